"""A run's passport: what was replaced and how, what was checked, and whether it may be published."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from .model import CheckResult, Policy

#: Types whose replacements have no content of the rule pack, only digits and checks.
TECHNICAL = ("snils",)


@dataclass
class Passport:
    run_id: str
    requested_by: str
    started_at: str
    schema_fingerprint: str
    artifact_fingerprint: str
    replaced: list[dict]
    untouched: list[dict]
    domains: list[dict]
    checks: list[CheckResult]
    model_share: float
    technical_types: list[str]
    risks: list[str] = field(default_factory=list)
    #: By table: rows, and by column the cells replaced and unchanged.
    counts: dict[str, dict] = field(default_factory=dict)

    @property
    def failed_blocking(self) -> int:
        return sum(not c.passed and c.blocking for c in self.checks)

    @property
    def publishable(self) -> bool:
        return self.failed_blocking == 0

    def to_json(self) -> str:
        return json.dumps(asdict(self) | {"publishable": self.publishable, "failed_blocking": self.failed_blocking}, ensure_ascii=False, indent=1)

    def to_markdown(self) -> str:
        verdict = "may be published" if self.publishable else f"may NOT be published: {self.failed_blocking} blocking checks failed"
        lines = [f"# Run {self.run_id}", "", f"The result {verdict}.", "", "| column | type | mode | strategy |", "| --- | --- | --- | --- |"]
        lines += [f"| {c['column']} | {c['semantic_type']} | {c['mode']} | {c['strategy']} |" for c in self.replaced]
        lines += ["", "| requirement | check | passed | blocking | detail |", "| --- | --- | --- | --- | --- |"]
        lines += [f"| {c.requirement} | {c.name} | {c.passed} | {c.blocking} | {c.detail} |" for c in self.checks]
        lines += ["", f"Share of replaced columns with content of the rule pack: {self.model_share:.2f}", "", *(f"- {r}" for r in self.risks)]
        return "\n".join(lines) + "\n"


def model_share(types: list[str]) -> float:
    """Share of replaced columns whose content comes from the rule pack; 1 without any."""
    return 1.0 if not types else sum(t not in TECHNICAL for t in types) / len(types)


def build_passport(run_id: str, policy: Policy, checks: list[CheckResult], domains: list[dict], started_at: str = "", requested_by: str = "") -> Passport:
    def entry(c) -> dict:
        return {"column": c.address.qualified, "semantic_type": c.semantic_type, "mode": c.mode, "strategy": c.strategy, "source": c.source, "reason": c.reason}

    replaced = [c for c in policy.columns if c.strategy != "None"]
    types = [c.semantic_type for c in replaced]
    risks = ["quasi-identifiers are not generalised"]
    if any(c.mode == "TextWipe" for c in replaced):
        risks.append("free text is wiped whole; its content is lost")
    risks += [f"exception: {e}" for e in policy.exceptions] + [f"departure: {d}" for d in policy.departures]
    return Passport(run_id, requested_by, started_at, policy.schema_fingerprint, policy.artifact_fingerprint, [entry(c) for c in replaced], [entry(c) for c in policy.columns if c.strategy == "None"], domains, checks, model_share(types), sorted(set(types) & set(TECHNICAL)), risks)
