"""What a run decides and reports: column policies, plans, checks, as plain data."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("Typed", "TextWipe", "TextSpot", "Document")
STRATEGIES = ("None", "Dictionary", "Derangement", "Function")
UNKNOWN = "unknown"
FREE_TEXT = "free_text"


def type_id(text: str) -> str:
    """A semantic type's name: trimmed, lower case, not blank."""
    out = text.strip().lower()
    if not out:
        raise ValueError("a semantic type has a name")
    return out


class TypeRegistry:
    """Ranks of semantic types; ranks differ, and the smallest one is the most specific."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks = {type_id(k): v for k, v in ranks.items()}
        if UNKNOWN in self.ranks:
            raise ValueError(f"{UNKNOWN} is reserved")
        if len(set(self.ranks.values())) < len(self.ranks):
            raise ValueError("two semantic types share a rank")

    def most_specific(self, types: list[str]) -> str:
        """The most specific of several; types without rank come last, by name; none gives ``unknown``."""
        return min((type_id(t) for t in types), key=lambda t: (self.ranks.get(t, 1 << 62), t), default=UNKNOWN)

    def most_specific_of(self, types: Column) -> Column:
        """The same of an array in each row; null or blank types are none."""
        ranks = F.create_map(*[F.lit(x) for pair in self.ranks.items() for x in pair]) if self.ranks else F.create_map().cast("map<string,long>")
        named = F.filter(F.transform(types, lambda t: F.lower(F.trim(t))), lambda t: t != "")
        ranked = F.transform(named, lambda t: F.struct(F.coalesce(F.try_element_at(ranks, t).cast("long"), F.lit(1 << 62)).alias("rank"), t.alias("type")))
        return F.coalesce(F.array_min(ranked)["type"], F.lit(UNKNOWN))


@dataclass(frozen=True, order=True)
class Address:
    """A column's place."""

    schema: str
    table: str
    column: str

    @property
    def qualified(self) -> str:
        return f"{self.schema}.{self.table}.{self.column}"

    @classmethod
    def parse(cls, text: str) -> Address:
        schema, table, column = text.split(".", 2)
        return cls(schema, table, column)


@dataclass
class Features:
    """All that classification looks at for a column. ``text_hit_share`` -1: no detector has run."""

    address: Address
    data_type: str
    comment: str = ""
    nullable: bool = True
    is_primary_key: bool = False
    is_unique: bool = False
    is_foreign_key: bool = False
    finite_domain: list[str] = field(default_factory=list)
    rows: int = 0
    distinct: int = 0
    null_share: float = 0.0
    average_length: float = 0.0
    sample: list[str] = field(default_factory=list)
    text_hit_share: float = -1.0


@dataclass
class PolicyColumn:
    address: Address
    data_type: str
    sensitive: bool = False
    semantic_type: str = UNKNOWN
    mode: str = "Typed"
    strategy: str = "None"
    canonical_kind: str = "Text"
    confidence: float = 0.0
    source: str = "ValueFormat"
    reason: str = ""
    needs_approval: bool = False
    document_paths: dict[str, str] = field(default_factory=dict)


@dataclass
class Approval:
    """A person's word on one column."""

    column: str
    sensitive: bool
    semantic_type: str = UNKNOWN
    mode: str | None = None
    strategy: str | None = None
    reason: str = ""
    accepted_by: str = ""


@dataclass
class Policy:
    schema_fingerprint: str
    artifact_fingerprint: str
    columns: list[PolicyColumn]
    exceptions: list[str] = field(default_factory=list)
    departures: list[str] = field(default_factory=list)
    version: int = 1

    def problems(self) -> list[str]:
        """Why the policy can't be run; empty if it can."""
        out = []
        if not self.schema_fingerprint:
            out.append("no schema fingerprint")
        if not self.artifact_fingerprint:
            out.append("no artifact fingerprint")
        from palimpsest.functions.canonical import KINDS

        seen: set[str] = set()
        for c in self.columns:
            name = c.address.qualified
            if name in seen:
                out.append(f"{name}: listed twice")
            seen.add(name)
            if c.sensitive and c.strategy == "None" and not c.reason:
                out.append(f"{name}: sensitive, but neither a strategy nor a reason")
            if not c.sensitive and c.strategy != "None":
                out.append(f"{name}: a strategy on a column that is not sensitive")
            if c.strategy != "None" and c.semantic_type == UNKNOWN:
                out.append(f"{name}: a strategy without a semantic type")
            if c.needs_approval:
                out.append(f"{name}: waits for approval")
            if c.canonical_kind not in KINDS:
                out.append(f"{name}: unknown canonical kind {c.canonical_kind}")
            if c.mode not in MODES or c.strategy not in STRATEGIES:
                out.append(f"{name}: unknown mode or strategy")
        return out

    def approved(self, approvals: list[Approval]) -> Policy:
        """The policy with people's decisions in place of its own."""
        by_name = {a.column: a for a in approvals}
        unknown = set(by_name) - {c.address.qualified for c in self.columns}
        if unknown:
            raise ValueError(f"approvals of unknown columns: {', '.join(sorted(unknown))}")
        return replace(self, columns=[_approved(c, by_name[c.address.qualified]) if c.address.qualified in by_name else c for c in self.columns])

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, indent=1, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Policy:
        raw = json.loads(text)
        raw["columns"] = [PolicyColumn(**c | {"address": Address(**c["address"])}) for c in raw["columns"]]
        return cls(**raw)


def _approved(c: PolicyColumn, a: Approval) -> PolicyColumn:
    common: dict[str, Any] = {"confidence": 1.0, "source": "Human", "reason": a.reason, "needs_approval": False}
    if not a.sensitive:
        return replace(c, sensitive=False, semantic_type=UNKNOWN, strategy="None", **common)
    mode = a.mode or c.mode
    strategy = "Function" if mode in ("TextWipe", "Document") else a.strategy or (c.strategy if c.strategy != "None" else "Function")
    return replace(c, sensitive=True, semantic_type=type_id(a.semantic_type), mode=mode, strategy=strategy, **common)


@dataclass(frozen=True)
class CheckResult:
    requirement: str
    name: str
    passed: bool
    blocking: bool
    detail: str = ""
