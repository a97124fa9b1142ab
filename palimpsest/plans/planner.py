"""From an accepted policy to a plan: which tables are rewritten, which values share a dictionary."""

from __future__ import annotations

import json
from dataclasses import dataclass

from .model import Address, Policy, PolicyColumn


@dataclass
class Domain:
    """Columns of one semantic type, whose values share one dictionary."""

    semantic_type: str
    members: list[PolicyColumn]
    constrained: bool = False
    allowed: tuple[str, ...] = ()


@dataclass
class Plan:
    tables: dict[str, list[PolicyColumn]]
    domains: list[Domain]
    untouched: dict[str, str]


def build_plan(policy: Policy, finite_domains: dict[Address, list[str]] | None = None) -> Plan:
    """The plan of a policy without problems; everything in it is sorted by name.

    Columns of one type that the schema restricts to different sets of values may only take values of
    all these sets.
    """
    if problems := policy.problems():
        raise ValueError("the policy can't be run: " + "; ".join(problems))
    finite_domains = finite_domains or {}
    tables: dict[str, list[PolicyColumn]] = {}
    members: dict[str, list[PolicyColumn]] = {}
    untouched = {}
    for c in sorted(policy.columns, key=lambda c: c.address):
        if c.strategy == "None":
            untouched[c.address.qualified] = c.reason
            continue
        tables.setdefault(f"{c.address.schema}.{c.address.table}", []).append(c)
        if c.strategy in ("Dictionary", "Derangement"):
            members.setdefault(c.semantic_type, []).append(c)
    domains = []
    for semantic_type in sorted(members):
        columns = members[semantic_type]
        restricted = [c for c in columns if c.strategy == "Derangement"]
        allowed: tuple[str, ...] = ()
        for c in restricted:
            if not finite_domains.get(c.address):
                raise ValueError(f"{c.address.qualified}: a permutation needs the values that the schema allows")
            own = set(finite_domains[c.address])
            allowed = tuple(sorted(own if not allowed else own & set(allowed)))
        domains.append(Domain(semantic_type, columns, bool(restricted), allowed))
    return Plan(dict(sorted(tables.items())), domains, untouched)


def plan_files(plan: Plan) -> dict[str, str]:
    """One JSON text a table: its columns in order, with type, mode, strategy and canonical kind.

    Columns of one name may differ between tables, so no file holds two tables.
    """
    out = {}
    for table, columns in plan.tables.items():
        rows = [{"column": c.address.column, "semantic_type": c.semantic_type, "mode": c.mode, "strategy": c.strategy, "canonical_kind": c.canonical_kind, "document_paths": c.document_paths} for c in columns]
        out[table] = json.dumps({"table": table, "columns": rows}, ensure_ascii=False, sort_keys=True)
    return out
