"""Which columns hold personal data, of which type, and how they are to be replaced."""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

from palimpsest.functions.validators import INN_10, INN_11, INN_12

from .model import FREE_TEXT, Features, PolicyColumn
from .rulepack import Rule, RulePack

# What each signal is worth, and the levels at which it decides.
NAME, COMMENT, FORMAT, CHECKSUM = 0.55, 0.75, 0.70, 0.95
SAMPLE_SHARE = 0.90
NOISE, SURE = 0.40, 0.85
LONG_TEXT = 40
DICTIONARY_BELOW = 100_000


def _sum_ok(digits: str, weights: tuple[int, ...]) -> bool:
    return sum(int(d) * w for d, w in zip(digits, weights, strict=False)) % 11 % 10 == int(digits[len(weights)])


def inn_ok(v: str) -> bool:
    if not re.fullmatch("[0-9]{10}|[0-9]{12}", v):
        return False
    return _sum_ok(v, INN_10) if len(v) == 10 else _sum_ok(v, INN_11) and _sum_ok(v, INN_12)


def snils_ok(v: str) -> bool:
    d = re.sub("[^0-9]", "", v)
    if len(d) != 11:
        return False
    total = sum(int(c) * (9 - i) for i, c in enumerate(d[:9]))
    return int(d[9:]) == (total if total < 100 else 0 if total <= 101 else total % 101 % 100)


CHECKS: dict[str, Callable[[str], bool]] = {"inn": inn_ok, "snils": snils_ok}


def _share(values: list[str], test: Callable[[str], object]) -> float:
    return sum(bool(test(v)) for v in values) / len(values)


def score(pack: RulePack, rule: Rule, f: Features) -> tuple[float, str]:
    """Confidence that a rule's type fits a column, and the last signal that added to it.

    Signals are independent: confidences combine as 1 - (1 - a)(1 - b).
    """
    kind = f.data_type.lower()
    if rule.data_types and not any(t.lower() in kind for t in rule.data_types):
        return 0.0, "ColumnName"
    left, source = 1.0, "ColumnName"
    if any(p.search(f.address.column) for p in pack.name_patterns(rule)):
        left *= 1 - NAME
    if f.comment and any(p.search(f.comment) for p in pack.comment_patterns(rule)):
        left, source = left * (1 - COMMENT), "ObjectComment"
    sample = [v for v in f.sample if v and not v.isspace()]
    if sample:
        if rule.value and _share(sample, regex.compile(rule.value).search) >= SAMPLE_SHARE:
            left, source = left * (1 - FORMAT), "ValueFormat"
        if rule.checksum:
            if rule.checksum not in CHECKS:
                raise ValueError(f"unknown checksum {rule.checksum!r}")
            if _share(sample, CHECKS[rule.checksum]) >= SAMPLE_SHARE:
                left, source = left * (1 - CHECKSUM), "ValueFormat"
    return 1 - left, source


def strategy_for(f: Features) -> str:
    """A schema's domain needs a permutation; unique, key and not too varied columns a dictionary."""
    if f.finite_domain:
        return "Derangement"
    if f.is_unique or f.is_primary_key or f.is_foreign_key or 0 < f.distinct <= DICTIONARY_BELOW:
        return "Dictionary"
    return "Function"


def is_text_like(data_type: str, average_length: float) -> bool:
    return "text" in data_type.lower() or average_length >= LONG_TEXT


def classify(pack: RulePack, f: Features) -> PolicyColumn:
    """The verdict on one column. Of equal confidences the more specific type (smaller rank) wins."""
    best, confidence, source = None, 0.0, "ColumnName"
    for rule in pack.rules:
        got, by = score(pack, rule, f)
        if got > confidence:
            best, confidence, source = rule, got, by
    if best is not None and confidence >= NOISE:
        return PolicyColumn(f.address, f.data_type, True, best.semantic_type, best.mode, strategy_for(f), best.canonical_kind, confidence, source, needs_approval=confidence < SURE)
    if is_text_like(f.data_type, f.average_length):
        unmeasured, found = f.text_hit_share < 0, f.text_hit_share > 0
        if unmeasured or found:
            return PolicyColumn(f.address, f.data_type, True, FREE_TEXT, "TextWipe", "Function", confidence=max(0.0, f.text_hit_share), source="TextDetector", needs_approval=unmeasured)
        return PolicyColumn(f.address, f.data_type, mode="TextWipe", source="TextDetector", reason="the detector found nothing in a sample of the text")
    return PolicyColumn(f.address, f.data_type, reason="no signal above the level of noise")
