"""Renderers: a semantic type and a 64-bit index give a plausible value, always the same one.

Vectorised over indexes; each draw takes the next independent number of an index's stream.
"""

from __future__ import annotations

import calendar
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.index_stream import IndexStream
from palimpsest.functions.validators import INN_10, INN_11, INN_12
from palimpsest.plans.rulepack import RulePack

Render = Callable[[IndexStream], np.ndarray]


def _text(digits: np.ndarray) -> np.ndarray:
    """Rows of digits as strings."""
    return np.ascontiguousarray(digits + 48, dtype=np.uint32).view(f"U{digits.shape[1]}").ravel()


def _with_check(digits: np.ndarray, weights: tuple[int, ...]) -> np.ndarray:
    check = digits @ np.array(weights) % 11 % 10
    return np.column_stack([digits, check])


def codes(values: list[str], width: int, name: str) -> np.ndarray:
    """Component values that are codes of exactly ``width`` digits."""
    if not values:
        raise ValueError(f"empty component list {name}")
    if bad := [v for v in values if len(v) != width or not (v.isascii() and v.isdigit())]:
        raise ValueError(f"{name}: {bad[0]!r} is not a code of {width} digits")
    return np.array(values)


def _digits_of(texts: np.ndarray) -> np.ndarray:
    return np.array([[int(c) for c in t] for t in texts], np.int64).reshape(len(texts), -1)


class Renderers:
    """The renderers of a rule pack: those registered with it, then dates, structured identifiers, templates."""

    def __init__(self, pack: RulePack):
        self.by_type: dict[str, Render] = dict(pack.renderers)
        c = pack.components
        if "birth_year" in c:
            years = codes(c["birth_year"], 4, "birth_year").astype(np.int64)
            self.by_type.setdefault("birth_date", lambda s: _dates(s, years))
        if "inn_region" in c:
            regions = _digits_of(codes(c["inn_region"], 2, "inn_region"))
            self.by_type.setdefault("inn_person", lambda s: _text(_with_check(_with_check(np.column_stack([s.pick(regions), s.digits(8)]), INN_11), INN_12)))
            self.by_type.setdefault("inn_legal", lambda s: _text(_with_check(np.column_stack([s.pick(regions), s.digits(7)]), INN_10)))
        self.by_type.setdefault("snils", _snils)
        if "phone_operator" in c:
            operators = codes(c["phone_operator"], 3, "phone_operator")
            self.by_type.setdefault("phone", lambda s: _joined("+7", s.pick(operators), _text(s.digits(7))))
        if "passport_series" in c:
            series = codes(c["passport_series"], 4, "passport_series")
            self.by_type.setdefault("passport", lambda s: _joined(s.pick(series), " ", _text(s.digits(6))))
        for semantic_type in pack.templates:
            self.by_type.setdefault(semantic_type, lambda s, t=semantic_type: _template(s, pack, t))

    def supports(self, semantic_type: str) -> bool:
        return semantic_type in self.by_type

    def render(self, semantic_type: str, indexes: np.ndarray) -> np.ndarray:
        """Values for unsigned 64-bit indexes."""
        if semantic_type not in self.by_type:
            raise ValueError(f"no generator for type {semantic_type}")
        if not len(indexes):
            return np.array([], object)
        return self.by_type[semantic_type](IndexStream(indexes)).astype(object)


def _joined(*parts: str | np.ndarray) -> np.ndarray:
    out = parts[0]
    for part in parts[1:]:
        out = np.char.add(out, part)
    return out


def _snils(s: IndexStream) -> np.ndarray:
    d = s.digits(9)
    total = d @ np.arange(9, 0, -1)
    control = np.where(total < 100, total, np.where(total <= 101, 0, total % 101 % 100))
    t = _text(np.column_stack([d, control // 10, control % 10]))
    return _joined(*[x for a, b, sep in ((0, 3, "-"), (3, 6, "-"), (6, 9, " "), (9, 11, "")) for x in (np.array([v[a:b] for v in t]), sep)])


def _dates(s: IndexStream, years: np.ndarray) -> np.ndarray:
    year, month = s.pick(years), 1 + s.draw(12)
    lengths = np.array([calendar.monthrange(y, m)[1] for y, m in zip(year.tolist(), month.tolist(), strict=True)])
    day = np.empty(len(year), np.int64)
    for length in np.unique(lengths).tolist():  # the bound of the third draw differs
        at = np.flatnonzero(lengths == length)
        part = IndexStream(s.state[at])
        day[at] = 1 + part.draw(length)
        s.state[at] = part.state
    return np.array([f"{y:04d}-{m:02d}-{d:02d}" for y, m, d in zip(year.tolist(), month.tolist(), day.tolist(), strict=True)])


def _template(s: IndexStream, pack: RulePack, semantic_type: str) -> np.ndarray:
    variants = pack.templates[semantic_type]
    which = s.draw(len(variants))
    out = np.empty(len(which), object)
    for k, template in enumerate(variants):
        at = np.flatnonzero(which == k)
        part = IndexStream(s.state[at])
        pieces = [part.pick(np.array(pack.components[text], object)) if is_component else text for is_component, text in template.parts]
        value = np.full(len(at), "", object)
        for piece in pieces:
            value = value + piece
        out[at] = value
    return out


def rendered(pack: RulePack, semantic_type: str, index_hex: Column, probe: Column | None = None) -> Column:
    """Values for indexes of 16 hex digits, ``probe`` added modulo 2^64; null for null indexes."""
    renderers = Renderers(pack)
    if not renderers.supports(semantic_type):
        raise ValueError(f"no generator for type {semantic_type}")

    @F.pandas_udf("string")
    def run(index: pd.Series, step: pd.Series) -> pd.Series:
        out = pd.Series(None, index=index.index, dtype=object)
        known = index.notna()
        if known.any():
            at = np.frombuffer(bytes.fromhex("".join(index[known])), ">u8").astype(np.uint64)
            with np.errstate(over="ignore"):
                at = at + step[known].to_numpy().astype(np.uint64)
            out[known] = Renderers(pack).render(semantic_type, at)
        return out

    return run(index_hex, F.lit(0) if probe is None else probe)
