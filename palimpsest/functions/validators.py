"""Plausibility of values by semantic type, and checksums by name, as Column predicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the checks of taxpayer numbers.
INN_10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN_11 = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN_12 = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)


def _digit(c: Column, at: int) -> Column:
    return F.substring(c, at + 1, 1).try_cast("int")


def _weighted(c: Column, weights: tuple[int, ...]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + _digit(c, i) * w
    return total


def _check(c: Column, weights: tuple[int, ...]) -> Column:
    return _weighted(c, weights) % 11 % 10 == _digit(c, len(weights))


def valid_inn(c: Column) -> Column:
    """Taxpayer number of 10 (companies) or 12 digits (persons)."""
    ten = c.rlike("^[0-9]{10}$") & _check(c, INN_10)
    return F.coalesce(ten | c.rlike("^[0-9]{12}$") & _check(c, INN_11) & _check(c, INN_12), F.lit(False))


def valid_snils(c: Column) -> Column:
    """Insurance number: 11 digits, whatever stands between them."""
    d = F.regexp_replace(c, "[^0-9]", "")
    total = _weighted(d, (9, 8, 7, 6, 5, 4, 3, 2, 1))
    want = F.when(total < 100, total).when(total.isin(100, 101), 0).otherwise(total % 101 % 100)
    return F.coalesce((F.length(d) == 11) & (F.substring(d, 10, 2).try_cast("int") == want), F.lit(False))


CHECKSUMS: dict[str, Callable[[Column], Column]] = {"inn": valid_inn, "snils": valid_snils}


def checksum(name: str) -> Callable[[Column], Column] | None:
    """The checksum of that name; none for an empty one."""
    if not name:
        return None
    if name not in CHECKSUMS:
        raise ValueError(f"unknown checksum {name!r}")
    return CHECKSUMS[name]


def _words(c: Column) -> Column:
    """Not blank, no space at either end, no control characters."""
    return (F.length(c) > 0) & ~c.rlike(r"(?U)^\s|\s$|\p{Cntrl}")


def _date(c: Column) -> Column:
    return c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & c.try_cast("date").isNotNull()


#: Predicates by semantic type; other types have none and are not checked.
VALIDATORS: dict[str, Callable[[Column], Column]] = {
    "inn_person": valid_inn,
    "inn_legal": valid_inn,
    "snils": valid_snils,
    "phone": lambda c: c.rlike(r"^\+7[0-9]{10}$"),
    "email": lambda c: c.rlike(r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$"),
    "birth_date": _date,
    "passport": lambda c: c.rlike("^[0-9]{4} [0-9]{6}$"),
    "marital_status": _words,
    "full_name": _words,
    "last_name": _words,
    "street": _words,
    "city": _words,
    "postal_address": _words,
    "free_text": _words,
}


def valid(c: Column, semantic_type: str) -> Column | None:
    """Whether values are plausible for a type (null for null values); None if the type has no validator."""
    test = VALIDATORS.get(semantic_type)
    return None if test is None else F.when(c.isNotNull(), F.coalesce(test(c), F.lit(False)))
