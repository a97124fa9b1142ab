"""Canonical forms: one text for all spellings of a value, so that one value has one replacement.

Everything is a Column expression. Null, empty and blank values are no key (null). A value that doesn't
fit its kind fails the run; it is never passed through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("Text", "EmailAddress", "Integer", "Decimal", "Boolean", "Timestamp", "Binary")
#: Largest exponent that a decimal text may have.
EXPONENT = 10_000
#: Decimal texts that are canonical as they stand.
DECIMAL_DONE = r"^(0|-?[1-9][0-9]*|-?(0|[1-9][0-9]*)\.[0-9]*[1-9])$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _not_blank(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def _fail(kind: str, c: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"not a valid {kind}: "), c)).cast("string")


def text(c: Column) -> Column:
    """Without trailing spaces (U+0020 only); case and leading spaces count."""
    return _not_blank(F.rtrim(c))


def email(c: Column) -> Column:
    return _not_blank(F.lower(F.rtrim(c)))


def integer(c: Column) -> Column:
    """Any number of digits, without sign of zero and leading zeros."""
    t = _not_blank(F.trim(c))
    digits = F.regexp_replace(F.regexp_replace(t, r"^[+-]", ""), r"^0+(?=\d)", "")
    signed = F.when(t.startswith("-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits)
    return F.when(t.isNull(), None).when(t.rlike(r"^[+-]?[0-9]+$"), signed).otherwise(_fail("integer", t))


def decimal(c: Column) -> Column:
    """Exact decimal text: exponents written out, no leading zeros, no zeros at the fraction's end."""
    form = r"^[+-]?([0-9]*)(?:\.([0-9]*))?(?:[eE]([+-]?[0-9]+))?$"

    def read(t: Column) -> Column:
        parts = F.struct(t.alias("t"), *[F.regexp_extract(t, form, k + 1).alias(name) for k, name in enumerate(("whole", "part", "power"))])
        return F.when(t.isNull() | t.rlike(DECIMAL_DONE), t).when(t.rlike(form), let(parts, shift)).otherwise(_fail("decimal", t))

    def shift(p: Column) -> Column:
        """The digits without a point, and how many of them are the fraction."""
        power = F.when(p["power"] == "", 0).otherwise(p["power"].try_cast("int"))
        number = F.struct(p["t"].alias("t"), F.concat(p["whole"], p["part"]).alias("digits"), (F.length(p["part"]) - power).alias("scale"), (F.abs(power) <= EXPONENT).alias("small"))
        return let(number, lambda n: F.when((F.length(n["digits"]) > 0) & n["small"], let(padded(n), point)).otherwise(_fail("decimal", n["t"])))

    def padded(n: Column) -> Column:
        scale = F.greatest(n["scale"], F.lit(0))
        digits = F.concat(n["digits"], F.repeat(F.lit("0"), F.greatest(-n["scale"], F.lit(0))))
        return F.struct(n["t"].startswith("-").alias("minus"), F.lpad(digits, F.greatest(F.length(digits), scale + 1), "0").alias("digits"), scale.alias("scale"))

    def point(n: Column) -> Column:
        whole = F.length(n["digits"]) - n["scale"]
        left = F.regexp_replace(F.substring(n["digits"], F.lit(1), whole), r"^0+(?=\d)", "")
        right = F.regexp_replace(F.substring(n["digits"], whole + 1, n["scale"]), "0+$", "")
        return let(F.struct(left.alias("left"), right.alias("right"), n["minus"].alias("minus")), written)

    def written(n: Column) -> Column:
        sign = F.when(n["minus"] & ~((n["left"] == "0") & (n["right"] == "")), "-").otherwise("")
        return F.concat(sign, n["left"], F.when(n["right"] == "", "").otherwise(F.concat(F.lit("."), n["right"])))

    return let(_not_blank(F.trim(c)), read)


def boolean(c: Column) -> Column:
    t = _not_blank(F.lower(F.trim(c)))
    return (
        F.when(t.isNull(), None)
        .when(t.isin("t", "true", "1", "yes", "y"), "true")
        .when(t.isin("f", "false", "0", "no", "n"), "false")
        .otherwise(_fail("boolean", t))
    )


def timestamp(c: Column) -> Column:
    """UTC with seven digits of a second; a text without offset is UTC whatever the session's zone."""
    def read(t: Column) -> Column:
        zoned = t.rlike(r"(?i)[0-9]:[0-9].*[0-9](Z|[+-][0-9]{1,2}(:?[0-9]{2})?)$")
        at = F.when(zoned, t).when(t.rlike("[0-9]:[0-9]"), F.concat(t, F.lit("Z"))).otherwise(F.concat(t, F.lit(" 00:00:00Z")))
        return F.when(t.isNull(), t).otherwise(let(F.struct(t.alias("t"), F.unix_micros(at.try_cast("timestamp")).alias("micros")), split))

    def split(n: Column) -> Column:
        rest = F.pmod(n["micros"], F.lit(86_400_000_000))
        day = F.floor(n["micros"] / F.lit(86_400_000_000)).cast("int")
        hundred = F.coalesce(F.nullif(F.regexp_extract(n["t"], r"\.[0-9]{6}([0-9])", 1), F.lit("")), F.lit("0"))
        return F.when(n["micros"].isNull(), _fail("timestamp", n["t"])).otherwise(let(F.struct(day.alias("day"), rest.alias("rest"), hundred.alias("hundred")), written))

    def two(n: Column) -> Column:
        return F.lpad(F.floor(n).cast("string"), 2, "0")

    def written(n: Column) -> Column:
        rest = n["rest"]
        return F.concat(
            F.date_from_unix_date(n["day"]).cast("string"), F.lit("T"), two(rest / 3_600_000_000), F.lit(":"), two(rest / 60_000_000 % 60), F.lit(":"), two(rest / 1_000_000 % 60),
            F.lit("."), F.lpad((rest % 1_000_000).cast("string"), 6, "0"), n["hundred"], F.lit("Z"),
        )

    return let(_not_blank(F.trim(c)), read)


def binary(c: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^\\x", ""), "(?i)^0x", "")
    t = _not_blank(t)
    return F.when(t.isNull(), None).when(t.rlike("^([0-9a-fA-F]{2})+$"), F.lower(t)).otherwise(_fail("binary", t))


_BY_KIND = dict(zip(KINDS, (text, email, integer, decimal, boolean, timestamp, binary), strict=True))


def canonical(c: Column, kind: str) -> Column:
    """The canonical text of a column's values; null where a value is no key."""
    if kind not in _BY_KIND:
        raise ValueError(f"unknown canonical kind {kind!r}; known: {', '.join(KINDS)}")
    return _BY_KIND[kind](c.cast("string"))
