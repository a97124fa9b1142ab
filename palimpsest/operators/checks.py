"""Checks of a result against its source. Full joins throughout: no violation hides behind a sample."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.canonical import canonical
from palimpsest.functions.validators import valid
from palimpsest.plans.model import CheckResult, PolicyColumn
from palimpsest.plans.storage import stage_table

from .containment import holding
from .profile import aggregates, as_text, unpivoted

TOLERANCE = 0.05
#: Shortest text of the source looked for within wiped texts.
NEEDLE = 6
#: Needles, and bytes of them, that are sent to the workers at most.
BROADCAST_NEEDLES = 100_000
BROADCAST_BYTES = 1 << 21  # an automaton takes about 50 times as much
#: Offending values that a failed check names.
EXAMPLES = 10
#: Types whose values are common words and are not looked for.
COMMON = ("marital_status", "city")


def check_schema(source: DataFrame, result: DataFrame) -> CheckResult:
    """Same names, order and types of columns, and no column that takes nulls where it took none.

    Files and rewritten columns may be nullable where the source was not; then the values decide.
    """
    a, b = ([(f.name, f.dataType.simpleString()) for f in df.schema.fields] for df in (source, result))
    if a != b:
        return CheckResult("F-11", "schema", False, True, f"{a} became {b}")
    looser = [f.name for f, g in zip(source.schema.fields, result.schema.fields, strict=True) if g.nullable and not f.nullable]
    nulls = result.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{k}") for k, c in enumerate(looser)]).first() if looser else []
    bad = [c for c, n in zip(looser, nulls, strict=True) if n]
    return CheckResult("F-11", "schema", not bad, True, f"nulls in {', '.join(bad)}" if bad else "")


def check_volume(source: DataFrame, result: DataFrame, table: str = "") -> CheckResult:
    a, b = source.count(), result.count()
    return CheckResult("F-9", f"volume {table}".strip(), a == b, True, f"{a} rows became {b}")


def _pairs(source: DataFrame, result: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``before`` and ``after`` of a column by key."""
    a = source.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], as_text(source, column).alias("before"))
    b = result.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], as_text(result, column).alias("after"))
    same = [F.col(f"a.k{i}").eqNullSafe(F.col(f"b.k{i}")) for i in range(len(keys))]  # rows with a null in the key count, too
    return a.alias("a").join(b.alias("b"), same).select(*[f"a.k{i}" for i in range(len(keys))], "before", "after")


def survivors(source: DataFrame, result: DataFrame, keys: list[str], column: str, kind: str = "Text") -> int:
    """Rows that keep their value, compared in canonical form; rows are matched by the full key."""
    pairs = _pairs(source, result, keys, column)
    return pairs.where(canonical(F.col("before"), kind) == canonical(F.col("after"), kind)).count()


def surviving_values(source: DataFrame, result: DataFrame, column: str) -> int:
    """Different values of the result that the source has, too (for tables without a key)."""
    a, b = (df.select(as_text(df, column).alias("value")).where("trim(value) <> ''").distinct() for df in (source, result))
    return b.join(a, "value", "left_semi").count()


def check_completeness(source: DataFrame, result: DataFrame, keys: list[str] | None, column: PolicyColumn) -> CheckResult:
    """No value survives: by row where the table has a key, by set of values otherwise."""
    name = column.address.column
    left = survivors(source, result, keys, name, column.canonical_kind) if keys else surviving_values(source, result, name)
    return CheckResult("F-4", f"completeness {column.address.qualified}", left == 0, True, f"{left} {'rows' if keys else 'values'} survive")


def needles(source: DataFrame, columns: list[str], shortest: int = NEEDLE) -> DataFrame:
    """``needle``: different texts of sensitive columns that are worth looking for."""
    cells = unpivoted(source, columns).where(F.length("value") >= shortest)
    return cells.select(F.col("value").alias("needle")).distinct()


_automata: dict[str, object] = {}


def _automaton(mark: str, some: list[str]):
    """The automaton of the needles sent under a mark, once per worker."""
    import ahocorasick

    if mark not in _automata:
        _automata.clear()
        found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for needle in some:
            found.add_word(needle)
        found.make_automaton()
        _automata[mark] = found
    return _automata[mark]


def containing(texts: DataFrame, column: str, sought: DataFrame, most: int = BROADCAST_NEEDLES) -> int:
    """Rows whose text holds any of the needles.

    Up to ``most`` needles of ``BROADCAST_BYTES`` together, counted first, go to the workers as one
    multi-pattern automaton. Beyond that, ``containment`` indexes each by its rarest gram.
    """
    sought = stage_table(sought.where(F.length("needle") >= NEEDLE), "sought")  # counted, then sent or indexed
    body = texts.select(as_text(texts, column).alias("text")).where(F.length("text") >= NEEDLE)
    n, size = sought.agg(F.count("*"), F.sum(F.octet_length("needle"))).first()
    if not n:
        return 0
    if n <= most and size <= BROADCAST_BYTES:
        sent, mark = texts.sparkSession.sparkContext.broadcast([r["needle"] for r in sought.collect()]), uuid.uuid4().hex

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _automaton(mark, sent.value)
            for part in parts:
                n = sum(next(found.iter(t), None) is not None for t in part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

        return body.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return holding(body, "text", sought).count()


def check_containment(result: DataFrame, column: PolicyColumn, sought: DataFrame) -> CheckResult:
    n = containing(result, column.address.column, sought)
    return CheckResult("F-4a", f"containment {column.address.qualified}", n == 0, True, f"{n} rows hold a source value")


def conflicts(pairs: DataFrame) -> DataFrame:
    """Values (``key``) with more than one replacement (``after``)."""
    return pairs.groupBy("key").agg(F.count_distinct("after").alias("replacements")).where("replacements > 1")


def check_consistency(members: list[tuple[DataFrame, DataFrame, list[str], PolicyColumn]], semantic_type: str) -> CheckResult:
    """One source value, one replacement, over all columns of a domain that have a row key."""
    parts = []
    for source, result, keys, c in members:
        pairs = _pairs(source, result, keys, c.address.column)
        parts.append(pairs.select(canonical(F.col("before"), c.canonical_kind).alias("key"), "after").where("key is not null"))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    n = conflicts(union).count()
    return CheckResult("F-7", f"consistency {semantic_type}", n == 0, True, f"{n} values have several replacements")


def check_fixed_points(source: DataFrame, result: DataFrame, keys: list[str], column: PolicyColumn) -> CheckResult:
    n = survivors(source, result, keys, column.address.column, column.canonical_kind)
    return CheckResult("R-3", f"derangement {column.address.qualified}", n == 0, True, f"{n} fixed points")


def check_diversity(source: DataFrame, result: DataFrame, columns: list[PolicyColumn]) -> list[CheckResult]:
    """Shares of nulls are equal and different values at most 5 % fewer; of wiped texts only the former,
    and without blocking. Values are compared in canonical form, since spellings of one value merge."""
    if not columns:
        return []
    names = [c.address.column for c in columns]

    def keyed(df: DataFrame) -> DataFrame:
        own = [(F.col(f"`{c.address.column}`").cast("string") if c.mode != "Typed" else canonical(F.col(f"`{c.address.column}`"), c.canonical_kind)).alias(c.address.column) for c in columns]
        return df.select(*own)

    a, b = ({r["column"]: r for r in aggregates(keyed(df), names, exact=True).collect()} for df in (source, result))
    out = []
    for c in columns:
        x, y = a[c.address.column], b[c.address.column]
        nulls = abs(x["null_share"] - y["null_share"]) <= 1e-9
        loss = 1 - y["distinct_values"] / x["distinct_values"] if x["distinct_values"] else 0.0
        typed = c.mode == "Typed"
        out.append(CheckResult("F-10", f"diversity {c.address.qualified}", nulls and (loss <= TOLERANCE or not typed), typed, f"{x['distinct_values']} values became {y['distinct_values']}, null share {x['null_share']:.6f} became {y['null_share']:.6f}"))
    return out


def implausible(result: DataFrame, column: str, semantic_type: str) -> int | None:
    """Values of the result that don't look like their type; None if it has no validator."""
    test = valid(F.col("value"), semantic_type)
    if test is None:
        return None
    return result.select(as_text(result, column).alias("value")).where("trim(value) <> ''").where(~test).count()


def offending(result: DataFrame, column: str, semantic_type: str, n: int = EXAMPLES) -> DataFrame:
    """The first ``n`` different values that don't look like their type, in order."""
    test = valid(F.col("value"), semantic_type)
    values = result.select(as_text(result, column).alias("value")).where("trim(value) <> ''")
    return values.where(F.lit(False) if test is None else ~test).distinct().orderBy("value").limit(n)


def check_plausibility(result: DataFrame, column: PolicyColumn) -> CheckResult | None:
    n = implausible(result, column.address.column, column.semantic_type)
    if n is None:
        return None
    named = ", ".join(repr(r["value"]) for r in offending(result, column.address.column, column.semantic_type).collect()) if n else ""
    return CheckResult("F-5", f"plausibility {column.address.qualified}", n == 0, True, f"{n} values are not plausible" + f", such as {named}" * bool(named))


def diff_sample(source: DataFrame, result: DataFrame, keys: list[str], columns: list[str], n: int = 10) -> DataFrame:
    """Keys with each column ``before`` and ``after``, for the ``n`` smallest keys of the source."""
    some = source.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]).distinct().orderBy(*[f"k{i}" for i in range(len(keys))]).limit(n)
    parts = []
    for c in columns:
        pairs = _pairs(source, result, keys, c)
        parts.append(some.join(pairs, [f"k{i}" for i in range(len(keys))]).select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.lit(c).alias("column"), "before", "after"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> int:
    """Rows whose foreign key has no match."""
    c = child.select(F.col(f"`{column}`").alias("k")).where("k is not null")
    return c.join(parent.select(F.col(f"`{key}`").alias("k")), "k", "left_anti").count()


def check_foreign_key(child: DataFrame, column: str, parent: DataFrame, key: str, name: str) -> CheckResult:
    n = orphans(child, column, parent, key)
    return CheckResult("F-8", f"foreign key {name}", n == 0, True, f"{n} rows have lost their parent")


def check_spellings(source: DataFrame, column: PolicyColumn) -> CheckResult:
    """Before a run: different spellings of one value in a unique column would become one replacement."""
    name = column.address.column
    row = source.agg(F.count_distinct(F.col(f"`{name}`").cast("string")), F.count_distinct(canonical(F.col(f"`{name}`"), column.canonical_kind))).first()
    return CheckResult("F-7", f"spellings {column.address.qualified}", row[0] == row[1], True, f"{row[0]} spellings of {row[1]} values")
