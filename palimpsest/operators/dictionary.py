"""Replacement dictionaries: one (key, replacement) row for each value of a domain.

A dictionary is a bijection: no value is replaced by itself, and no two by the same one. Values propose
the candidates render(index), render(index + 1), ...; of the values that want one candidate the one with
the smallest key holds it, the others go on to their next. All candidates rank values alike, so the
outcome is the same as that of assigning values one by one in the order of keys, whatever the order of
rounds; that makes it a distributed operation.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.canonical import canonical
from palimpsest.functions.prf import Secret, index_hex
from palimpsest.plans.rulepack import RulePack
from palimpsest.plans.storage import stage_table

from .derange import constrained_derangement, derangement
from .generators import Renderers, rendered

#: Candidates that a value tries at most.
PROBES = 64
#: Domains of up to so many values are assigned in one pass on the driver.
SMALL = 20_000
#: Values of a list that a schema gives at most.
LISTED = 10_000


def domain_values(columns: Iterable[tuple[DataFrame, str, str]]) -> DataFrame:
    """``key``: the different canonical values of (table, column, canonical kind) triples."""
    parts = [df.select(canonical(F.col(f"`{c}`"), kind).alias("key")) for df, c, kind in columns]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("key is not null").distinct()


def listed(keys: DataFrame, most: int = LISTED) -> tuple[str, ...]:
    """The values of a domain as a list like that of a schema; more than ``most`` fail, as that is no list."""
    found = [r["key"] for r in keys.select("key").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} values are no finite domain")
    return tuple(found)


class PoolTooSmall(ValueError):
    """The type's pool has no replacement left for some value."""


def bijection(keys: DataFrame, semantic_type: str, pack: RulePack, secret: Secret, small: int = SMALL) -> DataFrame:
    """``key`` and ``replacement`` for each row of ``keys`` (column ``key``, all different).

    A domain that the type's templates are too few for takes all its replacements from the pack's reserve.
    """
    if not Renderers(pack).supports(semantic_type):
        raise ValueError(f"no generator for type {semantic_type}")
    at = stage_table(secret.keyed(keys).select("key", index_hex(F.col("key")).alias("index")), "keys")
    n, wider = at.count(), pack.wider(semantic_type)
    assign = _assigned if n <= small else _proposed
    if wider is None:
        return assign(at, semantic_type, pack)
    if n <= pack.cardinality(semantic_type):
        try:
            return assign(at, semantic_type, pack)
        except PoolTooSmall:
            pass
    return assign(at, semantic_type, wider)


def _assigned(at: DataFrame, semantic_type: str, pack: RulePack) -> DataFrame:
    """The same map for a domain whose size has been checked, one value after the other."""
    renderers = Renderers(pack)
    rows = sorted((r["key"], int(r["index"], 16)) for r in at.collect())
    first = renderers.render(semantic_type, np.array([i for _, i in rows], np.uint64)) if rows else []
    used: set[str] = set()
    out = []
    for (key, index), candidate in zip(rows, first, strict=True):
        probe = 0
        while candidate == key or candidate in used:
            probe += 1
            if probe == PROBES:
                raise PoolTooSmall(f"{semantic_type}: the pool is too small for {len(rows)} values")
            candidate = renderers.render(semantic_type, np.array([(index + probe) % (1 << 64)], np.uint64))[0]
        used.add(candidate)
        out.append((key, candidate))
    return at.sparkSession.createDataFrame(out, "key string, replacement string")


def _proposed(at: DataFrame, semantic_type: str, pack: RulePack) -> DataFrame:
    """Rounds of proposals; only values that lose in a round render a new candidate."""
    at = at.withColumn("probe", F.lit(0)).withColumn("replacement", rendered(pack, semantic_type, F.col("index")))
    while True:
        at = stage_table(at, "proposals")
        best = at.where("replacement <> key").groupBy("replacement").agg(F.min("key").alias("holder"))
        at = at.join(best, "replacement", "left").withColumn("lost", F.coalesce(F.col("holder") != F.col("key"), F.lit(True)))
        at = stage_table(at.drop("holder"), "rounds")
        lost = at.where("lost").withColumn("probe", F.col("probe") + 1)
        worst = lost.agg(F.max("probe")).first()[0]
        if worst is None:
            return at.select("key", "replacement")
        if worst >= PROBES:
            raise PoolTooSmall(f"{semantic_type}: the pool is too small for its values")
        again = lost.withColumn("replacement", rendered(pack, semantic_type, F.col("index"), F.col("probe")))
        columns = ["key", "index", "probe", "replacement"]
        at = at.where("not lost").select(*columns).unionByName(again.select(*columns))


def permutation(keys: DataFrame, semantic_type: str, allowed: tuple[str, ...], secret: Secret, choices: dict[str, list[str]] | None = None) -> DataFrame:
    """``key`` and ``replacement`` within the values that the schema allows, without fixed points.

    The list of the schema is permuted, whichever of its values stand in the data; a value outside of it
    fails. ``choices``: for values in several lists, those that all of them allow.
    """
    seed = secret.index(semantic_type)
    values = sorted(allowed)
    made = constrained_derangement(values, choices, seed) if choices else derangement(values, seed)
    spark = keys.sparkSession
    found = spark.createDataFrame(sorted(made.items()), "key string, replacement string")
    if not keys.join(F.broadcast(found), "key", "left_anti").isEmpty():
        raise ValueError(f"{semantic_type}: a value is not among those that the schema allows")
    return found


def merged(parts: list[DataFrame]) -> DataFrame:
    """One dictionary of several; a key in two of them fails."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = stage_table(out, "dictionary")
    twice = out.groupBy("key").count().where("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"{len(twice)} or more keys stand in two dictionaries")
    return out


def function_replacement(key: Column, index: Column, semantic_type: str, pack: RulePack) -> Column:
    """The replacement by the pure function; the next candidate where it would be the value itself."""
    first = rendered(pack, semantic_type, index)
    return F.when(first == key, rendered(pack, semantic_type, index, F.lit(1))).otherwise(first)
