"""Connected components of an edge list, as rounds of DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, materialise


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node`` and ``root`` (the smallest node it reaches) for each node of ``edges`` (long columns a, b).

    Alternates large stars and small stars: every node hands its neighbours on to the smallest node it
    knows of, until the edges are stars around roots. Each round is a grouped minimum (combined before
    its shuffle) and a sort-merge join that Spark may split where a hub has many neighbours; rounds grow
    with the logarithm of the longest chain. Each round is written to the shared folder. Nulls, loops and
    repeated edges are left out; no edges give no rows.
    """
    now = materialise(_distinct(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "edges")
    mark = _mark(now)
    for _ in range(rounds):
        if mark[0] == 0:
            break
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _distinct(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        after = materialise(_distinct(small), "edges")
        before, mark, path = mark, _mark(after), now.shared_path
        now = after
        drop_path(edges.sparkSession, path)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)


def _distinct(df: DataFrame) -> DataFrame:
    return df.where("a != b").distinct()


def _mark(df: DataFrame) -> tuple[int, int]:
    """Number and fingerprint of a set of edges."""
    row = df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1] or 0
