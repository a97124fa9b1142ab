"""Near-duplicate vectors by Euclidean p-stable hashing.

Vectors are normalised, so that cosine c means Euclidean distance sqrt(2 - 2c). Each of a number of tables
has ``width_k`` random Gaussian directions; a vector's projections, shifted at random and cut into steps of
``step``, name its bucket. Vectors that share a bucket in some table are compared exactly.

Two vectors at distance d share a projection's step with probability p(d). ``width_k`` follows from the
number n of different vectors of the largest label, so that an unrelated vector (at distance sqrt 2) shares
a bucket with about ``CHANCE`` others by chance, n * p(sqrt 2) ^ width_k = CHANCE; the number of tables
follows from that, so that a pair right at the threshold is missed by all with probability ``miss`` at most,
and closer pairs with less. Work grows as n to the power 1.22 then: 15 projections and 100 tables for 10,000
vectors of a label.

Exact copies are brought together before. Within a bucket, vectors are compared in blocks of ``block``, as
products of matrices: counts and a spanning forest leave a block, never its pairs. A pair is counted in
the first table in which it meets.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialise
from .graph import connected_components


#: Unrelated vectors that a vector meets in a table, on average.
CHANCE = 0.25


def collision(distance: float, step: float) -> float:
    """Probability that two vectors share a projection's step."""
    r = step / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(n: int, least: float, step: float, miss: float) -> tuple[int, int]:
    """Number of tables and of projections a table for ``n`` vectors of a label."""
    near, far = collision(math.sqrt(max(2 - 2 * least, 1e-9)), step), collision(math.sqrt(2), step)
    width_k = max(4, math.ceil(math.log(max(n, 2) / CHANCE) / -math.log(far)))
    return math.ceil(math.log(miss) / math.log1p(-(near**width_k))), width_k


@functools.lru_cache(2)
def directions(dim: int, tables: int, width_k: int, step: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The Gaussian directions and shifts of all tables."""
    random = np.random.default_rng([seed, dim])
    return random.standard_normal((dim, tables * width_k)), random.uniform(0, step, tables * width_k)


def signatures(unit: np.ndarray, tables: int, width_k: int, step: float, seed: int) -> np.ndarray:
    """The bucket of each unit vector in each table, as a 32-bit hash of its steps.

    Two vectors meet in a table if these are equal, so a chance of 1 in 2^32 that steps differ then adds
    candidates only.
    """
    a, b = directions(unit.shape[1], tables, width_k, step, seed)
    parts = []
    for k in range(0, len(unit), 1024):
        steps = np.floor((unit[k : k + 1024] @ a + b) / step).astype(np.int64).astype(np.uint64).reshape(-1, tables, width_k)
        out = np.full(steps.shape[:2], np.uint64(0x9E3779B97F4A7C15))
        for j in range(width_k):
            out = (out ^ steps[:, :, j]) * np.uint64(0xFF51AFD7ED558CCD)
            out ^= out >> np.uint64(32)
        parts.append((out >> np.uint64(32)).astype(np.uint32).view(np.int32))
    return np.concatenate(parts) if parts else np.zeros((0, tables), np.int32)


def _unit(batch: pa.RecordBatch, column: int) -> np.ndarray:
    """Normalised vectors of one length."""
    x = batch.column(column)
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    v = flat.reshape(len(x), -1)
    v = v / np.abs(v).max(1, keepdims=True)  # no overflow of squares
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _compare(ids: np.ndarray, left: np.ndarray, unit: np.ndarray, sig: np.ndarray, times: np.ndarray, table: int, inner: bool, least: float) -> tuple[list, list, list]:
    """Rows (id, other, links) of one block: a vector's links first met in this table (other: itself), and
    edges of a forest (links 0). ``left`` marks the first side; one side only if ``inner``."""
    if inner:
        rows = cols = np.arange(len(ids))
    else:
        rows, cols = np.flatnonzero(left), np.flatnonzero(~left)
    if not len(rows) or not len(cols):
        return [], [], []
    near = unit[rows] @ unit[cols].T >= least
    if inner:
        np.fill_diagonal(near, False)
    i, j = np.nonzero(near)
    i, j = rows[i], cols[j]
    if table and len(i):
        new = np.ones(len(i), bool)
        for t in range(table):
            new &= sig[i, t] != sig[j, t]
        i, j = i[new], j[new]
    if not len(i):
        return [], [], []
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, i, times[j])
    if not inner:
        np.add.at(links, j, times[i])
    out_a, out_b, out_n = [], [], []
    for k in np.flatnonzero(links).tolist():
        out_a.append(int(ids[k]))
        out_b.append(int(ids[k]))
        out_n.append(int(links[k]))
    # edges from each vector to the first of its component within the block
    root = np.arange(len(ids))
    while True:
        lower = root.copy()
        np.minimum.at(lower, i, root[j])
        np.minimum.at(lower, j, root[i])
        lower = lower[lower]
        if (lower == root).all():
            break
        root = lower
    away = np.flatnonzero(root != np.arange(len(ids)))
    out_a += ids[away].tolist()
    out_b += ids[root[away]].tolist()
    out_n += [0] * len(away)
    return out_a, out_b, out_n


def near_vectors(
    df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = 0.93,
    tables: int | None = None, width_k: int | None = None, step: float = 2.0, miss: float = 1e-4, block: int = 512, seed: int = 5,
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for every row.

    Vectors are compared only where labels are equal and not null and lengths are the same. Vectors that
    are null, empty, zero, or hold a null or non-finite component link with nothing, nor do those without
    label. Copies of a vector are links, too. ``component_id`` is the smallest id reachable, ``kept``
    tells whether it is the row's own; a row without id is never kept, unless nothing in its component
    has one, where it is null. An empty table gives an empty result; other columns are not looked at.
    ``tables`` and ``width_k`` follow from the number of vectors and ``miss`` unless both are given.
    """
    e = F.col(f"`{embedding}`")
    kind = "array<float>" if df.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"), e.cast(kind).alias("v"))
    good = F.col("v").isNotNull() & F.col("label").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    # -0.0 and 0.0 are one; the hash of 128 bits stands for label and vector
    key = F.md5(F.concat_ws(" ", F.to_json(F.struct("label")), F.to_json(F.transform("v", lambda x: F.when(x == 0, F.lit(0.0).cast(kind[6:-1])).otherwise(x)))))
    rows = rows.withColumn("key", F.when(F.col("good"), key))
    keyed = materialise(rows.select("vec_id", "key"), "vectors")
    first = rows.where("good").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("times"), F.first(F.struct("label", "v")).alias("x"))
    first = first.select(F.xxhash64("key", F.lit(1)).alias("id"), "key", "least", "times", F.to_json(F.struct("x.label")).alias("label"), F.size("x.v").alias("dim"), F.col("x.v").alias("v"))
    reps = materialise(first, "representatives")
    if tables is None or width_k is None:
        largest = reps.groupBy("label", "dim").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        tables, width_k = parameters(largest or 0, least, step, miss)

    links = materialise(_links(reps, least, block, tables, width_k, step, seed), "links")
    counts = links.where("n > 0").groupBy("a").agg(F.sum("n").alias("n"))
    parts = connected_components(links.where("n = 0").select("a", "b"))
    nodes = reps.select("id", "key", "least", "times").join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    nodes = nodes.join(counts.withColumnRenamed("a", "id"), "id", "left")
    roots = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(roots, "root").select("key", "component_id", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    out = keyed.join(nodes, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(F.col("vec_id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def signed(reps: DataFrame, tables: int, width_k: int, step: float, seed: int) -> DataFrame:
    """``id``, ``h`` (which stands for label and length) and ``sig``, the buckets by table, of vectors."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = batch.column(2).to_numpy()
        sig = np.zeros((batch.num_rows, tables), np.int32)
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            sig[at] = signatures(_unit(batch.take(pa.array(at)), 3), tables, width_k, step, seed)
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.FixedSizeListArray.from_arrays(pa.array(sig.ravel()), tables).cast(pa.list_(pa.int32()))], names=["id", "h", "sig"])

    return arrow_map(reps.select("id", F.xxhash64("label", "dim").alias("h"), "dim", "v"), run, "id long, h long, sig array<int>")


def _links(reps: DataFrame, least: float, block: int, tables: int, width_k: int, step: float, seed: int) -> DataFrame:
    """Rows ``a``, ``b``, ``n``: ``n`` links of ``a``, or an edge where ``n`` is 0."""
    marks = materialise(signed(reps, tables, width_k, step, seed), "signatures")
    at = marks.select("id", "h", F.posexplode("sig").alias("t", "s")).select("id", "t", F.xxhash64("h", "t", "s").alias("bucket"))
    sizes = at.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    at = at.join(sizes, "bucket")
    # buckets of many vectors are compared block by block: own block pairs (i, j) with i <= j
    blocks = F.ceil(F.col("n") / block).cast("int")
    at = at.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    at = at.select("id", "t", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("first"), pair.alias("pair"))
    whole = reps.select("id", "times", "v", "dim", F.xxhash64("label").alias("lab")).join(marks.select("id", "sig"), "id")
    at = at.join(whole, "id")
    group = ["pair", "lab", "dim", "bucket", "t", "i", "j"]
    at = at.select(*group, "id", "first", "times", "v", F.slice("sig", F.lit(1), F.col("t")).alias("sig")).repartition("pair").sortWithinPartitions(*group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([held, now]) if held is not None else now
            heads = _heads(now, group)
            cut = int(heads[-1])
            if cut:
                yield from done(now.slice(0, cut), heads)
            held = now.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield from done(held, np.array([0, held.num_rows]))

    def done(table: pa.Table, heads: np.ndarray) -> Iterator[pa.RecordBatch]:
        cols = {n: table[n].combine_chunks() for n in table.column_names}
        plain = {n: cols[n].to_numpy(zero_copy_only=False) for n in ("id", "t", "i", "j", "times", "first", "dim")}
        out: tuple[list, list, list] = ([], [], [])
        for start, stop in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
            if stop - start < 2:
                continue
            part = slice(start, stop)
            n = stop - start
            v = cols["v"].slice(start, n).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
            v = v / np.abs(v).max(1, keepdims=True)
            v = v / np.sqrt((v * v).sum(1, keepdims=True))
            sig = cols["sig"].slice(start, n).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            found = _compare(plain["id"][part], plain["first"][part], v, sig, plain["times"][part], int(plain["t"][start]), plain["i"][start] == plain["j"][start], least)
            for to, x in zip(out, found, strict=True):
                to.extend(x)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b", "n"])

    return at.mapInArrow(run, "a long, b long, n long")


def _heads(table: pa.Table, group: list[str]) -> np.ndarray:
    """Where groups start; the last one may go on in the next batch."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[0] = True
    for name in group:
        x = table[name].combine_chunks().to_numpy(zero_copy_only=False)
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)
