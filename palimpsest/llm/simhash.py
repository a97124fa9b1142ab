"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of ``BITS`` bits are compared at ``radius`` differing bits. Each bit gets a non-zero vector of
``radius + 1`` bits; for each non-zero vector ``v`` there is a table whose mask holds the bits whose vector
has odd product with ``v``. Any ``radius`` bits have a ``v`` orthogonal to all their vectors, so that table's
mask leaves them all out: a pair within the radius agrees on some mask, always. Vectors are dealt out
evenly, so each of the 2^(radius+1) - 1 masks holds more than half of the bits.

A bucket that holds many fingerprints is split by the same construction over the bits its mask leaves
free; after some levels a bucket cannot hold more than a few fingerprints, whatever the data. So no
bucket needs a cap, and no pair within the radius is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, by_size, fields_of, materialise, row_of, row_schema
from .graph import connected_components

BITS = 64
#: Shingles whose bits are added up at once.
BLOCK = 1 << 18


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """Masks over ``bits`` of which any ``radius`` of them are left out together by at least one."""
    vectors = (1 << (radius + 1)) - 1
    of = {bit: 1 + i % vectors for i, bit in enumerate(bits)}
    return [sum(1 << bit for bit in bits if (of[bit] & v).bit_count() & 1) for v in range(1, vectors + 1)]


def nested_masks(radius: int) -> list[dict[int, list[int]]]:
    """By level: for each mask of the level before (0 at first), the masks that split its buckets.

    Masks that leave fewer than 2^(radius+1) - 1 bits free are not split: such a set of bits might leave
    a new mask empty. Their buckets hold at most 2^free fingerprints anyway, which ends the recursion.
    """
    least = (1 << (radius + 1)) - 1
    out, held = [], [0]
    while held:
        free = {m: [b for b in range(BITS) if not m >> b & 1] for m in held}
        out.append({m: sorted({m | more for more in covering_masks(free[m], radius)}) for m in held})
        held = sorted({m for ms in out[-1].values() for m in ms if BITS - m.bit_count() >= least})
    return out


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """SimHash of the text's word shingles, as an unsigned number; 0 where there is no word.

    A-Z count as lower case, words are separated by ASCII white space, and every shingle counts as often
    as it stands there. A bit is set if it is set in over half of the shingles' XXH64 hashes.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    ones = np.zeros(BITS, np.int64)
    hash_of = xxhash.xxh64_intdigest
    for start in range(0, n, BLOCK):
        block = [hash_of(b" ".join(parts[i : i + words]), seed) for i in range(start, min(n, start + BLOCK))]
        ones += np.unpackbits(np.array(block, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, keep: list[str] | None = None) -> DataFrame:
    """``__id`` and ``__fp`` (the fingerprint as a signed long) of every row, and ``row`` with the columns ``keep``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [fingerprint(t, words) for part in by_size(batch) for t in part.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.array(got, np.uint64).view(np.int64))], names=["row", "__id", "__fp"])

    kept = df.select(row_of(keep or []), F.col(f"`{doc_id}`").cast("long").alias("__id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    return arrow_map(kept, run, row_schema(kept, "__id long, __fp long"))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(fps: DataFrame, radius: int = 2, bucket: int = 64) -> DataFrame:
    """Pairs ``a`` < ``b`` of different values of the column ``fp`` within ``radius`` differing bits.

    Buckets of up to ``bucket`` fingerprints are joined with themselves, larger ones split further.
    """
    tables = nested_masks(radius)
    at = fps.select("fp", F.lit(0).cast("long").alias("mask"))
    found: list[DataFrame] = []
    for level, splits in enumerate(tables):
        choose = F.create_map(*[x for m, ms in splits.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(v)) for v in ms]))])
        masks = F.array(*[F.lit(_signed(v)) for v in splits[0]]) if level == 0 else choose[F.col("mask")]
        keyed = at.select("fp", F.explode(masks).alias("mask")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key")).distinct()
        sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        keyed = materialise(keyed.join(sizes, ["mask", "key"]), "buckets")
        last = level == len(tables) - 1
        # the masks of all buckets of a level leave about as many bits free; of the last too few to split
        whole = F.lit(True) if last else (F.col("n") <= bucket) | ~F.col("mask").isin(*[_signed(m) for m in tables[level + 1]])
        small = keyed.where(whole)
        left = small.select("mask", "key", F.col("fp").alias("a"))
        right = small.select("mask", "key", F.col("fp").alias("b"))
        found.append(left.join(right, ["mask", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b"))
        if last:
            break
        at = keyed.where(~whole).select("fp", "mask")
        if at.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out.distinct()


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 2, words: int = 3, keep: list[str] | None = None) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` and ``group`` for every row.

    ``group`` names a component whatever its ids; the columns ``keep`` follow.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is the
    smallest id reachable by links. Equal fingerprints are brought together first, so copies make no pairs.
    A null text counts as empty (fingerprint 0, linked like any other); a null id never becomes a
    component id unless all of its component are null; repeated rows and ids each give a row; an empty
    table gives an empty one.
    """
    fps = materialise(fingerprints(df, doc_id, text, words, keep), "fingerprints")
    nodes = fps.groupBy(F.col("__fp").alias("fp")).agg(F.min("__id").alias("least"))
    parts = connected_components(links(nodes.select("fp"), radius))
    # nodes without links are components of their own
    nodes = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.select("fp", "root").join(roots, "root").select(F.col("fp").alias("__fp"), "component_id", "root")
    return fps.join(named, "__fp").select(F.col("__id").alias(doc_id), F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("root").alias("group"), *fields_of(keep or []))
