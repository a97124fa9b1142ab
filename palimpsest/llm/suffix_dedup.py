"""Removal of repeated passages: every byte covered by a string of ``window`` bytes that also starts elsewhere.

The corpus is dealt out so that equal windows always meet, and each part is solved by its suffix order:

1. A window's *anchor* is the least hash of the ``GRAM``-byte strings in it, which depends on the window's
   content alone. Neighbouring windows mostly share their anchor, so a text falls into segments: runs of
   windows with one anchor. Anchors whose string stands only once in the corpus can't hold a repeated window.
2. Segments of equal content are brought together; all their windows repeat. One of each stays as their
   representative, with the bytes it needs. Equal means the same anchor, length and 64-bit XXH3 of the
   segment's bytes.
3. Representatives with the same anchor go to the same shard, where external induced sorting
   (``suffix.py``: recursion and queues on disk beyond ``limit`` bytes of memory) gives suffix order and
   common prefixes, which come from the bytes themselves: a window repeats if a neighbour in that order
   shares ``window`` bytes with it. Shards are cut between anchors at ``SHARD`` bytes.
4. An anchor of more than ``BIG`` bytes of different segments (a line that stands in a large part of all
   documents with different words around it) would be an unbounded group in one task. Its windows are
   told apart by 128-bit XXH3 of their bytes instead, which deals them out evenly. No case is capped or
   dropped.
5. Repeated windows go back to all segments of that content, and to their documents.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, by_size, fields_of, materialise, row_of, row_schema, worker_cache
from .suffix import Space, repeated_starts

#: Bytes of the strings that anchors are hashes of.
GRAM = 64
#: Windows in a segment at most.
RUN = 1024
#: Bytes of a shard at least, if an anchor's segments don't fill it.
SHARD = 6_000_000
#: Bytes of an anchor's different segments beyond which its windows are told apart singly.
BIG = 4_000_000
#: Bytes hashed at once.
BLOCK = 1 << 20
#: Bytes of memory for the queues and arrays of a shard; the rest of them lies on disk.
MEMORY = 1 << 24


class Hasher:
    """Hashes of all substrings of one length, from prefix sums of powers modulo 2^64."""

    def __init__(self, seed: int, most: int):
        random = np.random.default_rng(seed)
        self.table = random.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(random.integers(1 << 40, 1 << 62)) | 5
        base -= (base & 7) - 5  # of the greatest order modulo 2^64
        inverse = pow(base, -1, 1 << 64)
        self.up, self.down = self._powers(base, most), self._powers(inverse, most)

    @staticmethod
    def _powers(base: int, most: int) -> np.ndarray:
        steps = np.full(most + 1, base, np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.down[: len(data)], out=out[1:], dtype=np.uint64)
        return out

    def of(self, sums: np.ndarray, start: np.ndarray | slice, stop: np.ndarray | slice, at: np.ndarray | slice) -> np.ndarray:
        x = (sums[stop] - sums[start]) * self.up[at]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def hasher() -> Hasher:
    """The hasher of anchors, once per worker process. Strings it fails to tell apart share a shard, no more."""
    return worker_cache("hasher", lambda: Hasher(11, 2 * BLOCK))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    power, table = 1, x
    while 2 * power <= width:
        table = np.minimum(table[:-power], table[power:])
        power *= 2
    return np.minimum(table[: len(x) - width + 1], table[width - power :]) if width > power else table


def segments(data: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Segments of texts that lie one after the other in ``data``; ``ends`` has where each ends.

    Gives arrays: text number, start in the text, number of windows, anchor, hash of the content, and
    whether the anchor's string stands there more than once (or else no window repeats within).
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none, none, none > 0
    a = hasher()
    sums = a.sums(data)
    grams = a.of(sums, slice(0, n - gram + 1), slice(gram, n + 1), slice(0, n - gram + 1))
    least = sliding_least(grams, window - gram + 1)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: n - window + 1]
    whole = np.arange(n - window + 1) + window <= ends[text]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    heads = np.flatnonzero(new)
    sizes = np.diff(heads, append=len(least))
    if int(sizes.max()) > RUN:
        heads = np.concatenate([np.arange(h, h + s, RUN) for h, s in zip(heads.tolist(), sizes.tolist(), strict=True)])
        sizes = np.diff(heads, append=len(least))
    # windows that would run over a text's end lie at the end of its segments
    sizes = np.minimum(sizes, ends[text[heads]] - window + 1 - heads)
    keep = (sizes > 0) & whole[heads]
    heads, sizes = heads[keep], sizes[keep]
    raw = memoryview(data)
    content = np.fromiter((xxhash.xxh3_64_intdigest(raw[k:e]) for k, e in zip(heads.tolist(), (heads + sizes + window - 1).tolist(), strict=True)), np.uint64, len(heads))
    first = np.concatenate([[0], ends[:-1]])
    # strings that are the least of some window around them; the anchor's places are among them
    width = window - gram + 1
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    places = np.flatnonzero(~sliding_least(~padded, width) == grams)
    lo = np.searchsorted(places, heads)
    many = np.searchsorted(places, heads + sizes + width - 1) - lo
    segment = np.repeat(np.arange(len(heads)), many)
    at = np.arange(len(segment)) - np.repeat(np.cumsum(many) - many, many) + lo[segment]
    times = np.bincount(segment[grams[places[at]] == least[heads][segment]], minlength=len(heads))
    return text[heads], heads - first[text[heads]], sizes, least[heads].view(np.int64), content.view(np.int64), times > 1


def _texts(df: DataFrame, doc_id: str, text: str, *more: Column) -> DataFrame:
    """``id``, ``h`` (which tells texts of one id apart) and ``data`` (bytes)."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.xxhash64(body).alias("h"), body.cast("binary").alias("data"), *more)


def texts_with(df: DataFrame, keep: list[str], doc_id: str, text: str) -> DataFrame:
    """The texts of ``df`` with the columns ``keep`` in a struct ``row``."""
    return _texts(df, doc_id, text, row_of(keep))


def _occurrences(texts: DataFrame, window: int) -> DataFrame:
    """All segments of all texts: ``id``, ``h``, ``start``, ``n`` windows, ``anchor``, ``content``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out: list[list[np.ndarray]] = [[] for _ in range(7)]
        for part in by_size(batch, BLOCK):
            ids, hs = (part.column(k).to_numpy(zero_copy_only=False) if k else part.column(k) for k in range(2))
            raw = part.column(2)
            data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
            ends = np.cumsum(np.fromiter((len(x.as_py()) for x in raw), np.int64, part.num_rows))
            if len(data) <= 2 * BLOCK:
                blocks = [(data, ends, 0)]
            else:  # one text larger than a block
                step = BLOCK
                blocks = [(data[k : k + step + window - 1], np.array([min(len(data) - k, step + window - 1)]), k) for k in range(0, len(data), step)]
            for block, stops, offset in blocks:
                text, start, n, anchor, content, again = segments(block, stops, window, GRAM)
                if len(blocks) > 1:
                    text = text + part.num_rows - 1
                for to, x in zip(out, (ids.take(pa.array(text)), hs[text], start + offset, n, anchor, content, again), strict=True):
                    to.append(x)
        if not out[0]:
            return None
        cols = [pa.concat_arrays(out[0]), *(pa.array(np.concatenate(x), pa.int64()) for x in out[1:3]), pa.array(np.concatenate(out[3]), pa.int32()), *(pa.array(np.concatenate(x), pa.int64()) for x in out[4:6]), pa.array(np.concatenate(out[6]))]
        return pa.RecordBatch.from_arrays(cols, names=["id", "h", "start", "n", "anchor", "content", "again"])

    return arrow_map(texts, run, "id long, h long, start long, n int, anchor long, content long, again boolean")


def scratch() -> str | None:
    """The folder that Spark gives Python workers for spills, of its own local folders; Spark clears it."""
    found = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")
    usable = [f for f in found if f and os.path.isdir(f)]
    return usable[os.getpid() % len(usable)] if usable else None


class Shard:
    """Strings of one shard, written to a file as they come, and their repeated windows."""

    def __init__(self, folder: str, window: int, limit: int):
        self.space, self.window = Space(folder, limit), window
        self.file = tempfile.TemporaryFile(dir=folder)
        self.rows: list[tuple[int, int, int]] = []
        self.size = 0

    def add(self, anchor: int, content: int, data: bytes) -> None:
        symbols = np.zeros(len(data) + 1, np.uint16)
        np.add(np.frombuffer(data, np.uint8), 1, out=symbols[:-1], casting="unsafe", dtype=np.uint16)
        symbols.tofile(self.file)
        self.rows.append((anchor, content, len(data)))
        self.size += len(symbols)

    def solve(self) -> Iterator[pa.RecordBatch]:
        """Rows (anchor, content, lo, hi) of repeated windows ``lo`` to ``hi``, by suffix order."""
        if not self.rows:
            return
        self.file.flush()
        repeated = repeated_starts(np.memmap(self.file, np.uint16, "r", shape=(self.size,)), self.window, self.space)
        out: list[tuple[int, int, int, int]] = []
        start = 0
        for anchor, content, n in self.rows:
            marks = np.diff(repeated[start : start + n - self.window + 1].astype(np.int8), prepend=0, append=0)
            out += [(anchor, content, lo, hi) for lo, hi in zip(np.flatnonzero(marks == 1).tolist(), np.flatnonzero(marks == -1).tolist(), strict=True)]
            start += n + 1
        self.file.close()
        if out:
            yield _spans(out)


def _shards(found: DataFrame, window: int, limit: int) -> DataFrame:
    """Repeated windows of ``found`` (anchor, content, bytes) by suffix order: ``lo`` <= window < ``hi``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("shard", int)  # make room
        with tempfile.TemporaryDirectory(prefix="suffix-", dir=scratch()) as folder:
            shard, last = Shard(folder, window, limit), None
            for batch in batches:
                for anchor, content, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if shard.size >= SHARD and last != anchor:
                        yield from shard.solve()
                        shard = Shard(folder, window, limit)
                    shard.add(anchor, content, data)
                    last = anchor
            yield from shard.solve()

    return found.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "anchor long, content long, lo int, hi int")


def _spans(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["anchor", "content", "lo", "hi"])


def _single_windows(found: DataFrame, window: int) -> DataFrame:
    """Repeated windows of ``found`` by the content of each window, for anchors with many segments."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list[np.ndarray]] = [[] for _ in range(3)]
        digests: list[bytes] = []
        for anchor, content, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw, n = memoryview(data), len(data) - window + 1
            digests += [xxhash.xxh3_128_digest(raw[k : k + window]) for k in range(n)]
            for to, y in zip(out, (np.full(n, anchor), np.full(n, content), np.arange(n, dtype=np.int32)), strict=True):
                to.append(y)
        return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in out), pa.array(digests, pa.binary())], names=["anchor", "content", "lo", "w"])

    single = arrow_map(found, run, "anchor long, content long, lo int, w binary")
    twice = single.groupBy("w").agg(F.count("*").alias("times")).where("times > 1").select("w")
    return single.join(twice, "w").select("anchor", "content", "lo", (F.col("lo") + 1).alias("hi"))


def repeated_spans(texts: DataFrame, window: int, limit: int) -> DataFrame:
    """``id``, ``h`` and ``spans``: the byte ranges (start, end) that repeated windows cover, unsorted."""
    occurrences = _occurrences(texts, window)
    twice = occurrences.groupBy("anchor").agg(F.count("*").alias("c"), F.max("again").alias("again")).where("c > 1 or again").select("anchor")
    live = materialise(occurrences.join(twice, "anchor"), "segments")
    contents = live.groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.min(F.struct("id", "h", "start")).alias("at"), F.first("n").alias("n"), F.max("again").alias("again"))
    contents = materialise(contents, "contents")
    # a single content has no other window to compare with, unless its anchor stands there twice; contents that all repeat need none
    groups = contents.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum(F.col("n") + (window - 1)).alias("bytes"), F.min("copies").alias("least"), F.max("again").alias("again"))
    groups = groups.where("(kinds > 1 or again) and least = 1").select("anchor", "bytes")
    wanted = contents.join(groups, "anchor").select("anchor", "content", "bytes", F.col("at.id").alias("id"), F.col("at.h").alias("h"), F.col("at.start").alias("start"), (F.col("n") + window - 1).alias("size"))
    of = texts.select(F.col("id").alias("of_id"), F.col("h").alias("of_h"), "data")
    cut = wanted.join(of, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("h") == F.col("of_h")))
    cut = cut.select("anchor", "content", "bytes", F.substring("data", (F.col("start") + 1).cast("int"), F.col("size")).alias("data"))
    # rows that repeat a whole text give a representative twice, which then counts as repeated anyway
    cut = materialise(cut, "representatives")
    few = cut.where(F.col("bytes") <= BIG).select("anchor", "content", "data")
    many = cut.where(F.col("bytes") > BIG).select("anchor", "content", "data")
    windows = _shards(few, window, limit).unionAll(_single_windows(many, window))
    whole = contents.where("copies > 1").select("anchor", "content", F.lit(0).alias("lo"), F.col("n").alias("hi"))
    ones = contents.where("copies = 1").select("anchor", "content")
    windows = windows.join(ones, ["anchor", "content"], "left_semi").unionAll(whole)
    hits = live.join(windows, ["anchor", "content"])
    hits = hits.select("id", "h", F.struct((F.col("start") + F.col("lo")).alias("a"), (F.col("start") + F.col("hi") + (window - 1)).alias("b")).alias("span"))
    # rows that repeat an id and its text have the same spans: a set of them, combined before the shuffle
    return hits.groupBy("id", "h").agg(F.collect_set("span").alias("spans"))


def cut_out(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left of the bytes without the spans, and how many maximal runs were taken out."""
    if not spans:
        return data, 0
    marks = np.zeros(len(data) + 1, np.int32)
    at = np.array(spans, np.int64)
    np.add.at(marks, at[:, 0], 1)
    np.subtract.at(marks, at[:, 1], 1)
    gone = np.cumsum(marks[:-1]) > 0
    runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), runs


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 200, keep: list[str] | None = None, kept_text: str | None = None, limit: int = MEMORY) -> DataFrame:
    """The columns ``keep`` (default: the id) and ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    With ``kept_text`` a column of that name holds what is left as text; a character of which a part was
    cut off is left out of it. ``limit``: bytes of memory for a shard's queues and arrays, beyond which they
    lie on disk while the shard is solved, where Spark's own spills of Python workers do; nothing outlives the task. Null texts are empty; texts shorter than ``window`` stay whole; repeated rows
    are copies of each other like any other; a null id is an id of its own; an empty table gives an empty
    one. Columns of ``df`` with the names made here are replaced.
    """
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + [kept_text] * (kept_text is not None)
    keep = [c for c in ([doc_id] if keep is None else keep) if c not in made]
    texts = _texts(df, doc_id, text)
    spans = repeated_spans(texts, window, limit).select(F.col("id").alias("of_id"), F.col("h").alias("of_h"), "spans")
    # the columns kept travel in a struct, so their names meet no others
    rows = texts_with(df, keep, doc_id, text).join(spans, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("h") == F.col("of_h")), "left").select("row", "spans", "data")
    kinds = {"n_bytes": "long", "n_removed": "long", "n_spans": "long"}
    schema = row_schema(rows, ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in made))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for found, raw in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            data = raw.as_py()
            left, runs = cut_out(data, [(s["a"], s["b"]) for s in found or ()])
            row = (len(data), len(data) - len(left), runs, hashlib.sha256(left).hexdigest())
            out.append((*row, left.decode("utf-8", "ignore")) if kept_text else row)
        types = [pa.int64()] * 3 + [pa.string()] * 2
        new = [pa.array([r[k] for r in out], types[k]) for k in range(len(made))]
        return pa.RecordBatch.from_arrays([batch.column(0), *new], names=["row", *made])

    return arrow_map(rows, run, schema).select(*fields_of(keep), *[f"`{c}`" for c in made])
