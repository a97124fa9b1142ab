"""Scoring by cross-entropy difference of two n-gram models.

A target model (documents that labels call good) and a background model (all documents) share one
vocabulary, order and smoothing; both are counted over everything they stand for. A document's score is
the mean over its tokens of its loss under the target model minus its loss under the background model:
the lower, the more it looks like the target.

Both are bigram models that back off to unigrams by Dirichlet smoothing:
p(w | v) = (c(v, w) + MU * p(w)) / (c(v) + MU). Every word and every bigram of the corpus has its own count;
no table of them is ever in one place. Documents go through in blocks. A block asks for its different words
and bigrams once each, by fingerprints dealt to parts of the key space; a part sums what all blocks have
seen of a key and answers each of them; the block's texts meet the answers and are scored. A common key
so costs one entry a block, and both parts and blocks have a bounded size whatever the corpus.
"""

from __future__ import annotations

import gc
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size

MU = 50.0
FIRST = 0  # number of the word before the first one; 1 stands for words outside the vocabulary, which counts leave at 0
SLOTS = 1 << 62
#: Bytes of text in a block and for each part, and the least number of parts.
BLOCK, PART, PARTS = 9_000_000, 24_000_000, 64
FIGURES = ("n", "t", "n_end", "t_end")


def words_of(text: str | None) -> list[bytes]:
    """Lower-case (A-Z) words between ASCII white space."""
    return (text or "").encode().lower().split()


def slots_of(numbers: np.ndarray, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, words and bigrams (a number of its own each) of a text's word numbers."""
    before = np.concatenate([[FIRST], numbers[:-1]])
    return before, numbers, before << 31 | numbers


def unigram(n: np.ndarray, total: int, kinds: int) -> np.ndarray:
    """Probabilities of words seen ``n`` times; ``kinds`` are all words of the corpus, and two for FIRST and unknown ones."""
    return (n + 0.5) / (total + 0.5 * (kinds + 2))


def losses(pairs: np.ndarray, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Bits for each token, from the counts of its bigram and its context and its word's probability."""
    return -np.log2((pairs + MU * words) / (contexts + MU))


class Bigrams:
    """Counts of one model over word numbers, on the driver."""

    def __init__(self, texts: list[np.ndarray], kinds: int):
        self.pairs: Counter[int] = Counter()
        ones, self.contexts = np.zeros(kinds, np.int64), np.zeros(kinds, np.int64)
        for numbers in texts:
            before, words, pairs = slots_of(numbers)
            self.pairs.update(pairs.tolist())
            np.add.at(ones, words, 1)
            np.add.at(self.contexts, before, 1)
        self.unigram = unigram(ones, ones.sum(), kinds - 2)


def train(df: DataFrame, target: DataFrame, doc_id: str, text: str) -> tuple[dict[bytes, int], Bigrams, Bigrams]:
    """Vocabulary, target model and background model of a small corpus, to look into: all of it comes to the
    driver. ``cross_entropy_difference`` holds the same counts and doesn't use this."""
    rows = [(t, _plain(x).split()) for t, _, x in _marked(df, target, doc_id, text).toLocalIterator()]
    known = {w: i + 2 for i, w in enumerate(sorted({w for _, words in rows for w in words}))}
    texts = [(t, np.array([known[w] for w in words], np.int64)) for t, words in rows if words]
    return known, Bigrams([x for t, x in texts if t], len(known) + 2), Bigrams([x for _, x in texts], len(known) + 2)


def _marked(df: DataFrame, target: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``target`` (boolean), the id and the text (its words, compressed) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 6)
        for batch in (x for whole in batches for x in by_size(whole)):
            plain = [b" ".join(words_of(x)) for x in batch.column(1).to_pylist()]
            packed = [len(x).to_bytes(8, "little") + codec.compress(x, asbytes=True) for x in plain]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["__id", "__text"])

    # joined by a shuffle at every size: the ids have no bound that would allow a broadcast
    ids = target.select(F.col(target.columns[0]).alias("__of")).where("__of is not null").distinct().withColumn("__is", F.lit(True)).hint("merge")
    plain = df.select(F.col(f"`{doc_id}`").alias("__id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    marked = plain.mapInArrow(run, f"__id {df.schema[doc_id].dataType.simpleString()}, __text binary").join(ids, F.col("__id") == F.col("__of"), "left")
    return marked.select(F.coalesce("__is", F.lit(False)).alias("target"), F.col("__id").alias("id"), F.col("__text").alias("text"))


def _plain(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def _pack(a: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of their width, which leaves little of small ones."""
    if not len(a):
        return b""
    return pa.compress(np.ascontiguousarray(a.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(packed, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.int64).reshape(-1)


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class _Block:
    """The words and bigrams of some texts. Keys are 63-bit fingerprints and a bit that tells bigrams from words."""

    def __init__(self, texts: list[bytes]):
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        numbers[b""]  # FIRST; no word is empty
        each = []
        for text in texts:
            words = text.split()
            each.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        self.sizes = np.array([len(x) for x in each], np.int64)
        self.kinds = len(numbers)
        words = np.concatenate(each) if each else np.zeros(0, np.int32)
        del each
        self.full = self.sizes > 0
        self.starts = (np.cumsum(self.sizes) - self.sizes)[self.full]
        self.words = words
        before = np.empty_like(words)
        before[1:] = words[:-1]
        before[self.starts] = FIRST
        pairs, pair_of = np.unique(before.astype(np.int64) << 32 | words, return_inverse=True)
        self.pair_of = pair_of.astype(np.int32)
        del before, pair_of
        self.before, self.after = pairs >> 32, pairs & 0xFFFFFFFF
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, self.kinds)
        one = np.uint64(1)
        keys = np.concatenate([_mix(h) & ~one, _mix(_mix(h[self.before] + one) * np.uint64(0x9E3779B97F4A7C15) + h[self.after]) | one])
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]

    def figures(self, target: np.ndarray) -> list[np.ndarray]:
        """For each key: how often it stands in all texts and in those of the target, and how often in both as
        a text's last word (for FIRST, which stands before each text and in none, less than never)."""
        out = []
        ends = self.words[self.starts + self.sizes[self.full] - 1]
        for which in (np.ones(len(target), bool), target):
            at = np.repeat(which, self.sizes)
            out.append(np.concatenate([np.bincount(self.words[at], minlength=self.kinds), np.bincount(self.pair_of[at], minlength=len(self.before))])[self.order])
            last = np.bincount(ends[which[self.full]], minlength=len(self.keys))
            last[FIRST] = -which[self.full].sum()
            out.append(last[self.order])
        return [out[0], out[2], out[1], out[3]]

    def scores(self, figures: list[np.ndarray], totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of tokens, mean target loss and mean background loss of each text."""
        kinds = int(totals[0])
        means = []
        for k in (1, 0):
            n, end = (np.empty(len(self.keys), np.int64) for _ in range(2))
            n[self.order], end[self.order] = figures[k], figures[k + 2]
            ones = n[: self.kinds]
            bits = losses(n[self.kinds :], (ones - end[: self.kinds])[self.before], unigram(ones, int(totals[1 + k]), kinds)[self.after])
            sums = np.full(len(self.sizes), np.nan)
            if len(self.words):
                sums[self.full] = np.add.reduceat(bits[self.pair_of], self.starts) / self.sizes[self.full]
            means.append(sums)
        return self.sizes, *means


#: Texts (with their ids) of a block; or what it asks a part; or the part's answer, with its words and tokens.
ROW = "block string, part long, size long, keys binary, n binary, t binary, n_end binary, t_end binary, totals array<long>, ids binary, texts binary"


def _asked(df: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        held: list[pa.RecordBatch] = []
        texts: list[bytes] = []
        size = made = 0

        def block() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            packed, ids = _table_bytes(pa.table({"text": pa.array(texts, pa.binary())})), _table_bytes(table.select(["id"]))
            at = _Block(texts)
            texts.clear()
            figures = at.figures(table.column("target").to_numpy(zero_copy_only=False).astype(bool))
            # a task that runs again may see its rows in another order; blocks of both must not mix
            name = f"{TaskContext.get().partitionId()}-{made}-{xxhash.xxh3_64_hexdigest(ids + packed)}"
            stops = np.searchsorted((at.keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
            rows = [(name, xxhash.xxh3_64_intdigest(name) % parts, -1, None, None, None, None, None, None, ids, packed)]
            for part, (a, b) in enumerate(zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)):
                gaps = np.diff(at.keys[a:b], prepend=np.uint64(0))
                # an empty question is sent, too: its answer has the part's totals
                rows.append((name, part, b - a, _pack(gaps), *(_pack(x[a:b]) for x in figures), None, None, None))
            for k in range(0, len(rows), 1000):
                yield _rows(rows[k : k + 1000])

        for batch in (x for whole in batches for x in by_size(whole, 500_000)):
            held.append(batch.select(["target", "id"]))
            texts.extend(map(_plain, batch.column("text").to_pylist()))
            size += sum(map(len, texts[-batch.num_rows :]))
            if size >= BLOCK:
                yield from block()
                held.clear()
                size, made = 0, made + 1
        if held:
            yield from block()

    return df.mapInArrow(run, ROW)


KINDS = pa.schema([("block", pa.string()), ("part", pa.int64()), ("size", pa.int64()), ("keys", pa.binary()), *((c, pa.binary()) for c in FIGURES), ("totals", pa.list_(pa.int64())), ("ids", pa.binary()), ("texts", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), KINDS, strict=True)], schema=KINDS)


def _table_bytes(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 12))) as to:
        to.write_table(table)
    return out.getvalue().to_pybytes()


def _answered(table: pa.Table) -> pa.Table:
    """What a part answers: every question with the sums of all of them in place of its own figures."""
    gc.disable()
    texts, questions = [], []
    for row in table.to_batches():
        for at in range(row.num_rows):
            one = tuple(c[at].as_py() for c in row.columns)
            (texts if one[2] < 0 else questions).append(one)
    sizes = [q[2] for q in questions]
    keys = np.concatenate([np.cumsum(_unpack(q[3], q[2]).view(np.uint64), dtype=np.uint64) for q in questions]) if questions else np.zeros(0, np.uint64)
    known, at = np.unique(keys, return_inverse=True)
    del keys
    sums = []
    for k in range(4):
        n = np.concatenate([_unpack(q[4 + k], q[2]) for q in questions]) if questions else np.zeros(0, np.int64)
        sums.append(np.bincount(at, n, len(known)).astype(np.int64))  # exact to 2^53
    words = known & np.uint64(1) == 0
    totals = [int((words & (sums[0] > 0)).sum()), int(sums[0][words].sum()), int(sums[1][words].sum())]
    stops = np.cumsum([0, *sizes]).tolist()
    out = list(texts)
    for q, a, b in zip(questions, stops[:-1], stops[1:], strict=True):
        mine = at[a:b]
        out.append((q[0], q[1], q[2], None, *(_pack(x[mine]) for x in sums), totals, None, None))
    return pa.Table.from_batches([_rows(out)])


def _scored(parts: int, names: list[str]):
    def run(table: pa.Table) -> pa.Table:
        gc.disable()
        rows = sorted((tuple(c[at].as_py() for c in batch.columns) for batch in table.to_batches() for at in range(batch.num_rows)), key=lambda r: (r[2] >= 0, r[1]))
        if len(rows) != parts + 1 or rows[0][2] != -1:
            raise RuntimeError("a block has not met its answers")
        ids, texts = (pa.ipc.open_stream(rows[0][k]).read_all() for k in (9, 10))
        at = _Block(texts.column(0).to_pylist())
        figures = [np.concatenate([_unpack(r[4 + k], r[2]) for r in rows[1:]]) for k in range(4)]
        sizes, good, all_ = at.scores(figures, np.sum([r[8] for r in rows[1:]], axis=0))
        none = sizes == 0
        made = [pa.array(sizes), *(pa.array(x, mask=none) for x in (good, all_, good - all_))]
        return pa.Table.from_arrays([ids.column(0), *made], names=names)

    return run


def cross_entropy_difference(df: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores every row of ``df``; the first column of ``target`` names the documents to look like. The id with
    ``n_tokens``, ``target_loss``, ``background_loss`` (bits a token) and ``loss_difference``; the last three
    are null for a text without a word.

    Ids that ``target`` repeats count once, unknown or null ones not at all; without any the target
    model is the uniform one. Rows that repeat an id all count. Null texts have no words. An empty table
    gives an empty one. Columns besides the id are not kept.
    """
    size = df.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    parts = max(PARTS, -(-size // PART))
    names = [doc_id, "n_tokens", "target_loss", "background_loss", "loss_difference"]
    schema = f"`{doc_id}` {df.schema[doc_id].dataType.simpleString()}, n_tokens long, target_loss double, background_loss double, loss_difference double"
    answers = _asked(_marked(df, target, doc_id, text), parts).groupBy("part").applyInArrow(_answered, ROW)
    return answers.groupBy("block").applyInArrow(_scored(parts, names), schema)
