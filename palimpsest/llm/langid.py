"""Language identification by word-first backoff.

Known words score by their log frequency in each language. An unseen word falls back to its longest known
character n-grams, then to shorter ones, with a fixed penalty for each step down, and at last to a floor.

Frequencies are counted over all training rows of a sample whose size is a parameter, as grouped sums. The
model that goes to the workers is sparse: (item, language, gain) rows for the languages that have an item,
over a floor for those that lack it. It holds at most ``WORDS`` words and ``GRAMS`` n-grams of each length a
language, and at most about ``ITEMS`` rows over all languages, which bounds its broadcast.
"""

from __future__ import annotations

import gc
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, by_size, fields_of, materialise, row_schema, worker_cache

#: Expected training documents of each language; a hash of the text chooses them.
SAMPLE = 4000
#: Most frequent words, and n-grams of each length, that the model keeps for a language.
WORDS = 50_000
GRAMS = 20_000
LONGEST = 5
#: Rows of the model over all languages: with very many languages each keeps fewer items, ``FEWEST`` at least.
ITEMS = 8_000_000
FEWEST = 200
#: Numbers in a worker's memo of word scores.
MEMO = 20_000_000
#: Subtracted in log space for each step from words to shorter and shorter n-grams.
STEP_DOWN = 1.0
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str) -> Counter[str]:
    """Lower-case words (runs of letters and their marks) of a text."""
    return Counter(LETTERS.findall(text.lower()))


def grams_of(word: str, size: int) -> list[str]:
    """Character n-grams of a word with a border on either side."""
    bordered = f"\x02{word}\x03"
    return [bordered[i : i + size] for i in range(len(bordered) - size + 1)]


class Model:
    """Log frequencies by language of words (size 0) and n-grams (by length), sparse.

    ``items``: (item, size, language's place, gain over the floor), rows of an item together; ``floors``:
    by size and language, what a lacking item counts.
    """

    def __init__(self, languages: list[str], floors: np.ndarray, items: pa.Table):
        self.languages, self.floors, self.items = languages, floors, items
        names, sizes = items.column("item").to_pylist(), items.column("size").to_pylist()
        self.place, self.gain = (items.column(c).to_numpy() for c in ("place", "gain"))
        heads = [k for k in range(len(names)) if not k or names[k] != names[k - 1] or sizes[k] != sizes[k - 1]]
        self.first = np.array([*heads, len(names)], np.int64)
        self.tables: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        for number, k in enumerate(heads):
            self.tables[sizes[k]][names[k]] = number
        #: Words scored at once.
        self.block = max(1000, BLOCK // max(1, len(languages)))
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.languages)))

    def word_scores(self, words: list[str]) -> np.ndarray:
        """The score of each word in each language, by the word itself or its longest known n-grams."""
        wide = len(self.languages)
        out = np.zeros((len(words), wide))
        left = range(len(words))
        for step, size in enumerate([0, *range(LONGEST, 0, -1)]):
            own = [grams_of(words[k], size) if size else [words[k]] for k in left]
            known = np.fromiter(map(self.tables[size].get, chain.from_iterable(own), repeat(-1)), np.int64)
            owner = np.repeat(np.array(left, np.int64), np.fromiter(map(len, own), np.int64, len(own)))[known >= 0]
            known = known[known >= 0]
            found = np.bincount(owner, minlength=len(words))
            many = self.first[known + 1] - self.first[known]
            at = np.arange(int(many.sum())) + np.repeat(self.first[known] - np.cumsum(many) + many, many)
            gains = np.bincount(np.repeat(owner, many) * wide + self.place[at], self.gain[at], len(words) * wide).reshape(-1, wide)
            hit = found > 0
            out[hit] = self.floors[size] + gains[hit] / found[hit, None] - STEP_DOWN * step
            left = [k for k in left if not found[k]]
            if not left:
                break
        return out

    def _number(self, words: list[str]) -> list[int]:
        """Rows of ``scores`` for words, which hold until the next call."""
        fresh = list(set(words).difference(self.numbers))
        if fresh and (len(self.numbers) + len(fresh)) * max(1, len(self.languages)) > MEMO:
            self._clear()
            fresh = list(set(words))
        if fresh:
            start = len(self.numbers)
            if start + len(fresh) > len(self.scores):
                more = np.zeros((max(len(self.scores), len(fresh), 1024), len(self.languages)))
                self.scores = np.concatenate([self.scores, more])
            self.scores[start : start + len(fresh)] = self.word_scores(fresh)
            self.numbers.update(zip(fresh, range(start, start + len(fresh)), strict=True))
        return list(map(self.numbers.__getitem__, words))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """For each text the most likely language (the first of ties) and its probability, given the mean
        word score."""
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        found = [LETTERS.findall((t or "").lower()) for t in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        words, owner = list(chain.from_iterable(found)), np.repeat(np.arange(len(found)), counts)
        total = np.zeros((len(found), len(self.languages)))
        for k in range(0, len(words), self.block):
            numbers, own = self._number(words[k : k + self.block]), owner[k : k + self.block]
            heads = np.flatnonzero(np.diff(own, prepend=-1))
            total[own[heads]] += np.add.reduceat(self.scores[numbers], heads)
        # words of a text are not independent: its root mean is what its length is worth
        total /= np.sqrt(np.maximum(counts, 1))[:, None]
        best = total.argmax(1)
        share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return [(self.languages[b], p) if n else ("und", 0.0) for b, p, n in zip(best.tolist(), share.tolist(), counts.tolist(), strict=True)]


#: Numbers looked at once.
BLOCK = 2_000_000


def _counts(rows: DataFrame) -> DataFrame:
    """``lang``, ``size`` (0: a word), ``item``, ``n`` over training rows (lang, text)."""

    def words(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: Counter[tuple[str, str]] = Counter()
        for part in by_size(batch):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for word, n in words_of(text).items():
                    out[lang, word] += n
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.string()), pa.array(list(out.values()), pa.int64())], names=["lang", "item", "n"])

    def grams(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: Counter[tuple[str, int, str]] = Counter()
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for size in range(1, LONGEST + 1):
                for g in grams_of(word, size):
                    out[lang, size, g] += n
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.int32()), pa.array([k[2] for k in out], pa.string()), pa.array(list(out.values()), pa.int64())], names=["lang", "size", "item", "n"])

    by_word = materialise(arrow_map(rows, words, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n")), "words")
    by_gram = arrow_map(by_word, grams, "lang string, size int, item string, n long").groupBy("lang", "size", "item").agg(F.sum("n").alias("n"))
    return by_word.select("lang", F.lit(0).alias("size"), "item", "n").unionAll(by_gram)


def _frequent(counts: DataFrame, most: Column) -> DataFrame:
    """The ``most`` most frequent items of each language and size.

    Ranked in two steps, so that no task sorts a whole language: first within 64 parts of it.
    """
    for part in ([F.pmod(F.xxhash64("item"), F.lit(64))], []):
        w = Window.partitionBy("lang", "size", *part).orderBy(F.col("n").desc(), "item")
        counts = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")
    return counts


def train(rows: DataFrame, text: str, lang: str, sample: int = SAMPLE) -> Model:
    """A model of the rows with a language and a text; about ``sample`` rows a language are looked at.

    The rows are chosen by a hash of their text, so copies are taken or left together and reruns agree.
    """
    rows = rows.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    share = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)
    rows = rows.join(materialise(sizes, "languages"), "lang").where(share < F.lit(float(sample)) / F.col("rows"))
    counts = materialise(_counts(rows.select("lang", "text")), "counts")
    totals = {(r["lang"], r["size"]): r["n"] + r["kinds"] for r in counts.groupBy("lang", "size").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()}
    languages = sorted({k[0] for k in totals})
    # an item that a language lacks counts as a fraction of one that it has seen once
    floors = np.array([[math.log(0.1 / totals[x, size]) if (x, size) in totals else -30.0 for x in languages] for size in range(LONGEST + 1)]).reshape(LONGEST + 1, len(languages))
    each = max(FEWEST, ITEMS // max(1, (LONGEST + 1) * len(languages)))
    kept = _frequent(counts, F.when(F.col("size") == 0, min(WORDS, each)).otherwise(min(GRAMS, each))).toArrow().sort_by([("size", "ascending"), ("item", "ascending")])
    place = np.searchsorted(np.array(languages, object), np.array(kept.column("lang").to_pylist(), object)) if kept.num_rows else np.zeros(0, np.int64)
    size = kept.column("size").to_numpy()
    whole = np.array([[totals.get((x, k), 1) for x in languages] for k in range(LONGEST + 1)], float).reshape(LONGEST + 1, len(languages))
    gain = np.log(kept.column("n").to_numpy() / whole[size, place]) - floors[size, place]
    return Model(languages, floors, pa.table({"item": kept.column("item"), "size": kept.column("size"), "place": pa.array(place.astype(np.int32)), "gain": pa.array(gain)}).combine_chunks())


def held_out(doc_id: Column) -> Column:
    """True for the third of documents that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(df: DataFrame, model: Model, keep: list[str | Column], text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score`` for every row.

    ``und`` with score 0 where a text is null or has no letter, or where nothing has been learned. Row by
    row: repeated rows stay; an empty table gives an empty one.
    """
    named = [c for c in df.select(*keep).columns]
    extra = [F.col(f"`{c}`") if isinstance(c, str) else c for c in keep]
    names = [(k, c) for k, c in enumerate(named) if c not in ("lang_pred", "score")]
    inner = df.select(F.struct(F.lit(0).alias("none"), *[extra[k].alias(f"f{i}") for i, (k, _) in enumerate(names)]).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    sent, mark = df.sparkSession.sparkContext.broadcast((model.languages, model.floors, model.items)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        model = worker_cache(("languages", mark), lambda: Model(*sent.value))
        for batch in (part for whole in batches for part in by_size(whole)):
            found = model.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["row", "lang_pred", "score"])

    return inner.mapInArrow(run, row_schema(inner, "lang_pred string, score double")).select(*fields_of([c for _, c in names]), "lang_pred", "score")


def cross_identify(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """Learns from two thirds of the documents and predicts all: id, ``held_out``, ``lang_pred``, ``score``.

    The fold is a CRC of the id; a null id is not held out. Language, source and id are no inputs of a
    prediction.
    """
    fold = held_out(F.col(f"`{doc_id}`"))
    model = train(df.where(~fold), text, lang, sample)
    return identify(df, model, [F.col(f"`{doc_id}`"), fold.alias("held_out")], text)
