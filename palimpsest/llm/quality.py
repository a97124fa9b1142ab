"""Quality rules: structural counts and tokeniser fertility.

A public vocabulary tells how "word-like" a text is: clean prose of a language it knows needs few tokens
for its characters, hardly ever falls back to bytes, and spreads its tokens. Each text's words are encoded
one by one with a SentencePiece vocabulary; three measures are held against a band for the text's script
(or its language, where a band names one): characters per token, share of byte-fallback tokens, entropy
of the tokens. A text is rejected if a measure lies outside. Bounds allow short texts more: the mean of few
tokens strays further, and few tokens spread less.

``fit_bands`` measures bands for a corpus of one's own; ``LANGUAGES`` holds those it gave for the invented
prose of the test tables.
"""

from __future__ import annotations

import gc
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, fields_of, row_of, row_schema, worker_cache

SYMBOLS = "#*$%&|<>"
SEPARATORS = " \t\n\x0b\x0c\r"
MEMO = 400_000


class Band(NamedTuple):
    """What a clean text's measures stay within."""

    min_chars_per_token: float
    max_chars_per_token: float
    max_byte_share: float
    min_entropy: float
    #: The lower bound of characters per token is lower by this over the root of the number of words.
    spread: float = 0.0

    def least_chars(self, words: int) -> float:
        return self.min_chars_per_token - self.spread / math.sqrt(max(words, 1))

    def least_entropy(self, words: int) -> float:
        """The bound holds for texts of ``FULL`` words or more, and falls by ``SLOPE`` with each halving."""
        return self.min_entropy - SLOPE * math.log2(max(1.0, FULL / max(words, 1)))


SPREAD, FULL, SLOPE = 1.6, 400, 0.29
#: By script. Latin prose has 2 to 5 characters a token; scripts the vocabulary knows by single characters
#: only have about 1, and fall back to bytes for the rest. The lower bounds leave room for invented or rare
#: words.
BANDS = {
    "latin": Band(1.45, 9.0, 0.15, 3.5),
    "cyrillic": Band(1.2, 9.0, 0.15, 3.5),
    "greek": Band(0.8, 6.0, 0.3, 3.0),
    "hebrew": Band(0.6, 6.0, 0.5, 3.0),
    "arabic": Band(0.6, 6.0, 0.5, 3.0),
    "indic": Band(0.25, 6.0, 0.95, 2.5),
    "kana": Band(0.4, 4.0, 0.8, 3.0),
    "hangul": Band(0.25, 4.0, 0.95, 3.0),
    "han": Band(0.25, 4.0, 0.95, 3.0),
    "other": Band(0.2, 12.0, 1.0, 2.0),
    # without letters, such as dumps of numbers or symbols: no easier than Latin prose
    "none": Band(1.45, 9.0, 0.15, 3.5),
}
#: By language code: ``fit_bands`` over all 10,000 documents of the test tables at scale 0.1, of which it
#: takes those that pass the base rules and hold few symbols; rounded down. Upper bounds are those of Latin.
LANGUAGES = {
    "de": Band(2.16, 9.0, 0.15, 6.35, SPREAD),
    "en": Band(2.07, 9.0, 0.15, 6.4, SPREAD),
    "es": Band(1.87, 9.0, 0.15, 6.25, SPREAD),
    "fr": Band(1.86, 9.0, 0.15, 6.25, SPREAD),
}
#: First code points of ranges and their script (None: no letters to judge by).
RANGES = [
    (0x0, None), (0x41, "latin"), (0x5B, None), (0x61, "latin"), (0x7B, None), (0xC0, "latin"), (0x250, "other"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "hebrew"),
    (0x600, "arabic"), (0x780, "other"), (0x900, "indic"), (0xE00, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, None), (0x2C00, "other"), (0x3000, None),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x40000, "other"),
]
_STARTS = np.array([a for a, _ in RANGES])
_SCRIPTS = [s for _, s in RANGES]


def script_of(text: str) -> str:
    """The script of most letters; ``other`` where there are none. The first in ``BANDS`` wins ties."""
    if text.isascii():
        return "latin" if any(c.isalpha() for c in text) else "other"
    kinds = np.bincount(np.searchsorted(_STARTS, np.frombuffer(text.encode("utf-32-le"), np.uint32), "right") - 1, minlength=len(_STARTS))
    counts: Counter[str] = Counter()
    for kind, n in zip(_SCRIPTS, kinds.tolist(), strict=True):
        if kind:
            counts[kind] += n
    return max(BANDS, key=lambda s: (counts[s], s == "other")) if counts.total() else "other"


def band_of(text: str) -> str:
    """The script; ``none`` for a text without letters, of which emoji and symbols are none."""
    script = script_of(text)
    return "none" if script == "other" and not any(c.isalpha() for c in text) else script


def repeated_words(ids: np.ndarray, window: int = 3) -> int:
    """How many words lie in windows of ``window`` words that the list of word ids holds twice or more."""
    n = len(ids)
    if n <= window:
        return 0
    kinds = int(ids.max()) + 1
    key = ids[: n - window + 1]
    for k in range(1, window):
        if (int(key.max()) + 1) * kinds >= 1 << 62:  # number the prefixes anew: keys are exact in 64 bits
            key = np.unique(key, return_inverse=True)[1].reshape(-1)
        key = key * kinds + ids[k : n - window + 1 + k]
    held = np.sort(key)
    twice = held[1:][held[1:] == held[:-1]]
    if not len(twice):
        return 0
    starts = np.isin(key, twice)
    covered = np.zeros(n, bool)
    for k in range(window):
        covered[k : n - window + 1 + k] |= starts
    return int(covered.sum())


class Fertility:
    """Tokens of words by a SentencePiece vocabulary. Words are numbered; a bounded memo keeps their tokens."""

    def __init__(self, file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=file)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.tokens = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def number(self, words: list[bytes]) -> np.ndarray:
        """The numbers of words, which hold until the next call."""
        fresh = set(words).difference(self.numbers)
        if fresh and len(self.numbers) + len(fresh) > MEMO:
            self._clear()
            fresh = set(words)
        if fresh:
            made = self.model.encode([w.decode() for w in fresh], num_threads=1)
            self.numbers.update(zip(fresh, range(len(self.numbers), len(self.numbers) + len(fresh)), strict=True))
            self.tokens = np.concatenate([self.tokens, np.fromiter(chain.from_iterable(made), np.int32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.fromiter(map(len, made), np.int64, len(made)))])
        return np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))

    def measures(self, ids: np.ndarray, word_chars: int) -> tuple[float, float, float]:
        """Characters per token, share of byte tokens, entropy in bits; zeros where there is no word."""
        if not len(ids):
            return 0.0, 0.0, 0.0
        sizes = self.ends[ids + 1] - self.ends[ids]
        at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.ends[ids], sizes)
        tokens = self.tokens[at]
        share = np.bincount(tokens)
        bytes_used = int(share[self.is_byte[: len(share)]].sum())
        share = share[share > 0] / len(tokens)
        return word_chars / len(tokens), bytes_used / len(tokens), float(-(share * np.log2(share)).sum())


def loaded(file: str) -> Fertility:
    """The vocabulary of a file, once per worker process."""
    return worker_cache(("fertility", file), lambda: Fertility(file))


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
VERDICT = "chars_per_token double, byte_share double, token_entropy double, band string, base_failed boolean, kept boolean"


def judge(texts: list[str], langs: list[str | None], vocabulary: Fertility, bands: dict[str, Band], min_words: int, max_repeat: int) -> list[tuple]:
    """The counts, measures and verdict of each text, in the order of ``COUNTS`` and ``VERDICT``."""
    split = [text.encode().split() for text in texts]
    numbers = vocabulary.number(list(chain.from_iterable(split)))
    out, start = [], 0
    for text, lang, words in zip(texts, langs, split, strict=True):
        n = len(words)
        ids = numbers[start : start + n]
        start += n
        word_chars = len(text) - sum(map(text.count, SEPARATORS))
        lines = [x for x in text.split("\n") if x.strip(SEPARATORS)]
        repeats = repeated_words(ids)
        failed = n < min_words or 100 * repeats > max_repeat * n
        per_token, byte_share, entropy = vocabulary.measures(ids, word_chars)
        name = lang if lang in bands else band_of(text)
        band = bands.get(name, bands["other"])
        within = band.least_chars(n) <= per_token <= band.max_chars_per_token and byte_share <= band.max_byte_share and entropy >= band.least_entropy(n)
        out.append((n, word_chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, per_token, byte_share, entropy, name, failed, within and not failed))
    return out


def quality_rules(df: DataFrame, file: str, keep: list[str], text: str = "text", lang: str | None = None, bands: dict[str, Band] | None = None, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """The columns ``keep`` with counts, fertility measures, ``base_failed`` and ``kept`` for every row.

    ``file`` is a SentencePiece vocabulary with byte fallback. ``lang`` names a column whose value picks a
    band of ``bands`` (default ``BANDS``) where it has one; the script of the text decides otherwise, and
    where the language is null. Row by row, without a shuffle: repeated rows stay, a null or empty text has
    no words and fails the base rules, an empty table gives an empty one. Columns in ``keep`` may have any
    name; those whose names are made here are left out.
    """
    made = [c.split()[0] for c in f"{COUNTS}, {VERDICT}".split(", ")]
    keep = [c for c in keep if c not in made]
    inner = df.select(row_of(keep), (F.col(f"`{lang}`") if lang else F.lit(None)).cast("string").alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    bands = dict(BANDS, **(bands or {}))
    kinds = [pa.int64()] * 5 + [pa.float64()] * 3 + [pa.string(), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        vocabulary = loaded(file)
        for batch in (part for whole in batches for part in by_size(whole)):
            rows = judge(batch.column(2).to_pylist(), batch.column(1).to_pylist(), vocabulary, bands, min_words, max_repeat)
            new = [pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new], names=["row", *made])

    return inner.mapInArrow(run, row_schema(inner, f"{COUNTS}, {VERDICT}")).select(*fields_of(keep), *made)


def fit_bands(df: DataFrame, file: str, text: str = "text", lang: str = "lang", sample: int = 20_000, share: float = 0.001, symbols: float = 0.02) -> dict[str, Band]:
    """Bands by language from the clean texts of a corpus, for ``quality_rules``.

    Clean are texts that pass the base rules and in which at most a share of ``symbols`` of all characters
    are symbols. Of each language about ``sample`` rows are measured, chosen by a hash of their text; the
    share ``share`` of the clean ones lies below each lower bound. Other bounds are those of Latin.
    """
    rows = df.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    at = F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / float(1 << 20)
    rows = rows.join(sizes, "lang").where(at < F.lit(float(sample)) / F.col("rows")).select("lang", "text")
    seen = quality_rules(rows, file, ["lang"]).where(~F.col("base_failed") & (F.col("n_symbols") <= symbols * F.col("word_chars")))
    chars = F.col("chars_per_token") + SPREAD / F.sqrt("n_words")
    entropy = F.col("token_entropy") + SLOPE * F.log2(F.greatest(F.lit(1.0), FULL / F.col("n_words")))
    found = seen.groupBy("lang").agg(F.percentile_approx(chars, F.lit(share), F.lit(100_000)).alias("chars"), F.percentile_approx(entropy, F.lit(share), F.lit(100_000)).alias("entropy"))
    base = BANDS["latin"]
    return {r["lang"]: Band(r["chars"], base.max_chars_per_token, base.max_byte_share, r["entropy"], SPREAD) for r in found.collect()}
