"""Audit of how the sources of a language differ in their words: exact L1 distances, and each source's own terms.

Terms are counted by (language, source). Each group's smoothed share of a term is an integer, so all sums
are exact. The distance of every two sources is split by how many sources hold a term. Heavy terms, held
by many, are summed in dense tiles (blocks of sources by chunks of terms). A light term is missing from most
sources, and all terms that a source misses have the same share there: the distance of two sources over
light terms is that of their missing shares, corrected by a sum over the own terms of each (by how often
each share occurs), and by the posting list of each term for the pairs of sources that both hold it. The
partial sums are added.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_size, materialise, sized

#: Letters by bytes: A-Z lowered, everything else below 0x80 but a-z a space.
LETTERS = bytes(b if b >= 0x80 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
#: Bytes of a text that are split at a time, and different terms a worker counts before it hands them on.
CUT, HELD = 4_000_000, 1_000_000
#: Sources along a side of a tile, and about how many terms one holds.
SIDE, CHUNK = 128, 1024
#: A term is heavy if more than this share of the language's sources hold it.
HEAVY = 0.25


def _parts(text: bytes) -> Iterator[bytes]:
    """The text in parts of about ``CUT`` bytes that end where a term can't go on."""
    start = 0
    while len(text) - start > CUT:
        stop = text.find(b" ", start + CUT)
        if stop < 0:
            break
        yield text[start:stop]
        start = stop
    yield text[start:] if start else text


def tally(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` occurrences and ``docs`` rows that hold it.

    Every group has a row with the empty term and zeros, so that groups without terms are there. Counts
    leave a worker combined, so frequent terms and groups are no hot keys of the shuffle.
    """
    of = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang), ("source", source))]
    rows = df.select(*of, F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
        docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def combined() -> Iterator[pa.RecordBatch]:
            for (of_lang, of_source), found in counts.items():
                terms, held = [b"", *found], docs[of_lang, of_source]
                n = len(terms)
                columns = [pa.array([of_lang] * n, pa.string()), pa.array([of_source] * n, pa.string()), pa.array(terms, pa.binary()).cast(pa.string())]
                columns += [pa.array([0, *found.values()], pa.int64()), pa.array([0, *[held[t] for t in found]], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            counts.clear()
            docs.clear()

        for batch in (part for whole in batches for part in by_size(whole)):
            for key, raw in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2).to_pylist(), strict=True):
                mine, seen = counts[key], set()
                for part in _parts(raw.translate(LETTERS)):
                    words = part.split()
                    mine.update(words)
                    seen.update(words)
                docs[key].update(seen)
            if sum(map(len, counts.values())) > HELD:
                yield from combined()
        yield from combined()

    made = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, terms: str, prior: int, scale: int) -> Column:
    """1 + floor(scale * (n + prior) / (total + prior * terms)) in decimals, without rounding."""
    return F.expr(f"1 + (cast({n} as decimal(20,0)) + {prior}) * {scale} div ({total} + {prior} * {terms})")


def _sums(code: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different codes, and the sum of the values of each."""
    order = np.argsort(code, kind="stable")
    code, value = code[order], value[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    return code[first], np.add.reduceat(value, first)


def _shared(cells: DataFrame) -> DataFrame:
    """``lang``, ``a`` < ``b``, ``v``: corrections for light terms that both sources hold, from posting lists.

    A list holds at most ``HEAVY`` of a language's sources; pairs are summed within a batch of lists.
    """
    lists = cells.where("not heavy").groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("g", "p", "p0"))).alias("held")).where("size(held) > 1")
    lists = lists.select("lang", F.col("held.g").alias("g"), F.col("held.p").alias("p"), F.col("held.p0").alias("p0"))

    def pairs(g: np.ndarray, p: np.ndarray, p0: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of lists of one length, the rows of the arrays: each member against all behind it."""
        for i in range(g.shape[1] - 1):
            v = np.abs(p[:, i : i + 1] - p[:, i + 1 :]) - np.abs(p[:, i : i + 1] - p0[:, i + 1 :]) - np.abs(p[:, i + 1 :] - p0[:, i : i + 1]) + np.abs(p0[:, i : i + 1] - p0[:, i + 1 :])
            yield _sums((g[:, i : i + 1] << 32 | g[:, i + 1 :]).ravel(), v.ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            starts = batch.column(1).offsets.to_numpy()[:-1]
            flat = [np.asarray(batch.column(k).values).astype(np.int64) for k in (1, 2, 3)]
            for of in sorted(set(langs)):
                codes, values = [], []
                for k in np.unique(sizes[langs == of]):
                    at = starts[(langs == of) & (sizes == k)][:, None] + np.arange(k)
                    for code, value in pairs(*[x[at] for x in flat]):
                        codes.append(code)
                        values.append(value)
                code, value = _sums(np.concatenate(codes), np.concatenate(values))
                yield pa.RecordBatch.from_arrays([pa.array([of] * len(code), pa.string()), pa.array((code >> 32).astype(np.int32)), pa.array((code & 0xFFFFFFFF).astype(np.int32)), pa.array(value)], names=["lang", "a", "b", "v"])

    return lists.mapInArrow(run, "lang string, a int, b int, v long")


def _frame(lang: str, a: np.ndarray, b: np.ndarray, v: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"lang": lang, "a": np.minimum(a, b).astype(np.int32), "b": np.maximum(a, b).astype(np.int32), "v": v.astype(np.int64)})


PAIR = "lang string, a int, b int, v long"
BLOCKS = f"sequence(0, cast((sources - 1) div {SIDE} as int))"


def _missing(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang``, ``a`` < ``b``, ``v``: every pair as if it shared no light term, and missed all heavy ones.

    Over its own terms a source differs from the missing share of another; shares that occur often are
    counted once. Sorted shares and running sums give all distances of a source at once.
    """
    own = cells.where("not heavy").groupBy("lang", "g", "p").agg(F.count("*").alias("times"))
    own = own.join(sized(groups.select("lang", "g", "sources", "p0")), ["lang", "g"])
    own = own.select("lang", F.expr(f"g div {SIDE}").cast("int").alias("i"), F.explode(F.expr(BLOCKS)).alias("j"), F.lit(True).alias("held"), "g", "p", "times", F.lit(0).cast("long").alias("terms"))
    every = groups.select("lang", "g", "p0", "terms", F.expr(f"cast(g div {SIDE} as int)").alias("own"), F.explode(F.expr(BLOCKS)).alias("other"))
    # each source once as the one whose terms are looked at, once as the one they are compared with
    left = every.select("lang", F.col("own").alias("i"), F.col("other").alias("j"), F.lit(None).cast("boolean").alias("held"), "g", F.col("p0").alias("p"), F.lit(0).cast("long").alias("times"), "terms")
    right = every.select("lang", F.col("other").alias("i"), F.col("own").alias("j"), F.lit(False).alias("held"), "g", F.col("p0").alias("p"), F.lit(0).cast("long").alias("times"), "terms")

    def tile(df: pd.DataFrame) -> pd.DataFrame:
        to, of = df[df["held"] == False], df[df["held"].isna()]  # noqa: E712
        g, p0, terms, out = to["g"].to_numpy(np.int64), to["p"].to_numpy(np.int64), to["terms"].to_numpy(np.int64), []
        shares = {k: x for k, x in df[df["held"] == True].groupby("g")}  # noqa: E712
        for me, mine in zip(of["g"].tolist(), of["p"].tolist(), strict=True):
            v = np.where(g > me, terms, 0) * np.abs(p0 - mine)
            if me in shares:
                x = shares[me].sort_values("p")
                p, times = x["p"].to_numpy(np.int64), x["times"].to_numpy(np.int64)
                n, total = np.r_[0, np.cumsum(times)], np.r_[0, np.cumsum(times * p)]
                at = np.searchsorted(p, p0)
                v = v + p0 * n[at] - total[at] + total[-1] - total[at] - p0 * (n[-1] - n[at]) - n[-1] * np.abs(p0 - mine)
            out.append(_frame(df["lang"].iloc[0], np.full(len(g), me), g, v)[g != me])
        return pd.concat(out) if out else _frame("", g[:0], g[:0], g[:0])

    return own.unionByName(left).unionByName(right).groupBy("lang", "i", "j").applyInPandas(tile, PAIR)


def _dense(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang``, ``a`` < ``b``, ``v``: what heavy terms add to the distance of missing shares, in tiles of
    ``SIDE`` sources by ``SIDE`` by about ``CHUNK`` terms. Terms that no source of a tile holds add nothing."""
    of = sized(groups.select("lang", "g", "sources", "chunks"))
    held = cells.where("heavy").join(of, ["lang", "g"]).withColumn("chunk", F.expr("cast(pmod(xxhash64(term), chunks) as int)")).select("lang", "g", "sources", "chunk", "term", "p")
    # a source without any term of a chunk has missing shares there
    none = groups.where("chunks > 0").select("lang", "g", "sources", F.explode(F.expr("sequence(0, cast(chunks - 1 as int))")).alias("chunk"), F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"))
    rows = held.unionByName(none).withColumn("own", F.expr(f"cast(g div {SIDE} as int)")).withColumn("other", F.explode(F.expr(BLOCKS)))
    rows = rows.select("lang", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "chunk", "own", "g", "term", "p")

    def tile(df: pd.DataFrame) -> pd.DataFrame:
        missing, cells = df[df["term"].isna()].sort_values("g"), df[df["term"].notna()]
        g = missing["g"].to_numpy(np.int64)
        terms, _ = pd.factorize(cells["term"])
        p0 = missing["p"].to_numpy(np.int64)
        share = np.repeat(p0[:, None], int(terms.max()) + 1 if len(terms) else 0, axis=1)
        share[np.searchsorted(g, cells["g"].to_numpy(np.int64)), terms] = cells["p"].to_numpy(np.int64)
        side = missing["own"].to_numpy()
        low, high = side.min(), side.max()
        out = []
        for k in range(len(g)):
            if side[k] == low:
                to = np.flatnonzero((g > g[k]) & (side == high))
                out.append(_frame(df["lang"].iloc[0], np.full(len(to), g[k]), g[to], np.abs(share[to] - share[k]).sum(axis=1) - share.shape[1] * np.abs(p0[to] - p0[k])))
        return pd.concat(out)

    return rows.groupBy("lang", "i", "j", "chunk").applyInPandas(tile, PAIR)


def divergence(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = 30, prior: int = 5, scale: int = 1_000_000_000, top: int = 50, heavy: float = HEAVY) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``.

    A language keeps the terms that at least ``min_docs`` of its rows hold. Part ``pair``: every other
    source of the language by distance over all kept terms. Part ``term``: the ``top`` kept terms that the
    source uses more than the language, by difference of shares. Largest values first, then by item.

    Null texts, languages and sources are empty ones. Repeated rows count as often as they stand there. A
    group without terms has its pairs and no terms; a language that keeps no term has distances of 0. An
    empty table gives an empty one; other columns are not looked at.
    """
    counted = materialise(tally(df, lang, source, text), "tally")
    kept = counted.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("of_lang"), F.count("*").alias("holders")).where(F.col("docs") >= min_docs)
    by_lang = counted.where("term = ''").groupBy("lang").agg(F.count("*").cast("int").alias("sources"))
    kept = kept.join(sized(by_lang), "lang").withColumn("heavy", F.col("holders") > F.col("sources") * F.lit(heavy)).drop("docs", "holders", "sources")
    cells = materialise(counted.where("term <> ''").select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "cells")

    # tables of a row a source
    terms = cells.groupBy("lang", "term").agg(F.first("heavy").alias("heavy"), F.first("of_lang").alias("n"))
    vocabulary = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"), F.count_if("heavy").alias("dense"))
    groups = counted.where("term = ''").select("lang", "source").join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = groups.join(by_lang, "lang").join(vocabulary, "lang", "left").fillna(0, ["total", "terms", "lang_total", "dense"])
    groups = groups.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).withColumn("chunks", F.ceil(F.col("dense") / CHUNK).cast("int"))
    groups = materialise(groups.withColumn("p0", F.when(F.col("terms") > 0, _share("0", "total", "terms", prior, scale)).otherwise(F.lit(0).cast("long"))), "groups")

    of = sized(groups.select("lang", "source", "g", "total", "terms", "lang_total", "p0"))
    shares = cells.join(of, ["lang", "source"])
    shares = shares.withColumn("p", _share("n", "total", "terms", prior, scale)).withColumn("q", _share("of_lang", "lang_total", "terms", prior, scale))
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    own = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    own = own.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    cells = shares.select("lang", "term", "heavy", "g", "p", "p0")
    sums = _missing(cells, groups).unionByName(_shared(cells)).unionByName(_dense(cells, groups)).groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"), "value").select("lang", "x.*", "value")
    name = groups.select("lang", "g", "source")
    both = both.join(sized(name.withColumnRenamed("g", "a")), ["lang", "a"]).join(sized(name.withColumnsRenamed({"g": "b", "source": "item"})), ["lang", "b"])
    pair = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best))
    return pair.unionByName(own)
