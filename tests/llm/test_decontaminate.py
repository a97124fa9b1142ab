"""Benchmark windows in documents against brute force over all words."""

import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import common, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, items string, mark string, kept string"
BENCH = "item_id long, text string, mark string, words string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items, window=10):
    out = []
    for text in texts:
        w, hit, whose = words(text), set(), set()
        for item, of in items:
            b = words(of)
            size = min(window, len(b))
            for i in range(len(b) - size + 1 if size else 0):
                for k in range(len(w) - size + 1):
                    if w[k : k + size] == b[i : i + size]:
                        hit.update(range(k, k + size))
                        if item is not None:
                            whose.add(item)
        out.append((len(w), len(hit), sorted(whose)))
    return out


def corpus():
    random.seed(3)
    vocabulary = "the of and Ähre É é straße x1 42 rare".split() + [f"w{i}" for i in range(12)]
    line = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    items = [(i, line(random.randint(10, 25))) for i in range(8)] + [(20, "Three little words"), (21, ""), (22, None), (23, "one"), (None, line(12)), (3, line(11)), (24, "the the the the the the the the the the the the"), (25, "absent from everything")]
    texts = [None, "", " ", "one", "ONE! two", "é É", "the " * 40, "three, LITTLE-words three little words"]
    for i in range(40):
        text = line(random.randint(0, 60))
        if i % 3:
            of = random.choice([t for _, t in items if t])
            w = of.split()
            start = random.randint(0, max(0, len(w) - 10))
            text += ". " + (", ".join(w[start : start + random.randint(8, 14)])).upper().replace("ÄHRE", "Ähre").replace("STRASSE", "straße") + " " + line(5)
        texts.append(text)
    return texts + [texts[-1]] * 30, items


@pytest.mark.parametrize("sent", [common.SENT, 0])
def test_equals_brute_force(spark, monkeypatch, sent):
    """Also where no table may be sent to all executors."""
    monkeypatch.setattr(decontaminate, "sized", lambda df: common.sized(df, sent - 1))
    texts, items = corpus()
    df = spark.createDataFrame([(None if i == 9 else i, t, "i", "m", "k") for i, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame([(i, t, "m", "w") for i, t in items], BENCH)
    rows = decontaminate.contamination(df, bench, ["doc_id", "kept", "mark", "items"]).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts) and rows[0].__fields__ == ["doc_id", "kept", "mark", "n_words", "n_hit", "spans", "items"]
    for i, want in enumerate(brute(texts, items)):
        r = got[None if i == 9 else i]
        assert (r["n_words"], r["n_hit"], r["items"]) == want, (i, texts[i])
        spans = [tuple(s) for s in r["spans"]]
        assert sum(b - a for a, b in spans) == r["n_hit"] and all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and r["kept"] == "k"


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "some text of words", "", "", "")], DOCS)
    bench = spark.createDataFrame([(1, "some text", "", "")], BENCH)
    assert decontaminate.contamination(df.where("false"), bench, ["doc_id"]).count() == 0
    for none in (bench.where("false"), bench.selectExpr("item_id", "cast(null as string) text", "mark", "words")):
        assert [tuple(r) for r in decontaminate.contamination(df, none, ["doc_id"]).collect()] == [(1, 4, 0, [], [])]


def test_long_text(spark):
    body = [f"w{i % 997}" for i in range(60_000)]
    body[40_000:40_000] = "Here begins one long passage that nobody else has written down".split()
    df = spark.createDataFrame([(1, " ".join(body), "", "", "")], DOCS)
    bench = spark.createDataFrame([(5, "here begins one long passage that nobody else has written down", "", "")], BENCH)
    (row,) = decontaminate.contamination(df, bench, ["doc_id"]).collect()
    assert (row["n_hit"], [tuple(s) for s in row["spans"]], row["items"]) == (11, [(40_000, 40_011)], [5])


def test_proximity(spark):
    random.seed(5)
    texts = [" ".join(random.choice("a b c d e f the of".split()) for _ in range(random.randint(0, 30))) for _ in range(40)] + [None, ""]
    phrases = [["a", "b", "c"], ["the", "the", "f"], ["e"], ["a", "zzz"]]
    df = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)], DOCS)
    found = decontaminate.proximity_matches(df, spark.createDataFrame([(p,) for p in phrases], "words array<string>"), 5)
    marks = {bytes(r["m"]): r["text"] for r in df.where("text is not null").select("text", decontaminate.mark_of(df["text"]).alias("m")).collect()}
    got = {(marks[bytes(r["mark"])], tuple(r["words"]), r["start"]) for r in found.collect()}
    want = set()
    for text in texts:
        w = words(text)
        for p in phrases:
            for k in range(len(w)):
                near = w[k : k + 5]
                if w[k] in p and all(near.count(x) >= p.count(x) for x in p):
                    want.add((text, tuple(p), k))
    assert got == want and len(want) > 20


def test_the_words_of_every_character_without_ranges(spark):
    ranges = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    points = spark.createDataFrame([(chr(k),) for k in range(0x30000) if not 0xD800 <= k < 0xE000], "c string")
    assert points.where(F.regexp_count("c", F.lit(ranges)) != F.size(decontaminate.raw_words(F.col("c")))).count() == 0
    assert "-" not in decontaminate.WORD  # a range is tested on its own for every character
