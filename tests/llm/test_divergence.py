"""Divergence of sources against plain loops over all groups and terms."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from palimpsest.llm import divergence, queries

DOCS = "doc_id long, text string, lang string, source string, term string, n int, g int"
WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, min_docs, top):
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        counts[lang or "", source or ""].update(words(text))
        held[lang or ""].update(set(words(text)))
    out = []
    for lang in {g for g, _ in counts}:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        whole = sum(groups.values(), Counter())

        def share(c, t, kept=kept):
            return 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept))

        p = {s: {t: share(c, t) for t in kept} for s, c in groups.items()}
        q = {t: share(whole, t) for t in kept}
        for s in groups:
            pair = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s))
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pair)]
            own = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if groups[s][t] > 0 and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(own)]
    return sorted(out)


def corpus():
    random.seed(11)
    rows = [(None, None, None), (None, "de", "s1"), ("", "de", ""), ("1 2 3 !", "xx", "numbers"), ("Ähre ähre É é", "xx", "a"), ("word Word WORD wörd", "en", None)]
    for k in range(700):
        source = f"s{min(int(random.expovariate(0.25)), 11)}"
        own = [f"{source.replace('s', 'q')}{chr(97 + random.randint(0, 3))}" for _ in range(3)]
        rows.append((" ".join(random.choice(["alpha", "beta", "Gamma", "delta-x", "rare" + chr(97 + k % 26), *own]) for _ in range(random.randint(0, 30))), random.choice(["en", "en", "de"]), source))
    return rows + [("same row here", "en", "s0")] * 40


@pytest.mark.parametrize(("heavy", "side"), [(0.25, 128), (2.0, 3), (0.0, 5), (0.5, 2)])
def test_equals_brute_force(spark, monkeypatch, heavy, side):
    """However terms fall into heavy and light ones, and sources and terms into tiles."""
    monkeypatch.setattr(divergence, "SIDE", side)
    monkeypatch.setattr(divergence, "BLOCKS", f"sequence(0, cast((sources - 1) div {side} as int))")
    monkeypatch.setattr(divergence, "CHUNK", 3)
    rows = corpus()
    df = spark.createDataFrame([(i, t, g, s, "x", 1, 2) for i, (t, g, s) in enumerate(rows)], DOCS)
    got = divergence.divergence(df, min_docs=12, top=7, heavy=heavy)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 12, 7)


def test_edges(spark):
    df = spark.createDataFrame([(1, "few words", "en", "a", "x", 1, 1), (2, None, "en", "b", "x", 1, 1)], DOCS)
    assert sorted(map(tuple, divergence.divergence(df).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert divergence.divergence(df.where("false")).count() == 0


def test_long_text(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CUT", 50)
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(3000))
    assert b"".join(divergence._parts(text.encode())) == text.encode()
    got = {r["term"]: (r["n"], r["docs"]) for r in divergence.tally(spark.createDataFrame([(1, text + "x" * 300, "en", "a", "", 0, 0)], DOCS)).collect()}
    assert got.pop("") == (0, 0) and all(d == 1 for _, d in got.values())
    assert Counter({t: n for t, (n, _) in got.items()}) == Counter(words(text + "x" * 300))


@pytest.mark.parametrize("name", ["op11_divergence", "op12_decontaminate"])
def test_query_equals_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = queries.QUERIES[name](spark, folder)
    found = duck.execute(queries.ORACLE_SQL[name])
    order = [[d[0] for d in found.description].index(c) for c in got.columns]
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r[k] for k in order) for r in found.fetchall())
