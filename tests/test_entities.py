"""Spans by pattern and by tagger: decoding against brute force, context, overlaps, names never seen."""

import itertools
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import detect, entities, tagger
from palimpsest.operators.entities import find, patterns, settled
from palimpsest.operators.tagger import Tagger, endings, sentences, tags_of, tokens


def words(text):
    return [text[a:b] for a, b in tokens(text)]


def test_tokens_and_tags():
    text = "Живёт в г. Тверь, ул. Мира. Don't co-op 3.5\nNext"
    assert words(text) == ["Живёт", "в", "г.", "Тверь", ",", "ул.", "Мира", ".", "Don't", "co-op", "3", ".", "5", "Next"]
    places = tokens(text)
    assert [text[places[a][0] : places[b - 1][1]] for a, b in sentences(text, places)] == [text[: text.index("\n")], "Next"]
    assert tags_of(places[:8], [("L", text.index("Тверь"), text.index("Тверь") + 5)]) == ["O", "<<L", "<L", "B-L", "O", "O", "O", "O"]
    assert tags_of(places[:3], [("P", 2, 9)]) == ["B-P", "I-P", "I-P"]
    assert endings("Иванов", True) == ["Xx^", "Xx^|в", "Xx^|ов", "Xx^|нов", "Xx^|анов"] and endings("12", False) == ["9"]
    assert tokens("") == [] and list(sentences("", [])) == []


def test_long_sentences_are_cut_at_full_stops():
    text = "word " * 500 + "ending. " + "more " * 300
    places = tokens(text)
    cuts = list(sentences(text, places))
    assert [b for _, b in cuts][-1] == len(places) and len(cuts) == 2 and all(x[1] == y[0] for x, y in zip(cuts, cuts[1:]))


def test_decoding_equals_brute_force():
    random = np.random.default_rng(1)
    for n in (1, 2, 3, 5):
        m = Tagger(["A", "B-x", "I-x"], np.ones(3) / 3, np.log(random.dirichlet(np.ones(3), 4)), {}, {})
        rows = [np.log(random.dirichlet(np.ones(3), n)), np.log(random.dirichlet(np.ones(3), 3)), np.zeros((0, 3))]
        for row, path in zip(rows, m.decode(rows), strict=True):
            ways = list(itertools.product(range(3), repeat=len(row)))
            score = [sum((m.succession[-1] if t == 0 else m.succession[w[t - 1]])[k] + row[t][k] for t, k in enumerate(w)) for w in ways]
            assert tuple(path) == ways[int(np.argmax(score))]
            if len(row):
                p = np.exp(np.array(score) - max(score))
                want = [[sum(x for x, w in zip(p, ways, strict=True) if w[t] == k) / p.sum() for k in range(3)] for t in range(len(row))]
                assert np.allclose(m.posterior(row), want)


def test_context_is_near():
    card = [r for r in detect.RECOGNISERS if r.entity == "CREDIT_CARD"]
    number = "4111 1111 1111 1111"
    assert patterns(f"pay by card now: {number}", card)[0][1] == pytest.approx(0.65)
    assert patterns(f"card one two three four five six {number} and then {number} card", card) == [("CREDIT_CARD", 0.3, 33, 52), ("CREDIT_CARD", 0.3, 62, 81)]
    assert [round(p[1], 2) for p in patterns(f"{number} card {number}", card)] == [0.3, 0.65]


def test_overlaps():
    spans = [("A", 0.5, 0, 10), ("B", 0.6, 8, 12), ("C", 0.7, 11, 14), ("D", 0.7, 20, 25), ("E", 0.7, 21, 30), ("F", 0.7, 30, 31)]
    assert [s[0] for s in settled(spans)] == ["A", "C", "E", "F"]
    random.seed(2)
    for _ in range(50):
        spans = [(random.choice("AB"), random.choice([0.5, 0.6]), a := random.randint(0, 40), a + random.randint(1, 9)) for _ in range(15)]
        kept = []
        for s in sorted(spans, key=lambda s: (-s[1], s[2] - s[3], s[2], s[0])):
            if all(s[3] <= k[2] or k[3] <= s[2] for k in kept):
                kept.append(s)
        assert settled(spans) == sorted(kept, key=lambda s: s[2])


FIRST = ["Ivan", "Petr", "Sergei", "Anton", "Maksim", "Roman"]
LAST = ["Smirnov", "Kozlov", "Popov", "Volkov", "Lebedev", "Frolov", "Zaitsev"]
TOWNS = ["Pskovsk", "Tomsk", "Omsk", "Bratsk", "Kursk", "Irkutsk"]


@pytest.fixture(scope="module")
def model(spark):
    random.seed(3)
    rows = []
    for k in range(300):
        name, town = f"{random.choice(FIRST)} {random.choice(LAST)}", random.choice(TOWNS)
        text = ["Yesterday {n} moved to {t} again.", "The parcel of {n} is late.", "Nobody lives in {t} now. Write soon.", "Nothing of note. The Report was read."][k % 4].format(n=name, t=town)
        spans = [(kind, text.index(x), text.index(x) + len(x)) for kind, x in (("PERSON", name), ("LOCATION", town)) if x in text]
        rows.append((text, spans, "clash"))
    rows += [(None, [], ""), ("", None, "")]
    return tagger.train(spark.createDataFrame(rows, "text string, spans array<struct<type:string,start:int,stop:int>>, tag string"))


def test_new_names(spark, model):
    texts = ["Yesterday Oleg Morozov moved to Minsk again.", "The parcel of Oleg Morozov is late.\nNobody lives in Minsk now.", "The Report was read. Nothing of note.", None, "", "Mail a@b.example of Oleg Morozov"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id int, text string, type int")
    got = {r["id"]: [(e["type"], e["text"]) for e in r["entities"]] for r in entities.spans(df, "text", model).collect()}
    assert got[0] == [("PERSON", "Oleg Morozov"), ("LOCATION", "Minsk")] == got[1]
    assert got[2] == got[3] == got[4] == [] and ("EMAIL_ADDRESS", "a@b.example") in got[5]
    assert entities.spans(df.where("false"), "text", model).count() == 0
    detector = entities.detector(model)
    assert detect.hit_share(df.where("id < 3"), "text", detector) == pytest.approx(2 / 3)
    assert df.select(F.size(detect.relevant(detector(F.col("text")))).alias("n")).where("n > 0").count() == 3


def test_long_text(model):
    text = "Nothing of note. " * 5000 + "Yesterday Oleg Morozov moved to Minsk again."
    ((*_, person, place),) = find([text], [], model)
    assert text[person[2] : person[3]] == "Oleg Morozov" and text[place[2] : place[3]] == "Minsk" and min(person[1], place[1]) > 0.6


def test_evidence_of_a_new_word_is_the_same_in_a_larger_corpus():
    """Names of a fixed list in training, beside more and more different words."""

    def margin(n):
        m = Tagger(["B-x", "O"], np.array([0.001, 0.999]), np.zeros((3, 2)), {}, {"Xx": np.array([30.0, n]), "x": np.array([0.0, 3 * n])})
        name, other = m.evidence("Livny", False)
        return name - other

    assert margin(1e3) > 1 and abs(margin(1e3) - margin(1e6)) < 0.1


def test_memory_of_a_batch_is_bounded_by_pieces(model):
    """Words of a batch of many texts are held for a piece of it at a time, evidence of new words once an ending."""
    texts = [f"Nobody lives in Minsk{k} now. " + "nothing of note " * 600 for k in range(250)]
    one = [find([t], [], model)[0] for t in texts[:60]]
    model.held.clear()
    tracemalloc.start()
    found = find(texts, [], model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 250 and found[:60] == one and peak < 60_000_000, peak
    a, b = model.evidence("Zabcdqqq", False), model.evidence("Yefgdqqq", False)
    assert a is b


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    rows = [(f"Report {k} of Oleg Morozov{k}", [("PERSON", text.index("Oleg"), len(text))]) for k in range(40) if (text := f"Report {k} of Oleg Morozov{k}")]
    df = spark.createDataFrame(rows, "text string, spans array<struct<type:string,start:int,stop:int>>").coalesce(1)
    whole = sorted(tuple(r) for r in tagger._counts(df).collect())
    monkeypatch.setattr(tagger, "TOGETHER", 5)
    assert sorted(tuple(r) for r in tagger._counts(df).collect()) == whole and sum(r[-1] for r in whole) == 2 * 40 * 5


def test_words_reach_the_driver_as_columns(spark, monkeypatch):
    """Rows are collected for successions of tags only; a model keeps the most frequent words, ties by name."""
    rows = [("to Minsk and Pinsk", [("TOWN", 3, 8), ("TOWN", 13, 18)]), ("to and fro", []), ("to Minsk", [])]
    df = spark.createDataFrame(rows, "text string, spans array<struct<type:string,start:int,stop:int>>")
    sizes, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: sizes.append(self.columns) or collect(self))
    m = tagger.train(df, words=3)
    assert sizes == [["item", "tag", "n"]] and list(m.words) == ["to", "Minsk", "and"]
    at = {t: k for k, t in enumerate(m.tags)}
    assert m.words["Minsk"][at["B-TOWN"]] == m.words["Minsk"][at["O"]] == 1 and m.words["to"].sum() == 3 and m.words["to"][at["<TOWN"]] == 1
