"""Operators for training data, against brute force, exact round trips and held-out accuracy."""

import base64
import gzip
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import bpe, chat, embeddings, graph, langid, lm, mixing, quality, simhash, suffix, suffix_dedup, warc
from palimpsest.llm.queries import BYTE_BPE, PIECES

DOCS = "doc_id long, text string, lang string, source string, size int, kept string"


def docs(spark, texts, sources=None):
    """A table with columns whose names clash with those that operators make."""
    return spark.createDataFrame([(i, t, "en", (sources or ["s"])[i % len(sources or ["s"])], 1, "x") for i, t in enumerate(texts)], DOCS)


EDGES = [None, "", " ", "word", "word", "Word\tword x", "a " * 300, "x" * 5000, "ünï " * 100, "日本語テキスト" * 20, "😀" * 60, "<|endoftext|>"]


# ------------------------------------------------------------------ BPE


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    want, own = Tokenizer.from_file(BYTE_BPE), bpe.loaded(BYTE_BPE)
    random.seed(4)
    texts = [t or "" for t in EDGES] + ["it's  we'll\n\n x", " lead", "trail \n", "a<|endoftext|> b", "՘x ẞ", "=" * 700]
    texts += ["".join(random.choice(" abcdeäéß'12\n.") for _ in range(random.randint(0, 60))) for _ in range(300)]
    texts += ["".join(chr(random.choice([random.randint(0, 0x2FF), random.randint(0x400, 0xD7FF), random.randint(0xE000, 0x10FFFF)])) for _ in range(15)) for _ in range(300)]
    for text, ids in zip(texts, own.encode_batch(texts), strict=True):
        assert ids == want.encode(text, add_special_tokens=False).ids == own.encode(text), text
        assert own.decode(ids) == want.decode(ids, skip_special_tokens=False) == text
    assert own.decode([255, 10**9]) == want.decode([255])


def test_bpe_operator(spark):
    got = {r["doc_id"]: r for r in bpe.encode_documents(docs(spark, EDGES), BYTE_BPE, keep_text=True).collect()}
    for i, text in enumerate(EDGES):
        ids = bpe.loaded(BYTE_BPE).encode(text or "")
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids) and got[i]["decoded"] == (text or "")
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest() and got[i]["kept"] == "x"
    assert bpe.encode_documents(docs(spark, EDGES).where("false"), BYTE_BPE).count() == 0


def test_bpe_memos_are_small():
    """Memos hold no numbers of their own and stay below their bounds, whatever comes."""
    own, most = bpe.PrefixBpe(BYTE_BPE), 0
    for k in range(0, 240_000, 20_000):
        text = " ".join(f"q{n * 2654435761 % (1 << 32):x}z" for n in range(k, k + 20_000)) + " " + "".join(chr(97 + n * n * (k + 7) % 26) for n in range(99))
        assert own.decode(own.encode(text)) == text
        held = [*own._words.values(), *own._pieces_memo.values()]
        most = max(most, len(held))
        assert len({id(t) for tokens in held for t in tokens}) <= len(own.bytes_of)
    assert 100_000 < most < 350_000


# ------------------------------------------------------------------ graph, SimHash, embeddings


def components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    random.seed(2)
    edges = [(random.randint(0, 60), random.randint(0, 60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(20)] + [(200, 200 + i) for i in range(30)] + [(7, 7)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    want = {x: r for x, r in components([(a, b) for a, b in edges if a != b]).items()}
    assert {r["node"]: r["root"] for r in graph.connected_components(df).collect()} == want
    assert graph.connected_components(df.where("false")).count() == 0


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_covering_masks():
    masks = simhash.covering_masks(list(range(64)), 2)
    assert len(masks) == 7
    for a in range(64):
        for b in range(a, 64):
            assert any(not m >> a & 1 and not m >> b & 1 for m in masks)
    levels = simhash.nested_masks(2)
    for splits in levels:
        for held, masks in splits.items():
            free = [b for b in range(64) if not held >> b & 1]
            assert held not in masks and all(any(not m >> a & 1 and not m >> b & 1 for m in masks) for a in free for b in free)
    assert all(64 - m.bit_count() < 7 for ms in levels[-1].values() for m in ms)


@pytest.mark.parametrize("bucket", [64, 1])
def test_links_are_complete(spark, bucket):
    random.seed(5)
    base = [random.getrandbits(64) for _ in range(8)] + [0]
    fps = set(base)
    for b in base:
        for _ in range(12):
            fps.add(b ^ sum(1 << x for x in random.sample(range(64), random.randint(1, 3))))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    assert {(r["a"], r["b"]) for r in simhash.links(df, 2, bucket).collect()} == want


def test_simhash_operator(spark):
    random.seed(6)
    long = " ".join(random.choice("alpha beta gamma delta epsilon zeta eta".split()) + str(random.randint(0, 99)) for _ in range(400))
    texts = [*EDGES, long, long.upper(), long + " end", long.replace("alpha1", "omega"), None]
    fps = [slow_fingerprint(t) for t in texts]
    edges = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want = components(edges)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    for i, f in enumerate(fps):
        assert got[i]["fingerprint"] == f"{f:016x}" and got[i]["component_id"] == want.get(i, i)
    assert simhash.near_duplicates(docs(spark, texts).where("false")).count() == 0


def test_embeddings(spark):
    random = np.random.default_rng(3)
    rows = []
    for label in (0, 1):
        for _ in range(12):
            v = random.standard_normal(16)
            rows += [(v + random.standard_normal(16) * s, label) for s in (0, 0.05, 0.12, 0.2)]
    rows += [(rows[0][0], 0), (rows[0][0] * 3, 0), (rows[0][0], 1), (rows[0][0], None)]
    vectors = [[float(x) for x in v] for v, _ in rows] + [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 3]
    labels = [x for _, x in rows] + [0] * 7
    df = spark.createDataFrame([(i, v, x, "z") for i, (v, x) in enumerate(zip(vectors, labels, strict=True))], "vec_id long, embedding array<double>, label int, n_links string")

    def good(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    edges = []
    for i, a in enumerate(vectors):
        for j in range(i):
            b = vectors[j]
            if good(a) and good(b) and len(a) == len(b) and labels[i] is not None and labels[i] == labels[j]:
                x, y = np.array(a), np.array(b)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                    edges.append((i, j))
    want = components(edges)
    assert len(edges) > 50
    for block in (512, 3):
        got = {r["vec_id"]: r for r in embeddings.near_vectors(df, block=block).collect()}
        assert len(got) == len(vectors)
        for i in got:
            assert got[i]["n_links"] == sum(i in e for e in edges) and got[i]["component_id"] == want.get(i, i) and got[i]["kept"] == (want.get(i, i) == i)
    assert embeddings.near_vectors(df.where("false")).count() == 0


def test_vector_tables_follow_the_number_of_vectors():
    """Pairs at the threshold are found, unrelated ones hardly meet, and candidates a vector grow slowly."""
    random = np.random.default_rng(4)
    shares = []
    for n in (500, 8000):
        tables, width = embeddings.parameters(n, 0.93, 2.0, 1e-4)
        unit = random.standard_normal((n, 64))
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        away = random.standard_normal((n, 64))
        away -= (away * unit).sum(1, keepdims=True) * unit
        away /= np.linalg.norm(away, axis=1, keepdims=True)
        close = 0.9301 * unit + math.sqrt(1 - 0.9301**2) * away
        a, b = (embeddings.signatures(x, tables, width, 2.0, 5) for x in (unit, close))
        assert (a == b).any(1).mean() >= 0.999
        other = np.roll(a, 1, axis=0)
        shares.append(n * (a == other).any(1).mean())
        assert (a == other).any(1).mean() < 0.04
    assert shares[1] < 4 * shares[0]  # 16 times the vectors
    assert embeddings.parameters(10_000, 0.93, 2.0, 1e-4) == (100, 15)
    assert embeddings.parameters(0, 0.93, 2.0, 1e-4)[1] >= 4


# ------------------------------------------------------------------ suffix order and passages


def test_suffix_order(tmp_path, monkeypatch):
    random.seed(3)
    seen = Counter()
    for r in range(150):
        t = [random.randint(0, random.randint(1, 5)) for _ in range(random.randint(1, 60))] * random.randint(1, 3)
        monkeypatch.setattr(suffix, "BATCH", random.choice([1, 3, 1 << 20]))
        space = suffix.Space(str(tmp_path), random.choice([1, 64, 500, 5000, 1 << 27]))
        got = list(suffix.falling(np.array(t, random.choice([np.uint16, np.int64])), space))
        seen += space.seen
        order, common = [int(x) for a, _ in got for x in a], [int(x) for _, c in got for x in c]
        assert order == sorted(range(len(t)), key=lambda i: t[i:], reverse=True)
        for k in range(1, len(order)):
            a, b = t[order[k - 1] :], t[order[k] :]
            n = 0
            while n < min(len(a), len(b), suffix.CAP) and a[n] == b[n]:
                n += 1
            assert common[k] == n
    assert seen["levels"] > 50 and seen["spills"] > 1000 and seen["sorts"] > 50
    assert not list(tmp_path.iterdir())


def test_suffix_order_beyond_memory(tmp_path):
    """With the memory of the query, a shard of its size recurses, sorts names externally and spills."""
    random = np.random.default_rng(9)
    words = [bytes(random.integers(97, 123, random.integers(2, 9)).tolist()) for _ in range(3000)]
    data = b" ".join(words[k] for k in (random.zipf(1.3, 1_300_000) % 3000).tolist())[: suffix_dedup.SHARD]
    data = data[:3_000_000] + data[1_000_000:1_000_700] + data[3_000_000:]
    text = np.frombuffer(data, np.uint8).astype(np.uint16) + 1
    space = suffix.Space(str(tmp_path), suffix_dedup.MEMORY)
    got = suffix.repeated_starts(text, 200, space)
    assert text.nbytes * 9 > suffix_dedup.MEMORY and space.seen["levels"] >= 2 and space.seen["spills"] >= 1 and space.seen["sorts"] >= 1
    times = Counter(data[k : k + 200] for k in range(len(data) - 199))
    assert [times[data[k : k + 200]] > 1 for k in range(len(data) - 199)] == got[: len(data) - 199].tolist()
    assert got.sum() >= 2 * 501


def passages(texts, window=200):
    seen = {}
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for k in range(len(b) - window + 1):
            seen[b[k : k + window]] = seen.get(b[k : k + window], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                gone[k : k + window] = True
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("big", [4_000_000, 1])
def test_repeats(spark, monkeypatch, big):
    random.seed(7)
    monkeypatch.setattr(suffix_dedup, "BIG", big)

    def prose(n):
        return " ".join("".join(random.choice("abcdeé") for _ in range(random.randint(2, 7))) for _ in range(n))

    shared, line = prose(60), prose(30)[:120]
    texts = [*EDGES, prose(200), "ab" * 400, shared, prose(30) + shared + prose(40), shared[:199], shared[:200], shared[5:260] + "!" + shared[:230]]
    texts += [prose(40) + line + prose(40) for _ in range(8)] + [texts[12]] * 3 + [texts[12][:500] + "#" + texts[12][501:]]
    want = passages(texts)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs(spark, texts), kept_text="rest").collect()}
    for i, w in enumerate(want):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == w, i
    assert got[12]["rest"] == "" and got[3]["rest"] == "word"
    assert suffix_dedup.remove_repeats(docs(spark, texts).where("false")).count() == 0


# ------------------------------------------------------------------ quality, language, scoring

PROSE = """The river had risen in the night, and by morning the lower meadow lay under water. A farmer stood at the gate
and counted his sheep, which had climbed to the bank near the old mill. Nobody spoke. Far away, beyond the poplars, a train
passed slowly towards the coast, and its smoke hung in the grey air long after the sound had gone. Then children came running
down the lane with baskets, looking for whatever the flood had left behind."""


def test_quality(spark):
    texts = [*EDGES, "one two three one two three four one two", "a\na \n\na\nb#$", PROSE, "same words again " * 40]
    got = {r["doc_id"]: r for r in quality.quality_rules(docs(spark, texts), PIECES, keep=["doc_id", "kept"]).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        covered = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r["kept"] and r["base_failed"])
    assert got[len(EDGES) + 2]["kept"] and not got[len(EDGES) + 3]["kept"]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = [x for w in texts[8].split() for x in model.encode(w)]
    assert got[8]["chars_per_token"] == pytest.approx(got[8]["word_chars"] / len(ids))
    assert quality.script_of("привет мир") == "cyrillic" and quality.script_of("日本") == "han" and quality.script_of("12 3") == "other"


def test_quality_rejects_texts_without_letters(spark):
    random.seed(6)
    emoji, signs = [chr(c) for c in range(0x1F600, 0x1F640)], "!?;:+=~^@/.,()[]{}"
    noise = [[str(k) for k in random.sample(range(1000, 99999), 80)], ["".join(random.choices(emoji, k=3)) for _ in range(80)], ["".join(random.choices(signs, k=4)) for _ in range(80)]]
    found = {r["doc_id"]: r for r in quality.quality_rules(docs(spark, [" ".join(x) for x in noise]), PIECES, keep=["doc_id"]).collect()}
    assert [(found[i]["base_failed"], found[i]["kept"]) for i in range(3)] == [(False, False)] * 3
    assert quality.band_of("12 3 😀") == "none" and quality.band_of("สวัสดี") == "other"


def test_quality_counts_beyond_21_bits():
    ids = np.array([0, 1 << 21, 7, 9, 1, 0, 7, 11, 12])
    assert quality.repeated_words(ids) == 0 and quality.repeated_words(np.array([0, 1 << 40, 7, 9, 0, 1 << 40, 7])) == 6
    assert quality.repeated_words(np.array([(1 << 31) - 1, (1 << 31) - 2] * 4)) == 8


def test_quality_each_measure_rejects(spark):
    """Texts that the base rules keep and that one measure alone rejects; the verdict against brute force."""
    import sentencepiece

    random.seed(8)
    prose = [w for w in PROSE.split() if w.isalpha()]
    short = " ".join("".join(random.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", k=4)) for _ in range(400))  # few characters a token
    bytes_ = " ".join(f"{w}\U00013000" if len(w) > 5 else w for w in prose)  # byte fallback in every long word
    few = " ".join(prose[k % 6] for k in (int(x) for x in random.choices(range(6), k=400)))  # few different tokens
    few = " ".join(x + ("" if k % 9 else "s") for k, x in enumerate(few.split()))
    texts = [short, bytes_, few, PROSE, " ".join(random.sample(prose, 60)), *EDGES]
    langs = ["en", "xx", "en", "en", None] + ["en"] * len(EDGES)
    df = spark.createDataFrame([(i, t, x, "clash", 1) for i, (t, x) in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string, row string, f0 int")
    got = {r["doc_id"]: r for r in quality.quality_rules(df, PIECES, keep=["doc_id", "row", "f0", "text", "lang"], lang="lang", bands=quality.LANGUAGES, max_repeat=100).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for i, text in enumerate(texts):
        words = (text or "").encode().split()
        ids = [x for w in words for x in model.encode(w.decode())]
        r, band = got[i], quality.LANGUAGES["en"] if langs[i] == "en" else quality.BANDS[quality.band_of(text or "")]
        per = len(b"".join(words).decode()) / len(ids) if ids else 0.0
        share = sum(model.is_byte(x) for x in ids) / len(ids) if ids else 0.0
        entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in Counter(ids).values()) if ids else 0.0
        assert (r["chars_per_token"], r["byte_share"], r["token_entropy"]) == pytest.approx((per, share, entropy))
        n = max(1, len(words))
        out = [not band.min_chars_per_token - band.spread / math.sqrt(n) <= per <= band.max_chars_per_token, share > band.max_byte_share, entropy < band.min_entropy - 0.29 * max(0, math.log2(400 / n))]
        assert r["base_failed"] == (len(words) < 50) and r["kept"] == (not r["base_failed"] and not any(out)), i
        assert (r["row"], r["f0"], r["text"]) == ("clash", 1, text)
        if i < 3:
            assert out == [i == 0, i == 1, i == 2] and not r["base_failed"]
    assert got[3]["kept"] and got[4]["kept"]
    assert quality.quality_rules(df.where("false"), PIECES, keep=["doc_id"]).count() == 0


def test_quality_bands_of_a_corpus(spark):
    random.seed(2)
    words = PROSE.split()
    texts = [" ".join(random.choices(words, k=100)) for _ in range(200)] + [" ".join(f"{w}###" for w in words), "short", None]
    bands = quality.fit_bands(docs(spark, texts), PIECES, share=0.01)
    found = quality.quality_rules(docs(spark, texts), PIECES, keep=["doc_id"], lang="lang", bands=bands).orderBy("doc_id").collect()
    assert set(bands) == {"en"} and sum(r["kept"] for r in found[:200]) >= 190 and not found[200]["kept"]
    assert quality.fit_bands(docs(spark, texts).where("false"), PIECES) == {}


def test_language(spark):
    random.seed(1)
    words = {"aa": ["alpha", "beta", "gamma", "delta"], "bb": ["uno", "dos", "tres", "cuatro"]}
    texts = [(i, " ".join(random.choices(words[x], k=20)), x) for i, x in enumerate(["aa", "bb"] * 30)]
    extra = [(900, None, "aa"), (901, "12 !", "bb"), (902, "", None), (903, "cuatros unos", None), (904, "ALPHA", None), (904, "ALPHA", None), (None, "uno", "bb")]
    df = spark.createDataFrame(texts + extra, "doc_id long, text string, lang string")
    got = langid.cross_identify(df).collect()
    assert len(got) == len(texts) + len(extra)
    by_id = {r["doc_id"]: r for r in got}
    for i, _, x in texts:
        assert by_id[i]["lang_pred"] == x and 0 <= by_id[i]["score"] <= 1
        assert by_id[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert [by_id[i]["lang_pred"] for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "bb", "aa"]
    assert {r["lang_pred"] for r in langid.cross_identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_equals_brute_force(spark):
    """Every word, n-gram, back-off and floor against plain dictionaries."""
    import regex

    random.seed(12)
    stems = {"aa": ["katto", "talo", "vesi", "metsä"], "bb": ["haus", "baum", "wasser", "straße"], "cc": ["дом", "вода", "лес"]}
    texts = [(i, " ".join(random.choice(stems[x]) + random.choice(["", "n", "en", "e", "s"]) for _ in range(random.randint(1, 30))), x) for i, x in enumerate(["aa", "bb", "cc", "aa"] * 25)]
    texts += [(300, "talossa hausern 12 zzz", None), (301, "вод", None), (302, "Ωmega", "bb"), (303, " ".join(["talo", "haus"] * 60_000), None)]
    df = spark.createDataFrame([(*t, "clash", 1) for t in texts], "doc_id long, text string, lang string, row string, f0 int")
    letters = regex.compile(r"\p{L}[\p{L}\p{M}]*")
    count = {}
    for i, text, lang in texts:
        if lang and zlib.crc32(str(i).encode()) % 3 != 1:
            for w in letters.findall(text.lower()):
                for size in range(6):
                    for g in langid.grams_of(w, size) if size else [w]:
                        count.setdefault((lang, size), Counter())[g] += 1
    langs = sorted({k[0] for k in count})
    want = {}
    for i, text, _ in texts:
        words = letters.findall(text.lower())
        total = []
        for x in langs:
            s = 0.0
            for w, times in Counter(words).items():
                for step, size in enumerate([0, 5, 4, 3, 2, 1]):
                    every = langid.grams_of(w, size) if size else [w]
                    known = [g for g in every if any(g in count.get((y, size), ()) for y in langs)]
                    if known:
                        c = count[x, size]
                        whole = c.total() + len(c)
                        s += times * (sum(math.log((c[g] or 0.1) / whole) for g in known) / len(known) - langid.STEP_DOWN * step)
                        break
            total.append(s / math.sqrt(len(words)))
        odds = [math.exp(t - max(total)) for t in total]
        want[i] = (langs[total.index(max(total))], max(odds) / sum(odds))
    for r in langid.cross_identify(df, sample=10**9).collect():
        assert r["lang_pred"] == want[r["doc_id"]][0] and r["score"] == pytest.approx(want[r["doc_id"]][1], abs=1e-9), r
    kept = langid.identify(df, langid.train(df, "text", "lang"), ["doc_id", "row", "f0", "text"]).collect()
    assert {(r["row"], r["f0"]) for r in kept} == {("clash", 1)} and len(kept) == len(texts)
    assert langid.cross_identify(df.where("false")).count() == 0


def test_scoring(spark):
    texts = ["good words are here", "good words are there", "bad noise"] * 5 + [None, "", "good words", "noise bad"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    target = spark.createDataFrame([(i,) for i in range(15) if i % 3 < 2] + [(None,), (0,), (999,)], "doc_id long")
    known, good, all_ = lm.train(df, target, "doc_id", "text")
    counts = {}
    for t in texts:
        for w in (t or "").split():
            counts[w] = counts.get(w, 0) + 1
    assert {w.decode() for w in known} == set(counts) and known[b"noise"] > 1
    assert all_.unigram[known[b"good"]] == pytest.approx((counts["good"] + 0.5) / (sum(counts.values()) + 0.5 * (len(counts) + 2)))
    got = {r["doc_id"]: r for r in lm.cross_entropy_difference(df, target).collect()}
    assert got[17]["loss_difference"] < 0 < got[18]["loss_difference"] and got[15]["target_loss"] is None and got[16]["n_tokens"] == 0
    seen = [b"good", b"words"]
    p = []
    for model in (good, all_):
        before, losses = 0, []
        for w in seen:
            i = known[w]
            _, _, slot = lm.slots_of(np.array([i]), lm.SLOTS) if before == 0 else lm.slots_of(np.array([before, i]), lm.SLOTS)
            context = model.contexts[before]
            pair = min(model.pairs[slot[-1]], context)
            losses.append(-math.log2((pair + lm.MU * model.unigram[i]) / (context + lm.MU)))
            before = i
        p.append(sum(losses) / 2)
    assert got[17]["target_loss"] == pytest.approx(p[0]) and got[17]["loss_difference"] == pytest.approx(p[0] - p[1])


def test_scoring_counts_every_word_and_bigram(spark, monkeypatch):
    """Against plain dictionaries, with more words than 50,000 and more bigrams than 2^20 counters keep apart."""
    random.seed(5)
    texts = [" ".join(f"w{random.randrange(60_000)}" for _ in range(300)) for _ in range(1200)] + ["w1 w2", "", None, "w1 w1 W1", "w7"]
    good = set(range(0, len(texts), 3))
    monkeypatch.setattr(lm, "BLOCK", 200_000, raising=False)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in lm.cross_entropy_difference(df, spark.createDataFrame([(i,) for i in good], "doc_id long")).collect()}
    words = [(t or "").lower().split() for t in texts]
    kinds = len({w for ws in words for w in ws})
    assert len(got) == len(texts) and kinds > 50_000
    models = []
    for of in (good, set(range(len(texts)))):
        one, pair, context = {}, {}, {}
        for ws in (words[i] for i in of):
            for v, w in zip(["", *ws], ws, strict=False):
                one[w], pair[v, w], context[v] = one.get(w, 0) + 1, pair.get((v, w), 0) + 1, context.get(v, 0) + 1
        models.append((one, pair, context, sum(one.values())))
    for i in [*range(0, 1200, 50), *range(1200, len(texts))]:
        want = []
        for one, pair, context, total in models:
            bits = [-math.log2((pair.get((v, w), 0) + lm.MU * (one.get(w, 0) + 0.5) / (total + 0.5 * (kinds + 2))) / (context.get(v, 0) + lm.MU)) for v, w in zip(["", *words[i]], words[i], strict=False)]
            want.append(sum(bits) / len(bits) if bits else None)
        assert got[i]["n_tokens"] == len(words[i])
        if words[i]:
            assert [got[i]["target_loss"], got[i]["background_loss"], got[i]["loss_difference"]] == pytest.approx([*want, want[0] - want[1]])
        else:
            assert got[i]["target_loss"] is None and got[i]["loss_difference"] is None


# ------------------------------------------------------------------ mixing, chat, WARC


def slow_targets(sizes, weights, share, most):
    goal, open_, rest = {}, dict(zip(sizes, [weights[i % len(weights)] for i in range(len(sizes))], strict=True)), share * sum(sizes.values())
    while open_:
        level = rest / sum(open_.values())
        full = [s for s in open_ if open_[s] * level > most * sizes[s]]
        if not full:
            return goal | {s: w * level for s, w in open_.items()}
        for s in full:
            goal[s] = most * sizes[s]
            rest -= goal[s]
            del open_[s]
    return goal


def test_mixing(spark):
    random.seed(8)
    rows = [(i, " ".join(["w"] * random.randint(1, 40)), f"s{random.choice([0, 0, 0, 1, 2, 3])}", 1.0 + i % 3) for i in range(400)]
    rows += [(900, None, "s1", 1.0), (901, "", None, 1.0), (902, "a b c", None, None), (903, "d e", None, 1.0), (903, "d e", None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taste double")
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    names = sorted((s for s in sizes if s), key=lambda s: s) + [None]
    want = slow_targets({s: sizes[s] for s in names}, [3, 1, 2], 1.5, 2)
    for prefer in (None, "taste"):
        got = mixing.mix(df, prefer=prefer).collect()
        taken = {s: sum(r["__taken"] for r in got if r["source"] == s) for s in names}
        for r in got:
            assert r["__target"] == pytest.approx(want[r["source"]]) and r["__source_size"] == sizes[r["source"]]
            assert r["__taken"] in (0, r["__size"], 2 * r["__size"])
        for s in names[:-1]:
            assert abs(taken[s] - want[s]) <= 3, (s, taken[s], want[s])
        if prefer:
            again = mixing.mix(df.repartition(7), prefer=prefer)
            assert sorted(map(str, got)) == sorted(map(str, again.collect()))
            out = mixing.repeat(again, df.columns)
            assert sum(len(r["text"].split()) for r in out.collect()) == sum(r["__taken"] for r in got)
    assert mixing.mix(df.where("false")).count() == 0


def test_pareto_inclusion(spark):
    """With preferences, documents are drawn about as often as their inclusion probabilities say."""
    df = spark.createDataFrame([(i, "w", "s", 1.0 + 2 * (i % 2)) for i in range(2000)], "doc_id long, text string, source string, taste double")
    got = mixing.mix(df, share=0.5, weights=(1.0,), prefer="taste").collect()
    odd = sum(r["__taken"] for r in got if r["doc_id"] % 2) / 1000
    assert odd == pytest.approx(0.75, abs=0.05) and sum(r["__taken"] for r in got) == 1000


def test_mixing_repeated_rows_keep_the_target(spark):
    """One row makes up 90 % of a source; some of its repeats are taken, and the target is met."""
    rows = [(i, " ".join(["w"] * (5 + i % 50)), "s", "a", i, 0) for i in range(500)] + [(777, "w " * 20, "s", "b", 777, 1)] * 4500
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __source string, __hash int, row int")
    for prefer in (mixing.longer(F.col("text")),):
        for parts in (7,):
            got = mixing.mix(df.repartition(parts, "doc_id").coalesce(5), share=0.4, weights=(1.0,), prefer=prefer).collect()
            target = got[0]["__target"]
            assert target == pytest.approx(0.4 * sum(len(r[1].split()) for r in rows)) and len(got) == 5000
            assert abs(sum(r["__taken"] for r in got) - target) <= 20
            copies = [r["__taken"] for r in got if r["doc_id"] == 777]
            assert 0 < sum(copies) < 4500 * 20 and set(copies) <= {0, 20, 40}
            assert {r["__source"] for r in got} == {"a", "b"} and all(r["row"] in (0, 1) for r in got)


def test_mixing_goes_on_behind_long_documents(spark):
    """A document longer than what is left shuts none out; the draw against a plain loop over ranks."""
    random.seed(14)
    rows = [(i, "w " * (3000 if i % 40 == 0 else random.randint(1, 60)), f"s{i % 3}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for share in (0.3, 1.6):
        for prefer in (mixing.longer(F.col("text")),):
            got = mixing.mix(df, share=share, prefer=prefer).collect()
            for s in ("s0", "s1", "s2"):
                of = [r for r in got if r["source"] == s]
                taken, target = sum(r["__taken"] for r in of), of[0]["__target"]
                gap = target - taken  # no document left would make it smaller
                assert abs(gap) <= 30 or all(abs(gap - r["__size"]) >= abs(gap) for r in of if r["__taken"] < (2 if share > 1 else 1) * r["__size"]), (share, s, gap)
    got = mixing.mix(df, share=0.3).collect()
    key = {r["doc_id"]: r["h"] for r in df.select("doc_id", F.xxhash64(F.lit(17), "doc_id", "text").alias("h")).collect()}
    for s in ("s0", "s1", "s2"):
        of = [r for r in got if r["source"] == s]
        left, p, want = of[0]["__target"], of[0]["__target"] / of[0]["__source_size"], set()

        def rank(r, p=p):
            u = ((key[r["doc_id"]] % (1 << 64) >> 12) + 0.5) / (1 << 52)
            return u / (1 - u) * (1 - p) / p, key[r["doc_id"]]

        queue, target, first = sorted(of, key=rank), left, True
        while True:
            most, some, rest = (float("inf") if first else left / 2), 0, []
            for n, r in enumerate(queue):
                if r["__size"] > most:
                    continue
                if r["__size"] > left:
                    rest = queue[n + 1 :]
                    break
                want.add(r["doc_id"])
                left -= r["__size"]
                some += 1
            queue, first = rest, False
            if not some or left <= target * mixing.NEAR:
                break
        fit = min((r for r in of if r["doc_id"] not in want), key=lambda r: (abs(left - r["__size"]), rank(r)))
        want |= {fit["doc_id"]} if abs(left - fit["__size"]) < left else set()
        assert {r["doc_id"] for r in of if r["__taken"]} == want


def test_repeats_in_repeated_rows(spark):
    """Rows that repeat one id and text, or have no id, cost what rows with ids of their own do."""
    import time

    text = " ".join(f"word{i} said{i * 7 % 89}" for i in range(55))
    frame = lambda ids: spark.range(20_000).select(F.expr(ids).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    took, want = {}, (len(text), len(text), 1, hashlib.sha256(b"").hexdigest())
    for name, ids in (("first", "id"), ("own", "id"), ("one", "7"), ("none", "null")):
        began = time.time()
        rows = suffix_dedup.remove_repeats(frame(ids)).groupBy("n_bytes", "n_removed", "n_spans", "kept_sha256").count().collect()
        took[name] = time.time() - began
        assert [tuple(r) for r in rows] == [(*want, 20_000)]
    assert max(took["one"], took["none"]) < 3 * took["own"] + 2, took


def test_chat_with_sparse_ids(spark):
    """Conversations meet by their order, not by the values of their ids; a lone one is paired with itself."""
    many = spark.range(1000).select((F.col("id") * 448).alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.concat(F.lit("answer "), "id").alias("text"))
    got = chat.format_preferences(chat.swapped_pairs(chat.turns_of(many)), ["conv_id", "rejected_from"]).collect()
    blocks = {r["conv_id"]: r["rejected_from"] for r in got}
    assert len(got) == 1000 and all(r["rejected_completion"] and r["conv_id"] != r["rejected_from"] for r in got)
    assert all(blocks[448 * k] == 448 * (k + 1 if (k + 1) % 64 or k > 900 else k - 63) for k in range(999)) and blocks[448 * 999] == 448 * 896
    lone = chat.swapped_pairs(chat.turns_of(many.limit(1))).collect()
    assert [r["conv_id"] for r in lone] == [r["rejected_from"] for r in lone]


def test_chat_refuses_names_of_its_own(spark):
    pairs = spark.createDataFrame([("x", [("user", "a")], [("user", "b")])], f"prompt string, chosen {chat.TURNS}, rejected {chat.TURNS}")
    with pytest.raises(ValueError, match="prompt"):
        chat.format_preferences(pairs, ["prompt"])


def test_chat_long(spark):
    """A conversation of many turns and one of a very long text."""
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(3000)] + [(2, 0, "user", "x" * 2_000_000), (2, 1, "assistant", "short")]
    got = {r["conv_id"]: r for r in chat.format_preferences(chat.swapped_pairs(chat.turns_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))), ["conv_id", "rejected_from"]).collect()}
    assert got[1]["n_prompt_turns"] == 2999 and got[1]["rejected_from"] == 2 and got[1]["rejected_completion"] == "<|im_start|>assistant\nshort<|im_end|>\n"
    assert len(got[2]["prompt"]) == 2_000_000 + len("<|im_start|>user\n<|im_end|>\n") and "turn 2999" in got[2]["rejected_completion"]


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "bye"), (2, 0, "system", "s"), (2, 1, "assistant", "a <|im_end|> b"), (3, 0, "user", None), (4, 0, None, "x"), (65, 0, "assistant", "alone"), (None, 0, "user", "n"), (None, 0, "user", "n"), (None, 1, "assistant", "m")]
    turns = chat.turns_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in chat.format_preferences(chat.swapped_pairs(turns), ["conv_id", "rejected_from"]).collect()}
    one = got[1]
    assert one["rejected_from"] == 2 and one["n_prompt_turns"] == 1 and one["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    assert one["chosen_completion"] == "<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n"
    assert [one["chosen_completion"][s["start"] : s["stop"]] for s in one["chosen_trained"]] == ["yo<|im_end|>"]
    assert one["rejected_completion"] == "<|im_start|>assistant\na <im_end> b<|im_end|>\n"
    assert got[3]["rejected_from"] is None and got[3]["n_prompt_turns"] == 1 and got[3]["chosen_completion"] == ""
    assert got[2]["rejected_from"] == 65 and got[65]["rejected_from"] == 1 and got[65]["rejected_completion"] == "<|im_start|>assistant\nyo<|im_end|>\n"
    alone = chat.format_preferences(chat.swapped_pairs(turns), ["conv_id", "rejected_from"]).where("conv_id is null").collect()
    assert sorted(r["prompt"] for r in alone) == ["<|im_start|>assistant\nm<|im_end|>\n"] + ["<|im_start|>user\nn<|im_end|>\n"] * 2
    pairs = spark.createDataFrame([(1, [("user", "a")], None), (2, [("user", "a"), ("assistant", "b")], [("user", "a"), ("assistant", "b"), ("user", "c")])], f"id int, chosen {chat.TURNS}, rejected {chat.TURNS}")
    both = {r["id"]: r for r in chat.format_preferences(pairs, ["id"]).collect()}
    assert both[1]["n_prompt_turns"] == 0 and both[2]["n_prompt_turns"] == 2 and both[2]["rejected_trained"] == []


def test_warc_round_trip(spark, tmp_path):
    pages = [(5, "http://a/", "same é"), (3, "http://b/\r\nX: y", "same é"), (7, None, None), (8, "u", ""), (9, "u", "WARC/1.1\r\n\r\n\r\n"), (None, "u", "same é"), (5, "u", "same é")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "w"))
    got = warc.read(spark, str(tmp_path / "w")).collect()
    assert len(got) == 7 and all(r["gap"] is None for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r["record_id"], r)
    for page, html in ((3, "same é"), (5, "same é"), (7, ""), (8, ""), (9, pages[4][2])):
        r = by_id[f"<urn:x-page:{page}>"]
        body = html.encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert r["record_type"] == ("revisit" if page in (5, 8) else "response")
        assert bytes(r["payload"]) == (b"" if page in (5, 8) else body)
    assert by_id["<urn:x-page:5>"]["refers_to"] == "<urn:x-page:3>" and by_id["<urn:x-page:8>"]["refers_to"] == "<urn:x-page:7>"
    warc.write(df, str(tmp_path / "z"), compression="gzip")
    assert warc.read(spark, str(tmp_path / "z")).count() == 7
    assert warc.records(df, least=1).where("value like '%WARC-Type: revisit%'").count() == 3


def test_warc_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 20_000)
    monkeypatch.setattr(warc, "LARGE", 3000)
    df = spark.createDataFrame([(i, "u", f"{i} " + "x" * (5000 if i % 10 == 0 else 900), "clash") for i in range(100)], "page_id long, url string, html string, payload string").coalesce(1)
    warc.write(df, str(tmp_path / "w"))
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("part-*")]
    assert len(sizes) > 5 and max(sizes) <= 20_000
    got = warc.read(spark, str(tmp_path / "w"))
    assert got.where("gap is null").count() == 100 and got.where("record_type = 'response'").count() == 100
    warc.write(df.where("false"), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0
    monkeypatch.setattr(warc, "MEMBER", 50)
    assert [r.reason is None for r in warc.salvage(gzip.compress(record(1, b"y" * 500)))] == [False]


def record(n, body):
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    return f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:{n}>\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
def test_warc_salvage(packed):
    parts = [record(i, f"body {i} ".encode() * 20) for i in range(6)]
    if packed:
        parts = [gzip.compress(p, mtime=0) for p in parts]

    def ids(data):
        found = list(warc.salvage(data))
        at = 0
        for r in found:  # records and gaps cover the file without overlap
            assert r.offset == at
            at += r.length
        assert at == len(data)
        return [r.headers["warc-record-id"] if r.reason is None else "gap" for r in found]

    every = [f"<urn:{i}>" for i in range(6)]
    assert ids(b"".join(parts)) == every
    hurt = bytearray(parts[2])
    hurt[len(hurt) - 20] ^= 1
    assert ids(b"".join([*parts[:2], bytes(hurt), *parts[3:]])) == [*every[:2], "gap", *every[3:]]
    assert ids(b"".join([*parts[:2], parts[2][:-30], *parts[3:]])) == [*every[:2], "gap", *every[3:]]
    assert ids(b"junk " + b"".join(parts)) == ["gap", *every]
    assert ids(b"".join(parts)[:-9]) == [*every[:5], "gap"]
    assert ids(b"".join(parts[:1]) + b"\0" * 50 + b"".join(parts[1:])) == [every[0], "gap", *every[1:]]
    assert ids(b"") == [] and ids(b"WARC/1.0\r\n") == ["gap"]
    random.seed(9)
    for _ in range(60):
        data = bytearray(b"".join(parts))
        times = random.randint(1, 3)
        for _ in range(times):
            k = random.randrange(len(data))
            data[k : k + random.randint(0, 9)] = bytes(random.randrange(256) for _ in range(random.randint(0, 9)))
        assert sum(x != "gap" for x in ids(bytes(data))) >= 6 - 2 * times


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    random.seed(11)

    def prose(n):
        return " ".join("".join(random.choice("etaoinshr") for _ in range(random.randint(2, 8))) for _ in range(n))

    shared = prose(60)
    texts = [prose(120) for _ in range(12)] + [prose(90) + " " + shared, prose(90) + " " + shared, "too short", "again and again " * 60, None]
    texts += [texts[0], texts[1].upper()]
    # words of random letters are no English: the bands fitted to a language would reject them
    rows = [(i, t, "xx", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in out}
    assert kept <= set(range(14)) and len(kept) >= 8
    for r in out:
        if r["doc_id"] < 12:
            assert r["ids"] == bpe.loaded(BYTE_BPE).encode(texts[r["doc_id"]])
        else:
            assert shared[5:200] not in bpe.loaded(BYTE_BPE).decode(r["ids"])
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_keeps_one_row_of_each_group(spark):
    """Null ids, repeated ids on different texts, and repeated rows."""
    import corpus_pipeline

    random.seed(13)
    a, b, c, d = (" ".join("".join(random.choice("etaoinshr") for _ in range(5)) for _ in range(80)) for _ in range(4))
    rows = [(None, a), (None, a), (7, a), (None, b), (None, b.upper()), (3, c), (3, d), (3, d), (3, c.upper()), (9, d), (None, None), (None, "")]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, lang string, mark int, document int")
    got = corpus_pipeline.near_copies(spark, df, "").collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "").lower()) for r in got) == sorted([(7, a), (0, b), (3, c), (3, d), (0, "")])
    assert {(r["mark"], r["document"]) for r in got} == {(1, 2)}
    empty = df.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty.select("doc_id", "text", "lang", F.lit("s").alias("source"), "mark"), "").count() == 0, name


def test_operators_on_empty_tables(spark):
    turns = chat.turns_of(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert chat.format_preferences(chat.swapped_pairs(turns), ["conv_id", "rejected_from"]).count() == 0
    none = docs(spark, ["x"]).where("false")
    assert lm.cross_entropy_difference(none, none.select("doc_id")).count() == 0
    assert simhash.near_duplicates(none, keep=["text", "kept"]).count() == 0


def test_very_long_texts(spark):
    """Texts of several megabytes go through whole."""
    from tokenizers import Tokenizer

    random.seed(15)
    words = ["".join(random.choice("abcdefgh") for _ in range(random.randint(1, 9))) for _ in range(500)]
    long = " ".join(random.choices(words, k=450_000))
    long = long[:1_500_000] + long[100_000:100_700] + long[1_500_000:]
    df = docs(spark, [long, "short text", long])
    ids = Tokenizer.from_file(BYTE_BPE).encode(long, add_special_tokens=False).ids
    got = {r["doc_id"]: r for r in bpe.encode_documents(df, BYTE_BPE, keep=["doc_id"], keep_ids=False).collect()}
    assert got[0]["n_tokens"] == len(ids) and got[0]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    found = {r["doc_id"]: r for r in quality.quality_rules(df, PIECES, keep=["doc_id"]).collect()}
    assert found[0]["n_words"] == len(long.split()) and found[0]["word_chars"] == sum(map(len, long.split()))
    marks = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert marks == {0: 0, 1: 1, 2: 0}
    rest = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs(spark, [long, "short text"])).collect()}
    assert rest[0]["n_removed"] >= 1400 and rest[0]["n_bytes"] == len(long) and rest[1]["n_removed"] == 0
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(df).collect()} == {0: len(long), 1: 0, 2: len(long)}
