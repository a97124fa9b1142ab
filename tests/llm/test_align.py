"""Alignment of two tokenisations, against the libraries on whole texts and offsets of bytes."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from palimpsest.llm import align
from palimpsest.llm.queries import BYTE_BPE, PIECES

EDGES = [None, "", " ", "  ", "word", "word", "Word\tword  x ", " lead", "a\n\n b \n", "it's  we'll  x　y", "日本語テキスト x" * 8, "😀 😀a" * 9, "<|endoftext|> </s><s> <unk>", "lower ▁ block", "a " * 300, "x" * 3000, "nul\0 \x1c tail "]
DOCS = "doc_id long, text string, n_a int, kept string"


def spelt():
    """The bytes of both vocabularies' tokens, by other means than the operator's."""
    a, b = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    alphabet = {}
    for byte in range(256):
        if byte < 0x80:
            (token,) = a.encode(chr(byte), add_special_tokens=False).tokens
            alphabet[token] = byte
    rest = sorted(t for t in a.get_vocab() if len(t) == 1 and t not in alphabet)
    alphabet |= {t: byte for t, byte in zip(sorted(rest, key=lambda t: (ord(t) >= 256, ord(t))), [*range(0xA1, 0xAD), *range(0xAE, 0x100), *range(0x80, 0xA1), 0xAD], strict=True)}
    return a, b, alphabet


def brute(texts):
    a, b, alphabet = spelt()
    rows, holds = [], Counter()
    for text in texts:
        want = (" " + (text or "")).encode()
        x = a.encode(" " + (text or ""), add_special_tokens=False)
        y = b.encode(text or "")
        xs = [bytes(alphabet[c] for c in t) for t in x.tokens]
        ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not text or b"".join(xs) != want or b"".join(ys) != want:
            rows.append(None)
            continue
        ends = []
        for tokens in (xs, ys):
            at, here = 0, []
            for t in tokens:
                at += len(t)
                here.append(at)
            ends.append(here)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([i for i, e in zip(x.ids, ends[0], strict=True) if start < e <= stop], [i for i, e in zip(y, ends[1], strict=True) if start < e <= stop], start, stop) for start, stop in zip([0, *cuts], cuts)]
        links = Counter((g, h) for left, right, *_ in groups for g in left for h in right)
        rows.append((x.ids, y, groups, links))
        holds.update(links.keys())
    best = {}
    for (g, _), n in holds.items():
        best[g] = max(best.get(g, 0), n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, "", None))
            continue
        left, right, groups, links = row
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h, *_ in groups)
        out.append((len(left), len(right), len(groups), links.total(), sum(n for k, n in links.items() if holds[k] == best[k[0]]), sum(n * holds[k] for k, n in links.items()), hashlib.sha256(text.encode()).hexdigest(), [(g, h, s, e) for g, h, s, e in groups]))
    return out


def made_up():
    random.seed(8)
    words = [w for w in "the and ist über niño garçon straße don't 12,5 a_b http://x.y/z C++ …".split()] + ["\n", "\t", " ", " "]
    return [" ".join(random.choice(words) for _ in range(random.randint(1, 40))) for _ in range(60)] + ["".join(chr(random.choice([random.randint(1, 0x2FF), random.randint(0x2000, 0x33FF)])) for _ in range(40)) for _ in range(60)]


@pytest.mark.parametrize("sent", [align.SENT_PAIRS, 0])
def test_equals_brute_force(spark, sent):
    texts = EDGES + made_up() + made_up()[:5]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r for r in align.align_documents(df, BYTE_BPE, PIECES, ["doc_id", "kept", "n_a"], keep_groups=True, sent_pairs=sent).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute(texts)):
        r = got[i]
        groups = None if r["groups"] is None else [(g["a"], g["b"], g["start"], g["stop"]) for g in r["groups"]]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"], groups) == want, texts[i]
        assert r["kept"] == "x"


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(None, "same text", 1, "x")] * 50, DOCS)
    rows = align.align_documents(df, BYTE_BPE, PIECES, ["doc_id"]).collect()
    assert len(rows) == 50 and len(set(rows)) == 1 and rows[0]["count_sum"] == 50 * rows[0]["n_links"] > 0
    for none in (df.where("false"), spark.createDataFrame([(1, None, 1, "x")], DOCS)):
        assert [tuple(r)[1:] for r in align.align_documents(none, BYTE_BPE, PIECES, ["doc_id"]).collect()] == [(0, 0, 0, 0, 0, 0, "")] * none.count()


def test_long_texts_and_small_memos(spark, monkeypatch):
    """Texts are read in parts, and memos that run full are emptied; the outcome is the same."""
    random.seed(1)
    text = " ".join("".join(random.choice("abcé '\n") for _ in range(random.randint(1, 9))) for _ in range(4000))
    want = brute([text, "b c"])
    for name, value in (("READ", 500), ("PIECES", 300), ("STATES", 50), ("GATHERED", 100)):
        monkeypatch.setattr(align, name, value)
    one = align.Aligner(BYTE_BPE, PIECES)
    total = sum(one.figures.held[n].sum(axis=0) for n in one.read(text))
    assert tuple(total[:4]) == want[0][:4]
    *_, code, times, _ = align._linked(one, text, False)
    assert times.sum() == want[0][3] and len(set(code.tolist())) == len(code)


def test_transducer():
    t = align.Transducer([b"", b"ab", b"c", b"abc", b"x"], [b"", b"a", b"bc", b"abcab", b"y"])
    assert t.groups([1, 2], [1, 2]) == ([[1, 2]], [[1, 2]])
    assert t.groups([], []) == ([], [])
    for left, right in (([1], [4]), ([1], []), ([], [1]), ([1, 2], [1])):
        with pytest.raises(align.Mismatch):
            t.groups(left, right)


def test_texts_are_learnt_together(monkeypatch):
    """The new pieces of many texts are encoded at once, and come out as one text at a time does, misspelt ones among them."""
    texts = [t for t in EDGES if t] + made_up()
    one, all_ = align.Aligner(BYTE_BPE, PIECES), align.Aligner(BYTE_BPE, PIECES)
    calls, encoded = [], all_._encoded
    monkeypatch.setattr(all_, "_encoded", lambda pieces: calls.append(len(pieces)) or encoded(pieces))
    plain = [f"w{k} v{k} x{k * k}" for k in range(500)]
    assert len([list(x) for x in all_.read_all(plain)]) == 500 and calls == [1500]
    for text, parts in zip(texts, all_.read_all(texts), strict=True):
        want, got = align._linked(one, text, True), align._summed(all_, parts, True)
        assert (want is None) == (got is None), text
        if want:
            assert got[:2] == want[:2] and got[2].tolist() == want[2].tolist() and got[3].tolist() == want[3].tolist() and got[4] == want[4], text
