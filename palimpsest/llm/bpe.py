"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a pre-token exactly one vocabulary entry can be the last token of that prefix's
encoding: the token ``t`` ending there for which the last token ``p`` of the prefix before it and ``t``
are *compatible*, i.e. no merge of lower rank acts across the seam between them. So one left-to-right
pass stores one token per prefix and the back-pointers (token lengths) give the encoding.

* Tokens ending at a position come from a suffix automaton of the whole vocabulary.
* Compatibility walks the right spine of ``p`` and the left spine of ``t`` in the merge tree.
* The last token of a prefix depends on that prefix alone; pre-tokens are therefore handled in sorted
  order and shared prefixes are computed once. A bounded memo keeps whole pre-tokens.

Only the file of the vocabulary is read; the library that made it is used for splitting texts with
characters beyond U+052F (where Unicode versions differ) and, in tests, as the reference result.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, fields_of, row_of, row_schema, worker_cache

#: Entries kept by each memo of a worker; the memo is emptied when it is full, which costs time only.
MEMO = 100_000
#: Characters that both memos hold at most, however long their entries are.
MEMO_CHARS = 16_000_000
#: Bytes of texts that are encoded together.
READ = 1_000_000
NEVER = 1 << 60
#: Pre-tokens of up to so many bytes are encoded side by side.
WIDE = 32


class SuffixAutomaton:
    """Suffix automaton of several strings: reads bytes and tells which of the strings end here."""

    def __init__(self, strings: list[tuple[bytes, int]]):
        self.step: dict[int, int] = {}  # state << 8 | byte -> state
        self.link, self.length = [-1], [0]
        self.moves: list[list[int]] = [[]]  # bytes that lead on from a state
        ends: dict[int, list[tuple[int, int]]] = {}
        for text, token in strings:
            at = 0
            for byte in text:
                at = self._extend(at, byte)
        for text, token in strings:
            at = 0
            for byte in text:
                at = self.step[at << 8 | byte]
            ends.setdefault(at, []).append((len(text), token))
        #: By state: (length, token) of all strings that are suffixes of its longest string, longest first.
        self.found: list[tuple[tuple[int, int], ...]] = [()] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            own = tuple(sorted(ends.get(state, ()), reverse=True))
            self.found[state] = own + self.found[self.link[state]]
        del self.moves

    def _new(self, length: int) -> int:
        self.link.append(0)
        self.length.append(length)
        self.moves.append([])
        return len(self.link) - 1

    def _split(self, state: int, byte: int, target: int) -> int:
        """A copy of ``target`` for the strings up to ``state`` plus ``byte``."""
        copy = self._new(self.length[state] + 1)
        self.moves[copy] = list(self.moves[target])
        for b in self.moves[target]:
            self.step[copy << 8 | b] = self.step[target << 8 | b]
        self.link[copy], self.link[target] = self.link[target], copy
        while state >= 0 and self.step.get(state << 8 | byte) == target:
            self.step[state << 8 | byte] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, byte: int) -> int:
        known = self.step.get(last << 8 | byte)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, byte, known)
        now = self._new(self.length[last] + 1)
        state = last
        while state >= 0 and (state << 8 | byte) not in self.step:
            self.step[state << 8 | byte] = now
            self.moves[state].append(byte)
            state = self.link[state]
        if state >= 0:
            target = self.step[state << 8 | byte]
            exact = self.length[target] == self.length[state] + 1
            self.link[now] = target if exact else self._split(state, byte, target)
        return now

    def read(self, state: int, matched: int, byte: int) -> tuple[int, int]:
        """State and length of the longest known substring after one more byte."""
        while True:
            to = self.step.get(state << 8 | byte)
            if to is not None:
                return to, matched + 1
            if state == 0:
                return 0, 0
            state = self.link[state]
            matched = self.length[state]


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write the 256 bytes (printable ones as they are)."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixBpe:
    """Encoder and decoder of a byte-level BPE vocabulary file (``tokenizers`` JSON)."""

    SPLIT = r" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, file: str):
        self.file = file
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only byte-level BPE files without normaliser and prefix space are supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that look at their surroundings are not supported")
        alphabet = byte_alphabet()
        vocab = {bytes(alphabet[c] for c in text): token for text, token in model["vocab"].items() if all(c in alphabet for c in text)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {token: text for text, token in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> rank, left and right part
        for rank, merge in enumerate(model["merges"]):
            left, right = (vocab[bytes(alphabet[c] for c in part)] for part in (merge.split(" ") if isinstance(merge, str) else merge))
            self.rank[left, right] = rank
            made = vocab[self.bytes_of[left] + self.bytes_of[right]]
            self.parts.setdefault(made, (rank, left, right))
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._fits: dict[int, bool] = {}
        self._words: dict[str, tuple[int, ...]] = {}
        self._pieces_memo: dict[str, tuple[int, ...]] = {}
        self._held = 0
        #: Tokens that their own merges make; any other is never the result of an encoding.
        made = {t for t, (_, left, right) in self.parts.items() if self._seam_free(left, right, self.parts[t][0])}
        self.match = SuffixAutomaton(sorted((b, t) for b, t in ((self.bytes_of[t], t) for t in vocab.values() if t not in self.special.values()) if len(b) == 1 or t in made))
        specials = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self._special = regex.compile(f"({specials})") if specials else None
        self._split = regex.compile(self.SPLIT)
        self._far = regex.compile("[^\x00-ԯ]")
        #: What keeps a text from falling apart at its spaces and line ends.
        self.apart = ["  ", " \n", "\n ", "\n\n", *self.special]
        self._odd = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u0530-\U0010ffff]")
        found = self.match.found
        keys = np.fromiter(sorted(self.match.step), np.int64)
        self._arrays = (
            keys, np.array([self.match.step[k] for k in keys.tolist()]), np.array(self.match.link), np.array(self.match.length),
            np.cumsum([0, *map(len, found)]), np.array([size for x in found for size, _ in x]), np.array([t for x in found for _, t in x]),
        )
        self._pair_keys, self._pair_fits, self._pairs_held = np.full(1 << 21, -1), np.zeros(1 << 21, bool), 0
        self.digits = [str(i) for i in range(max(self.bytes_of) + 1)]
        #: One object for each id: memos refer to these and hold no numbers of their own.
        self._ids = list(range(len(self.digits)))
        self._library = None

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens along one edge of the merge tree, with the rank at which each is used up."""
        held = (self._left, self._right)[side == 2]
        out = held.get(token)
        if out is None:
            out, used = [], NEVER
            while True:
                out.append((token, used))
                if token not in self.parts:
                    break
                used, token = self.parts[token][0], self.parts[token][side]
            held[out[0][0]] = out
        return out

    def _seam_free(self, left: int, right: int, below: int = NEVER) -> bool:
        """No merge acts across the seam of two tokens before rank ``below``."""
        rank = self.rank
        for a, a_used in self._spine(left, 2):
            for b, b_used in self._spine(right, 1):
                r = rank.get((a, b))
                if r is not None and r < a_used and r <= b_used and r < below:
                    return False
        return True

    def encode_sorted(self, pieces: list[bytes]) -> Iterator[tuple[int, ...]]:
        """The tokens of each pre-token; equal prefixes of neighbours are worked out once."""
        step, found, fits = self.match.step, self.match.found, self._fits
        before = b""
        states: list[tuple[int, int]] = [(0, 0)]
        last: list[int] = [-1]
        back: list[int] = [0]
        for piece in pieces:
            n, k = len(piece), 0
            top = min(n, len(before))
            if piece[:top] == before[:top]:
                k = top
            else:
                while piece[k] == before[k]:
                    k += 1
            del states[k + 1 :], last[k + 1 :], back[k + 1 :]
            state, matched = states[k]
            for i in range(k + 1, n + 1):
                to = step.get(state << 8 | piece[i - 1])
                if to is not None:
                    state, matched = to, matched + 1
                else:
                    state, matched = self.match.read(state, matched, piece[i - 1])
                for length, token in found[state]:
                    if length > matched:
                        continue
                    if length == i:
                        break
                    key = last[i - length] << 20 | token
                    ok = fits.get(key)
                    if ok is None:
                        if len(fits) >= 4 * MEMO:
                            fits.clear()
                        ok = fits[key] = self._seam_free(last[i - length], token)
                    if ok:
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                states.append((state, matched))
                last.append(self._ids[token])
                back.append(length)
            before = piece
            out, i = [], n
            while i:
                out.append(last[i])
                i -= back[i]
            yield tuple(reversed(out))

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Vectorised compatibility test, with a hash table of the pairs met so far."""
        pairs = left.astype(np.int64) << 20 | right
        keys, known = self._pair_keys, self._pair_fits
        mask = len(keys) - 1
        at = (pairs * 0x2545F4914F6CDD1D >> 24) & mask
        found = keys[at]
        todo = np.flatnonzero((found != pairs) & (found >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            found[todo] = keys[at[todo]]
            todo = todo[(found[todo] != pairs[todo]) & (found[todo] >= 0)]
        out = known[at]
        missing = np.flatnonzero(found < 0)
        if len(missing):
            fresh, where = np.unique(pairs[missing], return_inverse=True)
            fits = np.array([self._seam_free(k >> 20, k & 0xFFFFF) for k in fresh.tolist()])
            out[missing] = fits[where]
            if self._pairs_held + len(fresh) > len(keys) // 2:
                keys.fill(-1)
                self._pairs_held = 0
            self._pairs_held += len(fresh)
            slots = ((fresh * 0x2545F4914F6CDD1D >> 24) & mask).tolist()
            for key, fit, slot in zip(fresh.tolist(), fits.tolist(), slots, strict=True):
                while keys[slot] >= 0:
                    slot = (slot + 1) & mask
                keys[slot], known[slot] = key, fit
        return out

    def encode_many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """As ``encode_sorted``, for many pre-tokens of up to ``WIDE`` bytes side by side: the same
        table of last tokens, filled column by column."""
        if not pieces:
            return []
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        order = np.argsort(-sizes, kind="stable")
        rows = np.frombuffer(b"".join([p.ljust(WIDE, b"\0") for p in pieces]), np.uint8).reshape(n, WIDE)[order].astype(np.int64)
        sizes = sizes[order]
        last = np.zeros((n, WIDE + 1), np.int32)
        back = np.zeros((n, WIDE + 1), np.int8)
        state, matched = np.zeros(n, np.int64), np.zeros(n, np.int64)
        keys, targets, link, length, first, c_length, c_token = self._arrays
        for d in range(1, int(sizes[0]) + 1):
            live = int(np.searchsorted(-sizes, -d, "right"))
            todo = np.arange(live)
            while len(todo):
                key = state[todo] << 8 | rows[todo, d - 1]
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[at] == key
                state[todo[hit]] = targets[at[hit]]
                matched[todo[hit]] += 1
                todo = todo[~hit]
                state[todo] = link[state[todo]]
                matched[todo] = length[state[todo]]
            todo = np.arange(live)
            at = first[state[:live]]
            stop = first[state[:live] + 1]
            while len(todo):
                if (at[todo] >= stop[todo]).any():
                    raise ValueError("the vocabulary lacks a byte")
                size, token = c_length[at[todo]], c_token[at[todo]]
                fits = (size == d) & (size <= matched[todo])
                ask = np.flatnonzero((size < d) & (size <= matched[todo]))
                fits[ask] = self._compatible(last[todo[ask], d - size[ask]], token[ask])
                won = todo[fits]
                last[won, d], back[won, d] = token[fits], size[fits]
                todo = todo[~fits]
                at[todo] += 1
        every = np.arange(n)
        at = sizes.copy()
        whose, tokens = [], []
        while len(every):
            whose.append(every)
            tokens.append(last[every, at[every]])
            at[every] -= back[every, at[every]]
            every = every[at[every] > 0]
        whose, tokens = order[np.concatenate(whose[::-1])], np.concatenate(tokens[::-1])
        by_piece = np.argsort(whose, kind="stable")
        flat = list(map(self._ids.__getitem__, tokens[by_piece].tolist()))
        ends = np.cumsum(np.bincount(whose, minlength=n)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]

    def split(self, text: str) -> list[str]:
        """Pre-tokens; special tokens stand alone."""
        if self._special is not None and any(s in text for s in self.special):
            out: list[str] = []
            for part in self._special.split(text):
                out += [part] if part in self.special else self._pieces(part)
            return out
        return self._pieces(text)

    def _pieces(self, text: str) -> list[str]:
        if self._far.search(text) is None:
            return self._split.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.file).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """The token ids of each text.

        A text without two white-space characters in a row falls apart before each space and around
        each line end, whatever stands next to them, so the memo can hold space-separated words. Any
        other text is split as a whole.
        """
        words, pieces = self._words, self._pieces_memo
        if len(words) > 2 * MEMO or self._held > MEMO_CHARS:
            words.clear()
        if len(pieces) > MEMO or self._held > MEMO_CHARS:
            pieces.clear()
        if not pieces and not words:
            self._held = 0
        keyed: list[list[str]] = []
        for text in texts:
            if any(s in text for s in self.apart) or self._odd.search(text) is not None:
                keyed.append(self.split(text))
                continue
            keys: list[str] = []
            for line in text.split("\n"):
                first, *rest = line.split(" ")
                if first:
                    keys.append(first)
                keys += [" " + w for w in rest]
                keys.append("\n")
            keys.pop()
            keyed.append(keys)
        fresh = set().union(*keyed).difference(words)
        parts = {w: (w,) if w in self.special or w[1:].isalpha() and (w[0] == " " or w[0].isalpha()) else self._pieces(w) for w in fresh}
        new = {p for ps in parts.values() for p in ps}.difference(pieces)
        self._held += sum(map(len, fresh)) + sum(map(len, new))
        raw = [(p.encode(), p) for p in new]
        short = [x for x in raw if len(x[0]) <= WIDE]
        long = sorted(x for x in raw if len(x[0]) > WIDE)
        pieces.update(zip([p for _, p in short], self.encode_many([b for b, _ in short]), strict=True))
        pieces.update(zip([p for _, p in long], self.encode_sorted([b for b, _ in long]), strict=True))
        for s, token in self.special.items():
            pieces[s] = (token,)
        for w, ps in parts.items():
            words[w] = pieces[ps[0]] if len(ps) == 1 else tuple([t for p in ps for t in pieces[p]])
        return [list(chain.from_iterable(map(words.__getitem__, keys))) for keys in keyed]

    def encode(self, text: str) -> list[int]:
        """Token ids of a text, as the library gives them without its special tokens added."""
        return self.encode_batch([text])[0]

    def decode(self, ids) -> str:
        """Text of token ids; bytes that are no UTF-8 become U+FFFD. Unknown ids are left out."""
        of = self.bytes_of
        try:
            return b"".join(map(of.__getitem__, ids)).decode("utf-8", "replace")
        except KeyError:
            return self.decode([t for t in ids if t in of])


def loaded(file: str) -> PrefixBpe:
    """The encoder of a file, once per worker process."""
    return worker_cache(("bpe", file), lambda: PrefixBpe(file))


def encode_documents(df: DataFrame, file: str, text: str = "text", keep_ids: bool = True, keep_text: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Encodes and decodes the column ``text`` of every row.

    Gives the columns ``keep`` (default: all other columns than those made here) and ``n_tokens``,
    ``ids`` (array of int, if ``keep_ids``), ``decoded`` (if ``keep_text``), ``ids_sha256`` and
    ``decoded_sha256``. Row by row: no shuffle, repeated rows stay, an empty table gives an empty one.
    A null text counts as empty. Columns of those names in ``df`` are replaced.
    """
    made = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids + ["decoded"] * keep_text
    rest = [c for c in (df.columns if keep is None else keep) if c not in made]
    inner = df.select(row_of(rest), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    schema = row_schema(inner, ", ".join(["n_tokens long, ids_sha256 string, decoded_sha256 string"] + ["ids array<int>"] * keep_ids + ["decoded string"] * keep_text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the memos hold no cycles, and walking them again and again takes a third of the time
        bpe = loaded(file)
        for batch in (part for whole in batches for part in by_size(whole, READ)):
            n, ids_hash, text_hash, all_ids, all_texts = [], [], [], [], []
            for ids in bpe.encode_batch(batch.column(1).to_pylist()):
                decoded = bpe.decode(ids)
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join(map(bpe.digits.__getitem__, ids)).encode()).hexdigest())
                text_hash.append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep_ids:
                    all_ids.append(ids)
                if keep_text:
                    all_texts.append(decoded)
            new = [pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            new += [pa.array(all_ids, pa.list_(pa.int32()))] * keep_ids + [pa.array(all_texts, pa.string())] * keep_text
            yield pa.RecordBatch.from_arrays([batch.column(0), *new], names=["row", *made])

    return inner.mapInArrow(run, schema).select(*fields_of(rest), *made)
