"""Alignment of two tokenisations of a text: groups of tokens that cover the same bytes.

A transducer reads both streams of tokens. Its state is the side that leads and the bytes of it that the
other side has not matched yet (the dangling suffix); the next token always comes from the side that lags,
and transitions are remembered by residual and token. A group closes when nothing dangles.

Neither vocabulary has a token that reaches over the start of a run of spaces behind something that is no
white space, so both tokenisations fall apart there, and the transducer is in its first state. Texts are
therefore cut at these places, and what it gives for a piece is remembered, too. New pieces of many texts
go through it side by side, a token of each at a step.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import by_size, fields_of, materialise, row_of, row_schema, worker_cache

CUT = re.compile(r"(?<=\S)(?= )")
#: Entries of each memo, pieces and characters of them that a worker remembers, characters read at a time.
STATES, PIECES, PIECE_CHARS, READ = 1_000_000, 400_000, 16_000_000, 1_000_000
#: Pieces that are encoded and aligned together; of fewer than ``FEW`` the rest is walked one by one.
TOGETHER, FEW = 4096, 32
#: Codes of pairs a worker gathers before it combines them.
GATHERED = 4_000_000
#: Different id pairs (24 bytes each) whose counts are sent to every executor at most.
SENT_PAIRS = 4_000_000
BASE = 1 << 20


class Mismatch(ValueError):
    """The two sides do not spell the same bytes."""


class Transducer:
    """Groups of two token streams; ``left`` and ``right`` are the bytes of each side's tokens by id."""

    def __init__(self, left: list[bytes], right: list[bytes]):
        self.tokens = left, right
        self._clear()

    def _clear(self) -> None:
        #: By number: the side that lags, and the residual it has to match. Nothing dangles in state 0.
        self.states: list[tuple[int, bytes]] = [(0, b"")]
        self.numbers = {(0, b""): 0}
        self.moves: dict[int, int] = {}
        #: The same moves as sorted arrays, and which side lags in each state.
        self.keys, self.to, self.lags = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, bool)

    def _move(self, state: int, token: int) -> int:
        lags, residual = self.states[state]
        spelt = self.tokens[lags][token]
        if residual.startswith(spelt):
            to = lags, residual[len(spelt) :]
        elif spelt.startswith(residual):
            to = 1 - lags, spelt[len(residual) :]
        else:
            raise Mismatch
        to = to if to[1] else (0, b"")
        if to not in self.numbers:
            self.numbers[to] = len(self.states)
            self.states.append(to)
        self.moves[state * BASE + token] = found = self.numbers[to]
        return found

    def _walk(self, left: list[int], right: list[int], state: int, i: int, j: int) -> Iterator[tuple[int, int]]:
        """Where groups end on both sides, from tokens ``i`` and ``j`` on."""
        moves, states = self.moves, self.states
        try:
            while i < len(left) or j < len(right) or state:
                if states[state][0]:
                    token = right[j]
                    j += 1
                else:
                    token = left[i]
                    i += 1
                found = moves.get(state * BASE + token)
                state = self._move(state, token) if found is None else found
                if not state:
                    yield i, j
        except IndexError:  # the side that lags has no more tokens
            raise Mismatch from None

    def _moved(self, keys: np.ndarray) -> np.ndarray:
        """The states that moves lead to; -1 where the sides differ."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            fresh, to = np.unique(keys[~known]), []
            for key in fresh.tolist():
                try:
                    to.append(self.moves.get(key) or self._move(*divmod(key, BASE)))
                except Mismatch:
                    to.append(-1)
            where = np.searchsorted(self.keys, fresh)
            self.keys, self.to = np.insert(self.keys, where, fresh), np.insert(self.to, where, to)
            self.lags = np.r_[self.lags, np.array([lags for lags, _ in self.states[len(self.lags) :]], bool)]
            at = np.searchsorted(self.keys, keys)
        return self.to[at]

    def aligned(self, left: np.ndarray, left_ends: np.ndarray, right: np.ndarray, right_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Groups of many pairs of streams, laid one behind the other: whose each group is, where it ends on both
        sides, in order; and which pairs spell the same bytes (of others some groups are missing)."""
        if len(self.moves) > STATES or len(self.states) > STATES or len(self.keys) > STATES:
            self._clear()
        n, good = len(left_ends), np.ones(len(left_ends), bool)
        i, j, state = np.r_[0, left_ends[:-1]], np.r_[0, right_ends[:-1]], np.zeros(n, np.int64)
        closed, live = [], np.arange(n)
        while True:
            live = live[(state[live] > 0) | (i[live] < left_ends[live]) | (j[live] < right_ends[live])]
            if len(live) < FEW:
                break
            second = self.lags[state[live]]
            lacks = np.where(second, j[live] >= right_ends[live], i[live] >= left_ends[live])
            if lacks.any():
                good[live[lacks]] = False
                live, second = live[~lacks], second[~lacks]
            token = np.empty(len(live), np.int64)
            token[second], token[~second] = right[j[live[second]]], left[i[live[~second]]]
            j[live] += second
            i[live] += ~second
            state[live] = to = self._moved(state[live] * BASE + token)
            done = live[to == 0]
            closed.append(np.stack([done, i[done], j[done]]))
            good[live[to < 0]] = False
            live = live[to >= 0]
        for k in live.tolist():
            a, b = int(i[k]), int(j[k])
            try:
                ends = [(k, a + x, b + y) for x, y in self._walk(left[a : left_ends[k]].tolist(), right[b : right_ends[k]].tolist(), int(state[k]), 0, 0)]
                closed.append(np.array(ends, np.int64).reshape(-1, 3).T)
            except Mismatch:
                good[k] = False
        whose, i, j = np.concatenate([np.zeros((3, 0), np.int64), *closed], axis=1)
        order = np.lexsort((j, i, whose))
        return whose[order], i[order], j[order], good

    def groups(self, left: list[int], right: list[int]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of both sides in each group, in order."""
        _, i, j, good = self.aligned(np.array(left, np.int64), np.array([len(left)]), np.array(right, np.int64), np.array([len(right)]))
        if not good.all():
            raise Mismatch
        return [left[a:b] for a, b in zip([0, *i], i)], [right[a:b] for a, b in zip([0, *j], j)]


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Grown:
    """Rows in one array that grows by half; ``held`` is what has been added so far."""

    def __init__(self, width: int = 0, kind: type = np.int64):
        self._rows = np.zeros((1024, width) if width else 1024, kind)
        self._n = 0

    @property
    def held(self) -> np.ndarray:
        return self._rows[: self._n]

    def add(self, rows: np.ndarray) -> None:
        n = self._n + len(rows)
        if n > len(self._rows):
            more = np.zeros((n + n // 2, *self._rows.shape[1:]), self._rows.dtype)
            more[: self._n] = self.held
            self._rows = more
        self._rows[self._n : n] = rows
        self._n = n


class Aligner:
    """Both vocabularies, the transducer, and what it gave for pieces of texts."""

    def __init__(self, byte_bpe: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_bpe), sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        of = byte_alphabet()
        left = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            left[i] = bytes(map(of.__getitem__, token)) if all(c in of for c in token) else token.encode()
        right = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.space = self.b.piece_to_id("▁")
        self.sizes = [np.array([len(t) for t in of], np.int64) for of in (left, right)]
        self.transducer = Transducer(left, right)
        self.left, self.right = left, right
        #: Ids as texts, followed by what comes behind them in a list of groups.
        self.marks = [b",", b"|", b";", b""]
        self.most = max(len(left), len(right))
        self.written = [str(t).encode() + mark for mark in self.marks for t in range(self.most)]
        self.widths = np.array([len(w) for w in self.written], np.int64)
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.held = 0
        self.texts: list[bytes] = []
        #: Tokens of both sides, groups, links; a row a piece. All negative: no alignment.
        self.figures = Grown(4, np.int32)
        #: Pairs of linked ids, piece by piece, and where those of each piece end.
        self.codes, self.ends = Grown(), Grown()
        self.ends.add(np.zeros(1, np.int64))

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of pieces, which all start with a space (the right side adds it by itself), and where each piece's
        end, on both sides. None of several pieces may end in white space: they fall apart where they meet."""
        whole = "".join(pieces)
        found = self.a.encode(whole, add_special_tokens=False).ids, self.b.encode(whole[1:], num_threads=1) if len(whole) > 1 else [self.space]
        ids = [np.array(x, np.int64) for x in found]
        if len(pieces) == 1:
            return ids[0], np.array([len(ids[0])]), ids[1], np.array([len(ids[1])])
        ends, out = np.cumsum([len(p.encode()) for p in pieces]), []
        for k in (0, 1):
            at = np.cumsum(self.sizes[k][ids[k]])
            cut = np.searchsorted(at, ends)
            if not len(at) or cut[-1] >= len(at) or (at[cut] != ends).any():  # something in them is spelt otherwise
                halves = [self._encoded(pieces[: len(pieces) // 2]), self._encoded(pieces[len(pieces) // 2 :])]
                return tuple(np.r_[halves[0][m], halves[1][m] + (len(halves[0][m - 1]) if m % 2 else 0)] for m in range(4))
            out += [ids[k][: cut[-1] + 1], cut + 1]
        return tuple(out)

    def learn(self, pieces: list[str]) -> None:
        """Aligns pieces that the memo lacks."""
        apart = [p for p in pieces if p[-1].isspace() or "▁" in p]
        rest = [p for p in pieces if not (p[-1].isspace() or "▁" in p)] if apart else pieces
        for some in [rest[k : k + TOGETHER] for k in range(0, len(rest), TOGETHER)] + [[p] for p in apart]:
            self._learn(some)

    def _learn(self, pieces: list[str]) -> None:
        left, left_ends, right, right_ends = self._encoded(pieces)
        whose, i, j, good = self.transducer.aligned(left, left_ends, right, right_ends)
        if len(pieces) == 1 and "▁" in pieces[0]:  # comes back as a space
            good[0] = False
        n_a, n_b = np.diff(left_ends, prepend=0), np.diff(right_ends, prepend=0)
        if not good.all():  # from here on only what is aligned whole
            held = good[whose]
            whose, shift_a, shift_b = whose[held], np.cumsum(np.where(good, 0, n_a)), np.cumsum(np.where(good, 0, n_b))
            i, j = i[held] - shift_a[whose], j[held] - shift_b[whose]
            left, right = left[np.repeat(good, n_a)], right[np.repeat(good, n_b)]
        in_a, in_b = np.diff(i, prepend=0), np.diff(j, prepend=0)
        n_groups, size = np.bincount(whose, minlength=len(pieces)), in_a * in_b
        # all pairs within each group
        group = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
        codes = left[(i - in_a)[group] + at // in_b[group]] * BASE + right[(j - in_b)[group] + at % in_b[group]]
        n_links = np.bincount(whose, size, len(pieces)).astype(np.int64)
        # ids of both sides in the order of their groups, each with the mark behind it
        words = np.empty(len(left) + len(right), np.int64)
        words[np.arange(len(left)) + np.repeat(j - in_b, in_a)] = left
        words[np.arange(len(right)) + np.repeat(i, in_b)] = right
        words[i + j - in_b - 1] += self.most
        last = np.r_[whose[1:] != whose[:-1], True] if len(whose) else np.zeros(0, bool)
        words[i + j - 1] += np.where(last, 3, 2) * self.most
        text = b"".join(map(self.written.__getitem__, words.tolist()))
        stop = np.zeros(len(pieces), np.int64)
        stop[whose[last]] = (i + j)[last]
        stop = np.r_[0, np.cumsum(self.widths[words])][np.maximum.accumulate(stop)].tolist()
        self.numbers.update(zip(pieces, range(len(self.texts), len(self.texts) + len(pieces)), strict=True))
        self.held += sum(map(len, pieces))
        self.texts += [text[a:b] for a, b in zip([0, *stop], stop)]
        figures = np.stack([n_a, n_b, n_groups, n_links], axis=1)
        figures[~good] = -1
        self.figures.add(figures)
        self.codes.add(codes)
        self.ends.add(self.ends.held[-1] + np.cumsum(n_links))

    def _known(self, pieces: set[str]) -> None:
        """Sees to it that all of some pieces are in the memo."""
        fresh = list(pieces.difference(self.numbers))
        if fresh and (len(self.texts) + len(fresh) > PIECES or self.held > PIECE_CHARS):
            self._clear()
            fresh = list(pieces)
        if fresh:
            self.learn(fresh)

    def _numbered(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, pieces), np.int64, len(pieces))

    def read(self, text: str) -> Iterator[np.ndarray]:
        """The numbers of a text's pieces, some at a time; they hold until the next ones are asked for."""
        whole, start = " " + text, 0
        while start < len(whole):
            found = CUT.search(whole, start + READ) if len(whole) - start > READ else None
            stop = found.start() if found else len(whole)
            pieces = CUT.split(whole[start:stop])
            self._known(set(pieces))
            yield self._numbered(pieces)
            start = stop

    def read_all(self, texts: list[str]) -> Iterator[Iterator[np.ndarray]]:
        """``read`` of each text, in order. Texts of up to ``READ`` characters together are learnt together."""
        if sum(map(len, texts)) > READ:
            yield from map(self.read, texts)
            return
        split = [CUT.split(" " + t) for t in texts]
        self._known(set().union(*split))
        for pieces in split:
            yield iter([self._numbered(pieces)])

    def groups(self, number: int) -> Iterator[tuple[list[int], list[int]]]:
        """The ids of both sides in each group of a piece."""
        for group in self.texts[number].decode().split(";"):
            a, b = group.split("|")
            yield [int(x) for x in a.split(",")], [int(x) for x in b.split(",")]

    def codes_of(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The id pairs linked in pieces, and where each piece's end."""
        first = self.ends.held[pieces]
        sizes = self.ends.held[pieces + 1] - first
        ends = np.cumsum(sizes)
        return self.codes.held[np.arange(int(sizes.sum())) - np.repeat(ends - sizes - first, sizes)], sizes


def _aligner(byte_bpe: str, pieces: str) -> Aligner:
    return worker_cache(("align", byte_bpe, pieces), lambda: Aligner(byte_bpe, pieces))


def _linked(aligner: Aligner, text: str, keep_groups: bool) -> tuple | None:
    """Figures and digest of a text's alignment, its different id pairs and how often each is linked, and its groups if
    wanted; None if it has no alignment."""
    return _summed(aligner, aligner.read(text), keep_groups)


def _summed(aligner: Aligner, parts: Iterator[np.ndarray], keep_groups: bool) -> tuple | None:
    """The same of a text whose pieces have the numbers ``parts``."""
    total, digest, sep, codes, times, groups, at = np.zeros(4, np.int64), hashlib.sha256(), b"", [], [], [], 0
    for numbers in parts:
        figures = aligner.figures.held[numbers]
        if (figures[:, 0] < 0).any():
            return None
        total += figures.sum(axis=0, dtype=np.int64)
        digest.update(sep + b";".join(map(aligner.texts.__getitem__, numbers.tolist())))
        sep = b";"
        piece, often = np.unique(numbers, return_counts=True)
        code, sizes = aligner.codes_of(piece)
        codes.append(code)
        times.append(np.repeat(often, sizes))
        if keep_groups:
            for a, b in (g for k in numbers.tolist() for g in aligner.groups(k)):
                stop = at + sum(len(aligner.left[t]) for t in a)
                groups.append({"a": a, "b": b, "start": at, "stop": stop})
                at = stop
    code, n = _combined(codes, times)
    return total.tolist(), digest.hexdigest(), code, n, groups


def _combined(codes: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different codes, and the sum of the times of each."""
    code, n = np.concatenate(codes), np.concatenate(times)
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(n, first) if len(first) else n


FIGURES = "n_a long, n_b long, n_groups long, n_links long"
GROUPS = "groups array<struct<a:array<int>,b:array<int>,start:long,stop:long>>"
LINKS = "a array<int>, b array<int>, times array<int>"
GROUP = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("start", pa.int64()), ("stop", pa.int64())]))


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))


def links(df: DataFrame, byte_bpe: str, pieces: str, keep_groups: bool = False) -> DataFrame:
    """``row``, ``id`` (different in each row), figures, digest and different linked pairs of the texts of ``df`` (``row``, ``text``).

    Row by row, without a shuffle. Ids are those of tasks: read them from where they have been written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = _aligner(byte_bpe, pieces), TaskContext.get().partitionId() << 33
        for batch in (part for whole in batches for part in by_size(whole, READ)):
            texts = batch.column(1).to_pylist()
            found = aligner.read_all([t for t in texts if t])
            rows = [(_summed(aligner, next(found), keep_groups) if t else None) or ([0] * 4, "", NONE, NONE, None) for t in texts]
            made = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(4)] + [pa.array([r[1] for r in rows], pa.string())]
            made += [_lists([r[2] // BASE for r in rows]), _lists([r[2] % BASE for r in rows]), _lists([r[3] for r in rows])]
            made += [pa.array([r[4] for r in rows], GROUP)] * keep_groups
            ids = pa.array(np.arange(number, number + len(rows)))
            number += len(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, *made], names=["row", "id", *NAMES, "groups_sha256", "a", "b", "times", *["groups"] * keep_groups])

    return df.mapInArrow(run, row_schema(df, f"id long, {FIGURES}, groups_sha256 string, {LINKS}" + f", {GROUPS}" * keep_groups))


NONE = np.zeros(0, np.int64)
NAMES = ["n_a", "n_b", "n_groups", "n_links"]


def _codes(batch: pa.RecordBatch, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes in the columns ``first`` (left ids) and the next (right ids), and where each row's begin and end."""
    a, b = batch.column(first), batch.column(first + 1)
    ends = a.offsets.to_numpy().astype(np.int64)
    left, right = (np.asarray(x.values)[x.offsets[0].as_py() : x.offsets[-1].as_py()].astype(np.int64) for x in (a, b))
    return left * BASE + right, ends - ends[0]


def pair_counts(linked: DataFrame) -> DataFrame:
    """``a``, ``b``, ``docs`` (rows of ``links`` that hold the pair), ``best`` (none of ``a`` is in more).

    Pairs leave a worker counted; their number is bounded by the vocabularies, whatever the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, held = [], [], 0
        for batch in batches:
            code, _ = _codes(batch, 0)
            codes.append(code)
            counts.append(np.ones(len(code), np.int64))
            held += len(code)
            if held > GATHERED:
                code, total = _combined(codes, counts)
                codes, counts, held = [code], [total], len(code)
                if held > GATHERED // 2:
                    yield out(code, total)
                    codes, counts, held = [], [], 0
        if codes:
            yield out(*_combined(codes, counts))

    def out(code: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((code // BASE).astype(np.int32)), pa.array((code % BASE).astype(np.int32)), pa.array(total)], names=["a", "b", "docs"])

    found = linked.select("a", "b").mapInArrow(run, "a int, b int, docs long").groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    # at most a row for each id of the other vocabulary in a window
    return found.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy("a")))


def _judged(linked: DataFrame, counts: DataFrame) -> DataFrame:
    """``linked`` with ``n_best`` and ``count_sum``, by counts that every executor gets."""
    found = counts.toArrow()
    code = found["a"].to_numpy().astype(np.int64) * BASE + found["b"].to_numpy()
    order = np.argsort(code)
    sent = linked.sparkSession.sparkContext.broadcast((code[order], found["docs"].to_numpy()[order], np.array(found["best"].to_pylist(), np.int64)[order]))
    at = linked.columns.index("a")
    rest = [c for c in linked.columns if c not in ("a", "b", "times", "id")]
    kinds = StructType([linked.schema[c] for c in rest] + StructType.fromDDL("n_best long, count_sum long").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs, best = sent.value
        for batch in batches:
            codes, ends = _codes(batch, at)
            times = np.asarray(batch.column(at + 2).values)[batch.column(at + 2).offsets[0].as_py() :][: len(codes)].astype(np.int64)
            where = np.searchsorted(known, codes)
            new = []
            for of in (best, docs):
                total = np.r_[0, np.cumsum(of[where] * times)]
                new.append(pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.names.index(c)) for c in rest], *new], names=[*rest, "n_best", "count_sum"])

    return linked.mapInArrow(run, kinds)


def _joined(linked: DataFrame, counts: DataFrame, salts: int = 32) -> DataFrame:
    """The same where counts are too many to send: pairs meet them in a join; one that most texts hold is spread
    over ``salts`` copies of its count."""
    each = linked.select("id", F.explode(F.arrays_zip("a", "b", "times")).alias("x")).select("id", "x.*", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    spread = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    sums = each.join(spread, ["a", "b", "salt"]).groupBy("id").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    return linked.drop("a", "b", "times").join(sums, "id", "left").fillna(0, ["n_best", "count_sum"])


def align_documents(df: DataFrame, byte_bpe: str, pieces: str, keep: list[str], text: str = "text", keep_groups: bool = False, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """The columns ``keep`` of every row with the figures of its alignment and a digest of its groups.

    The left side is space and text by the byte-level vocabulary ``byte_bpe``, the right side the text by
    the SentencePiece vocabulary ``pieces``; strings of special tokens in texts are plain text. ``n_links``
    pairs of tokens share a group; of these ``n_best`` are, corpus-wide, in as many rows as any pair of the
    same left id, and ``count_sum`` adds up in how many rows each is. ``groups_sha256`` digests the groups
    as ``a1,a2|b1;a3|b2``. With ``keep_groups``, ``groups`` holds their ids and offsets in the bytes of
    space and text.

    Texts are encoded once; their different pairs are written, and counted from there. Up to ``sent_pairs``
    counts, counted, are sent to the workers; beyond that pairs are joined with them. A null or empty text,
    or one whose tokens do not spell it (the lower block U+2581 comes back as a space), has no tokens:
    zeros, an empty digest, null groups. Repeated rows stay and count one by one; an empty table gives an
    empty one. Columns of ``keep`` named like those made here are left out.
    """
    made = [*NAMES, "n_best", "count_sum", "groups_sha256", *["groups"] * keep_groups]
    keep = [c for c in keep if c not in made]
    inner = df.select(row_of(keep), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    linked = materialise(links(inner, byte_bpe, pieces, keep_groups), "links")
    counts = materialise(pair_counts(linked), "pairs")
    found = _judged(linked, counts) if counts.count() <= sent_pairs else _joined(linked, counts)
    return found.select(*fields_of(keep), *made)
