"""Suffix order of a shard by external induced sorting, with common-prefix values.

Suffixes are L (greater than their right neighbour) or S. Those S that follow an L start the shard's S*
pieces: the pieces are sorted and named, the shorter string of names is solved by recursion, and the order
of the S* suffixes then induces all others. An L pass upward and an S pass downward move tuples through a
priority queue: it hands them out by first symbol and, within one, in the order of arrival, which is what
makes the result sorted.

At the top, symbols are bytes and tuples are (position, common prefix with the tuple before): the common
prefix of two neighbours that a pass induces is one more than the least of the values between their
sources, so it is carried along and never read from the text again; only S* neighbours and the seams of
passes are compared directly. Below, symbols are names, of which there may be as many as tuples: there the
queue hands out a range of names at once, and tuples that the range induces into itself are ordered by
following their chains of sources, twice as far each time.

``limit`` bounds the bytes in memory, not the shard. Texts, types, names and orders beyond a part of it lie
in files, the queue keeps tuples on disk beyond it, and names are made by external sorting: keys are dealt
by sampled splitters into runs on disk that are sorted one by one. What stays in memory besides is a run
of equal symbols that a range of names cannot be split within, handed on in batches.
"""

from __future__ import annotations

import os
import tempfile
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np

#: Common prefixes are counted up to so many symbols; no value beyond it is told apart.
CAP = 250
#: Tuples handled at once.
BATCH = 1 << 20


class Space:
    """Arrays of a shard: in memory while small, in files beyond a 16th of ``limit`` bytes."""

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit = folder, limit
        #: Tuples or keys handled at once, by the memory there is.
        self.batch = max(1, min(BATCH, limit // 64))
        #: What happened: ``levels`` of recursion, ``spills`` of the queue, external ``sorts``, ``files``.
        self.seen: Counter[str] = Counter()

    def array(self, n: int, kind: type) -> np.ndarray:
        if n * np.dtype(kind).itemsize * 16 <= self.limit or not n:
            return np.zeros(n, kind)
        self.seen["files"] += 1
        handle, name = tempfile.mkstemp(prefix="array-", dir=self.folder)
        os.close(handle)
        out = np.memmap(name, kind, "w+", shape=(n,))
        os.unlink(name)  # the mapping holds the file as long as it is needed
        return out

    def chunks(self, n: int) -> Iterator[slice]:
        for k in range(0, n, self.batch):
            yield slice(k, min(n, k + self.batch))


class PriorityQueue:
    """Tuples by symbol, first in first out; on disk beyond ``limit`` bytes."""

    def __init__(self, space: Space):
        self.space, self.limit = space, space.limit // 2
        self.held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        self.bytes: dict[int, int] = {}
        self.files: dict[int, list[str]] = {}
        self.total = 0

    def __contains__(self, symbol: int) -> bool:
        return symbol in self.held or symbol in self.files

    def push(self, symbol: int, *columns: np.ndarray) -> None:
        self.held.setdefault(symbol, []).append(columns)
        more = sum(c.nbytes for c in columns)
        self.bytes[symbol] = self.bytes.get(symbol, 0) + more
        self.total += more
        while self.total > self.limit:
            self._spill(max(self.bytes, key=self.bytes.__getitem__))

    def _spill(self, symbol: int) -> None:
        self.space.seen["spills"] += 1
        parts = self.held.pop(symbol)
        handle, name = tempfile.mkstemp(prefix="queue-", dir=self.space.folder)
        with open(handle, "wb") as f:
            for column in zip(*parts, strict=True):
                np.save(f, np.concatenate(column))
        self.files.setdefault(symbol, []).append(name)
        self.total -= self.bytes.pop(symbol)

    def take(self, symbol: int, back: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
        """Takes out what has been pushed for a symbol so far, in batches in the order of arrival, or
        with ``back`` from the last batch to the first."""
        names, parts = self.files.pop(symbol, []), self.held.pop(symbol, [])
        self.total -= self.bytes.pop(symbol, 0)
        chunks = [*names, parts] if parts else names
        for chunk in reversed(chunks) if back else chunks:
            if isinstance(chunk, str):
                columns = []
                with open(chunk, "rb") as f:
                    while f.tell() < os.fstat(f.fileno()).st_size:
                        columns.append(np.load(f))
                os.unlink(chunk)
            else:
                columns = [np.concatenate(c) for c in zip(*chunk, strict=True)]
            cuts = [tuple(c[part] for c in columns) for part in self.space.chunks(len(columns[0]))]
            yield from reversed(cuts) if back else cuts


def _types(text: np.ndarray, space: Space) -> np.ndarray:
    """True for S suffixes, the empty one at the end included."""
    n = len(text)
    out = space.array(n + 1, np.bool_)
    out[n] = True
    # the sign of the next change of symbol to the right decides; the last suffix is L
    carry = False
    for part in reversed(list(space.chunks(n))):
        here = np.asarray(text[part.start : part.stop + 1])
        change = np.flatnonzero(here[1:] != here[:-1])
        last = int(change[-1]) + 1 if len(change) else 0
        if last:
            out[part.start : part.start + last] = np.repeat(here[change + 1] > here[change], np.diff(change, prepend=-1))
        out[part.start + last : part.stop] = carry
        carry = bool(out[part.start])
    return out


def _starts(types: np.ndarray, space: Space, kind: type) -> np.ndarray:
    """Where S* suffixes start, without the empty one."""
    n = len(types) - 1
    found = [np.flatnonzero(types[p.start + 1 : p.stop + 1] & ~types[p]) + (p.start + 1) for p in space.chunks(max(0, n - 1))]
    out, k = space.array(sum(map(len, found)), kind), 0
    for x in found:
        out[k : k + len(x)] = x
        k += len(x)
    return out


def _ranks(keys: np.ndarray, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """For each key, how many keys are less, and whether others are equal.

    Keys beyond ``batch`` are sorted externally: dealt by sampled splitters into runs, which are files,
    and each run is sorted by itself. A run of one key that is frequent needs no sort.
    """
    n = len(keys)
    if n <= space.batch:
        return _ranks_held(np.asarray(keys))
    space.seen["sorts"] += 1
    runs = 2 * (n // space.batch + 1)
    sample = np.sort(keys[np.sort(np.random.default_rng(n).integers(0, n, 32 * runs))])
    cuts = np.unique(sample[::32])
    # run 2k holds keys between cuts, run 2k + 1 those equal to a cut
    files = [tempfile.TemporaryFile(dir=space.folder) for _ in range(2 * len(cuts) + 1)]
    sizes = [0] * len(files)
    for part in space.chunks(n):
        x = np.asarray(keys[part])
        to = (np.searchsorted(cuts, x, "left") + np.searchsorted(cuts, x, "right")).astype(np.uint16 if len(files) < 1 << 16 else np.int64)
        order = np.argsort(to, kind="stable")
        edges = np.searchsorted(to[order], np.arange(len(files) + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            at = order[edges[k] : edges[k + 1]]
            sizes[k] += len(at)
            np.stack([at + part.start, x[at]]).astype(np.int64).T.tofile(files[k])
    out, more = space.array(n, np.int64), space.array(n, np.bool_)
    before = 0
    for k, file in enumerate(files):
        file.seek(0)
        left = sizes[k]
        many = sizes[k] if k % 2 else space.limit  # a run between two cuts is sorted whole
        while left:
            rows = np.fromfile(file, np.int64, 2 * min(left, space.batch if k % 2 else left)).reshape(-1, 2)
            left -= len(rows)
            if k % 2:
                out[rows[:, 0]], more[rows[:, 0]] = before, many > 1
            else:
                r, again = _ranks_held(rows[:, 1])
                out[rows[:, 0]], more[rows[:, 0]] = r + before, again
        before += sizes[k]
        file.close()
    return out, more


def _ranks_held(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    held = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = held[1:] != held[:-1]
    heads = np.flatnonzero(new)
    sizes = np.diff(heads, append=len(keys))
    out, more = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
    out[order] = np.repeat(heads, sizes)
    more[order] = np.repeat(sizes > 1, sizes)
    return out, more


def _name_pieces(text: np.ndarray, types: np.ndarray, starts: np.ndarray, top: int, space: Space) -> tuple[np.ndarray, int]:
    """Names, in order from 0, of the S* pieces (each up to and with the next start), and how many differ.

    A few symbols of the pieces make a key at a time; pieces that share all keys so far go on to the next.
    """
    n, m = len(text), len(starts)
    bits = (2 * top + 3).bit_length()
    word = max(1, 62 // bits)

    def key(at: np.ndarray, size: np.ndarray, done: int) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for k in range(done, done + word):
            here = np.minimum(at + k, n - 1)
            inside = (k < size) & (at + k < n)
            out = (out << bits) + np.where(inside, (text[here].astype(np.int64) << 1) + types[here] + 1, 0)
        return out

    def keys(live: np.ndarray | None, done: int) -> np.ndarray:
        count = m if live is None else len(live)
        out = space.array(count, np.int64)
        for p in space.chunks(count):
            which = np.arange(p.start, p.stop) if live is None else live[p]
            out[p] = key(starts[which].astype(np.int64), sizes_of(which), done)
        return out

    def sizes_of(which: np.ndarray) -> np.ndarray:
        return np.where(which + 1 < m, starts[np.minimum(which + 1, m - 1)], n - 1).astype(np.int64) - starts[which] + 1

    names, more = _ranks(keys(None, 0), space)
    live, done = None, word
    while True:
        found = []
        for p in space.chunks(m if live is None else len(live)):
            which = np.arange(p.start, p.stop) if live is None else live[p]
            found.append(which[(more[p]) & (sizes_of(which) > done)])
        live = space.array(sum(map(len, found)), np.int64)
        if not len(live):
            break
        np.concatenate(found, out=live)
        held, (sub, _) = names[live], _ranks(keys(live, done), space)
        joint, more = _ranks(held * (len(live) + 1) + sub, space)
        names[live] = held + joint - _ranks(held, space)[0]
        done += word
    # ranks have gaps where names repeat
    used = space.array(m, np.bool_)
    for p in space.chunks(m):
        used[names[p]] = True
    dense, kinds = space.array(m, np.int64), 0
    for p in space.chunks(m):
        dense[p] = kinds + np.cumsum(used[p]) - 1
        kinds += int(np.count_nonzero(used[p]))
    for p in space.chunks(m):
        names[p] = dense[names[p]]
    return names, kinds


def _compare(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int, space: Space) -> np.ndarray:
    """Common prefixes of pairs of suffixes, up to ``cap``; four symbols of 16 bits are compared at once."""
    n = len(text)
    out = np.zeros(len(a), np.uint8)
    wide = np.ndarray((max(0, n - 3),), "<u8", buffer=text, strides=(2,)) if text.dtype == np.uint16 and n > 3 else None
    for part in space.chunks(len(a)):
        x, y = a[part].astype(np.int64), b[part].astype(np.int64)
        live, k = np.arange(part.start, part.stop), 0
        if wide is not None:
            while k + 4 <= cap and len(live):
                inside = np.maximum(x, y) + k + 4 <= n
                rest = ~inside
                differ = np.zeros(len(live), np.uint64)
                differ[inside] = wide[x[inside] + k] ^ wide[y[inside] + k]
                stop = differ != 0
                low = differ[stop] & (~differ[stop] + np.uint64(1))  # its lowest bit set tells the first symbol that differs
                out[live[stop]] = k + (np.searchsorted(_EDGES, low, "right") - 1)
                tail = np.flatnonzero(rest)
                if len(tail):
                    out[live[tail]] = _compare_slowly(text, x[tail], y[tail], k, cap)
                go = inside & ~stop
                live, x, y, k = live[go], x[go], y[go], k + 4
        if len(live):
            out[live] = _compare_slowly(text, x, y, k, cap)
    return out


_EDGES = np.array([1, 1 << 16, 1 << 32, 1 << 48], np.uint64)


def _compare_slowly(text: np.ndarray, a: np.ndarray, b: np.ndarray, known: int, cap: int) -> np.ndarray:
    n = len(text)
    out = np.full(len(a), known, np.uint8)
    live = np.arange(len(a))
    for k in range(known, cap):
        x, y = a[live] + k, b[live] + k
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        live = live[text[x] == text[y]]
        if not len(live):
            break
        out[live] += 1
    return out


class _Least:
    """Common-prefix values between the sources of consecutive tuples of each symbol."""

    def __init__(self, cap: int):
        self.cap = cap
        self.since: dict[int, int] = {}  # symbol -> least value after its last source

    def induce(self, values: np.ndarray, targets: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For sources with ``values`` (common prefix with the source before), of which ``chosen`` induce
        the symbols ``targets``: the order by symbol, the symbols in that order, and the values induced."""
        by = np.argsort(targets, kind="stable")
        order, to = chosen[by], targets[by]
        first = np.ones(len(order), bool)
        first[1:] = to[1:] != to[:-1]
        last = np.append(first[1:], True) if len(order) else first
        out = np.zeros(len(order), np.int64)
        same = np.flatnonzero(~first)
        if len(same):
            out[same] = self._between(values, order[same - 1] + 1, order[same])
        upto = np.minimum.accumulate(values) if len(values) else values
        new = {}
        for k in np.flatnonzero(first).tolist():
            symbol = int(to[k])
            out[k] = min(self.since[symbol], int(upto[order[k]])) if symbol in self.since else -1
        after = np.append(np.minimum.accumulate(values[::-1])[::-1], 255) if len(values) else values
        for k in np.flatnonzero(last).tolist():
            new[int(to[k])] = int(after[order[k] + 1])
        if len(values):
            least = int(after[0])
            for symbol, held in self.since.items():
                if symbol not in new and least < held:
                    self.since[symbol] = least
        self.since.update(new)
        return order, to, np.minimum(out + 1, self.cap).astype(np.uint8)

    @staticmethod
    def _between(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Least of values[start..stop] for each pair, from tables of powers of two."""
        length = stop - start + 1
        out = np.empty(len(start), values.dtype)
        table, power = values, 1
        while True:
            here = np.flatnonzero((length >= power) & (length < 2 * power))
            if len(here):
                out[here] = np.minimum(table[start[here]], table[stop[here] - power + 1])
            if 2 * power > int(length.max()):
                return out
            table = np.minimum(table[:-power], table[power:])
            power *= 2


def _induce(text: np.ndarray, types: np.ndarray, seeds: np.ndarray, alphabet: list[int], space: Space, cap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in falling order, in batches with the common prefix with the suffix before (greater).

    ``seeds``: the S* suffixes in rising order. The empty suffix is left out.
    """
    n = len(text)
    seed_common = space.array(len(seeds), np.uint8)
    for p in space.chunks(len(seeds)):
        a = max(1, p.start)
        seed_common[a : p.stop] = _compare(text, seeds[a - 1 : p.stop - 1], seeds[a : p.stop], cap, space)
    bounds = [bisect_left(seeds, symbol, key=lambda p: text[p]) for symbol in alphabet] + [len(seeds)]
    kept = PriorityQueue(space)  # L suffixes in rising order, for the way back
    kind = seeds.dtype

    def move(queue: PriorityQueue, least: _Least, at: np.ndarray, common: np.ndarray, s_type: bool) -> None:
        before = at - 1
        chosen = np.flatnonzero((before >= 0) & (types[before] == s_type))
        order, to, induced = least.induce(common, text[before[chosen]], chosen)
        if not len(order):
            return
        cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1])).tolist() + [len(to)]
        for a, b in zip(cuts, cuts[1:]):
            queue.push(int(to[a]), before[order[a:b]], induced[a:b])

    queue, least = PriorityQueue(space), _Least(cap)
    move(queue, least, np.array([n], kind), np.zeros(1, np.uint8), False)  # the empty suffix comes first
    for k, symbol in enumerate(alphabet):
        end = -1
        fresh = True
        while symbol in queue:
            for at, common in queue.take(symbol):
                common = common.copy()
                if fresh:
                    common[0], fresh = 0, False
                kept.push(symbol, at, common)
                move(queue, least, at, common, False)
                end = int(at[-1])
        for p in space.chunks(bounds[k + 1] - bounds[k]):
            at, common = (x[bounds[k] + p.start : bounds[k] + p.stop] for x in (seeds, seed_common))
            if not p.start:
                common = common.copy()
                common[0] = _compare(text, np.array([end]), at[:1], cap, space)[0] if end >= 0 else 0
            move(queue, least, np.asarray(at), np.asarray(common), False)

    queue, least = PriorityQueue(space), _Least(cap)
    for symbol in reversed(alphabet):
        end, fresh = -1, True
        while symbol in queue:
            for at, common in queue.take(symbol):
                common = common.copy()
                if fresh:
                    common[0], fresh = 0, False
                yield at, common
                move(queue, least, at, common, True)
                end = int(at[-1])
        # the L suffixes, turned round: each one's value is the one its greater neighbour had
        carry = 0
        for j, (at, common) in enumerate(kept.take(symbol, back=True)):
            at, own = at[::-1], common[::-1]
            turned = np.empty_like(own)
            turned[1:] = own[:-1]
            turned[0] = (_compare(text, np.array([end]), at[:1], cap, space)[0] if end >= 0 else 0) if j == 0 else carry
            carry = int(own[-1])
            yield at, turned
            move(queue, least, at, turned, True)


def _ranges(text: np.ndarray, top: int, space: Space) -> np.ndarray:
    """The first name of each range, and one past the last; ranges hold about ``batch`` suffixes at most,
    or one name only."""
    shift = max(0, top.bit_length() - 16)

    def counts(shift: int, lo: int, hi: int) -> np.ndarray:
        out = np.zeros(((hi - 1 - lo) >> shift) + 1, np.int64)
        for p in space.chunks(len(text)):
            x = np.asarray(text[p])
            if hi - lo <= top:
                x = x[(x >= lo) & (x < hi)]
            out += np.bincount((x - lo) >> shift, minlength=len(out))
        return out

    bounds, held = [0], 0

    def add(first: int, size: int) -> None:
        nonlocal held
        if held and held + size > space.batch:
            bounds.append(first)
            held = 0
        held += size

    for k, size in enumerate(counts(shift, 0, top + 1).tolist()):
        lo, hi = k << shift, min(top + 1, (k + 1) << shift)
        if size > space.batch and hi - lo > 1:  # look into it name by name
            for j, one in enumerate(counts(0, lo, hi).tolist()):
                add(lo + j, one)
        else:
            add(lo, size)
    return np.array([*bounds, top + 1])


def _settle(first: np.ndarray, last: np.ndarray, text: np.ndarray, types: np.ndarray, s_type: bool, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a range of names in the order of a pass, and which of them are of the induced type.

    ``first``: those induced from outside the range, in the order of arrival; ``last``: suffixes of the
    other type that are given in order; each of them induces its left neighbour if of the type, and so
    on. Within a name the first come before those induced from inside, and those before the last.
    """
    sign = -1 if s_type else 1
    parts, sources = [first, last], np.concatenate([first, last])
    at, base = np.arange(len(sources)), len(sources)
    links = [at]
    while True:
        before = sources - 1
        go = np.flatnonzero((before >= 0) & (types[before] == s_type))
        name = text[before[go]]
        go = go[(name >= lo) & (name < hi)]
        if not len(go):
            break
        links.append(at[go])
        sources = before[go]
        at = np.arange(base, base + len(go))
        base += len(go)
        parts.append(sources)
    every, source = np.concatenate(parts), np.concatenate(links)
    inner = len(first) + len(last)
    group = np.ones(base, np.int64)
    group[: len(first)], group[len(first) : inner] = 0, 2
    key = sign * text[every].astype(np.int64) * 4 + group
    order = np.argsort(key, kind="stable")
    if base > inner:
        # ranks with ties only among those induced from inside; ties go by their sources' ranks
        held = key[order]
        new = np.ones(base, bool)
        new[1:] = (held[1:] != held[:-1]) | (group[order[1:]] != 1)
        rank = np.empty(base, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(base), 0))
        while True:
            held = rank[order]
            tied = np.zeros(base, bool)
            tied[1:] = held[1:] == held[:-1]
            tied[:-1] |= tied[1:]
            places = np.flatnonzero(tied)
            if not len(places):
                break
            open_ = order[places]
            by = np.lexsort((rank[source[open_]], rank[open_]))
            order[places] = open_ = open_[by]
            mine, theirs = rank[open_], rank[source[open_]]
            new = np.ones(len(open_), bool)
            new[1:] = (mine[1:] != mine[:-1]) | (theirs[1:] != theirs[:-1])
            rank[open_] = np.maximum.accumulate(np.where(new, places, 0))
            source = source[source]
    return every[order], group[order] < 2


def _induce_names(text: np.ndarray, types: np.ndarray, seeds: np.ndarray, top: int, space: Space) -> np.ndarray:
    """All suffixes of a string of names in rising order; ``seeds`` are its S* suffixes in that order."""
    n = len(text)
    kind = seeds.dtype
    bounds = _ranges(text, top, space)
    kept = PriorityQueue(space)

    def move(queue: PriorityQueue, at: np.ndarray, s_type: bool, lo: int, hi: int) -> None:
        """Hands on what suffixes induce outside the range."""
        before = at - 1
        before = before[(before >= 0) & (types[before] == s_type)]
        name = text[before]
        away = (name < lo) | (name >= hi)
        before, name = before[away], name[away]
        to = np.searchsorted(bounds, name, "right") - 1
        if len(bounds) < 1 << 16:
            to = to.astype(np.uint16)
        by = np.argsort(to, kind="stable")
        to, before = to[by], before[by]
        cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1])).tolist() + [len(to)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                queue.push(int(to[a]), before[a:b])

    def waves(queue: PriorityQueue, r: int, s_type: bool) -> Iterator[np.ndarray]:
        """The queue's suffixes of a range of one name, which induce suffixes of the same name in turn."""
        while r in queue:
            for (at,) in queue.take(r):
                yield at
                before = at - 1
                same = before[(before >= 0) & (types[before] == s_type)]
                same = same[text[same] == bounds[r]]
                if len(same):
                    queue.push(r, same)

    def all_of(parts: Iterator[tuple[np.ndarray, ...]]) -> np.ndarray:
        found = [p[0] for p in parts]
        return np.concatenate(found) if found else np.zeros(0, kind)

    queue, start = PriorityQueue(space), 0
    move(queue, np.array([n], kind), False, -1, -1)
    for r, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        stop = bisect_left(seeds, hi, lo=start, key=lambda p: text[p])
        if hi - lo == 1:
            for at in waves(queue, r, False):
                kept.push(r, at)
                move(queue, at, False, lo, hi)
            for p in space.chunks(stop - start):
                move(queue, np.asarray(seeds[start + p.start : start + p.stop]), False, lo, hi)
        else:
            order, own = _settle(all_of(queue.take(r)), np.asarray(seeds[start:stop]), text, types, False, lo, hi)
            if own.any():
                kept.push(r, order[own])
            move(queue, order, False, lo, hi)
        start = stop

    out, end = space.array(n, kind), n

    def emit(at: np.ndarray) -> None:
        nonlocal end
        out[end - len(at) : end] = at[::-1]
        end -= len(at)

    queue = PriorityQueue(space)
    for r in range(len(bounds) - 2, -1, -1):
        lo, hi = int(bounds[r]), int(bounds[r + 1])
        if hi - lo == 1:
            for at in waves(queue, r, True):
                emit(at)
                move(queue, at, True, lo, hi)
            for (at,) in kept.take(r, back=True):
                emit(at[::-1])
                move(queue, at[::-1], True, lo, hi)
        else:
            order, _ = _settle(all_of(queue.take(r)), all_of(kept.take(r))[::-1], text, types, True, lo, hi)
            emit(order)
            move(queue, order, True, lo, hi)
    return out


def _star_order(text: np.ndarray, types: np.ndarray, top: int, space: Space) -> np.ndarray:
    """The S* suffixes (without the empty one) in rising order."""
    kind = np.int32 if len(text) < 1 << 31 else np.int64
    starts = _starts(types, space, kind)
    if len(starts) < 2:
        return starts
    names, kinds = _name_pieces(text, types, starts, top, space)
    out = space.array(len(starts), kind)
    if kinds == len(starts):
        for p in space.chunks(len(starts)):
            out[names[p]] = starts[p]
        return out
    space.seen["levels"] += 1
    below = _types(names, space)
    order = _induce_names(names, below, _star_order(names, below, kinds - 1, space), kinds - 1, space)
    for p in space.chunks(len(starts)):
        out[p] = starts[order[p]]
    return out


def falling(text: np.ndarray, space: Space, cap: int = CAP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of ``text`` (non-negative integers of few values) in falling order, with common prefixes up
    to ``cap``."""
    if not len(text):
        return
    types = _types(text, space)
    alphabet = sorted(set().union(*(np.unique(text[p]).tolist() for p in space.chunks(len(text)))))
    yield from _induce(text, types, _star_order(text, types, alphabet[-1], space), alphabet, space, cap)


def repeated_starts(text: np.ndarray, window: int, space: Space) -> np.ndarray:
    """True where a suffix shares its first ``window`` symbols with another one.

    ``text`` holds symbols from 1, and 0 where strings end, so that no window with a 0 counts if strings
    are told apart by the caller's choice of starts.
    """
    if window > CAP:
        raise ValueError(f"windows of up to {CAP}")
    out = space.array(len(text), np.bool_)
    end = -1
    for at, common in falling(text, space):
        same = common >= window
        out[at[same]] = True
        before = np.append(end, at[:-1])
        out[before[same]] = True
        end = int(at[-1])
    return out
