"""Independent numbers from one 64-bit index: SplitMix64, vectorised over indexes."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Fixed values of SplitMix64.
GAMMA = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB
TOP = (1 << 64) - 1


class IndexStream:
    """One generator per index; ``draw`` takes the next number of each."""

    def __init__(self, indexes: np.ndarray | Iterable[int]):
        self.state = np.array(indexes, np.uint64, copy=True)

    @classmethod
    def from_hex(cls, hex16: Iterable[str]) -> IndexStream:
        return cls(np.frombuffer(bytes.fromhex("".join(hex16)), ">u8"))

    def _next(self, which: np.ndarray | slice) -> np.ndarray:
        with np.errstate(over="ignore"):
            self.state[which] += np.uint64(GAMMA)
            z = self.state[which]
            z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
            return z ^ (z >> np.uint64(31))

    def draw(self, bound: int) -> np.ndarray:
        """Numbers below ``bound``, without bias: values of the incomplete last stretch are drawn anew."""
        if bound <= 0:
            raise ValueError("empty range")
        limit = np.uint64(TOP - TOP % bound)
        out = self._next(slice(None))
        again = np.flatnonzero(out >= limit)
        while len(again):
            out[again] = self._next(again)
            again = again[out[again] >= limit]
        return (out % np.uint64(bound)).astype(np.int64)

    def pick(self, values: np.ndarray) -> np.ndarray:
        return values[self.draw(len(values))]

    def digits(self, count: int) -> np.ndarray:
        """Rows of single digits."""
        return np.stack([self.draw(10) for _ in range(count)], axis=1)
