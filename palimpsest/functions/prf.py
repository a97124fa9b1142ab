"""Keyed pseudo-random function: HMAC-SHA256 as a Column expression.

The key never stands in a plan: its two padded blocks travel in a one-row frame, joined by broadcast, so
plans and event logs show attribute names only.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64
SHORTEST = 32


class Secret:
    """A run's secret: at least 32 bytes; unusable once closed."""

    def __init__(self, key: bytes):
        if len(key) < SHORTEST:
            raise ValueError(f"a secret has at least {SHORTEST} bytes")
        self._key: bytes | None = bytes(key)

    @classmethod
    def from_file(cls, path: str) -> Secret:
        with open(path, "rb") as f:
            return cls(f.read())

    @property
    def key(self) -> bytes:
        if self._key is None:
            raise RuntimeError("the secret has been closed")
        return self._key

    def close(self) -> None:
        self._key = None

    def __repr__(self) -> str:
        return "Secret(...)"

    def index(self, value: str, label: str = "") -> int:
        """The index of one key, on the driver."""
        return int.from_bytes(hmac.new(self.key, encode_key(value, label), hashlib.sha256).digest()[:8], "big")

    def fingerprint(self, value: str) -> str:
        return hmac.new(self.key, value.encode(), hashlib.sha256).hexdigest()

    def keyed(self, df: DataFrame) -> DataFrame:
        """``df`` with the columns ``__ipad`` and ``__opad`` that ``index_hex`` and ``fingerprint`` need."""
        key = self.key if len(self.key) <= BLOCK else hashlib.sha256(self.key).digest()
        key = key.ljust(BLOCK, b"\0")
        pads = [(bytearray(b ^ 0x36 for b in key), bytearray(b ^ 0x5C for b in key))]
        return df.crossJoin(F.broadcast(df.sparkSession.createDataFrame(pads, "__ipad binary, __opad binary")))


def encode_key(value: str, label: str = "") -> bytes:
    """Unambiguous bytes of (value, label): both lengths first."""
    v, x = value.encode(), label.encode()
    return len(v).to_bytes(4, "big") + len(x).to_bytes(4, "big") + v + x


def key_bytes(value: Column, label: Column | None = None) -> Column:
    """``encode_key`` as an expression."""
    label = F.lit("") if label is None else label

    def size(c: Column) -> Column:
        return F.unhex(F.lpad(F.hex(F.octet_length(c)), 8, "0"))

    return F.concat(size(value), size(label), value.cast("binary"), label.cast("binary"))


def _hmac(message: Column) -> Column:
    inner = F.unhex(F.sha2(F.concat(F.col("__ipad"), message), 256))
    return F.sha2(F.concat(F.col("__opad"), inner), 256)


def index_hex(value: Column, label: Column | None = None) -> Column:
    """The index of a key as 16 hex digits (Spark has no unsigned 64-bit type)."""
    return F.substring(_hmac(key_bytes(value, label)), 1, 16)


def index_decimal(hex16: Column) -> Column:
    return F.conv(hex16, 16, 10).cast("decimal(20,0)")


def fingerprint(value: Column) -> Column:
    """Digest of the bare canonical value, by which approved exceptions are listed."""
    return _hmac(value.cast("binary"))
