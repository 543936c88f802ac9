"""128-bit Murmur3 and the array shard, vectorised over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_U = np.uint64
_C1, _C2 = _U(0x87C37B91114253D5), _U(0x4CF5AD432745937F)


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << _U(by)) | (x >> _U(64 - by))


def _final(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


#: Values and padded bytes that are mixed at once.
_ROWS, _BYTES = 4096, 1 << 24


def _groups(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of ascending lengths: no more than ``_BYTES`` together, and none over four times as long as the first."""
    first = 0
    for i, n in enumerate(lengths):
        if i - first >= _ROWS or i > first and ((i - first + 1) * (n + 16) > _BYTES or n > 4 * lengths[first] + 256):
            yield first, i
            first = i
    if lengths:
        yield first, len(lengths)


def murmur3_128(values: list[bytes]) -> np.ndarray:
    """n x 16 bytes, seed 0. Values are taken by length, so that all blocks of one step are mixed at once."""
    out = np.zeros((len(values), 2), _U)
    order = sorted(range(len(values)), key=lambda i: len(values[i]))
    for first, last in _groups([len(values[i]) for i in order]):
        rows = order[first:last]
        length = np.array([len(values[i]) for i in rows])
        width = (int(length[-1]) // 16 + 1) * 16
        words = np.frombuffer(b"".join(values[i].ljust(width, b"\0") for i in rows), "<u8").reshape(len(rows), -1, 2)
        h1, h2 = np.zeros(len(rows), _U), np.zeros(len(rows), _U)
        blocks = length // 16
        starts = np.searchsorted(blocks, np.arange(blocks[-1]), "right")
        for k, at in enumerate(starts.tolist()):  # the longer ones are last
            a = _rotate(words[at:, k, 0] * _C1, 31) * _C2
            b = _rotate(words[at:, k, 1] * _C2, 33) * _C1
            x = (_rotate(h1[at:] ^ a, 27) + h2[at:]) * _U(5) + _U(0x52DCE729)
            y = (_rotate(h2[at:] ^ b, 31) + x) * _U(5) + _U(0x38495AB5)
            h1[at:], h2[at:] = x, y
        tail = words[np.arange(len(rows)), blocks]
        h2 ^= _rotate(tail[:, 1] * _C2, 33) * _C1
        h1 ^= _rotate(tail[:, 0] * _C1, 31) * _C2
        size = length.astype(_U)
        h1, h2 = h1 ^ size, h2 ^ size
        h1 = h1 + h2
        h2 = h2 + h1
        h1, h2 = _final(h1), _final(h2)
        h1 = h1 + h2
        h2 = h2 + h1
        out[rows] = np.stack([h1, h2], axis=1)
    return out.view(np.uint8).reshape(-1, 16)


def hash_text(value: str | bytes | None, salt: str | None = None) -> str:
    """Hex of the hash of salt and value; null and empty together are 32 zeros."""
    raw = (salt or "").encode() + (value if isinstance(value, bytes) else (value or "").encode())
    return murmur3_128([raw])[0].tobytes().hex() if raw else "0" * 32


def hash_texts(values: list[str], salt: str = "") -> list[str]:
    """``hash_text`` of many."""
    raw = [(salt + v).encode() for v in values]
    out = murmur3_128(raw).tobytes().hex()
    return [out[32 * i : 32 * i + 32] if r else "0" * 32 for i, r in enumerate(raw)]


@F.pandas_udf(StringType())
def _hash(values: pd.Series) -> pd.Series:
    raw = [v if isinstance(v, bytes) else (v or "").encode() for v in values]
    hashed = murmur3_128(raw)
    return pd.Series([hashed[i].tobytes().hex() if raw[i] else "0" * 32 for i in range(len(raw))])


@F.pandas_udf(StringType())
def hashed_bytes(values: pd.Series) -> pd.Series:
    """Of binary values; null and empty ones are 32 zeros."""
    raw = [bytes(v) if v is not None else b"" for v in values]
    out = murmur3_128(raw)
    return pd.Series([out[i].tobytes().hex() if raw[i] else "0" * 32 for i in range(len(raw))], dtype=object)


def hashed(value: Column, salt: str | None = None) -> Column:
    return _hash(F.concat(F.lit(salt), F.coalesce(value.cast("string"), F.lit(""))) if salt else value)


def shard_of(key: str) -> str:
    """ARR and two digits: a polynomial hash of the UTF-16 units, wrapping at 64 bits."""
    h = 1125899906842597
    units = np.frombuffer(key.encode("utf-16-le"), "<u2").tolist()
    for u in units:
        h = (31 * h + u) & 0xFFFFFFFFFFFFFFFF
    h = h - (1 << 64) if h >> 63 else h
    return f"ARR{abs(h) % 100:02d}"


_SHARDS = np.array([f"ARR{i:02d}" for i in range(100)], dtype=object)
#: Units from which on a key's shard is made by itself.
_LONG = 256


def shards_of(keys: list[str]) -> np.ndarray:
    """``shard_of`` of many: one step for each place of the keys."""
    raw = [k.encode("utf-16-le") for k in keys]
    length = np.array([len(r) // 2 for r in raw], np.int64)
    order = np.argsort(length, kind="stable")
    length = length[order]
    units = np.frombuffer(b"".join(raw), "<u2")
    first = (np.cumsum([0, *(len(r) // 2 for r in raw)])[:-1])[order]
    h = np.full(len(keys), 1125899906842597, _U)
    short = int(np.searchsorted(length, _LONG))
    for k in range(int(length[short - 1]) if short else 0):
        at = int(np.searchsorted(length, k, "right"))  # the longer ones are last
        h[at:short] = h[at:short] * _U(31) + units[first[at:short] + k]
    out = np.empty(len(keys), dtype=object)
    out[order] = _SHARDS[(np.where(h >> _U(63), ~h + _U(1), h) % _U(100)).astype(np.int64)]
    for i in order[short:]:
        out[i] = shard_of(keys[i])
    return out


@F.pandas_udf(StringType())
def array_shard(keys: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(keys), dtype=object)
    there = keys.notna().to_numpy()
    out[there] = shards_of(keys[there].tolist())
    return out
