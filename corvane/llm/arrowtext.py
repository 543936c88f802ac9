"""Vectorised text primitives over Arrow string buffers.

Everything here works on the contiguous UTF-8 bytes of a whole batch, so the cost
per byte is a few numpy passes and no Python object is made per word.

Nulls count as empty texts. A batch is cut by bytes (``pieces``); one text longer
than the limit is a piece of its own, so texts of any length are processed whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE_BYTES = 2 << 20
HASH_BYTES = 1 << 18


def arrow_batches(spark, records: int = 2000) -> None:
    """Bound the rows of one Arrow batch, as texts are long and workers are small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes of text, without copying."""
    _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_P = U64(0x9E3779B97F4A7C15)
_PINV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_P, _PINV)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


class Rolling:
    """Hash of any range of a sequence in constant time, from prefix sums."""

    def __init__(self, values: np.ndarray):
        up, self._down = _pow(len(values) + 1)
        self._sum = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self._sum[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._down[start] + (end - start).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Lower case of the code points of two bytes, where it has two bytes as well.
_LOWER = np.array([ord(low) if len(low := chr(c).lower()) == 1 and 128 <= ord(low) < 2048 else c for c in range(2048)], np.uint16)

#: Scripts without spaces between words: each of their characters is a word.
SINGLES = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x3100, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
SPACES = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
LETTER, SINGLE, SOLID, UPPER, LOWER = 1, 2, 4, 8, 16
_kinds: np.ndarray | None = None


def kinds() -> np.ndarray:
    """LETTER (letters, marks, digits), SINGLE, SOLID (no white space), UPPER and LOWER of each code point; made once a process."""
    global _kinds
    if _kinds is None:
        out = np.full(0x110000, LETTER, np.uint8)
        # from 0x20000 on there are letters, and tags
        some = [*range(0x20000), *range(0xE0000, 0xE0200)]
        out[some] = [LETTER * (unicodedata.category(chr(c)) in _LETTERS) for c in some]
        # joiners stand inside words
        out[[0x200C, 0x200D]] = LETTER
        out[:128] = 0
        out[[*range(48, 58), *range(65, 91), *range(97, 123)]] = LETTER
        out |= SOLID
        for c in range(0x20000):
            if (kind := unicodedata.category(chr(c))) in ("Lu", "Lt", "Ll"):
                out[c] |= LOWER if kind == "Ll" else UPPER
        for low, high in SINGLES:
            out[low : high + 1] |= SINGLE
        for low, high in SPACES:
            out[low : high + 1] = 0
        _kinds = out
    return _kinds


_LETTERS = frozenset("Lu Ll Lt Lm Lo Mn Mc Me Nd Nl No Cn Co".split())
_ASCII = np.zeros(256, np.uint8)
_ASCII[:128] = SOLID
_ASCII[[*range(9, 14), 32]] = 0
_ASCII[[*range(48, 58), *range(65, 91), *range(97, 123)]] = LETTER | SOLID


def points(data: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, their numbers of bytes) of the UTF-8 sequences that begin at ``lead``, bytes from 192 on."""
    first = data[lead].astype(np.int32)
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    last = len(data) - 1
    two, three, four = (data[np.minimum(lead + i, last)].astype(np.int32) & 0x3F for i in (1, 2, 3))
    out = np.where(size == 2, (first & 0x1F) << 6 | two, np.where(size == 3, (first & 0x0F) << 12 | two << 6 | three, (first & 0x07) << 18 | two << 12 | three << 6 | four))
    return np.minimum(out, 0x10FFFF), size


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of the letters that ASCII and two bytes of UTF-8 hold (Latin, Greek, Cyrillic, Armenian); other bytes stay."""
    out = _FOLD[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] < 0xE0)) if len(data) > 1 else np.zeros(0, np.int64)
    if len(lead):
        point = (data[lead].astype(np.uint16) & np.uint16(0x1F)) << np.uint16(6) | (data[lead + 1] & np.uint8(0x3F))
        low = _LOWER[point]
        changed = np.flatnonzero(low != point)
        out[lead[changed]] = 0xC0 | low[changed] >> 6
        out[lead[changed] + 1] = 0x80 | low[changed] & 0x3F
    return out


class Words:
    """Words of all texts of a piece.

    ``start``/``end`` are byte positions, ``first`` has for each text the number of
    its first word (and the total at the end). Words are runs of letters, marks and digits
    of any script; ``solid``: runs without white space. Of scripts without spaces
    (``SINGLES``) each character is a word, if ``singles``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, solid: bool = False, singles: bool = True):
        n = len(data)
        kind = _ASCII[data]
        begin = np.zeros(n, bool)
        lead = np.flatnonzero(data >= 0xC0)
        want = SOLID if solid else LETTER
        if len(lead):
            point, size = points(data, lead)
            own = kinds()[point]
            for i in range(4):
                some = lead[size > i] + i
                kind[some[some < n]] = own[size > i][some < n]
            single = lead[(own & (SINGLE | want)) == (SINGLE | want)] if singles else lead[:0]
            begin[single] = True
            after = single + size[np.searchsorted(lead, single)]
            begin[after[after < n]] = True
        inside = (kind & want) > 0
        begin[1:] |= ~inside[:-1]
        begin[:1] = True
        begin[offsets[:-1][offsets[:-1] < n]] = True
        begin &= inside
        finish = inside.copy()
        finish[:-1] &= ~inside[1:] | begin[1:]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.start)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """Hash of each word; some bytes at a time, which stay in the cache."""
        out = np.empty(len(self), np.uint64)
        first = 0
        while first < len(self):
            base = self.start[first]
            last = max(first + 1, int(np.searchsorted(self.end, base + HASH_BYTES, "right")))
            out[first:last] = Rolling(_BYTE[data[base : self.end[last - 1]]]).ranges(self.start[first:last] - base, self.end[first:last] - base)
            first = last
        return out


def windows(words: Words, hashes: np.ndarray, size: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each window of ``size`` words inside one text.

    ``short``: a text with fewer words, but at least one, is one window."""
    per_text = np.maximum(words.count - size + 1, 0)
    if short:
        per_text = np.where((words.count > 0) & (per_text == 0), 1, per_text)
    text = np.repeat(np.arange(len(per_text)), per_text)
    within = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    at = words.first[text] + within
    to = np.minimum(at + size, words.first[text + 1]) if short else at + size
    return at, Rolling(hashes).ranges(at, to)


def text_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` for each text; ``first`` as in Words. Exact for integers."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), values.dtype if values.dtype.kind in "iu" else np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
