"""Byte-level BPE encoding and decoding, without a regex and without training.

Pre-tokenisation: every code point gets a class from one array (letter, number, space,
other white space, other). Each class is a transition function on four states; an
associative scan composes them, which gives the state before every character. From
class and state follow the boundaries, for all texts of a piece at once: a token of
letters, numbers or others takes one space before it, the last white space of a run
stands apart from the run if something follows, and 's 'd 'm 't 'll 've 're are split
off where an apostrophe starts a token.

Merging: distinct slices are looked up in a cache by hash; the missing ones are
merged together, row by row of a matrix, always the lowest-ranked leftmost pair of each
slice. Slices beyond a row's width use a heap. Decoding concatenates the byte ranges of
the ids; every encoded text is decoded again and compared, and one that differs (a
collision of 64-bit hashes) is encoded once more without the cache.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.arrowtext import _BYTE, U64, Rolling, arrow_batches, pieces, utf8

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
NONE = np.int32(2**31 - 1)
WIDE = 48
#: Slices that a worker remembers, at about 35 bytes each.
CACHE_SLICES = 1_000_000

OTHER, LETTER, NUMBER, WHITE, SPACE = range(5)
_SPACES = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of each code point; made once a process."""
    global _classes
    if _classes is None:
        kind = {"L": LETTER, "N": NUMBER}
        out = np.full(0x110000, OTHER, np.uint8)
        # beyond there are neither letters nor numbers
        out[:0x40000] = [kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x40000)]
        out[_SPACES] = WHITE
        out[32] = SPACE
        _classes = out
    return _classes


#: States: 0 nothing open, 1 one space waits for a token, 2 in others, 3 in letters or numbers.
FRESH, WAITING, IN_OTHER, IN_WORD = range(4)


def _pack(to: list[int]) -> int:
    return sum(s << (2 * i) for i, s in enumerate(to))


_STEP = np.array([_pack([x] * 4) for x in (IN_OTHER, IN_WORD, IN_WORD, FRESH, WAITING)], np.uint8)
IDENTITY = _pack([0, 1, 2, 3])
_maps = np.array([[(m >> (2 * s)) & 3 for s in range(4)] for m in range(256)], np.uint8)
_CONSTANT = (_maps == _maps[:, :1]).all(axis=1)
#: _THEN[f * 256 + g]: first f, then g.
_THEN = sum((_maps[:, _maps[:, s]].T.astype(np.uint16) << (2 * s)) for s in range(4)).astype(np.uint8).reshape(-1)


def scan(functions: np.ndarray, block: int = 64) -> np.ndarray:
    """Packed composition of functions[0..i] for each i: doubling inside blocks, then
    the totals of the blocks in the same way."""
    n = len(functions)
    if n == 0 or _CONSTANT[functions].all():  # what comes before a constant function doesn't matter
        return functions
    out = np.full(-(-n // block) * block, IDENTITY, np.uint8)
    out[:n] = functions
    rows = out.reshape(-1, block)
    step = 1
    while step < block:
        rows[:, step:] = _THEN[(rows[:, :-step].astype(np.uint16) << np.uint16(8)) | rows[:, step:]]
        step *= 2
    if len(rows) > 1:
        before = scan(rows[:-1, -1].copy(), block)
        rows[1:] = _THEN[(before.astype(np.uint16)[:, None] << np.uint16(8)) | rows[1:]]
    return out[:n]


def slices(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which the slices of all texts start."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    try:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:  # not text: bytes from 128 on are others
        at, points = np.arange(n), np.where(data < 128, data, 0x2022).astype(np.uint32)
    kind = classes()[points]
    m = len(kind)
    opens = np.zeros(m + 1, bool)
    opens[np.searchsorted(at, offsets)] = True
    opens[m] = True
    first = opens[:-1]
    functions = _STEP[kind]
    # a text's first character resets the state: its function follows a constant one
    state = np.zeros(m, np.uint8)
    state[1:] = scan(functions)[:-1] & 3
    state[first] = FRESH
    before = np.full(m, 255, np.uint8)
    before[1:] = kind[:-1]
    before[first] = 255
    white = kind >= WHITE
    white_after = np.zeros(m, bool)
    white_after[:-1] = white[1:]
    last = ~opens[1:] & ~white_after
    start = np.where(white, last | (before < WHITE) | first, (before != kind) & (state != WAITING))
    # contractions
    quote = np.flatnonzero((points == 39) & ((state == FRESH) | (state == IN_WORD)))
    if len(quote):
        end_of = np.flatnonzero(opens)
        left = end_of[np.searchsorted(end_of, quote, "right")] - quote
        one = points[np.minimum(quote + 1, m - 1)]
        two = points[np.minimum(quote + 2, m - 1)]
        short = (left > 1) & np.isin(one, [115, 100, 109, 116])
        long = (left > 2) & (((one == 108) & (two == 108)) | (((one == 118) | (one == 114)) & (two == 101)))
        size = np.where(short, 2, np.where(long, 3, 0))
        for k in (1, 2):
            inner = quote[size > k] + k
            start[inner] = False
        end = (quote + size)[size > 0]
        start[end[end < m]] = True
    start |= first
    return at[start]


class Vocabulary:
    """Byte-level merges by rank, as arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        #: Tells apart vocabularies that have one name.
        self.digest = hashlib.sha256(b"".join(b"%d %b\n" % (r, t.hex().encode()) for t, r in sorted(ranks.items()))).hexdigest()
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        table = np.array(pairs, np.int64).reshape(-1, 3)
        key = (table[:, 0] << 32) | table[:, 1]
        self.bits = max(10, int(len(key) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        self.probes, slot, rest = 0, self._slot(key), np.arange(len(key))
        while len(rest):  # linear probing, all keys at a time
            self.probes += 1
            free = self.keys[slot[rest]] == -1
            _, winner = np.unique(slot[rest[free]], return_index=True)
            won = rest[free][winner]
            self.keys[slot[won]], self.values[slot[won]] = key[won], table[won, 2]
            rest = np.setdiff1d(rest, won)
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)

    @classmethod
    def load(cls, path: str = DEFAULT_VOCABULARY) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())})

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or NONE; a negative id has no pair."""
        key = (a.astype(np.int64) << 32) | (b.astype(np.int64) & 0xFFFFFFFF)
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NONE)
        open_ = np.flatnonzero((found != key) & (found != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Lowest rank first, leftmost among equals, with a heap."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        first = self.rank(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist() if n > 1 else []
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}

        def push(i: int) -> None:
            j = after[i]
            if j < n:
                pair = (ids[i], ids[j])
                if pair not in known:
                    known[pair] = int(self.rank(np.array([pair[0]], np.int32), np.array([pair[1]], np.int32))[0])
                if known[pair] != NONE:
                    heapq.heappush(heap, (known[pair], i, *pair))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            if not alive[i] or ids[i] != a or after[i] >= n or ids[after[i]] != b:
                continue
            j = after[i]
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([t for t, live in zip(ids, alive) if live], np.int32)

    def merge_rows(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count) of slices that are rows padded with -1."""
        n, width = tokens.shape
        done, counts = np.full((n, width), -1, np.int32), np.zeros(n, np.int64)
        rows = np.arange(n)
        rank = np.full((n, width), NONE, np.int32)
        rank[:, :-1] = self.rank(tokens[:, :-1].reshape(-1), tokens[:, 1:].reshape(-1)).reshape(n, width - 1)
        rank[:, :-1][tokens[:, 1:] < 0] = NONE
        places = np.arange(width)
        while len(rows):
            best = rank.argmin(axis=1)
            low = rank[np.arange(len(rows)), best]
            over = low == NONE
            if over.any():
                done[rows[over]], counts[rows[over]] = tokens[over], (tokens[over] >= 0).sum(axis=1)
                live = ~over
                rows, tokens, rank, best, low = rows[live], tokens[live], rank[live], best[live], low[live]
                if not len(rows):
                    break
            at = np.arange(len(rows))
            tokens[at, best] = low
            source = np.minimum(places + (places > best[:, None]), width - 1)
            tokens = np.take_along_axis(tokens, source, axis=1)
            tokens[:, -1] = -1
            rank = np.take_along_axis(rank, np.minimum(places + (places >= best[:, None]), width - 1), axis=1)
            rank[:, -1] = NONE
            for shift in (-1, 0):
                i = best + shift
                some = np.flatnonzero((i >= 0) & (i + 1 < width))
                a, b = tokens[some, i[some]], tokens[some, i[some] + 1]
                rank[some, i[some]] = np.where(b >= 0, self.rank(a, b), NONE)
        return done, counts

    def merge(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, count of each) of the given slices."""
        counts = np.zeros(len(start), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        low = 0
        for width in (4, 8, 12, 16, 24, WIDE):
            some = np.flatnonzero((length > low) & (length <= width))
            low = width
            for k in range(0, len(some), 1 << 15):
                rows = some[k : k + (1 << 15)]
                place = start[rows][:, None] + np.arange(width)
                inside = np.arange(width) < length[rows][:, None]
                tokens = np.where(inside, self.byte[data[np.minimum(place, len(data) - 1)]], np.int32(-1))
                ids, counts[rows] = self.merge_rows(tokens)
                parts.append((rows, ids[np.arange(width) < counts[rows][:, None]]))
        for row in np.flatnonzero(length > WIDE):
            ids = self.merge_long(data[start[row] : start[row] + length[row]].tobytes())
            counts[row] = len(ids)
            parts.append((np.array([row]), ids))
        out = np.zeros(int(counts.sum()), np.int32)
        begin = np.cumsum(counts) - counts
        for rows, ids in parts:
            out[spread(begin[rows], counts[rows])] = ids
        return out, counts

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids stand for, one after the other."""
        return self.bytes[spread(self.begin[ids], self.length[ids])]


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... count[0] of them, then those of begin[1], ..."""
    ends = np.cumsum(count)
    return np.repeat(begin - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    """A vocabulary with a cache of merged slices, which starts anew when it is full."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._empty()

    def _empty(self) -> None:
        self.known, self.begin, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.int32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each text and the total)."""
        start = slices(data, offsets)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        end = np.append(start[1:], len(data))
        key = Rolling(_BYTE[data]).ranges(start, end)
        order = np.argsort(key)
        ordered = key[order]
        new_key = np.ones(len(key), bool)
        new_key[1:] = ordered[1:] != ordered[:-1]
        sample = order[new_key]
        which = np.empty(len(key), np.int64)
        which[order] = np.cumsum(new_key) - 1
        distinct = ordered[new_key]
        if len(self.known) > CACHE_SLICES or len(self.pool) > 16 * CACHE_SLICES:
            self._empty()
        at = np.searchsorted(self.known, distinct)
        missing = np.ones(len(distinct), bool) if not len(self.known) else self.known[np.minimum(at, len(self.known) - 1)] != distinct
        if missing.any():
            ids, counts = self.vocabulary.merge(data, start[sample[missing]], (end - start)[sample[missing]])
            begin = len(self.pool) + np.cumsum(counts) - counts
            self.pool = np.concatenate([self.pool, ids])
            self.known, self.begin, self.count = (np.insert(x, at[missing], y) for x, y in ((self.known, distinct[missing]), (self.begin, begin), (self.count, counts.astype(np.int32))))
            at = np.searchsorted(self.known, distinct)
        count = self.count[at][which].astype(np.int64)
        ids = self.pool[spread(self.begin[at][which], count)]
        first = np.append(0, np.cumsum(count))[np.searchsorted(start, offsets)]
        return ids, first

    def ends(self, ids: np.ndarray, first: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte end of each id in its text."""
        ends = np.cumsum(self.vocabulary.length[ids])
        return (ends - np.repeat(offsets[:-1], np.diff(first))).astype(np.int32)

    def encode_checked(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``encode``, and whether decoding gives each text again."""
        ids, first = self.encode(data, offsets)
        same = self._same(ids, first, data, offsets)
        if not same.all():  # a collision in the cache
            self._empty()
            parts = []
            for i in range(len(offsets) - 1):
                own = data[offsets[i] : offsets[i + 1]]
                start = slices(own, np.array([0, len(own)]))
                parts.append(self.vocabulary.merge(own, start, np.diff(np.append(start, len(own))))[0])
            ids, first = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
            same = self._same(ids, first, data, offsets)
        return ids, first, same

    def _same(self, ids: np.ndarray, first: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        back = self.vocabulary.decode(ids)
        sizes = np.append(0, np.cumsum(self.vocabulary.length[ids]))[first]
        if len(back) == len(data) and (sizes == offsets).all():
            wrong = np.flatnonzero(back != data)
            bad = np.searchsorted(offsets, wrong, "right") - 1
            same = np.ones(len(offsets) - 1, bool)
            same[bad] = False
            return same
        return np.array([np.array_equal(back[sizes[i] : sizes[i + 1]], data[offsets[i] : offsets[i + 1]]) for i in range(len(offsets) - 1)])


_encoders: dict[str, Encoder] = {}


def shared_encoder(words: Vocabulary) -> Encoder:
    """One encoder a worker process and vocabulary, so that its cache outlives a task."""
    if words.digest not in _encoders:
        _encoders.clear()
        _encoders[words.digest] = Encoder(words)
    return _encoders[words.digest]


def encode(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, ends: bool = True) -> DataFrame:
    """(doc_id, n_tokens, token_ids, token_ends, round_trip), one row for each row of docs.

    token_ends are the byte offsets at which the tokens end in the UTF-8 text, left out without ``ends``;
    round_trip says that decoding the ids gave the text again. A null text has null
    lists, 0 tokens and round_trip true; an empty text has empty lists. Repeated rows
    are encoded each; null ids stay null; other columns are not looked at."""
    arrow_batches(docs.sparkSession)
    words = Vocabulary.load(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(words)
        for batch in batches:
            for piece in pieces(batch):
                text = piece.column(1)
                data, offsets = utf8(text)
                ids, first, same = encoder.encode_checked(data, offsets)
                null = text.is_null()
                bounds = pa.array(first.astype(np.int32), mask=np.append(null.to_numpy(zero_copy_only=False), False))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in ([ids, encoder.ends(ids, first, offsets)] if ends else [ids])]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(first).astype(np.int32)), *lists, pa.array(same)], ["doc_id", "n_tokens", "token_ids", *["token_ends"] * ends, "round_trip"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, f"doc_id long, n_tokens int, token_ids array<int>, {'token_ends array<int>, ' * ends}round_trip boolean")


def decode(tokens: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, token_ids). A null list gives a null text, null ids
    inside a list are left out, and an id that the vocabulary lacks raises an error."""
    words = Vocabulary.load(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            counts = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
            value = flat.fill_null(-1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(counts)), counts)[value >= 0]
            value = value[value >= 0]
            if len(value) and value.max() >= len(words.length):
                raise ValueError(f"token id {value.max()} is not in the vocabulary")
            size = np.bincount(row, weights=words.length[value], minlength=len(counts)).astype(np.int64)
            ends = np.append(0, np.cumsum(size)).astype(np.int32)
            text = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(words.decode(value).tobytes())])
            text = pa.compute.if_else(lists.is_null(), pa.scalar(None, pa.binary()), text).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), F.col("token_ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")
