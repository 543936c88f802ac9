"""Benchmark decontamination by templates.

Words of documents and benchmark items are put into a canonical form: numbers (digits or
spelled out), names (capitalised words) and units become typed slots, other words their
folded form; the words of one number or name are one slot. Windows of ``WINDOW``
canonical words are hash-joined; a window that matches is a leak only if its slots are
consistent: the same value of the item always stands for the same value of the document,
within the window, and the other way round. So a question with other numbers and names is
caught, and prose that merely has the same mould is not.

A capitalised word that begins a sentence may be a name or not, so a text has two
templates, one for either reading, and each of a document meets each of an item. A third
reading has no slots at all: it finds what is copied word by word, whatever its words are
taken for, and is what windows of fewer than ``PLAIN`` words outside slots are found by,
as their template would match anything.

Items of fewer words than a window, but at least ``LEAST``, are one window of their own
length. Shorter ones, of ``SHORT`` words at least, have to be the same with their signs. Of one
or two words nothing can be said: such items are not looked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.arrowtext import _BYTE, LOWER, U64, UPPER, Rolling, Words, arrow_batches, fold, kinds, mix, pieces, points, utf8
from corvane.llm.spread import cut, fresh_names
from corvane.llm.suffixes import text_hashes

WINDOW = 13
LEAST = 5
SHORT = 3
PLAIN = 4
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml cl l s sec secs ms min mins h hr hrs day days week weeks month months year years "
    "second seconds minute minutes hour hours meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters mile miles "
    "foot feet inch inches yard yards gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon gallons "
    "dollar dollars cent cents euro euros usd eur gbp percent degree degrees watt watts kw kwh volt volts mph kmh hz khz mhz ghz"
).split()
#: Spelled-out numbers and what they are.
NUMBERS = dict(zip("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split(), [*range(21), *range(30, 100, 10), 100, 1000, 10**6, 10**9, 12]))
#: Words of the benchmark up to which its windows are sent to every task (at most about 300 bytes a word); beyond, windows are shuffled.
BROADCAST_WORDS = 200_000
#: Bits of the filter that is sent to every task then.
FILTER_BITS = 27

NUMBER, NAME, UNIT = U64(0x1111), U64(0x2222), U64(0x3333)
EXACT, SIGNS = U64(0x4444), U64(0x5555)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[*b".!?:;\n\r\"|"]] = True
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_CASE = np.zeros(256, np.uint8)
_CASE[65:91], _CASE[97:123] = UPPER, LOWER


def _hashes(words: list[str]) -> np.ndarray:
    data, offsets = utf8(pa.array([" ".join(words)]))
    return Words(data, offsets).hashes(data)


UNIT_HASHES = np.sort(_hashes(UNITS))
_spelled = _hashes(list(NUMBERS))
NUMBER_HASHES, NUMBER_VALUES = np.sort(_spelled), _hashes([str(v) for v in NUMBERS.values()])[np.argsort(_spelled)]


@dataclass
class Reading:
    """Canonical words of all texts of a piece, in one way to read them."""

    template: np.ndarray
    own: np.ndarray  # hash of the value of each
    slot: np.ndarray
    word: np.ndarray  # number of the first word of each in its text
    first: np.ndarray  # as in Words
    doubt: np.ndarray | None = None  # where it may differ from the reading before
    signs: Rolling | None = None  # of what isn't white space
    span: np.ndarray | None = None  # where each word begins and ends in that

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def _in(sorted_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return sorted_[at] == values, at


def readings(data: np.ndarray, offsets: np.ndarray, signs: bool = False) -> tuple[Words, list[Reading]]:
    """(words, [word by word, first words of sentences plain, first words of sentences names])."""
    words = Words(data, offsets)
    n = len(words)
    if not n:
        none, flags = np.zeros(0, np.uint64), np.zeros(0, bool)
        at = np.zeros(0, np.int64)
        return words, [Reading(none, none, flags, at, words.first, flags, Rolling(none), np.stack([at, at])) for _ in range(3)]
    folded = fold(data)
    own = words.hashes(folded)
    number_of = np.arange(n) - np.repeat(words.first[:-1], words.count)
    exact = Reading(own, own, np.zeros(n, bool), number_of, words.first)
    if signs:
        solid = ~_WHITE[folded]
        place = np.append(0, np.cumsum(solid))
        exact.signs, exact.span = Rolling(_BYTE[folded[solid]]), np.stack([place[words.start], place[words.end]])
    head = np.zeros(n, bool)
    head[words.first[:-1][words.count > 0]] = True
    # case of each character, noted at its first byte
    case = _CASE[data]
    lead = np.flatnonzero(data >= 0xC0)
    width = np.ones(n, np.int64)
    if len(lead):
        point, size = points(data, lead)
        case[lead] = kinds()[point]
        at = np.searchsorted(lead, words.start)
        wide = (at < len(lead)) & (lead[np.minimum(at, len(lead) - 1)] == words.start)
        width[wide] = size[at[wide]]
    second = words.start + width
    more = second < words.end
    after = case[np.minimum(second, len(data) - 1)]
    first_up = (case[words.start] & UPPER) > 0
    lows = np.append(0, np.cumsum((case & LOWER) > 0))
    digits = np.append(0, np.cumsum(_DIGIT[data]))
    digit = digits[words.end] > digits[words.start]
    capitals = first_up & more & ((after & UPPER) > 0) & (lows[words.end] == lows[words.start]) & ~digit
    alone = capitals.copy()
    alone[1:] &= ~capitals[:-1] | head[1:]
    alone[:-1] &= ~capitals[1:] | head[1:]
    spelled, at = _in(NUMBER_HASHES, own)
    # a number with a unit written on to it, as in 5km, is one number
    number = digit | spelled
    value = np.where(spelled, NUMBER_VALUES[at], own)
    name = (first_up & more & ((after & LOWER) > 0) | alone) & ~number
    # what lies between a word and the one before
    stops = np.append(0, np.cumsum(_STOP[data]))
    gap = np.zeros(n, np.int64)
    gap[1:] = words.start[1:] - words.end[:-1]
    sign = np.zeros(n, np.uint8)
    sign[1:] = data[words.end[:-1]]
    begins = head.copy()
    begins[1:] |= stops[words.start[1:]] > stops[words.end[:-1]]
    before = lambda x: np.append(False, x[:-1])
    unit = _in(UNIT_HASHES, own)[0] & before(number) & ~head & ~number & ~name
    one = ~head & (gap == 1)
    same_number = number & before(number) & one & (digit & before(digit) & ((sign == 44) | (sign == 46)) | spelled & before(spelled) & ((sign == 32) | (sign == 45)))
    out = [exact]
    for doubtful in (False, True):
        named = name if doubtful else name & ~begins
        joined = same_number | named & before(named) & one & (sign == 32)
        start = np.flatnonzero(~joined)
        kind = np.where(number, 1, np.where(named, 2, np.where(unit, 3, 0)))[start]
        end = np.append(start[1:], n)
        values, long = value[start], end - start > 1
        if long.any():
            values = values.copy()
            values[long] = Rolling(value).ranges(start[long], end[long])
        template = np.where(kind == 0, own[start], np.array([0, NUMBER, NAME, UNIT], np.uint64)[kind])
        doubt = np.append(0, np.cumsum(name & begins)) if doubtful else None
        out.append(Reading(template, values, kind > 0, number_of[start], np.searchsorted(start, words.first), doubt[end] - doubt[start] > 0 if doubtful else None))
    return words, out


def _windows(r: Reading, size: int, per_text: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first canonical word, hash) of the windows of which each text has ``per_text``. ``which`` reading it is: of the
    second and third windows that are nearly all slots are left out, of the third those that are as in the second."""
    text = np.repeat(np.arange(len(per_text)), per_text)
    at = r.first[text] + np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    salt = U64(size)
    if which:
        plain = np.append(0, np.cumsum(~r.slot))
        some = plain[at + size] - plain[at] >= PLAIN
        if r.doubt is not None:
            doubts = np.append(0, np.cumsum(r.doubt))
            # a name that one of the readings begins earlier makes the words beside it doubtful too
            some &= doubts[at + size] > doubts[at]
        text, at = text[some], at[some]
    else:
        salt += EXACT
    h = Rolling(r.template).ranges(at, at + size)
    if not which and size < LEAST:
        h = mix(h ^ r.signs.ranges(r.span[0][at], r.span[1][at + size - 1])) + SIGNS
    return text, at, mix(h + salt)


def _item_sizes(count: np.ndarray, window: int, which: int) -> np.ndarray:
    """Words of the windows of items with so many; 0 for none."""
    return np.where(count >= window, window, np.where(count >= (LEAST if which else SHORT), count, 0))


def item_windows(data: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(size, text, hash, values, slots, is it word by word) of the windows of items, of one reading and size at a time."""
    _, ways = readings(data, offsets, True)
    for which, r in enumerate(ways):
        own = _item_sizes(r.count, window, which)
        for size in np.unique(own[own > 0]).tolist():
            text, at, h = _windows(r, size, np.where(own == size, r.count - size + 1, 0), which)
            spot = at[:, None] + np.arange(size)
            yield size, text, h, r.own[spot], r.slot[spot], np.full(len(h), which == 0)


def consistent(a: np.ndarray, b: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """For rows of words a and b: whether the slots' values map one to one."""
    out = np.ones(len(a), bool)
    for i in range(a.shape[1]):
        for j in range(i):
            both = slot[:, i] & slot[:, j]
            if both.any():
                out &= ~both | ((a[:, i] == a[:, j]) == (b[:, i] == b[:, j]))
    return out


class Filter:
    """One bit of a table for each hash: most windows of documents end here."""

    def __init__(self, bits: int):
        self.bits, self.table = bits, np.zeros(1 << max(0, bits - 3), np.uint8)

    def add(self, h: np.ndarray) -> None:
        place = (h >> U64(64 - self.bits)).astype(np.int64)
        np.bitwise_or.at(self.table, place >> 3, np.left_shift(1, place & 7).astype(np.uint8))

    def maybe(self, h: np.ndarray) -> np.ndarray:
        place = (h >> U64(64 - self.bits)).astype(np.int64)
        return np.flatnonzero(self.table[place >> 3] >> (place & 7).astype(np.uint8) & 1)


def doc_windows(data: np.ndarray, offsets: np.ndarray, sizes: list[list[int]], filter_: Filter) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, Reading]]:
    """(which reading, size, text, first canonical word, hash, reading) of the windows of documents that pass the filter."""
    _, ways = readings(data, offsets, any(s < LEAST for s in sizes[0]))
    for which, r in enumerate(ways):
        for size in sizes[min(which, 1)]:
            text, at, h = _windows(r, size, np.maximum(r.count - size + 1, 0), which)
            some = filter_.maybe(h)
            yield which, size, text[some], at[some], h[some], r


class Windows:
    """All windows of the benchmark, sorted by hash."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        data, offsets = utf8(pa.array([t for _, t in items], pa.string()))
        ids = np.array([i for i, _ in items], np.int64)
        hashes, which, values = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros((0, window), np.uint64)]
        self.sizes: list[list[int]] = [[], []]
        for size, text, h, value, _, exact in item_windows(data, offsets, window):
            row = np.zeros((len(h), window), np.uint64)
            row[:, :size] = value
            hashes.append(h)
            which.append(ids[text])
            values.append(row)
            if len(h):
                kind = 1 - int(exact[0])
                self.sizes[kind] = sorted({*self.sizes[kind], size})
        self.hash, self.item, self.value = (np.concatenate(x) for x in (hashes, which, values))
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.value = self.hash[order], self.item[order], self.value[order]
        self.filter = Filter(max(16, int(len(self.hash) * 16).bit_length()))
        self.filter.add(self.hash)

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, first word, are the values the same) for each leaking window."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
        for which, size, text, at, h, r in doc_windows(data, offsets, self.sizes, self.filter):
            low, high = np.searchsorted(self.hash, h), np.searchsorted(self.hash, h, "right")
            row = np.repeat(np.arange(len(h)), high - low)
            if not len(row):
                continue
            place = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
            spot = at[row][:, None] + np.arange(size)
            a, b = self.value[place][:, :size], r.own[spot]
            good = consistent(a, b, r.slot[spot])
            out.append((text[row][good], self.item[place][good], r.word[at[row]][good], (a == b).all(axis=1)[good]))
        return tuple(np.concatenate(x) for x in zip(*out))


_SCHEMA = "doc_id long, copy long, item_id long, n_windows long, n_same long"


def _rows(doc_ids: pa.Array, copies: np.ndarray, text: np.ndarray, item: np.ndarray, word: np.ndarray, same: np.ndarray) -> pa.RecordBatch:
    """Places of each text and item at which a window begins that matches in some reading."""
    order = np.lexsort((~same, word, item, text))
    text, item, word, same = text[order], item[order], word[order], same[order]
    new = np.ones(len(order), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (word[1:] != word[:-1])
    text, item, same = text[new], item[new], same[new]
    first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]))) if len(text) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(text)))
    n_same = np.add.reduceat(same.astype(np.int64), first) if len(first) else first
    return pa.RecordBatch.from_arrays([doc_ids.take(pa.array(text[first])), pa.array(copies[text[first]]), pa.array(item[first]), pa.array(count), pa.array(n_same)], ["doc_id", "copy", "item_id", "n_windows", "n_same"])


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, item_id, n_windows, n_same): documents that hold windows of an item.

    n_windows counts the places of the document at which a window begins that matches one of
    the item in some reading, n_same those at which the slots have the same values as well.
    Null texts and ids give no row, nor do items of fewer than SHORT words. Repeated rows
    (doc_id and text) count once, several texts of one doc_id together; repeated items with
    one item_id are one item. Runs a job that counts the words of the benchmark when it
    is called."""
    arrow_batches(docs.sparkSession)
    if window < LEAST:
        raise ValueError(f"a window has {LEAST} words at least")
    docs = docs.select(docs["doc_id"].cast("long"), docs["text"]).where("doc_id is not null and text is not null")
    items = benchmark.select(benchmark["item_id"].cast("long"), benchmark["text"]).where("item_id is not null and text is not null").distinct()
    # a word has one byte at least and what is between them one too, but in scripts without spaces
    words = items.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[\p{Alnum}]+|[^\x00-\x7f]"))), F.lit(0))).first()[0]
    if words > broadcast_words:
        found = _shuffled(docs, items, window)
    else:
        index = Windows([(r.item_id, r.text) for r in items.collect()], window)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in pieces(batch):
                    data, offsets = utf8(piece.column(1))
                    yield _rows(piece.column(0), text_hashes(data, offsets), *index.matches(data, offsets))

        found = docs.mapInArrow(run, _SCHEMA).dropDuplicates(["doc_id", "copy", "item_id"])
    return found.groupBy("doc_id", "item_id").agg(F.sum("n_windows").alias("n_windows"), F.sum("n_same").alias("n_same"))


def _lists(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(values).reshape(-1).view(np.int64)), values.shape[1]).cast(pa.list_(pa.int64()))


def _shuffled(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """The same for a benchmark too large to send around. Windows meet by hash: at first hashes alone, of
    what passes a filter of a fixed size; then, of documents that have some, with their values."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                for size, text, h, value, _, exact in item_windows(*utf8(piece.column(1)), window):
                    yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(text)), pa.array(h.view(np.int64)), pa.array(np.full(len(h), size, np.int32)), pa.array(exact), _lists(value)], ["item_id", "h", "size", "exact", "w"])

    theirs = cut(items.mapInArrow(explode, "item_id long, h long, size int, exact boolean, w array<long>"))
    known = theirs.groupBy("exact", "size").agg(F.count("*")).collect()
    sizes = [sorted(r["size"] for r in known if r.exact == e) for e in (True, False)]
    # at most 2 ** FILTER_BITS / 64 rows come to the driver, however large the benchmark is
    bits = theirs.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).alias("p")).select(F.shiftright("p", 6).alias("slot"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("mask")).toArrow()
    filter_ = Filter(FILTER_BITS)
    filter_.table.view(np.int64)[bits.column("slot").to_numpy()] = bits.column("mask").to_numpy()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                for _, _, text, _, h, _ in doc_windows(*utf8(piece.column(1)), sizes, filter_):
                    yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(text)), pa.array(h.view(np.int64))], ["doc_id", "h"])

    hits = docs.mapInArrow(hashes, "doc_id long, h long").join(theirs.select("h").distinct(), "h", "left_semi").select("doc_id").distinct()

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                data, offsets = utf8(piece.column(1))
                copies = text_hashes(data, offsets)
                for _, size, text, at, h, r in doc_windows(data, offsets, sizes, filter_):
                    spot = at[:, None] + np.arange(size)
                    word = r.word[at] if len(at) else at
                    yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(text)), pa.array(copies[text]), pa.array(word), pa.array(h.view(np.int64)), pa.array(np.full(len(h), size, np.int32)), _lists(r.own[spot]), _lists(r.slot[spot].astype(np.uint64))], ["doc_id", "copy", "word", "h", "size", "v", "slot"])

    ours = docs.join(hits, "doc_id", "left_semi").mapInArrow(values, "doc_id long, copy long, word long, h long, size int, v array<long>, slot array<long>")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(4).to_numpy()
            for s in np.unique(size):
                rows = batch.filter(pa.array(size == s))
                a, b, slot = (rows.column(i).flatten().to_numpy().reshape(-1, s) for i in (5, 6, 7))
                good = pa.array(consistent(a, b, slot > 0))
                yield pa.RecordBatch.from_arrays([*[rows.column(i).filter(good) for i in range(4)], pa.array((a == b).all(axis=1)).filter(good)], ["doc_id", "copy", "word", "item_id", "same"])

    found = ours.join(theirs, ["h", "size"]).select("doc_id", "copy", "word", "item_id", "size", "w", "v", "slot").mapInArrow(verify, "doc_id long, copy long, word long, item_id long, same boolean")
    places = found.groupBy("doc_id", "copy", "item_id", "word").agg(F.max("same").alias("same"))
    return places.groupBy("doc_id", "copy", "item_id").agg(F.count("*").alias("n_windows"), F.sum(F.col("same").cast("long")).alias("n_same"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of docs whose doc_id has no leak. Null texts and null ids stay; rows of one
    doc_id stand or fall together. The columns are those of docs."""
    name = fresh_names(docs, "leaked")[0]
    leaked = cut(leaks(docs, benchmark, window).select(F.col("doc_id").alias(name)).distinct())
    if leaked.count() <= broadcast_rows:
        leaked = F.broadcast(leaked)
    return docs.join(leaked, F.col("doc_id").cast("long") == F.col(name), "left_anti")
