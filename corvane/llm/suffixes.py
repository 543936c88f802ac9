"""Suffix-array dedup: exact repeated passages by a depth-limited radix sort.

A suffix is ordered only through its first ``DEPTH`` words, so a suffix is a window of
words, and the groups of equal suffixes are exactly the repeated windows. The sort goes
by most significant digit first, and what stands alone after a digit is dropped:

1. the anchor: the word run of ``RUN`` words with the lowest hash inside the window. It
   depends on the window alone, so equal windows have equal anchors; neighbouring
   windows mostly share one, so one shuffled row stands for a dozen suffixes. Suffixes
   are partitioned and ordered by this digit.
2. the place of the anchor in the window;
3. the words of the whole window.

Digits of words are hashes: 64 bits for the anchor and 48 for the window, 112 together
with the place besides. No suffix is left out, and no group has a limit. Groups are not
compared word by word: among 10**13 windows the odds that any two different ones fall
together are about 10**26 / 2 / 2**112, one in a hundred million.

Anchors are counted first. Those of more than ``HOT_ROWS`` rows, as boilerplate has, would
each be one task's work: their suffixes are grouped by all three digits instead, with the
number and the first of each group combined before the shuffle, and joined back, which
adaptive execution splits where a single window is hot itself.

Words are runs without white space, compared byte by byte; of scripts without spaces each
character is a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.arrowtext import _BYTE, U64, Rolling, Words, arrow_batches, pieces, utf8
from corvane.llm.spread import cut, fresh_names

DEPTH = 50
BYTES = 6
#: Rows that a task of the sort looks at together.
ROWS = 40_000
#: Rows of one anchor that one task sorts; a row takes about a kilobyte with its windows.
HOT_ROWS = 100_000
#: Anchors up to which they are sent to every task.
BROADCAST_ROWS = 1_000_000

_SUFFIXES = "doc_id long, copy long, anchor long, place long, windows binary"
_SPANS = "doc_id long, copy long, start_word int, end_word int, extra boolean"


def text_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return Rolling(_BYTE[data]).ranges(offsets[:-1], offsets[1:]).view(np.int64)


def _lowest(values: np.ndarray, width: int, step: int = 1 << 15) -> np.ndarray:
    """Place of the first lowest value of each ``width`` neighbours."""
    view = np.lib.stride_tricks.sliding_window_view(values, width)
    return np.concatenate([view[i : i + step].argmin(axis=1) + np.arange(i, min(i + step, len(view))) for i in range(0, len(view), step)] or [np.zeros(0, np.int64)])


def _anchors(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple:
    """(words, their prefix sums, text and first word of each suffix, place of its anchor, hash of
    every run, where each run of suffixes with one anchor begins)."""
    words = Words(data, offsets, solid=True)
    run = (depth + 1) // 2
    per_text = np.maximum(words.count - depth + 1, 0)
    text = np.repeat(np.arange(len(per_text)), per_text)
    start = words.first[text] + np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    if not len(text):
        none = np.zeros(0, np.int64)
        return words, None, text, start, none, none.view(np.uint64), none
    roll = Rolling(words.hashes(data))
    grams = np.arange(len(words) - run + 1)
    anchors = roll.ranges(grams, grams + run)
    at = _lowest(anchors, depth - run + 1)[start]
    first = np.ones(len(text), bool)
    first[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    return words, roll, text, start, at, anchors, np.flatnonzero(first)


def suffixes(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of suffixes that share an anchor: (text, anchor hash, first suffix * 64k + words
    before the anchor, where each run begins, 48-bit hashes of all suffixes as n x 6)."""
    words, roll, text, start, at, anchors, begin = _anchors(data, offsets, depth)
    if not len(text):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(1, np.int64), np.zeros((0, BYTES), np.uint8)
    window = (roll.ranges(start, start + depth) >> U64(64 - 8 * BYTES)).view(np.uint8).reshape(-1, 8)[:, :BYTES]
    place = (start[begin] - words.first[text[begin]] << 16) + at[begin] - start[begin]
    return text[begin], anchors[at[begin]].view(np.int64), place, np.append(begin, len(text)), np.ascontiguousarray(window)


def _streamed(batches: Iterator[pa.RecordBatch], key: list[int], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Sorted batches regrouped so that rows with equal keys come together."""
    kept: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        kept.append(batch)
        held += batch.num_rows
        if held < rows or not batch.num_rows:
            continue
        whole = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
        same = np.ones(whole.num_rows, bool)
        for k in key:
            value = whole.column(k).to_numpy(zero_copy_only=False)
            same &= value == value[-1]
        last = whole.num_rows - int(same[::-1].argmin()) if not same.all() else 0
        if last:
            yield whole.slice(0, last)
            # what is held on to is copied, so that the rest can go
            kept = [whole.slice(last).take(pa.array(np.arange(whole.num_rows - last)))]
            held = whole.num_rows - last
        rows = max(ROWS, 2 * held)
    if held:
        yield from pa.Table.from_batches(kept).combine_chunks().to_batches()


def _new(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def _alone(new: np.ndarray) -> np.ndarray:
    """Rows that are the only ones of their group; ``new`` marks the first of each."""
    return new & np.append(new[1:], True) if len(new) else new


def repeats(doc: np.ndarray, copy: np.ndarray, anchor: np.ndarray, place: np.ndarray, first: np.ndarray, window: np.ndarray, depth: int) -> tuple:
    """(doc, copy, start word, end word, extra) of the runs of repeated windows among rows that are
    in order by anchor: the passes after the first digit."""
    # a row that occurs again, with its doc_id, counts once
    once = np.lexsort((place, copy, doc, anchor))
    once = once[_new(anchor[once], doc[once], copy[once], place[once])]
    group = np.zeros(len(anchor), np.int64)
    group[once] = np.cumsum(_new(anchor[once]))
    some = once[~_alone(_new(anchor[once]))]
    count = (first[1:] - first[:-1])[some]
    row = np.repeat(some, count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    wide = np.zeros((len(row), 8), np.uint8)
    wide[:, :BYTES] = window[first[row] + step]
    # second digit above the third: the anchor's place in the window and the window itself
    digit = ((place[row] & 0xFFFF) - step).astype(np.uint64) << U64(8 * BYTES) | wide.view(np.uint64)[:, 0] if depth <= 512 else None
    if digit is None:
        raise ValueError("a depth of more than 512 words is not supported")
    order = np.lexsort((digit, group[row]))
    kept = order[~_alone(_new(group[row][order], digit[order]))]
    row, step, digit = row[kept], step[kept], digit[kept]
    start = (place[row] >> 16) + step
    order = np.lexsort((start, copy[row], doc[row], digit, group[row]))
    extra = np.ones(len(row), bool)
    extra[order[_new(group[row][order], digit[order])]] = False
    # runs of neighbouring windows of one row
    order = np.lexsort((step, row))
    row, start, extra = row[order], start[order], extra[order]
    first = np.flatnonzero(_new(row, extra, start - np.arange(len(start))))
    length = np.diff(np.append(first, len(row)))
    return doc[row[first]], copy[row[first]], start[first], start[first] + length - 1 + depth, extra[first]


def merged(doc: np.ndarray, copy: np.ndarray, extra: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that begin a run, end of each run) of spans in order by doc, copy, extra and start."""
    lift = np.cumsum(_new(doc, copy, extra)) * (np.int64(1) << 32)
    far = np.maximum.accumulate(end + lift) if len(end) else end
    first = np.ones(len(doc), bool)
    first[1:] = (start + lift)[1:] > far[:-1]
    first = np.flatnonzero(first)
    return first, (far - lift)[np.append(first[1:], len(doc)) - 1] if len(first) else first


def hot_anchors(text: DataFrame, depth: int, hot_rows: int) -> DataFrame:
    """(anchor) of more than hot_rows rows; every row is counted, partly before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                _, _, _, _, at, anchors, begin = _anchors(*utf8(piece.column(1)), depth)
                value, n = np.unique(anchors[at[begin]].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], ["anchor", "n"])

    return text.mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > hot_rows).select("anchor")


def _hot_spans(rows: DataFrame, depth: int) -> DataFrame:
    """As the sort finds them, of rows of any number for an anchor: one row for each window, its
    group's first one joined to it."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                piece = batch.slice(first, 500)
                data, offsets = utf8(piece.column(4))
                count = np.diff(offsets) // BYTES
                row = np.repeat(np.arange(len(count)), count)
                step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                wide = np.zeros((len(row), 8), np.uint8)
                wide[:, :BYTES] = data.reshape(-1, BYTES)
                place = piece.column(3).to_numpy()[row]
                yield pa.RecordBatch.from_arrays([*[piece.column(i).take(pa.array(row)) for i in range(3)], pa.array((place & 0xFFFF) - step), pa.array(wide.view(np.int64)[:, 0]), pa.array(((place >> 16) + step).astype(np.int32))], ["doc_id", "copy", "anchor", "place", "window", "start_word"])

    every = rows.mapInArrow(windows, "doc_id long, copy long, anchor long, place long, window long, start_word int")
    own = F.struct("doc_id", "copy", "start_word")
    groups = every.groupBy("anchor", "place", "window").agg(F.min(own).alias("low"), F.max(own).alias("high")).where("low <> high").drop("high")
    found = every.join(groups, ["anchor", "place", "window"]).select("doc_id", "copy", "start_word", (own != F.col("low")).alias("extra"))
    # rows that occur again are one before they meet
    return found.distinct().select("doc_id", "copy", "start_word", (F.col("start_word") + depth).cast("int").alias("end_word"), "extra")


def spans(docs: DataFrame, depth: int = DEPTH, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, copy, start_word, end_word, extra); see ``repeated``. copy is a hash of the text."""
    if not 2 <= depth <= 512:
        raise ValueError("depth has to be from 2 to 512")
    arrow_batches(docs.sparkSession)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                data, offsets = utf8(piece.column(1))
                text, anchor, place, first, window = suffixes(data, offsets, depth)
                packed = pa.Array.from_buffers(pa.binary(), len(text), [None, pa.py_buffer((first * BYTES).astype(np.int32).tobytes()), pa.py_buffer(window.tobytes())])
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(text)), pa.array(text_hashes(data, offsets)[text]), pa.array(anchor), pa.array(place), packed], ["doc_id", "copy", "anchor", "place", "windows"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _streamed(batches, [2]):
            data, first = utf8(batch.column(4))
            doc, copy, start, end, extra = repeats(*(batch.column(i).to_numpy() for i in range(4)), first // BYTES, data.reshape(-1, BYTES), depth)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(copy), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(extra)], ["doc_id", "copy", "start_word", "end_word", "extra"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _streamed(batches, [0, 1]):
            doc, copy, start, end, extra = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            first, last = merged(doc, copy, extra, start.astype(np.int64), end.astype(np.int64))
            rows = batch.take(pa.array(first))
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(last.astype(np.int32)), rows.column(4)], rows.schema.names)

    text = docs.select(docs["doc_id"].cast("long"), docs["text"]).where("doc_id is not null and text is not null")
    rows = text.mapInArrow(cut_up, _SUFFIXES)
    hot = cut(hot_anchors(text, depth, hot_rows))
    number = hot.count()
    if number and number <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    cold = rows.join(hot, "anchor", "left_anti").select(*rows.columns) if number else rows
    found = cold.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(sort, _SPANS)
    if number:
        found = found.unionByName(_hot_spans(cut(rows.join(hot, "anchor", "left_semi").select(*rows.columns)), depth))
    return found.repartition("doc_id", "copy").sortWithinPartitions("doc_id", "copy", "extra", "start_word").mapInArrow(merge, _SPANS)


def repeated(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, start_word, end_word, extra): every longest run of words that repeated windows
    of ``depth`` words cover, from word start_word up to end_word.

    extra says that the windows have an earlier copy, by doc_id and place, which is what
    ``without_repeats`` cuts out; the first copies are runs with extra false. A window
    may repeat in its own document. Null ids and null texts have no row, nor have texts
    of fewer than ``depth`` words. Repeated rows (doc_id and text) count as one; a doc_id
    with several texts has the runs of each. Runs the job that counts anchors when it is
    called."""
    return spans(docs, depth).select("doc_id", "start_word", "end_word", "extra")


def without_repeats(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """docs with the extra runs cut out of their texts; other columns stay as they are, and
    so do rows with a null doc_id or text. Repeated rows lose the same."""
    arrow_batches(docs.sparkSession)
    cuts, key = fresh_names(docs, "cuts", "cuts_of")
    some = spans(docs, depth).where("extra").groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("copy", "start_word", "end_word")).alias(cuts))
    joined = docs.join(some, F.col("doc_id").cast("long") == F.col(key), "left").drop(key)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            texts = batch.column(place)
            out = texts.to_pylist()
            for i in np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)):
                if out[i] is None:
                    continue
                data, offsets = utf8(texts.slice(i, 1))
                own = int(text_hashes(data, offsets)[0])
                words = Words(data, offsets, solid=True)
                keep = np.ones(len(data), bool)
                for cut in lists[int(i)].as_py():
                    if cut["copy"] == own:
                        keep[words.start[cut["start_word"]] : words.start[cut["end_word"]] if cut["end_word"] < len(words) else words.end[-1]] = False
                out[i] = data[keep].tobytes().decode()
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(out, texts.type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)
