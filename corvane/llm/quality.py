"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Features of a text are its distinct folded words (hashed; weight 1 + log of the count, of
unit length together), structure statistics, each squashed to -1..1, and the hashed values of lang and
source. The score is w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j; the pairs are summed in
linear time as half of (sum v_i x_i)**2 - sum (v_i x_i)**2 per factor.

It is trained in numpy on a bounded sample of labelled documents (``PER_CLASS`` of each
class); the threshold is set on the held-out fifth, so that few good documents are lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.arrowtext import _BYTE, U64, Rolling, Words, arrow_batches, fold, mix, pieces, text_sums, utf8
from corvane.llm.labelled import held_out, sample

PER_CLASS = 3000
RANK = 8
BITS = 17
EPOCHS = 6
RATE, DECAY = 0.02, 1e-4
#: Share of good documents of the held-out fifth that may fall below the threshold.
LOST = 0.002
META = ("lang", "source")
N_STATS = 14
#: Features of the sample that are looked up in training at a time.
BATCH = 64


@dataclass
class Features:
    """Sparse rows: features ``index``/``value`` of text i are those from first[i] to first[i + 1]."""

    index: np.ndarray
    value: np.ndarray
    first: np.ndarray


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _marks(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_UPPER, _DIGIT, _END, _SYMBOL, _SPACE = _marks(bytes(range(65, 91))), _marks(bytes(range(48, 58))), _marks(b".!?"), _marks(b"#$%&*+/<=>@\\^_`{|}~[]"), _marks(b" \t\r\n")
_EXCLAIM, _PIPE, _COMMA, _QUOTE, _LETTER = _marks(b"!"), _marks(b"|"), _marks(b",;:"), _marks(b"\"'()"), _marks(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))


def structure(data: np.ndarray, offsets: np.ndarray, words: Words, distinct: np.ndarray) -> np.ndarray:
    """Structure statistics of each text, each from -1 to 1."""
    size = np.diff(offsets)

    def count(mark: np.ndarray) -> np.ndarray:
        return text_sums(mark.astype(np.int64), offsets)

    line = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([offsets[:-1], line + 1, offsets[-1:]]))
    begin, end = edges[:-1], edges[1:]
    text = np.searchsorted(offsets, begin, "right") - 1
    end = end - (data[np.maximum(end - 1, 0)] == 10) if len(end) else end
    some = end > begin
    begin, end, text = begin[some], end[some], text[some]
    hashes = Rolling(_BYTE[data]).ranges(begin, end) if len(begin) else np.zeros(0, np.uint64)
    lines = np.bincount(text, minlength=len(size))
    kinds = np.unique(np.stack([text.astype(np.uint64), hashes], axis=1), axis=0)[:, 0] if len(text) else np.zeros(0, np.uint64)
    again = lines - np.bincount(kinds.astype(np.int64), minlength=len(size))
    letters = count(_LETTER[data])
    length = text_sums(words.end - words.start, words.first)
    n = words.count
    return np.stack(
        [
            _share(count(_UPPER[data]), letters),
            _share(count(_DIGIT[data]), size),
            _share(4 * count(_SYMBOL[data]), size),
            _share(8 * count(_EXCLAIM[data]), size),
            _share(8 * count(_PIPE[data]), size),
            _share(4 * count(_END[data]), n),
            _share(4 * count(_COMMA[data]), n),
            _share(8 * count(_QUOTE[data]), size),
            _share(count(_SPACE[data]), size) * 4 - 0.6,
            _share(again, lines),
            _share(distinct, n),
            np.log1p(_share(length, n)) - 1.7,
            np.log1p(n) / 4 - 1.2,
            np.log1p(_share(n, lines)) / 2 - 1,
        ],
        axis=1,
    ).clip(-1, 1)


def features(texts: pa.Array, meta: list[pa.Array]) -> Features:
    data, offsets = utf8(texts)
    n = len(texts)
    folded = fold(data)
    words = Words(folded, offsets)
    size = 1 << BITS
    bucket = (words.hashes(folded) >> U64(64 - BITS)).astype(np.int64)
    key, times = np.unique(words.text_of() * size + bucket, return_counts=True)
    text = key // size
    distinct = np.bincount(text, minlength=n)
    weight = 1 + np.log(times)
    weight /= np.sqrt(np.bincount(text, weights=weight * weight, minlength=n))[text]
    stats = structure(data, offsets, words, distinct)
    index, value, owner = [key % size, np.tile(size + np.arange(N_STATS), n)], [weight, stats.reshape(-1)], [text, np.repeat(np.arange(n), N_STATS)]
    for k, column in enumerate(meta):
        own, places = utf8(column.cast(pa.string()))
        hashed = (mix(Rolling(_BYTE[own]).ranges(places[:-1], places[1:]) + U64(k + 1)) >> U64(64 - 10)).astype(np.int64)
        index.append(size + N_STATS + (k << 10) + hashed)
        value.append(np.where(np.diff(places) > 0, 0.5, 0.0))
        owner.append(np.arange(n))
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return Features(np.concatenate(index)[order], np.concatenate(value)[order].astype(np.float32), np.searchsorted(owner[order], np.arange(n + 1)))


class Machine:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        size = (1 << BITS) + N_STATS + (len(META) << 10)
        self.bias = 0.0
        self.weight = np.zeros(size, np.float32)
        self.factor = rng.normal(0, 0.05, (size, RANK)).astype(np.float32)
        self.threshold = 0.0

    def parts(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log odds, sum of v_i x_i of each text, v_i x_i of each feature). Every text has features."""
        each = self.factor[f.index] * f.value[:, None]
        first = f.first[:-1]
        total = np.add.reduceat(each, first, axis=0)
        squares = np.add.reduceat(np.einsum("ij,ij->i", each, each), first)
        linear = np.add.reduceat(self.weight[f.index] * f.value, first)
        return self.bias + linear + 0.5 * (np.einsum("ij,ij->i", total, total) - squares), total, each

    def scores(self, f: Features) -> np.ndarray:
        return self.parts(f)[0] if len(f.first) > 1 else np.zeros(0)

    def train(self, f: Features, label: np.ndarray, rng: np.random.Generator) -> None:
        """AdaGrad on log loss, in random order, both classes weighing the same."""
        balance = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum())) * len(label)
        seen_w, seen_v, seen_b = np.full(len(self.weight), 1e-6, np.float32), np.full(self.factor.shape, 1e-6, np.float32), 1e-6
        for _ in range(EPOCHS):
            order = rng.permutation(len(label))
            for i in range(0, len(order), BATCH):
                rows = order[i : i + BATCH]
                count = f.first[rows + 1] - f.first[rows]
                at = np.repeat(f.first[rows] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                part = Features(f.index[at], f.value[at], np.append(0, np.cumsum(count)))
                logit, total, each = self.parts(part)
                d = ((1 / (1 + np.exp(-logit)) - label[rows]) * balance[rows] / len(rows)).astype(np.float32)
                own = np.repeat(d, count)
                grad_w = own * part.value
                grad_v = (own * part.value)[:, None] * (np.repeat(total, count, axis=0) - each)
                used, where = np.unique(part.index, return_inverse=True)
                sum_w = np.bincount(where, weights=grad_w, minlength=len(used)).astype(np.float32) + DECAY * self.weight[used]
                sum_v = np.stack([np.bincount(where, weights=grad_v[:, k], minlength=len(used)) for k in range(RANK)], axis=1).astype(np.float32) + DECAY * self.factor[used]
                seen_w[used] += sum_w * sum_w
                seen_v[used] += sum_v * sum_v
                self.weight[used] -= RATE * sum_w / np.sqrt(seen_w[used])
                self.factor[used] -= RATE * sum_v / np.sqrt(seen_v[used])
                seen_b += float(d.sum()) ** 2
                self.bias -= RATE * float(d.sum()) / seen_b**0.5


def fit(rows: list[tuple], seed: int = 11) -> Machine | None:
    """From (label, doc_id, text, *META); None without documents of both classes."""
    label = np.array([r[0] for r in rows], np.float32)
    if not len(rows) or label.min() == label.max():
        return None
    columns = [pa.array([r[k] for r in rows], pa.string()) for k in range(2, 3 + len(META))]
    # some texts at a time, as the driver is small
    parts = [features(p.column(0), p.columns[1:]) for p in pieces(pa.RecordBatch.from_arrays(columns, ["text", *META]))]
    f = Features(np.concatenate([p.index.astype(np.int32) for p in parts]), np.concatenate([p.value for p in parts]), np.append(0, np.cumsum(np.concatenate([np.diff(p.first) for p in parts]))))
    away = np.array([held_out(r[1]) for r in rows])
    if min((label[~away] == 1).sum(), (label[~away] == 0).sum()) == 0:
        away[:] = False
    some = np.flatnonzero(~away)
    count = np.diff(f.first)[some]
    at = np.concatenate([np.arange(f.first[i], f.first[i + 1]) for i in some])
    machine = Machine(seed)
    machine.train(Features(f.index[at], f.value[at], np.append(0, np.cumsum(count))), label[some], np.random.default_rng(seed))
    value = machine.scores(f)
    judged = away if (label[away] == 0).any() and (label[away] == 1).any() else np.ones(len(rows), bool)
    good, bad = np.sort(value[judged & (label == 1)]), np.sort(value[judged & (label == 0)])
    # below all but the share of good documents that may be lost, and if there is a gap to the bad ones in it
    floor = good[min(len(good) - 1, int(len(good) * LOST))]
    below = bad[bad < floor]
    machine.threshold = float((floor + below[-1]) / 2 if len(below) else floor - 1)
    return machine


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Machine | None:
    return fit(sample(docs, labels, "quality", per_class, ["text", *META]))


def _with_meta(docs: DataFrame) -> DataFrame:
    return docs.withColumns({c: F.lit(None).cast("string") for c in META if c not in docs.columns})


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, score, good), one row for each row of docs: the probability of good quality,
    and whether it reaches the threshold.

    A null text has a null score and is not good; an empty one is scored by its structure
    and metadata, of which missing ones count as absent. If labels of one class are
    missing, every score is null and nothing is good. Null ids stay, repeated rows are
    scored each; other columns are not looked at."""
    arrow_batches(docs.sparkSession)
    docs = _with_meta(docs)
    machine = train(docs, labels, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                null = piece.column(1).is_null().to_numpy(zero_copy_only=False) | (machine is None)
                value = np.zeros(len(null)) if machine is None else machine.scores(features(piece.column(1), piece.columns[2:])).astype(np.float64)
                good = ~null & (value >= (machine.threshold if machine else 0))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(1 / (1 + np.exp(-value)), mask=null), pa.array(good)], ["doc_id", "score", "good"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"], *[docs[c].cast("string") for c in META]).mapInArrow(run, "doc_id long, score double, good boolean")
