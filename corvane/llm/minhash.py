"""Document fingerprints by one-permutation MinHash.

Each distinct shingle (``SHINGLE`` folded words) is hashed once; the high bits of the hash
name one of ``BINS`` bins, the rest is its value there, and a bin keeps its lowest value.
Bins that stay empty are filled by optimal densification: each has a fixed random order in
which it asks the other bins, the same for all documents, and takes over the first that is
not empty. Of each bin's value the low ``BITS`` bits are stored, packed.

Two unequal values agree in b bits with probability 2**-b, so the share of agreeing bins
is P = J + (1 - J) 2**-b; ``jaccard`` solves that for J.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.arrowtext import U64, Words, arrow_batches, fold, pieces, utf8, windows

SHINGLE = 5
BINS = 256
BITS = 4
#: Bins asked one after the other by all texts at once; who is still empty then asks all the rest in one step.
PROBES = 24

_orders: dict[int, np.ndarray] = {}


def _order(bins: int) -> np.ndarray:
    """For each bin the order in which it asks the others."""
    if bins not in _orders:
        rng = np.random.default_rng(20240611)
        _orders[bins] = np.stack([rng.permutation(np.delete(np.arange(bins), i)) for i in range(bins)])
    return _orders[bins]


def densify(value: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """value (texts x bins) with the empty bins of each text filled; a text has at least one that is not."""
    bins = value.shape[1]
    order = _order(bins) if bins > 1 else np.zeros((1, 0), np.int64)
    out = value.copy()
    text, bin_ = np.nonzero(empty)
    for probe in range(min(PROBES, bins - 1)):
        if not len(text):
            return out
        donor = order[bin_, probe]
        full = ~empty[text, donor]
        out[text[full], bin_[full]] = value[text[full], donor[full]]
        text, bin_ = text[~full], bin_[~full]
    for i in range(0, len(text), 1 << 13):
        t, b = text[i : i + (1 << 13)], bin_[i : i + (1 << 13)]
        first = (~empty[t[:, None], order[b]]).argmax(axis=1)
        out[t, b] = value[t, order[b, first]]
    return out


def signatures(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(packed signatures as n x bytes, number of distinct shingles); texts without words have zeros."""
    n = len(offsets) - 1
    data = fold(data)
    words = Words(data, offsets)
    packed, count = np.zeros((n, bins * bits // 8), np.uint8), np.zeros(n, np.int64)
    if not len(words):
        return packed, count
    at, hashes = windows(words, words.hashes(data), shingle)
    text = np.searchsorted(words.first, at, "right") - 1
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(text[order], kind="stable")]
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    text, hashes = text[new], hashes[new]
    count += np.bincount(text, minlength=n)
    # high bits name the bin, so that in order of hash the first of each bin is its lowest
    shift = U64(64 - bins.bit_length() + 1)
    bin_ = (hashes >> shift).astype(np.int64)
    low = np.ones(len(text), bool)
    low[1:] = (text[1:] != text[:-1]) | (bin_[1:] != bin_[:-1])
    some = np.flatnonzero(count)
    place = np.searchsorted(some, text[low])
    value, empty = np.zeros((len(some), bins), np.uint8), np.ones((len(some), bins), bool)
    value[place, bin_[low]] = (hashes[low] & U64((1 << bits) - 1)).astype(np.uint8)
    empty[place, bin_[low]] = False
    value = densify(value, empty)
    flat = np.unpackbits(value[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(some), -1)
    packed[some] = np.packbits(flat, axis=1)
    return packed, count


def estimate(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Jaccard similarity of rows of packed signatures, corrected for chance agreement."""
    different = np.unpackbits(a ^ b, axis=1).reshape(len(a), -1, bits).any(axis=2).mean(axis=1) if len(a) else np.zeros(0)
    chance = 0.5**bits
    return np.clip((1 - different - chance) / (1 - chance), 0, 1)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """(doc_id, n_shingles, signature), one row for each row of docs.

    bins is a power of two and bits 1, 2, 4 or 8. A text of fewer words than a shingle is
    one shingle; a null, empty or wordless text has 0 shingles and a null signature. Null
    ids stay null, repeated rows have a row each, other columns are not looked at."""
    if bins < 8 or bins & (bins - 1) or bits not in (1, 2, 4, 8) or shingle < 1:
        raise ValueError("bins has to be a power of two from 8 on, bits 1, 2, 4 or 8, shingle 1 or more")
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                packed, count = signatures(*utf8(piece.column(1)), shingle, bins, bits)
                width = bins * bits // 8
                lists = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer((np.arange(len(count) + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(packed.tobytes())])
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(count), pa.compute.if_else(pa.array(count > 0), lists, pa.scalar(None, pa.binary()))], ["doc_id", "n_shingles", "signature"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, "doc_id long, n_shingles long, signature binary")


def jaccard(pairs: DataFrame, left: str, right: str, bits: int = BITS, name: str = "jaccard") -> DataFrame:
    """pairs with the estimated similarity of two signature columns; null where one is null
    or their lengths differ."""

    @F.pandas_udf("double")
    def udf(a, b):
        import pandas as pd

        out = np.full(len(a), np.nan)
        for size in {len(x) for x in a if x is not None}:
            some = [i for i, (x, y) in enumerate(zip(a, b)) if x is not None and y is not None and len(x) == len(y) == size]
            if some:
                x, y = (np.frombuffer(b"".join(c.iloc[some]), np.uint8).reshape(len(some), size) for c in (a, b))
                out[some] = estimate(x, y, bits)
        return pd.Series(out)

    return pairs.withColumn(name, F.nanvl(udf(F.col(left), F.col(right)), F.lit(None).cast("double")))
