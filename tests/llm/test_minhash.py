import random

import numpy as np
import pyarrow as pa
import pytest
from corvane.llm import minhash as M
from corvane.llm.arrowtext import Words, fold, utf8, windows

SCHEMA = "doc_id long, text string, signature string, n_shingles int"


def shingles(text, size=M.SHINGLE):
    data, offsets = utf8(pa.array([text], pa.string()))
    data = fold(data)
    words = Words(data, offsets)
    return {int(h) for h in windows(words, words.hashes(data), size)[1]} if len(words) else set()


def brute(text, bins=M.BINS, bits=M.BITS):
    """Signature bin by bin."""
    own = shingles(text)
    if not own:
        return None
    low = {}
    for h in own:
        b = h * bins >> 64
        low[b] = min(low.get(b, 1 << 64), h)
    order = M._order(bins)
    values = [low[b] if b in low else low[next(d for d in order[b].tolist() if d in low)] for b in range(bins)]
    number = int("".join(f"{v & (1 << bits) - 1:0{bits}b}" for v in values), 2)
    return number.to_bytes(bins * bits // 8, "big")


def text(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


@pytest.mark.parametrize("bins,bits", [(256, 4), (64, 1), (8, 8), (128, 2)])
def test_equals_brute_force(spark, bins, bits):
    rng = random.Random(bins)
    rows = [(i, text(rng, n)) for i, n in enumerate([0, 1, 3, 5, 6, 20, 200, 900, 900, 20_000])] + [(None, "a b c d e f"), (50, None), (51, " !? "), (52, "Été ÉTÉ été"), (5, text(rng, 9)), (5, text(rng, 9))]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], SCHEMA)
    got = M.fingerprints(docs, bins=bins, bits=bits).collect()
    want = [(i, len(shingles(t)) if t else 0, brute(t, bins, bits) if t else None) for i, t in rows]
    assert sorted(((r.doc_id, r.n_shingles, bytes(r.signature) if r.signature is not None else None) for r in got), key=str) == sorted(want, key=str)
    assert M.fingerprints(docs.limit(0)).count() == 0


def test_estimate_is_unbiased():
    rng = random.Random(3)
    errors = []
    for share in (0.0, 0.2, 0.5, 0.8, 1.0):
        for _ in range(30):
            n = rng.choice([40, 150, 1500])
            common, a, b = text(rng, round(n * share) + 4), text(rng, n - round(n * share)), text(rng, n - round(n * share))
            x, y = common + " " + a, common + " " + b
            sx, sy = shingles(x), shingles(y)
            packed, _ = M.signatures(*utf8(pa.array([x, y])))
            errors.append(M.estimate(packed[:1], packed[1:])[0] - len(sx & sy) / len(sx | sy))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_jaccard_column(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h", "s", 1), (2, None, "s", 1), (3, "a b c d e f g h", "s", 1), (4, "q r s t u v w x", "s", 1)], SCHEMA)
    prints = M.fingerprints(docs)
    pairs = prints.alias("a").crossJoin(prints.alias("b")).selectExpr("a.doc_id i", "b.doc_id j", "a.signature x", "b.signature y")
    got = {(r.i, r.j): r.jaccard for r in M.jaccard(pairs, "x", "y").collect()}
    assert got[1, 3] == 1 and got[1, 2] is None and got[1, 4] < 0.15


def test_bad_parameters(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for wrong in ({"bins": 100}, {"bits": 3}, {"shingle": 0}):
        with pytest.raises(ValueError):
            M.fingerprints(docs, **wrong)
