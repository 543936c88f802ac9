import random
import re

import numpy as np
import pyarrow as pa
import pytest
from corvane.llm import simhash
from corvane.llm.arrowtext import U64, pieces, utf8
from pyspark.sql import functions as F

DOCS = "/root/testdata/sf0.001/documents.parquet"


def brute(rows, k=simhash.K):
    """{doc_id: group_id} by comparing all pairs."""
    batch = pa.RecordBatch.from_pydict({"text": pa.array([t for _, t in rows], pa.string())})
    codes, sizes = zip(*[simhash.fingerprints(*utf8(p.column(0))) for p in pieces(batch, limit=5000)])
    code, size = np.concatenate(codes).view(np.uint64).reshape(-1, 2), np.concatenate(sizes)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if size[i] and size[j] and np.bitwise_count(code[i] ^ code[j]).sum() <= k and 10 * min(size[i], size[j]) >= simhash.LEAST_TENTHS * max(size[i], size[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return {(d, least[root(i)]) for i, (d, _) in enumerate(rows) if size[i]}


def slow_fingerprint(text):
    """(code, size) bit by bit, each word hashed by itself."""
    words = {}
    for w in re.findall(r"[^\W_]+", "".join(c if len(c.encode()) < 3 else " " for c in text.lower())):
        data, offsets = utf8(pa.array([w]))
        words[w] = int(simhash.Words(data, offsets).hashes(data)[0])
    total, sums = 0, [0] * 128
    for w, h in words.items():
        weight = min(4, max(1, (len(w.encode()) + 1) // 3))
        total += weight
        both = h.to_bytes(8, "little") + int(simhash.mix(np.array([h], np.uint64) + U64(77))[0]).to_bytes(8, "little")
        for bit in range(128):
            sums[bit] += weight * (both[bit // 8] >> (7 - bit % 8) & 1)
    return [int(2 * s > total) for s in sums], total


def test_fingerprints_equal_bit_by_bit(spark):
    texts = [r.text for r in spark.read.parquet(DOCS).limit(25).collect()] + ["one", "Éa éA x x x", " ".join(f"w{i}" for i in range(500))]
    texts = ["".join(c for c in t if ord(c) < 0x250) for t in texts]
    code, size = simhash.fingerprints(*utf8(pa.array(texts)))
    for i, t in enumerate(texts):
        bits, total = slow_fingerprint(t)
        assert np.unpackbits(code[i]).tolist() == bits and size[i] == total


def test_equals_brute_force(spark):
    docs = spark.read.parquet(DOCS)
    got = {(r.doc_id, r.group_id) for r in simhash.groups(docs).collect()}
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got == want
    assert len({g for _, g in got}) < len(got)


def some_codes(seed=3, n=40):
    random.seed(seed)
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 64, (n, 2), dtype=np.uint64)
    codes = np.concatenate([base, base, base])
    for i in range(n, 3 * n):
        for bit in random.sample(range(128), random.randrange(0, 26)):
            codes[i, bit // 64] ^= np.uint64(1 << (bit % 64))
    return codes


def near_pairs(codes, k):
    return {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if np.bitwise_count(codes[i] ^ codes[j]).sum() <= k}


def test_random_codes_and_every_bound():
    codes = some_codes()
    for k in (0, 3, 12, 20, 23, 40):
        found = set()
        for start in range(simhash.BYTES):
            index = simhash.GrayIndex(simhash.rotated(codes, start))
            for x, y in simhash.join(index, index, [simhash.limit(k, start, bits) for bits in simhash.LEVELS]):
                found |= {(min(int(i), int(j)), max(int(i), int(j))) for i, j in zip(x, y) if i != j and np.bitwise_count(codes[i] ^ codes[j]).sum() <= k}
        assert found == near_pairs(codes, k)


def test_rotation_is_a_ring_of_bytes():
    codes = some_codes(5, 4)
    whole = np.ascontiguousarray(codes.byteswap()).view(np.uint8).reshape(-1, 16)
    for start in range(16):
        want = np.roll(whole, -start, axis=1)[:, :8]
        assert (np.ascontiguousarray(simhash.rotated(codes, start).byteswap()).view(np.uint8).reshape(-1, 8) == want).all()


@pytest.mark.parametrize("head_bits, cell_codes", [(3, None), (6, None), (10, None), (3, 7), (1, 20)])
def test_edges_connect_all_near_pairs(spark, head_bits, cell_codes):
    import time

    codes = some_codes(head_bits, 60)
    size = np.where(np.arange(len(codes)) % 11 == 0, 10, 100)
    rows = [(i, *map(int, c.view(np.int64)), int(s)) for i, (c, s) in enumerate(zip(codes, size))]
    nodes = spark.createDataFrame(rows, "node long, hi long, lo long, size long")
    for k in (3, 20):
        began = time.time()
        edges = simhash.near_edges(nodes, k, head_bits, cell_codes)
        assert time.time() - began < 20
        up = list(range(len(codes)))

        def root(i, up=up):
            while up[i] != i:
                i = up[i]
            return i

        pairs = {(i, j) for i, j in near_pairs(codes, k) if 10 * min(size[i], size[j]) >= simhash.LEAST_TENTHS * max(size[i], size[j])}
        for i, j in pairs:
            up[max(root(i), root(j))] = min(root(i), root(j))
        got = {r.node: r.root for r in simhash.components(edges).collect()}
        assert [got.get(i, i) for i in range(len(codes))] == [root(i) for i in range(len(codes))]


def test_head_counts(spark):
    codes = some_codes(9, 30)
    nodes = spark.createDataFrame([tuple(map(int, c.view(np.int64))) for c in codes], "hi long, lo long").repartition(3)
    got = simhash.head_counts(nodes, 4)
    want = [np.bincount((simhash.rotated(codes, start) >> U64(60)).astype(int), minlength=16) for start in range(16)]
    assert (got == want).all()
    assert not simhash.head_counts(nodes.limit(0), 3).any()


def test_groups_with_longer_heads(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_CODES", 4)
    assert simhash.heads(200) == 6
    docs = spark.read.parquet(DOCS)
    got = {(r.doc_id, r.group_id) for r in simhash.groups(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_dense_group_is_not_compared_pair_by_pair():
    rng = np.random.default_rng(8)
    codes = np.repeat(rng.integers(0, 1 << 64, (1, 2), dtype=np.uint64), 20_000, axis=0)
    for _ in range(6):
        bit = rng.integers(0, 128, len(codes))
        codes[np.arange(len(codes)), bit // 64] ^= U64(1) << (bit % 64).astype(np.uint64)
    compared = 0
    plain = simhash.join

    def counted(*of):
        nonlocal compared
        for x, y in plain(*of):
            compared += len(x)
            yield x, y

    simhash.join = counted
    try:
        child, root = simhash.cell_edges(codes, np.full(len(codes), 50), np.full(len(codes), 2), 0, 20)
    finally:
        simhash.join = plain
    assert len(child) == len(codes) - 1 and not root.any()
    assert compared < len(codes) ** 2 / 50


def test_edges_and_extra_columns(spark):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(1, text, "a"), (2, text.replace("word7 ", "other "), "b"), (2, text.replace("word7 ", "other "), "b"), (3, None, None), (4, "", "c"), (5, "?!", "d"), (6, "quite another text", None), (None, text, "e"), (7, " ".join(f"x{i}" for i in range(60000)), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, dropped string").withColumn("hi", F.lit(1)).withColumn("node", F.lit(1))
    got = {(r.doc_id, r.group_id, r.n_group) for r in simhash.groups(docs).collect()}
    assert got == {(1, 1, 2), (2, 1, 2), (6, 6, 1), (7, 7, 1)}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7]
    assert simhash.groups(docs.limit(0)).count() == 0


def test_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "src long, dst long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}
