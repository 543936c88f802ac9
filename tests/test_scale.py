"""Steps whose cost or memory must not grow with what one task happens to read."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from corvane import queries
from corvane.functions import hashing, jsonops, security
from corvane.operators import shared
from corvane.operators.stores import DataStore

SF = "/root/testdata/sf0.01"


def murmur(data: bytes) -> bytes:
    """Murmur3 with 128 bits, value by value in Python's numbers."""
    mask, c1, c2 = (1 << 64) - 1, 0x87C37B91114253D5, 0x4CF5AD432745937F
    rotate = lambda x, by: (x << by | x >> (64 - by)) & mask
    h1 = h2 = 0
    whole = len(data) // 16 * 16
    for i in range(0, whole, 16):
        k1, k2 = int.from_bytes(data[i : i + 8], "little"), int.from_bytes(data[i + 8 : i + 16], "little")
        h1 ^= rotate(k1 * c1 & mask, 31) * c2 & mask
        h1 = ((rotate(h1, 27) + h2) * 5 + 0x52DCE729) & mask
        h2 ^= rotate(k2 * c2 & mask, 33) * c1 & mask
        h2 = ((rotate(h2, 31) + h1) * 5 + 0x38495AB5) & mask
    tail = data[whole:].ljust(16, b"\0")
    h2 ^= rotate(int.from_bytes(tail[8:], "little") * c2 & mask, 33) * c1 & mask
    h1 ^= rotate(int.from_bytes(tail[:8], "little") * c1 & mask, 31) * c2 & mask

    def final(x: int) -> int:
        x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & mask
        x = (x ^ x >> 33) * 0xC4CEB9FE1A85EC53 & mask
        return x ^ x >> 33

    h1, h2 = h1 ^ len(data), h2 ^ len(data)
    h1 = (h1 + h2) & mask
    h2 = (h2 + h1) & mask
    h1, h2 = final(h1), final(h2)
    h1 = (h1 + h2) & mask
    h2 = (h2 + h1) & mask
    return h1.to_bytes(8, "little") + h2.to_bytes(8, "little")


@pytest.fixture
def steps(monkeypatch) -> list[int]:
    """Values that each step of mixing takes."""
    out, rotate = [], hashing._rotate
    monkeypatch.setattr(hashing, "_rotate", lambda x, by: out.append(len(x)) or rotate(x, by))
    return out


def test_hashes_of_any_lengths():
    draw = random.Random(1)
    values = [draw.randbytes(n) for n in [*range(70), 4079, 4080, 4096, 20_000, 300_000, *draw.choices(range(9000), k=200)]]
    draw.shuffle(values)
    assert [bytes(h) for h in hashing.murmur3_128(values)] == [murmur(v) for v in values]
    assert hashing.murmur3_128([]).shape == (0, 16)


def test_long_values_are_hashed_together(steps):
    """F8: a file was hashed by itself, so that each of its blocks was a step."""
    hashing.murmur3_128([bytes([i]) * (5000 + i) for i in range(200)])
    assert len(steps) < 4000


def test_values_are_hashed_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(hashing, "_BYTES", 4096)
    assert list(hashing._groups([10] * 3 + [2000, 2000, 2000, 9000, 9000])) == [(0, 3), (3, 5), (5, 6), (6, 7), (7, 8)]
    values = [b"x" * n for n in (10, 2000, 2001, 3000, 9000)]
    assert [bytes(h) for h in hashing.murmur3_128(values)] == [murmur(v) for v in values]


def test_fields_are_matched_by_batch(monkeypatch):
    """each value of each document was hashed by itself."""
    calls, hash_texts = [], jsonops.hash_texts
    monkeypatch.setattr(jsonops, "hash_texts", lambda *a: calls.append(1) or hash_texts(*a))
    a, none = jsonops.MASK + hashing.hash_text("a"), jsonops.MASK + hashing.hash_text(None)
    documents = [{"x": ["a", "b"]}, {"x": ["b"]}, {"x": []}, {"x[*]": "b", "x": ["a"]}, {"x": [None]}, {"x": [""]}, {"x": [True, 1.50]}, ["a"]]
    texts = [json.dumps(d) for d in documents] + ["a", "", None, '{"x":[1.50]}']
    assert jsonops.Matching({"x[*]": a})(texts) == [True] + 2 * [False] + [False] + 8 * [False]
    assert jsonops.Matching({"x[*]": none})(texts) == [False] * 4 + [True, True] + [False] * 6
    assert jsonops.Matching({"x[*]": "1.50"})(texts) == [False] * 11 + [True]
    assert jsonops.Matching({"x[*]": a, "x[1]": "b"})(texts) == [True] + [False] * 11
    assert len(calls) == 4


def test_documents_are_matched_on_all_cores(spark):
    """the test of fields moved below the repartition of a small table, into the one task that reads it."""
    plan = queries.QUERIES["field_hash_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert 0 <= plan.find("ArrowEvalPython") < plan.find("Exchange")


def sorted_columns(spark, place: str) -> list[str]:
    """What the sorts of the last write to a folder held."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [p for p in (runs.apply(i).physicalPlanDescription() for i in range(runs.size())) if "InsertIntoHadoopFsRelationCommand" in p and f"{place}, " in p]
    return [c.split("#")[0] for inner in re.findall(r"\n\(\d+\) Sort[^\n]*\nInput \[\d+\]: \[(.*)\]", plans[-1]) for c in inner.split(", ")]


def test_sort_of_arrays_is_narrow(spark, tmp_path):
    """labels and all other columns were made before the sort of a write, which held them."""
    store = DataStore(spark, str(tmp_path))
    rows = [("d e", "k2", "b\0c", ["X"]), ("d e", "k1", "a", None), (None, "k1", "a", None), ("d e", None, "z", None)]
    store.blobs.put(spark.createDataFrame(rows, "dataset string, key string, value string, labels array<string>").coalesce(1).withColumn("dataset", F.lit("d e")), "ARR")
    assert set(sorted_columns(spark, f"{tmp_path}/blobs")) == {"dataset", "kind", "key", "value", "labels"}  # labels as they are given
    out = [(r.dataset, r.kind, r.key, r.type, r.value, r.labels, r.version) for r in store.tables._load("blobs").collect()]
    shard = hashing.shard_of
    own = ["ADM", "D_E_RAW_DATA"]
    assert out == [("d e", "ARR", None, None, "z", own, 1)] + [("d e", "ARR", "k1", shard("k1"), "a", own, 1)] * 2 + [("d e", "ARR", "k2", shard("k2"), "b\0c", ["X", *own], 1)]
    store.blobs.put(spark.range(3).select(F.lit("n").alias("dataset"), F.col("id").cast("string").alias("key"), F.lit("v").alias("value")), "ARR")
    assert set(sorted_columns(spark, f"{tmp_path}/blobs")) <= {"dataset", "kind", "key", "value"}


def test_sort_of_postings_is_narrow_and_of_a_set_size(spark, tmp_path, monkeypatch):
    """so it was for postings; and few tasks had all rows, however many there were."""
    monkeypatch.setattr(shared, "PIECE_BYTES", 2000)
    store = DataStore(spark, str(tmp_path))
    c = spark.read.parquet(f"{SF}/customer.parquet")
    store.persist(c.select(F.lit("c").alias("dataset"), F.col("c_custkey").cast("string").alias("doc_id"), F.to_json(F.struct("c_name", F.struct("c_mktsegment").alias("x"))).alias("json")), sinks=("postings",))
    assert not {"labels", "term_num", "version"} & set(sorted_columns(spark, f"{tmp_path}/postings"))
    posted = store.tables.read("postings").where("way = 'f'")
    assert len(posted.inputFiles()) > 8
    rows = {(r.doc_id, r.field, r.term): (r.n, r.labels) for r in posted.collect()}
    assert rows["7", "x¤c_mktsegment", next(t for d, f, t in rows if d == "7" and f[0] == "x")] == (1, ["ADM", "C_X", "C_X_C_MKTSEGMENT", "C_7"])
    assert rows["7", "c_name", "customer"] == (1, ["ADM", "C_C_NAME", "C_7"])
    assert len(rows) == posted.count() == 3 * c.count()


def test_shards_of_many_keys():
    draw = random.Random(2)
    keys = ["", "a", "é", "日本", "😀x", "x" * 300, *("".join(draw.choices("0123456789aé😀", k=draw.randrange(40))) for _ in range(2000))]
    assert hashing.shards_of(keys).tolist() == [hashing.shard_of(k) for k in keys]
    assert hashing.shards_of([]).tolist() == []


def test_labels_of_texts(spark):
    """a label is made without its regular expressions where nothing is to be replaced."""
    texts = ["plain_Text9", "a b", " a\t\nb ", "x[3]", "x[*]¤y z", "é", "a😀b", "", "_", "[1]", "a-b.c", " "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", security.label_column(F.col("t")).alias("label"))
    assert {r.t: r.label for r in rows.collect()} == {t: security.label(t) for t in texts[:-1]} | {" ": "_"}
