import random
import re

import numpy as np
import pyarrow as pa
import pytest
from corvane.llm import suffixes as S

SCHEMA = "doc_id long, text string, start_word string, cuts int"


def brute(rows, depth):
    """{(doc_id, start, end, extra)} by comparing all windows."""
    words = {}
    for i, t in rows:
        if i is not None and t is not None:
            words[i, t] = re.findall(r"[^ \t\n\r\x0b\x0c]+", t)
    where = {}
    for key in words:
        w = words[key]
        for s in range(len(w) - depth + 1):
            where.setdefault(tuple(w[s : s + depth]), []).append((key[0], int(S.text_hashes(*S.utf8(pa.array([key[1]])))[0]), s, key))
    covered = {}
    for places in where.values():
        if len(places) > 1:
            for n, (_, _, s, key) in enumerate(sorted(places, key=lambda p: p[:3])):
                covered.setdefault((key, n > 0), []).append(s)
    out = set()
    for (key, extra), starts in covered.items():
        runs = []
        for s in sorted(starts):
            if runs and s <= runs[-1][1]:
                runs[-1][1] = s + depth
            else:
                runs.append([s, s + depth])
        out |= {(key[0], a, b, extra) for a, b in runs}
    return out


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["été", "a.b", "|"]
    shared = [[rng.choice(vocabulary) for _ in range(rng.randrange(5, 40))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 30))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(shared)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    return [*rows, (None, rows[0][1]), (900, None), (901, ""), (902, "   "), (903, "x " * 300), (0, rows[1][1]), rows[2], (904, "one")]


@pytest.mark.parametrize("depth", [2, 7, 12])
def test_equals_brute_force(spark, depth):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "e", 1) for i, t in rows], SCHEMA)
    got = {tuple(r) for r in S.repeated(docs, depth).collect()}
    assert got == brute(rows, depth)


@pytest.mark.parametrize("hot_rows, broadcast", [(0, 10), (2, 10), (8, 0)])
def test_hot_anchors_equal_brute_force(spark, monkeypatch, hot_rows, broadcast):
    monkeypatch.setattr(S, "BROADCAST_ROWS", broadcast)
    rows = corpus(3) + [corpus(3)[7]] * 40
    docs = spark.createDataFrame([(i, t, "e", 1) for i, t in rows], SCHEMA)
    got = [tuple(r) for r in S.spans(docs, 7, hot_rows).select("doc_id", "start_word", "end_word", "extra").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 7)
    text = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    assert S.hot_anchors(text, 7, 8).count() < S.hot_anchors(text, 7, 2).count() < S.hot_anchors(text, 7, 0).count()


def test_empty_and_bad_depth(spark):
    assert S.repeated(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        S.repeated(spark.createDataFrame([], SCHEMA), 1)


def test_long_text_and_hot_group(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{i}a {passage} {i}b") for i in range(500)] + [(1000, " ".join(map(str, range(100_000))) + " " + passage)]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA).repartition(5)
    got = {tuple(r) for r in S.repeated(docs).collect()}
    assert got == {(0, 1, 61, False)} | {(i, 1, 61, True) for i in range(1, 500)} | {(1000, 100_000, 100_060, True)}


def test_without_repeats(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(1, f"a {passage} b", "x", 3), (2, f"c {passage}", None, None), (3, passage, "z", 1), (None, passage, "n", 2), (4, None, "n", 2), (5, "ü only", "n", 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = S.without_repeats(docs, 10)
    assert out.schema == docs.schema
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted([(1, f"a {passage} b", "x", 3), (2, "c ", None, None), (3, "", "z", 1), (None, passage, "n", 2), (4, None, "n", 2), (5, "ü only", "n", 2)], key=str)


def test_streamed_keeps_groups_together():
    value = np.sort(np.random.default_rng(0).integers(0, 30, 1000))
    batches = [pa.record_batch([pa.array(value[i : i + 7])], ["k"]) for i in range(0, 1000, 7)]
    got = [b.column(0).to_numpy() for b in S._streamed(iter(batches), [0], 50)]
    assert np.array_equal(np.concatenate(got), value)
    assert all(a[-1] != b[0] for a, b in zip(got, got[1:]))


def test_sf_table_equals_sql(spark):
    import duckdb
    from corvane.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as from '{sf}/documents.parquet'")
    want = sorted(con.execute(queries.ORACLE_SQL["op2_suffixes"]).fetchall())
    names = [d[0] for d in con.description]
    got = sorted(tuple(r) for r in queries.QUERIES["op2_suffixes"](spark, sf).select(*names).collect())
    assert want and got == want
