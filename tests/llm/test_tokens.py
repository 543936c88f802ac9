import glob

import pyarrow.parquet as pq
import pytest
from corvane.llm import bpe, tokens
from pyspark.sql import functions as F

SCHEMA = "doc_id long, n_tokens int, token_ids array<int>, token_ends array<int>, lang string"
ROWS = [(3, 3, [5, 5, 9], [1, 4, 6], "e"), (1, 0, [], [], None), (None, 2, [7, None], [1, 2], "n"), (2, 0, None, None, "x"), (3, 3, [5, 5, 9], [1, 4, 6], "e")]


def facts(path):
    out = []
    for f in sorted(glob.glob(f"{path}/*.parquet")):
        file = pq.ParquetFile(f)
        for g in range(file.metadata.num_row_groups):
            group = file.metadata.row_group(g)
            out.append({group.column(c).path_in_schema: group.column(c) for c in range(group.num_columns)})
    return out


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_round_trip_and_encodings(spark, tmp_path, encoding):
    path = str(tmp_path / "t")
    tokens.write(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), path, tokens.ENCODINGS | {"token_ids": encoding})
    got = [tuple(r) for r in tokens.read(spark, path).collect()]
    assert got == sorted(ROWS, key=lambda r: r[0] or 0)
    [group] = facts(path)
    ids, ends = (group[f"{c}.list.element"] for c in ("token_ids", "token_ends"))
    assert ("RLE_DICTIONARY" in ids.encodings) == (encoding == "dictionary") and ("DELTA_BINARY_PACKED" in ids.encodings) == (encoding == "delta")
    assert "DELTA_BINARY_PACKED" in ends.encodings and group["doc_id"].has_offset_index and group["doc_id"].has_column_index


def test_row_groups_and_selective_reads(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(20_000).repartition(1).selectExpr("id as doc_id", "20 as n_tokens", "transform(sequence(1, 20), x -> cast(hash(id, x) % 50000 as int)) as token_ids")
    tokens.write(rows, path, row_group=1 << 18, page=1 << 13)
    groups = facts(path)
    assert len(groups) > 3 and sum(g["doc_id"].num_values for g in groups) == 20_000
    ranges = [(g["doc_id"].statistics.min, g["doc_id"].statistics.max) for g in groups]
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    some = tokens.read(spark, path, ["doc_id", "token_ids"], F.col("doc_id").between(5000, 5010))
    assert some.count() == 11
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,5000)" in plan
    meta = tokens.metadata(tokens.read(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert "token_ids" not in meta


def test_empty_and_wrong(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    tokens.write(empty, str(tmp_path / "e"))
    assert tokens.read(spark, str(tmp_path / "e")).count() == 0
    for wrong in ({"encodings": {"token_ids": "plain"}}, {"row_group": 0}):
        with pytest.raises(ValueError):
            tokens.write(empty, str(tmp_path / "w"), **wrong)


def brute(path, ids):
    """{doc_id: rows} of some ids and the files that hold them, by reading every file whole."""
    rows, files = {}, {}
    for f in glob.glob(f"{path}/*.parquet"):
        for r in pq.ParquetFile(f).read().to_pylist():
            if r["doc_id"] in ids:
                rows.setdefault(r["doc_id"], []).append((r["n_tokens"], r["token_ids"], r["token_ends"]))
                files.setdefault(r["doc_id"], set()).add(f)
    return rows, files


def test_query_is_every_token_and_a_lookup_opens_one_file(spark, tmp_path):
    import tiktoken
    import tiktoken.load
    from corvane.llm import queries

    sf = "/root/testdata/sf0.001"
    ranks = tiktoken.load.load_tiktoken_bpe(bpe.DEFAULT_VOCABULARY)
    known = tiktoken.Encoding("b", pat_str=r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.token_ids) for r in queries.QUERIES["op9_tokens"](spark, sf).collect()}
    assert got.keys() == texts.keys()
    ends_of = {r.doc_id: r.token_ends for r in tokens.output(spark.read.parquet(f"{sf}/documents.parquet"), ends=True).collect()}
    for i, text in texts.items():
        ids = known.encode_ordinary(text)
        ends, at = [], 0
        for t in ids:
            at += len(known.decode_single_token_bytes(t))
            ends.append(at)
        assert got[i] == (len(ids), ids) and ends_of[i] == ends

    path = str(tmp_path / "r")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(7)
        stored = tokens.output(docs, path=path, ends=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(glob.glob(f"{path}/*.parquet")) > 1
    ids = sorted(texts)[::9]
    rows, files = brute(path, set(ids))
    assert all(len(f) == 1 for f in files.values())
    for i in ids:
        assert [tuple(r) for r in tokens.read(spark, path, ["n_tokens", "token_ids", "token_ends"], F.col("doc_id") == i).collect()] == rows[i]
    assert stored.columns == ["doc_id", "n_tokens", "token_ids", "token_ends"]
    tokens.remove(spark, path)
    assert not glob.glob(path)


def test_one_doc_id_may_be_several_ranges(spark):
    docs = spark.range(4000).selectExpr("if(id % 3 = 0, id, 7) as doc_id", "concat('text ', id) as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r[0] for r in tokens.by_id(docs).groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 4000 and max(sizes) < 2000


def test_output_decodes_to_the_texts(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stored = tokens.output(docs, path=str(tmp_path / "o"))
    want = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.text for r in bpe.decode(stored).collect()} == want
    odd = spark.createDataFrame([(1, None, 1), (None, "a", 2), (2, "", 3), (3, "word " * 100_000, 4)], "doc_id long, text string, token_ids int")
    got = {r.doc_id: (r.n_tokens, r.token_ids is None) for r in tokens.output(odd).select("doc_id", "n_tokens", "token_ids").collect()}
    assert got[1] == (0, True) and got[2] == (0, False) and got[None] == (1, False) and got[3][0] >= 100_000
