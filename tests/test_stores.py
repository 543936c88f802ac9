"""Stores: what is kept, what is replaced, what is masked, and who may do it."""

import glob
import gzip
import os

import pyarrow as pa
import pytest
from corvane import admin
from corvane.cache import BloomFilters
from corvane.functions import hashing
from corvane.functions import text as T
from corvane.operators import jobs, scans
from corvane.operators import tables as tb
from corvane.operators.stores import DataStore
from corvane.plans.language import build
from corvane.plans.planner import Planner
from corvane.sources import cells, files
from corvane.streaming import ingest
from pyspark.sql import functions as F

RAW = "dataset string, doc_id string, json string"
VALUE = "dataset string, key string, value string"
TERMS = "dataset string, doc_id string, field string, term string, n int"
ALL = {"ADM"}


@pytest.fixture
def store(spark, tmp_path):
    return DataStore(spark, str(tmp_path / "store"))


def docs(spark, *rows):
    return spark.createDataFrame([("d", i, j) for i, j in rows], RAW)


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def terms(store, pattern, dataset="d"):
    return sorted((r.doc_id, r.field, r.term, r.n) for r in store.terms.terms(ALL, dataset, pattern).collect())


def test_persist_keeps_what_it_does_not_replace(spark, store):
    store.persist(docs(spark, ("1", '{"a":"one john"}'), ("2", '{"a":"two"}')))
    store.blobs.put(spark.createDataFrame([("d", "1", "text")], VALUE), "STR")
    store.blobs.put(spark.createDataFrame([("d", "1", "x\0y")], VALUE), "ARR")
    store.blobs.put(spark.createDataFrame([("d", "1", bytearray(b"ab"))], "dataset string, key string, value binary"), "FIL")
    store.terms.put(spark.createDataFrame([("d", "1", "f", "hand", 2)], TERMS))
    store.persist(docs(spark, ("1", '{"a":"three"}'), ("3", '{"a":"john"}')))
    raw = {"D_RAW_DATA", "D_RAW_FILE"}
    assert store.blobs.strings(raw, "d").count() == store.blobs.arrays(raw, "d").count() == store.blobs.files(raw, "d").count() == 1
    assert terms(store, "hand") == [("1", "f", "hand", 2)]
    assert ids(store.query(ALL, "d", "john")) == ["3"] and ids(store.query(ALL, "d", "three")) == ["1"] and ids(store.query(ALL, "d", "*wo")) == ["2"]
    assert store.estimate(ALL, "d", '"john"') == 1 and store.estimate(ALL, "d", '"one"') == 0 and store.estimate(ALL, "d", '"hand"') == 1
    assert {r.key: r.value for r in store.jsons({"D_RAW_DATA"}, "d").collect()} == {"1": '{"a":"three"}', "2": '{"a":"two"}', "3": '{"a":"john"}'}
    assert ids(store.match_value("d", "a", "john")) == ["3"] and ids(store.match_value("d", "a", "one john")) == []
    before = terms(store, "t*"), store.estimate(ALL, "d", "john")
    store.compact()
    assert (terms(store, "t*"), store.estimate(ALL, "d", "john")) == before and not store.tables.exists("stale")
    assert store.blobs.strings(raw, "d").count() == store.blobs.arrays(raw, "d").count() == 1


def test_a_document_without_terms_leaves_none_behind(spark, store):
    store.persist(docs(spark, ("1", '{"a":"john"}')))
    store.persist(docs(spark, ("1", '{"_y":"nothing"}')))
    assert ids(store.query(ALL, "d", "john")) == [] and store.estimate(ALL, "d", '"john"') == 0 and ids(store.match_value("d", "a", "john")) == []
    store.reindex("d")
    assert ids(store.query(ALL, "d", "john")) == [] and store.jsons({"D_RAW_DATA"}, "d").first().value == '{"_y":"nothing"}'


def test_the_last_of_a_batch_counts_in_every_table(spark, store):
    rows = [("d", "1", f'{{"a":"v{i}"}}', i) for i in range(9)]
    store.persist(spark.createDataFrame(rows, RAW + ", at int").repartition(4), order="at")
    assert store.jsons({"D_RAW_DATA"}, "d").first().value == '{"a":"v8"}' and [t[2] for t in terms(store, "v*")] == ["v8"] and ids(store.match_value("d", "a", "v8")) == ["1"]
    store.persist(spark.createDataFrame(rows[::-1], RAW + ", at int").coalesce(1))
    assert store.jsons({"D_RAW_DATA"}, "d").first().value == '{"a":"v0"}' and [t[2] for t in terms(store, "v*")] == ["v0"]
    store.persist(spark.createDataFrame([(None, "1", "{}"), ("d", None, "{}"), ("d", "4", "no json"), ("d", "5", None)], RAW))
    assert {r.key for r in store.jsons({"D_RAW_DATA"}, "d").collect()} == {"1", "4", "5"}


def test_terms_are_summed_and_counted(spark, store):
    rows = [("d", "1", "f", "john", 2), ("d", "1", "f", "john", 3), ("d", "2", "f", "johnny", 1), ("d", "2", "f", None, 1), ("d", "2", "f", "", 1)]
    store.terms.put(spark.createDataFrame(rows, TERMS))
    store.terms.put(spark.createDataFrame(rows[:1], TERMS))
    assert terms(store, "john") == [("1", "f", "john", 7)] and terms(store, "*hnny") == [("2", "f", "johnny", 1)]
    assert {r.term: r.n_docs for r in store.terms.counts(ALL, "d", "john*").collect()} == {"john": 3, "johnny": 1}
    assert store.estimate(ALL, "d", "john") == 3 and {r.term for r in store.terms.counts_between(ALL, "d", "johnn", None).collect()} == {"johnny"}
    with pytest.raises(Exception, match="n has to be positive"):
        store.terms.put(spark.createDataFrame([("d", "1", "f", "x", 0)], TERMS))
    assert terms(store, "x") == []
    labelled = spark.createDataFrame([("e", "1", "f", "a", 1, ["E_1"], ["E_F"])], TERMS + ", labels array<string>, field_labels array<string>")
    store.terms.put(labelled)
    seen = lambda auths: (store.terms.terms(auths, "e", "a").count(), store.terms.counts(auths, "e", "a").count())
    assert seen({"E_1"}) == (1, 0) and seen({"E_F"}) == (1, 1) and seen({"E_X"}) == (0, 0)
    numbers = spark.createDataFrame([("n", "1", "f", "5", 1, 2), ("n", "2", "f", "11", 1, 2)], TERMS + ", term_type int")
    store.terms.put(numbers)
    assert [r.term for r in store.terms.terms_between(ALL, "n", 4, 12, ordered=True).collect()] == ["5", "11"]
    assert store.terms.terms(ALL, "n", "*1").count() == 0


def test_sinks_are_independent(spark, store):
    store.persist(docs(spark, ("1", '{"a":"john"}')), sinks=("counts",))
    assert not store.tables.exists("postings") and not store.tables.exists("blobs") and store.estimate(ALL, "d", "john") == 1
    with pytest.raises(ValueError):
        store.persist(docs(spark), sinks=("bytes",))


def test_index_tokenizer_and_kept_fields(spark, store):
    store.persist(docs(spark, ("1", '{"a":"Été Ñandú","b":"left out"}')), keep=F.col("path") == "a", tokenizer=T.normal_terms)
    assert [t[2] for t in terms(store, "ete*")] == ["ete nandu"] and terms(store, "left*") == []
    got = spark.createDataFrame([("Ça, Ώ Ёж é",)], "t string").select(T.normalize(F.col("t"))).first()[0]
    assert got == "ca, ω еж e"


def test_a_failed_write_is_never_read(spark, store):
    store.persist(docs(spark, ("1", '{"a":"john"}')))
    version = store.tables.begin()
    store.tables.append("blobs", spark.createDataFrame([("d", "JSO", "1", "JSO", '{"a":"half"}', ["ADM", "D_RAW_DATA"], version)], "dataset string, kind string, key string, type string, value string, labels array<string>, version bigint"))
    assert store.jsons({"D_RAW_DATA"}, "d").first().value == '{"a":"john"}' and store.tables.unfinished() == [version]
    store.persist(docs(spark, ("2", '{"a":"jane"}')))
    assert store.jsons({"D_RAW_DATA"}, "d").count() == 2


def test_empty_batches_and_clashing_columns(spark, store):
    assert store.persist(docs(spark).limit(0)) == 1
    more = docs(spark, ("1", '{"a":"x"}')).withColumn("version", F.lit(9)).withColumn("term", F.lit("t")).withColumn("_by", F.lit(1))
    store.persist(more)
    assert ids(store.query(ALL, "d", "x")) == ["1"]


def test_row_operations(spark, store):
    store.terms.put(spark.createDataFrame([("d", str(i), f, t, 1) for i, (f, t) in enumerate([("f", "a"), ("f", "b"), ("g", "c"), ("g", "d"), ("g", "é")])], TERMS))
    left = lambda: sorted({r.term for r in store.tables.read("postings").collect()})
    store.tables.delete_rows("postings", "b", "c")
    assert left() == ["a", "b", "d", "é"]
    store.tables.delete_rows("postings", "b", "b", "d")
    assert left() == ["a", "d", "é"]
    store.tables.delete_rows("postings", end="a")
    assert left() == ["d", "é"]
    store.tables.remove_ranges("postings", [("c", "d")], "other")
    assert left() == ["d", "é"]
    store.tables.remove_ranges("postings", [("c", "d"), ("x", "y")])
    assert left() == ["é"]
    store.tables.remove_cells("counts", "b", "f")
    assert sorted({r.term for r in store.tables.read("counts").collect()}) == ["a", "c", "d", "é"]
    store.tables.remove_families("counts", ["g"])
    assert sorted({r.term for r in store.tables.read("counts").collect()}) == ["a"]
    store.tables.remove_cells("postings", qualifier="4")
    assert left() == [] and store.tables.exists("postings")
    with pytest.raises(ValueError):
        store.tables.remove_cells("postings")
    store.blobs.put(spark.createDataFrame([("d", "k", "v")], VALUE), "STR")
    store.tables.remove_families("blobs", ["JSO"])
    assert store.blobs.strings({"D_RAW_DATA"}, "d").count() == 1
    store.tables.delete_rows("blobs")
    assert store.blobs.strings({"D_RAW_DATA"}, "d").count() == 0
    store.tables.delete_rows("hashes", "a")


def test_a_rewrite_touches_its_dataset_alone(spark, store):
    for name in ("d", "e/f g"):
        store.blobs.put(spark.createDataFrame([(name, str(i), "v") for i in range(5)], VALUE), "STR")
    own = lambda n: sorted(glob.glob(f"{store.tables.path}/blobs/dataset={n}*/**/*.parquet", recursive=True))
    before = own("d")
    store.tables.delete_rows("blobs", "1", "3", "e/f g")
    assert own("d") == before and {r.key for r in store.blobs.strings({"E_F_G_RAW_DATA"}, "e/f g").collect()} == {"0", "1", "4"}
    store.tables.delete_rows("blobs", dataset="e/f g")
    assert own("d") == before and store.tables.read("blobs").count() == 5 and not glob.glob(f"{store.tables.path}/_blobs*")
    jobs.sink(store.tables, "own", spark.createDataFrame([("x", 1)], "a string, b int"))
    with pytest.raises(ValueError):
        store.tables.rewrite("own", "d", F.lit(True))


def test_tables(spark, store):
    t = store.tables
    assert t.create("blobs") and not t.create("blobs") and t.all() == ["blobs"] and t.read("blobs").count() == 0
    store.blobs.put(spark.createDataFrame([("d", "k", "v"), ("e", "k", "w")], VALUE), "STR")
    store.blobs.put(spark.createDataFrame([("d", "k", "v")], VALUE), "ARR")
    assert t.locality_groups("blobs") == {"ARR": ["ARR"], "STR": ["STR"]}
    assert t.clone("blobs", "copy") and not t.clone("blobs", "copy") and not t.clone("none", "x")
    assert t.rename("copy", "other") and not t.rename("copy", "again") and t.all() == ["blobs", "other"]
    t.remove_dataset("other", "d")
    assert t.read("other").count() == 1 and t.read("blobs").count() == 3
    t.delete_rows("other", end="z")
    assert t.read("other").count() == 0
    assert t.delete("other") and not t.delete("other") and not t.exists("other")
    assert t.create("own", "a string, b int") and t.read("own").columns == ["a", "b"]
    jobs.sink(t, "own", spark.createDataFrame([("x", 1)], "a string, b int"))
    assert t.read("own").count() == 1


def test_splits_and_options(spark, store):
    store.tables.split("postings", ["g", "p"])
    store.tables.split("postings", ["g", "t"])
    store.tables.bloom_filter("postings")
    assert store.tables.splits("postings") == ["g", "p", "t"]
    store.terms.put(spark.createDataFrame([("d", "1", "f", c, 1) for c in "abghpqtuz"], TERMS))
    found = []
    import pyarrow.parquet as pq

    for f in glob.glob(f"{store.tables.path}/postings/dataset=d/way=f/*.parquet"):
        found.append("".join(sorted(pq.ParquetFile(f).read(["term"]).column(0).to_pylist())))
    assert sorted(found) == ["abg", "hp", "qt", "uz"]
    store.tables.block_cache("postings")
    assert store.tables.read("postings").where("way = 'f'").count() == 9
    spark.catalog.clearCache()


def test_groups_of_families_and_writer_options(spark, store):
    import pyarrow.parquet as pq

    store.tables.set_locality_groups("postings", {"names": ["b", "d"]})
    store.tables.tune("postings", compression="zstd", parquet_block_size=1 << 20)
    store.terms.put(spark.createDataFrame([("d", "1", f, t, 1) for t, f in zip("stuvwxyz", "abcdabcd")], TERMS).coalesce(1))
    [file] = glob.glob(f"{store.tables.path}/postings/dataset=d/way=f/*.parquet")
    assert pq.ParquetFile(file).read(["field", "term"]).to_pylist() == [{"field": f, "term": t} for f, t in zip("bdbdacac", "tvxzsuwy")]
    assert pq.ParquetFile(file).metadata.row_group(0).column(0).compression == "ZSTD"
    assert store.tables.locality_groups("postings") == {"b": ["b"], "f": ["f"], "names": ["b", "d"]}


def test_permissions_are_checked(spark, tmp_path):
    path = str(tmp_path / "s")
    open_store = DataStore(spark, path)
    open_store.create()
    registry = admin.Registry(str(tmp_path / "users.json"))
    registry.create("u")
    store = DataStore(spark, path, registry, "u")
    row = docs(spark, ("1", '{"a":"x"}'))
    for act in (lambda: store.persist(row), lambda: store.query(ALL, "d", "x"), lambda: store.jsons(ALL, "d"), store.destroy, store.compact, lambda: store.remove("d"), lambda: store.cache.read("d", "c"), lambda: store.tables.rename("blobs", "b"), lambda: store.tables.create("b", "a int"), lambda: store.grant("u", "cache", "READ")):
        with pytest.raises(PermissionError):
            act()
    for t in ("blobs", "postings", "counts", "hashes"):
        registry.grant("u", "WRITE", t)
    store.persist(row)
    with pytest.raises(PermissionError):
        store.query(ALL, "d", "x")
    registry.grant("u", "GRANT", "cache")
    for table in admin.STORES["termstore"]:
        registry.grant("u", "GRANT", table)
    store.grant("u", "termstore", "READ")
    assert ids(store.query(ALL, "d", "x")) == ["1"]
    store.revoke("u", "termstore", "READ")
    with pytest.raises(PermissionError):
        store.query(ALL, "d", "x")
    stranger = DataStore(spark, path, registry, "nobody")
    with pytest.raises(PermissionError):
        stranger.jsons(ALL, "d")
    registry.grant("u", "CREATE_TABLE")
    assert store.tables.create("mine", "a int")


def test_command_line(spark, tmp_path):
    place, source = str(tmp_path / "s"), tmp_path / "in.jsonl"
    source.write_text('{"id":"1","x":"one"}\n{"id":"2","x":"two"}\n')
    run = lambda *a: admin.main([*a, "--store", place], spark)
    run("create_user", "--user", "u")
    with pytest.raises(PermissionError):
        run("create", "--user", "u")
    run("create")
    with pytest.raises(PermissionError):
        run("ingest", "--user", "u", "--dataset", "my-data", "--file", str(source))
    run("blobstore_grant_write_permission", "--user", "u")
    run("termstore_grant_write_permission", "--user", "u")
    run("ingest", "--user", "u", "--dataset", "my-data", "--file", str(source), "--hash")
    assert {r.key for r in DataStore(spark, place).jsons({"MY_DATA_RAW_DATA"}, "my-data").collect()} == {hashing.hash_text("1"), hashing.hash_text("2")}
    for wrong in (["ingest_many", "--dataset", "a,b", "--file", str(source)], ["backup_many", "--dataset", "a", "--file", "x,y"], ["ingest"]):
        with pytest.raises(ValueError):
            run(*wrong)
    with pytest.raises(PermissionError):
        run("backup", "--user", "u", "--dataset", "my-data", "--file", str(tmp_path / "out"))
    run("blobstore_grant_read_permission", "--user", "u")
    run("backup", "--user", "u", "--dataset", "my-data", "--file", str(tmp_path / "out"))
    lines = [x for p in glob.glob(str(tmp_path / "out/*.gz")) for x in gzip.open(p, "rt").read().splitlines()]
    assert sorted(lines) == sorted(source.read_text().splitlines())
    run("ingest_many", "--dataset", "a,b", "--file", f"{source},{source}", "--split")
    store = DataStore(spark, place)
    assert store.tables.splits("postings") == sorted(admin.SPLITS) and ids(store.query(ALL, "b", "two")) == ["2"]
    run("truncate")
    assert store.is_ready() and store.tables.read("blobs").count() == 0 and ids(store.query(ALL, "b", "two")) == []
    run("destroy")
    assert not store.is_ready()
    own = admin.Configuration(place, app="x")
    assert own.spark is spark and own.store().tables.path == place


def test_cache_writes_some_at_once_and_the_rest_later(spark, store):
    later = store.cache.write("d", "c", spark.createDataFrame([(f"v{i:02d}",) for i in range(20)] + [(None,)], "v string"), delegate_after=5)
    assert store.cache.read("d", "c", limit=5).count() == 5
    later.result(60)
    assert [r.key for r in store.cache.read("d", "c", "v18").collect()] == ["v18", "v19"] and store.cache.read("d", "c").count() == 21
    assert store.cache.write("d", "h", spark.createDataFrame([("a",), ("a",)], "v string"), hashed=True) is None
    assert [(r.key, r.value) for r in store.cache.read("d", "h").collect()] == [(hashing.hash_text("a"), "a")]


def test_jobs(spark, store):
    store.persist(docs(spark, *[(str(i), f'{{"a":"word w{i % 3}","b":{i}}}') for i in range(9)]))
    rows = jobs.source(store.tables, "postings", {"D_A"}, F.col("way") == "f", ["term", "n", "field"])
    assert {r.field for r in rows.select("field").distinct().collect()} == {"a"}

    def upper(batch):
        return pa.RecordBatch.from_arrays([pa.compute.utf8_upper(batch.column(0)), batch.column(1)], ["term", "n"])

    def count(key, batches):
        n, total = 0, 0
        for b in batches:
            n, total = n + b.num_rows, total + sum(b.column(1).to_pylist())
        return pa.RecordBatch.from_pydict({"term": [key[0]], "rows": [n], "n": [total]})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        mapped = jobs.mapped(rows.drop("field"), upper, "term string, n long")
        got = {tuple(r) for r in jobs.reduced(mapped, ["term"], count, "term string, rows long, n long").collect()}
        assert got == {("WORD", 9, 9), ("W0", 3, 3), ("W1", 3, 3), ("W2", 3, 3)}
        one = {tuple(r) for r in jobs.reduced(mapped, ["term"], count, "term string, rows long, n long", [F.sum("n").alias("n")]).collect()}
        assert one == {("WORD", 1, 9), ("W0", 1, 3), ("W1", 1, 3), ("W2", 1, 3)}
        summed = lambda key, batches: pa.RecordBatch.from_pydict({"term": [key[0]], "n": [sum(sum(b.column("n").to_pylist()) for b in batches)]})
        assert {tuple(r) for r in jobs.reduced(mapped, ["term"], summed, "term string, n long", salts=3).collect()} == {("WORD", 9), ("W0", 3), ("W1", 3), ("W2", 3)}
        lazy = lambda key, batches: pa.RecordBatch.from_pydict({"term": [key[0]]})
        assert jobs.reduced(mapped, ["term"], lazy, "term string").count() == 4
        assert jobs.reduced(mapped.limit(0), ["term"], count, "term string, rows long, n long").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_cells_go_out_and_come_in(spark, store):
    store.persist(docs(spark, ("1", '{"a":"john doe","b":5}')))
    store.blobs.put(spark.createDataFrame([("d", "k", bytearray(b"ab"))], "dataset string, key string, value binary"), "FIL")
    t = store.tables
    own = ["dataset", "way", "doc_id", "field", "term_type", "term", F.array_sort("labels").alias("labels"), "n"]
    rows = lambda df: sorted(map(str, df.collect()))
    postings = t.read("postings")
    assert rows(cells.terms_from_cells(cells.term_cells(postings))) == rows(postings.select(*own))
    counts = t.read("counts").select("dataset", "way", "field", "term_type", "term", F.array_sort("labels").alias("labels"), "n_docs")
    assert rows(cells.counts_from_cells(cells.count_cells(t.read("counts")))) == rows(counts)
    blobs = t.read("blobs").select("dataset", "key", "type", "kind", "properties", F.array_sort("labels").alias("labels"), "value")
    assert rows(cells.blobs_from_cells(cells.blob_cells(t.read("blobs")))) == rows(blobs)
    odd = spark.createDataFrame([("d\0nhoj", "BIDX", "1\0f", " A | B ", "3\x001\x002"), ("bad", "FIDX", "1\0f", "", "1"), ("d\0x", "FIDX", "1", "", "1")], "row string, family string, qualifier string, visibility string, value string")
    assert [tuple(r) for r in cells.terms_from_cells(odd).collect()] == [("d", "b", "1", "f", 0, "john", ["A", "B"], 3)]
    assert cells.blobs_from_cells(odd).count() == 0
    text = spark.createDataFrame([("a\0b",), (None,), ("",)], "t string")
    assert [r[0] for r in text.select(cells.encode(F.col("t"))).collect()] == ["a\\u0000b", None, ""]
    assert [r[0] for r in text.select(cells.decode(cells.encode(F.col("t")))).collect()] == ["a\0b", None, ""]


def test_scans(spark):
    rows = spark.range(100).select((F.col("id") * 7 % 100).alias("k")).repartition(6)
    assert [(r.k, r["index"]) for r in scans.indexed(rows, ["k"]).orderBy("k").collect()] == [(i, i) for i in range(100)]
    assert scans.first(rows, ["k"]).first().k == 0
    assert [r.k for r in scans.until(rows, "k", F.col("k") >= 3).collect()] == [0, 1, 2] and scans.until(rows, "k", F.lit(False)).count() == 100
    table = spark.createDataFrame([("TERM_1", "D_1", "Q", "f", '{"a":1,"b":2}'), ("TERM_2", "D_2", "Q", "g", "x")], "row string, family string, qualifier string, field string, value string")
    assert scans.apply(table, "wildcard", {"row": "*_1", "family": "D_?", "and": "true"}).count() == 1 and scans.apply(table, "wildcard", {"row": "*_1", "family": "D_?"}).count() == 2
    assert scans.apply(table, "fields", {"fields": "f,h*"}).count() == 1 and scans.apply(table, "project", {"fields": "a"}).first().value == '{"a":1}'
    assert "MASKED_" in scans.apply(table, "mask", {"dataset": "d", "auths": "D_A"}).first().value
    aged = table.withColumn("ts", F.current_timestamp() - F.expr("interval 2 hours"))
    assert scans.apply(aged, "age_off", {"ttl": "3", "units": "HOURS"}).count() == 2 and scans.apply(aged, "age_off", {"ttl": "1", "units": "HOURS"}).count() == 0
    for name, options in (("age_off", {"ttl": "1"}), ("wildcard", {"column": "x"})):
        with pytest.raises(ValueError):
            scans.apply(table, name, options)


def test_queries_are_one_scan(spark):
    table = spark.createDataFrame([("1", "f", 1, "a", None, "f", None)], "doc_id string, field string, term_type int, term string, term_num decimal(38,18), way string, term_rev string")
    table.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.sql.warehouse.dir').removeprefix('file:')}_one_scan")
    plan = Planner(spark.read.parquet(path), secure=False).ids(build("(a* OR *b) AND NOT (c OR f:[1 TO 2])"))._jdf.queryExecution()
    text = plan.optimizedPlan().toString()
    assert text.count("Relation [") == 1 and text.count("Aggregate") == 1 and "Join" not in text
    for f in glob.glob(f"{path}/*") + glob.glob(f"{path}/.*"):
        os.remove(f)
    os.rmdir(path)


def test_an_estimate_is_one_job(spark):
    counts = spark.createDataFrame([("f", 1, "a", None, 3), ("f", 1, "ab", None, 2), ("g", 2, "5", 5, 4)], "field string, term_type int, term string, term_num int, n_docs int")
    plan = Planner(counts, counts, secure=False)
    for query, want in (("a OR ab", 5), ("a AND ab", 2), ("a AND NOT ab", 3), ("a*", 5), ("f:a OR g:[1 TO 9]", 7), ("~a", 0), ("", 0), ("zz", 0), ("a AND (ab OR g:[1 TO 9])", 3)):
        assert plan.estimate_frame(build(query)).collect()[0][0] == plan.estimate(build(query)) == want, query


def test_streams_cost_what_they_bring(spark, store, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(3):
        (tmp_path / f"in/{n}.jsonl").write_text(f'{{"id":"{n % 2}","x":"word{n}"}}\n')
        ingest.index_stream(ingest.lines(spark, str(tmp_path / "in"), "d", "id"), store, str(tmp_path / "check")).awaitTermination()
        files_now = set(glob.glob(f"{store.tables.path}/postings/**/*.parquet", recursive=True))
        if n:
            assert before < files_now  # nothing that was there is written again
        before = files_now
    assert ids(store.query(ALL, "d", "word*")) == ["0", "1"] and ids(store.query(ALL, "d", "word0")) == [] and store.estimate(ALL, "d", "word2") == 1


def test_running_counts_and_retention(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"t":"a b a","ts":"2024-01-01T00:00:00Z"}\n{"t":"b","ts":"2024-01-01T05:00:00Z"}\n')
    stream = lambda: spark.readStream.schema("t string, ts timestamp").json(str(tmp_path / "in"))
    for name, rows in (("running", ingest.term_counts(stream(), "t")), ("kept", ingest.retained(stream(), "ts", "1 hour", ["t"]))):
        rows.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {r.term: r.n for r in spark.table("running").collect()} == {"a": 2, "b": 2}
    assert {(r.t, r.n) for r in spark.table("kept").collect()} == {("a b a", 1), ("b", 1)}


def test_bloom_filters():
    own = BloomFilters(1000)
    own.put_all([f"v{i}" for i in range(5000)])
    assert len(own.filters) > 1 and all(own.might_contain(f"v{i}") for i in range(0, 5000, 37))
    assert sum(own.might_contain(f"w{i}") for i in range(500)) < 400
    fresh = BloomFilters(1000)
    fresh.put("a")
    again = BloomFilters.loads(fresh.dumps())
    assert again.might_contain("a") and not again.might_contain("b") and fresh.copy().might_contain("a")


def test_hash_files_and_schemas(spark, store, tmp_path):
    store.persist(docs(spark, ("1", '{"a":"x","b":null}')))
    files.hash_file(store.tables.read("hashes"), str(tmp_path / "h"))
    assert [tuple(r) for r in spark.read.option("sep", "\t").csv(str(tmp_path / "h")).collect()] == [("d", "a", hashing.hash_text("x"), "1")]
    assert dict(tb.columns_of(tb.SCHEMAS["postings"]))["term_num"] == "decimal(38,18)"


def test_small_tables_are_spread_over_the_cores(spark, tmp_path, monkeypatch):
    from corvane.operators import shared

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    rows = spark.read.parquet(str(tmp_path / "one"))
    cores = spark.sparkContext.defaultParallelism
    assert shared.widened(rows).rdd.getNumPartitions() == cores and shared.widened(rows).count() == 100
    assert shared.widened(spark.range(3)).count() == 3
    monkeypatch.setattr(shared, "SMALL_BYTES", 1)
    assert shared.widened(rows).rdd.getNumPartitions() == 1
    spark.range(100).repartition(cores).write.parquet(str(tmp_path / "many"))
    assert "RoundRobin" not in shared.widened(spark.read.parquet(str(tmp_path / "many")))._jdf.queryExecution().toString()
