"""Golden values of the functions, the parser and the stores."""

import gzip
import glob

import numpy as np
import pytest
from corvane import admin
from corvane.cache import AuthAwareCache
from corvane.functions import hashing, jsonops, security
from corvane.functions import text as T
from corvane.operators import index as ix
from corvane.operators.stores import DataStore, between
from corvane.plans.language import Branch, Leaf, build
from corvane.plans.planner import Planner
from corvane.sources import files
from corvane.streaming import ingest
from pyspark.sql import functions as F

RAW = "dataset string, doc_id string, json string"
JOHN = '{"id":"1","first_name":"john","last_name":"doe","age":17,"birthdate":"2004-04-01T00:00:00Z"}'
JANE = '{"id":"1","first_name":"jane","last_name":"doe","age":18,"birthdate":"2003-04-01T00:00:00Z"}'
PATH = '{"path":"/opt/test/01_MyFile.csv"}'
ACTORS = '{"uuid":1,"Actors":[{"name":"Tom Cruise","age":56,"weight":67.5,"wife":null,"children":["Suri"]},{"name":"Robert Downey Jr.","age":73,"weight":77.1,"hasGreyHair":false,"children":["Avri Roel","Exton"]}]}'


@pytest.mark.parametrize("text,digest", [("Tom Cruise", "8f8a04ea49585975fcf1e452b988e085"), ("67.5", "4103e8509cbdf6b3372222061bbe1da6"), ("73", "3974c437d717863985a0b5618f289b46"), ("true", "5db32d6ecc1f5ef816ebe6268a3343c2"), ("false", "e495b7e5056dbfc4e854950696d4c3cc"), ("john", "88fecf016203005fdbeb018c1376c333"), ("doe", "4b5c86196dd52c0cf2673d2d0a569431"), ("1", "717c7b8afebbfb7137f6f0f99beb2a94"), ("2004-04-01T00:00:00Z", "8c979aa1006083b505eadf7fdbbd786c"), ("/opt/test/01_MyFile.csv", "8995d3edb756b461812cdb3501a74032"), ("", "0" * 32), (None, "0" * 32)])
def test_murmur(text, digest):
    assert hashing.hash_text(text) == digest


def test_murmur_batches_equal_single_values():
    rng = np.random.default_rng(1)
    values = [rng.bytes(int(n)) for n in [0, 1, 15, 16, 17, 31, 32, 33, 5000, 20_000, *rng.integers(0, 90, 300)]]
    assert [x.tobytes() for x in hashing.murmur3_128(values)] == [hashing.murmur3_128([v])[0].tobytes() for v in values]
    assert len({hashing.shard_of(str(i)) for i in range(5000)}) == 100


@pytest.mark.parametrize(
    "query,tree",
    [
        ("A", "A"), ("A B", "(A And B)"), ("A or B", "(A Or B)"), ('"a b"', '"a b"'), ("+a", '"a"'), ("~a", "~a"), ("-a b", "(b And Not(a))"), ("A OR B AND C OR D", "(((A Or B) And C) Or D)"), ("NOT(A AND B) OR (C AND D)", "((C And D) Or Not(A And B))"),
        ("A AND NOT(B AND NOT(C) AND D)", "(A And ((C Or Not(B)) Or Not(D)))"), ("NOT(A AND NOT(B AND NOT(C) AND D))", "(((B And Not(C)) And D) Or Not(A))"), ("NOT(NOT A AND NOT B)", "(A Or B)"), ("NOT name:andré", None), ("NOT a AND NOT b", None), ("NOT a OR NOT b", None),
        ("firstname:john + lastname:doe", '(firstname:john And lastname:"doe")'), ('name:~"andré"', 'name:"andré"'), ("children[0]", None), ("A[0]¤b[*]:x", "A[0]¤b[*]:x"), ("age:[* TO *]", None), ("age:[1]", None), ("age:[1 TO]", None), ("age:[]", None), ("age:[1 TO 2]", "age:[1 TO 2]"), ("[* TO 2]", "[* TO 2]"), ("", None), ("()", None), ("() a", "a"), ('("a) b" c)', '("a) b" And c)'),
    ],
)
def test_parser(query, tree):
    node = build(query)
    assert (str(node) if node else None) == tree


def test_parser_details():
    with pytest.raises(TypeError):
        build(None)
    assert str(build("a-b:c", keep_punctuation=True)) == "a-b:c" and str(build("the a", stop_words=frozenset(["the"]))) == "a"
    assert build("a (b OR c)").terms() == {"a", "b", "c"}


def test_wildcards():
    assert T.wildcard_match("????_1", "TERM_1") and T.wildcard_match("*_1\0F_?", "T_1\0F_2") and not T.wildcard_match("", "") and not T.wildcard_match("1", "11")
    assert T.literal_prefix("ab*c?") == "ab" and T.compact("a**b") == "a*b"


def test_labels():
    assert security.label(" a[0].b c") == "_A_B_C" and security.path_labels("Actors[0]¤children[*]¤x¤y") == ["ACTORS", "ACTORS_CHILDREN", "ACTORS_CHILDREN_X"]
    assert security.narrow({"ADM", "DS_A", "DT_B"}, "ds") == {"ADM", "DS_A"}
    assert security.evaluate("A&(B|C)", {"A", "C"}) and not security.evaluate("A&(B|C)", {"A"}) and security.evaluate("", set())
    for wrong in ("A&B|C", "(A", "A)"):
        with pytest.raises(ValueError):
            security.evaluate(wrong, {"A", "B"})


def test_json():
    flat = jsonops.flatten(jsonops.loads(ACTORS))
    assert flat["Actors[0]¤name"] == "Tom Cruise" and flat["Actors[0]¤weight"] == "67.5" and flat["Actors[1]¤children[1]"] == "Exton"
    assert jsonops.dumps(jsonops.unflatten(flat)) == ACTORS
    assert jsonops.project_document(ACTORS, ["Actors[*]¤name"]) == '{"Actors":[{"name":"Tom Cruise"},{"name":"Robert Downey Jr."}]}'
    assert jsonops.project_document("no json", ["x"]) == "no json" and jsonops.project_document('{"a":1}', ["b"]) == "{}"
    assert jsonops.project_document('{"a":"x\x07"}', ["a"]) == '{"a":"x\\u0007"}'
    masked = jsonops.loads(jsonops.mask_document('{"a":1.50,"b":{"c":null}}', "ds", {"DS_A"}))
    assert masked == {"a": "1.50", "b": {"c": "MASKED_" + "0" * 32}}
    assert jsonops.mask_document(ACTORS, "ds", {"DS_RAW_DATA"}) == ACTORS
    assert jsonops.fields_match(ACTORS, {"Actors[*]¤age": "73", "uuid": "1"}) and not jsonops.fields_match(ACTORS, {"Actors[*]¤age": "74"})
    assert jsonops.fields_match(ACTORS, {"Actors[0]¤name": "MASKED_8f8a04ea49585975fcf1e452b988e085"}) and not jsonops.fields_match("x", {"a": "b"})


def test_types(spark):
    texts = ["1", "0.98", ".99", "97.", "0001", "2004-04-01T00:00:00Z", "TRUE", "yes", "1e3", "2004-99-01T00:00:00Z", "x"]
    got = [r.k for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.term_type(F.col("t")).alias("k")).collect()]
    assert got == [2, 2, 1, 1, 1, 3, 4, 1, 1, 1, 1]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    out = DataStore(spark, str(tmp_path_factory.mktemp("store")))
    rows = [("ds_1", "row_1", JOHN), ("ds_1", "row_2", JANE), ("files", "f", PATH), ("movies", "m", ACTORS)]
    out.persist(spark.createDataFrame(rows, RAW))
    return out


ALL = {"ADM"}


def ids(df):
    return [r.doc_id for r in df.collect()]


@pytest.mark.parametrize("query,want", [("joh? AND doe", ["row_1"]), ("doe AND NOT jan?", ["row_1"]), ("joh* OR jan*", ["row_1", "row_2"]), ("*ohn OR *ane", ["row_1", "row_2"]), ("age:[* TO 20]", ["row_1", "row_2"]), ("age:[15 TO *]", ["row_1", "row_2"]), ("age:[17 TO 18]", ["row_1"]), ("~john", []), ("john OR NOT jane", []), ("*oh*", []), ("age:[a TO b]", [])])
def test_queries(store, query, want):
    assert ids(store.query(ALL, "ds_1", query)) == want


def test_row_and_field_labels(store):
    assert ids(store.query({"DS_1_ROW_1"}, "ds_1", "joh* OR jan*")) == ["row_1"]
    assert ids(store.query({"DS_1_FIRST_NAME"}, "ds_1", "joh* OR doe")) == ["row_1"]
    assert ids(store.query(set(), "ds_1", "joh*")) == []


@pytest.mark.parametrize("query,want", [("joh* OR jan*", 2), ("joh* AND jan*", 1), ("joh* AND NOT jan*", 1), ("*ohn OR *ane", 2), ("age:[* TO 20]", 2), ("~x", 0)])
def test_estimates(store, query, want):
    assert store.estimate(ALL, "ds_1", query) == want


def test_tokenised_queries(store):
    for query in ("myfile.csv", "path:myfile.csv", "path:*yfile", 'path:"myfile" AND path:"csv"'):
        assert ids(store.query(ALL, "files", query)) == ["f"], query
    assert ids(store.query(ALL, "files", 'path:"myfile.csv"')) == [] and ids(store.query(ALL, "files", 'path:"myfile.csv"', tokenize=True)) == ["f"]


def test_values_and_hashes(store):
    for field, value in (("Actors[*]¤name", "Tom Cruise"), ("Actors[*]¤weight", 67.5), ("Actors[*]¤age", 73), ("Actors[*]¤hasGreyHair", False)):
        assert ids(store.match_value("movies", field, value)) == ["m"], field
    assert ids(store.match_value("movies", "uuid", 2)) == [] and ids(store.match_value("movies", "uuid", 1, auths={"X"})) == []


def test_documents(store):
    auths = {"ADM", "DS_1_FIRST_NAME"}
    got = {r.key: jsonops.loads(r.value) for r in store.jsons(auths, "ds_1", ["first_name", "age"], ordered=True).collect()}
    assert got["row_1"]["first_name"] == "john" and got["row_1"]["age"].startswith("MASKED_") and set(got["row_1"]) == {"first_name", "age"}
    raw = store.jsons({"DS_1_RAW_DATA"}, "ds_1", wanted={"age": "18"}).collect()
    assert [(r.key, r.value) for r in raw] == [("row_2", JANE)]
    assert store.jsons({"DS_1_RAW_DATA"}, "ds_1", ids=store.query(ALL, "ds_1", "john")).count() == 1 and store.jsons({"OTHER"}, "ds_1").count() == 0


def test_terms(store):
    assert [r.term for r in store.terms.terms(ALL, "ds_1", "j???", ordered=True).collect()] == ["jane", "john"]
    assert {r.term for r in store.terms.terms_between(ALL, "ds_1", "ja", "jp").collect()} == {"jane", "john"}
    assert {r.term for r in store.terms.terms_between(ALL, "ds_1", 18, None, ["age", "*name"]).collect()} == {"18", "doe", "jane", "john"}
    assert {(r.term, r.n_docs) for r in store.terms.cardinality(ALL, "ds_1", "do*").collect()} == {("doe", 2)}
    for wrong in ((None, None), ("a", 1), ("a*", "b")):
        with pytest.raises(ValueError):
            between(*wrong)


def test_cell_counts(spark):
    """Cells of a document: a hash for each value, four for a string's token, two for another term."""
    for json, want in ((JOHN, 19), (PATH, 21), ('{"id":"1","nom":"doe","prénom":"john","score_1":"0.98","score_2":".99","score_3":"97."}', 26)):
        of = ix.values(spark.createDataFrame([("d", "1", json)], RAW))
        kinds = [r.term_type for r in ix.postings(of).collect()]
        assert of.count() + sum(4 if k == T.STRING else 2 for k in kinds) == want


def test_lifecycle(spark, tmp_path):
    store = DataStore(spark, str(tmp_path / "s"))
    assert not store.is_ready() and ids(store.query(ALL, "a", "x")) == []
    store.persist(spark.createDataFrame([("a", "1", JOHN), ("b", "1", JANE)], RAW))
    store.persist(spark.createDataFrame([("a", "1", '{"first_name":"jack"}'), ("a", "2", JOHN)], RAW))
    assert ids(store.query(ALL, "a", "jack")) == ["1"] and ids(store.query(ALL, "a", "john")) == ["2"] and ids(store.query(ALL, "b", "jane")) == ["1"]
    store.reindex("a")
    assert ids(store.query(ALL, "a", "jack OR john")) == ["1", "2"]
    store.compact()
    store.tables.rewrite("postings", "a", F.col("doc_id") != "2")
    assert ids(store.query(ALL, "a", "jack OR john")) == ["1"]
    store.remove("a")
    assert ids(store.query(ALL, "a", "jack")) == [] and ids(store.query(ALL, "b", "jane")) == ["1"]
    store.destroy()
    assert not store.is_ready()


def test_blobs_and_cache(spark, tmp_path):
    store = DataStore(spark, str(tmp_path / "s"))
    rows = lambda *r: spark.createDataFrame([("ds", *x) for x in r], "dataset string, key string, value string")
    store.blobs.put(rows(("k", "1\0002\0002"), ("k", " 3 \0"), ("j", "9")), "ARR")
    assert [(r.key, r.value) for r in store.blobs.get({"DS_RAW_DATA"}, "ds", "ARR", ordered=True).collect()] == [("j", ["9"]), ("k", ["1", "2", "3"])]
    assert [(r.key, r.value) for r in store.blobs.arrays({"ADM"}, "ds", ordered=True).collect()] == [("j", ["MASKED_" + hashing.hash_text("9")]), ("k", ["MASKED_" + hashing.hash_text("1\0002\0003")])]
    store.blobs.put(rows(("s", "secret")), "STR")
    assert store.blobs.get({"DS_RAW_DATA"}, "ds", "STR").first().value == "secret"
    assert store.blobs.get({"ADM"}, "ds", "STR").first().value == "MASKED_" + hashing.hash_text("secret")
    store.blobs.put(spark.createDataFrame([("ds", "f", "a.bin", bytearray(b"\0\1"))], "dataset string, key string, name string, value binary"), "FIL")
    assert store.blobs.get({"DS_RAW_FILE"}, "ds", "FIL", ["f"]).first().properties == ["a.bin", "2"]
    seen = store.blobs.files({"DS_RAW_FILE", "ADM"}, "ds").first()
    assert (seen.name, seen.size, bytes(seen.content)) == ("a.bin", 2, b"\0\1")
    masked = store.blobs.files({"ADM"}, "ds").first()
    assert masked.content is None and masked.value == "MASKED_" + hashing.hash_text(b"\0\1") and masked.size == 2
    assert store.blobs.files({"OTHER"}, "ds").count() == 0
    store.cache.write("ds", "c", spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "v string"))
    assert [r.key for r in store.cache.read("ds", "c").collect()] == ["", "a", "b"] and [r.key for r in store.cache.read("ds", "c", "a", 1).collect()] == ["a"]
    late = F.current_timestamp() + F.expr("interval 4 hours")
    assert store.cache.has_data("ds", "c") and store.cache.read("ds", "c", now=late).count() == 0
    store.cache.remove("ds")
    assert not store.cache.has_data("ds", "c")


def test_files_and_command_line(spark, tmp_path):
    source = tmp_path / "in.jsonl.gz"
    with gzip.open(source, "wt") as f:
        f.write(f"{JOHN}\n\nnot json\n" + JANE.replace('"1"', '"2"', 1) + "\n")
    assert files.json_lines(spark, str(source), "d", "id").count() == 2 and files.rejected_lines(spark, str(source)).count() == 1
    place = str(tmp_path / "store")
    for args in (["create"], ["create_user", "--user", "u"], ["termstore_grant_read_permission", "--user", "u"], ["ingest", "--dataset", "d", "--file", str(source)], ["reindex", "--dataset", "d"], ["compact"], ["backup", "--dataset", "d", "--file", str(tmp_path / "out")]):
        assert admin.main([*args, "--store", place], spark) == 0
    lines = [x for p in glob.glob(str(tmp_path / "out/*.gz")) for x in gzip.open(p, "rt").read().splitlines()]
    assert sorted(lines) == sorted([JOHN, JANE.replace('"1"', '"2"', 1)])
    registry = admin.Registry(f"{place}/users.json")
    assert registry.has("u", "READ", "postings") and registry.users_with("READ", "counts") == ["u"] and len(admin.actions()) == 23
    registry.set_auths("u", "A, B")
    registry.grant("u", "SYSTEM")
    assert registry.auths("u") == {"A", "B"} and registry.has("u", "SYSTEM")
    registry.revoke_all("u")
    assert not registry.has("u", "READ", "postings")
    with pytest.raises(ValueError):
        registry.grant("u", "FLY")
    store = DataStore(spark, place)
    files.hash_file(store.tables.read("hashes"), str(tmp_path / "h"))
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "h")).count() == 10
    assert files.binary_files(spark, str(tmp_path / "out/*.gz"), "d").count() >= 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.jsonl").write_text(JOHN + "\n")
    store = DataStore(spark, str(tmp_path / "store"))
    for name, json in ((None, None), ("2", JANE.replace('"1"', '"2"', 1))):
        if name:
            (tmp_path / f"in/{name}.jsonl").write_text(json + "\n")
        ingest.index_stream(ingest.lines(spark, str(tmp_path / "in"), "d", "id"), store, str(tmp_path / "check")).awaitTermination()
    assert ids(store.query(ALL, "d", "joh* OR jan*")) == ["1", "2"]


def test_hand_built_trees(spark):
    p = spark.createDataFrame([("1", "f", 1, "a", None), ("2", "f", 1, "b", None)], "doc_id string, field string, term_type int, term string, term_num decimal(38,18)")
    plan = Planner(p, p.withColumn("n_docs", F.lit(1)), secure=False)
    a, b = Leaf("prefix", "", "a"), Leaf("prefix", "", "b", True)
    assert ids(plan.ids(Branch("And", b, a))) == ["1"] and ids(plan.ids(Branch("Or", a, None))) == ["1"] and ids(plan.ids(Branch("And", None, a))) == [] and ids(plan.ids(None)) == []
    assert ids(plan.ids(build("a OR b"), p.where("doc_id = '2'"))) == ["2"]


def test_combiners(spark):
    t = spark.createDataFrame([("k", "3\0x\0y"), ("k", "4"), ("k", "z")], "k string, v string")
    assert ix.sum_spans(t, ["k"], "v").first().n == 7 and ix.sum_counts(t, ["k"], "v").first().n == 4
    with pytest.raises(ValueError):
        ix.age_off(F.col("ts"), 1, "WEEKS", F.current_timestamp())


def test_auth_aware_cache():
    cache = AuthAwareCache()
    cache.put("n", "k", "A|B", 1)
    cache.put("n", "k", "C", 2)
    assert cache.get_if_present("n", "k", {"B"}) == 1 and cache.get_if_present("n", "k", {"C"}) == 2 and cache.get_if_present("n", "k", {"D"}) is None
    assert cache.get("n", "l", {"A"}, lambda: ("A", 3)) == 3 and cache.get("n", "m", {"A"}, lambda: ("B", 4)) is None
    assert cache.get_all_present("n", ["k", "l", "x"], {"A"}) == {"k": 1, "l": 3} and cache.stats()["misses"] == 4
    cache.invalidate_all("n")
    assert cache.stats()["size"] == 0
