"""Named queries of the engine's own operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime
from itertools import combinations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import hashing, jsonops, security
from corvane.functions import text as T
from corvane.operators import index as ix
from corvane.operators import jobs, scans, shared
from corvane.operators.stores import DataStore, between
from corvane.plans.language import build
from corvane.plans.planner import Planner
from corvane.sources import cells, files
from corvane.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _add(name: str, run: Query, sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def _postings(spark: SparkSession, sf: str, fields: tuple[str, ...] = ("text",)) -> DataFrame:
    return ix.text_postings(shared.widened(_read(spark, sf, "documents").select("doc_id", *fields)), "doc_id", list(fields))


_P = r"with p as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as term from documents) "
_F = r"""with p as (select doc_id, field, unnest(regexp_extract_all(lower(v), '[\p{L}\p{N}]+')) as term from
 (select doc_id, 'text' as field, text as v from documents union all select doc_id, 'lang', lang from documents union all select doc_id, 'source', source from documents)) """


def _text(name: str, query: str, sql: str, fields: tuple[str, ...] = ("text",), tokenizer=None) -> None:
    """A query string over documents; sql selects doc_id from p."""
    _add(name, lambda s, d: Planner(_postings(s, d, fields), tokenizer=tokenizer, secure=False).ids(build(query)), (_P if fields == ("text",) else _F) + sql)


_add("postings_build", lambda s, d: _postings(s, d).select("doc_id", "term", "n"), _P + "select doc_id, term, count(*) as n from p group by all")
_add("term_doc_counts", lambda s, d: _postings(s, d).groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n")), _P + "select term, count(distinct doc_id) as n_docs, count(*) as n from p group by term")


def _term(name: str, pattern: str, where: str) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        p = _postings(s, d)
        return p.where(T.term_predicate(F.col("term"), F.col("term_type"), F.reverse("term"), pattern)).select("doc_id", "term", "n")

    _add(name, run, _P + f"select doc_id, term, count(*) as n from p where {where} group by all")


_term("term_exact", "the", "term = 'the'")
_term("term_prefix", "th*", "term like 'th%'")
_term("term_infix", "t?e*n", "regexp_full_match(term, 't.e.*n')")
_term("term_suffix", "*tion", "term like '%tion'")
_add("term_range_text", lambda s, d: _postings(s, d).where(between("ja", "jp")).select("doc_id", "term", "n"), _P + "select doc_id, term, count(*) as n from p where term >= 'ja' and term < 'jp' group by all")


def _numbers(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("o_totalprice").alias("field"), F.lit(T.NUMBER).alias("term_type"), F.col("o_totalprice").cast("string").alias("term"), F.col("o_totalprice").cast("decimal(38,18)").alias("term_num"))


_add("numeric_range", lambda s, d: Planner(_numbers(s, d), secure=False).ids(build("o_totalprice:[1000 TO 200000]")), "select o_orderkey as doc_id from orders where o_totalprice >= 1000 and o_totalprice < 200000")
_add("numeric_range_open", lambda s, d: Planner(_numbers(s, d), secure=False).ids(build("o_totalprice:[300000 TO *]")), "select o_orderkey as doc_id from orders where o_totalprice >= 300000")

_A, _B = "select doc_id from p where term like '{}%'", "select doc_id from p where term = '{}'"
_text("bool_and", "the AND with", f"{_A.format('the')} intersect {_A.format('with')}")
_text("bool_or", "pour OR que", f"{_A.format('pour')} union {_A.format('que')}")
_text("bool_and_not", "the AND NOT in", f"{_A.format('the')} except {_A.format('in')}")
_text("bool_nested", "(the OR der) AND NOT (with OR una)", f"({_A.format('the')} union {_A.format('der')}) except ({_A.format('with')} union {_A.format('una')})")
_text("left_assoc_precedence", "pour OR the AND with OR und", f"((({_A.format('pour')}) union ({_A.format('the')})) intersect ({_A.format('with')})) union ({_A.format('und')})")
_text("ill_formed_or_not", "the OR NOT in", "select doc_id from p where false")
_text("phrase_tokens", '"of the thing"', f"{_B.format('of')} intersect {_B.format('the')} intersect {_B.format('thing')}", tokenizer=T.query_tokens)
_text("fielded_query", "lang:en AND source:src1 AND text:the", "select doc_id from p where field = 'lang' and term like 'en%' intersect select doc_id from p where field = 'source' and term like 'src1%' intersect select doc_id from p where field = 'text' and term like 'the%'", ("text", "lang", "source"))


def _estimate(name: str, query: str, sql: str) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        counts = _postings(s, d).groupBy("field", "term_type", "term", "term_num").agg(F.count("*").alias("n_docs"))
        return Planner(counts, counts, tokenizer=T.query_tokens, secure=False).estimate_frame(build(query))

    one = "(select count(distinct doc_id) from p where term = '{}')"
    _add(name, run, _P + "select (" + sql.replace("<", one[: one.index("{")]).replace(">", one[one.index("}") + 1 :]) + ")::bigint as estimate")


_estimate("cardinality_or", "the OR with", "<the> + <with>")
_estimate("cardinality_and", "the AND with", "least(<the>, <with>)")
_estimate("cardinality_not", "the AND NOT with", "<the>")
_estimate("cardinality_literal", '"the with"', "greatest(<the>, <with>)")


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    c = shared.widened(_read(spark, sf, "customer"))
    return c.select(F.lit("customer").alias("dataset"), F.col("c_custkey").cast("string").alias("doc_id"), F.to_json(F.struct("c_name", "c_nationkey", "c_mktsegment", F.struct(F.col("c_nationkey").alias("key"), F.array("c_mktsegment", F.lit("x")).alias("tags")).alias("more"))).alias("json"))


_BUILDING = "select c_custkey::bigint as doc_id from customer where c_mktsegment = 'BUILDING'"
_add("field_hash_filter", lambda s, d: _customers(s, d).where(jsonops.where_fields(F.col("json"), {"more¤tags[*]": jsonops.MASK + hashing.hash_text("BUILDING")})).select(F.col("doc_id").cast("bigint").alias("doc_id")), _BUILDING)


def json_flatten(s: SparkSession, d: str) -> DataFrame:
    talks = shared.widened(_read(s, d, "conversations")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    raw = talks.select(F.lit("talk").alias("dataset"), F.col("conv_id").cast("string").alias("doc_id"), F.to_json(F.struct("turns")).alias("json"))
    flat = jsonops.flat_rows(raw, ["dataset", "doc_id"], "json")
    return flat.select(F.col("doc_id").cast("bigint").alias("conv_id"), T.general_field(F.col("path")).alias("field"), "text")


_add("json_flatten", json_flatten, "select conv_id::bigint as conv_id, 'turns[*]¤turn' as field, turn::varchar as text from conversations union all select conv_id::bigint, 'turns[*]¤role', role from conversations union all select conv_id::bigint, 'turns[*]¤text', text from conversations")


def json_project(s: SparkSession, d: str) -> DataFrame:
    value = jsonops.project(F.col("json"), ["c_name", "more¤tags[*]"])
    out = _customers(s, d).withColumn("v", value)
    get = lambda p: F.get_json_object("v", p)
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), get("$.c_name").alias("name"), get("$.c_nationkey").alias("nation"), get("$.more.tags[0]").alias("tag"), get("$.more.key").alias("key"))


_add("json_project", json_project, "select c_custkey::bigint as doc_id, c_name as name, null::varchar as nation, c_mktsegment as tag, null::varchar as key from customer")


def json_mask_flags(s: SparkSession, d: str) -> DataFrame:
    value = jsonops.mask(F.col("json"), "customer", {"ADM", "CUSTOMER_C_NAME", "CUSTOMER_MORE_KEY"})
    out = _customers(s, d).withColumn("v", value)
    get = lambda p: F.get_json_object("v", p)
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), get("$.c_name").alias("name"), get("$.c_nationkey").startswith("MASKED_").alias("nation_masked"), get("$.more.key").cast("int").alias("key"), get("$.more.tags[1]").startswith("MASKED_").alias("tag_masked"))


_add("json_mask_flags", json_mask_flags, "select c_custkey::bigint as doc_id, c_name as name, true as nation_masked, c_nationkey as key, true as tag_masked from customer")
_add("row_visibility", lambda s, d: _read(s, d, "documents").where(security.visible(F.array(F.concat(F.lit("DOCS_"), F.upper("lang")), F.concat(F.lit("DOCS_"), F.upper("source"))), security.narrow({"DOCS_EN", "DOCS_SRC3", "OTHER_FR"}, "docs"))).select("doc_id"), "select doc_id from documents where list_has_any(['DOCS_' || upper(lang), 'DOCS_' || upper(source)], ['DOCS_EN', 'DOCS_SRC3'])")
_add("visibility_label", lambda s, d: _read(s, d, "pages").select("page_id", security.label_column(F.col("url")).alias("label")), r"select page_id, upper(trim(regexp_replace(regexp_replace(url, '\[\d+\]|\[\*\]', '', 'g'), '\s+|[^a-zA-Z0-9_]', '_', 'g'))) as label from pages")
_add("array_union_combiner", lambda s, d: ix.union_arrays(_read(s, d, "lineitem").select("l_orderkey", F.concat_ws("\0", "l_returnflag", "l_linestatus", F.lit(" "), F.col("l_linenumber").cast("string")).alias("v")), ["l_orderkey"], "v").select("l_orderkey", F.array_join("value", ",").alias("value")), "select l_orderkey, array_to_string(list_sort(list_distinct(flatten(list([l_returnflag, l_linestatus, l_linenumber::varchar])))), ',') as value from lineitem group by l_orderkey")
_add("count_combiner", lambda s, d: ix.sum_counts(_read(s, d, "events").select("event_type", F.when(F.col("user_id") % 3 == 0, "x").otherwise(F.get_json_object("props", "$.k")).alias("v")), ["event_type"], "v"), "select event_type, sum(coalesce(try_cast(case when user_id % 3 = 0 then 'x' else json_extract_string(props, '$.k') end as bigint), 0))::bigint as n from events group by event_type")
_add("latest_version", lambda s, d: ix.latest(_read(s, d, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]), "select user_id, event_type, ts, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1")
_NOW = "2024-01-20 00:00:00"
_add("age_off", lambda s, d: _read(s, d, "events").where(ix.age_off(F.col("ts"), 5, "DAYS", F.lit(_NOW).cast("timestamp"))).select("event_id", "ts"), f"select event_id, ts from events where ts >= timestamp '{_NOW}' - interval 5 day and ts < timestamp '{_NOW}'")


_add("wildcard_filter", lambda s, d: _read(s, d, "part").where(T.wildcard_filter(F.col("p_type"), ["*TIN*", "STANDARD*"], match_all=False)).select("p_partkey"), "select p_partkey from part where p_type is null or regexp_matches(p_type, '.*TIN.*') or p_type like 'STANDARD%'")


def ingest_terms(s: SparkSession, d: str) -> DataFrame:
    """The whole ingest pipeline over customers: flatten, type, tokenise, count."""
    return ix.postings(ix.values(_customers(s, d))).select(F.col("doc_id").cast("bigint").alias("doc_id"), "field", F.col("term_type").cast("int").alias("term_type"), "term", "n")


_add("ingest_terms", ingest_terms, r"""
with v as (
  select c_custkey as id, 'c_name' as field, 1 as kind, c_name as t from customer union all
  select c_custkey, 'c_nationkey', 2, c_nationkey::varchar from customer union all
  select c_custkey, 'c_mktsegment', 1, c_mktsegment from customer union all
  select c_custkey, 'more¤key', 2, c_nationkey::varchar from customer union all
  select c_custkey, 'more¤tags[*]', 1, c_mktsegment from customer union all
  select c_custkey, 'more¤tags[*]', 1, 'x' from customer
), w as (select id, field, kind, unnest(case when kind = 2 then [t] else regexp_extract_all(lower(t), '[\p{L}\p{N}]+') end) as term from v)
select id::bigint as doc_id, field, kind::integer as term_type, term, count(*) as n from w group by all""")


# Queries that go through stores. A store is made once a session and table, in the shared folder.

_stores: dict[tuple[str, str, str], DataStore] = {}


def _made(s: SparkSession, d: str, name: str, fill: Callable[[DataStore], None]) -> DataStore:
    key = (s.sparkContext.applicationId, d, name)
    if key not in _stores:
        store = DataStore(s, shared.folder(s, f"store-{name}"))
        fill(store)
        _stores[key] = store
    return _stores[key]


def _fresh(s: SparkSession, name: str) -> DataStore:
    return DataStore(s, shared.folder(s, f"store-{name}"))


def _customer_store(s: SparkSession, d: str) -> DataStore:
    """All customers, and then those in debt again with another segment."""

    def fill(store: DataStore) -> None:
        c = _read(s, d, "customer")
        json = lambda segment: F.to_json(F.struct("c_name", "c_nationkey", segment.alias("c_mktsegment")))
        rows = lambda of, segment: of.select(F.lit("customer").alias("dataset"), F.col("c_custkey").cast("string").alias("doc_id"), json(segment).alias("json"))
        store.persist(rows(c, F.col("c_mktsegment")))
        store.persist(rows(c.where("c_acctbal < 0"), F.lit("CLOSED DOWN")))

    return _made(s, d, "customer", fill)


_C = "with c as (select c_custkey::bigint as id, c_name, c_nationkey, case when c_acctbal < 0 then 'CLOSED DOWN' else c_mktsegment end as seg from customer) "
_CP = _C + r""", v as (select id, 'c_name' as field, c_name as t from c union all select id, 'c_mktsegment', seg from c),
p as (select id, field, 1 as kind, unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}]+')) as term from v union all select id, 'c_nationkey', 2, c_nationkey::varchar from c) """


def _masked(column: str, values: list[str], otherwise: str = "null") -> str:
    return f"case {column} " + " ".join(f"when '{v}' then '{jsonops.MASK}{hashing.hash_text(v)}'" for v in values) + f" else {otherwise} end"


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "CLOSED DOWN"]
_ADM = {"ADM"}


def _id(df: DataFrame, name: str = "doc_id") -> DataFrame:
    return df.select(F.col(name).cast("bigint").alias("doc_id"))


def _forward(store: DataStore, name: str) -> DataFrame:
    return store.tables.read(name).where("way = 'f'")


_add("store_persist", lambda s, d: _forward(_customer_store(s, d), "postings").select(F.col("doc_id").cast("bigint").alias("doc_id"), "field", F.col("term_type").cast("int").alias("term_type"), "term", "n"), _CP + "select id as doc_id, field, kind::integer as term_type, term, count(*) as n from p group by all")
_add("store_counts", lambda s, d: _customer_store(s, d).terms.counts(_ADM, "customer", "c*").select("field", "term", "n_docs"), _CP + "select field, term, count(distinct id)::bigint as n_docs from p where term like 'c%' and kind = 1 group by field, term")
_add("store_query", lambda s, d: _id(_customer_store(s, d).query(_ADM, "customer", "clos* AND NOT c_nationkey:[5 TO 10]")), _C + "select id as doc_id from c where seg = 'CLOSED DOWN' and not (c_nationkey >= 5 and c_nationkey < 10)")
_add("store_query_suffix", lambda s, d: _id(_customer_store(s, d).query(_ADM, "customer", "*ding OR *own")), _C + "select id as doc_id from c where seg in ('BUILDING', 'CLOSED DOWN')")
_add("store_query_among", lambda s, d: _id(_customer_store(s, d).query(_ADM, "customer", "machinery", among=_read(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").cast("string").alias("doc_id")))), _C + "select id as doc_id from c where seg = 'MACHINERY' and id in (select o_custkey from orders where o_orderstatus = 'P')")
_add("store_query_labels", lambda s, d: _id(_customer_store(s, d).query({"CUSTOMER_C_MKTSEGMENT", "OTHER_C_NAME"}, "customer", "building OR customer")), _C + "select id as doc_id from c where seg = 'BUILDING'")
_add("store_query_tokens", lambda s, d: _id(_customer_store(s, d).query(_ADM, "customer", 'c_mktsegment:"closed-down"', tokenize=True)), _C + "select id as doc_id from c where seg = 'CLOSED DOWN'")
_add("store_estimate", lambda s, d: _customer_store(s, d).planner(_ADM, "customer").estimate_frame(build('"closed" OR ("building" AND c_nationkey:[0 TO 5])')), _C + "select ((select count(*) from c where seg = 'CLOSED DOWN') + least((select count(*) from c where seg = 'BUILDING'), (select count(*) from c where c_nationkey >= 0 and c_nationkey < 5)))::bigint as estimate")
_add("match_hash", lambda s, d: _id(_customer_store(s, d).match_hash("customer", "c_mktsegment", hashing.hash_text("BUILDING"))), _C + "select id as doc_id from c where seg = 'BUILDING'")
_add("match_value", lambda s, d: _id(_customer_store(s, d).match_value("customer", "c_*key", 7, auths={"CUSTOMER_C_NATIONKEY"})), _C + "select id as doc_id from c where c_nationkey = 7")


def _json(df: DataFrame, *fields: str) -> DataFrame:
    return df.select(F.col("key").cast("bigint").alias("doc_id"), *[F.get_json_object("value", f"$.{f}").alias(f) for f in fields])


_add("store_jsons", lambda s, d: _json(_customer_store(s, d).jsons({"CUSTOMER_RAW_DATA"}, "customer", ids=_read(s, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").cast("string").alias("doc_id"))), "c_name", "c_mktsegment"), _C + "select id as doc_id, c_name, seg as c_mktsegment from c where id in (select o_custkey from orders where o_orderstatus = 'P')")
_add("store_jsons_masked", lambda s, d: _json(_customer_store(s, d).jsons({"ADM", "CUSTOMER_C_NAME"}, "customer", ["c_name", "c_mkt*"], wanted={"c_mktsegment": jsonops.MASK + hashing.hash_text("CLOSED DOWN")}), "c_name", "c_mktsegment", "c_nationkey"), _C + f"select id as doc_id, c_name, {_masked('seg', _SEGMENTS)} as c_mktsegment, null::varchar as c_nationkey from c where seg = 'CLOSED DOWN'")
_add("store_jsons_row", lambda s, d: _json(_customer_store(s, d).jsons({"CUSTOMER_7", "CUSTOMER_C_NAME"}, "customer"), "c_name", "c_mktsegment"), _C + f"select id as doc_id, c_name, {_masked('seg', _SEGMENTS)} as c_mktsegment from c where id = 7")


def _blob_store(s: SparkSession, d: str) -> DataStore:
    """Types of parts as strings, pages as files, flags of orders' lines as arrays."""

    def fill(store: DataStore) -> None:
        part, pages, lines = _read(s, d, "part"), _read(s, d, "pages"), _read(s, d, "lineitem")
        store.blobs.put(part.select(F.lit("part").alias("dataset"), F.col("p_partkey").cast("string").alias("key"), F.lit("old").alias("value")), "STR")
        store.blobs.put(part.select(F.lit("part").alias("dataset"), F.col("p_partkey").cast("string").alias("key"), F.col("p_brand").alias("value")), "STR")
        store.blobs.put(pages.select(F.lit("page").alias("dataset"), F.col("page_id").cast("string").alias("key"), F.col("url").alias("name"), F.encode("html", "UTF-8").alias("value")), "FIL")
        store.blobs.put(lines.select(F.lit("line").alias("dataset"), F.col("l_orderkey").cast("string").alias("key"), F.concat_ws("\0", "l_returnflag", "l_linestatus", F.lit(" ")).alias("value")), "ARR")

    return _made(s, d, "blobs", fill)


_add("store_blob_get", lambda s, d: _blob_store(s, d).blobs.strings({"PART_RAW_DATA"}, "part").select(F.col("key").cast("bigint").alias("key"), "value"), "select p_partkey::bigint as key, p_brand as value from part")
_add("store_blob_keys", lambda s, d: _blob_store(s, d).blobs.strings({"PART_RAW_DATA"}, "part", keys=["7", "11", "none"]).select("key", "value"), "select p_partkey::varchar as key, p_brand as value from part where p_partkey in (7, 11)")
_BRANDS = [f"Brand#{i}{j}" for i in range(10) for j in range(10)] + [f"Brand#{i}" for i in range(10)]
_add("store_masked_string", lambda s, d: _blob_store(s, d).blobs.strings({"ADM"}, "part").select(F.col("key").cast("bigint").alias("key"), "value"), f"select p_partkey::bigint as key, {_masked('p_brand', _BRANDS)} as value from part")
_add("store_files", lambda s, d: _blob_store(s, d).blobs.files({"PAGE_RAW_FILE"}, "page").select(F.col("key").cast("bigint").alias("key"), "name", "size", F.md5("content").alias("md5")), "select page_id::bigint as key, url as name, octet_length(encode(html))::bigint as size, md5(html) as md5 from pages")
_add("store_masked_file", lambda s, d: _blob_store(s, d).blobs.files({"ADM"}, "page").select(F.col("key").cast("bigint").alias("key"), "name", F.length("value").alias("length"), F.col("content").isNull().alias("hidden")), "select page_id::bigint as key, url as name, 39 as length, true as hidden from pages")
_add("store_arrays", lambda s, d: _blob_store(s, d).blobs.arrays({"LINE_RAW_DATA"}, "line").select(F.col("key").cast("bigint").alias("key"), F.array_join("value", ",").alias("value")), "select l_orderkey::bigint as key, array_to_string(list_sort(list_distinct(flatten(list([l_returnflag, l_linestatus])))), ',') as value from lineitem group by l_orderkey")
_FLAGS = ["\0".join(sorted(x)) for n in (1, 2, 3, 4, 5) for x in combinations("AFNOR", n)]
_add("store_masked_array", lambda s, d: _blob_store(s, d).blobs.arrays({"ADM"}, "line").select(F.col("key").cast("bigint").alias("key"), F.array_join("value", ",").alias("value")), "select key, case v " + " ".join(f"when '{f.replace(chr(0), ',')}' then '{jsonops.MASK}{hashing.hash_text(f)}'" for f in _FLAGS) + " end as value from (select l_orderkey::bigint as key, array_to_string(list_sort(list_distinct(flatten(list([l_returnflag, l_linestatus])))), ',') as v from lineitem group by l_orderkey)")


def _shard_sql(key: str, table: str) -> str:
    """(key, shard): the hash wraps at 64 bits, which is done in 128."""
    return f"""select key, 'ARR' || lpad((abs(case when h >= 9223372036854775808::hugeint then h - 18446744073709551616::hugeint else h end) % 100)::varchar, 2, '0') as shard
from (select key, list_reduce(list_prepend(1125899906842597::hugeint, list_transform(string_split(key, ''), lambda c: unicode(c)::hugeint)), lambda h, u: (31 * h + u) % 18446744073709551616::hugeint) as h from (select distinct {key}::varchar as key from {table}))"""


_add("array_shard", lambda s, d: _read(s, d, "customer").select(F.col("c_name").alias("key"), hashing.array_shard(F.col("c_name")).alias("shard")).distinct(), _shard_sql("c_name", "customer"))
_add("store_shards", lambda s, d: _blob_store(s, d).tables.read("blobs").where("kind = 'ARR'").groupBy("type").agg(F.count_distinct("key").alias("n")), f"select shard as type, count(*) as n from ({_shard_sql('l_orderkey', 'lineitem')}) group by shard")


def _order_store(s: SparkSession, d: str) -> DataStore:
    def fill(store: DataStore) -> None:
        o = _read(s, d, "orders")
        store.persist(o.select(F.lit("orders").alias("dataset"), F.col("o_orderkey").cast("string").alias("doc_id"), F.to_json(F.struct("o_totalprice", T.iso_instant(F.col("o_orderdate")).alias("o_orderdate"), "o_orderstatus")).alias("json")), sinks=("postings",))

    return _made(s, d, "orders", fill)


_add("date_range", lambda s, d: _id(_order_store(s, d).terms.terms_between(_ADM, "orders", datetime(1995, 1, 1), datetime(1996, 1, 1), ["o_orderdate"])), "select o_orderkey as doc_id from orders where o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1996-01-01'")
_add("store_numeric_range", lambda s, d: _id(_order_store(s, d).query(_ADM, "orders", "o_totalprice:[1000 TO 200000] AND o_orderstatus:f")), "select o_orderkey as doc_id from orders where o_totalprice >= 1000 and o_totalprice < 200000 and o_orderstatus ilike 'f%'")
_add("iso_instants", lambda s, d: _read(s, d, "orders").select("o_orderkey", T.iso_instant(F.col("o_orderdate")).alias("instant")), "select o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as instant from orders")


def _term_store(s: SparkSession, d: str) -> DataStore:
    """Languages and sources of documents as terms put by hand, languages twice; a dataset for each language besides."""

    def fill(store: DataStore) -> None:
        docs = _read(s, d, "documents")
        rows = lambda c, name, n: docs.select(F.lit(name).alias("dataset"), F.col("doc_id"), F.lit(c).alias("field"), F.col(c).alias("term"), F.lit(n).alias("n"), F.array(F.lit("ADM"), F.lit(f"DOCS_{c.upper()}")).alias("field_labels"))
        store.terms.put(rows("lang", "docs", 2))
        store.terms.put(rows("lang", "docs", 3))
        store.terms.put(rows("source", "docs", 1))
        own = docs.select(F.col("lang").alias("dataset"), "doc_id", F.lit("source").alias("field"), F.col("source").alias("term"), F.lit(1).alias("n"), F.array(F.concat(F.upper("lang"), F.lit("_SOURCE"))).alias("field_labels"))
        store.terms.put(own)

    return _made(s, d, "terms", fill)


_add("store_terms", lambda s, d: _term_store(s, d).terms.terms(_ADM, "docs", "?n").select(F.col("doc_id").cast("bigint").alias("doc_id"), "field", "term", "n"), "select doc_id::bigint as doc_id, 'lang' as field, lang as term, 5::bigint as n from documents where lang like '_n'")
_add("store_term_counts", lambda s, d: _term_store(s, d).terms.counts_between(_ADM, "docs", "a", "zz", ["l*"]).select("term", "n_docs"), "select lang as term, 2 * count(*)::bigint as n_docs from documents where lang is not null and lang <> '' group by lang")
_add("store_terms_between", lambda s, d: _term_store(s, d).terms.terms_between({"DOCS_SOURCE"}, "docs", "en", "src3").select(F.col("doc_id").cast("bigint").alias("doc_id"), "field", "term"), "select doc_id::bigint as doc_id, 'source' as field, source as term from documents where source >= 'en' and source < 'src3'")
_add("auth_narrowing", lambda s, d: _term_store(s, d).terms.terms({"EN_SOURCE", "FR_OTHER", "DE_SOURCE"}, "en", "src*").select(F.col("doc_id").cast("bigint").alias("doc_id"), "term").union(_term_store(s, d).terms.terms({"EN_SOURCE", "FR_OTHER"}, "fr", "src*").select(F.col("doc_id").cast("bigint"), "term")), "select doc_id::bigint as doc_id, source as term from documents where lang = 'en' and source like 'src%'")


def _cache_store(s: SparkSession, d: str) -> DataStore:
    def fill(store: DataStore) -> None:
        names = _read(s, d, "customer").select("c_name")
        store.cache.write("ds", "names", names.union(names))

    return _made(s, d, "cache", fill)


_add("store_cache", lambda s, d: _cache_store(s, d).cache.read("ds", "names", "Customer#000000050", 20).select("key"), "select distinct c_name as key from customer where c_name >= 'Customer#000000050' order by key limit 20")
_add("store_cache_all", lambda s, d: _cache_store(s, d).cache.read("ds", "names").select("key"), "select distinct c_name as key from customer")


def _keyed(s: SparkSession, d: str, table: str, key: str, dataset: str) -> DataFrame:
    return _read(s, d, table).select(F.lit(dataset).alias("dataset"), F.col(key).cast("string").alias("key"), F.lit("v").alias("value"))


def dataset_removed(s: SparkSession, d: str) -> DataFrame:
    store = _fresh(s, "removed")
    store.blobs.put(_read(s, d, "documents").select(F.col("source").alias("dataset"), F.col("doc_id").cast("string").alias("key"), F.col("lang").alias("value")), "STR")
    store.remove("src0")
    return store.tables.read("blobs").select("dataset", F.col("key").cast("bigint").alias("key"), "value")


_add("dataset_removed", dataset_removed, "select source as dataset, doc_id::bigint as key, lang as value from documents where source <> 'src0'")


def rows_deleted(s: SparkSession, d: str) -> DataFrame:
    """Rows after one up to another, a range, a family and a cell taken out of a store, one after the other."""
    store = _fresh(s, "deleted")
    for table, key in (("nation", "n_name"), ("supplier", "s_name"), ("region", "r_name")):
        store.blobs.put(_keyed(s, d, table, key, table), "STR")
    store.blobs.put(_keyed(s, d, "nation", "n_name", "nation"), "ARR")
    store.tables.delete_rows("blobs", "C", "J", "nation")
    store.tables.remove_ranges("blobs", [("Supplier#000000003", "Supplier#000000005"), ("Z", None)])
    store.tables.remove_families("blobs", ["ARR"])
    store.tables.remove_cells("blobs", "ASIA", "STR")
    return store.tables.read("blobs").select("dataset", "kind", "key")


_add("rows_deleted", rows_deleted, "select 'nation' as dataset, 'STR' as kind, n_name as key from nation where not (n_name > 'C' and n_name <= 'J') and n_name < 'Z' union all select 'supplier', 'STR', s_name from supplier where not (s_name between 'Supplier#000000003' and 'Supplier#000000005') union all select 'region', 'STR', r_name from region where r_name <> 'ASIA' and r_name < 'Z'")


def tables_cloned(s: SparkSession, d: str) -> DataFrame:
    store = _fresh(s, "cloned")
    store.blobs.put(_keyed(s, d, "nation", "n_name", "nation"), "STR")
    store.tables.clone("blobs", "copy")
    store.remove("nation")
    store.blobs.put(_keyed(s, d, "region", "r_name", "region"), "STR")
    store.tables.rename("copy", "kept")
    return store.tables.read("kept").select("dataset", "key").union(store.tables.read("blobs").select("dataset", "key"))


_add("tables_cloned", tables_cloned, "select 'nation' as dataset, n_name as key from nation union all select 'region', r_name from region")


def _nation_lines(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "nation").select(F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey")).alias("value"))


_NATION_JSON = """'{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}'"""
_NATION_TERMS = r"select n_nationkey::bigint as doc_id, field, term, count(*) as n from (select n_nationkey, 'n_name' as field, unnest(regexp_extract_all(lower(n_name), '[\p{L}\p{N}]+')) as term from nation union all select n_nationkey, 'n_nationkey', n_nationkey::varchar from nation union all select n_nationkey, 'n_regionkey', n_regionkey::varchar from nation) group by all"


def _terms_of(store: DataStore) -> DataFrame:
    return _forward(store, "postings").select(F.col("doc_id").cast("bigint").alias("doc_id"), "field", "term", "n")


def lines_backed_up(s: SparkSession, d: str) -> DataFrame:
    """JSON lines in, a backup out, and its lines read again."""
    store = _fresh(s, "backup")
    lines, out = shared.folder(s, "lines"), shared.folder(s, "backup")
    _nation_lines(s, d).union(s.createDataFrame([("",), ("no json",)], "value string")).write.option("compression", "gzip").text(lines)
    store.persist(files.json_lines(s, lines, "my-nation", "n_nationkey"))
    files.backup(store.jsons({"MY_NATION_RAW_DATA"}, "my-nation"), out)
    return s.read.text(out)


_add("lines_backed_up", lines_backed_up, f"select {_NATION_JSON} as value from nation")


def reindexed(s: SparkSession, d: str) -> DataFrame:
    store = _fresh(s, "reindexed")
    store.persist(_nation_lines(s, d).select(F.lit("n").alias("dataset"), F.get_json_object("value", "$.n_nationkey").alias("doc_id"), F.col("value").alias("json")), sinks=("blobs",))
    store.reindex("n")
    return _terms_of(store)


_add("reindexed", reindexed, _NATION_TERMS)


def compacted(s: SparkSession, d: str) -> DataFrame:
    """Persisted twice, the first time with other names, and compacted."""
    store = _fresh(s, "compacted")
    rows = _nation_lines(s, d).select(F.lit("n").alias("dataset"), F.get_json_object("value", "$.n_nationkey").alias("doc_id"), F.col("value").alias("json"))
    store.persist(rows.withColumn("json", F.replace("json", F.lit('"n_name":"'), F.lit('"n_name":"old '))))
    store.persist(rows)
    store.compact()
    return _terms_of(store)


_add("compacted", compacted, _NATION_TERMS)


def stream_indexed(s: SparkSession, d: str) -> DataFrame:
    """Lines that arrive in a folder, indexed by a stream."""
    store = _fresh(s, "stream")
    lines = shared.folder(s, "stream-lines")
    _nation_lines(s, d).repartition(3).write.text(lines)
    ingest.index_stream(ingest.lines(s, lines, "n", "n_nationkey", files=1), store, shared.folder(s, "stream-checkpoint")).awaitTermination()
    return _terms_of(store)


_add("stream_indexed", stream_indexed, _NATION_TERMS)


def _streamed(s: SparkSession, d: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    events = _read(s, d, "events")
    place = shared.folder(s, "events")
    events.repartition(4).write.parquet(place)
    name = f"corvane_{abs(hash(place))}"
    stream = s.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(place)
    run(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", shared.folder(s, "stream-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return s.table(name)


_add("stream_counts", lambda s, d: _streamed(s, d, lambda e: ingest.term_counts(e, "event_type")), r"select term, count(*) as n from (select unnest(regexp_extract_all(lower(event_type), '[\p{L}\p{N}]+')) as term from events) group by term")
_add("stream_retained", lambda s, d: _streamed(s, d, lambda e: ingest.retained(e.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", ["event_type"])).select(F.col("window.start").cast("string").alias("day"), "event_type", "n"), "select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as day, event_type, count(*) as n from events group by all")


def job_counts(s: SparkSession, d: str) -> DataFrame:
    """A job over the postings: occurrences and documents of each field, mapped and reduced."""
    rows = jobs.source(_customer_store(s, d).tables, "postings", {"ADM"}, F.col("way") == "f", ["field", "n"])

    def mapper(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pc.utf8_upper(batch.column(0)), batch.column(1)], ["field", "n"])

    def reducer(key: tuple, batches: Iterator[pa.RecordBatch]) -> pa.RecordBatch:
        sums = [(pc.sum(b.column(1)).as_py(), pc.sum(b.column(2)).as_py()) for b in batches]
        return pa.RecordBatch.from_pydict({"field": [key[0]], "n": [sum(n for n, _ in sums)], "n_rows": [sum(r for _, r in sums)]})

    return jobs.reduced(jobs.mapped(rows, mapper, "field string, n long"), ["field"], reducer, "field string, n long, n_rows long", [F.sum("n").alias("n"), F.count("*").alias("n_rows")])


_add("job_counts", job_counts, _CP + "select upper(field) as field, sum(n)::bigint as n, count(*) as n_rows from (select id, field, kind, term, count(*) as n from p group by all) group by field")
_add("cells_round_trip", lambda s, d: cells.terms_from_cells(cells.term_cells(_customer_store(s, d).tables.read("postings"))).groupBy("way", "field", "term").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n")), _CP + ", w as (select *, unnest(case when kind = 1 then ['f', 'b'] else ['f'] end) as way from (select id, field, kind, term, count(*) as n from p group by all)) select way, field, term, count(*) as n_docs, sum(n)::bigint as n from w group by all")
_add("scan_index", lambda s, d: scans.indexed(_read(s, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", F.col("index").cast("bigint").alias("index")), "select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) - 1 as index from orders")
_add("scan_first", lambda s, d: scans.first(_read(s, d, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"]), "select o_totalprice, o_orderkey from orders order by o_totalprice, o_orderkey limit 1")
_add("scan_until", lambda s, d: scans.until(_read(s, d, "part").select("p_partkey", "p_size"), "p_partkey", F.col("p_size") > 45), "select p_partkey, p_size from part where p_partkey < (select min(p_partkey) from part where p_size > 45)")
_add("iterator_wildcard", lambda s, d: scans.apply(_read(s, d, "part").select("p_partkey", F.col("p_type").alias("row"), F.col("p_brand").alias("family")), "wildcard", {"row": "*BRASS", "family": "Brand#1*", "and": "true"}).select("p_partkey"), "select p_partkey from part where p_type like '%BRASS' and p_brand like 'Brand#1%'")
_add("normalized", lambda s, d: _read(s, d, "documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("md5")), "select doc_id, md5(strip_accents(lower(text))) as md5 from documents")
_add("path_labels", lambda s, d: _read(s, d, "documents").select("doc_id", F.array_join(security.path_labels_column(F.concat_ws("¤", F.concat("source", F.lit("[3]")), "lang", F.lit("x y"), F.lit("z"))), ",").alias("labels")), "select doc_id, upper(source) || ',' || upper(source) || '_' || upper(lang) || ',' || upper(source) || '_' || upper(lang) || '_X_Y' as labels from documents")
_add("span_combiner", lambda s, d: ix.sum_spans(_read(s, d, "events").select("event_type", F.concat_ws("\0", F.get_json_object("props", "$.k"), F.col("user_id").cast("string"), F.lit("s")).alias("v")), ["event_type"], "v").select("event_type", "n", F.size("spans").alias("n_spans")), "select event_type, sum(json_extract_string(props, '$.k')::bigint)::bigint as n, (2 * count(*))::integer as n_spans from events group by event_type")


def _as_json(s: SparkSession, d: str, *fields) -> DataFrame:
    return _read(s, d, "documents").select(F.lit("d").alias("dataset"), F.col("doc_id").cast("string").alias("doc_id"), F.to_json(F.struct(*fields)).alias("json"))


_B64 = "to_base64(encode(source || ':' || doc_id || ':' || lang))"
_add("base64_skip", lambda s, d: ix.occurrences(ix.values(_as_json(s, d, F.base64(F.encode(F.concat_ws(":", "source", "doc_id", "lang"), "UTF-8")).alias("a"), F.col("lang").alias("b")))).select(F.col("doc_id").cast("bigint").alias("doc_id"), "field", "term"), rf"""
with v as (select doc_id::bigint as doc_id, {_B64} as a, lang from documents)
select doc_id, 'b' as field, lower(lang) as term from v
union all select doc_id, 'a', unnest(regexp_extract_all(lower(a), '[\p{{L}}\p{{N}}]+')) from v where not (regexp_full_match(a, '[A-Za-z0-9+/]{{16,}}={{0,2}}') and regexp_matches(a, '[0-9]') and regexp_matches(a, '[A-Z]') and regexp_matches(a, '[a-z]'))""")
_add("underscore_skip", lambda s, d: ix.values(_as_json(s, d, F.col("lang").alias("_a"), F.struct(F.col("lang").alias("_c"), F.col("source").alias("d")).alias("b"), F.lit(None).cast("string").alias("e"), F.array("lang", "source").alias("f"))).select(F.col("doc_id").cast("bigint").alias("doc_id"), "field", "text"), "select doc_id::bigint as doc_id, 'b¤d' as field, source as text from documents union all select doc_id::bigint, 'f[*]', lang from documents union all select doc_id::bigint, 'f[*]', source from documents")
_text("bool_rewritten", "NOT(NOT the AND NOT der) AND with", f"({_A.format('the')} union {_A.format('der')}) intersect {_A.format('with')}")
_text("both_wildcards", "*h* OR und", f"{_A.format('und')} union {_A.format('und')}")
_text("synonyms_find_nothing", "~the OR und", f"{_A.format('und')} union {_A.format('und')}")
_text("stop_at_punctuation", "+the -in und", f"({_B.format('the')} except {_A.format('in')}) intersect {_A.format('und')}")
_add("store_terms_docs", lambda s, d: _term_store(s, d).terms.terms(_ADM, "docs", "src*", ["sou*"], docs=_read(s, d, "labels").where("quality = 1").select("doc_id")).select(F.col("doc_id").cast("bigint").alias("doc_id"), "term", "n"), "select doc_id::bigint as doc_id, source as term, 1::bigint as n from documents where source like 'src%' and doc_id in (select doc_id from labels where quality = 1)")
_add("row_visibility_null", lambda s, d: _read(s, d, "documents").where(security.visible(F.when(F.col("lang") != "en", F.array(F.concat(F.lit("DOCS_"), F.upper("source")))), {"DOCS_SRC1"})).select("doc_id"), "select doc_id from documents where lang is null or lang = 'en' or source = 'src1'")
_add("control_characters", lambda s, d: _read(s, d, "documents").select("doc_id", F.concat(F.lit('{"a":"'), "source", F.lit("\x07"), "lang", F.lit('","b":1}')).alias("v")).select("doc_id", F.get_json_object(jsonops.project(F.col("v"), ["a"]), "$.a").alias("a")), "select doc_id, source || chr(7) || lang as a from documents")
_add("json_not_json", lambda s, d: _read(s, d, "documents").select("doc_id", F.md5(jsonops.mask(F.col("text"), "d", {"ADM"})).alias("md5")), "select doc_id, md5(text) as md5 from documents")


def hash_file(s: SparkSession, d: str) -> DataFrame:
    """Hashes of one field that is kept, written as a file and read again."""
    store, out = _fresh(s, "hashes"), shared.folder(s, "hash-file")
    store.persist(_nation_lines(s, d).select(F.lit("n").alias("dataset"), F.get_json_object("value", "$.n_nationkey").alias("doc_id"), F.col("value").alias("json")), keep=F.col("path") == "n_regionkey")
    files.hash_file(store.tables.read("hashes"), out)
    return s.read.schema("dataset string, field string, hash string, doc_id bigint").option("sep", "\t").csv(out)


_add("hash_file", hash_file, "select 'n' as dataset, 'n_regionkey' as field, " + _masked("n_regionkey::varchar", [str(i) for i in range(10)]).replace(jsonops.MASK, "") + " as hash, n_nationkey::bigint as doc_id from nation")


def normal_index(s: SparkSession, d: str) -> DataFrame:
    """An index whose tokenizer leaves values whole, in lower case and without accents."""
    store = _fresh(s, "normal")
    store.persist(_read(s, d, "nation").select(F.lit("n").alias("dataset"), F.col("n_nationkey").cast("string").alias("doc_id"), F.to_json(F.struct(F.concat(F.col("n_name"), F.lit(" Été")).alias("name"))).alias("json")), tokenizer=T.normal_terms)
    return _terms_of(store)


_add("normal_index", normal_index, "select n_nationkey::bigint as doc_id, 'name' as field, lower(n_name) || ' ete' as term, 1::bigint as n from nation")


def cache_hashed(s: SparkSession, d: str) -> DataFrame:
    store = _fresh(s, "hashed-cache")
    later = store.cache.write("ds", "h", _read(s, d, "customer").select("c_mktsegment"), hashed=True, delegate_after=2)
    later.result()
    return store.cache.read("ds", "h")


_add("store_cache_hashed", cache_hashed, "select distinct " + _masked("c_mktsegment", _SEGMENTS).replace(jsonops.MASK, "") + " as key, c_mktsegment as value from customer")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return QUERIES["bool_and_not"](spark, sf)
