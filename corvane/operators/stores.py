"""Stores over tables: blobs, terms, cache, and the document store that joins them. Reads return DataFrames and run
nothing, but where it says so; see ``tables`` for how rows are kept."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.admin import STORES
from corvane.functions import hashing, jsonops
from corvane.functions import text as T
from corvane.functions.security import ADM, RAW_DATA, RAW_FILE, label, label_column, narrow, visible
from corvane.operators import index as ix
from corvane.operators.shared import pieces
from corvane.operators.tables import FORWARD, SCHEMAS, Tables, both_ways
from corvane.plans.language import build
from corvane.plans.planner import Planner

KINDS = ("STR", "JSO", "FIL", "ARR")


def _labels(rows: DataFrame, name: str) -> Column:
    none = F.array().cast("array<string>")
    return F.coalesce(F.col(name), none) if name in rows.columns else none


class BlobStore:
    def __init__(self, tables: Tables):
        self.tables = tables

    def put(self, rows: DataFrame, kind: str) -> None:
        """(dataset, key, value[, labels, properties, name]) as blobs of a kind: STR, JSO, FIL (value binary) or ARR.
        Of blobs of one kind and key the last put counts, of one put the last row; arrays are united."""
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind}")
        raw = F.lit(RAW_FILE if kind == "FIL" else RAW_DATA)
        labels = F.array_distinct(F.concat(_labels(rows, "labels"), F.array(F.lit(ADM), F.concat_ws("_", label_column(F.col("dataset")), raw))))
        late = {"labels": labels, "ts": F.current_timestamp()}
        if kind == "FIL":
            name = F.col("name") if "name" in rows.columns else F.col("key")
            late |= {"properties": F.array(name, F.length("value").cast("string")), "content": F.col("value"), "value": F.lit(None)}
        late["type"] = hashing.array_shard("key") if kind == "ARR" else F.lit(kind)
        out = rows if kind == "ARR" else ix.latest(rows.withColumn("_place", F.monotonically_increasing_id()), ["dataset", "key"], ["_place"]).drop("_place")
        version = self.tables.begin()
        self.tables.append("blobs", out.withColumn("kind", F.lit(kind)), late | {"version": F.lit(version)})
        self.tables.done(version)

    def get(self, auths: set[str], dataset: str, kind: str, keys: DataFrame | Iterable[str] | None = None, fields: list[str] | None = None, wanted: dict[str, str] | None = None, ordered: bool = False) -> DataFrame:
        """(key, type, properties, labels, value, content): projection, then masking, then the test of field values, in
        this order. Who sees a blob that is no JSON by ADM alone gets a hash in place of its value, content or array."""
        own = narrow(auths, dataset)
        out = self.tables.read("blobs").where((F.col("dataset") == dataset) & (F.col("kind") == kind)).drop("dataset", "kind")
        out = out.where(visible(F.col("labels"), own))
        if isinstance(keys, DataFrame):
            out = out.join(keys.select(F.col(keys.columns[0]).cast("string").alias("key")), "key", "left_semi")
        elif keys is not None:
            out = out.where(F.col("key").isin(sorted(keys)))
        if kind == "ARR":
            parts = ix.array_parts(F.col("value"))
            # what is masked is the union of the cells that share labels, as they are one cell
            cells = out.groupBy("key", "type", F.array_sort("labels").alias("labels")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(parts)))).alias("value"))
            masked = F.when(jsonops.hidden(F.col("labels"), own), F.array(F.concat(F.lit(jsonops.MASK), hashing.hashed(F.array_join("value", "\0"))))).otherwise(F.col("value"))
            cells = cells.withColumn("value", masked)
            out = cells.groupBy("key", "type").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("value")))).alias("value"))
        else:
            out = ix.latest(out, ["key"], ["version"]).drop("version", "ts")
            if kind == "JSO":
                if fields:
                    out = out.withColumn("value", jsonops.project(F.col("value"), fields))
                if f"{label(dataset)}_{RAW_DATA}" not in own:
                    out = out.withColumn("value", jsonops.mask(F.col("value"), dataset, own))
                if wanted:
                    out = out.where(jsonops.where_fields(F.col("value"), wanted))
            else:
                hidden = jsonops.hidden(F.col("labels"), own)
                # Python functions are run for every row: what is shown is not handed to them
                digest = F.concat(F.lit(jsonops.MASK), hashing.hashed_bytes(F.when(hidden, F.coalesce("content", F.encode("value", "UTF-8")))))
                out = out.withColumn("value", F.when(hidden, digest).otherwise(F.col("value"))).withColumn("content", F.when(~hidden, F.col("content")))
        return out.orderBy("key") if ordered else out

    def strings(self, auths: set[str], dataset: str, **how) -> DataFrame:
        return self.get(auths, dataset, "STR", **how)

    def files(self, auths: set[str], dataset: str, **how) -> DataFrame:
        """(key, name, size, value, content, labels)."""
        out = self.get(auths, dataset, "FIL", **how)
        return out.select("key", F.get("properties", 0).alias("name"), F.get("properties", 1).cast("bigint").alias("size"), "value", "content", "labels")

    def arrays(self, auths: set[str], dataset: str, **how) -> DataFrame:
        return self.get(auths, dataset, "ARR", **how)


class TermStore:
    def __init__(self, tables: Tables):
        self.tables = tables

    def put(self, rows: DataFrame) -> None:
        """(dataset, doc_id, field, term, n[, term_type, labels, field_labels]): occurrences of terms in documents, put by hand.
        Each row adds n to its term's occurrences and 1 to its documents. n has to be positive, else the write
        fails as a whole; null and empty terms are left out. Postings have both sorts of labels, counts the field's."""
        rows = rows.where("term is not null and term <> ''")
        kind = (F.col("term_type") if "term_type" in rows.columns else F.lit(T.STRING)).cast("tinyint")
        positive = F.when(F.col("n") > 0, F.col("n").cast("bigint")).otherwise(F.raise_error(F.lit("n has to be positive")).cast("bigint"))
        field = _labels(rows, "field_labels")
        rows = rows.select("dataset", F.col("doc_id").cast("string").alias("doc_id"), "field", F.col("term").cast("string").alias("term"), kind.alias("term_type"), T.term_number(F.col("term").cast("string"), kind).alias("term_num"), positive.alias("n"), F.array_distinct(F.concat(_labels(rows, "labels"), field)).alias("labels"), field.alias("field_labels"))
        self.tables.append("postings", both_ways(rows))
        self.tables.append("counts", both_ways(rows.drop("labels").withColumnRenamed("field_labels", "labels").withColumn("n_docs", F.lit(1))))

    def terms(self, auths: set[str], dataset: str, pattern: str, fields: list[str] | None = None, docs: DataFrame | None = None, ordered: bool = False, way: str | None = None) -> DataFrame:
        """(doc_id, field, term_type, term, term_num, labels, n): postings of a term or wildcard, of some documents if given.
        With ``way`` the rows of one direction that match, whatever the pattern."""
        found = self._scan("postings", auths, dataset, fields).where(T.way_predicate(T.compact(pattern), way))
        return self._finish(found, docs, ordered)

    def terms_between(self, auths: set[str], dataset: str, low=None, high=None, fields: list[str] | None = None, docs: DataFrame | None = None, ordered: bool = False) -> DataFrame:
        """Postings from low up to high, high left out; bounds are both texts or both numbers. An open range of numbers
        also holds what sorts after them: strings that begin with a letter."""
        return self._finish(self._scan("postings", auths, dataset, fields).where((F.col("way") == FORWARD) & between(low, high)), docs, ordered)

    def counts(self, auths: set[str], dataset: str, pattern: str, fields: list[str] | None = None) -> DataFrame:
        """(field, term_type, term, n_docs) of a term or wildcard, from the counts that are kept."""
        return self._summed(self._scan("counts", auths, dataset, fields).where(T.way_predicate(T.compact(pattern))))

    def counts_between(self, auths: set[str], dataset: str, low=None, high=None, fields: list[str] | None = None) -> DataFrame:
        return self._summed(self._scan("counts", auths, dataset, fields).where((F.col("way") == FORWARD) & between(low, high)))

    @staticmethod
    def _summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("field", "term_type", "term").agg(F.sum("n_docs").alias("n_docs")).where("n_docs > 0")

    cardinality, cardinality_between = counts, counts_between

    def _scan(self, name: str, auths: set[str], dataset: str, fields: list[str] | None) -> DataFrame:
        out = self.tables.read(name).where(F.col("dataset") == dataset).where(visible(F.col("labels"), narrow(auths, dataset)))
        return out.where(T.any_wildcard(F.col("field"), fields)) if fields else out

    @staticmethod
    def _finish(out: DataFrame, docs: DataFrame | None, ordered: bool) -> DataFrame:
        if docs is not None:
            out = out.join(docs.select(F.col("doc_id").cast("string").alias("doc_id")), "doc_id", "left_semi")
        # what was put several times is one posting
        out = out.groupBy("doc_id", "field", "term_type", "term", "term_num", F.array_sort("labels").alias("labels")).agg(F.sum("n").alias("n"))
        return out.orderBy("term_type", "term_num", "term", "doc_id") if ordered else out


def between(low, high) -> Column:
    """Half-open range predicate on term or term_num, by the class of the bounds: texts, numbers or datetimes."""
    kind = lambda x: "text" if isinstance(x, str) else "time" if isinstance(x, datetime) else "number"
    if low is None and high is None:
        raise ValueError("one bound is needed")
    if low is not None and high is not None and kind(low) != kind(high):
        raise ValueError("bounds have to be of one class")
    one = low if low is not None else high
    if kind(one) == "time":
        out, time = F.col("term_type") == T.DATE, F.try_to_timestamp("term")
        bound = lambda x: F.lit(x.isoformat() + ("" if x.tzinfo else "Z")).cast("timestamp")
        out = out & (time >= bound(low)) if low is not None else out
        return out & (time < bound(high)) if high is not None else out
    if isinstance(one, str):
        if any(T.has_wildcards(x) for x in (low, high) if x):
            raise ValueError("bounds can't have wildcards")
        out = F.col("term_type") == T.STRING
        out = out & (F.col("term") >= low) if low is not None else out
        return out & (F.col("term") < high) if high is not None else out
    number = F.col("term_num")
    out = F.col("term_type") == T.NUMBER
    out = out & (number >= F.lit(str(low)).cast("decimal(38,18)")) if low is not None else out
    out = out & (number < F.lit(str(high)).cast("decimal(38,18)")) if high is not None else out
    if high is None:
        return out | ((F.col("term_type") == T.STRING) & (F.col("term") >= "@"))
    return out | ((F.col("term_type") != T.NUMBER) & (F.col("term") < "?")) if low is None else out


class Cache:
    """Sets of values kept for some hours, read in order from any value on."""

    HOURS = 3
    _pool = ThreadPoolExecutor(3)

    def __init__(self, tables: Tables):
        self.tables = tables

    def write(self, dataset: str, cache_id: str, values: DataFrame, hashed: bool = False, delegate_after: int | None = None) -> Future | None:
        """Put the distinct values of a column; null counts as empty. With ``delegate_after`` the first so many in order are
        written at once and the rest by a thread, whose future is returned. ``hashed`` keys are hashes."""
        value = F.coalesce(F.col(values.columns[0]).cast("string"), F.lit(""))
        rows = values.select(F.lit(dataset).alias("dataset"), F.lit(cache_id).alias("cache_id"), (hashing.hashed(value) if hashed else value).alias("key"), (value if hashed else F.lit("")).alias("value")).distinct().withColumn("ts", F.current_timestamp())
        if delegate_after is None:
            self.tables.append("cache", rows)
            return None
        first = page(rows, "key", limit=delegate_after)
        last = first.agg(F.max("key")).first()[0]
        self.tables.append("cache", first)
        rest = rows.where(F.col("key") > last) if last is not None else rows
        return self._pool.submit(self.tables.append, "cache", rest)

    def read(self, dataset: str, cache_id: str, start: str | None = None, limit: int | None = None, now: Column | None = None) -> DataFrame:
        """(key, value) in order from ``start`` on; ``limit`` is the size of a page."""
        out = self.tables.read("cache").where((F.col("dataset") == dataset) & (F.col("cache_id") == cache_id))
        now = F.current_timestamp() + F.expr("interval 1 second") if now is None else now
        return page(out.where(ix.age_off(F.col("ts"), self.HOURS, "HOURS", now)).select("key", "value").distinct(), "key", start, limit)

    def has_data(self, dataset: str, cache_id: str) -> bool:
        return not self.read(dataset, cache_id).isEmpty()

    def remove(self, dataset: str) -> None:
        self.tables.remove_dataset("cache", dataset)


def page(rows: DataFrame, key: str, start: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows in order of a key from a value on, the value included."""
    if start is not None:
        rows = rows.where(F.col(key) >= start)
    rows = rows.orderBy(key)
    return rows.limit(limit) if limit is not None else rows


SINKS = ("blobs", "postings", "counts", "hashes")


class DataStore:
    """JSON documents: stored, indexed, queried, and read as far as somebody may.

    With a registry and a user's name every access is checked against the user's permissions."""

    def __init__(self, spark: SparkSession, path: str, registry=None, user: str | None = None):
        self.tables = Tables(spark, path, registry, user)
        self.blobs, self.terms, self.cache = BlobStore(self.tables), TermStore(self.tables), Cache(self.tables)

    def is_ready(self) -> bool:
        return any(self.tables.exists(n) for n in SINKS)

    def create(self) -> bool:
        """All tables, empty; False if one was there."""
        return all([self.tables.create(n) for n in SCHEMAS])

    def destroy(self) -> None:
        for name in SCHEMAS:
            self.tables.check("DROP_TABLE", "blobs" if name in ("ids", "stale") else name)
        for name in SCHEMAS:
            self.tables._delete(self.tables.place(name))
            self.tables._delete(f"{self.tables.path}/_properties/{name}")
        self.tables._delete(f"{self.tables.path}/_log")

    def truncate(self) -> None:
        """No rows, but the tables and what is set for them stay."""
        there = [n for n in SCHEMAS if self.tables.exists(n)]
        for name in there:
            self.tables.check("WRITE", "blobs" if name in ("ids", "stale") else name)
        for name in there:
            self.tables._delete(self.tables.place(name))
            self.tables.spark.createDataFrame([], SCHEMAS[name]).write.parquet(self.tables.place(name))

    def persist(self, raw: DataFrame, keep: Column | None = None, sinks: tuple[str, ...] = SINKS, order: str | None = None, tokenizer: Callable[[Column], Column] = T.tokens) -> int:
        """(dataset, doc_id, json) written to some of the tables; the version of the write is returned.

        Documents of the same id are replaced: of several in raw the last counts, by the column ``order`` if one is
        named, else as they stand. What is written and read depends on raw and the documents that it replaces, not
        on the size of the dataset, but for the ids of its documents. Other kinds of blobs and terms put by hand
        stay. Counts of documents that were written without postings are not taken back. Rows with a null dataset or
        id are left out; json that is none is stored and not indexed."""
        if wrong := set(sinks) - set(SINKS):
            raise ValueError(f"unknown sinks {sorted(wrong)}")
        for name in sinks:
            self.tables.check("WRITE", name)
        t = self.tables
        version = t.begin()
        beside = t.beside("raw")
        by = F.col(order) if order else F.monotonically_increasing_id()
        own = raw.select("dataset", F.col("doc_id").cast("string").alias("doc_id"), "json", by.alias("_by")).where("dataset is not null and doc_id is not null")
        ix.latest(own.withColumn("_place", F.monotonically_increasing_id()), ["dataset", "doc_id"], ["_by", "_place"]).select("dataset", "doc_id", "json").write.parquet(beside)
        staged = t.spark.read.parquet(beside)
        replaced = self._replaced(staged, beside)
        stamp = lambda rows: rows.withColumn("version", F.lit(version))
        self._index(staged, version, beside, keep, tokenizer, sinks, replaced)
        if "blobs" in sinks:
            t.append("blobs", stamp(ix.blobs(staged)), ix.blob_columns())
        t._write("ids", stamp(staged.select("dataset", "doc_id")), t.place("ids"))
        if replaced is not None and {"postings", "hashes"} & set(sinks):
            t._write("stale", stamp(replaced), t.place("stale"))
        t.done(version)
        for end in ("", "_ids", "_values"):
            t._delete(f"{beside}{end}")
        return version

    def _index(self, staged: DataFrame, version: int, beside: str, keep: Column | None, tokenizer: Callable[[Column], Column], sinks: tuple[str, ...], replaced: DataFrame | None) -> None:
        """Postings, counts and hashes of staged documents. They are taken apart once, and counted from what is written."""
        if not {"postings", "counts", "hashes"} & set(sinks):
            return
        t = self.tables
        ix.values(staged, keep).write.parquet(f"{beside}_values")
        # documents are dealt out by how much there is of them: a task's sort is as large for many as for few
        of = pieces(t.spark.read.parquet(f"{beside}_values"), t.size(f"{beside}_values"), "dataset", "doc_id")
        stamp = lambda rows: rows.withColumn("version", F.lit(version))
        found = ix.counted(of, tokenizer)
        if "postings" in sinks:
            t.append("postings", stamp(both_ways(found)), ix.posting_columns())
            found = t._load("postings", versions=False).where((F.col("version") == version) & (F.col("way") == FORWARD))
        if "counts" in sinks:
            added = ix.counts(found)
            if replaced is not None:
                old = t._current("postings").where((F.col("way") == FORWARD) & F.col("version").isNotNull()).join(replaced, ["dataset", "doc_id"], "left_semi")
                added = added.unionByName(ix.counts(old).withColumn("n_docs", -F.col("n_docs")))
            t.append("counts", stamp(both_ways(added)), ix.count_columns())
        if "hashes" in sinks:
            t.append("hashes", stamp(ix.hashes(of)))

    def _replaced(self, staged: DataFrame, beside: str) -> DataFrame | None:
        """(dataset, doc_id) of staged documents that are there already, or None if there is none."""
        if not self.tables.exists("ids"):
            return None
        known = staged.select("dataset", "doc_id").join(self.tables._load("ids"), ["dataset", "doc_id"], "left_semi")
        known.write.parquet(f"{beside}_ids")
        ids = self.tables.spark.read.schema("dataset string, doc_id string").parquet(f"{beside}_ids")
        return None if ids.isEmpty() else ids

    def reindex(self, dataset: str, keep: Column | None = None, tokenizer: Callable[[Column], Column] = T.tokens) -> None:
        """Postings, counts and hashes again from the blobs; terms put by hand go, as all of the dataset's."""
        t = self.tables
        raw = ix.latest(t._load("blobs").where((F.col("dataset") == dataset) & (F.col("kind") == "JSO")), ["dataset", "key"], ["version"])
        beside = t.beside("raw")
        raw.select("dataset", F.col("key").alias("doc_id"), F.col("value").alias("json")).write.parquet(beside)
        for name in ("postings", "counts", "hashes"):
            t.remove_dataset(name, dataset)
        version = t.begin()
        self._index(t.spark.read.parquet(beside), version, beside, keep, tokenizer, ("postings", "counts", "hashes"), None)
        t.done(version)
        for end in ("", "_values"):
            t._delete(f"{beside}{end}")

    def compact(self) -> None:
        """One current version of every row in files of even sizes; all datasets in one job for each table."""
        t = self.tables
        latest = t.begin()
        for name in SCHEMAS:
            if not t.exists(name) or name == "stale":
                continue
            t.check("ALTER_TABLE", "blobs" if name == "ids" else name)
            rows = t._load(name) if name == "ids" else t._current(name)
            if name == "blobs":
                whole = ix.latest(rows.where("kind <> 'ARR'"), ["dataset", "kind", "key"], ["version"])
                rows = whole.unionByName(rows.where("kind = 'ARR'"))
            elif name == "counts":
                rows = rows.groupBy("dataset", "way", "field", "term_type", "term", "term_rev", "term_num", F.array_sort("labels").alias("labels")).agg(F.sum("n_docs").alias("n_docs"), F.max("version").alias("version")).where("n_docs > 0")
            elif name == "ids":
                rows = rows.groupBy("dataset", "doc_id").agg(F.max("version").alias("version"))
            # as many files as the data make, of even sizes, whatever each dataset's share is
            t._swap(name, rows.hint("rebalance", *t._parts(name)))
        t._delete(t.place("stale"))
        for entry in t._list(f"{t.path}/_log"):
            if not entry.startswith(f"{latest:012d}"):
                t._delete(f"{t.path}/_log/{entry}")
        t.done(latest)

    def remove(self, dataset: str) -> None:
        for name in SCHEMAS:
            if name in ("ids", "stale"):
                self.tables._delete(f"{self.tables.place(name)}/{self.tables._folder(dataset)}")
            else:
                self.tables.remove_dataset(name, dataset)

    def planner(self, auths: set[str], dataset: str, tokenize: bool = False) -> Planner:
        return Planner(self.tables.read("postings"), self.tables.read("counts"), dataset, auths, T.query_tokens if tokenize else None)

    def query(self, auths: set[str], dataset: str, text: str, tokenize: bool = False, among: DataFrame | None = None) -> DataFrame:
        """Sorted doc_id of a query."""
        return self.planner(auths, dataset, tokenize).sorted_ids(build(text), among)

    def estimate(self, auths: set[str], dataset: str, text: str, tokenize: bool = False) -> int:
        """Documents that a query may have, from the counts; runs one job."""
        return self.planner(auths, dataset, tokenize).estimate(build(text))

    def jsons(self, auths: set[str], dataset: str, fields: list[str] | None = None, ids: DataFrame | None = None, wanted: dict[str, str] | None = None, ordered: bool = False) -> DataFrame:
        return self.blobs.get(auths, dataset, "JSO", ids, fields, wanted, ordered)

    def match_hash(self, dataset: str, field: str, digest: str, auths: set[str] | None = None) -> DataFrame:
        """doc_id whose field, a name or wildcard, has a value of this hash. Without auths labels are not looked at."""
        found = self.tables.read("hashes").where((F.col("dataset") == dataset) & (F.col("hash") == digest)).where(T.wildcard(F.col("field"), field))
        if auths is not None:
            seen = self.tables.read("postings").where((F.col("dataset") == dataset) & (F.col("way") == FORWARD) & visible(F.col("labels"), narrow(auths, dataset)))
            found = found.join(seen.select("doc_id", "field").distinct(), ["doc_id", "field"], "left_semi")
        return found.select("doc_id").distinct()

    def match_value(self, dataset: str, field: str, value, auths: set[str] | None = None) -> DataFrame:
        """The same for a value; dates as ISO instants, as they are indexed."""
        text = value.strftime("%Y-%m-%dT%H:%M:%SZ") if hasattr(value, "strftime") else str(value).lower() if isinstance(value, bool) else str(value)
        return self.match_hash(dataset, field, hashing.hash_text(text), auths)

    # permissions of whole stores

    def grant(self, user: str, store: str, permission: str) -> None:
        """READ, WRITE or ALTER_TABLE on the tables of blobstore, termstore or cache, given by who may GRANT."""
        for name in STORES[store]:
            self.tables.check("GRANT", name)
            self.tables.registry.grant(user, permission, name)

    def revoke(self, user: str, store: str, permission: str) -> None:
        for name in STORES[store]:
            self.tables.check("GRANT", name)
            self.tables.registry.revoke(user, permission, name)
