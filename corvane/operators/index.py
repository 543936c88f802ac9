"""Relations of the index, each declared once over the raw documents; see ``tables`` for their columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.hashing import hashed
from corvane.functions.jsonops import flat_rows
from corvane.functions.security import ADM, RAW_DATA, label_column, path_labels_column


def values(raw: DataFrame, keep: Column | None = None) -> DataFrame:
    """(dataset, doc_id, path, field, text, term_type) of every value that is indexed: not null, no name
    with a leading underscore, and kept by a predicate on path if one is given."""
    flat = flat_rows(raw, ["dataset", "doc_id"], "json").where(F.col("text").isNotNull() & ~F.col("path").rlike(r"(^|¤)_"))
    if keep is not None:
        flat = flat.where(keep)
    kind = F.when(F.col("kind") == "n", T.NUMBER).when(F.col("kind") == "b", T.BOOLEAN).otherwise(T.term_type(F.col("text")))
    return flat.select("dataset", "doc_id", "path", T.general_field(F.col("path")).alias("field"), "text", kind.cast("tinyint").alias("term_type"))


def occurrences(of: DataFrame, tokenizer: Callable[[Column], Column] = T.tokens) -> DataFrame:
    """(dataset, doc_id, field, term_type, term), one row an occurrence: tokens of strings, typed values whole.
    What looks like base64 has no tokens, and empty terms are dropped."""
    plain = of.withColumn("trimmed", F.trim("text"))
    words = F.when(F.col("term_type") != T.STRING, F.array("trimmed")).when(T.looks_base64(F.col("trimmed")), F.array().cast("array<string>")).otherwise(tokenizer(F.col("trimmed")))
    return plain.select("dataset", "doc_id", "field", "term_type", F.explode(words).alias("term")).where("term <> ''")


def _field_labels() -> Column:
    start = F.concat(label_column(F.col("dataset")), F.lit("_"))
    one = F.array(F.concat(start, label_column(F.col("field"))))
    return F.when(~F.contains("field", F.lit(T.SEPARATOR)), one).otherwise(F.transform(path_labels_column(F.col("field")), lambda x: F.concat(start, x)))


def counted(of: DataFrame, tokenizer: Callable[[Column], Column] = T.tokens) -> DataFrame:
    """(dataset, doc_id, field, term_type, term, n): occurrences counted by document, field and term; the partial counts
    are made before the shuffle."""
    return occurrences(of, tokenizer).groupBy("dataset", "doc_id", "field", "term_type", "term").agg(F.count("*").alias("n"))


def posting_columns() -> dict[str, Column]:
    """What postings have besides, made of what is counted."""
    document = F.concat(label_column(F.col("dataset")), F.lit("_"), label_column(F.col("doc_id")))
    return {"term_num": T.term_number(F.col("term"), F.col("term_type")), "labels": F.array_distinct(F.concat(F.array(F.lit(ADM)), _field_labels(), F.array(document)))}


def postings(of: DataFrame, tokenizer: Callable[[Column], Column] = T.tokens) -> DataFrame:
    """What is counted, with all columns."""
    return counted(of, tokenizer).withColumns(posting_columns()).select("dataset", "doc_id", "field", "term_type", "term", "term_num", "labels", "n")


def counts(of: DataFrame) -> DataFrame:
    """Documents that have each term, from postings, which have one row for each."""
    return of.groupBy("dataset", "field", "term_type", "term").agg(F.count("*").alias("n_docs"))


def count_columns() -> dict[str, Column]:
    """What counts have besides."""
    labels = F.array_distinct(F.concat(F.array(F.lit(ADM)), _field_labels()))
    return {"term_num": T.term_number(F.col("term"), F.col("term_type")), "labels": labels}


def hashes(of: DataFrame) -> DataFrame:
    """Hash of the text of every value."""
    return of.select("dataset", "field", hashed(F.col("text")).alias("hash"), "doc_id").distinct()


def blobs(raw: DataFrame) -> DataFrame:
    return raw.select("dataset", F.col("doc_id").alias("key"), F.lit("JSO").alias("kind"), F.col("json").alias("value"))


def blob_columns() -> dict[str, Column]:
    """What blobs of documents have besides."""
    start = label_column(F.col("dataset"))
    labels = F.array_distinct(F.array(F.lit(ADM), F.concat(start, F.lit(f"_{RAW_DATA}")), F.concat(start, F.lit("_"), label_column(F.col("key")))))
    return {"type": F.lit("JSO"), "properties": F.array().cast("array<string>"), "labels": labels, "ts": F.current_timestamp()}


def text_postings(table: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(doc_id, field, term_type, term, n) of text columns of a table; all in built-in functions."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), T.tokens(F.col(f)).alias("words")) for f in fields])).alias("p")
    words = table.select(F.col(key).alias("doc_id"), pairs).select("doc_id", "p.field", F.explode("p.words").alias("term"))
    return words.groupBy("doc_id", "field", "term").agg(F.count("*").alias("n")).withColumn("term_type", F.lit(T.STRING).cast("tinyint")).withColumn("term_num", F.lit(None).cast("decimal(38,18)"))


def sum_counts(table: DataFrame, keys: list[str], value: str, name: str = "n") -> DataFrame:
    """Sum by key of texts of numbers; what is none counts as 0."""
    return table.groupBy(*keys).agg(F.sum(F.coalesce(F.col(value).try_cast("bigint"), F.lit(0).cast("bigint"))).alias(name))


def sum_spans(table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sum of the leading counts and all further parts of values whose parts a NUL separates."""
    parts = F.split(F.col(value), "\0")
    return table.groupBy(*keys).agg(F.sum(F.coalesce(parts[0].try_cast("bigint"), F.lit(0).cast("bigint"))).alias("n"), F.flatten(F.collect_list(F.slice(parts, 2, 1 << 30))).alias("spans"))


def array_parts(value: Column) -> Column:
    """The NUL-separated, trimmed, non-empty parts of a value."""
    return F.filter(F.transform(F.split(value, "\0"), lambda x: F.trim(x)), lambda x: x != "")


def union_arrays(table: DataFrame, keys: list[str], value: str, name: str = "value") -> DataFrame:
    """Sorted set of the NUL-separated, trimmed, non-empty parts by key."""
    parts = table.select(*keys, F.explode(F.split(F.col(value), "\0")).alias("part")).select(*keys, F.trim("part").alias("part")).where("part <> ''")
    return parts.groupBy(*keys).agg(F.array_sort(F.collect_set("part")).alias(name))


def latest(table: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The last row of each key. An aggregate, so that it combines before the shuffle."""
    rest = [c for c in table.columns if c not in keys]
    best = table.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("last"))
    return best.select(*keys, *[F.col("last")[c].alias(c) for c in rest])


def age_off(ts: Column, ttl: float, unit: str, now: Column) -> Column:
    """now - ttl <= ts < now, with ``now`` fixed for the query."""
    sizes = {"DAYS": 86_400, "HOURS": 3_600, "MINUTES": 60, "SECONDS": 1, "MILLISECONDS": 1e-3}
    if unit not in sizes:
        raise ValueError(f"unknown unit {unit}")
    return (ts >= now - F.make_dt_interval(secs=F.lit(ttl * sizes[unit]).cast("decimal(18,6)"))) & (ts < now)
