"""Raw cells (row, family, qualifier, visibility, value) in and out of the relations.

Parts of a row or qualifier are separated by NULs: a blob's row is dataset and key, its qualifier its properties; a
term's row is dataset and term, its family the direction, its qualifier document, field and type. Labels of a
visibility stand between bars. A NUL inside a part is written as its six-character escape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators.tables import BACKWARD, FORWARD

NUL = "\0"
#: Families of postings and counts by direction.
POSTING_FAMILIES = {FORWARD: "FIDX", BACKWARD: "BIDX"}
COUNT_FAMILIES = {FORWARD: "FCNT", BACKWARD: "BCNT"}


def encode(text: Column) -> Column:
    """NULs as their escape."""
    return F.replace(text, F.lit(NUL), F.lit("\\u0000"))


def decode(text: Column) -> Column:
    return F.replace(text, F.lit("\\u0000"), F.lit(NUL))


def _labels(visibility: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(visibility, F.lit("")), r"\|"), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def _after(text: Column, first: Column) -> Column:
    """What follows the first NUL."""
    return F.substring(text, F.length(first) + 2, F.length(text))


def blobs_from_cells(cells: DataFrame) -> DataFrame:
    """(dataset, key, type, kind, properties, labels, value): rows without a NUL, or of another family, are left out."""
    dataset = F.split("row", NUL)[0]
    kind = F.when(F.col("family").startswith("ARR"), "ARR").otherwise(F.col("family"))
    out = cells.where(F.contains(F.col("row"), F.lit(NUL)) & kind.isin("STR", "JSO", "FIL", "ARR"))
    properties = F.filter(F.transform(F.split(F.coalesce("qualifier", F.lit("")), NUL), lambda x: F.trim(x)), lambda x: x != "")
    return out.select(dataset.alias("dataset"), _after(F.col("row"), dataset).alias("key"), F.col("family").alias("type"), kind.alias("kind"), properties.alias("properties"), _labels(F.col("visibility")).alias("labels"), F.col("value").cast("string").alias("value"))


def _terms(cells: DataFrame, families: dict[str, str]) -> DataFrame:
    dataset = F.split("row", NUL)[0]
    back = F.col("family") == families[BACKWARD]
    term = _after(F.col("row"), dataset)
    own = cells.where(F.col("family").isin(list(families.values())) & F.contains(F.col("row"), F.lit(NUL)))
    return own.select(dataset.alias("dataset"), F.when(back, BACKWARD).otherwise(FORWARD).alias("way"), F.when(back, F.reverse(term)).otherwise(term).alias("term"), F.split("qualifier", NUL).alias("_parts"), _labels(F.col("visibility")).alias("labels"), F.split(F.col("value").cast("string"), NUL)[0].cast("bigint").alias("n"))


def terms_from_cells(cells: DataFrame) -> DataFrame:
    """(dataset, way, doc_id, field, term_type, term, labels, n). Backward terms are turned round; a qualifier without a
    type has type 0; spans that follow the count are not kept."""
    parts = F.col("_parts")
    kind = F.when(F.size(parts) > 2, F.element_at(parts, -1).try_cast("tinyint")).otherwise(F.lit(T.UNKNOWN).cast("tinyint"))
    name = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), NUL)).otherwise(F.element_at(parts, -1))
    return _terms(cells, POSTING_FAMILIES).where(F.size("_parts") > 1).select("dataset", "way", parts[0].alias("doc_id"), name.alias("field"), kind.alias("term_type"), "term", "labels", "n")


def counts_from_cells(cells: DataFrame) -> DataFrame:
    """(dataset, way, field, term_type, term, labels, n_docs)."""
    parts = F.col("_parts")
    kind = F.when(F.size(parts) > 1, F.get(parts, F.lit(1)).try_cast("tinyint")).otherwise(F.lit(T.UNKNOWN).cast("tinyint"))
    return _terms(cells, COUNT_FAMILIES).select("dataset", "way", parts[0].alias("field"), kind.alias("term_type"), "term", "labels", F.col("n").alias("n_docs"))


def blob_cells(blobs: DataFrame) -> DataFrame:
    """Cells of (dataset, key, type, properties, labels, value)."""
    return blobs.select(F.concat_ws(NUL, "dataset", "key").alias("row"), F.col("type").alias("family"), F.array_join("properties", NUL).alias("qualifier"), F.array_join("labels", "|").alias("visibility"), "value")


def term_cells(postings: DataFrame) -> DataFrame:
    """Cells of (dataset, way, doc_id, field, term_type, term, labels, n)."""
    back = F.col("way") == BACKWARD
    return postings.select(
        F.concat_ws(NUL, "dataset", F.when(back, F.reverse("term")).otherwise(F.col("term"))).alias("row"),
        F.when(back, POSTING_FAMILIES[BACKWARD]).otherwise(POSTING_FAMILIES[FORWARD]).alias("family"),
        F.concat_ws(NUL, "doc_id", "field", F.col("term_type").cast("string")).alias("qualifier"),
        F.array_join("labels", "|").alias("visibility"),
        F.col("n").cast("string").alias("value"),
    )


def count_cells(counts: DataFrame) -> DataFrame:
    """Cells of (dataset, way, field, term_type, term, labels, n_docs)."""
    back = F.col("way") == BACKWARD
    return counts.select(
        F.concat_ws(NUL, "dataset", F.when(back, F.reverse("term")).otherwise(F.col("term"))).alias("row"),
        F.when(back, COUNT_FAMILIES[BACKWARD]).otherwise(COUNT_FAMILIES[FORWARD]).alias("family"),
        F.concat_ws(NUL, "field", F.col("term_type").cast("string")).alias("qualifier"),
        F.array_join("labels", "|").alias("visibility"),
        F.col("n_docs").cast("string").alias("value"),
    )
