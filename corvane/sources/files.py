"""JSON lines in, backups and hash files out, folders of files as blobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, dataset: str, id_field: str) -> DataFrame:
    """(dataset, doc_id, json) of a file or folder of one object a line, gzip or not. Blank lines,
    lines that are no JSON and lines without the id are left out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    doc = F.get_json_object("value", f"$['{id_field}']")
    parsed = F.try_parse_json("value").isNotNull()
    return lines.where(parsed & doc.isNotNull()).select(F.lit(dataset).alias("dataset"), doc.alias("doc_id"), F.col("value").alias("json"))


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where((F.trim("value") != "") & F.try_parse_json("value").isNull())


def backup(jsons: DataFrame, path: str) -> None:
    """One document a line, gzip."""
    jsons.select("value").write.mode("overwrite").option("compression", "gzip").text(path)


def hash_file(hashes: DataFrame, path: str) -> None:
    """dataset, field, hash and document, tabs between them, gzip."""
    hashes.select("dataset", "field", "hash", "doc_id").write.mode("overwrite").option("sep", "\t").option("compression", "gzip").csv(path)


def binary_files(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """(dataset, key, name, value) of a folder's files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.lit(dataset).alias("dataset"), F.col("path").alias("key"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("value"))
