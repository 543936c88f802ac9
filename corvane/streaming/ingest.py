"""Documents indexed as they arrive, counts kept up to date, rows that age."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import tokens
from corvane.operators.stores import DataStore


def lines(spark: SparkSession, path: str, dataset: str, id_field: str, files: int = 100) -> DataFrame:
    """A stream of (dataset, doc_id, json) from a folder that JSON lines are put into."""
    raw = spark.readStream.option("maxFilesPerTrigger", files).text(path).where(F.trim("value") != "")
    doc = F.get_json_object("value", f"$['{id_field}']")
    return raw.where(F.try_parse_json("value").isNotNull() & doc.isNotNull()).select(F.lit(dataset).alias("dataset"), doc.alias("doc_id"), F.col("value").alias("json"))


def index_stream(docs: DataFrame, store: DataStore, checkpoint: str, available_now: bool = True):
    """Persist each micro-batch, at the cost of the batch, not of what is stored. A batch that is done again replaces its
    own documents."""
    writer = docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: store.persist(batch) and None)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def term_counts(docs: DataFrame, column: str) -> DataFrame:
    """Running occurrences of each token; for the update or complete output mode."""
    return docs.select(F.explode(tokens(F.col(column))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def retained(events: DataFrame, ts: str, ttl: str, keys: list[str]) -> DataFrame:
    """Counts by key of events in windows of ttl; what is later than a ttl is dropped with its state."""
    return events.withWatermark(ts, ttl).groupBy(F.window(ts, ttl), *keys).agg(F.count("*").alias("n"))
