"""Bounded samples of labelled documents for the classifiers that are trained here."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a text beyond which it isn't taken into a sample.
SAMPLE_CHARS = 200_000


#: Candidates up to which they are sent to every task.
BROADCAST_ROWS = 1_000_000


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, columns: list[str], chars: int = SAMPLE_CHARS) -> list[tuple]:
    """[(label, doc_id, *columns)] of at most ``per_class`` documents of each class.

    Which ones: of those that are in docs, those with the lowest hash of doc_id, so the
    choice depends neither on partitions nor on order. Sampled texts are read whole; one
    of more than ``chars`` characters isn't used, so that the sample fits the driver. Rows
    whose label, id or text is null, or label neither 0 nor 1, are left out; ids with
    contradicting labels too. Of several rows of one id the first in order counts.

    Labels need not be in docs: twice per_class ids are looked up at first, and eight
    times as many while a class falls short and has more."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("high")).where("label = high").select("doc_id", "label")
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    text = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *[docs[c] for c in columns]).where(F.length("text") <= chars)
    ask, total = 2 * per_class, None
    while True:
        asked = known.where("label = 0").orderBy(*order).limit(ask).union(known.where("label = 1").orderBy(*order).limit(ask))
        found = text.join(F.broadcast(asked) if 2 * ask <= BROADCAST_ROWS else asked, "doc_id").groupBy("label", "doc_id").agg(F.min(F.struct(*columns)).alias("row"))
        first = found.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(*order))).where(F.col("place") <= per_class)
        out = [tuple(r) for r in first.select("label", "doc_id", *[F.col("row")[c] for c in columns]).collect()]
        short = [y for y in (0, 1) if sum(r[0] == y for r in out) < per_class]
        if short and total is None:
            total = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
        if not any(total.get(y, 0) > ask for y in short):
            return sorted(out, key=lambda r: r[1])
        ask *= 8


def held_out(doc_id: int) -> bool:
    """A fifth of the sample is kept from training, to set thresholds."""
    return (doc_id * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 32 < (1 << 32) // 5
