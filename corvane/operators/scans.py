"""Things that go along an ordered scan: running numbers, the first row, a stop; and iterators by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import jsonops
from corvane.functions import text as T
from corvane.operators import index as ix
from corvane.operators.shared import folder


def indexed(rows: DataFrame, by: list[str], name: str = "index") -> DataFrame:
    """Rows with their running number from 0 in an order; rows that tie are numbered in any order.

    Ranges of the order are written to the shared folder when this is called, so that the number of a range is the
    same whenever it is read; each then numbers its own rows, and only the sizes of the ranges meet in one place."""
    spark = rows.sparkSession
    place = folder(spark, "indexed")
    rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()).write.parquet(place)
    ranged = spark.read.parquet(place)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    numbered = ranged.withColumn(name, F.row_number().over(Window.partitionBy("_part").orderBy(*by)))
    return numbered.join(F.broadcast(before), "_part").withColumn(name, F.col(name) - 1 + F.col("_before")).drop("_part", "_before")


def first(rows: DataFrame, by: list[str]) -> DataFrame:
    """The first row in an order."""
    return rows.orderBy(*by).limit(1)


def until(rows: DataFrame, by: str, stop: Column) -> DataFrame:
    """Rows in order up to the first that says stop, which is left out as are rows with its key."""
    end = rows.where(stop).agg(F.min(by).alias("_end"))
    return rows.crossJoin(F.broadcast(end)).where(F.col("_end").isNull() | (F.col(by) < F.col("_end"))).drop("_end").orderBy(by)


@dataclass(frozen=True)
class Iterator:
    """A filter or transformation of a scan that is put together from texts."""

    options: dict[str, str]
    make: Callable[[dict[str, str]], Callable[[DataFrame], DataFrame]]
    required: frozenset[str] = frozenset()

    def validate(self, given: dict[str, str]) -> bool:
        return set(given) <= set(self.options) and self.required <= set(given)


def _wildcards(o: dict[str, str]) -> Callable[[DataFrame], DataFrame]:
    columns = [c for c in ("row", "family", "qualifier") if c in o]
    every = o.get("and", "false").lower() == "true"

    def run(rows: DataFrame) -> DataFrame:
        out = F.lit(every)
        for c in columns:
            one = T.wildcard_filter(F.col(c), [o[c]], True)
            out = (out & one) if every else (out | one)
        return rows.where(out)

    return run


ITERATORS = {
    "wildcard": Iterator({"row": "pattern of the row", "family": "pattern of the family", "qualifier": "pattern of the qualifier", "and": "whether all have to match"}, _wildcards),
    "age_off": Iterator({"ttl": "a number", "units": "DAYS, HOURS, MINUTES, SECONDS or MILLISECONDS"}, lambda o: lambda rows: rows.where(ix.age_off(F.col("ts"), float(o["ttl"]), o["units"], F.current_timestamp())), frozenset(["ttl", "units"])),
    "fields": Iterator({"fields": "patterns with commas between them"}, lambda o: lambda rows: rows.where(T.any_wildcard(F.col("field"), o["fields"].split(","))), frozenset(["fields"])),
    "project": Iterator({"fields": "patterns of paths with commas between them"}, lambda o: lambda rows: rows.withColumn("value", jsonops.project(F.col("value"), o["fields"].split(","))), frozenset(["fields"])),
    "mask": Iterator({"dataset": "name of the dataset", "auths": "labels with commas between them", "salt": "put before each value"}, lambda o: lambda rows: rows.withColumn("value", jsonops.mask(F.col("value"), o["dataset"], set(o["auths"].split(",")), o.get("salt"))), frozenset(["dataset", "auths"])),
}


def apply(rows: DataFrame, name: str, options: dict[str, str]) -> DataFrame:
    """Rows through an iterator; unknown and missing options are an error."""
    if not ITERATORS[name].validate(options):
        raise ValueError(f"options of {name} are {ITERATORS[name].options}, not {options}")
    return ITERATORS[name].make(options)(rows)
