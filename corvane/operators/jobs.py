"""Jobs over the tables of a store: a source as far as somebody may see it, a mapper, a reducer, a sink.

A mapper sees Arrow batches. A reducer sees one key at a time, as an iterator of Arrow batches of its rows, so a key
of any number of rows takes the memory of a batch; a combiner, an aggregate of Catalyst's, comes before the shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.security import visible
from corvane.operators.tables import SCHEMAS, Tables

Mapper = Callable[[pa.RecordBatch], pa.RecordBatch]
Reducer = Callable[[tuple, Iterator[pa.RecordBatch]], pa.RecordBatch]


def source(tables: Tables, name: str, auths: set[str] | None, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """Rows of a table whose labels somebody holds; tables without labels are read whole."""
    rows = tables.read(name)
    if "labels" in rows.columns:
        rows = rows.where(visible(F.col("labels"), auths))
    if where is not None:
        rows = rows.where(where)
    return rows.select(*columns) if columns else rows


def mapped(rows: DataFrame, mapper: Mapper, schema: str) -> DataFrame:
    """What a mapper makes of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield mapper(batch)

    return rows.mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Pieces of sorted batches that have one key each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys)))
        first = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or values[i] != values[first]:
                yield values[first], batch.slice(first, i - first)
                first = i


def reduced(rows: DataFrame, keys: list[str], reducer: Reducer, schema: str, combiner: list[Column] | None = None, salts: int = 1) -> DataFrame:
    """What a reducer makes of each key. With a combiner, aggregates named as the columns that the reducer reads, it has one
    row a key to read. With ``salts`` every key is so many tasks' work at first, and what they make of it is reduced once
    more: for reducers that can read what they return."""
    if combiner:
        rows = rows.groupBy(*keys).agg(*combiner)
    if salts > 1:
        salted = rows.withColumn("_salt", F.monotonically_increasing_id() % salts)
        first = reduced(salted, [*keys, "_salt"], lambda key, batches: reducer(key[:-1], (b.drop_columns(["_salt"]) for b in batches)), schema)
        return reduced(first, keys, reducer, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _runs(batches, keys)
        ahead = next(pieces, None)
        while ahead is not None:
            key, first = ahead
            after: list = [None]

            def own(key: tuple = key, first: pa.RecordBatch = first, after: list = after) -> Iterator[pa.RecordBatch]:
                yield first
                for other, piece in pieces:
                    if other != key:
                        after[0] = (other, piece)
                        return
                    yield piece

            rest = own()
            yield reducer(key, rest)
            for _ in rest:  # what the reducer has not read
                pass
            ahead = after[0]

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def sink(tables: Tables, name: str, rows: DataFrame) -> None:
    """Append to a table of the store, which is made of the columns of rows if there is none."""
    if not tables.exists(name):
        tables.create(name, None if name in SCHEMAS else ", ".join(f"{c} {t}" for c, t in rows.dtypes))
    tables.append(name, rows)
