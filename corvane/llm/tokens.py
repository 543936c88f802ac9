"""Token ids as Parquet: list columns that can be read in part.

Token ids are dictionary-encoded (a vocabulary's ids repeat), or delta-encoded on request; end offsets,
which rise, are delta-encoded. Files hold ranges of doc_id that don't overlap (but for the rows of one
doc_id that itself is spread over several), in order, so that a lookup opens one of them. Row groups and
pages are of a controlled size, and every page has its place and its lowest and highest
values in the page index, so a reader of some documents fetches their pages, and a reader
of metadata no token at all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe
from corvane.llm.spread import checkpoint_dir

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 1000
ENCODINGS = {"token_ids": "dictionary", "token_ends": "delta"}


def write(tokens: DataFrame, path: str, encodings: dict[str, str] = ENCODINGS, row_group: int = ROW_GROUP_BYTES, page: int = PAGE_BYTES, page_rows: int = PAGE_ROWS, mode: str = "errorifexists", ordered: bool = False) -> None:
    """Write (doc_id, ..., list columns of integers) to a Parquet folder.

    Every column is written, whatever it is named; null lists, empty lists and nulls in
    lists are kept, so are repeated rows. Rows of a null doc_id come first in a file. An
    empty table becomes a folder with the schema. Needs a column doc_id. ``ordered`` says that
    the rows of each partition are in order of doc_id already."""
    if wrong := {v for v in encodings.values()} - {"dictionary", "delta"}:
        raise ValueError(f"unknown encodings {sorted(wrong)}")
    if min(row_group, page, page_rows) < 1:
        raise ValueError("sizes have to be positive")
    options = {"parquet.block.size": row_group, "parquet.page.size": page, "parquet.page.row.count.limit": page_rows, "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true", "compression": "lz4_raw"}
    for column, encoding in encodings.items():
        # without a dictionary, the second version of the format writes integers as deltas
        options[f"parquet.enable.dictionary#{column}.list.element"] = str(encoding == "dictionary").lower()
    (tokens if ordered else tokens.sortWithinPartitions("doc_id")).write.mode(mode).options(**options).parquet(path)


def read(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Some columns of the rows that meet a condition; the condition is pushed down to row
    groups and pages, and columns that are not asked for are not read."""
    rows = spark.read.parquet(path)
    if where is not None:
        rows = rows.where(where)
    return rows.select(*columns) if columns is not None else rows


def folder(spark: SparkSession) -> str:
    """A new place in the folder that the cluster shares; ``remove`` deletes it."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored folder when nobody reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def by_id(docs: DataFrame) -> DataFrame:
    """docs in ranges of doc_id, in order. The texts move, which are smaller than their tokens; rows of one doc_id
    are many ranges if they have to be, by the hash of the text."""
    return docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")


def output(docs: DataFrame, vocabulary: str = bpe.DEFAULT_VOCABULARY, path: str | None = None, ends: bool = False) -> DataFrame:
    """(doc_id, n_tokens, token_ids) of every row of docs, as read back from what was written.

    Runs the jobs that write when it is called. With ``ends`` there is a column token_ends, the byte offsets at
    which the tokens end; by default there is none, as the lengths of the tokens add up to it. A null text has null
    lists and 0 tokens, an empty one empty lists; null ids are kept, repeated rows too. Other columns of docs are
    not stored: they are one join on doc_id away."""
    spark = docs.sparkSession
    path = path or folder(spark)
    ranged = by_id(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]))
    write(bpe.encode(ranged, vocabulary, ends).select("doc_id", "n_tokens", "token_ids", *["token_ends"] * ends), path, ordered=True)
    return read(spark, path)


def metadata(stored: DataFrame) -> DataFrame:
    """(doc_id, n_tokens) without reading a token."""
    return stored.select("doc_id", F.col("n_tokens"))
