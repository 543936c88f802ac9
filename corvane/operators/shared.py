"""The folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new place in spark.checkpoint.dir; only where that is unset and the master is local, in a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = _made.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="corvane-")
        _made[spark.sparkContext.applicationId] = named
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes of a table for each core up to which few files are spread over all cores.
SMALL_BYTES = 16 << 20


def widened(rows: DataFrame) -> DataFrame:
    """A table as it is read, but a small one of fewer files than cores dealt out to all of them: a file of one row group
    is one task's work, however much is made of it."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = rows.inputFiles()
    if not 0 < len(files) < cores:
        return rows
    size = 0
    for f in files:
        where = spark._jvm.org.apache.hadoop.fs.Path(f)
        size += where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).getLen()
    return rows.repartition(cores) if size < cores * SMALL_BYTES else rows


#: Bytes of stored rows that a task takes apart and sorts, and those from which on it is worth a task.
PIECE_BYTES, LEAST_BYTES = 2 << 20, 1 << 17


def pieces(rows: DataFrame, size: int, *by: str) -> DataFrame:
    """Rows dealt out by columns to tasks, as many as the bytes that they are stored in make. Their number is set, so that
    Spark doesn't join them to fewer, whose memory grows with the table."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, -(-size // PIECE_BYTES), min(cores, size // LEAST_BYTES)), *by)
