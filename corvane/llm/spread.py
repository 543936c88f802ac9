"""Lineage cuts and small helpers that the operators share."""

from __future__ import annotations

import ctypes
import tempfile

from pyspark.sql import DataFrame


def checkpoint_dir(spark) -> str:
    """The shared folder the cluster names; a temporary one only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="corvane-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder: lost executors don't redo them."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def trim() -> None:
    """Give the memory of arrays that are gone back to the system, where its allocator can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores as keep them apart from the columns of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
