"""Shared pieces: words, row keys, checkpoints and sizes."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, as a Java/Python character class, and as plain text for trimming.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+`; empty for null or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def word_count(text: Column) -> Column:
    """Number of words (long); 0 for null."""
    return F.size(words_of(text)).cast("long")


def row_key(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes of the given values, nulls kept apart from every value."""
    flat = [x for c in columns for x in (c.isNull(), c)]
    return [F.xxhash64(F.lit(11), *flat).alias("__k1"), F.xxhash64(*flat, F.lit(23)).alias("__k2")]


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder that `spark.checkpoint.dir` names.

    Only where that setting is absent (tests, a laptop) a temporary folder is used.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what `spark.checkpoint.dir` names; a temporary one only on a local master."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return tempfile.mkdtemp(prefix="tarnbase-")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library has written, on whatever store it is."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


#: Thin rows that may be sent to every executor; larger sides are joined by exchange.
BROADCAST_ROWS = 250_000


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """A hint to broadcast only where the counted rows are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, what runs gets Arrow batches of at most so many rows: whole texts in large batches take memory in the JVM and in Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)
