"""Command logs as streams: micro-batches of newest-wins upserts, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.log import newest


def read_events(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def newest_per_batch(log: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch's newest row per key; readers reconcile with `operators.log.newest`. A repeated batch overwrites its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        newest(batch).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
