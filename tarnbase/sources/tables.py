"""Sources: Parquet tables, synthetic rows, and the logs that are derived from the `events` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import random_keys
from ..operators.catalogue import DURATIONS

# The words of the synthetic rows.
CITIES = ("Beijing", "Shanghai", "Hangzhou", "Shenzhen", "Chengdu", "Xian")
NAMES = ("ada", "brin", "codd", "dean", "edgar", "fay", "gray", "hoare", "ingres", "jim")
USERS = (("id", "int", None), ("name", "varchar", 32), ("city", "varchar", 16), ("score", "int", None))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(words: tuple[str, ...], key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (key % len(words) + 1).cast("int"))


def user_rows(keys: DataFrame, key: str = "key") -> DataFrame:
    """(id, name, city, score): a pure function of the key."""
    k = F.col(key)
    return keys.select(k.alias("id"), F.concat_ws("-", pick(NAMES, k), k.cast("string")).alias("name"), pick(CITIES, k).alias("city"), ((k * 7919) % 100).cast("int").alias("score"))


def bumped(rows: DataFrame, generation: int) -> DataFrame:
    """The rows' n-th update: the first numeric column that isn't the key moves by 13 per generation."""
    return rows.withColumn("score", ((F.col("score") + generation * 13) % 100).cast("int"))


def bulk_keys(spark: SparkSession, count: int, pattern: str, start: int = 1, seed: int = 0, most: int | None = None) -> DataFrame:
    """(ordinal, key) of a bulk load: sequential, reverse or random."""
    if pattern == "random":
        return random_keys(spark, count, seed, most)
    key = F.lit(start) + F.col("id") if pattern == "sequential" else F.lit(start + count - 1) - F.col("id")
    return spark.range(count).select(F.col("id").alias("ordinal"), key.alias("key"))


def command_log(events: DataFrame) -> DataFrame:
    """(lsn, key, op, cents, k): error deletes, view searches, click upserts, signup and purchase put."""
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "search").when(F.col("event_type") == "click", "upsert").otherwise("put")
    return events.select(
        (F.col("event_id") + 1).alias("lsn"), F.col("user_id").alias("key"), op.alias("op"),
        F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cents"), F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def writes(events: DataFrame) -> DataFrame:
    return command_log(events).where("op <> 'search'")


def version_log(events: DataFrame) -> DataFrame:
    """The writes with their transaction: ten commands each; every seventh is aborted, the last fifty are active."""
    log = writes(events).withColumn("xid", 100 + F.floor((F.col("lsn") - 1) / 10))
    last = events.agg((100 + F.floor(F.max("event_id") / 10)).alias("last"))
    status = F.when(F.col("xid") % 7 == 0, "aborted").when(F.col("xid") > F.col("last") - 50, "active").otherwise("committed")
    # One row: the newest transaction of the log.
    return log.join(F.broadcast(last)).withColumn("status", status).drop("last")


def event_log(events: DataFrame) -> DataFrame:
    """(seq, cmd, type, rows, duration): storage events derived from user events, five to a command."""
    kind = {"view": "BUFFER_HIT", "click": "BUFFER_MISS", "signup": "RECORD_INSERT", "purchase": "SCAN_STEP", "error": "RECORD_DELETE"}
    cost = {user: DURATIONS[event] for user, event in kind.items()}
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return events.select(
        F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 5).alias("cmd"), F.col("user_id").alias("page"),
        pairs(kind)[F.col("event_type")].alias("type"), pairs(cost)[F.col("event_type")].cast("long").alias("duration"),
    )
