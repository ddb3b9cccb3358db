"""Sinks: session store, event and state export, sorted runs and logs."""

from __future__ import annotations

import dataclasses
import json
import tempfile
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.numbers import bloom_positions

# Bytes of a log record and of a tombstone.
RECORD_BYTES, TOMBSTONE_BYTES = 40, 10


@dataclass(frozen=True)
class Session:
    """A saved run: its engine, configuration and commands rebuild everything else."""

    name: str
    engine: str
    config: dict = field(default_factory=dict)
    commands: tuple = ()
    markers: tuple[int, ...] = ()
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    updated_at: int = field(default_factory=lambda: int(time.time() * 1000))


class SessionStore:
    """Sessions as JSON rows in append-only Parquet; the newest row of an id counts, a row without body deletes."""

    SCHEMA = "id string, body string, updated_at bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def save(self, session: Session) -> None:
        self._append([(session.id, json.dumps(dataclasses.asdict(session)), session.updated_at)])

    def delete(self, id: str) -> None:
        self._append([(id, None, int(time.time() * 1000) + 1)])

    def list(self) -> DataFrame:
        try:
            rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
            rows.schema  # noqa: B018  resolves the path
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = self.spark.createDataFrame([], self.SCHEMA)
        newest = rows.groupBy("id").agg(F.max_by(F.struct("body", "updated_at"), "updated_at").alias("r"))
        return newest.select("id", "r.*").where("body IS NOT NULL").orderBy(F.desc("updated_at"))

    def load(self, id: str) -> Session | None:
        row = self.list().where(F.col("id") == id).first()
        if row is None:
            return None
        d = json.loads(row["body"])
        return Session(**d | {"commands": tuple(d["commands"]), "markers": tuple(d["markers"])})

    def fork(self, id: str, name: str) -> Session:
        copy = dataclasses.replace(self.load(id), id=uuid.uuid4().hex, name=name, updated_at=int(time.time() * 1000))
        self.save(copy)
        return copy


EXPORT_VERSION = 2


def export_events(events: DataFrame, path: str, engine: str, config: dict, commands: list[dict]) -> None:
    """A versioned envelope (one JSON line) and, beside it, the events as JSON lines, which may be of any size."""
    envelope = json.dumps({"version": EXPORT_VERSION, "engineId": engine, "engine": engine, "config": config, "commands": commands}, default=str)
    events.sparkSession.createDataFrame([(envelope,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/envelope")
    events.write.mode("overwrite").json(f"{path}/events")


def read_export(spark: SparkSession, path: str, schema: str) -> tuple[dict, DataFrame]:
    """(envelope, events) of an export; refuses another version."""
    envelope = json.loads(spark.read.text(f"{path}/envelope").first()["value"])
    if envelope.get("version") != EXPORT_VERSION:
        raise ValueError(f"version {envelope.get('version')} isn't {EXPORT_VERSION}")
    return envelope, spark.read.schema(schema).json(f"{path}/events")


def export_state(states: dict[str, DataFrame], path: str) -> None:
    """Each table of a state as JSON lines in a folder of its name."""
    for name, df in states.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def write_sorted_runs(entries: DataFrame, path: str, runs: int, bits: int, hashes: int) -> DataFrame:
    """Sorted runs of an LSM level, range-partitioned by key, so that a key lies in one file, and their manifest beside them.

    Manifest: (run, low, high, n, tombstones, bloom): `bloom` has the set positions of the run's keys.
    """
    spark = entries.sparkSession
    dealt = entries.repartitionByRange(runs, "key").sortWithinPartitions("key").withColumn("run", F.spark_partition_id())
    dealt.write.mode("overwrite").parquet(f"{path}/runs")
    stored = spark.read.parquet(f"{path}/runs")
    blooms = stored.select("run", F.explode(bloom_positions(F.col("key"), bits, hashes)).alias("bit")).groupBy("run").agg(F.array_sort(F.collect_set("bit")).alias("bloom"))  # `bits` positions at most
    manifest = stored.groupBy("run").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("op") == "delete").alias("tombstones"))
    manifest.join(blooms, "run").write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def runs_for(manifest: DataFrame, key: int, bits: int, hashes: int) -> DataFrame:
    """The runs that can hold a key: by key range, then by bloom filter."""
    asked = bloom_positions(F.lit(key).cast("long"), bits, hashes)
    return manifest.where((F.col("low") <= key) & (F.col("high") >= key) & F.forall(asked, lambda b: F.array_contains("bloom", b)))


def write_row_groups(rows: DataFrame, path: str, order_by: str, bytes_per_group: int = 128 << 20) -> None:
    """Column chunks: Parquet clustered by `order_by`, so that zone maps skip."""
    rows.sortWithinPartitions(order_by).write.option("parquet.block.size", bytes_per_group).mode("overwrite").parquet(path)


def append_log(records: DataFrame, path: str, file_records: int, start: int = 0) -> int:
    """Appends records (lsn, ...) to a log in files of `file_records`; a file is sealed when a later one is begun. Returns the next lsn.

    The file follows from the record's place, so a file's records are found by its folder.
    """
    placed = records.withColumn("file", F.floor(F.col("lsn") / file_records))
    placed.write.mode("append").partitionBy("file").parquet(path)
    last = records.agg(F.max("lsn")).first()[0]
    return start if last is None else last + 1


def sealed_files(log: DataFrame) -> DataFrame:
    """(file, records, bytes, sealed) of a log in files: all but the last are sealed."""
    counted = log.groupBy("file").agg(F.count(F.lit(1)).alias("records"), F.sum(F.when(F.col("op") == "delete", TOMBSTONE_BYTES).otherwise(RECORD_BYTES)).cast("long").alias("bytes"))
    # One row: the open file.
    return counted.join(F.broadcast(counted.agg(F.max("file").alias("open"))), F.lit(True)).select("file", "records", "bytes", (F.col("file") < F.col("open")).alias("sealed"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what `spark.checkpoint.dir` names; a temporary one only on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if named or held.isDefined():
        return named or held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tarnbase-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def store_segment(rows: DataFrame, order: str, files: int | None = None) -> DataFrame:
    """Writes rows as Parquet, ordered inside files, below the shared folder, and reads them back: filters on `order` skip row groups."""
    path = f"{shared_folder(rows.sparkSession).rstrip('/')}/segment-{uuid.uuid4().hex}"
    dealt = rows.repartitionByRange(files, order) if files else rows
    dealt.sortWithinPartitions(order).write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
