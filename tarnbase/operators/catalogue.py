"""The catalogue of storage events: category, logical duration, key frames; and metrics that depend on an event's payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Event types by category, each with its logical duration in milliseconds.
CATALOGUE: dict[str, dict[str, int]] = {
    "command": {"COMMAND_BEGIN": 40, "COMMAND_END": 40, "NOTE": 60},
    "meta": {"CONFIG_SET": 40, "TABLE_CREATE": 200, "INDEX_CREATE": 300, "INDEX_DROP": 200, "INDEX_STATS": 40, "BLOAT_STAT": 60},
    "structure": {"PAGE_ALLOC": 220, "PAGE_FREE": 220, "PARENT_SET": 30, "ROOT_CHANGE": 400, "LEAF_LINK": 60, "PAGE_SPLIT": 700, "PAGE_MERGE": 700, "REDISTRIBUTE": 500, "LINE_POINTER": 120, "HEAP_PRUNE": 420, "CHILD_REPOINT": 110, "BUFFER_SPLIT": 260},
    "access": {"DESCEND": 160, "PAGE_READ": 40, "SEARCH_BEGIN": 80, "SEARCH_RESULT": 260, "SCAN_STEP": 90, "SCAN_END": 120, "LOOKUP_BACK": 260, "LOOKUP_DONE": 160, "HEAP_FETCH": 260, "BLOOM_PROBE": 110, "SST_PROBE": 170, "LSM_GET_RESULT": 280, "ZONE_MAP_SKIP": 220, "COLUMN_READ": 240, "VECTOR_BATCH": 150, "HASH_PROBE": 200, "BUFFER_PROBE": 150},
    "record": {"RECORD_INSERT": 180, "RECORD_UPDATE": 180, "RECORD_DELETE": 180, "SEPARATOR_INSERT": 200, "SEPARATOR_DELETE": 200, "SEPARATOR_UPDATE": 120, "HEAP_INSERT": 200, "MEMTABLE_PUT": 140, "LOG_APPEND": 130},
    "buffer": {"BUFFER_HIT": 40, "BUFFER_MISS": 90, "BUFFER_EVICT": 260, "PAGE_MARK_DIRTY": 40, "PAGE_FLUSH": 160},
    "plan": {"PLAN_READY": 400, "OPERATOR_OPEN": 120, "OPERATOR_ROW": 70, "OPERATOR_CLOSE": 120},
    "txn": {"TXN_BEGIN": 180, "TXN_COMMIT": 260, "TXN_ABORT": 320, "SNAPSHOT_TAKE": 220, "WRITE_TXN_BEGIN": 120, "WRITE_TXN_COMMIT": 260, "SNAPSHOT_OPEN": 300, "SNAPSHOT_CLOSE": 260},
    "mvcc": {"HEAP_SET_XMAX": 240, "VISIBILITY_CHECK": 150, "VISIBILITY_MAP": 90, "VACUUM_BEGIN": 260, "VACUUM_END": 320},
    "lsm": {"WAL_APPEND": 60, "WAL_SEAL": 160, "WAL_TRUNCATE": 200, "CRASH": 900, "WAL_REPLAY": 420, "RECOVER_END": 600, "BG_JOB_SCHEDULED": 90, "BG_JOB_RUN": 220, "WRITE_STALL": 520, "MEMTABLE_FREEZE": 420, "SST_CREATE": 460, "SST_DROP": 300, "COMPACTION_BEGIN": 500, "COMPACTION_END": 620},
    "columnar": {"ROW_GROUP_OPEN": 180, "COLUMN_CHUNK_WRITE": 260, "ROW_GROUP_SEAL": 380},
    "kv": {"LOG_FILE_OPEN": 180, "LOG_FILE_SEAL": 260, "HASH_INDEX_SET": 120, "MERGE_BEGIN": 420, "MERGE_END": 520},
    "cow": {"COW_COPY": 300, "META_FLIP": 520, "FREELIST_PUSH": 200, "FREELIST_POP": 90},
    "fractal": {"MSG_INJECT": 130, "MSG_FLUSH": 460, "BUFFER_STATE": 50, "PATH_FLUSH": 320},
}
DURATIONS: dict[str, int] = {t: d for types in CATALOGUE.values() for t, d in types.items()}
# The types on which playback dwells.
KEY_FRAMES = (
    "PAGE_SPLIT PAGE_MERGE REDISTRIBUTE ROOT_CHANGE BUFFER_EVICT SEARCH_RESULT PLAN_READY LOOKUP_BACK INDEX_CREATE COMMAND_END TXN_COMMIT TXN_ABORT HEAP_PRUNE VACUUM_END MEMTABLE_FREEZE SST_CREATE COMPACTION_END "
    "LSM_GET_RESULT WRITE_STALL CRASH RECOVER_END WAL_TRUNCATE ROW_GROUP_SEAL ZONE_MAP_SKIP MERGE_END LOG_FILE_SEAL COW_COPY META_FLIP SNAPSHOT_OPEN WRITE_TXN_COMMIT MSG_FLUSH BUFFER_SPLIT PATH_FLUSH"
).split()
# Metric, and the (type, details) that count for it; no details: every event of the type.
DETAILED: dict[str, tuple[tuple[str, tuple[str, ...]], ...]] = {
    "leaf_splits": (("PAGE_SPLIT", ("leaf",)),), "internal_splits": (("PAGE_SPLIT", ("internal",)),),
    "hot_updates": (("HEAP_SET_XMAX", ("hot",)),), "cold_updates": (("HEAP_SET_XMAX", ("cold",)),),
    "records_inserted": (("RECORD_INSERT", ()), ("HEAP_INSERT", ()), ("LOG_APPEND", ("put",)), ("MSG_INJECT", ("insert", "upsert"))),
    "records_updated": (("RECORD_UPDATE", ()), ("HEAP_SET_XMAX", ("hot", "cold"))),
    "records_deleted": (("RECORD_DELETE", ()), ("HEAP_SET_XMAX", ("delete",)), ("LOG_APPEND", ("tombstone",)), ("MSG_INJECT", ("delete",))),
    "logical_reads": (("PAGE_READ", ()), ("COLUMN_READ", ()), ("HASH_PROBE", ("found",))),
    "scanned_steps": (("SCAN_STEP", ("emitted",)),), "bloom_skips": (("BLOOM_PROBE", ("skip",)),), "memtable_flushes": (("SST_CREATE", ("flush",)),),
    "page_copies": (("COW_COPY", ()),), "injected": (("MSG_INJECT", ()),),
}
# Metrics that sum the amount of a type: rows of a batch, entries of a run, removed tuples, logged bytes, flushed messages.
AMOUNTS = {"batch_rows": "VECTOR_BATCH", "entries_written": "SST_CREATE", "vacuumed_tuples": "HEAP_PRUNE", "wal_bytes": "WAL_APPEND", "flushed_hops": "MSG_FLUSH"}


def catalogue(spark: SparkSession) -> DataFrame:
    """(type, category, duration, key_frame): one row per event type."""
    rows = [(t, c, d, t in KEY_FRAMES) for c, types in CATALOGUE.items() for t, d in types.items()]
    return spark.createDataFrame(rows, "type string, category string, duration bigint, key_frame boolean")


def category_totals(events: DataFrame) -> DataFrame:
    """Events, logical time and key frames per category. Types are counted first, so the join with the catalogue sees a row per type."""
    counted = events.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    # The catalogue has a fixed number of rows.
    met = counted.join(F.broadcast(catalogue(events.sparkSession)), "type")
    return met.groupBy("category").agg(
        F.sum("n").alias("n_events"), F.sum(F.col("n") * F.col("duration")).alias("duration"), F.sum(F.when(F.col("key_frame"), F.col("n")).otherwise(0)).alias("key_frames")
    )


def condition(metric: str) -> str:
    """SQL of the events that count for a metric; the same text in both dialects."""
    parts = [f"type = '{t}'" + (f" AND detail IN ({', '.join(repr(d) for d in details)})" if details else "") for t, details in DETAILED[metric]]
    return " OR ".join(f"({p})" for p in parts)


def payload_metrics(events: DataFrame) -> DataFrame:
    """One row of all payload-dependent counters and ratios of (type, detail, amount), in one pass."""
    counts = [F.count_if(F.expr(condition(m))).alias(m) for m in DETAILED]
    sums = [F.coalesce(F.sum(F.when(F.col("type") == t, F.col("amount"))), F.lit(0)).cast("long").alias(m) for m, t in AMOUNTS.items()]
    folded = events.agg(*counts, *sums).withColumn("scan_rows", F.col("scanned_steps") + F.col("batch_rows"))
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return folded.withColumns({"copies_per_row": ratio("page_copies", "records_inserted"), "message_amplification": ratio("flushed_hops", "injected")})
