"""Event logs: metrics, spans, logical clocks and time travel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalogue import DURATIONS

# Metrics and the event types that they count.
METRICS = {
    "buffer_hits": ("BUFFER_HIT",), "buffer_misses": ("BUFFER_MISS",), "evictions": ("BUFFER_EVICT",), "flushes": ("PAGE_FLUSH",), "page_allocs": ("PAGE_ALLOC",), "page_frees": ("PAGE_FREE",),
    "logical_reads": ("PAGE_READ", "COLUMN_READ"), "records_inserted": ("RECORD_INSERT", "HEAP_INSERT"), "records_updated": ("RECORD_UPDATE",), "records_deleted": ("RECORD_DELETE",),
    "merges": ("PAGE_MERGE",), "redistributes": ("REDISTRIBUTE",), "root_changes": ("ROOT_CHANGE",), "separator_writes": ("SEPARATOR_INSERT", "SEPARATOR_DELETE", "SEPARATOR_UPDATE"),
    "scan_rows": ("SCAN_STEP",), "lookups": ("LOOKUP_BACK",), "heap_fetches": ("HEAP_FETCH",), "visibility_checks": ("VISIBILITY_CHECK",), "versions_written": ("HEAP_INSERT",),
    "memtable_writes": ("MEMTABLE_PUT",), "memtable_flushes": ("SST_CREATE",), "compactions": ("COMPACTION_END", "MERGE_END"), "sst_reads": ("SST_PROBE",), "bloom_skips": ("BLOOM_PROBE",),
}


def metrics(events: DataFrame) -> DataFrame:
    """One row with all counters and the buffer hit rate, in one pass."""
    counts = [F.count_if(F.col("type").isin(*types)).alias(name) for name, types in METRICS.items()]
    asked = F.count_if(F.col("type").isin("BUFFER_HIT", "BUFFER_MISS"))
    return events.agg(*counts, (F.count_if(F.col("type") == "BUFFER_HIT") / F.nullif(asked, F.lit(0))).alias("hit_rate"))


def state_at(events: DataFrame, seq: int) -> DataFrame:
    """Time travel: the metrics of the prefix before `seq`."""
    return metrics(events.where(F.col("seq") < seq))


def spans(events: DataFrame) -> DataFrame:
    """First and last event, duration and number of events of each command; with `t` and `detail`, when it began and ended, whether it went well and its note."""
    base = [F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum("duration").alias("duration"), F.count(F.lit(1)).alias("n_events")]
    more = []
    if {"t", "detail"} <= set(events.columns):
        end = F.max_by("detail", F.when(F.col("type") == "COMMAND_END", F.col("seq")))
        more = [F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.coalesce(end == "ok", F.lit(False)).alias("ok"), end.alias("note")]
    return events.groupBy("cmd").agg(*base, *more)


def blocked_before(df: DataFrame, at: Column, value: Column, block: int) -> DataFrame:
    """(blk, base): for each block of `block` places the sum of `value` over all blocks before, by blocks of blocks, so that no task orders more than one in block^2 places."""
    sums = df.groupBy(F.floor(at / block).alias("blk")).agg(F.sum(value).alias("d")).withColumn("sup", F.floor(F.col("blk") / block))
    upto = lambda w: F.coalesce(F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    supers = sums.groupBy("sup").agg(F.sum("d").alias("d")).select("sup", upto(Window.orderBy("sup")).alias("before"))
    inside = sums.withColumn("own", upto(Window.partitionBy("sup").orderBy("blk")))
    return inside.join(supers, "sup").select("blk", (F.col("before") + F.col("own")).alias("base"))


def clock(events: DataFrame, block: int = 1000) -> DataFrame:
    """Adds `t`, the running sum of durations: sums of blocks of the sequence first, then inside each block, so no task orders the whole log."""
    blocks = blocked_before(events, F.col("seq"), F.col("duration"), block)
    inside = Window.partitionBy("blk").orderBy("seq")
    return events.withColumn("blk", F.floor(F.col("seq") / block)).join(blocks, "blk").withColumn("t", F.col("base") + F.sum("duration").over(inside)).drop("blk", "base")


def checkpoints(n_events: int, interval: int = 200, most: int = 24) -> list[int]:
    """Positions of the checkpoints that are left after thinning: the interval doubles whenever there are more than `most`."""
    while n_events // interval > most:
        interval *= 2
    return list(range(interval, n_events + 1, interval))


def store_checkpoints(events: DataFrame, path: str, interval: int = 200, most: int = 24) -> DataFrame:
    """Writes, and reads back, a row of all counters at each checkpoint that thinning leaves: (at, counts by type, hits)."""
    last = events.agg(F.max("seq")).first()[0]
    places = checkpoints(0 if last is None else last + 1, interval, most)
    step = places[0] if places else interval
    per = events.where(F.col("seq") < (places[-1] if places else 0)).groupBy(F.floor(F.col("seq") / step).alias("blk"), "type").agg(F.count(F.lit(1)).alias("n"))
    # At most `most` blocks a type.
    upto = Window.partitionBy("type").orderBy("blk")
    grid = events.sparkSession.createDataFrame([(i, p, t) for i, p in enumerate(places) for t in DURATIONS], "blk bigint, at bigint, type string")
    full = grid.join(per, ["blk", "type"], "left").select("at", "type", F.sum(F.coalesce("n", F.lit(0))).over(upto).alias("n"))
    full.write.mode("overwrite").parquet(path)
    return events.sparkSession.read.parquet(path)


def state_from(stored: DataFrame, events: DataFrame, seq: int) -> DataFrame:
    """Time travel: the metrics of the prefix before `seq`, from the nearest checkpoint and the events after it only."""
    at = stored.where(F.col("at") <= seq).agg(F.max("at")).first()[0] or 0
    rest = events.where((F.col("seq") >= at) & (F.col("seq") < seq)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    counted = rest.unionByName(stored.where(F.col("at") == at).select("type", "n"))
    total = lambda types: F.coalesce(F.sum(F.when(F.col("type").isin(*types), F.col("n"))), F.lit(0)).cast("long")
    hits, asked = total(("BUFFER_HIT",)), total(("BUFFER_HIT", "BUFFER_MISS"))
    return counted.agg(*[total(types).alias(name) for name, types in METRICS.items()], (hits / F.nullif(asked, F.lit(0))).alias("hit_rate"))


def queue_depth(jobs: DataFrame, per: str) -> DataFrame:
    """(per, max_depth): jobs that wait at once, from BG_JOB_SCHEDULED and BG_JOB_RUN; a CRASH empties the queue."""
    order = Window.partitionBy(per).orderBy("seq")
    epoch = jobs.withColumn("epoch", F.count_if(F.col("type") == "CRASH").over(order))
    step = F.when(F.col("type") == "BG_JOB_SCHEDULED", 1).when(F.col("type") == "BG_JOB_RUN", -1).otherwise(0)
    depth = epoch.withColumn("depth", F.sum(step).over(Window.partitionBy(per, "epoch").orderBy("seq")))
    return depth.groupBy(per).agg(F.max("depth").alias("max_depth"))


def next_matching(events: DataFrame, seq: int, type_: str) -> DataFrame:
    return events.where((F.col("seq") > seq) & (F.col("type") == type_)).agg(F.min("seq").alias("next_seq"))


def recency(events: DataFrame, pages: str = "page", block: int = 1000) -> DataFrame:
    """(page, last_seq, place): each page's last access and its place, the most recent first; places by blocks of the sequence, which has a page at most each."""
    last = events.where("type IN ('BUFFER_HIT', 'BUFFER_MISS')").groupBy(pages).agg(F.max("seq").alias("last_seq"))
    # The block that comes first holds the latest: the place counts pages with a later access.
    turned = last.withColumn("back", -F.col("last_seq"))
    blocks = blocked_before(turned, F.col("back"), F.lit(1), block)
    inside = F.row_number().over(Window.partitionBy("blk").orderBy("back"))
    placed = turned.withColumn("blk", F.floor(F.col("back") / block)).join(blocks, "blk").withColumn("place", (F.col("base") + inside).cast("long"))
    return placed.select(pages, "last_seq", "place")


def jump(events: DataFrame, seq: int, markers: list[int]) -> dict[str, int | None]:
    """Where navigation goes from an event: the next and previous event, command and marker (a user's list)."""
    near = events.where(F.col("seq").between(seq - 1, seq + 1) | (F.col("seq") == seq))
    own = near.where(F.col("seq") == seq).select("cmd").first()
    cmd = own["cmd"] if own else None
    r = events.agg(
        F.min(F.when(F.col("seq") > seq, F.col("seq"))).alias("next_event"), F.max(F.when(F.col("seq") < seq, F.col("seq"))).alias("previous_event"),
        F.min(F.when(F.col("cmd") > cmd, F.col("seq"))).alias("next_command"), F.min(F.when(F.col("cmd") == cmd - 1, F.col("seq"))).alias("previous_command"),
    ).first() if cmd is not None else None
    out = r.asDict() if r else {"next_event": None, "previous_event": None, "next_command": None, "previous_command": None}
    return out | {"next_marker": min((m for m in markers if m > seq), default=None), "previous_marker": max((m for m in markers if m < seq), default=None)}


def recent(events: DataFrame, per: str, n: int) -> DataFrame:
    """The last `n` events of each group; the rank limit reaches the sort, so groups are cut before the exchange."""
    w = Window.partitionBy(per).orderBy(F.desc("seq"))
    return events.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")
