"""More registered queries: snapshots, sessions, index upkeep, compaction decisions, plan accuracy and payload metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import numbers, text
from .operators import catalogue, events, log, mvcc
from .registry import _CHUNKS, _EVENTS, _LOG, _RUNS, _VERSIONS, PER_BLOCK, _H, _chunks, _events, _runs, _t, _versions, _writes, query
from .sources import tables


def _n() -> Column:
    return F.count(F.lit(1))


# -- versions and sessions ---------------------------------------------------------------------------------------


@query(
    """SELECT coalesce(min(xid) FILTER (open), max(xid) + 1) AS xmin, max(xid) + 1 AS xmax, coalesce(string_agg(xid::VARCHAR, ',' ORDER BY xid) FILTER (open), '') AS active
FROM (SELECT xid, min(lsn) AS began, min(status) = 'active' OR max(lsn) > 900 AS open FROM v GROUP BY xid) WHERE began <= 900""",
    _VERSIONS,
)
def snapshot_at(spark, d):
    """The snapshot a statement at lsn 900 takes: transactions begun by then, and those still open; the list is as long as sessions are many."""
    txns = _versions(spark, d).groupBy("xid").agg(F.min("lsn").alias("began"), ((F.min("status") == "active") | (F.max("lsn") > 900)).alias("open")).where("began <= 900")
    open_ = F.when(F.col("open"), F.col("xid"))
    active = F.transform(F.sort_array(F.collect_set(open_)), lambda x: x.cast("string"))
    return txns.agg(F.coalesce(F.min(open_), F.max("xid") + 1).alias("xmin"), (F.max("xid") + 1).alias("xmax"), F.array_join(active, ",").alias("active"))


_HOT_SQL = f"""SELECT count(*) FILTER (hot) AS hot_updates, count(*) FILTER (NOT hot) AS cold_updates
FROM (SELECT k IS NOT DISTINCT FROM lag(k) OVER c AND (lsn - 1) // {PER_BLOCK} = lag((lsn - 1) // {PER_BLOCK}) OVER c AS hot, lag(lsn) OVER c AS prev
  FROM v WHERE status <> 'aborted' AND op <> 'delete' WINDOW c AS (PARTITION BY key ORDER BY lsn)) WHERE prev IS NOT NULL"""


@query(_HOT_SQL, _VERSIONS)
def hot_cold_updates(spark, d):
    """An update is hot if the indexed column stays and the new version lands in the old one's block."""
    c = Window.partitionBy("key").orderBy("lsn")
    block = F.floor((F.col("lsn") - 1) / PER_BLOCK)
    hot = F.col("k").eqNullSafe(F.lag("k").over(c)) & (block == F.lag(block).over(c))
    v = _versions(spark, d).where("status <> 'aborted' AND op <> 'delete'").select(hot.alias("hot"), F.lag("lsn").over(c).alias("prev")).where("prev IS NOT NULL")
    return v.agg(F.count_if("hot").alias("hot_updates"), F.count_if(~F.col("hot")).alias("cold_updates"))


@query("SELECT lsn, key, last_value(CASE WHEN op = 'search' THEN k % 4 END IGNORE NULLS) OVER (PARTITION BY key ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM log", _LOG)
def current_session(spark, d):
    """The session that a connection's last switch chose, for each of its later commands."""
    switch = F.when(F.col("op") == "search", F.col("k") % 4)
    upto = Window.partitionBy("key").orderBy("lsn").rowsBetween(Window.unboundedPreceding, 0)
    return tables.command_log(_t(spark, d, "events")).select("lsn", "key", F.last(switch, ignorenulls=True).over(upto).alias("session"))


@query(f"SELECT count(*) AS blocks, count(*) FILTER (clean) AS all_visible, count(*) FILTER (clean) / count(*) AS ratio FROM (SELECT bool_and(xmax IS NULL AND status = 'committed' AND xid < {_H}) AS clean FROM every GROUP BY (lsn - 1) // {PER_BLOCK})", _VERSIONS)
def all_visible_ratio(spark, d):
    """Blocks whose every version all snapshots see, by the oldest open transaction."""
    v = _versions(spark, d)
    # One row: the horizon.
    every = mvcc.chain_with_aborted(v).join(F.broadcast(mvcc.horizon(v)))
    clean = F.col("xmax").isNull() & (F.col("status") == "committed") & (F.col("xid") < F.col("horizon"))
    blocks = every.groupBy(F.floor((F.col("lsn") - 1) / PER_BLOCK)).agg(F.bool_and(clean).alias("clean"))
    return blocks.agg(_n().alias("blocks"), F.count_if("clean").alias("all_visible"), (F.count_if("clean") / _n()).alias("ratio"))


# -- index access -----------------------------------------------------------------------------------------------


@query("SELECT key, lsn, k FROM chain WHERE k BETWEEN 5 AND 9 AND status = 'committed' AND (xmax IS NULL OR xmax_status = 'active') AND op <> 'delete'", _VERSIONS)
def heap_index_scan(spark, d):
    """Index entries of a range, fetched from the version table by row id; visibility and predicate are checked on the fetched row."""
    versions = _versions(spark, d)
    entries = versions.where("k BETWEEN 5 AND 9").select(F.col("lsn").alias("tid"))
    fetched = log.version_chain(versions).join(entries, F.col("lsn") == F.col("tid"), "left_semi")
    return fetched.where(mvcc.visible() & F.col("k").between(5, 9)).select("key", "lsn", "k")


@query(f"SELECT k, lsn FROM every WHERE NOT (status = 'aborted' OR coalesce(xmax_status = 'committed' AND xmax < {_H}, false))", _VERSIONS)
def vacuum_index_entries(spark, d):
    """What vacuum leaves of an index: entries whose version is not removed."""
    versions = _versions(spark, d)
    removed = mvcc.dead(mvcc.chain_with_aborted(versions)).where("removable").select("lsn")
    return versions.select("k", "lsn").join(removed, "lsn", "left_anti").select("k", "lsn")


@query("SELECT p_size, p_partkey FROM part WHERE p_size BETWEEN 5 AND 8 ")
def covering_index_scan(spark, d):
    """A covering projection of index column and key, in key ranges sorted inside, answers without the table."""
    index = _t(spark, d, "part").select("p_size", "p_partkey").where("p_size BETWEEN 5 AND 8")
    return index.repartitionByRange("p_size", "p_partkey").sortWithinPartitions("p_size", "p_partkey")


@query("SELECT p_size, count(*) FILTER (p_partkey <= 150) AS stats_entries, count(*) AS entries, count(*) FILTER (p_partkey <= 150) <> count(*) AS stale FROM part GROUP BY p_size")
def stale_statistics(spark, d):
    """Entries when statistics were taken (the first 150 keys) against those of now."""
    then = F.count_if(F.col("p_partkey") <= 150)
    return _t(spark, d, "part").groupBy("p_size").agg(then.alias("stats_entries"), _n().alias("entries"), (then != _n()).alias("stale"))


@query("SELECT p_size, greatest(1, floor((SELECT count(*) FROM part) / (SELECT count(DISTINCT p_size) FROM part) + 0.5))::BIGINT AS estimated, count(*) AS actual, count(*) / greatest(1, floor((SELECT count(*) FROM part) / (SELECT count(DISTINCT p_size) FROM part) + 0.5)) AS ratio FROM part GROUP BY p_size")
def estimated_actual_rows(spark, d):
    """Rows that the planner expects of an equality on each value, against those it meets."""
    actual = _t(spark, d, "part").groupBy("p_size").agg(_n().alias("actual"))
    all_ = actual.agg(F.sum("actual").alias("n"), _n().alias("n_distinct"))
    # One row of statistics.
    met = actual.join(F.broadcast(all_)).withColumn("estimated", F.greatest(F.lit(1), F.floor(F.col("n") / F.col("n_distinct") + 0.5)).cast("long"))
    return met.select("p_size", "estimated", "actual", (F.col("actual") / F.col("estimated")).alias("ratio"))


_FILL = text.record_bytes(list(tables.USERS))


@query(f"SELECT c_custkey // 100 AS page, count(*) AS keys, (102 + count(*) * {_FILL})::BIGINT AS used_bytes, count(*) / 127 AS fill FROM customer GROUP BY 1")
def page_fill(spark, d):
    """Keys, bytes and fill of leaf pages of 100 consecutive keys at order 128."""
    pages = _t(spark, d, "customer").groupBy(F.floor(F.col("c_custkey") / 100).alias("page")).agg(_n().alias("keys"))
    return pages.select("page", "keys", (text.PAGE_HEADER + F.col("keys") * _FILL).cast("long").alias("used_bytes"), (F.col("keys") / 127).alias("fill"))


# -- column store and sorted runs ---------------------------------------------------------------------------------


@query('SELECT "column", string_agg(DISTINCT encoding, \',\' ORDER BY encoding) AS encodings, sum(raw_bytes)::BIGINT AS raw_bytes, sum(encoded_bytes)::BIGINT AS encoded_bytes FROM chunks GROUP BY 1', _CHUNKS)
def column_encodings(spark, d):
    return _chunks(spark, d).groupBy("column").agg(F.array_join(F.sort_array(F.collect_set("encoding")), ",").alias("encodings"), F.sum("raw_bytes").alias("raw_bytes"), F.sum("encoded_bytes").alias("encoded_bytes"))


@query("SELECT count(*) AS runs, count(*) FILTER (hi >= 20 AND lo <= 60) AS touched FROM (SELECT min(key) AS lo, max(key) AS hi FROM runs GROUP BY sst)", _RUNS)
def runs_touched(spark, d):
    """Sorted runs that a scan of keys 20 to 60 has to open."""
    m = _runs(spark, d).groupBy("sst").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    return m.agg(_n().alias("runs"), F.count_if((F.col("hi") >= 20) & (F.col("lo") <= 60)).alias("touched"))


_TRIGGER, _LIMIT, _FANOUT = 4, 100, 4


@query(
    f"""SELECT level, files, entries, CASE WHEN level = 0 THEN files >= {_TRIGGER} ELSE entries > {_LIMIT} * power({_FANOUT}, level) END AS due
FROM (SELECT CASE WHEN sst % 4 = 3 THEN 0 ELSE 1 END AS level, count(DISTINCT sst) AS files, count(*) AS entries FROM runs GROUP BY 1)""",
    _RUNS,
)
def compaction_due(spark, d):
    """Level 0 is due by its files, every other level by entries above limit * fanout ^ level."""
    levels = _runs(spark, d).groupBy(F.when(F.col("sst") % 4 == 3, 0).otherwise(1).alias("level")).agg(F.countDistinct("sst").alias("files"), _n().alias("entries"))
    return levels.withColumn("due", F.when(F.col("level") == 0, F.col("files") >= _TRIGGER).otherwise(F.col("entries") > _LIMIT * F.pow(F.lit(float(_FANOUT)), F.col("level"))))


@query("SELECT key, lsn, (lsn - 1) // 512 AS file FROM live WHERE (lsn - 1) // 512 < (SELECT max((lsn - 1) // 512) FROM w)", _LOG)
def kv_merge_survivors(spark, d):
    """Records of sealed files that the index still points at: what a merge rewrites."""
    w = _writes(spark, d)
    file = F.floor((F.col("lsn") - 1) / 512)
    # One row: the file that is still open.
    last = w.agg(F.max(file).alias("open"))
    return log.merged_view(w.select("key", "lsn", "op")).withColumn("file", file).join(F.broadcast(last)).where("file < open").select("key", "lsn", "file")


@query("SELECT bits, CAST(floor(power(1 - exp(-h / bits), h) * 1000000 + 0.5) AS BIGINT) AS per_million FROM (SELECT DISTINCT c_custkey % 20 + 1 AS bits, greatest(1.0, floor((c_custkey % 20 + 1) * 0.6931 + 0.5))::DOUBLE AS h FROM customer)")
def bloom_false_positives(spark, d):
    bits = _t(spark, d, "customer").select((F.col("c_custkey") % 20 + 1).alias("bits")).distinct()
    return bits.select("bits", F.floor(numbers.bloom_false_positive_rate(F.col("bits").cast("double")) * 1_000_000 + 0.5).cast("long").alias("per_million"))


@query("SELECT tbl, slot, n FROM (SELECT key % 8 AS tbl, key // 8 % 4 AS slot, count(*) AS n FROM w GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY tbl ORDER BY n DESC, slot) = 1", _LOG)
def heaviest_child(spark, d):
    """The child with most buffered messages, the lowest slot first among equals."""
    n = _writes(spark, d).groupBy((F.col("key") % 8).alias("tbl"), (F.floor(F.col("key") / 8) % 4).alias("slot")).agg(_n().alias("n"))
    return n.groupBy("tbl").agg(F.max_by(F.struct("slot", "n"), F.struct(F.col("n"), -F.col("slot"))).alias("b")).select("tbl", "b.slot", "b.n")


# -- events ---------------------------------------------------------------------------------------------------------


@query("SELECT cmd, page % 3 AS node, count(*) FILTER (type = 'SCAN_STEP') AS emitted, count(*) FILTER (type <> 'SCAN_STEP') AS filtered FROM e GROUP BY 1, 2", _EVENTS)
def operator_rows(spark, d):
    """Rows each plan node let through and held back, per command."""
    emitted = F.col("type") == "SCAN_STEP"
    return _events(spark, d).groupBy("cmd", (F.col("page") % 3).alias("node")).agg(F.count_if(emitted).alias("emitted"), F.count_if(~emitted).alias("filtered"))


@query("SELECT page, arg_max(type, seq) IN ('RECORD_INSERT', 'RECORD_DELETE') AS dirty FROM e WHERE type IN ('RECORD_INSERT', 'RECORD_DELETE', 'SCAN_STEP') GROUP BY page", _EVENTS)
def dirty_pages(spark, d):
    """A page is dirty if its last change is later than its last flush (here the scan steps)."""
    e = _events(spark, d).where(F.col("type").isin("RECORD_INSERT", "RECORD_DELETE", "SCAN_STEP"))
    return e.groupBy("page").agg(F.max_by("type", "seq").isin("RECORD_INSERT", "RECORD_DELETE").alias("dirty"))


@query("SELECT job, ran - planned AS wait FROM (SELECT cmd AS job, min(seq) FILTER (type = 'RECORD_INSERT') AS planned, max(seq) FILTER (type = 'SCAN_STEP') AS ran FROM e GROUP BY cmd) WHERE ran > planned", _EVENTS)
def job_wait(spark, d):
    """Events between a background job's scheduling and its run."""
    at = lambda f, t: f(F.when(F.col("type") == t, F.col("seq")))
    jobs = _events(spark, d).groupBy(F.col("cmd").alias("job")).agg(at(F.min, "RECORD_INSERT").alias("planned"), at(F.max, "SCAN_STEP").alias("ran"))
    return jobs.where("ran > planned").select("job", (F.col("ran") - F.col("planned")).alias("wait"))


_CATALOGUE_SQL = ", ".join(f"('{t}', '{c}', {n}, {t in catalogue.KEY_FRAMES})" for c, types in catalogue.CATALOGUE.items() for t, n in types.items())


@query(f"SELECT category, count(*) AS n_events, sum(c.duration)::BIGINT AS duration, count(*) FILTER (key_frame) AS key_frames FROM e JOIN (VALUES {_CATALOGUE_SQL}) c(type, category, duration, key_frame) USING (type) GROUP BY category", _EVENTS)
def event_categories(spark, d):
    return catalogue.category_totals(_events(spark, d))


#: Types with a payload, and the details they take in turn.
_DETAILS = {
    "PAGE_SPLIT": ("leaf", "internal"), "HEAP_SET_XMAX": ("hot", "cold", "delete"), "LOG_APPEND": ("put", "tombstone"), "MSG_INJECT": ("insert", "upsert", "delete"), "HASH_PROBE": ("found", "missing"),
    "SCAN_STEP": ("emitted", "held"), "BLOOM_PROBE": ("skip", "maybe"), "SST_CREATE": ("flush", "compaction"), "VECTOR_BATCH": ("",), "HEAP_PRUNE": ("",), "WAL_APPEND": ("",), "MSG_FLUSH": ("",), "COW_COPY": ("",), "RECORD_INSERT": ("",),
}
_TURNS = {t: x * (6 // len(x)) for t, x in _DETAILS.items()}
_PAYLOADS = f"""e AS (SELECT {list(_TURNS)}[event_id % {len(_TURNS)} + 1] AS type, {[list(x) for x in _TURNS.values()]}[event_id % {len(_TURNS)} + 1][k % 6 + 1] AS detail, k AS amount
FROM (SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events))"""


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("k"))
    one = lambda words: F.array(*[F.lit(w) for w in words])
    turn = (F.col("event_id") % len(_TURNS)).cast("int")
    return rows.select(F.get(one(_TURNS), turn).alias("type"), F.get(F.get(F.array(*[one(x) for x in _TURNS.values()]), turn), (F.col("k") % 6).cast("int")).alias("detail"), F.col("k").alias("amount"))


_COUNTS_SQL = ", ".join([f"count(*) FILTER ({catalogue.condition(m)}) AS {m}" for m in catalogue.DETAILED] + [f"coalesce(sum(amount) FILTER (type = '{t}'), 0)::BIGINT AS {m}" for m, t in catalogue.AMOUNTS.items()])


@query(f"SELECT *, scanned_steps + batch_rows AS scan_rows, page_copies / nullif(records_inserted, 0) AS copies_per_row, flushed_hops / nullif(injected, 0) AS message_amplification FROM (SELECT {_COUNTS_SQL} FROM e)", _PAYLOADS)
def payload_metrics(spark, d):
    return catalogue.payload_metrics(_payloads(spark, d))


@query("SELECT lsn, CASE op WHEN 'put' THEN 'INSERT key=' WHEN 'upsert' THEN 'UPDATE key=' WHEN 'delete' THEN 'DELETE key=' ELSE 'SELECT … WHERE pk=' END || key AS label FROM log", _LOG)
def command_labels(spark, d):
    return tables.command_log(_t(spark, d, "events")).select("lsn", _label(F.col("op"), F.col("key")).alias("label"))


def _label(op: Column, key: Column) -> Column:
    words = {"put": "insert", "upsert": "update", "delete": "delete", "search": "search"}
    out = F.lit(None).cast("string")
    for name, kind in words.items():
        out = F.when(op == name, F.concat(F.lit(text.command_label(kind, key="")), key.cast("string"))).otherwise(out)
    return out


# -- files, clocks, transactions, bulk keys ---------------------------------------------------------------------------

_PER_FILE = 40


@query(
    f"""SELECT file, min(key) AS min_key, max(key) AS max_key, count(*) AS entries FROM newest JOIN (
  SELECT rng, coalesce(sum(n) OVER (ORDER BY rng ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // {_PER_FILE} AS file
  FROM (SELECT key // {_PER_FILE} AS rng, count(*) AS n FROM newest WHERE op <> 'delete' GROUP BY 1)) f ON key // {_PER_FILE} = rng WHERE op <> 'delete' GROUP BY file""",
    _LOG,
)
def compaction_files(spark, d):
    """The bottom level's output, split into files by key range."""
    w = _writes(spark, d)
    files = log.split_runs(log.merged_view(w.select("key", "lsn", "op")), _PER_FILE)
    return files.groupBy("file").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), _n().alias("entries"))


@query("SELECT min(seq) AS seq FROM (SELECT seq, sum(duration) OVER (ORDER BY seq) AS t FROM e) WHERE t >= 20000", _EVENTS)
def time_to_event(spark, d):
    """The first event at or after a logical time."""
    return events.clock(_events(spark, d)).where("t >= 20000").agg(F.min("seq").alias("seq"))


@query("SELECT xid, min(lsn) AS began, CASE WHEN min(status) <> 'active' THEN max(lsn) END AS ended, min(status) AS status, count(*) AS writes FROM v GROUP BY xid", _VERSIONS)
def transactions(spark, d):
    """The transaction table: begin and end in the log, status and writes."""
    ended = F.when(F.min("status") != "active", F.max("lsn"))
    return _versions(spark, d).groupBy("xid").agg(F.min("lsn").alias("began"), ended.alias("ended"), F.min("status").alias("status"), _n().alias("writes"))


@query("SELECT 'sequential' AS pattern, range AS ordinal, 11 + range AS key FROM range(500) UNION ALL SELECT 'reverse', range, 510 - range FROM range(500)")
def bulk_load_keys(spark, d):
    """Keys of a sequential and of a reverse bulk load of 500 rows from key 11."""
    of = lambda p: tables.bulk_keys(spark, 500, p, 11).select(F.lit(p).alias("pattern"), "ordinal", F.col("key").cast("long").alias("key"))
    return of("sequential").unionByName(of("reverse"))
