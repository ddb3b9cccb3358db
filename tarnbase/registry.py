"""The registered queries of the core engine, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import numbers
from .operators import columnar, events, log, mvcc, stateful
from .plans import cost
from .plans.predicate import Predicate, needed_columns, select
from .sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PER_BLOCK, GROUP_ROWS, BUCKETS, PER_FILE, SEED = 64, 128, 16, 40, 20260814
# Bytes of a log record, a tombstone, an index entry and a sorted run's entry.
RECORD_BYTES, TOMBSTONE_BYTES, KEY_BYTES, ENTRY_BYTES = 40, 10, 24, 48

_LOG = """log AS (SELECT event_id + 1 AS lsn, user_id AS key,
  CASE event_type WHEN 'error' THEN 'delete' WHEN 'view' THEN 'search' WHEN 'click' THEN 'upsert' ELSE 'put' END AS op,
  CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
w AS (SELECT * FROM log WHERE op <> 'search'),
newest AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY key ORDER BY lsn DESC) = 1),
live AS (SELECT * FROM newest WHERE op <> 'delete')"""
_VERSIONS = f"""{_LOG},
v0 AS (SELECT *, 100 + (lsn - 1) // 10 AS xid FROM w),
v AS (SELECT *, CASE WHEN xid % 7 = 0 THEN 'aborted' WHEN xid > (SELECT 100 + max(event_id) // 10 FROM events) - 50 THEN 'active' ELSE 'committed' END AS status FROM v0),
chain AS (SELECT *, lead(xid) OVER c AS xmax, lead(status) OVER c AS xmax_status, row_number() OVER c AS depth FROM v WHERE status <> 'aborted' WINDOW c AS (PARTITION BY key ORDER BY lsn)),
every AS (SELECT v.*, n.xid AS xmax, n.status AS xmax_status FROM v ASOF LEFT JOIN (SELECT key, lsn, xid, status FROM v WHERE status <> 'aborted') n ON v.key = n.key AND v.lsn < n.lsn)"""
_EVENTS = """e AS (SELECT event_id AS seq, event_id // 5 AS cmd, user_id AS page,
  CASE event_type WHEN 'view' THEN 'BUFFER_HIT' WHEN 'click' THEN 'BUFFER_MISS' WHEN 'signup' THEN 'RECORD_INSERT' WHEN 'purchase' THEN 'SCAN_STEP' ELSE 'RECORD_DELETE' END AS type,
  CASE event_type WHEN 'view' THEN 40 WHEN 'click' THEN 90 WHEN 'purchase' THEN 90 ELSE 180 END::BIGINT AS duration FROM events)"""
_COLUMNS = {"o_orderkey": 8, "o_custkey": 8, "o_orderstatus": 17, "cents": 8}
_NUMERIC = {"o_orderkey", "o_custkey", "cents"}
_CHUNKS = """cells AS (
  SELECT o_orderkey // 128 AS row_group, o_orderkey AS ord, u.c AS "column", u.width AS width, u.s AS s, u.v AS v
  FROM (SELECT *, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents FROM orders) o,
  LATERAL (VALUES ('o_orderkey', 8, o_orderkey::VARCHAR, o_orderkey::DOUBLE), ('o_custkey', 8, o_custkey::VARCHAR, o_custkey::DOUBLE),
                  ('o_orderstatus', 17, o_orderstatus, NULL), ('cents', 8, cents::VARCHAR, cents::DOUBLE)) u(c, width, s, v)),
marked AS (SELECT *, lag(s) OVER c AS prev, v > lag(v) OVER c AS up FROM cells WINDOW c AS (PARTITION BY row_group, "column" ORDER BY ord)),
g AS (SELECT row_group, "column", width, count(*) AS n, count(DISTINCT s) AS n_distinct, count(*) FILTER (prev IS NULL OR s <> prev) AS runs,
        bool_and(v IS NOT NULL AND (prev IS NULL OR coalesce(up, false))) AS ascending, min(v) AS min_value, max(v) AS max_value FROM marked GROUP BY ALL),
c1 AS (SELECT *, CASE WHEN runs * 2 <= n THEN 'rle' WHEN ascending THEN 'delta' WHEN n_distinct * 2 <= n THEN 'dictionary' ELSE 'plain' END AS choice FROM g),
c2 AS (SELECT *, CASE choice WHEN 'rle' THEN runs * (width + 2) WHEN 'delta' THEN width + n - 1 WHEN 'dictionary' THEN n_distinct * width + n * CASE WHEN n_distinct <= 256 THEN 1 ELSE 2 END ELSE n * width END AS size FROM c1),
chunks AS (SELECT row_group, "column", n, n_distinct, runs, CASE WHEN size >= n * width THEN 'plain' ELSE choice END AS encoding, (n * width)::BIGINT AS raw_bytes, least(size, n * width)::BIGINT AS encoded_bytes, min_value, max_value FROM c2)"""


def query(sql: str | None = None, views: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {views}\n{sql}" if views else sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return tables.table(spark, d, name)


def _writes(spark: SparkSession, d: str) -> DataFrame:
    return tables.writes(_t(spark, d, "events"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return tables.version_log(_t(spark, d, "events"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    orders = _t(spark, d, "orders").withColumn("cents", F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long"))
    return columnar.chunk_stats(orders, "o_orderkey", GROUP_ROWS, _COLUMNS, _NUMERIC)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return tables.event_log(_t(spark, d, "events"))


# -- access paths, predicates, projection ---------------------------------------------------------------


@query("SELECT * FROM customer WHERE c_custkey = 42")
def point_lookup(spark, d):
    return select(_t(spark, d, "customer"), Predicate.eq("c_custkey", 42))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey BETWEEN 10 AND 60")
def range_scan(spark, d):
    return select(_t(spark, d, "customer"), Predicate.between("c_custkey", 10, 60), ["c_custkey", "c_name", "c_acctbal"])


@query("SELECT c_custkey, c_mktsegment FROM customer")
def full_scan(spark, d):
    return select(_t(spark, d, "customer"), Predicate(), ["c_custkey", "c_mktsegment"])


@query("SELECT c_custkey FROM customer WHERE c_custkey BETWEEN 60 AND 10")
def empty_range(spark, d):
    return select(_t(spark, d, "customer"), Predicate.between("c_custkey", 60, 10), ["c_custkey"])


@query("SELECT p_partkey, p_size FROM part WHERE p_size = 7")
def project_cover(spark, d):
    return select(_t(spark, d, "part"), Predicate.eq("p_size", 7), ["p_partkey", "p_size"])


@query("SELECT * FROM part WHERE p_size BETWEEN 40 AND 41")
def project_star(spark, d):
    return select(_t(spark, d, "part"), Predicate.between("p_size", 40, 41))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 3 END AS score FROM customer WHERE CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 3 END = 0")
def filter_null_semantics(spark, d):
    df = _t(spark, d, "customer").withColumn("score", F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 3))
    return select(df, Predicate.eq("score", 0), ["c_custkey", "score"])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
def columnar_scan(spark, d):
    """Appended rows keep their duplicates; predicate and columns reach the Parquet scan."""
    df, p = _t(spark, d, "lineitem"), Predicate.between("l_quantity", 10, 12)
    return select(df.select(*needed_columns(p, ["l_orderkey", "l_linenumber", "l_quantity"], df.columns)), p)


# -- newest wins, folds, compaction -------------------------------------------------------------------------


@query("SELECT key, lsn, op, cents, k FROM live", _LOG)
def lsm_merged_view(spark, d):
    return log.merged_view(_writes(spark, d)).select("key", "lsn", "op", "cents", "k")


@query("SELECT key FROM live", _LOG)
def lsm_live_keys(spark, d):
    return log.merged_view(_writes(spark, d).select("key", "lsn", "op")).select("key")


@query("SELECT key, cents, k FROM live WHERE key = 17", _LOG)
def lsm_point_get(spark, d):
    return log.merged_view(_writes(spark, d).where("key = 17")).select("key", "cents", "k")


@query("SELECT key, cents, k FROM live WHERE key BETWEEN 20 AND 60", _LOG)
def lsm_range(spark, d):
    return log.merged_view(_writes(spark, d).where("key BETWEEN 20 AND 60")).select("key", "cents", "k")


@query(
    """SELECT key, CASE WHEN u.lsn > coalesce(b.lsn, 0) THEN u.cents ELSE b.cents END AS cents, CASE WHEN b.op = 'put' THEN b.k END AS k
FROM (SELECT key, arg_max(row(lsn, op, cents, k)::STRUCT(lsn BIGINT, op VARCHAR, cents BIGINT, k BIGINT), lsn) FILTER (op <> 'upsert') AS b,
        arg_max(row(lsn, cents)::STRUCT(lsn BIGINT, cents BIGINT), lsn) FILTER (op = 'upsert') AS u FROM w GROUP BY key)
WHERE b.op = 'put' OR u.lsn > coalesce(b.lsn, 0)""",
    _LOG,
)
def fractal_fold(spark, d):
    return log.fold_upserts(_writes(spark, d))


@query(f"SELECT key, min(lsn) AS min_lsn, count(*) AS n, count(*) FILTER (op = 'delete') AS tombstones, count(*) * {ENTRY_BYTES} AS bytes FROM (SELECT * FROM w) GROUP BY key", _LOG)
def entries_per_key(spark, d):
    return _writes(spark, d).groupBy("key").agg(F.min("lsn").alias("min_lsn"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("op") == "delete").alias("tombstones"), (F.count(F.lit(1)) * ENTRY_BYTES).alias("bytes"))


_RUNS = f"{_LOG}, runs AS (SELECT *, (lsn - 1) // 1000 AS sst FROM w QUALIFY row_number() OVER (PARTITION BY (lsn - 1) // 1000, key ORDER BY lsn DESC) = 1)"


def _runs(spark, d):
    """Sorted runs of a thousand commands each: the newest write per key and run."""
    w = _writes(spark, d).withColumn("sst", F.floor((F.col("lsn") - 1) / 1000))
    return w.groupBy("sst", "key").agg(F.max_by(F.struct("lsn", "op"), "lsn").alias("r")).select("sst", "key", "r.*")


@query(f"SELECT sst, min(key) AS min_key, max(key) AS max_key, count(*) AS n, count(*) FILTER (op = 'delete') AS tombstones, count(*) * {ENTRY_BYTES} AS bytes FROM runs GROUP BY sst", _RUNS)
def sst_manifest(spark, d):
    n = F.count(F.lit(1))
    return _runs(spark, d).groupBy("sst").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), n.alias("n"), F.count_if(F.col("op") == "delete").alias("tombstones"), (n * ENTRY_BYTES).alias("bytes"))


@query("SELECT CASE WHEN sst % 4 = 3 THEN 0 ELSE 1 END AS level, count(DISTINCT sst) AS files, count(*) AS entries FROM runs GROUP BY 1", _RUNS)
def level_stats(spark, d):
    return _runs(spark, d).groupBy(F.when(F.col("sst") % 4 == 3, 0).otherwise(1).alias("level")).agg(F.countDistinct("sst").alias("files"), F.count(F.lit(1)).alias("entries"))


@query("SELECT (SELECT count(*) FROM w) AS user_writes, (SELECT count(*) FROM runs) AS entries_written, (SELECT count(*) FROM live) AS live_keys", _RUNS)
def write_space_amplification(spark, d):
    """Entries on disk against writes (write amplification) and live keys (space amplification)."""
    runs = _runs(spark, d).agg(F.count(F.lit(1)).alias("entries_written"))
    users = _writes(spark, d).agg(F.count(F.lit(1)).alias("user_writes"))
    live = log.merged_view(_writes(spark, d)).agg(F.count(F.lit(1)).alias("live_keys"))
    return users.join(F.broadcast(runs)).join(F.broadcast(live))  # three rows of one row each


@query("SELECT key, lsn, op, cents, k FROM newest WHERE op <> 'delete' AND lsn <= 5000 UNION ALL SELECT key, lsn, op, cents, k FROM w WHERE lsn > 5000", _LOG.replace("newest AS (SELECT * FROM w QUALIFY", "newest AS (SELECT * FROM w WHERE lsn <= 5000 QUALIFY"))
def compaction_output(spark, d):
    return log.compact(_writes(spark, d), 5000, bottom=True).select("key", "lsn", "op", "cents", "k")


@query("SELECT key, lsn, op, cents, k FROM live", _LOG)
def crash_recovery_equals_live(spark, d):
    """The snapshot up to a low-water mark and the log after it give the live table again."""
    return log.merged_view(log.compact(_writes(spark, d), 7000, bottom=False)).select("key", "lsn", "op", "cents", "k")


@query("SELECT (lsn - 1) // 1000 AS segment, count(*) AS records FROM w WHERE lsn > 7000 GROUP BY 1", _LOG)
def wal_retained(spark, d):
    return _writes(spark, d).where("lsn > 7000").groupBy(F.floor((F.col("lsn") - 1) / 1000).alias("segment")).agg(F.count(F.lit(1)).alias("records"))


@query("SELECT a.sst AS upper, b.sst AS lower FROM (SELECT sst, min(key) AS lo, max(key) AS hi FROM runs GROUP BY sst) a JOIN (SELECT sst, min(key) AS lo, max(key) AS hi FROM runs GROUP BY sst) b ON a.sst % 2 = 0 AND b.sst % 2 = 1 AND a.hi >= b.lo AND a.lo <= b.hi", _RUNS)
def sst_overlaps(spark, d):
    """Range overlaps of two levels, met by buckets of keys."""
    m = _runs(spark, d).groupBy(F.col("sst").alias("id")).agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    return log.overlapping(m.where("id % 2 = 0"), m.where("id % 2 = 1"), 50)


_MUL = "(({a})::HUGEINT * {b} % 4294967296)::BIGINT"


def _mul(a: str, b) -> str:
    return _MUL.format(a=a, b=b)


def _mix_sql(x: str) -> str:
    h1 = _mul(f"xor({x}, {numbers.MIX[0]})", numbers.MIX[1])
    h2 = _mul(f"xor(h1, h1 >> 15)", numbers.MIX[2])
    return f"(SELECT xor(h2, h2 >> 13) FROM (SELECT {h2} AS h2 FROM (SELECT {h1} AS h1)))"


@query(f"SELECT c_custkey AS key, {_mix_sql('c_custkey')} AS h FROM customer")
def mixed_hash(spark, d):
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("key"), numbers.mix32(F.col("c_custkey")).alias("h"))


_BLOOM_BITS, _BLOOM_HASHES = numbers.bloom_shape(1000, 10)
_BLOOM = f"""h AS (SELECT c_custkey AS key, {_mix_sql('c_custkey')} AS a, {_mix_sql(f"xor(c_custkey, {numbers.GOLDEN})")} | 1 AS u FROM customer),
p AS (SELECT key, unnest(list_transform(range({_BLOOM_HASHES}), lambda i: abs((a + i * (CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END)) % {_BLOOM_BITS}))) AS bit FROM h)"""


@query("SELECT count(*) AS probes, count(*) FILTER (missing > 0) AS skips FROM (SELECT key, count(*) FILTER (bit NOT IN (SELECT bit FROM p WHERE key % 2 = 0)) AS missing FROM p WHERE key % 2 = 1 GROUP BY key)", _BLOOM)
def bloom_probe(spark, d):
    """For even keys a filter is built; how many odd keys it excludes."""
    bits, hashes = _BLOOM_BITS, _BLOOM_HASHES
    keys = _t(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    even = keys.where("key % 2 = 0").select(F.explode(numbers.bloom_positions(F.col("key"), bits, hashes)).alias("bit")).distinct()
    odd = keys.where("key % 2 = 1").select("key", F.explode(numbers.bloom_positions(F.col("key"), bits, hashes)).alias("bit"))
    missed = odd.join(even.withColumn("held", F.lit(1)), "bit", "left").groupBy("key").agg(F.count_if(F.col("held").isNull()).alias("missing"))
    return missed.agg(F.count(F.lit(1)).alias("probes"), F.count_if(F.col("missing") > 0).alias("skips"))


# -- hash log ----------------------------------------------------------------------------------------------


@query("SELECT key, (lsn - 1) // 512 AS file, lsn FROM live", _LOG)
def kv_live(spark, d):
    return log.merged_view(_writes(spark, d)).select("key", F.floor((F.col("lsn") - 1) / 512).alias("file"), "lsn")


@query("SELECT (SELECT count(*) FROM w) AS records, (SELECT count(*) FROM live) AS live_records, (SELECT count(*) FROM live) * 24 AS index_bytes", _LOG)
def kv_dead_ratio(spark, d):
    w = _writes(spark, d).select("key", "lsn", "op")
    live = w.join(log.merged_view(w).select("key", "lsn"), ["key", "lsn"], "left_semi").agg(F.count(F.lit(1)).alias("live_records"))
    total = w.agg(F.count(F.lit(1)).alias("records"))
    return total.join(F.broadcast(live)).select("records", "live_records", (F.col("live_records") * KEY_BYTES).alias("index_bytes"))


@query(f"SELECT (lsn - 1) // 512 AS file, count(*) AS garbage, sum(CASE op WHEN 'delete' THEN {TOMBSTONE_BYTES} ELSE {RECORD_BYTES} END)::BIGINT AS reclaimed FROM w ANTI JOIN live USING (key, lsn) GROUP BY 1", _LOG)
def kv_reclaimed(spark, d):
    w = _writes(spark, d).select("key", "lsn", "op")
    gone = w.join(log.merged_view(w).select("key", "lsn"), ["key", "lsn"], "left_anti")
    size = F.when(F.col("op") == "delete", TOMBSTONE_BYTES).otherwise(RECORD_BYTES)
    return gone.groupBy(F.floor((F.col("lsn") - 1) / 512).alias("file")).agg(F.count(F.lit(1)).alias("garbage"), F.sum(size).cast("long").alias("reclaimed"))


@query(
    f"""SELECT bucket, count(*) AS n FROM (SELECT abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % {BUCKETS} AS bucket FROM (
SELECT xor(h2, h2 >> 16) AS h FROM (SELECT {_mul("xor(h1, h1 >> 13)", numbers.BUCKET[1])} AS h2 FROM (SELECT {_mul(f"xor(key, {numbers.GOLDEN})", numbers.BUCKET[0])} AS h1 FROM live)))) GROUP BY bucket""",
    _LOG,
)
def kv_buckets_hist(spark, d):
    live = log.merged_view(_writes(spark, d))
    return live.groupBy(numbers.bucket_of(F.col("key"), BUCKETS).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# -- versions, snapshots, vacuum -----------------------------------------------------------------------------


@query("SELECT key, lsn, xid, cents FROM chain WHERE status = 'committed' AND (xmax IS NULL OR xmax_status = 'active') AND op <> 'delete'", _VERSIONS)
def mvcc_visible(spark, d):
    return log.version_chain(_versions(spark, d)).where(mvcc.visible()).select("key", "lsn", "xid", "cents")


def _count_at(x: int) -> str:
    return f"(SELECT count(*) FROM chain WHERE status = 'committed' AND xid < {x} AND NOT (xmax IS NOT NULL AND xmax_status = 'committed' AND xmax < {x}) AND op <> 'delete')"


@query(f"SELECT {_count_at(150)} AS repeatable_read, {_count_at(190)} AS read_committed", _VERSIONS)
def mvcc_rc_vs_rr(spark, d):
    """A transaction that began at 150 reads again at 190: its own snapshot against a new one."""
    chain = log.version_chain(_versions(spark, d))
    return chain.agg(F.count_if(mvcc.visible(before=150)).alias("repeatable_read"), F.count_if(mvcc.visible(before=190)).alias("read_committed"))


@query("SELECT key, lsn, xid, xmax, depth FROM chain", _VERSIONS)
def version_chain(spark, d):
    return log.version_chain(_versions(spark, d)).select("key", "lsn", "xid", "xmax", F.col("depth").cast("long").alias("depth"))


@query("SELECT lsn, xid, status, op FROM v WHERE key = 17", _VERSIONS)
def versions_of_key(spark, d):
    return _versions(spark, d).where("key = 17").select("lsn", "xid", "status", "op")


@query(
    f"""SELECT (lsn - 1) // {PER_BLOCK} AS block, count(*) FILTER (NOT dead) AS live, count(*) FILTER (dead) AS dead, bool_and(xmax IS NULL AND status = 'committed') AS all_visible
FROM (SELECT *, status = 'aborted' OR coalesce(xmax_status = 'committed', false) AS dead FROM every) GROUP BY 1""",
    _VERSIONS,
)
def bloat_by_block(spark, d):
    return mvcc.block_stats(mvcc.chain_with_aborted(_versions(spark, d)), PER_BLOCK)


_H = "(SELECT coalesce(min(xid) FILTER (status = 'active'), max(xid) + 1) FROM v)"


@query(f"SELECT key, lsn, xid, status FROM every WHERE NOT (status = 'aborted' OR coalesce(xmax_status = 'committed' AND xmax < {_H}, false))", _VERSIONS)
def vacuum_survivors(spark, d):
    return mvcc.dead(mvcc.chain_with_aborted(_versions(spark, d))).where("NOT removable").select("key", "lsn", "xid", "status")


@query("SELECT key, lsn, xid, prev_xid FROM (SELECT *, lag(xid) OVER c AS prev_xid, lag(status) OVER c AS prev_status FROM v WINDOW c AS (PARTITION BY key ORDER BY lsn)) WHERE prev_status = 'active' AND prev_xid <> xid", _VERSIONS)
def write_conflicts(spark, d):
    return mvcc.write_conflicts(_versions(spark, d))


@query("SELECT status, count(*) AS n, count(DISTINCT xid) AS txns FROM v GROUP BY status", _VERSIONS)
def txn_status(spark, d):
    return _versions(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("xid").alias("txns"))


@query("SELECT key, lsn, cents FROM (SELECT * FROM w WHERE lsn <= 4000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY lsn DESC) = 1) WHERE op <> 'delete'", _LOG)
def cow_snapshot_read(spark, d):
    return log.merged_view(_writes(spark, d).where("lsn <= 4000")).select("key", "lsn", "cents")


@query("SELECT count(*) AS reclaimable FROM (SELECT lead(lsn) OVER (PARTITION BY key ORDER BY lsn) AS retired FROM w) WHERE retired <= 4000", _LOG)
def cow_reclaimable(spark, d):
    """Versions retired by transactions up to the oldest open reader."""
    from pyspark.sql import Window

    retired = F.lead("lsn").over(Window.partitionBy("key").orderBy("lsn"))
    return _writes(spark, d).select(retired.alias("retired")).where("retired <= 4000").agg(F.count(F.lit(1)).alias("reclaimable"))


@query("SELECT lsn % 2 AS slot, max(lsn) AS last_txn, count(*) AS commits FROM w GROUP BY 1", _LOG)
def cow_meta_slots(spark, d):
    return _writes(spark, d).groupBy((F.col("lsn") % 2).alias("slot")).agg(F.max("lsn").alias("last_txn"), F.count(F.lit(1)).alias("commits"))


# -- column store --------------------------------------------------------------------------------------------


@query('SELECT row_group, "column", n, n_distinct, min_value, max_value FROM chunks', _CHUNKS)
def zone_map_stats(spark, d):
    return _chunks(spark, d).select("row_group", "column", "n", "n_distinct", "min_value", "max_value")


@query("SELECT row_group, max_value >= 100 AND min_value <= 300 AS scanned FROM chunks WHERE \"column\" = 'o_orderkey'", _CHUNKS)
def zone_map_prune(spark, d):
    c = _chunks(spark, d).where(F.col("column") == "o_orderkey")
    return c.select("row_group", columnar.overlaps(F.col("min_value"), F.col("max_value"), 100, 300).alias("scanned"))


@query(
    """SELECT count(*) FILTER (first AND hit) AS groups_scanned, count(*) FILTER (first AND NOT hit) AS groups_skipped,
  sum(CASE WHEN hit AND "column" IN ('o_orderkey', 'cents') THEN encoded_bytes ELSE 0 END)::BIGINT AS bytes_read, sum(raw_bytes)::BIGINT AS row_store_bytes
FROM (SELECT chunks.*, chunks."column" = 'o_orderkey' AS first, z.max_value >= 100 AND z.min_value <= 300 AS hit FROM chunks JOIN (SELECT * FROM chunks WHERE "column" = 'o_orderkey') z USING (row_group))""",
    _CHUNKS,
)
def scan_bill(spark, d):
    return columnar.scan_bill(_chunks(spark, d), "o_orderkey", 100, 300, {"o_orderkey", "cents"})


@query('SELECT row_group, "column", runs FROM chunks', _CHUNKS)
def rle_runs(spark, d):
    return _chunks(spark, d).select("row_group", "column", "runs")


@query('SELECT row_group, "column", encoding, raw_bytes, encoded_bytes FROM chunks', _CHUNKS)
def encoding_choice(spark, d):
    return _chunks(spark, d).select("row_group", "column", "encoding", "raw_bytes", "encoded_bytes")


@query('SELECT "column", sum(raw_bytes)::BIGINT AS raw_bytes, sum(encoded_bytes)::BIGINT AS encoded_bytes, sum(raw_bytes) / sum(encoded_bytes) AS ratio FROM chunks GROUP BY 1', _CHUNKS)
def compression_ratio(spark, d):
    return _chunks(spark, d).groupBy("column").agg(F.sum("raw_bytes").alias("raw_bytes"), F.sum("encoded_bytes").alias("encoded_bytes"), (F.sum("raw_bytes") / F.sum("encoded_bytes")).alias("ratio"))


# -- statistics, plans, lookups ------------------------------------------------------------------------------


@query("SELECT count(p_size) AS entries, count(DISTINCT p_size) AS n_distinct, min(p_size) AS min_key, max(p_size) AS max_key, greatest(1, ceil(count(p_size) / 100))::BIGINT AS leaf_pages, (1 + (ceil(count(p_size) / 100) > 1)::INT + (ceil(count(p_size) / 100) > 100)::INT + (ceil(count(p_size) / 100) > 10000)::INT)::BIGINT AS height FROM part")
def index_stats(spark, d):
    return cost.index_stats(_t(spark, d, "part"), "p_size")


@query("SELECT 1.0 / count(DISTINCT p_size) AS eq, greatest(1.0 / count(p_size), (least(20, max(p_size)) - greatest(10, min(p_size)) + 1) / (max(p_size) - min(p_size) + 1)) AS rng FROM part")
def selectivity_estimates(spark, d):
    s = cost.collect_stats(_t(spark, d, "part"), "p_size", "idx_size")
    return spark.createDataFrame([(cost.selectivity(Predicate.eq("p_size", 7), s), cost.selectivity(Predicate.between("p_size", 10, 20), s))], "eq double, rng double")


@query()
def plan_choice(spark, d):
    """The explained plan of an equality on the secondary index, with lookups, against the scan."""
    part = _t(spark, d, "part")
    stats = [cost.collect_stats(part, "p_partkey", "PRIMARY", True, True), cost.collect_stats(part, "p_size", "idx_size")]
    p = Predicate.eq("p_size", 7)
    best = next(c for c in cost.choose(cost.clustered_candidates(p, stats, ["p_name"], "p_partkey")) if c.chosen)
    return cost.plan_rows(spark, best, p, ["p_name"])


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size = 7")
def secondary_lookup_join(spark, d):
    """Index entries of the predicate, looked up in the table by key."""
    part = _t(spark, d, "part")
    index = part.select("p_size", "p_partkey").where("p_size = 7")
    return index.join(part.select("p_partkey", "p_name"), "p_partkey").select("p_partkey", "p_name", "p_size")


# -- event logs ------------------------------------------------------------------------------------------------

_METRICS_SQL = ", ".join(f"count(*) FILTER (type IN ({', '.join(repr(t) for t in types)})) AS {name}" for name, types in events.METRICS.items())
_HITS = "count(*) FILTER (type = 'BUFFER_HIT') / nullif(count(*) FILTER (type IN ('BUFFER_HIT', 'BUFFER_MISS')), 0) AS hit_rate"


@query(f"SELECT {_METRICS_SQL}, {_HITS} FROM e", _EVENTS)
def event_metrics(spark, d):
    return events.metrics(_events(spark, d))


@query(f"SELECT {_METRICS_SQL}, {_HITS} FROM e WHERE seq < 500", _EVENTS)
def time_travel_prefix(spark, d):
    return events.state_at(_events(spark, d), 500)


@query("SELECT cmd, min(seq) AS first_seq, max(seq) AS last_seq, sum(duration)::BIGINT AS duration, count(*) AS n_events FROM e GROUP BY cmd", _EVENTS)
def command_spans(spark, d):
    return events.spans(_events(spark, d))


@query("SELECT seq, sum(duration) OVER (ORDER BY seq)::BIGINT AS t FROM e", _EVENTS)
def running_clock(spark, d):
    return events.clock(_events(spark, d)).select("seq", "t")


@query("SELECT min(seq) AS next_seq FROM e WHERE seq > 100 AND type = 'SCAN_STEP'", _EVENTS)
def next_event(spark, d):
    return events.next_matching(_events(spark, d), 100, "SCAN_STEP")


@query("SELECT page, last_seq, row_number() OVER (ORDER BY last_seq DESC) AS place FROM (SELECT page, max(seq) AS last_seq FROM e WHERE type IN ('BUFFER_HIT', 'BUFFER_MISS') GROUP BY page)", _EVENTS)
def page_recency(spark, d):
    return events.recency(_events(spark, d))


@query("SELECT page, seq, type FROM e QUALIFY row_number() OVER (PARTITION BY page ORDER BY seq DESC) <= 3", _EVENTS)
def recent_events(spark, d):
    return events.recent(_events(spark, d), "page", 3).select("page", "seq", "type")


@query("SELECT seq, cmd, type FROM e WHERE seq BETWEEN 420 AND 540", _EVENTS)
def event_window(spark, d):
    return _events(spark, d).where("seq BETWEEN 420 AND 540").select("seq", "cmd", "type")


_JOBS = """j AS (SELECT event_id AS seq, user_id AS tbl, CASE event_type WHEN 'signup' THEN 'BG_JOB_SCHEDULED' WHEN 'click' THEN 'BG_JOB_SCHEDULED' WHEN 'purchase' THEN 'BG_JOB_RUN' WHEN 'error' THEN 'CRASH' ELSE 'NOTE' END AS type FROM events)"""


@query(
    """SELECT tbl, max(depth)::BIGINT AS max_depth FROM (
  SELECT tbl, sum(CASE type WHEN 'BG_JOB_SCHEDULED' THEN 1 WHEN 'BG_JOB_RUN' THEN -1 ELSE 0 END) OVER (PARTITION BY tbl, epoch ORDER BY seq) AS depth
  FROM (SELECT *, count(*) FILTER (type = 'CRASH') OVER (PARTITION BY tbl ORDER BY seq) AS epoch FROM j)) GROUP BY tbl""",
    _JOBS,
)
def queue_depth(spark, d):
    """Signups and clicks schedule jobs, purchases run them, errors crash the table."""
    kind = F.when(F.col("event_type").isin("signup", "click"), "BG_JOB_SCHEDULED").when(F.col("event_type") == "purchase", "BG_JOB_RUN").when(F.col("event_type") == "error", "CRASH").otherwise("NOTE")
    return events.queue_depth(_t(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("tbl"), kind.alias("type")), "tbl")


# -- synthetic rows and state machines ------------------------------------------------------------------------


def _case(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(f"SELECT c_custkey AS id, {_case(tables.NAMES)}[c_custkey % 10 + 1] || '-' || c_custkey AS name, {_case(tables.CITIES)}[c_custkey % 6 + 1] AS city, (c_custkey * 7919 % 100)::INT AS score FROM customer")
def synth_rows(spark, d):
    return tables.user_rows(_t(spark, d, "customer"), "c_custkey")


_T1 = _mul("xor(s, s >> 15)", "(s | 1)")
_T2 = _mul("xor(t1, t1 >> 7)", "(t1 | 61)")


@query(
    f"""SELECT ordinal, 1 + floor(xor(t2, t2 >> 14) / 4294967296.0 * 1000)::BIGINT AS key FROM (SELECT ordinal, xor(t1, (t1 + {_T2}) % 4294967296) AS t2 FROM (
SELECT ordinal, {_T1} AS t1 FROM (SELECT c_custkey AS ordinal, (({SEED} + (c_custkey + 1)::HUGEINT * {numbers.RNG_STEP}) % 4294967296)::BIGINT AS s FROM customer)))"""
)
def rng_stream(spark, d):
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("ordinal"), numbers.random_int(SEED, F.col("c_custkey"), 1, 1000).cast("long").alias("key"))


_FRAMES = 8


@query(
    f"""SELECT pool, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(*) FILTER (NOT hit) - least({_FRAMES}, count(DISTINCT page)) AS evictions
FROM (SELECT a.pool, a.seq, a.page, prev IS NOT NULL AND (SELECT count(DISTINCT b.page) FROM e b WHERE b.page % 8 = a.pool AND b.seq > a.prev AND b.seq < a.seq) < {_FRAMES} AS hit
      FROM (SELECT page % 8 AS pool, seq, page, lag(seq) OVER (PARTITION BY page ORDER BY seq) AS prev FROM e) a) GROUP BY pool""",
    _EVENTS,
)
def buffer_pool_lru(spark, d):
    """In SQL: an access hits if fewer pages than frames were touched since the page's last access."""
    accesses = _events(spark, d).select((F.col("page") % 8).alias("pool"), "seq", "page", F.col("type").isin("RECORD_INSERT", "RECORD_DELETE").alias("writes"))
    return stateful.buffer_pool(accesses, frames=_FRAMES).select("pool", "hits", "misses", "evictions")


_STEPS = """n AS (SELECT key % 8 AS tbl, key, op, row_number() OVER (PARTITION BY key % 8 ORDER BY lsn) AS i FROM w)"""


@query(
    f"""SELECT tbl, freezes, flushes, stalls, retained FROM s QUALIFY row_number() OVER (PARTITION BY tbl ORDER BY i DESC) = 1""",
    "RECURSIVE " + _LOG + ", " + _STEPS + """,
s AS (SELECT tbl, 0::BIGINT AS i, []::BIGINT[] AS keys, 0::BIGINT AS records, []::BIGINT[] AS waiting, 0::BIGINT AS freezes, 0::BIGINT AS flushes, 0::BIGINT AS stalls, 0::BIGINT AS retained FROM n GROUP BY tbl
  UNION ALL
  SELECT tbl, i, keys, records, waiting[1 + least(1, len(waiting)):], freezes, flushes + least(1, len(waiting)), stalls, (records + coalesce(list_sum(waiting[1 + least(1, len(waiting)):]), 0))::BIGINT FROM (
    SELECT tbl, i, keys, records, waiting[1 + greatest(0, len(waiting) - 2):] AS waiting, freezes, flushes + greatest(0, len(waiting) - 2) AS flushes, stalls + greatest(0, len(waiting) - 2) AS stalls FROM (
      SELECT tbl, i, CASE WHEN len(k) >= 8 THEN [] ELSE k END AS keys, CASE WHEN len(k) >= 8 THEN 0 ELSE r END AS records, CASE WHEN len(k) >= 8 THEN list_append(waiting, r) ELSE waiting END AS waiting,
             freezes + (len(k) >= 8)::BIGINT AS freezes, flushes, stalls
      FROM (SELECT s.tbl, n.i, CASE WHEN list_contains(s.keys, n.key) THEN s.keys ELSE list_append(s.keys, n.key) END AS k, s.records + 1 AS r, s.waiting, s.freezes, s.flushes, s.stalls
            FROM s JOIN n ON n.tbl = s.tbl AND n.i = s.i + 1)))""" + ")",
)
def memtable_stall_fold(spark, d):
    """Freezes at eight keys, one flush behind each write, two frozen memtables at most; level 0 has no limits here."""
    writes = _writes(spark, d).select((F.col("key") % 8).alias("tbl"), "lsn", "key")
    folded = stateful.memtable_fold(writes, limit=8, trigger=1 << 40, stop=1 << 40)
    return folded.select("tbl", "freezes", "flushes", "stalls", "retained")


@query(
    """SELECT tbl, slots[p] AS key, (p - 1) // 4 AS block, ((p - 1) % 4)::INT AS slot
FROM (SELECT tbl, slots, unnest(range(1, len(slots) + 1)) AS p FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY tbl ORDER BY i DESC) = 1)) WHERE slots[p] <> -1""",
    "RECURSIVE " + _LOG + ", " + _STEPS + """,
s AS (SELECT tbl, 0::BIGINT AS i, []::BIGINT[] AS slots FROM n GROUP BY tbl
  UNION ALL
  SELECT s.tbl, n.i, CASE
    WHEN n.op = 'delete' THEN list_transform(s.slots, lambda x: CASE WHEN x = n.key THEN -1 ELSE x END)
    WHEN list_contains(s.slots, n.key) THEN s.slots
    WHEN list_contains(s.slots, -1) THEN s.slots[:list_position(s.slots, -1) - 1] || [n.key] || s.slots[list_position(s.slots, -1) + 1:]
    ELSE list_append(s.slots, n.key) END
  FROM s JOIN n ON n.tbl = s.tbl AND n.i = s.i + 1)""",
)
def heap_placement(spark, d):
    return stateful.heap_placement(_writes(spark, d).select((F.col("key") % 8).alias("tbl"), "lsn", "key", "op"), per_page=4)


from . import registry_engines, registry_storage  # noqa: E402, F401  (add their queries)
