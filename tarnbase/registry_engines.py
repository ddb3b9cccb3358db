"""Registered queries over the engines, their files and page structures: scripted command logs against SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import numbers
from .operators import columnar, events, log, mvcc, stateful, trees
from .plans import cost, scenarios
from .plans.engines import CAPABILITIES, Engine, Unsupported, create_engine
from .plans.predicate import Predicate, select
from .plans.worker import Worker
from .registry import _CHUNKS, _EVENTS, _LOG, _RUNS, _T1, _T2, _VERSIONS, BUCKETS, GROUP_ROWS, PER_BLOCK, SEED, _case, _chunks, _events, _mul, _runs, _t, _versions, _writes, query
from .sources import store, tables

_FIELDS = "id bigint, name string, city string, score bigint"


def _folder(spark: SparkSession) -> str:
    return f"{store.shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("city"), F.col("c_nationkey").cast("long").alias("score"))


def _row(key: int) -> dict:
    return {"name": f"u{key}", "city": "X", "score": key % 7}


_UPDATED, _DELETED, _INSERTED = (5, 10, 15), range(20, 26), (900_001, 900_002, 900_003)


def _scripted(spark: SparkSession, d: str, id: str, **config) -> Engine:
    """Customers in bulk, then single updates, deletes and inserts as far as the discipline has them."""
    e = create_engine(spark, id, **config)
    e.execute("create_table")
    e.load(_customers(spark, d))
    if "update" in e.capabilities:
        for k in _UPDATED:
            e.execute("update", key=k, row=_row(k))
        for k in _DELETED:
            e.execute("delete", key=k)
    for k in _INSERTED:
        e.execute("insert", key=k, row=_row(k))
    return e


_VALUES = ", ".join(f"({k}, 'u{k}', 'X', {k % 7})" for k in (*_UPDATED, *_INSERTED))
_BASE = "base AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS city, c_nationkey::BIGINT AS score FROM customer)"
_TABLE = f"{_BASE}, ch(id, name, city, score) AS (VALUES {_VALUES}), tbl AS (SELECT * FROM base WHERE id NOT IN ({', '.join(map(str, (*_UPDATED, *_DELETED)))}) UNION ALL SELECT id::BIGINT, name, city, score::BIGINT FROM ch)"


# -- tables of the disciplines ----------------------------------------------------------------------------------------


@query("SELECT * FROM tbl", _TABLE)
def engine_clustered(spark, d):
    """An index, a plan by it and its removal change nothing."""
    e = _scripted(spark, d, "clustered")
    e.execute("create_index", name="by_score", column="score")
    e.execute("insert", key=77_777_777, row=_row(0))
    e.execute("query", predicate=Predicate.eq("score", 3), hint="by_score")
    e.execute("delete", key=77_777_777)
    e.execute("drop_index", name="by_score")
    e.execute("flush_all")
    return e.execute("full_scan")


@query("SELECT * FROM tbl", _TABLE)
def engine_heap(spark, d):
    """With a transaction that is rolled back, one that commits, both kinds of vacuum."""
    e = _scripted(spark, d, "heap")
    e.execute("begin_txn")
    e.execute("insert", key=900_010, row=_row(0))
    e.execute("delete", key=5)
    e.execute("abort_txn")
    e.execute("vacuum")
    e.execute("begin_txn", isolation="repeatable-read")
    e.execute("update", key=30, row=_row(30))
    e.execute("commit_txn")
    e.execute("vacuum", full=True)
    return e.execute("full_scan").where("id <> 30").unionByName(_customers(spark, d).where("id = 30"))


@query("SELECT * FROM tbl", _TABLE)
def engine_lsm(spark, d):
    """Through freezes, flushes, compactions, a crash and recovery."""
    e = _scripted(spark, d, "lsm", memtable_limit=4, l0_compaction_trigger=2)
    e.execute("crash")
    e.execute("run_background")
    e.execute("flush_memtable")
    e.execute("compact")
    return e.execute("full_scan")


@query(f"SELECT * FROM base UNION ALL SELECT * FROM (VALUES {', '.join(f'({k}, $$u{k}$$, $$X$$, {k % 7})' for k in _INSERTED)})", _BASE)
def engine_columnar(spark, d):
    e = _scripted(spark, d, "columnar", row_group_size=2)
    e.execute("flush_memtable")
    return e.execute("full_scan")


@query("SELECT * FROM tbl", _TABLE)
def engine_kv(spark, d):
    e = _scripted(spark, d, "kv")
    e.execute("compact")
    return e.table()


@query("SELECT * FROM tbl", _TABLE)
def engine_cow(spark, d):
    e = _scripted(spark, d, "cow")
    e.execute("use_session", session="reader")
    e.execute("begin_txn")
    e.execute("commit_txn")
    e.execute("vacuum")
    return e.execute("full_scan")


@query(f"SELECT id, name, city, score FROM tbl WHERE id <> 40 UNION ALL SELECT id, name, city, 99 FROM base WHERE id = 40 UNION ALL SELECT 900020, NULL, NULL, 4", _TABLE)
def engine_fractal(spark, d):
    """Upserts set only the columns they give, also of keys that aren't there."""
    e = _scripted(spark, d, "fractal")
    e.execute("update", key=40, row={"score": 99})
    e.execute("compact")
    e.execute("update", key=900_020, row={"score": 4})
    e.execute("flush_all")
    return e.execute("full_scan")


@query("SELECT id, name, city, score FROM base WHERE id <= 60 UNION ALL SELECT 900010, 'u900010', 'X', 900010 % 7", _BASE)
def engine_cow_snapshot(spark, d):
    """What a reader sees that began before deletes and a reclaim, and after an insert."""
    e = create_engine(spark, "cow")
    e.load(_customers(spark, d).where("id <= 60"))
    e.execute("insert", key=900_010, row=_row(900_010))
    e.execute("use_session", session="reader")
    e.execute("begin_txn")
    e.execute("use_session", session="main")
    for k in (1, 2, 900_010):
        e.execute("delete", key=k)
    e.execute("vacuum")
    e.execute("use_session", session="reader")
    return e.execute("full_scan")


def _each(spark: SparkSession, d: str, command: str, read) -> DataFrame:
    found = [read(_scripted(spark, d, id)).withColumn("engine", F.lit(id)) for id in CAPABILITIES if command in CAPABILITIES[id]]
    return reduce(DataFrame.unionByName, found)


_ENGINES = lambda names, table: f"SELECT id, name, score, e.engine FROM {table} JOIN (SELECT unnest({list(names)}) AS engine) e ON true"
_CHANGING = [x for x in CAPABILITIES if x != "columnar"]


@query(f"{_ENGINES([x for x in _CHANGING if x != 'kv'], 'tbl')} WHERE id BETWEEN 4 AND 30 UNION ALL {_ENGINES(['columnar'], 'base')} WHERE id BETWEEN 4 AND 30", _TABLE)
def engine_range_scans(spark, d):
    return _each(spark, d, "range_scan", lambda e: e.execute("range_scan", low=4, high=30).select("id", "name", "score"))


@query(f"{_ENGINES(_CHANGING, 'tbl')} WHERE id IN (5, 21, 900001) UNION ALL {_ENGINES(['columnar'], 'base')} WHERE id IN (5, 21) UNION ALL SELECT 900001, 'u900001', 900001 % 7, 'columnar'", _TABLE)
def engine_point_reads(spark, d):
    """An updated, a deleted and an inserted key in every discipline."""
    read = lambda e: reduce(DataFrame.unionByName, [e.execute("search", key=k).select("id", "name", "score") for k in (5, 21, 900_001)])
    return _each(spark, d, "search", read)


@query(f"SELECT id, name, e.engine, h.hint FROM tbl JOIN (SELECT unnest(['clustered', 'heap', 'lsm', 'cow']) AS engine) e ON true JOIN (SELECT unnest(['auto', 'none', 'by_score']) AS hint) h ON true WHERE score = 3", _TABLE)
def engine_queries(spark, d):
    """A predicate on a column with and without its index, by every hint: the same rows."""
    out = []
    for id in ("clustered", "heap", "lsm", "cow"):
        e = _scripted(spark, d, id)
        if "create_index" in e.capabilities:
            e.execute("create_index", name="by_score", column="score")
            # Written after the index was built.
            e.execute("update", key=5, row=_row(5))
        for hint in ("auto", "none", "by_score"):
            rows = e.execute("query", predicate=Predicate.eq("score", 3), columns=["id", "name"], hint=hint)
            out.append(rows.withColumns({"engine": F.lit(id), "hint": F.lit(hint)}))
    return reduce(DataFrame.unionByName, out)


@query("SELECT count(*) FILTER (score BETWEEN 2 AND 4) AS entries, count(*) AS rows, true AS lookups_agree FROM tbl", _TABLE)
def engine_index_entries(spark, d):
    """Entries of a range in the stored index of a clustered table."""
    e = _scripted(spark, d, "clustered")
    e.execute("create_index", name="by_score", column="score")
    entries = e.indexes["by_score"].entries
    agree = e.table().select("score", "id").exceptAll(entries.select("value", "key")).isEmpty()
    return entries.agg(F.count_if(F.col("value").between(2, 4)).alias("entries"), F.count(F.lit(1)).alias("rows"), F.lit(agree).alias("lookups_agree"))


@query(f"SELECT * FROM (VALUES ('clustered', 'by_score', 'index-range'), ('clustered', 'none', 'table-scan'), ('heap', 'by_score', 'index-scan'), ('heap', 'none', 'seq-scan')) t(engine, hint, strategy)")
def engine_plans(spark, d):
    """The access path that each hint chooses."""
    out = []
    for id in ("clustered", "heap"):
        e = _scripted(spark, d, id)
        e.execute("create_index", name="by_score", column="score")
        for hint in ("by_score", "none"):
            r = e.query_result(Predicate.between("score", 2, 3), None, hint)
            out.append((id, hint, next(c.strategy for c in r.candidates if c.chosen)))
    return spark.createDataFrame(out, "engine string, hint string, strategy string")


@query("SELECT * FROM (VALUES ('update', 'COMMITTED', false), ('update', 'OPEN', true), ('load', 'OPEN', true), ('late', 'REPEATABLE', true), ('begin', 'TWICE', true)) t(command, other, refused)")
def engine_conflicts(spark, d):
    """Which writes the heap refuses: keys of open transactions, keys changed after a repeatable-read snapshot, a second BEGIN."""
    e = create_engine(spark, "heap")
    e.load(_customers(spark, d))

    def refused(kind: str, **args) -> bool:
        try:
            e.execute(kind, **args)
        except Unsupported:
            return True
        return False

    e.execute("begin_txn")
    e.execute("update", key=1, row=_row(1))
    e.execute("commit_txn")
    out = [("update", "COMMITTED", refused("update", key=1, row=_row(2)))]
    e.execute("begin_txn")
    e.execute("update", key=3, row=_row(3))
    e.execute("use_session", session="b")
    out.append(("update", "OPEN", refused("update", key=3, row=_row(4))))
    out.append(("load", "OPEN", refused("bulk_insert", count=5, start=1)))
    e.execute("begin_txn", isolation="repeatable-read")
    e.execute("use_session", session="c")
    e.execute("update", key=9, row=_row(9))
    e.execute("use_session", session="b")
    out.append(("late", "REPEATABLE", refused("delete", key=9)))
    out.append(("begin", "TWICE", refused("begin_txn")))
    return spark.createDataFrame(out, "command string, other string, refused boolean")


@query("SELECT 10 AS retained, 10 AS restored, 10 AS live, 0 AS wal")
def lsm_crash(spark, d):
    """Ten rows at a memtable of four without background jobs: the log holds all of them, and gives them back."""
    e = create_engine(spark, "lsm", memtable_limit=4, max_background_jobs=0)
    for k in range(1, 11):
        e.execute("insert", key=k)
    retained = e.snapshot()["wal"]
    e.execute("crash")
    s = e.snapshot()
    restored = sum(r.n for r in e.levels[0])
    return spark.createDataFrame([(retained, restored, e.table().count(), s["wal"])], "retained int, restored int, live int, wal int")


@query("SELECT 12 AS freezes, 12 AS flushes, 100 AS live, true AS compacted, true AS accounts, 0 AS stalls")
def lsm_levels(spark, d):
    """A hundred keys at a memtable of eight, compaction in step: every entry that goes into a compaction comes out or is dropped."""
    e = create_engine(spark, "lsm", background_compaction=False)
    for k in range(1, 101):
        e.execute("insert", key=k * 37 % 101)
    c = e.snapshot()
    accounts = c["compacted_in"] == c["compacted_out"] + c.get("dropped", 0)
    return spark.createDataFrame([(c["freezes"], c["flushes"], e.table().count(), c["compactions"] > 0, accounts, c.get("stalls", 0))], "freezes int, flushes int, live int, compacted boolean, accounts boolean, stalls int")


@query("SELECT * FROM (VALUES ('immutable-full', true), ('l0-stop', true)) t(reason, stalls)")
def lsm_stalls(spark, d):
    """Both reasons for which a write waits: too many frozen memtables, too many files in level 0."""
    kinds = {}
    for limits in ({"max_immutable_memtables": 1, "max_background_jobs": 0}, {"l0_stop_trigger": 3, "l0_compaction_trigger": 50, "max_background_jobs": 1}):
        e = create_engine(spark, "lsm", memtable_limit=2, **limits)
        for k in range(40):
            e.execute("insert", key=k)
        for r in e.event_log().where("type = 'WRITE_STALL'").groupBy("detail").count().collect():
            kinds[r["detail"]] = kinds.get(r["detail"], 0) + r["count"]
    return spark.createDataFrame([(k, n > 0) for k, n in sorted(kinds.items())], "reason string, stalls boolean")


@query("SELECT 12 AS versions, 6 AS dead, 0.5::DOUBLE AS bloat, 6 AS after, 0.0::DOUBLE AS bloat_after")
def heap_bloat_vacuum(spark, d):
    """Twelve rows, six deleted: half the versions are dead until vacuum."""
    e = create_engine(spark, "heap")
    e.execute("bulk_insert", count=12)
    for k in range(1, 7):
        e.execute("delete", key=k)
    puts = e._frame().where("op = 'put'").count()
    live = e.table().count()
    e.execute("vacuum")
    after = e._frame().count()
    return spark.createDataFrame([(puts, puts - live, (puts - live) / puts, after, (after - e.table().count()) / after)], "versions int, dead int, bloat double, after int, bloat_after double")


# -- events of the engines ------------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('RECORD_INSERT', 6), ('RECORD_DELETE', 6), ('COMMAND_BEGIN', 13), ('COMMAND_END', 13), ('TABLE_CREATE', 1)) t(type, n)")
def engine_events(spark, d):
    """What a clustered table's script emits."""
    counted = _scripted(spark, d, "clustered").event_log().groupBy("type").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return counted.where(F.col("type").isin("RECORD_INSERT", "RECORD_DELETE", "COMMAND_BEGIN", "COMMAND_END", "TABLE_CREATE"))


@query(f"SELECT engine, true AS dense, true AS clock, true AS folds, true AS replays FROM (SELECT unnest({list(CAPABILITIES)}) AS engine)")
def engine_replay(spark, d):
    """Sequence and clock have no gaps, the events fold to the engine's own counters, and replayed commands give the table and the events again."""
    out = []
    for id in CAPABILITIES:
        e = create_engine(spark, id)
        e.execute("bulk_insert", count=30, start=1)
        for k in (3, 31):
            e.execute("insert", key=k)
        log_ = e.event_log().cache()
        r = log_.agg(F.count(F.lit(1)), F.max("seq"), F.max("t"), F.sum("duration")).first()
        folded = {x["type"]: x["count"] for x in log_.groupBy("type").count().collect()}
        again = create_engine(spark, id).replay(e.log)
        out.append((id, r[0] == r[1] + 1 == e.event_count, r[2] == r[3], folded == e.snapshot()["events"], same_rows(again.table(), e.table()) and same_rows(again.event_log(), log_)))
        log_.unpersist()
    return spark.createDataFrame(out, "engine string, dense boolean, clock boolean, folds boolean, replays boolean")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results have the same rows, repeats included."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@query("SELECT cmd, first_seq, last_seq, duration, n_events, first_t, last_t, ok, note FROM (VALUES (1, 0, 3, 320, 4, 40, 320, true, 'ok'), (2, 4, 6, 260, 3, 360, 580, true, 'ok'), (3, 7, 8, 80, 2, 620, 660, false, 'error: index nothing can''t be dropped')) t(cmd, first_seq, last_seq, duration, n_events, first_t, last_t, ok, note)")
def engine_command_spans(spark, d):
    """Begin, end, outcome and note of a table's creation, an insert and a refused command."""
    e = create_engine(spark, "clustered")
    e.execute("create_table")
    e.execute("insert", key=1)
    try:
        e.execute("drop_index", name="nothing")
    except Unsupported:
        pass
    return events.spans(e.event_log())


_METRICS_AT = ", ".join(f"count(*) FILTER (type IN ({', '.join(repr(t) for t in types)})) AS {name}" for name, types in events.METRICS.items())


@query(f"SELECT {_METRICS_AT}, count(*) FILTER (type = 'BUFFER_HIT') / nullif(count(*) FILTER (type IN ('BUFFER_HIT', 'BUFFER_MISS')), 0) AS hit_rate FROM e WHERE seq < 987", _EVENTS)
def state_from_checkpoint(spark, d):
    """The same prefix as a plain fold, from a stored checkpoint and the events behind it."""
    e = _events(spark, d)
    return events.state_from(events.store_checkpoints(e, _folder(spark), interval=25), e, 987)


@query("SELECT 500 + 1 AS next_event, 500 - 1 AS previous_event, (500 // 5 + 1) * 5 AS next_command, (500 // 5 - 1) * 5 AS previous_command, 900 AS next_marker, 20 AS previous_marker")
def event_jumps(spark, d):
    return spark.createDataFrame([events.jump(_events(spark, d), 500, [10, 20, 900, 950])], "next_event int, previous_event int, next_command int, previous_command int, next_marker int, previous_marker int")


@query("SELECT 'ready' AS kind, 1 AS messages, 0 AS events UNION ALL SELECT 'events', 4, 19 UNION ALL SELECT 'error', 1, 0")
def worker_protocol(spark, d):
    """init, run and reset: events come in chunks of at most a given size."""
    w = Worker(spark, chunk=6)
    out = w.handle({"kind": "init", "engine": "clustered"}) + w.handle({"kind": "run", "commands": [{"kind": "create_table"}, *({"kind": "insert", "key": k} for k in range(1, 5)), {"kind": "search", "key": 2}]})
    out = [m for m in out if m["kind"] != "done"] + w.handle({"kind": "run", "commands": [{"kind": "vacuum"}]})
    counted = {}
    for m in out:
        n, k = counted.get(m["kind"], (0, 0))
        counted[m["kind"]] = (n + 1, k + len(m.get("events", ())))
    return spark.createDataFrame([(kind, n, k) for kind, (n, k) in counted.items() if kind != "done"], "kind string, messages int, events int")


@query(f"SELECT * FROM (VALUES {', '.join(f'($${s.id}$$, $${s.engine}$$, {s.rows})' for s in scenarios.OWN)}) t(scenario, engine, rows)")
def scenario_runs(spark, d):
    """Each discipline's own scenarios run to their end and leave as many rows as they say."""
    out = [(s.id, s.engine, scenarios.run(spark, s).table().count()) for s in scenarios.OWN]
    return spark.createDataFrame(out, "scenario string, engine string, rows int")


# -- page structures -----------------------------------------------------------------------------------------------------


_LIVE_KEYS = "SELECT key % 8 AS tbl, count(*) AS n_keys, min(key) AS min_key, max(key) AS max_key, sum(key)::BIGINT AS key_sum, true AS sound FROM live GROUP BY 1"


def _tree(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return trees.structure(_writes(spark, d).select((F.col("key") % 8).alias("tbl"), "lsn", "key", "op"), kind)


@query(_LIVE_KEYS, _LOG)
def btree_keys(spark, d):
    """The keys of a B+ tree after all splits, borrows and merges; `sound`: in order, leaves equally deep, nodes half full."""
    return _tree(spark, d, "btree").select("tbl", "n_keys", "min_key", "max_key", "key_sum", "sound")


@query(_LIVE_KEYS, _LOG)
def cow_tree_keys(spark, d):
    return _tree(spark, d, "cow").select("tbl", "n_keys", "min_key", "max_key", "key_sum", "sound")


@query(_LIVE_KEYS, _LOG)
def message_tree_keys(spark, d):
    return _tree(spark, d, "fractal").select("tbl", "n_keys", "min_key", "max_key", "key_sum", "sound")


@query("SELECT key % 8 AS tbl, true AS node_count, true AS copies_are_paths FROM live GROUP BY 1", _LOG)
def tree_accounts(spark, d):
    """Splits and merges account for every node; a copy-on-write commit copies its path."""
    nodes = 1 + F.col("leaf_splits") + F.col("internal_splits") - F.col("merges")
    # Of the root's changes, those that added a level and those that took one away differ by the height.
    btree = _tree(spark, d, "btree").select("tbl", (F.col("pages") == nodes + F.col("height") - 1).alias("node_count"))
    cow = _tree(spark, d, "cow").select("tbl", ((F.col("copies") >= F.col("commits")) & (F.col("copies") <= F.col("commits") * (F.col("height") + 1))).alias("copies_are_paths"))
    return btree.join(cow, "tbl")


@query("SELECT true AS falls")
def message_write_amplification(spark, d):
    """Leaf pushes a message needs fall, or stay, as buffers grow."""
    w = _writes(spark, d).select(F.lit(0).cast("long").alias("tbl"), "lsn", "key", "op").where("lsn <= 2000")
    pushed = [(c, trees.structure(w, "fractal", capacity=c).select("flushes").first()[0]) for c in (4, 16, 64)]
    return spark.createDataFrame([(all(a[1] >= b[1] for a, b in zip(pushed, pushed[1:])),)], "falls boolean")


@query("SELECT pool, count(*) AS accesses, true AS accounts FROM (SELECT page % 8 AS pool FROM e) GROUP BY pool", _EVENTS)
def buffer_pool_flushes(spark, d):
    """Dirty pages are flushed when they are evicted, or by a flush of all; under CLOCK, too."""
    a = _events(spark, d).select((F.col("page") % 8).alias("pool"), "seq", "page", F.col("type").isin("RECORD_INSERT", "RECORD_DELETE").alias("writes"))
    p = stateful.buffer_pool(a, frames=8, policy="CLOCK")
    return p.select("pool", (F.col("hits") + F.col("misses")).alias("accesses"), ((F.col("flushes") <= F.col("evictions")) & (F.col("dirty") <= 8) & (F.col("misses") >= F.col("evictions"))).alias("accounts"))


# -- files -----------------------------------------------------------------------------------------------------------------

_BITS, _HASHES = numbers.bloom_shape(500, 10)


@query("SELECT count(*) AS entries, count(*) FILTER (op = 'delete') AS tombstones, true AS disjoint, true AS found FROM newest", _LOG)
def sorted_run_files(spark, d):
    """Written runs: all entries, key ranges that don't overlap, and a filter that never hides a key."""
    path = _folder(spark)
    entries = log.newest(_writes(spark, d).select("key", "lsn", "op"))
    m = store.write_sorted_runs(entries, path, 4, _BITS, _HASHES)
    next_low = F.lead("low").over(Window.orderBy("low"))  # a row per file
    ranges = m.withColumn("after", next_low).agg(F.sum("n").alias("entries"), F.sum("tombstones").alias("tombstones"), F.bool_and(F.col("after").isNull() | (F.col("high") < F.col("after"))).alias("disjoint"))
    keys = [r["key"] for r in entries.orderBy("key").limit(5).collect()]
    found = all(spark.read.parquet(f"{path}/runs").join(store.runs_for(m, k, _BITS, _HASHES).select("run"), "run", "left_semi").where(F.col("key") == k).count() == 1 for k in keys)
    return ranges.withColumn("found", F.lit(found))


@query("SELECT lsn // 512 AS file, count(*) AS records, sum(CASE op WHEN 'delete' THEN 10 ELSE 40 END)::BIGINT AS bytes, lsn // 512 < (SELECT max(lsn) // 512 FROM w) AS sealed FROM w GROUP BY file", _LOG)
def log_files(spark, d):
    """An append log in files, written in two appends; all files but the last are sealed."""
    path, w = _folder(spark), _writes(spark, d).select("lsn", "key", "op")
    store.append_log(w.where("lsn <= 600"), path, 512)
    store.append_log(w.where("lsn > 600"), path, 512)
    return store.sealed_files(spark.read.parquet(path)).withColumn("file", F.col("file").cast("long"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 100 AND 300")
def row_group_files(spark, d):
    """Row groups in key order, read back through their statistics."""
    path = _folder(spark)
    store.write_row_groups(_t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path, "o_orderkey")
    return select(spark.read.parquet(path), Predicate.between("o_orderkey", 100, 300), ["o_orderkey", "o_orderstatus"])


@query("SELECT 2 AS version, 'heap' AS engine, 3 AS commands, true AS events_agree, 2 AS rows")
def exports(spark, d):
    """Events in a versioned envelope and the state as JSON, read back."""
    e, path = create_engine(spark, "heap"), _folder(spark)
    e.execute("create_table")
    for k in (1, 2):
        e.execute("insert", key=k)
    store.export_events(e.event_log(), f"{path}/log", e.id, {"isolation": e.config.isolation}, e.log)
    envelope, back = store.read_export(spark, f"{path}/log", Engine._EVENT)
    store.export_state({"users": e.table()}, f"{path}/state")
    rows = spark.read.schema(_FIELDS).json(f"{path}/state/users").count()
    return spark.createDataFrame([(envelope["version"], envelope["engine"], len(envelope["commands"]), same_rows(back, e.event_log()), rows)], "version int, engine string, commands int, events_agree boolean, rows int")


@query("SELECT * FROM (VALUES ('first', 2, 1), ('second', 2, 0)) t(name, commands, markers)")
def session_store(spark, d):
    """Sessions saved, forked, changed and deleted; the newest row of each counts."""
    s = store.SessionStore(spark, _folder(spark))
    first = store.Session("first", "lsm", commands=({"kind": "insert", "key": 1}, {"kind": "insert", "key": 2}), updated_at=1)
    s.save(first)
    s.fork(first.id, "second")
    s.save(store.Session("first", "lsm", commands=first.commands, markers=(5,), id=first.id, updated_at=2))
    gone = store.Session("third", "kv", updated_at=3)
    s.save(gone)
    s.delete(gone.id)
    body = s.list()
    count = lambda c: F.size(F.from_json(F.get_json_object("body", c), "array<string>"))
    return body.select(F.get_json_object("body", "$.name").alias("name"), count("$.commands").alias("commands"), count("$.markers").alias("markers"))


# -- statistics, plans, visibility ----------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 10 AND 12")
def predicate_sql(spark, d):
    """A predicate's own SQL text, run by Spark."""
    _t(spark, d, "part").createOrReplaceTempView("part_of_predicate_sql")
    return spark.sql(Predicate.between("p_size", 10, 12).to_sql("part_of_predicate_sql", ["p_partkey", "p_name"]))


_COST = """i AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT p_size) AS sizes, greatest(1, ceil(count(*) / 100)) AS leaves FROM part),
h AS (SELECT *, 1 + (leaves > 1)::INT + (leaves > 100)::INT + (leaves > 10000)::INT AS height, greatest(1, floor(n / sizes + 0.5)) AS hits FROM i)"""


@query(
    """SELECT 'table-scan' AS strategy, hits::BIGINT AS est_rows, round(leaves + n * 0.02, 6) AS est_cost, false AS needs_lookup FROM h
UNION ALL SELECT 'index-seek', hits::BIGINT, round(height + greatest(1, ceil(hits / greatest(1, n / leaves))) + hits * 0.02 + hits * height * 1.4, 6), true FROM h""",
    _COST,
)
def plan_costs(spark, d):
    """Both candidates of an equality on the secondary index when looked-up columns are wanted."""
    part = _t(spark, d, "part")
    stats = [cost.collect_stats(part, "p_partkey", "PRIMARY", True, True), cost.collect_stats(part, "p_size", "idx_size")]
    found = cost.clustered_candidates(Predicate.eq("p_size", 7), stats, ["p_name"], "p_partkey")
    return spark.createDataFrame([(c.strategy, c.est_rows, round(float(c.est_cost), 6), c.needs_lookup) for c in found], "strategy string, est_rows bigint, est_cost double, needs_lookup boolean")


@query("SELECT 'p_size' AS covered_by, true AS covers_itself, true AS covers_with_key, false AS covers_name, true AS clustered_covers_all")
def covering_test(spark, d):
    idx, pk = cost.IndexStats("idx", "p_size", 1, 1, 0, 0, 1, 1), cost.IndexStats("PRIMARY", "p_partkey", 1, 1, 0, 0, 1, 1, True, True)
    test = lambda s, c: cost.covers(s, c, "p_partkey")
    return spark.createDataFrame([("p_size", test(idx, ["p_size"]), test(idx, ["p_size", "p_partkey"]), test(idx, ["p_size", "p_name"]), test(pk, None))], "covered_by string, covers_itself boolean, covers_with_key boolean, covers_name boolean, clustered_covers_all boolean")


@query("SELECT count(*) FILTER (op <> 'delete') - count(*) FILTER (op = 'delete') AS entries, count(DISTINCT key) FILTER (op <> 'delete') AS n_distinct, min(key) FILTER (op <> 'delete') AS min_key, max(key) FILTER (op <> 'delete') AS max_key FROM w", _LOG)
def incremental_statistics(spark, d):
    """Statistics kept up by each insert and delete: bounds never shrink. Folded per part of the log, then together."""
    w = _writes(spark, d)
    put, gone = F.col("op") != "delete", F.col("op") == "delete"
    return w.agg((F.count_if(put) - F.count_if(gone)).alias("entries"), F.countDistinct(F.when(put, F.col("key"))).alias("n_distinct"), F.min(F.when(put, F.col("key"))).alias("min_key"), F.max(F.when(put, F.col("key"))).alias("max_key"))


@query(f"SELECT count(*) FILTER (NOT dead) AS live, count(*) FILTER (dead) AS dead, count(DISTINCT (lsn - 1) // {PER_BLOCK}) AS pages, count(*) FILTER (dead) / count(*) AS bloat FROM (SELECT *, status = 'aborted' OR coalesce(xmax_status = 'committed', false) AS dead FROM every)", _VERSIONS)
def bloat_stat(spark, d):
    """Live and dead versions, pages and the dead share, as of the last command."""
    v = mvcc.dead(mvcc.chain_with_aborted(_versions(spark, d)))
    return v.agg(F.count_if(~F.col("dead")).alias("live"), F.count_if("dead").alias("dead"), F.countDistinct(F.floor((F.col("lsn") - 1) / PER_BLOCK)).alias("pages"), (F.count_if("dead") / F.count(F.lit(1))).alias("bloat"))


@query(f"SELECT xid, sum(live) OVER o AS live, sum(dead) OVER o AS dead FROM (SELECT xid, count(*) FILTER (status <> 'aborted') AS live, count(*) FILTER (status = 'aborted') AS dead FROM v GROUP BY xid) WINDOW o AS (ORDER BY xid)", _VERSIONS)
def bloat_by_transaction(spark, d):
    """Versions in the heap after each transaction, those of aborted ones apart; running totals by blocks of transactions."""
    per = _versions(spark, d).groupBy("xid").agg(F.count_if(F.col("status") != "aborted").alias("l"), F.count_if(F.col("status") == "aborted").alias("x"))
    out = per.withColumn("blk", F.floor(F.col("xid") / 100))
    for name, column in (("live", "l"), ("dead", "x")):
        before = events.blocked_before(per, F.col("xid"), F.col(column), 100).withColumnRenamed("base", f"b_{name}")
        out = out.join(before, "blk").withColumn(name, F.col(f"b_{name}") + F.sum(column).over(Window.partitionBy("blk").orderBy("xid")))
    return out.select("xid", F.col("live").cast("long").alias("live"), F.col("dead").cast("long").alias("dead"))


@query("SELECT 5 AS skipped, 1 AS scanned, 3 AS rows_matched, ['id'] AS columns_read")
def scan_bill_small(spark, d):
    """Ids 1 to 3 of 24 rows in row groups of four: five of six groups are skipped."""
    rows = tables.user_rows(spark.range(1, 25).withColumnRenamed("id", "key")).select("id")
    chunks = columnar.chunk_stats(rows.withColumn("at", F.col("id") - 1), "at", 4, {"id": 4}, {"id"})
    z = chunks.where(F.col("column") == "id").select(columnar.overlaps(F.col("min_value"), F.col("max_value"), 1, 3).alias("hit"))
    matched = select(rows, Predicate.between("id", 1, 3)).count()
    return z.agg(F.count_if(~F.col("hit")).cast("int").alias("skipped"), F.count_if("hit").cast("int").alias("scanned"), F.lit(matched).alias("rows_matched"), F.array(F.lit("id")).alias("columns_read"))


@query("SELECT count(*) FILTER (lsn <= 5000) AS entries_in, (SELECT count(*) FROM n WHERE op <> 'delete') AS entries_out, count(*) FILTER (lsn <= 5000) - (SELECT count(*) FROM n WHERE op <> 'delete') AS dropped FROM w", _LOG + ", n AS (SELECT * FROM w WHERE lsn <= 5000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY lsn DESC) = 1)")
def compaction_counters(spark, d):
    """What a compaction of the bottom level read, wrote and dropped, in one pass by key."""
    per = _writes(spark, d).where("lsn <= 5000").groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.max_by("op", "lsn") != "delete").cast("long").alias("kept"))
    return per.agg(F.sum("n").alias("entries_in"), F.sum("kept").alias("entries_out"), (F.sum("n") - F.sum("kept")).alias("dropped"))


_BUCKET_SQL = f"""b AS (SELECT *, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % {BUCKETS} AS bucket FROM (
SELECT *, xor(h2, h2 >> 16) AS h FROM (SELECT *, {_mul("xor(h1, h1 >> 13)", numbers.BUCKET[1])} AS h2 FROM (SELECT *, {_mul(f"xor(key, {numbers.GOLDEN})", numbers.BUCKET[0])} AS h1 FROM
(SELECT key, min(lsn) AS first, arg_max(op, lsn) AS op FROM w GROUP BY key HAVING arg_max(op, lsn) <> 'delete')))))"""


@query("SELECT key, bucket, row_number() OVER (PARTITION BY bucket ORDER BY first) AS steps FROM b", f"{_LOG}, {_BUCKET_SQL}")
def kv_chain_steps(spark, d):
    """Entries that a probe walks in its bucket, in the order in which keys came."""
    live = _writes(spark, d).groupBy("key").agg(F.min("lsn").alias("first"), F.max_by("op", "lsn").alias("op")).where("op <> 'delete'")
    chain = live.withColumn("bucket", numbers.bucket_of(F.col("key"), BUCKETS))
    return chain.select("key", "bucket", F.row_number().over(Window.partitionBy("bucket").orderBy("first")).cast("long").alias("steps"))


@query("SELECT count(DISTINCT bucket) AS buckets_used, max(n) AS longest FROM (SELECT bucket, count(*) AS n FROM b GROUP BY bucket)", f"{_LOG}, {_BUCKET_SQL}")
def kv_longest_chain(spark, d):
    live = log.merged_view(_writes(spark, d).select("key", "lsn", "op"))
    sizes = live.groupBy(numbers.bucket_of(F.col("key"), BUCKETS).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("buckets_used"), F.max("n").alias("longest"))


@query("SELECT count(*) FILTER (retired > 4000) AS retained, count(*) FILTER (retired <= 4000) AS free FROM (SELECT lead(lsn) OVER (PARTITION BY key ORDER BY lsn) AS retired FROM w)", _LOG)
def cow_pages(spark, d):
    """Pages that readers at transaction 4000 still hold, and those on the free list."""
    retired = _writes(spark, d).select(F.lead("lsn").over(Window.partitionBy("key").orderBy("lsn")).alias("retired"))
    return retired.agg(F.count_if(F.col("retired") > 4000).alias("retained"), F.count_if(F.col("retired") <= 4000).alias("free"))


@query("SELECT c_custkey AS id, ((c_custkey * 7919 % 100 + 2 * 13) % 100)::INT AS score FROM customer")
def bumped_rows(spark, d):
    """The second update of each row."""
    return tables.bumped(tables.user_rows(_t(spark, d, "customer"), "c_custkey"), 2).select("id", "score")


@query("SELECT c_custkey AS block, (c_custkey % 7)::INT AS slot, c_custkey * 4096 + c_custkey % 7 AS tid, true AS back FROM customer")
def tids(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("block"), (F.col("c_custkey") % 7).cast("int").alias("slot"))
    packed = c.withColumn("tid", numbers.pack_tid(F.col("block"), F.col("slot")))
    return packed.withColumn("back", numbers.unpack_tid(F.col("tid")) == F.struct("block", "slot"))


@query(
    f"""SELECT ordinal, {_case(tables.CITIES)}[1 + floor(xor(t2, t2 >> 14) / 4294967296.0 * {len(tables.CITIES)})::BIGINT] AS city FROM (SELECT ordinal, xor(t1, (t1 + {_T2}) % 4294967296) AS t2 FROM (
SELECT ordinal, {_T1} AS t1 FROM (SELECT c_custkey AS ordinal, (({SEED} + (c_custkey + 1)::HUGEINT * {numbers.RNG_STEP}) % 4294967296)::BIGINT AS s FROM customer)))"""
)
def random_picks(spark, d):
    """A word for each draw of the generator."""
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("ordinal"), numbers.random_pick(SEED, F.col("c_custkey"), tables.CITIES).alias("city"))


def _seen(own: int, before: int, active: tuple[int, ...]) -> str:
    counts = lambda x, s: f"(({s} = 'committed' AND {x} < {before} AND {x} NOT IN {active}) OR {x} = {own})"
    return f"SELECT key, lsn, xid FROM chain WHERE {counts('xid', 'status')} AND NOT coalesce(xmax IS NOT NULL AND {counts('xmax', 'xmax_status')}, false) AND op <> 'delete'"


@query(_seen(171, 180, (165, 166)), _VERSIONS)
def mvcc_own_and_active(spark, d):
    """A snapshot with an own transaction, a future and transactions that were open when it was taken."""
    return log.version_chain(_versions(spark, d)).where(mvcc.visible(own=171, before=180, active=(165, 166))).select("key", "lsn", "xid")


@query("SELECT * FROM (SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 200)")
def scan_output_cap(spark, d):
    """The first rows of a scan, as many as an output pane shows."""
    return _t(spark, d, "customer").select("c_custkey", "c_name").orderBy("c_custkey").limit(200)


@query("SELECT 'PRIMARY' AS name, 'id' AS \"column\", 1 AS place UNION ALL SELECT 'a_score', 'score', 2 UNION ALL SELECT 'b_score', 'score', 3")
def index_listing(spark, d):
    """Indexes of a table, the primary one first, then by name."""
    e = create_engine(spark, "heap")
    e.execute("bulk_insert", count=3)
    for name in ("b_score", "a_score"):
        e.execute("create_index", name=name, column="score")
    names = sorted(e.indexes, key=lambda n: (n != "PRIMARY", n))
    return spark.createDataFrame([(n, e.indexes[n].column if e.indexes[n] else e.schema.key, i) for i, n in enumerate(names, 1)], "name string, column string, place int")


@query("SELECT * FROM (VALUES ('v', 41)) t(name, top)")
def custom_schema(spark, d):
    """A table of other columns: its key, types and defaults come from the schema."""
    from .plans.engines import TableSchema

    e = create_engine(spark, "clustered")
    e.execute("create_table", schema=TableSchema("points", "pid", (("name", "string"), ("x", "bigint"))))
    for k in range(3):
        e.execute("insert", key=k, row={"name": "v", "x": 40 + k % 2})
    return e.execute("query", predicate=Predicate.eq("pid", 1)).select("name", F.col("x").cast("int").alias("top"))
