"""Core engine: every registered query against DuckDB, and the disciplines against dictionaries."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tarnbase import registry
from tarnbase.functions import numbers, text
from tarnbase.operators import catalogue, events, log, stateful, trees
from tarnbase.plans import cost
from tarnbase.plans.engines import CAPABILITIES, Unsupported, create_engine, list_engines
from tarnbase.plans.predicate import Predicate
from tarnbase.sources import tables
from tarnbase.sources.store import Session, SessionStore

TABLES = "customer supplier part orders lineitem events nation region".split()


def plain(rows):
    flat = lambda x: round(x, 9) if isinstance(x, float) else str(x) if hasattr(x, "isoformat") else x
    return sorted((tuple(flat(x) for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    if name in registry.ORACLE_SQL:
        r = duck.sql(registry.ORACLE_SQL[name])
        assert sorted(r.columns) == columns
        assert got == plain(tuple(x[r.columns.index(c)] for c in columns) for x in r.fetchall())


def mulberry(seed, n):
    out, state, m = [], seed & 0xFFFFFFFF, 0xFFFFFFFF
    for _ in range(n):
        state = (state + 0x6D2B79F5) & m
        t = (state ^ state >> 15) * (state | 1) & m
        t ^= (t + ((t ^ t >> 7) * (t | 61) & m)) & m
        out.append((t ^ t >> 14) / 2**32)
    return out


def test_random_numbers(spark):
    got = [r[1] for r in spark.range(300).select("id", numbers.random_unit(42, F.col("id"))).orderBy("id").collect()]
    assert got == mulberry(42, 300)


def test_bloom_has_no_false_negatives(spark):
    bits, hashes = numbers.bloom_shape(100, 10)
    rows = spark.range(200).select("id", numbers.bloom_positions(F.col("id"), bits, hashes).alias("p")).collect()
    held = {p for r in rows if r.id % 2 == 0 for p in r.p}
    assert all(0 <= p < bits for r in rows for p in r.p)
    assert all(set(r.p) <= held for r in rows if r.id % 2 == 0)
    assert sum(set(r.p) <= held for r in rows if r.id % 2) < 10


def test_synthetic_rows(spark):
    rows = {r.id: (r.name, r.city, r.score) for r in tables.user_rows(tables.bulk_keys(spark, 12, "sequential")).collect()}
    assert rows[1] == ("brin-1", "Shanghai", 19) and rows[4] == ("edgar-4", "Chengdu", 76) and rows[12] == ("codd-12", "Beijing", 28)
    assert [r.key for r in tables.bulk_keys(spark, 3, "reverse", 5).orderBy("ordinal").collect()] == [7, 6, 5]


def test_compaction_keeps_answers(spark, sf):
    w = tables.writes(tables.table(spark, sf, "events"))
    want = plain(log.merged_view(w).select("key", "lsn", "cents").collect())
    for upto in (0, 300, 10**9):
        for bottom in (False, True):
            assert plain(log.merged_view(log.compact(w, upto, bottom)).select("key", "lsn", "cents").collect()) == want
    files = log.split_runs(log.newest(w), 40).groupBy("file").count().collect()
    assert all(r["count"] <= 80 for r in files)


def test_engines_register():
    assert list_engines() == list(CAPABILITIES)


@pytest.mark.parametrize("engine", ["clustered", "heap", "lsm", "kv", "cow", "fractal"])
def test_engine_against_dict(spark, engine):
    e, model, rng = create_engine(spark, engine), {}, random.Random(4242)
    for i in range(120):
        key, row = rng.randrange(1, 30), {"name": f"n{i}", "city": "Xian", "score": i % 100}
        dice = rng.random()
        if dice < 0.65:
            e.execute("insert", key=key, row=row)
            model[key] = row
        elif dice < 0.8 and (engine != "cow" or key in model):
            e.execute("delete", key=key)
            model.pop(key, None)
        elif engine == "fractal":
            e.execute("update", key=key, row={"score": i})
            model[key] = {"name": None, "city": None} | model.get(key, {}) | {"score": i}
        elif engine != "cow" or key in model:
            e.execute("update", key=key, row=row)
            model[key] = row
    assert {r.id: (r.name, r.city, r.score) for r in e.table().collect()} == {k: (v["name"], v["city"], v["score"]) for k, v in model.items()}
    again = create_engine(spark, engine).replay(e.log)
    assert plain(again.table().collect()) == plain(e.table().collect())
    if "compact" in e.capabilities:
        e.execute("compact")
        assert {r.id for r in e.table().collect()} == set(model)


def test_engine_refusals(spark):
    with pytest.raises(Unsupported):
        create_engine(spark, "kv").execute("range_scan", low=1, high=2)
    cow = create_engine(spark, "cow")
    with pytest.raises(Unsupported):
        cow.execute("delete", key=3)
    cow.execute("insert", key=3)
    assert cow.table().count() == 1


@pytest.mark.parametrize("isolation, want", [("read-committed", [3, 4]), ("repeatable-read", [3, 3])])
def test_isolation(spark, isolation, want):
    e = create_engine(spark, "heap")
    e.execute("bulk_insert", count=3)
    e.execute("use_session", session="A")
    e.execute("begin_txn", isolation=isolation)
    seen = [e.table().count()]
    e.execute("use_session", session="B")
    e.execute("insert", key=50)
    e.execute("use_session", session="A")
    assert [*seen, e.table().count()] == want


def test_rollback_conflict_and_own_writes(spark):
    e = create_engine(spark, "heap")
    e.execute("insert", key=1)
    e.execute("begin_txn")
    e.execute("insert", key=2)
    assert e.table().count() == 2
    e.execute("use_session", session="B")
    assert e.table().count() == 1
    with pytest.raises(Unsupported):
        e.execute("insert", key=2)
    e.execute("use_session", session="main")
    e.execute("abort_txn")
    e.execute("vacuum")
    assert [r.id for r in e.table().collect()] == [1]


def test_cow_snapshot(spark):
    e = create_engine(spark, "cow")
    e.execute("bulk_insert", count=8)
    e.execute("use_session", session="A")
    e.execute("begin_txn")
    e.execute("use_session", session="B")
    e.execute("insert", key=99)
    e.execute("use_session", session="A")
    assert sorted(r.id for r in e.table().collect()) == list(range(1, 9))


def test_query_and_hints(spark):
    e = create_engine(spark, "clustered")
    e.execute("bulk_insert", count=20)
    p = Predicate.eq("score", 19)
    assert e.execute("query", predicate=p, columns=["id"], hint="none").collect() == e.execute("query", predicate=p, columns=["id"]).collect()
    assert p.to_sql("users", ["id"]) == "SELECT id FROM users WHERE score = 19"
    assert not p.matches(None) and not p.matches("19") and p.matches(19)


def test_plan_choice():
    pk = cost.IndexStats("PRIMARY", "id", 200, 200, 1, 200, 3, 50, True, True)
    score = cost.IndexStats("idx", "score", 200, 100, 0, 99, 3, 50)
    pick = lambda p, cols=None, hint="auto": next(c for c in cost.choose(cost.clustered_candidates(p, [pk, score], cols, "id"), hint) if c.chosen)
    assert pick(Predicate.between("score", 0, 99)).strategy == "table-scan"
    assert pick(Predicate.between("score", 40, 41)).strategy == "index-range"
    assert not pick(Predicate.eq("score", 3), ["score", "id"]).needs_lookup
    assert pick(Predicate.eq("id", 42)).index == "PRIMARY"
    assert pick(Predicate.eq("score", 3), hint="none").strategy == "table-scan"
    heap = cost.HeapStats(200, 100, 75, 1.0)
    best = next(c for c in cost.choose(cost.heap_candidates(Predicate.eq("score", 3), [score], heap, ["score"], "id")) if c.chosen)
    assert best.strategy == "index-only-scan" and not best.needs_lookup


@pytest.mark.parametrize("frames, misses", [(2, 24), (16, 8)])
def test_buffer_pool(spark, frames, misses):
    rows = [(0, i, i % 8) for i in range(24)]
    df = spark.createDataFrame(rows, "pool bigint, seq bigint, page bigint").selectExpr("*", "page = 0 AS writes")
    assert stateful.buffer_pool(df, frames).first()["misses"] == misses
    r = stateful.buffer_pool(df, frames).first()
    assert (r.flushes, r.dirty) == ((3, 0) if frames == 2 else (0, 1))
    assert stateful.buffer_pool(df, frames, "CLOCK").first()["misses"] == misses


def test_memtable_and_placement(spark):
    rows = [(0, i, i % 10, "put") for i in range(40)]
    df = spark.createDataFrame(rows, "tbl bigint, lsn bigint, key bigint, op string")
    r = stateful.memtable_fold(df, limit=4, jobs=0, stop=100).first()
    assert r.freezes == 10 and r.stalls == 8 and r.flushes == 8
    # Too many files in level 0: a write waits for a compaction.
    r = stateful.memtable_fold(df, limit=4, jobs=0, trigger=2, stop=3).first()
    assert r.compactions > 0 and r.stalls > 8
    placed = stateful.heap_placement(df, 4).collect()
    assert len(placed) == 10 and max(p.block for p in placed) == 2


def test_checkpoints_and_text():
    assert len(events.checkpoints(10_000)) <= 24
    assert text.record_bytes(list(tables.USERS)) == 5 + 2 + 4 + 33 + 17 + 4
    assert [text.format_bytes(n) for n in (100, 2048, 20480, 3 << 20)] == ["100 B", "2.0 KB", "20 KB", "3.00 MB"]
    assert text.format_number(1234567) == "1,234,567" and text.format_number(1234.5) == "1,234.5" and text.format_percent(float("nan")) == "—"
    with pytest.raises(AssertionError):
        text.require(False, "order")
    assert text.format_percent(0.5) == "50.0%" and text.clamp(5, 0, 3) == 3


def test_session_store(spark, tmp_path):
    store = SessionStore(spark, str(tmp_path / "sessions"))
    assert store.list().count() == 0
    s = Session("first", "lsm", {"memtable_limit": 4}, ({"kind": "insert", "key": 1},))
    store.save(s)
    assert store.load(s.id).commands == s.commands
    copy = store.fork(s.id, "second")
    assert store.list().count() == 2
    store.delete(s.id)
    assert [r.id for r in store.list().collect()] == [copy.id]


def test_streaming(spark, sf, tmp_path):
    from tarnbase.streaming import ingest

    source = tmp_path / "in"
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(str(source))
    stream = ingest.read_events(spark, str(source), spark.read.parquet(str(source)).schema)
    ingest.newest_per_batch(tables.writes(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = log.merged_view(spark.read.parquet(str(tmp_path / "out")).drop("epoch"))
    want = log.merged_view(tables.writes(tables.table(spark, sf, "events")))
    assert plain(got.select("key", "lsn").collect()) == plain(want.select("key", "lsn").collect())


def test_labels_and_catalogue(spark):
    assert text.command_label("range_scan", low=1, high=9) == "SELECT … WHERE pk BETWEEN 1 AND 9"
    assert text.command_label("begin_txn", isolation="repeatable-read") == "BEGIN ISOLATION LEVEL REPEATABLE READ"
    assert [text.command_label("compact"), text.command_label("compact", level=0), text.command_label("vacuum", full=True)] == ["COMPACT", "COMPACT L0 → L1", "VACUUM FULL"]
    kinds = catalogue.catalogue(spark).collect()
    assert len(kinds) == len({r.type for r in kinds}) == 99 and sum(r.key_frame for r in kinds) == len(catalogue.KEY_FRAMES) == 33
    none = catalogue.payload_metrics(spark.createDataFrame([], "type string, detail string, amount bigint")).first()
    assert none.wal_bytes == 0 and none.scan_rows == 0 and none.copies_per_row is None


@pytest.mark.parametrize("engine", ["heap", "lsm", "fractal"])
def test_bulk_segments_and_sealed_tail(spark, engine, monkeypatch):
    """Loads stay DataFrames; sealing the tail, compaction and vacuum keep the answer."""
    from tarnbase.plans import engines

    monkeypatch.setattr(engines, "TAIL_ROWS", 3)
    e = create_engine(spark, engine)
    e.load(spark.range(1, 6).selectExpr("id", "'n' AS name", "'c' AS city", "id AS score"))
    e.execute("bulk_insert", count=4, pattern="reverse", start=4)
    for k in (1, 2, 7):
        e.execute("delete", key=k)
    e.execute("update", key=3, row={"name": "x", "city": "y", "score": 1})
    assert engine == "lsm" or (len(e.segments), len(e.tail)) == (3, 1)
    want = [(3, "x"), (4, "edgar-4"), (5, "fay-5"), (6, "gray-6")]
    read = lambda: [(r.id, r.name) for r in e.execute("full_scan").collect()]
    assert read() == want
    if engine == "heap":
        e.execute("begin_txn")
        e.execute("bulk_insert", count=2, pattern="sequential", start=5)
        e.execute("use_session", session="b")
        with pytest.raises(Unsupported):
            e.execute("insert", key=6)
        with pytest.raises(Unsupported):
            e.execute("bulk_insert", count=3, pattern="sequential", start=6)
        e.execute("use_session", session="main")
        e.execute("abort_txn")
        e.execute("vacuum")
        assert not e.status and e._frame().count() == len(want)
    else:
        e.execute("compact")
    assert read() == want


def test_labels_of_all_commands():
    label = text.command_label
    assert label("query", predicate=Predicate.eq("score", 3), columns=["id"]) == "SELECT id WHERE score = 3" and label("query", predicate=Predicate()) == "SELECT *"
    assert label("crash") == "CRASH + RECOVER FROM WAL" and label("use_session", session="a") == "\\c a" and label("run_background", jobs=2).endswith("×2")
    lines = {t: text.describe_event(t, "x", 1200) for t in catalogue.DURATIONS}
    assert len(set(lines.values())) == 99 and lines["SST_CREATE"] == "SST create: x (1,200)"


def test_shuffle_is_a_permutation():
    assert sorted(numbers.shuffled(7, list(range(50)))) == list(range(50)) != numbers.shuffled(7, list(range(50)))
    assert numbers.shuffled(7, list(range(50))) == numbers.shuffled(7, list(range(50)))


@pytest.mark.parametrize("kind", ["btree", "cow", "fractal"])
def test_trees_against_sets(spark, kind):
    rng, model, rows = random.Random(3), set(), []
    for i in range(1500):
        key, op = rng.randrange(300), "delete" if rng.random() < 0.45 else "put"
        model.discard(key) if op == "delete" else model.add(key)
        rows.append((0, i, key, op))
    r = trees.structure(spark.createDataFrame(rows, "tbl bigint, lsn bigint, key bigint, op string"), kind).first()
    assert (r.n_keys, r.min_key, r.max_key, r.key_sum, r.sound) == (len(model), min(model), max(model), sum(model), True)
    assert r.leaf_splits and r.internal_splits and (kind != "btree" or (r.merges and r.borrows))
    assert kind != "fractal" or (r.injected == 1500 and r.buffer_splits and r.hops >= 1500 * 0.5)


def test_cow_copies_a_path():
    t = trees.CowTree(4)
    for k in range(20):
        t.put(k)
    before, height = t.count["copies"], t.height()
    t.delete(7)
    assert t.count["copies"] == before + height and t.count["reused"] > 0


def test_engine_conflicts_use_the_snapshot(spark):
    e = create_engine(spark, "heap")
    e.execute("bulk_insert", count=5)
    e.execute("begin_txn", isolation="repeatable-read")
    with pytest.raises(Unsupported):
        e.execute("begin_txn")
    e.execute("use_session", session="b")
    e.execute("update", key=2, row={"name": "b", "city": "c", "score": 1})
    e.execute("use_session", session="main")
    with pytest.raises(Unsupported):
        e.execute("update", key=2, row={"name": "x", "city": "c", "score": 1})
    assert e.execute("search", key=2).first()["name"] != "b"
    e.execute("abort_txn")
    e.execute("update", key=2, row={"name": "x", "city": "c", "score": 1})
    assert e.execute("search", key=2).first()["name"] == "x"


def test_point_reads_reach_the_scan(spark):
    """The key's filter is pushed into the stored segments."""
    e = create_engine(spark, "lsm")
    e.load(spark.range(1000).selectExpr("id", "'n' AS name", "'c' AS city", "id AS score"))
    plan = e.execute("search", key=17)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,17)" in plan


def test_shared_folder_is_named_on_a_cluster():
    from tarnbase.sources.store import shared_folder

    class Cluster:
        master = "spark://host:7077"

        class _jsc:
            sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))})())

    session = type("Session", (), {"conf": type("C", (), {"get": staticmethod(lambda k, d: None)}), "sparkContext": Cluster})
    with pytest.raises(RuntimeError):
        shared_folder(session)


def test_scenarios(spark):
    from tarnbase.plans import scenarios

    assert len(scenarios.SCENARIOS) >= 53 and len({s.id for s in scenarios.SCENARIOS}) == len(scenarios.SCENARIOS)
    for s in scenarios.SCENARIOS[::3]:
        assert scenarios.run(spark, s).table().count() == s.rows, s.id


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(9)
    a, b = ([(i, x, x + rng.randrange(0, 90)) for i in range(40) for x in [rng.randrange(-200, 500)]] for _ in range(2))
    frame = lambda r: spark.createDataFrame(r, "id bigint, lo bigint, hi bigint")
    want = sorted((i, j) for i, x, y in a for j, u, v in b if y >= u and x <= v)
    assert sorted(map(tuple, log.overlapping(frame(a), frame(b), 25).collect())) == want


def test_overlaps_of_very_long_ranges(spark, monkeypatch):
    """Ranges of any length, blocks of one key and shares of two: lengths don't make rows, each pair comes once."""
    monkeypatch.setattr(log, "MET", 2)
    rng = random.Random(10)
    a, b = ([(i, x, x + rng.choice([0, 1, 7, 10**3, 10**12])) for i in range(30) for x in [rng.choice([-(10**12), -9, 0, 5]) + rng.randrange(12)]] for _ in range(2))
    frame = lambda r: spark.createDataFrame([*r, (99, None, None)], "id bigint, lo bigint, hi bigint")
    want = sorted((i, j) for i, x, y in a for j, u, v in b if y >= u and x <= v)
    assert sorted(map(tuple, log.overlapping(frame(a), frame(b), 1).collect())) == want
    assert log.overlapping(frame([]), frame(b), 1).isEmpty()


def test_clock_over_many_blocks(spark):
    rows = [(i * 3, i % 7) for i in range(500)]
    got = events.clock(spark.createDataFrame(rows, "seq bigint, duration bigint"), block=10).orderBy("seq").collect()
    total = 0
    for (_, x), r in zip(rows, got):
        total += x
        assert r.t == total
