"""Guided experiments as data: an engine, its settings, commands, and the rows they leave."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from .engines import CAPABILITIES, Engine, create_engine
from .predicate import Predicate


@dataclass(frozen=True)
class Scenario:
    id: str
    engine: str
    shows: str
    commands: tuple[dict, ...]
    rows: int
    config: dict = field(default_factory=dict)


def _c(kind: str, **args) -> dict:
    return {"kind": kind, **args}


def _bulk(n: int, start: int = 1, pattern: str = "sequential") -> dict:
    return _c("bulk_insert", count=n, start=start, pattern=pattern)


def _deletes(low: int, high: int) -> tuple[dict, ...]:
    return tuple(_c("delete", key=k) for k in range(low, high))


_RULES = (
    # id, shows, commands, rows, config; for every engine that has all the commands.
    ("load", "a load in key order", (_bulk(20),), 20, {}),
    ("reverse", "a load against key order", (_bulk(20, pattern="reverse"),), 20, {}),
    ("delete", "rows that go", (_bulk(12), *_deletes(1, 7)), 6, {}),
    ("overwrite", "one key many times", (*(_c("insert", key=7, row={"name": f"n{i}", "city": "Xian", "score": i}) for i in range(6)),), 1, {}),
    ("reinsert", "a deleted key again", (_bulk(5), _c("delete", key=3), _c("insert", key=3)), 5, {}),
    ("settings", "a knob turned in between", (_bulk(4), _c("configure", order=8), _c("insert", key=5)), 5, {}),
)
_OWN = (
    ("index", "clustered", "a secondary index used and dropped", (_bulk(30), _c("create_index", name="s", column="score"), _c("query", predicate=Predicate.eq("score", 19), hint="s"), _c("drop_index", name="s")), 30, {}),
    ("rollback", "heap", "an aborted transaction", (_bulk(5), _c("begin_txn"), _c("delete", key=1), _c("insert", key=9), _c("abort_txn")), 5, {}),
    ("commit", "heap", "a committed transaction", (_bulk(5), _c("begin_txn"), _c("delete", key=1), _c("insert", key=9), _c("commit_txn")), 5, {}),
    ("vacuum", "heap", "dead versions swept", (_bulk(12), *_deletes(1, 7), _c("vacuum")), 6, {}),
    ("vacuum-full", "heap", "the heap written anew", (_bulk(12), *_deletes(1, 10), _c("vacuum", full=True)), 3, {}),
    ("two-sessions", "heap", "a reader that keeps its snapshot", (_bulk(3), _c("use_session", session="a"), _c("begin_txn", isolation="repeatable-read"), _c("use_session", session="b"), _c("insert", key=50), _c("use_session", session="a")), 3, {}),
    ("flush", "lsm", "the memtable becomes a run", (*(_c("insert", key=k) for k in range(6)), _c("flush_memtable")), 6, {}),
    ("compact", "lsm", "runs merged", (*(_c("insert", key=k % 10) for k in range(40)), _c("flush_memtable"), _c("compact")), 10, {"memtable_limit": 4}),
    ("tiered", "lsm", "whole levels merged", (*(_c("insert", key=k) for k in range(40)), _c("compact")), 40, {"memtable_limit": 2, "compaction_style": "tiered"}),
    ("crash", "lsm", "memory lost and found", (*(_c("insert", key=k) for k in range(10)), _c("crash")), 10, {"memtable_limit": 4, "max_background_jobs": 0}),
    ("stall", "lsm", "writes that wait", tuple(_c("insert", key=k) for k in range(30)), 30, {"memtable_limit": 2, "max_background_jobs": 0, "max_immutable_memtables": 1}),
    ("tombstones", "lsm", "deletes that outlive their rows", (*(_c("insert", key=k) for k in range(8)), *_deletes(0, 8), _c("flush_memtable"), _c("compact", level=0)), 0, {"memtable_limit": 4, "background_compaction": False, "l0_compaction_trigger": 50}),
    ("row-groups", "columnar", "appends sealed by hand", (_bulk(10), _c("insert", key=1), _c("flush_memtable")), 11, {"row_group_size": 4}),
    ("merge", "kv", "dead records dropped", (*(_c("insert", key=k % 4) for k in range(24)), _c("compact")), 4, {}),
    ("snapshot", "cow", "a root that a reader holds", (_bulk(8), _c("use_session", session="a"), _c("begin_txn"), _c("use_session", session="b"), _c("insert", key=99), _c("use_session", session="a")), 8, {}),
    ("reclaim", "cow", "pages nobody sees", (_bulk(8), *_deletes(1, 5), _c("vacuum")), 4, {}),
    ("upserts", "fractal", "messages for keys that aren't there", (_c("update", key=1, row={"score": 1}), _c("update", key=1, row={"city": "Xian"}), _c("compact")), 1, {}),
)
OWN: tuple[Scenario, ...] = tuple(Scenario(id, engine, shows, commands, rows, config) for id, engine, shows, commands, rows, config in _OWN)
SCENARIOS: tuple[Scenario, ...] = (
    *(Scenario(f"{id}-{engine}", engine, shows, commands, 6 if engine == "columnar" and id == "overwrite" else rows, config) for id, shows, commands, rows, config in _RULES for engine in CAPABILITIES if all(c["kind"] in CAPABILITIES[engine] for c in commands)),
    *OWN,
)


def run(spark: SparkSession, scenario: Scenario) -> Engine:
    """The engine after the scenario's commands."""
    return create_engine(spark, scenario.engine, **scenario.config).replay(list(scenario.commands))
