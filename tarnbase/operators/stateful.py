"""Order-dependent state machines: one sequential fold per table, over sorted Arrow batches.

Their state depends on every earlier command of one table, so a table is the unit of parallel work. A task holds the state of one table and one batch of its log.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold_sorted(df: DataFrame, group: str, order: str, columns: tuple[str, ...], start: Callable, step: Callable, finish: Callable, schema: str) -> DataFrame:
    """Feeds the rows of each group, in order, to `step(state, *columns)`; `finish(group, state)` gives the result rows."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for b in batches:
            out = []
            for g, *values in zip(*(b.column(c).to_pylist() for c in (group, *columns))):
                if state is None or g != at:
                    if state is not None:
                        out += finish(at, state)
                    at, state = g, start()
                step(state, *values)
            yield batch(out)
        if state is not None:
            yield batch(finish(at, state))

    held = df.select(group, order, *columns).repartition(group).sortWithinPartitions(group, order)
    return held.mapInArrow(run, schema)


class Pool:
    """Frames of pages under LRU or CLOCK; a dirty page is flushed when it is evicted."""

    def __init__(self, frames: int, policy: str):
        self.frames, self.lru = frames, policy == "LRU"
        self.used: OrderedDict[int, bool] = OrderedDict()  # page -> used since the hand passed
        self.dirty: set[int] = set()
        self.ring: deque[int] = deque()
        self.hits = self.misses = self.evictions = self.flushes = 0

    def access(self, page: int, writes: bool) -> None:
        if page in self.used:
            self.hits += 1
            self.used[page] = True
            if self.lru:
                self.used.move_to_end(page)
        else:
            self.misses += 1
            if len(self.used) >= self.frames:
                self._evict()
            self.used[page] = self.lru
            if not self.lru:
                self.ring.append(page)
        if writes:
            self.dirty.add(page)

    def _evict(self) -> None:
        self.evictions += 1
        if self.lru:
            page, _ = self.used.popitem(last=False)
        else:
            while self.used[self.ring[0]]:
                self.used[self.ring[0]] = False
                self.ring.rotate(-1)
            page = self.ring.popleft()
            del self.used[page]
        if page in self.dirty:
            self.dirty.remove(page)
            self.flushes += 1


def buffer_pool(accesses: DataFrame, frames: int, policy: str = "LRU") -> DataFrame:
    """(pool, hits, misses, evictions, flushes, dirty) of page accesses (pool, seq, page, writes); `dirty`: what a flush of all would write at the end."""
    schema = "pool bigint, hits bigint, misses bigint, evictions bigint, flushes bigint, dirty bigint"
    result = lambda pool, p: [(pool, p.hits, p.misses, p.evictions, p.flushes, len(p.dirty))]
    return fold_sorted(accesses, "pool", "seq", ("page", "writes"), lambda: Pool(frames, policy), Pool.access, result, schema)


class Memtables:
    """The write path of one table: memtable, frozen memtables, level 0 and its background jobs."""

    def __init__(self, limit: int, jobs: int, most_frozen: int, trigger: int, stop: int):
        self.limit, self.jobs, self.most_frozen, self.trigger, self.stop = limit, jobs, most_frozen, trigger, stop
        self.keys: set[int] = set()
        self.records, self.frozen, self.queue, self.files = 0, [], [], 0
        self.freezes = self.flushes = self.stalls = self.compactions = 0

    def write(self, key: int) -> None:
        self.keys.add(key)
        self.records += 1
        if len(self.keys) >= self.limit:
            self.freezes += 1
            self.frozen.append(self.records)
            self.keys, self.records = set(), 0
            self.queue.append("flush")
            while len(self.frozen) > self.most_frozen:
                self.stalls += 1
                self._run("flush")
            while self.files >= self.stop:
                self.stalls += 1
                self._due()
                if not self._run("compaction"):
                    self._compact()
        for _ in range(self.jobs):
            self._run()

    def _due(self) -> None:
        # A level waits for one compaction at most.
        if self.files >= self.trigger and "compaction" not in self.queue:
            self.queue.append("compaction")

    def _compact(self) -> None:
        self.files = 0
        self.compactions += 1

    def _run(self, preferred: str | None = None) -> bool:
        if not self.queue:
            return False
        kind = self.queue.pop(self.queue.index(preferred) if preferred in self.queue else 0)
        if kind == "flush":
            self.frozen.pop(0)
            self.files += 1
            self.flushes += 1
        elif self.files >= self.trigger:
            self._compact()
        self._due()
        return True


def memtable_fold(log: DataFrame, limit: int, jobs: int = 1, most_immutable: int = 2, trigger: int = 4, stop: int = 8) -> DataFrame:
    """(tbl, freezes, flushes, stalls, compactions, retained): freezes, flushes and stalls of each table's memtable; `retained` records are in the log only."""
    schema = "tbl bigint, freezes bigint, flushes bigint, stalls bigint, compactions bigint, retained bigint"
    result = lambda tbl, m: [(tbl, m.freezes, m.flushes, m.stalls, m.compactions, sum(m.frozen) + m.records)]
    return fold_sorted(log, "tbl", "lsn", ("key",), lambda: Memtables(limit, jobs, most_immutable, trigger, stop), Memtables.write, result, schema)


class Slots:
    """Places of a heap in order; freed ones are used again, the first first."""

    def __init__(self):
        self.at: dict[int, int] = {}
        self.free: list[int] = []
        self.end = 0

    def apply(self, key: int, op: str) -> None:
        if op == "delete":
            if key in self.at:
                heapq.heappush(self.free, self.at.pop(key))
        elif key not in self.at:
            if self.free:
                self.at[key] = heapq.heappop(self.free)
            else:
                self.at[key] = self.end
                self.end += 1


def heap_placement(ops: DataFrame, per_page: int) -> DataFrame:
    """(tbl, key, block, slot): placement of inserts and deletes (tbl, lsn, key, op); freed slots are reused, first page with room first."""
    result = lambda tbl, s: [(tbl, k, *divmod(p, per_page)) for k, p in sorted(s.at.items())]
    return fold_sorted(ops, "tbl", "lsn", ("key", "op"), Slots, Slots.apply, result, "tbl bigint, key bigint, block bigint, slot int")
