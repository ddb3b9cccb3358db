"""Ordered reconciliation of logs: newest wins, upsert folds, compaction, recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .events import blocked_before

#: Starts and ranges of one piece that one share holds against each other.
MET = 1024


def newest(log: DataFrame, key: str = "key", order: str = "lsn") -> DataFrame:
    """The newest row of each key. max_by combines on the map side, so a hot key costs one row per task."""
    others = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r")).select(key, "r.*")


def merged_view(log: DataFrame, tombstone: str = "op = 'delete'") -> DataFrame:
    """Newest write of each key, without deleted keys."""
    return newest(log).where(f"NOT ({tombstone})")


def fold_upserts(log: DataFrame) -> DataFrame:
    """(key, cents, k) after messages in order: put replaces, delete removes, upsert sets `cents` only.

    The newest put or delete is a barrier; the newest upsert after it wins its own column.
    """
    barrier = F.max_by(F.struct("lsn", "op", "cents", "k"), F.when(F.col("op") != "upsert", F.col("lsn")))
    upsert = F.max_by(F.struct("lsn", "cents"), F.when(F.col("op") == "upsert", F.col("lsn")))
    g = log.groupBy("key").agg(barrier.alias("b"), upsert.alias("u"))
    above = F.col("u").isNotNull() & (F.col("b").isNull() | (F.col("u.lsn") > F.col("b.lsn")))
    base = F.col("b").isNotNull() & (F.col("b.op") == "put")
    g = g.select("key", "b", "u", above.alias("above"), base.alias("base")).where("above OR base")
    return g.select("key", F.when(F.col("above"), F.col("u.cents")).otherwise(F.col("b.cents")).alias("cents"), F.when(F.col("base"), F.col("b.k")).alias("k"))


def compact(log: DataFrame, upto: int, bottom: bool) -> DataFrame:
    """The log with everything up to `upto` reduced to its newest rows; tombstones go only at the bottom."""
    old = newest(log.where(F.col("lsn") <= upto))
    old = old.where("op <> 'delete'") if bottom else old
    return old.select(*log.columns).unionByName(log.where(F.col("lsn") > upto))


def split_runs(entries: DataFrame, per_file: int) -> DataFrame:
    """Adds `file`: key ranges of about `per_file` entries, from the counts of key ranges, these by blocks (no order of all rows or ranges in one task)."""
    at = F.floor(F.col("key") / per_file)
    ranges = blocked_before(entries.withColumn("range", at), F.col("key"), F.lit(1), per_file)
    placed = ranges.select(F.col("blk").alias("range"), F.floor(F.col("base") / per_file).alias("file"))
    return entries.withColumn("range", at).join(placed, "range").drop("range")


def overlapping(upper: DataFrame, lower: DataFrame, width: int) -> DataFrame:
    """(upper, lower): pairs of key ranges (id, lo, hi) that overlap.

    Of two that overlap one starts in the other. In blocks of `width` keys a range is made of at most two aligned pieces of each power of two, and a start lies in one piece of a
    range or none, so a pair meets once however long both are. Pieces with many starts and ranges are dealt to shares of `MET` by `MET`.
    """
    key = ["turn", "level", "cell"]
    both = upper.select("id", "lo", "hi", F.lit(True).alias("up")).union(lower.select("id", "lo", "hi", F.lit(False).alias("up")))
    both = both.select("*", F.floor(F.col("lo") / width).alias("first"), F.floor(F.col("hi") / width).alias("last"))
    both = both.withColumn("deep", F.floor(F.log2(F.col("last") - F.col("first") + 1)).cast("int"))
    top = both.agg(F.max("deep").alias("top"))
    starts = "transform(sequence(0, top), k -> struct(NOT up AS turn, k AS level, shiftright(first, k) AS cell, true AS starts))"
    left, right = "-shiftright(-first, k)", "shiftright(last + 1, k)"
    ends = [f"if({left} < {right} AND {odd} % 2 <> 0, {cell}, null)" for odd, cell in ((left, left), (right, f"{right} - 1"))]
    pieces = f"flatten(transform(sequence(0, deep), k -> array({', '.join(f'struct(up AS turn, k AS level, {x} AS cell, false AS starts)' for x in ends)})))"
    # The other side is one row.
    dealt = both.join(F.broadcast(top)).select("id", "lo", "hi", "first", F.explode(F.expr(f"concat({starts}, {pieces})")).alias("x")).select("id", "lo", "hi", "first", "x.*").where("cell IS NOT NULL")
    share = lambda rows: F.ceil(F.count_if(rows) / F.lit(MET)).cast("int")
    cells = dealt.groupBy(*key).agg(share(F.col("starts")).alias("np"), share(~F.col("starts")).alias("nr")).where("np > 0 AND nr > 0")
    own, every = "int(pmod(xxhash64(id), {0}))", "explode(sequence(0, {0} - 1))"
    held = dealt.join(cells, key)
    x = held.where("starts").select(*key, F.col("id").alias("p"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), F.col("first").alias("p_first"), F.expr(own.format("np")).alias("i"), F.expr(every.format("nr")).alias("j"))
    y = held.where("NOT starts").select(*key, "id", "lo", "hi", "first", F.expr(every.format("np")).alias("i"), F.expr(own.format("nr")).alias("j"))
    # Of two that start in one block, only the upper one's start counts.
    met = x.join(y, [*key, "i", "j"]).where("p_lo <= hi AND p_hi >= lo AND (NOT turn OR p_first > first)")
    return met.select(F.when(F.col("turn"), F.col("id")).otherwise(F.col("p")).alias("upper"), F.when(F.col("turn"), F.col("p")).otherwise(F.col("id")).alias("lower"))


def version_chain(versions: DataFrame, order: str = "lsn") -> DataFrame:
    """Adds the next version's transaction (`xmax`) and the depth in the chain, per key; aborted writers left out."""
    w = Window.partitionBy("key").orderBy(order)
    return versions.where("status <> 'aborted'").withColumn("xmax", F.lead("xid").over(w)).withColumn("xmax_status", F.lead("status").over(w)).withColumn("depth", F.row_number().over(w))
