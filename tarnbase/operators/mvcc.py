"""Snapshots, visibility, vacuum and conflicts over version tables (key, xid, status, xmax, xmax_status, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(own: int | None = None, before: int | None = None, active: tuple[int, ...] = ()) -> Column:
    """Whether a snapshot sees a version.

    `own`: the reader's transaction; `before`: transactions from it on are in the future; `active`: those open when the snapshot was
    taken. Aborted, future and open writers are invisible, as are versions whose remover counts as committed or is the reader.
    """

    def counts(xid: Column, status: Column) -> Column:
        done = status == "committed"
        if before is not None:
            done &= xid < before
        if active:
            done &= ~xid.isin(*active)
        return done if own is None else done | (xid == own)

    removed = F.col("xmax").isNotNull() & counts(F.col("xmax"), F.col("xmax_status"))
    return counts(F.col("xid"), F.col("status")) & ~F.coalesce(removed, F.lit(False)) & (F.col("op") != "delete")


def horizon(versions: DataFrame) -> DataFrame:
    """One row: the oldest open transaction, or the next one."""
    return versions.agg(F.coalesce(F.min(F.when(F.col("status") == "active", F.col("xid"))), F.max("xid") + 1).alias("horizon"))


def dead(versions: DataFrame) -> DataFrame:
    """Adds `dead` (no new snapshot sees it) and `removable` (no open one either), by the horizon."""
    h = horizon(versions)
    gone = (F.col("status") == "aborted") | F.coalesce(F.col("xmax_status") == "committed", F.lit(False))
    late = (F.col("status") == "aborted") | F.coalesce((F.col("xmax_status") == "committed") & (F.col("xmax") < F.col("horizon")), F.lit(False))
    return versions.join(F.broadcast(h)).withColumn("dead", gone).withColumn("removable", late).drop("horizon")


def chain_with_aborted(versions: DataFrame) -> DataFrame:
    """Every version with its remover: the next writer that was not aborted."""
    later = Window.partitionBy("key").orderBy("lsn").rowsBetween(1, Window.unboundedFollowing)
    nxt = F.first(F.when(F.col("status") != "aborted", F.struct("xid", "status")), ignorenulls=True).over(later)
    return versions.withColumn("n", nxt).select("*", F.col("n.xid").alias("xmax"), F.col("n.status").alias("xmax_status")).drop("n")


def block_stats(versions: DataFrame, per_block: int) -> DataFrame:
    """Live and dead versions of each heap block, and whether all of it is visible to everyone."""
    v = dead(versions).withColumn("block", F.floor((F.col("lsn") - 1) / per_block))
    clean = F.col("xmax").isNull() & (F.col("status") == "committed")
    return v.groupBy("block").agg(F.count_if(~F.col("dead")).alias("live"), F.count_if("dead").alias("dead"), F.bool_and(clean).alias("all_visible"))


def write_conflicts(versions: DataFrame) -> DataFrame:
    """Writes of a key that follow a write of it by another transaction that was still open: pairs of neighbours in the key's chain."""
    w = Window.partitionBy("key").orderBy("lsn")
    v = versions.withColumn("prev_xid", F.lag("xid").over(w)).withColumn("prev_status", F.lag("status").over(w))
    return v.where("prev_status = 'active' AND prev_xid <> xid").select("key", "lsn", "xid", "prev_xid")
