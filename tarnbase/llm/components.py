"""Connected components on executors: alternating large and small stars, every round cut in the shared folder; counted few edges by one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node joins all its larger neighbours to the smallest node it knows."""
    both = edges.union(edges.select("b", "a").toDF("a", "b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node joins itself and its smaller neighbours to the smallest of them; edges have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    met = edges.join(least, "b")
    return met.where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m").alias("a"), "b")).distinct()


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable from each) of the edges (a, b)."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    root, u, v = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while True:
        x, y = root[u], root[v]
        if (x == y).all():
            return nodes, nodes[root]
        # Roots are hooked to the smallest root next to them: of each component at least half of them go.
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(above := root[root], root):
            root = above


def _alone(edges: DataFrame) -> DataFrame:
    """(node, root) by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        empty = np.empty(0, np.int64)
        found = roots_of(*(np.concatenate([empty, *side]) for side in zip(*held))) if held else (empty, empty)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "root"])

    return edges.coalesce(1).mapInArrow(run, "node bigint, root bigint")


def components(edges: DataFrame, most_rounds: int = 60, alone: int = 0) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of an edge (a, b); nodes are longs.

    Up to `alone` edges, counted, are one task's work: rounds of stars on them are hundreds of exchanges whose files and plans outweigh the rows. More go by stars.

    Minima are pre-aggregated before their shuffle and the joins back are plain joins that adaptive execution can
    split, so a node with very many neighbours is not one task's work. Self-edges and repeated edges are allowed.
    """
    e = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    if alone and e.count() <= alone:
        return _alone(e)
    seen = None
    for _ in range(most_rounds):
        e = cut(_small_star(_large_star(e)))
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).union(e.select("a", "a").distinct())
