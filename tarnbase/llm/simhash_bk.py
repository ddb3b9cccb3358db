"""SimHash near-duplicates with BK-trees over shards of the fingerprints.

1. Fingerprints: Arrow batches; the 64 bit counts of a text come from byte histograms of its shingle hashes.
2. Equal fingerprints are merged first, so copies cost one row.
3. Shards: fingerprints within r differing bits agree on at least k of k + r disjoint blocks of bits. A shard is the set of
   fingerprints with the same bits in one choice of k blocks; k follows from their number. Shards that are counted above `SHARD_ROWS` all the same are
   dealt again by blocks of their remaining bits (the same argument holds inside a shard), and those that no bits part in pairs of chunks.
4. Each shard's BK-tree (children keyed by Hamming distance to the parent) is built and asked in one pass by the task
   that holds the shard; only edges within the radius are followed. A tree sent to all executors would have to meet every
   fingerprint, which is a cross join; a dealt shard meets only those that can match. A shard returns at most one edge per row.
5. Components of these edges, by stars, on executors.

Defined cases: null and empty texts have fingerprint 0 and are linked like any other; rows with equal doc_id
are one document as far as components are named; a null doc_id never names a component (null if there is no other); an empty table
gives an empty table; other columns may have any name (they are not read).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

SHINGLE_WORDS = 4
RADIUS = 4
HASH_SEED = 42
SHARD_ROWS = 4096
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_ROWS = np.arange(8, dtype=np.int64) * 256


def shingle_hashes(text: str | None, width: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> np.ndarray:
    """Unsigned hashes of all shingles of the whole text, repeats included; a text below `width` words is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, "<u8")
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return np.array([digest(joined, seed)], "<u8")
    starts = [0, *(e + 1 for e in ends)]
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :])], dtype="<u8")


def fingerprint_of(hashes: np.ndarray) -> int:
    """64 bits, unsigned: a bit is 1 if it is set in over half of the hashes."""
    if len(hashes) < 2:
        return int(hashes[0]) if len(hashes) else 0
    spread = hashes.view(np.uint8).reshape(-1, 8).astype(np.int64) + _ROWS
    counts = np.bincount(spread.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * counts.ravel() > len(hashes), bitorder="little").tobytes(), "little")


def simhash(text: str | None, width: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> int:
    """64-bit fingerprint of the whole text, unsigned."""
    return fingerprint_of(shingle_hashes(text, width, seed))


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((simhash(t.as_py(), width) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(free: list[int], chosen: int, radius: int) -> list[int]:
    """Bit masks of `chosen` of `chosen + radius` disjoint blocks of the free bits, one for each choice, as signed longs."""
    n = chosen + radius
    cuts = [len(free) * i // n for i in range(n + 1)]
    block = [sum(1 << b for b in free[cuts[i] : cuts[i + 1]]) for i in range(n)]
    return [sum(block[i] for i in c) for c in combinations(range(n), chosen)]


def depth_for(n: int, radius: int, most: int) -> int:
    """Blocks that a shard fixes, so that n evenly spread fingerprints make shards below `most / 4`: the fewest, as each more costs copies."""
    chosen = 1
    while chosen < 4 and n > (most / 4) * 2 ** (64 * chosen // (chosen + radius)):
        chosen += 1
    return chosen


def shards(distinct: DataFrame, radius: int = RADIUS, most: int = SHARD_ROWS) -> DataFrame:
    """(shard, fp): each two fingerprints within `radius` bits share a shard; `distinct` has each fp once.

    Fingerprints that differ in at most `radius` bits agree on `k` of `k + radius` blocks; a shard is one choice of blocks and their bits.
    `k` follows from the count (1: 5 copies of a fingerprint, 2: 15). Shards above `most`, counted, are dealt once more by the bits that they leave free. What
    is still above it is a cluster that bits don't part: its rows are dealt to g chunks, and a shard is two chunks, so each two rows still meet.
    """
    spark = distinct.sparkSession
    first = _masks(list(range(64)), depth_for(distinct.count(), radius, most), radius)
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("path"), F.lit(m).alias("mask")) for i, m in enumerate(map(_signed, first))])).alias("p")
    out = distinct.select("fp", parts).select("fp", F.col("p.mask").alias("mask"), F.xxhash64("p.path", F.col("fp").bitwiseAND(F.col("p.mask"))).alias("shard"))
    count = F.count(F.lit(1)).alias("n")
    counted = cut(out.groupBy("shard").agg(count).where(F.col("n") > most).select("shard", "n"))
    if counted.isEmpty():
        return out.select("shard", "fp")

    def marked(rows: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
        met = cut(rows.join(hot, "shard", "left"))
        return met.where("n IS NULL").select("shard", "fp"), met.where("n IS NOT NULL")

    small, hot = marked(out, counted)
    table = [(_signed(m), i, _signed(x)) for m in first for i, x in enumerate(_masks([b for b in range(64) if not m >> b & 1], 1, radius))]
    again = spark.createDataFrame(table, "mask bigint, path int, more bigint")
    dealt = hot.join(F.broadcast(again), "mask").select("fp", F.xxhash64("shard", "path", F.col("fp").bitwiseAND(F.col("more"))).alias("shard"))  # radius + 1 rows for each choice of blocks
    counted = cut(dealt.groupBy("shard").agg(count).where(F.col("n") > most).select("shard", "n"))
    if counted.isEmpty():
        return small.union(dealt.select("shard", "fp"))
    less, hot = marked(dealt, counted)
    # Dealt over all tasks first: a row becomes as many as its shard has chunks.
    chunks = F.ceil(2 * F.col("n") / F.lit(most)).cast("int")
    paired = hot.select("shard", "fp", F.pmod(F.xxhash64("fp"), chunks).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("d"))
    paired = paired.select(F.xxhash64("shard", F.least("c", "d"), F.greatest("c", "d")).alias("shard"), "fp")
    return small.union(less).union(paired)


def link_shard(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, least value of its component) inside one shard, for values that aren't the least."""
    nodes, children, parent = [values[0]], [{}], [0]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(1, len(values)):
        x, stack, home = values[i], [0], i
        parent.append(i)
        while stack:
            j = stack.pop()
            d = (x ^ nodes[j]).bit_count()
            if d <= radius:
                r = root(j)
                home, other = (r, home) if values[r] < values[home] else (home, r)
                parent[other] = home
            for edge, child in children[j].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)
        nodes.append(x)
        children.append({})
        j = 0
        while (child := children[j].get(d := (x ^ nodes[j]).bit_count())) is not None:
            j = child
        children[j][d] = i
    return [(values[i], values[r]) for i in range(len(values)) if (r := root(i)) != i]


def shard_links(sharded: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b), at most one per row of a shard. Rows of a shard arrive together and sorted, across batch ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest_key, rest = None, []
        mask = (1 << 64) - 1

        def linked(groups: list[list[int]]) -> pd.DataFrame:
            found = [e for g in groups for e in link_shard(sorted({v & mask for v in g}), radius)]
            signed = [(_signed(x), _signed(y)) for x, y in found]
            return pd.DataFrame(signed, columns=["a", "b"], dtype="int64")

        for frame in batches:
            key, fp = frame["shard"].to_numpy(), frame["fp"].to_numpy()
            if not len(key):
                continue
            ends = np.flatnonzero(np.r_[key[1:] != key[:-1], True]) + 1
            begin, ready = 0, []
            for end in ends:
                if key[begin] == rest_key:
                    rest.extend(fp[begin:end].tolist())
                else:
                    if len(rest) > 1:
                        ready.append(rest)
                    rest_key, rest = key[begin], fp[begin:end].tolist() if end - begin > 1 or end == len(key) else []
                begin = end
            if ready:
                yield linked(ready)
        if len(rest) > 1:
            yield linked([rest])

    held = sharded.repartition("shard").sortWithinPartitions("shard", "fp")
    return held.mapInPandas(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    held = cut(fingerprints(docs, width))
    distinct = cut(held.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = shard_links(shards(distinct.select("fp"), radius), radius)
    roots = components(edges)
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Cut before the join, so that adaptive execution may split the rows of a root that very many fingerprints have.
    of_root = cut(named.groupBy("root").agg(F.min("least").alias("component_id")))
    by_fp = cut(named.join(of_root, "root").select("fp", "component_id"))
    return held.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
