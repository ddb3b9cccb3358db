"""Near-duplicates of the pipeline: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, without loss.

1. SimHash and BK-trees (`simhash_bk`, over these shingles) propose, for each set, one centre of the sets that its fingerprint reaches within 4 bits.
   That finds close copies cheaply, but a pair at 0.8 differs by 9.6 of 64 bits on average, where no tree or block prunes. So the rest is found by
2. prefixes: take any one order of all shingles, and of a set of n its first n - ceil(s n) + k. The set whose prefix ends first shares with the other's prefix all that
   it shares before that end, so two sets of similarity s share at least `required` shingles of their prefixes. Shingles that a sample of the documents
   shows to be common come last in the order, so they are seldom in a prefix. The sample decides the work, not the result. Prefixes travel in binary blocks
   (five bytes a shingle), and only shingles that two sets have become rows.
3. Hubs: each set is held against one other, the one with the most shared shingles among those it shares most of its prefix with. At last come all pairs of components
   whose members share enough of their prefixes: a component counts once for a shingle, so a group of k copies doesn't make k * k pairs.
4. All candidates are verified by their whole sets: texts travel to the sets they are held against, in shares of `SHARE` rows.
   Components of the verified pairs, by stars, on executors.

Equal sets are one node. Defined cases: words are lower-cased (ASCII); null and texts without words are equal; a text below five words is one shingle; shingles are
compared by 64-bit hashes; rows are told apart by doc_id and text, so repeated and null doc_ids are rows like any other; an empty table gives an
empty table; other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, arrow_batches, bounded, cut, row_key
from .components import components
from .simhash_bk import RADIUS, fingerprint_of, shard_links, shards, shingle_hashes

SHINGLE_WORDS = 5
SIMILARITY = 0.8
HASH_SEED = 42
# What the order of the shingles is taken from: documents of the sample, and how many common shingles are told apart.
SAMPLE_DOCS, SAMPLE_SHARE, COMMON_LEAST, COMMON_MOST = 2_000, 0.1, 2, 500_000
#: Shingles that two prefixes must share (k above).
SHARED = 8
#: Rows of one centre that one group verifies; shingles of one class of prefix blocks.
SHARE, CLASS_SHINGLES = 64, 4_000_000
#: Shingles of a component up to which they are ordered.
ORDERED = 4_096
#: Rows of an Arrow batch; a row has a whole text.
TEXT_ROWS = 1_000
_LOW = (1 << 40) - 1


def shingle_set(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    return np.unique(shingle_hashes(text, width, HASH_SEED).view(np.int64))


def _sets(keyed: DataFrame, width: int) -> DataFrame:
    """(h): the shingles of the sets of the rows, as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t.as_py(), width) for t in b.column(0)]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *found])))], names=["h"])

    return keyed.select("text").mapInArrow(run, "h array<bigint>")


def common_shingles(keyed: DataFrame, width: int) -> list[tuple[int, int]]:
    """(hash, documents) of common shingles of a sample of the rows (__k1, text): the same rows whatever their order."""
    n = keyed.count()
    share = max(SAMPLE_SHARE, min(1.0, SAMPLE_DOCS / max(1, n)))
    sample = keyed.where(F.pmod("__k1", F.lit(1_000_000)) < int(share * 1_000_000))
    count = _sets(sample, width).select(F.explode("h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON_LEAST)
    return [tuple(r) for r in count.orderBy(F.desc("n"), "h").limit(COMMON_MOST).collect()]


def nodes_of(keyed: DataFrame, width: int) -> DataFrame:
    """(__k1, __k2, node, n, fp) of each row: the set's own hash, its size and its SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sizes, prints = [], [], []
            for t in b.column(2):
                h = shingle_set(t.as_py(), width)
                nodes.append(xxhash.xxh64_intdigest(h.tobytes(), HASH_SEED))
                sizes.append(len(h))
                prints.append(fingerprint_of(h.view(np.uint64)))
            signed = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (nodes, prints)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), signed[0], pa.array(sizes, pa.int64()), signed[1]], names=["__k1", "__k2", "node", "n", "fp"])

    return keyed.select("__k1", "__k2", "text").mapInArrow(run, "__k1 bigint, __k2 bigint, node bigint, n bigint, fp bigint")


def needed(n: int, similarity: float) -> int:
    return math.ceil(similarity * n - 1e-9)


def packed(nodes: np.ndarray, hashes: np.ndarray) -> bytes:
    """A block of (node, shingle) in order of nodes: each node once with its count, the low 40 bits of each shingle."""
    at = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]])
    counts = np.diff(np.r_[at, len(nodes)]).astype("<u4")
    low = (hashes & _LOW).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :5]
    return np.array([len(at), len(nodes)], "<u4").tobytes() + nodes[at].astype("<i8").tobytes() + counts.tobytes() + low.tobytes()


def unpacked(block: bytes, class_: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, shingles) of a block; a shingle is its class and its low 40 bits."""
    k, n = np.frombuffer(block, "<u4", 2)
    nodes, counts = np.frombuffer(block, "<i8", k, 8), np.frombuffer(block, "<u4", k, 8 + 8 * int(k))
    low = np.zeros((n, 8), np.uint8)
    low[:, :5] = np.frombuffer(block, np.uint8, 5 * int(n), 8 + 12 * int(k)).reshape(-1, 5)
    return np.repeat(nodes, counts), low.view("<i8").ravel() | (class_ << 40)


def shared_shingles(texts: DataFrame, common: list[tuple[int, int]], similarity: float, width: int, n_shingles: int) -> DataFrame:
    """(h, node): the shingles that the prefixes of two nodes or more have; `texts` has a row (__k1, text) of each node."""
    by_hash = sorted(common)
    hashes, counts = np.array([h for h, _ in by_hash], dtype=np.int64), np.array([n for _, n in by_hash], dtype=np.int64)
    classes = max(16, -(-n_shingles // CLASS_SHINGLES))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            firsts, nodes = [], []
            for t in b.column(0):
                h = shingle_set(t.as_py(), width)
                nodes.append(xxhash.xxh64_intdigest(h.tobytes(), HASH_SEED))
                if len(hashes) and len(h):
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    h = h[np.argsort(np.where(hashes[at] == h, counts[at], 0), kind="stable")]
                firsts.append(h[: len(h) - needed(len(h), similarity) + SHARED].copy())  # not a view that holds the whole set
            flat = np.concatenate([np.empty(0, np.int64), *firsts])
            own = np.repeat(np.array(nodes, np.uint64).view(np.int64), [len(f) for f in firsts])
            class_ = (flat >> 40) % classes
            order = np.argsort(class_, kind="stable")
            ends = np.flatnonzero(np.r_[np.diff(class_[order]) != 0, True]) + 1 if len(flat) else []
            out, begin = [], 0
            for end in ends:
                pick = order[begin:end]
                out.append((int(class_[pick[0]]), packed(own[pick], flat[pick])))
                begin = end
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["class", "block"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for class_, block in zip(b.column(0).to_pylist(), b.column(1)):
                node, h = unpacked(block.as_py(), class_)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(node)], names=["h", "node"])

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None  # the shingle before, and its node if that wasn't given out
        for b in batches:
            h, node = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(h):
                continue
            same = h[1:] == h[:-1]
            keep = np.r_[False, same] | np.r_[same, False]
            first_h, first_node = [], []
            if last == h[0]:
                keep[0] = True
                if held is not None:
                    first_h, first_node = [last], [held]
            last, held = int(h[-1]), None if keep[-1] else int(node[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.array(first_h, np.int64), h[keep]]), pa.array(np.r_[np.array(first_node, np.int64), node[keep]])], names=["h", "node"])

    # Sorted by Spark, which spills; a task holds one batch.
    spread = texts.select("text").mapInArrow(blocks, "class bigint, block binary").repartition(classes, "class").mapInArrow(rows, "h bigint, node bigint")
    return spread.sortWithinPartitions("h").mapInArrow(twice, "h bigint, node bigint")


def _verified(pairs: DataFrame, keyed: DataFrame, held: DataFrame, similarity: float, width: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar enough."""
    # Texts travel, not sets: they are smaller. The text of `a` comes first in each share of its partners.
    pairs = cut(pairs.select("a", "b").distinct())
    size = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARE)).alias("shares"))
    n = pairs.count()
    dealt = pairs.join(size, "a").select("a", F.pmod(F.xxhash64("b"), "shares").alias("share"), F.col("b").alias("node"))
    asked = cut(dealt.union(dealt.select("a", "share", "a").distinct()))
    # One row key stands for a node: all its rows have the same set.
    chosen = held.join(bounded(asked.select("node").distinct(), 2 * n), "node", "left_semi").groupBy("node").agg(F.min(F.struct("__k1", "__k2")).alias("k"))
    wanted = cut(asked.join(chosen, "node").select("a", "share", "node", "k.*"))
    texts = keyed.join(bounded(wanted, 2 * n), ["__k1", "__k2"]).select("a", "share", (F.col("node") != F.col("a")).alias("other"), "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last, centre = None, None, None
        for b in batches:
            near = []
            for a, share, node, t in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), b.column(4)):
                # Repeated rows of a node come next to each other.
                if (a, share, node) == last:
                    continue
                last = a, share, node
                h = shingle_set(t.as_py(), width)
                if (a, share) != group:
                    group, centre = (a, share), h
                    continue
                both = len(np.intersect1d(centre, h, assume_unique=True))
                if both >= similarity * (len(centre) + len(h) - both) - 1e-9:
                    near.append((a, node))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in near], pa.int64()), pa.array([y for _, y in near], pa.int64())], names=["a", "b"])

    return cut(texts.repartition("a", "share").sortWithinPartitions("a", "share", "other", "node").mapInArrow(run, "a bigint, b bigint"))


def simhash_candidates(nodes: DataFrame) -> DataFrame:
    """(a, b): each node and the least node of those that its fingerprint reaches within `RADIUS` bits."""
    roots = components(shard_links(shards(nodes.select("fp").distinct(), RADIUS), RADIUS), alone=BROADCAST_ROWS)
    roots = cut(roots.select(F.col("node").alias("fp"), F.col("root").alias("r")))
    named = nodes.select("node", "fp").join(bounded(roots, roots.count()), "fp", "left").select("node", F.coalesce("r", "fp").alias("r"))
    centres = cut(named.groupBy("r").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("r", "a"))
    return named.join(bounded(centres, centres.count()), "r").where("a <> node").select("a", F.col("node").alias("b"))


def required(n: str, m: str, similarity: float) -> Column:
    """Shingles that the prefixes of similar sets of n and m share."""
    need = F.ceil(similarity * F.greatest(n, m) - 1e-9)
    return F.ceil(similarity / (1 + similarity) * (F.col(n) + F.col(m)) - 1e-9) + F.least(F.lit(0), F.lit(SHARED) - need)


def _sizes(n: str, m: str, similarity: float) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return (F.col(n) * similarity <= F.col(m) + 1e-9) & (F.col(m) * similarity <= F.col(n) + 1e-9)


def _open(shared: DataFrame, info: DataFrame, links: DataFrame) -> DataFrame:
    """(h, node, n, weight, root): the shingles that nodes of different components share."""
    roots = cut(components(links, alone=BROADCAST_ROWS))
    known = cut(info.join(bounded(roots, roots.count()), "node", "left").select("node", "n", "weight", F.coalesce("root", "node").alias("root")))
    named = shared.join(bounded(known, known.count()), "node")
    same = Window.partitionBy("h")
    return cut(named.select("*", F.min("root").over(same).alias("u"), F.max("root").over(same).alias("v")).where("u < v").select("h", "node", "n", "weight", "root"))


def hub_candidates(open_: DataFrame, similarity: float) -> DataFrame:
    """(a, b): each node and the hub of another component that it shares most of its prefix with. The hub of a shingle is the node with most shared shingles."""
    same = Window.partitionBy("h")
    hub = F.max(F.struct(F.col("weight").alias("w"), F.col("node").alias("hub"), F.col("n").alias("m"), F.col("root").alias("r"))).over(same)
    met = open_.select("node", "n", "root", hub.alias("x")).select("node", "n", "root", "x.*").where(F.expr("r <> root") & _sizes("n", "m", similarity)).groupBy("node", "hub", "n", "m").agg(F.count(F.lit(1)).alias("c"))
    met = met.where(F.col("c") >= required("n", "m", similarity))
    return met.groupBy("node").agg(F.max_by("hub", F.struct("c", "hub")).alias("a")).select("a", F.col("node").alias("b"))


def _least_required(lo: Column, hi: Column, similarity: float) -> Column:
    """The least that `required` is for sizes from lo to hi."""
    least = F.least(F.lit(SHARED), F.ceil(similarity * lo - 1e-9))
    wide = F.when(lo * similarity >= SHARED, F.floor(similarity / (1 + similarity) * (lo + hi)) + SHARED - F.ceil(similarity * hi) - 1).otherwise(0)
    return F.greatest(least, wide)


def root_candidates(open_: DataFrame, similarity: float) -> DataFrame:
    """(x, y): pairs of components of which some members may be similar, by the shingles that the prefixes of all their members have.

    A component has a row for each shingle, however many members it has. Its shingles are ordered by the number of components that have them, and `rest` counts those
    behind one: of the shingles that a pair shares the first has enough behind it on both sides, so only shingles that do need to meet.
    """
    held = open_.groupBy("h", "root").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    many = held.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    held = cut(held.join(many, "h"))
    size = held.groupBy("root").agg(F.count(F.lit(1)).alias("all"))
    held = held.join(size, "root")
    # Of a component with very many shingles the order isn't taken: all of them may have enough behind them.
    few = held.where(F.col("all") <= ORDERED).withColumn("rest", F.col("all") - F.row_number().over(Window.partitionBy("root").orderBy("df", "h")))
    ranked = few.unionByName(held.where(F.col("all") > ORDERED).withColumn("rest", F.col("all")))
    x, y = (ranked.select("h", *[F.col(c).alias(f"{side}_{c}") for c in ("root", "lo", "hi", "rest")]) for side in "xy")
    sizes = (F.col("x_lo") * similarity <= F.col("y_hi") + 1e-9) & (F.col("y_lo") * similarity <= F.col("x_hi") + 1e-9)
    enough = F.least("x_rest", "y_rest") + 1 >= _least_required(F.least("x_lo", "y_lo"), F.greatest("x_hi", "y_hi"), similarity)
    return x.join(y, "h").where((F.col("x_root") < F.col("y_root")) & sizes & enough).select(F.col("x_root").alias("x"), F.col("y_root").alias("y")).distinct()


def _verified_roots(pairs: DataFrame, open_: DataFrame, keyed: DataFrame, nodes: DataFrame, similarity: float, width: int) -> DataFrame:
    """Links (a, b) between members of the given components: the larger one's members in shares, against shares of the members of all its partners."""
    members = open_.select("root", "node").distinct()
    size = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    pairs = cut(pairs)
    n_pairs = pairs.count()
    size = cut(size.join(bounded(pairs.select(F.explode(F.array("x", "y")).alias("root")).distinct(), 2 * n_pairs), "root"))
    members = cut(members.join(bounded(size, 2 * n_pairs), "root"))
    sized = pairs.join(bounded(size.toDF("x", "nx"), 2 * n_pairs), "x").join(bounded(size.toDF("y", "ny"), 2 * n_pairs), "y")
    turn = F.col("nx") < F.col("ny")
    sized = cut(sized.select(F.when(turn, F.col("y")).otherwise(F.col("x")).alias("base"), F.when(turn, F.col("x")).otherwise(F.col("y")).alias("root")))
    asked = sized.join(members.select("root", "node"), "root").select("base", "node")
    shares = asked.groupBy("base").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARE)).alias("asking"))
    bases = cut(shares.join(size.select(F.col("root").alias("base"), F.ceil(F.col("n") / F.lit(SHARE)).alias("based")), "base"))
    own = lambda count: F.pmod(F.xxhash64("node"), count)
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    of_base = members.select(F.col("root").alias("base"), "node").join(bounded(bases, n_pairs), "base").select("base", own(F.col("based")).alias("i"), every("asking").alias("j"), F.lit(False).alias("asks"), "node")
    of_query = asked.join(bounded(bases, n_pairs), "base").select("base", every("based").alias("i"), own(F.col("asking")).alias("j"), F.lit(True).alias("asks"), "node")
    wanted = cut(of_base.union(of_query).join(nodes.select("node", "k.*"), "node"))
    texts = keyed.join(bounded(wanted, wanted.count()), ["__k1", "__k2"]).select("base", "i", "j", "asks", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last, held = None, None, []
        for b in batches:
            near = []
            for *key, asks, node, t in zip(*(b.column(i).to_pylist() for i in range(5)), b.column(5)):
                if key != group:
                    group, last, held = key, None, []
                # Repeated rows of a node come next to each other.
                if (asks, node) == last:
                    continue
                last = asks, node
                h = shingle_set(t.as_py(), width)
                if not asks:
                    held.append((node, h))
                    continue
                for other, x in held:
                    if min(len(x), len(h)) < similarity * max(len(x), len(h)) - 1e-9:
                        continue
                    both = len(np.intersect1d(x, h, assume_unique=True))
                    if both >= similarity * (len(x) + len(h) - both) - 1e-9:
                        # The base is one component: a link to any member will do.
                        near.append((other, node))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in near], pa.int64()), pa.array([y for _, y in near], pa.int64())], names=["a", "b"])

    return cut(texts.repartition("base", "i", "j").sortWithinPartitions("base", "i", "j", "asks", "node").mapInArrow(run, "a bigint, b bigint"))


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE_WORDS) -> DataFrame:
    """(__k1, __k2, root) of every row: rows of one root are linked by pairs of the similarity or more."""
    # Whatever runs Python is cut in there; the result is a join of what was cut.
    with arrow_batches(docs.sparkSession, TEXT_ROWS):
        return _near_copies(docs, similarity, width)


def _near_copies(docs: DataFrame, similarity: float, width: int) -> DataFrame:
    keyed = docs.select("text", *row_key(F.col("doc_id"), F.col("text")))
    held = cut(nodes_of(keyed, width))
    nodes = cut(held.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.min(F.struct("__k1", "__k2")).alias("k"), F.count(F.lit(1)).alias("rows")))
    links = _verified(simhash_candidates(nodes), keyed, held, similarity, width)

    # One row of each node; repeated rows of one key are one node, and their shingles are counted once below.
    copies = cut(held.join(nodes.where("rows > 1").select("node", "k"), "node").where((F.col("__k1") != F.col("k.__k1")) | (F.col("__k2") != F.col("k.__k2"))).select("__k1", "__k2").distinct())
    single = keyed.join(bounded(copies, copies.count()), ["__k1", "__k2"], "left_anti")
    total = nodes.agg(F.sum(F.col("n") * (1 - similarity) + SHARED + 1)).first()[0] or 0
    shared = cut(shared_shingles(single, common_shingles(keyed, width), similarity, width, int(total)).distinct())
    info = shared.groupBy("node").agg(F.count(F.lit(1)).alias("weight")).join(nodes.select("node", "n"), "node")
    open_ = _open(shared, cut(info), links)
    more = _verified(hub_candidates(open_, similarity), keyed, held, similarity, width)
    if not more.isEmpty():
        links = links.union(more)
        open_ = _open(open_.select("h", "node"), info, links)
    last = _verified_roots(root_candidates(open_, similarity), open_, keyed, nodes, similarity, width)

    roots = cut(components(links.union(last), alone=BROADCAST_ROWS))
    return held.join(bounded(roots, roots.count()), "node", "left").select("__k1", "__k2", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each group: the one with the smallest doc_id (one without doc_id only if there is no other), then the smallest text hash."""
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    names = docs.columns
    found = near_copies(docs, **options)
    ids = docs.select(k1, k2, "doc_id").groupBy("__k1", "__k2").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"))
    roots = found.groupBy("__k1", "__k2").agg(F.min("root").alias("root"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__k1", "__k2")
    best = ids.join(roots, ["__k1", "__k2"]).groupBy("root").agg(F.min_by(F.struct("__k1", "__k2", "rows"), order).alias("b"))
    best = cut(best.select(F.col("b.__k1").alias("__a"), F.col("b.__k2").alias("__b"), F.col("b.rows").alias("__n")))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), k1.alias("__x"), k2.alias("__y"))
    met = keyed.join(bounded(best, best.count()), (F.col("__x") == F.col("__a")) & (F.col("__y") == F.col("__b")))
    # Only rows that are equal in doc_id and text are grouped; of these the least in all columns stays.
    several = met.where("__n > 1").groupBy("__x", "__y").agg(F.min("__row").alias("__row"))
    kept = met.where("__n = 1").select("__row").unionByName(several.select("__row"))
    return kept.select(*[F.col("__row").getField(c).alias(c) for c in names])
