"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification. DataFrame operations only.

A window is as many consecutive words of a document as a benchmark item has. Its weighted-shingle similarity to the item is
sum min / sum max over the counts of 5-word shingles (lower-cased words). Only windows that can reach the threshold are fingerprinted, which
loses nothing: a window of w shingles and an item of m share at least similarity * (w + m) / (1 + similarity) of them, so it holds as many
positions whose shingle some item of its size has; and a best window starts at such a position (or is the document's last one), as moving its start
on to the next such position drops no shared shingle.

A fingerprint is a row of blocks, one for each class of shingles (classes by hash), and a block is the SimHash of the shingles of its class. A window at the similarity
differs from its item in at most `radius` shingles, counted with their repeats, so it differs in at most that many blocks; there is one block more than that. So
every pair within the radius agrees on a block, without exception, and an equi-join on (size, block, bits) finds it; a block stands for about four shingles, so
unlike pairs seldom do. Candidates are then verified exactly. `distance` is the Hamming distance of the 64-bit SimHashes of the whole window and item.

Defined cases: null and empty texts and items match nothing; items below five words are one shingle and match only whole documents
of the same words; a document shorter than an item is one window, compared by its own shingles; equal rows give equal rows; repeated items are fingerprinted once and
reported each; empty tables give an empty result; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as shared
from .common import bounded, cut, row_key, words_of

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Bits of one row of a bitmap of shingles, and the most rows of it.
ROW_BITS, BITMAP_ROWS = 32_768, 2_048


def shingle_hashes(words: str, width: int = SHINGLE_WORDS) -> Column:
    """Hashes of the shingles of the array column `words`; a shorter text is one shingle; none of no words."""
    parts = ", ".join(["x", *(f"get({words}, i + {k})" for k in range(1, width))])
    return F.expr(
        f"CASE WHEN size({words}) >= {width} THEN transform(slice({words}, 1, size({words}) - {width - 1}), (x, i) -> xxhash64({parts}))"
        f" WHEN size({words}) > 0 THEN array(xxhash64(concat('short ', array_join({words}, ' ')))) ELSE cast(array() AS array<bigint>) END"
    )


def simhash(hashes: str) -> str:
    """SQL of a 64-bit fingerprint: a bit is 1 if it is set in over half of the hashes, repeats included."""
    return (
        f"aggregate(sequence(0, 63), 0L, (f, b) -> f | CASE WHEN 2 * aggregate({hashes}, 0L, (n, h) -> n + (shiftrightunsigned(h, b) & 1L)) > size({hashes})"
        " THEN shiftleft(1L, b) ELSE 0L END)"
    )


def n_blocks(m: str, similarity: float) -> str:
    """SQL of the radius and one: a window and an item of at most `m` shingles at the similarity differ in at most 2 m (1 - s) / (1 + s) of them."""
    return f"cast(floor({2 * (1 - similarity) / (1 + similarity)} * {m} + 1e-9) AS int) + 1"


def blocks(hashes: str, m: str, similarity: float) -> Column:
    """(block, bits) of a row with `hashes`: the SimHash of each class of shingles."""
    of_class = f"filter({hashes}, h -> pmod(h, {n_blocks(m, similarity)}) = c)"
    return F.expr(f"transform(sequence(0, {n_blocks(m, similarity)} - 1), c -> named_struct('block', c, 'bits', transform(array({of_class}), p -> {simhash('p')})[0]))")


def common(a: str, b: str) -> str:
    """SQL of the size of the multiset intersection of two sorted arrays of longs: equal values are numbered first."""
    numbered = lambda x: f"transform({x}, (v, i) -> named_struct('v', v, 'k', i - array_position({x}, v)))"
    return f"size(array_intersect({numbered(a)}, {numbered(b)}))"


def window_starts(n: str, m: str, at: str, similarity: float) -> Column:
    """Starts of the windows that can reach the similarity, from `at`, the sorted positions of shingles that an item of `m` shingles has.

    `n`: shingles of the document. Positions too near to its end stand for its last window, a document shorter than the item is one window.
    """
    need = f"cast(ceil({similarity} * (least({n}, {m}) + {m}) / {1 + similarity} - 1e-9) as int)"
    inside = f"CASE WHEN get({at}, i + {need} - 1) < x + {m} THEN x END"
    last = f"CASE WHEN get({at}, size({at}) - {need}) >= {n} - {m} THEN greatest(0, {n} - {m}) END"
    return F.expr(f"array_distinct(filter(transform({at}, (x, i) -> CASE WHEN x <= {n} - {m} THEN {inside} ELSE {last} END), s -> s IS NOT NULL))")


def may_hold(exploded: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The rows whose `h` may be among `n` wanted ones, by a bitmap that is sent to all tasks: beyond the broadcast bound it keeps most shingles from the exchange."""
    rows = min(BITMAP_ROWS, 1 + 8 * n // ROW_BITS)
    place = F.pmod(F.xxhash64("h"), F.lit(rows * ROW_BITS))
    marked = wanted.select(F.floor(place / ROW_BITS).alias("row"), (place % ROW_BITS).alias("bit"))
    bitmap = marked.groupBy("row").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))  # at most BITMAP_ROWS rows of 4 KB
    asked = exploded.withColumn("row", F.floor(place / ROW_BITS)).withColumn("bit", place % ROW_BITS).join(F.broadcast(bitmap), "row")
    byte = F.conv(F.hex(F.expr("substring(bitmap, cast(bit div 8 AS int) + 1, 1)")), 16, 10).cast("int")
    return asked.where(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1).drop("row", "bit", "bitmap")


def candidates(windows: DataFrame, items: DataFrame, similarity: float, n_items: int) -> DataFrame:
    """(key, m, s, iid): windows and items of one size that agree on a block."""
    left = windows.select("__k1", "__k2", "m", "s", F.explode(blocks("wh", "m", similarity)).alias("x")).select("__k1", "__k2", "m", "s", "x.*")
    right = items.select("iid", "m", F.explode(blocks("ih", "m", similarity)).alias("x")).select("iid", "m", "x.*")
    return left.join(bounded(right, n_items), ["m", "block", "bits"]).select("__k1", "__k2", "m", "s", "iid").distinct()


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, keys: bool = False) -> DataFrame:
    """(doc_id, item_id, similarity, distance, start_word, n_windows) of each document that holds a benchmark item; with `keys` also the row's key."""
    items = benchmark.select("item_id", words_of(F.lower("text")).alias("w")).where("size(w) > 0").select("item_id", F.sort_array(shingle_hashes("w")).alias("ih"))
    items = cut(items.select("item_id", "ih", F.size("ih").alias("m"), F.xxhash64("ih").alias("iid")))
    # Repeated items are one for the search.
    single = cut(items.groupBy("iid", "m").agg(F.first("ih").alias("ih")))
    # Rows, blocks and shingles of the benchmark's side, counted before it is sent anywhere.
    total = single.agg(F.coalesce(F.sum(F.expr(n_blocks("m", similarity))), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
    entries = cut(single.select("m", F.explode("ih").alias("h")).distinct())
    n_entries = entries.count()
    wanted = entries.select("h").distinct()

    read = docs.select("doc_id", "text", *row_key(F.col("doc_id"), F.col("text")))
    hashed = read.select("__k1", "__k2", words_of(F.lower("text")).alias("w")).select("__k1", "__k2", shingle_hashes("w").alias("h"))
    # The outer form: the inner one makes Spark filter by the size of the array first, and so hash every text twice.
    exploded = hashed.select("__k1", "__k2", F.size("h").alias("n"), F.posexplode_outer("h").alias("p", "h"))
    if n_entries > shared.BROADCAST_ROWS:
        exploded = may_hold(exploded, wanted, n_entries)
    hits = exploded.join(bounded(wanted, n_entries), "h", "left_semi")
    met = hits.join(bounded(entries, n_entries), "h").groupBy("__k1", "__k2", "n", "m").agg(F.sort_array(F.collect_set("p")).alias("p"))
    starts = met.select("__k1", "__k2", "m", window_starts("n", "m", "p", similarity).alias("s")).where("size(s) > 0")
    proposed = cut(starts.groupBy("__k1", "__k2").agg(F.collect_list(F.struct("m", "s")).alias("at")))
    n_docs = proposed.count()

    met = read.join(bounded(proposed, n_docs), ["__k1", "__k2"]).select("doc_id", "__k1", "__k2", "at", words_of(F.lower("text")).alias("w"))
    met = met.select("doc_id", "__k1", "__k2", "at", shingle_hashes("w").alias("h")).select("doc_id", "__k1", "__k2", "h", F.explode("at").alias("a"))
    met = met.select("__k1", "__k2", "doc_id", "h", F.col("a.m").alias("m"), F.explode("a.s").alias("s"))
    windows = cut(met.select("doc_id", "__k1", "__k2", "m", "s", F.sort_array(F.slice("h", F.col("s") + 1, F.col("m"))).alias("wh")))

    near = candidates(windows, single, similarity, int(total[0]))
    pairs = near.join(windows, ["__k1", "__k2", "m", "s"]).join(bounded(single.select("iid", "ih"), int(total[1])), "iid")
    pairs = pairs.withColumn("both", F.expr(common("wh", "ih"))).withColumn("similarity", F.col("both") / (F.size("wh") + F.size("ih") - F.col("both")))
    pairs = pairs.where(F.col("similarity") >= similarity - 1e-12)
    best = pairs.groupBy("__k1", "__k2", "doc_id", "iid").agg(
        F.max_by(F.struct("similarity", F.col("s").alias("start_word"), "wh", "ih"), F.struct(F.col("similarity"), -F.col("s"))).alias("b"), F.countDistinct("s").alias("n_windows")
    )
    distance = F.expr(f"bit_count(({simhash('wh')}) ^ ({simhash('ih')}))")
    best = best.select("__k1", "__k2", "doc_id", "iid", "b.*", "n_windows").withColumn("distance", distance)
    named = best.join(bounded(items.select("iid", "item_id"), items.count()), "iid")
    return named.select(*(["__k1", "__k2"] if keys else []), "doc_id", "item_id", "similarity", "distance", "start_word", "n_windows")


def drop_leaking(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark item, with their own columns."""
    found = cut(find_leaks(docs, benchmark, keys=True, **options).select(F.col("__k1").alias("__a"), F.col("__k2").alias("__b")).distinct())
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    names = docs.columns
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], k1.alias("__x"), k2.alias("__y"))
    return keyed.join(bounded(found, found.count()), (F.col("__x") == F.col("__a")) & (F.col("__y") == F.col("__b")), "left_anti").select(*[F.col(f"`{c}`") for c in names])
