"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Of all mixes that take `target` words of each source and at most `MOST` times any document, entropy balancing picks the one nearest to the corpus in
word-weighted relative entropy, sum size * (r ln r - r + 1), that also keeps the corpus's length profile: the word-weighted means of the standardised log
size and of its square. The constraints of the sources are exact, the two of the profile, which all sources share, are held softly (a ridge of
`RIDGE` on their multipliers), so there is always a solution. The dual is convex:

    D(l, u) = sum size * f(l_source + u . x) - sum l_s target_s + RIDGE / 2 * words * |u|^2,    f' = min(MOST, exp)

and the rates are exponential tilts, min(MOST, exp(l_source + u . x)). Each Newton step takes its gradient and Hessian from one Spark aggregate over the
counted (source, size) cells. The Hessian has the sources on its diagonal and is full only in the two rows of the profile, so its Schur complement,
2 x 2, is all that the driver solves; multipliers of sources stay rows of a DataFrame, however many there are. Steps are halved until D falls enough.

Rates become whole copies: every document gets the whole number below its rate, and one more goes to a subset of each source. The subset is counted per size class (large
first, the error carried to the smaller ones); within a class it is the rows whose hash is below a threshold, found by radix selection over counts. So
copies follow from a row's own columns and small tables: no text is exchanged and no task holds a source.

Defined cases: null text has size 0; null source is a source of its own and the last; documents of size 0 take 0 words; equal rows are
ranked like any two rows; an empty table gives an empty table; other columns may have any name (they are not read).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, word_count

#: Weights by the source's place in code-point order, repeating. Most copies of a document.
WEIGHTS = (5, 2, 1)
MOST = 3
#: Size classes per doubling.
CLASSES_PER_DOUBLING = 6
RIDGE, NEWTON_STEPS, TOLERANCE = 0.01, 50, 1e-8
#: Bits of the hash that one level of the radix selection looks at; rows of a cell that are sorted at last.
DIGIT_BITS, SORTED_ROWS = 12, 1024
_CELL = ("__src", "__class", "__all")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds `__rank` from 0 in code-point order, null last: places inside range partitions, after the counts of the partitions before."""
    placed = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    placed = cut(placed.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33)))
    counts = sorted((r["__part"], r["count"]) for r in placed.groupBy("__part").count().collect())  # one row per partition
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    start = sources.sparkSession.createDataFrame(before, "__part bigint, __before bigint")
    return placed.join(F.broadcast(start), "__part").withColumn("__rank", F.col("__before") + F.col("__id") - F.shiftleft("__part", 33)).drop("__part", "__id", "__before")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds `target` to (source, source_size): shares by weight, capped at `most` times the size, the excess reshared until none is above."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    s = cut(ranked(sources).withColumn("__w", weight).withColumn("__cap", F.col("source_size") * float(most)).drop("__rank"))
    theta, capped = None, -1
    while True:
        # `theta` words per weight; sources at their cap leave the sharing. More of them raise it, so this ends.
        over = F.lit(False) if theta is None else F.col("__cap") < F.lit(theta) * F.col("__w")
        got = s.agg(F.sum("source_size"), F.sum(F.when(over, F.col("__cap"))), F.sum(F.when(~over, F.col("__w"))), F.count_if(over)).first()
        if got[3] == capped or not got[2]:
            break
        theta, capped = (float(got[0]) - (got[1] or 0.0)) / got[2], got[3]
    return s.select("source", "source_size", F.least(F.col("__cap"), F.lit(theta or 0.0) * F.col("__w")).alias("target"))


def _value(tilt: Column, most: float) -> Column:
    return F.when(tilt < math.log(most), F.exp(tilt)).otherwise(most + most * (tilt - math.log(most)))


def _slope(tilt: Column, most: float) -> Column:
    return F.when(tilt < math.log(most), F.exp(tilt)).otherwise(F.lit(float(most)))


def _profile(size: Column, centre: float, spread: float) -> tuple[Column, Column]:
    """The two covariates of a size."""
    x = (F.log(size.cast("double")) - centre) / spread if spread > 0 else F.lit(0.0)
    return x, (x * x - 1.0) if spread > 0 else F.lit(0.0)


def balance(cells: DataFrame, sources: DataFrame, most: int = MOST, steps: int = NEWTON_STEPS) -> tuple[DataFrame, tuple[float, ...]]:
    """Solves the dual. `cells`: (__src, size, __words); `sources`: (__src, source_size, target). Returns (__src, source_size, target, __l) and (centre, spread, u1, u2).

    `__l` is null where nothing is to be balanced: no words wanted, or as many as the cap allows.
    """
    free = (F.col("target") > 0) & (F.col("target") < most * F.col("source_size") * (1 - 1e-9))
    held = cut(sources.withColumn("__l", F.when(free, F.log(F.col("target") / F.col("source_size")))))
    n_sources = held.count()
    known = cells.where("__words > 0").join(bounded(held.where("__l IS NOT NULL").select("__src"), n_sources), "__src")
    x = F.log(F.col("size").cast("double"))
    w = F.col("__words").cast("double")
    moments = known.agg(F.sum(w), F.sum(w * x), F.sum(w * x * x)).first()
    if not moments[0]:
        return held, (0.0, 0.0, 0.0, 0.0)
    centre = round(moments[1] / moments[0], 9)
    variance = moments[2] / moments[0] - centre * centre
    spread = round(math.sqrt(variance), 9) if variance > 1e-9 else 0.0
    x1, x2 = _profile(F.col("size"), centre, spread)
    known = cut(known.select("__src", w.alias("w"), x1.alias("x1"), x2.alias("x2")))
    u, best, step = np.zeros(2), None, 1.0
    now = held.where("__l IS NOT NULL").select("__src", "target", F.col("__l").alias("l"))
    for _ in range(steps):
        tilt = F.col("l") + F.lit(float(u[0])) * F.col("x1") + F.lit(float(u[1])) * F.col("x2")
        met = known.join(bounded(now, n_sources), "__src").select("*", _value(tilt, most).alias("f"), _slope(tilt, most).alias("r"))
        met = met.withColumn("h", F.when(F.col("r") < most, F.col("r")).otherwise(0.0))
        total = lambda e, name: F.sum(F.expr(f"w * {e}")).alias(name)
        per = met.groupBy("__src").agg(
            F.first("target").alias("target"), F.first("l").alias("l"), total("f", "f"), total("r", "r"), total("h", "h"), total("h * x1", "b1"), total("h * x2", "b2"),
            total("r * x1", "g1"), total("r * x2", "g2"), total("h * x1 * x1", "c11"), total("h * x1 * x2", "c12"), total("h * x2 * x2", "c22"),
        )
        per = cut(per.withColumn("g", F.col("r") - F.col("target")).withColumn("h", F.greatest("h", F.col("target") * 1e-9)))
        names = ("f - l * target", "target", "g1", "g2", "c11 - b1 * b1 / h", "c12 - b1 * b2 / h", "c22 - b2 * b2 / h", "b1 * g / h", "b2 * g / h", "g * g / h")
        got = per.agg(*[F.sum(F.expr(e)) for e in names], F.max(F.abs(F.col("g")) / F.col("target"))).first()
        words, gradient = got[1], np.array(got[2:4]) + RIDGE * got[1] * u
        value = got[0] + RIDGE / 2 * words * float(u @ u)
        if best is not None and value > best[0] + 1e-4 * step * best[4] + 1e-12 * abs(value):
            step /= 2
        else:
            # Newton's direction: the sources are eliminated, their own steps follow from that of the profile.
            schur = np.array([[got[4], got[5]], [got[5], got[6]]]) + RIDGE * words * np.eye(2)
            du = -np.linalg.solve(schur, gradient - np.array(got[7:9]))
            if got[10] <= TOLERANCE and float(np.abs(gradient).max()) <= TOLERANCE * words:
                best = (value, per, u, du, 0.0)
                break
            ds = gradient - np.array(got[7:9])
            best, step = (value, per, u, du, float(ds @ du) - got[9]), 1.0
        _, at, u0, du, _ = best
        move = -(F.col("g") + F.lit(float(du[0])) * F.col("b1") + F.lit(float(du[1])) * F.col("b2")) / F.col("h")
        now, u = at.select("__src", "target", (F.col("l") + F.lit(step) * move).alias("l")), u0 + step * du
    # Rounded, so that the order in which Spark adds up doesn't show in the rates.
    solved = best[1].select("__src", F.round("l", 9).alias("__solved"))
    u = [round(float(v), 9) for v in best[2]]
    out = held.join(bounded(solved, n_sources), "__src", "left").select("__src", "source_size", "target", F.coalesce("__solved", "__l").alias("__l"))
    return cut(out), (centre, spread, *u)


def _rate(solved: tuple[float, ...], most: int) -> Column:
    """The rate of a row with size, target, source_size and __l."""
    centre, spread, u1, u2 = solved
    x1, x2 = _profile(F.col("size"), centre, spread)
    tilted = F.round(_slope(F.col("__l") + u1 * x1 + u2 * x2, most), 6)
    return F.when((F.col("size") <= 0) | (F.col("target") <= 0), F.lit(0.0)).when(F.col("__l").isNull(), F.lit(float(most))).otherwise(tilted)


def picks(cells: DataFrame) -> DataFrame:
    """(source, class, copies for all, rows, number that get one more), from rows, words and words that are due, by carrying the error on."""
    room = F.col("__words") - F.col("__due")
    listed = F.sort_array(F.collect_list(F.struct("__class", "__all", "__n", "__words", "__due", room.alias("__room"))), asc=False).alias("__cells")
    per = cells.groupBy("__src").agg(listed, F.sum(room).alias("__up"), F.sum("__due").alias("__down"))

    def step(acc, cell):
        due, mean = acc["due"] + cell["__due"], cell["__words"] / cell["__n"]
        up, down = acc["up"] - cell["__room"], acc["down"] - cell["__due"]
        # The nearest number, but no error that the classes below, with all their documents or none, couldn't make good.
        m = F.greatest(F.floor(due / mean + 0.5), F.ceil((due - up) / mean - 1e-9))
        m = F.least(m, F.greatest(F.lit(0), F.floor((due + down) / mean + 1e-9)))
        m = F.greatest(F.lit(0), F.least(cell["__n"], m)).cast("long")
        one = F.struct(cell["__class"].alias("__class"), cell["__all"].alias("__all"), m.alias("__m"), cell["__n"].alias("__n"))
        return F.struct((due - m * mean).alias("due"), up.alias("up"), down.alias("down"), F.concat(acc["out"], F.array(one)).alias("out"))

    start = F.struct(F.lit(0.0).alias("due"), F.col("__up").alias("up"), F.col("__down").alias("down"), F.array().cast("array<struct<__class:int,__all:bigint,__m:bigint,__n:bigint>>").alias("out"))
    # A source has a cell for each of its size classes, a few hundred at most.
    return per.select("__src", F.explode(F.aggregate("__cells", start, step, lambda acc: acc["out"])).alias("__c")).select("__src", "__c.*")


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cell, __top, __take, __ties): the `__m`-th smallest `__h` of each cell, and how many of the rows that have it are among the `__m`."""
    n = wanted.count()
    rows = rows.select(*_CELL, "__h").join(bounded(wanted.select(*_CELL, F.col("__m").alias("__need")), n), list(_CELL))
    upto = Window.partitionBy(*_CELL).orderBy("__digit")

    def hit(digits: DataFrame) -> DataFrame:
        """The digit in which the wanted row is, with its rows and the place in it; a cell has few digits."""
        counted = digits.groupBy(*_CELL, "__need", "__digit").agg(F.count(F.lit(1)).alias("__c")).withColumn("__upto", F.sum("__c").over(upto))
        found = counted.where("__upto >= __need AND __upto - __c < __need")
        return cut(found.select(*_CELL, F.col("__digit").alias("__hit"), (F.col("__need") - F.col("__upto") + F.col("__c")).alias("__left"), "__c"))

    for bits in range(DIGIT_BITS, 64, DIGIT_BITS):
        digit = F.shiftright("__h", 64 - bits)
        found = hit(rows.withColumn("__digit", digit))
        inside = rows.join(bounded(found, n), list(_CELL)).where(digit == F.col("__hit"))
        rows = inside.select(*_CELL, "__h", F.col("__left").alias("__need"))
        if (found.agg(F.max("__c")).first()[0] or 0) <= SORTED_ROWS:
            break
    return hit(rows.withColumn("__digit", F.col("__h"))).select(*_CELL, F.col("__hit").alias("__top"), F.col("__left").alias("__take"), F.col("__c").alias("__ties"))


def entropy_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, carry: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every row; with `carry` also a struct `__row` of all its columns."""
    thin = docs.select(
        "doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("__src"), "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "source", "text").alias("__h"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")] if carry else []),
    )
    held = cut(thin.drop("__row"))
    cells = cut(held.groupBy("__src", "source", "size").agg(F.count(F.lit(1)).alias("__n"), F.sum("size").alias("__words")))
    sized = targets(cells.groupBy("source").agg(F.sum("__words").alias("source_size")), weights, most)
    sized = sized.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("__src"), "source_size", "target")
    sources, solved = balance(cells, sized, most)
    n_sources = sources.count()

    def rated(df: DataFrame) -> DataFrame:
        df = df.join(bounded(sources, n_sources), "__src").withColumn("__rate", _rate(solved, most))
        return df.withColumn("__class", F.floor(F.log2("size") * CLASSES_PER_DOUBLING).cast("int")).withColumn("__all", F.greatest(F.lit(0), F.ceil("__rate") - 1).cast("long"))

    due = F.sum((F.col("__rate") - F.col("__all")) * F.col("__words")).alias("__due")
    info = cut(picks(rated(cells.drop("source")).where("size > 0").groupBy(*_CELL).agg(F.sum("__n").alias("__n"), F.sum("__words").alias("__words"), F.round(due, 3).alias("__due"))))
    some = info.where("__m > 0 AND __m < __n")
    top = thresholds(rated(held.drop("source")).where("size > 0"), some)
    every = info.where("__m > 0 AND __m = __n").select(*_CELL, F.lit((1 << 63) - 1).alias("__top"), F.lit(1).cast("long").alias("__take"), F.lit(1).cast("long").alias("__ties"))
    top = cut(top.unionByName(every))
    out = rated(thin.drop("source")).join(bounded(top, top.count()), list(_CELL), "left")
    more = F.when(F.col("__h") < F.col("__top"), 1).when((F.col("__h") == F.col("__top")) & (F.col("__take") == F.col("__ties")), 1).otherwise(0)
    tied = F.coalesce((F.col("__h") == F.col("__top")) & (F.col("__take") < F.col("__ties")), F.lit(False))
    whole = out.where(~tied).withColumn("__more", more)
    if not top.where("__take < __ties").isEmpty():
        # Rows that are equal in id, source and text, of which only some get one more.
        place = F.row_number().over(Window.partitionBy(*_CELL, "__h").orderBy("doc_id"))
        whole = whole.unionByName(out.where(tied).withColumn("__more", (place <= F.col("__take")).cast("int")))
    copies = (F.col("__all") + F.col("__more")).cast("long")
    kept = ["__row"] if carry else []
    return whole.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), copies.alias("copies"), (F.col("size") * copies).alias("taken"), *kept)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its columns and `copy_no` from 1."""
    names = [c for c in docs.columns if c != "copy_no"]
    mixed = entropy_mix(docs, carry=True, **options).where("copies > 0")
    rows = mixed.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy_no"))
    return rows.select(*[F.col("__row").getField(c).alias(c) for c in names], "copy_no")
