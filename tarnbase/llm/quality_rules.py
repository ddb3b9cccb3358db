"""Quality rules: one threshold table compiled into one projection, without user functions.

Every metric is a column expression over the row's own text, so the operator needs no shuffle at all and
its cost is linear in the text (plus one sort of the word windows inside each document).

Defined cases: a null text counts as empty; an empty text has no words and fails the base rule; equal rows
give equal rows; an empty table gives an empty table; columns other than `text` pass through, and a column
whose name is one of the result's is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_of

# Frequent function words of English, French, German and Spanish, lower case.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to "
    "was we were which who will with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur ne nous par pas pour qui que sa se ses son sur un une vous "
    "als am auch auf aus bei das dem den der des die ein eine er es für hat ich im ist mit nach nicht noch sich sie sind so um und von vor war wie zu zum zur "
    "al como con del el ella en es esta la las lo los más no para pero por que se sin su sus y"
).split()


@dataclass(frozen=True)
class Rule:
    """`metric` must lie in [at_least, at_most]; metrics are SQL over the measured columns."""

    name: str
    metric: str
    at_least: float | None = None
    at_most: float | None = None


#: The threshold table. Ratios are compared as 100 * part against bound * whole, in exact integers.
RULES: tuple[Rule, ...] = (
    Rule("word_length", "100 * word_chars / n_words", 200, 1500),
    Rule("symbols", "100 * n_symbols / n_words", None, 10),
    Rule("stop_words", "100 * n_stop_words / n_words", 2, None),
    Rule("duplicate_lines", "100 * n_dup_lines / n_lines", None, 60),
    Rule("bullet_lines", "100 * n_bullet_lines / n_lines", None, 90),
    Rule("ellipsis_lines", "100 * n_ellipsis_lines / n_lines", None, 30),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines")


def verdict(rule: Rule) -> Column:
    """True if the rule holds; a ratio over nothing holds."""
    part, whole = rule.metric.split(" / ")
    inside = F.lit(True)
    if rule.at_least is not None:
        inside &= F.expr(f"{part} >= {rule.at_least} * {whole}")
    if rule.at_most is not None:
        inside &= F.expr(f"{part} <= {rule.at_most} * {whole}")
    return inside


def repeated_words(words: str) -> Column:
    """Number of words covered by 3-word windows that occur at least twice in the text.

    Windows are hashed to 64 bits and sorted with their positions, so equal windows become neighbours; the covered
    words are then summed from the gaps between the positions. Two different windows of one document
    share a hash with probability below n^2 / 2^65.
    """
    return F.expr(
        f"""aggregate(transform({words}, (p, i) -> least(3, coalesce(get({words}, i + 1) - p, 3))), 0L, (a, x) -> a + x)"""
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` with the measured columns (all long)."""
    keep = [c for c in docs.columns if c not in MEASURES]
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    # The other columns travel in one struct, so that their names cannot clash with those used here.
    row = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row")] if keep else []
    staged = docs.select(*row, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__t"))
    staged = staged.withColumns({"__w": words_of(F.col("__t")), "__l": F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    staged = staged.withColumn(
        "__s",
        F.expr(
            "sort_array(transform(slice(__w, 1, greatest(size(__w) - 2, 0)),"
            " (x, i) -> named_struct('h', xxhash64(x, get(__w, i + 1), get(__w, i + 2)), 'i', i)))"
        ),
    )
    staged = staged.withColumn(
        "__p", F.expr("sort_array(transform(filter(__s, (x, i) -> x.h = get(__s, i - 1).h OR x.h = get(__s, i + 1).h), x -> x.i))")
    )
    lines = F.size("__l").cast("long")
    return staged.select(
        *[F.col("__row").getField(c).alias(c) for c in keep],
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (lines - F.size(F.array_distinct("__l"))).alias("n_dup_lines"),
        repeated_words("__p").alias("n_repeat_words"),
        F.expr(f"cast(size(filter(__w, x -> x IN ({stops}))) as bigint)").alias("n_stop_words"),
        lines.alias("n_lines"),
        F.expr(r"cast(size(filter(__l, x -> x rlike '^[\\x20\\x09-\\x0D]*[-*•]')) as bigint)").alias("n_bullet_lines"),
        F.expr(r"cast(size(filter(__l, x -> x rlike '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$')) as bigint)").alias("n_ellipsis_lines"),
    )


def apply_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures, `base_failed`, one boolean `ok_<rule>` for each rule, and `kept`."""
    measured = measure(docs, text)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = measured.withColumns({"base_failed": base} | {f"ok_{r.name}": verdict(r) for r in rules})
    # The row number is a fence: Spark would push a filter on `kept` below the projections that hold the word arrays, and then
    # evaluate those arrays anew for each word.
    kept = ~F.col("base_failed") & (F.monotonically_increasing_id() >= 0)
    for r in rules:
        kept &= F.col(f"ok_{r.name}")
    return out.withColumn("kept", kept)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns only."""
    names = docs.columns
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col("text").alias("text"))
    return apply_rules(wrapped).where("kept").select("__row.*")
