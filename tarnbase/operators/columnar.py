"""Row groups, chunk statistics, encodings, zone maps and the bill of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunk_stats(rows: DataFrame, order: str, group_rows: int, columns: dict[str, int], numeric: set[str]) -> DataFrame:
    """Statistics of each (row_group, column), the encoding that is chosen and its bytes.

    Rows are brought together by row group once; all columns are aggregated side by side, and only the finished statistics become a row per column.
    Tests in order: run lengths if runs are at most half the rows, deltas if strictly ascending numbers, a dictionary if distinct values are at
    most half the rows, else plain; an encoding that isn't smaller than plain is plain.
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns}
    value = {c: F.col(c).cast("double") if c in numeric else F.lit(None).cast("double") for c in columns}
    held = rows.select(F.floor(F.col(order) / group_rows).alias("row_group"), F.col(order).alias("ord"), *[text[c].alias(f"s_{c}") for c in columns], *[value[c].alias(f"v_{c}") for c in columns])
    w = Window.partitionBy("row_group").orderBy("ord")
    held = held.select("*", *[F.lag(f"s_{c}").over(w).alias(f"p_{c}") for c in columns], *[F.lag(f"v_{c}").over(w).alias(f"q_{c}") for c in columns])

    def of(c: str) -> Column:
        s, v, before = F.col(f"s_{c}"), F.col(f"v_{c}"), F.col(f"p_{c}")
        rises = v.isNotNull() & (before.isNull() | F.coalesce(v > F.col(f"q_{c}"), F.lit(False)))
        # A set of a row group's values is bounded by its rows.
        return F.struct(
            F.lit(c).alias("column"), F.lit(columns[c]).alias("width"), F.count(F.lit(1)).alias("n"), F.size(F.collect_set(s)).cast("long").alias("n_distinct"),
            F.count_if(before.isNull() | (s != before)).alias("runs"), F.bool_and(rises).alias("ascending"), F.min(v).alias("min_value"), F.max(v).alias("max_value"),
        ).alias(f"c_{c}")

    g = held.groupBy("row_group").agg(*[of(c) for c in columns])
    g = g.select("row_group", F.explode(F.array(*[F.col(f"c_{c}") for c in columns])).alias("x")).select("row_group", "x.*")
    wide, n = F.col("width"), F.col("n")
    choice = F.when(F.col("runs") * 2 <= n, "rle").when(F.col("ascending"), "delta").when(F.col("n_distinct") * 2 <= n, "dictionary").otherwise("plain")
    size = F.when(choice == "rle", F.col("runs") * (wide + 2)).when(choice == "delta", wide + n - 1).when(choice == "dictionary", F.col("n_distinct") * wide + n * F.when(F.col("n_distinct") <= 256, 1).otherwise(2)).otherwise(n * wide)
    raw = n * wide
    return g.select(
        "row_group", "column", "n", "n_distinct", "runs", F.when(size >= raw, "plain").otherwise(choice).alias("encoding"),
        raw.cast("long").alias("raw_bytes"), F.least(size, raw).cast("long").alias("encoded_bytes"), "min_value", "max_value",
    )


def overlaps(low: Column, high: Column, least: float, most: float) -> Column:
    """Whether a zone may hold values of [least, most]; zones without statistics may."""
    return F.coalesce((high >= least) & (low <= most), F.lit(True))


def scan_bill(chunks: DataFrame, predicate_column: str, least: float, most: float, read: set[str]) -> DataFrame:
    """One row: row groups scanned and skipped, bytes read, and all bytes, for a range predicate and the columns it reads."""
    own = F.col("column") == predicate_column
    groups = chunks.groupBy("row_group").agg(
        F.max(F.when(own, overlaps(F.col("min_value"), F.col("max_value"), least, most))).alias("hit"),
        F.sum(F.when(F.col("column").isin(*sorted(read)), F.col("encoded_bytes")).otherwise(0)).alias("read"), F.sum("raw_bytes").alias("raw"),
    )
    return groups.agg(
        F.count_if("hit").alias("groups_scanned"), F.count_if(~F.col("hit")).alias("groups_skipped"),
        F.coalesce(F.sum(F.when(F.col("hit"), F.col("read")).otherwise(0)), F.lit(0)).cast("long").alias("bytes_read"), F.sum("raw").alias("row_store_bytes"),
    )
