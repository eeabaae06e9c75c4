"""First-wins deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key under an explicit order.

    Spark keeps only the first row per key on the map side before it shuffles
    (a window group limit), so one key with a third of all rows sends a row per
    input partition, not its whole group.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def duplicate_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Input, kept and removed row counts."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return per_key.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("input_count"),
                       F.count(F.lit(1)).alias("output_count")).withColumn(
        "duplicate_count", F.col("input_count") - F.col("output_count"))


def with_group_count(df: DataFrame, keys: list[str], out: str = "group_rows") -> DataFrame:
    """Group size on each row, by a pre-aggregated join rather than a window.

    A window would put a hot group in one task; the count table has one row per
    key and adaptive execution splits a skewed probe side.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    return df.join(counts, keys, "left")


def groups_of_size(df: DataFrame, keys: list[str], at_least: int) -> DataFrame:
    """Rows of groups with enough rows."""
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= at_least)
    return df.join(big.select(*keys), keys, "left_semi")
