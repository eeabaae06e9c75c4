"""Exact interpolated percentiles per group, whatever the group size.

`percentile` keeps a group's distinct values in one task's memory. Here values are first
counted, then placed in buckets that are a monotone function of the value (logarithmic
ones at first), so that a histogram tells which buckets hold a wanted rank. Buckets that
hold one and are still crowded are cut again, evenly between their least and largest
value, until each has few values; only those are ordered. Every cut parts at least the
least value from the largest, so this ends for any values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from costlens import session

BUCKETS_PER_OCTAVE = 256
TINY = 1e-12
#: Parts of a crowded bucket, and values that one task may order.
PARTS, CROWDED = 4096, 100_000


def _octave(v: Column) -> Column:
    """Monotone in v; at most a few ten thousand distinct buckets."""
    size = F.floor(F.log2(F.greatest(F.abs(v), F.lit(TINY)) / F.lit(TINY)) * BUCKETS_PER_OCTAVE)
    return F.when(v < 0, -size - 1).otherwise(size)


def _part(v: Column) -> Column:
    """Monotone in v between the bucket's least and largest value."""
    share = F.try_divide(v - F.col("_low"), F.col("_high") - F.col("_low"))
    return F.floor(F.coalesce(share, F.lit(0.0)) * PARTS)


def exact_percentiles(df: DataFrame, groups: list[str], value: str,
                      fractions: dict[str, float]) -> DataFrame:
    """One row per group with its percentiles, interpolated between the two nearest ranks."""
    v = F.col(value).cast("double")
    cells = (df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*groups, v.alias("_v"))
             .agg(F.count(F.lit(1)).alias("_n")).withColumn("_base", F.lit(0).cast("bigint")))

    def rank(f: float) -> Column:
        return F.lit(f) * (F.col("_total") - 1)

    ends = [end(rank(f)) for f in fractions.values() for end in (F.floor, F.ceil)]
    bucket = _octave(F.col("_v"))
    while True:
        # a bucket is known by the group and the rank it starts at
        whole = "_total" in cells.columns
        cells = cells.withColumn("_b", bucket)
        hist = cells.groupBy(*groups, "_base", "_b").agg(
            F.sum("_n").alias("_bn"), F.count(F.lit(1)).alias("_values"),
            F.min("_v").alias("_low"), F.max("_v").alias("_high"),
            *([F.any_value("_total").alias("_total")] if whole else []))
        before = W.partitionBy(*groups, "_base").orderBy("_b").rowsBetween(
            W.unboundedPreceding, -1)
        hist = hist.withColumn("_start", F.col("_base") + F.coalesce(
            F.sum("_bn").over(before), F.lit(0)))
        if not whole:
            hist = hist.withColumn("_total", F.sum("_bn").over(W.partitionBy(*groups)))
        wanted = [(F.col("_start") <= e) & (e < F.col("_start") + F.col("_bn")) for e in ends]
        kept = session.materialize(hist.where(reduce(lambda a, b: a | b, wanted)), "histogram")
        cells = (cells.select(*groups, "_v", "_n", "_base", "_b")
                 .join(kept.drop("_bn", "_values"), [*groups, "_base", "_b"])
                 .drop("_base", "_b").withColumnRenamed("_start", "_base"))
        if (kept.agg(F.max("_values").alias("most")).first()["most"] or 0) <= CROWDED:
            break
        cells = session.materialize(cells, "crowded-buckets")
        bucket = _part(F.col("_v"))
    in_bucket = W.partitionBy(*groups, "_base").orderBy("_v")
    cells = (cells.withColumn("_end", F.col("_base") + F.sum("_n").over(
                in_bucket.rowsBetween(W.unboundedPreceding, 0)))
             .withColumn("_from", F.col("_end") - F.col("_n")))

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("_from") <= position) & (position < F.col("_end")),
                            F.col("_v")))

    aggs = [F.max("_total").alias("_total")]
    for i, f in enumerate(fractions.values()):
        aggs += [at(F.floor(rank(f))).alias(f"_lo{i}"), at(F.ceil(rank(f))).alias(f"_hi{i}")]
    found = cells.groupBy(*groups).agg(*aggs)
    return found.select(*groups, *[
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}"))
         * (rank(f) - F.floor(rank(f)))).alias(name)
        for i, (name, f) in enumerate(fractions.items())])


def box_plot(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Quartiles, 1.5-IQR whiskers (the outermost values inside the fences) and outliers."""
    q = exact_percentiles(df, groups, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    q = q.withColumn("low_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn(
        "high_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    inside = F.col(value).between(F.col("low_fence"), F.col("high_fence"))
    return (df.join(q, groups).groupBy(*groups)
            .agg(F.any_value("q1").alias("q1"), F.any_value("median").alias("median"),
                 F.any_value("q3").alias("q3"),
                 F.min(F.when(inside, F.col(value))).alias("whisker_low"),
                 F.max(F.when(inside, F.col(value))).alias("whisker_high"),
                 F.count_if(~inside).alias("outliers")))
