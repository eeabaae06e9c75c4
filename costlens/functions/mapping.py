"""Service, region and currency normalisation.

Each lookup exists twice: as a column expression, for SQL functions and small
inputs, and as a broadcast join against the fixed table, which probes one hash
per row instead of walking a literal map and is what the bulk jobs use.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from costlens import constants as C


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])


def fixed_table(spark: SparkSession, mapping: dict, key: str, value: str) -> DataFrame:
    return spark.range(1).select(F.explode(literal_map(mapping)).alias(key, value))


def lookup_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def service_category(raw: Column) -> Column:
    hit = F.try_element_at(literal_map(C.SERVICE_CATEGORY), lookup_key(raw))
    return F.coalesce(hit, F.lit(C.DEFAULT_SERVICE_CATEGORY))


def canonical_region(raw: Column) -> Column:
    hit = F.try_element_at(literal_map(C.REGION_CANONICAL), lookup_key(raw))
    return F.coalesce(hit, F.nullif(raw, F.lit("")), F.lit(C.DEFAULT_REGION))


def fx_rate(currency: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(C.FX_RATES), F.upper(currency)), F.lit(1.0))


def to_usd(amount: Column, currency: Column) -> Column:
    return amount * fx_rate(currency)


def fx_missing(currency: Column) -> Column:
    """True where a currency is absent from the table and 1:1 is assumed."""
    return F.coalesce(~F.upper(currency).isin(list(C.FX_RATES)), F.lit(False))


def _join_lookup(df: DataFrame, source: Column, mapping: dict, out: str,
                 default: Column) -> DataFrame:
    table = fixed_table(df.sparkSession, mapping, "_lk", "_lv")
    return (df.withColumn("_key", lookup_key(source))
            .join(F.broadcast(table), F.col("_key") == F.col("_lk"), "left")
            .withColumn(out, F.coalesce("_lv", default))
            .drop("_key", "_lk", "_lv"))


def with_service_category(df: DataFrame, source: str = "service",
                          out: str = "service_category", mapping: dict | None = None) -> DataFrame:
    return _join_lookup(df, F.col(source), mapping or C.SERVICE_CATEGORY, out,
                        F.lit(C.DEFAULT_SERVICE_CATEGORY))


def with_canonical_region(df: DataFrame, source: str = "region", out: str = "region",
                          mapping: dict | None = None) -> DataFrame:
    raw = F.col(source)
    fallback = F.coalesce(F.nullif(raw, F.lit("")), F.lit(C.DEFAULT_REGION))
    return _join_lookup(df, raw, mapping or C.REGION_CANONICAL, out, fallback)
