"""Daily rollup and the spend queries over billing records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from costlens import constants as C
from costlens.functions import calendar as cal
from costlens.operators import filters as flt
from costlens.schemas import DAILY_KEY


def _rows():
    return F.count(F.lit(1))


def daily_rollup(billing: DataFrame, start=None, end=None) -> DataFrame:
    """Sum, count and mean cost per date and five dimensions.

    Missing environment and team become `unknown` before grouping, so the two
    cannot collide on the table key afterwards.
    """
    named = flt.unknown_dimensions(flt.date_range(billing, "usage_date", start, end),
                                   "environment", "team")
    return (named.withColumnRenamed("usage_date", "agg_date").groupBy(*DAILY_KEY)
            .agg(F.sum("cost_usd").alias("total_cost_usd"), _rows().alias("record_count"),
                 F.avg("cost_usd").alias("avg_cost_usd")))


def add_up(daily: DataFrame) -> DataFrame:
    """One rollup row per key from several partial ones."""
    return daily.groupBy(*DAILY_KEY).agg(
        F.sum("total_cost_usd").alias("total_cost_usd"),
        F.sum("record_count").alias("record_count")).withColumn(
        "avg_cost_usd", F.col("total_cost_usd") / F.col("record_count"))


def regroup_daily(daily: DataFrame, start=None, end=None, cloud=None, service=None,
                  group_by: tuple[str, ...] = ("agg_date", "cloud_provider")) -> DataFrame:
    """Re-aggregate the rollup by any of its dimensions."""
    cols = flt.known_columns(list(group_by), set(DAILY_KEY), ["agg_date", "cloud_provider"])
    rows = flt.equals(flt.date_range(daily, "agg_date", start, end),
                      cloud_provider=cloud, service_category=service)
    return (rows.groupBy(*cols).agg(F.sum("total_cost_usd").alias("total_cost"),
                                    F.sum("record_count").alias("total_records"))
            .orderBy(F.col(cols[0]).desc_nulls_first(), *cols[1:]))


def spend_summary(billing: DataFrame, start=None, end=None,
                  group_by: str = "cloud_provider") -> DataFrame:
    allowed = {"cloud_provider", "service_category", "environment", "team", "account_id"}
    col = flt.known_columns([group_by], allowed, ["cloud_provider"])[0]
    return (flt.date_range(billing, "usage_date", start, end).groupBy(col)
            .agg(F.sum("cost_usd").alias("total_cost"), _rows().alias("record_count"))
            .orderBy(F.col("total_cost").desc_nulls_first(), col))


def record_count(billing: DataFrame, start=None, end=None) -> DataFrame:
    """Row count; the range applies only when both ends are given."""
    if start is not None and end is not None:
        billing = flt.date_range(billing, "usage_date", start, end)
    return billing.agg(_rows().alias("record_count"))


def billing_summary(billing: DataFrame, start=None, end=None, clouds=None, service=None,
                    region=None) -> DataFrame:
    rows = flt.equals(flt.member(flt.date_range(billing, "usage_date", start, end),
                                 "cloud_provider", clouds),
                      service_category=service, region=region)
    return (rows.groupBy("usage_date", "cloud_provider",
                         F.col("service_category").alias("service"), "region")
            .agg(F.sum("cost_usd").alias("total_cost_usd"), _rows().alias("record_count"),
                 F.count_if("anomaly_flag").alias("anomaly_count")))


def date_bounds(df: DataFrame, column: str = "usage_date",
                defaults: tuple[str, str] = C.DEFAULT_BOUNDS) -> DataFrame:
    """First and last date as text, with defaults for an empty table."""
    return df.agg(F.coalesce(F.min(column).cast("string"), F.lit(defaults[0])).alias("min_date"),
                  F.coalesce(F.max(column).cast("string"), F.lit(defaults[1])).alias("max_date"))


def with_share(totals: DataFrame, value: str) -> DataFrame:
    """Percent of the grand total; NULL when that is zero.

    `totals` is already grouped, one row per dimension value, so summing it again
    in a window costs nothing and the billing rows are scanned once.
    """
    whole = F.sum(value).over(W.partitionBy())
    return totals.withColumn("pct_of_total", F.try_divide(F.col(value), whole) * 100)


def shares(rows: DataFrame, dimension: str, cloud: str | None = None) -> DataFrame:
    """Spend and record count per dimension value and its share of all spend.

    A cloud narrows the spend and the count but not the total it is compared with.
    """
    mine = F.col("cloud_provider") == cloud if flt.is_given(cloud) else F.lit(True)
    totals = rows.groupBy(F.col(dimension).alias("dimension")).agg(
        F.sum("cost_usd").alias("_all"),
        F.sum(F.when(mine, F.col("cost_usd"))).alias("total_cost_usd"),
        F.count_if(mine).alias("record_count"))
    share = F.try_divide("total_cost_usd", F.sum("_all").over(W.partitionBy())) * 100
    return totals.withColumn("pct_of_total", share).where("record_count > 0").drop("_all")


def spend_by_cloud(billing: DataFrame, start=None, end=None) -> DataFrame:
    rows = flt.date_range(billing, "usage_date", start, end)
    return shares(rows, "cloud_provider").orderBy(
        F.col("total_cost_usd").desc_nulls_first(), "dimension")


def spend_by_service(billing: DataFrame, start=None, end=None, cloud=None,
                     top_n: int = 10) -> DataFrame:
    """Top services; the share is of all clouds' spend even under a cloud filter."""
    rows = flt.date_range(billing, "usage_date", start, end)
    return (shares(rows, "service_category", cloud)
            .orderBy(F.col("total_cost_usd").desc_nulls_first(), "dimension").limit(top_n))


def spend_trend(billing: DataFrame, start=None, end=None, cloud=None,
                granularity: str = "day") -> DataFrame:
    rows = flt.equals(flt.date_range(billing, "usage_date", start, end), cloud_provider=cloud)
    return (rows.groupBy(cal.truncate(F.col("usage_date"), granularity).alias("period"))
            .agg(F.sum("cost_usd").alias("total_cost_usd"), _rows().alias("record_count"))
            .orderBy("period").withColumn("period", F.col("period").cast("string")))
