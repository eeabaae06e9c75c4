"""Reports over anomalies, alerts, attributions and the labelled raw data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from costlens import constants as C
from costlens.operators import filters as flt


def _rows() -> Column:
    return F.count(F.lit(1))


def count_by(df: DataFrame, column: str, out: str = "count") -> DataFrame:
    return df.groupBy(column).agg(_rows().alias(out))


def _count_map(key: str, only: Column) -> Column:
    """Map of key to row count, from the grouping-set rows that belong to it."""
    pairs = F.collect_list(F.when(only, F.struct(F.col(key), F.col("_n"))))
    return F.map_from_entries(F.array_sort(pairs))


def anomaly_summary(anomalies: DataFrame, start=None, end=None) -> DataFrame:
    """Total and counts by severity, cloud and method, from one scan.

    Grouping sets fold the three groupings into one aggregation; what is
    collected afterwards is one row per distinct label.
    """
    rows = flt.date_range(anomalies, "usage_date", start, end)
    keys = ["severity", "cloud_provider", "detection_method"]
    cols = [F.col(k) for k in keys]
    sets = rows.groupingSets([[c] for c in cols] + [[]], *cols).agg(
        _rows().alias("_n"), F.grouping_id(*cols).alias("_set"))
    return sets.agg(
        F.max(F.when(F.col("_set") == 7, F.col("_n"))).alias("total_anomalies"),
        _count_map("severity", F.col("_set") == 3).alias("by_severity"),
        _count_map("cloud_provider", F.col("_set") == 5).alias("by_cloud"),
        _count_map("detection_method", F.col("_set") == 6).alias("by_type"))


def alert_summary(alerts: DataFrame, start=None, end=None) -> DataFrame:
    """Long form (`metric`, `key`, `n`): total, unresolved, and counts by severity
    (the four known ones zero-filled, others kept), type and cloud."""
    rows = flt.date_range(alerts, "alert_date", start, end)
    cols = [F.col(k) for k in ("severity", "alert_type", "cloud_provider")]
    sets = rows.groupingSets([[c] for c in cols] + [[]], *cols).agg(
        _rows().alias("_n"), F.count_if(~F.col("is_resolved")).alias("_open"),
        F.grouping_id(*cols).alias("_set"))
    named = (F.when(F.col("_set") == 3, F.array(F.struct(
                F.lit("by_severity").alias("metric"), F.col("severity").alias("key"),
                F.col("_n").alias("n"))))
             .when(F.col("_set") == 5, F.array(F.struct(
                 F.lit("by_type").alias("metric"), F.col("alert_type").alias("key"),
                 F.col("_n").alias("n"))))
             .when(F.col("_set") == 6, F.array(F.struct(
                 F.lit("by_cloud").alias("metric"), F.col("cloud_provider").alias("key"),
                 F.col("_n").alias("n"))))
             .otherwise(F.array(
                 F.struct(F.lit("total").alias("metric"), F.lit("").alias("key"),
                          F.col("_n").alias("n")),
                 F.struct(F.lit("unresolved").alias("metric"), F.lit("").alias("key"),
                          F.col("_open").alias("n")))))
    seen = sets.select(F.inline(named))
    zeros = severity_list(alerts).select(F.lit("by_severity").alias("metric"),
                                         F.col("severity").alias("key"), F.lit(0).alias("n"))
    return seen.unionByName(zeros).groupBy("metric", "key").agg(F.sum("n").alias("n"))


def severity_list(df: DataFrame) -> DataFrame:
    levels = F.array(*map(F.lit, C.SEVERITY_LEVELS))
    return df.sparkSession.range(1).select(F.explode(levels).alias("severity"))


def unresolved_by_severity(alerts: DataFrame, start=None, end=None, cloud=None) -> DataFrame:
    """Open alerts per known severity, zero-filled; other severities are dropped."""
    rows = flt.equals(flt.date_range(alerts, "alert_date", start, end), cloud_provider=cloud)
    counts = rows.where(~F.col("is_resolved")).groupBy("severity").agg(_rows().alias("_n"))
    return (severity_list(alerts).join(counts, "severity", "left")
            .select("severity", F.coalesce("_n", F.lit(0)).alias("unresolved")))


def drivers_long(attributions: DataFrame, start=None, end=None, cloud=None) -> DataFrame:
    """The three driver column pairs as rows, from one scan."""
    rows = flt.equals(flt.date_range(attributions, "attribution_date", start, end),
                      cloud_provider=cloud)
    pairs = F.array(*[F.struct(F.col(f"top_driver_{i}").alias("driver"),
                               F.col(f"top_driver_{i}_value").alias("val")) for i in (1, 2, 3)])
    return rows.select("attribution_date", "cloud_provider", F.inline(pairs))


def top_drivers(attributions: DataFrame, start=None, end=None, cloud=None,
                top_n: int = 10) -> DataFrame:
    """Drivers by mean absolute value, with mean and appearance count."""
    rows = drivers_long(attributions, start, end, cloud).where(F.col("driver").isNotNull())
    return (rows.groupBy("driver").agg(F.avg("val").alias("avg_shap_value"),
                                       _rows().alias("appearance_count"),
                                       F.avg(F.abs("val")).alias("_rank"))
            .orderBy(F.col("_rank").desc_nulls_first(), "driver").limit(top_n).drop("_rank"))


def top_signed_drivers(attributions: DataFrame, n: int = 8, **scope) -> DataFrame:
    """Drivers by signed mean value."""
    rows = drivers_long(attributions, **scope).where(F.col("driver").isNotNull())
    return (rows.groupBy("driver").agg(F.avg("val").alias("avg_shap_value"))
            .orderBy(F.col("avg_shap_value").desc_nulls_first(), "driver").limit(n))


def group_top_driver(attributions: DataFrame) -> DataFrame:
    """Each group's top driver on its first day."""
    first = F.min_by("top_driver_1", F.struct("attribution_date", "account_id", "environment",
                                              "team"))
    return attributions.groupBy("cloud_provider", "service_category").agg(
        first.alias("top_driver"))


def detection_report(scored: DataFrame) -> DataFrame:
    """Rows, anomalies, rate and severe counts per cloud and service."""
    flagged = F.col("severity").isNotNull()
    return (scored.groupBy("cloud_provider", "service_category")
            .agg(_rows().alias("total_rows"), F.count_if(flagged).alias("anomalies"),
                 F.count_if(F.col("severity") == "critical").alias("critical"),
                 F.count_if(F.col("severity") == "high").alias("high"))
            .withColumn("rate_pct", F.col("anomalies") / F.col("total_rows") * 100))


def distinct_groups(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct().orderBy(*columns)


# --- labelled raw data -------------------------------------------------------

def dataset_stats(raw: DataFrame) -> DataFrame:
    edge = (F.coalesce("is_duplicate", F.lit(False)) | F.coalesce("is_backdated", F.lit(False))
            | (F.col("cost_usd") < 0))
    return raw.groupBy("cloud_provider").agg(
        _rows().alias("records"), F.count_if("is_anomaly").alias("anomalies"),
        F.count_if(edge).alias("edge_cases"))


def dataset_manifest(raw: DataFrame) -> DataFrame:
    return raw.agg(
        F.min("usage_date").alias("start"), F.max("usage_date").alias("end"),
        _rows().alias("total_records"),
        F.count_if("is_anomaly").alias("total_anomaly_records")).withColumn(
        "anomaly_rate_actual", F.col("total_anomaly_records")
        / F.greatest(F.lit(1), F.col("total_records")))


def daily_cost_by_cloud(raw: DataFrame, day: str = "usage_date") -> DataFrame:
    return raw.groupBy(day).pivot("cloud_provider", C.CLOUD_PROVIDERS).agg(F.sum("cost_usd"))


def monthly_cost_by_cloud(raw: DataFrame, day: str = "usage_date") -> DataFrame:
    month_end = F.last_day(F.col(day).cast("date")).alias("month_end")
    return raw.groupBy(month_end).pivot("cloud_provider", C.CLOUD_PROVIDERS).agg(
        F.sum("cost_usd"))


def monthly_spend_vs_budget(raw: DataFrame, day: str = "usage_date",
                            budgets: dict[str, float] | None = None) -> DataFrame:
    """Monthly spend beside the cloud's budget; the budget table has one row per cloud."""
    from costlens.functions.mapping import fixed_table
    table = fixed_table(raw.sparkSession, budgets or C.MONTHLY_BUDGET_USD,
                        "cloud_provider", "monthly_budget_usd")
    month_end = F.last_day(F.col(day).cast("date")).alias("month_end")
    spend = raw.groupBy(month_end, "cloud_provider").agg(F.sum("cost_usd").alias("spend_usd"))
    return (spend.join(F.broadcast(table), "cloud_provider", "left")
            .withColumn("over_budget", F.col("spend_usd") > F.col("monthly_budget_usd")))


def currency_by_day(raw: DataFrame, currencies: list[str], day: str = "usage_date") -> DataFrame:
    """Rows per day and currency, zero-filled; unlisted currencies go to `other`."""
    named = F.when(F.col("original_currency").isin(currencies),
                   F.col("original_currency")).otherwise("other")
    return (raw.withColumn("_cur", named).groupBy(day).pivot("_cur", [*currencies, "other"])
            .agg(_rows()).na.fill(0, [*currencies, "other"]))


def anomaly_dates(raw: DataFrame, day: str = "usage_date") -> DataFrame:
    return raw.where("is_anomaly").select(day).distinct()


def anomaly_type_frequency(raw: DataFrame) -> DataFrame:
    return (raw.where("is_anomaly").where("anomaly_type IS NOT NULL").groupBy("anomaly_type")
            .agg(_rows().alias("count")).orderBy(F.desc("count"), "anomaly_type"))


def tag_key_frequency(tagged: DataFrame, top: int = 20, tags: str = "tags") -> DataFrame:
    keys = tagged.select(F.explode(F.map_keys(tags)).alias("tag_key"))
    return (keys.groupBy("tag_key").agg(_rows().alias("count"))
            .orderBy(F.desc("count"), "tag_key").limit(top))


def edge_case_counts(raw: DataFrame) -> DataFrame:
    return raw.agg(F.count_if("is_duplicate").alias("duplicates"),
                   F.count_if("is_backdated").alias("backdated"),
                   F.count_if(F.col("cost_usd") < 0).alias("negative_cost"))


# --- overview ----------------------------------------------------------------

def kpi_row(billing: DataFrame, forecast_30d: DataFrame, anomalies: DataFrame,
            alerts: DataFrame, start=None, end=None) -> DataFrame:
    """Headline numbers on one row.

    Each part is an aggregate of one row, read as a scalar subquery of the spend
    row, so nothing is joined.
    """
    spend = flt.date_range(billing, "usage_date", start, end)
    found = flt.date_range(anomalies, "usage_date", start, end)
    per_cloud = spend.groupBy("cloud_provider").agg(F.sum("cost_usd").alias("_c"))
    by_cloud = per_cloud.agg(F.sum("_c").alias("total_spend"), F.map_from_entries(
        F.array_sort(F.collect_list(F.struct("cloud_provider", "_c")))).alias("by_cloud"))
    worst = found.groupBy("cloud_provider").agg(_rows().alias("_n")).agg(
        F.max_by("cloud_provider", F.struct(F.col("_n"), F.col("cloud_provider"))))
    opened = flt.date_range(alerts, "alert_date", start, end).where(~F.col("is_resolved"))
    return by_cloud.select(
        "total_spend", "by_cloud",
        forecast_30d.agg(F.sum("predicted_cost")).scalar().alias("forecast_30d"),
        found.agg(_rows()).scalar().alias("anomaly_count"),
        found.agg(F.count_if(F.col("severity") == "critical")).scalar().alias("critical_count"),
        found.agg(F.count_if(F.col("severity") == "high")).scalar().alias("high_count"),
        worst.scalar().alias("top_anomaly_cloud"),
        opened.agg(_rows()).scalar().alias("unresolved_alerts"))
