"""Filtered scans over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from costlens.operators import filters as flt
from costlens.schemas import ATTRIBUTIONS, DIMENSIONS

FEATURE_VALUES = [
    "total_cost_usd", "record_count", "cost_lag_1d", "cost_lag_7d", "cost_lag_30d",
    "rolling_mean_7d", "rolling_std_7d", "rolling_mean_30d", "rolling_std_30d",
    "pct_change_1d", "pct_change_7d", "pct_change_30d", "z_score_30d", "day_of_week",
    "day_of_month", "week_of_year", "month", "is_weekend", "is_month_start", "is_month_end",
]


def billing_records(billing: DataFrame, start, end, cloud=None, service=None, account=None,
                    environment=None, team=None, limit: int | None = None) -> DataFrame:
    """Rows in a range under up to five equality filters, newest first."""
    rows = flt.equals(flt.date_range(billing, "usage_date", start, end), cloud_provider=cloud,
                      service_category=service, account_id=account, environment=environment,
                      team=team)
    rows = rows.orderBy(F.col("usage_date").desc(), "record_id")
    return rows if limit is None else rows.limit(limit)


def daily_with_warmup(daily: DataFrame, start, end, cloud=None, days: int = 30) -> DataFrame:
    """Rollup rows from `days` before the start, so rolling features are warm."""
    first = F.date_sub(F.lit(start).cast("date"), days)
    rows = flt.equals(daily, cloud_provider=cloud).where(
        F.col("agg_date").between(first, F.lit(end).cast("date")))
    return rows.orderBy(*DIMENSIONS, "agg_date")


def features(table: DataFrame, start, end, cloud=None, service=None, account=None,
             min_z: float | None = None) -> DataFrame:
    rows = flt.equals(flt.date_range(table, "feature_date", start, end), cloud_provider=cloud,
                      service_category=service, account_id=account)
    return flt.min_abs(rows, "z_score_30d", min_z).orderBy(
        "feature_date", "cloud_provider", "service_category")


def feature_series(table: DataFrame, cloud: str, service: str, account: str, start,
                   end) -> DataFrame:
    rows = table.where((F.col("cloud_provider") == cloud) & (F.col("service_category") == service)
                       & (F.col("account_id") == account))
    return flt.date_range(rows, "feature_date", start, end).orderBy("feature_date")


def features_for_group(table: DataFrame, cloud: str, service: str, start, end) -> DataFrame:
    """One (cloud, service) group with its date named `usage_date`."""
    rows = table.where((F.col("cloud_provider") == cloud) & (F.col("service_category") == service))
    return flt.date_range(rows, "feature_date", start, end).select(
        F.col("feature_date").alias("usage_date"), "account_id", "environment", "team",
        *FEATURE_VALUES).orderBy("usage_date")


def anomalies(table: DataFrame, cloud=None, service=None, start=None, end=None,
              min_severity=None, limit: int | None = None) -> DataFrame:
    rows = flt.equals(flt.date_range(table, "usage_date", start, end), cloud_provider=cloud,
                      service=service)
    rows = flt.min_severity(rows, min_severity).orderBy(
        F.col("usage_date").desc(), F.col("ensemble_score").desc(), "anomaly_id")
    return rows if limit is None else rows.limit(limit)


def anomaly_list(table: DataFrame, start=None, end=None, clouds=None, severities=None,
                 method=None, service=None) -> DataFrame:
    """The listing columns; the table has no region, so it is NULL."""
    rows = flt.date_range(table, "usage_date", start, end)
    rows = flt.member(flt.member(rows, "cloud_provider", clouds), "severity", severities)
    return flt.equals(rows, detection_method=method, service=service).select(
        "anomaly_id", "record_id", "detection_method", "severity", "z_score", "expected_cost",
        "actual_cost", "deviation_pct", "detected_at", "cloud_provider", "service",
        F.lit(None).cast("string").alias("region"), "usage_date")


def anomaly_by_id(table: DataFrame, anomaly_id: str) -> DataFrame:
    return anomaly_list(table.where(F.col("anomaly_id") == anomaly_id))


def forecasts(table: DataFrame, cloud=None, service=None, horizon=None, start=None, end=None,
              model: str = "ensemble") -> DataFrame:
    rows = flt.equals(flt.date_range(table, "forecast_date", start, end), cloud_provider=cloud,
                      service=service).where(F.col("model_used") == model)
    return flt.horizon_exactly(rows, horizon).orderBy("forecast_date")


def forecast_list(table: DataFrame, clouds=None, service=None, horizon=None, model=None,
                  start=None, end=None) -> DataFrame:
    rows = flt.member(flt.date_range(table, "forecast_date", start, end), "cloud_provider", clouds)
    rows = flt.horizon_at_most(flt.equals(rows, service=service, model_used=model), horizon)
    return rows.withColumns({
        "forecast_date_display": F.col("forecast_date").cast("string"),
        "generated_at_display": F.col("generated_at").cast("string")})


def attributions(table: DataFrame, start=None, end=None, cloud=None, service=None,
                 driver=None) -> DataFrame:
    rows = flt.equals(flt.date_range(table, "attribution_date", start, end),
                      cloud_provider=cloud, service_category=service)
    return flt.any_of_columns(rows, driver, [f"top_driver_{i}" for i in (1, 2, 3)]).orderBy(
        F.col("attribution_date").desc())


def attribution_series(table: DataFrame, cloud: str, service: str, start=None,
                       end=None) -> DataFrame:
    """One group's attributions in date order, dates as text."""
    rows = flt.date_range(
        table.where((F.col("cloud_provider") == cloud) & (F.col("service_category") == service)),
        "attribution_date", start, end)
    kept = [f.name for f in ATTRIBUTIONS if f.name not in ("attribution_date", "feature_count",
                                                           "computed_at")]
    return rows.orderBy("attribution_date").select(
        F.col("attribution_date").cast("string").alias("attribution_date"),
        *[c for c in kept if c in table.columns])


def alerts(table: DataFrame, start=None, end=None, severity=None, cloud=None, alert_type=None,
           is_resolved: bool | None = None) -> DataFrame:
    rows = flt.equals(flt.date_range(table, "alert_date", start, end), severity=severity,
                      cloud_provider=cloud, alert_type=alert_type)
    return flt.tri_state(rows, "is_resolved", is_resolved)

