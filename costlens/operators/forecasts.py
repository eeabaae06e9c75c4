"""Queries over the forecast table: latest run, running totals, budget risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from costlens.functions import budget as bud
from costlens.operators import filters as flt, series


def _latest(rows: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each key's latest run.

    The run table is one row per key; joining on key and run keeps only the
    matching rows, without a window over a whole key.
    """
    last = runs.groupBy(*keys).agg(F.max("generated_at").alias("generated_at"))
    return rows.join(last, [*keys, "generated_at"])


def latest_forecast(forecasts: DataFrame, cloud=None, service=None, horizon: int = 30) -> DataFrame:
    """Latest run of each (cloud, service), summed per date."""
    rows = flt.equals(forecasts.where(F.col("horizon_days") <= horizon),
                      cloud_provider=cloud, service=service)
    runs = flt.equals(forecasts, cloud_provider=cloud, service=service)
    picked = _latest(rows, runs, ["cloud_provider", "service"])
    sums = picked.groupBy("forecast_date").agg(
        F.max("generated_at").alias("generated_at"),
        F.sum("predicted_cost").alias("predicted_cost"),
        F.sum("lower_bound").alias("lower_bound"), F.sum("upper_bound").alias("upper_bound"))
    day = F.col("forecast_date").cast("string")
    return sums.select(
        F.concat(F.lit("aggregated_"), day).alias("forecast_id"),
        F.coalesce(F.lit(cloud).cast("string"), F.lit("All Clouds")).alias("cloud_provider"),
        F.coalesce(F.lit(service).cast("string"), F.lit("All Services")).alias("service"),
        F.lit(None).cast("string").alias("region"), F.lit(horizon).alias("horizon_days"),
        "forecast_date", day.alias("forecast_date_display"),
        F.lit("ensemble").alias("model_used"), "generated_at",
        "predicted_cost", "lower_bound", "upper_bound").orderBy("forecast_date")


def risk_series(forecasts: DataFrame, cloud=None, horizon: int = 30) -> DataFrame:
    """Per-date forecast of the latest runs that the budget report adds up.

    For one cloud the latest run is found among horizons up to H; across clouds
    among rows of exactly H, while the sum still takes horizons up to H.
    """
    rows = forecasts.where(F.col("horizon_days") <= horizon)
    if flt.is_given(cloud):
        rows = rows.where(F.col("cloud_provider") == cloud)
        picked = _latest(rows, rows, ["service"])
    else:
        runs = forecasts.where(F.col("horizon_days") == horizon)
        picked = _latest(rows, runs, ["cloud_provider", "service"])
    return picked.groupBy("forecast_date").agg(
        *[F.sum(c).alias(c) for c in ("predicted_cost", "lower_bound", "upper_bound")])


def budget_risk(forecasts: DataFrame, as_of, cloud=None, budget: float = 50000.0,
                horizon: int = 30) -> DataFrame:
    """One row: projected cost, breach class, first breach date and days to it."""
    scope = F.lit(cloud if flt.is_given(cloud) else None).cast("string")
    daily = risk_series(forecasts, cloud, horizon).withColumn("_scope", F.lit(1))
    running = series.running_totals(daily, ["_scope"], "forecast_date",
                                    ["predicted_cost", "lower_bound", "upper_bound"])
    limit = F.lit(float(budget))
    row = running.agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("predicted_cost").alias("_p"), F.sum("lower_bound").alias("_l"),
        F.sum("upper_bound").alias("_u"),
        F.min(F.when(F.col("cum_upper_bound") >= limit, F.col("forecast_date"))).alias("_d"))
    empty = F.col("_n") == 0
    return row.select(
        scope.alias("cloud_provider"), limit.alias("monthly_budget_usd"),
        F.when(empty, F.lit(0.0)).otherwise(F.round("_p", 2)).alias("projected_monthly_cost"),
        F.when(empty, "none").otherwise(
            bud.breach_risk(F.col("_l"), F.col("_p"), F.col("_u"), limit)).alias("breach_risk"),
        F.col("_d").cast("string").alias("breach_date"),
        bud.days_to(F.col("_d"), F.lit(as_of).cast("date")).alias("days_to_breach"),
        F.when(empty, F.lit(0.0)).otherwise(F.lit(95.0)).alias("confidence_pct"),
        F.when(empty, "No forecast data available").alias("message"))


def projected_by_cloud(forecasts: DataFrame, start=None, end=None, cloud=None,
                       horizon: int = 30, model: str = "ensemble") -> DataFrame:
    rows = flt.equals(flt.date_range(forecasts, "forecast_date", start, end),
                      cloud_provider=cloud, model_used=model)
    return (flt.horizon_exactly(rows, horizon).groupBy("cloud_provider")
            .agg(F.sum("predicted_cost").alias("projected_cost")))


def forecast_input(features: DataFrame, start=None, end=None, cloud=None) -> DataFrame:
    """One row per (date, cloud, service): summed cost and averaged features."""
    rows = flt.equals(flt.date_range(features, "feature_date", start, end), cloud_provider=cloud)
    averaged = {"rolling_mean_7d": "rolling_mean_7d", "rolling_mean_30d": "rolling_mean_30d",
                "rolling_std_7d": "rolling_std_7d", "rolling_std_30d": "rolling_std_30d",
                "cost_lag_1d": "lag_1d", "cost_lag_7d": "lag_7d", "cost_lag_30d": "lag_30d",
                "pct_change_7d": "pct_change_7d", "day_of_week": "day_of_week"}
    return (rows.groupBy(F.col("feature_date").alias("usage_date"), "cloud_provider",
                         F.col("service_category").alias("service"))
            .agg(F.sum("total_cost_usd").alias("cost_usd"),
                 *[F.avg(c).alias(a) for c, a in averaged.items()],
                 F.max(F.col("is_weekend").cast("int")).alias("is_weekend"),
                 F.max(F.col("is_month_end").cast("int")).alias("is_month_end")))
