"""Rollups, spend queries, filters on them, paging (billing side)."""

from __future__ import annotations

from pyspark.sql import functions as F

from costlens.functions import calendar as cal
from costlens.operators import filters as flt, paging, rollup
from entries.base import entry, f32, rounded, s32
from entries.ctes import sql

A, Z = "1996-01-01", "2000-12-31"
RANGE = f"usage_date BETWEEN DATE '{A}' AND DATE '{Z}'"


@entry("ag1_daily_rollup", sql(f"""
    SELECT CAST(usage_date AS VARCHAR) AS agg_date, cloud_provider, service_category, account_id,
      coalesce(environment, 'unknown') AS environment, coalesce(team, 'unknown') AS team,
      round(sum(cost_usd), 2) AS total_cost_usd, count(*) AS record_count,
      {s32('avg(cost_usd)')} AS avg_cost_usd FROM bill GROUP BY ALL""", "bill"))
def _(b):
    return f32(rounded(rollup.daily_rollup(b.billing), 2, "total_cost_usd"), "avg_cost_usd")


@entry("ag2_regroup_daily", sql("""
    SELECT CAST(agg_date AS VARCHAR) AS agg_date, team, round(sum(total_cost_usd), 2) AS total_cost,
      CAST(sum(record_count) AS BIGINT) AS total_records FROM daily GROUP BY ALL""", "daily"))
def _(b):
    return rounded(rollup.regroup_daily(b.daily, group_by=("agg_date", "team", "bogus")), 2,
                   "total_cost")


@entry("ag3_spend_summary", sql(f"""
    SELECT environment, round(sum(cost_usd), 2) AS total_cost, count(*) AS record_count
    FROM bill WHERE {RANGE} GROUP BY ALL""", "bill"))
def _(b):
    return rounded(rollup.spend_summary(b.billing, A, Z, "environment"), 2, "total_cost")


@entry("ag4_record_count", sql(f"""
    SELECT count(*) AS record_count, count(*) FILTER (WHERE {RANGE}) AS in_range FROM bill""",
    "bill"))
def _(b):
    both = rollup.record_count(b.billing, A, Z).scalar()
    return rollup.record_count(b.billing, start=A).withColumn("in_range", both)


SUMMARY = f"""SELECT CAST(usage_date AS VARCHAR) AS usage_date, cloud_provider,
      service_category AS service, region, round(sum(cost_usd), 2) AS total_cost_usd,
      count(*) AS record_count, count(*) FILTER (WHERE anomaly_flag) AS anomaly_count
    FROM bill"""


@entry("ag5_billing_summary", sql(f"{SUMMARY} WHERE {RANGE} GROUP BY ALL", "bill"))
def _(b):
    return rounded(rollup.billing_summary(b.billing, A, Z), 2, "total_cost_usd")


@entry("ag6_date_bounds", sql("""
    SELECT CAST(min(usage_date) AS VARCHAR) AS min_date, CAST(max(usage_date) AS VARCHAR)
      AS max_date, '2023-01-01' AS empty_min, '2024-12-31' AS empty_max FROM bill""", "bill"))
def _(b):
    nothing = rollup.date_bounds(b.billing.where("usage_date < '1900-01-01'"))
    return rollup.date_bounds(b.billing).withColumns({
        "empty_min": nothing.select("min_date").scalar(),
        "empty_max": nothing.select("max_date").scalar()})


@entry("ag7_spend_by_cloud", sql(f"""
    SELECT cloud_provider AS dimension, round(sum(cost_usd), 2) AS total_cost_usd,
      {s32('sum(cost_usd) / nullif((SELECT sum(cost_usd) FROM bill), 0) * 100')} AS pct_of_total,
      count(*) AS record_count FROM bill GROUP BY 1""", "bill"))
def _(b):
    return f32(rounded(rollup.spend_by_cloud(b.billing), 2, "total_cost_usd"), "pct_of_total")


@entry("ag8_spend_by_service", sql(f"""
    SELECT service_category AS dimension, round(sum(cost_usd), 2) AS total_cost_usd,
      {s32('sum(cost_usd) / nullif((SELECT sum(cost_usd) FROM bill), 0) * 100')} AS pct_of_total,
      count(*) AS record_count FROM bill WHERE cloud_provider = 'aws'
    GROUP BY 1 ORDER BY sum(cost_usd) DESC LIMIT 3""", "bill"))
def _(b):
    top = rollup.spend_by_service(b.billing, cloud="aws", top_n=3)
    return f32(rounded(top, 2, "total_cost_usd"), "pct_of_total")


for _unit in ("day", "week", "month"):
    @entry(f"ag9_spend_trend_{_unit}", sql(f"""
        SELECT CAST(CAST(date_trunc('{_unit}', usage_date) AS DATE) AS VARCHAR) AS period,
          round(sum(cost_usd), 2) AS total_cost_usd, count(*) AS record_count
        FROM bill GROUP BY 1""", "bill"))
    def _(b, unit=_unit):
        return rounded(rollup.spend_trend(b.billing, granularity=unit), 2, "total_cost_usd")


@entry("li_spend_by_region", sql(f"""
    SELECT region, cloud_provider, round(sum(cost_usd), 4) AS total_cost_usd,
      count(*) AS record_count,
      {s32('sum(cost_usd) / nullif((SELECT sum(cost_usd) FROM lines), 0) * 100')} AS pct_of_total
    FROM lines GROUP BY ALL""", "lines"))
def _(b):
    """Shares at line grain, over the four-table join."""
    rows = b.billing_lines
    out = rows.groupBy("region", "cloud_provider").agg(
        F.sum("cost_usd").alias("total_cost_usd"), F.count(F.lit(1)).alias("record_count"))
    out = rollup.with_share(out, "total_cost_usd")
    return f32(rounded(out, 4, "total_cost_usd"), "pct_of_total")


# --- predicates ----------------------------------------------------------------

@entry("pf1_date_range", sql(f"""
    SELECT record_id, CAST(usage_date AS VARCHAR) AS usage_date FROM bill WHERE {RANGE}""", "bill"))
def _(b):
    inverted = flt.date_range(b.billing, "usage_date", Z, A)
    return flt.date_range(b.billing, "usage_date", A, Z).unionByName(inverted).select(
        "record_id", "usage_date")


@entry("pf2_optional_equality", sql("""
    SELECT record_id, cost_usd FROM bill WHERE cloud_provider = 'gcp' AND team = 'growth'""",
    "bill"))
def _(b):
    return flt.equals(b.billing, cloud_provider="gcp", team="growth", environment=None,
                      account_id="").select("record_id", "cost_usd")


@entry("pf3_membership", sql("""
    SELECT anomaly_id FROM anom WHERE cloud_provider IN ('aws', 'gcp')
      AND severity IN ('high', 'critical')""", "anom"))
def _(b):
    rows = flt.member(b.anomalies, "cloud_provider", ["aws", "gcp"])
    return flt.member(rows, "severity", ["high", "critical"]).select("anomaly_id")


@entry("pf4_all_sentinel", sql("""
    SELECT alert_id FROM alert WHERE severity = 'high'""", "alert"))
def _(b):
    return flt.equals(b.alerts, cloud_provider="all", alert_type="All", severity="high").select(
        "alert_id")


@entry("pf5_min_severity", sql("""
    SELECT anomaly_id, severity FROM anom WHERE ensemble_score >= 0.7""", "anom"))
def _(b):
    return flt.min_severity(b.anomalies, "high").select("anomaly_id", "severity")


@entry("pf6_min_abs_z", sql("""
    SELECT CAST(feature_date AS VARCHAR) AS feature_date, account_id, environment, team,
      cloud_provider, service_category FROM feat WHERE abs(z_score_30d) >= 2""", "feat"))
def _(b):
    return flt.min_abs(b.features, "z_score_30d", 2.0).select(
        "feature_date", "account_id", "environment", "team", "cloud_provider",
        "service_category")


@entry("pf7_abs_change", sql("""
    SELECT cloud_provider, service_category, count(*) AS n FROM feat
    WHERE abs(pct_change_1d) > 0.5 GROUP BY ALL""", "feat"))
def _(b):
    return flt.abs_above(b.features, "pct_change_1d", 0.5).groupBy(
        "cloud_provider", "service_category").agg(F.count(F.lit(1)).alias("n"))


@entry("pf8_any_driver", sql("""
    SELECT cloud_provider, service_category, count(*) AS n FROM attr
    WHERE 'month' IN (top_driver_1, top_driver_2, top_driver_3) GROUP BY ALL""", "attr"))
def _(b):
    cols = [f"top_driver_{i}" for i in (1, 2, 3)]
    return flt.any_of_columns(b.attributions, "month", cols).groupBy(
        "cloud_provider", "service_category").agg(F.count(F.lit(1)).alias("n"))


@entry("pf9_horizon", sql("""
    SELECT cloud_provider, count(*) FILTER (WHERE horizon_days <= 30) AS at_most,
      count(*) FILTER (WHERE horizon_days = 30) AS exactly FROM fcst GROUP BY 1""", "fcst"))
def _(b):
    def counts(rows, name):
        return rows.groupBy("cloud_provider").agg(F.count(F.lit(1)).alias(name))
    f = b.forecasts
    return counts(flt.horizon_at_most(f, 30), "at_most").join(
        counts(flt.horizon_exactly(f, 30), "exactly"), "cloud_provider", "full_outer")


@entry("pf10_one_sided", sql("""
    SELECT alert_id FROM alert WHERE alert_date >= DATE '2024-01-20'
    UNION ALL SELECT alert_id FROM alert WHERE alert_date <= DATE '2024-01-03'""", "alert"))
def _(b):
    late = flt.date_range(b.alerts, "alert_date", start="2024-01-20")
    return late.unionByName(flt.date_range(b.alerts, "alert_date", end="2024-01-03")).select(
        "alert_id")


@entry("pf11_tri_state", sql("""
    SELECT 'any' AS wanted, count(*) AS n FROM alert
    UNION ALL SELECT 'yes', count(*) FROM alert WHERE is_resolved
    UNION ALL SELECT 'no', count(*) FROM alert WHERE NOT is_resolved""", "alert"))
def _(b):
    parts = [flt.tri_state(b.alerts, "is_resolved", v).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(name).alias("wanted"), "n") for name, v in
        (("any", None), ("yes", True), ("no", False))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@entry("pf13_rename_constant_null", sql("""
    SELECT record_id AS id, service_category AS service, 'ensemble' AS model_used,
      CAST(NULL AS VARCHAR) AS region FROM bill""", "bill"))
def _(b):
    return b.billing.select(F.col("record_id").alias("id"),
                            F.col("service_category").alias("service"),
                            F.lit("ensemble").alias("model_used"),
                            F.lit(None).cast("string").alias("region"))


@entry("pf14_dates_as_text", sql("""
    SELECT alert_id, CAST(alert_date AS VARCHAR) AS alert_date,
      strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM alert""", "alert"))
def _(b):
    return b.alerts.select("alert_id", F.col("alert_date").cast("string").alias("alert_date"),
                           F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@entry("pf15_unknown_dimensions", sql("""
    SELECT coalesce(environment, 'unknown') AS environment, coalesce(team, 'unknown') AS team,
      count(*) AS n FROM bill GROUP BY ALL""", "bill"))
def _(b):
    return flt.unknown_dimensions(b.billing, "environment", "team").groupBy(
        "environment", "team").agg(F.count(F.lit(1)).alias("n"))


@entry("pf16_group_by_whitelist", sql("""
    SELECT cloud_provider, round(sum(cost_usd), 2) AS total_cost, count(*) AS record_count
    FROM bill GROUP BY 1""", "bill"))
def _(b):
    return rounded(rollup.spend_summary(b.billing, group_by="cost_usd; drop table"), 2,
                   "total_cost")


@entry("pf17_granularity_whitelist", sql("""
    SELECT CAST(usage_date AS VARCHAR) AS period, round(sum(cost_usd), 2) AS total_cost_usd,
      count(*) AS record_count FROM bill GROUP BY 1""", "bill"))
def _(b):
    return rounded(rollup.spend_trend(b.billing, granularity="fortnight"), 2, "total_cost_usd")


@entry("pf23_default_window", sql("""
    SELECT record_id, CAST(usage_date AS VARCHAR) AS usage_date FROM bill
    WHERE usage_date BETWEEN (SELECT max(usage_date) FROM bill) - INTERVAL 365 DAY
      AND (SELECT max(usage_date) FROM bill)""", "bill"))
def _(b):
    return flt.default_window(b.billing, "usage_date").select("record_id", "usage_date")


# --- ordering and paging ---------------------------------------------------------

@entry("tk1_newest", sql("""
    SELECT anomaly_id, strftime(detected_at, '%Y-%m-%d %H:%M:%S') AS detected_at FROM anom
    ORDER BY anom.detected_at DESC, anomaly_id LIMIT 50""", "anom"))
def _(b):
    return paging.newest(b.anomalies, "detected_at", 50, "anomaly_id").select(
        "anomaly_id", "detected_at")


@entry("tk2_page", sql(f"""
    SELECT *, (SELECT count(*) FROM s) AS total, (SELECT count(*) FROM s) > 60 AS has_next
    FROM s ORDER BY usage_date DESC, cloud_provider, service, region LIMIT 20 OFFSET 40""",
    "bill", s=f"{SUMMARY} GROUP BY ALL"))
def _(b):
    rows = rounded(rollup.billing_summary(b.billing), 2, "total_cost_usd")
    order = [F.col("usage_date").desc(), F.col("cloud_provider"), F.col("service"),
             F.col("region")]
    return paging.page(rows, order, page=3, page_size=20)


@entry("tk2_page_after_key", sql("""
    SELECT record_id FROM bill WHERE record_id > '5' ORDER BY record_id LIMIT 50""", "bill"))
def _(b):
    return paging.page_after(b.billing, "record_id", "5", 50).select("record_id")


@entry("tk3_top_services", sql("""
    SELECT service_category, round(sum(cost_usd), 2) AS total_cost FROM bill GROUP BY 1
    ORDER BY 2 DESC LIMIT 2""", "bill"))
def _(b):
    rows = rounded(rollup.spend_summary(b.billing, group_by="service_category"), 2, "total_cost")
    return paging.top_n(rows, F.col("total_cost"), 2).select("service_category", "total_cost")


@entry("tk5_top_abs_z", sql(f"""
    SELECT CAST(feature_date AS VARCHAR) AS feature_date, cloud_provider, service_category,
      account_id, environment, team, {s32('z_score_30d')} AS z_score_30d FROM feat
    WHERE abs(z_score_30d) >= 2 ORDER BY abs(z_score_30d) DESC LIMIT 5""", "feat"))
def _(b):
    rows = flt.min_abs(b.features, "z_score_30d", 2.0)
    return f32(paging.top_n(rows, F.abs("z_score_30d"), 5, "feature_date").select(
        "feature_date", "cloud_provider", "service_category", "account_id", "environment",
        "team", "z_score_30d"), "z_score_30d")


@entry("tk8_multi_key_order", sql("""
    SELECT record_id, environment, cost_usd FROM bill
    ORDER BY environment ASC NULLS LAST, cost_usd DESC NULLS FIRST, record_id""", "bill"))
def _(b):
    return paging.multi_key_order(b.billing, ("environment", True), ("cost_usd", False),
                                  ("record_id", True)).select(
        "record_id", "environment", "cost_usd")


@entry("fn13_truncate_dates", sql("""
    SELECT CAST(CAST(date_trunc('day', usage_date) AS DATE) AS VARCHAR) AS d,
      CAST(CAST(date_trunc('week', usage_date) AS DATE) AS VARCHAR) AS w,
      CAST(CAST(date_trunc('month', usage_date) AS DATE) AS VARCHAR) AS m, count(*) AS n
    FROM bill GROUP BY ALL""", "bill"))
def _(b):
    day = F.col("usage_date")
    return b.billing.groupBy(cal.truncate(day, "day").alias("d"),
                             cal.truncate(day, "week").alias("w"),
                             cal.truncate(day, "month").alias("m")).agg(
        F.count(F.lit(1)).alias("n"))
