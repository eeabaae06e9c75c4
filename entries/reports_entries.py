"""Anomaly, alert, attribution and dataset reports, alert rules, data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from costlens import constants as C
from costlens.functions import tags as tg
from costlens.operators import forecasts as fq, quality as dq, reports, rollup
from costlens.plans import alerts as al, detect, normalise as nm
from costlens.schemas import FEATURE_KEY, RAW_BILLING
from entries.base import entry, f32, rounded, s32
from entries.ctes import DIMS, sql


for _n, _c in (("ag10_by_severity", "severity"), ("ag11_by_cloud", "cloud_provider"),
               ("ag12_by_method", "detection_method")):
    @entry(_n, sql(f"SELECT {_c}, count(*) AS count FROM anom GROUP BY 1", "anom"))
    def _(b, column=_c):
        return reports.count_by(b.anomalies, column)


@entry("ag13_anomaly_summary", sql("""
    SELECT 'by_severity' AS metric, severity AS key, count(*) AS n FROM anom
    GROUP BY ALL UNION ALL SELECT 'by_cloud', cloud_provider, count(*) FROM anom
    GROUP BY ALL UNION ALL SELECT 'by_type', detection_method, count(*) FROM anom
    GROUP BY ALL UNION ALL SELECT 'total', '', count(*) FROM anom""", "anom"))
def _(b):
    row = reports.anomaly_summary(b.anomalies)
    maps = [row.select(F.lit(m).alias("metric"), F.explode(m).alias("key", "n"))
            for m in ("by_severity", "by_cloud", "by_type")]
    total = row.select(F.lit("total").alias("metric"), F.lit("").alias("key"),
                       F.col("total_anomalies").alias("n"))
    return maps[0].unionByName(maps[1]).unionByName(maps[2]).unionByName(total)


@entry("ag14_alert_summary", sql("""
    SELECT 'total' AS metric, '' AS key, count(*) AS n FROM alert
    UNION ALL SELECT 'unresolved', '', count(*) FILTER (WHERE NOT is_resolved) FROM alert
    UNION ALL SELECT 'by_severity', severity, count(*) FROM alert GROUP BY ALL
    UNION ALL SELECT 'by_type', alert_type, count(*) FROM alert GROUP BY ALL
    UNION ALL SELECT 'by_cloud', cloud_provider, count(*) FROM alert GROUP BY ALL""", "alert"))
def _(b):
    return reports.alert_summary(b.alerts)


@entry("ag15_unresolved_by_severity", sql("""
    SELECT s AS severity, (SELECT count(*) FROM alert WHERE severity = s AND NOT is_resolved)
      AS unresolved
    FROM (SELECT unnest(['low', 'medium', 'high', 'critical']) AS s)""", "alert"))
def _(b):
    return reports.unresolved_by_severity(b.alerts)


@entry("ag17_projected_by_cloud", sql("""
    SELECT cloud_provider, round(sum(predicted_cost), 2) AS projected_cost FROM fcst
    WHERE horizon_days = 30 AND model_used = 'ensemble' GROUP BY 1""", "fcst"))
def _(b):
    return rounded(fq.projected_by_cloud(b.forecasts), 2, "projected_cost")


@entry("ag18_forecast_sums", sql("""
    SELECT CAST(forecast_date AS VARCHAR) AS forecast_date, round(sum(predicted_cost), 2)
      AS predicted_cost, round(sum(lower_bound), 3) AS lower_bound,
      round(sum(upper_bound), 3) AS upper_bound,
      strftime(max(generated_at), '%Y-%m-%d %H:%M:%S') AS generated_at FROM fcst GROUP BY 1""",
    "fcst"))
def _(b):
    rows = b.forecasts.groupBy("forecast_date").agg(
        F.max("generated_at").alias("generated_at"),
        *[F.sum(c).alias(c) for c in ("predicted_cost", "lower_bound", "upper_bound")])
    return rounded(rounded(rows, 2, "predicted_cost"), 3, "lower_bound", "upper_bound")


LONG = """SELECT attribution_date, cloud_provider, top_driver_1 AS driver, top_driver_1_value
    AS val FROM attr UNION ALL SELECT attribution_date, cloud_provider, top_driver_2,
    top_driver_2_value FROM attr UNION ALL SELECT attribution_date, cloud_provider, top_driver_3,
    top_driver_3_value FROM attr"""


@entry("st1_drivers_long", sql("""
    SELECT cloud_provider, driver, count(*) AS n FROM d GROUP BY ALL""", "attr", d=LONG))
def _(b):
    return reports.drivers_long(b.attributions).groupBy("cloud_provider", "driver").agg(
        F.count(F.lit(1)).alias("n"))


@entry("ag19_top_drivers", sql(f"""
    SELECT driver, {s32('avg(val)')} AS avg_shap_value, count(*) AS appearance_count FROM d
    WHERE driver IS NOT NULL GROUP BY 1 ORDER BY avg(abs(val)) DESC LIMIT 10""", "attr", d=LONG))
def _(b):
    return f32(reports.top_drivers(b.attributions), "avg_shap_value")


@entry("tk4_top_three_drivers", sql("""
    SELECT driver, count(*) AS appearance_count FROM d WHERE cloud_provider = 'aws' GROUP BY 1
    ORDER BY avg(abs(val)) DESC LIMIT 3""", "attr", d=LONG))
def _(b):
    return reports.top_drivers(b.attributions, cloud="aws", top_n=3).drop("avg_shap_value")


@entry("tk6_top_signed_drivers", sql(f"""
    SELECT driver, {s32('avg(val)')} AS avg_shap_value FROM d GROUP BY 1
    ORDER BY avg(val) DESC LIMIT 8""", "attr", d=LONG))
def _(b):
    return f32(reports.top_signed_drivers(b.attributions), "avg_shap_value")


@entry("ag20_detection_report", sql(f"""
    SELECT cloud_provider, service_category, count(*) AS total_rows, count(severity) AS anomalies,
      count(*) FILTER (WHERE severity = 'critical') AS critical,
      count(*) FILTER (WHERE severity = 'high') AS high,
      {s32('count(severity) / count(*) * 100')} AS rate_pct FROM found GROUP BY ALL""", "found"))
def _(b):
    scored = detect.combine(detect.ZScore().score(b.features))
    return f32(reports.detection_report(scored), "rate_pct")


@entry("ag22_distinct_groups", sql("""
    SELECT DISTINCT cloud_provider, service_category FROM bill""", "bill"))
def _(b):
    return reports.distinct_groups(b.billing, "cloud_provider", "service_category")


@entry("ag28_run_metrics", sql("""
    SELECT count(*) AS input_count, count(DISTINCT fingerprint) AS output_count,
      count(*) - count(DISTINCT fingerprint) AS duplicate_count, 0 AS error_count FROM enriched""",
    "enriched"))
def _(b):
    return nm.run(b.raw_billing).metrics


@entry("ag29_dataset_stats", sql("""
    SELECT cloud_provider, count(*) AS records, count(*) FILTER (WHERE is_anomaly) AS anomalies,
      count(*) FILTER (WHERE is_duplicate OR is_backdated OR cost_usd < 0) AS edge_cases
    FROM raw GROUP BY 1""", "raw"))
def _(b):
    return reports.dataset_stats(b.raw_billing)


def _pivot(date: str, name: str) -> str:
    return f"SELECT {date} AS {name}, " + ", ".join(
        f"round(sum(cost_usd) FILTER (WHERE cloud_provider = '{c}'), 2) AS {c}"
        for c in C.CLOUD_PROVIDERS)


@entry("ag30_daily_by_cloud", sql(
    _pivot("usage_date", "usage_date") + " FROM raw GROUP BY 1", "raw"))
def _(b):
    return rounded(reports.daily_cost_by_cloud(b.raw_billing), 2, *C.CLOUD_PROVIDERS)


@entry("ag31_anomaly_dates", sql("SELECT DISTINCT usage_date FROM raw WHERE is_anomaly", "raw"))
def _(b):
    return reports.anomaly_dates(b.raw_billing)


@entry("ag33_anomaly_types", sql("""
    SELECT anomaly_type, count(*) AS count FROM raw WHERE is_anomaly GROUP BY 1""", "raw"))
def _(b):
    return reports.anomaly_type_frequency(b.raw_billing)


@entry("ag34_tag_keys", sql("""
    SELECT tag_key, count(*) AS count FROM (SELECT unnest(json_keys(tags)) AS tag_key FROM raw
      WHERE json_valid(tags)) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""", "raw"))
def _(b):
    rows = b.raw_billing.select(tg.parse_tags(F.col("tags")).alias("tags"))
    return reports.tag_key_frequency(rows)


@entry("ag35_edge_cases", sql("""
    SELECT count(*) FILTER (WHERE is_duplicate) AS duplicates, count(*) FILTER (WHERE
      is_backdated) AS backdated, count(*) FILTER (WHERE cost_usd < 0) AS negative_cost FROM raw""",
    "raw"))
def _(b):
    return reports.edge_case_counts(b.raw_billing)


@entry("ag36_monthly_by_cloud", sql(
    _pivot("CAST(last_day(usage_date) AS VARCHAR)", "month_end") + " FROM bill GROUP BY 1",
    "bill"))
def _(b):
    return rounded(reports.monthly_cost_by_cloud(b.billing), 2, *C.CLOUD_PROVIDERS)


@entry("jn13_spend_vs_budget", sql("""
    SELECT *, spend_usd > monthly_budget_usd AS over_budget FROM (
      SELECT cloud_provider, CAST(last_day(usage_date) AS VARCHAR) AS month_end,
        round(sum(cost_usd), 2) AS spend_usd, CASE cloud_provider WHEN 'aws' THEN 180000.0::DOUBLE
        WHEN 'azure' THEN 160000.0::DOUBLE ELSE 140000.0::DOUBLE END AS monthly_budget_usd
      FROM bill GROUP BY ALL)""", "bill"))
def _(b):
    return rounded(reports.monthly_spend_vs_budget(b.billing), 2, "spend_usd")


@entry("ag37_currency_by_day", sql(
    "SELECT usage_date, " + ", ".join(
        f"count(*) FILTER (WHERE original_currency = '{c}') AS \"{c}\"" for c in C.FX_RATES)
    + ", count(*) FILTER (WHERE original_currency = 'CNY') AS other FROM raw GROUP BY 1", "raw"))
def _(b):
    return reports.currency_by_day(b.raw_billing, list(C.FX_RATES))


@entry("ag38_kpi_row", sql("""
    SELECT round((SELECT sum(cost_usd) FROM raw), 2) AS total_spend,
      round((SELECT sum(cost_usd) FROM raw WHERE cloud_provider = 'aws'), 2) AS aws_spend,
      round((SELECT sum(predicted_cost) FROM l WHERE horizon_days <= 30), 2) AS forecast_30d,
      count(*) AS anomaly_count, count(*) FILTER (WHERE severity = 'critical') AS critical_count,
      count(*) FILTER (WHERE severity = 'high') AS high_count,
      (SELECT cloud_provider FROM anom GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)
        AS top_anomaly_cloud,
      (SELECT count(*) FROM alert WHERE NOT is_resolved) AS unresolved_alerts FROM anom""",
    "raw", "anom", "alert", "fcst", l="""SELECT f.* FROM fcst f JOIN (SELECT cloud_provider,
      service, max(generated_at) AS generated_at FROM fcst GROUP BY ALL)
      USING (cloud_provider, service, generated_at)"""))
def _(b):
    row = reports.kpi_row(b.raw_billing, fq.latest_forecast(b.forecasts), b.anomalies, b.alerts)
    aws = F.try_element_at("by_cloud", F.lit("aws"))
    return rounded(row.withColumn("aws_spend", aws).drop("by_cloud"), 2, "total_spend",
                   "aws_spend", "forecast_30d")


@entry("ag39_group_top_driver", sql(f"""
    SELECT cloud_provider, service_category, arg_min(top_driver_1, CAST(attribution_date AS
      VARCHAR) || '|' || account_id || '|' || environment || '|' || team) AS top_driver
    FROM attr GROUP BY ALL""", "attr"))
def _(b):
    return reports.group_top_driver(b.attributions)


# --- detection and alerts ------------------------------------------------------------

@entry("ml1_zscore_detector", sql(f"""
    SELECT CAST(feature_date AS VARCHAR) AS feature_date, {DIMS}, {s32('ensemble_score')}
      AS zscore_score, {s32('''CASE WHEN rolling_mean_30d > 0 THEN
      (total_cost_usd - rolling_mean_30d) / rolling_mean_30d * 100 ELSE 0 END''')} AS deviation_pct
    FROM scored""", "scored"))
def _(b):
    scored = detect.ZScore().score(b.features)
    # at single precision a cost equal to its mean leaves only rounding noise
    return f32(scored.select(*FEATURE_KEY, "zscore_score", "deviation_pct"), "zscore_score",
               "deviation_pct")


@entry("ml4_ensemble_anomalies", sql(f"""
    SELECT cloud_provider || '_' || service_category || '_' || account_id || '_' ||
      CAST(feature_date AS VARCHAR) AS record_id, severity, {s32('ensemble_score')}
      AS ensemble_score, total_cost_usd AS actual_cost, {s32('expected_cost')} AS expected_cost,
      sha256(concat_ws('|', CAST(feature_date AS VARCHAR), {DIMS})) AS anomaly_id
    FROM found WHERE severity IS NOT NULL""", "found"))
def _(b):
    scored = detect.combine(detect.ZScore().score(b.features))
    out = detect.to_anomalies(scored, F.current_timestamp())
    return f32(out.select("record_id", "severity", "ensemble_score", "actual_cost",
                          "expected_cost", "anomaly_id"), "ensemble_score", "expected_cost")


@entry("al1_anomaly_alerts", sql("""
    SELECT sha256(concat_ws('|', 'anomaly_detected', cloud_provider, service,
      CAST(usage_date AS VARCHAR))) AS alert_id, severity, account_id, 'Anomaly: ' || service ||
      ' spend ' || CASE WHEN deviation_pct < 0 THEN 'drop' ELSE 'spike' END || ' on ' ||
      CAST(usage_date AS VARCHAR) AS title, deviation_pct AS meta_deviation FROM anom""", "anom"))
def _(b):
    out = al.from_anomalies(b.anomalies, F.current_timestamp())
    return out.select("alert_id", "severity", "account_id", "title", F.get_json_object(
        "metadata", "$.deviation_pct").cast("double").alias("meta_deviation"))


SPIKES = """SELECT *, abs(pct_change_1d * 100) AS p, CASE WHEN abs(pct_change_1d * 100) > 100
    THEN 'high' ELSE 'medium' END AS severity FROM feat WHERE abs(pct_change_1d * 100) > 50"""


@entry("al2_spike_alerts", sql("""
    SELECT CAST(feature_date AS VARCHAR) AS alert_date, cloud_provider, service_category,
      account_id, severity, count(*) AS n FROM s GROUP BY ALL""", "feat", s=SPIKES))
def _(b):
    return al.from_spikes(b.features, F.current_timestamp()).groupBy(
        "alert_date", "cloud_provider", "service_category", "account_id", "severity").agg(
        F.count(F.lit(1)).alias("n"))


BUDGET = """SELECT cloud_provider, p / 3e8 * 100 AS pct FROM (SELECT cloud_provider,
    sum(predicted_cost) AS p FROM fcst WHERE horizon_days = 30 AND model_used = 'ensemble'
    GROUP BY 1) WHERE p / 3e8 * 100 >= 85"""


@entry("al3_budget_alerts", sql("""
    SELECT cloud_provider, CASE WHEN pct >= 100 THEN 'critical' ELSE 'high' END AS severity,
      CASE WHEN pct >= 100 THEN cloud_provider || ' budget breach projected by end of month'
      ELSE cloud_provider || ' budget at ' || printf('%.0f', pct) || '% - breach risk' END
      AS title, '1998-07-01' AS alert_date FROM g""", "fcst", g=BUDGET))
def _(b):
    out = al.from_budget(fq.projected_by_cloud(b.forecasts), 3e8,
                         F.to_date(F.lit("1998-07-01")), F.current_timestamp())
    return out.select("cloud_provider", "severity", "title", "alert_date")


CANDIDATES = f"""SELECT 'anomaly_detected' AS alert_type, cloud_provider, service
      AS service_category, usage_date AS alert_date FROM anom
    UNION ALL SELECT 'spend_spike', cloud_provider, service_category, feature_date FROM s
    UNION ALL SELECT 'budget_breach_imminent', cloud_provider, NULL, DATE '1998-07-01' FROM g"""


@entry("st4_alert_candidates", sql("""
    SELECT alert_type, cloud_provider, count(*) AS n FROM c GROUP BY ALL""", "anom", "feat",
    "fcst", s=SPIKES, g=BUDGET, c=CANDIDATES))
def _(b):
    rows = al.candidates(b.anomalies, b.features, b.forecasts, None, None, "1998-07-01",
                         F.current_timestamp(), budget=3e8)
    return rows.groupBy("alert_type", "cloud_provider").agg(F.count(F.lit(1)).alias("n"))


@entry("wn15_first_alert_wins", sql("""
    SELECT alert_type, cloud_provider, service_category, CAST(alert_date AS VARCHAR) AS alert_date,
      max(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3
        WHEN 'critical' THEN 4 ELSE 0 END) AS rank FROM alert GROUP BY ALL""", "alert"))
def _(b):
    from costlens.functions.scoring import severity_rank
    once = al.new_alerts(b.alerts, b.alerts.where(F.lit(False)))
    return once.select(*al.LOGICAL_KEY, severity_rank(F.col("severity")).alias("rank"))


@entry("al4_alert_job", sql("""
    SELECT alert_type, cloud_provider, count(*) AS stored, (SELECT count(*) FROM k) AS inserted,
      (SELECT count(*) FROM c) - (SELECT count(*) FROM k) AS skipped, 0 AS inserted_again
    FROM k GROUP BY ALL""", "anom", "feat", "fcst", s=SPIKES, g=BUDGET, c=CANDIDATES,
    k="SELECT DISTINCT * FROM c"))
def _(b):
    from costlens.operators import tables
    root = b.root("al4")
    tables.merge(b.anomalies, root, "anomalies")
    tables.merge(b.features, root, "spend_features")
    tables.merge(b.forecasts.withColumn("forecast_id", F.lit("f")), root, "forecasts")
    span = ("1995-01-01", "2024-12-31", "1998-07-01", F.current_timestamp())
    first = al.run(b.spark, root, *span, budget=3e8)
    again = al.run(b.spark, root, *span, budget=3e8)
    stored = tables.scan(b.spark, root, "alerts").groupBy("alert_type", "cloud_provider").agg(
        F.count(F.lit(1)).alias("stored"))
    return stored.withColumns({
        "inserted": first.select("total_inserted").scalar(),
        "skipped": first.select("total_skipped").scalar(),
        "inserted_again": again.select("total_inserted").scalar()})


RISK = """SELECT forecast_date, sum(predicted_cost) AS p, sum(lower_bound) AS l,
    sum(upper_bound) AS u FROM fcst f JOIN (SELECT cloud_provider, service, max(generated_at)
    AS generated_at FROM fcst WHERE {runs} GROUP BY ALL)
    USING (cloud_provider, service, generated_at) WHERE horizon_days <= 30 AND {rows} GROUP BY 1"""


def _risk_sql(cloud: str, budget: str, runs: str, rows: str) -> str:
    return sql(f"""
        SELECT {cloud} AS cloud_provider, {budget}::DOUBLE AS monthly_budget_usd,
          round(sum(p), 2) AS projected_monthly_cost, CASE WHEN sum(u) < {budget} THEN 'none'
          WHEN sum(l) < {budget} AND {budget} <= sum(p) THEN 'possible'
          WHEN sum(p) < {budget} AND {budget} <= sum(u) THEN 'likely' ELSE 'certain' END
          AS breach_risk, CAST(min(forecast_date) FILTER (WHERE c >= {budget}) AS VARCHAR)
          AS breach_date, CAST(min(forecast_date) FILTER (WHERE c >= {budget}) -
          DATE '2001-06-30' AS INTEGER) AS days_to_breach, 95.0::DOUBLE AS confidence_pct,
          CAST(NULL AS VARCHAR) AS message
        FROM (SELECT *, sum(u) OVER (ORDER BY forecast_date) AS c FROM r)""",
        "fcst", r=RISK.format(runs=runs, rows=rows))


@entry("al5_budget_risk", _risk_sql("CAST(NULL AS VARCHAR)", "20000000", "horizon_days = 30",
                                    "true"))
def _(b):
    return fq.budget_risk(b.forecasts, "2001-06-30", budget=20000000.0)


@entry("al5_budget_risk_one_cloud", _risk_sql(
    "'aws'", "5000000", "cloud_provider = 'aws' AND horizon_days <= 30",
    "cloud_provider = 'aws'"))
def _(b):
    return fq.budget_risk(b.forecasts, "2001-06-30", cloud="aws", budget=5000000.0)


@entry("al6_rule_table", sql("""
    SELECT 'r-' || cloud_provider || '-' || service AS rule_id, 'budget_absolute' AS rule_type,
      cloud_provider, service AS service_category, round(actual, 2) AS value FROM m
    WHERE actual > limit_usd
    UNION ALL SELECT 'c-' || cloud_provider, 'forecast_variance', cloud_provider, NULL,
      round((sum(predicted) - sum(actual)) / sum(actual) * 100, 2) FROM m
    GROUP BY cloud_provider HAVING (sum(predicted) - sum(actual)) / sum(actual) * 100 > -50""",
    "bill", "fcst", m="""SELECT *, (SELECT avg(cost) FROM (SELECT sum(cost_usd) AS cost FROM bill
      GROUP BY cloud_provider, service_category)) AS limit_usd FROM (SELECT cloud_provider,
      service_category AS service, sum(cost_usd) AS actual FROM bill GROUP BY ALL) JOIN (
      SELECT cloud_provider, service, sum(predicted_cost) AS predicted FROM fcst
      WHERE horizon_days <= 30 GROUP BY ALL) USING (cloud_provider, service)"""))
def _(b):
    spend = b.billing.groupBy("cloud_provider", "service_category").agg(
        F.sum("cost_usd").alias("actual"))
    predicted = b.forecasts.where("horizon_days <= 30").groupBy(
        "cloud_provider", F.col("service").alias("service_category")).agg(
        F.sum("predicted_cost").alias("predicted"))
    limit = spend.agg(F.avg("actual")).scalar()
    scopes = spend.select("cloud_provider", "service_category")
    rules = scopes.select(
        F.concat_ws("-", F.lit("r"), "cloud_provider", "service_category").alias("rule_id"),
        F.lit("spend").alias("name"), F.lit("budget_absolute").alias("rule_type"),
        "cloud_provider", "service_category", limit.alias("threshold_value"),
        F.lit("high").alias("severity"), F.lit(True).alias("is_active"))
    variance = scopes.select("cloud_provider").distinct().select(
        F.concat_ws("-", F.lit("c"), "cloud_provider").alias("rule_id"),
        F.lit("variance").alias("name"), F.lit("forecast_variance").alias("rule_type"),
        "cloud_provider", F.lit(None).cast("string").alias("service_category"),
        F.lit(-50.0).alias("threshold_value"), F.lit("medium").alias("severity"),
        F.lit(True).alias("is_active"))
    out = al.from_rule_table(rules.unionByName(variance), spend, predicted)
    return rounded(out.select("rule_id", "rule_type", "cloud_provider", "service_category",
                              "value"), 2, "value")


# --- data quality ----------------------------------------------------------------------

@entry("dq_row_checks", sql("""
    SELECT 'schema' AS "check", count(*) FILTER (WHERE record_id IS NULL OR cloud_provider IS NULL
      OR account_id IS NULL OR service IS NULL OR usage_date IS NULL OR cost_usd IS NULL OR
      original_cost IS NULL OR original_currency IS NULL OR exchange_rate IS NULL OR tags IS NULL
      OR ingested_at IS NULL) AS failed_rows FROM raw
    UNION ALL SELECT 'cost_usable', count(*) FILTER (WHERE cost_usd IS NULL OR NOT
      isfinite(cost_usd)) FROM raw
    UNION ALL SELECT 'date_parses', count(*) FILTER (WHERE try_cast(usage_date AS DATE) IS NULL OR
      try_cast(ingested_at AS TIMESTAMP) IS NULL) FROM raw
    UNION ALL SELECT 'usage_before_ingest', count(*) FILTER (WHERE usage_date > ingested_at[1:10])
      FROM raw
    UNION ALL SELECT 'currency_consistent', count(*) FILTER (WHERE
      abs(original_cost * exchange_rate - cost_usd) >= 0.01) FROM raw
    UNION ALL SELECT 'backdated_lag', count(*) FILTER (WHERE is_backdated AND
      CAST(ingested_at[1:10] AS DATE) - CAST(usage_date AS DATE) <= 2) FROM raw
    UNION ALL SELECT 'credit_tagged', count(*) FILTER (WHERE cost_usd < 0 AND
      tags NOT LIKE '%credit_type%') FROM raw
    UNION ALL SELECT 'anomaly_typed', count(*) FILTER (WHERE is_anomaly AND
      trim(coalesce(anomaly_type, '')) = '') FROM raw
    UNION ALL SELECT 'known_provider', count(*) FILTER (WHERE cloud_provider NOT IN ('aws',
      'azure', 'gcp')) FROM raw""", "raw"))
def _(b):
    """Schema, cost, date, currency, lag, credit, label and provider checks in one pass."""
    rows = b.raw_billing
    return dq.row_report(rows, dq.row_checks(rows, RAW_BILLING))


@entry("dq1_feature_columns", sql("""
    SELECT 0 AS missing_columns, count(*) AS rows_checked FROM feat""", "feat"))
def _(b):
    rows = b.features
    missing = dq.missing_columns(rows, dq.FEATURE_COLUMNS_REQUIRED)
    return rows.agg(F.count(F.lit(1)).alias("rows_checked")).withColumn(
        "missing_columns", F.lit(len(missing)))


@entry("dq6_duplicate_twins", sql("""
    SELECT 'duplicate_has_twin' AS "check", count(*) FILTER (WHERE is_duplicate AND c = 1)
      AS failed_rows FROM (SELECT *, count(*) OVER (PARTITION BY cloud_provider, service,
      usage_date, original_cost) AS c FROM raw)""", "raw"))
def _(b):
    return dq.duplicates_without_twin(b.raw_billing)


@entry("dq10_conservation", sql("""
    SELECT 'conservation' AS "check", count(*) - count(*) AS failed_rows FROM raw""", "raw"))
def _(b):
    return dq.conservation(b.raw_billing)


@entry("dq11_known_categories", sql("""
    SELECT 'known_category' AS "check", count(*) FILTER (WHERE service_category NOT IN ('compute',
      'storage', 'database', 'other')) AS failed_rows FROM enriched
    UNION ALL SELECT 'provider_present', 3 - count(DISTINCT cloud_provider) FROM enriched""",
    "enriched"))
def _(b):
    rows = nm.normalise(b.raw_billing)
    return dq.unknown_categories(rows).unionByName(dq.providers_missing(rows))


@entry("dq11_flags_agree", sql(f"""
    SELECT 'flag_has_anomaly' AS "check", count(*) AS failed_rows FROM bill WHERE anomaly_flag
      AND (cloud_provider, service_category, account_id, usage_date) NOT IN (
      SELECT cloud_provider, service_category, account_id, feature_date FROM found
      WHERE severity IS NOT NULL)""", "bill", "found"))
def _(b):
    scored = detect.combine(detect.ZScore().score(b.features))
    found = detect.to_anomalies(scored, F.current_timestamp())
    return dq.flags_without_anomaly(b.billing, found)


@entry("dq12_shares_sum", sql("""
    SELECT 'shares_sum' AS "check", CASE WHEN abs(sum(s) - 100) > 0.1 THEN 1 ELSE 0 END
      AS failed_rows FROM (SELECT sum(cost_usd) / (SELECT sum(cost_usd) FROM bill) * 100 AS s
      FROM bill GROUP BY cloud_provider)""", "bill"))
def _(b):
    return dq.shares_off(rollup.spend_by_cloud(b.billing))
