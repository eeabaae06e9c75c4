"""Scalar functions and normalisation over the raw export view."""

from __future__ import annotations

from pyspark.sql import functions as F

from costlens import constants as C
from costlens.functions import (budget as bud, calendar as cal, forecasting as fc, identity,
                                mapping, scoring as sc, sqlfuncs, tags as tg, text as tx)
from costlens.operators import dedup, filters as flt, rollup
from costlens.plans import normalise as nm
from entries import ctes
from entries.base import entry, f32, rounded, s32
from entries.ctes import sql


@entry("fn1_service_category", sql(
    "SELECT record_id, service_category FROM enriched", "enriched"))
def _(b):
    return b.raw_billing.select("record_id", mapping.service_category(
        F.col("service")).alias("service_category"))


@entry("fn2_canonical_region", sql(
    "SELECT record_id, region_name AS region FROM enriched", "enriched"))
def _(b):
    return b.raw_billing.select("record_id", mapping.canonical_region(
        F.col("region")).alias("region"))


@entry("fn3_fx_rate", sql(f"""
    SELECT record_id, {ctes.RATE.format(c='original_currency')} AS rate FROM raw""", "raw"))
def _(b):
    return b.raw_billing.select("record_id", mapping.fx_rate(
        F.lower("original_currency")).alias("rate"))


@entry("fn4_to_usd", sql(f"""
    SELECT record_id, {s32('usd')} AS usd, original_currency = 'CNY' AS fx_missing FROM enriched""",
    "enriched"))
def _(b):
    return f32(b.raw_billing.select(
        "record_id", mapping.to_usd(F.col("original_cost"), F.col("original_currency"))
        .alias("usd"), mapping.fx_missing(F.col("original_currency")).alias("fx_missing")), "usd")


@entry("fn5_parse_tags", sql("""
    SELECT record_id, CASE WHEN json_valid(tags) THEN CAST(len(json_keys(tags)) AS INTEGER)
      ELSE 0 END AS n_tags,
      CASE WHEN json_valid(tags) THEN json_extract_string(tags, '$.owner') END AS owner FROM raw""",
    "raw"))
def _(b):
    tags = tg.parse_tags(F.col("tags"))
    return b.raw_billing.select("record_id", F.size(tags).alias("n_tags"),
                                F.try_element_at(tags, F.lit("owner")).alias("owner"))


@entry("fn6_environment", sql("SELECT record_id, environment FROM enriched", "enriched"))
def _(b):
    return b.raw_billing.select("record_id", tg.environment(
        tg.parse_tags(F.col("tags"))).alias("environment"))


@entry("fn7_team", sql("SELECT record_id, team FROM enriched", "enriched"))
def _(b):
    return b.raw_billing.select("record_id", tg.team(tg.parse_tags(F.col("tags"))).alias("team"))


@entry("fn8_fingerprint", sql("SELECT record_id, fingerprint FROM enriched", "enriched"))
def _(b):
    return nm.with_fingerprint(b.raw_billing).select("record_id", "fingerprint")


@entry("fn9_content_key", sql("""
    SELECT record_id, md5('{"account":"' || account_id || '","cloud":"' || cloud_provider ||
      '","day":"' || usage_date || '"}') AS key FROM raw""", "raw"))
def _(b):
    return b.raw_billing.select("record_id", identity.content_key(
        day=F.col("usage_date"), cloud=F.col("cloud_provider"),
        account=F.col("account_id")).alias("key"))


@entry("fn10_feature_description", sql("""
    SELECT top_driver_1 AS driver, CASE top_driver_1
      WHEN 'cost_lag_1d' THEN 'yesterday''s cost level' WHEN 'cost_lag_7d' THEN
      'cost level 7 days ago' WHEN 'cost_lag_30d' THEN 'cost level 30 days ago'
      WHEN 'day_of_week' THEN 'day of week effect' WHEN 'month' THEN 'monthly seasonality' END
      AS description, count(*) AS n FROM attr GROUP BY ALL""", "attr"))
def _(b):
    return b.attributions.groupBy(
        F.col("top_driver_1").alias("driver"),
        tx.feature_description(F.col("top_driver_1")).alias("description")).agg(
        F.count(F.lit(1)).alias("n"))


@entry("fn11_calendar_features", sql("""
    SELECT CAST(agg_date AS VARCHAR) AS day, day_of_week, day_of_month, week_of_year, month,
      is_weekend, is_month_start, is_month_end, count(*) AS n FROM feat GROUP BY ALL""", "feat"))
def _(b):
    day = F.col("agg_date")
    cols = [c.alias(n) for n, c in cal.calendar_columns(day).items()]
    return b.daily.groupBy(day.alias("day"), *cols).agg(F.count(F.lit(1)).alias("n"))


@entry("fn12_quarter", sql("""
    SELECT CAST(quarter(usage_date) AS INTEGER) AS quarter, count(*) AS n FROM bill GROUP BY 1""",
    "bill"))
def _(b):
    return b.billing.groupBy(cal.quarter(F.col("usage_date")).alias("quarter")).agg(
        F.count(F.lit(1)).alias("n"))


@entry("fn14_date_helpers", sql("""
    SELECT cloud_provider, count(*) AS days, CAST(any_value(m) AS INTEGER) AS months,
      CAST(any_value(hi) + 1 AS VARCHAR) AS next_start, CAST(any_value(hi) - 1 AS VARCHAR)
      AS day_before FROM (
      SELECT cloud_provider, lo, hi, (year(hi) - year(lo)) * 12 + month(hi) - month(lo) AS m,
        unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d FROM (
        SELECT cloud_provider, min(usage_date) AS lo, max(usage_date) AS hi FROM bill GROUP BY 1))
    GROUP BY 1""", "bill"))
def _(b):
    span = b.billing.groupBy("cloud_provider").agg(F.min("usage_date").alias("lo"),
                                                   F.max("usage_date").alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    return cal.date_series(span, lo, hi).groupBy("cloud_provider").agg(
        F.count(F.lit(1)).alias("days"),
        F.any_value(cal.months_between(lo, hi)).alias("months"),
        F.any_value(cal.next_start(hi, F.to_date(F.lit(C.INGESTION_START)))).alias("next_start"),
        F.any_value(cal.yesterday(hi)).alias("day_before"))


@entry("fn15_finite", sql("""
    SELECT record_id, CASE WHEN cost_usd <> 0 THEN original_cost / cost_usd END AS ratio
    FROM raw""".replace("original_cost / cost_usd", s32("original_cost / cost_usd")), "raw"))
def _(b):
    ratio = F.when(F.col("cost_usd") == 0, F.lit(float("nan"))).otherwise(
        F.col("original_cost") / F.nullif(F.col("cost_usd"), F.lit(0.0)))
    return f32(b.raw_billing.select("record_id", cal.finite(ratio).alias("ratio")), "ratio")


@entry("fn16_zscore_score", sql(f"""
    SELECT anomaly_id, {s32(ctes.ZSCORE.format(z='z_score'))} AS score FROM anom""", "anom"))
def _(b):
    return f32(b.anomalies.select("anomaly_id", sc.zscore_score(F.col("z_score")).alias("score")),
               "score")


@entry("fn17_deviation_pct", sql(f"""
    SELECT anomaly_id, {s32('''CASE WHEN expected_cost > 0
      THEN (actual_cost - expected_cost) / expected_cost * 100 ELSE 0 END''')} AS pct FROM anom""",
    "anom"))
def _(b):
    return f32(b.anomalies.select("anomaly_id", sc.deviation_pct(
        F.col("actual_cost"), F.col("expected_cost")).alias("pct")), "pct")


@entry("fn18_range_score", sql(f"""
    SELECT anomaly_id, {s32('''least(1, greatest(0, 1 - (z_score - lo) /
      CASE WHEN hi <> lo THEN hi - lo ELSE 1 END))''')} AS score
    FROM anom JOIN (SELECT cloud_provider, service, min(z_score) AS lo, max(z_score) AS hi
      FROM anom GROUP BY ALL) USING (cloud_provider, service)""", "anom"))
def _(b):
    keys = ["cloud_provider", "service"]
    ends = b.anomalies.groupBy(*keys).agg(F.min("z_score").alias("lo"), F.max("z_score").alias("hi"))
    return f32(b.anomalies.join(ends, keys).select("anomaly_id", sc.range_score(
        F.col("z_score"), F.col("lo"), F.col("hi")).alias("score")), "score")


@entry("fn19_reconstruction_score", sql(f"""
    SELECT anomaly_id, {s32('''CASE WHEN z_score > 0
      THEN least(1, ensemble_score / z_score) ELSE 0 END''')} AS score FROM anom""", "anom"))
def _(b):
    return f32(b.anomalies.select("anomaly_id", sc.reconstruction_score(
        F.col("ensemble_score"), F.col("z_score")).alias("score")), "score")


PARTS = """SELECT anomaly_id, {z} AS z, CASE WHEN detection_method <> 'zscore'
  THEN ensemble_score END AS f FROM anom"""


@entry("fn20_ensemble_score", sql(f"""
    SELECT anomaly_id, {s32('''(z * 0.45::DOUBLE + coalesce(f, 0) * 0.55::DOUBLE) /
      (0.45::DOUBLE + CASE WHEN f IS NULL THEN 0 ELSE 0.55::DOUBLE END)''')} AS score FROM p""",
    "anom", p=PARTS.format(z=ctes.ZSCORE.format(z="z_score"))))
def _(b):
    f = F.when(F.col("detection_method") != "zscore", F.col("ensemble_score"))
    score = sc.ensemble_score(sc.zscore_score(F.col("z_score")), f, F.lit(None).cast("double"))
    return f32(b.anomalies.select("anomaly_id", score.alias("score")), "score")


@entry("fn21_severity", sql(f"""
    SELECT anomaly_id, {ctes.SEVERITY.format(s='ensemble_score')} AS severity FROM anom""", "anom"))
def _(b):
    return b.anomalies.select("anomaly_id", sc.severity(F.col("ensemble_score")).alias("severity"))


@entry("fn22_expected_cost", sql(f"""
    SELECT anomaly_id, {s32('''CASE WHEN expected_cost > 0 AND actual_cost > 0
      THEN (expected_cost + actual_cost) / 2 WHEN expected_cost > 0 THEN expected_cost
      WHEN actual_cost > 0 THEN actual_cost ELSE 0 END''')} AS expected FROM anom""", "anom"))
def _(b):
    return f32(b.anomalies.select("anomaly_id", sc.expected_cost(
        F.col("expected_cost"), F.col("actual_cost")).alias("expected")), "expected")


@entry("fn23_composite_record_id", sql("""
    SELECT anomaly_id, cloud_provider || '_' || service || '_' || account_id || '_' ||
      CAST(usage_date AS VARCHAR) AS record_id FROM anom""", "anom"))
def _(b):
    return b.anomalies.select("anomaly_id", identity.composite_record_id(
        F.col("cloud_provider"), F.col("service"), F.col("account_id"),
        F.col("usage_date")).alias("record_id"))


MAPES = """SELECT alert_id, CASE WHEN k % 4 <> 0 THEN k / 100.0::DOUBLE END AS s,
  CASE WHEN k % 3 <> 0 THEN (100 - k) / 200.0::DOUBLE END AS b FROM (
  SELECT 'al-' || CAST(event_id AS VARCHAR) AS alert_id, k FROM ev)"""


@entry("fn24_blend_weights", sql(f"""
    SELECT alert_id, {s32('''CASE WHEN s + b > 0 THEN b / (s + b) WHEN s IS NOT NULL THEN 1
      WHEN b IS NOT NULL THEN 0 ELSE 0.45::DOUBLE END''')} AS seasonal,
      {s32('''CASE WHEN s + b > 0 THEN s / (s + b) WHEN s IS NOT NULL THEN 0
      WHEN b IS NOT NULL THEN 1 ELSE 0.55::DOUBLE END''')} AS boosted FROM m""",
    "ev", m=MAPES))
def _(b):
    k = F.get_json_object("message", "$.k").cast("int")
    rows = b.alerts.select("alert_id", F.when(k % 4 != 0, k / F.lit(100.0)).alias("s"),
                           F.when(k % 3 != 0, (100 - k) / F.lit(200.0)).alias("b"))
    w = fc.blend_weights(F.col("s"), F.col("b"))
    return f32(rows.select("alert_id", w[0].alias("seasonal"), w[1].alias("boosted")),
               "seasonal", "boosted")


@entry("fn27_interval", sql(f"""
    SELECT cloud_provider, service, horizon_days, CAST(forecast_date AS VARCHAR) AS forecast_date,
      model_used, {s32('greatest(0, predicted_cost - 1.96::DOUBLE * upper_bound)')} AS lo,
      {s32('predicted_cost + 1.96::DOUBLE * upper_bound')} AS hi FROM fcst""", "fcst"))
def _(b):
    low, high = fc.interval(F.col("predicted_cost"), F.col("upper_bound"))
    return f32(b.forecasts.select("cloud_provider", "service", "horizon_days", "forecast_date",
                                  "model_used", low.alias("lo"), high.alias("hi")), "lo", "hi")


@entry("fn28_budget_severity", sql(f"""
    SELECT record_id, {s32('cost_usd / 250000 * 100')} AS pct, CASE WHEN cost_usd / 250000 * 100
      >= 100 THEN 'critical' WHEN cost_usd / 250000 * 100 >= 85 THEN 'high' END AS severity,
      CAST(NULL AS VARCHAR) AS no_budget FROM bill""", "bill"))
def _(b):
    cost = F.col("cost_usd")
    return f32(b.billing.select(
        "record_id", bud.budget_pct(cost, F.lit(250000.0)).alias("pct"),
        bud.budget_severity(cost, F.lit(250000.0)).alias("severity"),
        bud.budget_severity(cost, F.lit(0.0)).alias("no_budget")), "pct")


@entry("fn29_breach_risk", sql("""
    SELECT risk, count(*) AS n FROM (SELECT CASE WHEN upper_bound < 150000 THEN 'none'
      WHEN lower_bound < 150000 AND 150000 <= predicted_cost THEN 'possible'
      WHEN predicted_cost < 150000 AND 150000 <= upper_bound THEN 'likely' ELSE 'certain' END
      AS risk FROM fcst) GROUP BY 1""", "fcst"))
def _(b):
    risk = bud.breach_risk(F.col("lower_bound"), F.col("predicted_cost"), F.col("upper_bound"),
                           F.lit(150000.0))
    return b.forecasts.groupBy(risk.alias("risk")).agg(F.count(F.lit(1)).alias("n"))


@entry("fn30_days_to_breach", sql("""
    SELECT CAST(forecast_date AS VARCHAR) AS forecast_date,
      CAST(forecast_date - DATE '1998-01-01' AS INTEGER) AS days, count(*) AS n FROM fcst
    GROUP BY ALL""", "fcst"))
def _(b):
    days = bud.days_to(F.col("forecast_date"), F.to_date(F.lit("1998-01-01")))
    return b.forecasts.groupBy("forecast_date", days.alias("days")).agg(
        F.count(F.lit(1)).alias("n"))


@entry("fn31_anomaly_text", sql("""
    SELECT anomaly_id, 'Anomaly: ' || service || ' spend ' || CASE WHEN deviation_pct < 0
      THEN 'drop' ELSE 'spike' END || ' on ' || CAST(usage_date AS VARCHAR) AS title,
      'Detected ' || printf('%.1f', abs(deviation_pct)) || '% ' || CASE WHEN deviation_pct < 0
      THEN 'below' ELSE 'above' END || ' expected cost ($' || printf('%.2f', actual_cost) ||
      ' vs $' || printf('%.2f', expected_cost) || ')' AS message FROM anom""", "anom"))
def _(b):
    dev = F.col("deviation_pct")
    return b.anomalies.select(
        "anomaly_id", tx.anomaly_title(F.col("service"), dev, F.col("usage_date")).alias("title"),
        tx.anomaly_message(dev, F.col("actual_cost"), F.col("expected_cost")).alias("message"))


@entry("fn32_spike_text", sql("""
    SELECT CAST(feature_date AS VARCHAR) AS feature_date, account_id, environment, team,
      cloud_provider || ' ' || service_category || ' spend up ' || printf('%.0f',
      pct_change_1d * 100) || '% day-over-day' AS title,
      CASE WHEN abs(pct_change_1d * 100) > 100 THEN 'high' ELSE 'medium' END AS severity
    FROM feat WHERE abs(pct_change_1d * 100) > 50""", "feat"))
def _(b):
    pct = F.col("pct_change_1d") * 100
    return b.features.where(F.abs(pct) > C.SPEND_SPIKE_PCT).select(
        "feature_date", "account_id", "environment", "team",
        tx.spike_title(F.col("cloud_provider"), F.col("service_category"), pct).alias("title"),
        tx.spike_severity(pct).alias("severity"))


@entry("fn33_metadata_json", sql("""
    SELECT anomaly_id, '{"method":"' || detection_method || '","direction":' ||
      CASE WHEN deviation_pct < 0 THEN '"drop"' ELSE 'null' END || '}' AS metadata FROM anom""",
    "anom"))
def _(b):
    down = F.when(F.col("deviation_pct") < 0, "drop")
    return b.anomalies.select("anomaly_id", tx.json_object(
        method=F.col("detection_method"), direction=down).alias("metadata"))


@entry("fn34_row_id", sql("""
    SELECT alert_id, sha256(concat_ws('|', alert_type, cloud_provider, coalesce(service_category,
      chr(0)), CAST(alert_date AS VARCHAR))) AS id FROM alert""", "alert"))
def _(b):
    return b.alerts.select("alert_id", identity.row_id(
        F.col("alert_type"), F.col("cloud_provider"), F.col("service_category"),
        F.col("alert_date")).alias("id"))


DRIVER = """'{i}. ' || top_driver_{i} || ': ' || printf('%+.2f', top_driver_{i}_value) || ' (' ||
  CASE top_driver_{i} WHEN 'cost_lag_1d' THEN 'yesterday''s cost level' WHEN 'cost_lag_7d' THEN
  'cost level 7 days ago' WHEN 'cost_lag_30d' THEN 'cost level 30 days ago' WHEN 'day_of_week'
  THEN 'day of week effect' ELSE 'monthly seasonality' END || ')'"""


@entry("fn36_driver_list", sql(f"""
    SELECT attribution_date, cloud_provider, service_category, account_id, environment, team,
      {" || chr(10) || ".join(DRIVER.format(i=i) for i in (1, 2, 3))} AS drivers FROM (
      SELECT * REPLACE (CAST(attribution_date AS VARCHAR) AS attribution_date,
        CASE WHEN top_driver_1 LIKE 'cost%' THEN CAST(CAST(floor(top_driver_1_value) AS BIGINT) AS DOUBLE) ELSE top_driver_1_value
          END AS top_driver_1_value,
        CASE WHEN top_driver_2 LIKE 'cost%' THEN CAST(CAST(floor(top_driver_2_value) AS BIGINT) AS DOUBLE) ELSE top_driver_2_value
          END AS top_driver_2_value,
        CASE WHEN top_driver_3 LIKE 'cost%' THEN CAST(CAST(floor(top_driver_3_value) AS BIGINT) AS DOUBLE) ELSE top_driver_3_value
          END AS top_driver_3_value) FROM attr)""", "attr"))
def _(b):
    names = [F.col(f"top_driver_{i}") for i in (1, 2, 3)]
    values = [F.when(n.startswith("cost"), F.floor(v).cast("double")).otherwise(v) for n, v in
              ((F.col(f"top_driver_{i}"), F.col(f"top_driver_{i}_value")) for i in (1, 2, 3))]
    return b.attributions.select(
        "attribution_date", "cloud_provider", "service_category", "account_id", "environment",
        "team", tx.driver_list(names, values).alias("drivers"))


@entry("fn37_band_width", sql("""
    SELECT cloud_provider, round(sum(upper_bound - lower_bound), 2) AS width FROM fcst
    GROUP BY 1""", "fcst"))
def _(b):
    width = fc.band_width(F.col("lower_bound"), F.col("upper_bound"))
    return rounded(b.forecasts.groupBy("cloud_provider").agg(F.sum(width).alias("width")), 2,
                   "width")


# --- normalisation ---------------------------------------------------------------

NORMAL = f"""SELECT record_id, fingerprint, cloud_provider, account_id,
    service AS service_name_raw, service_category, region_name AS region,
    nullif(resource_id, '') AS resource_id, usage_date, original_currency AS currency_original,
    {s32('usd')} AS cost_usd, environment, team FROM norm"""
KEPT = ["record_id", "fingerprint", "cloud_provider", "account_id", "service_name_raw",
        "service_category", "region", "resource_id", "usage_date", "currency_original",
        "cost_usd", "environment", "team"]


@entry("nm1_normalise", sql(NORMAL, "norm"))
def _(b):
    from costlens.sources.billing import blanks_to_null
    return f32(nm.normalise(blanks_to_null(b.raw_billing)).select(*KEPT), "cost_usd")


@entry("nm1_run_metrics", sql("""
    SELECT count(*) AS input_count, (SELECT count(*) FROM norm) AS output_count,
      count(*) - (SELECT count(*) FROM norm) AS duplicate_count, 0 AS error_count FROM raw""",
    "norm"))
def _(b):
    return nm.normalise_metrics(b.raw_billing)


@entry("nm2_deduplicate", sql("SELECT record_id, fingerprint FROM norm", "norm"))
def _(b):
    return nm.deduplicate(nm.with_fingerprint(nm.typed(b.raw_billing))).select(
        "record_id", "fingerprint")


@entry("nm2_removed_count", sql("""
    SELECT count(*) AS input_count, count(DISTINCT fingerprint) AS output_count,
      count(*) - count(DISTINCT fingerprint) AS duplicate_count FROM enriched""", "enriched"))
def _(b):
    return dedup.duplicate_counts(nm.with_fingerprint(b.raw_billing), ["fingerprint"])


@entry("wn14_first_wins", sql("""
    SELECT record_id, account_id, usage_date FROM (SELECT *, row_number() OVER (PARTITION BY
      account_id, usage_date ORDER BY ingested_at, record_id) AS rn FROM raw) WHERE rn = 1""",
    "raw"))
def _(b):
    return dedup.first_wins(b.raw_billing, ["account_id", "usage_date"],
                            ["ingested_at", "record_id"]).select(
        "record_id", "account_id", "usage_date")


@entry("pf18_reject_channel", sql("""
    SELECT coalesce(CASE WHEN resource_id = '' THEN 'missing resource_id' WHEN cost_usd < 0 THEN
      'credit' END, 'accepted') AS reason, count(*) AS n FROM raw GROUP BY 1""", "raw"))
def _(b):
    good, bad = flt.split_rejects(b.raw_billing, {
        "missing resource_id": F.nullif(F.col("resource_id"), F.lit("")).isNull(),
        "credit": F.col("cost_usd") < 0})
    out = good.withColumn("reject_reason", F.lit("accepted")).unionByName(bad)
    return out.groupBy(F.col("reject_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@entry("jn11_lookup_joins", sql("""
    SELECT service_category, region_name AS region, count(*) AS n FROM enriched GROUP BY ALL""",
    "enriched"))
def _(b):
    rows = mapping.with_canonical_region(mapping.with_service_category(b.raw_billing))
    return rows.groupBy("service_category", "region").agg(F.count(F.lit(1)).alias("n"))


@entry("ud4_sql_functions", sql(f"""
    SELECT record_id, service_category, region_name AS region, {s32('usd')} AS usd, environment,
      team, {s32(ctes.ZSCORE.format(z='cost_usd / 100'))} AS score,
      {ctes.SEVERITY.format(s='cost_usd / 500')} AS severity,
      CASE WHEN cost_usd >= 400 THEN 'critical' WHEN cost_usd >= 340 THEN 'high' END AS budget,
      CASE WHEN cost_usd + 50 < 300 THEN 'none' WHEN cost_usd - 50 < 300 AND 300 <= cost_usd
        THEN 'possible' WHEN cost_usd < 300 AND 300 <= cost_usd + 50 THEN 'likely'
        ELSE 'certain' END AS risk,
      {s32('(cost_usd / 500 * 0.45::DOUBLE + 0.5::DOUBLE * 0.55::DOUBLE) / (0.45::DOUBLE + 0.55::DOUBLE)')}
        AS ensemble FROM enriched""", "enriched"))
def _(b):
    sqlfuncs.register(b.spark)
    rows = b.raw_billing.selectExpr(
        "record_id", "cl_service_category(service) AS service_category",
        "cl_region(region) AS region", "cl_to_usd(original_cost, original_currency) AS usd",
        "cl_environment(cl_tags(tags)) AS environment", "cl_team(cl_tags(tags)) AS team",
        "cl_zscore_score(cost_usd / 100) AS score", "cl_severity(cost_usd / 500) AS severity",
        "cl_budget_severity(cost_usd, 400D) AS budget",
        "cl_breach_risk(cost_usd - 50, cost_usd, cost_usd + 50, 300D) AS risk",
        "cl_ensemble(cost_usd / 500, 0.5D, NULL) AS ensemble")
    return f32(rows, "usd", "score", "ensemble")


@entry("nm1_rollup_of_normalised", sql(f"""
    SELECT usage_date AS agg_date, cloud_provider, service_category, account_id,
      coalesce(environment, 'unknown') AS environment, coalesce(team, 'unknown') AS team,
      round(sum(usd), 2) AS total_cost_usd, count(*) AS record_count FROM norm GROUP BY ALL""",
    "norm"))
def _(b):
    return rounded(rollup.daily_rollup(nm.normalise(b.raw_billing)).drop("avg_cost_usd"), 2,
                   "total_cost_usd")
