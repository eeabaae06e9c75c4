"""Scans of stored tables, sinks and keyed joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from costlens.operators import filters as flt, forecasts as fq, joins, reports, rollup, tables
from costlens.operators.paging import page, page_result
from costlens.plans import attribute as at, normalise as nm
from costlens.schemas import DIMENSIONS, FEATURE_KEY, TABLES
from costlens.sources import billing as src, exports, scans
from entries import ctes
from entries.base import entry, f32, rounded, s32
from entries.ctes import DIMS, sql

EV_A, EV_Z = "2024-01-05", "2024-01-25"
RAW_COLUMNS = """record_id, cloud_provider, service, nullif(region, '') AS region,
    nullif(resource_id, '') AS resource_id, usage_date, cost_usd"""
RAW_KEPT = ["record_id", "cloud_provider", "service", "region", "resource_id", "usage_date",
            "cost_usd"]


def landed(b, raw=None) -> str:
    """The raw view as one Parquet folder per provider, as a source would leave it."""
    root = b.root("landing")
    raw = b.raw_billing if raw is None else raw
    for cloud in ("aws", "azure", "gcp"):
        raw.where(F.col("cloud_provider") == cloud).write.parquet(f"{root}/{cloud}")
    return root


@entry("sc1_billing_scan", sql(f"""
    SELECT {RAW_COLUMNS} FROM raw WHERE usage_date BETWEEN '{EV_A}' AND '{EV_Z}'""", "raw"))
def _(b):
    return src.read_billing(b.spark, landed(b), start=EV_A, end=EV_Z).select(*RAW_KEPT)


@entry("sc2_fetch_account", sql(f"""
    SELECT {RAW_COLUMNS} FROM raw WHERE account_id = 'acct-2'""", "raw"))
def _(b):
    return src.ParquetSource(landed(b)).read(b.spark, account="acct-2").select(*RAW_KEPT)


@entry("sc3_fetch_provider", sql(f"""
    SELECT {RAW_COLUMNS} FROM raw WHERE cloud_provider = 'azure' AND usage_date >= '{EV_A}'""",
    "raw"))
def _(b):
    return src.ParquetSource(landed(b)).read_cloud(b.spark, "azure", EV_A).select(*RAW_KEPT)


@entry("sc4_available_range", sql("""
    SELECT min(usage_date) AS min_date, max(usage_date) AS max_date FROM raw""", "raw"))
def _(b):
    return src.ParquetSource(landed(b)).available_range(b.spark)


@entry("sc5_source_ready", sql("SELECT count(*) > 0 AS ready, false AS absent_ready FROM raw",
                               "raw"))
def _(b):
    root = landed(b)
    ready = src.ParquetSource(root).ready(b.spark)
    absent = src.ParquetSource(f"{root}/none").ready(b.spark)
    rows = src.read_billing(b.spark, root).agg(F.count(F.lit(1)).alias("n"))
    return rows.select((F.lit(ready) & (F.col("n") > 0)).alias("ready"),
                       F.lit(absent).alias("absent_ready"))


@entry("sc6_fetch_windows", sql("""
    SELECT CAST(n AS INTEGER) AS window_no, CAST(DATE '1995-01-01' + CAST(n * 31 AS INTEGER)
      AS VARCHAR) AS window_start, CAST(least(DATE '1995-01-01' + CAST(n * 31 + 30 AS INTEGER),
      DATE '2001-08-01') AS VARCHAR) AS window_end, count(*) AS n_rows FROM (
      SELECT *, (usage_date - DATE '1995-01-01') // 31 AS n FROM bill) GROUP BY ALL""", "bill"))
def _(b):
    windows = src.fetch_windows(b.spark, "1995-01-01", "2001-08-01")
    return src.in_windows(b.billing, windows).groupBy(
        "window_no", "window_start", "window_end").agg(F.count(F.lit(1)).alias("n_rows"))


EXPORT = """SELECT count(*) AS n, count(DISTINCT usage_date) AS days,
    round(sum(original_cost), 2) AS cost, count(*) FILTER (WHERE tags <> '{}') AS tagged
    FROM raw WHERE cloud_provider = """


def _export_counts(rows):
    return rounded(rows.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("usage_date").alias("days"),
        F.sum("original_cost").alias("cost"), F.count_if(F.col("tags") != "{}").alias("tagged")),
        2, "cost")


@entry("sc7_aws_export", sql(EXPORT.replace("tags <> '{}'", "true") + "'aws'", "raw"))
def _(b):
    path = b.root("aws-export")
    b.raw_billing.where("cloud_provider = 'aws'").select(
        F.col("record_id").alias("identity_line_item_id"),
        F.col("account_id").alias("line_item_usage_account_id"),
        F.col("service").alias("product_servicename"), F.col("region").alias("product_region"),
        F.col("resource_id").alias("line_item_resource_id"),
        F.col("usage_date").alias("line_item_usage_start_date"),
        F.col("original_cost").alias("line_item_unblended_cost"),
        F.col("original_currency").alias("line_item_currency_code"),
        F.col("ingested_at").alias("bill_billing_period_end_date"),
        F.col("account_id").alias("resource_tags_user_team")).write.parquet(path)
    return _export_counts(exports.ExportSource("aws", path).read(b.spark))


@entry("sc7_export_range", sql(EXPORT.replace("tags <> '{}'", "true")
                               + "'aws' AND usage_date BETWEEN '2024-01-09' AND '2024-01-16'", "raw"))
def _(b):
    """A range of days, read by bounds on the export's own time column."""
    path = b.root("aws-range")
    b.raw_billing.where("cloud_provider = 'aws'").select(
        F.col("record_id").alias("identity_line_item_id"),
        F.col("account_id").alias("line_item_usage_account_id"),
        F.col("service").alias("product_servicename"), F.col("region").alias("product_region"),
        F.col("resource_id").alias("line_item_resource_id"),
        F.col("usage_date").cast("timestamp").alias("line_item_usage_start_date"),
        F.col("original_cost").alias("line_item_unblended_cost"),
        F.col("original_currency").alias("line_item_currency_code"),
        F.col("ingested_at").alias("bill_billing_period_end_date")).write.parquet(path)
    rows = exports.ExportSource("aws", path).read(b.spark, "2024-01-09", "2024-01-16")
    return _export_counts(rows.withColumn("tags", F.lit("{\"a\":1}")))


@entry("sc8_azure_export", sql(EXPORT + "'azure'", "raw"))
def _(b):
    path = b.root("azure-export")
    text = F.regexp_replace("tags", r"^\{|\}$", "")
    b.raw_billing.where("cloud_provider = 'azure'").select(
        F.col("account_id").alias("SubscriptionId"), F.col("service").alias("ServiceName"),
        F.col("region").alias("ResourceLocation"), F.col("resource_id").alias("ResourceId"),
        F.col("record_id").alias("MeterId"), F.col("usage_date").alias("Date"),
        F.col("original_cost").alias("CostInBillingCurrency"),
        F.col("original_currency").alias("BillingCurrency"), text.alias("Tags")
    ).write.option("header", True).option("escape", '"').csv(path)
    source = exports.ExportSource("azure", path, "csv", header=True, escape='"')
    return _export_counts(source.read(b.spark))


@entry("sc9_gcp_export", sql(EXPORT.replace("tags <> '{}'", "true") + "'gcp'", "raw"))
def _(b):
    path = b.root("gcp-export")
    label = F.struct(F.lit("team").alias("key"), F.col("account_id").alias("value"))
    b.raw_billing.where("cloud_provider = 'gcp'").select(
        F.struct(F.col("account_id").alias("id")).alias("project"),
        F.struct(F.col("service").alias("description")).alias("service"),
        F.struct("region").alias("location"),
        F.struct(F.col("resource_id").alias("name")).alias("resource"),
        F.array(label).alias("labels"), F.col("original_cost").alias("cost"),
        F.col("original_currency").alias("currency"),
        F.col("usage_date").cast("timestamp").alias("usage_start_time"),
        F.col("ingested_at").cast("timestamp").alias("export_time")).write.parquet(path)
    return _export_counts(exports.ExportSource("gcp", path).read(b.spark))


@entry("sc14_billing_records", sql("""
    SELECT record_id, CAST(usage_date AS VARCHAR) AS usage_date, cost_usd FROM bill
    WHERE usage_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND cloud_provider = 'aws'
      AND environment = 'prod' ORDER BY bill.usage_date DESC, record_id LIMIT 10000""", "bill"))
def _(b):
    return scans.billing_records(b.billing, "1996-01-01", "1999-12-31", cloud="aws",
                                 environment="prod", limit=10_000).select("record_id", "usage_date", "cost_usd")


@entry("sc15_anomaly_scan", sql("""
    SELECT anomaly_id, severity, CAST(usage_date AS VARCHAR) AS usage_date FROM anom
    WHERE service = 'compute' AND ensemble_score >= 0.5 ORDER BY anom.usage_date DESC,
      ensemble_score DESC, anomaly_id LIMIT 1000""", "anom"))
def _(b):
    return scans.anomalies(b.anomalies, service="compute", min_severity="medium",
                           limit=1000).select(
        "anomaly_id", "severity", "usage_date")


@entry("sc16_forecast_scan", sql("""
    SELECT cloud_provider, service, CAST(forecast_date AS VARCHAR) AS forecast_date,
      predicted_cost FROM fcst WHERE model_used = 'ensemble' AND horizon_days = 30
      AND forecast_date >= DATE '1996-06-01'""", "fcst"))
def _(b):
    return scans.forecasts(b.forecasts, horizon=30, start="1996-06-01").select(
        "cloud_provider", "service", "forecast_date", "predicted_cost")


@entry("sc17_attribution_scan", sql(f"""
    SELECT CAST(attribution_date AS VARCHAR) AS attribution_date, {DIMS}, top_driver_1 FROM attr
    WHERE cloud_provider = 'gcp'
      AND 'day_of_week' IN (top_driver_1, top_driver_2, top_driver_3)""", "attr"))
def _(b):
    return scans.attributions(b.attributions, cloud="gcp", driver="day_of_week").select(
        "attribution_date", *DIMENSIONS, "top_driver_1")


@entry("sc18_labelled_load", sql("""
    SELECT cloud_provider, count(*) AS n, count(*) FILTER (WHERE is_anomaly) AS anomalies FROM raw
    GROUP BY 1""", "raw"))
def _(b):
    return src.read_billing(b.spark, landed(b)).groupBy("cloud_provider").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_anomaly").alias("anomalies"))


@entry("st2_concatenate_providers", sql(f"SELECT {RAW_COLUMNS} FROM raw", "raw"))
def _(b):
    root = landed(b)
    parts = [src.read_billing(b.spark, root, c) for c in ("aws", "azure", "gcp")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(*RAW_KEPT)


@entry("pf12_point_lookup", sql("""
    SELECT anomaly_id, record_id, severity, CAST(NULL AS VARCHAR) AS region FROM anom
    WHERE anomaly_id = 'an-77'""", "anom"))
def _(b):
    return scans.anomaly_by_id(b.anomalies, "an-77").select("anomaly_id", "record_id", "severity",
                                                            "region")


@entry("pf22_driver_not_null", sql("""
    SELECT service_category, count(*) AS n FROM alert WHERE service_category IS NOT NULL
    GROUP BY 1""", "alert"))
def _(b):
    return b.alerts.where(F.col("service_category").isNotNull()).groupBy(
        "service_category").agg(F.count(F.lit(1)).alias("n"))


@entry("tk7_group_series", sql(f"""
    SELECT CAST(attribution_date AS VARCHAR) AS attribution_date, {DIMS}, total_cost_usd,
      top_driver_1, top_driver_1_value FROM attr WHERE cloud_provider = 'aws'
      AND service_category = '1-URGENT'""", "attr"))
def _(b):
    return scans.attribution_series(b.attributions, "aws", "1-URGENT").select(
        "attribution_date", *DIMENSIONS, "total_cost_usd", "top_driver_1", "top_driver_1_value")


@entry("tk9_anomaly_pages", sql("""
    SELECT anomaly_id, severity, total, total > 100 AS has_next FROM (
      SELECT *, count(*) OVER () AS total FROM anom WHERE cloud_provider IN ('aws', 'gcp')
        AND severity IN ('high', 'critical') AND detection_method = 'zscore')
    ORDER BY detected_at DESC, anomaly_id LIMIT 50 OFFSET 50""", "anom"))
def _(b):
    rows = scans.anomaly_list(b.anomalies, clouds=["aws", "gcp"],
                              severities=["high", "critical"], method="zscore")
    out = page(rows, [F.col("detected_at").desc(), F.col("anomaly_id")], 2, 50)
    return out.select("anomaly_id", "severity", "total", "has_next")


@entry("tk9_empty_page", sql("""
    SELECT CAST(0 AS INTEGER) AS n_items, count(*) AS total, 9999 AS page, 50 AS page_size,
      false AS has_next FROM anom""", "anom"))
def _(b):
    """A page behind the last one still tells the total."""
    out = page_result(b.anomalies, [F.col("detected_at").desc(), F.col("anomaly_id")], 9999, 50)
    return out.select(F.size("items").alias("n_items"), "total", "page", "page_size", "has_next")


@entry("tk9_page_result", sql("""
    SELECT string_agg(anomaly_id, ',' ORDER BY detected_at DESC, anomaly_id) AS ids,
      (SELECT count(*) FROM anom) AS total, (SELECT count(*) FROM anom) > 100 AS has_next
    FROM (SELECT anomaly_id, anom.detected_at FROM anom ORDER BY anom.detected_at DESC, anomaly_id
      LIMIT 50 OFFSET 50)""", "anom"))
def _(b):
    out = page_result(b.anomalies, [F.col("detected_at").desc(), F.col("anomaly_id")], 2, 50)
    return out.select(F.array_join("items.anomaly_id", ",").alias("ids"), "total", "has_next")


@entry("tk9_forecast_pages", sql("""
    SELECT cloud_provider, service, horizon_days, CAST(forecast_date AS VARCHAR) AS forecast_date,
      CAST(forecast_date AS VARCHAR) AS forecast_date_display, model_used,
      (SELECT count(*) FROM fcst WHERE horizon_days <= 30 AND cloud_provider IN ('azure'))
      AS total FROM fcst WHERE horizon_days <= 30 AND cloud_provider IN ('azure')
    ORDER BY fcst.forecast_date, service, horizon_days, model_used, generated_at LIMIT 100""",
    "fcst"))
def _(b):
    rows = scans.forecast_list(b.forecasts, clouds=["azure"], horizon=30)
    order = [F.col(c) for c in ("forecast_date", "service", "horizon_days", "model_used",
                                "generated_at")]
    return page(rows, order, 1, 100).select(
        "cloud_provider", "service", "horizon_days", "forecast_date", "forecast_date_display",
        "model_used", "total")


@entry("tk9_alert_pages", sql("""
    SELECT alert_id, severity, total, total > 40 AS has_next FROM (
      SELECT *, count(*) OVER () AS total FROM alert WHERE NOT is_resolved AND severity = 'high')
    ORDER BY alert_date DESC, created_at DESC, alert_id LIMIT 20 OFFSET 20""", "alert"))
def _(b):
    rows = scans.alerts(b.alerts, severity="high", cloud="all", is_resolved=False)
    order = [F.col("alert_date").desc(), F.col("created_at").desc(), F.col("alert_id")]
    return page(rows, order, 2, 20, max_size=1000).select("alert_id", "severity", "total",
                                                          "has_next")


@entry("tk9_attribution_pages", sql(f"""
    SELECT CAST(attribution_date AS VARCHAR) AS attribution_date, {DIMS}, top_driver_1
    FROM attr WHERE cloud_provider = 'aws' ORDER BY attr.attribution_date DESC, {DIMS}
    LIMIT 50 OFFSET 100""", "attr"))
def _(b):
    rows = scans.attributions(b.attributions, cloud="aws")
    order = [F.col("attribution_date").desc(), *map(F.col, DIMENSIONS)]
    return page(rows, order, 3, 50).select("attribution_date", *DIMENSIONS, "top_driver_1")


# --- sinks -----------------------------------------------------------------------

@entry("sk1_insert_if_absent", sql("""
    SELECT usage_date, count(DISTINCT fingerprint) AS stored,
      (SELECT count(DISTINCT fingerprint) FROM enriched WHERE usage_date > '2024-01-15')
        AS inserted, (SELECT count(*) FROM enriched) - (SELECT count(DISTINCT fingerprint)
        FROM enriched WHERE usage_date > '2024-01-15') AS skipped, 0 AS again
    FROM enriched GROUP BY 1""", "enriched"))
def _(b):
    root, raw = b.root("sk1"), b.raw_billing
    early = raw.where("usage_date <= '2024-01-15'")
    tables.insert_if_absent(nm.normalise(early), root, "billing_records")
    everything = nm.normalise(raw, dedup=False)
    counts = tables.insert_if_absent(everything, root, "billing_records")
    again = tables.insert_if_absent(everything, root, "billing_records")
    return tables.scan(b.spark, root, "billing_records").groupBy("usage_date").agg(
        F.count(F.lit(1)).alias("stored"), F.lit(counts["inserted"]).alias("inserted"),
        F.lit(counts["skipped"]).alias("skipped"), F.lit(again["inserted"]).alias("again"))


@entry("sk2_audit_log", sql("""
    SELECT cloud_provider, 'success' AS status, count(DISTINCT fingerprint) AS records_inserted,
      0 AS records_skipped FROM enriched GROUP BY 1""",
    "enriched"))
def _(b):
    from costlens.plans import ingest
    root, landing = b.root("sk2"), landed(b)

    class One(src.ParquetSource):
        def __init__(self, cloud):
            super().__init__(landing)
            self.cloud_provider = cloud

        def read(self, spark, start=None, end=None):
            return src.read_billing(spark, self.root, self.cloud_provider, start, end)

    for cloud in ("aws", "azure", "gcp"):
        ingest.load_provider(b.spark, One(cloud), root, "2024-01-01", "2024-01-31",
                             F.to_timestamp(F.lit("2024-02-01 00:00:00")))
    return tables.scan(b.spark, root, "ingestion_log").select(
        "cloud_provider", "status", "records_inserted", "records_skipped")


@entry("sk3_rollup_upsert", sql(f"""
    SELECT CAST(agg_date AS VARCHAR) AS agg_date, {DIMS}, total_cost_usd, record_count
    FROM daily""", "daily"))
def _(b):
    root, fresh = b.root("sk3"), b.daily
    stale = flt.date_range(fresh, "agg_date", end="1998-12-31").withColumn(
        "total_cost_usd", F.lit(-1.0))
    tables.merge(stale, root, "daily_aggregates")
    tables.merge(fresh, root, "daily_aggregates")
    return tables.scan(b.spark, root, "daily_aggregates").drop("avg_cost_usd")


@entry("sk4_feature_upsert", sql(f"""
    SELECT CAST(feature_date AS VARCHAR) AS feature_date, {DIMS}, total_cost_usd, cost_lag_7d,
      {s32('z_score_30d')} AS z_score_30d, true AS stamped FROM feat""", "feat"))
def _(b):
    root, rows = b.root("sk4"), b.features
    first = flt.date_range(rows, "feature_date", start="1999-01-01").withColumn(
        "total_cost_usd", F.lit(999.0))
    tables.merge(first, root, "spend_features")
    tables.merge(rows.withColumn("computed_at", F.current_timestamp()), root, "spend_features")
    out = tables.scan(b.spark, root, "spend_features").withColumn(
        "stamped", F.col("computed_at").isNotNull())
    return f32(out.select(*FEATURE_KEY, "total_cost_usd", "cost_lag_7d", "z_score_30d",
                          "stamped"), "z_score_30d")


@entry("sk5_anomaly_upsert", sql("""
    SELECT anomaly_id, severity, ensemble_score, CASE WHEN usage_date <= DATE '2024-01-15' THEN 1
      ELSE expected_cost END AS expected_cost FROM anom""", "anom"))
def _(b):
    root, rows = b.root("sk5"), b.anomalies
    old = flt.date_range(rows, "usage_date", end="2024-01-15").withColumns({
        "severity": F.lit("low"), "ensemble_score": F.lit(0.0), "expected_cost": F.lit(1.0)})
    tables.merge(old, root, "anomalies")
    tables.merge(rows, root, "anomalies", ["severity", "ensemble_score"])
    return tables.scan(b.spark, root, "anomalies").select(
        "anomaly_id", "severity", "ensemble_score", "expected_cost")


FKEY = ["cloud_provider", "service", "horizon_days", "forecast_date", "model_used"]


@entry("sk6_forecast_upsert", sql("""
    SELECT cloud_provider, service, horizon_days, CAST(forecast_date AS VARCHAR) AS forecast_date,
      model_used, predicted_cost, CASE WHEN forecast_date < DATE '1998-01-01' THEN
      '1990-01-01 00:00:00' ELSE strftime(generated_at, '%Y-%m-%d %H:%M:%S') END AS generated_at
    FROM fcst""", "fcst"))
def _(b):
    root, rows = b.root("sk6"), b.forecasts
    old = flt.date_range(rows, "forecast_date", end="1997-12-31").withColumns({
        "predicted_cost": F.lit(0.0), "generated_at": F.to_timestamp(F.lit("1990-01-01"))})
    tables.merge(old, root, "forecasts")
    tables.merge(rows, root, "forecasts", ["predicted_cost", "lower_bound", "upper_bound"])
    return tables.scan(b.spark, root, "forecasts").select(*FKEY, "predicted_cost", "generated_at")


@entry("sk7_attribution_upsert", sql(f"""
    SELECT CAST(attribution_date AS VARCHAR) AS attribution_date, {DIMS}, total_cost_usd,
      top_driver_1, 5 AS n_values FROM attr""", "attr"))
def _(b):
    root, rows = b.root("sk7"), b.attributions
    old = flt.date_range(rows, "attribution_date", end="1997-12-31").withColumn(
        "top_driver_1", F.lit("stale"))
    tables.merge(old, root, "cost_attributions")
    tables.merge(rows, root, "cost_attributions")
    return tables.scan(b.spark, root, "cost_attributions").select(
        "attribution_date", *DIMENSIONS, "total_cost_usd", "top_driver_1",
        F.size("shap_values").alias("n_values"))


@entry("sk8_alert_insert", sql("""
    SELECT alert_id, CASE WHEN alert_date <= DATE '2024-01-10' THEN 'kept' ELSE title END AS title
    FROM alert""", "alert"))
def _(b):
    root, rows = b.root("sk8"), b.alerts
    old = flt.date_range(rows, "alert_date", end="2024-01-10").withColumn("title", F.lit("kept"))
    tables.insert_if_absent(old, root, "alerts")
    tables.insert_if_absent(rows, root, "alerts")
    return tables.scan(b.spark, root, "alerts").select("alert_id", "title")


FLAGGED = f"""SELECT cloud_provider, service_category, account_id, usage_date,
    max(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END) AS r
    FROM (SELECT cloud_provider, service_category, account_id, feature_date AS usage_date,
      severity FROM found WHERE severity IS NOT NULL) GROUP BY ALL"""


def _flagged(b):
    from costlens.plans.detect import ZScore, combine
    scored = combine(ZScore().score(b.features)).where("severity IS NOT NULL")
    return scored.select("cloud_provider", "service_category", "account_id",
                         F.col("feature_date").alias("usage_date"), "severity")


MARKED = """SELECT b.record_id, anomaly_flag OR r IS NOT NULL AS anomaly_flag,
    coalesce((['low','medium','high','critical'])[r], anomaly_severity) AS anomaly_severity
    FROM bill b LEFT JOIN fl USING (cloud_provider, service_category, account_id, usage_date)"""


@entry("jn4_flag_by_dimensions", sql(MARKED, "found", "bill", fl=FLAGGED))
def _(b):
    return tables.flag_by_dimensions(b.billing, _flagged(b)).select(
        "record_id", "anomaly_flag", "anomaly_severity")


def _billing_stored(b, root: str) -> None:
    full = b.billing.withColumns({
        "service_name_raw": F.col("service_category"),
        "ingested_at": F.col("usage_date").cast("timestamp"), "cost_original": F.col("cost_usd"),
        "currency_original": F.lit("USD")})
    tables.insert_if_absent(full, root, "billing_records")


@entry("sk9_update_flags", sql(MARKED, "found", "bill", fl=FLAGGED))
def _(b):
    root = b.root("sk9")
    _billing_stored(b, root)
    tables.update_flags(root, _flagged(b))
    return tables.scan(b.spark, root, "billing_records").select(
        "record_id", "anomaly_flag", "anomaly_severity")


@entry("sk10_flag_by_identifier", sql("""
    SELECT record_id, anomaly_flag OR h AS anomaly_flag, CASE WHEN h THEN 'critical'
      ELSE anomaly_severity END AS anomaly_severity FROM (SELECT *,
      environment IS NULL OR service_category = '1-URGENT' AS h FROM bill)""", "bill"))
def _(b):
    rows = b.billing
    by_print = rows.where("environment IS NULL").select(F.col("fingerprint").alias("identifier"))
    by_record = rows.where("service_category = '1-URGENT'").select(
        F.col("record_id").alias("identifier"))
    ids = by_print.unionByName(by_record).withColumn("severity", F.lit("critical"))
    root = b.root("sk10")
    _billing_stored(b, root)
    tables.update_flags_by_identifier(root, ids)
    return tables.scan(b.spark, root, "billing_records").select(
        "record_id", "anomaly_flag", "anomaly_severity")


@entry("jn5_semi_on_either", sql("""
    SELECT record_id FROM bill WHERE environment IS NULL OR service_category = '1-URGENT'""",
    "bill"))
def _(b):
    rows = b.billing
    ids = rows.where("environment IS NULL").select(
        F.col("fingerprint").alias("identifier")).unionByName(
        rows.where("service_category = '1-URGENT'").select(F.col("record_id").alias("identifier")))
    return joins.semi_on_either(rows, ids, "fingerprint", "record_id").select("record_id")


@entry("sk11_resolve_alerts", sql("""
    SELECT alert_id, is_resolved OR severity = 'critical' AS is_resolved,
      NOT is_resolved AND severity = 'critical' AS changed, CASE WHEN NOT is_resolved AND
      severity = 'critical' THEN '2024-03-01 00:00:00' ELSE strftime(resolved_at,
      '%Y-%m-%d %H:%M:%S') END AS resolved_at FROM alert""", "alert"))
def _(b):
    rows = b.alerts
    todo = rows.where("severity = 'critical'").select(
        "alert_id", F.to_timestamp(F.lit("2024-03-01 00:00:00")).alias("resolved_at"))
    root = b.root("sk11")
    tables.insert_if_absent(rows, root, "alerts")
    tables.resolve_stored(root, todo.unionByName(todo))
    stored = tables.scan(b.spark, root, "alerts").select("alert_id", "is_resolved", "resolved_at")
    changed = tables.resolve(rows, todo).select("alert_id", "changed")
    return stored.join(changed, "alert_id").select("alert_id", "is_resolved", "changed",
                                                   "resolved_at")


@entry("sk12_dataset_writer", sql("""
    SELECT cloud_provider, count(*) AS n, min(usage_date) AS first, max(usage_date) AS last
    FROM raw GROUP BY 1""", "raw"))
def _(b):
    target = b.root("dataset")
    tables.write_dataset(b.raw_billing, target)
    return b.spark.read.parquet(target).groupBy("cloud_provider").agg(
        F.count(F.lit(1)).alias("n"), F.min("usage_date").alias("first"),
        F.max("usage_date").alias("last"))


@entry("sk13_unlabelled_csv", sql("""
    SELECT record_id, cloud_provider, usage_date, cost_usd, 14 AS n_columns FROM raw""", "raw"))
def _(b):
    target = b.root("csv")
    tables.write_unlabelled_csv(b.raw_billing, target)
    rows = b.spark.read.option("header", True).option("escape", '"').csv(target)
    return rows.select("record_id", "cloud_provider", "usage_date",
                       F.col("cost_usd").cast("double").alias("cost_usd"),
                       F.lit(len(rows.columns)).alias("n_columns"))


@entry("sk14_csv_round_trip", sql("""
    SELECT record_id, tags, nullif(region, '') AS region FROM raw""", "raw"))
def _(b):
    target = b.root("export")
    tables.write_csv(b.raw_billing.select("record_id", "tags", "region"), target)
    return b.spark.read.option("header", True).option("quote", '"').option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).csv(target)


@entry("sk15_manifest", sql("""
    SELECT min(usage_date) AS start, max(usage_date) AS "end", count(*) AS total_records,
      count(*) FILTER (WHERE is_anomaly) AS total_anomaly_records,
      CAST(count(*) FILTER (WHERE is_anomaly) AS DOUBLE) / greatest(1, count(*))
        AS anomaly_rate_actual FROM raw""", "raw"))
def _(b):
    target = b.root("manifest")
    tables.write_manifest(reports.dataset_manifest(b.raw_billing), target)
    return b.spark.read.json(target)


@entry("sk16_bootstrap", sql(f"""
    SELECT {len(TABLES)} AS created, 0 AS created_again, count(*) AS n FROM bill""", "bill"))
def _(b):
    root = b.root("sk16")
    created, again = tables.bootstrap(b.spark, root), tables.bootstrap(b.spark, root)
    tables.insert_if_absent(b.billing.withColumns({
        "service_name_raw": F.col("service_category"),
        "ingested_at": F.col("usage_date").cast("timestamp"), "cost_original": F.col("cost_usd"),
        "currency_original": F.lit("USD")}), root, "billing_records")
    tables.register(b.spark, root)
    rows = b.spark.sql("SELECT count(*) AS n FROM billing_records")
    return rows.select(F.lit(len(created)).alias("created"),
                       F.lit(len(again)).alias("created_again"), "n")


@entry("sk17_groups_to_train", sql("""
    SELECT DISTINCT cloud_provider, service_category FROM feat WHERE cloud_provider <> 'aws'""",
    "feat"))
def _(b):
    root, rows = b.root("sk17"), b.features
    tables.save_params(at.fit(rows.where("cloud_provider = 'aws'")), root, "attribution")
    known = tables.load_params(b.spark, root, "attribution")
    return tables.groups_to_train(rows.select(*at.GROUP).distinct(), known, at.GROUP)


# --- keyed joins -------------------------------------------------------------------

LATEST = """SELECT f.* FROM fcst f JOIN (SELECT cloud_provider, service, max(generated_at)
    AS generated_at FROM fcst {where} GROUP BY ALL) USING (cloud_provider, service, generated_at)"""


@entry("jn1_latest_forecast", sql("""
    SELECT 'aggregated_' || CAST(forecast_date AS VARCHAR) AS forecast_id, 'All Clouds' AS
      cloud_provider, 'All Services' AS service, CAST(NULL AS VARCHAR) AS region,
      30 AS horizon_days, CAST(forecast_date AS VARCHAR) AS forecast_date,
      CAST(forecast_date AS VARCHAR) AS forecast_date_display, 'ensemble' AS model_used,
      strftime(max(generated_at), '%Y-%m-%d %H:%M:%S') AS generated_at,
      round(sum(predicted_cost), 2) AS predicted_cost, round(sum(lower_bound), 3) AS lower_bound,
      round(sum(upper_bound), 3) AS upper_bound FROM l WHERE horizon_days <= 30
    GROUP BY forecast_date""", "fcst", l=LATEST.format(where="")))
def _(b):
    out = rounded(fq.latest_forecast(b.forecasts), 2, "predicted_cost")
    return rounded(out, 3, "lower_bound", "upper_bound")


@entry("fn35_wildcard_labels", sql("""
    SELECT DISTINCT 'aws' AS cloud_provider, 'All Services' AS service, 'aggregated_' ||
      CAST(forecast_date AS VARCHAR) AS forecast_id FROM l WHERE cloud_provider = 'aws'""",
    "fcst", l=LATEST.format(where="")))
def _(b):
    return fq.latest_forecast(b.forecasts, cloud="aws", horizon=90).select(
        "cloud_provider", "service", "forecast_id")


RISK_ROWS = """SELECT CAST(forecast_date AS VARCHAR) AS forecast_date,
    round(sum(predicted_cost), 2) AS predicted_cost FROM l WHERE horizon_days <= 30
    GROUP BY 1"""


@entry("jn2_latest_in_cloud", sql(RISK_ROWS, "fcst", l=LATEST.format(
    where="WHERE cloud_provider = 'gcp' AND horizon_days <= 30") + " WHERE cloud_provider = 'gcp'"))
def _(b):
    return rounded(fq.risk_series(b.forecasts, "gcp"), 2, "predicted_cost").select(
        "forecast_date", "predicted_cost")


@entry("jn3_latest_across_clouds", sql(RISK_ROWS, "fcst", l=LATEST.format(
    where="WHERE horizon_days = 30")))
def _(b):
    return rounded(fq.risk_series(b.forecasts), 2, "predicted_cost").select(
        "forecast_date", "predicted_cost")


@entry("jn6_new_alerts_anti_join", sql("""
    SELECT DISTINCT alert_type, cloud_provider, service_category,
      CAST(alert_date AS VARCHAR) AS alert_date FROM alert a WHERE NOT EXISTS (
      SELECT 1 FROM alert s WHERE s.is_resolved AND s.severity = 'low'
        AND s.alert_type = a.alert_type AND s.cloud_provider = a.cloud_provider
        AND s.service_category IS NOT DISTINCT FROM a.service_category
        AND s.alert_date = a.alert_date)""", "alert"))
def _(b):
    from costlens.plans.alerts import LOGICAL_KEY, new_alerts
    rows = b.alerts
    return new_alerts(rows, rows.where("is_resolved AND severity = 'low'")).select(*LOGICAL_KEY)


@entry("jn7_fingerprint_anti_join", sql("""
    SELECT fingerprint FROM norm WHERE fingerprint NOT IN (SELECT fingerprint FROM enriched
      WHERE usage_date <= '2024-01-15')""", "norm"))
def _(b):
    raw = nm.with_fingerprint(b.raw_billing)
    stored = raw.where("usage_date <= '2024-01-15'")
    once = nm.deduplicate(raw)
    return joins.null_safe_anti(once, stored, ["fingerprint"]).select("fingerprint")


@entry("jn8_combine_detectors", sql(f"""
    SELECT feature_date, {DIMS}, {s32('(z * 0.45::DOUBLE + f * 0.55::DOUBLE) / (0.45::DOUBLE + 0.55::DOUBLE)')} AS
      ensemble_score FROM (SELECT CAST(feature_date AS VARCHAR) AS feature_date, {DIMS},
      {ctes.ZSCORE.format(z='z_score_30d')} AS z,
      least(1, coalesce(abs(pct_change_7d), 0)) AS f FROM feat)""", "feat"))
def _(b):
    from costlens.plans.detect import ZScore, combine
    rows = b.features
    second = rows.select(*FEATURE_KEY, F.least(F.lit(1.0), F.coalesce(
        F.abs("pct_change_7d"), F.lit(0.0))).alias("iforest_score"))
    scored = combine(ZScore().score(rows).join(second, FEATURE_KEY))
    return f32(scored.select(*FEATURE_KEY, "ensemble_score"), "ensemble_score")


@entry("jn10_share_of_total", sql(f"""
    SELECT environment, {s32('sum(cost_usd) / nullif((SELECT sum(cost_usd) FROM bill), 0) * 100')}
      AS pct FROM bill GROUP BY 1""", "bill"))
def _(b):
    return f32(rollup.shares(b.billing, "environment").select(
        F.col("dimension").alias("environment"), F.col("pct_of_total").alias("pct")), "pct")


@entry("jn12_group_parameters", sql(f"""
    SELECT anomaly_id, {s32("CASE WHEN m > 0 THEN least(1, ensemble_score / m) ELSE 0 END")} AS score FROM anom
    LEFT JOIN (SELECT cloud_provider, service, max(ensemble_score) AS m FROM anom
      GROUP BY ALL HAVING service <> 'other') USING (cloud_provider, service)""", "anom"))
def _(b):
    from costlens.functions import scoring as sc
    keys = ["cloud_provider", "service"]
    params = b.anomalies.where("service <> 'other'").groupBy(*keys).agg(
        F.max("ensemble_score").alias("threshold"))
    scored = joins.salted_left_join(b.anomalies, params, keys, ["anomaly_id"])
    score = F.coalesce(sc.reconstruction_score(F.col("ensemble_score"), F.col("threshold")),
                       F.lit(0.0))
    return f32(scored.select("anomaly_id", score.alias("score")), "score")


@entry("jn14_duplicate_twins", sql("""
    SELECT cloud_provider, service, usage_date, original_cost, count(*) AS copies FROM raw
    GROUP BY ALL HAVING count(*) >= 2""", "raw"))
def _(b):
    from costlens.operators.quality import with_twins
    return with_twins(b.raw_billing)


@entry("st3_union_of_dates", sql("""
    SELECT DISTINCT CAST(forecast_date AS VARCHAR) AS forecast_date FROM fcst""", "fcst"))
def _(b):
    f = b.forecasts
    left = f.where("model_used = 'seasonal'").select("forecast_date").distinct()
    right = f.where("model_used = 'ensemble'").select("forecast_date").distinct()
    return left.join(right, "forecast_date", "full_outer")
