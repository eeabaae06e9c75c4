"""Alert rules, deduplication and the alert job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from costlens import constants as C
from costlens.functions import budget as bud, identity, scoring as sc, text as tx
from costlens.operators import filters as flt, forecasts as fq, tables
from costlens.operators.dedup import first_wins
from costlens.operators.joins import null_safe_anti

LOGICAL_KEY = ["alert_type", "cloud_provider", "service_category", "alert_date"]


def _alert(rows: DataFrame, kind: str, severity: Column, cloud: Column, service: Column,
           account: Column, day: Column, title: Column, message: Column, metadata: Column,
           created_at: Column) -> DataFrame:
    """Alert columns; the id is a hash of the logical key, stable over re-runs."""
    return rows.select(
        identity.row_id(F.lit(kind), cloud, service, day).alias("alert_id"),
        F.lit(kind).alias("alert_type"), severity.alias("severity"),
        cloud.alias("cloud_provider"), service.cast("string").alias("service_category"),
        account.cast("string").alias("account_id"), day.alias("alert_date"),
        created_at.alias("created_at"), title.alias("title"), message.alias("message"),
        metadata.alias("metadata"), F.lit(False).alias("is_resolved"),
        F.lit(None).cast("timestamp").alias("resolved_at"))


def from_anomalies(anomalies: DataFrame, created_at: Column) -> DataFrame:
    dev, actual, expected = F.col("deviation_pct"), F.col("actual_cost"), F.col("expected_cost")
    meta = tx.json_object(z_score=F.col("z_score"), deviation_pct=dev,
                          detection_method=F.col("detection_method"), actual_cost=actual,
                          expected_cost=expected, anomaly_direction=tx.direction(dev))
    return _alert(anomalies, "anomaly_detected", F.col("severity"), F.col("cloud_provider"),
                  F.col("service"), F.col("account_id"), F.col("usage_date"),
                  tx.anomaly_title(F.col("service"), dev, F.col("usage_date")),
                  tx.anomaly_message(dev, actual, expected), meta, created_at)


def from_spikes(features: DataFrame, created_at: Column, threshold: float = C.SPEND_SPIKE_PCT,
                pct_unit: str = "fraction") -> DataFrame:
    """Day-over-day changes beyond the threshold, in percent.

    Stored changes are fractions and are scaled here; `pct_unit="percent"` takes
    the stored number as it is.
    """
    scale = 100.0 if pct_unit == "fraction" else 1.0
    rows = features.withColumn("_pct", F.col("pct_change_1d") * scale)
    rows = flt.abs_above(rows, "_pct", threshold)
    pct = F.col("_pct")
    title = tx.spike_title(F.col("cloud_provider"), F.col("service_category"), pct)
    meta = tx.json_object(pct_change_1d=pct, total_cost_usd=F.col("total_cost_usd"),
                          rolling_mean_7d=F.col("rolling_mean_7d"))
    return _alert(rows, "spend_spike", tx.spike_severity(pct), F.col("cloud_provider"),
                  F.col("service_category"), F.col("account_id"), F.col("feature_date"),
                  title, title, meta, created_at)


def from_budget(projected: DataFrame, budget: float, as_of: Column, created_at: Column,
                breach_date: Column | None = None) -> DataFrame:
    """One alert per cloud whose projected cost nears or passes the budget."""
    limit = F.lit(float(budget))
    when = breach_date if breach_date is not None else F.lit(None).cast("string")
    sev = bud.budget_severity(F.col("projected_cost"), limit)
    rows = projected.withColumns({"_sev": sev, "_pct": bud.budget_pct(F.col("projected_cost"),
                                                                     limit)})
    rows = rows.where(F.col("_sev").isNotNull())
    title = tx.budget_title(F.col("cloud_provider"), F.col("_pct"), when)
    meta = tx.json_object(projected=F.col("projected_cost"), budget=limit, pct_used=F.col("_pct"),
                          breach_date=when)
    return _alert(rows, "budget_breach_imminent", F.col("_sev"), F.col("cloud_provider"),
                  F.lit(None), F.lit(None), as_of.cast("date"), title, title, meta, created_at)


def new_alerts(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """First candidate per logical key, highest severity first, if not yet stored."""
    rank = -sc.severity_rank(F.col("severity"))
    once = first_wins(candidates, LOGICAL_KEY,
                      [rank, F.col("account_id").asc_nulls_last(), "message"])
    return null_safe_anti(once, stored, LOGICAL_KEY)


def candidates(anomalies: DataFrame, features: DataFrame, forecasts: DataFrame | None, start, end,
               as_of, created_at: Column, cloud=None, budget: float | None = None) -> DataFrame:
    found = flt.equals(flt.date_range(anomalies, "usage_date", start, end), cloud_provider=cloud)
    rows = flt.equals(flt.date_range(features, "feature_date", start, end), cloud_provider=cloud)
    out = from_anomalies(found, created_at).unionByName(from_spikes(rows, created_at))
    if budget is not None and budget > 0 and forecasts is not None:
        projected = fq.projected_by_cloud(forecasts, start, end, cloud)
        out = out.unionByName(from_budget(projected, budget, F.lit(as_of).cast("date"),
                                          created_at))
    return out


def run(spark: SparkSession, root: str, start, end, as_of, created_at: Column, cloud=None,
        budget: float | None = None) -> DataFrame:
    """Evaluate all rules, insert what is new; returns counts per rule and in total."""
    from costlens.session import materialize
    found = materialize(candidates(
        tables.scan(spark, root, "anomalies", start, end),
        tables.scan(spark, root, "spend_features", start, end),
        tables.scan(spark, root, "forecasts", start, end), start, end, as_of, created_at, cloud,
        budget), "alert-candidates")
    stored = tables.scan(spark, root, "alerts", min(str(start), str(as_of)),
                         max(str(end), str(as_of)))
    done = tables.insert_if_absent(new_alerts(found, stored), root, "alerts", unique=True)
    by_type = {t: F.count_if(F.col("alert_type") == t) for t in
               ("anomaly_detected", "spend_spike", "budget_breach_imminent")}
    return found.agg(
        by_type["anomaly_detected"].alias("anomaly_alerts"),
        by_type["spend_spike"].alias("spend_spike_alerts"),
        by_type["budget_breach_imminent"].alias("budget_alerts"),
        F.lit(done["inserted"]).alias("total_inserted"),
        (F.count(F.lit(1)) - done["inserted"]).alias("total_skipped"))


def from_rule_table(rules: DataFrame, spend: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Alerts of user-defined rules.

    `budget_absolute`: actual spend of the rule's scope above the threshold.
    `forecast_variance`: percent by which forecast exceeds actual spend above it.
    Spend (cloud_provider, service_category, actual) and forecasts (…, predicted)
    are one row per scope; a rule without a service covers the cloud.
    """
    by_service = spend.join(forecasts, ["cloud_provider", "service_category"], "full_outer")
    by_cloud = by_service.groupBy("cloud_provider").agg(
        F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted")).withColumn(
        "service_category", F.lit(None).cast("string"))
    scopes = by_service.unionByName(by_cloud).withColumnRenamed(
        "cloud_provider", "_cloud").withColumnRenamed("service_category", "_service")
    active = rules.where("is_active")
    joined = active.join(scopes, (F.col("cloud_provider") == F.col("_cloud"))
                         & F.col("service_category").eqNullSafe(F.col("_service")))
    variance = F.try_divide(F.col("predicted") - F.col("actual"), F.col("actual")) * 100
    value = (F.when(F.col("rule_type") == "budget_absolute", F.col("actual"))
             .when(F.col("rule_type") == "forecast_variance", variance))
    return (joined.withColumn("value", value).where(F.col("value") > F.col("threshold_value"))
            .select("rule_id", "name", "rule_type", "cloud_provider", "service_category",
                    "threshold_value", "value", "severity"))
