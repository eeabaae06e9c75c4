"""Billing-shaped frames derived from the given tables.

The given tables are not billing data. These views give every operator whole
tables of the right shape: a raw export from `events`, normalised billing from
`orders`, and anomaly, alert, forecast and attribution rows from both. The maps
below spread keys over providers, accounts and tags; they filter nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from costlens import constants as C
from costlens.functions import scoring
from costlens.operators import series

SERVICES = {"click": "Amazon EC2", "view": " Amazon S3", "purchase": "Amazon RDS",
            "signup": "AWS Lambda", "error": "Unlisted"}
CATEGORIES = {"click": "compute", "view": "storage", "purchase": "database",
              "signup": "compute", "error": "other"}
REGIONS = ["us-east-1", " EastUS ", "europe-west1", "", "mars-1", "ap-south-1"]
CURRENCIES = ["USD", "EUR", "GBP", "INR", "AUD", "CAD", "JPY", "SGD", "CNY"]
TAGS = [
    '{"environment": "production", "team": "data-engineering"}',
    '{"env": "Staging", "owner": "platform"}',
    '{"environment": "canary"}',
    '{"region": "us-east-1", "cost_center": "1234"}',
    '{"broken json',
    '{}',
    '{"stage": "qa", "team": "", "squad": "growth", "credit_type": "refund"}',
    '{"tier": "premium", "project": "atlas"}',
]
KINDS = ["point_spike", "sudden_drop", "tag_explosion", "gradual_drift"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def choose(mapping: dict[str, str], key: Column) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out


def _event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events(table(spark, sf_dir, "events"))


def raw_events(events: DataFrame) -> DataFrame:
    """`k` is the one number in the property text; it is cut out, not parsed, because
    the optimiser copies it into every predicate over the derived columns."""
    number = F.substring_index(F.substring_index("props", ": ", -1), "}", 1)
    return events.withColumns({"k": number.cast("int"), "day": F.col("ts").cast("date")})


def raw_billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw export rows, one per event."""
    return to_raw_billing(_event_rows(spark, sf_dir))


def to_raw_billing(e: DataFrame) -> DataFrame:
    k = F.col("k")
    currency = pick(CURRENCIES, k % 9)
    cost = F.when(k % 20 == 7, -F.floor("value")).otherwise(F.floor("value")).cast("double")
    rate = F.element_at(F.array(*[F.lit(C.FX_RATES.get(c, 1.0)) for c in CURRENCIES]),
                        k % 9 + 1)
    lag = F.when(k % 10 == 3, F.expr("interval 4 days")).otherwise(F.expr("interval 2 hours"))
    odd = k >= 92
    return e.select(
        F.col("event_id").cast("string").alias("record_id"),
        pick(C.CLOUD_PROVIDERS, F.col("user_id") % 3).alias("cloud_provider"),
        F.concat(F.lit("acct-"), (F.col("user_id") % 5).cast("string")).alias("account_id"),
        choose(SERVICES, F.col("event_type")).alias("service"),
        pick(REGIONS, k % 6).alias("region"),
        F.when(k % 5 == 0, "").otherwise(
            F.concat(F.lit("res-"), F.col("user_id").cast("string"))).alias("resource_id"),
        F.col("day").cast("string").alias("usage_date"),
        cost.alias("cost_usd"), F.round(cost / rate, 6).alias("original_cost"),
        currency.alias("original_currency"), rate.alias("exchange_rate"),
        pick(TAGS, k % 8).alias("tags"),
        F.date_format(F.col("ts") + lag, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ingested_at"),
        odd.alias("is_anomaly"),
        F.when(odd, pick(KINDS, k % 4)).otherwise("").alias("anomaly_type"),
        F.when(odd, pick(C.SEVERITY_LEVELS, k % 4)).otherwise("").alias("anomaly_severity"),
        (F.col("event_id") % 200 == 199).alias("is_duplicate"),
        (k % 10 == 3).alias("is_backdated"), F.lit("").alias("notes"))


def billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised billing rows, one per order."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        key.cast("string").alias("record_id"),
        F.concat(F.lit("fp-"), key.cast("string")).alias("fingerprint"),
        choose({"F": "aws", "O": "azure", "P": "gcp"},
               F.col("o_orderstatus")).alias("cloud_provider"),
        F.concat(F.lit("acct-"), (cust % 3).cast("string")).alias("account_id"),
        F.col("o_orderpriority").alias("service_category"),
        pick(["us-east", "europe-west", "asia-south", "unknown"], cust % 4).alias("region"),
        F.col("o_orderdate").cast("date").alias("usage_date"),
        F.col("o_totalprice").alias("cost_usd"),
        choose({"0": "prod", "1": "staging", "2": "dev"},
               (cust % 4).cast("string")).alias("environment"),
        choose({"0": "platform", "1": "growth"}, (cust % 3).cast("string")).alias("team"),
        (key % 50 == 0).alias("anomaly_flag"),
        F.when(key % 50 == 0, "high").alias("anomaly_severity"))


def billing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Billing at line grain: net line price, by the customer's world region."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                                   "o_orderpriority", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").join(
        F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .join(F.broadcast(nations.select("n_nationkey", "r_name")),
                  F.col("c_nationkey") == F.col("n_nationkey"))
            .select(choose({"F": "aws", "O": "azure", "P": "gcp"},
                           F.col("o_orderstatus")).alias("cloud_provider"),
                    F.col("o_orderpriority").alias("service_category"),
                    F.col("r_name").alias("region"),
                    F.col("o_orderdate").cast("date").alias("usage_date"),
                    (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("cost_usd")))


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomaly rows, one per event; the score is k/99, low scores count as `low`."""
    e = _event_rows(spark, sf_dir)
    k = F.col("k")
    score = k / F.lit(99.0)
    expected = F.floor("value").cast("double")
    pct = (k % 41 - 20).cast("double")
    return e.select(
        F.concat(F.lit("an-"), F.col("event_id").cast("string")).alias("anomaly_id"),
        F.col("event_id").cast("string").alias("record_id"),
        pick(["ensemble", "zscore", "isolation_forest"], k % 3).alias("detection_method"),
        F.coalesce(scoring.severity(score), F.lit("low")).alias("severity"),
        ((k - 50) / F.lit(10.0)).alias("z_score"), expected.alias("expected_cost"),
        (expected + expected * pct / 100).alias("actual_cost"), pct.alias("deviation_pct"),
        F.col("ts").cast("timestamp").alias("detected_at"),
        pick(C.CLOUD_PROVIDERS, F.col("user_id") % 3).alias("cloud_provider"),
        choose(CATEGORIES, F.col("event_type")).alias("service"),
        F.concat(F.lit("acct-"), (F.col("user_id") % 5).cast("string")).alias("account_id"),
        F.col("day").alias("usage_date"), score.alias("ensemble_score"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert rows, one per event; severity `info` is outside the known four."""
    e = _event_rows(spark, sf_dir)
    k = F.col("k")
    done = k % 3 == 0
    return e.select(
        F.concat(F.lit("al-"), F.col("event_id").cast("string")).alias("alert_id"),
        pick(["anomaly_detected", "spend_spike", "budget_breach_imminent"],
             k % 3).alias("alert_type"),
        pick([*C.SEVERITY_LEVELS, "info"], k % 5).alias("severity"),
        pick(C.CLOUD_PROVIDERS, F.col("user_id") % 3).alias("cloud_provider"),
        F.when(k % 3 != 2, choose(CATEGORIES, F.col("event_type"))).alias("service_category"),
        F.concat(F.lit("acct-"), (F.col("user_id") % 5).cast("string")).alias("account_id"),
        F.col("day").alias("alert_date"), F.col("ts").cast("timestamp").alias("created_at"),
        F.col("event_type").alias("title"), F.col("props").alias("message"),
        done.alias("is_resolved"),
        F.when(done, F.col("ts").cast("timestamp")).alias("resolved_at"))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast rows from all orders, one per natural key; runs are calendar quarters."""
    o = table(spark, sf_dir, "orders")
    cust, day = F.col("o_custkey"), F.col("o_orderdate").cast("date")
    return (o.select(
        choose({"F": "aws", "O": "azure", "P": "gcp"},
               F.col("o_orderstatus")).alias("cloud_provider"),
        F.col("o_orderpriority").alias("service"),
        pick(["7", "14", "30", "90"], cust % 4).cast("int").alias("horizon_days"),
        day.alias("forecast_date"),
        F.when(cust % 5 == 0, "seasonal").otherwise("ensemble").alias("model_used"),
        F.date_trunc("quarter", F.col("o_orderdate").cast("timestamp")).alias("generated_at"),
        "o_totalprice")
        .groupBy("cloud_provider", "service", "horizon_days", "forecast_date", "model_used",
                 "generated_at")
        .agg(F.round(F.sum("o_totalprice"), 2).alias("predicted_cost"))
        .withColumns({"lower_bound": F.col("predicted_cost") * 0.5,
                      "upper_bound": F.col("predicted_cost") * 1.5}))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    from costlens.operators.rollup import daily_rollup
    return daily_rollup(billing(spark, sf_dir)).withColumn(
        "total_cost_usd", F.round("total_cost_usd", 2))


def features(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    return series.build_features(daily(spark, sf_dir), **kw)


CONTRIBUTIONS = {"cost_lag_1d": 0.5, "cost_lag_7d": -0.25, "cost_lag_30d": 0.125}


def contributions(features_df: DataFrame) -> DataFrame:
    """Feature rows with fixed-slope contributions, for the attribution queries."""
    calendar = {"day_of_week": (F.col("day_of_week") - 3) * 10000.0,
                "month": (F.col("month") - 6) * 9000.0}
    lags = {c: F.coalesce(F.col(c), F.lit(0.0)) * F.lit(b) for c, b in CONTRIBUTIONS.items()}
    return features_df.withColumn("shap_values", F.map_from_arrays(
        F.array(*[F.lit(c) for c in lags | calendar]),
        F.array(*(lags | calendar).values())))


def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from costlens.plans.attribute import with_top_drivers
    rows = contributions(features(spark, sf_dir))
    return with_top_drivers(rows, [*CONTRIBUTIONS, "day_of_week", "month"]).select(
        F.col("feature_date").alias("attribution_date"), "cloud_provider", "service_category",
        "account_id", "environment", "team", "total_cost_usd", "shap_values",
        *[c for i in (1, 2, 3) for c in (f"top_driver_{i}", f"top_driver_{i}_value")])
