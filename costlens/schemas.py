"""One StructType per table; readers, writers and checks all derive from these."""

from __future__ import annotations

from pyspark.sql import types as T


TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(),
    "bigint": T.LongType(), "boolean": T.BooleanType(), "date": T.DateType(),
    "timestamp": T.TimestampType(), "map<string|string>": T.MapType(T.StringType(), T.StringType()),
    "map<string|double>": T.MapType(T.StringType(), T.DoubleType()),
    "array<int>": T.ArrayType(T.IntegerType()), "array<double>": T.ArrayType(T.DoubleType()),
    "array<array<double>>": T.ArrayType(T.ArrayType(T.DoubleType())),
}


def _struct(fields: str) -> T.StructType:
    """`name type [not null], …`, readable without a session (tasks import this too)."""
    out = T.StructType()
    for field in fields.replace("string,string>", "string|string>").replace(
            "string,double>", "string|double>").split(","):
        name, kind, *rest = field.split()
        out = out.add(name, TYPES[kind], not rest)
    return out


def with_fields(df, keys: list[str], ddl: str) -> T.StructType:
    """The key columns of a frame followed by the fields of a DDL list."""
    return T.StructType([df.schema[k] for k in keys] + _struct(ddl).fields)


RAW_BILLING = _struct("""
    record_id string not null, cloud_provider string not null, account_id string not null,
    service string not null, region string, resource_id string, usage_date string not null,
    cost_usd double not null, original_cost double not null, original_currency string not null,
    exchange_rate double not null, tags string not null, ingested_at string not null,
    is_anomaly boolean, anomaly_type string, anomaly_severity string,
    is_duplicate boolean, is_backdated boolean, notes string""")

BILLING = _struct("""
    record_id string not null, fingerprint string not null, cloud_provider string not null,
    account_id string not null, service_name_raw string not null,
    service_category string not null, region string not null, resource_id string,
    usage_date date not null, ingested_at timestamp not null, cost_original double not null,
    currency_original string not null, cost_usd double not null, usage_quantity double,
    usage_unit string, tags_raw string, tags map<string,string>, environment string,
    team string, anomaly_flag boolean not null, anomaly_severity string""")

DAILY = _struct("""
    agg_date date not null, cloud_provider string not null, service_category string not null,
    account_id string not null, environment string, team string,
    total_cost_usd double not null, record_count bigint not null, avg_cost_usd double not null""")

INGESTION_LOG = _struct("""
    log_id string not null, run_at timestamp not null, cloud_provider string not null,
    records_inserted bigint not null, records_skipped bigint not null, error_count bigint,
    date_range_start date not null, date_range_end date not null, duration_seconds double,
    status string not null, error_message string""")

REJECTS = _struct("""
    reject_id string not null, reject_date date not null, reject_reason string not null,
    cloud_provider string, record_id string, raw_row string not null""")

FEATURES = _struct("""
    feature_date date not null, cloud_provider string not null, service_category string not null,
    account_id string not null, environment string, team string,
    total_cost_usd double not null, record_count bigint not null,
    cost_lag_1d double, cost_lag_7d double, cost_lag_30d double,
    rolling_mean_7d double, rolling_std_7d double, rolling_mean_30d double,
    rolling_std_30d double, pct_change_1d double, pct_change_7d double, pct_change_30d double,
    z_score_30d double, day_of_week int, day_of_month int, week_of_year int, month int,
    is_weekend boolean, is_month_start boolean, is_month_end boolean, computed_at timestamp""")

ANOMALIES = _struct("""
    anomaly_id string not null, record_id string not null, detection_method string not null,
    severity string not null, z_score double, expected_cost double not null,
    actual_cost double not null, deviation_pct double not null, detected_at timestamp not null,
    shap_attribution map<string,double>, cloud_provider string not null, service string not null,
    account_id string not null, usage_date date not null, zscore_score double,
    iforest_score double, sequence_score double, ensemble_score double not null""")

FORECASTS = _struct("""
    forecast_id string not null, cloud_provider string not null, service string not null,
    region string, horizon_days int not null, forecast_date date not null,
    predicted_cost double not null, lower_bound double not null, upper_bound double not null,
    model_used string not null, generated_at timestamp not null, seasonal_prediction double,
    boosted_prediction double, seasonal_weight double, boosted_weight double""")

ATTRIBUTIONS = _struct("""
    attribution_date date not null, cloud_provider string not null,
    service_category string not null, account_id string not null, environment string,
    team string, total_cost_usd double not null, shap_values map<string,double>,
    top_driver_1 string, top_driver_1_value double, top_driver_2 string,
    top_driver_2_value double, top_driver_3 string, top_driver_3_value double,
    model_r2_score double, feature_count int, computed_at timestamp""")

ALERTS = _struct("""
    alert_id string not null, alert_type string not null, severity string not null,
    cloud_provider string, service_category string, account_id string,
    alert_date date not null, created_at timestamp not null, title string not null,
    message string not null, metadata string, is_resolved boolean not null,
    resolved_at timestamp""")

ALERT_RULES = _struct("""
    rule_id string not null, name string not null, rule_type string not null,
    cloud_provider string not null, service_category string, threshold_value double not null,
    severity string not null, is_active boolean not null""")

DIMENSIONS = ["cloud_provider", "service_category", "account_id", "environment", "team"]
DAILY_KEY = ["agg_date", *DIMENSIONS]
FEATURE_KEY = ["feature_date", *DIMENSIONS]

# name -> (schema, natural key, partition column -> derivation from a date column)
TABLES = {
    "billing_records": (BILLING, ["usage_date", "fingerprint"], "usage_date"),
    "daily_aggregates": (DAILY, DAILY_KEY, "agg_date"),
    "ingestion_log": (INGESTION_LOG, ["log_id"], None),
    "rejects": (REJECTS, ["reject_date", "reject_id"], "reject_date"),
    "spend_features": (FEATURES, FEATURE_KEY, "feature_date"),
    "anomalies": (ANOMALIES, ["anomaly_id"], "usage_date"),
    "forecasts": (FORECASTS, ["cloud_provider", "service", "horizon_days", "forecast_date",
                              "model_used"], "forecast_date"),
    "cost_attributions": (ATTRIBUTIONS, ["attribution_date", *DIMENSIONS], "attribution_date"),
    "alerts": (ALERTS, ["alert_id"], "alert_date"),
    "alert_rules": (ALERT_RULES, ["rule_id"], None),
}
