"""Data-quality checks as one report: `check`, `failed_rows`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from costlens import constants as C

FEATURE_COLUMNS_REQUIRED = [
    "feature_date", "cloud_provider", "service_category", "account_id", "environment", "team",
    "total_cost_usd", "record_count", "cost_lag_1d", "cost_lag_7d", "cost_lag_30d",
    "rolling_mean_7d", "rolling_std_7d", "rolling_mean_30d", "rolling_std_30d",
    "pct_change_1d", "pct_change_7d", "pct_change_30d", "z_score_30d", "day_of_week",
    "day_of_month", "week_of_year", "month", "is_weekend", "is_month_start", "is_month_end",
]


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [f"Missing column: {c}" for c in required if c not in df.columns]


def schema_failures(raw: DataFrame, schema: T.StructType) -> Column:
    """True where a required field is NULL or does not cast to its type."""
    bad = F.lit(False)
    for f in schema:
        if f.name not in raw.columns:
            bad = bad | F.lit(not f.nullable)
            continue
        typed = F.col(f.name).try_cast(f.dataType)
        bad = bad | (F.col(f.name).isNotNull() & typed.isNull())
        if not f.nullable:
            bad = bad | F.col(f.name).isNull()
    return bad


def unusable_cost(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))


def row_checks(raw: DataFrame, schema: T.StructType) -> dict[str, Column]:
    """Per-row failure conditions over raw billing rows."""
    usage = F.col("usage_date").try_cast("date")
    seen = F.col("ingested_at").try_cast("timestamp").cast("date")
    tags = F.from_json("tags", "map<string,string>")
    return {
        "schema": schema_failures(raw, schema),
        "cost_usable": unusable_cost(F.col("cost_usd")),
        "date_parses": usage.isNull() | seen.isNull(),
        "usage_before_ingest": usage > seen,
        "currency_consistent": F.abs(F.col("original_cost") * F.col("exchange_rate")
                                     - F.col("cost_usd")) >= 0.01,
        "backdated_lag": F.col("is_backdated") & (F.datediff(seen, usage) <= 2),
        "credit_tagged": (F.col("cost_usd") < 0)
        & ~F.coalesce(F.map_contains_key(tags, "credit_type"), F.lit(False)),
        "anomaly_typed": F.col("is_anomaly")
        & F.coalesce(F.trim("anomaly_type"), F.lit("")).isin(""),
        "known_provider": ~F.col("cloud_provider").isin(C.CLOUD_PROVIDERS),
    }


def row_report(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """All row checks in one pass over the data."""
    counted = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n)
                       for n, c in checks.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("failed_rows"))
                      for n in checks])
    return counted.select(F.inline(pairs))


TWIN_KEY = ["cloud_provider", "service", "usage_date", "original_cost"]


def duplicates_without_twin(raw: DataFrame) -> DataFrame:
    """Rows labelled duplicate whose key occurs once; counted per key, never per pair."""
    per_key = raw.groupBy(*TWIN_KEY).agg(F.count(F.lit(1)).alias("_n"),
                                         F.count_if("is_duplicate").alias("_d"))
    lonely = F.sum(F.when(F.col("_n") < 2, F.col("_d")).otherwise(0))
    return per_key.agg(F.lit("duplicate_has_twin").alias("check"),
                       F.coalesce(lonely, F.lit(0)).alias("failed_rows"))


def with_twins(raw: DataFrame) -> DataFrame:
    """Keys that occur at least twice, with their row counts."""
    return (raw.groupBy(*TWIN_KEY).agg(F.count(F.lit(1)).alias("copies"))
            .where(F.col("copies") >= 2))


def conservation(raw: DataFrame) -> DataFrame:
    """Input rows less those kept, rejected and removed as duplicates.

    Each part is counted on its own: the kept rows from the normalised output, the
    rejects from their channel, the duplicates from the accepted rows' keys. Not 0
    when normalisation loses or adds a row.
    """
    from costlens.plans.normalise import accepted_and_rejected, normalise, with_fingerprint
    good, bad = accepted_and_rejected(raw)
    extra = with_fingerprint(good).groupBy("fingerprint").agg(
        (F.count(F.lit(1)) - 1).alias("n"))
    parts = [raw.select(F.lit(1).alias("n")), normalise(raw).select(F.lit(-1).alias("n")),
             bad.select(F.lit(-1).alias("n")), extra.select((-F.col("n")).alias("n"))]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.agg(F.lit("conservation").alias("check"),
                     F.coalesce(F.sum("n"), F.lit(0)).alias("failed_rows"))


def unknown_categories(billing: DataFrame) -> DataFrame:
    known = [*C.SERVICE_NAMES, C.DEFAULT_SERVICE_CATEGORY]
    return billing.agg(F.lit("known_category").alias("check"),
                       F.count_if(~F.col("service_category").isin(known)).alias("failed_rows"))


def flags_without_anomaly(billing: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Flagged billing rows with no anomaly on their (cloud, category, account, date)."""
    keys = ["cloud_provider", "service_category", "account_id", "usage_date"]
    flagged = billing.where("anomaly_flag").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    known = anomalies.select("cloud_provider", F.col("service").alias("service_category"),
                             "account_id", "usage_date").distinct()
    return flagged.join(known, keys, "left_anti").agg(
        F.lit("flag_has_anomaly").alias("check"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("failed_rows"))


def providers_missing(billing: DataFrame) -> DataFrame:
    """Known providers without a billing row."""
    known = billing.sparkSession.range(1).select(
        F.explode(F.array(*map(F.lit, C.CLOUD_PROVIDERS))).alias("cloud_provider"))
    present = billing.groupBy("cloud_provider").agg(F.count(F.lit(1)).alias("_n"))
    return known.join(present, "cloud_provider", "left_anti").agg(
        F.lit("provider_present").alias("check"), F.count(F.lit(1)).alias("failed_rows"))


def shares_off(shares: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """1 when the shares do not add up to 100 within the tolerance."""
    off = F.abs(F.sum("pct_of_total") - 100) > tolerance
    return shares.agg(F.lit("shares_sum").alias("check"),
                      F.when(off, 1).otherwise(0).cast("bigint").alias("failed_rows"))


