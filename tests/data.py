"""Literal fixtures."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from costlens.schemas import DAILY, RAW_BILLING


def raw(spark, *rows):
    """Raw billing rows; each argument overrides some columns of a plain EC2 row."""
    base = {"record_id": "r1", "cloud_provider": "aws", "account_id": "a1", "service": "EC2",
            "region": "us-east-1", "resource_id": None, "usage_date": "2023-01-01",
            "cost_usd": 10.0, "original_cost": 10.0, "original_currency": "USD",
            "exchange_rate": 1.0, "tags": "{}", "ingested_at": "2023-01-01T04:00:00Z",
            "is_anomaly": False, "anomaly_type": None, "anomaly_severity": None,
            "is_duplicate": False, "is_backdated": False, "notes": None}
    full = [base | {"record_id": f"r{i}"} | r for i, r in enumerate(rows, 1)]
    loose = type(RAW_BILLING)([type(f)(f.name, f.dataType) for f in RAW_BILLING])
    return spark.createDataFrame([tuple(r[f.name] for f in RAW_BILLING) for r in full], loose)


def daily(spark, costs, start=date(2023, 1, 1), cloud="aws", service="compute", account="a1",
          environment="prod", team="core"):
    rows = [(start + timedelta(days=i), cloud, service, account, environment, team, float(c), 1,
             float(c)) for i, c in enumerate(costs)]
    return spark.createDataFrame(rows, DAILY)


def spike_costs():
    """60 days of 100 + 2i with a 500 on day 44."""
    return [500.0 if i == 44 else 100.0 + 2 * i for i in range(60)]


def normalised(spark, n, day="2023-01-15", cloud="aws", category="compute", prefix="fp", cost=1.0):
    return spark.range(n).select(
        F.concat(F.lit(f"{prefix}-r"), F.col("id").cast("string")).alias("record_id"),
        F.concat(F.lit(f"{prefix}_"), F.col("id").cast("string")).alias("fingerprint"),
        F.lit(cloud).alias("cloud_provider"), F.lit("a1").alias("account_id"),
        F.lit("EC2").alias("service_name_raw"), F.lit(category).alias("service_category"),
        F.lit("us-east").alias("region"), F.lit(day).cast("date").alias("usage_date"),
        F.to_timestamp(F.lit(f"{day} 05:00:00")).alias("ingested_at"),
        F.lit(cost).alias("cost_original"), F.lit("USD").alias("currency_original"),
        F.lit(cost).alias("cost_usd"), F.lit(None).cast("string").alias("environment"),
        F.lit(None).cast("string").alias("team"), F.lit(False).alias("anomaly_flag"))
