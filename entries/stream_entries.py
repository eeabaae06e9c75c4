"""Streaming operators, driven to completion over a landing folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from costlens import session
from costlens.operators import tables
from costlens.streaming import billing as st
from entries.base import entry, rounded
from entries.ctes import sql


FILES = 8


def _landing(b) -> str:
    """The raw view as a folder that a file stream can follow: files of day ranges, in the
    order that their tasks end, so that days come late and early."""
    path = b.root("stream-landing")
    b.raw_billing.repartitionByRange(FILES, "usage_date").write.parquet(path)
    return path


def _stream(b):
    """The landed files in about four micro-batches."""
    return st.read_raw(b.spark, _landing(b), max_files=FILES // 4)


@entry("ss1_stream_ingest", sql("""
    SELECT usage_date, cloud_provider, count(DISTINCT fingerprint) AS n FROM enriched
    GROUP BY ALL""", "enriched"))
def _(b):
    root = b.root("ss1")
    query = st.ingest(_stream(b), root, f"{root}/_checkpoint")
    query.awaitTermination()
    return tables.scan(b.spark, root, "billing_records").groupBy(
        "usage_date", "cloud_provider").agg(F.count(F.lit(1)).alias("n"))


@entry("ss2_stream_dedup", sql("SELECT DISTINCT fingerprint FROM enriched", "enriched"))
def _(b):
    root = b.root("ss2")
    rows = st.deduplicated(_stream(b)).select("fingerprint", "usage_date")
    st._start(rows.writeStream.format("parquet").option("path", f"{root}/out"),
              f"{root}/_checkpoint", True).awaitTermination()
    return b.spark.read.parquet(f"{root}/out").select("fingerprint")


@entry("ss3_stream_rollup", sql(f"""
    SELECT usage_date AS agg_date, cloud_provider, service_category, account_id,
      coalesce(environment, 'unknown') AS environment, coalesce(team, 'unknown') AS team,
      round(sum(usd), 2) AS total_cost_usd, count(*) AS record_count FROM norm
    GROUP BY ALL""", "norm"))
def _(b):
    root = b.root("ss3")
    st.rollup(_stream(b), root, f"{root}/_checkpoint").awaitTermination()
    rows = tables.scan(b.spark, root, "daily_aggregates").drop("avg_cost_usd")
    return rounded(rows, 2, "total_cost_usd")


@entry("ss4_stream_alerts", sql(f"""
    SELECT DISTINCT cloud_provider, service_category, CAST(agg_date AS VARCHAR) AS alert_date
    FROM (SELECT a.*, (a.total_cost_usd - p.total_cost_usd) / p.total_cost_usd * 100 AS pct
      FROM daily a JOIN daily p ON a.agg_date = p.agg_date + 1
        AND a.cloud_provider = p.cloud_provider AND a.service_category = p.service_category
        AND a.account_id = p.account_id AND a.environment = p.environment AND a.team = p.team)
    WHERE abs(pct) > 50""", "daily"))
def _(b):
    """Days are compared with the day before in the calendar, whichever file brought it."""
    query, root = _spikes(b, "ss4", days_apart=1)
    query.awaitTermination()
    return tables.scan(b.spark, root, "alerts").select("cloud_provider", "service_category",
                                                       "alert_date")


def _spikes(b, label: str, **options):
    """Alerts on the rollup, landed as files of consecutive days and streamed file by file."""
    root, path = b.root(label), b.root("daily-landing")
    daily = session.materialize(b.daily, "daily")
    files = daily.repartitionByRange(FILES, "agg_date").sortWithinPartitions("agg_date")
    parts = session.materialize(files.withColumn("file", F.spark_partition_id()), "daily-files")
    for i in range(FILES):
        parts.where(F.col("file") == i).drop("file").write.mode("append").parquet(path)
    stream = b.spark.readStream.schema(daily.schema).option("maxFilesPerTrigger", 4).parquet(path)
    return st.spike_alerts(stream, root, f"{root}/_checkpoint",
                           F.to_timestamp(F.lit("2002-01-01")), 50.0, **options), root


@entry("ss4_stream_as_batch", sql("""
    SELECT DISTINCT cloud_provider, service_category, CAST(feature_date AS VARCHAR) AS alert_date
    FROM feat WHERE abs(pct_change_1d * 100) > 50""", "feat"))
def _(b):
    """Days streamed one file after the other give the alerts of the batch job's features."""
    query, root = _spikes(b, "ss4-batch")
    query.awaitTermination()
    return tables.scan(b.spark, root, "alerts").select("cloud_provider", "service_category",
                                                       "alert_date")


@entry("ss5_stream_provider_state", sql("""
    SELECT cloud_provider, max(usage_date) AS last_ingested_date, count(*) AS total_records
    FROM raw GROUP BY 1""", "raw"))
def _(b):
    root = b.root("ss5")
    state = st.provider_state(_stream(b))
    st.write_complete(state, f"{root}/state", f"{root}/_checkpoint").awaitTermination()
    return st.read_complete(b.spark, f"{root}/state")

