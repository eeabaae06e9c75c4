"""Structured Streaming forms of ingestion, rollup and alerts.

Late rows are the reason to stream by ingestion order: a usage date up to a week
back still reaches the table, where a usage-date high-water mark would miss it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from costlens import session
from costlens.functions import calendar as cal
from costlens.operators import series, tables
from costlens.operators.rollup import add_up, daily_rollup
from costlens.plans import alerts as al
from costlens.plans.ingest import store, store_rejects
from costlens.plans.normalise import accepted_and_rejected, enrich, normalise, with_fingerprint
from costlens.schemas import RAW_BILLING, TABLES
from costlens.session import materialize
from costlens.streaming import spikes

LATENESS = "8 days"


def read_raw(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New Parquet files of a landing folder, in the raw schema."""
    return (spark.readStream.schema(RAW_BILLING).option("maxFilesPerTrigger", max_files)
            .parquet(path))


def _start(writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingest(raw: DataFrame, root: str, checkpoint: str, available_now: bool = True
           ) -> StreamingQuery:
    """Normalise each micro-batch, insert what is new and keep what is rejected.

    Insert-if-absent makes a replayed batch a no-op.
    """
    def write(batch: DataFrame, _: int) -> None:
        store(materialize(batch, "stream-batch"), root)
    return _start(raw.writeStream.foreachBatch(write), checkpoint, available_now)


def deduplicated(raw: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Stateful dedup: one row per fingerprint among those that arrive within the bound.

    The bound is on arrival, the time of the micro-batch, which only moves forward:
    history that is read late is never dropped, whatever its dates. A copy that
    arrives after the bound is for the target's key to refuse, as `ingest` does.
    """
    good, _ = accepted_and_rejected(raw)
    rows = with_fingerprint(good).withColumn("arrived", F.current_timestamp())
    once = rows.withWatermark("arrived", lateness).dropDuplicatesWithinWatermark(["fingerprint"])
    return enrich(once)


def rollup(raw: DataFrame, root: str, checkpoint: str, available_now: bool = True
           ) -> StreamingQuery:
    """Store each micro-batch and add the rows that were new to the rollup of their days.

    Duplicates, whichever batch brings them, are refused by the stored keys, so the rollup
    is that of the batch job, in any order of files. Of the billing table a batch reads
    the keys, and of the rollup the rows, in the partitions it has rows for.

    Adding is not repeatable by itself, so a batch's steps are written below its number,
    each before it is acted on: the new rows, then the summed partitions, which replace
    the stored ones. A batch that is run again takes up what it finds there.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark, work = batch.sparkSession, f"{checkpoint.rstrip('/')}-rollup"
        new_at, sums_at = f"{work}/{number}/rows", f"{work}/{number}/sums"
        repeated = session.exists(spark, f"{new_at}/_SUCCESS")
        if not repeated:
            rows = materialize(batch, "stream-batch")
            store_rejects(rows, root)
            tables.new_rows(normalise(rows), root, "billing_records").write.mode(
                "overwrite").parquet(new_at)
        new = spark.read.schema(TABLES["billing_records"][0]).parquet(new_at)
        if repeated:
            tables.insert_if_absent(new, root, "billing_records", unique=True)
        else:
            tables.append(new, root, "billing_records")
        if not session.exists(spark, f"{sums_at}/_SUCCESS"):
            delta = materialize(daily_rollup(new), "rollup-delta")
            add_up(tables.touched_with(delta, root, "daily_aggregates")).write.mode(
                "overwrite").parquet(sums_at)
        sums = spark.read.schema(TABLES["daily_aggregates"][0]).parquet(sums_at)
        tables.replace_partitions(sums, root, "daily_aggregates")
        session.remove(spark, f"{work}/{number - 1}")
    return _start(raw.writeStream.foreachBatch(write), checkpoint, available_now)


def spike_alerts(daily: DataFrame, root: str, checkpoint: str, created_at, threshold: float,
                 baseline: DataFrame | None = None, days_apart: int | None = None,
                 available_now: bool = True) -> StreamingQuery:
    """Alert on streamed daily rows against the day before in their series.

    The days of a series that matter are state (`spikes.py`), so a day that streams in is
    compared with one that streamed in before. `baseline` (five dimensions, agg_date,
    total_cost_usd) holds past days to start from; `days_apart` limits how far back the
    day before may be (none: the row before, as in the batch job's features).
    """
    changes = spikes.day_changes(daily, baseline, days_apart)

    def write(batch: DataFrame, _: int) -> None:
        rows = batch.withColumns({
            "pct_change_1d": cal.finite(series.change(F.col("total_cost_usd"),
                                                      F.col("previous_cost"))),
            "rolling_mean_7d": F.lit(None).cast("double")})
        found = materialize(al.from_spikes(rows, created_at, threshold), "stream-alerts")
        span = found.agg(F.min("alert_date").alias("a"), F.max("alert_date").alias("b")).first()
        if span["a"] is None:
            return
        stored = tables.scan(batch.sparkSession, root, "alerts", span["a"], span["b"])
        tables.insert_if_absent(al.new_alerts(found, stored), root, "alerts", unique=True)

    return _start(changes.writeStream.outputMode("append").foreachBatch(write), checkpoint,
                  available_now)


def provider_state(raw: DataFrame) -> DataFrame:
    """Running last date and record count per provider, in complete mode."""
    return raw.groupBy("cloud_provider").agg(
        F.max(F.col("usage_date").try_cast("date")).alias("last_ingested_date"),
        F.count(F.lit(1)).alias("total_records"))


def write_complete(df: DataFrame, path: str, checkpoint: str, available_now: bool = True
                   ) -> StreamingQuery:
    """Each batch's whole result under its batch number; the highest one is current."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return _start(df.writeStream.outputMode("complete").foreachBatch(write), checkpoint,
                  available_now)


def read_complete(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).scalar()).drop("batch")
