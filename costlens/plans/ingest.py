"""Loading jobs: scan, normalise, insert what is new, refresh the rollup, audit."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from costlens import constants as C, session
from costlens.functions import calendar as cal, identity
from costlens.operators import filters as flt, rollup, tables
from costlens.plans.normalise import accepted_and_rejected, normalise
from costlens.sources.billing import Source


def rejects(raw: DataFrame) -> DataFrame:
    """Rows that cannot be normalised, whole, with the reason, in the rejects schema.

    The date is that of ingestion, or a fixed one where it does not parse, so that a
    repeated load finds the rows it stored before.
    """
    _, bad = accepted_and_rejected(raw)
    row = F.to_json(F.struct(*raw.columns), {"ignoreNullFields": "false"})
    return bad.select(
        identity.row_id(F.col("reject_reason"), row).alias("reject_id"),
        F.coalesce(F.col("ingested_at").cast("date"), F.lit("1970-01-01").cast("date"))
        .alias("reject_date"), "reject_reason", "cloud_provider", "record_id", row.alias("raw_row"))


def store(raw: DataFrame, root: str) -> dict[str, int]:
    """Insert accepted rows that are new and keep the rejected ones; counts of both."""
    counts = tables.insert_if_absent(normalise(raw), root, "billing_records", unique=True)
    return counts | {"errors": store_rejects(raw, root)}


def store_rejects(raw: DataFrame, root: str) -> int:
    """Keep the rejected rows; how many there are, stored before or not."""
    bad = session.materialize(rejects(raw), "rejects")
    return 0 if bad.isEmpty() else tables.insert_if_absent(bad, root, "rejects")["total"]


def load(raw: DataFrame, root: str, start, end) -> dict[str, int]:
    """One load of raw rows of any number of providers."""
    spark = raw.sparkSession
    counts = store(raw, root)
    billing = tables.scan(spark, root, "billing_records", start, end)
    tables.merge(rollup.daily_rollup(billing, start, end), root, "daily_aggregates")
    return counts


def load_provider(spark: SparkSession, source: Source, root: str, start, end,
                  run_at: Column) -> DataFrame:
    """Load one source and append its audit row; a failure becomes the row's status."""
    began = time.monotonic()
    try:
        counts, status, error = load(source.read(spark, start, end), root, start, end), \
            "success", None
    except Exception as problem:  # noqa: BLE001  one provider must not stop the others
        counts, status, error = {"inserted": 0, "skipped": 0, "errors": 0}, "error", str(problem)
    row = spark.range(1).select(
        identity.row_id(F.lit(source.cloud_provider), F.lit(str(start)), F.lit(str(end)),
                        run_at).alias("log_id"),
        run_at.alias("run_at"), F.lit(source.cloud_provider).alias("cloud_provider"),
        F.lit(counts["inserted"]).alias("records_inserted"),
        F.lit(counts["skipped"]).alias("records_skipped"),
        F.lit(str(start)).cast("date").alias("date_range_start"),
        F.lit(str(end)).cast("date").alias("date_range_end"),
        F.lit(counts["errors"]).alias("error_count"),
        F.lit(time.monotonic() - began).alias("duration_seconds"), F.lit(status).alias("status"),
        F.lit(error).cast("string").alias("error_message"))
    tables.log_run(spark, root, row)
    return row


def run_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("cloud_provider").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("records_inserted").alias("inserted"),
        F.sum("records_skipped").alias("skipped"),
        F.count_if(F.col("status") != "success").alias("failed_runs"))


# --- high-water marks --------------------------------------------------------

STATE_COLUMNS = "cloud_provider string, last_ingested_date date, total_records bigint"


def state_after(state: DataFrame, loaded: DataFrame) -> DataFrame:
    """State merged with a load (cloud_provider, last_date, records).

    The mark moves only for providers that delivered rows, and never back.
    """
    got = loaded.where("records > 0").select(
        "cloud_provider", F.col("last_date").alias("_d"), F.col("records").alias("_n"))
    return state.join(got, "cloud_provider", "full_outer").select(
        "cloud_provider", F.greatest("_d", "last_ingested_date").alias("last_ingested_date"),
        (F.coalesce("total_records", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias(
            "total_records"))


def next_starts(state: DataFrame, fallback: str = C.INGESTION_START) -> DataFrame:
    """Where each provider continues; a provider without a mark starts at the fallback."""
    providers = state.sparkSession.range(1).select(
        F.explode(F.array(*map(F.lit, C.CLOUD_PROVIDERS))).alias("cloud_provider"))
    return providers.join(state, "cloud_provider", "left").select(
        "cloud_provider", cal.next_start(F.col("last_ingested_date"),
                                         F.lit(fallback).cast("date")).alias("next_start"))


def day_before(as_of) -> date:
    return date.fromisoformat(str(as_of)) - timedelta(days=1)


def pending(raw: DataFrame, state: DataFrame, as_of, fallback: str = C.INGESTION_START
            ) -> DataFrame:
    """Raw rows after each provider's mark, up to the day before `as_of`.

    Rows whose date does not parse go by the day they were ingested, and are always
    pending if that is unknown too: they are rejected, once, where they are stored.
    """
    marks = next_starts(state, fallback)
    day = F.coalesce(F.col("usage_date").try_cast("date"), _ingested())
    dated = (F.col("usage_date").try_cast("date").isNull() & day.isNull()) | (
        (day >= F.col("next_start")) & (day <= F.lit(day_before(as_of))))
    return raw.join(F.broadcast(marks), "cloud_provider").where(dated).drop("next_start")


def _ingested() -> Column:
    return F.col("ingested_at").try_cast("timestamp").cast("date")


def undated(raw: DataFrame, start) -> DataFrame:
    """Rows whose date does not parse, ingested from `start` on or at an unknown time.

    The first test is on raw text and reaches the file's statistics: ISO times order as
    text, and other text, which may be anything, is kept.
    """
    at = F.col("ingested_at")
    recent = at.isNull() | (at >= F.lit(str(start))) | (at < F.lit("1"))
    return raw.where(recent).where(F.col("usage_date").try_cast("date").isNull())


def reset(state: DataFrame, cloud: str | None = None) -> DataFrame:
    """State without one provider, or without any."""
    return state.where(F.col("cloud_provider") != cloud) if flt.is_given(cloud) \
        else state.where(F.lit(False))


def _versions(spark: SparkSession, root: str) -> tuple[str, int]:
    """The state's folder and its newest version, -1 if there is none."""
    path = tables.path(root, "ingestion_state")
    found = [int(n.removeprefix("version=")) for n in session.names(spark, path)
             if n.startswith("version=")]
    return path, max(found, default=-1)


def _state_of(spark: SparkSession, path: str, version: int) -> DataFrame:
    if version < 0:
        return spark.createDataFrame([], STATE_COLUMNS)
    return spark.read.schema(STATE_COLUMNS).parquet(f"{path}/version={version}")


def read_state(spark: SparkSession, root: str) -> DataFrame:
    """The newest state version; versions are written whole and never edited."""
    return _state_of(spark, *_versions(spark, root))


def update_state(spark: SparkSession, root: str,
                 change: Callable[[DataFrame], DataFrame], attempts: int = 20) -> DataFrame:
    """Replace the newest version by what `change` makes of it; returns the new state.

    The next version is written aside and published under a name that only one writer
    can take. One that finds it taken changes the newer version instead, so no writer's
    change is lost.
    """
    for _ in range(attempts):
        path, version = _versions(spark, root)
        staged = f"{path}/_staged-{uuid.uuid4().hex}"
        change(_state_of(spark, path, version)).select("cloud_provider", "last_ingested_date",
                                                       "total_records").coalesce(1).write.parquet(staged)
        if session.publish(spark, staged, f"{path}/version={version + 1}"):
            return _state_of(spark, path, version + 1)
    raise RuntimeError(f"the state of {root} was changed by others {attempts} times in a row")


def reset_stored(spark: SparkSession, root: str, cloud: str | None = None,
                 dry_run: bool = False) -> DataFrame:
    """Forget one provider's mark, or all, in the stored state; returns what is left."""
    if dry_run:
        return reset(read_state(spark, root), cloud)
    return update_state(spark, root, lambda state: reset(state, cloud))


def run_incremental(spark: SparkSession, source: Source, root: str, as_of,
                    dry_run: bool = False) -> DataFrame:
    """Load what each provider has after its mark; returns the loaded range and count.

    The earliest mark and the day before `as_of` bound the source's scan; the pending
    rows are staged once and serve the counts and the load. Rows without a readable date
    are sought by the time of their ingestion and end as rejects.
    """
    state = read_state(spark, root)
    first = next_starts(state).agg(F.min("next_start").alias("d")).first()["d"]
    day = F.col("usage_date").try_cast("date")
    rows = source.read(spark, first, day_before(as_of)).where(day.isNotNull())
    rows = pending(rows.unionByName(undated(source.read(spark), first)), state, as_of)
    if not dry_run:
        rows = session.materialize(rows, "ingest-pending")
    loaded = rows.where(day.isNotNull()).groupBy("cloud_provider").agg(
        F.max(day).alias("last_date"), F.min(day).alias("first_date"),
        F.count(F.lit(1)).alias("records"))
    if dry_run:
        return loaded
    done = session.materialize(loaded, "ingest-loaded")
    bounds = done.agg(F.min("first_date").alias("a"), F.max("last_date").alias("b"),
                      F.count(F.lit(1)).alias("n")).first()
    if bounds["n"]:
        load(rows, root, bounds["a"], bounds["b"])
        update_state(spark, root, lambda newest: state_after(newest, done))
    elif not rows.isEmpty():
        store(rows, root)
    return done
