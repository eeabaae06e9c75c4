"""Raw export rows to the normalised billing schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from costlens import constants as C
from costlens.functions import identity, mapping, tags as tg
from costlens.operators import filters as flt
from costlens.operators.dedup import first_wins
from costlens.operators.tables import conform


def typed(raw: DataFrame) -> DataFrame:
    """Text dates to dates and timestamps; text that does not parse becomes NULL."""
    return raw.withColumns({"usage_date": F.col("usage_date").try_cast("date"),
                            "ingested_at": F.col("ingested_at").try_cast("timestamp")})


def reject_reasons() -> dict[str, Column]:
    """Why a row cannot be normalised, in the order the checks apply."""
    required = ["record_id", "account_id", "service", "usage_date", "cost_usd", "original_cost",
                "original_currency", "tags", "ingested_at"]
    return ({"unknown provider": ~F.col("cloud_provider").isin(C.CLOUD_PROVIDERS)}
            | {f"missing {c}": F.col(c).isNull() for c in required})


def accepted_and_rejected(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    return flt.split_rejects(typed(raw), reject_reasons())


def with_fingerprint(rows: DataFrame, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    return rows.withColumn("fingerprint", identity.fingerprint(
        F.col("cloud_provider"), F.col("account_id"), F.col("service"), F.col("usage_date"),
        F.col("cost_usd"), *[F.col(k) for k in extra_keys]))


def deduplicate(rows: DataFrame) -> DataFrame:
    """The earliest ingested row of each fingerprint."""
    return first_wins(rows, ["fingerprint"], ["ingested_at", "record_id"])


def enrich(rows: DataFrame, parity: bool = False, service_mapping: dict | None = None) -> DataFrame:
    """Category, region, USD cost, parsed tags, environment and team.

    The cost is the original amount at the table's rate. `parity` converts the
    USD column once more instead, as the figures it is compared with do.
    """
    rows = mapping.with_service_category(rows, mapping=service_mapping)
    rows = mapping.with_canonical_region(rows)
    amount = F.col("cost_usd") if parity else F.col("original_cost")
    parsed = rows.withColumn("_tags", tg.parse_tags(F.col("tags")))
    return parsed.select(
        "record_id", "fingerprint", "cloud_provider", "account_id",
        F.col("service").alias("service_name_raw"), "service_category", "region", "resource_id",
        "usage_date", "ingested_at", F.col("original_cost").alias("cost_original"),
        F.col("original_currency").alias("currency_original"),
        mapping.to_usd(amount, F.col("original_currency")).alias("cost_usd"),
        F.lit(None).cast("double").alias("usage_quantity"),
        F.lit(None).cast("string").alias("usage_unit"),
        F.col("tags").alias("tags_raw"), F.col("_tags").alias("tags"),
        tg.environment(F.col("_tags")).alias("environment"),
        tg.team(F.col("_tags")).alias("team"),
        F.lit(False).alias("anomaly_flag"), F.lit(None).cast("string").alias("anomaly_severity"),
        mapping.fx_missing(F.col("original_currency")).alias("fx_missing"))


def normalise(raw: DataFrame, dedup: bool = True, parity: bool = False,
              extra_keys: tuple[str, ...] = (),
              service_mapping: dict | None = None) -> DataFrame:
    """Accepted rows as billing records."""
    good, _ = accepted_and_rejected(raw)
    rows = with_fingerprint(good, extra_keys)
    return conform(enrich(deduplicate(rows) if dedup else rows, parity, service_mapping),
                   "billing_records")


def normalise_metrics(raw: DataFrame) -> DataFrame:
    """Input, output, duplicate and error counts of a run, from one pass over the rows."""
    reasons = reject_reasons()
    bad = F.coalesce(*[F.when(F.coalesce(c, F.lit(True)), True) for c in reasons.values()])
    rows = typed(raw).withColumn("_bad", bad)
    per_key = with_fingerprint(rows).groupBy(F.col("_bad").isNotNull().alias("_bad"),
                                             "fingerprint").agg(
        F.count(F.lit(1)).alias("_n"))
    total = F.coalesce(F.sum("_n"), F.lit(0))
    errors = F.coalesce(F.sum(F.when(F.col("_bad"), F.col("_n"))), F.lit(0))
    kept = F.count_if(~F.col("_bad"))
    return per_key.agg(total.alias("input_count"), kept.alias("output_count"),
                       (total - errors - kept).alias("duplicate_count"),
                       errors.alias("error_count"))


@dataclass(frozen=True)
class Normalised:
    records: DataFrame
    rejects: DataFrame
    metrics: DataFrame


def run(raw: DataFrame, **options) -> Normalised:
    """Records, reject channel and counts of one normalisation run."""
    _, rejects = accepted_and_rejected(raw)
    return Normalised(normalise(raw, **options), rejects, normalise_metrics(raw))

