"""Content keys: fingerprints, row ids and order-insensitive hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fingerprint(cloud: Column, account: Column, service: Column, usage_date: Column,
                cost: Column, *extra: Column) -> Column:
    """SHA-256 over provider, account, service, ISO date and the cost at six decimals.

    The cost is written as a decimal so that the text never turns to exponents.
    """
    cost_text = F.round(cost, 6).cast("decimal(38,6)").cast("string")
    parts = [cloud, account, service, usage_date.cast("date").cast("string"), cost_text]
    parts += [F.coalesce(e.cast("string"), F.lit("")) for e in extra]
    return F.sha2(F.concat_ws("|", *parts), 256)


def row_id(*parts: Column) -> Column:
    """Deterministic id of a natural key; a re-run yields the same id."""
    texts = [F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts]
    return F.sha2(F.concat_ws("|", *texts), 256)


def composite_record_id(cloud: Column, service: Column, account: Column, day: Column) -> Column:
    return F.concat_ws("_", cloud, service, account, day.cast("string"))


def content_key(**fields: Column) -> Column:
    """MD5 of a JSON object whose keys are sorted, so argument order is irrelevant."""
    return F.md5(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])))
