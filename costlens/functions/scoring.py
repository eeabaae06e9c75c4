"""Detector scores, the ensemble and severities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from costlens import constants as C


def zscore_score(z: Column) -> Column:
    """|z| of 1.5 or less scores 0, 5 or more scores 1; no z scores 0."""
    scaled = (F.abs(F.coalesce(F.nanvl(z, F.lit(0.0)), F.lit(0.0))) - 1.5) / 3.5
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled))


def deviation_pct(actual: Column, expected: Column) -> Column:
    return F.when(expected > 0, (actual - expected) / expected * 100).otherwise(F.lit(0.0))


def range_score(raw: Column, low: Column, high: Column) -> Column:
    """1 at the low end of the fitted range, 0 at the high end."""
    width = F.when(high != low, high - low).otherwise(F.lit(1.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - (raw - low) / width))


def reconstruction_score(error: Column, threshold: Column) -> Column:
    return F.when(threshold > 0, F.least(F.lit(1.0), error / threshold)).otherwise(F.lit(0.0))


def ensemble_score(zscore: Column, iforest: Column, sequence: Column,
                   weights: dict[str, float] | None = None) -> Column:
    """Weighted mean; the weight of a missing detector goes to the others."""
    w = weights or C.ENSEMBLE_WEIGHTS
    pairs = [(zscore, w["zscore"]), (iforest, w["iforest"]), (sequence, w["sequence"])]
    total = sum((F.when(s.isNotNull(), F.lit(wt)).otherwise(F.lit(0.0)) for s, wt in pairs),
                F.lit(0.0))
    weighted = sum((F.coalesce(s * F.lit(wt), F.lit(0.0)) for s, wt in pairs), F.lit(0.0))
    return F.when(total > 0, weighted / total).otherwise(F.lit(0.0))


def severity(score: Column) -> Column:
    """Highest threshold reached; NULL below the lowest one."""
    out = None
    for level in reversed(C.SEVERITY_LEVELS):
        test = score >= C.SEVERITY_THRESHOLDS[level]
        out = F.when(test, level) if out is None else out.when(test, level)
    return out


def severity_rank(sev: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, C.SEVERITY_LEVELS)), sev), F.lit(0))


def expected_cost(*expectations: Column) -> Column:
    """Mean of the positive expectations, 0 when there is none."""
    n = sum((F.when(e > 0, 1).otherwise(0) for e in expectations), F.lit(0))
    s = sum((F.when(e > 0, e).otherwise(F.lit(0.0)) for e in expectations), F.lit(0.0))
    return F.when(n > 0, s / n).otherwise(F.lit(0.0))
