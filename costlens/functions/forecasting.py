"""Blend weights, bounds and horizons as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from costlens import constants as C


def floor_at_zero(c: Column) -> Column:
    return F.greatest(F.lit(0.0), c)


def blend_weights(seasonal_mape: Column, boosted_mape: Column,
                  zero_is_missing: bool = False) -> tuple[Column, Column]:
    """Each model is weighted by the other's error.

    A NULL error means the model is missing: the other takes all, and with both
    missing the defaults apply. `zero_is_missing` also reads an error of 0 so.
    """
    s, b = seasonal_mape, boosted_mape
    if zero_is_missing:
        s, b = F.when(s > 0, s), F.when(b > 0, b)
    total = s + b
    default_s, default_b = C.BLEND_DEFAULT_WEIGHTS
    w_s = (F.when(total > 0, b / total)
           .when(s.isNotNull() & b.isNull(), F.lit(1.0))
           .when(b.isNotNull() & s.isNull(), F.lit(0.0))
           .otherwise(F.lit(default_s)))
    w_b = (F.when(total > 0, s / total)
           .when(s.isNotNull() & b.isNull(), F.lit(0.0))
           .when(b.isNotNull() & s.isNull(), F.lit(1.0))
           .otherwise(F.lit(default_b)))
    return w_s, w_b


def interval(predicted: Column, sigma: Column) -> tuple[Column, Column]:
    half = sigma * C.INTERVAL_Z
    return floor_at_zero(predicted - half), predicted + half


def horizon(forecast_date: Column, origin: Column) -> Column:
    return F.datediff(forecast_date, origin)


def band_width(lower: Column, upper: Column) -> Column:
    return upper - lower
