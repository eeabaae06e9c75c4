"""Date arithmetic and calendar features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

GRANULARITIES = ("day", "week", "month")


def calendar_columns(day: Column) -> dict[str, Column]:
    """Monday is 0; the week is the ISO week."""
    dow = F.weekday(day)
    return {
        "day_of_week": dow,
        "day_of_month": F.dayofmonth(day),
        "week_of_year": F.weekofyear(day),
        "month": F.month(day),
        "is_weekend": dow >= 5,
        "is_month_start": F.dayofmonth(day) == 1,
        "is_month_end": F.last_day(day) == day,
    }


def quarter(day: Column) -> Column:
    return F.quarter(day)


def truncate(day: Column, granularity: str) -> Column:
    """Start of the day, Monday week or month; an unknown unit means day."""
    unit = granularity if granularity in GRANULARITIES else "day"
    return F.date_trunc(unit, day).cast("date")


def date_series(df: DataFrame, start: Column, end: Column, out: str = "day") -> DataFrame:
    """One row per day of an inclusive range; an inverted range yields none."""
    days = F.when(start <= end, F.sequence(start, end, F.expr("interval 1 day")))
    return df.withColumn(out, F.explode(days))


def months_between(start: Column, end: Column) -> Column:
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def yesterday(as_of: Column) -> Column:
    return F.date_sub(as_of, 1)


def next_start(last_ingested: Column, fallback: Column) -> Column:
    return F.coalesce(F.date_add(last_ingested, 1), fallback)


def finite(c: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
