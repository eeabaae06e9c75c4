"""Predicates shared by every scan and report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from costlens import constants as C


def date_range(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Inclusive bounds, each optional. An inverted range selects nothing."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(column) <= F.lit(end).cast("date"))
    return df


def is_given(value) -> bool:
    """None, the empty string and the word `all` mean: no filter."""
    return value is not None and value != "" and not (
        isinstance(value, str) and value.lower() == "all")


def equals(df: DataFrame, **wanted) -> DataFrame:
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])),
                  [(k, v) for k, v in wanted.items() if is_given(v)], df)


def member(df: DataFrame, column: str, values: list | None) -> DataFrame:
    return df.where(F.col(column).isin(list(values))) if values else df


def tri_state(df: DataFrame, column: str, wanted: bool | None) -> DataFrame:
    return df if wanted is None else df.where(F.col(column) == F.lit(wanted))


def min_severity(df: DataFrame, level: str | None, score: str = "ensemble_score") -> DataFrame:
    """Severity floor by score; an unknown level filters nothing."""
    if level not in C.SEVERITY_THRESHOLDS:
        return df
    return df.where(F.col(score) >= C.SEVERITY_THRESHOLDS[level])


def min_abs(df: DataFrame, column: str, floor: float | None) -> DataFrame:
    return df if floor is None else df.where(F.abs(F.col(column)) >= floor)


def abs_above(df: DataFrame, column: str, limit: float) -> DataFrame:
    return df.where(F.abs(F.col(column)) > limit)


def any_of_columns(df: DataFrame, value, columns: list[str]) -> DataFrame:
    return df.where(F.lit(value).isin([F.col(c) for c in columns])) if is_given(value) else df


def horizon_at_most(df: DataFrame, days: int | None) -> DataFrame:
    return df.where(F.col("horizon_days") <= days) if days else df


def horizon_exactly(df: DataFrame, days: int | None) -> DataFrame:
    return df if days is None else df.where(F.col("horizon_days") == days)


def known_columns(requested: list[str], allowed: set[str], fallback: list[str]) -> list[str]:
    """The allowed ones in the order asked for, or the fallback when none is."""
    return [c for c in requested if c in allowed] or fallback


def unknown_dimensions(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("unknown")) for c in columns})


def default_window(df: DataFrame, column: str, days: int = 365) -> DataFrame:
    """The last `days` days before the latest date in the data."""
    last = df.agg(F.max(column)).scalar()
    return df.where(F.col(column).between(F.date_sub(last, days), last))


def model_matrix(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Numeric matrix: absent columns and NULLs are 0, booleans are 0/1."""
    return df.select(*keep, *[number_or_zero(df, c).alias(c) for c in columns])


def number_or_zero(df: DataFrame, column: str) -> Column:
    if column not in df.columns:
        return F.lit(0.0)
    c = F.col(column)
    if dict(df.dtypes)[column] == "boolean":
        c = c.cast("int")
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))


def split_rejects(df: DataFrame, reasons: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and rows with the first reason that applies.

    The accepted side is a plain conjunction, so that null checks reach the scan.
    A condition that is NULL rejects.
    """
    reason = F.coalesce(*[F.when(F.coalesce(cond, F.lit(True)), F.lit(name))
                          for name, cond in reasons.items()])
    good = reduce(lambda d, cond: d.where(~cond), reasons.values(), df)
    return good, df.withColumn("reject_reason", reason).where("reject_reason IS NOT NULL")
