"""Lag, rolling and cumulative operators on ordered series.

A feature series is one row per day of one five-dimension key, because it is
read from the daily rollup. Its length is bounded by the calendar however many
billing rows there are, which is what makes a window per series safe.
"""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from costlens import constants as C
from costlens.functions import calendar as cal
from costlens.operators import filters as flt
from costlens.schemas import DIMENSIONS

LAGS = (1, 7, 30)
ROLLING = (7, 30)
STD_FLOOR = 1e-9


def over_series(order: str, keys: list[str] = DIMENSIONS) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(order)


def lag_rows(value: Column, n: int, w: WindowSpec) -> Column:
    """The value n rows back: rows, not days; gaps are not filled."""
    return F.lag(value, n).over(w)


def rolling_mean(value: Column, n: int, w: WindowSpec) -> Column:
    return F.avg(value).over(w.rowsBetween(-(n - 1), 0))


def rolling_std(value: Column, n: int, w: WindowSpec) -> Column:
    """Sample deviation; NULL on a single row."""
    return F.stddev_samp(value).over(w.rowsBetween(-(n - 1), 0))


def change(value: Column, lagged: Column) -> Column:
    """Change as a fraction of the lag; a zero or missing lag gives NULL."""
    return F.try_divide(value - lagged, lagged)


def z_score(value: Column, mean: Column, std: Column) -> Column:
    return (F.when(std.isNull(), F.lit(None).cast("double"))
            .when(std < STD_FLOOR, F.lit(0.0)).otherwise((value - mean) / std))


def lead_rows(value: Column, n: int, w: WindowSpec) -> Column:
    return F.lead(value, n).over(w)


def build_features(daily: DataFrame, start=None, end=None, cloud=None,
                   warmup_days: int = 30) -> DataFrame:
    """Feature rows for [start, end], computed over a warm-up before start.

    One shuffle: all lags and frames share the series partitioning and order.
    """
    rows = flt.equals(daily, cloud_provider=cloud)
    if start is not None:
        rows = rows.where(F.col("agg_date") >= F.date_sub(F.lit(start).cast("date"), warmup_days))
    rows = flt.date_range(rows, "agg_date", None, end)
    w = over_series("agg_date")
    cost = F.col("total_cost_usd")
    rows = rows.withColumns(
        {f"cost_lag_{n}d": lag_rows(cost, n, w) for n in LAGS}
        | {f"rolling_mean_{n}d": rolling_mean(cost, n, w) for n in ROLLING}
        | {f"rolling_std_{n}d": rolling_std(cost, n, w) for n in ROLLING})
    rows = rows.withColumns(
        {f"pct_change_{n}d": change(cost, F.col(f"cost_lag_{n}d")) for n in LAGS}
        | {"z_score_30d": z_score(cost, F.col("rolling_mean_30d"), F.col("rolling_std_30d"))}
        | cal.calendar_columns(F.col("agg_date")))
    rows = flt.date_range(rows, "agg_date", start, None)
    return rows.select(
        F.col("agg_date").alias("feature_date"), *DIMENSIONS, "total_cost_usd", "record_count",
        *[f"cost_lag_{n}d" for n in LAGS],
        "rolling_mean_7d", "rolling_std_7d", "rolling_mean_30d", "rolling_std_30d",
        *[cal.finite(F.col(f"pct_change_{n}d")).alias(f"pct_change_{n}d") for n in LAGS],
        cal.finite(F.col("z_score_30d")).alias("z_score_30d"),
        "day_of_week", "day_of_month", "week_of_year", "month",
        "is_weekend", "is_month_start", "is_month_end")


def rebuild_recent(daily: DataFrame, as_of, days_back: int = 7) -> DataFrame:
    """Features of the last days up to `as_of`, for a partition overwrite."""
    end = date.fromisoformat(str(as_of))
    return build_features(daily, end - timedelta(days=days_back), end)


def _before(rows: DataFrame, groups: list[str], order: list[str], count: str) -> DataFrame:
    """`rows` with `_before`, the sum of `count` over a group's earlier rows."""
    w = W.partitionBy(*groups).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("_before", F.coalesce(F.sum(count).over(w), F.lit(0)))


def _null_safe(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)])


def chronological_split(df: DataFrame, groups: list[str], order: str, tiebreak: list[str],
                        train: float = C.TRAIN_RATIO, val: float = C.VAL_RATIO) -> DataFrame:
    """`split` by row position in the group: first 70 %, next 15 %, the rest.

    Positions come from counts on two levels: the days of a group are cumulated (one row
    per day), then the cells of a day (a cell is a day and a value of the first tiebreak
    column, one row per cell), and rows are numbered only within their own cell. No task
    ever holds a group, nor all rows of a day.
    """
    cell = list(dict.fromkeys([order, *tiebreak[:1]]))
    counts = df.groupBy(*groups, *cell).agg(F.count(F.lit(1)).alias("_n"))
    day_key = [f"_d_{c}" for c in (*groups, order)]
    days = counts.groupBy(*groups, order).agg(F.sum("_n").alias("_n"))
    days = _before(days, groups, [order], "_n").select(
        *[F.col(c).alias(k) for c, k in zip((*groups, order), day_key)],
        F.col("_before").alias("_day_before"),
        F.sum("_n").over(W.partitionBy(*groups)).alias("group_rows"))
    cell_key = [f"_{c}" for c in (*groups, *cell)]
    if len(cell) > 1:
        counts = _before(counts, [*groups, order], cell[1:], "_n").join(
            days, _null_safe([*groups, order], day_key))
        counts = counts.select(
            *[F.col(c).alias(k) for c, k in zip((*groups, *cell), cell_key)],
            (F.col("_before") + F.col("_day_before")).alias("_before"), "group_rows")
    else:
        counts = days.withColumnRenamed("_day_before", "_before").withColumnsRenamed(
            dict(zip(day_key, cell_key)))
    in_cell = W.partitionBy(*groups, *cell).orderBy(*tiebreak)
    train_end = F.floor(F.col("group_rows") * F.lit(train))
    val_end = train_end + F.floor(F.col("group_rows") * F.lit(val))
    return (df.withColumn("_in_cell", F.row_number().over(in_cell))
            .join(counts, _null_safe([*groups, *cell], cell_key))
            .withColumn("position", F.col("_before") + F.col("_in_cell") - 1)
            .withColumn("split", F.when(F.col("position") < train_end, "train")
                        .when(F.col("position") < val_end, "val").otherwise("test"))
            .drop("_in_cell", "_before", *cell_key))


def last_row(df: DataFrame, groups: list[str], order: str) -> DataFrame:
    w = W.partitionBy(*groups).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def trailing_sequences(df: DataFrame, keys: list[str], order: str, columns: list[str],
                       length: int = 30) -> DataFrame:
    """`sequence`: the last `length` rows flattened; absent before the length-th row."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(-(length - 1), 0)
    step = F.array(*[F.col(c).cast("double") for c in columns])
    rows = df.withColumn("_steps", F.collect_list(step).over(w))
    return (rows.where(F.size("_steps") == length)
            .withColumn("sequence", F.flatten("_steps")).drop("_steps"))


def running_totals(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({f"cum_{c}": F.sum(c).over(w) for c in columns})


def first_date_reaching(df: DataFrame, keys: list[str], order: str, running: str,
                        level: Column) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min(F.when(F.col(running) >= level, F.col(order))).alias("breach_date"))


def latest_per_group(df: DataFrame, keys: list[str], column: str, out: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(column).alias(out))
