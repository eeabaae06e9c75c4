"""Grouped second-moment sums: the data side of every linear fit.

Each task folds its rows into one small matrix per group; Spark then adds the
matrices cell by cell. What crosses the network does not grow with the rows,
and a group that holds a third of them is summed by every task that has some.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from costlens.schemas import with_fields

FLUSH_CELLS = 8_000_000


def _fold(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Upper triangles of Z'Z per group for one partition."""
    sums: dict[tuple, np.ndarray] = {}

    def emit():
        rows = list(sums.items())
        sums.clear()
        cols = [pa.array([k[i] for k, _ in rows]) for i in range(len(keys))]
        tri = np.triu_indices(rows[0][1].shape[0])
        return pa.RecordBatch.from_arrays(
            cols + [pa.array([m[tri] for _, m in rows], pa.list_(pa.float64()))],
            [*keys, "cells"])

    for batch in batches:
        if not batch.num_rows:
            continue
        z = batch.column("_z")
        z = z.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        groups = batch.select(keys).to_pandas().groupby(keys, dropna=False, sort=False).indices
        for key, at in groups.items():
            key = key if isinstance(key, tuple) else (key,)
            part = z[at].T @ z[at]
            sums[key] = sums[key] + part if key in sums else part
        if sums and len(sums) * z.shape[1] ** 2 > FLUSH_CELLS:
            yield emit()
    if sums:
        yield emit()


def centres(df: DataFrame, keys: list[str], vector: str, size: int) -> DataFrame:
    """One row per group: `_mean` and `_scale`, the deviation, of each place of a vector.

    A column whose deviation is lost in its size is constant and has `_scale` 0.
    """
    def each(f):
        return F.array(*[f(F.get(F.col(vector), F.lit(i))) for i in range(size)])
    stats = df.groupBy(*keys).agg(each(F.avg).alias("_mean"), each(F.stddev_pop).alias("_sd"))
    return stats.withColumn("_scale", F.zip_with("_sd", "_mean", lambda s, m: F.when(
        s > 1e-9 * F.greatest(F.lit(1.0), F.abs(m)), s).otherwise(F.lit(0.0)))).drop("_sd")


def standardised(df: DataFrame, stats: DataFrame, keys: list[str], vector: str, size: int
                 ) -> DataFrame:
    """`df` with `_std`: each number less its group's mean, over its group's deviation;
    0 where that is 0."""
    places = F.sequence(F.lit(0), F.lit(size - 1))
    std = F.transform(places, lambda i: F.when(F.get("_scale", i) > 0, (
        F.get(vector, i) - F.get("_mean", i)) / F.get("_scale", i)).otherwise(F.lit(0.0)))
    return df.join(stats, keys).withColumn("_std", std).drop("_mean", "_scale")


def gram_sums(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys..., pos, value): the upper triangle of sum(z z') per group."""
    schema = with_fields(df, keys, "cells array<double>")
    rows = df.select(*keys, F.col(vector).alias("_z"))
    parts = rows.mapInArrow(lambda it: _fold(it, keys), schema)
    return (parts.select(*keys, F.posexplode("cells").alias("pos", "value"))
            .groupBy(*keys, "pos").agg(F.sum("value").alias("value")))


def unpack(cells: pd.DataFrame, size: int) -> np.ndarray:
    """Symmetric matrix from its (pos, value) cells, zero where absent."""
    flat = np.zeros(size * (size + 1) // 2)
    flat[cells["pos"].to_numpy()] = cells["value"].to_numpy()
    m = np.zeros((size, size))
    m[np.triu_indices(size)] = flat
    return m + np.triu(m, 1).T


def dot(a, b):
    """Inner product of two array columns."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def centred_ridge(g: np.ndarray, l2: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, feature means and target mean from a moment matrix.

    Row 0 is the intercept, the last row the target. Features are standardised
    so that one penalty suits them all; constant ones get a zero coefficient.
    """
    n = g[0, 0]
    mean = g[0, 1:] / n
    cov = g[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    usable = sd[:-1] > 1e-9 * np.maximum(1.0, np.abs(mean[:-1]))
    scale = np.where(usable, sd[:-1], 1.0)
    corr = cov[:-1, :-1] / np.outer(scale, scale)
    rhs = cov[:-1, -1] / scale
    corr[~usable, :] = corr[:, ~usable] = 0.0
    rhs[~usable] = 0.0
    beta = np.linalg.solve(corr + l2 * np.eye(len(rhs)), rhs) / scale
    return np.where(usable, beta, 0.0), mean[:-1], float(mean[-1])


def r_squared(g: np.ndarray, beta: np.ndarray, mean: np.ndarray, base: float) -> float:
    """R² of a fitted line on the rows a moment matrix sums over; 0 for one row or none."""
    n = g[0, 0]
    if n <= 1:
        return 0.0
    coef = np.concatenate([[base - beta @ mean], beta])
    sse = g[-1, -1] - 2 * coef @ g[:-1, -1] + coef @ g[:-1, :-1] @ coef
    sst = g[-1, -1] - g[0, -1] ** 2 / n
    return float(1 - sse / sst) if sst > 0 else 0.0
