"""Cost attribution: additive contributions of the features to each row's cost."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from costlens import constants as C, session
from costlens.operators import filters as flt, gram, series, tables
from costlens.operators.dedup import groups_of_size
from costlens.schemas import DIMENSIONS, with_fields

GROUP = ["cloud_provider", "service_category"]
TARGET = "total_cost_usd"
RIDGE = 1e-4


def fit(features: DataFrame, columns: list[str] = C.ATTRIBUTION_FEATURES,
        min_rows: int = C.MIN_ROWS["attribution"]) -> DataFrame:
    """Coefficients, feature means, base and test R² per (cloud, service).

    The first 70 % of a group's rows in date order are fitted, the last 15 %
    tested. Both need only second moments, of columns that are first centred and
    scaled by their group's mean and deviation: raw moments of large values would
    cancel. The rows are designed once, and one row per group holds the means.
    """
    numbers = [flt.number_or_zero(features, c) for c in columns]
    rows = session.materialize(groups_of_size(features.select(
        *GROUP, "feature_date", *DIMENSIONS[2:], F.array(*numbers, F.col(TARGET)).alias("_raw")),
        GROUP, min_rows), "attribution-rows")
    stats = session.materialize(gram.centres(rows, GROUP, "_raw", len(columns) + 1), "centres")
    rows = gram.standardised(rows, stats, GROUP, "_raw", len(columns) + 1).drop("_raw")
    rows = rows.withColumn("_v", F.concat(F.array(F.lit(1.0)), F.col("_std"))).drop("_std")
    rows = series.chronological_split(rows, GROUP, "feature_date", DIMENSIONS[2:])
    cells = gram.gram_sums(rows.where("split <> 'val'"), [*GROUP, "split"], "_v").join(stats, GROUP)
    size = len(columns) + 2
    schema = with_fields(rows, GROUP, "beta array<double>, centre array<double>, base double, "
                                      "r2 double, train_rows bigint, test_rows bigint")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {s: gram.unpack(p, size) for s, p in pdf.groupby("split")}
        beta, mean, base = gram.centred_ridge(parts["train"], RIDGE)
        test = parts.get("test")
        r2 = gram.r_squared(test, beta, mean, base) if test is not None else 0.0
        at, by = np.array(pdf["_mean"].iloc[0]), np.array(pdf["_scale"].iloc[0])
        wide = np.where(by > 0, by, 1.0)
        beta = np.where(by[:-1] > 0, beta * wide[-1] / wide[:-1], 0.0)
        mean, base = at[:-1] + by[:-1] * mean, float(at[-1] + by[-1] * base)
        return pd.DataFrame([[*pdf.loc[pdf.index[0], GROUP], beta, mean, base, r2,
                              int(parts["train"][0, 0]),
                              int(test[0, 0]) if test is not None else 0]],
                            columns=[f.name for f in schema])

    return cells.groupBy(*GROUP).applyInPandas(solve, schema)


def explain(features: DataFrame, params: DataFrame,
            columns: list[str] = C.ATTRIBUTION_FEATURES) -> DataFrame:
    """`shap_values`: slope times distance from the mean, per feature.

    These are the exact Shapley values of a linear model; with `base` they add
    up to the prediction.
    """
    x = F.array(*[flt.number_or_zero(features, c) for c in columns])
    phi = F.transform(F.arrays_zip(F.col("beta"), F.col("_x"), F.col("centre")),
                      lambda t: t["beta"] * (t["_x"] - t["centre"]))
    rows = features.withColumn("_x", x).join(params, GROUP).withColumn("_phi", phi)
    return rows.withColumns({
        "shap_values": F.map_from_arrays(F.array(*map(F.lit, columns)), F.col("_phi")),
        "prediction": F.col("base") - gram.dot(F.col("beta"), F.col("centre"))
        + gram.dot(F.col("beta"), F.col("_x")),
        "model_r2_score": F.col("r2"), "feature_count": F.lit(len(columns)),
    }).drop("_x", "_phi", "beta", "centre", "r2", "train_rows", "test_rows")


def ranked_drivers(values: Column, columns: list[str], n: int = 3) -> Column:
    """The n largest contributions by size; ties keep the feature order."""
    items = F.array(*[F.struct(
        (-F.abs(F.coalesce(F.try_element_at(values, F.lit(c)), F.lit(0.0)))).alias("rank"),
        F.lit(i).alias("position"), F.lit(c).alias("feature"),
        F.try_element_at(values, F.lit(c)).alias("value")) for i, c in enumerate(columns)])
    return F.slice(F.array_sort(items), 1, n)


def with_top_drivers(rows: DataFrame, columns: list[str] = C.ATTRIBUTION_FEATURES,
                     n: int = 3) -> DataFrame:
    ranked = rows.withColumn("_top", ranked_drivers(F.col("shap_values"), columns, n))
    return ranked.withColumns({
        name: value for i in range(1, n + 1) for name, value in (
            (f"top_driver_{i}", F.get(F.col("_top"), F.lit(i - 1))["feature"]),
            (f"top_driver_{i}_value", F.get(F.col("_top"), F.lit(i - 1))["value"]))}).drop("_top")


def attribute(features: DataFrame, params: DataFrame,
              columns: list[str] = C.ATTRIBUTION_FEATURES) -> DataFrame:
    return with_top_drivers(explain(features, params, columns), columns).withColumnRenamed(
        "feature_date", "attribution_date")


def run(spark: SparkSession, root: str, start, end, computed_at: Column, cloud=None,
        force: bool = False) -> DataFrame:
    """Fit or reuse parameters, attribute, upsert; returns the group report."""
    from costlens.operators.reports import group_top_driver
    features = flt.equals(tables.scan(spark, root, "spend_features", start, end),
                          cloud_provider=cloud)
    known = tables.load_params(spark, root, "attribution")
    todo = tables.groups_to_train(features.select(*GROUP).distinct(), known, GROUP, force)
    fresh = fit(features.join(todo, GROUP, "left_semi"))
    params = tables.merge_params(spark, root, "attribution", fresh, GROUP)
    rows = attribute(features, params).withColumn("computed_at", computed_at)
    tables.merge(rows, root, "cost_attributions")
    stored = tables.scan(spark, root, "cost_attributions", start, end)
    return group_top_driver(stored).join(
        params.select(*GROUP, "r2", "train_rows", "test_rows"), GROUP, "left")


def mean_r2(params: DataFrame) -> DataFrame:
    return params.agg(F.avg("r2").alias("mean_r2"), F.count(F.lit(1)).alias("groups"))
