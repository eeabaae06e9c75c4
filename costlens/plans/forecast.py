"""Spend forecasts: a seasonal model, a boosted model and their blend."""

from __future__ import annotations

import math
import uuid
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import (Column, DataFrame, SparkSession, Window as W, functions as F,
                         types as T)

from costlens import constants as C, session
from costlens.functions import forecasting as fc, identity
from costlens.operators import filters as flt, forecasts as fq, gram, series, tables
from costlens.operators.dedup import groups_of_size
from costlens.schemas import with_fields

GROUP = ["cloud_provider", "service"]


class Forecaster(Protocol):
    """A forecaster plug-in: `fit` gives parameters, `predict` gives dated rows.

    Parameters are all that `predict` reads. What does not fit into a table is written
    below `models` while fitting, and the parameters say where.
    """

    name: str

    def fit(self, series_df: DataFrame, models: str) -> DataFrame: ...

    def predict(self, params: DataFrame, horizon: int) -> DataFrame: ...


def positions(series_df: DataFrame) -> DataFrame:
    """70/15/15 split of each group's daily series, one row per date."""
    return series.chronological_split(series_df, GROUP, "usage_date", ["usage_date"])


def error_columns(predicted: Column, actual: Column | None = None) -> dict[str, Column]:
    """MAE, MAPE, residual population deviation and R² (0 for one row) as aggregates over
    the rows that have a prediction."""
    y = F.when(predicted.isNotNull(), F.col("cost_usd") if actual is None else actual)
    shifted = y + 1e-9
    n = F.count(y)
    sst = F.var_pop(y) * n
    return {
        "mae": F.avg(F.abs(y - predicted)),
        "mape": F.avg(F.try_divide(F.abs(shifted - predicted), F.abs(shifted))),
        "residual_std": F.stddev_pop(y - predicted), "test_rows": n,
        "r2": F.when(n > 1, F.coalesce(1 - F.try_divide(
            F.sum((y - predicted) * (y - predicted)), sst), F.lit(0.0))).otherwise(F.lit(0.0))}


def error_metrics(rows: DataFrame, keys: list[str], actual: str = "cost_usd",
                  predicted: str = "predicted") -> DataFrame:
    """The error columns per key."""
    found = error_columns(F.col(predicted), F.col(actual))
    return rows.groupBy(*keys).agg(*[c.alias(name) for name, c in found.items()])


def mean_over_horizons(metrics: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    return metrics.groupBy(*keys).agg(F.avg("mape").alias("mape"), F.avg("mae").alias("mae"))


class Seasonal:
    """Additive trend and seasonality per (cloud, service).

    Design columns (trend, trend changes, yearly and weekly waves) are built once by
    Spark; the fit needs only their grouped second moments, and only the small
    solve per group is local. Penalties follow the prior widths.

    The trend is taken to go on changing as often and as strongly as it did, so the
    band widens: changes of Laplace size with mean magnitude m, S of them a span, add
    2 S m² τ³ / 3 to the variance τ spans ahead.
    """

    name = "seasonal"
    CHANGEPOINTS = 25
    NOISE = 0.1

    def __init__(self, min_rows: int = C.MIN_ROWS["seasonal"]):
        self.min_rows = min_rows

    def _design(self, day: Column) -> Column:
        t = F.datediff(day, F.col("first_day")) / F.greatest(F.col("span_days"), F.lit(1))
        number = F.unix_date(day).cast("double")

        def waves(period: float, order: int) -> list[Column]:
            return [f(number * (2 * math.pi * k / period)) for k in range(1, order + 1)
                    for f in (F.sin, F.cos)]

        hinges = [F.greatest(F.lit(0.0), t - 0.8 * i / self.CHANGEPOINTS)
                  for i in range(1, self.CHANGEPOINTS + 1)]
        return F.array(F.lit(1.0), t.cast("double"), *hinges,
                       *waves(365.25, C.SEASONAL_YEARLY_ORDER),
                       *waves(7.0, C.SEASONAL_WEEKLY_ORDER))

    def _penalty(self) -> np.ndarray:
        hinge = self.NOISE ** 2 / C.SEASONAL_CHANGEPOINT_PRIOR ** 2
        wave = self.NOISE ** 2 / C.SEASONAL_SEASONALITY_PRIOR ** 2
        waves = 2 * (C.SEASONAL_YEARLY_ORDER + C.SEASONAL_WEEKLY_ORDER)
        return np.array([1e-9, 1e-6] + [hinge] * self.CHANGEPOINTS + [wave] * waves)

    def fit(self, series_df: DataFrame, models: str = "") -> DataFrame:
        """Coefficients fitted on all rows, with the test error of a fit on the first 70 %."""
        rows = positions(groups_of_size(series_df.select(*GROUP, "usage_date", "cost_usd"),
                                        GROUP, self.min_rows))
        spans = rows.groupBy(*GROUP).agg(
            F.min("usage_date").alias("first_day"), F.max("usage_date").alias("last_day"),
            F.max(F.abs("cost_usd")).alias("scale"))
        spans = spans.withColumns({
            "span_days": F.datediff("last_day", "first_day"),
            "scale": F.when(F.col("scale") > 0, F.col("scale")).otherwise(F.lit(1.0))})
        rows = session.materialize(
            rows.join(spans, GROUP).withColumn("x", self._design(F.col("usage_date"))), "design")
        z = rows.withColumn("_v", F.concat("x", F.array(F.col("cost_usd") / F.col("scale"))))
        cells = gram.gram_sums(z, [*GROUP, "split"], "_v")
        penalty = self._penalty()
        size = len(penalty) + 1
        schema = with_fields(rows, GROUP, "train_beta array<double>, beta array<double>")

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            parts = {s: gram.unpack(p, size) for s, p in pdf.groupby("split")}

            def beta(g):
                return np.linalg.solve(g[:-1, :-1] + np.diag(penalty), g[:-1, -1])
            return pd.DataFrame([[*pdf.loc[pdf.index[0], GROUP], beta(parts["train"]),
                                  beta(sum(parts.values()))]],
                                columns=[f.name for f in schema])

        betas = cells.groupBy(*GROUP).applyInPandas(solve, schema)
        fitted = rows.join(betas, GROUP).withColumns({
            "held_out": F.col("scale") * gram.dot(F.col("train_beta"), F.col("x")),
            "predicted": F.col("scale") * gram.dot(F.col("beta"), F.col("x"))})
        errors = error_columns(F.when(F.col("split") == "test", F.col("held_out")))
        tested = fitted.groupBy(*GROUP).agg(
            F.stddev_pop(F.col("cost_usd") - F.col("predicted")).alias("sigma"),
            F.count(F.lit(1)).alias("series_rows"), errors["mae"].alias("mae"),
            errors["mape"].alias("mape"))
        return (rows.groupBy(*GROUP).agg(*[F.any_value(c).alias(c) for c in spans.columns
                                           if c not in GROUP])
                .join(betas.drop("train_beta"), GROUP).join(tested, GROUP))

    def deviation(self, days_ahead: Column) -> Column:
        """Standard deviation of a forecast so many days ahead of the last one."""
        changes = F.slice("beta", 3, self.CHANGEPOINTS)
        size = F.aggregate(changes, F.lit(0.0), lambda s, b: s + F.abs(b)) / self.CHANGEPOINTS
        ahead = days_ahead / F.greatest(F.col("span_days"), F.lit(1))
        rate = self.CHANGEPOINTS / 0.8
        drift = F.col("scale") * size * F.sqrt(F.lit(2 * rate / 3) * F.pow(ahead, F.lit(3.0)))
        return F.sqrt(F.col("sigma") * F.col("sigma") + drift * drift)

    def predict(self, params: DataFrame, horizon: int) -> DataFrame:
        """One row per group and future day."""
        days = F.sequence(F.date_add("last_day", 1), F.date_add("last_day", horizon))
        rows = params.withColumn("forecast_date", F.explode(days))
        rows = rows.withColumn("predicted_cost", F.col("scale") * gram.dot(
            F.col("beta"), self._design(F.col("forecast_date"))))
        low, high = fc.interval(F.col("predicted_cost"), self.deviation(
            F.datediff("forecast_date", "last_day")))
        return rows.select(*GROUP, F.lit(horizon).alias("horizon_days"), "forecast_date",
                           "predicted_cost", low.alias("lower_bound"),
                           high.alias("upper_bound"), "mape", F.lit(self.name).alias("model_name"))


class Boosted:
    """One gradient-boosted regressor per horizon, pooled over groups.

    Each predicts the cost H rows ahead; forecasts start from the last row a group had
    when it was fitted. Pooling lets Spark distribute the rows of one fit; the group
    enters as an indexed feature. The rows of all horizons are designed once, and the
    horizons are fitted as concurrent jobs, each in a scheduler pool of its own.

    A fit writes one Spark pipeline per horizon below `models/version=…`; parameters hold
    (group, horizon, version), the test errors and the group's last row, so any session
    that reaches the folder can predict.
    """

    name = "boosted"

    def __init__(self, horizons: list[int] = C.FORECAST_HORIZONS,
                 max_trees: int = C.BOOSTED_MAX_TREES, depth: int = 5,
                 min_rows: int = C.MIN_ROWS["boosted"], tolerance: float = 0.01):
        """`tolerance`: boosting stops once a tree lowers the validation error by less."""
        self.horizons, self.max_trees, self.depth = horizons, max_trees, depth
        self.min_rows, self.tolerance = min_rows, tolerance

    def _frame(self, series_df: DataFrame) -> DataFrame:
        rows = groups_of_size(series_df, GROUP, self.min_rows).withColumns({
            "month": F.month("usage_date"), "quarter": F.quarter("usage_date")})
        return rows.select(*GROUP, "usage_date", "cost_usd",
                           *[flt.number_or_zero(rows, c).alias(c) for c in C.BOOSTED_FEATURES])

    def targets(self, rows: DataFrame, h: int) -> DataFrame:
        """Rows with the cost h rows ahead; rows without one are dropped."""
        w = W.partitionBy(*GROUP).orderBy("usage_date")
        return rows.withColumn("target", series.lead_rows(F.col("cost_usd"), h, w)).na.drop(
            subset=["target"])

    def design(self, series_df: DataFrame) -> DataFrame:
        """Every row with its place in the group's series, counted from both ends, and the
        target and the split of every horizon (null where the series ends before).

        A series is one row per day, so its window is bounded by the calendar.
        """
        rows = self._frame(series_df)
        w = W.partitionBy(*GROUP).orderBy("usage_date")
        n = F.count(F.lit(1)).over(W.partitionBy(*GROUP))
        rows = rows.withColumns({"position": F.row_number().over(w) - 1, "group_rows": n})
        out = {}
        for h in self.horizons:
            left = F.col("group_rows") - h
            train = F.floor(left * F.lit(C.TRAIN_RATIO))
            val = train + F.floor(left * F.lit(C.VAL_RATIO))
            out[f"target_{h}"] = series.lead_rows(F.col("cost_usd"), h, w)
            out[f"split_{h}"] = F.when(F.col("position") < left, F.when(
                F.col("position") < train, "train").when(
                F.col("position") < val, "val").otherwise("test"))
        return rows.withColumns(out)

    def _regressor(self, validated: bool):
        from pyspark.ml.regression import GBTRegressor
        gbt = GBTRegressor(featuresCol="features", labelCol="target", maxBins=256,
                           predictionCol="predicted", maxIter=self.max_trees,
                           maxDepth=self.depth, stepSize=C.BOOSTED_LEARNING_RATE,
                           seed=C.FOREST_SEED, validationTol=self.tolerance)
        return gbt.setValidationIndicatorCol("is_val") if validated else gbt

    def fit(self, series_df: DataFrame, models: str | None = None) -> DataFrame:
        """Per group and horizon: version, test errors, residual deviation and last row."""
        from pyspark.ml import Pipeline, PipelineModel
        from pyspark.ml.feature import StringIndexer, VectorAssembler
        spark = series_df.sparkSession
        models = models or session.run_path(spark, "models")
        version = uuid.uuid4().hex
        rows = session.materialize(self.design(series_df), "boosted-design")
        last = rows.where(F.col("position") == F.col("group_rows") - 1).select(
            *GROUP, F.col("usage_date").alias("last_date"), F.col("group_rows").alias("series_rows"),
            F.struct(*C.BOOSTED_FEATURES).alias("last_row"))
        codes = [f"{g}_code" for g in GROUP]
        stages = [StringIndexer(inputCol=g, outputCol=c, handleInvalid="keep")
                  for g, c in zip(GROUP, codes)]
        stages.append(VectorAssembler(inputCols=[*C.BOOSTED_FEATURES, *codes],
                                      outputCol="features"))
        have = rows.agg(*[F.count(F.when(F.col(f"split_{h}") == s, 1)).alias(f"{s}_{h}")
                          for h in self.horizons for s in ("train", "val")]).first()
        horizons = [h for h in self.horizons if have[f"train_{h}"]]
        if not horizons:
            return spark.createDataFrame([], self._schema(rows))
        encoder = Pipeline(stages=stages).fit(rows)
        session.checkpoints(spark)

        def fit_one(h: int) -> DataFrame:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"horizon-{h}")
            part = encoder.transform(rows.where(F.col(f"split_{h}").isNotNull()).select(
                *GROUP, *C.BOOSTED_FEATURES, F.col(f"target_{h}").alias("target"),
                F.col(f"split_{h}").alias("split"), (F.col(f"split_{h}") == "val").alias("is_val")))
            model = self._regressor(bool(have[f"val_{h}"])).fit(part.where("split <> 'test'"))
            PipelineModel([*encoder.stages, model]).write().save(_stored(models, version, h))
            tested = model.transform(part).withColumn(
                "predicted", F.when(F.col("split") == "test", F.col("predicted")))
            return session.materialize(error_metrics(tested, GROUP, "target").withColumn(
                "horizon_days", F.lit(h)), "boosted-errors")

        with ThreadPool(len(horizons)) as pool:
            errors = pool.map(inheritable_thread_target(spark)(fit_one), horizons)
        return (reduce(DataFrame.unionByName, errors).join(last, GROUP)
                .withColumns({"version": F.lit(version), "models": F.lit(models)})
                .select(*[f.name for f in self._schema(rows)]))

    def _schema(self, rows: DataFrame) -> T.StructType:
        last = T.StructType([rows.schema[c] for c in C.BOOSTED_FEATURES])
        return (with_fields(rows, GROUP, "horizon_days int, version string, models string, "
                            "mae double, mape double, residual_std double, test_rows bigint, "
                            "r2 double, series_rows bigint, last_date date")
                .add("last_row", last))

    def predict(self, params: DataFrame, horizon: int = max(C.FORECAST_HORIZONS)) -> DataFrame:
        """One row per group and horizon, by the stored models of each group's version."""
        from pyspark.ml import PipelineModel
        rows = params.where(F.col("horizon_days") <= horizon).select(
            *GROUP, "horizon_days", "version", "last_date", "residual_std", "last_row.*")
        # one row per training run and horizon, whatever the number of groups
        versions = params.where(F.col("horizon_days") <= horizon).select(
            "models", "version", "horizon_days").distinct()
        parts = [PipelineModel.load(_stored(v["models"], v["version"], v["horizon_days"])).transform(
            rows.where((F.col("version") == v["version"])
                       & (F.col("horizon_days") == v["horizon_days"]))).select(
            *GROUP, "horizon_days", F.date_add("last_date", v["horizon_days"]).alias("forecast_date"),
            F.col("predicted").alias("predicted_cost"), "residual_std")
            for v in versions.toLocalIterator()]
        if not parts:
            parts = [rows.select(*GROUP, "horizon_days", F.col("last_date").alias("forecast_date"),
                                 F.lit(0.0).alias("predicted_cost"), "residual_std")]
        low, high = fc.interval(F.col("predicted_cost"), F.coalesce("residual_std", F.lit(0.0)))
        return (reduce(DataFrame.unionByName, parts)
                .withColumns({"lower_bound": low, "upper_bound": high})
                .join(mean_over_horizons(params).drop("mae"), GROUP, "left")
                .drop("residual_std").withColumn("model_name", F.lit(self.name)))


def _stored(models: str, version: str, horizon: int) -> str:
    return f"{models}/version={version}/horizon={horizon}"


def blend(seasonal: DataFrame, boosted: DataFrame, generated_at: Column,
          zero_is_missing: bool = False) -> DataFrame:
    """Both models' rows by date; either side may be missing.

    Where both forecast a date the prediction is the error-weighted mean and the
    band the widest of the two; elsewhere the one forecast passes through. The
    horizon counts from the origin; rows not after it are dropped.
    """
    values = ["predicted_cost", "lower_bound", "upper_bound", "mape"]
    s = seasonal.select(*GROUP, "forecast_date", *[F.col(c).alias(f"s_{c}") for c in values])
    b = boosted.select(*GROUP, "forecast_date", F.col("horizon_days").alias("b_horizon"),
                       *[F.col(c).alias(f"b_{c}") for c in values])
    origin = b.groupBy(*GROUP).agg(F.min(F.date_sub("forecast_date", F.col("b_horizon"))).alias(
        "_b_origin"), F.max("b_mape").alias("_b_mape"))
    start = s.groupBy(*GROUP).agg(F.date_sub(F.min("forecast_date"), 1).alias("_s_origin"),
                                  F.max("s_mape").alias("_s_mape"))
    per_group = origin.join(start, GROUP, "full_outer")
    rows = s.join(b, [*GROUP, "forecast_date"], "full_outer").join(per_group, GROUP, "left")
    w_s, w_b = fc.blend_weights(F.col("_s_mape"), F.col("_b_mape"), zero_is_missing)
    has_s, has_b = F.col("s_predicted_cost").isNotNull(), F.col("b_predicted_cost").isNotNull()
    both = has_s & has_b
    rows = rows.withColumns({
        "seasonal_weight": F.when(both, w_s).when(has_s, 1.0).otherwise(0.0),
        "boosted_weight": F.when(both, w_b).when(has_s, 0.0).otherwise(1.0),
        "horizon_days": fc.horizon(F.col("forecast_date"), F.coalesce("_b_origin", "_s_origin")),
    }).where("horizon_days > 0")
    zero = F.lit(0.0)
    mixed = (F.coalesce(F.col("s_predicted_cost") * F.col("seasonal_weight"), zero)
             + F.coalesce(F.col("b_predicted_cost") * F.col("boosted_weight"), zero))
    return rows.select(
        identity.row_id(F.col("cloud_provider"), F.col("service"), F.col("horizon_days"),
                        F.col("forecast_date"), F.lit("ensemble")).alias("forecast_id"),
        *GROUP, F.lit("all").alias("region"), F.col("horizon_days").cast("int"),
        "forecast_date", fc.floor_at_zero(mixed).alias("predicted_cost"),
        fc.floor_at_zero(F.least("s_lower_bound", "b_lower_bound")).alias("lower_bound"),
        fc.floor_at_zero(F.greatest("s_upper_bound", "b_upper_bound")).alias("upper_bound"),
        F.lit("ensemble").alias("model_used"), generated_at.alias("generated_at"),
        F.col("s_predicted_cost").alias("seasonal_prediction"),
        F.col("b_predicted_cost").alias("boosted_prediction"),
        "seasonal_weight", "boosted_weight")


def forecast(series_df: DataFrame, generated_at: Column, horizon: int = max(C.FORECAST_HORIZONS),
             seasonal: Forecaster | None = None, boosted: Forecaster | None = None) -> DataFrame:
    """Fit both models, store nothing, and blend."""
    series_df = session.materialize(series_df, "forecast-input")
    seasonal, boosted = seasonal or Seasonal(), boosted or Boosted()
    models = session.run_path(series_df.sparkSession, "models")
    s, b = (m.predict(session.materialize(m.fit(series_df, models), f"fit-{m.name}"), horizon)
            for m in (seasonal, boosted))
    return blend(s, b, generated_at)


def models_path(root: str, model: Forecaster) -> str:
    """Where a forecaster's pipelines lie, beside its parameter table."""
    return f"{root.rstrip('/')}/pipelines/{model.name}"


def train(series_df: DataFrame, model: Forecaster, root: str, force: bool = False
          ) -> DataFrame | None:
    """Stored parameters of a forecaster, after fitting the groups that have none.

    `force` fits all groups of `series_df` anew; those of other groups stay stored, with
    the version they were fitted in. A group too short to be fitted has no parameters and
    is tried again next time.
    """
    spark = series_df.sparkSession
    known = tables.load_params(spark, root, model.name)
    groups = tables.groups_to_train(series_df.select(*GROUP).distinct(), known, GROUP, force)
    groups = session.materialize(groups, "groups-to-fit")
    if groups.isEmpty():
        return known
    fresh = model.fit(series_df.join(groups, GROUP, "left_semi"), models_path(root, model))
    return tables.merge_params(spark, root, model.name, fresh, GROUP)


def run(spark: SparkSession, root: str, start, end, generated_at: Column, cloud=None,
        keep_first_run: bool = False, mode: str = "train_predict", force: bool = False,
        horizon: int = max(C.FORECAST_HORIZONS), seasonal: Forecaster | None = None,
        boosted: Forecaster | None = None) -> DataFrame:
    """Fit what is missing, forecast every group from stored models, upsert; the report.

    `train` only fits; `predict` only forecasts with what is stored; `force` fits the
    groups in question anew. A re-forecast row also moves to the new run, unless
    `keep_first_run` updates the figures only.
    """
    features = tables.scan(spark, root, "spend_features", start, end)
    rows = session.materialize(fq.forecast_input(features, cloud=cloud), "forecast-input")
    forecasters = [seasonal or Seasonal(), boosted or Boosted()]
    params = {m.name: train(rows, m, root, force) if "train" in mode
              else tables.load_params(spark, root, m.name) for m in forecasters}
    if "predict" not in mode:
        return spark.createDataFrame([], "cloud_provider string")
    wanted = rows.select(*GROUP).distinct()
    found = [(m, params[m.name].join(wanted, GROUP, "left_semi")) for m in forecasters
             if params[m.name] is not None]
    if len(found) < len(forecasters):
        raise ValueError("no forecaster is stored; run with mode 'train' first")
    out = session.materialize(blend(*[m.predict(p, horizon) for m, p in found], generated_at),
                              "forecast")
    figures = ["predicted_cost", "lower_bound", "upper_bound"]
    tables.merge(out, root, "forecasts", figures if keep_first_run else None)
    sizes = [p.groupBy(*GROUP).agg(F.max("series_rows").alias("train_rows"),
                                   F.avg("mape").alias(f"{m.name}_mape")) for m, p in found]
    report = sizes[0].join(sizes[1].drop("train_rows"), GROUP, "full_outer")
    return out.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("forecasts"), F.first("seasonal_weight").alias("seasonal_weight"),
        F.first("boosted_weight").alias("boosted_weight")).join(report, GROUP, "left")
