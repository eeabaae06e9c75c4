"""Anomaly detection over feature rows: detectors, ensemble, flags."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from costlens import constants as C, session
from costlens.functions import identity, scoring as sc
from costlens.operators import filters as flt, forest, gram, series, tables
from costlens.operators.dedup import groups_of_size
from costlens.operators.percentiles import exact_percentiles
from costlens.schemas import DIMENSIONS, FEATURE_KEY, with_fields

GROUP = ["cloud_provider", "service_category"]


class Detector(Protocol):
    """A detector plug-in: parameters come from `fit`, `score` adds its column."""

    name: str

    def fit(self, features: DataFrame) -> DataFrame | None: ...

    def score(self, features: DataFrame, params: DataFrame | None) -> DataFrame: ...


class ZScore:
    """Score from the trailing z-score; nothing to fit."""

    name = "zscore"

    def fit(self, features: DataFrame) -> None:
        return None

    def score(self, features: DataFrame, params: DataFrame | None = None) -> DataFrame:
        return features.withColumns({
            "zscore_score": sc.zscore_score(F.col("z_score_30d")),
            "expected_cost": F.coalesce("rolling_mean_30d", F.lit(0.0)),
        }).withColumn("deviation_pct", sc.deviation_pct(F.col("total_cost_usd"),
                                                        F.col("expected_cost")))


def _matrix(features: DataFrame, columns: list[str]) -> DataFrame:
    return features.withColumns({f"_x_{c}": flt.number_or_zero(features, c) for c in columns})


class IsolationForest:
    """One forest per (cloud, service); groups without one score 0."""

    name = "iforest"

    def __init__(self, trees: int = C.FOREST_TREES, min_rows: int = C.MIN_ROWS["iforest"],
                 columns: list[str] = C.FOREST_FEATURES):
        self.trees, self.min_rows, self.columns = trees, min_rows, columns
        self._x = [f"_x_{c}" for c in columns]

    def _trees(self, features: DataFrame) -> DataFrame:
        rows = _matrix(features, self.columns).select(*FEATURE_KEY, *self._x)
        return forest.fit_forest(rows, GROUP, self._x, FEATURE_KEY, self.trees,
                                 min_rows=self.min_rows)

    def _raw(self, features: DataFrame, trees: DataFrame) -> DataFrame:
        """`features` with `outlier_score`; rows are carried through, not joined back."""
        return forest.score_forest(_matrix(features, self.columns), trees, GROUP, self._x,
                                   FEATURE_KEY).drop(*self._x)

    def _normalised(self, raw: DataFrame, ranges: DataFrame) -> DataFrame:
        # the library's decision value falls as the outlier score rises
        score = sc.range_score(-F.col("outlier_score"), -F.col("score_max"),
                               -F.col("score_min"))
        return (raw.join(ranges, GROUP, "left")
                .withColumn("iforest_score", F.coalesce(score, F.lit(0.0)))
                .drop("outlier_score", "score_min", "score_max"))

    def fit(self, features: DataFrame) -> DataFrame:
        """Trees with the group's score range on the rows they were fitted on."""
        return self.fit_score(features)[0]

    def fit_score(self, features: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Parameters and the scored rows they were fitted on, scored once."""
        trees = session.materialize(self._trees(features), "trees")
        raw = session.materialize(self._raw(features, trees), "outlier-scores")
        ranges = forest.score_ranges(raw.where("outlier_score IS NOT NULL"), GROUP,
                                     "outlier_score")
        return trees.join(ranges, GROUP), self._normalised(raw, ranges)

    def score(self, features: DataFrame, params: DataFrame | None) -> DataFrame:
        if params is None:
            return features.withColumn("iforest_score", F.lit(0.0))
        trees = params.drop("score_min", "score_max")
        ranges = params.groupBy(*GROUP).agg(F.first("score_min").alias("score_min"),
                                            F.first("score_max").alias("score_max"))
        return self._normalised(self._raw(features, trees), ranges)


class SequenceReconstruction:
    """Reconstruction error of trailing 30-row windows under a linear autoencoder.

    The encoder is the leading principal directions of a group's windows, taken
    from its grouped second moments; the error threshold is the 95th percentile
    over the last part of the data. Off by default: its ensemble weight is 0.

    A group is fitted if it has enough rows in all and enough of them in its training
    part; features with fewer than three of the columns fit no group.
    """

    name = "sequence"

    def __init__(self, components: int = 8, length: int = C.SEQUENCE_LENGTH,
                 min_rows: int = C.MIN_ROWS["sequence"],
                 columns: list[str] = C.SEQUENCE_FEATURES,
                 min_train: int = C.MIN_ROWS["sequence_train"]):
        self.components, self.length, self.min_rows = components, length, min_rows
        self.columns, self.min_train = columns, min_train

    def _scaled(self, rows: DataFrame, ranges: DataFrame) -> DataFrame:
        width = {c: F.col(f"_max_{c}") - F.col(f"_min_{c}") for c in self.columns}
        return rows.join(ranges, GROUP).withColumns({
            c: (F.col(c) - F.col(f"_min_{c}")) / F.when(width[c] > 0, width[c]).otherwise(1.0)
            for c in self.columns}).drop(*[f"_{s}_{c}" for s in ("min", "max")
                                           for c in self.columns])

    def _numbers(self, features: DataFrame) -> DataFrame:
        return features.select(*FEATURE_KEY, *[flt.number_or_zero(features, c).alias(c)
                                               for c in self.columns])

    def _sequences(self, rows: DataFrame) -> DataFrame:
        return series.trailing_sequences(rows, DIMENSIONS, "feature_date", self.columns,
                                         self.length)

    def train_ranges(self, split_rows: DataFrame) -> DataFrame:
        """Min and max per group over the training part only, where it has enough rows."""
        part = split_rows.where("split = 'train'")
        return part.groupBy(*GROUP).agg(
            F.count(F.lit(1)).alias("_train_rows"),
            *[F.min(c).alias(f"_min_{c}") for c in self.columns],
            *[F.max(c).alias(f"_max_{c}") for c in self.columns]).where(
            F.col("_train_rows") >= self.min_train).drop("_train_rows")

    def fit(self, features: DataFrame) -> DataFrame:
        if len(set(self.columns) & set(features.columns)) < C.SEQUENCE_LEAST_COLUMNS:
            features = features.where(F.lit(False))
        rows = groups_of_size(self._numbers(features), GROUP, self.min_rows)
        rows = series.chronological_split(rows, GROUP, "feature_date", DIMENSIONS[2:])
        ranges = self.train_ranges(rows)
        seqs = self._sequences(self._scaled(rows, ranges))
        z = seqs.where("split = 'train'").withColumn(
            "_v", F.concat(F.array(F.lit(1.0)), F.col("sequence")))
        cells = gram.gram_sums(z, GROUP, "_v")
        size, k = len(self.columns) * self.length, self.components
        schema = with_fields(rows, GROUP, "centre array<double>, "
                                          "directions array<array<double>>")

        def directions(pdf: pd.DataFrame) -> pd.DataFrame:
            g = gram.unpack(pdf, size + 1)
            n = max(g[0, 0], 1.0)
            mean = g[0, 1:] / n
            _, vectors = np.linalg.eigh(g[1:, 1:] / n - np.outer(mean, mean))
            top = vectors[:, ::-1][:, :k].T
            return pd.DataFrame([[*pdf.loc[pdf.index[0], GROUP], mean, list(top)]],
                                columns=[f.name for f in schema])

        basis = cells.groupBy(*GROUP).applyInPandas(directions, schema)
        errors = self._errors(seqs, basis).where("split <> 'val'")
        held_out = exact_percentiles(errors, [*GROUP, "split"], "error",
                                     {"p95": C.SEQUENCE_ERROR_PERCENTILE})
        threshold = held_out.groupBy(*GROUP).agg(
            F.max_by("p95", F.when(F.col("split") == "test", 1).otherwise(0)).alias("threshold"))
        return basis.join(threshold, GROUP).join(ranges, GROUP)

    def _errors(self, seqs: DataFrame, basis: DataFrame) -> DataFrame:
        """Mean squared error: what the directions leave of the centred window."""
        size = float(len(self.columns) * self.length)
        joined = seqs.join(basis, GROUP).withColumn(
            "_d", F.zip_with("sequence", "centre", lambda a, b: a - b))
        kept = F.aggregate(F.col("directions"), F.lit(0.0),
                           lambda s, v: s + F.pow(gram.dot(v, F.col("_d")), F.lit(2.0)))
        left = gram.dot(F.col("_d"), F.col("_d")) - kept
        return joined.withColumn("error", F.greatest(F.lit(0.0), left) / size).drop(
            "_d", "directions", "centre")

    def score(self, features: DataFrame, params: DataFrame | None) -> DataFrame:
        if params is None:
            return features.withColumn("sequence_score", F.lit(0.0))
        ranges = params.drop("centre", "directions", "threshold")
        rows = self._scaled(self._numbers(features), ranges)
        errors = self._errors(self._sequences(rows), params.select(
            *GROUP, "centre", "directions", "threshold"))
        scored = errors.select(*FEATURE_KEY, sc.reconstruction_score(
            F.col("error"), F.col("threshold")).alias("_s"))
        return features.join(scored, FEATURE_KEY, "left").withColumn(
            "sequence_score", F.coalesce("_s", F.lit(0.0))).drop("_s")


def combine(scored: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Ensemble score and severity from whichever detector columns are there."""
    def col(name: str) -> Column:
        return F.col(name) if name in scored.columns else F.lit(None).cast("double")
    score = sc.ensemble_score(col("zscore_score"), col("iforest_score"), col("sequence_score"),
                              weights)
    return scored.withColumn("ensemble_score", score).withColumn(
        "severity", sc.severity(F.col("ensemble_score")))


def to_anomalies(scored: DataFrame, detected_at: Column) -> DataFrame:
    """Rows that reach the lowest severity, in the anomaly schema.

    The id is a hash of the natural key, so that a second run updates its rows.
    """
    def opt(name: str) -> Column:
        return F.col(name) if name in scored.columns else F.lit(None).cast("double")
    expected = sc.expected_cost(F.col("rolling_mean_30d"))
    return scored.where(F.col("severity").isNotNull()).select(
        identity.row_id(*[F.col(c) for c in FEATURE_KEY]).alias("anomaly_id"),
        identity.composite_record_id(F.col("cloud_provider"), F.col("service_category"),
                                     F.col("account_id"), F.col("feature_date")
                                     ).alias("record_id"),
        F.lit("ensemble").alias("detection_method"), "severity",
        F.coalesce("z_score_30d", F.lit(0.0)).alias("z_score"),
        expected.alias("expected_cost"), F.col("total_cost_usd").alias("actual_cost"),
        sc.deviation_pct(F.col("total_cost_usd"), expected).alias("deviation_pct"),
        detected_at.alias("detected_at"), "cloud_provider",
        F.col("service_category").alias("service"), "account_id",
        F.col("feature_date").alias("usage_date"), opt("zscore_score").alias("zscore_score"),
        opt("iforest_score").alias("iforest_score"),
        opt("sequence_score").alias("sequence_score"), "ensemble_score")


def train(features: DataFrame, detector: Detector, root: str | None = None,
          force: bool = False) -> DataFrame | None:
    """Parameters of a detector: stored ones are reused, missing groups are fitted.

    `force` fits the given groups anew; those of other groups stay stored.
    """
    if root is None:
        return detector.fit(features)
    spark = features.sparkSession
    known = tables.load_params(spark, root, detector.name)
    groups = tables.groups_to_train(features.select(*GROUP).distinct(), known, GROUP, force)
    fresh = detector.fit(features.join(groups, GROUP, "left_semi"))
    if fresh is None:
        return None
    return tables.merge_params(spark, root, detector.name, fresh, GROUP)


def detect(features: DataFrame, detectors: list[Detector],
           params: dict[str, DataFrame | None], weights: dict[str, float] | None = None
           ) -> DataFrame:
    rows = features
    for d in detectors:
        rows = d.score(rows, params.get(d.name))
    return combine(rows, weights)


def run(spark: SparkSession, root: str, start, end, detected_at: Column, cloud=None,
        mode: str = "train_predict", force: bool = False,
        weights: dict[str, float] = C.ENSEMBLE_WEIGHTS) -> DataFrame:
    """Score stored features, write anomalies, flag billing rows; returns the report.

    `train` only fits, `predict` only scores with stored parameters.
    """
    features = flt.equals(tables.scan(spark, root, "spend_features", start, end),
                          cloud_provider=cloud)
    if features.limit(C.MIN_ROWS["detection_run"]).count() < C.MIN_ROWS["detection_run"]:
        raise ValueError(f"detection needs {C.MIN_ROWS['detection_run']} feature rows")
    detectors: list[Detector] = [ZScore(), IsolationForest()]
    if weights["sequence"] > 0:
        detectors.append(SequenceReconstruction())
    fit = "train" in mode
    params = {d.name: (train(features, d, root, force) if fit
                       else tables.load_params(spark, root, d.name)) for d in detectors}
    if "predict" not in mode:
        return features.sparkSession.createDataFrame([], "cloud_provider string")
    from costlens.operators.reports import detection_report
    scored = session.materialize(detect(features, detectors, params, weights), "scored")
    found = to_anomalies(scored, detected_at)
    tables.merge(found, root, "anomalies", ["severity", "ensemble_score"])
    tables.update_flags(root, found.select(
        "cloud_provider", F.col("service").alias("service_category"), "account_id",
        "usage_date", "severity"))
    return detection_report(scored)
