import math
from datetime import date, timedelta
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from costlens import constants as C, session
from costlens.functions import scoring as sc
from costlens.operators import series
from costlens.plans import attribute as at, detect, forecast as fp
from costlens.schemas import FEATURE_KEY
from tests.data import daily


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def lit(v):
    return F.lit(v).cast("double")


def test_zscore_bands(spark):
    assert one(spark, sc.zscore_score(lit(5.0))) > 0.9
    assert one(spark, sc.zscore_score(lit(-5.0))) > 0.9
    assert one(spark, sc.zscore_score(lit(1.5))) <= 0.01
    assert one(spark, sc.zscore_score(lit(float("nan")))) == 0
    assert one(spark, sc.zscore_score(lit(None))) == 0


def test_ensemble_redistributes(spark):
    got = one(spark, sc.ensemble_score(lit(0.8), lit(0.6), lit(None)))
    assert got == pytest.approx(0.8 * 0.45 + 0.6 * 0.55)
    assert one(spark, sc.ensemble_score(lit(0.8), lit(None), lit(None))) == pytest.approx(0.8)
    assert one(spark, sc.ensemble_score(lit(None), lit(None), lit(None))) == 0


@pytest.mark.parametrize("score, want", [(0.95, "critical"), (0.9, "critical"), (0.7, "high"),
                                         (0.55, "medium"), (0.3, "low"), (0.1, None)])
def test_severity(spark, score, want):
    assert one(spark, sc.severity(lit(score))) == want


def noisy_features(spark):
    rng = np.random.default_rng(42)
    normal = list(100 + 5 * rng.standard_normal(115))
    normal[100:105] = [500.0] * 5
    return series.build_features(daily(spark, normal))


def test_forest_scores_outliers_higher_and_is_repeatable(spark):
    rows = session.materialize(noisy_features(spark), "t")
    forest = detect.IsolationForest(trees=60)
    params = session.materialize(forest.fit(rows), "t")
    assert params.count() == 60
    out = forest.score(rows, params)
    odd = F.col("total_cost_usd") > 300
    row = out.agg(F.avg(F.when(odd, F.col("iforest_score"))).alias("hi"),
                  F.avg(F.when(~odd, F.col("iforest_score"))).alias("lo"),
                  F.min("iforest_score").alias("mn"), F.max("iforest_score").alias("mx")).first()
    assert row.hi > row.lo and row.mn == pytest.approx(0) and row.mx == pytest.approx(1)
    again = forest.fit(rows)
    assert again.exceptAll(params).isEmpty()


def test_small_groups_get_no_forest_and_score_zero(spark):
    rows = session.materialize(series.build_features(daily(spark, range(10))), "t")
    forest = detect.IsolationForest(trees=5)
    out = forest.score(rows, session.materialize(forest.fit(rows), "t"))
    assert out.count() == 10 and out.where("iforest_score <> 0").isEmpty()


def test_forest_scoring_by_chunks_equals_one_chunk(spark, monkeypatch):
    from costlens.operators import forest as fo
    rows = session.materialize(noisy_features(spark), "t")
    model = detect.IsolationForest(trees=10)
    params = session.materialize(model.fit(rows), "t")
    whole = {r.feature_date: r.iforest_score for r in model.score(rows, params).collect()}
    monkeypatch.setattr(fo, "CHUNK_ROWS", 10)
    parts = {r.feature_date: r.iforest_score for r in model.score(rows, params).collect()}
    assert whole == pytest.approx(parts)


def test_sequence_detector_flags_a_break(spark):
    costs = [100 + 20 * math.sin(2 * math.pi * i / 30) for i in range(200)]
    costs[180:185] = [1000.0] * 5
    rows = session.materialize(series.build_features(daily(spark, costs)), "t")
    d = detect.SequenceReconstruction(components=4)
    out = d.score(rows, session.materialize(d.fit(rows), "t"))
    row = out.agg(F.max(F.when(F.col("total_cost_usd") > 500, F.col("sequence_score"))).alias("odd"),
                  F.count(F.lit(1)).alias("n"),
                  F.max(F.when(F.col("feature_date") < "2023-01-30", F.col("sequence_score"))
                        ).alias("early")).first()
    assert row.n == 200 and row.odd > 0.5 and row.early == 0


def group_series(spark, values, start=date(2023, 1, 1), cloud="aws", service="compute"):
    return spark.createDataFrame(
        [(start + timedelta(days=i), cloud, service, float(v)) for i, v in enumerate(values)],
        "usage_date date, cloud_provider string, service string, cost_usd double")


def test_seasonal_forecaster_learns_a_week(spark):
    wave = [100 + 10 * math.sin(2 * math.pi * i / 7) for i in range(120)]
    model = fp.Seasonal()
    params = session.materialize(model.fit(group_series(spark, wave)), "t")
    assert params.first().mape < 0.25
    rows = model.predict(params, 30).orderBy("forecast_date").collect()
    assert len(rows) == 30 and all(r.lower_bound >= 0 for r in rows)
    assert rows[0].forecast_date == date(2023, 5, 1)
    truth = [100 + 10 * math.sin(2 * math.pi * (120 + i) / 7) for i in range(30)]
    assert max(abs(r.predicted_cost - t) for r, t in zip(rows, truth)) < 25


def test_seasonal_forecaster_skips_short_series(spark):
    assert fp.Seasonal().fit(group_series(spark, range(50))).isEmpty()


def test_boosted_forecaster_gives_one_row_per_horizon(spark):
    rng = np.random.default_rng(1)
    costs = [100 + 0.5 * i + rng.standard_normal() for i in range(150)]
    feats = series.build_features(daily(spark, costs))
    from costlens.operators.forecasts import forecast_input
    data = session.materialize(forecast_input(feats), "t")
    model = fp.Boosted(horizons=[7, 30], max_trees=5, depth=3)
    params = session.materialize(model.fit(data), "t")
    rows = model.predict(params).collect()
    assert sorted(r.horizon_days for r in rows) == [7, 30]
    assert all(0 <= r.lower_bound <= r.predicted_cost <= r.upper_bound for r in rows)


def stored_features(spark, root, clouds=("aws", "gcp"), days=150):
    from costlens.operators import tables
    rng = np.random.default_rng(1)
    frames = [daily(spark, 100 + 0.5 * np.arange(days) + rng.standard_normal(days), cloud=c)
              for c in clouds]
    rows = series.build_features(reduce(lambda a, b: a.unionByName(b), frames))
    tables.merge(rows, root, "spend_features")


SPAN = ("2023-01-01", "2023-12-31")


def models():
    return {"seasonal": fp.Seasonal(), "boosted": fp.Boosted(horizons=[7, 30], max_trees=3, depth=2)}


def by_key(df):
    return {(r.cloud_provider, r.horizon_days, r.forecast_date): r.predicted_cost
            for r in df.collect()}


def test_stored_forecasters_predict_alike_in_a_new_session(spark, root):
    from costlens.operators import tables
    from costlens.operators.forecasts import forecast_input
    stored_features(spark, root)
    rows = session.materialize(forecast_input(tables.scan(spark, root, "spend_features")), "t")
    fitted = {name: fp.train(rows, m, root) for name, m in models().items()}
    here = {name: by_key(m.predict(fitted[name], 30)) for name, m in models().items()}
    other = spark.newSession()
    for name, m in models().items():
        there = m.predict(tables.load_params(other, root, name), 30)
        assert there.sparkSession is not spark and by_key(there) == pytest.approx(here[name])
        assert len(here[name]) == {"seasonal": 60, "boosted": 4}[name]


def test_modes_and_forcing_of_the_forecast_job(spark, root):
    from costlens.operators import tables
    now = F.to_timestamp(F.lit("2024-01-01"))
    stored_features(spark, root, ("aws",))
    with pytest.raises(ValueError):
        fp.run(spark, root, *SPAN, now, mode="predict", **models())
    assert fp.run(spark, root, *SPAN, now, mode="train", **models()).isEmpty()
    assert tables.scan(spark, root, "forecasts").isEmpty()

    def versions():
        return {r.cloud_provider: r.version for r in
                tables.load_params(spark, root, "boosted").collect()}
    first = versions()
    stored_features(spark, root)
    report = {r.cloud_provider: r for r in fp.run(spark, root, *SPAN, now, **models()).collect()}
    second = versions()
    assert second["aws"] == first["aws"] and second["gcp"] != first["aws"]
    assert set(report) == {"aws", "gcp"} and report["aws"].train_rows == 150
    fp.run(spark, root, *SPAN, now, cloud="gcp", mode="train", force=True, **models())
    third = versions()
    assert third["aws"] == first["aws"] and third["gcp"] != second["gcp"]
    assert tables.scan(spark, root, "forecasts").groupBy("cloud_provider").count().count() == 2


def test_short_groups_are_left_for_the_next_training(spark, root):
    from costlens.operators import tables
    stored_features(spark, root, ("aws",), days=20)
    now = F.to_timestamp(F.lit("2024-01-01"))
    out = fp.run(spark, root, *SPAN, now, **models())
    assert out.isEmpty() and tables.load_params(spark, root, "boosted").isEmpty()


def test_bands_widen_with_the_horizon(spark):
    costs = [100 + i + (9 * (i - 100) if i > 100 else 0) - (18 * (i - 150) if i > 150 else 0)
             for i in range(200)]
    model = fp.Seasonal()
    rows = model.predict(session.materialize(model.fit(group_series(spark, costs)), "t"), 60)
    width = [r.upper_bound - r.predicted_cost for r in rows.orderBy("forecast_date").collect()]
    assert all(b > a for a, b in zip(width, width[1:]))


def test_boosted_design_counts_from_both_ends(spark):
    rows = group_series(spark, range(100)).withColumns(
        {c: F.lit(1.0) for c in C.BOOSTED_FEATURES if c not in ("month", "quarter")})
    got = fp.Boosted(horizons=[7, 99]).design(rows)
    by = {(r.split_7, r.split_99): r.n for r in got.groupBy("split_7", "split_99").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    assert sum(n for (s, _), n in by.items() if s == "train") == 65
    assert sum(n for (s, _), n in by.items() if s == "val") == 13
    assert sum(n for (s, _), n in by.items() if s is None) == 7
    assert [r.target_99 for r in got.where("split_99 IS NOT NULL").collect()] == [99.0]


def test_forest_scores_once(spark):
    rows = session.materialize(noisy_features(spark), "t")
    model = detect.IsolationForest(trees=10)
    params, scored = model.fit_score(rows)
    again = model.score(rows, session.materialize(params, "t"))
    assert scored.columns == again.columns
    assert scored.select("feature_date", "iforest_score").exceptAll(
        again.select("feature_date", "iforest_score")).isEmpty()
    assert set(rows.columns) < set(scored.columns)


def test_sequence_gates(spark):
    rows = session.materialize(noisy_features(spark), "t")
    assert detect.SequenceReconstruction(components=4).fit(rows).count() == 1
    assert detect.SequenceReconstruction(components=4, min_train=100).fit(rows).isEmpty()
    few = rows.drop(*C.SEQUENCE_FEATURES[2:])
    assert detect.SequenceReconstruction(components=4).fit(few).isEmpty()


def side(spark, rows, mape):
    return spark.createDataFrame(
        [("aws", "compute", h, date(2024, 1, 1) + timedelta(days=d), p, lo, hi, mape)
         for h, d, p, lo, hi in rows],
        "cloud_provider string, service string, horizon_days int, forecast_date date, "
        "predicted_cost double, lower_bound double, upper_bound double, mape double")


def test_blend_weights_and_bounds(spark):
    s = side(spark, [(7, 7, 100.0, 90.0, 110.0)], 0.10)
    b = side(spark, [(7, 7, 120.0, 115.0, 125.0)], 0.05)
    row = fp.blend(s, b, F.current_timestamp()).first()
    assert row.seasonal_weight == pytest.approx(1 / 3) and row.boosted_weight == pytest.approx(2 / 3)
    assert (row.lower_bound, row.upper_bound, row.horizon_days) == (90.0, 125.0, 7)
    assert row.predicted_cost == pytest.approx(100 / 3 + 240 / 3)


def test_blend_single_source_passes_through(spark):
    s = side(spark, [(7, d, 50.0, -5.0, 60.0) for d in range(1, 8)], 0.1)
    empty = side(spark, [(7, 7, 0.0, 0.0, 0.0)], 0.1).where("1 = 0")
    rows = fp.blend(s, empty, F.current_timestamp()).orderBy("horizon_days").collect()
    assert [r.horizon_days for r in rows] == [1, 2, 3, 4, 5, 6, 7]
    assert all(r.seasonal_weight == 1 and r.boosted_weight == 0 and r.lower_bound == 0
               for r in rows)


def attribution_rows(spark, n=120):
    rng = np.random.default_rng(42)
    x = rng.standard_normal((n, len(C.ATTRIBUTION_FEATURES)))
    cost = 100 + 50 * x[:, 0] + 20 * x[:, 3]
    cost[90:95] *= 3
    rows = [(date(2023, 1, 1) + timedelta(days=i), "aws", "compute", "a1", "prod", "core",
             float(cost[i]), *map(float, x[i])) for i in range(n)]
    ddl = ("feature_date date, cloud_provider string, service_category string, account_id string, "
           "environment string, team string, total_cost_usd double, "
           + ", ".join(f"{c} double" for c in C.ATTRIBUTION_FEATURES))
    return spark.createDataFrame(rows, ddl)


def test_attribution_fits_and_adds_up(spark):
    rows = attribution_rows(spark)
    params = session.materialize(at.fit(rows), "t")
    p = params.first()
    assert p.r2 > 0 and (p.train_rows, p.test_rows) == (84, 18)
    out = at.attribute(rows, params).collect()
    assert len(out) == 120
    for r in out:
        assert sum(r.shap_values.values()) + r.base == pytest.approx(r.prediction, abs=1e-6)
    assert {r.top_driver_1 for r in out} <= {"cost_lag_1d", "rolling_mean_7d"} | set(
        C.ATTRIBUTION_FEATURES)
    heavy = sum(r.top_driver_1 == "cost_lag_1d" for r in out)
    assert heavy > 60


def test_driver_order_is_by_size_with_stable_ties(spark):
    cols = ["cost_lag_1d", "rolling_mean_7d", "day_of_week", "is_weekend"]
    row = spark.range(1).select(F.map_from_arrays(
        F.array(*map(F.lit, cols)), F.array(*map(F.lit, [15.5, -42.2, 2.1, -0.5]))).alias(
        "shap_values"))
    got = at.with_top_drivers(row, cols).first()
    assert (got.top_driver_1, got.top_driver_2, got.top_driver_3) == (
        "rolling_mean_7d", "cost_lag_1d", "day_of_week")
    tie = spark.range(1).select(F.map_from_arrays(
        F.array(*map(F.lit, cols)), F.array(*map(F.lit, [1.0, -1.0, 1.0, 1.0]))).alias(
        "shap_values"))
    assert at.with_top_drivers(tie, cols).first().top_driver_3 == "day_of_week"


def test_anomaly_ids_are_stable(spark):
    rows = noisy_features(spark)
    scored = detect.combine(detect.ZScore().score(rows))
    a = detect.to_anomalies(scored, F.current_timestamp()).select("anomaly_id").collect()
    b = detect.to_anomalies(scored, F.current_timestamp()).select("anomaly_id").collect()
    assert a == b and len(a) >= 1
    assert FEATURE_KEY[0] == "feature_date"


def test_any_row_of_a_large_group_can_be_in_a_tree(spark):
    from costlens.operators import forest
    rows = spark.range(20_000).select(F.lit("g").alias("g"), F.col("id"),
                                      F.rand(1).alias("x")).unionByName(
        spark.range(40).select(F.lit("s").alias("g"), F.col("id"), F.rand(2).alias("x")))
    got = forest.draws(rows, ["g"], ["id"], 200, 256)
    per_tree = got.groupBy("g", "tree").count().groupBy("g").agg(
        F.count(F.lit(1)), F.min("count"), F.max("count")).collect()
    assert {tuple(r) for r in per_tree} == {("g", 200, 256, 256), ("s", 200, 40, 40)}
    spread = got.where("g = 'g'").agg(F.countDistinct("id"), F.max("id")).first()
    assert spread[0] > 15_000 and spread[1] > 19_900
