from datetime import date

import pytest
from pyspark.sql import functions as F

from costlens.operators import percentiles, series
from costlens.operators.quality import FEATURE_COLUMNS_REQUIRED, missing_columns
from costlens.schemas import DIMENSIONS
from tests.data import daily, spike_costs


@pytest.fixture(scope="module")
def spike(spark):
    rows = series.build_features(daily(spark, spike_costs())).orderBy("feature_date").collect()
    return rows


def test_lags_and_means(spike):
    assert spike[0].cost_lag_1d is None and spike[1].cost_lag_1d == 100
    assert spike[7].cost_lag_7d == 100 and spike[6].rolling_mean_7d == 106
    assert spike[0].rolling_std_7d is None and spike[0].z_score_30d is None
    assert abs(spike[44].z_score_30d) > 2


def test_calendar(spike):
    assert spike[0].day_of_week == 6 and spike[0].week_of_year == 52
    assert spike[30].is_month_end and spike[31].is_month_start and spike[0].is_weekend


def test_zero_lag_and_flat_series(spark):
    rows = series.build_features(daily(spark, [0, 0, 10, 20, 30])).orderBy(
        "feature_date").collect()
    assert rows[1].pct_change_1d is None and rows[2].pct_change_1d is None
    assert rows[3].pct_change_1d == 1.0 and rows[1].z_score_30d == 0.0


def test_warmup_rows_feed_the_window_and_are_trimmed(spark):
    rows = series.build_features(daily(spark, spike_costs()), "2023-02-10", "2023-02-20")
    got = rows.orderBy("feature_date").collect()
    assert len(got) == 11 and got[0].feature_date == date(2023, 2, 10)
    assert got[0].cost_lag_30d is not None


def test_all_feature_columns_are_there(spark):
    df = series.build_features(daily(spark, [1, 2]))
    assert missing_columns(df, FEATURE_COLUMNS_REQUIRED) == []
    assert missing_columns(df.drop("month"), FEATURE_COLUMNS_REQUIRED) == ["Missing column: month"]


def test_split_positions_with_many_rows_per_day(spark):
    parts = [daily(spark, range(20), account=f"a{i}") for i in range(7)]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    got = series.chronological_split(df, ["cloud_provider"], "agg_date", DIMENSIONS[2:])
    counts = {r.split: r["count"] for r in got.groupBy("split").count().collect()}
    assert counts == {"train": 98, "val": 21, "test": 21}
    order = got.orderBy("position").select("position").collect()
    assert [r.position for r in order] == list(range(140))


def test_sequences_start_at_the_thirtieth_row(spark):
    rows = series.trailing_sequences(daily(spark, range(32)), DIMENSIONS, "agg_date",
                                     ["total_cost_usd"])
    got = rows.orderBy("agg_date").collect()
    assert len(got) == 3 and got[0].sequence == [float(i) for i in range(30)]


@pytest.mark.parametrize("values", [
    [5.0], [1.0, 2.0], [float(i) for i in range(101)], [3.0] * 500 + [7.0],
    [-2.0, -1.0, 0.0, 1.0, 2.5, 1e6], [0.0] * 9 + [1e-9]])
def test_percentiles_match_interpolation(spark, values):
    import numpy as np
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    fractions = {"a": 0.25, "b": 0.5, "c": 0.95}
    row = percentiles.exact_percentiles(df, ["g"], "v", fractions).first()
    for name, f in fractions.items():
        assert row[name] == pytest.approx(float(np.percentile(values, f * 100)), abs=1e-12)


def test_percentiles_ignore_null_and_nan(spark):
    df = spark.createDataFrame([("g", None), ("g", float("nan")), ("g", 4.0)], "g string, v double")
    assert percentiles.exact_percentiles(df, ["g"], "v", {"m": 0.5}).first().m == 4.0


def test_running_totals_and_first_date(spark):
    df = daily(spark, [1, 2, 3, 4])
    run = series.running_totals(df, ["cloud_provider"], "agg_date", ["total_cost_usd"])
    assert [r.cum_total_cost_usd for r in run.orderBy("agg_date").collect()] == [1, 3, 6, 10]
    first = series.first_date_reaching(run, ["cloud_provider"], "agg_date", "cum_total_cost_usd",
                                       F.lit(3.0)).first()
    assert first.breach_date == date(2023, 1, 2)
