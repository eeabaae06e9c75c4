"""Feature, window, split and percentile operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from costlens import constants as C
from costlens.functions import calendar as cal
from costlens.operators import filters as flt, percentiles, series
from costlens.operators import forecasts as fq
from costlens.operators.dedup import groups_of_size, with_group_count
from costlens.plans import attribute as at, forecast as fp
from costlens.schemas import DIMENSIONS, FEATURE_KEY
from costlens.sources import scans
from entries.base import entry, f32, rounded, s32
from entries.ctes import DIMS, sql

KEY = f"CAST(feature_date AS VARCHAR) AS feature_date, {DIMS}"
FLOATS = ["rolling_mean_7d", "rolling_std_7d", "rolling_mean_30d", "rolling_std_30d",
          "pct_change_1d", "pct_change_7d", "pct_change_30d", "z_score_30d"]
FEATURES = (f"SELECT {KEY}, total_cost_usd, record_count, cost_lag_1d, cost_lag_7d, cost_lag_30d, "
            + ", ".join(f"{s32(c)} AS {c}" for c in FLOATS)
            + ", day_of_week, day_of_month, week_of_year, month, is_weekend, is_month_start, "
              "is_month_end FROM feat")


@entry("wn1_lags", sql(f"SELECT {KEY}, cost_lag_1d, cost_lag_7d, cost_lag_30d FROM feat", "feat"))
def _(b):
    w = series.over_series("agg_date")
    return b.daily.select(F.col("agg_date").alias("feature_date"), *DIMENSIONS,
                          *[series.lag_rows(F.col("total_cost_usd"), n, w).alias(f"cost_lag_{n}d")
                            for n in series.LAGS])


@entry("wn2_rolling_means", sql(f"""
    SELECT {KEY}, {s32('rolling_mean_7d')} AS m7, {s32('rolling_mean_30d')} AS m30 FROM feat""",
    "feat"))
def _(b):
    w, c = series.over_series("agg_date"), F.col("total_cost_usd")
    return f32(b.daily.select(F.col("agg_date").alias("feature_date"), *DIMENSIONS,
                              series.rolling_mean(c, 7, w).alias("m7"),
                              series.rolling_mean(c, 30, w).alias("m30")), "m7", "m30")


@entry("wn3_rolling_stds", sql(f"""
    SELECT {KEY}, {s32('rolling_std_7d')} AS s7, {s32('rolling_std_30d')} AS s30 FROM feat""",
    "feat"))
def _(b):
    w, c = series.over_series("agg_date"), F.col("total_cost_usd")
    return f32(b.daily.select(F.col("agg_date").alias("feature_date"), *DIMENSIONS,
                              series.rolling_std(c, 7, w).alias("s7"),
                              series.rolling_std(c, 30, w).alias("s30")), "s7", "s30")


@entry("wn4_pct_change", sql(f"""
    SELECT {KEY}, {s32('pct_change_1d')} AS p1, {s32('pct_change_30d')} AS p30 FROM feat""",
    "feat"))
def _(b):
    return f32(b.features.select(*FEATURE_KEY, F.col("pct_change_1d").alias("p1"),
                                 F.col("pct_change_30d").alias("p30")), "p1", "p30")


@entry("wn5_z_score", sql(f"SELECT {KEY}, {s32('z_score_30d')} AS z FROM feat", "feat"))
def _(b):
    return f32(b.features.select(*FEATURE_KEY, F.col("z_score_30d").alias("z")), "z")


@entry("wn6_features", sql(FEATURES, "feat"))
def _(b):
    return f32(b.features, *FLOATS)


@entry("wn7_rebuild_recent", sql(f"""
    SELECT CAST(agg_date AS VARCHAR) AS feature_date, {DIMS}, total_cost_usd,
      {s32('avg(total_cost_usd) OVER (w ROWS 6 PRECEDING)')} AS m7 FROM daily
    WHERE agg_date BETWEEN DATE '2001-07-23' - 30 AND DATE '2001-07-30'
    WINDOW w AS (PARTITION BY {DIMS} ORDER BY daily.agg_date)
    QUALIFY agg_date >= DATE '2001-07-23'""", "daily"))
def _(b):
    rows = series.rebuild_recent(b.daily, "2001-07-30", 7)
    return f32(rows.select(*FEATURE_KEY, "total_cost_usd", F.col("rolling_mean_7d").alias("m7")),
               "m7")


@entry("pf21_trim_warmup", sql("""
    SELECT CAST(agg_date AS VARCHAR) AS feature_date, count(*) AS n,
      round(sum(total_cost_usd), 2) AS cost FROM daily
    WHERE agg_date BETWEEN DATE '1997-01-01' AND DATE '1998-06-30' GROUP BY 1""", "daily"))
def _(b):
    rows = series.build_features(b.daily, "1997-01-01", "1998-06-30")
    return rounded(rows.groupBy("feature_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_cost_usd").alias("cost")), 2, "cost")


@entry("sc10_daily_with_warmup", sql(f"""
    SELECT CAST(agg_date AS VARCHAR) AS agg_date, {DIMS}, total_cost_usd, record_count FROM daily
    WHERE agg_date BETWEEN DATE '1997-01-01' - 30 AND DATE '1999-12-31'""", "daily"))
def _(b):
    return scans.daily_with_warmup(b.daily, "1997-01-01", "1999-12-31").drop("avg_cost_usd")


@entry("sc11_feature_scan", sql(f"""
    SELECT {KEY}, total_cost_usd, {s32('z_score_30d')} AS z_score_30d FROM feat
    WHERE cloud_provider = 'gcp' AND abs(z_score_30d) >= 1.5""", "feat"))
def _(b):
    rows = scans.features(b.features, "1900-01-01", "2100-01-01", cloud="gcp", min_z=1.5)
    return f32(rows.select(*FEATURE_KEY, "total_cost_usd", "z_score_30d"), "z_score_30d")


@entry("sc12_feature_series", sql(f"""
    SELECT {KEY}, total_cost_usd, cost_lag_7d FROM feat WHERE cloud_provider = 'aws'
      AND service_category = '2-HIGH' AND account_id = 'acct-1'""", "feat"))
def _(b):
    return scans.feature_series(b.features, "aws", "2-HIGH", "acct-1", None, None).select(
        *FEATURE_KEY, "total_cost_usd", "cost_lag_7d")


@entry("sc13_features_for_group", sql(f"""
    SELECT CAST(feature_date AS VARCHAR) AS usage_date, account_id, environment, team,
      total_cost_usd, {s32('rolling_mean_7d')} AS rolling_mean_7d, is_weekend FROM feat
    WHERE cloud_provider = 'azure' AND service_category = '5-LOW'""", "feat"))
def _(b):
    rows = scans.features_for_group(b.features, "azure", "5-LOW", None, None)
    return f32(rows.select("usage_date", "account_id", "environment", "team", "total_cost_usd",
                           "rolling_mean_7d", "is_weekend"), "rolling_mean_7d")


SPLIT = """SELECT *, row_number() OVER (PARTITION BY cloud_provider, service_category
    ORDER BY feature_date, account_id, environment, team) - 1 AS p,
    count(*) OVER (PARTITION BY cloud_provider, service_category) AS n FROM feat"""
LABEL = ("CASE WHEN p < floor(n * 0.7::DOUBLE) THEN 'train' WHEN p < floor(n * 0.7::DOUBLE) + "
         "floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END")


@entry("wn8_chronological_split", sql(f"SELECT {KEY}, {LABEL} AS split FROM s", "feat", s=SPLIT))
def _(b):
    return series.chronological_split(b.features, at.GROUP, "feature_date",
                                      DIMENSIONS[2:]).select(*FEATURE_KEY, "split")


@entry("wn9_future_target", sql("""
    SELECT CAST(usage_date AS VARCHAR) AS usage_date, cloud_provider, service, round(t, 2)
      AS target FROM (SELECT *, lead(cost_usd, 14) OVER (PARTITION BY cloud_provider, service
      ORDER BY usage_date) AS t FROM fin) WHERE t IS NOT NULL""", "fin"))
def _(b):
    rows = fp.Boosted().targets(fq.forecast_input(b.features), 14)
    return rounded(rows.select("usage_date", "cloud_provider", "service", "target"), 2, "target")


@entry("pf20_drop_without_target", sql("""
    SELECT cloud_provider, service, count(*) AS n FROM (SELECT *, lead(cost_usd, 90) OVER (
      PARTITION BY cloud_provider, service ORDER BY usage_date) AS t FROM fin)
    WHERE t IS NOT NULL GROUP BY ALL""", "fin"))
def _(b):
    rows = fp.Boosted().targets(fq.forecast_input(b.features), 90)
    return rows.groupBy("cloud_provider", "service").agg(F.count(F.lit(1)).alias("n"))


@entry("wn10_last_row", sql("""
    SELECT cloud_provider, service, CAST(usage_date AS VARCHAR) AS usage_date,
      round(cost_usd, 2) AS cost_usd FROM (SELECT *, row_number() OVER (PARTITION BY
      cloud_provider, service ORDER BY usage_date DESC) AS rn FROM fin) WHERE rn = 1""", "fin"))
def _(b):
    rows = series.last_row(fq.forecast_input(b.features), ["cloud_provider", "service"],
                           "usage_date")
    return rounded(rows.select("cloud_provider", "service", "usage_date", "cost_usd"), 2,
                   "cost_usd")


@entry("wn11_trailing_sequences", sql(f"""
    SELECT {KEY}, 30 AS steps, round(s, 2) AS total, first_cost FROM (SELECT *, count(*) OVER w
      AS n, sum(total_cost_usd) OVER w AS s, first_value(total_cost_usd) OVER w AS first_cost
      FROM feat WINDOW w AS (PARTITION BY {DIMS} ORDER BY feature_date ROWS 29 PRECEDING))
    WHERE n = 30""", "feat"))
def _(b):
    rows = series.trailing_sequences(b.features, DIMENSIONS, "feature_date", ["total_cost_usd"])
    total = F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x)
    return rounded(rows.select(*FEATURE_KEY, F.size("sequence").alias("steps"),
                               total.alias("total"),
                               F.get("sequence", F.lit(0)).alias("first_cost")), 2, "total")


@entry("wn12_running_totals", sql("""
    SELECT cloud_provider, CAST(d.forecast_date AS VARCHAR) AS forecast_date,
      round(sum(p) OVER w, 2) AS cum_predicted_cost, round(sum(u) OVER w, 3) AS cum_upper_bound
    FROM (SELECT cloud_provider, forecast_date, sum(predicted_cost) AS p, sum(upper_bound) AS u
      FROM fcst GROUP BY ALL) d
    WINDOW w AS (PARTITION BY cloud_provider ORDER BY d.forecast_date)""", "fcst"))
def _(b):
    rows = b.forecasts.groupBy("cloud_provider", "forecast_date").agg(
        F.sum("predicted_cost").alias("predicted_cost"), F.sum("upper_bound").alias("upper_bound"))
    out = series.running_totals(rows, ["cloud_provider"], "forecast_date",
                                ["predicted_cost", "upper_bound"])
    return rounded(rounded(out.select("cloud_provider", "forecast_date", "cum_predicted_cost",
                                      "cum_upper_bound"), 2, "cum_predicted_cost"), 3,
                   "cum_upper_bound")


@entry("wn13_first_date_reaching", sql("""
    SELECT cloud_provider, CAST(min(forecast_date) FILTER (WHERE c >= 10000000) AS VARCHAR)
      AS breach_date FROM (SELECT cloud_provider, forecast_date, sum(sum(upper_bound)) OVER (
      PARTITION BY cloud_provider ORDER BY forecast_date) AS c FROM fcst
      GROUP BY cloud_provider, forecast_date) GROUP BY 1""", "fcst"))
def _(b):
    rows = b.forecasts.groupBy("cloud_provider", "forecast_date").agg(
        F.sum("upper_bound").alias("upper_bound"))
    running = series.running_totals(rows, ["cloud_provider"], "forecast_date", ["upper_bound"])
    return series.first_date_reaching(running, ["cloud_provider"], "forecast_date",
                                      "cum_upper_bound", F.lit(10000000.0))


@entry("wn16_top_drivers_per_row", sql("""
    SELECT CAST(attribution_date AS VARCHAR) AS attribution_date, cloud_provider,
      service_category, account_id, environment, team, top_driver_1, top_driver_1_value,
      top_driver_2, top_driver_2_value, top_driver_3, top_driver_3_value FROM attr""", "attr"))
def _(b):
    return b.attributions.drop("shap_values", "total_cost_usd")


@entry("wn17_latest_per_group", sql("""
    SELECT cloud_provider, service, strftime(max(generated_at), '%Y-%m-%d %H:%M:%S') AS last_run
    FROM fcst GROUP BY ALL""", "fcst"))
def _(b):
    return series.latest_per_group(b.forecasts, ["cloud_provider", "service"], "generated_at",
                                   "last_run")


@entry("pf19_model_matrix", sql(f"""
    SELECT {KEY}, coalesce(cost_lag_30d, 0) AS cost_lag_30d, CAST(is_weekend AS DOUBLE) AS
      is_weekend, CAST(month AS DOUBLE) AS month, 0.0::DOUBLE AS not_a_column FROM feat""",
    "feat"))
def _(b):
    return flt.model_matrix(b.features, ["cost_lag_30d", "is_weekend", "month", "not_a_column"],
                            FEATURE_KEY)


# --- series aggregates -------------------------------------------------------------

AVERAGED = ["rolling_mean_7d", "rolling_mean_30d", "rolling_std_7d", "rolling_std_30d", "lag_1d",
            "lag_7d", "lag_30d", "pct_change_7d", "day_of_week"]


@entry("ag16_forecast_input", sql(
    "SELECT CAST(usage_date AS VARCHAR) AS usage_date, cloud_provider, service, "
    "round(cost_usd, 2) AS cost_usd, is_weekend, is_month_end, "
    + ", ".join(f"{s32(c)} AS {c}" for c in AVERAGED) + " FROM fin", "fin"))
def _(b):
    return f32(rounded(fq.forecast_input(b.features), 2, "cost_usd"), *AVERAGED)


@entry("ag21_group_size_gates", sql("""
    SELECT cloud_provider, service_category, account_id, count(*) AS group_rows FROM feat
    GROUP BY ALL HAVING count(*) >= 400""", "feat"))
def _(b):
    keys = ["cloud_provider", "service_category", "account_id"]
    rows = groups_of_size(b.features, keys, 400)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows"))


@entry("ag21_group_count_on_rows", sql("""
    SELECT alert_id, count(*) OVER (PARTITION BY cloud_provider, alert_type) AS group_rows
    FROM alert""", "alert"))
def _(b):
    return with_group_count(b.alerts, ["cloud_provider", "alert_type"]).select(
        "alert_id", "group_rows")


@entry("ag23_score_range", sql("""
    SELECT cloud_provider, service, min(ensemble_score) AS score_min, max(ensemble_score)
      AS score_max FROM anom GROUP BY ALL""", "anom"))
def _(b):
    from costlens.operators.forest import score_ranges
    return score_ranges(b.anomalies, ["cloud_provider", "service"], "ensemble_score")


@entry("ag24_train_ranges", sql(f"""
    SELECT cloud_provider, service_category, min(cost_lag_1d) AS lo, max(cost_lag_1d) AS hi FROM (
      SELECT cloud_provider, service_category, coalesce(cost_lag_1d, 0) AS cost_lag_1d,
        {LABEL} AS split FROM s) WHERE split = 'train' GROUP BY ALL""", "feat", s=SPLIT))
def _(b):
    from costlens.plans.detect import SequenceReconstruction
    detector = SequenceReconstruction()
    rows = series.chronological_split(detector._numbers(b.features), at.GROUP, "feature_date",
                                      DIMENSIONS[2:])
    return detector.train_ranges(rows).select(
        *at.GROUP, F.col("_min_cost_lag_1d").alias("lo"), F.col("_max_cost_lag_1d").alias("hi"))


@entry("ag25_error_threshold", sql(f"""
    SELECT cloud_provider, service_category,
      {s32('quantile_cont(abs(total_cost_usd - rolling_mean_30d), 0.95)')} AS p95 FROM feat
    GROUP BY ALL""", "feat"))
def _(b):
    rows = b.features.withColumn("e", F.abs(F.col("total_cost_usd") - F.col("rolling_mean_30d")))
    return f32(percentiles.exact_percentiles(rows, at.GROUP, "e",
                                             {"p95": C.SEQUENCE_ERROR_PERCENTILE}), "p95")


@entry("ag26_error_metrics", sql(f"""
    SELECT cloud_provider, service_category AS service, {s32('avg(abs(y - p))')} AS mae,
      {s32('avg(abs(y + 1e-9 - p) / abs(y + 1e-9))')} AS mape,
      {s32('stddev_pop(y - p)')} AS residual_std, count(*) AS test_rows,
      {s32('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))')} AS r2 FROM (
      SELECT *, total_cost_usd AS y, rolling_mean_7d AS p FROM feat) GROUP BY ALL""", "feat"))
def _(b):
    rows = b.features.withColumnRenamed("service_category", "service")
    return f32(fp.error_metrics(rows, fp.GROUP, "total_cost_usd", "rolling_mean_7d"),
               "mae", "mape", "residual_std", "r2")


@entry("ag27_mean_over_horizons", sql(f"""
    SELECT cloud_provider, {s32('avg(mape)')} AS mape, {s32('avg(mae)')} AS mae FROM (
      SELECT cloud_provider, service_category, avg(abs(total_cost_usd - rolling_mean_30d)) AS mae,
        avg(abs(total_cost_usd + 1e-9 - rolling_mean_30d) / abs(total_cost_usd + 1e-9)) AS mape
      FROM feat GROUP BY ALL) GROUP BY 1""", "feat"))
def _(b):
    rows = b.features.withColumnRenamed("service_category", "service")
    per = fp.error_metrics(rows, fp.GROUP, "total_cost_usd", "rolling_mean_30d")
    return f32(fp.mean_over_horizons(per, ["cloud_provider"]), "mape", "mae")


@entry("ag32_box_plot", sql(f"""
    SELECT cloud_provider, service, {s32('any_value(q1)')} AS q1, {s32('any_value(q2)')}
      AS median, {s32('any_value(q3)')} AS q3,
      min(cost_usd) FILTER (WHERE cost_usd BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))
        AS whisker_low,
      max(cost_usd) FILTER (WHERE cost_usd BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))
        AS whisker_high,
      count(*) FILTER (WHERE cost_usd NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))
        AS outliers
    FROM raw JOIN (SELECT cloud_provider, service, quantile_cont(cost_usd, 0.25) AS q1,
      quantile_cont(cost_usd, 0.5) AS q2, quantile_cont(cost_usd, 0.75) AS q3 FROM raw
      GROUP BY ALL) USING (cloud_provider, service) GROUP BY ALL""", "raw"))
def _(b):
    return f32(percentiles.box_plot(b.raw_billing, ["cloud_provider", "service"], "cost_usd"),
               "q1", "median", "q3")


@entry("ag32_box_plot_lines", sql(f"""
    SELECT cloud_provider, {s32('quantile_cont(cost_usd, 0.25)')} AS q1,
      {s32('quantile_cont(cost_usd, 0.5)')} AS median, {s32('quantile_cont(cost_usd, 0.95)')}
      AS p95 FROM lines GROUP BY ALL""", "lines"))
def _(b):
    return f32(percentiles.exact_percentiles(b.billing_lines, ["cloud_provider"], "cost_usd",
                                             {"q1": 0.25, "median": 0.5, "p95": 0.95}),
               "q1", "median", "p95")


@entry("ml10_contribution_formula", sql("""
    SELECT cloud_provider, service_category, feature,
      CAST(sum(CAST(v AS DECIMAL(20, 6))) AS DOUBLE) AS total FROM contrib
    GROUP BY ALL""", "contrib"))
def _(b):
    from costlens.sources.testbed import contributions
    rows = contributions(b.features).select(
        "cloud_provider", "service_category", F.explode("shap_values").alias("feature", "v"))
    return rows.groupBy("cloud_provider", "service_category", "feature").agg(
        F.sum(F.col("v").cast("decimal(20,6)")).cast("double").alias("total"))


@entry("fn14_date_series", sql("""
    SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day, count(*) AS n FROM (
      SELECT unnest(generate_series(forecast_date, forecast_date + 6, INTERVAL 1 DAY)) AS d
      FROM fcst) GROUP BY 1""", "fcst"))
def _(b):
    day = F.col("forecast_date")
    return cal.date_series(b.forecasts, day, F.date_add(day, 6)).groupBy("day").agg(
        F.count(F.lit(1)).alias("n"))
