"""Fitted operators and whole jobs; most are checked by invariants in the tests."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from costlens import constants as C, session
from costlens.operators import forecasts as fq, rollup, series, tables
from costlens.plans import attribute as at, detect, forecast as fp, ingest
from costlens.schemas import FEATURE_KEY
from costlens.sources import billing as src
from entries.base import entry, f32, rounded, s32
from entries.ctes import DIMS, sql
from entries.tables_entries import landed


def _stored(b, label: str) -> str:
    """Billing, rollup and features of the orders view as tables."""
    root = b.root(label)
    billing = b.billing.withColumns({
        "service_name_raw": F.col("service_category"),
        "ingested_at": F.col("usage_date").cast("timestamp"), "cost_original": F.col("cost_usd"),
        "currency_original": F.lit("USD"), "anomaly_flag": F.lit(False),
        "anomaly_severity": F.lit(None).cast("string")})
    tables.insert_if_absent(billing, root, "billing_records", unique=True)
    tables.merge(rollup.daily_rollup(tables.scan(b.spark, root, "billing_records")), root,
                 "daily_aggregates")
    daily = tables.scan(b.spark, root, "daily_aggregates")
    tables.merge(series.build_features(daily), root, "spend_features")
    return root


@entry("ml2_isolation_forest")
def _(b):
    _, scored = detect.IsolationForest().fit_score(session.materialize(b.features, "features"))
    return scored.select(*FEATURE_KEY, "total_cost_usd", "z_score_30d", "iforest_score")


@entry("ml2_score_span", sql(f"""
    SELECT cloud_provider, service_category, count(*) AS n, 0.0::DOUBLE AS lowest,
      1.0::DOUBLE AS highest FROM feat GROUP BY ALL
    HAVING count(*) >= {C.MIN_ROWS['iforest']}""", "feat"))
def _(b):
    """Every row of a fitted group has a score, and the scores span the unit interval."""
    rows = session.materialize(b.features, "features")
    forest = detect.IsolationForest()
    params = session.materialize(forest.fit(rows), "forest")
    scored = forest.score(rows, params).join(params.select(*at.GROUP).distinct(), at.GROUP)
    return scored.groupBy(*at.GROUP).agg(
        F.count("iforest_score").alias("n"), F.round(F.min("iforest_score"), 9).alias("lowest"),
        F.round(F.max("iforest_score"), 9).alias("highest"))


@entry("ml3_sequence_reconstruction")
def _(b):
    rows = session.materialize(b.features, "features")
    detector = detect.SequenceReconstruction()
    params = session.materialize(detector.fit(rows), "sequence")
    return detector.score(rows, params).select(*FEATURE_KEY, "total_cost_usd", "sequence_score")


@entry("ml5_detection_job")
def _(b):
    root = _stored(b, "ml5")
    report = detect.run(b.spark, root, "1995-01-01", "2001-12-31",
                        F.to_timestamp(F.lit("2002-01-01")))
    flagged = tables.scan(b.spark, root, "billing_records").groupBy(
        "cloud_provider", "service_category").agg(
        F.count_if("anomaly_flag").alias("flagged_rows"))
    return report.join(flagged, ["cloud_provider", "service_category"], "left")


@entry("ml3_sequence_gates", sql(f"""
    SELECT cloud_provider, service_category, n, n >= {C.MIN_ROWS['sequence']}
      AND floor(n * {C.TRAIN_RATIO}::DOUBLE) >= {C.MIN_ROWS['sequence_train']} AS fitted,
      CAST(0 AS BIGINT) AS early, CAST(0 AS BIGINT) AS outside
    FROM (SELECT cloud_provider, service_category, count(*) AS n FROM feat GROUP BY ALL)""", "feat"))
def _(b):
    """Groups with enough rows are fitted; scores lie in 0..1 and start with the 30th row of a
    series."""
    rows = session.materialize(b.features, "features")
    detector = detect.SequenceReconstruction()
    params = session.materialize(detector.fit(rows), "sequence")
    number = F.row_number().over(series.over_series("feature_date"))
    scored = detector.score(rows, params).withColumn("_i", number)
    score = F.col("sequence_score")
    counted = scored.groupBy(*at.GROUP).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("_i") < C.SEQUENCE_LENGTH) & (score != 0)).alias("early"),
        F.count_if(~score.between(0, 1)).alias("outside"))
    fitted = params.select(*at.GROUP, F.lit(True).alias("fitted"))
    return counted.join(fitted, at.GROUP, "left").withColumn(
        "fitted", F.coalesce("fitted", F.lit(False)))


@entry("ml5_flags_agree", sql("""
    SELECT cloud_provider, service_category, count(*) AS n, CAST(0 AS BIGINT) AS disagreeing,
      CAST(0 AS BIGINT) AS unreported FROM bill GROUP BY ALL""", "bill"))
def _(b):
    """After the job a billing row is flagged, with the severity, just where its (cloud,
    category, account, date) is a stored anomaly, and the report counts them all."""
    from costlens.functions.scoring import severity_rank
    root = _stored(b, "ml5-flags")
    report = detect.run(b.spark, root, "1995-01-01", "2001-12-31",
                        F.to_timestamp(F.lit("2002-01-01")))
    found = tables.scan(b.spark, root, "anomalies")
    keys = ["cloud_provider", "service_category", "account_id", "usage_date"]
    named = found.withColumnRenamed("service", "service_category")
    worst = named.groupBy(*keys).agg(
        F.max_by("severity", severity_rank(F.col("severity"))).alias("wanted"))
    rows = tables.scan(b.spark, root, "billing_records").join(worst, keys, "left")
    same = (F.col("anomaly_flag") == F.col("wanted").isNotNull()) & F.col(
        "anomaly_severity").eqNullSafe(F.col("wanted"))
    stored = named.groupBy(*at.GROUP).agg(F.count(F.lit(1)).alias("stored"))
    unreported = report.join(stored, at.GROUP, "left").select(
        *at.GROUP, F.abs(F.col("anomalies") - F.coalesce("stored", F.lit(0))).alias("unreported"))
    return rows.groupBy(*at.GROUP).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~same).alias("disagreeing")).join(
        unreported, at.GROUP, "left").withColumn("unreported", F.coalesce("unreported", F.lit(0)))


@entry("ml6_seasonal_forecaster")
def _(b):
    series_df = session.materialize(fq.forecast_input(b.features), "series")
    model = fp.Seasonal()
    return model.predict(session.materialize(model.fit(series_df), "seasonal"), 30)


@entry("ml6_forecast_shape", sql(f"""
    SELECT cloud_provider, service_category AS service, 30 AS days,
      CAST(max(feature_date) + 1 AS VARCHAR) AS first, CAST(max(feature_date) + 30 AS VARCHAR)
      AS last, 0 AS crossed FROM feat GROUP BY ALL
    HAVING count(DISTINCT feature_date) >= {C.MIN_ROWS['seasonal']}""", "feat"))
def _(b):
    """Thirty days in a row after each group's last one, inside their bands."""
    model = fp.Seasonal()
    fitted = session.materialize(
        model.fit(session.materialize(fq.forecast_input(b.features), "series")), "seasonal")
    out = F.col("lower_bound") > F.col("upper_bound")
    return model.predict(fitted, 30).groupBy("cloud_provider", "service").agg(
        F.countDistinct("forecast_date").alias("days"), F.min("forecast_date").alias("first"),
        F.max("forecast_date").alias("last"),
        F.count_if(out | (F.col("lower_bound") < 0)).alias("crossed"))


@entry("ml7_boosted_forecaster")
def _(b):
    series_df = session.materialize(fq.forecast_input(b.features), "series")
    model = fp.Boosted()
    return model.predict(session.materialize(model.fit(series_df), "boosted"))


@entry("ml6_band_growth", sql(f"""
    SELECT cloud_provider, service_category AS service, CAST(29 AS BIGINT) AS widening,
      CAST(30 AS BIGINT) AS explained FROM feat GROUP BY ALL
    HAVING count(DISTINCT feature_date) >= {C.MIN_ROWS['seasonal']}""", "feat"))
def _(b):
    """Bands widen from day to day, as the stored spread and trend changes say."""
    model = fp.Seasonal()
    fitted = session.materialize(
        model.fit(session.materialize(fq.forecast_input(b.features), "series")), "seasonal")
    rows = model.predict(fitted, 30).join(
        fitted.select(*fp.GROUP, "beta", "sigma", "scale", "span_days", "last_day"), fp.GROUP)
    days = W.partitionBy(*fp.GROUP).orderBy("forecast_date")
    half = F.col("upper_bound") - F.col("predicted_cost")
    rows = rows.withColumns({"half": half, "before": F.lag(half).over(days)})
    explained = F.expr("""abs(half - 1.96 * sqrt(pow(sigma, 2) + pow(scale * aggregate(
        slice(beta, 3, 25), 0D, (s, x) -> s + abs(x)) / 25, 2) * 2 * 31.25 / 3
        * pow(datediff(forecast_date, last_day) / span_days, 3))) <= 1e-9 * abs(half)""")
    return rows.groupBy(*fp.GROUP).agg(F.count_if(F.col("half") > F.col("before")).alias("widening"),
                                       F.count_if(explained).alias("explained"))


@entry("ml7_boosted_horizons", sql(f"""
    SELECT cloud_provider, service, h AS horizon_days, CAST(last + h AS VARCHAR) AS forecast_date,
      CAST(n - h - floor((n - h) * {C.TRAIN_RATIO}::DOUBLE) - floor((n - h) *
        {C.VAL_RATIO}::DOUBLE) AS BIGINT) AS test_rows, true AS inside
    FROM (SELECT cloud_provider, service_category AS service, max(feature_date) AS last,
            CAST(count(DISTINCT feature_date) AS INTEGER) AS n FROM feat GROUP BY ALL)
      JOIN (SELECT unnest({C.FORECAST_HORIZONS}) AS h) ON n > h
    WHERE n >= {C.MIN_ROWS['boosted']}""", "feat"))
def _(b):
    """One forecast per group and horizon that its series reaches, inside its band."""
    model = fp.Boosted()
    params = session.materialize(
        model.fit(session.materialize(fq.forecast_input(b.features), "series")), "boosted")
    inside = F.col("predicted_cost").between(F.col("lower_bound"), F.col("upper_bound"))
    return model.predict(params).join(
        params.select(*fp.GROUP, "horizon_days", "test_rows"), [*fp.GROUP, "horizon_days"]).select(
        *fp.GROUP, "horizon_days", "forecast_date", "test_rows",
        (inside | (F.col("predicted_cost") < 0)).alias("inside"))


BLEND_SIDE = """SELECT cloud_provider, service, forecast_date, sum(predicted_cost) AS p,
    sum(lower_bound) AS lo, sum(upper_bound) AS hi FROM fcst WHERE model_used = '{m}'
    GROUP BY ALL"""


@entry("ml8_blend", sql(f"""
    SELECT cloud_provider, service, CAST(forecast_date AS VARCHAR) AS forecast_date,
      CAST(forecast_date - origin AS INTEGER) AS horizon_days,
      {s32('CASE WHEN s.p IS NOT NULL AND b.p IS NOT NULL THEN s.p * 0.25::DOUBLE / (0.75::DOUBLE + 0.25::DOUBLE) + b.p * 0.75::DOUBLE / (0.75::DOUBLE + 0.25::DOUBLE) ELSE coalesce(s.p, b.p) END')}
        AS predicted_cost,
      {s32('least(s.lo, b.lo)')} AS lower_bound, {s32('greatest(s.hi, b.hi)')} AS upper_bound,
      CASE WHEN s.p IS NOT NULL AND b.p IS NOT NULL THEN 0.25::DOUBLE WHEN s.p IS NOT NULL
        THEN 1 ELSE 0 END AS seasonal_weight
    FROM s FULL JOIN b USING (cloud_provider, service, forecast_date)
    JOIN (SELECT cloud_provider, service, min(forecast_date) - 7 AS origin FROM b GROUP BY ALL)
      USING (cloud_provider, service) WHERE forecast_date > origin""",
    "fcst", s=BLEND_SIDE.format(m="seasonal"), b=BLEND_SIDE.format(m="ensemble")))
def _(b):
    def side(model, mape):
        rows = b.forecasts.where(F.col("model_used") == model)
        return rows.groupBy("cloud_provider", "service", "forecast_date").agg(
            *[F.sum(c).alias(c) for c in ("predicted_cost", "lower_bound", "upper_bound")]
        ).withColumns({"mape": F.lit(mape), "horizon_days": F.lit(7)})
    out = fp.blend(side("seasonal", 0.75), side("ensemble", 0.25), F.current_timestamp())
    return f32(out.select("cloud_provider", "service", "forecast_date", "horizon_days",
                          "predicted_cost", "lower_bound", "upper_bound", "seasonal_weight"),
               "predicted_cost", "lower_bound", "upper_bound")


SIDES = {"s": BLEND_SIDE.format(m="seasonal"), "b": BLEND_SIDE.format(m="ensemble")}


@entry("jn9_outer_join_forecasters", sql("""
    SELECT cloud_provider, service, count(*) AS dates, count(s.p) AS seasonal, count(b.p)
      AS boosted FROM s FULL JOIN b USING (cloud_provider, service, forecast_date)
    GROUP BY ALL""", "fcst", **SIDES))
def _(b):
    key = ["cloud_provider", "service", "forecast_date"]

    def side(model, name):
        rows = b.forecasts.where(F.col("model_used") == model)
        return rows.groupBy(*key).agg(F.sum("predicted_cost").alias(name))
    both = side("seasonal", "s").join(side("ensemble", "b"), key, "full_outer")
    return both.groupBy("cloud_provider", "service").agg(
        F.count(F.lit(1)).alias("dates"), F.count("s").alias("seasonal"),
        F.count("b").alias("boosted"))


@entry("fn25_blend_bounds", sql(f"""
    SELECT cloud_provider, round(sum(least(s.lo, b.lo)), 3) AS lo,
      round(sum(greatest(s.hi, b.hi)), 3) AS hi FROM s FULL JOIN b
      USING (cloud_provider, service, forecast_date) GROUP BY 1""", "fcst", **SIDES))
def _(b):
    out = _blended(b)
    return rounded(out.groupBy("cloud_provider").agg(
        F.sum("lower_bound").alias("lo"), F.sum("upper_bound").alias("hi")), 3, "lo", "hi")


def _blended(b):
    def side(model):
        rows = b.forecasts.where(F.col("model_used") == model)
        return rows.groupBy("cloud_provider", "service", "forecast_date").agg(
            *[F.sum(c).alias(c) for c in ("predicted_cost", "lower_bound", "upper_bound")]
        ).withColumns({"mape": F.lit(0.5), "horizon_days": F.lit(90)})
    return fp.blend(side("seasonal"), side("ensemble"), F.current_timestamp())


@entry("fn26_horizon_from_origin", sql("""
    SELECT cloud_provider, service, CAST(max(forecast_date - origin) AS INTEGER) AS furthest,
      count(*) AS dates FROM (SELECT cloud_provider, service, forecast_date FROM s UNION
      SELECT cloud_provider, service, forecast_date FROM b)
    JOIN (SELECT cloud_provider, service, min(forecast_date) - 90 AS origin FROM b GROUP BY ALL)
      USING (cloud_provider, service) WHERE forecast_date > origin GROUP BY ALL""",
    "fcst", **SIDES))
def _(b):
    return _blended(b).groupBy("cloud_provider", "service").agg(
        F.max("horizon_days").alias("furthest"), F.count(F.lit(1)).alias("dates"))


@entry("ml9_forecast_job")
def _(b):
    root = _stored(b, "ml9")
    fp.run(b.spark, root, "1995-01-01", "2001-12-31", F.to_timestamp(F.lit("2002-01-01")))
    return tables.scan(b.spark, root, "forecasts")


@entry("ml9_blend_of_stored", sql(f"""
    SELECT cloud_provider, service_category AS service, CASE WHEN count(DISTINCT feature_date)
      >= {C.MIN_ROWS['seasonal']} THEN 90 ELSE 3 END AS dates, true AS consistent
    FROM feat GROUP BY ALL HAVING count(DISTINCT feature_date) >= {C.MIN_ROWS['boosted']}""", "feat"))
def _(b):
    """Stored forecasts are the weighted means of their stored parts, one for each day."""
    root = _stored(b, "ml9-blend")
    fp.run(b.spark, root, "1995-01-01", "2001-12-31", F.to_timestamp(F.lit("2002-01-01")))
    zero = F.lit(0.0)
    mixed = (F.coalesce(F.col("seasonal_prediction") * F.col("seasonal_weight"), zero)
             + F.coalesce(F.col("boosted_prediction") * F.col("boosted_weight"), zero))
    last = F.date_sub("forecast_date", F.col("horizon_days"))
    rows = tables.scan(b.spark, root, "forecasts")
    return rows.groupBy(*fp.GROUP).agg(
        F.countDistinct("forecast_date").cast("int").alias("dates"),
        (F.bool_and(F.abs(F.greatest(mixed, zero) - F.col("predicted_cost"))
                    <= 1e-9 * (1 + F.abs("predicted_cost")))
         & F.bool_and(F.abs(F.col("seasonal_weight") + F.col("boosted_weight") - 1) <= 1e-9)
         & (F.min(last) == F.max(last))).alias("consistent"))


@entry("ml9_force_one_cloud", sql(f"""
    SELECT cloud_provider, count(*) AS groups, count(*) FILTER (WHERE cloud_provider = 'aws')
      AS refitted, sum(CASE WHEN n >= {C.MIN_ROWS['seasonal']} THEN 90 ELSE 3 END)::BIGINT
      AS forecasts FROM (SELECT cloud_provider, count(DISTINCT feature_date) AS n FROM feat
      GROUP BY cloud_provider, service_category) WHERE n >= {C.MIN_ROWS['boosted']}
    GROUP BY 1""", "feat"))
def _(b):
    """Models of one cloud are fitted anew and stored; the others' stay, and all predict."""
    root = _stored(b, "ml9-force")
    span, now = ("1995-01-01", "2001-12-31"), F.to_timestamp(F.lit("2002-01-01"))
    fp.run(b.spark, root, *span, now, mode="train")

    def versions(name):
        return session.materialize(tables.load_params(b.spark, root, "boosted").groupBy(
            *fp.GROUP).agg(F.any_value("version").alias(name)), "versions")

    before = versions("before")
    fp.run(b.spark, root, *span, now, cloud="aws", mode="train", force=True)
    both = before.join(versions("after"), fp.GROUP, "full_outer")
    fp.run(b.spark, root, *span, now, mode="predict")
    counts = tables.scan(b.spark, root, "forecasts").groupBy("cloud_provider").agg(
        F.count(F.lit(1)).alias("forecasts"))
    return both.groupBy("cloud_provider").agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(F.col("before") != F.col("after")).alias("refitted")).join(counts, "cloud_provider")


@entry("ml10_attribution_fit")
def _(b):
    return at.fit(b.features).select(
        *at.GROUP, "base", "r2", "train_rows", "test_rows", F.size("beta").alias("features"))


@entry("ml10_fit_rows", sql(f"""
    SELECT cloud_provider, service_category, CAST(floor(n * {C.TRAIN_RATIO}::DOUBLE) AS BIGINT)
      AS train_rows, n - CAST(floor(n * {C.TRAIN_RATIO}::DOUBLE) AS BIGINT)
      - CAST(floor(n * {C.VAL_RATIO}::DOUBLE) AS BIGINT) AS test_rows
    FROM (SELECT cloud_provider, service_category, count(*) AS n FROM feat GROUP BY ALL)
    WHERE n >= {C.MIN_ROWS['attribution']}""", "feat"))
def _(b):
    """Each group is fitted on its first 70 % of rows and tested on the last 15 %."""
    return at.fit(b.features).select(*at.GROUP, "train_rows", "test_rows")


@entry("ml10_additive_contributions", sql(f"""
    SELECT CAST(feature_date AS VARCHAR) AS feature_date, {DIMS}, true AS adds_up, 19 AS n_values
    FROM feat""", "feat"))
def _(b):
    """Contributions plus base equal the prediction on every row of every fitted group."""
    rows = at.explain(b.features, session.materialize(at.fit(b.features), "attribution"))
    total = F.aggregate(F.map_values("shap_values"), F.lit(0.0), lambda s, v: s + v)
    gap = F.abs(F.col("base") + total - F.col("prediction"))
    return rows.select(*FEATURE_KEY, (gap <= 1e-6 * (1 + F.abs("prediction"))).alias("adds_up"),
                       F.size("shap_values").alias("n_values"))


@entry("ml11_attribution_job", sql(f"""
    SELECT cloud_provider, service_category, count(*) AS attributed, 3 * count(*) AS drivers
    FROM feat GROUP BY ALL""", "feat"))
def _(b):
    root = _stored(b, "ml11")
    at.run(b.spark, root, "1995-01-01", "2001-12-31", F.to_timestamp(F.lit("2002-01-01")))
    return tables.scan(b.spark, root, "cost_attributions").groupBy(*at.GROUP).agg(
        F.count(F.lit(1)).alias("attributed"),
        (F.count("top_driver_1") + F.count("top_driver_2")
         + F.count("top_driver_3")).alias("drivers"))


@entry("ml12_train_then_predict", sql("""
    SELECT cloud_provider, service_category, count(*) AS n FROM feat GROUP BY ALL""", "feat"))
def _(b):
    """Parameters of one cloud are stored, the other groups fitted later, none twice."""
    root, rows = b.root("ml12"), session.materialize(b.features, "features")
    detector = detect.IsolationForest()
    detect.train(rows.where("cloud_provider = 'aws'"), detector, root)
    params = detect.train(rows, detector, root)
    scored = detect.combine(detector.score(detect.ZScore().score(rows), params))
    trees = params.groupBy(*at.GROUP).agg(F.count(F.lit(1)).alias("trees"))
    return (scored.groupBy(*at.GROUP).agg(F.count(F.lit(1)).alias("n"))
            .join(trees.where(f"trees = {detector.trees}").drop("trees"), at.GROUP))


# --- ingestion -------------------------------------------------------------------------

@entry("nm3_load_providers", sql("""
    SELECT cloud_provider, count(DISTINCT fingerprint) AS stored FROM enriched GROUP BY 1
    UNION ALL SELECT 'broken', 0""", "enriched"))
def _(b):
    """One load per provider; a source that fails is logged and stops nothing."""
    root, landing = b.root("nm3"), landed(b)

    class One(src.ParquetSource):
        def __init__(self, cloud):
            super().__init__(landing)
            self.cloud_provider = cloud

        def read(self, spark, start=None, end=None):
            if self.cloud_provider == "broken":
                raise OSError("no such export")
            return src.read_billing(spark, self.root, self.cloud_provider, start, end)

    for cloud in ("aws", "broken", "azure", "gcp"):
        ingest.load_provider(b.spark, One(cloud), root, "2024-01-01", "2024-01-31",
                             F.to_timestamp(F.lit("2024-02-01")))
    stored = tables.scan(b.spark, root, "billing_records").groupBy("cloud_provider").agg(
        F.count(F.lit(1)).alias("stored"))
    log = tables.scan(b.spark, root, "ingestion_log").select("cloud_provider")
    return log.join(stored, "cloud_provider", "left").select(
        "cloud_provider", F.coalesce("stored", F.lit(0)).alias("stored"))


STATE = """SELECT cloud_provider, CAST(max(usage_date) AS DATE) AS last_ingested_date,
    count(*) AS total_records FROM raw WHERE usage_date <= CASE cloud_provider WHEN 'aws'
    THEN '2024-01-10' ELSE '2024-01-20' END AND cloud_provider <> 'gcp' GROUP BY 1"""


def _state(b):
    cut = F.when(F.col("cloud_provider") == "aws", "2024-01-10").otherwise("2024-01-20")
    return b.raw_billing.where((F.col("usage_date") <= cut) & (F.col("cloud_provider") != "gcp")
                               ).groupBy("cloud_provider").agg(
        F.max(F.col("usage_date").cast("date")).alias("last_ingested_date"),
        F.count(F.lit(1)).alias("total_records"))


@entry("nm4_pending_after_mark", sql("""
    SELECT record_id FROM raw LEFT JOIN st USING (cloud_provider)
    WHERE CAST(usage_date AS DATE) > coalesce(last_ingested_date, DATE '2022-12-31')
      AND usage_date <= '2024-01-27'""", "raw", st=STATE))
def _(b):
    return ingest.pending(b.raw_billing, _state(b), "2024-01-28").select("record_id")


@entry("nm4_state_after_load", sql("""
    SELECT cloud_provider, max(usage_date) AS last_ingested_date, count(*) AS total_records
    FROM raw WHERE usage_date <= '2024-01-27' GROUP BY 1""", "raw"))
def _(b):
    state = _state(b)
    loaded = ingest.pending(b.raw_billing, state, "2024-01-28").groupBy("cloud_provider").agg(
        F.max(F.col("usage_date").cast("date")).alias("last_date"),
        F.count(F.lit(1)).alias("records"))
    return ingest.state_after(state, loaded)


@entry("nm4_incremental_runs", sql("""
    SELECT cloud_provider, max(usage_date) AS last_ingested_date, count(*) AS total_records,
      (SELECT count(DISTINCT fingerprint) FROM enriched) AS stored FROM enriched GROUP BY 1""",
    "enriched"))
def _(b):
    root = b.root("nm4")
    source = src.ParquetSource(landed(b))
    for as_of in ("2024-01-12", "2024-01-12", "2024-02-05"):
        ingest.run_incremental(b.spark, source, root, as_of)
    stored = tables.scan(b.spark, root, "billing_records").agg(F.count(F.lit(1))).scalar()
    return ingest.read_state(b.spark, root).withColumn("stored", stored)


@entry("nm4_undated_rows", sql("""
    SELECT count(DISTINCT fingerprint) FILTER (WHERE record_id NOT LIKE '%7') AS stored,
      count(*) FILTER (WHERE record_id LIKE '%7') AS rejected FROM enriched""", "enriched"))
def _(b):
    """Rows whose date cannot be read are rejected on the incremental path, each once."""
    bad = F.col("record_id").endswith("7")
    raw = b.raw_billing.withColumn("usage_date", F.when(bad, "n/a").otherwise(F.col("usage_date")))
    root, source = b.root("nm4-undated"), src.ParquetSource(landed(b, raw))
    for as_of in ("2024-01-12", "2024-02-15", "2024-02-15"):
        ingest.run_incremental(b.spark, source, root, as_of)
    stored = tables.scan(b.spark, root, "billing_records").agg(F.count(F.lit(1))).scalar()
    return tables.scan(b.spark, root, "rejects").agg(F.count(F.lit(1)).alias("rejected")).withColumn(
        "stored", stored)


@entry("nm5_reset_state", sql("""
    SELECT cloud_provider, CAST(last_ingested_date AS VARCHAR) AS last_ingested_date,
      total_records FROM st WHERE cloud_provider <> 'aws'""", "raw", st=STATE))
def _(b):
    """One provider's mark is forgotten in the stored state, at last all; a dry run forgets none."""
    root = b.root("nm5")
    ingest.update_state(b.spark, root, lambda _: _state(b))
    ingest.reset_stored(b.spark, root, dry_run=True)
    left = ingest.reset_stored(b.spark, root, "aws")
    return left.unionByName(ingest.reset_stored(b.spark, root))


@entry("nm6_run_summary", sql("""
    SELECT cloud_provider, count(*) AS runs, sum(n) AS inserted, CAST(0 AS BIGINT) AS skipped,
      CAST(0 AS BIGINT) AS failed_runs FROM (SELECT cloud_provider, usage_date, count(*) AS n
      FROM raw GROUP BY ALL) GROUP BY 1""".replace("sum(n)", "CAST(sum(n) AS BIGINT)"), "raw"))
def _(b):
    log = b.raw_billing.groupBy("cloud_provider", "usage_date").agg(
        F.count(F.lit(1)).alias("records_inserted")).withColumns({
            "records_skipped": F.lit(0), "status": F.lit("success")})
    return ingest.run_summary(log)

