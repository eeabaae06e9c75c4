"""Plans and results when one key dominates."""

import re

from pyspark.sql import functions as F

from costlens.operators import dedup, joins, percentiles


def hot(spark, n=20000):
    """Two thirds of the rows carry one key."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"),
        F.col("id").alias("v"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_wins_limits_before_the_shuffle(spark):
    out = dedup.first_wins(hot(spark), ["k"], ["v"])
    text = plan(out)
    assert "WindowGroupLimit" in text and "Partial" in text
    assert out.where("k = 'hot'").collect()[0].v == 0
    assert out.count() == hot(spark).select("k").distinct().count()


def test_salted_join_equals_plain_join(spark):
    big = hot(spark)
    small = big.select("k").distinct().withColumn("p", F.length("k"))
    salted = joins.salted_left_join(big, small, ["k"], ["v"])
    plain = big.join(small, "k", "left")
    assert salted.select("k", "v", "p").exceptAll(plain.select("k", "v", "p")).isEmpty()
    assert salted.count() == plain.count()


def test_null_safe_anti_join(spark):
    left = spark.createDataFrame([("a", None), ("a", "x"), ("b", None)], "p string, q string")
    right = spark.createDataFrame([("a", None)], "p string, q string")
    got = joins.null_safe_anti(left, right, ["p", "q"]).collect()
    assert {tuple(r) for r in got} == {("a", "x"), ("b", None)}


def test_group_counts_use_no_window(spark):
    out = dedup.with_group_count(hot(spark), ["k"])
    assert "Window" not in plan(out)
    assert out.where("k = 'hot'").first().group_rows == hot(spark).where("k = 'hot'").count()


def test_percentiles_order_only_the_buckets_they_need(spark):
    df = hot(spark).withColumn("v", F.col("v").cast("double"))
    got = percentiles.exact_percentiles(df, ["k"], "v", {"m": 0.5})
    want = df.where("k = 'hot'").agg(F.percentile("v", 0.5)).first()[0]
    assert got.where("k = 'hot'").first().m == want


def test_percentiles_of_values_that_are_almost_equal(spark, monkeypatch):
    monkeypatch.setattr(percentiles, "CROWDED", 500)
    rows = spark.range(200_000).select(
        F.lit("g").alias("g"), (1 + F.col("id") * 5e-15).alias("v")).unionByName(
        spark.range(50).select(F.lit("s").alias("g"), (F.col("id") - 20).cast("double").alias("v")))
    got = {r.g: (r.a, r.b) for r in percentiles.exact_percentiles(
        rows, ["g"], "v", {"a": 0.25, "b": 0.953}).collect()}
    for g in ("g", "s"):
        want = rows.where(F.col("g") == g).agg(F.percentile("v", 0.25), F.percentile("v", 0.953)).first()
        assert got[g] == tuple(want)


def test_no_window_of_the_split_holds_a_group(spark):
    from costlens.operators.series import chronological_split
    rows = spark.range(20_000).select(
        (F.col("id") % 1).alias("g"), F.date_add(F.lit("2023-01-01").cast("date"),
                                          (F.col("id") % 10).cast("int")).alias("d"),
        F.col("id").cast("string").alias("a"))
    out = chronological_split(rows, ["g"], "d", ["a"])
    counts = {r.split: (r.n, r.lo, r.hi) for r in out.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("position").alias("lo"),
        F.max("position").alias("hi")).collect()}
    assert counts == {"train": (14_000, 0, 13_999), "val": (3000, 14_000, 16_999),
                      "test": (3000, 17_000, 19_999)}
    ordered = out.orderBy("d", "a").select("position").collect()
    assert [r.position for r in ordered] == list(range(20_000))
    # windows over a whole group order its days, those that order cells are within a day
    text = plan(out)
    assert re.search(r"windowspecdefinition\(g#\d+L, d#\d+ ASC", text)
    assert re.search(r"windowspecdefinition\(g#\d+L, d#\d+, a#\d+ ASC", text)
    assert not re.search(r"windowspecdefinition\(g#\d+L, (d#\d+ ASC NULLS FIRST, )?a#", text)


def test_filters_and_columns_reach_the_scan(spark, root):
    from costlens.plans.normalise import normalise
    from costlens.sources.billing import read_billing
    from tests.data import raw
    raw(spark, {}, {"usage_date": "2023-02-01"}).write.parquet(f"{root}/aws")
    rows = read_billing(spark, root, "aws", start="2023-01-15")
    text = plan(normalise(rows).groupBy("cloud_provider").agg(F.sum("cost_usd")))
    assert "GreaterThanOrEqual(usage_date,2023-01-15)" in text
    scan = text[text.index("ReadSchema"):]
    assert "notes" not in scan and "resource_id" not in scan and "is_anomaly" not in scan


def test_dated_tables_prune_partitions(spark, root):
    from costlens.operators import tables
    from tests.data import normalised
    tables.insert_if_absent(normalised(spark, 5).unionByName(
        normalised(spark, 5, "2023-06-01", prefix="b")), root, "billing_records")
    text = plan(tables.scan(spark, root, "billing_records", "2023-05-30", "2023-06-10"))
    part = text[text.index("PartitionFilters"):]
    assert "part_date" in part.split("PushedFilters")[0]


def test_shares_scan_once_without_a_join(spark, sf_dir):
    from costlens.operators.rollup import spend_by_cloud
    from costlens.sources import testbed
    text = plan(spend_by_cloud(testbed.billing(spark, sf_dir)))
    assert "Join" not in text and text.count("FileScan") == 1


def test_features_shuffle_once(spark, sf_dir):
    from costlens.operators.series import build_features
    from costlens.sources import testbed
    stored = testbed.daily(spark, sf_dir)
    text = plan(build_features(stored))
    assert text.count("Exchange") == 2      # the rollup and the series
