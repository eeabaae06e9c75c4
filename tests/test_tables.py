from functools import reduce

import pytest
from pyspark.sql import functions as F

from costlens import session
from costlens.operators import rollup, series, tables
from costlens.operators.filters import date_range
from costlens.sources import scans
from tests.data import daily, normalised, spike_costs


def test_insert_counts(spark, root):
    first = normalised(spark, 100)
    assert tables.insert_if_absent(first, root, "billing_records") == {
        "inserted": 100, "skipped": 0, "total": 100}
    assert tables.insert_if_absent(first, root, "billing_records")["inserted"] == 0
    mixed = normalised(spark, 150).where("fingerprint >= 'fp_1'")
    total = mixed.count()
    got = tables.insert_if_absent(mixed, root, "billing_records")
    assert got["inserted"] == 50 and got["total"] == total
    assert tables.scan(spark, root, "billing_records").count() == 150


def test_a_key_repeated_in_one_batch_is_stored_once(spark, root):
    twice = normalised(spark, 5).unionByName(normalised(spark, 5))
    assert tables.insert_if_absent(twice, root, "billing_records") == {
        "inserted": 5, "skipped": 5, "total": 10}


def test_filtered_reads(spark, root):
    rows = (normalised(spark, 50, "2023-01-05").unionByName(
        normalised(spark, 50, "2023-01-06", "azure", "storage", "b")).unionByName(
        normalised(spark, 100, "2023-01-15", "gcp", "compute", "c")))
    tables.insert_if_absent(rows, root, "billing_records")
    table = tables.scan(spark, root, "billing_records", "2023-01-01", "2023-01-31")

    def n(**kw):
        return scans.billing_records(table, "2023-01-01", "2023-01-31", **kw).count()
    assert tables.scan(spark, root, "billing_records", "2023-01-01", "2023-01-10").count() == 100
    assert (n(cloud="aws"), n(service="compute"), n(limit=7)) == (50, 150, 7)
    assert tables.scan(spark, root, "billing_records", "2023-02-01", "2023-01-01").isEmpty()


def test_rollup_refresh_is_idempotent(spark, root):
    rows = normalised(spark, 10, "2023-01-20", cost=10.0)
    for _ in range(2):
        tables.merge(rollup.daily_rollup(rows), root, "daily_aggregates")
    row = tables.scan(spark, root, "daily_aggregates").collect()
    assert len(row) == 1 and row[0].total_cost_usd == 100 and row[0].record_count == 10
    assert row[0].environment == "unknown"


def test_feature_upsert_replaces(spark, root):
    parts = [daily(spark, [1.0], service=f"svc_{i}") for i in range(10)]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    rows = series.build_features(df)
    tables.merge(rows, root, "spend_features")
    tables.merge(rows.withColumn("total_cost_usd", F.lit(999.0)), root, "spend_features")
    got = tables.scan(spark, root, "spend_features").collect()
    assert len(got) == 10 and {r.total_cost_usd for r in got} == {999.0}


def test_merge_leaves_other_partitions_alone(spark, root):
    rows = series.build_features(daily(spark, spike_costs()))
    tables.merge(rows, root, "spend_features")
    tables.merge(date_range(rows, "feature_date", start="2023-02-27").withColumn(
        "total_cost_usd", F.lit(-1.0)), root, "spend_features")
    got = tables.scan(spark, root, "spend_features")
    assert got.count() == 60 and got.where("total_cost_usd = -1").count() == 3


def test_partial_update_keeps_other_columns(spark, root):
    row = spark.range(1).select(
        F.lit("x").alias("anomaly_id"), F.lit("r").alias("record_id"),
        F.lit("ensemble").alias("detection_method"), F.lit("low").alias("severity"),
        F.lit(1.0).alias("expected_cost"), F.lit(2.0).alias("actual_cost"),
        F.lit(100.0).alias("deviation_pct"), F.to_timestamp(F.lit("2023-01-02")).alias(
            "detected_at"), F.lit("aws").alias("cloud_provider"), F.lit("compute").alias("service"),
        F.lit("a").alias("account_id"), F.to_date(F.lit("2023-01-01")).alias("usage_date"),
        F.lit(0.3).alias("ensemble_score"))
    tables.merge(row, root, "anomalies")
    tables.merge(row.withColumns({"severity": F.lit("high"), "ensemble_score": F.lit(0.8),
                                  "expected_cost": F.lit(5.0)}), root, "anomalies",
                 ["severity", "ensemble_score"])
    got = tables.scan(spark, root, "anomalies").first()
    assert (got.severity, got.ensemble_score, got.expected_cost) == ("high", 0.8, 1.0)


def test_flags_take_the_highest_severity(spark, root):
    tables.insert_if_absent(normalised(spark, 4).unionByName(
        normalised(spark, 4, "2023-03-01", prefix="other")), root, "billing_records")
    dims = spark.createDataFrame(
        [("aws", "compute", "a1", "2023-01-15", "low"),
         ("aws", "compute", "a1", "2023-01-15", "critical")],
        "cloud_provider string, service_category string, account_id string, usage_date string, "
        "severity string").withColumn("usage_date", F.to_date("usage_date"))
    tables.update_flags(root, dims)
    got = tables.scan(spark, root, "billing_records").groupBy(
        "anomaly_flag", "anomaly_severity").count().collect()
    assert {(r[0], r[1], r[2]) for r in got} == {(True, "critical", 4), (False, None, 4)}


def test_bootstrap_creates_once(spark, root):
    assert len(tables.bootstrap(spark, root)) == 10
    assert tables.bootstrap(spark, root) == []
    assert tables.scan(spark, root, "alerts").isEmpty()


def weeks(spark, n=6):
    parts = [normalised(spark, 5, f"2023-0{m}-15", prefix=f"p{m}") for m in range(1, n + 1)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def listed(spark, *ids):
    return spark.createDataFrame([(i, "high") for i in ids], "identifier string, severity string")


def test_flagging_reads_only_indexed_partitions(spark, root):
    tables.insert_if_absent(weeks(spark), root, "billing_records")
    ids = listed(spark, "p2_3", "p5-r1", "unknown")
    assert [str(d) for d in sorted(tables.holding(spark, root, "billing_records", ids))] == [
        "2023-02-13", "2023-05-15"]
    lookup = tables._index_entries(spark, root, "billing_records", ids)
    text = lookup._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in text or "PartitionFilters: [bucket" in text
    assert "fingerprint" not in text and "record_id" not in text
    tables.update_flags_by_identifier(root, ids)
    got = tables.scan(spark, root, "billing_records").where("anomaly_flag").select("record_id")
    assert {r.record_id for r in got.collect()} == {"p2-r3", "p5-r1"}


def test_a_table_without_index_gets_one(spark, root):
    tables.insert_if_absent(weeks(spark, 2), root, "billing_records")
    session.remove(spark, tables._index_path(root, "billing_records"))
    tables.insert_if_absent(weeks(spark, 3), root, "billing_records")
    assert len(tables.holding(spark, root, "billing_records", listed(spark, "p1_0", "p3_0"))) == 2
    tables.rebuild_index(spark, root, "billing_records")
    assert len(tables.holding(spark, root, "billing_records", listed(spark, "p1_0", "p3_0"))) == 2


def test_a_page_result_keeps_the_total(spark):
    from costlens.operators.paging import page_result
    df = spark.range(10).withColumnRenamed("id", "n")
    row = page_result(df, [F.col("n").desc()], 2, 4).first()
    assert [r.n for r in row["items"]] == [5, 4, 3, 2] and row.total == 10 and row.has_next
    behind = page_result(df, [F.col("n")], 9, 4).first()
    assert behind["items"] == [] and (behind.total, behind.page, behind.has_next) == (10, 9, False)
    assert page_result(df.where("n < 0"), [F.col("n")]).first().total == 0


def test_existence_is_asked_of_the_file_system(spark, root):
    assert not session.exists(spark, root) and session.names(spark, root) == []
    spark.range(1).write.parquet(f"{root}/a")
    assert session.exists(spark, f"{root}/a") and session.exists(spark, f"{root}/*")
    assert not session.exists(spark, f"{root}/b*")


def test_publishing_takes_a_name_once(spark, root):
    for name in ("x", "y"):
        spark.range(1).write.parquet(f"{root}/_{name}")
    assert session.publish(spark, f"{root}/_x", f"{root}/v=1")
    before = set(session.names(spark, f"{root}/v=1"))
    assert not session.publish(spark, f"{root}/_y", f"{root}/v=1")
    assert set(session.names(spark, f"{root}/v=1")) == before
    assert session.names(spark, root) == ["v=1"]


def test_csv_quotes_only_where_needed(spark, root):
    df = spark.createDataFrame([("plain", None), ('say "hi"', "a,b"), ("two\nlines", "x")],
                               "a string, b string")
    tables.write_csv(df.coalesce(1), root)
    text = "".join(r.value for r in spark.read.text(f"{root}/*.csv", wholetext=True).collect())
    assert text.startswith("a,b\nplain,\n")
    assert '"say ""hi""","a,b"' in text and '"two\nlines",x' in text


def test_resolving_twice_changes_once(spark):
    alerts = spark.createDataFrame([("1", False, None), ("2", True, "2023-01-01 00:00:00")],
                                   "alert_id string, is_resolved boolean, resolved_at string"
                                   ).withColumn("resolved_at", F.to_timestamp("resolved_at"))
    ids = alerts.select("alert_id", F.to_timestamp(F.lit("2023-05-01")).alias("resolved_at"))
    once = tables.resolve(alerts, ids)
    assert once.where("changed").count() == 1 and once.where("is_resolved").count() == 2
    assert tables.resolve(once.drop("changed"), ids).where("changed").isEmpty()


def test_groups_to_train(spark):
    groups = spark.createDataFrame([("a",), ("b",)], "g string")
    known = groups.where("g = 'a'")
    assert [r.g for r in tables.groups_to_train(groups, known, ["g"]).collect()] == ["b"]
    assert tables.groups_to_train(groups, known, ["g"], force=True).count() == 2
    assert tables.groups_to_train(groups, None, ["g"]).count() == 2


def test_unknown_page_size_is_refused(spark):
    from costlens.operators.paging import page
    df = spark.range(10)
    with pytest.raises(ValueError):
        page(df, [F.col("id")], 0, 5)
    got = page(df, [F.col("id")], 4, 3).collect()
    assert [r.id for r in got] == [9] and got[0].total == 10 and not got[0].has_next
