import re
from datetime import date
from multiprocessing.pool import ThreadPool

import pytest
from pyspark.sql import functions as F

from costlens import session
from costlens.operators import rollup, tables
from costlens.plans import ingest
from costlens.plans.normalise import normalise
from costlens.schemas import DAILY
from costlens.sources import billing as src, exports
from costlens.streaming import billing as st
from tests.data import daily, raw


@pytest.fixture
def landing(spark, root):
    rows = raw(spark, {"usage_date": "2023-01-01"}, {"usage_date": "2023-01-05", "region": ""},
               {"usage_date": "2023-01-09", "cloud_provider": "gcp", "account_id": "a2"})
    for cloud in ("aws", "gcp"):
        rows.where(F.col("cloud_provider") == cloud).write.parquet(f"{root}/{cloud}")
    return root


def test_scan_filters(spark, landing):
    def n(**kw):
        return src.read_billing(spark, landing, **kw).count()
    assert (n(), n(cloud="aws"), n(cloud="azure"), n(limit=2)) == (3, 2, 0, 2)
    assert (n(start="2023-01-05"), n(start="2023-01-05", end="2023-01-05")) == (2, 1)
    assert n(start="2023-01-09", end="2023-01-01") == 0
    assert src.read_billing(spark, landing, start="2023-01-05", cloud="aws").first().region is None


def test_combined_file_is_preferred(spark, landing):
    raw(spark, {}).write.parquet(f"{landing}/combined")
    assert src.read_billing(spark, landing).count() == 1


def test_source_plugin(spark, landing):
    source = src.ParquetSource(landing)
    assert source.ready(spark) and not src.ParquetSource(f"{landing}/none").ready(spark)
    assert source.read(spark, account="a2").count() == 1
    assert tuple(source.available_range(spark).first()) == ("2023-01-01", "2023-01-09")


def test_fetch_windows(spark):
    rows = src.fetch_windows(spark, "2023-01-01", "2023-03-10").orderBy("window_no").collect()
    assert [(r.window_start, r.window_end) for r in rows] == [
        (date(2023, 1, 1), date(2023, 1, 31)), (date(2023, 2, 1), date(2023, 3, 3)),
        (date(2023, 3, 4), date(2023, 3, 10))]
    assert src.fetch_windows(spark, "2023-02-01", "2023-01-01").isEmpty()


def test_missing_exports_are_empty_and_not_ready(spark):
    for cloud in ("aws", "azure", "gcp"):
        for location in (None, "/nowhere/at/all"):
            source = exports.ExportSource(cloud, location)
            assert not source.ready(spark) and source.read(spark).isEmpty()


class Given:
    cloud_provider = "aws"

    def __init__(self, rows):
        self.rows = rows

    def ready(self, spark):
        return True

    def read(self, spark, start=None, end=None):
        return self.rows


def test_high_water_mark(spark, root):
    rows = raw(spark, {"usage_date": "2023-05-19"}, {"usage_date": "2023-05-20"},
               {"usage_date": "2023-05-21"})
    first = ingest.run_incremental(spark, Given(rows), root, "2023-05-21").first()
    assert first.records == 2
    state = ingest.read_state(spark, root).first()
    assert state.last_ingested_date == date(2023, 5, 20) and state.total_records == 2
    starts = {r.cloud_provider: str(r.next_start) for r in
              ingest.next_starts(ingest.read_state(spark, root)).collect()}
    assert starts == {"aws": "2023-05-21", "azure": "2023-01-01", "gcp": "2023-01-01"}
    assert ingest.run_incremental(spark, Given(rows), root, "2023-05-22", dry_run=True).count() == 1
    assert tables.scan(spark, root, "billing_records").count() == 2
    assert ingest.run_incremental(spark, Given(rows), root, "2023-05-21").isEmpty()


def test_reset(spark):
    state = spark.createDataFrame([("aws", date(2023, 1, 1), 1), ("gcp", date(2023, 1, 1), 2)],
                                  ingest.STATE_COLUMNS)
    assert [r.cloud_provider for r in ingest.reset(state, "aws").collect()] == ["gcp"]
    assert ingest.reset(state).isEmpty()


def test_a_replayed_stream_stores_nothing_twice(spark, root):
    rows = raw(spark, {}, {"cost_usd": 3.0}, {"cost_usd": 3.0})
    rows.write.parquet(f"{root}/in")
    for attempt in ("one", "two"):
        st.ingest(st.read_raw(spark, f"{root}/in"), f"{root}/out",
                  f"{root}/{attempt}").awaitTermination()
    assert tables.scan(spark, f"{root}/out", "billing_records").count() == 2


def test_a_late_row_updates_its_day(spark, root):
    raw(spark, {"usage_date": "2023-01-08"}, {"usage_date": "2023-01-03"}).write.parquet(
        f"{root}/in")
    st.rollup(st.read_raw(spark, f"{root}/in"), f"{root}/out", f"{root}/c").awaitTermination()
    raw(spark, {"usage_date": "2023-01-03", "cost_usd": 5.0, "original_cost": 5.0}).write.mode(
        "append").parquet(f"{root}/in")
    st.rollup(st.read_raw(spark, f"{root}/in"), f"{root}/out", f"{root}/c").awaitTermination()
    got = {str(r.agg_date): r.total_cost_usd for r in
           tables.scan(spark, f"{root}/out", "daily_aggregates").collect()}
    assert got == {"2023-01-03": 15.0, "2023-01-08": 10.0}


def test_export_ranges_reach_the_raw_column(spark, root):
    rows = spark.createDataFrame(
        [("i", "2023-05-01 23:59:59"), ("j", "2023-05-02 00:00:00"), ("k", "2023-05-03 23:00:00"),
         ("l", "2023-05-04 00:00:00")], "id string, at string")
    rows.select(
        F.col("id").alias("identity_line_item_id"), F.lit("a").alias("line_item_usage_account_id"),
        F.lit("EC2").alias("product_servicename"), F.lit("r").alias("product_region"),
        F.lit("x").alias("line_item_resource_id"), F.lit(1.0).alias("line_item_unblended_cost"),
        F.lit("USD").alias("line_item_currency_code"),
        F.col("at").cast("timestamp").alias("line_item_usage_start_date"),
        F.col("at").alias("bill_billing_period_end_date")).write.parquet(root)
    got = exports.ExportSource("aws", root).read(spark, "2023-05-02", "2023-05-03")
    assert {r.record_id for r in got.collect()} == {"j", "k"}
    for span, want in (({"start": "2023-05-02"}, "GreaterThanOrEqual"), ({"end": "2023-05-03"}, "LessThan")):
        rows = exports.ExportSource("aws", root).read(spark, **span)
        text = rows._jdf.queryExecution().executedPlan().toString()
        assert f"{want}(line_item_usage_start_date" in text[text.index("PushedFilters"):]


def test_text_days_of_any_form_are_in_range(spark):
    df = spark.createDataFrame([("2023-5-2",), ("2023-05-02",), ("2023-05-09",)], "Date string")
    assert exports.in_range(df, "Date", "2023-05-01", "2023-05-03").count() == 3


def test_undated_rows_end_as_rejects_once(spark, root):
    rows = raw(spark, {"usage_date": "2023-05-19", "ingested_at": "2023-05-19T01:00:00Z"},
               {"usage_date": "soon", "ingested_at": "2023-05-19T02:00:00Z"},
               {"usage_date": None, "ingested_at": "unknown"},
               {"usage_date": "later", "ingested_at": "2023-05-25T02:00:00Z"})
    for as_of, stored, rejected in (("2023-05-20", 1, 2), ("2023-05-20", 1, 2), ("2023-06-01", 1, 3)):
        ingest.run_incremental(spark, Given(rows), root, as_of)
        assert tables.scan(spark, root, "billing_records").count() == stored
        assert tables.scan(spark, root, "rejects").count() == rejected
    assert ingest.read_state(spark, root).first().total_records == 1


def test_overlapping_writers_lose_no_state(spark, root):
    def add(cloud):
        def change(state):
            got = spark.createDataFrame([(cloud, date(2023, 1, 1), 1)],
                                        "cloud_provider string, last_date date, records bigint")
            return ingest.state_after(state, got)
        ingest.update_state(spark, root, change)
    with ThreadPool(4) as pool:
        pool.map(add, ["aws", "azure", "gcp", "aws", "azure", "gcp"])
    got = {r.cloud_provider: r.total_records for r in ingest.read_state(spark, root).collect()}
    assert got == {"aws": 2, "azure": 2, "gcp": 2}
    assert {r.cloud_provider for r in ingest.reset_stored(spark, root, "aws").collect()} == {
        "azure", "gcp"}
    assert ingest.reset_stored(spark, root).isEmpty()


def test_a_batch_reads_the_partitions_it_has_rows_for(spark, root):
    days = raw(spark, *[{"usage_date": f"2023-0{m}-08"} for m in range(1, 10)])
    ingest.load(days, root, "2023-01-01", "2023-12-31")
    new = session.materialize(rollup.daily_rollup(normalise(raw(
        spark, {"usage_date": "2023-02-20"}, {"usage_date": "2023-09-20"}))), "t")
    both = tables.touched_with(new, root, "daily_aggregates")
    assert sorted(str(r.agg_date) for r in both.collect()) == [
        "2023-02-08", "2023-02-20", "2023-09-08", "2023-09-20"]
    text = both._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[part_date#\d+ IN \(2023-0[29]-01,2023-0[29]-01\)\]", text)


def test_a_repeated_batch_is_added_once(spark, root, monkeypatch):
    rows = raw(spark, {}, {"cost_usd": 3.0, "original_cost": 3.0})
    rows.write.parquet(f"{root}/in")
    real, calls = tables.replace_partitions, []

    def fails_first(*args):
        calls.append(args)
        if len(calls) == 1:
            real(*args)
            raise OSError("lost after the write")
        real(*args)

    monkeypatch.setattr(st.tables, "replace_partitions", fails_first)
    stream = lambda: st.rollup(st.read_raw(spark, f"{root}/in"), f"{root}/out", f"{root}/c")
    with pytest.raises(Exception, match="lost after"):
        stream().awaitTermination()
    stream().awaitTermination()
    got = tables.scan(spark, f"{root}/out", "daily_aggregates").collect()
    assert [(r.total_cost_usd, r.record_count, r.avg_cost_usd) for r in got] == [(13.0, 2, 6.5)]
    assert len(calls) == 2 and tables.scan(spark, f"{root}/out", "billing_records").count() == 2


def spikes(spark, root, costs, name, **options):
    for i, (start, part) in enumerate(costs):
        daily(spark, part, start=date.fromisoformat(start)).coalesce(1).write.mode("append").parquet(
            f"{root}/days")
        st.spike_alerts(spark.readStream.schema(DAILY).parquet(f"{root}/days"), f"{root}/{name}",
                        f"{root}/{name}-c", F.to_timestamp(F.lit("2024-01-01")), 50.0,
                        **options).awaitTermination()
    got = tables.scan(spark, f"{root}/{name}", "alerts").collect()
    return sorted(str(r.alert_date) for r in got)


def test_days_streamed_apart_are_compared(spark, root):
    files = [("2023-01-01", [100.0, 100.0]), ("2023-01-03", [200.0]), ("2023-01-04", [210.0, 90.0])]
    assert spikes(spark, root, files, "a") == ["2023-01-03", "2023-01-05"]


def test_a_late_day_and_a_gap_in_the_stream(spark, root):
    files = [("2023-01-01", [100.0]), ("2023-01-03", [300.0]), ("2023-01-02", [190.0]),
             ("2023-01-09", [900.0])]
    assert spikes(spark, root, files, "a", days_apart=1) == ["2023-01-02", "2023-01-03"]


def test_a_baseline_starts_the_series(spark, root):
    past = daily(spark, [100.0], start=date(2022, 12, 31))
    assert spikes(spark, root, [("2023-01-01", [300.0])], "a", baseline=past) == ["2023-01-01"]


def test_quality_checks_find_planted_faults(spark):
    from costlens.operators import quality as dq
    from costlens.schemas import RAW_BILLING
    rows = raw(spark, {"usage_date": "2023-02-01"}, {"cost_usd": float("nan")},
               {"original_cost": 99.0}, {"is_backdated": True}, {"cost_usd": -1.0,
                                                                 "original_cost": -1.0},
               {"is_anomaly": True}, {"cloud_provider": "ibm"}, {"account_id": None},
               {"is_duplicate": True, "original_cost": 77.0, "cost_usd": 77.0})
    got = {r.check: r.failed_rows for r in
           dq.row_report(rows, dq.row_checks(rows, RAW_BILLING)).collect()}
    assert got["usage_before_ingest"] == 1 and got["cost_usable"] == 1
    assert got["currency_consistent"] >= 1 and got["backdated_lag"] == 1
    assert got["credit_tagged"] == 1 and got["anomaly_typed"] == 1
    assert got["known_provider"] == 1 and got["schema"] == 1
    assert dq.duplicates_without_twin(rows).first().failed_rows == 1
