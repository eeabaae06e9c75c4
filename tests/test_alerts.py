from datetime import date

import pytest
from pyspark.sql import functions as F

from costlens.functions import budget as bud
from costlens.operators import forecasts as fq, reports, tables
from costlens.plans import alerts as al


def now():
    return F.to_timestamp(F.lit("2024-01-02"))


def anomaly(spark, **over):
    base = {"anomaly_id": "x", "record_id": "r", "detection_method": "ensemble",
            "severity": "critical", "z_score": 4.0, "expected_cost": 100.0, "actual_cost": 250.0,
            "deviation_pct": 150.0, "cloud_provider": "aws", "service": "compute",
            "account_id": "a1", "usage_date": date(2024, 1, 1), "ensemble_score": 0.95,
            "detected_at": None} | over
    ddl = ("anomaly_id string, record_id string, detection_method string, severity string, "
           "z_score double, expected_cost double, actual_cost double, deviation_pct double, "
           "cloud_provider string, service string, account_id string, usage_date date, "
           "ensemble_score double, detected_at timestamp")
    return spark.createDataFrame([tuple(base.values())], ddl)


def test_anomaly_alert_text(spark):
    row = al.from_anomalies(anomaly(spark), now()).first()
    assert row.title == "Anomaly: compute spend spike on 2024-01-01"
    assert row.message == "Detected 150.0% above expected cost ($250.00 vs $100.00)"
    assert row.severity == "critical" and '"anomaly_direction":"spike"' in row.metadata
    drop = al.from_anomalies(anomaly(spark, deviation_pct=-20.0), now()).first()
    assert "spend drop" in drop.title and "20.0% below" in drop.message


def feature(spark, pct):
    return spark.createDataFrame(
        [("aws", "compute", "a1", date(2024, 1, 1), pct, 10.0, 5.0)],
        "cloud_provider string, service_category string, account_id string, feature_date date, "
        "pct_change_1d double, total_cost_usd double, rolling_mean_7d double")


@pytest.mark.parametrize("pct, want", [(1.2, "high"), (0.6, "medium"), (0.1, None),
                                       (-1.5, "high"), (0.5, None), (None, None)])
def test_spike_bands(spark, pct, want):
    got = al.from_spikes(feature(spark, pct), now()).collect()
    assert [r.severity for r in got] == ([want] if want else [])


def test_spike_title_and_percent_unit(spark):
    assert al.from_spikes(feature(spark, 1.2), now()).first().title == \
        "aws compute spend up 120% day-over-day"
    assert al.from_spikes(feature(spark, 1.2), now(), pct_unit="percent").isEmpty()


@pytest.mark.parametrize("projected, want", [(95000.0, "high"), (105000.0, "critical"),
                                             (50000.0, None), (85000.0, "high")])
def test_budget_bands(spark, projected, want):
    rows = spark.createDataFrame([("aws", projected)], "cloud_provider string, "
                                                       "projected_cost double")
    got = al.from_budget(rows, 100000.0, F.to_date(F.lit("2024-01-01")), now()).collect()
    assert [r.severity for r in got] == ([want] if want else [])
    if want == "critical":
        assert got[0].title == "aws budget breach projected by end of month"
    if projected == 95000.0:
        assert got[0].title == "aws budget at 95% - breach risk"


def test_second_run_inserts_nothing(spark, root):
    rows = anomaly(spark).unionByName(anomaly(spark, anomaly_id="y", severity="low",
                                              account_id="a2"))
    tables.merge(rows.withColumn("detected_at", now()), root, "anomalies")
    span = ("2024-01-01", "2024-01-31", "2024-01-31", now())
    first = al.run(spark, root, *span).first()
    assert (first.anomaly_alerts, first.total_inserted, first.total_skipped) == (2, 1, 1)
    assert tables.scan(spark, root, "alerts").first().severity == "critical"
    assert al.run(spark, root, *span).first().total_inserted == 0


def test_breach_classes(spark):
    def risk(lo, p, hi):
        return spark.range(1).select(bud.breach_risk(*map(F.lit, (lo, p, hi)),
                                                     F.lit(100.0))).first()[0]
    assert [risk(10.0, 20.0, 30.0), risk(10.0, 120.0, 130.0), risk(10.0, 90.0, 110.0),
            risk(101.0, 102.0, 103.0)] == ["none", "possible", "likely", "certain"]


def test_budget_risk_without_forecasts(spark):
    empty = spark.createDataFrame([], "cloud_provider string, service string, horizon_days int, "
                                      "forecast_date date, generated_at timestamp, "
                                      "predicted_cost double, lower_bound double, "
                                      "upper_bound double")
    row = fq.budget_risk(empty, "2024-01-01").first()
    assert (row.breach_risk, row.projected_monthly_cost, row.confidence_pct) == ("none", 0.0, 0.0)
    assert row.message == "No forecast data available" and row.breach_date is None


def test_unresolved_counts_are_zero_filled(spark):
    alerts = spark.createDataFrame([("high", False), ("high", True), ("odd", False)],
                                   "severity string, is_resolved boolean")
    got = {r.severity: r.unresolved for r in reports.unresolved_by_severity(alerts).collect()}
    assert got == {"low": 0, "medium": 0, "high": 1, "critical": 0}
