from pyspark.sql import functions as F
import pytest

from costlens.functions import identity, mapping, sqlfuncs, tags as tg
from costlens.plans import normalise as nm
from tests.data import raw


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize("text, env, team, size", [
    ('{"environment": "production", "team": "data-engineering"}', "prod", "data-engineering", 2),
    ('{"env": "staging", "owner": "platform"}', "staging", "platform", 2),
    ('{"environment": "canary"}', "canary", None, 1),
    ('{"region": "us-east-1", "cost_center": "1234"}', None, "1234", 2),
    ('{"broken json', None, None, 0),
    ('["a"]', None, None, 0),
    ('{"team": "", "squad": "growth"}', None, "growth", 2),
    ('{"environment": "QA", "env": "prod"}', "test", None, 2),
])
def test_tags(spark, text, env, team, size):
    tags = tg.parse_tags(F.lit(text))
    row = spark.range(1).select(tg.environment(tags), tg.team(tags), F.size(tags)).first()
    assert tuple(row) == (env, team, size)


@pytest.mark.parametrize("raw_name, want", [
    ("Amazon EC2", "compute"), ("  BIGQUERY ", "database"), ("nope", "other"), ("", "other"),
    (None, "other"), ("Azure Key Vault", "security"), ("Tax", "tax")])
def test_service(spark, raw_name, want):
    assert one(spark, mapping.service_category(F.lit(raw_name).cast("string"))) == want


@pytest.mark.parametrize("raw_name, want", [
    ("us-east-1", "us-east"), ("EastUS", "us-east"), ("mars-1", "mars-1"), ("", "unknown"),
    (None, "unknown"), ("australiaeast", "asia-pacific"), ("global", "global")])
def test_region(spark, raw_name, want):
    assert one(spark, mapping.canonical_region(F.lit(raw_name).cast("string"))) == want


def test_join_and_expression_lookups_agree(spark):
    names = ["Amazon S3", "x", "", None, " AKS"]
    df = spark.createDataFrame([(n, n) for n in names], "service string, region string")
    joined = mapping.with_canonical_region(mapping.with_service_category(df).withColumns({
        "a": mapping.service_category(F.col("service")),
        "b": mapping.canonical_region(F.col("region"))}))
    assert joined.count() == len(names)
    assert joined.where("service_category <> a OR region <> b").isEmpty()


def test_fx(spark):
    def rate(c):
        return one(spark, mapping.fx_rate(F.lit(c).cast("string")))
    assert (rate("eur"), rate("CNY"), rate(None), rate("")) == (1.08, 1.0, 1.0, 1.0)
    assert one(spark, mapping.to_usd(F.lit(100.0), F.lit("GBP"))) == 127.0
    assert one(spark, mapping.fx_missing(F.lit("CNY"))) and not one(
        spark, mapping.fx_missing(F.lit("usd")))


def test_duplicates_are_removed_and_counted(spark):
    rows = raw(spark, {}, {}, {"cost_usd": 11.0}, {"cost_usd": 12.0}, {"tags": '{"broken": '})
    out = nm.run(rows)
    assert out.records.count() == 3
    m = out.metrics.first()
    assert (m.input_count, m.output_count, m.duplicate_count, m.error_count) == (5, 3, 2, 0)
    kept = out.records.where("cost_usd = 10").first()
    assert kept.record_id == "r1" and kept.tags == {} and kept.environment is None


def test_extra_keys_keep_distinct_lines(spark):
    rows = raw(spark, {"region": "eastus"}, {"region": "westus"})
    assert nm.normalise(rows).count() == 1
    assert nm.normalise(rows, extra_keys=("region",)).count() == 2


def test_bad_rows_are_rejected_and_others_continue(spark):
    rows = raw(spark, {}, {"usage_date": "not a date"}, {"cloud_provider": "oracle"},
               {"cost_usd": None})
    out = nm.run(rows)
    assert out.records.count() == 1
    got = {r.record_id: r.reject_reason for r in out.rejects.collect()}
    assert got == {"r2": "missing usage_date", "r3": "unknown provider", "r4": "missing cost_usd"}
    assert out.metrics.first().error_count == 3


def test_cost_is_converted_from_the_original_amount(spark):
    rows = raw(spark, {"original_cost": 100.0, "original_currency": "EUR", "cost_usd": 108.0})
    assert nm.normalise(rows).first().cost_usd == pytest.approx(108.0)
    assert nm.normalise(rows, parity=True).first().cost_usd == pytest.approx(108.0 * 1.08)


def test_fingerprint_ignores_float_noise_and_small_costs_have_no_exponent(spark):
    def fp(cost):
        return one(spark, identity.fingerprint(F.lit("aws"), F.lit("a"), F.lit("s"),
                                               F.lit("2023-01-01"), F.lit(cost)))
    assert fp(0.1 + 0.2) == fp(0.3) and fp(1e-5) != fp(2e-5) and len(fp(1.0)) == 64


def test_sql_functions_are_registered(spark):
    names = sqlfuncs.register(spark)
    assert len(names) == 12
    row = spark.sql("SELECT cl_service_category('aks') a, cl_severity(0.95) b, "
                    "cl_environment(cl_tags('{\"stage\": \"stg\"}')) c, "
                    "cl_ensemble(0.8, 0.6, NULL) d, cl_breach_risk(1, 2, 3, 2.5) e").first()
    assert tuple(row)[:3] == ("compute", "critical", "staging") and row.e == "likely"
    assert row.d == pytest.approx(0.8 * 0.45 + 0.6 * 0.55)
