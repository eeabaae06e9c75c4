"""The derived views in SQL, for the comparison engine."""

from __future__ import annotations

from costlens.sources import testbed as tb


def _list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def _case(key: str, mapping: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


CLOUD_EV = "(['aws','azure','gcp'])[user_id % 3 + 1]"
ACCT_EV = "'acct-' || CAST(user_id % 5 AS VARCHAR)"
RATE = ("CASE upper({c}) WHEN 'USD' THEN 1.0::DOUBLE WHEN 'EUR' THEN 1.08::DOUBLE "
        "WHEN 'GBP' THEN 1.27::DOUBLE WHEN 'INR' THEN 0.012::DOUBLE WHEN 'AUD' THEN 0.65::DOUBLE "
        "WHEN 'CAD' THEN 0.74::DOUBLE WHEN 'JPY' THEN 0.0067::DOUBLE "
        "WHEN 'SGD' THEN 0.74::DOUBLE ELSE 1.0::DOUBLE END")
CATEGORY = ("CASE lower(trim(service)) WHEN 'amazon ec2' THEN 'compute' WHEN 'amazon s3' THEN "
            "'storage' WHEN 'amazon rds' THEN 'database' WHEN 'aws lambda' THEN 'compute' "
            "ELSE 'other' END")
REGION = ("CASE lower(trim(region)) WHEN 'us-east-1' THEN 'us-east' WHEN 'eastus' THEN 'us-east' "
          "WHEN 'europe-west1' THEN 'europe-west' WHEN 'ap-south-1' THEN 'asia-south' "
          "ELSE coalesce(nullif(region, ''), 'unknown') END")
FINGERPRINT = ("sha256(concat_ws('|', cloud_provider, account_id, service, usage_date, "
               "CAST(CAST(round(cost_usd, 6) AS DECIMAL(38,6)) AS VARCHAR)))")


def _tag(key: str) -> str:
    return f"CASE WHEN json_valid(tags) THEN json_extract_string(tags, '$.{key}') END"


ENV_RAW = "lower(coalesce(" + ", ".join(_tag(k) for k in ("environment", "env", "stage",
                                                          "tier")) + "))"
ENVIRONMENT = (f"CASE {ENV_RAW} WHEN 'production' THEN 'prod' WHEN 'prod' THEN 'prod' "
               f"WHEN 'staging' THEN 'staging' WHEN 'qa' THEN 'test' ELSE {ENV_RAW} END")
TEAM = "coalesce(" + ", ".join(f"nullif({_tag(k)}, '')" for k in (
    "team", "owner", "squad", "department", "cost_center", "project", "app")) + ")"
SEVERITY = ("CASE WHEN {s} >= 0.9 THEN 'critical' WHEN {s} >= 0.7 THEN 'high' "
            "WHEN {s} >= 0.5 THEN 'medium' WHEN {s} >= 0.3 THEN 'low' END")
CLOUD_ORD = _case("o_orderstatus", {"F": "aws", "O": "azure", "P": "gcp"})
ZSCORE = "least(1.0, greatest(0.0, (abs(coalesce({z}, 0.0)) - 1.5) / 3.5))"
DIMS = "cloud_provider, service_category, account_id, environment, team"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), "SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, "
               "CAST(ts AS DATE) AS day FROM events"),
    "raw": (("ev",), f"""
        SELECT *, round(cost_usd / exchange_rate, 6) AS original_cost FROM (
        SELECT CAST(event_id AS VARCHAR) AS record_id, {CLOUD_EV} AS cloud_provider,
          {ACCT_EV} AS account_id, {_case('event_type', tb.SERVICES)} AS service,
          ({_list(tb.REGIONS)})[k % 6 + 1] AS region,
          CASE WHEN k % 5 = 0 THEN '' ELSE 'res-' || CAST(user_id AS VARCHAR) END AS resource_id,
          CAST(day AS VARCHAR) AS usage_date,
          CAST(CASE WHEN k % 20 = 7 THEN -CAST(floor(value) AS BIGINT)
               ELSE CAST(floor(value) AS BIGINT) END AS DOUBLE) AS cost_usd,
          ({_list(tb.CURRENCIES)})[k % 9 + 1] AS original_currency,
          {RATE.format(c=f"({_list(tb.CURRENCIES)})[k % 9 + 1]")} AS exchange_rate,
          ({_list(tb.TAGS)})[k % 8 + 1] AS tags,
          strftime(ts + CASE WHEN k % 10 = 3 THEN INTERVAL 4 DAY ELSE INTERVAL 2 HOUR END,
                   '%Y-%m-%dT%H:%M:%SZ') AS ingested_at,
          k >= 92 AS is_anomaly,
          CASE WHEN k >= 92 THEN ({_list(tb.KINDS)})[k % 4 + 1] ELSE '' END AS anomaly_type,
          CASE WHEN k >= 92 THEN (['low','medium','high','critical'])[k % 4 + 1]
               ELSE '' END AS anomaly_severity,
          event_id % 200 = 199 AS is_duplicate, k % 10 = 3 AS is_backdated FROM ev)"""),
    "enriched": (("raw",), f"""
        SELECT *, {FINGERPRINT} AS fingerprint, {CATEGORY} AS service_category,
          {REGION} AS region_name, original_cost * {RATE.format(c='original_currency')} AS usd,
          {ENVIRONMENT} AS environment, {TEAM} AS team FROM raw"""),
    "norm": (("enriched",), """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint
          ORDER BY ingested_at, record_id) AS rn FROM enriched) WHERE rn = 1"""),
    "bill": ((), f"""
        SELECT CAST(o_orderkey AS VARCHAR) AS record_id,
          'fp-' || CAST(o_orderkey AS VARCHAR) AS fingerprint, {CLOUD_ORD} AS cloud_provider,
          'acct-' || CAST(o_custkey % 3 AS VARCHAR) AS account_id,
          o_orderpriority AS service_category,
          (['us-east','europe-west','asia-south','unknown'])[o_custkey % 4 + 1] AS region,
          CAST(o_orderdate AS DATE) AS usage_date, o_totalprice AS cost_usd,
          CASE o_custkey % 4 WHEN 0 THEN 'prod' WHEN 1 THEN 'staging' WHEN 2 THEN 'dev' END
            AS environment,
          CASE o_custkey % 3 WHEN 0 THEN 'platform' WHEN 1 THEN 'growth' END AS team,
          o_orderkey % 50 = 0 AS anomaly_flag,
          CASE WHEN o_orderkey % 50 = 0 THEN 'high' END AS anomaly_severity FROM orders"""),
    "lines": ((), f"""
        SELECT {CLOUD_ORD} AS cloud_provider, o_orderpriority AS service_category,
          r_name AS region, CAST(o_orderdate AS DATE) AS usage_date,
          l_extendedprice * (1 - l_discount) AS cost_usd
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey"""),
    "daily": (("bill",), """
        SELECT usage_date AS agg_date, cloud_provider, service_category, account_id,
          coalesce(environment, 'unknown') AS environment, coalesce(team, 'unknown') AS team,
          round(sum(cost_usd), 2) AS total_cost_usd, count(*) AS record_count,
          avg(cost_usd) AS avg_cost_usd FROM bill GROUP BY ALL"""),
    "feat0": (("daily",), f"""
        SELECT *, lag(total_cost_usd, 1) OVER w AS cost_lag_1d,
          lag(total_cost_usd, 7) OVER w AS cost_lag_7d,
          lag(total_cost_usd, 30) OVER w AS cost_lag_30d,
          avg(total_cost_usd) OVER (w ROWS 6 PRECEDING) AS rolling_mean_7d,
          stddev_samp(total_cost_usd) OVER (w ROWS 6 PRECEDING) AS rolling_std_7d,
          avg(total_cost_usd) OVER (w ROWS 29 PRECEDING) AS rolling_mean_30d,
          stddev_samp(total_cost_usd) OVER (w ROWS 29 PRECEDING) AS rolling_std_30d
        FROM daily WINDOW w AS (PARTITION BY {DIMS} ORDER BY agg_date)"""),
    "feat": (("feat0",), """
        SELECT *, agg_date AS feature_date,
          (total_cost_usd - cost_lag_1d) / nullif(cost_lag_1d, 0) AS pct_change_1d,
          (total_cost_usd - cost_lag_7d) / nullif(cost_lag_7d, 0) AS pct_change_7d,
          (total_cost_usd - cost_lag_30d) / nullif(cost_lag_30d, 0) AS pct_change_30d,
          CASE WHEN rolling_std_30d IS NULL THEN NULL WHEN rolling_std_30d < 1e-9 THEN 0.0
            ELSE (total_cost_usd - rolling_mean_30d) / rolling_std_30d END AS z_score_30d,
          CAST(isodow(agg_date) - 1 AS INTEGER) AS day_of_week,
          CAST(day(agg_date) AS INTEGER) AS day_of_month,
          CAST(weekofyear(agg_date) AS INTEGER) AS week_of_year,
          CAST(month(agg_date) AS INTEGER) AS month,
          isodow(agg_date) >= 6 AS is_weekend, day(agg_date) = 1 AS is_month_start,
          last_day(agg_date) = agg_date AS is_month_end FROM feat0"""),
    "scored": (("feat",), f"""
        SELECT *, {ZSCORE.format(z='z_score_30d')} AS ensemble_score FROM feat"""),
    "found": (("scored",), f"""
        SELECT *, {SEVERITY.format(s='ensemble_score')} AS severity,
          CASE WHEN rolling_mean_30d > 0 THEN rolling_mean_30d ELSE 0 END AS expected_cost
        FROM scored"""),
    "anom": (("ev",), f"""
        SELECT *, coalesce({SEVERITY.format(s='ensemble_score')}, 'low') AS severity FROM (
        SELECT 'an-' || CAST(event_id AS VARCHAR) AS anomaly_id,
          CAST(event_id AS VARCHAR) AS record_id,
          (['ensemble','zscore','isolation_forest'])[k % 3 + 1] AS detection_method,
          (k - 50) / 10.0::DOUBLE AS z_score, floor(value) AS expected_cost,
          floor(value) + floor(value) * CAST(k % 41 - 20 AS DOUBLE) / 100 AS actual_cost,
          CAST(k % 41 - 20 AS DOUBLE) AS deviation_pct, ts AS detected_at,
          {CLOUD_EV} AS cloud_provider, {_case('event_type', tb.CATEGORIES)} AS service,
          {ACCT_EV} AS account_id, day AS usage_date, k / 99.0::DOUBLE AS ensemble_score
        FROM ev)"""),
    "alert": (("ev",), f"""
        SELECT 'al-' || CAST(event_id AS VARCHAR) AS alert_id,
          (['anomaly_detected','spend_spike','budget_breach_imminent'])[k % 3 + 1] AS alert_type,
          (['low','medium','high','critical','info'])[k % 5 + 1] AS severity,
          {CLOUD_EV} AS cloud_provider,
          CASE WHEN k % 3 <> 2 THEN {_case('event_type', tb.CATEGORIES)} END AS service_category,
          {ACCT_EV} AS account_id, day AS alert_date, ts AS created_at, event_type AS title,
          props AS message, k % 3 = 0 AS is_resolved,
          CASE WHEN k % 3 = 0 THEN ts END AS resolved_at FROM ev"""),
    "fcst": ((), f"""
        SELECT *, predicted_cost * 0.5 AS lower_bound, predicted_cost * 1.5 AS upper_bound FROM (
        SELECT {CLOUD_ORD} AS cloud_provider, o_orderpriority AS service,
          ([7, 14, 30, 90])[o_custkey % 4 + 1] AS horizon_days,
          CAST(o_orderdate AS DATE) AS forecast_date,
          CASE WHEN o_custkey % 5 = 0 THEN 'seasonal' ELSE 'ensemble' END AS model_used,
          date_trunc('quarter', o_orderdate) AS generated_at,
          round(sum(o_totalprice), 2) AS predicted_cost FROM orders GROUP BY ALL)"""),
    "phi": (("feat",), """
        SELECT *, coalesce(cost_lag_1d, 0) * 0.5 AS c1, coalesce(cost_lag_7d, 0) * -0.25 AS c2,
          coalesce(cost_lag_30d, 0) * 0.125 AS c3, (day_of_week - 3) * 10000.0::DOUBLE AS c4,
          (month - 6) * 9000.0::DOUBLE AS c5 FROM feat"""),
    "contrib": (("phi",), f"""
        SELECT feature_date, {DIMS}, i, feature, v FROM (
          SELECT feature_date, {DIMS},
            unnest([0, 1, 2, 3, 4]) AS i,
            unnest(['cost_lag_1d','cost_lag_7d','cost_lag_30d','day_of_week','month']) AS feature,
            unnest([c1, c2, c3, c4, c5]) AS v FROM phi)"""),
    "rankd": (("contrib",), f"""
        SELECT *, row_number() OVER (PARTITION BY feature_date, {DIMS}
          ORDER BY abs(v) DESC, i) AS rk FROM contrib"""),
    "attr": (("rankd", "feat"), f"""
        SELECT f.feature_date AS attribution_date, f.cloud_provider, f.service_category,
          f.account_id, f.environment, f.team, f.total_cost_usd,
          a.feature AS top_driver_1, a.v AS top_driver_1_value,
          b.feature AS top_driver_2, b.v AS top_driver_2_value,
          c.feature AS top_driver_3, c.v AS top_driver_3_value
        FROM feat f
        JOIN rankd a USING (feature_date, {DIMS}) JOIN rankd b USING (feature_date, {DIMS})
        JOIN rankd c USING (feature_date, {DIMS})
        WHERE a.rk = 1 AND b.rk = 2 AND c.rk = 3"""),
    "fin": (("feat",), """
        SELECT feature_date AS usage_date, cloud_provider, service_category AS service,
          sum(total_cost_usd) AS cost_usd, avg(rolling_mean_7d) AS rolling_mean_7d,
          avg(rolling_mean_30d) AS rolling_mean_30d, avg(rolling_std_7d) AS rolling_std_7d,
          avg(rolling_std_30d) AS rolling_std_30d, avg(cost_lag_1d) AS lag_1d,
          avg(cost_lag_7d) AS lag_7d, avg(cost_lag_30d) AS lag_30d,
          avg(pct_change_7d) AS pct_change_7d, avg(day_of_week) AS day_of_week,
          max(CAST(is_weekend AS INTEGER)) AS is_weekend,
          max(CAST(is_month_end AS INTEGER)) AS is_month_end
        FROM feat GROUP BY ALL"""),
}


def sql(body: str, *views: str, **extra: str) -> str:
    """`body` under the CTEs it needs, in dependency order; `extra` adds its own."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in CTES[name][0]:
            add(dep)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order] + [f"{n} AS ({t})" for n, t in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
