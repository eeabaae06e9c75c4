"""The scalar functions under SQL names.

They are SQL functions, not Python ones: Catalyst inlines the body, so a query
that calls them stays in one generated stage.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from costlens import constants as C


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _map(mapping: dict) -> str:
    def lit(v):
        return _text(v) if isinstance(v, str) else f"{v}D"
    return "map(" + ", ".join(f"{lit(k)}, {lit(v)}" for k, v in mapping.items()) + ")"


def _ladder(cases: list[tuple[str, str]], default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {_text(v)}" for c, v in cases) + f" ELSE {default} END"


def _functions() -> dict[str, str]:
    tag = "try_element_at(t, '{}')"
    env = "CASE " + " ".join(f"WHEN map_contains_key(t, '{k}') THEN lower({tag.format(k)})"
                             for k in C.ENVIRONMENT_KEYS) + " END"
    teams = ", ".join(f"nullif({tag.format(k)}, '')" for k in C.TEAM_KEYS)
    w = C.ENSEMBLE_WEIGHTS
    weight = " + ".join(f"if({a} IS NULL, 0D, {w[k]}D)"
                        for a, k in (("z", "zscore"), ("f", "iforest"), ("s", "sequence")))
    value = " + ".join(f"coalesce({a} * {w[k]}D, 0D)"
                       for a, k in (("z", "zscore"), ("f", "iforest"), ("s", "sequence")))
    th = C.SEVERITY_THRESHOLDS
    return {
        "cl_service_category(x STRING) RETURNS STRING":
            f"coalesce(try_element_at({_map(C.SERVICE_CATEGORY)}, lower(trim(x))), 'other')",
        "cl_region(x STRING) RETURNS STRING":
            f"coalesce(try_element_at({_map(C.REGION_CANONICAL)}, lower(trim(x))), "
            "nullif(x, ''), 'unknown')",
        "cl_fx_rate(x STRING) RETURNS DOUBLE":
            f"coalesce(try_element_at({_map(C.FX_RATES)}, upper(x)), 1D)",
        "cl_to_usd(amount DOUBLE, x STRING) RETURNS DOUBLE":
            "amount * cl_fx_rate(x)",
        "cl_tags(x STRING) RETURNS MAP<STRING, STRING>":
            "coalesce(from_json(x, 'map<string,string>'), from_json('{}', 'map<string,string>'))",
        "cl_environment(t MAP<STRING, STRING>) RETURNS STRING":
            f"coalesce(try_element_at({_map(C.ENVIRONMENT_ALIASES)}, {env}), {env})",
        "cl_team(t MAP<STRING, STRING>) RETURNS STRING":
            f"coalesce({teams})",
        "cl_zscore_score(z DOUBLE) RETURNS DOUBLE":
            "least(1D, greatest(0D, (abs(coalesce(nanvl(z, 0D), 0D)) - 1.5D) / 3.5D))",
        "cl_ensemble(z DOUBLE, f DOUBLE, s DOUBLE) RETURNS DOUBLE":
            f"coalesce(try_divide({value}, {weight}), 0D)",
        "cl_severity(x DOUBLE) RETURNS STRING":
            _ladder([(f"x >= {th[s]}D", s) for s in reversed(C.SEVERITY_LEVELS)]),
        "cl_budget_severity(projected DOUBLE, budget DOUBLE) RETURNS STRING":
            f"CASE WHEN budget <= 0 THEN NULL "
            f"WHEN projected / budget * 100 >= {C.BUDGET_BREACH_PCT}D THEN 'critical' "
            f"WHEN projected / budget * 100 >= {C.BUDGET_WARNING_PCT}D THEN 'high' END",
        "cl_breach_risk(lo DOUBLE, p DOUBLE, hi DOUBLE, budget DOUBLE) RETURNS STRING":
            _ladder([("hi < budget", "none"), ("lo < budget AND budget <= p", "possible"),
                     ("p < budget AND budget <= hi", "likely")], "'certain'"),
    }


def register(spark: SparkSession) -> list[str]:
    for signature, body in _functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [s.split("(")[0] for s in _functions()]
