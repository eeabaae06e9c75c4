"""Alert titles, messages, metadata and plain-language driver lists."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from costlens import constants as C
from costlens.functions.mapping import literal_map


def direction(deviation: Column) -> Column:
    return F.when(deviation < 0, "drop").otherwise("spike")


def anomaly_title(service: Column, deviation: Column, day: Column) -> Column:
    return F.format_string("Anomaly: %s spend %s on %s", service, direction(deviation),
                           day.cast("string"))


def anomaly_message(deviation: Column, actual: Column, expected: Column) -> Column:
    side = F.when(deviation < 0, "below").otherwise("above")
    return F.format_string("Detected %.1f%% %s expected cost ($%.2f vs $%.2f)",
                           F.abs(deviation), side, actual, expected)


def spike_severity(pct: Column) -> Column:
    return F.when(F.abs(pct) > C.SPEND_SPIKE_HIGH_PCT, "high").otherwise("medium")


def spike_title(cloud: Column, service: Column, pct: Column) -> Column:
    return F.format_string("%s %s spend up %.0f%% day-over-day", cloud, service, pct)


def budget_title(cloud: Column, pct: Column, breach_date: Column) -> Column:
    return (F.when(pct >= C.BUDGET_BREACH_PCT,
                   F.concat(cloud, F.lit(" budget breach projected by "),
                            F.coalesce(breach_date.cast("string"), F.lit("end of month"))))
            .when(pct >= C.BUDGET_WARNING_PCT,
                  F.format_string("%s budget at %.0f%% - breach risk", cloud, pct)))


def json_object(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]),
                     {"ignoreNullFields": "false"})


def feature_description(name: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(C.FEATURE_DESCRIPTIONS), name),
                      F.replace(name, F.lit("_"), F.lit(" ")))


def driver_list(names: list[Column], values: list[Column]) -> Column:
    """`n. name: +0.00 (description)` joined by newlines; absent drivers are left out."""
    lines = [F.when(n.isNotNull(), F.format_string(f"{i}. %s: %+.2f (%s)", n, v,
                                                   feature_description(n)))
             for i, (n, v) in enumerate(zip(names, values), 1)]
    return F.concat_ws("\n", *lines)
