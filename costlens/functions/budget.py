"""Budget usage and breach classes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from costlens import constants as C


def budget_pct(projected: Column, budget: Column) -> Column:
    return F.when(budget > 0, projected / budget * 100)


def budget_severity(projected: Column, budget: Column) -> Column:
    pct = budget_pct(projected, budget)
    return (F.when(pct >= C.BUDGET_BREACH_PCT, "critical")
            .when(pct >= C.BUDGET_WARNING_PCT, "high"))


def breach_risk(lower: Column, predicted: Column, upper: Column, budget: Column) -> Column:
    """Tests run in this order; the first that holds names the class."""
    return (F.when(upper < budget, "none")
            .when((lower < budget) & (budget <= predicted), "possible")
            .when((predicted < budget) & (budget <= upper), "likely")
            .otherwise("certain"))


def days_to(breach_date: Column, as_of: Column) -> Column:
    return F.datediff(breach_date, as_of)
