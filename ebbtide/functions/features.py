"""Feature expressions. Each returns a Column, so a whole feature table is one projection."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tenure bucket edges and names.
TENURE_EDGES = [0, 6, 12, 24, 60, 100]
TENURE_LABELS = ["New", "Growing", "Established", "Loyal", "Veteran"]


def flag(*conditions: Column) -> Column:
    """1 when every condition holds, else 0. An unknown condition counts as not holding."""
    return F.when(F.coalesce(reduce(and_, conditions), F.lit(False)), 1).otherwise(0)


def tenure_bucket(tenure: Column, edges=None, labels=None) -> Column:
    """Right-closed intervals with the lowest edge included; outside them NULL."""
    edges, labels = edges or TENURE_EDGES, labels or TENURE_LABELS
    if len(edges) != len(labels) + 1:
        raise ValueError("need one more edge than labels")
    bucket = F.when((tenure >= edges[0]) & (tenure <= edges[1]), labels[0])
    for low, high, label in zip(edges[1:], edges[2:], labels[1:]):
        bucket = bucket.when((tenure > low) & (tenure <= high), label)
    return bucket


def price_per_service(monthly: Column, internet: Column) -> Column:
    """Monthly price over one more than the number of services. An unknown service counts as one."""
    services = F.when(internet.eqNullSafe("No Service"), 1).otherwise(2)
    return monthly / (services + 1)


def high_risk(tenure: Column, monthly: Column, tickets: Column, median: float) -> Column:
    """Short tenure, price above the training median, exactly one recent ticket."""
    return flag(tenure < 12, monthly > F.lit(median), tickets == 1)


def contract_tenure_mismatch(contract: Column, tenure: Column) -> Column:
    return flag(contract == "Month-to-Month", tenure > 24)


def financial_stress(late: Column, complaints: Column) -> Column:
    return late + complaints * F.lit(0.5)


def one_hot(column: Column, name: str, categories, drop_first: bool = True) -> dict[str, Column]:
    """Dummies in sorted category order. The first sorted category is the baseline."""
    kept = sorted(categories)[1 if drop_first else 0:]
    return {f"{name}_{c}": F.when(column.eqNullSafe(c), 1).otherwise(0) for c in kept}


def total_charges(monthly: Column, tenure: Column) -> Column:
    """Price times months, at least one month, to the cent."""
    return F.round(monthly * F.greatest(F.lit(1), tenure), 2)


def engagement(minutes: Column, gigabytes: Column) -> Column:
    return F.round(clip(minutes, 0) / F.lit(1000.0) + clip(gigabytes, 0) / F.lit(10.0), 2)


def clip(value: Column, low=None, high=None) -> Column:
    """Bound a value; NULL stays NULL (``greatest`` alone would skip it)."""
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, F.lit(float(low)))
    if high is not None:
        bounded = F.least(bounded, F.lit(float(high)))
    return F.when(value.isNotNull(), bounded)


def interactions() -> dict[str, Column]:
    """Product and flag features proposed by the exploration notes."""
    return {
        "MonthlyContractTenure": flag(F.col("ContractType") == "Month-to-Month") * F.col("Tenure"),
        "SupportIntensity": F.col("RecentSupportTickets") * F.col("Complaints"),
        "EngagementDrop": flag(F.col("Engagement") < 1, F.col("MonthlyCharges") > 70),
        "TenureCharges": F.col("Tenure") * F.col("MonthlyCharges"),
    }
