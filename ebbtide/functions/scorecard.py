"""A rule scorecard: eight additive rules, then the logistic function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rule weights. Doubles throughout, so that no decimal arithmetic creeps in.
TENURE_WEIGHT = -0.025
TICKET_WEIGHT = 0.6
CONTRACT_WEIGHTS = {"Month-to-Month": 1.2, "One Year": -0.5}
OTHER_CONTRACT_WEIGHT = -1.0
DISENGAGED_PAYER_WEIGHT = 1.3   # engagement < 1 and price > 70
COMPLAINT_WEIGHT = 0.5
LATE_PAYMENT_WEIGHT = 0.4
HIGH_PRICE_WEIGHT = 0.4         # price > 85
INACTIVE_WEIGHT = 0.5           # engagement < 0.5


def _points(condition: Column, weight: float) -> Column:
    return F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))


def logit() -> Column:
    """The additive score of one snapshot row."""
    engagement, price = F.col("Engagement"), F.col("MonthlyCharges")
    contract = F.lit(OTHER_CONTRACT_WEIGHT)
    for name, weight in CONTRACT_WEIGHTS.items():
        contract = F.when(F.col("ContractType") == name, F.lit(weight)).otherwise(contract)
    return (
        F.lit(TENURE_WEIGHT) * F.col("Tenure")
        + F.lit(TICKET_WEIGHT) * F.col("RecentSupportTickets")
        + contract
        + _points((engagement < 1) & (price > 70), DISENGAGED_PAYER_WEIGHT)
        + F.lit(COMPLAINT_WEIGHT) * F.col("Complaints")
        + F.lit(LATE_PAYMENT_WEIGHT) * F.col("LatePayments")
        + _points(price > 85, HIGH_PRICE_WEIGHT)
        + _points(engagement < 0.5, INACTIVE_WEIGHT)
    )


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def probability() -> Column:
    return F.least(F.greatest(sigmoid(logit()), F.lit(0.0)), F.lit(1.0))
