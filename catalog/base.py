"""Shared by all areas: registration, rounding, and the common table expressions of the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query ``(spark, folder) -> DataFrame`` and the SQL that gives the same rows."""

    def add(function):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so that the order of summation does not show."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in doubles})


# The customer snapshot, one row per customer.
SNAP = """
per_customer AS (
  SELECT o_custkey, count(*) AS n_orders,
         CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) * 100 AS HUGEINT) AS cents,
         count(*) FILTER (WHERE o_orderstatus = 'P') AS n_pending,
         count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent,
         max(o_orderdate) AS last_order
  FROM orders GROUP BY o_custkey),
usage AS (
  SELECT user_id, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS n_usage,
         count(*) FILTER (WHERE event_type = 'error') AS n_errors
  FROM events GROUP BY user_id),
base AS (
  SELECT 'CUST' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(6, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') AS CustomerID,
         CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS Gender,
         18 + c_custkey % 57 AS Age,
         c_custkey * 37 % 72 AS Tenure,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'One Year' WHEN 'FURNITURE' THEN 'Two Year' ELSE 'Month-to-Month' END AS ContractType,
         CASE c_nationkey % 3 WHEN 0 THEN 'DSL' WHEN 1 THEN 'Fiber' ELSE 'No Service' END AS InternetService,
         CAST((2 * cents + 3000 * n_orders) // (6000 * n_orders) AS DOUBLE) / 100.0 AS MonthlyCharges,
         coalesce(n_pending, 0) * 100.0::DOUBLE AS CallMinutes,
         CAST(coalesce(n_usage, 0) AS DOUBLE) AS DataUsage,
         CAST(coalesce(n_errors, 0) % 5 AS BIGINT) AS Complaints,
         CAST(CASE WHEN coalesce(n_pending, 0) >= 4 THEN 1 ELSE 0 END AS BIGINT) AS RecentSupportTickets,
         CASE c_custkey % 4 WHEN 0 THEN 'Credit Card' WHEN 1 THEN 'Debit Card' WHEN 2 THEN 'UPI' ELSE 'Cash' END AS PaymentMethod,
         CAST(coalesce(n_urgent, 0) % 4 AS BIGINT) AS LatePayments,
         CASE WHEN date_diff('day', CAST(last_order AS DATE), CAST((SELECT max(o_orderdate) FROM orders) AS DATE)) <= 180
              THEN 'No' ELSE 'Yes' END AS Churn
  FROM customer LEFT JOIN per_customer ON c_custkey = o_custkey LEFT JOIN usage ON c_custkey = user_id),
measured AS (
  SELECT *, round(MonthlyCharges * greatest(1, Tenure), 2) AS TotalCharges,
         round(greatest(CallMinutes, 0) / 1000.0::DOUBLE + greatest(DataUsage, 0) / 10.0::DOUBLE, 2) AS Engagement
  FROM base),
logits AS (
  SELECT *, -0.025::DOUBLE * Tenure + 0.6::DOUBLE * RecentSupportTickets
         + CASE ContractType WHEN 'Month-to-Month' THEN 1.2::DOUBLE WHEN 'One Year' THEN -0.5::DOUBLE ELSE -1.0::DOUBLE END
         + CASE WHEN Engagement < 1 AND MonthlyCharges > 70 THEN 1.3::DOUBLE ELSE 0.0::DOUBLE END
         + 0.5::DOUBLE * Complaints + 0.4::DOUBLE * LatePayments
         + CASE WHEN MonthlyCharges > 85 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END
         + CASE WHEN Engagement < 0.5 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS logit
  FROM measured),
snap AS (
  SELECT CustomerID, Gender, Age, Tenure, ContractType, InternetService, MonthlyCharges, TotalCharges, CallMinutes,
         DataUsage, Complaints, RecentSupportTickets, PaymentMethod, LatePayments, Engagement,
         round(1.0::DOUBLE / (1.0::DOUBLE + exp(-logit)), 3) AS ChurnProbability, Churn
  FROM logits),
scored AS (
  SELECT * EXCLUDE (logit), round(1.0::DOUBLE / (1.0::DOUBLE + exp(-logit)), 3) AS ChurnProbability,
         CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END AS label,
         round(1.0::DOUBLE / (1.0::DOUBLE + exp(-logit)), 6) AS probability,
         CASE WHEN round(1.0::DOUBLE / (1.0::DOUBLE + exp(-logit)), 6) > 0.5 THEN 1 ELSE 0 END AS prediction
  FROM logits)"""

# Scored line items: many rows and many distinct scores.
LINES = """
lines AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
         round(l_extendedprice / 105000.0::DOUBLE, 6) AS probability,
         CASE WHEN round(l_extendedprice / 105000.0::DOUBLE, 6) > 0.5 THEN 1 ELSE 0 END AS prediction,
         l_quantity, l_discount, l_tax, l_linestatus
  FROM lineitem)"""

# Test rows of the stratified split: the smallest hashes of each class, as many as the quota.
SPLIT = """
hashed AS (SELECT *, md5('42:' || CustomerID) AS hash FROM snap),
quota AS (
  SELECT Churn, n, n - CAST(part + CASE WHEN row_number() OVER (ORDER BY part - exact, Churn) <= train - sum(part) OVER () THEN 1 ELSE 0 END AS BIGINT) AS n_test
  FROM (SELECT *, floor(exact) AS part
        FROM (SELECT Churn, n, train, n * train / CAST(total AS DOUBLE) AS exact
              FROM (SELECT Churn, count(*) AS n, sum(count(*)) OVER () AS total,
                           sum(count(*)) OVER () - ceil(sum(count(*)) OVER () * 0.2::DOUBLE) AS train
                    FROM snap GROUP BY Churn)))),
parted AS (
  SELECT hashed.* EXCLUDE (hash),
         CASE WHEN row_number() OVER (PARTITION BY hashed.Churn ORDER BY hash, CustomerID) <= n_test THEN 'test' ELSE 'train' END AS split
  FROM hashed JOIN quota USING (Churn))"""


def engineered_sql(source: str, fit: str) -> str:
    """CTE ``feat``: the 24 features of ``source``, fitted on ``fit``."""
    scaled = ["Age", "Tenure", "MonthlyCharges", "TotalCharges", "Complaints", "LatePayments", "Engagement"]
    moments = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in scaled)
    z = {c: f"round(({c} - m_{c}) / s_{c}, 6) + 0.0 AS {c}" for c in scaled}
    return f"""
fitted AS (SELECT {moments}, quantile_cont(MonthlyCharges, 0.5) AS median_price FROM {fit}),
feat AS (
  SELECT CustomerID, CASE Gender WHEN 'Female' THEN 0 ELSE 1 END AS Gender,
         {z["Age"]}, {z["Tenure"]}, {z["MonthlyCharges"]}, {z["TotalCharges"]}, {z["Complaints"]},
         RecentSupportTickets, {z["LatePayments"]}, {z["Engagement"]},
         CASE WHEN Tenure > 6 AND Tenure <= 12 THEN 1 ELSE 0 END AS TenureBucket_Growing,
         CASE WHEN Tenure > 12 AND Tenure <= 24 THEN 1 ELSE 0 END AS TenureBucket_Established,
         CASE WHEN Tenure > 24 AND Tenure <= 60 THEN 1 ELSE 0 END AS TenureBucket_Loyal,
         CASE WHEN Tenure > 60 AND Tenure <= 100 THEN 1 ELSE 0 END AS TenureBucket_Veteran,
         round({source}.MonthlyCharges / (CASE InternetService WHEN 'No Service' THEN 2 ELSE 3 END), 6) AS PricePerService,
         CASE WHEN {source}.Tenure < 12 AND {source}.MonthlyCharges > median_price AND RecentSupportTickets = 1 THEN 1 ELSE 0 END AS IsHighRisk,
         CASE WHEN ContractType = 'Month-to-Month' AND {source}.Tenure > 24 THEN 1 ELSE 0 END AS ContractTenureMismatch,
         {source}.LatePayments + 0.5::DOUBLE * {source}.Complaints AS FinancialStress,
         CASE WHEN ContractType = 'One Year' THEN 1 ELSE 0 END AS "ContractType_One Year",
         CASE WHEN ContractType = 'Two Year' THEN 1 ELSE 0 END AS "ContractType_Two Year",
         CASE WHEN InternetService = 'Fiber' THEN 1 ELSE 0 END AS "InternetService_Fiber",
         CASE WHEN InternetService = 'No Service' THEN 1 ELSE 0 END AS "InternetService_No Service",
         CASE WHEN PaymentMethod = 'Credit Card' THEN 1 ELSE 0 END AS "PaymentMethod_Credit Card",
         CASE WHEN PaymentMethod = 'Debit Card' THEN 1 ELSE 0 END AS "PaymentMethod_Debit Card",
         CASE WHEN PaymentMethod = 'UPI' THEN 1 ELSE 0 END AS "PaymentMethod_UPI",
         CASE Churn WHEN 'Yes' THEN 1 ELSE 0 END AS Churn
  FROM {source}, fitted)"""
