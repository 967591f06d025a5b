"""Schemas, domains and the three range rule sets of the customer data."""

from __future__ import annotations

from pyspark.sql import types as T

ID = "CustomerID"
TARGET = "Churn"

SNAPSHOT = T.StructType([
    T.StructField("CustomerID", T.StringType()),
    T.StructField("Gender", T.StringType()),
    T.StructField("Age", T.LongType()),
    T.StructField("Tenure", T.LongType()),
    T.StructField("ContractType", T.StringType()),
    T.StructField("InternetService", T.StringType()),
    T.StructField("MonthlyCharges", T.DoubleType()),
    T.StructField("TotalCharges", T.DoubleType()),
    T.StructField("CallMinutes", T.DoubleType()),
    T.StructField("DataUsage", T.DoubleType()),
    T.StructField("Complaints", T.LongType()),
    T.StructField("RecentSupportTickets", T.LongType()),
    T.StructField("PaymentMethod", T.StringType()),
    T.StructField("LatePayments", T.LongType()),
    T.StructField("Engagement", T.DoubleType()),
    T.StructField("ChurnProbability", T.DoubleType()),
    T.StructField("Churn", T.StringType()),
])

# The category lists of the data contract.
CATEGORIES = {
    "Gender": ["Male", "Female"],
    "ContractType": ["Month-to-Month", "One Year", "Two Year"],
    "InternetService": ["DSL", "Fiber", "No Service"],
    "PaymentMethod": ["Credit Card", "Debit Card", "UPI", "Cash"],
    "Churn": ["Yes", "No"],
}

# Request field -> snapshot column.
REQUEST_TO_SNAPSHOT = {
    "customer_id": "CustomerID",
    "gender": "Gender",
    "age": "Age",
    "tenure": "Tenure",
    "contract_type": "ContractType",
    "internet_service": "InternetService",
    "monthly_charges": "MonthlyCharges",
    "total_charges": "TotalCharges",
    "call_minutes": "CallMinutes",
    "data_usage": "DataUsage",
    "complaints": "Complaints",
    "recent_support_tickets": "RecentSupportTickets",
    "payment_method": "PaymentMethod",
    "late_payments": "LatePayments",
    "engagement": "Engagement",
}

REQUEST = T.StructType([
    T.StructField(field, SNAPSHOT[column].dataType)
    for field, column in REQUEST_TO_SNAPSHOT.items()
])

# Requests as they arrive: every field is text until the row rules cast it.
RAW_REQUEST = T.StructType([T.StructField(f, T.StringType()) for f in REQUEST.names])
# Where readers put the text of a line or row that does not parse.
CORRUPT = "_corrupt_record"
REQUEST_LINE = T.StructType([*RAW_REQUEST.fields, T.StructField(CORRUPT, T.StringType())])

# Three layers state ranges for the same columns and they differ, so each layer
# keeps its own set. (low, high), None = open, both ends inclusive.
CONTRACT_RANGES = {
    "Age": (18, 100),
    "Tenure": (0, None),
    "TotalCharges": (0, None),
    "CallMinutes": (0, None),
    "DataUsage": (0, None),
    "Complaints": (0, None),
    "RecentSupportTickets": (0, 1),
    "LatePayments": (0, None),
    "Engagement": (0, None),
    "ChurnProbability": (0, 1),
}
CONTRACT_OPEN_RANGES = {"MonthlyCharges": (0, 500)}  # strict at both ends
SUITE_RANGES = {
    "Age": (18, 100),
    "Tenure": (0, 120),
    "CallMinutes": (0, 2000),
    "DataUsage": (0, 50),
    "MonthlyCharges": (0, 500),
    "ChurnProbability": (0, 1),
}
REQUEST_RANGES = {
    "age": (18, 100),
    "tenure": (0, 100),
    "monthly_charges": (0, 200),
    "total_charges": (0, 10000),
    "call_minutes": (0, 10000),
    "data_usage": (0, 1000),
    "complaints": (0, 10),
    "recent_support_tickets": (0, 10),
    "late_payments": (0, 10),
    "engagement": (0, 2),
}

# The 24 model inputs in output order.
FEATURES = [
    "Gender", "Age", "Tenure", "MonthlyCharges", "TotalCharges", "Complaints",
    "RecentSupportTickets", "LatePayments", "Engagement",
    "TenureBucket_Growing", "TenureBucket_Established", "TenureBucket_Loyal", "TenureBucket_Veteran",
    "PricePerService", "IsHighRisk", "ContractTenureMismatch", "FinancialStress",
    "ContractType_One Year", "ContractType_Two Year",
    "InternetService_Fiber", "InternetService_No Service",
    "PaymentMethod_Credit Card", "PaymentMethod_Debit Card", "PaymentMethod_UPI",
]

RUNS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("run_name", T.StringType()),
    T.StructField("start_time", T.TimestampType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
])

VERSIONS = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("version", T.LongType()),
    T.StructField("stage", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("created", T.TimestampType()),
    T.StructField("description", T.StringType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
])


def columns_of_type(df, kinds: type | tuple[type, ...]) -> list[str]:
    """Column names whose Spark type is one of ``kinds`` (schema only, no job)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def numeric_columns(df) -> list[str]:
    return columns_of_type(df, T.NumericType)


def text_columns(df) -> list[str]:
    return columns_of_type(df, T.StringType)


def require_columns(df, names) -> None:
    """Fail with the full list of what is missing."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
