import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ebbtide.schema import SNAPSHOT  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


ROWS = [
    ("K-11", "Female", 52, 9, "Month-to-Month", "Fiber", 79.0, 711.0, 310.0, 4.4, 2, 1, "UPI", 1, 0.75, 0.8, "Yes"),
    ("K-12", "Male", 31, 40, "One Year", "DSL", 58.0, 2320.0, 250.0, 2.1, 0, 0, "Cash", 0, 0.46, 0.3, "No"),
    ("K-13", "Female", 68, 21, "Two Year", "No Service", 36.0, 756.0, 120.0, 0.0, 1, 0, "Debit Card", 0, 0.12, 0.2, "No"),
    ("K-14", "Male", 23, 70, "Month-to-Month", "Fiber", 101.0, 7070.0, 640.0, 8.8, 0, 0, "Credit Card", 3, 1.52, 0.7, "Yes"),
]

VALID_REQUEST = {
    "customer_id": "REQ-77", "gender": "Male", "age": 44, "tenure": 30, "contract_type": "One Year", "internet_service": "Fiber",
    "monthly_charges": 72.5, "total_charges": 2175.0, "call_minutes": 415.0, "data_usage": 22.5, "complaints": 1,
    "recent_support_tickets": 0, "payment_method": "Cash", "late_payments": 1, "engagement": 1.2,
}


@pytest.fixture(scope="session")
def customers(spark):
    return spark.createDataFrame(ROWS, SNAPSHOT).cache()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def snap(spark, folder):
    from ebbtide.sources.snapshot import snapshot
    return snapshot(spark, folder).cache()


@pytest.fixture(scope="session")
def trained(spark, folder):
    """Features of the smallest snapshot with a logistic, a forest and a boosted model."""
    from ebbtide.operators import training
    from ebbtide.plans import jobs
    from ebbtide.sources.snapshot import snapshot

    train, test, features = jobs.build_features(snapshot(spark, folder))
    train, test = training.as_training(train).cache(), training.as_training(test).cache()
    models = {
        "logistic": training.train(train, "logistic-baseline"),
        "forest": training.train(train, "rf-default", n_estimators=4, max_depth=5),
        "boosted": training.train(train, "xgb-conservative", n_estimators=4),
    }
    return train, test, features, models
