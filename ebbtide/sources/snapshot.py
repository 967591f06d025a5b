"""The customer snapshot, derived from the customer, orders and events tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.functions import features as fx
from ebbtide.functions import scorecard
from ebbtide.functions.scalars import padded_id
from ebbtide.schema import SNAPSHOT


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer with the 17 contract columns.

    Orders and events are reduced to one row per customer before the joins, with a
    map-side combine, so a customer holding a large share of the orders costs one
    partial row per task. The joins reuse the partitioning of those aggregates.
    """
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    orders = table(spark, folder, "orders")
    per_customer = orders.groupBy("o_custkey").agg(
        F.count("*").alias("n_orders"),
        F.sum(F.col("o_totalprice").cast("decimal(12,2)")).alias("spend"),
        F.count_if(F.col("o_orderstatus") == "P").alias("n_pending"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"),
        F.max("o_orderdate").alias("last_order"),
    )
    newest = orders.agg(F.max("o_orderdate").alias("newest")).scalar()
    usage = (
        table(spark, folder, "events")
        .filter(F.col("event_type").isin("click", "view", "error"))
        .groupBy("user_id")
        .agg(
            F.count_if(F.col("event_type").isin("click", "view")).alias("n_usage"),
            F.count_if(F.col("event_type") == "error").alias("n_errors"),
        )
    )
    joined = (
        customer
        .join(per_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(usage, F.col("c_custkey") == F.col("user_id"), "left")
    )

    key = F.col("c_custkey")
    pending = F.coalesce("n_pending", F.lit(0))
    base = joined.select(
        padded_id(key).alias("CustomerID"),
        F.when(key % 2 == 0, "Male").otherwise("Female").alias("Gender"),
        (18 + key % 57).alias("Age"),
        (key * 37 % 72).alias("Tenure"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "One Year")
        .when(F.col("c_mktsegment") == "FURNITURE", "Two Year")
        .otherwise("Month-to-Month").alias("ContractType"),
        F.when(F.col("c_nationkey") % 3 == 0, "DSL")
        .when(F.col("c_nationkey") % 3 == 1, "Fiber")
        .otherwise("No Service").alias("InternetService"),
        # Mean order price / 3000 to the cent, in whole numbers: the same in every run and engine.
        (F.expr("(2 * spend * 100 + 3000 * n_orders) div (6000 * n_orders)") / 100.0).alias("MonthlyCharges"),
        (pending * 100.0).alias("CallMinutes"),
        F.coalesce("n_usage", F.lit(0)).cast("double").alias("DataUsage"),
        (F.coalesce("n_errors", F.lit(0)) % 5).alias("Complaints"),
        F.when(pending >= 4, 1).otherwise(0).cast("long").alias("RecentSupportTickets"),
        F.element_at(F.array(*map(F.lit, ["Credit Card", "Debit Card", "UPI", "Cash"])),
                     (key % 4 + 1).cast("int")).alias("PaymentMethod"),
        (F.coalesce("n_urgent", F.lit(0)) % 4).alias("LatePayments"),
        F.when(F.datediff(newest, "last_order") <= 180, "No").otherwise("Yes").alias("Churn"),
    )
    derived = base.withColumns({
        "TotalCharges": fx.total_charges(F.col("MonthlyCharges"), F.col("Tenure")),
        "Engagement": fx.engagement(F.col("CallMinutes"), F.col("DataUsage")),
    })
    return derived.withColumn("ChurnProbability", F.round(scorecard.probability(), 3)).select(*SNAPSHOT.names)


def scored_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshot rows with ``label``, ``probability`` and ``prediction`` of the scorecard."""
    return snapshot(spark, folder).select(
        "*",
        F.when(F.col("Churn") == "Yes", 1).otherwise(0).alias("label"),
        F.round(scorecard.probability(), 6).alias("probability"),
    ).withColumn("prediction", (F.col("probability") > 0.5).cast("int"))


def scored_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A larger scored table: line items, label = returned, probability from the price."""
    return table(spark, folder, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.round(F.col("l_extendedprice") / F.lit(105000.0), 6).alias("probability"),
        F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_linestatus"),
    ).withColumn("prediction", (F.col("probability") > 0.5).cast("int"))
