"""Profiles as mergeable states: each period or batch is read once, any periods are merged from stored rows.

A state is a table ``(period, column, category, rows, mean, m2, low, high)``. A number has one
row per period with its count, mean, sum of squared deviations and extremes and a NULL
category; a category column has one row per value with its count. Merging is associative, so
states of days, of micro-batches and of late arrivals combine in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = ("column", "category")


def profile_state(df: DataFrame, period: Column, numeric: list[str], categorical: list[str]) -> DataFrame:
    """State of every period found in ``df``, in one pass and one shuffle of partial sums.

    NULL and NaN numbers and NULL categories are left out, as in a profile. Rows without a
    period belong to the period NULL.
    """
    def cell(name: str, category, x):
        return F.struct(F.lit(name).alias("column"), category.alias("category"), x.alias("x"))

    none = F.lit(None)
    cells = F.array(
        *[cell(c, none.cast("string"), F.nanvl(F.col(f"`{c}`").cast("double"), none.cast("double"))) for c in numeric],
        *[cell(c, F.col(f"`{c}`").cast("string"), none.cast("double")) for c in categorical])
    return (
        df.select(period.alias("period"), F.inline(cells)).where("x IS NOT NULL OR category IS NOT NULL")
        .groupBy("period", *CELLS)
        .agg(F.count("*").alias("rows"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("m2"), F.min("x").alias("low"), F.max("x").alias("high"))
    )


def merge_states(states: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One state per group of ``by``, over all rows given: ``by=("period",)`` merges micro-batches of a period.

    The squared deviations move to the common mean, which arrives by a join with one row per
    cell; no group of states is collected.
    """
    keys = [*by, *CELLS]
    common = states.groupBy(*keys).agg((F.sum(F.col("rows") * F.col("mean")) / F.sum("rows")).alias("_mean")).select(
        *[F.col(k).alias(f"_{k}") for k in keys], "_mean")
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    away = F.col("mean") - F.col("_mean")
    return states.join(common, same).groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("rows") * away * away).alias("m2"),
        F.min("low").alias("low"), F.max("high").alias("high"))


def profile_of_state(state: DataFrame) -> DataFrame:
    """The long profile ``(column, statistic, value)`` of one merged state, as ``feature_profile`` gives it for rows."""
    numbers = state.where("category IS NULL").select("column", F.inline(F.array(
        F.struct(F.lit("mean").alias("statistic"), F.col("mean").alias("value")),
        F.struct(F.lit("std").alias("statistic"), F.sqrt(F.try_divide("m2", F.col("rows") - 1)).alias("value")))))
    counts = state.where("category IS NOT NULL")
    totals = counts.groupBy(F.col("column").alias("_column")).agg(F.sum("rows").alias("_total"))
    shares = counts.join(totals, F.col("column") == F.col("_column")).select(
        "column", F.concat(F.lit("share:"), "category").alias("statistic"), (F.col("rows") / F.col("_total")).alias("value"))
    return numbers.unionByName(shares)


def store_states(states: DataFrame, path: str, batch: int | str = 0) -> None:
    """Write the states of one batch; a batch that is written again replaces its own rows and no others."""
    states.withColumn("batch", F.lit(batch).cast("string")).write.mode("overwrite").partitionBy("batch").option(
        "partitionOverwriteMode", "dynamic").parquet(path)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "period string, column string, category string, rows bigint, mean double, m2 double, low double, high double, batch string").parquet(path)
