"""Profiling: counts, descriptions, cross-tabs, correlations, histograms, outliers, drift."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.scalars import equal_width_bin
from ebbtide.operators.statistics import quantiles

QUARTILES = [0.25, 0.5, 0.75]


# Rows of a histogram's ranges, one per column and group, that are sent to every task; beyond
# that the rows of a group are spread over this many salts.
RANGE_ROWS, SALTS = 10_000, 16


def _q(name: str):
    return F.col(f"`{name}`")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows and percent per value, NULL not counted, most frequent first."""
    counts = df.filter(_q(column).isNotNull()).groupBy(_q(column).alias("value")).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows")).scalar()
    return counts.withColumn("percent", F.col("rows") * 100.0 / total).orderBy(F.desc("rows"), "value")


def describe(df: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """count, mean, sample std, min, quartiles, max: one row per column (and group)."""
    wide = df.groupBy(*by).agg(*[
        f(_q(c)).alias(f"_{n}{i}") for i, c in enumerate(columns)
        for n, f in (("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
    ])
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(f"_count{i}").alias("count"), F.col(f"_mean{i}").alias("mean"),
                 F.col(f"_std{i}").alias("std"), F.col(f"_min{i}").cast("double").alias("min"), F.col(f"_max{i}").cast("double").alias("max"))
        for i, c in enumerate(columns)
    ]
    table = wide.select(*by, F.inline(F.array(*cells)))
    ranks = (
        quantiles(df, columns, QUARTILES, by)
        .groupBy(*[F.col(b).alias(f"_by_{b}") for b in by], F.col("column").alias("_column"))
        .agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"p{int(p * 100)}") for p in QUARTILES])
    )
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by], F.col("column") == F.col("_column"))
    return table.join(ranks, same, "left").select(*by, "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def five_numbers(df: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Minimum, quartiles and maximum: the table behind box and violin plots."""
    names = {0.0: "min", 0.25: "p25", 0.5: "p50", 0.75: "p75", 1.0: "max"}
    return (
        quantiles(df, columns, list(names), by).groupBy(*by, "column")
        .agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in names.items()])
    )


def cross_tab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Share of each known ``column`` value within a ``row`` value."""
    counts = df.filter(_q(row).isNotNull() & _q(column).isNotNull()).groupBy(_q(row).alias(row)).agg(
        F.count("*").alias("_all"), *[F.count_if(_q(column) == v).alias(f"_v{i}") for i, v in enumerate(values)])
    return counts.select(row, *[(F.col(f"_v{i}") / F.col("_all")).alias(str(v)) for i, v in enumerate(values)])


def rate_by(df: DataFrame, column: str, target: str = "Churn", positive="Yes") -> DataFrame:
    """Percent of positive rows per category, highest first."""
    hit = F.coalesce(_q(target) == positive, F.lit(False)).cast("int")
    return (
        df.filter(_q(column).isNotNull()).groupBy(_q(column).alias("value"))
        .agg(F.count("*").alias("rows"), (F.avg(hit) * 100).alias("rate"))
        .orderBy(F.desc("rate"), "value")
    )


def co_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(i, j, n, sx, sy, sxx, syy, sxy)`` of all pairs of columns, over the rows that have both.

    Values are taken from their column's minimum on. A task multiplies its blocks of rows
    with their masks and passes one small matrix on; equal cells meet in a sum. NULL and NaN
    are missing values.
    """
    least = df.agg(*[F.min(F.when(~F.isnan(_q(c).cast("double")), _q(c).cast("double"))) for c in columns]).first()
    values = df.select(*[(_q(c).cast("double") - F.lit(float(m or 0.0))).alias(f"_{i}") for i, (c, m) in enumerate(zip(columns, least))])
    upper = np.triu_indices(len(columns))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)
            there = np.isfinite(x)
            x, there = np.where(there, x, 0.0), there.astype(float)
            sums, squares = x.T @ there, (x * x).T @ there
            total = total + np.stack([there.T @ there, sums, sums.T, squares, squares.T, x.T @ x])
        if not np.isscalar(total):
            cells = total[:, upper[0], upper[1]]
            yield pa.RecordBatch.from_arrays([pa.array(upper[0]), pa.array(upper[1]), *[pa.array(c) for c in cells]], names)

    names = ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"]
    partial = values.mapInArrow(add_up, "i bigint, j bigint, " + ", ".join(f"{c} double" for c in names[2:]))
    return partial.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names[2:]])


def _complete_correlation(pairs: list[tuple[str, str]], df: DataFrame) -> DataFrame:
    """Pearson correlation for column pairs from one matrix of sums; rows that lack a value are left out per pair."""
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    place = {c: i for i, c in enumerate(columns)}
    wanted = df.sparkSession.createDataFrame(
        [(a, b, min(place[a], place[b]), max(place[a], place[b])) for a, b in pairs], "a string, b string, i bigint, j bigint")

    def spread(square, total):
        found = F.col("n") * F.col(square) - F.col(total) * F.col(total)
        # A constant column has no correlation; what is left of it here is rounding.
        return F.when(found > 1e-12 * F.col("n") * F.col(square), found)

    correlation = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(spread("sxx", "sx")) / F.sqrt(spread("syy", "sy"))
    return wanted.join(co_moments(df, columns), ["i", "j"], "left").select("a", "b", correlation.alias("correlation"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """All ordered pairs (a, b, correlation), the diagonal included."""
    half = _complete_correlation([*combinations(columns, 2), *[(c, c) for c in columns]], df)
    # Both triangles from one scan.
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(
        F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return half.select(F.inline(both), "correlation")


def target_correlation(df: DataFrame, columns: list[str], target: str, top: int | None = None) -> DataFrame:
    """Correlation of each column with the target, strongest first."""
    table = _complete_correlation([(c, target) for c in columns], df).select(
        F.col("a").alias("feature"), "correlation")
    ordered = table.orderBy(F.desc_nulls_last(F.abs("correlation")), "feature")
    return ordered.limit(top) if top else ordered


def redundancy(df: DataFrame, columns: list[str]) -> DataFrame:
    """1 - |correlation| for each unordered pair of features."""
    return _complete_correlation(list(combinations(columns, 2)), df).select(
        "a", "b", (1 - F.abs("correlation")).alias("distance"))


def extremes(df: DataFrame, columns: list[str]) -> DataFrame:
    wide = df.agg(*[f(_q(c)).cast("double").alias(f"_{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_lo{i}").alias("min"), F.col(f"_hi{i}").alias("max"))
        for i, c in enumerate(columns)])))


def iqr_bounds(df: DataFrame, columns: list[str]) -> DataFrame:
    table = five_numbers(df, columns)
    spread = F.col("p75") - F.col("p25")
    return table.select("column", (F.col("p25") - 1.5 * spread).alias("lower"), (F.col("p75") + 1.5 * spread).alias("upper"))


def _bounds_dict(df, columns) -> dict:
    found = {r["column"]: (r["lower"], r["upper"]) for r in iqr_bounds(df, columns).collect()}  # one row per column
    return {c: tuple(F.lit(x).cast("double") for x in found.get(c, (None, None))) for c in columns}


def outliers(df: DataFrame, column: str) -> DataFrame:
    """Rows below Q1 - 1.5 IQR or above Q3 + 1.5 IQR."""
    low, high = _bounds_dict(df, [column])[column]
    return df.filter((_q(column) < low) | (_q(column) > high))


def outlier_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bounds, outlier count and percent per column."""
    bounds = _bounds_dict(df, columns)
    wide = df.agg(F.count("*").alias("_rows"), *[
        F.count_if((_q(c) < bounds[c][0]) | (_q(c) > bounds[c][1])).alias(f"_o{i}") for i, c in enumerate(columns)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), bounds[c][0].alias("lower"), bounds[c][1].alias("upper"),
                 F.col(f"_o{i}").alias("outliers"), (F.col(f"_o{i}") * 100.0 / F.col("_rows")).alias("percent"))
        for i, c in enumerate(columns)])))


def histogram(df: DataFrame, columns: list[str], bins: int = 50, by: tuple[str, ...] = ()) -> DataFrame:
    """Equal-width bins over the range of each column (and group); empty bins are left out.

    All columns share two scans: one for the ranges, one for the counts. The ranges, one row
    per column and group, are counted and broadcast while they are few. With more groups
    than that the join is salted, so that no group meets in one task; the bins are the same.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), _q(c).cast("double").alias("x")) for c in columns])
    long = df.select(*by, F.inline(cells)).filter(F.col("x").isNotNull())
    wide = df.groupBy(*by).agg(*[f(_q(c)).cast("double").alias(f"_{n}{i}") for i, c in enumerate(columns)
                                 for n, f in (("lo", F.min), ("hi", F.max))])
    ranges = wide.select(*[F.col(b).alias(f"_by_{b}") for b in by], F.inline(F.array(*[
        F.struct(F.lit(c).alias("_column"), F.col(f"_lo{i}").alias("_lo"), F.col(f"_hi{i}").alias("_hi"))
        for i, c in enumerate(columns)])))
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_by_{b}")) for b in by], F.col("column") == F.col("_column"))
    if not by or ranges.count() <= RANGE_ROWS:
        joined = long.join(F.broadcast(ranges), same)
    else:
        salted = ranges.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = long.withColumn("_of", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("_of") == F.col("_salt")))
    return (
        joined.withColumn("bin", equal_width_bin(F.col("x"), F.col("_lo"), F.col("_hi"), bins))
        .groupBy(*by, "column", "bin").agg(F.count("*").alias("rows"))
    )


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Class counts, negatives per positive, positive share."""
    return df.agg(
        F.count_if(F.col(label) == 0).alias("negatives"),
        F.count_if(F.col(label) == 1).alias("positives"),
    ).select("*", F.try_divide("negatives", "positives").alias("ratio"),
             F.try_divide(F.col("positives"), F.col("negatives") + F.col("positives")).alias("positive_share"))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def feature_profile(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Long profile ``(column, statistic, value)``: mean and std of numbers, shares of categories."""
    wide = df.agg(*[f(_q(c)).alias(f"_{n}{i}") for i, c in enumerate(numeric) for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
    numbers = wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(n).alias("statistic"), F.col(f"_{n}{i}").alias("value"))
        for i, c in enumerate(numeric) for n in ("mean", "std")])))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), _q(c).alias("v")) for c in categorical])
    counts = df.select(F.inline(cells)).filter(F.col("v").isNotNull()).groupBy("column", "v").agg(F.count("*").alias("n"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("t"))
    shares = counts.join(totals, "column").select(
        "column", F.concat(F.lit("share:"), "v").alias("statistic"), (F.col("n") / F.col("t")).alias("value"))
    return numbers.unionByName(shares)


def profile_drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Change of each profile statistic against a baseline profile; a share that is gone counts as 0."""
    old, new = baseline.withColumnRenamed("value", "baseline"), current.withColumnRenamed("value", "current")
    share = F.col("statistic").startswith("share:")
    filled = {c: F.when(share, F.coalesce(c, F.lit(0.0))).otherwise(F.col(c)) for c in ("baseline", "current")}
    return old.join(new, ["column", "statistic"], "full").withColumns(filled).withColumn(
        "change", F.col("current") - F.col("baseline"))
