"""ROC and precision-recall curves, exact, with ties grouped.

Rows are reduced to one row per distinct score first. If even those are many, the
running totals are built range by range (see ``running``). Rows whose label is NULL, or
whose score is NULL or NaN, cannot be ranked and are left out before anything else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.running import ROWS_PER_TASK, range_bounds, running_totals


def _ranked(label: str, score: str):
    p = F.col(score).cast("double")
    return F.col(label).isNotNull() & p.isNotNull() & ~F.isnan(p)


def unscored(df: DataFrame, label: str = "label", score: str = "probability") -> DataFrame:
    """One row: how many rows the curves leave out."""
    return df.agg(F.count_if(~_ranked(label, score)).alias("unscored"))


def score_groups(df: DataFrame, label: str = "label", score: str = "probability", also=()) -> DataFrame:
    """Positives and negatives per distinct score, and any further aggregates in ``also``."""
    return df.filter(_ranked(label, score)).groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"), *also)


def cumulative(df: DataFrame, label: str = "label", score: str = "probability",
               rows_per_task: int = ROWS_PER_TASK, also=()) -> DataFrame:
    """Per distinct score: true and false positives when predicting positive at or above it."""
    bounds = range_bounds(df.filter(_ranked(label, score)), score, rows_per_task)
    groups = score_groups(df, label, score, also)
    totals = groups.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    return running_totals(groups, "score", {"tp": "pos", "fp": "neg"}, descending=True, bounds=bounds) \
        .withColumns({"positives": totals["p"], "negatives": totals["n"]})


def roc_points(curve: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr) for each distinct score, after a starting point at (0, 0)."""
    points = curve.select(
        F.col("score").alias("threshold"),
        F.try_divide("fp", "negatives").alias("fpr"), F.try_divide("tp", "positives").alias("tpr"))
    spark = curve.sparkSession
    start = spark.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(points)


def pr_points(curve: DataFrame) -> DataFrame:
    """(threshold, precision, recall) for each distinct score, plus the closing point (1, 0)."""
    points = curve.select(
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.try_divide("tp", "positives").alias("recall"))
    end = curve.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def areas(curve: DataFrame, also=()) -> DataFrame:
    """One row: ROC-AUC, average precision, positive share (the PR baseline).

    ``also`` names carried columns whose sums come along.
    """
    # Each tie group adds a trapezoid: its negatives pass the positives already counted
    # and half of its own. Every new positive adds the precision reached with its group.
    trapezoid = F.col("neg") * (F.col("tp") - F.col("pos") / 2)
    step = F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return curve.agg(
        F.sum(trapezoid).alias("area"), F.sum(step).alias("steps"),
        F.sum("pos").alias("p"), F.sum("neg").alias("n"), *[F.sum(c).alias(c) for c in also],
    ).select(
        F.try_divide("area", F.col("p").cast("double") * F.col("n")).alias("roc_auc"),
        F.try_divide("steps", "p").alias("average_precision"),
        F.try_divide(F.col("p"), F.col("p") + F.col("n")).alias("positive_share"), *also,
    )

