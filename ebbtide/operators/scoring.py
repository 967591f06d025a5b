"""Scoring: features and model to the response columns."""

from __future__ import annotations

import time

from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions import scorecard
from ebbtide.functions.scalars import version_label
from ebbtide.schema import ID

# Lower bounds of the risk tiers.
TIERS = [(0.80, "Critical"), (0.65, "High"), (0.45, "Medium")]
LOWEST_TIER = "Low"
HIGH_RISK = ("High", "Critical")


def risk_tier(p: Column) -> Column:
    """Tier of the unrounded probability; unknown stays unknown."""
    tier = F.when(p.isNull(), F.lit(None))
    for bound, name in TIERS:
        tier = tier.when(p >= bound, name)
    return tier.otherwise(LOWEST_TIER)


def decide(p: Column, threshold: float | None = None) -> Column:
    """Default: above a half. A threshold of one's own counts as reached when equal, as in the cost sweep."""
    if threshold is None:
        return (p > 0.5).cast("int")
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must lie in [0, 1]")
    return (p >= threshold).cast("int")


def score(df: DataFrame, features: Transformer, model: PipelineModel) -> DataFrame:
    """Raw snapshot rows -> kept id columns, features, ``probability``, ``prediction``."""
    return model.transform(features.transform(df))


def score_with_rules(df: DataFrame) -> DataFrame:
    """Snapshot rows scored by the rule scorecard instead of a trained model."""
    return df.withColumn("probability", scorecard.probability()).withColumn("prediction", decide(F.col("probability")))


def responses(scored: DataFrame, version, threshold: float | None = None, key: str = ID) -> DataFrame:
    """The seven response columns. Tier and decision use the unrounded probability."""
    p = F.col("probability")
    churns = F.col("prediction") if threshold is None else decide(p, threshold)
    return scored.select(
        F.col(key).alias("customer_id"),
        F.when(churns == 1, "Yes").otherwise("No").alias("churn_prediction"),
        F.round(p, 4).alias("churn_probability"),
        risk_tier(p).alias("risk_level"),
        F.round(F.when(churns == 1, p).otherwise(1 - p), 4).alias("confidence"),
        version_label(F.lit(str(version))).alias("model_version"),
        F.current_timestamp().alias("prediction_date"),
    )


def batch_summary(answers: DataFrame) -> DataFrame:
    return answers.agg(
        F.count("*").alias("total_predictions"),
        F.count_if(F.col("risk_level").isin(*HIGH_RISK)).alias("high_risk_count"))


def timed_summary(answers: DataFrame) -> dict:
    """Run the summary and report how long it took."""
    start = time.monotonic()
    row = batch_summary(answers).first()
    return {**row.asDict(), "processing_time_seconds": round(time.monotonic() - start, 3)}
