"""Column-level shaping: split off the target, rename requests, union records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.schema import REQUEST_TO_SNAPSHOT, TARGET, require_columns


def split_target(df: DataFrame, target: str = TARGET) -> tuple[list[str], str]:
    """Feature columns and target column. Both stay on the same rows, so nothing needs aligning."""
    require_columns(df, [target])
    return [c for c in df.columns if c != target], target


def requests_to_snapshot(df: DataFrame) -> DataFrame:
    """Rename the 15 request fields to the snapshot columns, in snapshot order."""
    require_columns(df, REQUEST_TO_SNAPSHOT)
    return df.select(*[F.col(f).alias(c) for f, c in REQUEST_TO_SNAPSHOT.items()])


def snapshot_to_requests(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(f) for f, c in REQUEST_TO_SNAPSHOT.items()])


def union_records(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def class_filter(df: DataFrame, error_type: str) -> DataFrame:
    return df.filter(F.col("error_type") == error_type)


def members(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``ids``."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def require_rows(df: DataFrame) -> DataFrame:
    """Opt-in guard against empty input; it runs a small job."""
    if df.isEmpty():
        raise ValueError("input DataFrame is empty")
    return df
