"""Deterministic stratified split and sampling by a hash of the row id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.session import work_path

# Hex digits of the hash by which rows are counted: 65,536 slices. Only the slice in which
# a quota ends is ranked, so a task ranks a 65,536th of a class.
SLICE_DIGITS = 4


def row_hash(key: str, seed: int) -> Column:
    """Hash text that orders rows at random; a NULL id hashes like an empty one.

    md5 is the same in every engine, so a split can be redone anywhere.
    """
    return F.md5(F.concat(F.lit(f"{seed}:"), _text(key)).cast("binary"))


def _text(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def class_quotas(sizes: DataFrame, test_size: float) -> DataFrame:
    """``(_class, _quota)`` from one row ``(_class, _size)`` per class.

    The test rows are ceil(n * share) in all; the train rows are spread over the classes by
    largest remainder.
    """
    whole = Window.partitionBy()
    total = F.sum("_size").over(whole)
    train = total - F.ceil(total * F.lit(float(test_size)))
    exact = F.col("_size") * F.col("_train") / F.col("_total")
    by_remainder = Window.orderBy(F.col("_floor") - F.col("_exact"), F.coalesce(F.col("_class").cast("string"), F.lit("None")))
    spread = (
        sizes.withColumns({"_total": total, "_train": train}).withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
        .withColumn("_short", F.col("_train") - F.sum("_floor").over(whole)).withColumn("_place", F.row_number().over(by_remainder))
    )
    return spread.select("_class", (F.col("_size") - F.col("_floor") - (F.col("_place") <= F.col("_short")).cast("long")).alias("_quota"))


def hash_cutoffs(df: DataFrame, key: str, strata: Column, quotas_of, seed: int) -> DataFrame:
    """``(_class, _last_hash, _last_id)``: the last row inside each class's quota.

    ``quotas_of`` maps the class sizes to quotas, both as tables with a row per class. Rows
    are counted by class and hash slice; the slice in which a quota ends is ranked, no class
    is ever sorted as a whole. A class without quota has no row.
    """
    hashed = df.select(strata.alias("_class"), _text(key).alias("_id"), row_hash(key, seed).alias("_hash"))
    hashed = hashed.withColumn("_slice", F.substring("_hash", 1, SLICE_DIGITS))
    slices = hashed.groupBy("_class", "_slice").agg(F.count("*").alias("_n"))
    quotas = quotas_of(slices.groupBy("_class").agg(F.sum("_n").alias("_size"))).select(F.col("_class").alias("_of"), "_quota")
    upto = F.sum("_n").over(Window.partitionBy("_class").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0))
    ends = (
        slices.withColumn("_upto", upto).join(quotas, F.col("_class").eqNullSafe(F.col("_of")))
        .filter("_upto - _n < _quota and _quota <= _upto")
        .select("_of", F.col("_slice").alias("_end"), (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_left"))
    )
    near = hashed.join(ends, F.col("_class").eqNullSafe(F.col("_of")) & (F.col("_slice") == F.col("_end")))
    rank = F.row_number().over(Window.partitionBy("_class").orderBy("_hash", "_id"))
    return near.withColumn("_rank", rank).filter("_rank = _left").select("_class", F.col("_hash").alias("_last_hash"), F.col("_id").alias("_last_id"))


def _marked(df: DataFrame, key: str, strata: Column, quotas_of, seed: int, name: str) -> DataFrame:
    """Add a boolean: is the row inside its class's quota."""
    path = work_path(df.sparkSession, "cutoffs")
    hash_cutoffs(df, key, strata, quotas_of, seed).write.parquet(path)
    # One row per class, read back from a file of known size: Spark broadcasts it while that is small.
    cutoffs = df.sparkSession.read.parquet(path)
    here, identity = row_hash(key, seed), _text(key)
    inside = (here < F.col("_last_hash")) | ((here == F.col("_last_hash")) & (identity <= F.col("_last_id")))
    return df.join(cutoffs, strata.eqNullSafe(F.col("_class")), "left").withColumn(name, F.coalesce(inside, F.lit(False))).drop(
        "_class", "_last_hash", "_last_id")


def stratified_split(df: DataFrame, key: str, label: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split`` = train | test with exact class shares.

    ``key`` must be unique. Any number of classes will do; a NULL label is a class. An empty
    frame gives an empty one.
    """
    marked = _marked(df, key, F.col(label), lambda sizes: class_quotas(sizes, test_size), seed, "_test")
    return marked.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def train_test(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col("split") == "train").drop("split"), df.filter(F.col("split") == "test").drop("split")


def sample_rows(df: DataFrame, n: int | None, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same ones in every run; all rows if n is None or not below their number."""
    if n is None:
        return df
    quotas = lambda sizes: sizes.select("_class", F.least("_size", F.lit(n)).alias("_quota"))
    return _marked(df, key, F.lit("all"), quotas, seed, "_taken").filter("_taken").drop("_taken")
