"""What must be refused with an error of its own is refused, and unknown names are told."""

import pytest
from pyspark.sql import functions as F

from ebbtide.operators import training
from ebbtide.operators import transformers as tf
from ebbtide.schema import require_columns
from ebbtide.sources import files
from ebbtide.sources.snapshot import snapshot


@pytest.fixture(scope="module")
def rows(spark, folder):
    return snapshot(spark, folder)


@pytest.fixture(scope="module")
def labelled(rows):
    return rows.select(F.col("Age").cast("double").alias("Age"), F.lit(1).alias("label"))


def test_input_must_exist(spark, folder):
    with pytest.raises(FileNotFoundError):
        files.read_snapshot(spark, f"{folder}/no-such-file.csv")


def test_an_empty_input_is_not_fitted(rows):
    with pytest.raises(ValueError):
        tf.FeatureEngineer().fit(rows.filter("false"))


def test_required_columns(rows):
    with pytest.raises(ValueError, match="Age"):
        require_columns(rows.drop("Age"), ["Age", "Tenure"])


def test_both_classes(labelled):
    with pytest.raises(ValueError):
        training.train(labelled, "logistic-baseline", ["Age"])


def test_depth_of_trees(labelled):
    two = labelled.withColumn("label", (F.col("Age") > 40).cast("int"))
    with pytest.raises(ValueError):
        training.train(two, "rf-deep", ["Age"], max_depth=31)


def test_unknown_vote(labelled):
    with pytest.raises(ValueError):
        training.train_voting(labelled, voting="other")


def test_unknown_names_to_drop_are_told(rows):
    with pytest.warns(UserWarning, match="NotThere"):
        out = tf.ColumnDropper(["Age", "NotThere"]).transform(rows)
    assert "Age" not in out.columns
