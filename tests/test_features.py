import pytest
from pyspark.errors import PythonException, SparkRuntimeException
from pyspark.sql import functions as F

from ebbtide.functions import features as fx
from ebbtide.operators import impute
from ebbtide.operators import transformers as tf
from ebbtide.schema import FEATURES, ID

# Scaled values worked out with the population standard deviation of the four rows.
GOLDEN = {
    "Gender": [0, 1, 0, 1],
    "Age": [0.481025, -0.70739, 1.386484, -1.160119],
    "Tenure": [-1.128835, 0.217084, -0.607834, 1.519586],
    "MonthlyCharges": [0.434772, -0.434772, -1.345724, 1.345724],
    "TotalCharges": [-0.771398, -0.151815, -0.75407, 1.677283],
    "Complaints": [1.507557, -0.904534, 0.301511, -0.904534],
    "RecentSupportTickets": [1, 0, 0, 0],
    "LatePayments": [0.0, -0.816497, -0.816497, 1.632993],
    "Engagement": [0.072564, -0.488596, -1.146507, 1.562539],
    "TenureBucket_Growing": [1, 0, 0, 0],
    "TenureBucket_Established": [0, 0, 1, 0],
    "TenureBucket_Loyal": [0, 1, 0, 0],
    "TenureBucket_Veteran": [0, 0, 0, 1],
    "PricePerService": [26.333333, 19.333333, 18.0, 33.666667],
    "IsHighRisk": [1, 0, 0, 0],
    "ContractTenureMismatch": [0, 0, 0, 1],
    "FinancialStress": [2, 0, 0.5, 3],
    "ContractType_One Year": [0, 1, 0, 0],
    "ContractType_Two Year": [0, 0, 1, 0],
    "InternetService_Fiber": [1, 0, 0, 1],
    "InternetService_No Service": [0, 0, 1, 0],
    "PaymentMethod_Credit Card": [0, 0, 0, 1],
    "PaymentMethod_Debit Card": [0, 0, 1, 0],
    "PaymentMethod_UPI": [1, 0, 0, 0],
    "Churn": [1, 0, 0, 1],
}


def test_golden_features(customers):
    out = tf.FeatureEngineer().fit(customers).transform(customers)
    assert out.columns == [ID, *FEATURES, "Churn"]
    rows = out.orderBy(ID).collect()
    for column, expected in GOLDEN.items():
        assert [r[column] for r in rows] == pytest.approx(expected, abs=1e-6), column


def test_feature_names_need_no_job(customers):
    model = tf.FeatureEngineer().fit(customers)
    assert model.feature_names() == FEATURES


def test_a_raw_column_may_stay_a_feature(customers):
    config = {**tf.DEFAULT_CONFIG, "features_to_drop": [c for c in tf.DEFAULT_CONFIG["features_to_drop"] if c != "CallMinutes"]}
    model = tf.FeatureEngineer(config).fit(customers)
    out = model.transform(customers)
    assert "CallMinutes" in model.feature_names() and out.columns == [ID, *model.feature_names(), "Churn"] and out.count() == 4


@pytest.mark.parametrize("tenure,bucket", [
    (0, "New"), (2, "New"), (6, "New"), (7, "Growing"), (10, "Growing"), (12, "Growing"), (20, "Established"),
    (24, "Established"), (25, "Loyal"), (40, "Loyal"), (60, "Loyal"), (61, "Veteran"), (100, "Veteran"), (101, None), (-1, None)])
def test_tenure_bucket_edges(spark, tenure, bucket):
    assert spark.range(1).select(fx.tenure_bucket(F.lit(tenure)).alias("b")).first()["b"] == bucket


def test_tenure_is_kept(customers):
    assert "Tenure" in tf.TenureBucketer().transform(customers).columns


def test_dropper_ignores_unknown_names(customers):
    assert tf.ColumnDropper(["Age", "Nothing"]).transform(customers).columns == [c for c in customers.columns if c != "Age"]


def test_high_risk_uses_training_median_and_exactly_one_ticket(spark):
    schema = "Tenure long, MonthlyCharges double, RecentSupportTickets long"
    train = spark.createDataFrame([(10, 50.0, 0), (20, 60.0, 1), (30, 70.0, 0)], schema)
    test = spark.createDataFrame([(5, 65.0, 1), (5, 60.0, 1), (5, 65.0, 2), (12, 65.0, 1), (None, 65.0, 1)], schema)
    model = tf.HighRisk().fit(train)
    assert model["median"] == 60.0
    assert [r["IsHighRisk"] for r in model.transform(test).collect()] == [1, 0, 0, 0, 0]


def test_missing_values_in_flags_count_as_no(spark):
    df = spark.createDataFrame([(None, 30), ("Month-to-Month", None)], "ContractType string, Tenure long")
    assert [r["ContractTenureMismatch"] for r in tf.ContractTenureMismatch().transform(df).collect()] == [0, 0]


def test_unknown_service_counts_as_one_service(spark):
    df = spark.createDataFrame([(None, 90.0), ("No Service", 90.0), ("DSL", 90.0)], "InternetService string, MonthlyCharges double")
    assert [r["PricePerService"] for r in tf.PricePerService().transform(df).collect()] == [30.0, 45.0, 30.0]


def test_unseen_binary_label_is_an_error(spark, customers):
    model = tf.FeatureEngineer().fit(customers)
    with pytest.raises((SparkRuntimeException, PythonException), match="unseen label in Gender: Other"):
        model.transform(customers.withColumn("Gender", F.lit("Other"))).collect()


def test_unseen_one_hot_value_gives_zeros(customers):
    model = tf.FeatureEngineer().fit(customers)
    row = model.transform(customers.withColumn("PaymentMethod", F.lit("Barter"))).first()
    assert [row[c] for c in FEATURES if c.startswith("PaymentMethod_")] == [0, 0, 0]


def test_fit_on_part_keeps_columns_and_median(customers):
    train, test = customers.filter("CustomerID <= 'K-12'"), customers.filter("CustomerID > 'K-12'")
    model = tf.FeatureEngineer().fit(train)
    assert model.transform(train).columns == model.transform(test).columns
    assert model.stage(tf.HighRiskModel)["median"] == 68.5


def test_single_row_and_no_target(customers):
    model = tf.FeatureEngineer().fit(customers)
    out = model.transform(customers.filter("CustomerID = 'K-11'").drop("Churn"))
    assert out.count() == 1 and out.columns == [ID, *FEATURES]


def test_pipeline_survives_saving(customers, tmp_path):
    model = tf.FeatureEngineer().fit(customers)
    model.write().save(str(tmp_path / "m"))
    loaded = tf.FeatureEngineerModel.load(str(tmp_path / "m"))
    assert loaded.transform(customers).collect() == model.transform(customers).collect()


def test_stage_by_stage_fit_agrees(customers):
    """Scaling a fitted flag forces the sequential fit; the shared columns must not change."""
    config = {**tf.DEFAULT_CONFIG, "numerical_features": {"scale": [*tf.DEFAULT_CONFIG["numerical_features"]["scale"], "IsHighRisk"]}}
    joint = tf.FeatureEngineer().fit(customers).transform(customers).orderBy(ID).collect()
    stepwise = tf.FeatureEngineer(config).fit(customers).transform(customers).orderBy(ID).collect()
    assert [r["Age"] for r in joint] == pytest.approx([r["Age"] for r in stepwise])
    assert sum(r["IsHighRisk"] for r in stepwise) == pytest.approx(0.0)


def test_steps_can_be_switched_off(customers):
    config = {**tf.DEFAULT_CONFIG, "engineered_features": {}}
    columns = tf.FeatureEngineer(config).fit(customers).transform(customers).columns
    assert not any(c.startswith("TenureBucket") for c in columns) and "IsHighRisk" not in columns


def test_missing_columns_are_listed(customers):
    with pytest.raises(ValueError, match="Complaints.*LatePayments"):
        tf.FinancialStress().transform(customers.drop("Complaints", "LatePayments"))


def test_fit_on_nothing_fails(customers):
    with pytest.raises(ValueError, match="empty"):
        tf.FeatureEngineer().fit(customers.filter("false"))


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (4.0, 5.0)], "a double, flat double")
    out = {m: tf.NumericScaler(["a", "flat", "absent"], m).fit(df).transform(df).collect() for m in tf.NumericScaler.METHODS}
    assert [r["a"] for r in out["standard"]] == pytest.approx([-1.341641, -0.447214, 0.447214, 1.341641], abs=1e-6)
    assert [r["a"] for r in out["minmax"]] == pytest.approx([0, 1 / 3, 2 / 3, 1])
    assert [r["a"] for r in out["robust"]] == pytest.approx([-1, -1 / 3, 1 / 3, 1])
    assert all(r["flat"] == 0 for rows in out.values() for r in rows)
    with pytest.raises(ValueError, match="unknown scaling"):
        tf.NumericScaler(["a"], "other")


def test_scaled_training_rows_have_zero_mean_and_unit_deviation(snap):
    out = tf.FeatureEngineer().fit(snap).transform(snap)
    for c in tf.DEFAULT_CONFIG["numerical_features"]["scale"]:
        row = out.agg(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).first()
        assert row["m"] == pytest.approx(0, abs=1e-9) and row["s"] == pytest.approx(1)


def test_mapping_option(customers):
    spec = {"Gender": {"mapping": {"Male": 0, "Female": 1}, "use_mapping": True}}
    out = tf.CategoricalEncoder(spec).fit(customers).transform(customers).orderBy(ID).collect()
    assert [r["Gender"] for r in out] == [1, 0, 1, 0]


def test_declared_categories_replace_saved_ones(customers):
    model = tf.FeatureEngineer().fit(customers)
    pipeline, drift = tf.overlay_categories(model.pipeline, {"PaymentMethod": {"categories": ["Cash", "UPI"]}})
    assert list(drift) == ["PaymentMethod"]
    columns = pipeline.transform(customers).columns
    assert "PaymentMethod_UPI" in columns and "PaymentMethod_Credit Card" not in columns


def test_imputer(spark):
    df = spark.createDataFrame(
        [(1, 10.0, "UPI", None), (2, None, "UPI", "DSL"), (None, 30.0, "Cash", "DSL"), (4, 20.0, None, "DSL")],
        "Age long, MonthlyCharges double, PaymentMethod string, InternetService string")
    out = impute.Imputer().fit(df).transform(df).orderBy("Age").collect()
    assert [r["Age"] for r in out] == [1, 2, 4]
    assert [r["MonthlyCharges"] for r in out] == [10.0, 15.0, 20.0]
    assert [r["PaymentMethod"] for r in out] == ["UPI", "UPI", "UPI"]
    assert out[0]["InternetService"] == "No Service" and out[0]["InternetService_was_missing"] == 1
    assert [r["MonthlyCharges_was_missing"] for r in out] == [0, 1, 0]


def test_variance_filter(customers):
    df = customers.withColumn("Constant", F.lit(1.0))
    assert "Constant" not in tf.VarianceFilter(["Constant", "Age"]).fit(df).transform(df).columns


def test_config_file(customers, tmp_path):
    import json

    from ebbtide.sources.files import read_config

    path = tmp_path / "features.json"
    path.write_text(json.dumps({**tf.DEFAULT_CONFIG, "scaling": {"method": "minmax"}}))
    out = tf.FeatureEngineer(read_config(str(path))).fit(customers).transform(customers)
    assert out.agg(F.min("Age"), F.max("Age")).first()[:2] == (0.0, 1.0)


def test_columns_of_many_values(spark, tmp_path):
    """A long list of labels is joined as a table, also after saving; only one-hot columns are refused, by an exact count."""
    df = spark.range(100_000).select(F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("city"), (F.col("id") % 2).alias("other"))
    model = tf.CategoricalEncoder(binary={"city": {}}).fit(df)
    model.write().save(str(tmp_path / "codes"))
    for fitted in (model, tf.CategoricalModel.load(str(tmp_path / "codes"))):
        coded = fitted.transform(df.withColumn("want", F.substring("city", 2, 6).cast("int")))
        assert coded.columns == ["city", "other", "want"] and coded.filter("city = want").count() == 100_000
    with pytest.raises(Exception, match="unseen label in city: new"):
        model.transform(spark.createDataFrame([("new", 1)], "city string, other long")).collect()
    with pytest.raises(ValueError, match="1001 values"):
        tf.CategoricalEncoder(one_hot={"city": {}}).fit(df.limit(1001))
    assert len(tf.CategoricalEncoder(one_hot={"city": {}}).fit(df.limit(1000)).transform(df.limit(5)).columns) == 1000
