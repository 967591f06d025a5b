import json

import pytest
from pyspark.sql import functions as F

from ebbtide.operators import checks, rules, shaping
from ebbtide.plans import jobs
from ebbtide.schema import RAW_REQUEST, REQUEST, SNAPSHOT
from ebbtide.sources import files, sinks
from tests.conftest import VALID_REQUEST

SMALL_SUITE = [
    checks.Check("columns", args={"column_list": SNAPSHOT.names}),
    checks.Check("in_set", "Gender", {"value_set": ["Male", "Female"]}),
    checks.Check("between", "CallMinutes", {"min_value": 0, "max_value": 2000}),
]


def _csv(df, tmp_path, name="data"):
    path = str(tmp_path / name)
    sinks.write_table(df.coalesce(1), path, "csv")
    return path


def test_valid_file_passes(spark, customers, tmp_path):
    summary = jobs.validate_file(spark, _csv(customers, tmp_path), SMALL_SUITE).first()
    assert (summary["evaluated"], summary["successful"], summary["success_percent"], summary["success"]) == (3, 3, 100.0, True)


@pytest.mark.parametrize("column,value", [("CallMinutes", -50.0), ("Gender", "Other")])
def test_bad_file_fails(spark, customers, tmp_path, column, value):
    path = _csv(customers.limit(1).withColumn(column, F.lit(value)), tmp_path)
    with pytest.raises(checks.SuiteFailed, match="1 checks failed") as failure:
        jobs.validate_file(spark, path, SMALL_SUITE)
    assert failure.value.failures[0]["column"] == column


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        jobs.validate_file(spark, str(tmp_path / "nothing"), SMALL_SUITE)


def test_extra_or_reordered_columns_fail(spark, customers, tmp_path):
    path = _csv(customers.select(*reversed(customers.columns)), tmp_path)
    with pytest.raises(checks.SuiteFailed):
        jobs.validate_file(spark, path, SMALL_SUITE)


def test_full_suite_on_clean_rows(customers):
    suite = checks.raw_data_suite(rows=(1, 10), mean_churn=(0.4, 0.6))
    assert len(suite) == 43
    row = checks.summarize(checks.run_suite(customers, suite)).first()
    assert (row["evaluated"], row["unsuccessful"]) == (43, 0)


def test_type_check_counts_cells_that_do_not_cast(spark, customers, tmp_path):
    broken = customers.withColumn("Age", F.when(F.col("CustomerID") == "K-11", "old").otherwise(F.col("Age").cast("string")))
    text = files.read_text_snapshot(spark, _csv(broken, tmp_path))
    result = checks.run_suite(text, [checks.Check("type", "Age", {"type_": "int64"})]).first()
    assert (result["success"], result["unexpected_count"]) == (False, 1)


def test_mostly_and_nulls(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (200,)], "v long")
    results = checks.run_suite(df, [
        checks.Check("not_null", "v", {"mostly": 0.75}), checks.Check("not_null", "v"),
        checks.Check("between", "v", {"min_value": 0, "max_value": 100}),
        checks.Check("between", "v", {"min_value": 0, "max_value": 100, "mostly": 0.6}),
        checks.Check("unique", "v"), checks.Check("in_set", "gone", {"value_set": [1]})]).orderBy("check_id").collect()
    assert [r["success"] for r in results] == [True, False, False, True, True, False]
    assert results[2]["unexpected_count"] == 1


def test_unique_ignores_nulls_and_counts_every_copy(spark):
    df = spark.createDataFrame([("a",), ("a",), ("a",), ("b",), (None,), (None,)], "k string")
    row = checks.run_suite(df, [checks.Check("unique", "k")]).first()
    assert (row["success"], row["unexpected_count"]) == (False, 3)


def test_warnings_do_not_stop(customers):
    results = checks.validate(customers, [checks.Check("row_count", args={"min_value": 100}, severity="warning")])
    assert not results[0]["success"]
    with pytest.raises(checks.SuiteFailed):
        checks.validate(customers, [checks.Check("row_count", args={"min_value": 100})])


def test_first_failures_say_how_many_more(customers):
    suite = [checks.Check("row_count", args={"min_value": 100}) for _ in range(8)]
    shown = checks.first_failures(checks.run_suite(customers, suite)).collect()
    assert len(shown) == 5 and shown[0]["n_more"] == 3


def test_suite_file(tmp_path, customers):
    path = tmp_path / "suite.json"
    path.write_text(json.dumps({"expectations": [
        {"expectation_type": "expect_column_values_to_be_between", "kwargs": {"column": "Age", "min_value": 30, "max_value": 90}},
        {"expectation_type": "expect_table_row_count_to_be_between", "kwargs": {"min_value": 1, "max_value": 9}}]}))
    results = checks.run_suite(customers, checks.suite_from_json(str(path))).orderBy("check_id").collect()
    assert [r["success"] for r in results] == [False, True]


def test_cells_and_duplicates(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (1.0, "a"), (float("inf"), None)], "x double, s string")
    assert checks.quality_totals(df).first().asDict() == {"missing": 1, "infinite": 1, "duplicate_rows": 2}


def _requests(spark, *changes):
    rows = [{**VALID_REQUEST, **c} for c in changes]
    text = [[None if r[f] is None else str(r[f]) for f in REQUEST.names] for r in rows]
    return rules.check_requests(spark.createDataFrame(text, RAW_REQUEST))


def _fields(spark, **change):
    return [e["field"] for e in _requests(spark, change).first()["errors"]]


@pytest.mark.parametrize("change", [
    {}, {"tenure": 6, "contract_type": "Month-to-Month", "internet_service": "Fiber", "monthly_charges": 95.5,
         "total_charges": 573.0, "complaints": 3, "recent_support_tickets": 2, "late_payments": 2, "engagement": 0.6},
    {"tenure": 60, "monthly_charges": 50.0, "total_charges": 3000.0, "engagement": 1.8},
    {"internet_service": "No Service", "data_usage": 0.0},
    {"tenure": 0, "monthly_charges": 50.0, "total_charges": 100.0}])
def test_accepted_requests(spark, change):
    assert _fields(spark, **change) == []


@pytest.mark.parametrize("change,fields", [
    ({"age": 16}, ["age"]), ({"age": 101}, ["age"]), ({"age": None}, ["age"]), ({"age": "thirty-two"}, ["age"]),
    ({"contract_type": "Ten Year"}, ["contract_type"]),
    ({"tenure": 60, "monthly_charges": 85.5, "total_charges": 500.0}, ["total_charges"]),
    ({"tenure": 0, "monthly_charges": 50.0, "total_charges": 100.01}, ["total_charges"]),
    ({"age": -5}, ["age"]), ({"tenure": -10}, ["tenure"]), ({"monthly_charges": -50.0}, ["monthly_charges"]),
    ({"total_charges": -100.0}, ["total_charges"]), ({"call_minutes": -200.0}, ["call_minutes"]),
    ({"data_usage": -30.0}, ["data_usage"]), ({"engagement": -0.5}, ["engagement"]),
    ({"monthly_charges": 0.0}, ["monthly_charges"]), ({"customer_id": ""}, ["customer_id"]), ({"customer_id": "x" * 51}, ["customer_id"]),
    ({"internet_service": "No Service"}, ["__root__"]),
    ({"internet_service": "No Service", "data_usage": -1.0}, ["data_usage"]),
    ({"age": 10, "engagement": 3.0}, ["age", "engagement"])])
def test_rejected_requests(spark, change, fields):
    assert _fields(spark, **change) == fields


def test_error_records(spark):
    rejected = rules.rejects(_requests(spark, {}, {"age": 16, "gender": "X"})).collect()
    assert [(r["field"], r["type"], r["input"], r["error_count"]) for r in rejected] == [
        ("gender", "type_error.enum", "X", 2), ("age", "value_error.number.not_ge", "16", 2)]


def test_batch_modes(spark):
    checked = _requests(spark, {}, {"age": 16})
    valid, rejected = rules.accept(checked)
    assert (valid.count(), rejected.count()) == (1, 1)
    with pytest.raises(rules.InvalidRequests) as refused:
        rules.accept(checked, "fail")
    assert refused.value.rejected == 1 and refused.value.errors.count() == 1
    with pytest.raises(ValueError):
        rules.accept(checked, "other")


def test_batch_size(spark):
    with pytest.raises(rules.BatchTooLarge):
        rules.limit_batch(spark.range(101))
    with pytest.raises(rules.InvalidRequests):
        rules.limit_batch(spark.range(0))
    assert rules.limit_batch(spark.range(100)).count() == 100


def test_batch_bodies(spark):
    bodies = [json.dumps({"customers": [VALID_REQUEST, {**VALID_REQUEST, "age": 5}]}), json.dumps({"customers": []})]
    df = files.explode_batches(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "batch int, body string"))
    rows = df.orderBy("batch", "position").collect()
    assert [(r["batch"], r["position"], r["age"]) for r in rows] == [(0, 0, "44"), (0, 1, "5"), (1, None, None)]


def test_renaming(spark):
    snapshot = shaping.requests_to_snapshot(rules.valid_rows(_requests(spark, {})))
    assert snapshot.columns == SNAPSHOT.names[:15]
    assert snapshot.first()["MonthlyCharges"] == 72.5


def test_soft_signals(spark):
    signals = rules.soft_signals(rules.valid_rows(_requests(spark, {"contract_type": "Two Year", "tenure": 2, "total_charges": 145.0}))).first()
    assert signals["new_two_year"] and not signals["long_monthly"]


def test_assets(spark, customers, tmp_path):
    for name in ("jan", "feb"):
        (tmp_path / f"{name}.csv").write_text("CustomerID\nA\n")
    (tmp_path / "notes.txt").write_text("x")
    assert {r["asset"] for r in files.list_assets(spark, str(tmp_path)).collect()} == {"jan", "feb"}
    assert files.latest_asset(spark, str(tmp_path)).endswith("jan.csv")


def test_nan_becomes_null(spark):
    assert files.nan_to_null(spark.createDataFrame([(float("nan"),)], "x double")).first()["x"] is None


def test_corrupt_rows_keep_their_text(spark, customers, tmp_path):
    path = _csv(customers.withColumn("Age", F.lit("old")), tmp_path)
    row = files.read_snapshot(spark, path, keep_corrupt=True).cache().first()
    assert row["Age"] is None and "old" in row["_corrupt_record"]
