import json

from pyspark.sql import functions as F

from ebbtide.operators import scoring
from ebbtide.streaming import scoring as streaming
from tests.conftest import VALID_REQUEST


def _put(folder, name, *changes):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps({**VALID_REQUEST, **c}) for c in changes))


def _run(spark, tmp_path, **options):
    streaming.start_scoring(
        streaming.read_request_stream(spark, str(tmp_path / "in"), **options), scoring.score_with_rules,
        str(tmp_path / "out"), str(tmp_path / "checkpoint"), 1).awaitTermination()


def test_stream_scores_and_rejects_across_restarts(spark, tmp_path):
    _put(tmp_path / "in", "one", {"customer_id": "a"}, {"customer_id": "b", "age": 16})
    _run(spark, tmp_path, files_per_batch=1)
    _put(tmp_path / "in", "two", {"customer_id": "c"}, {"customer_id": "d", "age": "thirty"})
    (tmp_path / "in" / "three.json").write_text("{not json")
    _run(spark, tmp_path)
    valid = spark.read.parquet(str(tmp_path / "out/valid"))
    assert sorted(r["customer_id"] for r in valid.collect()) == ["a", "c"]
    rejected = spark.read.parquet(str(tmp_path / "out/rejects"))
    assert sorted((str(r["customer_id"]), r["type"], r["input"]) for r in rejected.collect()) == [
        ("None", "value_error.jsondecode", "{not json"), ("b", "value_error.number.not_ge", "16"), ("d", "type_error.integer", "thirty")]


def test_stream_with_a_model_equals_batch(spark, trained, snap, tmp_path):
    from ebbtide.operators.shaping import requests_to_snapshot, snapshot_to_requests
    _, _, features, models = trained
    requests = snapshot_to_requests(snap).filter((F.col("engagement") <= 2) & ~((F.col("internet_service") == "No Service") & (F.col("data_usage") > 0)))
    requests.write.json(str(tmp_path / "in"))
    scorer = lambda df: scoring.score(df, features, models["logistic"])
    streaming.start_scoring(streaming.read_request_stream(spark, str(tmp_path / "in")), scorer, str(tmp_path / "out"),
                            str(tmp_path / "checkpoint"), 1).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out/valid")).drop("batch_id", "prediction_date")
    batch = scoring.responses(scorer(requests_to_snapshot(requests)), 1).drop("prediction_date")
    assert streamed.count() == batch.count() > 100
    assert streamed.exceptAll(batch).count() == 0
