from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import explain, runs, scoring, training
from ebbtide.plans import jobs
from ebbtide.schema import FEATURES, ID
from ebbtide.sources.snapshot import snapshot


def test_all_kinds_score(trained):
    _, test, _, models = trained
    for model in models.values():
        out = model.transform(test)
        assert out.columns == [*test.columns, "probability", "prediction"]
        bad = out.filter((F.col("probability") < 0) | (F.col("probability") > 1) |
                         ((F.col("probability") > 0.5).cast("int") != F.col("prediction")))
        assert bad.count() == 0


def test_logistic_minimises_the_published_objective(trained):
    """At the optimum the gradient of 0.5 w'w + C * sum(weight * loss) vanishes."""
    train, _, _, models = trained
    fitted = training.classifier_of(models["logistic"])
    data = train.select("label", *[F.col(f"`{c}`").cast("double").alias(c) for c in FEATURES]).toPandas()
    x, y = data[FEATURES].to_numpy(), data["label"].to_numpy()
    w, b = fitted.coefficients.toArray(), fitted.intercept
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    residual = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
    assert np.abs(w + x.T @ residual).max() < 0.05 and abs(residual.sum()) < 0.05


def test_models_survive_saving(trained, tmp_path):
    _, test, _, models = trained
    training.save(models["forest"], str(tmp_path / "m"))
    assert training.load(str(tmp_path / "m")).transform(test).collect() == models["forest"].transform(test).collect()


def test_voting_and_stacking(trained):
    train, test, _, _ = trained
    bases = ({"kind": "logistic"}, {"kind": "forest", "n_estimators": 3, "max_depth": 3}, {"kind": "boosted", "n_estimators": 2, "learning_rate": 0.1, "max_depth": 2})
    soft = training.train_voting(train, bases)
    single = [training.train(train, b).transform(test).select(ID, F.col("probability").alias(f"p{i}"), F.col("prediction").alias(f"y{i}"))
              for i, b in enumerate(bases)]
    joined = soft.transform(test).join(single[0], ID).join(single[1], ID).join(single[2], ID)
    gap = joined.agg(F.max(F.abs(F.col("probability") - (F.col("p0") + F.col("p1") + F.col("p2")) / 3))).first()[0]
    assert gap < 1e-9
    hard = training.train_voting(train, bases, voting="hard").transform(test)
    assert "probability" not in hard.columns
    votes = hard.join(single[0], ID).join(single[1], ID).join(single[2], ID)
    assert votes.filter(((F.col("y0") + F.col("y1") + F.col("y2")) >= 2).cast("int") != F.col("prediction")).count() == 0
    stacked = training.train_stacking(train, ID, bases, folds=3).transform(test)
    assert stacked.columns == [*test.columns, "probability", "prediction"]
    with pytest.raises(ValueError):
        training.train_voting(train, bases, voting="other")


@pytest.mark.parametrize("kind", ["logistic", "forest", "boosted"])
def test_contributions_add_up_to_the_output(trained, kind):
    _, test, _, models = trained
    explained = explain.explain(test, models[kind], ID)
    total = F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda a, b: a + b)
    output = total if kind == "forest" else 1 / (1 + F.exp(-total))
    joined = explained.join(models[kind].transform(test).select(ID, "probability"), ID)
    assert joined.count() == test.count()
    assert joined.agg(F.max(F.abs(output - F.col("probability")))).first()[0] < 1e-9


def test_shapley_batch_agrees_with_all_orders():
    """Brute force over every feature order, on leaves that test up to four features."""
    from itertools import permutations

    rng = np.random.default_rng(5)
    leaves = [([0, 2], rng.random(2)), ([1, 2, 3], rng.random(3)), ([0, 1, 2, 3], rng.random(4))]
    tables = [(np.array([f]), np.full((1, len(f)), -np.inf), np.full((1, len(f)), 0.5), s[None, :], np.array([2.0])) for f, s in leaves]
    x = rng.random((6, 4))

    def worth(row, known):
        return sum(2.0 * np.prod([float(row[f] <= 0.5) if f in known else s for f, s in zip(fs, shares)]) for fs, shares in leaves)

    orders = list(permutations(range(4)))
    want = np.zeros(x.shape)
    for i, row in enumerate(x):
        for order in orders:
            for k, f in enumerate(order):
                want[i, f] += (worth(row, order[:k + 1]) - worth(row, order[:k])) / len(orders)
    assert explain.shapley_batch(x, tables) == pytest.approx(want)


def test_explanation_views(trained):
    _, test, _, models = trained
    explained = explain.explain(test, models["logistic"], ID, sample=7).cache()
    assert explained.count() == 7
    assert explain.global_importance(explained, top=5).count() == 5
    some = explained.first()[ID]
    one = explain.explain_one(explained, ID, some).collect()
    assert len(one) == 24 and abs(one[0]["contribution"]) >= abs(one[-1]["contribution"])
    assert explain.explain_one(explained, ID, "nobody").count() == 0
    assert explain.dependence(explained, "Tenure").count() == 7


def test_importance_tables(spark, trained):
    *_, models = trained
    linear = training.feature_importance(spark, models["logistic"]).collect()
    assert [r["importance"] for r in linear] == sorted((abs(r["coefficient"]) for r in linear), reverse=True)
    forest = training.feature_importance(spark, models["forest"]).collect()
    assert sum(r["importance"] for r in forest) == pytest.approx(1.0)


def test_comparison_writes_runs(spark, folder, tmp_path):
    train, test, _ = jobs.build_features(snapshot(spark, folder), out=str(tmp_path / "features"), model_path=str(tmp_path / "pipeline"))
    table, models = jobs.compare_models(train, test, ["logistic-baseline"], str(tmp_path / "runs"))
    assert table.first()["rank"] == 1 and list(models) == ["logistic-baseline"]
    row = spark.read.parquet(str(tmp_path / "runs")).first()
    assert row["run_name"].startswith("logistic-baseline-2") and row["metrics"]["roc_auc"] == pytest.approx(table.first()["roc_auc"])
    assert {r["split"] for r in spark.read.parquet(str(tmp_path / "features")).select("split").distinct().collect()} == {"train", "test"}


@pytest.mark.parametrize("p,tier", [(0.8, "Critical"), (0.79999, "High"), (0.65, "High"), (0.45, "Medium"), (0.44999, "Low"), (None, None)])
def test_tiers(spark, p, tier):
    assert spark.range(1).select(scoring.risk_tier(F.lit(p).cast("double")).alias("t")).first()["t"] == tier


def test_responses(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.50001), ("c", 0.79996)], "CustomerID string, probability double") \
        .withColumn("prediction", scoring.decide(F.col("probability")))
    rows = scoring.responses(df, 7).collect()
    assert [(r["churn_prediction"], r["churn_probability"], r["risk_level"], r["confidence"]) for r in rows] == [
        ("No", 0.5, "Medium", 0.5), ("Yes", 0.5, "Medium", 0.5), ("Yes", 0.8, "High", 0.8)]
    assert rows[0]["model_version"] == "v7"
    assert scoring.responses(df, 7, threshold=0.5).first()["churn_prediction"] == "Yes"
    assert scoring.timed_summary(scoring.responses(df, 7))["high_risk_count"] == 1


def test_stage_log(spark):
    def event(version, stage, at, archive=True):
        return ("m", version, stage, archive, at)

    schema = "name string, version bigint, stage string, archive_existing boolean, at int"
    log = spark.createDataFrame([
        event(1, "Staging", 1, False), event(1, "Production", 2), event(2, "Staging", 3, False), event(2, "Production", 4),
        event(3, "Staging", 5, False)], schema)
    assert {r["version"]: r["stage"] for r in runs.current_stages(log).collect()} == {1: "Archived", 2: "Production", 3: "Staging"}
    kept = spark.createDataFrame([event(1, "Production", 1), event(2, "Production", 2, False)], schema)
    assert {r["stage"] for r in runs.current_stages(kept).collect()} == {"Production"}
    with pytest.raises(ValueError):
        runs.stage_event(spark, "m", 1, "Live")
    assert runs.stage_event(spark, "m", 1, "Production").first()["archive_existing"]


def test_versions(spark, tmp_path):
    table = runs.run_row(spark, "r", {"a": "b"}, {"model_type": "forest"}, {"roc_auc": 0.8}, with_time=False)
    run_id = table.first()["run_id"]
    versions = spark.createDataFrame(
        [("m", 1, "Archived", "gone", None, None, {}), ("m", 2, "Production", run_id, None, "d" * 60, {})],
        "name string, version bigint, stage string, run_id string, created timestamp, description string, tags map<string,string>")
    listed = runs.list_versions(versions, table, "m").collect()
    assert [(r["version"], r["run_name"], r["roc_auc"]) for r in listed] == [(2, "r", 0.8), (1, "unknown", None)]
    assert listed[0]["description"] == "d" * 50 + "..."
    assert runs.list_versions(versions, table, "other").count() == 0
    assert runs.version_in_stage(versions, "m", "Production").first()["version"] == 2
    tagged = runs.set_description(runs.add_tags(versions, "m", 2, {"a": 1, "b": 2}), "m", 2, "new")
    assert {r["version"]: (r["tags"], r["description"]) for r in runs.add_tags(tagged, "m", 2, {"a": 3}).collect()} == {
        1: ({}, None), 2: ({"a": "3", "b": "2"}, "new")}
    assert runs.new_version(versions, "m", run_id).first()["version"] == 3
    claims = str(tmp_path / "claims")
    with ThreadPoolExecutor(4) as writers:
        numbers = list(writers.map(lambda _: runs.new_version(versions, "m", run_id, claims=claims).first()["version"], range(8)))
    assert len(set(numbers)) == 8 and min(numbers) >= 3
    assert runs.new_version(versions, "other", run_id, claims=claims).first()["version"] == 1
    assert runs.new_version(versions, "fresh", run_id, "d", {"k": 1}).first()["tags"] == {"k": "1"}
    tags = runs.champion_tags(table).first()["champion_tags"]
    assert tags["metric_roc_auc"] == "0.8" and tags["model_type"] == "forest" and tags["champion"] == "true"


def test_customers_are_computed_once(spark, folder):
    """What the models train on is read from the written snapshot, not joined from orders and events again."""
    from catalog.models import complete_customers

    rows = complete_customers(spark, folder)
    assert rows.count() > 0 and not [f for f in rows.inputFiles() if f.endswith(("orders.parquet", "events.parquet"))]
