import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import curves, evaluation
from ebbtide.plans import jobs


@pytest.fixture(scope="module")
def hand(spark):
    rows = [(0, 1, 0.9), (1, 0, 0.8), (2, 1, 0.7), (3, 0, 0.4), (4, 1, 0.3), (5, 0, 0.1)]
    return spark.createDataFrame(rows, "id long, label int, probability double").withColumn(
        "prediction", (F.col("probability") > 0.5).cast("int"))


@pytest.fixture(scope="module")
def scored(spark):
    """Scores with many ties: two decimals, and a third of the rows on one value."""
    rng = np.random.default_rng(3)
    p = np.where(rng.random(3000) < 1 / 3, 0.62, rng.random(3000).round(2))
    y = (rng.random(3000) < p).astype(int)
    return spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "id long, label int, probability double") \
        .withColumn("prediction", (F.col("probability") > 0.5).cast("int")).cache()


def _brute_auc(data):
    pos, neg = data[data.label == 1].probability.to_numpy(), data[data.label == 0].probability.to_numpy()
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


@pytest.mark.parametrize("rows_per_task", [1_000_000, 2])
def test_hand_metrics(hand, rows_per_task):
    m = evaluation.metrics(hand, rows_per_task).first()
    assert (m["roc_auc"], m["pr_auc"]) == pytest.approx((0.666667, 0.755556), abs=1e-6)


@pytest.mark.parametrize("rows_per_task", [1_000_000, 40])
def test_auc_with_ties_agrees_with_all_pairs(scored, rows_per_task):
    m = evaluation.metrics(scored, rows_per_task).first()
    data = scored.toPandas()
    assert m["roc_auc"] == pytest.approx(_brute_auc(data), abs=1e-12)
    assert m["accuracy"] == pytest.approx((data.label == data.prediction).mean())
    ap, seen, total = 0.0, 0, data.label.sum()
    for t in sorted(data.probability.unique(), reverse=True):
        at = data[data.probability >= t]
        ap += (at.label.sum() - seen) / total * at.label.mean()
        seen = at.label.sum()
    assert m["pr_auc"] == pytest.approx(ap)


def test_published_counts_give_the_published_rates(spark):
    counts = spark.createDataFrame([(2532, 948, 1686, 4834)], "tn long, fp long, fn long, tp long")
    row = evaluation.rates(counts).first()
    assert [round(row[c], 4) for c in ("accuracy", "precision", "recall", "f1")] == [0.7366, 0.8360, 0.7414, 0.7859]
    assert row["fp"] * evaluation.COST_FP + row["fn"] * evaluation.COST_FN == 1_059_000


def test_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0.1, 0), (0, 0.2, 0)], "label int, probability double, prediction int")
    row = evaluation.metrics(df).first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"], row["roc_auc"]) == (1.0, 0.0, 0.0, 0.0, None)


def test_curves(hand):
    points = curves.roc_points(curves.cumulative(hand)).orderBy(F.desc("threshold")).collect()
    assert [(round(r["fpr"], 4), round(r["tpr"], 4)) for r in points] == [
        (0, 0), (0, .3333), (.3333, .3333), (.3333, .6667), (.6667, .6667), (.6667, 1), (1, 1)]
    pr = curves.pr_points(curves.cumulative(hand)).collect()
    assert len(pr) == 7 and (1.0, 0.0) in [(r["precision"], r["recall"]) for r in pr]


def test_sweep_agrees_with_ninety_scans(scored):
    data = scored.toPandas()
    rows = evaluation.threshold_sweep(scored).orderBy("threshold").collect()
    assert len(rows) == 90
    for r in rows:
        yes = data.probability >= r["threshold"]
        assert (r["fp"], r["fn"], r["tp"]) == ((yes & (data.label == 0)).sum(), (~yes & (data.label == 1)).sum(), (yes & (data.label == 1)).sum())
        assert r["tn"] + r["fp"] + r["fn"] + r["tp"] == 3000
    best = evaluation.optimal_threshold(evaluation.threshold_sweep(scored)).first()
    assert (best["cost"], best["threshold"]) == min((r["cost"], r["threshold"]) for r in rows)
    capped = evaluation.optimal_threshold(evaluation.threshold_sweep(scored), max_flagged=0.3).first()
    assert capped["tp"] + capped["fp"] <= 900 and capped["cost"] >= best["cost"]


def test_calibration_bins_include_their_upper_edge(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 0.1), (1, 0.1000001), (1, 1.0)], "label int, probability double")
    rows = {r["bin"]: r["rows"] for r in evaluation.calibration(df).collect()}
    assert rows == {0: 2, 1: 1, 9: 1}


def test_report_and_matrix(hand):
    report = {r["name"]: r for r in evaluation.classification_report(hand).collect()}
    assert report["Churn"]["support"] == 3 and report["macro avg"]["f1"] == pytest.approx(2 / 3)
    shares = evaluation.confusion_matrix(hand, normalize=True).collect()
    assert sum(r["value"] for r in shares) == pytest.approx(2.0)


def test_errors(hand):
    errors = evaluation.error_table(hand)
    assert {r["error_type"]: r["rows"] for r in evaluation.error_breakdown(errors).collect()} == {
        "Correct": 4, "False Positive": 1, "False Negative": 1}
    assert sum(r["rows"] for r in evaluation.error_histogram(errors).collect()) == 6


def test_brier_verdicts(spark):
    for p, verdict in ((0.9, "excellent"), (0.65, "good"), (0.4, "poor")):
        assert evaluation.brier(spark.createDataFrame([(1, p)], "label int, probability double")).first()["verdict"] == verdict


def test_gates(hand, spark):
    signature = evaluation.signature_gate(hand)
    row = evaluation.all_gates(evaluation.performance_gate(evaluation.metrics(hand)), evaluation.sanity_gate(hand), signature).first()
    assert (row["signature"], row["sanity"], row["performance"], row["promote"]) == (True, True, False, False)
    lenient = evaluation.performance_gate(evaluation.metrics(hand), {"roc_auc": 0.6})
    assert evaluation.all_gates(lenient, evaluation.sanity_gate(hand), signature).first()["promote"]


def test_sanity_finds_nan_and_range(spark):
    df = spark.createDataFrame([(float("nan"),), (1.5,), (0.5,)], "probability double")
    assert {r["criterion"]: r["ok"] for r in evaluation.sanity_gate(df).collect() if not r["warning_only"]} == {
        "no_nan": False, "in_range": False}


def test_champion_tables(spark, trained, tmp_path):
    _, test, _, models = trained
    jobs.evaluate_champion(test.withColumnRenamed("label", "Churn"), models["boosted"], str(tmp_path), explained_rows=10)
    for name in ("metrics", "roc", "calibration", "errors", "threshold_sweep", "contributions", "importance"):
        assert spark.read.parquet(str(tmp_path / name)).count() > 0, name
    assert spark.read.json(str(tmp_path / "optimal_threshold")).first()["cost_fn"] == 600
