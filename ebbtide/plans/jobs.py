"""End-to-end jobs: validate, build features, train and compare, evaluate, report."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.functions import scorecard
from ebbtide.operators import checks, curves, evaluation, explain, runs, scoring, split, training
from ebbtide.operators import transformers as tf
from ebbtide.schema import ID, TARGET, require_columns
from ebbtide.session import work_path
from ebbtide.sources import files, sinks


def validate_file(spark: SparkSession, path: str, suite: list[checks.Check] | None = None) -> DataFrame:
    """Check a snapshot CSV. A missing file or a failed critical check raises; otherwise the statistics come back."""
    suite = suite or checks.raw_data_suite()
    header = files.csv_header(spark, path)
    wanted = next((c.args["column_list"] for c in suite if c.kind == "columns"), None)
    # Cells stay text, so a cell of the wrong type fails its type check instead of turning into NULL.
    text = files.read_text_snapshot(spark, path) if header == wanted else spark.read.option("header", True).csv(path)
    rows = checks.validate(text, suite)
    return checks.summarize(spark.createDataFrame(rows, checks.RESULT))


def risk_report(df: DataFrame) -> DataFrame:
    """Customers, mean score, churn rate and engineered flags per contract and risk tier."""
    high_risk = tf.HighRisk().fit(df)
    for stage in (tf.TenureBucketer(), tf.PricePerService(), high_risk, tf.ContractTenureMismatch(), tf.FinancialStress()):
        df = stage.transform(df)
    scored = df.withColumn("probability", F.round(scorecard.probability(), 6))
    return scored.groupBy("ContractType", scoring.risk_tier(F.col("probability")).alias("risk_level")).agg(
        F.count("*").alias("customers"),
        F.avg("probability").alias("mean_probability"),
        F.avg((F.col(TARGET) == "Yes").cast("int")).alias("churn_rate"),
        F.sum("IsHighRisk").alias("high_risk_customers"),
        F.sum("ContractTenureMismatch").alias("mismatched"),
        F.avg("FinancialStress").alias("mean_stress"),
    )


def build_features(df: DataFrame, out: str | None = None, test_size: float = 0.2, seed: int = 42, config: dict | None = None,
                   model_path: str | None = None, fmt: str = "parquet") -> tuple[DataFrame, DataFrame, tf.FeatureEngineerModel]:
    """Stratified split, fit on the training part, transform both, write tables and pipeline.

    The rows are computed once and written; the split, the fit and the transformation read that table.
    """
    require_columns(df, [ID, TARGET])
    rows = work_path(df.sparkSession, "rows")
    df.write.parquet(rows)
    df = df.sparkSession.read.schema(df.schema).parquet(rows)
    marked = split.stratified_split(df, ID, TARGET, test_size, seed)
    model = tf.FeatureEngineer(config, keep=(ID, "split")).fit(marked.filter("split = 'train'"))
    features = model.transform(marked)
    if out:
        # One scan writes both parts; whatever follows reads the written table.
        sinks.write_table(features, out, fmt, ["split"])
        reader = features.sparkSession.read.schema(features.schema)
        features = (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(out)
    if model_path:
        model.write().overwrite().save(model_path)
    return (*split.train_test(features), model)


def compare_models(train: DataFrame, test: DataFrame, profiles: list[str], runs_path: str | None = None) -> tuple[DataFrame, dict]:
    """Train each profile, evaluate it on the test rows, rank the runs by ROC-AUC.

    Returns the ranked table and the trained models by run name. With ``runs_path`` each
    run is appended to the run table.
    """
    spark = train.sparkSession
    labelled = training.as_training(train).persist(StorageLevel.MEMORY_AND_DISK)
    held_out = training.as_training(test).persist(StorageLevel.MEMORY_AND_DISK)
    results = []
    try:
        models = dict(zip(profiles, training.train_many(labelled, profiles)))
        for name in profiles:
            settings = training.profile_settings(name)
            measured = evaluation.metrics(models[name].transform(held_out)).first().asDict()
            results.append((name, training.MODEL_TYPES[settings["kind"]], *[measured[m] for m in (
                "roc_auc", "accuracy", "precision", "recall", "f1")]))
            if runs_path:
                runs.append_run(runs.run_row(spark, name, {"model_type": settings["kind"], "stage": "experimentation"},
                                             settings, measured), runs_path)
    finally:
        labelled.unpersist()
        held_out.unpersist()
    table = spark.createDataFrame(
        results, "run_name string, model_type string, roc_auc double, accuracy double, precision double, recall double, f1 double")
    return runs.leaderboard(table), models


def evaluate_champion(test: DataFrame, model: PipelineModel, out: str, key: str = ID, explained_rows: int | None = None,
                      bins: int = 10) -> None:
    """Write every evaluation table of one model below ``out``. The scored rows are computed once."""
    scored = model.transform(training.as_training(test)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        curve = curves.cumulative(scored)
        errors = evaluation.error_table(scored)
        sweep = evaluation.threshold_sweep(scored)
        tables = {
            "metrics": evaluation.metrics(scored),
            "report": evaluation.classification_report(scored),
            "confusion": evaluation.confusion_matrix(scored),
            "confusion_normalized": evaluation.confusion_matrix(scored, normalize=True),
            "roc": curves.roc_points(curve),
            "precision_recall": curves.pr_points(curve),
            "calibration": evaluation.calibration(scored, bins),
            "brier": evaluation.brier(scored),
            "errors": errors,
            "error_breakdown": evaluation.error_breakdown(errors),
            "error_histogram": evaluation.error_histogram(errors),
            "threshold_sweep": sweep,
            "extremes": evaluation.score_extremes(scored, key),
        }
        explained = explain.explain(scored, model, key, sample=explained_rows).persist()
        tables["contributions"] = explain.long_contributions(explained, key)
        tables["importance"] = explain.global_importance(explained)
        for name, table in tables.items():
            sinks.write_table(table, f"{out}/{name}")
        best = evaluation.optimal_threshold(sweep)
        sinks.write_record(evaluation.threshold_record(best), f"{out}/optimal_threshold")
        explained.unpersist()
    finally:
        scored.unpersist()


def gate(test: DataFrame, model: PipelineModel, rules: dict[str, float] | None = None) -> DataFrame:
    """One row: signature, sanity and performance gates, and whether to promote."""
    scored = model.transform(training.as_training(test))
    return evaluation.all_gates(
        evaluation.performance_gate(evaluation.metrics(scored), rules),
        evaluation.sanity_gate(scored), evaluation.signature_gate(scored))


