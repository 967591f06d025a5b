"""Evaluation queries on scorecard scores of customers and on the larger set of scored lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import LINES, SNAP, query, rounded
from catalog.profiling import _bin_sql
from ebbtide.operators import curves, evaluation, shaping
from ebbtide.schema import ID
from ebbtide.session import work_path
from ebbtide.sources import sinks
from ebbtide.sources.snapshot import scored_customers, scored_lines

CONFUSION = """
cm AS (SELECT count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
              count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp FROM {source})"""
CURVE = """
groups AS (SELECT probability AS score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM {source} GROUP BY 1),
curve AS (SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
          FROM groups WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
areas AS (SELECT sum(neg * (tp - pos / 2.0::DOUBLE)) / (CAST(max(p) AS DOUBLE) * max(n)) AS roc_auc,
                 sum(pos * (tp / CAST(tp + fp AS DOUBLE))) / max(p) AS average_precision, max(p) / CAST(max(p) + max(n) AS DOUBLE) AS positive_share FROM curve)"""


def _ratio(top, bottom):
    return f"CASE WHEN {bottom} = 0 THEN 0 ELSE ({top}) / CAST({bottom} AS DOUBLE) END"


METRICS = f"""SELECT round({_ratio('tp + tn', '(tn + fp + fn + tp)')}, 6) AS accuracy, round({_ratio('tp', '(tp + fp)')}, 6) AS precision,
  round({_ratio('tp', '(tp + fn)')}, 6) AS recall, round({_ratio('2 * tp', '(2 * tp + fp + fn)')}, 6) AS f1,
  round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS pr_auc FROM cm, areas"""
CUSTOMERS = f"WITH {SNAP}, {CONFUSION.format(source='scored')}, {CURVE.format(source='scored')}"
LINE_ITEMS = f"WITH {LINES}, {CONFUSION.format(source='lines')}, {CURVE.format(source='lines')}"


@query("metrics_of_customers", f"{CUSTOMERS} {METRICS}")
def metrics_of_customers(spark, folder):
    return rounded(evaluation.metrics(scored_customers(spark, folder)))


@query("metrics_of_lines", f"{LINE_ITEMS} {METRICS}")
def metrics_of_lines(spark, folder):
    return rounded(evaluation.metrics(scored_lines(spark, folder)))


@query("metrics_of_lines_by_ranges", f"{LINE_ITEMS} {METRICS}")
def metrics_of_lines_by_ranges(spark, folder):
    """The same numbers by way of value ranges, the form used when one task could not sort all scores."""
    return rounded(evaluation.metrics(scored_lines(spark, folder), rows_per_task=10_000))


# Lines without label, without score, and with a score that is no number, by their quantity.
HOLED = """
holed AS (
  SELECT CASE WHEN CAST(l_quantity AS INTEGER) % 13 = 0 THEN NULL ELSE label END AS label, prediction,
         CASE WHEN CAST(l_quantity AS INTEGER) % 7 = 0 THEN NULL WHEN CAST(l_quantity AS INTEGER) % 11 = 0 THEN CAST('nan' AS DOUBLE) ELSE probability END AS probability
  FROM lines),
usable AS (SELECT * FROM holed WHERE label IS NOT NULL AND probability IS NOT NULL AND NOT isnan(probability))"""
GAPS = f"WITH {LINES}, {HOLED}, {CONFUSION.format(source='usable')}, {CURVE.format(source='usable')}"
GAP_METRICS = f"""{GAPS}, measured AS ({METRICS})
SELECT *, (SELECT count(*) FROM holed) - (SELECT count(*) FROM usable) AS unscored FROM measured"""


def _holed(spark, folder):
    quantity = F.col("l_quantity").cast("int")
    score = F.when(quantity % 7 == 0, None).when(quantity % 11 == 0, float("nan")).otherwise(F.col("probability"))
    return scored_lines(spark, folder).withColumns({"label": F.when(quantity % 13 != 0, F.col("label")), "probability": score})


def _gap_metrics(df, **size):
    return rounded(evaluation.metrics(df, **size)).withColumn("unscored", curves.unscored(df).scalar())


@query("metrics_with_gaps", GAP_METRICS)
def metrics_with_gaps(spark, folder):
    """Rows without label or score are left out and counted."""
    return _gap_metrics(_holed(spark, folder))


@query("metrics_with_gaps_by_ranges", GAP_METRICS)
def metrics_with_gaps_by_ranges(spark, folder):
    return _gap_metrics(_holed(spark, folder), rows_per_task=10_000)


@query("confusion_matrix", f"""{CUSTOMERS}
SELECT 0 AS true_label, 0 AS predicted_label, tn AS value FROM cm UNION ALL SELECT 0, 1, fp FROM cm
UNION ALL SELECT 1, 0, fn FROM cm UNION ALL SELECT 1, 1, tp FROM cm""")
def confusion_matrix(spark, folder):
    return evaluation.confusion_matrix(scored_customers(spark, folder))


@query("confusion_matrix_normalized", f"""{CUSTOMERS}
SELECT 0 AS true_label, 0 AS predicted_label, round({_ratio('tn', '(tn + fp)')}, 6) AS value FROM cm
UNION ALL SELECT 0, 1, round({_ratio('fp', '(tn + fp)')}, 6) FROM cm
UNION ALL SELECT 1, 0, round({_ratio('fn', '(fn + tp)')}, 6) FROM cm UNION ALL SELECT 1, 1, round({_ratio('tp', '(fn + tp)')}, 6) FROM cm""")
def confusion_matrix_normalized(spark, folder):
    return rounded(evaluation.confusion_matrix(scored_customers(spark, folder), normalize=True))


@query("classification_report", f"""{CUSTOMERS}, c AS (
  SELECT 'No Churn' AS name, {_ratio('tn', '(tn + fn)')} AS precision, {_ratio('tn', '(tn + fp)')} AS recall, {_ratio('2 * tn', '(2 * tn + fn + fp)')} AS f1, tn + fp AS support FROM cm
  UNION ALL SELECT 'Churn', {_ratio('tp', '(tp + fp)')}, {_ratio('tp', '(tp + fn)')}, {_ratio('2 * tp', '(2 * tp + fn + fp)')}, fn + tp FROM cm)
SELECT name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM c
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM c
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM c
UNION ALL SELECT 'accuracy', round((tn + tp) / CAST(tn + fp + fn + tp AS DOUBLE), 6), round((tn + tp) / CAST(tn + fp + fn + tp AS DOUBLE), 6), round((tn + tp) / CAST(tn + fp + fn + tp AS DOUBLE), 6), tn + fp + fn + tp FROM cm""")
def classification_report(spark, folder):
    return rounded(evaluation.classification_report(scored_customers(spark, folder)))


@query("roc_points", f"""{CUSTOMERS}
SELECT score AS threshold, round(fp / CAST(n AS DOUBLE), 6) AS fpr, round(tp / CAST(p AS DOUBLE), 6) AS tpr FROM curve
UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0""")
def roc_points(spark, folder):
    points = curves.roc_points(curves.cumulative(scored_customers(spark, folder)))
    return points.select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query("roc_points_of_lines", f"""{LINE_ITEMS}
SELECT score AS threshold, round(fp / CAST(n AS DOUBLE), 6) AS fpr, round(tp / CAST(p AS DOUBLE), 6) AS tpr FROM curve
UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0""")
def roc_points_of_lines(spark, folder):
    points = curves.roc_points(curves.cumulative(scored_lines(spark, folder)))
    return points.select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query("precision_recall_points", f"""{CUSTOMERS}
SELECT score AS threshold, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(p AS DOUBLE), 6) AS recall FROM curve
UNION ALL SELECT NULL, 1.0, 0.0""")
def precision_recall_points(spark, folder):
    return rounded(curves.pr_points(curves.cumulative(scored_customers(spark, folder))))


@query("curve_areas", f"""{LINE_ITEMS}
SELECT round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision, round(positive_share, 6) AS positive_share FROM areas""")
def curve_areas(spark, folder):
    return rounded(curves.areas(curves.cumulative(scored_lines(spark, folder))))


def _calibration_sql(source):
    below = " + ".join(f"CASE WHEN probability > {i * (1.0 / 10)!r}::DOUBLE THEN 1 ELSE 0 END" for i in range(1, 10))
    return (f"SELECT {below} AS bin, count(*) AS \"rows\", round(avg(probability), 6) AS mean_predicted, "
            f"round(avg(label), 6) AS positive_share FROM {source} GROUP BY 1")


@query("calibration", f"WITH {SNAP} {_calibration_sql('scored')}")
def calibration(spark, folder):
    return rounded(evaluation.calibration(scored_customers(spark, folder)))


@query("calibration_of_lines", f"WITH {LINES} {_calibration_sql('lines')}")
def calibration_of_lines(spark, folder):
    return rounded(evaluation.calibration(scored_lines(spark, folder)))


@query("brier_score", f"""WITH {SNAP}, b AS (SELECT avg((probability - label) * (probability - label)) AS brier FROM scored)
SELECT round(brier, 6) AS brier, CASE WHEN brier < 0.1 THEN 'excellent' WHEN brier < 0.2 THEN 'good' ELSE 'poor' END AS verdict FROM b""")
def brier_score(spark, folder):
    return rounded(evaluation.brier(scored_customers(spark, folder)))


ERROR = "CASE WHEN label = 0 AND prediction = 1 THEN 'False Positive' WHEN label = 1 AND prediction = 0 THEN 'False Negative' ELSE 'Correct' END"
OUTCOME = """CASE WHEN label = 1 AND prediction = 1 THEN 'True Positive' WHEN label = 0 AND prediction = 1 THEN 'False Positive'
WHEN label = 1 AND prediction = 0 THEN 'False Negative' ELSE 'True Negative' END"""


@query("error_rows", f"""WITH {SNAP}
SELECT CustomerID, label, prediction, probability, label = prediction AS correct, {ERROR} AS error_type, {OUTCOME} AS outcome FROM scored""")
def error_rows(spark, folder):
    path = work_path(spark, "errors")
    sinks.write_table(evaluation.error_table(scored_customers(spark, folder)), path)
    return spark.read.parquet(path).select("CustomerID", "label", "prediction", "probability", "correct", "error_type", "outcome")


@query("false_positives", f"WITH {SNAP} SELECT CustomerID, probability FROM scored WHERE label = 0 AND prediction = 1")
def false_positives(spark, folder):
    errors = evaluation.error_table(scored_customers(spark, folder))
    return shaping.class_filter(errors, "False Positive").select("CustomerID", "probability")


@query("error_breakdown", f"""WITH {SNAP}
SELECT {ERROR} AS error_type, count(*) AS "rows", round(avg(probability), 6) AS mean_probability, round(avg(Tenure), 6) AS mean_Tenure,
       round(avg(MonthlyCharges), 6) AS mean_MonthlyCharges, round(avg(TotalCharges), 6) AS mean_TotalCharges FROM scored GROUP BY 1""")
def error_breakdown(spark, folder):
    return rounded(evaluation.error_breakdown(evaluation.error_table(scored_customers(spark, folder))))


def _error_histogram_sql(source):
    return (f"SELECT outcome, {_bin_sql('probability', 'lo', 'hi', 30)} AS bin, count(*) AS \"rows\" FROM ("
            f"SELECT *, min(probability) OVER (PARTITION BY outcome) AS lo, max(probability) OVER (PARTITION BY outcome) AS hi "
            f"FROM (SELECT probability, {OUTCOME} AS outcome FROM {source})) GROUP BY 1, 2")


@query("error_histogram", f"WITH {SNAP} {_error_histogram_sql('scored')}")
def error_histogram(spark, folder):
    return evaluation.error_histogram(evaluation.error_table(scored_customers(spark, folder)))


@query("error_histogram_of_lines", f"WITH {LINES} {_error_histogram_sql('lines')}")
def error_histogram_of_lines(spark, folder):
    return evaluation.error_histogram(evaluation.error_table(scored_lines(spark, folder)))


UNEVEN = [0.9, 0.01, 0.02, 0.03, 0.5, 0.45]


def _sweep_cte(source, points=None):
    # The grid of 90 thresholds from 0.01 to 0.9, as the doubles an even grid gives.
    step = (0.9 - 0.01) / 89
    points = points or [0.01 + i * step if i < 89 else 0.9 for i in range(90)]
    grid = ", ".join(f"({p!r}::DOUBLE)" for p in points)
    return f"""grid(threshold) AS (VALUES {grid}),
counted AS (SELECT threshold, count(*) FILTER (WHERE label = 0 AND probability < threshold) AS tn, count(*) FILTER (WHERE label = 0 AND probability >= threshold) AS fp,
                   count(*) FILTER (WHERE label = 1 AND probability < threshold) AS fn, count(*) FILTER (WHERE label = 1 AND probability >= threshold) AS tp
            FROM grid, {source} GROUP BY threshold),
sweep AS (SELECT *, fp * 50.0::DOUBLE + fn * 600.0::DOUBLE AS cost, {_ratio('tp', '(tp + fp)')} AS precision, {_ratio('tp', '(tp + fn)')} AS recall FROM counted)"""


SWEEP = "SELECT threshold, tn, fp, fn, tp, cost, round(precision, 6) AS precision, round(recall, 6) AS recall FROM sweep"


def _rounded_rates(df):
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query("threshold_sweep", f"WITH {SNAP}, {_sweep_cte('scored')} {SWEEP}")
def threshold_sweep(spark, folder):
    return _rounded_rates(evaluation.threshold_sweep(scored_customers(spark, folder)))


@query("threshold_sweep_of_lines", f"WITH {LINES}, {_sweep_cte('lines')} {SWEEP}")
def threshold_sweep_of_lines(spark, folder):
    return _rounded_rates(evaluation.threshold_sweep(scored_lines(spark, folder)))


@query("threshold_sweep_uneven", f"WITH {LINES}, {HOLED}, scored_only AS (SELECT label, CASE WHEN isnan(probability) THEN NULL ELSE probability END AS p FROM holed), "
       f"filled AS (SELECT label, coalesce(p, -1.0::DOUBLE) AS probability FROM scored_only), {_sweep_cte('filled', UNEVEN)} {SWEEP}")
def threshold_sweep_uneven(spark, folder):
    """Thresholds at any distance; lines without score are never flagged."""
    return _rounded_rates(evaluation.threshold_sweep(_holed(spark, folder), thresholds=UNEVEN))


@query("optimal_threshold", f"WITH {SNAP}, {_sweep_cte('scored')} {SWEEP} ORDER BY cost, threshold LIMIT 1")
def optimal_threshold(spark, folder):
    return _rounded_rates(evaluation.optimal_threshold(evaluation.threshold_sweep(scored_customers(spark, folder))))


@query("optimal_threshold_within_budget", f"""WITH {SNAP}, {_sweep_cte('scored')} {SWEEP}
WHERE tp + fp <= 0.6::DOUBLE * (tn + fp + fn + tp) ORDER BY cost, threshold LIMIT 1""")
def optimal_threshold_within_budget(spark, folder):
    sweep = evaluation.threshold_sweep(scored_customers(spark, folder))
    return _rounded_rates(evaluation.optimal_threshold(sweep, max_flagged=0.6))


@query("threshold_record", f"""WITH {SNAP}, {_sweep_cte('scored')}
SELECT threshold AS optimal_threshold, 0.5::DOUBLE AS default_threshold, CAST(50 AS BIGINT) AS cost_fp, CAST(600 AS BIGINT) AS cost_fn, threshold, cost AS total_cost,
       tn AS true_negatives, fp AS false_positives, fn AS false_negatives, tp AS true_positives, round(precision, 6) AS precision, round(recall, 6) AS recall
FROM sweep ORDER BY cost, threshold LIMIT 1""")
def threshold_record(spark, folder):
    path = work_path(spark, "threshold")
    best = evaluation.optimal_threshold(evaluation.threshold_sweep(scored_customers(spark, folder)))
    sinks.write_record(evaluation.threshold_record(best), path)
    return _rounded_rates(spark.read.json(path))


@query("score_extremes", f"""WITH {SNAP}
SELECT (SELECT CustomerID FROM scored ORDER BY probability DESC, CustomerID LIMIT 1) AS highest,
       (SELECT CustomerID FROM scored ORDER BY probability, CustomerID LIMIT 1) AS lowest""")
def score_extremes(spark, folder):
    return evaluation.score_extremes(scored_customers(spark, folder), ID)


GATE = f"""gated AS (SELECT {_ratio('tp + tn', '(tn + fp + fn + tp)')} AS accuracy, {_ratio('tp', '(tp + fp)')} AS precision,
                       {_ratio('tp', '(tp + fn)')} AS recall, roc_auc FROM cm, areas)"""


@query("performance_gate", f"""{CUSTOMERS}, {GATE}
SELECT 'roc_auc' AS criterion, round(roc_auc, 6) AS value, 0.8::DOUBLE AS threshold, roc_auc >= 0.8 AS passed FROM gated
UNION ALL SELECT 'recall', round(recall, 6), 0.7::DOUBLE, recall >= 0.7 FROM gated
UNION ALL SELECT 'accuracy', round(accuracy, 6), NULL, true FROM gated""")
def performance_gate(spark, folder):
    return rounded(evaluation.performance_gate(evaluation.metrics(scored_customers(spark, folder))))


@query("production_gate", f"""{CUSTOMERS}, {GATE}
SELECT 'roc_auc' AS criterion, round(roc_auc, 6) AS value, 0.85::DOUBLE AS threshold, roc_auc >= 0.85 AS passed FROM gated
UNION ALL SELECT 'precision', round(precision, 6), 0.75::DOUBLE, precision >= 0.75 FROM gated
UNION ALL SELECT 'accuracy', round(accuracy, 6), NULL, true FROM gated""")
def production_gate(spark, folder):
    return rounded(evaluation.performance_gate(
        evaluation.metrics(scored_customers(spark, folder)), evaluation.GATES["production"]))


@query("staging_gate", f"""{CUSTOMERS}, {GATE}
SELECT 'roc_auc' AS criterion, round(roc_auc, 6) AS value, 0.8::DOUBLE AS threshold, roc_auc >= 0.8 AS passed FROM gated
UNION ALL SELECT 'accuracy', round(accuracy, 6), NULL, true FROM gated""")
def staging_gate(spark, folder):
    return rounded(evaluation.performance_gate(evaluation.metrics(scored_customers(spark, folder)), evaluation.GATES["staging"]))


def _sane(source):
    """CTE ``s``: what the sanity gate looks at."""
    return f"""s AS (
  SELECT count(*) FILTER (WHERE probability IS NULL OR isnan(probability)) AS bad,
         count(*) FILTER (WHERE NOT isnan(probability) AND (probability < 0 OR probability > 1)) AS outside,
         avg(probability) FILTER (WHERE NOT isnan(probability)) AS m, stddev_pop(probability) FILTER (WHERE NOT isnan(probability)) AS d
  FROM {source})"""


SANE = """SELECT 'no_nan' AS criterion, CAST(bad AS DOUBLE) AS value, bad = 0 AS ok, false AS warning_only FROM s
UNION ALL SELECT 'in_range', CAST(outside AS DOUBLE), outside = 0, false FROM s
UNION ALL SELECT 'mean', round(m, 6), m BETWEEN 0.1 AND 0.9, true FROM s
UNION ALL SELECT 'spread', round(d, 6), d >= 0.05, true FROM s"""


@query("sanity_gate", f"WITH {SNAP}, {_sane('scored')} {SANE}")
def sanity_gate(spark, folder):
    return rounded(evaluation.sanity_gate(scored_customers(spark, folder)))


@query("sanity_gate_with_gaps", f"""WITH {LINES}, {HOLED}, shifted AS (
  SELECT CASE WHEN label = 1 AND prediction = 1 THEN probability + 0.25 ELSE probability END AS probability FROM holed), {_sane('shifted')} {SANE}""")
def sanity_gate_with_gaps(spark, folder):
    """Scores missing, not numbers, and above one are counted and refused."""
    p = F.col("probability")
    shifted = F.when((F.col("label") == 1) & (F.col("prediction") == 1), p + 0.25).otherwise(p)
    return rounded(evaluation.sanity_gate(_holed(spark, folder).withColumn("probability", shifted)))


@query("all_gates", f"""{CUSTOMERS}, {GATE}, {_sane('scored')}
SELECT signature, bad = 0 AND outside = 0 AS sanity, roc_auc >= 0.8 AND recall >= 0.7 AS performance,
       signature AND bad = 0 AND outside = 0 AND roc_auc >= 0.8 AND recall >= 0.7 AS promote
FROM gated, s, (SELECT count(*) = 2 AS signature FROM (DESCRIBE WITH {SNAP} SELECT * FROM scored) WHERE column_name IN ('prediction', 'probability'))""")
def all_gates(spark, folder):
    df = scored_customers(spark, folder)
    return evaluation.all_gates(evaluation.performance_gate(evaluation.metrics(df)), evaluation.sanity_gate(df),
                                evaluation.signature_gate(df))
