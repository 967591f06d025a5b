"""Classification metrics, calibration, error analysis, threshold costs, gates.

Input rows carry ``label`` (0/1), ``probability`` and ``prediction`` next to their
features, so nothing ever needs aligning by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.functions.scalars import grid, grid_rank
from ebbtide.operators import curves
from ebbtide.operators.profile import histogram

# The threshold sweep and its default costs.
SWEEP = grid(0.01, 0.9, 90)
COST_FP, COST_FN = 50, 600


def cells(label="label", prediction="prediction") -> list[Column]:
    """The four confusion counts as aggregates."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    return [F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"),
            F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp")]


def _ratio(top: Column, bottom: Column) -> Column:
    """Zero when the denominator is zero."""
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def confusion(df: DataFrame) -> DataFrame:
    """One row: tn, fp, fn, tp."""
    return df.agg(*cells())


def confusion_matrix(df: DataFrame, normalize: bool = False) -> DataFrame:
    """Four rows (true_label, predicted_label, value), always all four."""
    c = {n: F.col(n) for n in ("tn", "fp", "fn", "tp")}
    rows = [(0, 0, c["tn"], c["tn"] + c["fp"]), (0, 1, c["fp"], c["tn"] + c["fp"]),
            (1, 0, c["fn"], c["fn"] + c["tp"]), (1, 1, c["tp"], c["fn"] + c["tp"])]
    rows = [F.struct(F.lit(y).alias("true_label"), F.lit(p).alias("predicted_label"),
                      (_ratio(v, t) if normalize else v).alias("value")) for y, p, v, t in rows]
    return confusion(df).select(F.inline(F.array(*rows)))


def rates(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall and f1 next to tn, fp, fn, tp."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.select(
        "*",
        _ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def metrics(df: DataFrame, rows_per_task: int = curves.ROWS_PER_TASK) -> DataFrame:
    """One row: accuracy, precision, recall, f1, roc_auc, pr_auc (average precision).

    Rows without label or score (NULL or NaN) are left out of all six; ``curves.unscored`` counts them.
    """
    # The confusion counts ride along with the score groups: one scan for everything.
    names = ("tn", "fp", "fn", "tp")
    counted = [F.count_if((F.col("label") == int(n in ("fn", "tp"))) & (F.col("prediction") == int(n in ("fp", "tp"))))
               .alias(f"_{n}") for n in names]
    curve = curves.cumulative(df, rows_per_task=rows_per_task, also=counted)
    row = curves.areas(curve, also=[f"_{n}" for n in names])
    return rates(row.withColumnsRenamed({f"_{n}": n for n in names})).select(
        "accuracy", "precision", "recall", "f1", "roc_auc", F.col("average_precision").alias("pr_auc"))


def classification_report(df: DataFrame) -> DataFrame:
    """Precision, recall, f1 and support per class, then macro and weighted averages and accuracy."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n0, n1 = tn + fp, fn + tp
    by_class = {
        "No Churn": (_ratio(tn, tn + fn), _ratio(tn, n0), _ratio(2 * tn, 2 * tn + fn + fp), n0),
        "Churn": (_ratio(tp, tp + fp), _ratio(tp, n1), _ratio(2 * tp, 2 * tp + fp + fn), n1),
    }
    a, b = by_class.values()
    total = n0 + n1
    accuracy = _ratio(tn + tp, total)
    rows = {
        **by_class,
        "accuracy": (accuracy, accuracy, accuracy, total),
        "macro avg": tuple((x + y) / 2 for x, y in zip(a[:3], b[:3])) + (total,),
        "weighted avg": tuple(_ratio(x * n0 + y * n1, total) for x, y in zip(a[:3], b[:3])) + (total,),
    }
    structs = [F.struct(F.lit(name).alias("name"), p.alias("precision"), r.alias("recall"), f.alias("f1"), s.alias("support"))
               for name, (p, r, f, s) in rows.items()]
    return confusion(df).select(F.inline(F.array(*structs)))


def calibration(df: DataFrame, bins: int = 10, label: str = "label", score: str = "probability") -> DataFrame:
    """Mean score and positive share of each non-empty uniform bin; bins include their upper edge."""
    p = F.col(score)
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    below = sum((p > e).cast("int") for e in edges)  # interior edges under the score
    return df.withColumn("bin", below.cast("int")).groupBy("bin").agg(
        F.count("*").alias("rows"), F.avg(p).alias("mean_predicted"), F.avg(F.col(label)).alias("positive_share"))


def brier(df: DataFrame, label: str = "label", score: str = "probability") -> DataFrame:
    difference = F.col(score) - F.col(label)
    b = F.col("brier")
    return df.agg(F.avg(difference * difference).alias("brier")).withColumn(
        "verdict", F.when(b < 0.1, "excellent").when(b < 0.2, "good").otherwise("poor"))


def error_table(df: DataFrame) -> DataFrame:
    """Rows with ``correct``, ``error_type`` (Correct, False Positive, False Negative) and ``outcome`` (TN, FP, FN, TP names)."""
    y, p = F.col("label"), F.col("prediction")
    return df.withColumns({
        "correct": y == p,
        "error_type": F.when((y == 0) & (p == 1), "False Positive").when((y == 1) & (p == 0), "False Negative").otherwise("Correct"),
        "outcome": F.when((y == 1) & (p == 1), "True Positive").when((y == 0) & (p == 1), "False Positive")
        .when((y == 1) & (p == 0), "False Negative").otherwise("True Negative"),
    })


def error_breakdown(errors: DataFrame, columns=("Tenure", "MonthlyCharges", "TotalCharges")) -> DataFrame:
    """Rows, mean score and mean of some features per error type."""
    present = [c for c in columns if c in errors.columns]
    return errors.groupBy("error_type").agg(
        F.count("*").alias("rows"), F.avg("probability").alias("mean_probability"),
        *[F.avg(c).alias(f"mean_{c}") for c in present])


def error_histogram(errors: DataFrame, bins: int = 30) -> DataFrame:
    """Score histogram per outcome, over the score range of each outcome."""
    return histogram(errors, ["probability"], bins, by=("outcome",)).drop("column")


def threshold_sweep(df: DataFrame, cost_fp: float = COST_FP, cost_fn: float = COST_FN,
                    thresholds: list[float] | None = None, label: str = "label", score: str = "probability") -> DataFrame:
    """Confusion counts and cost of predicting positive at or above each threshold.

    One pass: each score falls into the gap between two thresholds, so the data shrinks
    to one row per gap before anything is summed over thresholds. Thresholds may be any
    finite numbers; they come back in rising order. A row without score is never flagged.
    """
    thresholds = SWEEP if thresholds is None else sorted({float(t) for t in thresholds})
    gaps = df.groupBy(grid_rank(F.col(score), thresholds).alias("gap")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    spark = df.sparkSession
    every_gap = spark.range(0, len(thresholds) + 1, 1, 1).select(F.col("id").alias("gap")).join(gaps, "gap", "left").na.fill(0)
    down = Window.orderBy(F.desc("gap")).rowsBetween(Window.unboundedPreceding, 0)  # 91 rows
    whole = Window.orderBy(F.desc("gap")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = every_gap.select(
        "gap", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"),
        F.sum("pos").over(whole).alias("_p"), F.sum("neg").over(whole).alias("_n"))
    tn, fn = F.col("_n") - F.col("fp"), F.col("_p") - F.col("tp")
    return sums.filter("gap > 0").select(
        F.get(F.array(*map(F.lit, thresholds)), (F.col("gap") - 1).cast("int")).alias("threshold"),
        tn.alias("tn"), "fp", fn.alias("fn"), "tp",
        (F.col("fp") * float(cost_fp) + fn * float(cost_fn)).alias("cost"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _ratio(F.col("tp"), F.col("_p")).alias("recall"),
    )


def optimal_threshold(sweep: DataFrame, max_flagged: Column | float | None = None) -> DataFrame:
    """The cheapest threshold, the lowest one on ties.

    ``max_flagged`` bounds the share of rows flagged positive (a campaign budget).
    """
    if max_flagged is not None:
        flagged, rows = F.col("tp") + F.col("fp"), F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
        sweep = sweep.filter(flagged <= max_flagged * rows)
    return sweep.orderBy("cost", "threshold").limit(1)


def threshold_record(best: DataFrame, cost_fp: float = COST_FP, cost_fn: float = COST_FN) -> DataFrame:
    """The chosen threshold with its costs, ready to be written as one JSON object."""
    return best.select(
        F.col("threshold").alias("optimal_threshold"), F.lit(0.5).alias("default_threshold"),
        F.lit(cost_fp).alias("cost_fp"), F.lit(cost_fn).alias("cost_fn"), "threshold",
        F.col("cost").alias("total_cost"), F.col("tn").alias("true_negatives"), F.col("fp").alias("false_positives"),
        F.col("fn").alias("false_negatives"), F.col("tp").alias("true_positives"), "precision", "recall")


def score_extremes(df: DataFrame, key: str, score: str = "probability") -> DataFrame:
    """Ids with the highest and the lowest score; the smallest id on ties."""
    return df.agg(
        F.min(F.struct((-F.col(score)).alias("s"), F.col(key).alias("id")))["id"].alias("highest"),
        F.min(F.struct(F.col(score).alias("s"), F.col(key).alias("id")))["id"].alias("lowest"))


# Gate thresholds by rule set.
GATES = {
    "default": {"roc_auc": 0.80, "recall": 0.70},
    "staging": {"roc_auc": 0.80},
    "production": {"roc_auc": 0.85, "precision": 0.75},
}


def performance_gate(measured: DataFrame, rules: dict[str, float] | None = None) -> DataFrame:
    """One row per criterion; accuracy is listed for information and always passes."""
    rules = rules or GATES["default"]
    criteria = [F.struct(F.lit(m).alias("criterion"), F.col(m).alias("value"), F.lit(float(t)).alias("threshold"),
                      F.coalesce(F.col(m) >= t, F.lit(False)).alias("passed")) for m, t in rules.items()]
    criteria.append(F.struct(F.lit("accuracy").alias("criterion"), F.col("accuracy").alias("value"),
                          F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("passed")))
    return measured.select(F.inline(F.array(*criteria)))


def sanity_gate(df: DataFrame, score: str = "probability") -> DataFrame:
    """NaN and range failures; mean and spread warnings."""
    p = F.col(score)
    wide = df.agg(
        F.count_if(p.isNull() | F.isnan(p)).alias("bad"), F.count_if((p < 0) | ((p > 1) & ~F.isnan(p))).alias("outside"),
        F.avg(F.when(~F.isnan(p), p)).alias("mean"), F.stddev_pop(F.when(~F.isnan(p), p)).alias("std"))

    def row(name, value, ok, warning):
        return F.struct(F.lit(name).alias("criterion"), value.cast("double").alias("value"),
                        F.coalesce(ok, F.lit(False)).alias("ok"), F.lit(warning).alias("warning_only"))

    return wide.select(F.inline(F.array(
        row("no_nan", F.col("bad"), F.col("bad") == 0, False),
        row("in_range", F.col("outside"), F.col("outside") == 0, False),
        row("mean", F.col("mean"), F.col("mean").between(0.1, 0.9), True),
        row("spread", F.col("std"), F.col("std") >= 0.05, True),
    )))


def signature_gate(df: DataFrame) -> DataFrame:
    """Does the scored frame offer a class and a probability (schema only)."""
    spark = df.sparkSession
    checks = [F.struct(F.lit(c).alias("criterion"), F.lit(c in df.columns).alias("passed")) for c in ("prediction", "probability")]
    return spark.range(1).select(F.inline(F.array(*checks)))


def all_gates(performance: DataFrame, sanity: DataFrame, signature: DataFrame) -> DataFrame:
    """One row: each gate and whether the model may be promoted."""
    row = performance.agg(F.bool_and("passed").alias("performance"))
    sane = sanity.agg(F.bool_and(F.col("ok") | F.col("warning_only"))).scalar()
    signed = signature.agg(F.bool_and("passed")).scalar()
    return row.select(signed.alias("signature"), sane.alias("sanity"), "performance").withColumn(
        "promote", F.col("signature") & F.col("sanity") & F.col("performance"))
