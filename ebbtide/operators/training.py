"""Training: logistic regression (MLlib), forests, boosted trees, voting and stacking.

All trees of a call, members and folds alike, are grown over one binned table (``trees``).
Every trained model is a ``PipelineModel`` from feature columns to ``probability`` and
``prediction``, so all kinds score, save and load the same way.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.operators import trees
from ebbtide.operators.profile import class_balance
from ebbtide.operators.transformers import Stage
from ebbtide.schema import FEATURES
from ebbtide.session import work_path

SEED = 42
WEIGHT = "_weight"
VECTOR = "_features"
MAX_DEPTH = 30      # a level is a pass over the rows; "unlimited" means this
MAX_BINS = {"forest": trees.MAX_BINS, "boosted": trees.MAX_BINS}
FOLDS = 5
# Rows of a training partition. Sums are exact and draws go by the rows' values, so models do not depend on it.
ROWS_PER_PARTITION = 50_000
# Up to so many rows (about 170 MB, binned) go to one task for each fit, in pieces: a job for every step would take longer than the step.
ROWS_OF_ONE_TASK = 5_000_000

# The hyper-parameters of the compared runs.
PROFILES = {
    "logistic-baseline": {"kind": "logistic", "C": 1.0, "max_iter": 1000},
    "rf-default": {"kind": "forest", "n_estimators": 100},
    "rf-deep": {"kind": "forest", "n_estimators": 200, "max_depth": 20, "min_split": 5},
    "rf-forest": {"kind": "forest", "n_estimators": 300, "max_depth": 15},
    "xgb-default": {"kind": "boosted", "n_estimators": 100, "learning_rate": 0.1, "max_depth": 6, "min_child_weight": 1,
                    "reg_lambda": 1.0, "weights": "positive_ratio"},
    "xgb-conservative": {"kind": "boosted", "n_estimators": 200, "learning_rate": 0.05, "max_depth": 4,
                         "min_child_weight": 3, "gamma": 0.1, "subsample": 0.8, "colsample": 0.8, "reg_alpha": 0.1,
                         "reg_lambda": 1.0, "weights": "positive_ratio"},
    "xgb-aggressive": {"kind": "boosted", "n_estimators": 150, "learning_rate": 0.1, "max_depth": 8, "min_child_weight": 1,
                       "subsample": 0.9, "colsample": 0.9, "reg_lambda": 1.0, "weights": "positive_ratio"},
    "lgbm-default": {"kind": "boosted", "n_estimators": 100, "learning_rate": 0.1, "num_leaves": 31, "min_instances": 20,
                     "min_child_weight": 0.001},
    "lgbm-tuned": {"kind": "boosted", "n_estimators": 200, "learning_rate": 0.05, "num_leaves": 31, "max_depth": 7,
                   "min_instances": 30, "min_child_weight": 0.001, "subsample": 0.8, "colsample": 0.8, "reg_alpha": 0.1, "reg_lambda": 0.1},
}
MODEL_TYPES = {"logistic": "LogisticRegression", "forest": "RandomForest", "boosted": "BoostedTrees"}
# The three base models of the voting and stacking ensembles.
ENSEMBLE = ("rf-forest", "xgb-conservative", "lgbm-tuned")


class ScoreColumns(Stage):
    """Probability vectors -> one ``probability`` (their mean) and ``prediction`` (above a half)."""

    def __init__(self, vectors=(), drop=()):
        super().__init__(vectors=list(vectors), drop=list(drop))

    def _transform(self, df):
        shares = [vector_to_array(F.col(v))[1] for v in self["vectors"]]
        mean = sum(shares[1:], shares[0]) / len(shares)
        return df.withColumn("probability", mean).withColumn(
            "prediction", (F.col("probability") > 0.5).cast("int")).drop(*self["vectors"], *self["drop"])


class MajorityVote(Stage):
    """Class predictions -> the majority class; ties go to 0. There is no probability."""

    def __init__(self, votes=(), drop=()):
        super().__init__(votes=list(votes), drop=list(drop))

    def _transform(self, df):
        votes = sum(F.col(v) for v in self["votes"])
        return df.withColumn("prediction", (votes * 2 > len(self["votes"])).cast("int")).drop(*self["votes"], *self["drop"])


class PositiveShares(Stage):
    """Probability vectors -> plain columns with the share of the positive class."""

    def __init__(self, vectors=(), outputs=()):
        super().__init__(vectors=list(vectors), outputs=list(outputs))

    def columns(self, df):
        return {o: vector_to_array(F.col(v))[1] for v, o in zip(self["vectors"], self["outputs"])}


def _columns(tag: str) -> dict[str, str]:
    return {"probabilityCol": f"_p_{tag}", "rawPredictionCol": f"_r_{tag}", "predictionCol": f"_y_{tag}"}


def _leftovers(tags) -> list[str]:
    return [VECTOR, WEIGHT, *[f"_{x}_{t}" for t in tags for x in "ry"]]


def _assembler(features) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=VECTOR)


def vectors(df: DataFrame, features=FEATURES) -> DataFrame:
    """``df`` with its feature vector, as fitted classifiers take it."""
    return _assembler(features).transform(df)


class _Task:
    """Class counts of the training rows and the weights that follow from them."""

    def __init__(self, negatives: int, positives: int):
        self.negatives, self.positives = negatives, positives
        if not self.negatives or not self.positives:
            raise ValueError("training needs rows of both classes")
        self.rows = self.negatives + self.positives

    def weights(self, scheme: str) -> tuple[float, float]:
        """Of a negative and of a positive row."""
        if scheme == "positive_ratio":
            return 1.0, self.negatives / self.positives
        if scheme == "balanced":
            return self.rows / (2 * self.negatives), self.rows / (2 * self.positives)
        return 1.0, 1.0

    def logistic(self, settings: dict):
        # The published objectives differ by a factor: C times a sum here, a weighted mean there.
        return LogisticRegression(
            featuresCol=VECTOR, labelCol="label", weightCol=WEIGHT, regParam=1.0 / (settings.get("C", 1.0) * float(self.rows)),
            elasticNetParam=0.0, standardization=False, maxIter=settings.get("max_iter", 1000))

    def trees(self, settings: dict, width: int, without_fold: int | None) -> dict:
        forest, depth = settings["kind"] == "forest", settings.get("max_depth") or MAX_DEPTH
        if depth > MAX_DEPTH:
            raise ValueError(f"max_depth {depth}: trees grow to depth {MAX_DEPTH} at most")
        return {
            "trees": settings["n_estimators"], "forest": forest, "depth": depth, "leaves": settings.get("num_leaves"),
            "rate": settings.get("learning_rate", 1.0), "min_rows": settings.get("min_instances", 1), "min_split": settings.get("min_split", 2),
            "min_curvature": settings.get("min_child_weight", 0.0), "l1": settings.get("reg_alpha", 0.0), "l2": settings.get("reg_lambda", 0.0),
            "gamma": settings.get("gamma", 0.0), "subsample": settings.get("subsample", 1.0), "colsample": settings.get("colsample", 1.0),
            "per_node": max(1, int(width ** 0.5)) if forest else None, "weights": self.weights(settings.get("weights", "balanced")),
            "without_fold": without_fold, "seed": SEED}


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: the balanced weight of each class and the negatives per positive."""
    positives, negatives = F.col("positives"), F.col("negatives")
    return class_balance(df, label).select(
        F.try_divide(positives + negatives, 2 * positives).alias("positive_weight"),
        F.try_divide(positives + negatives, 2 * negatives).alias("negative_weight"),
        F.col("ratio").alias("positive_ratio"))


def profile_settings(profile: str | dict, **changes) -> dict:
    return {**(PROFILES[profile] if isinstance(profile, str) else profile), **changes}


def _fit_logistic(rows: DataFrame, task: _Task, settings: dict, tag: str):
    negative, positive = task.weights(settings.get("weights", "balanced"))
    weighted = rows.withColumn(WEIGHT, F.when(F.col("label") == 1, F.lit(positive)).otherwise(F.lit(negative))).select("label", WEIGHT, VECTOR)
    classifier = task.logistic(settings)
    for param, column in _columns(tag).items():
        classifier.set(classifier.getParam(param), column)
    return classifier.fit(weighted)


def _in_parallel(df: DataFrame, jobs: list, threads: int) -> list:
    """Run independent fits as concurrent Spark jobs; the cluster shares its slots among them."""
    with ThreadPool(max(1, min(threads, len(jobs)))) as pool:
        return pool.map(inheritable_thread_target(df.sparkSession)(lambda job: job()), jobs)


class _Rows:
    """Label and features of the training rows, kept for all fits of a call; lost partitions are rebuilt from the input."""

    def __init__(self, df: DataFrame, features, fold=None):
        self.features, self.fold = list(features), fold
        self.kept = df.select("label", *[F.col(f"`{c}`") for c in features], *([fold] if fold else [])).persist(StorageLevel.MEMORY_AND_DISK)

    def __enter__(self):
        counts = self.kept.groupBy(F.col(self.fold) if self.fold else F.lit(-1).alias("fold"), "label").count().collect()  # a row per fold and class
        self.counts = {(r[0], int(r["label"])): r["count"] for r in counts if r["label"] is not None}
        return self

    def __exit__(self, *_):
        self.kept.unpersist()

    def task(self, without: int | None = None) -> _Task:
        return _Task(*[sum(n for (f, y), n in self.counts.items() if y == label and f != without) for label in (0, 1)])

    def fit(self, wanted: list[tuple[dict, str, int | None]], threads: int = 3) -> list:
        """Fitted stages for ``(settings, tag, fold left out)``: all trees together, logistic models as jobs side by side."""
        tasks = [self.task(without) for _, _, without in wanted]
        found: list = [None] * len(wanted)
        grown = [i for i, (s, _, _) in enumerate(wanted) if s["kind"] != "logistic"]
        if grown:
            specs = [tasks[i].trees(wanted[i][0], len(self.features), wanted[i][2]) for i in grown]
            count = sum(self.counts.values())
            pieces = -(-count // ROWS_PER_PARTITION)
            parts = 1 if count <= ROWS_OF_ONE_TASK else max(pieces, self.kept.sparkSession.sparkContext.defaultParallelism)
            for i, spec, members in zip(grown, specs, trees.fit_trees(self.kept, self.features, specs, parts, self.fold, pieces=pieces)):
                names = _columns(wanted[i][1])
                found[i] = trees.TreeScores(VECTOR, trees.pack_trees(members), spec["forest"], names["probabilityCol"], names["predictionCol"], len(self.features))
        others = [i for i in range(len(wanted)) if found[i] is None]
        if others:
            vectors = _assembler(self.features).transform(self.kept).select("label", VECTOR, *([self.fold] if self.fold else [])).persist(StorageLevel.MEMORY_AND_DISK)

            def one(i):
                settings, tag, without = wanted[i]
                return _fit_logistic(vectors if without is None else vectors.filter(F.col(self.fold) != without), tasks[i], settings, tag)

            for i, stage in zip(others, _in_parallel(self.kept, [lambda i=i: one(i) for i in others], threads)):
                found[i] = stage
            vectors.unpersist()
        return found


def _single(features, stage) -> PipelineModel:
    return PipelineModel([_assembler(features), stage, ScoreColumns(["_p_m"], _leftovers(["m"]))])


def train(df: DataFrame, profile: str | dict = "logistic-baseline", features=FEATURES, **changes) -> PipelineModel:
    """Train one model on rows with feature columns and a 0/1 ``label``."""
    return train_many(df, [profile_settings(profile, **changes)], features)[0]


def train_many(df: DataFrame, profiles, features=FEATURES) -> list[PipelineModel]:
    """A model for each profile, all from one reading of the rows."""
    with _Rows(df, features) as rows:
        return [_single(features, stage) for stage in rows.fit([(profile_settings(p), "m", None) for p in profiles])]


def train_voting(df: DataFrame, profiles=ENSEMBLE, features=FEATURES, voting: str = "soft", threads: int = 3) -> PipelineModel:
    """Soft: mean of the base probabilities. Hard: majority of the base classes."""
    return train_votes(df, profiles, features, (voting,), threads)[0]


def train_votes(df: DataFrame, profiles=ENSEMBLE, features=FEATURES, votings=("soft", "hard"), threads: int = 3) -> list[PipelineModel]:
    """A vote of each kind over the same members, which are trained once."""
    unknown = [v for v in votings if v not in ("soft", "hard")]
    if unknown:
        raise ValueError(f"unknown voting: {unknown[0]}")
    tags = [f"m{i}" for i in range(len(profiles))]
    with _Rows(df, features) as rows:
        models = rows.fit([(profile_settings(p), t, None) for p, t in zip(profiles, tags)], threads)
    vectors = [f"_p_{t}" for t in tags]
    kinds = {"soft": ScoreColumns(vectors, _leftovers(tags)),
             "hard": MajorityVote([f"_y_{t}" for t in tags], [VECTOR, *vectors, *[f"_r_{t}" for t in tags]])}
    return [PipelineModel([_assembler(features), *models, kinds[v]]) for v in votings]


def train_stacking(df: DataFrame, key: str, profiles=ENSEMBLE, features=FEATURES, folds: int = FOLDS,
                   threads: int = 3) -> PipelineModel:
    """Out-of-fold base probabilities feed a logistic meta-model; the bases are refitted on all rows.

    Folds come from a hash of the row key, so every pass puts a row into the same fold. The
    fold is a column of the one table that all fits share; a fit leaves its fold's rows out.
    """
    fold = F.pmod(F.xxhash64(F.col(key)), F.lit(folds)).alias("_fold")
    tags = [f"m{i}" for i in range(len(profiles))]
    shares = [f"_s_{t}" for t in tags]
    to_shares = PositiveShares([f"_p_{t}" for t in tags], shares)
    meta_vector = VectorAssembler(inputCols=shares, outputCol="_stack")
    settings = [profile_settings(p) for p in profiles]
    with _Rows(df.select("*", fold), features, "_fold") as rows:
        fitted = rows.fit([(s, t, k) for k in [*range(folds), None] for s, t in zip(settings, tags)], threads)
        bases = fitted[-len(tags):]
        held_out = None
        for k in range(folds):
            models = fitted[k * len(tags):(k + 1) * len(tags)]
            part = PipelineModel([_assembler(features), *models, to_shares]).transform(rows.kept.filter(F.col("_fold") == k)).select("label", *shares)
            held_out = part if held_out is None else held_out.unionByName(part)
        # Written, so that the passes of the meta-model do not score again.
        path = work_path(df.sparkSession, "held_out")
        held_out.write.parquet(path)
        held_out = df.sparkSession.read.schema(held_out.schema).parquet(path)
        meta = LogisticRegression(featuresCol="_stack", labelCol="label", regParam=1.0 / rows.task().rows, standardization=False,
                                  maxIter=1000, **_columns("meta")).fit(meta_vector.transform(held_out))
    drop = [*_leftovers([*tags, "meta"]), "_stack", *shares, *[f"_p_{t}" for t in tags]]
    return PipelineModel([_assembler(features), *bases, to_shares, meta_vector, meta, ScoreColumns(["_p_meta"], drop)])


def as_training(features_frame: DataFrame, target: str = "Churn") -> DataFrame:
    """Encoded target column -> ``label``."""
    return features_frame.withColumnRenamed(target, "label")


def members_of(model: PipelineModel) -> tuple[list, object | None]:
    """The fitted classifiers of a trained pipeline, and the meta-model of a stack."""
    found = [s for s in model.stages if hasattr(s, "featureImportances") or hasattr(s, "coefficients")]
    stacked = any(isinstance(s, PositiveShares) for s in model.stages)
    return (found[:-1], found[-1]) if stacked else (found, None)


def classifier_of(model: PipelineModel):
    """The one fitted classifier of a trained pipeline. An ensemble has several, and none of them stands for it."""
    found, meta = members_of(model)
    if len(found) != 1 or meta is not None:
        raise ValueError(f"the pipeline holds {len(found)} classifiers")
    return found[0]


def feature_importance(spark: SparkSession, model: PipelineModel, features=FEATURES) -> DataFrame:
    """Absolute coefficients or impurity importances, highest first (one row per feature).

    Of an ensemble: each member's importances as shares, weighted as the members are (equally
    in a vote, by the size of the meta-model's coefficients in a stack); there is no coefficient.
    """
    members, meta = members_of(model)

    def sizes(fitted):
        return fitted.featureImportances.toArray() if hasattr(fitted, "featureImportances") else abs(fitted.coefficients.toArray())

    if len(members) == 1 and meta is None:
        fitted = members[0]
        signed = [None] * len(features) if hasattr(fitted, "featureImportances") else [float(v) for v in fitted.coefficients.toArray()]
        rows = [(f, c, float(v)) for f, c, v in zip(features, signed, sizes(fitted))]
    else:
        weights = [1.0] * len(members) if meta is None else [abs(float(w)) for w in meta.coefficients.toArray()]
        shares = [sizes(m) / (sizes(m).sum() or 1.0) for m in members]
        total = sum(w * s for w, s in zip(weights, shares)) / (sum(weights) or 1.0)
        rows = [(f, None, float(v)) for f, v in zip(features, total)]
    return spark.createDataFrame(rows, "feature string, coefficient double, importance double").orderBy(
        F.desc("importance"), "feature")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
