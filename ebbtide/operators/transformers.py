"""Feature stages as ``pyspark.ml`` Transformers and Estimators.

Each stage is a projection of column expressions. Its settings live in one JSON
parameter, so stages and fitted pipelines save and load with the standard writers.
"""

from __future__ import annotations

import warnings

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions import features as fx
from ebbtide.operators.statistics import ONE_HOT_LIMIT, fit_statistics
from ebbtide.schema import ID, TARGET, require_columns


class _Settings(Params):
    """JSON settings kept in one Param; ``self["name"]`` reads one of them."""

    settings = Param(Params._dummy(), "settings", "settings of the stage", TypeConverters.identity)

    def __getitem__(self, name):
        return self.getOrDefault(self.settings)[name]


class Stage(_Settings, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A stateless or fitted stage: subclass it, set ``needs`` and write ``columns``."""

    needs: tuple[str, ...] = ()

    def __init__(self, **settings):
        super().__init__()
        self._set(settings=settings)

    def columns(self, df: DataFrame) -> dict[str, Column]:
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        require_columns(df, self.needs)
        return df.withColumns(self.columns(df))


class FittedBy(_Settings, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """A stage that learns scalars: says which statistics it needs, then builds its model."""

    needs: tuple[str, ...] = ()

    def __init__(self, **settings):
        super().__init__()
        self._set(settings=settings)

    def moments(self, df) -> list[str]:
        return []

    def quantiles(self, df) -> list[tuple[str, float]]:
        return []

    def categories(self, df) -> list[str]:
        return []

    def build(self, statistics: dict, df: DataFrame) -> Transformer:
        raise NotImplementedError

    def _fit(self, df: DataFrame) -> Transformer:
        require_columns(df, self.needs)
        return self.build(fit_statistics(df, self.moments(df), self.quantiles(df), self.categories(df)), df)


class ColumnDropper(Stage):
    """Drop columns; names that are not there are ignored with a warning."""

    def __init__(self, columns=()):
        super().__init__(columns=list(columns))

    def _transform(self, df):
        unknown = [c for c in self["columns"] if c not in df.columns]
        if unknown:
            warnings.warn(f"columns to drop are not there: {', '.join(unknown)}", stacklevel=2)
        return df.drop(*self["columns"])


class ColumnExpressions(Stage):
    """Set columns from SQL expressions and leave the rest (a generic wrapper stage)."""

    def __init__(self, expressions=None):
        super().__init__(expressions=dict(expressions or {}))

    def columns(self, df):
        return {name: F.expr(text) for name, text in self["expressions"].items()}


class TenureBucketer(Stage):
    needs = ("Tenure",)

    def __init__(self, bins=None, labels=None, encode_onehot=True):
        super().__init__(bins=list(bins or fx.TENURE_EDGES), labels=list(labels or fx.TENURE_LABELS),
                         encode_onehot=encode_onehot)

    def columns(self, df):
        bucket = fx.tenure_bucket(F.col("Tenure"), self["bins"], self["labels"])
        if not self["encode_onehot"]:
            return {"TenureBucket": bucket}
        # Buckets are ordered by their edges, so the lowest one is the baseline here.
        return {f"TenureBucket_{l}": fx.flag(bucket == l) for l in self["labels"][1:]}


class PricePerService(Stage):
    needs = ("MonthlyCharges", "InternetService")

    def columns(self, df):
        return {"PricePerService": fx.price_per_service(F.col("MonthlyCharges"), F.col("InternetService"))}


class ContractTenureMismatch(Stage):
    needs = ("ContractType", "Tenure")

    def columns(self, df):
        return {"ContractTenureMismatch": fx.contract_tenure_mismatch(F.col("ContractType"), F.col("Tenure"))}


class FinancialStress(Stage):
    needs = ("LatePayments", "Complaints")

    def columns(self, df):
        return {"FinancialStress": fx.financial_stress(F.col("LatePayments"), F.col("Complaints"))}


class Interactions(Stage):
    needs = ("ContractType", "Tenure", "RecentSupportTickets", "Complaints", "Engagement", "MonthlyCharges")

    def columns(self, df):
        return fx.interactions()


class HighRiskModel(Stage):
    needs = ("Tenure", "MonthlyCharges", "RecentSupportTickets")

    def __init__(self, median=None):
        super().__init__(median=median)

    def columns(self, df):
        return {"IsHighRisk": fx.high_risk(
            F.col("Tenure"), F.col("MonthlyCharges"), F.col("RecentSupportTickets"), self["median"])}


class HighRisk(FittedBy):
    """Learns the median price of the training rows."""

    needs = HighRiskModel.needs

    def quantiles(self, df):
        return [("MonthlyCharges", 0.5)]

    def build(self, statistics, df):
        return HighRiskModel(median=statistics["quantiles"][("MonthlyCharges", 0.5)])


#: Labels that are coded by a condition each; longer lists are joined as a table.
LISTED = 32


def _coded(df: DataFrame, column: str, labels: list) -> DataFrame:
    """The column as the 0-based position in the sorted labels; an unseen or missing label is an error."""
    unseen = F.raise_error(F.concat(F.lit(f"unseen label in {column}: "), F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("NULL"))))
    if len(labels) <= LISTED:
        code = unseen
        for position, label in reversed(list(enumerate(labels))):
            code = F.when(F.col(f"`{column}`") == label, F.lit(position)).otherwise(code)
        return df.withColumn(column, code)
    # As large as the model; Spark sends it to all tasks if it is small by its size, else both sides are shuffled.
    value, position = f"_label_of_{column}", f"_code_of_{column}"
    kind = dict(df.dtypes)[column]
    table = df.sparkSession.createDataFrame(list(zip(labels, range(len(labels)))), f"`{value}` {kind}, `{position}` int")
    joined = df.join(table, F.col(f"`{column}`") == F.col(f"`{value}`"), "left")
    return joined.withColumn(column, F.coalesce(F.col(f"`{position}`"), unseen)).drop(value, position)


class CategoricalModel(Stage):
    def __init__(self, binary=None, one_hot=None):
        super().__init__(binary=binary or {}, one_hot=one_hot or {})

    def _transform(self, df):
        spread = {c: spec for c, spec in self["one_hot"].items() if c in df.columns}
        new = {}
        for c, spec in spread.items():
            new.update(fx.one_hot(F.col(c), c, spec["categories"], spec["drop_first"]))
        for c, labels in self["binary"].items():
            if c in df.columns:
                df = _coded(df, c, labels)
        return df.withColumns(new).drop(*spread)


class CategoricalEncoder(FittedBy):
    """Binary columns become sorted label codes, one-hot columns dummies.

    A ``mapping`` given with ``use_mapping`` replaces the sorted codes. One-hot columns
    without a declared list take their categories from the training rows.
    """

    def __init__(self, binary=None, one_hot=None):
        super().__init__(binary=binary or {}, one_hot=one_hot or {})

    def categories(self, df):
        open_lists = [c for c, spec in self["one_hot"].items() if not spec.get("categories")]
        return [c for c in [*self["binary"], *open_lists] if c in df.columns]

    def build(self, statistics, df):
        seen = statistics["categories"]
        for c in self["one_hot"]:
            if len(seen.get(c, ())) > ONE_HOT_LIMIT:
                raise ValueError(f"{c} has {len(seen[c])} values and would become as many columns")
        binary = {}
        for c, spec in self["binary"].items():
            if c in df.columns:
                mapping = (spec or {}).get("mapping")
                use = mapping and spec.get("use_mapping")
                binary[c] = sorted(mapping, key=mapping.get) if use else seen[c]
        one_hot = {
            c: {"categories": sorted(spec.get("categories") or seen[c]), "drop_first": spec.get("drop_first", True)}
            for c, spec in self["one_hot"].items() if c in df.columns
        }
        return CategoricalModel(binary=binary, one_hot=one_hot)


def overlay_categories(model: PipelineModel, declared: dict) -> tuple[PipelineModel, dict]:
    """Let declared one-hot categories replace those saved at fit time.

    Returns the pipeline and what differed, column -> (saved, declared).
    """
    drift, stages = {}, []
    for stage in model.stages:
        if isinstance(stage, CategoricalModel):
            one_hot = dict(stage["one_hot"])
            for c, spec in one_hot.items():
                wanted = sorted(declared.get(c, {}).get("categories") or spec["categories"])
                if wanted != spec["categories"]:
                    drift[c] = (spec["categories"], wanted)
                one_hot[c] = {"categories": wanted, "drop_first": declared.get(c, {}).get("drop_first", spec["drop_first"])}
            stage = CategoricalModel(binary=stage["binary"], one_hot=one_hot)
        stages.append(stage)
    return PipelineModel(stages), drift


class ScalerModel(Stage):
    """(x - center) / scale for each fitted column."""

    def __init__(self, parameters=None):
        super().__init__(parameters=parameters or {})

    def columns(self, df):
        return {c: (F.col(c) - F.lit(center)) / F.lit(scale) for c, (center, scale) in self["parameters"].items()}


class NumericScaler(FittedBy):
    """standard: mean and population deviation; minmax: range; robust: median and IQR."""

    METHODS = ("standard", "minmax", "robust")

    def __init__(self, columns=(), method="standard"):
        if method not in self.METHODS:
            raise ValueError(f"unknown scaling method: {method}")
        super().__init__(columns=list(columns), method=method)

    def _present(self, df):
        return [c for c in self["columns"] if c in df.columns]

    def moments(self, df):
        return [] if self["method"] == "robust" else self._present(df)

    def quantiles(self, df):
        return [(c, p) for c in self._present(df) for p in (0.25, 0.5, 0.75)] if self["method"] == "robust" else []

    def build(self, statistics, df):
        parameters = {}
        for c in self._present(df):
            if self["method"] == "robust":
                q1, center, q3 = (statistics["quantiles"][(c, p)] for p in (0.25, 0.5, 0.75))
                scale = q3 - q1
            else:
                m = statistics["moments"][c]
                center, scale = (m["mean"], m["std"]) if self["method"] == "standard" else (m["min"], m["max"] - m["min"])
            parameters[c] = (float(center), float(scale) or 1.0)
        return ScalerModel(parameters=parameters)


class VarianceFilter(FittedBy):
    """Drop features whose population variance does not exceed the threshold."""

    def __init__(self, columns=(), threshold=0.01):
        super().__init__(columns=list(columns), threshold=threshold)

    def moments(self, df):
        return [c for c in self["columns"] if c in df.columns]

    def build(self, statistics, df):
        low = [c for c, m in statistics["moments"].items() if m["std"] ** 2 <= self["threshold"]]
        return ColumnDropper(columns=low)


class TargetModel(Stage):
    def __init__(self, column=TARGET, labels=("No", "Yes")):
        super().__init__(column=column, labels=list(labels))

    def _transform(self, df):
        return _coded(df, self["column"], self["labels"]) if self["column"] in df.columns else df


class TargetEncoder(FittedBy):
    """Target labels become 0, 1 in sorted order. Rows without a target column pass."""

    def __init__(self, column=TARGET):
        super().__init__(column=column)

    def categories(self, df):
        return [self["column"]]

    def build(self, statistics, df):
        return TargetModel(column=self["column"], labels=statistics["categories"][self["column"]])


# The default feature configuration.
DEFAULT_CONFIG = {
    "features_to_drop": ["CustomerID", "CallMinutes", "DataUsage", "ChurnProbability"],
    "categorical_features": {
        "binary": {"Gender": {"mapping": {"Male": 0, "Female": 1}}},
        "one_hot": {
            "ContractType": {"categories": ["Month-to-Month", "One Year", "Two Year"], "drop_first": True},
            "InternetService": {"categories": ["DSL", "Fiber", "No Service"], "drop_first": True},
            "PaymentMethod": {"categories": ["Credit Card", "Debit Card", "UPI", "Cash"], "drop_first": True},
        },
    },
    "numerical_features": {
        "scale": ["Age", "Tenure", "MonthlyCharges", "TotalCharges", "Engagement", "Complaints", "LatePayments"],
    },
    "engineered_features": {
        "tenure_buckets": {"enabled": True, "bins": fx.TENURE_EDGES, "labels": fx.TENURE_LABELS, "encode_as_onehot": True},
        "price_to_service_ratio": {"enabled": True},
        "high_risk_segment": {"enabled": True},
        "contract_tenure_mismatch": {"enabled": True},
        "financial_stress_score": {"enabled": True},
    },
    "scaling": {"method": "standard"},
    "target": {"column": "Churn"},
}


def config_stages(config: dict, keep=()) -> list:
    """Ordered stages of a feature configuration. ``keep`` protects columns from dropping."""
    steps = config["engineered_features"]

    def enabled(name):
        return steps.get(name, {}).get("enabled", False)

    stages = []
    drop = [c for c in config.get("features_to_drop") or [] if c not in keep]
    if drop:
        stages.append(ColumnDropper(columns=drop))
    if enabled("tenure_buckets"):
        spec = steps["tenure_buckets"]
        stages.append(TenureBucketer(spec["bins"], spec["labels"], spec["encode_as_onehot"]))
    for name, stage in (("price_to_service_ratio", PricePerService), ("high_risk_segment", HighRisk),
                        ("contract_tenure_mismatch", ContractTenureMismatch),
                        ("financial_stress_score", FinancialStress)):
        if enabled(name):
            stages.append(stage())
    categorical = config["categorical_features"]
    stages.append(CategoricalEncoder(categorical.get("binary"), categorical.get("one_hot")))
    stages.append(NumericScaler(config["numerical_features"]["scale"], config["scaling"]["method"]))
    return stages


class FeatureEngineer(FittedBy):
    """The whole feature pipeline: fit once on training rows, apply anywhere.

    All stages ask for their statistics together, so a fit costs two jobs. Settings
    under which a later stage learns from an earlier fitted one (say, scaling a
    fitted flag) fit stage by stage instead.
    """

    def __init__(self, config=None, keep=(ID,)):
        super().__init__(config=config or DEFAULT_CONFIG, keep=list(keep))

    def _fit(self, df):
        target = self["config"].get("target", {}).get("column", TARGET)
        stages = config_stages(self["config"], self["keep"])
        if target in df.columns:
            stages.append(TargetEncoder(target))
        ready = df
        for stage in stages:
            if isinstance(stage, Stage):
                ready = stage.transform(ready)
        learning = [s for s in stages if isinstance(s, FittedBy)]
        for stage in learning:
            require_columns(ready, stage.needs)
        scaled = set(self["config"]["numerical_features"]["scale"])
        fitted_first = {"IsHighRisk", *self["config"]["categorical_features"].get("binary", {})}
        if scaled & fitted_first or any(c not in ready.columns for c in scaled & {c for s in learning for c in s.needs}):
            pipeline = Pipeline(stages=stages).fit(df)
        else:
            statistics = fit_statistics(
                ready,
                [c for s in learning for c in s.moments(ready)],
                [q for s in learning for q in s.quantiles(ready)],
                [c for s in learning for c in s.categories(ready)],
            )
            pipeline = PipelineModel([s.build(statistics, ready) if isinstance(s, FittedBy) else s for s in stages])
        # The schema of an empty input tells the names; no job runs.
        made = pipeline.transform(df.limit(0)).columns
        return FeatureEngineerModel(pipeline, target, self["keep"], [c for c in made if c not in {*self["keep"], target}])


class FeatureEngineerModel(Transformer, MLReadable, MLWritable):
    """Fitted feature pipeline: kept columns, then features, then the target if present."""

    def __init__(self, pipeline: PipelineModel, target: str, keep, names):
        super().__init__()
        self.pipeline, self.target, self.keep, self.names = pipeline, target, list(keep), list(names)

    def _transform(self, df):
        out = self.pipeline.transform(df)
        kept = [c for c in self.keep if c in out.columns]
        tail = [self.target] if self.target in out.columns else []
        return out.select(*[F.col(f"`{c}`") for c in [*kept, *self.names, *tail]])

    def feature_names(self) -> list[str]:
        """Feature columns of the frames this model makes, as the fit found them."""
        return list(self.names)

    def stage(self, kind: type):
        return next(s for s in self.pipeline.stages if isinstance(s, kind))

    def write(self):
        return _EngineerWriter(self)

    @classmethod
    def read(cls):
        return _EngineerReader()


class _EngineerWriter(MLWriter):
    def __init__(self, model):
        super().__init__()
        self.model = model

    def saveImpl(self, path):
        # The kept columns and the target travel as a leading marker stage.
        marker = ColumnExpressions()
        marker._set(settings={"expressions": {}, "keep": self.model.keep, "target": self.model.target, "names": self.model.names})
        PipelineModel([marker, *self.model.pipeline.stages]).write().save(path)


class _EngineerReader(MLReader):
    def load(self, path):
        marker, *stages = PipelineModel.load(path).stages
        return FeatureEngineerModel(PipelineModel(stages), marker["target"], marker["keep"], marker["names"])
