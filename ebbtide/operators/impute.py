"""Missing-value policy: reject, fill, and flag what was missing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbtide.operators.transformers import FittedBy, Stage

# The declared policy. reject | median | mode | zero | constant:<value>
DEFAULT_POLICY = {
    "Age": "reject",
    "Tenure": "reject",
    "MonthlyCharges": "median",
    "TotalCharges": "zero",
    "Engagement": "median",
    "Complaints": "zero",
    "LatePayments": "zero",
    "Gender": "mode",
    "ContractType": "mode",
    "InternetService": "constant:No Service",
    "PaymentMethod": "mode",
}


class ImputerModel(Stage):
    def __init__(self, reject=(), fills=None, create_indicators=True):
        super().__init__(reject=list(reject), fills=fills or {}, create_indicators=create_indicators)

    def _transform(self, df):
        for c in self["reject"]:
            df = df.filter(F.col(c).isNotNull())
        columns = {}
        if self["create_indicators"]:
            columns.update({f"{c}_was_missing": F.col(c).isNull().cast("int") for c in self["fills"]})
        columns.update({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in self["fills"].items()})
        return df.withColumns(columns)


class Imputer(FittedBy):
    """Learns medians and modes from the training rows that are not rejected."""

    def __init__(self, policy=None, create_indicators=True):
        super().__init__(policy=policy or DEFAULT_POLICY, create_indicators=create_indicators)

    def _by_rule(self, df, rule):
        return [c for c, r in self["policy"].items() if r == rule and c in df.columns]

    def quantiles(self, df):
        return [(c, 0.5) for c in self._by_rule(df, "median")]

    def _fit(self, df):
        for c in self._by_rule(df, "reject"):
            df = df.filter(F.col(c).isNotNull())
        return super()._fit(df)

    def build(self, statistics, df):
        fills = {c: statistics["quantiles"][(c, 0.5)] for c in self._by_rule(df, "median")}
        modes = self._by_rule(df, "mode")
        if modes:
            fills.update(self._modes(df, modes))
        for c, rule in self["policy"].items():
            if c in df.columns and rule == "zero":
                fills[c] = 0
            elif c in df.columns and rule.startswith("constant:"):
                fills[c] = rule.split(":", 1)[1]
        return ImputerModel(self._by_rule(df, "reject"), fills, self["create_indicators"])

    @staticmethod
    def _modes(df, columns) -> dict:
        """Most frequent value per column, the smallest on ties, from combined value counts."""
        cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
        counts = df.select(F.inline(cells)).filter("v is not null").groupBy("c", "v").agg(F.count("*").alias("n"))
        best = counts.groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("m"), "v"))["v"].alias("v"))
        return {r["c"]: r["v"] for r in best.collect()}  # one row per column
