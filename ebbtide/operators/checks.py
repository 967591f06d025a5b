"""Data-quality suites: a list of checks evaluated in one pass over the data."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.schema import CATEGORIES, CONTRACT_OPEN_RANGES, CONTRACT_RANGES, SNAPSHOT, SUITE_RANGES

# Public expectation names in suite files -> check kind.
EXPECTATION_KINDS = {
    "expect_table_columns_to_match_ordered_list": "columns",
    "expect_column_values_to_be_of_type": "type",
    "expect_column_values_to_not_be_null": "not_null",
    "expect_column_values_to_be_unique": "unique",
    "expect_column_values_to_be_between": "between",
    "expect_column_values_to_be_in_set": "in_set",
    "expect_column_mean_to_be_between": "mean_between",
    "expect_table_row_count_to_be_between": "row_count",
}
# Type names in suite files -> Spark types that satisfy them.
TYPE_NAMES = {
    "int64": (T.LongType, T.IntegerType, T.ShortType, T.ByteType),
    "float64": (T.DoubleType, T.FloatType),
    "object": (T.StringType,),
}
CAST_NAMES = {"int64": "bigint", "float64": "double", "object": "string"}

RESULT = "check_id int, kind string, column string, severity string, success boolean, " \
         "element_count bigint, unexpected_count bigint, observed double"


@dataclass(frozen=True)
class Check:
    kind: str
    column: str | None = None
    args: dict = field(default_factory=dict)
    severity: str = "critical"


class SuiteFailed(ValueError):
    """Carries all failed results; its text names the first few."""

    SHOWN = 5

    def __init__(self, failures: list):
        named = [f"{r['kind']}({r['column'] or ''}): {r['unexpected_count']} unexpected, observed {r['observed']}" for r in failures]
        more = [f"and {len(named) - self.SHOWN} more"] if len(named) > self.SHOWN else []
        super().__init__("; ".join([f"data validation failed: {len(failures)} checks failed", *named[:self.SHOWN], *more]))
        self.failures = failures


def suite_from_json(path: str) -> list[Check]:
    """Read a suite file: ``{"expectations": [{"expectation_type", "kwargs"}, ...]}``."""
    with open(path, encoding="utf-8") as f:
        entries = json.load(f)["expectations"]
    suite = []
    for entry in entries:
        args = dict(entry["kwargs"])
        suite.append(Check(EXPECTATION_KINDS[entry["expectation_type"]], args.pop("column", None), args))
    return suite


def raw_data_suite(rows=(45_000, 55_000), mean_churn=(0.6, 0.7)) -> list[Check]:
    """The 43 checks of the raw snapshot."""
    numeric = [f for f in SNAPSHOT.fields if not isinstance(f.dataType, T.StringType)]
    names = {T.LongType: "int64", T.DoubleType: "float64"}
    return [
        Check("columns", args={"column_list": SNAPSHOT.names}),
        *[Check("type", f.name, {"type_": names[type(f.dataType)]}) for f in numeric],
        *[Check("not_null", c, {"mostly": 1.0}) for c in SNAPSHOT.names],
        Check("unique", "CustomerID"),
        *[Check("between", c, {"min_value": lo, "max_value": hi}) for c, (lo, hi) in SUITE_RANGES.items()],
        *[Check("in_set", c, {"value_set": v}) for c, v in CATEGORIES.items()],
        Check("mean_between", "ChurnProbability", {"min_value": mean_churn[0], "max_value": mean_churn[1]}),
        Check("row_count", args={"min_value": rows[0], "max_value": rows[1]}),
    ]


def contract_suite(rows=(45_000, 55_000), churn_share=(0.6, 0.7)) -> list[Check]:
    """The written data contract: critical rules, and stability rules that only warn."""
    strict = [c for c in raw_data_suite() if c.kind in ("columns", "type", "not_null", "unique", "in_set")]
    return [
        *strict,
        *[Check("between", c, {"min_value": lo, "max_value": hi}) for c, (lo, hi) in CONTRACT_RANGES.items()],
        *[Check("between", c, {"min_value": lo, "max_value": hi, "strict_min": True, "strict_max": True})
          for c, (lo, hi) in CONTRACT_OPEN_RANGES.items()],
        Check("share_between", "Churn", {"value": "Yes", "min_value": churn_share[0], "max_value": churn_share[1]}, "warning"),
        Check("row_count", args={"min_value": rows[0], "max_value": rows[1]}, severity="warning"),
    ]


def _within(value: Column, args: dict) -> Column:
    tests = []
    if args.get("min_value") is not None:
        tests.append(value > args["min_value"] if args.get("strict_min") else value >= args["min_value"])
    if args.get("max_value") is not None:
        tests.append(value < args["max_value"] if args.get("strict_max") else value <= args["max_value"])
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _number(column: str, df: DataFrame) -> Column:
    """The column for range checks; text cells that are no number become NULL."""
    c = F.col(f"`{column}`")
    return c.try_cast("double") if isinstance(df.schema[column].dataType, T.StringType) else c


def _unexpected(check: Check, df: DataFrame) -> Column | None:
    """Row condition that makes a cell unexpected; NULL cells count only for ``not_null``."""
    c = F.col(f"`{check.column}`")
    if check.kind == "not_null":
        return c.isNull()
    if check.kind == "between":
        # A text cell that is no number lies in no range.
        return c.isNotNull() & ~F.coalesce(_within(_number(check.column, df), check.args), F.lit(False))
    if check.kind == "in_set":
        return c.isNotNull() & ~c.isin(*check.args["value_set"])
    if check.kind == "type" and isinstance(df.schema[check.column].dataType, T.StringType):
        return c.isNotNull() & c.try_cast(CAST_NAMES[check.args["type_"]]).isNull()
    return None


def _result(i: int, check: Check, success, elements=None, unexpected=None, observed=None) -> Column:
    def typed(v, kind):
        return (v if isinstance(v, Column) else F.lit(v)).cast(kind)

    return F.struct(
        F.lit(i).alias("check_id"), F.lit(check.kind).alias("kind"),
        F.lit(check.column).cast("string").alias("column"), F.lit(check.severity).alias("severity"),
        F.coalesce(typed(success, "boolean"), F.lit(False)).alias("success"),
        typed(elements, "bigint").alias("element_count"), typed(unexpected, "bigint").alias("unexpected_count"),
        typed(observed, "double").alias("observed"),
    )


def run_suite(df: DataFrame, suite: list[Check]) -> DataFrame:
    """One result row per check.

    Every row, aggregate and count check is part of a single aggregation. Uniqueness
    needs its own grouping by key, one per checked column, combined map-side first.
    """
    suite_rows, uniques, totals = [], [], {"_rows": F.count("*")}
    for i, check in enumerate(suite):
        if check.column is not None and check.column not in df.columns:
            suite_rows.append(_result(i, check, False))
        elif check.kind == "columns":
            suite_rows.append(_result(i, check, df.columns == list(check.args["column_list"]), observed=len(df.columns)))
        elif check.kind == "row_count":
            suite_rows.append(_result(i, check, _within(F.col("_rows"), check.args), F.col("_rows"), observed=F.col("_rows")))
        elif check.kind in ("mean_between", "share_between"):
            c = F.col(f"`{check.column}`")
            totals[f"_m{i}"] = F.avg(_number(check.column, df) if check.kind == "mean_between" else (c == check.args["value"]).cast("int"))
            suite_rows.append(_result(i, check, _within(F.col(f"_m{i}"), check.args), F.col("_rows"), observed=F.col(f"_m{i}")))
        elif check.kind == "unique":
            uniques.append((i, check))
        else:
            bad = _unexpected(check, df)
            if bad is None:  # a type the schema itself answers
                fits = isinstance(df.schema[check.column].dataType, TYPE_NAMES[check.args["type_"]])
                suite_rows.append(_result(i, check, fits, F.col("_rows"), 0 if fits else F.col("_rows")))
                continue
            totals[f"_u{i}"] = F.count_if(bad)
            counted = F.col("_rows")
            if check.kind != "not_null":
                totals[f"_n_{check.column}"] = F.count(f"`{check.column}`")
                counted = F.col(f"_n_{check.column}")
            enough = F.when(counted == 0, True).otherwise(
                (counted - F.col(f"_u{i}")) / F.greatest(counted, F.lit(1)) >= float(check.args.get("mostly", 1.0)))
            suite_rows.append(_result(i, check, enough, F.col("_rows"), F.col(f"_u{i}")))
    parts = []
    if suite_rows:
        wide = df.agg(*[c.alias(n) for n, c in totals.items()])
        parts.append(wide.select(F.inline(F.array(*suite_rows))))
    for i, check in uniques:
        counts = df.groupBy(F.col(f"`{check.column}`").alias("_key")).agg(F.count("*").alias("_n"))
        repeated = F.col("_key").isNotNull() & (F.col("_n") > 1)
        row = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_all"),
                         F.coalesce(F.sum(F.when(repeated, F.col("_n"))), F.lit(0)).alias("_bad"))
        parts.append(row.select(F.inline(F.array(_result(i, check, F.col("_bad") == 0, F.col("_all"), F.col("_bad"))))))
    return reduce(DataFrame.unionByName, parts)


def summarize(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("evaluated"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("unsuccessful"),
        (F.count_if("success") * 100.0 / F.count("*")).alias("success_percent"),
        F.coalesce(F.bool_and(F.col("success") | (F.col("severity") != "critical")), F.lit(True)).alias("success"),
    )


def failures(results: DataFrame) -> DataFrame:
    return results.filter(~F.col("success"))


def first_failures(results: DataFrame, n: int = 5) -> DataFrame:
    """The first failing checks in suite order, each with how many more there are."""
    more = failures(results).agg(F.greatest(F.count("*") - n, F.lit(0))).scalar()
    return failures(results).orderBy("check_id").limit(n).withColumn("n_more", more)


def validate(df: DataFrame, suite: list[Check]) -> list:
    """Result rows (one per check). Raises when a critical check fails; warnings come back."""
    rows = run_suite(df, suite).orderBy("check_id").collect()  # as many rows as checks
    failed = [r for r in rows if not r["success"] and r["severity"] == "critical"]
    if failed:
        raise SuiteFailed(failed)
    return rows


def missing_cells(df: DataFrame) -> DataFrame:
    """NULL and infinite cells per column, with the share of rows."""
    cells, totals = [], {"_rows": F.count("*")}
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        totals[f"_n{i}"] = F.count_if(c.isNull())
        infinite = F.lit(0)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            totals[f"_i{i}"] = F.count_if(F.abs(c) == float("inf"))
            infinite = F.col(f"_i{i}")
        cells.append(F.struct(
            F.lit(f.name).alias("column"), F.col(f"_n{i}").alias("missing"), infinite.cast("bigint").alias("infinite"),
            F.try_divide(F.col(f"_n{i}") * 100.0, F.col("_rows")).alias("missing_percent")))
    return df.agg(*[c.alias(n) for n, c in totals.items()]).select(F.inline(F.array(*cells)))


def quality_totals(df: DataFrame) -> DataFrame:
    """Missing and infinite cells in total, and rows that repeat an earlier row."""
    cells = missing_cells(df).agg(F.sum("missing").alias("missing"), F.sum("infinite").alias("infinite"))
    return cells.withColumn("duplicate_rows", duplicate_rows(df).scalar())


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier one. Equal rows combine before the shuffle."""
    copies = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg((F.count("*") - 1).alias("_extra"))
    return copies.agg(F.coalesce(F.sum("_extra"), F.lit(0)).alias("duplicate_rows"))


def null_pattern(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).isNull().alias("is_null")).agg(F.count("*").alias("rows"))
