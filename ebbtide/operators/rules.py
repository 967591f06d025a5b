"""Row rules of scoring requests: typed fields, ranges, cross-field checks, rejects.

Every rule is a column expression. A row carries its errors as an array, so valid rows
and rejects come out of one projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.schema import CATEGORIES, CORRUPT, REQUEST, REQUEST_RANGES, REQUEST_TO_SNAPSHOT, require_columns

ERRORS = "errors"
ERROR_TYPE = T.ArrayType(T.StructType([
    T.StructField(n, T.StringType()) for n in ("field", "message", "type", "input")]))
# The price must be above zero although its range starts at zero; ids have 1 to 50 characters.
ID_LENGTH = (1, 50)
POSITIVE = "monthly_charges"
LOW_SHARE, HIGH_SHARE, NEW_CUSTOMER_MONTHS = 0.5, 1.5, 2


class InvalidRequests(ValueError):
    """``errors`` is the table of all rejects, or None for a batch without records."""

    def __init__(self, rejected: int, errors: DataFrame | None):
        super().__init__(f"request validation failed for {rejected} records")
        self.rejected, self.errors = rejected, errors


class BatchTooLarge(ValueError):
    pass


def _error(field: str, message, kind: str, value: Column) -> Column:
    text = message if isinstance(message, Column) else F.lit(message)
    return F.struct(F.lit(field).alias("field"), text.alias("message"), F.lit(kind).alias("type"),
                    value.cast("string").alias("input"))


def _field_error(df: DataFrame, field: str) -> Column:
    """The first thing wrong with one field, else NULL."""
    raw, value = F.col(field), _typed(df, field)
    error = F.when(raw.isNull(), _error(field, "field required", "value_error.missing", raw))
    if isinstance(df.schema[field].dataType, T.StringType) and not isinstance(REQUEST[field].dataType, T.StringType):
        kind = "integer" if isinstance(REQUEST[field].dataType, T.LongType) else "float"
        error = error.when(value.isNull(), _error(field, f"value is not a valid {kind}", f"type_error.{kind}", raw))
    snapshot_name = REQUEST_TO_SNAPSHOT[field]
    if field == "customer_id":
        low, high = ID_LENGTH
        error = error.when(F.length(raw) < low, _error(field, f"at least {low} character", "value_error.any_str.min_length", raw))
        error = error.when(F.length(raw) > high, _error(field, f"at most {high} characters", "value_error.any_str.max_length", raw))
    elif snapshot_name in CATEGORIES:
        allowed = CATEGORIES[snapshot_name]
        error = error.when(~raw.isin(*allowed), _error(field, "must be one of " + ", ".join(allowed), "type_error.enum", raw))
    else:
        low, high = REQUEST_RANGES[field]
        error = error.when(value < low, _error(field, f"must be at least {low}", "value_error.number.not_ge", raw))
        error = error.when(value > high, _error(field, f"must be at most {high}", "value_error.number.not_le", raw))
        if field == POSITIVE:
            error = error.when(value <= 0, _error(field, "must be positive", "value_error", raw))
        # NaN compares as larger than every number in Spark, so it fails the upper bound.
    return error


def _typed(df: DataFrame, field: str) -> Column:
    raw, wanted = F.col(field), REQUEST[field].dataType
    if isinstance(df.schema[field].dataType, T.StringType):
        return raw.try_cast(wanted)
    return raw.cast(wanted)


def _total_charges_error(value: dict[str, Column], ok: dict[str, Column]) -> Column:
    """Total must fit tenure x price. Judged only when all three fields are valid."""
    total, tenure, monthly = (value[f] for f in ("total_charges", "tenure", "monthly_charges"))
    judged = ok["total_charges"] & ok["tenure"] & ok["monthly_charges"]
    low, high = tenure * monthly * LOW_SHARE, tenure * monthly * HIGH_SHARE

    def fail(text, *parts):
        return _error("total_charges", F.format_string(text, *parts), "value_error", total)

    return (
        F.when(~judged, F.lit(None))
        .when(tenure == 0, F.when(total > monthly * NEW_CUSTOMER_MONTHS,
                                  fail("new customer: at most %.2f expected", monthly * NEW_CUSTOMER_MONTHS)))
        .when(total < low, fail("too low: %.2f to %.2f expected", low, high))
        .when(total > high, fail("too high: %.2f to %.2f expected", low, high))
    )


def check_requests(df: DataFrame) -> DataFrame:
    """Type the 15 request fields and add ``errors``, empty for a valid record.

    Other columns (batch ids, positions) pass through. Fields may arrive as text. A line that
    is no JSON object has that one error, with its text as the input.
    """
    require_columns(df, REQUEST.names)
    others = [c for c in df.columns if c not in REQUEST.names]
    value = {f: _typed(df, f) for f in REQUEST.names}
    marked = df.select(
        *others,
        *[value[f].alias(f) for f in REQUEST.names],
        *[_field_error(df, f).alias(f"_{f}") for f in REQUEST.names],
    )
    value = {f: F.col(f) for f in REQUEST.names}
    ok = {f: F.col(f"_{f}").isNull() for f in REQUEST.names}
    offline_usage = F.when(
        ok["internet_service"] & ok["data_usage"] & (value["internet_service"] == "No Service") & (value["data_usage"] > 0),
        _error("__root__", "no internet service, so data usage must be 0", "value_error", value["data_usage"]))
    errors = [F.col(f"_{f}") for f in REQUEST.names]
    total = REQUEST.names.index("total_charges")
    errors[total] = F.coalesce(errors[total], _total_charges_error(value, ok))
    found = F.filter(F.array(*errors, offline_usage), lambda e: e.isNotNull())
    if CORRUPT in others:
        body = F.array(_error("__body__", "not a JSON object", "value_error.jsondecode", F.col(CORRUPT)))
        found = F.when(F.col(CORRUPT).isNotNull(), body).otherwise(found)
    return marked.select(*[c for c in others if c != CORRUPT], *REQUEST.names, found.alias(ERRORS))


def soft_signals(df: DataFrame) -> DataFrame:
    """Unusual but accepted combinations, as boolean columns."""
    tenure, contract = F.col("tenure"), F.col("contract_type")
    signals = {
        "new_two_year": (contract == "Two Year") & (tenure < 3),
        "long_monthly": (contract == "Month-to-Month") & (tenure > 60),
        "pays_much_uses_little": (F.col("monthly_charges") > 80) & (F.col("engagement") < 0.5),
        "engaged_without_usage": (F.col("call_minutes") == 0) & (F.col("data_usage") == 0) & (F.col("engagement") > 1.5),
    }
    return df.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in signals.items()})


def valid_rows(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size(ERRORS) == 0).drop(ERRORS)


def rejects(checked: DataFrame, keep=("customer_id",)) -> DataFrame:
    """One row per error with the error count of its record.

    ``inline`` drops valid rows by itself; a filter before it would be pushed below the
    rules and evaluate all of them a second time.
    """
    return checked.select(*keep, F.size(ERRORS).alias("error_count"), F.inline(ERRORS))


def error_summary(checked: DataFrame) -> DataFrame:
    """Errors by field and type."""
    return checked.select(F.inline(ERRORS)).groupBy("field", "type").agg(F.count("*").alias("errors"))


def accept(checked: DataFrame, mode: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """Valid rows and rejects.

    ``quarantine`` splits the batch. ``fail`` refuses the whole batch if any record is
    invalid, which runs one counting job; the error carries the table of all rejects.
    """
    if mode not in ("quarantine", "fail"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "fail":
        bad = checked.filter(F.size(ERRORS) > 0).count()
        if bad:
            raise InvalidRequests(bad, rejects(checked))
    return valid_rows(checked), rejects(checked)


def judge_batches(checked: DataFrame, batch: str, size: int = 100) -> DataFrame:
    """All-or-nothing per batch: accepted when no record is invalid and none are too many."""
    return checked.groupBy(batch).agg(
        F.count("*").alias("records"), F.count_if(F.size(ERRORS) > 0).alias("invalid"),
    ).withColumn("accepted", (F.col("invalid") == 0) & (F.col("records") <= size))


def limit_batch(df: DataFrame, size: int = 100) -> DataFrame:
    """Refuse a batch above ``size`` records or without any. Looks at no more than size + 1 rows."""
    found = df.limit(size + 1).count()
    if found > size:
        raise BatchTooLarge(f"batch holds more than {size} records")
    if found == 0:
        raise InvalidRequests(0, None)
    return df
