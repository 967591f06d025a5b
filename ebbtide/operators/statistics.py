"""Column statistics that fits and profiles share: moments, exact quantiles, categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.session import work_path

# Cells (rows times columns) whose values are counted one by one; beyond that they are first
# counted by cuts of the range in which a wanted rank lies, until so few are left.
DISTINCT_LIMIT = 1_000_000
CUTS = 4096
# A one-hot column with more values than this would become as many columns.
ONE_HOT_LIMIT = 1_000


def quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    by: tuple[str, ...] = (),
    distinct_limit: int = DISTINCT_LIMIT,
) -> DataFrame:
    """Exact interpolated quantiles as rows ``(by..., column, prob, value)``.

    NULL and NaN are missing values and left out. All columns, groups and probabilities go
    together: each pass over the rows counts how many fall into each cut of the ranges that
    hold a wanted rank, and keeps the cut with that rank as the next range. Counts combine
    before the shuffle, so a pass moves at most ``CUTS`` rows a range and task. Once few
    enough cells are left, their values are counted and ranked.
    """
    cells = df.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), _number(c).alias("_x")) for c in columns]))).filter("_x is not null")
    if df.count() * len(columns) <= distinct_limit:
        return _interpolated(_counted(cells, probs, by), by)
    sizes = cells.groupBy(*by, "column").agg(F.count("*").alias("_size"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    wanted = F.array(*[F.struct(F.lit(float(p)).alias("prob"), (F.lit(float(p)) * (F.col("_size") - 1)).alias("position")) for p in probs])
    ranks = F.explode(F.array_distinct(F.array(F.floor("position"), F.ceil("position")))).alias("rank")
    targets = sizes.select(*by, "column", "_lo", "_hi", F.col("_size").alias("_left"), F.inline(wanted))
    targets = _kept(targets.select(*targets.columns, ranks, F.lit(0).cast("bigint").alias("_before")))
    logarithmic = False
    while _cells_left(targets, by) > distinct_limit:
        targets, logarithmic = _kept(_narrowed(cells, targets, by, logarithmic)), not logarithmic
    found = targets.filter("_lo = _hi").withColumn("_value", F.col("_lo"))
    rest = _in_ranges(cells, targets, by).groupBy(*by, "column", "_lo", "_x").agg(F.count("*").alias("_n"))
    window = Window.partitionBy(*by, "column", "_lo").orderBy("_x")
    rest = rest.withColumn("_upto", F.sum("_n").over(window))
    open_ones = targets.filter("_lo < _hi")
    ranked = open_ones.join(_aside(rest, by), _same(open_ones, by) & _holds_rank()).withColumn("_value", F.col("_of_x"))
    return _interpolated(found.unionByName(ranked.select(*found.columns)), by)


def _number(column: str) -> Column:
    """The value as a double, NULL for NaN. The infinite ones stand at the ends of what is finite."""
    value, top = F.col(f"`{column}`").cast("double"), 1.7976931348623157e308
    return F.when(value.isNotNull() & ~F.isnan(value), F.greatest(F.lit(-top), F.least(F.lit(top), value)))


def _kept(df: DataFrame) -> DataFrame:
    """Written and read back: a few rows, computed once."""
    path = work_path(df.sparkSession, "ranges")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _cells_left(targets: DataFrame, by) -> int:
    open_ones = targets.filter("_lo < _hi").select(*by, "column", "_lo", "_left").distinct()
    return open_ones.agg(F.sum("_left")).first()[0] or 0


def _aside(df: DataFrame, by) -> DataFrame:
    """Columns renamed, so that they can stand beside those of the same name."""
    return df.select(*[F.col(c).alias(f"_of{c}" if c.startswith("_") else f"_of_{c}") for c in df.columns])


def _same(df: DataFrame, by, low: bool = True) -> Column:
    keys = [F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by] + [F.col("column") == F.col("_of_column")]
    return reduce(lambda a, b: a & b, keys + ([df["_lo"] == F.col("_of_lo")] if low else []))


def _holds_rank() -> Column:
    place = F.col("rank") - F.col("_before")
    return (F.col("_of_upto") - F.col("_of_n") <= place) & (place < F.col("_of_upto"))


def _in_ranges(cells: DataFrame, targets: DataFrame, by) -> DataFrame:
    """Each cell with the open range that it lies in."""
    ranges = _aside(targets.filter("_lo < _hi").select(*by, "column", "_lo", "_hi").distinct(), by)
    inside = cells.join(ranges, _same(cells, by, low=False) & F.col("_x").between(F.col("_of_lo"), F.col("_of_hi")))
    return inside.select(*by, "column", "_x", F.col("_of_lo").alias("_lo"), F.col("_of_hi").alias("_hi"))


def _narrowed(cells: DataFrame, targets: DataFrame, by, logarithmic: bool) -> DataFrame:
    """The targets with the cut that holds their rank as their range.

    Equal cuts of the range tell near values apart, cuts of its logarithm those of different
    size; taking turns, any column is done in a few passes.
    """

    def place(name):
        x = F.col(name)
        # Halves keep differences finite; 700 makes all logarithms positive.
        return F.signum(x) * (F.log(F.abs(x) + 1e-300) + 700) if logarithmic else x / 2

    share = F.coalesce(F.try_divide(place("_x") - place("_lo"), place("_hi") - place("_lo")), F.lit(0.0))
    cut = F.least(F.floor(share * CUTS), F.lit(CUTS - 1))
    counts = _in_ranges(cells, targets, by).groupBy(*by, "column", "_lo", cut.alias("_cut")).agg(
        F.count("*").alias("_n"), F.min("_x").alias("_first"), F.max("_x").alias("_last"))
    counts = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*by, "column", "_lo").orderBy("_cut")))
    open_ones = targets.filter("_lo < _hi")
    moved = open_ones.join(_aside(counts, by), _same(open_ones, by) & _holds_rank()).withColumns({
        "_lo": F.col("_of_first"), "_hi": F.col("_of_last"), "_left": F.col("_of_n"), "_before": F.col("_before") + F.col("_of_upto") - F.col("_of_n")})
    return targets.filter("_lo = _hi").unionByName(moved.select(*targets.columns))


def _counted(cells: DataFrame, probs: list[float], by) -> DataFrame:
    """Few cells: a row per value and target next to it. A value covers the 0-based ranks from ``_upto - _n`` on."""
    counts = cells.groupBy(*by, "column", "_x").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by, "column")
    ranked = counts.withColumns({"_upto": F.sum("_n").over(group.orderBy("_x")), "_size": F.sum("_n").over(group)})

    def next_to(target):
        low, high, first = F.floor(target["position"]), F.ceil(target["position"]), F.col("_upto") - F.col("_n")
        return ((first <= low) & (low < F.col("_upto"))) | ((first <= high) & (high < F.col("_upto")))

    targets = F.array(*[F.struct(F.lit(float(p)).alias("prob"), (F.lit(float(p)) * (F.col("_size") - 1)).alias("position")) for p in probs])
    return ranked.select(*by, "column", F.col("_x").alias("_value"), F.inline(F.filter(targets, next_to)))


def _interpolated(ranked: DataFrame, by) -> DataFrame:
    share = F.max(F.col("position") - F.floor("position"))
    top = 1.7976931348623157e308
    value = F.when(F.min("_value") == F.max("_value"), F.min("_value")).otherwise(F.min("_value") * (1 - share) + F.max("_value") * share)
    found = ranked.groupBy(*by, "column", "prob").agg(value.alias("value"))
    return found.withColumn("value", F.when(F.abs("value") == top, F.signum("value") * float("inf")).otherwise(F.col("value"))).select(*by, "column", "prob", "value")


def fit_statistics(df: DataFrame, moments=(), quantile_requests=(), categories=()) -> dict:
    """Scalars for fitting, however many stages ask: moments in one job, all quantiles together, all categories in one.

    A category column's values become part of the fitted model, and with it of the driver.
    """
    moments, categories = sorted(set(moments)), sorted(set(categories))
    wanted = sorted(set(quantile_requests))
    ranked = sorted({c for c, _ in wanted})
    out: dict = {"moments": {}, "quantiles": {}, "categories": {}}
    if not (moments or ranked or categories):
        return out
    row = df.agg(F.count("*").alias("rows"), *[f(c).alias(f"{name}:{c}") for c in moments for name, f in (
        ("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]).first()
    if row["rows"] == 0:
        raise ValueError("cannot fit on an empty DataFrame")
    out["moments"] = {c: {n: row[f"{n}:{c}"] for n in ("mean", "std", "min", "max")} for c in moments}
    if ranked:
        out["quantiles"] = {pair: None for pair in wanted}
        for r in quantiles(df, ranked, sorted({p for _, p in wanted})).collect():  # a row per column and probability
            if (r["column"], r["prob"]) in out["quantiles"]:
                out["quantiles"][r["column"], r["prob"]] = r["value"]
    out["categories"] = category_values(df, categories)
    return out


def category_values(df: DataFrame, columns: list[str]) -> dict[str, list]:
    """The distinct values of each column, sorted; NULL is none."""
    out: dict[str, list] = {c: [] for c in columns}
    kinds: dict[str, list[str]] = {}
    for c in columns:
        kinds.setdefault(dict(df.dtypes)[c], []).append(c)
    for alike in kinds.values():
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in alike])
        for r in df.select(F.inline(cells)).filter("value is not null").distinct().orderBy("column", "value").collect():
            out[r["column"]].append(r["value"])
    return out
