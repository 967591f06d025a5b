"""Small scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded_id(number: Column, prefix: str = "CUST", width: int = 6) -> Column:
    """Prefix plus zero-padded number. Longer numbers keep all their digits."""
    return F.format_string(f"{prefix}%0{width}d", number)


def ellipsis(text: Column, width: int = 50) -> Column:
    """Cut long text and mark the cut; NULL stays NULL."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def file_stem(path: Column) -> Column:
    """Last path element without its extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def time_suffix(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd-HHmmss")


def version_label(version: Column) -> Column:
    return F.concat(F.lit("v"), version.cast("string"))


def prefixed_metrics(metrics: Column, prefix: str = "metric_") -> Column:
    """Metric map -> tag map with prefixed keys and text values."""
    keyed = F.transform_keys(metrics, lambda k, _: F.concat(F.lit(prefix), k))
    return F.transform_values(keyed, lambda _, v: v.cast("string"))


def lookup(mapping: Column, key: str, default=None) -> Column:
    """Map entry or a default."""
    value = F.try_element_at(mapping, F.lit(key))
    return value if default is None else F.coalesce(value, F.lit(default))


def equal_width_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based bin of ``x`` among ``bins`` equal bins of [low, high], last bin closed.

    The division gives the bin up to rounding; two comparisons with the edges of that
    bin make it exact, so a value on an edge always falls to the right of it.
    A zero range is widened by a half to both sides.
    """
    flat = low == high
    low = F.when(flat, low - 0.5).otherwise(low)
    high = F.when(flat, high + 0.5).otherwise(high)
    step = (high - low) / F.lit(float(bins))
    guess = F.least(F.floor((x - low) / step), F.lit(bins - 1))
    guess = F.greatest(guess, F.lit(0))
    too_high = x < low + guess * step
    too_low = (x >= low + (guess + 1) * step) & (guess < bins - 1)
    return (guess - too_high.cast("int") + too_low.cast("int")).cast("long")


def grid(start: float, stop: float, count: int) -> list[float]:
    """``count`` evenly spaced values from start to stop, stop exact."""
    step = (stop - start) / (count - 1)
    return [start + i * step for i in range(count - 1)] + [stop]


def grid_rank(x: Column, points: list[float]) -> Column:
    """How many of the ascending points are <= x; none for NULL and NaN.

    The points are halved, so a row takes as many comparisons as their number has digits in base two.
    """

    def rank(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(x >= F.lit(points[middle]), rank(middle + 1, high)).otherwise(rank(low, middle))

    return F.when(x.isNull() | F.isnan(x), 0).otherwise(rank(0, len(points))).cast("long")
