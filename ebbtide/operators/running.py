"""Running totals over a global order, without putting the whole order in one task."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Above this many distinct values a single sorted window is replaced by value ranges.
ROWS_PER_TASK = 1_000_000
# Splitters drawn for each range; its size varies by about a part in the root of this.
OVERSAMPLE = 32
# Ranges whose sums are added up in one task.
RANGES_PER_BLOCK = 4_096


def range_bounds(df: DataFrame, column: str, rows_per_task: int = ROWS_PER_TASK) -> list[float]:
    """Interior cut points that split the distinct values into ranges of about ``rows_per_task``.

    Every task draws the same share of values by their hash, so draws merge by leaving out
    repeats, a value held by a third of the rows is drawn once at most, and a task that runs
    again draws the same. Only the draws are sorted, and only every ``OVERSAMPLE``-th of them
    comes back, as a literal. Empty when everything fits one task.
    """
    share = min(1.0, OVERSAMPLE / rows_per_task)
    drawn = F.pmod(F.xxhash64(column), F.lit(1 << 30)) < int(share * (1 << 30))
    draws = df.filter(F.col(column).isNotNull() & drawn).select(F.col(column).cast("double").alias("v")).distinct()
    step = max(1, round(rows_per_task * share))
    place = F.row_number().over(Window.orderBy("v"))
    points = draws.withColumn("place", place).filter(F.col("place") % step == 0).select("v").collect()
    # The last cut would leave less than a range behind it.
    return sorted(p["v"] for p in points)[:-1]


def running_totals(
    df: DataFrame,
    order: str,
    totals: dict[str, str],
    by: tuple[str, ...] = (),
    descending: bool = False,
    bounds: list[float] | None = None,
) -> DataFrame:
    """Add inclusive running sums: ``totals`` maps a new column to the column it sums.

    ``order`` must be unique within ``by``, and neither NULL nor NaN. With ``bounds`` each
    task sorts one value range; the sums of the ranges before it arrive through a join with
    one row per range and group. Those come in two levels: ranges are added up within blocks
    of ``RANGES_PER_BLOCK``, and only the blocks' sums in one order. A NULL group is a group.
    """
    by = list(by)
    direction = F.desc if descending else F.asc
    if not bounds:
        window = Window.partitionBy(*by).orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({new: F.sum(old).over(window) for new, old in totals.items()})

    splits = [-float("inf"), *bounds, float("inf")]
    ranged = Bucketizer(splits=splits, inputCol=order, outputCol="_range").transform(df)
    block = F.floor(F.col("_range") / RANGES_PER_BLOCK)
    sums = ranged.groupBy(*by, "_range").agg(*[F.sum(old).alias(new) for new, old in totals.items()]).withColumn("_block", block)
    earlier = Window.partitionBy(*by, "_block").orderBy(direction("_range")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(b).alias(f"_of_{b}") for b in by], F.col("_range").alias("_of_range"), F.col("_block").alias("_of_block"),
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in totals])
    if len(bounds) >= RANGES_PER_BLOCK:
        ahead = Window.partitionBy(*by).orderBy(direction("_block")).rowsBetween(Window.unboundedPreceding, -1)
        blocks = sums.groupBy(*by, "_block").agg(*[F.sum(n).alias(n) for n in totals]).select(
            *[F.col(b).alias(f"_in_{b}") for b in by], "_block", *[F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"_ahead_{n}") for n in totals])
        inside = F.col("_of_block") == F.col("_block")
        for b in by:
            inside &= F.col(f"_of_{b}").eqNullSafe(F.col(f"_in_{b}"))
        offsets = offsets.join(blocks, inside).withColumns({f"_before_{n}": F.col(f"_before_{n}") + F.col(f"_ahead_{n}") for n in totals}).drop(
            "_block", *[f"_in_{b}" for b in by], *[f"_ahead_{n}" for n in totals])
    within = Window.partitionBy(*by, "_range").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({new: F.sum(old).over(within) for new, old in totals.items()})
    same = F.col("_range") == F.col("_of_range")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"_of_{b}"))
    return (
        local.join(offsets, same)
        .withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in totals})
        .drop("_range", "_of_range", "_of_block", *[f"_of_{b}" for b in by], *[f"_before_{n}" for n in totals])
    )
