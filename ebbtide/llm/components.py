"""Connected components of an edge table by alternating stars.

Every round links the larger neighbours of a node to its smallest one, then the smaller
ones, so that each component shrinks to a star in about log(size) rounds, whatever its
shape. A node with very many neighbours is aggregated before the shuffle; the join back
is one that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import stored


def _round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = (
        both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    )
    least = large.groupBy("u").agg(F.min("v").alias("v"))
    moved = (
        large.join(least.withColumnRenamed("v", "m"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    )
    return least.union(moved).distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, label)`` for every node that is not the smallest of its component.

    Edges join columns ``a`` and ``b`` of one comparable type in either direction; null
    ends and loops count for nothing, repeated edges once. The label is the smallest node
    of the component, so a node missing from the result is its own label. An empty edge
    table gives an empty result.
    """
    state = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")) & F.col(a).isNotNull() & F.col(b).isNotNull())
        .distinct(),
        "edges",
    )
    mark = state.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while mark[0]:
        state = stored(_round(state), "stars")
        now = state.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return state.select(F.col("u").alias("node"), F.col("v").alias("label"))
