"""Mix sources to target weights by hash-ordered prefix sums (operator 2).

Documents of a source stand in the order of a hash of their id and text, which is random
but the same in every run. A source's words are taken in that order, epoch after epoch,
until its budget is met exactly; the last document is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.common import WORD, narrowed, query, stored, table

WEIGHTS = (5, 2, 1)
#: All targets together, as a share of all words.
SHARE = 1.5
#: Largest target, in epochs of the source.
EPOCHS = 2.0
#: Documents of a source that are summed up in one task.
RANGE = 4_096

_GAP = r"[\x20\x09-\x0D]*"
_SPACES = " \t\n\x0b\f\r"


def word_count(text):
    """Runs of anything but the six ASCII white spaces; 0 for null."""
    marked = F.regexp_replace(text, f"{_GAP}{WORD}{_GAP}", "x")
    return F.coalesce(F.length(F.translate(marked, _SPACES, "")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """``(source, source_size, docs, rank, target)`` from rows ``(source, source_size, docs)``, one per source.

    Weights go to the sources by code point, null last, over and over. A target is at most
    ``epochs`` times its source; what is above is shared among the others by weight. That is
    one water level: a target is the lower of its limit and level times weight. With the
    limits in rising order of limit by weight, the level that is left for the others rises
    with each source it is above the limit of, and falls from there on; so it is the highest.
    One row per source is all that the windows see.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    rank = F.row_number().over(by_name) - 1
    named = sizes.withColumn("rank", rank.cast("bigint")).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    limited = named.withColumn("limit", F.lit(float(epochs)) * F.col("source_size"))
    full = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    below = full.rowsBetween(Window.unboundedPreceding, -1)
    onward = full.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    rest = F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(below), F.lit(0.0))
    levels = limited.withColumn("level", rest / F.sum("weight").over(onward))
    target = F.least("limit", F.max("level").over(whole) * F.col("weight"))
    return levels.select("source", "source_size", "docs", "rank", target.alias("target"))


def _identity(id_col: str, source_col: str, text_col: str):
    """A hash that rows share only if id, source and text are the same, nulls included."""
    marked = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (F.col(f"`{n}`").cast("string") for n in (id_col, source_col))]
    return F.md5(F.concat(*marked, F.coalesce(F.concat(F.lit("+"), F.col(f"`{text_col}`")), F.lit("-"))))


def _numbered(sized: DataFrame) -> DataFrame:
    """``sized`` with ``copy``: rows of one identity are numbered from 0, whichever stands where.

    Each part of the table numbers its own rows; what the parts before hold is counted
    first. A row that very many repeat is one row per part in what is counted and added up.
    """
    counts = sized.groupBy("ident", "place").agg(F.count("*").alias("n"))
    several = counts.groupBy("ident").agg(F.sum("n").alias("all")).where("all > 1").select("ident")
    earlier = Window.partitionBy("ident").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.join(several, "ident", "left_semi").select("ident", "place", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    here = F.row_number().over(Window.partitionBy("ident", "place").orderBy("key")) - 1
    return sized.join(before, ["ident", "place"], "left").withColumn("copy", F.when(F.col("before").isNull(), F.lit(0)).otherwise(F.col("before") + here).cast("bigint")).drop("before", "place")


def mix(
    docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, per_range: int = RANGE,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """``(id, source, key, ident, size, source_size, target, taken)`` of every row.

    ``taken`` is the number of words that the mix takes, repeats counted: whole epochs, then
    the documents in the order of ``key`` until the source's rounded target is met exactly.
    A null text has size 0 and takes nothing; a null source is a source, the last one; a
    null id is as good as any. Rows that repeat id, source and text share ``ident``; they are
    numbered, and all but the first stand at a place of their own by a hash of the number, so
    that however many they are, they spread over all ranges. An empty table gives an empty
    result; extra columns are left out.
    """
    source = narrowed(docs, id=id_col, text=text_col, source=source_col)
    key = F.md5(F.concat_ws("|", F.col("id").cast("string"), "text"))
    ident = _identity("id", "source", "text")
    rows = stored(source.select("id", "source", key.alias("key"), ident.alias("ident"), F.spark_partition_id().alias("place"), word_count("text").alias("size")), "sizes")
    sized = _numbered(rows).withColumn("turn", F.when(F.col("copy") == 0, F.col("key")).otherwise(F.md5(F.concat_ws("#", "key", F.col("copy").cast("string")))))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    targets = stored(source_targets(sizes, weights, share, epochs), "targets").withColumnRenamed("source", "named")
    # Hash values are spread evenly, so equal ranges of them hold about as many documents each.
    place = F.conv(F.substring("turn", 1, 8), 16, 10).cast("bigint")
    ranges = F.ceil(F.col("docs") / per_range).cast("bigint")
    ranged = sized.join(targets, F.col("source").eqNullSafe(F.col("named"))).withColumn("range", F.shiftright(place * ranges, 32)).drop("named", "docs")
    earlier = Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("rank", "range").agg(F.sum("size").alias("words")).select("rank", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    ahead = Window.partitionBy("rank", "range").orderBy("turn", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("ahead", F.coalesce(F.sum("size").over(ahead), F.lit(0))).join(bases, ["rank", "range"])
    budget = F.floor(F.col("target") + 0.5).cast("bigint")
    whole = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    part = F.least("size", F.greatest(F.lit(0), F.col("budget") - F.col("whole") * F.col("source_size") - F.col("base") - F.col("ahead")))
    return placed.withColumn("budget", budget).withColumn("whole", whole).select(
        "id", "source", "key", "ident", "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("bigint").alias("taken")
    )


def mixed_documents(
    docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, the cut one with its first words alone.

    Columns are those of ``docs``. Rows that repeat id, source and text are pooled: what they
    take together comes as copies of one of them, which is found before the join, in each
    task first. Rows that take nothing are left out.
    """
    taken = mix(docs, weights, share, epochs, id_col=id_col, text_col=text_col, source_col=source_col)
    pooled = taken.groupBy("ident").agg(F.max("size").alias("__size"), F.sum("taken").alias("__taken")).where("__taken > 0").withColumnRenamed("ident", "__ident")
    joined = docs.withColumn("__ident", _identity(id_col, source_col, text_col)).dropDuplicates(["__ident"]).join(pooled, "__ident")
    copies = joined.withColumn("__copy", F.explode(F.expr("sequence(1L, (__taken + __size - 1) div __size)")))
    left = F.col("__taken") - (F.col("__copy") - 1) * F.col("__size")
    words = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(f"{_GAP}{WORD}"), F.lit(0))
    cut = F.when(left < F.col("__size"), F.array_join(F.slice(words, F.lit(1), left.cast("int")), "")).otherwise(F.col(f"`{text_col}`"))
    return copies.withColumn(text_col, cut).select(*[F.col(f"`{c}`") for c in docs.columns])


MIX_SQL = rf"""
WITH sized AS (
  SELECT * EXCLUDE (key, copy), CASE WHEN copy = 0 THEN key ELSE md5(key || '#' || CAST(copy AS VARCHAR)) END AS turn
  FROM (SELECT doc_id, source, md5(concat_ws('|', CAST(doc_id AS VARCHAR), text)) AS key,
               row_number() OVER (PARTITION BY doc_id, source, text) - 1 AS copy,
               CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size
        FROM documents)),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
named AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rank FROM sizes),
weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS upper FROM named),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(upper) OVER (ORDER BY upper / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY upper / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, least(upper, (max(level) OVER ()) * weight) AS target
  FROM levels),
placed AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget,
         CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY turn, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
cut AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM placed)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + least(size, greatest(0, budget - whole * source_size - ahead)) AS BIGINT) AS taken
FROM cut
"""


@query("op2_mixing", MIX_SQL)
def op2_mixing(spark, folder):
    """Every document with its size, its source's size and target, and the words the mix takes."""
    return mix(table(spark, folder, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
