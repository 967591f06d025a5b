"""Exact histogram of encoded lengths, and what it answers (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.common import narrowed, query, stored, table
from ebbtide.llm.tokens import encoded_slices

VOCABULARY = "word_bpe_49k.json"
#: Lengths that are summed up in one task.
SPAN = 256


def length_histogram(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``(length, docs)``: how many texts encode to each length; a null text has length 0.

    Each task counts its own texts, so the shuffle carries one row per length and slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, counts in encoded_slices(tokenizer, batch.column(0)):
                lengths, docs = np.unique(counts, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64()), pa.array(docs, pa.int64())], ["length", "docs"])

    counted = narrowed(docs, text=text_col).mapInArrow(run, "length bigint, docs bigint")
    return counted.groupBy("length").agg(F.sum("docs").alias("docs"))


def limits(histogram: DataFrame, span: int = SPAN) -> DataFrame:
    """One row per length that occurs, taken as a context limit.

    ``docs`` of that length; ``docs_longer`` and ``tokens_longer`` above it (suffix sums);
    ``tokens`` of all; ``truncated_tokens`` if every document is cut at the limit;
    ``docs_within`` up to it and ``quantile``, their share. A limit between two lengths is
    answered by the lower one's row and the documents above it (``truncated_at``). The sums
    run over spans of lengths, joined by the totals of the spans above, so no task sees them
    all. An empty histogram gives an empty result.
    """
    spans = histogram.select("length", "docs", F.expr(f"length div {span}").alias("span"), (F.col("length") * F.col("docs")).alias("tokens"))
    above = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    # One row per 256 lengths: a few thousand for the longest text that fits in memory.
    totals = spans.groupBy("span").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    whole = Window.partitionBy()
    totals = totals.select(
        "span", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("d").over(whole).alias("all_docs"), F.sum("t").over(whole).alias("all_tokens"),
    )
    longer = Window.partitionBy("span").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    summed = spans.withColumns({
        "docs_longer": F.coalesce(F.sum("docs").over(longer), F.lit(0)), "tokens_longer": F.coalesce(F.sum("tokens").over(longer), F.lit(0)),
    }).join(totals, "span")
    docs_longer, tokens_longer = F.col("docs_longer") + F.col("docs_above"), F.col("tokens_longer") + F.col("tokens_above")
    return summed.select(
        "length", "docs", docs_longer.alias("docs_longer"), tokens_longer.alias("tokens_longer"), F.col("all_tokens").alias("tokens"),
        (F.col("all_tokens") - tokens_longer + F.col("length") * docs_longer).alias("truncated_tokens"),
        (F.col("all_docs") - docs_longer).alias("docs_within"), ((F.col("all_docs") - docs_longer) / F.col("all_docs")).alias("quantile"),
    )


def truncated_at(rows: DataFrame, limit: int) -> int:
    """Tokens left if every document is cut at any ``limit``; ``rows`` are those of ``limits``."""
    cut = F.least(F.col("length"), F.lit(limit)) * F.col("docs")
    return rows.select(F.coalesce(F.sum(cut), F.lit(0))).first()[0]


def length_quantile(rows: DataFrame, share: float) -> int | None:
    """The smallest length that at least this share of documents stays within."""
    return rows.where(F.col("quantile") >= share).select(F.min("length")).first()[0]


@query("op6_token_counts")
def op6_token_counts(spark, folder):
    """Totals, quantiles and truncated totals of the documents for every length as the limit."""
    histogram = stored(length_histogram(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY)), "lengths")
    return limits(histogram)
