"""Streaming scoring of request files: rules, score, valid rows and rejects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ebbtide.operators.rules import check_requests, rejects, valid_rows
from ebbtide.operators.scoring import responses
from ebbtide.operators.shaping import requests_to_snapshot
from ebbtide.schema import CORRUPT, REQUEST_LINE


def read_request_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Request files as they arrive, JSON lines with text fields. The file limit bounds a micro-batch."""
    reader = spark.readStream.schema(REQUEST_LINE).option("columnNameOfCorruptRecord", CORRUPT)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def score_requests(checked: DataFrame, scorer: Callable[[DataFrame], DataFrame], version) -> DataFrame:
    """Valid requests -> response rows."""
    return responses(scorer(requests_to_snapshot(valid_rows(checked))), version)


def start_scoring(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, version,
                  available_now: bool = True) -> StreamingQuery:
    """Score each micro-batch into ``out/valid`` and ``out/rejects``.

    Every step looks at one record at a time, so there is no state and no watermark. A
    batch that is run again after a failure overwrites its own ``batch_id`` partition
    and nothing else, so each record appears once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = check_requests(batch).persist()
        try:
            for name, part in (("valid", score_requests(checked, scorer, version)), ("rejects", rejects(checked))):
                part.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").partitionBy("batch_id").option(
                    "partitionOverwriteMode", "dynamic").parquet(f"{out}/{name}")
        finally:
            checked.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
