"""Request batches on a stream: accepted or refused as a whole, however their records arrive.

Rules are column expressions on single records. Only what a verdict needs goes through state,
by batch: the records that have come, at most as many as a batch may hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ebbtide.operators.rules import ERROR_TYPE, ERRORS, check_requests
from ebbtide.operators.scoring import responses
from ebbtide.operators.shaping import requests_to_snapshot
from ebbtide.schema import CORRUPT, REQUEST, REQUEST_LINE, require_columns

SIZE = 100
WAIT = "1 hour"
BATCH_LINE = T.StructType([
    T.StructField("batch", T.StringType()), T.StructField("position", T.LongType()), T.StructField("records", T.LongType()),
    T.StructField("at", T.TimestampType()), *REQUEST_LINE.fields])
VERDICT = "batch string, records bigint, invalid bigint, accepted boolean, reason string, bodies array<string>"
_NAMES = ["batch", "records", "invalid", "accepted", "reason", "bodies"]
_STATE = "decided boolean, records bigint, positions array<bigint>, wrong array<boolean>, bodies array<string>, last bigint"
_BODY = T.StructType([*REQUEST.fields, T.StructField(ERRORS, ERROR_TYPE)])

# What a run leaves, by table; a run without such rows leaves an empty one.
OUTCOMES = {
    "verdicts": "batch string, records bigint, invalid bigint, accepted boolean, reason string",
    "valid": "customer_id string, churn_prediction string, churn_probability double, risk_level string, confidence double, model_version string",
    "rejects": "batch string, customer_id string, field string, message string, type string, input string",
}


def read_outcome(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.schema(OUTCOMES[name]).parquet(f"{out}/{name}").drop("batch_id")


def read_batch_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Records of request batches as JSON lines: batch, position from 0, records in the batch, time, request fields."""
    reader = spark.readStream.schema(BATCH_LINE).option("columnNameOfCorruptRecord", CORRUPT)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder)


def _judge(size: int, wait_ms: int) -> Callable:
    def row(key, records, invalid, accepted, reason, bodies) -> pd.DataFrame:
        return pd.DataFrame([(key[0], records, invalid, accepted, reason, bodies)], columns=_NAMES, dtype=object)

    def judge(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        decided, records, positions, wrong, bodies, last = state.get if state.exists else (False, None, [], [], [], 0)
        found = dict(zip(positions, zip(wrong, bodies)))
        if state.hasTimedOut:
            state.remove()
            if not decided:
                bad = [found[p][1] for p in sorted(found) if found[p][0]]
                yield row(key, records, len(bad), False, "incomplete", bad)
            return
        verdict = None
        for frame in frames:
            for record in frame["record"].tolist():
                position, n, at, is_wrong, body = record.split("\t", 4)
                last = max(last, int(at)) if at else last
                if decided:
                    continue
                n, position = (int(v) if v else None for v in (n, position))
                if n is not None and n > size:
                    verdict = row(key, n, None, False, "too large", [])
                elif n is None or position is None or not 0 <= position < n or records not in (None, n):
                    verdict = row(key, n, None, False, "misnumbered", [])
                else:
                    records = n
                    found.setdefault(position, (is_wrong == "true", body))
                    if len(found) == n:
                        bad = [found[p][1] for p in sorted(found) if found[p][0]]
                        verdict = row(key, n, len(bad), not bad, "invalid" if bad else None, bad or [found[p][1] for p in sorted(found)])
                if verdict is not None:
                    decided, found = True, {}
                    yield verdict
                    verdict = None
        order = sorted(found)
        state.update((decided, records, order, [found[p][0] for p in order], [found[p][1] for p in order], last))
        state.setTimeoutTimestamp(max(last + wait_ms, state.getCurrentWatermarkMs() + 1))

    return judge


def judged_batches(stream: DataFrame, size: int = SIZE, wait: str = WAIT) -> DataFrame:
    """One verdict per batch, as soon as it is certain, with the records it lets through or the invalid ones.

    A batch is accepted when all its records have come and none is invalid. It is refused when one
    is (``invalid``), when it states more than ``size`` records (``too large``, without waiting for
    them; invalid ones are not counted), when positions or the stated number contradict each other
    (``misnumbered``), and when records are still missing ``wait`` after its last one
    (``incomplete``). A record that comes again is dropped, also after the verdict, until ``wait``
    has passed. Records later than the watermark are dropped by Spark. State is at most ``size``
    records a batch.
    """
    require_columns(stream, ["batch", "position", "records", "at"])
    kept = stream.withWatermark("at", wait)
    checked = check_requests(kept)
    # One text a record: every column of its own is converted anew for every batch. JSON holds no bare tabs.
    at = F.unix_millis("at").cast("string")
    numbers = [F.coalesce(c, F.lit("")) for c in (F.col("position").cast("string"), F.col("records").cast("string"), at, (F.size(ERRORS) > 0).cast("string"))]
    narrow = checked.select("batch", "at", F.concat_ws("\t", *numbers, F.to_json(F.struct(*REQUEST.names, ERRORS))).alias("record"))
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    return narrow.groupBy("batch").applyInPandasWithState(_judge(size, wait_ms), VERDICT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def records_of(verdicts: DataFrame, accepted: bool) -> DataFrame:
    """The records of accepted batches, or the invalid records of refused ones with their errors."""
    return verdicts.where(F.col("accepted") == accepted).select("batch", F.explode("bodies").alias("body")).select(
        "batch", F.from_json("body", _BODY).alias("_r")).select("batch", "_r.*")


def start_batches(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, version, size: int = SIZE, wait: str = WAIT,
                  available_now: bool = True) -> StreamingQuery:
    """Verdicts into ``out/verdicts``, responses of accepted batches into ``out/valid``, errors of refused ones into ``out/rejects``.

    A micro-batch that runs again after a failure overwrites its own partition and nothing else.
    """

    def write(verdicts: DataFrame, batch_id: int) -> None:
        kept = verdicts.persist()
        try:
            valid = responses(scorer(requests_to_snapshot(records_of(kept, True).drop("batch", ERRORS))), version)
            wrong = records_of(kept, False).select("batch", "customer_id", F.inline(ERRORS))
            for name, part in (("verdicts", kept.drop("bodies")), ("valid", valid), ("rejects", wrong)):
                part.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").partitionBy("batch_id").option(
                    "partitionOverwriteMode", "dynamic").parquet(f"{out}/{name}")
        finally:
            kept.unpersist()

    writer = judged_batches(stream, size, wait).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

