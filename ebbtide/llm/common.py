"""Shared by the text operators: registration, reading, writing intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.session import work_path

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

# A word is a run of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    """Register a query ``(spark, folder) -> DataFrame`` and the SQL that gives the same rows."""

    def add(function):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


#: Bytes of a batch on its way to Python; texts may be long, so rows alone do not bound it.
BATCH_BYTES = str(16 << 20)
_DEFAULT_BATCH = str(64 << 20)


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless its own setting differs from Spark's default."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("b") == _DEFAULT_BATCH:
        spark.conf.set(name, BATCH_BYTES)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared folder and read it back.

    The lineage ends there: an executor lost later costs no recomputation, and what was
    decided in the table (sampled ranges, row numbers) is decided once.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def narrowed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names.

    Whatever else the table holds, also under clashing names, stays out of the way.
    """
    bounded_batches(df.sparkSession)
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def text_slices(texts: pa.Array, limit: int = 1 << 22) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive slices of a text column of about ``limit`` bytes each, with their first row."""
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)) if len(texts) else []
    block = np.cumsum(sizes) // limit if len(texts) else np.empty(0, np.int64)
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
    for start, stop in zip(edges, edges[1:]):
        if stop > start:
            yield start, texts.slice(start, stop - start)


_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable):
    """What this worker process keeps from task to task: one thing at a time."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def release() -> None:
    """Let go of what earlier tasks of other operators left in this worker process."""
    _KEPT.clear()


def as_bytes(texts: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column, empty for null."""
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def with_column(docs: DataFrame, text_col: str, name: str, kind: str, compute: Callable, keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with a column that ``compute`` makes from slices of the text.

    The rows pass through as they are, so nothing has to be joined back by an id that may be
    null or repeated.
    """
    bounded_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    made = f"_{name}"
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text__"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for start, texts in text_slices(batch.column(len(keep))):
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], compute(texts)], [*keep, made])

    return source.mapInArrow(run, ", ".join([*fields, f"`{made}` {kind}"])).withColumnRenamed(made, name)
