"""Quartile bucket digests of whole texts (operator 5).

Byte triplets are hashed into buckets and counted; a digest holds the length on a log
scale and, for each bucket, the quarter of all buckets that its count falls into. Digests
are compared by the steps between quarters, bucket by bucket, and the lengths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.common import narrowed, query, stored, table, text_slices

BUCKETS = 256
#: Places of the bytes of a triplet, counted from its first.
TRIPLETS = ((0, 1, 2), (0, 2, 4))
#: What a bucket that is in the lowest quarter of one text and in the highest of the other counts, as against three single steps.
FARTHEST = 6
#: What lengths count at most, as a share of all that buckets can.
LENGTH_SHARE = 0.1

_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
_STEPS = np.array([0, 1, 2, FARTHEST])


def bucket_counts(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    shift = np.uint32(33 - BUCKETS.bit_length())
    for places in TRIPLETS:
        n = len(b) - places[-1]
        if n > 0:
            mixed = sum((b[p : p + n] * np.uint32(f) for p, f in zip(places, _FACTORS)), np.zeros(n, np.uint32))
            counts += np.bincount((mixed ^ mixed >> np.uint32(15)) * np.uint32(_FACTORS[1]) >> shift, minlength=BUCKETS)
    return counts


def digest(data: bytes) -> str:
    """Two hex digits for the length, then two bits per bucket; equal texts have equal digests."""
    counts = bucket_counts(data)
    ordered = np.sort(counts)
    quarters = ordered[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, None] > quarters).sum(axis=1).astype(np.uint8)
    packed = codes.reshape(-1, 4) @ np.array([64, 16, 4, 1], np.uint8)
    size = min(255, round(8 * np.log2(1 + len(data))))
    return f"{size:02x}" + packed.astype(np.uint8).tobytes().hex()


def _codes(mark: str) -> tuple[int, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(mark), np.uint8)
    return int(raw[0]), (raw[1:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).ravel()


def likeness(a: str, b: str) -> float:
    """From 0 to 1: one less the difference of two digests as a share of the largest possible."""
    (m, x), (n, y) = _codes(a), _codes(b)
    steps = _STEPS[np.abs(x.astype(np.int8) - y.astype(np.int8))].sum() / (FARTHEST * len(x))
    return float(1 - (1 - LENGTH_SHARE) * steps - LENGTH_SHARE * min(1.0, abs(m - n) / 64))


def edited(text: str, following: str) -> str:
    """The last third replaced by as many code points of the following text, or all it has."""
    gone = len(text) // 3
    return text[: len(text) - gone] + following[:gone]


_RESULT = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _row(key, text: str, mark: str, following: str, next_mark: str) -> tuple:
    changed = edited(text, following).encode()
    changed_mark = digest(changed)
    return key, len(text), hashlib.sha256(changed).hexdigest(), mark, changed_mark, likeness(mark, changed_mark), likeness(mark, next_mark)


def edited_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of every text and of its edited text, with their likeness, in one row each.

    The next document is the one with the next smaller id, after the smallest the largest;
    null ids come last, equal ids in order of their texts. A null text is empty. A single
    document is its own next one; an empty table gives an empty result; extra columns are
    left out. One shuffle brings the texts into ranges of ids. Each task pairs its own rows;
    the first and the last text of each range, two per task, are paired afterwards.
    """
    source = narrowed(docs, id=id_col, text=text_col)
    kind = source.schema["id"].dataType.simpleString()
    id_type = pa.schema(source.limit(0).toArrow().schema).field("id").type
    columns = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def batch_of(rows: list[tuple], more: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
        kinds = [*columns, *[t for _, t in more]]
        arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(arrays, [*_RESULT, *[n for n, _ in more]])

    edges = [("edge", pa.string()), ("part", pa.int64()), ("text", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            for start, texts in text_slices(batch.column(1)):
                out = []
                for key, text in zip(batch.column(0).slice(start, len(texts)).to_pylist(), texts.to_pylist()):
                    text = text or ""
                    mark = digest(text.encode())
                    if last is None:
                        out.append((key, None, None, mark, None, None, None, "first", part, text))
                    else:
                        out.append((*_row(*last, text, mark), None, None, None))
                    last = key, text, mark
                yield batch_of(out, edges)
        if last is not None:
            yield batch_of([(last[0], None, None, last[2], None, None, None, "last", part, last[1])], edges)

    ranged = source.repartitionByRange(F.desc("id")).sortWithinPartitions(F.desc("id"), "text")
    found = stored(ranged.mapInArrow(run, schema + ", edge string, part bigint, text string"), "digests")

    # One row per task: which range follows which, the first one after the last.
    order = Window.orderBy("part")
    firsts = found.where("edge = 'first'").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_mark"))
    follows = firsts.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())).alias("next"))
    lasts = (
        found.where("edge = 'last'").select("id", "text", "fingerprint", "part").join(follows, "part")
        .join(firsts.withColumnRenamed("part", "next"), "next").select("id", "text", "fingerprint", "next_text", "next_mark")
    )

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of([_row(*r) for r in zip(*[c.to_pylist() for c in batch.columns])], [])

    return found.where("edge is null").select(*_RESULT).union(lasts.mapInArrow(pair, schema))


@query("op5_digests")
def op5_digests(spark, folder):
    """Digest of every document and of its edited text, and how alike they are."""
    return edited_digests(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")
