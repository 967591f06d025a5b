"""Exact duplicates by an exchange of Golomb-coded fingerprints (operator 12).

Texts stay where they are while their fingerprints travel. The rows are written once,
unshuffled, as a table bucketed by blocks of input partitions. Each block sorts its
distinct fingerprints, cuts the list by owner (an owner holds a range of the fingerprint
space) and sends the gaps of each piece in Golomb-Rice code. An owner decodes what all
blocks sent, and answers each with a bitmap: which of its fingerprints another block has
too. A block turns the bitmaps, and what it repeats itself, into one bit per row. Only the
rows whose bit is set send their text, and texts are compared byte by byte, combined
before the shuffle, so that a group holding a third of all rows arrives as one text a task.

Fingerprints have eight bits more than the number of rows needs, so about one clean row in
256 is a suspect for nothing; it is cleared by its bytes.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import as_bytes, bounded_batches, query, release, stored, table, text_slices
from ebbtide.session import work_path

SEED = 42
#: Bits of a fingerprint beyond the logarithm of the number of rows.
SPARE_BITS = 8
#: Fingerprints that an owner takes, about; there are as many owners as this needs.
OWNED = 1 << 21
#: Blocks a bucket, so that buckets come out about even.
BLOCKS = 4
_HEADER = struct.Struct("<IIB")
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def golomb_encode(values: np.ndarray, base: int) -> bytes:
    """Ascending distinct unsigned numbers from ``base`` on, as Golomb-Rice coded gaps."""
    gaps = np.diff(values, prepend=np.uint64(base))
    mean = max(1.0, float(values[-1] - np.uint64(base)) / len(values)) if len(values) else 1.0
    low = max(0, int(np.log2(0.69 * mean)) if mean > 1.5 else 0)
    ends = np.cumsum((gaps >> np.uint64(low)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    rest = ((gaps[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    high = np.packbits(unary).tobytes()
    return _HEADER.pack(len(values), len(high), low) + high + np.packbits(rest).tobytes()


def golomb_decode(data: bytes, base: int) -> np.ndarray:
    """The numbers that ``golomb_encode`` wrote."""
    count, size, low = _HEADER.unpack_from(data)
    body = np.frombuffer(data, np.uint8, offset=_HEADER.size)
    ends = np.flatnonzero(np.unpackbits(body[:size]))[:count]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(low)
    if low:
        rest = np.unpackbits(body[size:], count=count * low).reshape(count, low).astype(np.uint64)
        gaps |= (rest << np.arange(low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(base)


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed, empty for null."""
    return F.translate(F.coalesce(text, F.lit("")), _CAPITALS, _CAPITALS.lower())


def _written(docs: DataFrame, id_col: str, text_col: str, whole: bool) -> DataFrame:
    """Rows ``(row, id, text[, doc], print, sha, block)``, bucketed by block without a shuffle."""
    spark = docs.sparkSession
    bounded_batches(spark)
    columns = [F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")]
    source = docs.select(*columns, *([F.struct("*").alias("doc")] if whole else []))
    names = [*source.columns, "print", "sha"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for start, texts in text_slices(batch.column(2)):
                low = [t.lower() for t in as_bytes(texts)]  # of bytes, lower() changes A-Z alone
                prints = np.array([xxhash.xxh64_intdigest(t, SEED) for t in low], np.uint64).view(np.int64)
                shas = pa.array([hashlib.sha256(t).digest() for t in low], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(start, len(texts)).columns, pa.array(prints), shas], names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = source.mapInArrow(run, ", ".join([*fields, "print bigint", "sha binary"]))
    marked = marked.withColumn("block", F.pmod(_task(), F.lit(BLOCKS * buckets)).cast("int"))
    name = f"texts_{uuid.uuid4().hex}"
    marked.write.bucketBy(buckets, "block").option("path", work_path(spark, "texts")).saveAsTable(name)
    found = spark.table(name)
    # The files stay; the name was needed only because a bucketed table must have one.
    spark.sql(f"DROP TABLE {name}")
    return found


def _task() -> Column:
    return F.shiftright("row", 33)


def _place() -> Column:
    return F.col("row").bitwiseAND(F.lit((1 << 33) - 1))


def _suspects(rows: DataFrame, spare_bits: int, owned: int) -> DataFrame:
    """``(block, bits)``: by input partition, a bit for each row whose fingerprint is found twice."""
    spark, count = rows.sparkSession, rows.count()
    width = min(64, max(1, (count - 1).bit_length() if count else 1) + spare_bits)
    # An owner's range is a prefix of the fingerprint.
    prefix = min(width, max(0, (-(-count // owned) - 1).bit_length()))
    heads, rest = rows.select("block", "row", "print"), np.uint64(width - prefix)

    def prints(block: pa.Table) -> np.ndarray:
        return block.column("print").to_numpy().view(np.uint64) >> np.uint64(64 - width)

    def pieces(found: np.ndarray):
        """Owner and slice of an ascending list."""
        owners = (found >> rest) if prefix else np.zeros(len(found), np.uint64)
        edges = [0, *(np.flatnonzero(np.diff(owners)) + 1).tolist(), len(found)]
        return [(int(owners[a]), a, b) for a, b in zip(edges, edges[1:])]

    def send(block: pa.Table) -> pa.Table:
        found = np.unique(prints(block))
        sent = [(o, golomb_encode(found[a:b], o << int(rest))) for o, a, b in pieces(found)]
        own = block.column("block")[0].as_py()
        return pa.table({"block": pa.array([own] * len(sent), pa.int32()), "owner": pa.array([o for o, _ in sent], pa.int64()),
                         "data": pa.array([d for _, d in sent], pa.binary())})

    def own(lists: pa.Table) -> pa.Table:
        base = lists.column("owner")[0].as_py() << int(rest)
        decoded = [golomb_decode(d, base) for d in lists.column("data").to_pylist()]
        _, back, times = np.unique(np.concatenate(decoded), return_inverse=True, return_counts=True)
        twice, ends = times[back] > 1, np.cumsum([len(d) for d in decoded])
        bits = [np.packbits(part).tobytes() for part in np.split(twice, ends[:-1])]
        return pa.table({"block": lists.column("block"), "owner": lists.column("owner"), "bits": pa.array(bits, pa.binary())})

    def mark(block: pa.Table, answers: pa.Table) -> pa.Table:
        found, back, times = np.unique(prints(block), return_inverse=True, return_counts=True)
        answered = dict(zip(answers.column("owner").to_pylist(), answers.column("bits").to_pylist()))
        twice = times > 1
        for o, a, b in pieces(found):
            twice[a:b] |= np.unpackbits(np.frombuffer(answered[o], np.uint8), count=b - a).astype(bool)
        suspects = np.sort(block.column("row").to_numpy()[twice[back]])
        bits = {}
        for task in np.unique(suspects >> 33).tolist():
            at = suspects[suspects >> 33 == task] & ((1 << 33) - 1)
            flags = np.zeros((int(at[-1]) // 64 + 1) * 64, np.uint8)
            flags[at] = 1
            bits[task] = np.packbits(flags, bitorder="little").view(np.int64).tolist()
        kind = pa.map_(pa.int64(), pa.list_(pa.int64()))
        return pa.table({"block": pa.array([block.column("block")[0].as_py()], pa.int32()), "bits": pa.array([list(bits.items())], kind)})

    sent = heads.groupBy("block").applyInArrow(send, "block int, owner bigint, data binary")
    answers = sent.groupBy("owner").applyInArrow(own, "block int, owner bigint, bits binary")
    marks = heads.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(mark, "block int, bits map<bigint, array<bigint>>")
    return stored(marks, "suspects")


def _classes(docs, id_col, text_col, whole, spare_bits, owned) -> tuple[DataFrame, DataFrame]:
    """All rows with ``suspect``, and a row for each text that several rows have."""
    rows = _written(docs, id_col, text_col, whole)
    marks = _suspects(rows, spare_bits, owned).hint("shuffle_hash")
    bit = F.getbit(F.get(F.try_element_at("bits", _task()), F.shiftright(_place(), 6).cast("int")), _place().bitwiseAND(F.lit(63)).cast("int"))
    rows = rows.join(marks, "block", "left").withColumn("suspect", F.coalesce(bit == 1, F.lit(False))).drop("bits")
    same = rows.where("suspect").groupBy(lowered(F.col("text")).alias("text")).agg(
        F.count("*").alias("group_size"), F.max("id").alias("keep_id"), F.max_by("row", "id").alias("by_id"), F.max("row").alias("any"))
    # Written once: which of several equal rows stays must not be decided again by a task that runs again.
    classes = stored(same.select(F.unhex(F.sha2("text", 256)).alias("sha"), "group_size", "keep_id", F.coalesce("by_id", "any").alias("keep_row")), "classes")
    return rows, classes


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spare_bits: int = SPARE_BITS, owned: int = OWNED) -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)`` of every row, dropped ones too.

    Texts are equal if their bytes are, after lower-casing A-Z only; a null text is an
    empty one. Of equal texts the row with the largest id stays, a null id counting as
    smaller than any; of rows that repeat that id as well, one. The SHA-256 of the
    normalised text carries the answer back to its rows; equality is decided by the bytes.
    Other columns of ``docs`` play no part, and an empty table gives an empty result.
    """
    rows, classes = _classes(docs, id_col, text_col, False, spare_bits, owned)
    heads = rows.select("row", "id", "sha", "suspect")
    text_sha256 = F.lower(F.hex("sha")).alias("text_sha256")
    lone = heads.where("not suspect").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), text_sha256)
    found = heads.where("suspect").join(classes, "sha")
    return lone.unionByName(found.select("id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), text_sha256))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spare_bits: int = SPARE_BITS, owned: int = OWNED) -> DataFrame:
    """The rows of ``docs`` that ``duplicate_groups`` keeps, with all their columns."""
    rows, classes = _classes(docs, id_col, text_col, True, spare_bits, owned)
    lone = rows.where("not suspect").select("doc.*")
    return lone.unionByName(rows.where("suspect").join(classes.select(F.col("keep_row").alias("row")), "row", "left_semi").select("doc.*"))


@query("op12_exact_duplicates", r"""
    WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM n WINDOW w AS (PARTITION BY t)
""")
def op12_exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return duplicate_groups(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")
