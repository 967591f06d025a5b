"""Token ids in binary files with Elias-Fano document boundaries (operator 7).

A file is a row of blocks, each ended by a line feed; a folder has as many files as its
blocks need. A block holds, in this order: a header (``BLOCK``), the document ids that are
not null as an Elias-Fano sequence of their distances from the first, the boundaries as one
of ``documents + 1`` numbers, and all token ids in a row, two bytes each where the
vocabulary allows it and four otherwise, little-endian. Documents rise by id within a
block, those without id first. Blocks are numbered; their order is that of the documents.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbtide.llm.common import narrowed, query, stored, table
from ebbtide.llm.elias_fano import EliasFano, pack
from ebbtide.llm.tokens import encoded_slices, ids_of
from ebbtide.session import work_path

VOCABULARY = "word_bpe_49k.json"
END = 1
MAGIC = b"TOKENID2"
#: Magic, number of the block, documents, those without id, the first id, token ids, bytes per token id, bytes of the document ids, of the boundaries.
BLOCK = struct.Struct("<8sQQQqQQQQ")
#: Ids from which a block is closed; a block ends with a whole document.
BLOCK_IDS = 1 << 22
#: Blocks of a file, some 128 MB: a reader's task holds a file at a time.
FILE_BLOCKS = 16


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Put the end id behind each document; returns all ids and the new counts."""
    counts = counts + 1
    ends = np.cumsum(counts) - 1
    out = np.empty(len(ids) + len(counts), np.result_type(ids.dtype, np.min_scalar_type(end)))
    body = np.ones(len(out), bool)
    body[ends] = False
    out[body], out[ends] = ids, end
    return out, counts


def block_bytes(number: int, doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> bytes:
    named = doc_ids.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
    first = int(named[0]) if len(named) else 0
    # Distances of ids far apart do not fit a signed number, but they do an unsigned one.
    names = pack(named.view(np.uint64) - np.uint64(first & (1 << 64) - 1))
    bounds = pack(np.concatenate([[0], np.cumsum(counts)]))
    head = BLOCK.pack(MAGIC, number, len(counts), len(counts) - len(named), first, len(ids), ids.dtype.itemsize, len(names), len(bounds))
    return b"".join([head, names, bounds, ids.astype(ids.dtype.newbyteorder("<")).tobytes()])


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end: int = END, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS,
    file_blocks: int = FILE_BLOCKS,
) -> None:
    """Encode every text of ``docs``, append the end id, and write the ids in ascending id order.

    One shuffle brings the texts into ranges of ids; each task encodes its range and writes
    files of at most ``file_blocks`` blocks, so files stay small however large a range is;
    only a single document of that size makes a larger one. Ids must be whole numbers; null ids come first, equal ids in order
    of their texts. A null text is empty and has the end id alone. Tasks that run again write
    their file anew. An empty table gives a folder without blocks. Extra columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 24, 0
        kept: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = 0

        def closed() -> pa.RecordBatch:
            names, counts, ids = zip(*kept)
            data = block_bytes(first + made, pa.concat_arrays(names), np.concatenate(counts), np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["block"])

        for batch in batches:
            for start, ids, counts in encoded_slices(tokenizer, batch.column(1)):
                ids, counts = with_end(ids, counts, end)
                kept.append((batch.column(0).slice(start, len(counts)), counts, ids.astype(ids_of(tokenizer).width)))
                size += len(ids)
                if size >= block_ids:
                    yield closed()
                    kept, size, made = [], 0, made + 1
        if kept:
            yield closed()

    source = narrowed(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("bigint"))
    blocks = source.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(run, "block binary")
    # The text writer puts a string's bytes into the file as they are.
    blocks.select(F.col("block").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", file_blocks).text(path)


def read_blocks(data: memoryview) -> Iterator[tuple[int, pa.Array, EliasFano, np.ndarray]]:
    """Number, document ids, boundaries and token ids of each block of a file, which is not copied."""
    at = 0
    while at < len(data):
        magic, number, docs, missing, first, ids, width, named, size = BLOCK.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        at += BLOCK.size
        distances = EliasFano(data[at : at + named]).select(np.arange(docs - missing))
        names = np.concatenate([np.zeros(missing, np.int64), (distances.view(np.uint64) + np.uint64(first & (1 << 64) - 1)).view(np.int64)])
        at += named
        bounds = EliasFano(data[at : at + size])
        at += size
        yield number, pa.array(names, mask=np.arange(docs) < missing), bounds, np.frombuffer(data, f"<u{width}", ids, at)
        at += width * ids + 1


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            for number, names, bounds, ids in read_blocks(memoryview(data.as_buffer())):
                at = bounds.select(np.arange(len(names) + 1))
                wide = memoryview(ids.astype("<u4")).cast("B")
                sums = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(at.tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(names), number)), names, pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(sums, pa.int64())],
                    ["block", "id", "start", "n_tokens", "ids_crc32"],
                )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` per document of the files below ``path``.

    ``start`` counts the ids of all documents before; the checksum is over the ids as
    little-endian 32-bit numbers, the end id included.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    found = stored(files.mapInArrow(_documents, "block bigint, id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"), "token_index")
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # One row per block of millions of ids.
    bases = found.groupBy("block").agg(F.sum("n_tokens").alias("ids")).select("block", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return found.join(bases, "block").select("id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


@query("op7_token_files")
def op7_token_files(spark, folder):
    """Place, length and checksum of every document, from the files written and read back."""
    path = work_path(spark, "token_files")
    write_token_files(table(spark, folder, "documents"), path, public_tokenizers.path(VOCABULARY))
    return read_token_files(spark, path).withColumnRenamed("id", "doc_id")
