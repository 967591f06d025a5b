"""SimHash near-duplicates by an inverted index over fingerprint bytes (operator 1).

A fingerprint has eight bytes, each at its place. Two fingerprints that differ in at most
four bits agree in at least four places, so the index counts shared places and verifies
the pairs that reach four. Lists by a single place would hold a 256th of all fingerprints
each; by the same guarantee, every such pair shares three places of one of twenty triples
(no four places avoid them all), so the lists are kept by triples and stay short.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import as_bytes, narrowed, query, release, stored, table, text_slices
from ebbtide.llm.components import connected_components

SHINGLE = 4
MOST_BITS = 4
PLACES = 8
SHARED_PLACES = PLACES - MOST_BITS
SEED = 42
#: Fingerprints of one list that are compared in one task; longer lists become several blocks.
BLOCK = 2048


def place_triples() -> list[tuple[int, int, int]]:
    """Triples of places such that any four places contain one of them.

    Places fall into three classes; a triple lies within a class, or has two places of a
    class and one of the next.
    """
    kind = [p * 3 // PLACES for p in range(PLACES)]
    return [
        t for t in combinations(range(PLACES), 3)
        if len({kind[p] for p in t}) == 1 or any([kind[p] for p in t].count(k) == 2 and (k + 1) % 3 in [kind[p] for p in t] for k in range(3))
    ]


# Eight bits of a byte, each in a byte of its own, so that a 64-bit sum counts eight of them at once.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").view(np.uint64).ravel()


def bit_majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 255 * 256):
        lanes = _SPREAD[hashes[start : start + 255 * 256].view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
        total += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def simhash(text: bytes, width: int = SHINGLE) -> int:
    """Fingerprint of one text, given as UTF-8; zero without words.

    ``bytes.lower`` and ``bytes.split`` know ASCII alone: A-Z, and the six white spaces.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        return bit_majority(np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64))
    digest, ends = xxhash.xxh64_intdigest, list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return bit_majority(np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :])], np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """``(id, fingerprint)`` of every row; a null text is an empty one."""
    source = narrowed(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for start, texts in text_slices(batch.column(1)):
                marks = np.array([simhash(t, width) for t in as_bytes(texts)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(marks)], ["id", "fingerprint"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fingerprint bigint")


def _spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the links a-b, those that join what the ones before did not."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    kept = []
    for x, y in {(x, y) for x, y in zip(a.tolist(), b.tolist())}:
        p, q = top(x), top(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def _linked(group: np.ndarray, mark: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Links between labels, comparing all rows of a group; groups are runs of equal numbers.

    Step d compares each row with the d-th after it, for as long as any group is that long.
    """
    a, b, step, rows = [], [], 1, np.arange(len(group))
    while True:
        rows = rows[rows + step < len(group)]
        rows = rows[group[rows] == group[rows + step]]
        if not len(rows):
            break
        other = rows + step
        differ = mark[rows] ^ mark[other]
        shared = (differ.view(np.uint8).reshape(-1, PLACES) == 0).sum(axis=1)
        near = (shared >= SHARED_PLACES) & (label[rows] != label[other])
        near[near] = np.bitwise_count(differ[near]) <= MOST_BITS
        a.append(label[rows[near]])
        b.append(label[other[near]])
        step += 1
    return _spanning(np.concatenate(a), np.concatenate(b)) if a else []


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (list, low, high, fingerprint, label), sorted by the first three; a block is one group."""
    left = np.empty((5, 0), np.int64)

    def found(part: np.ndarray) -> pa.RecordBatch:
        change = (np.diff(part[:3], axis=1) != 0).any(axis=0)
        group = np.concatenate([[0], np.cumsum(change)])
        pairs = np.array(_linked(group, part[3].copy(), part[4]), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        left = np.concatenate([left, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
        change = np.flatnonzero((np.diff(left[:3], axis=1) != 0).any(axis=0))
        if len(change):
            cut = change[-1] + 1
            yield found(left[:, :cut])
            left = left[:, cut:]
    if left.shape[1]:
        yield found(left)


def fingerprint_components(marks: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(fingerprint, label)`` for a table with one row per ``fingerprint``.

    Labels are equal where fingerprints reach each other over links of at most four bits.
    The lists are first reduced: each member near the smallest fingerprint of a list is
    linked to it, which gathers a group of near copies without comparing them all. Lists
    whose members now share a label can bring nothing new and go; members of all others
    are compared with each other, in blocks of bounded size spread over the tasks.
    """
    mark = F.col("fingerprint")
    lists = [
        F.lit(i << 24).cast("bigint").bitwiseOR(
            sum(
                (F.shiftleft(F.shiftrightunsigned(mark, 8 * p).bitwiseAND(F.lit(255).cast("bigint")), 8 * k) for k, p in enumerate(t)),
                F.lit(0).cast("bigint"),
            )
        )
        for i, t in enumerate(place_triples())
    ]
    postings = marks.select(mark, F.explode(F.array(*lists)).alias("list"))
    lengths = postings.groupBy("list").agg(F.count("*").alias("length"), F.min("fingerprint").alias("low")).where("length > 1")
    members = stored(postings.join(lengths, "list"), "lists")

    near = F.bit_count(mark.bitwiseXOR(F.col("low"))) <= MOST_BITS
    first = connected_components(members.where(near & (mark != F.col("low"))).select("fingerprint", "low").distinct(), "fingerprint", "low")
    first = first.select(F.col("node").alias("fingerprint"), F.col("label").alias("first"))

    labelled = stored(
        members.join(first, "fingerprint", "left").select("list", "length", "fingerprint", F.coalesce("first", "fingerprint").alias("label")),
        "labelled",
    )
    mixed = labelled.groupBy("list").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("list")
    parts = F.ceil(F.col("length") / block).cast("int")
    part = F.pmod(F.xxhash64("fingerprint"), parts).cast("int")
    other = F.explode(F.expr("filter(sequence(0, parts - 1), i -> i <> part or parts = 1)"))
    blocks = (
        labelled.join(mixed, "list", "left_semi").withColumns({"parts": parts, "part": part}).withColumn("other", other)
        .select("list", F.least("part", "other").cast("bigint").alias("low"), F.greatest("part", "other").cast("bigint").alias("high"), "fingerprint", "label")
        .repartition("list", "low", "high").sortWithinPartitions("list", "low", "high")
    )
    second = connected_components(blocks.mapInArrow(_compare, "a bigint, b bigint"), "a", "b")
    return (
        marks.select("fingerprint").join(first, "fingerprint", "left").withColumn("first", F.coalesce("first", "fingerprint"))
        .join(second.select(F.col("node").alias("first"), F.col("label").alias("second")), "first", "left")
        .select("fingerprint", F.coalesce("second", "first").alias("label"))
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint, component_id)`` of every row of ``docs``.

    Rows are linked if their fingerprints differ in at most four bits; ``component_id`` is
    the smallest id reachable over links. A null text is empty, and all texts without words
    share the fingerprint zero. Repeated rows stay, each with the same component. A null id
    takes part but is never the smallest; a component of null ids alone has a null id. An
    empty table gives an empty result. Extra columns are left out.
    """
    marked = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = stored(marked.groupBy("fingerprint").agg(F.min("id").alias("least")), "distinct")
    labels = stored(fingerprint_components(distinct), "labels")
    smallest = distinct.join(labels, "fingerprint").groupBy("label").agg(F.min("least").alias("component_id"))
    components = labels.join(smallest, "label").select("fingerprint", "component_id")
    return marked.join(components, "fingerprint").select("id", "fingerprint", "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row with the smallest id stays.

    Rows that repeat an id are one document. In a group of null ids alone one row stays.
    All columns are kept as they are.
    """
    found = near_duplicates(docs, id_col, text_col)
    key = F.col(f"`{id_col}`")
    kept = found.where("id = component_id").select(F.col("id").alias(id_col)).distinct()
    named = docs.join(kept, id_col, "left_semi").dropDuplicates([id_col])
    nameless = docs.where(key.isNull())
    # Groups that consist of null ids alone: their fingerprint has no component id.
    other = f"text_{uuid.uuid4().hex}"
    marks = fingerprints(nameless, text_col, text_col).withColumnRenamed("id", other).dropDuplicates(["fingerprint"])
    alone = found.where("component_id is null").select("fingerprint").distinct()
    labels = fingerprint_components(stored(alone, "nameless"))
    lone = labels.groupBy("label").agg(F.min("fingerprint").alias("fingerprint"))
    texts = marks.join(lone, "fingerprint").select(other)
    null_rows = nameless.join(texts, F.col(f"`{text_col}`").eqNullSafe(F.col(other)), "left_semi").dropDuplicates([text_col])
    return named.unionByName(null_rows)


@query("op1_simhash")
def op1_simhash(spark, folder):
    """Every document with its fingerprint and the smallest document it reaches."""
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
