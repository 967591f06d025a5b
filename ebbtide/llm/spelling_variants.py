"""Spelling variants of words by a frequency-vector trie (operator 11).

A word's vector says how many of its letters fall into each of ten letter groups. One
inserted, deleted or replaced letter raises at most one count by one and lowers at most
one by one. Words are therefore arranged in tries by their successive counts, and a word
looks for its near words depth first with a budget of one surplus and one deficit; at a
leaf, where the budget held all the way, the words themselves are compared.

The first counts of the vector name a shard, and each shard is a trie of its own in one
task. A word goes to its own shard and to those that its budget reaches; of two shards
only the words of the lower one travel, and pairs are told to both ends. How many counts
name a shard follows from the words, so that a shard holds a bounded number; one that is
still too large is cut into blocks, and its words visit all of them.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import narrowed, query, release, stored, table, text_slices

GROUPS = 10
#: Counts that name a shard, at most, and words of a shard or of a block of one.
MOST_COUNTS, SHARD = 6, 20_000
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form is at least so many times as frequent as its variant.
TIMES = 10
#: Words are compared as rows of a matrix up to this length, beyond it one by one.
WIDTH = 64
QUERIES, PAIRS = 4096, 1 << 19

# Letters of about equal frequency in many languages, dealt to the groups back and forth; others go by their number.
_ORDER = b"etaoinshrdlucmfwypvbgkjqxz"
_GROUP = (np.arange(256) % GROUPS).astype(np.int64)
for _rank, _letter in enumerate(_ORDER):
    _round, _at = divmod(_rank, GROUPS)
    _GROUP[_letter] = GROUPS - 1 - _at if _round % 2 else _at
_LETTERS = rb"[a-z\xc0-\xff]"


def vectors(words: list[bytes]) -> np.ndarray:
    """A row per word: letters in each group; beyond 255 they count as 255, which keeps differences within the budget."""
    sizes = np.array([len(w) for w in words], np.int64)
    at = np.repeat(np.arange(len(words)), sizes) * GROUPS + _GROUP[np.frombuffer(b"".join(words), np.uint8)]
    return np.minimum(np.bincount(at, minlength=len(words) * GROUPS), 255).reshape(-1, GROUPS).astype(np.int64)


def moves(depth: int) -> np.ndarray:
    """Changes of the first counts within the budget that lead to the same shard or to a higher one."""
    unit = np.eye(depth, dtype=np.int64)
    return np.array([np.zeros(depth, np.int64), *unit, *[unit[i] - unit[j] for i, j in combinations(range(depth), 2)]])


def _pack(counts: np.ndarray) -> np.ndarray:
    return (counts << (8 * np.arange(counts.shape[-1])[::-1])).sum(axis=-1)


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether exactly one letter was inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


class Words:
    """Words of a shard as they are compared: a matrix of their first letters, and the long ones as they are."""

    def __init__(self, words: list[bytes]):
        self.words, self.sizes = words, np.array([len(w) for w in words], np.int64)
        self.width = int(min(WIDTH, self.sizes.max(initial=0))) + 1
        self.letters = np.frombuffer(b"".join(w[: self.width - 1].ljust(self.width, b"\0") for w in words), np.uint8).reshape(-1, self.width)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of numbers of words: whether they are one edit apart."""
        swap = self.sizes[a] > self.sizes[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        longer, out = self.sizes[b] - self.sizes[a], np.zeros(len(a), bool)
        short = self.sizes[b] < self.width
        at = np.flatnonzero(short & (longer == 0))
        out[at] = (self.letters[a[at]] != self.letters[b[at]]).sum(axis=1) == 1
        at = np.flatnonzero(short & (longer == 1))
        x, y = self.letters[a[at]], self.letters[b[at]]
        past = np.arange(self.width - 1) >= (x != y).argmax(axis=1)[:, None]
        out[at] = ~((x[:, :-1] != y[:, 1:]) & past).any(axis=1)
        for i in np.flatnonzero(~short & (longer <= 1)).tolist():
            out[i] = one_edit(self.words[a[i]], self.words[b[i]])
        return out


class Trie:
    """Vectors arranged by their successive counts from ``depth`` on."""

    def __init__(self, counts: np.ndarray, depth: int):
        self.depth, self.order = depth, np.lexsort(counts.T[::-1])
        ordered, node, self.children = counts[self.order], np.zeros(len(counts), np.int64), []
        for level in range(depth, GROUPS):
            keys, node = np.unique(node * 256 + ordered[:, level], return_inverse=True)
            self.children.append(keys)
        self.starts = np.searchsorted(node, np.arange(node[-1] + 2 if len(node) else 1))

    def search(self, queries: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Depth first, many queries at a time: ``(query, member)`` wherever the budget, less what is spent already, holds."""
        stack = []
        for s in (0, 1):
            for d in (0, 1):
                rows = np.flatnonzero((surplus == s) & (deficit == d))
                stack.append((self.depth, rows, np.zeros(len(rows), np.int64), s, d))
        while stack:
            level, rows, node, s, d = stack.pop()
            if not len(rows):
                continue
            if level == GROUPS:
                yield from self._members(rows, node)
                continue
            keys = self.children[level - self.depth]
            for change in (-1, 0, 1):
                if (change < 0 and d) or (change > 0 and s):
                    continue
                count = queries[rows, level] + change
                key = node * 256 + count
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = (keys[at] == key) & (count >= 0) & (count < 256)
                stack.append((level + 1, rows[hit], at[hit], s + (change > 0), d + (change < 0)))

    def _members(self, rows: np.ndarray, leaf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        first, sizes = self.starts[leaf], self.starts[leaf + 1] - self.starts[leaf]
        # Slices of bounded pairs; a leaf is no larger than a shard.
        part = np.cumsum(sizes) // PAIRS
        for a, b in zip(*_edges(part)):
            n = sizes[a:b]
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(rows[a:b], n), self.order[np.repeat(first[a:b], n) + offset]


def _edges(part: np.ndarray) -> tuple[list[int], list[int]]:
    cuts = (np.flatnonzero(np.diff(part)) + 1).tolist()
    return [0, *cuts], [*cuts, len(part)]


def _near_words(depth: int) -> Callable[[pa.Table], pa.Table]:
    """What a shard's task does: for every word with near words here, their number and the most frequent one."""

    def run(shard: pa.Table) -> pa.Table:
        role = shard.column("role").to_numpy()
        told = np.empty((2, 0), np.int64)
        words = [w.encode("latin-1") for w in shard.column("word").to_pylist()]
        members = np.flatnonzero(role == 0)
        if len(members):
            counts, compared = vectors(words), Words(words)
            trie = Trie(counts[members], depth)
            change = counts[members[0], :depth] - counts[:, :depth]
            surplus, deficit = np.maximum(change, 0).sum(axis=1), np.maximum(-change, 0).sum(axis=1)
            found = [told]
            for start in range(0, len(words), QUERIES):
                part = slice(start, start + QUERIES)
                for rows, at in trie.search(counts[part], surplus[part], deficit[part]):
                    a, b = rows + start, members[at]
                    near = compared.near(a, b)
                    pairs = np.stack([a[near], b[near]])
                    found += [pairs, pairs[::-1, role[pairs[0]] == 2]]
            told = np.concatenate(found, axis=1)
        n, rank = shard.column("n").to_numpy(), np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        told = told[:, np.lexsort((rank[told[1]], -n[told[1]], told[0]))]
        first = np.flatnonzero(np.diff(told[0], prepend=-1))
        total = np.diff(np.append(first, told.shape[1]))
        word, near = told[:, first]
        return pa.table({"word": shard.column("word").take(pa.array(word)), "n_near": pa.array(total, pa.int64()),
                         "near": shard.column("word").take(pa.array(near)), "near_n": pa.array(n[near], pa.int64())})

    return run


def _prefix(depth: int) -> Callable[[list[bytes]], np.ndarray]:
    return lambda words: _pack(vectors(words)[:, :depth]) if words else np.empty(0, np.int64)


def _depth(words: DataFrame, shard: int) -> tuple[int, int]:
    """How many counts name a shard so that none has more than ``shard`` words, and the largest one's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            for depth in range(1, MOST_COUNTS + 1):
                keys, n = np.unique(_prefix(depth)(coded), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([depth] * len(keys), pa.int32()), pa.array(keys), pa.array(n)], ["depth", "shard", "n"])

    sizes = words.select("word").mapInArrow(run, "depth int, shard bigint, n bigint").groupBy("depth", "shard").agg(F.sum("n").alias("n"))
    largest = {r["depth"]: r["n"] for r in sizes.groupBy("depth").agg(F.max("n").alias("n")).collect()}  # a row per depth
    fit = [d for d in sorted(largest) if largest[d] <= shard]
    return (fit[0], largest[fit[0]]) if fit else (MOST_COUNTS, largest.get(MOST_COUNTS, 0))


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """``(word, n_near, near, near_n)`` of every word of ``(word, n)`` that has words one edit away.

    ``words`` has a row for each word, of letters up to U+00FF. ``near`` is the one with the
    largest ``n``, of equal ones the first by code points.
    """
    depth, largest = _depth(words, shard)
    steps = moves(depth)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = vectors([w.encode("latin-1") for w in batch.column(0).to_pylist()])[:, :depth] if batch.num_rows else np.empty((0, depth), np.int64)
            for i, step in enumerate(steps):
                there = own + step
                rows = np.flatnonzero(((there >= 0) & (there < 256)).all(axis=1))
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(_pack(there[rows]), pa.int64()), pa.array([min(i, 1) * 2] * len(rows), pa.int32())], ["word", "n", "shard", "role"])

    sent = words.select("word", F.col("n").cast("bigint").alias("n")).mapInArrow(route, "word string, n bigint, shard bigint, role int").withColumn("block", F.lit(0))
    if largest > shard:
        sizes = sent.where("role = 0").groupBy("shard").agg(F.ceil(F.count("*") / shard).cast("int").alias("blocks"))
        own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        cut = sent.join(sizes, "shard").withColumn("own", own).withColumn("block", each)
        sent = cut.withColumn("role", F.when((F.col("role") == 0) & (F.col("own") != F.col("block")), 1).otherwise(F.col("role")))
    told = sent.groupBy("shard", "block").applyInArrow(_near_words(depth), "word string, n_near bigint, near string, near_n bigint")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return told.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT, misread: Callable[[int | str | None, bytes], bytes] | None = None) -> DataFrame:
    """``(word, n)``: the words of all texts, counted.

    A word is a longest run of letters A-Z, a-z, U+00C0 to U+00FF, with A-Z in lower case.
    ``misread(id, run)`` may say how a document's run is read instead; runs are Latin-1 bytes
    and long enough to be words. A null text has no words.
    """
    letters = re.compile(_LETTERS + b"{%d,}" % least_length)
    source = narrowed(docs, id=id_col, text=text_col)

    def emit(total: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in total], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total: Counter = Counter()
        for batch in batches:
            for start, texts in text_slices(batch.column(1)):
                ids = batch.column(0).slice(start, len(texts)).to_pylist()
                for name, text in zip(ids, texts.to_pylist()):
                    # What lies beyond U+00FF becomes a question mark, which is no letter either.
                    runs = letters.findall((text or "").encode("latin-1", "replace").lower())
                    if misread is None:
                        total.update(runs)
                        continue
                    for found, times in Counter(runs).items():
                        read = misread(name, found)
                        if len(read) >= least_length:
                            total[read] += times
                if len(total) > 200_000:
                    yield emit(total)
                    total.clear()
        yield emit(total)

    counted = source.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


def variants(words: DataFrame, times: int = TIMES, shard: int = SHARD) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``(word, n)``.

    The form is the near word with the largest ``n`` (of equal ones the first by code points),
    if that is at least ``times`` the word's own ``n``. The root follows forms to the last
    one; a word without a form is its own. An empty table gives an empty result.
    """
    words = stored(words, "words")
    near = near_words(words, shard)
    formed = F.col("near_n") >= times * F.col("n")
    rows = stored(words.join(near, "word", "left").select(
        "word", F.when(formed, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("near_n")).alias("form_n")), "forms")
    roots = rows.where("form is not null").select("word", F.col("form").alias("root"))
    # Every step multiplies n, which bounds the steps; each round doubles those taken.
    ends = words.agg(F.max("n").alias("most"), F.min("n").alias("least")).first()
    steps = int(math.log(ends["most"] / max(1, ends["least"]), max(2, times)) + 1e-9) if ends["most"] else 0
    for _ in range(max(0, steps - 1).bit_length()):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = stored(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", misread=None, shard: int = SHARD) -> DataFrame:
    """``variants`` of the words of all texts; see there and in ``word_counts``.

    Repeated rows and ids count as often as they come. Other columns of ``docs`` play no part.
    """
    return variants(word_counts(docs, id_col, text_col, misread=misread), shard=shard)


def planted(name: int | str | None, run: bytes) -> bytes:
    """The run, less one letter for one in 31 pairs of document and run; a null id counts as an empty one."""
    wide = run if run.isascii() else run.decode("latin-1").encode()
    h = zlib.crc32(wide, zlib.crc32(b"%s:" % ("" if name is None else str(name)).encode()))
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


@query("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents"), misread=planted)
