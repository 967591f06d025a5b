"""Runs of words that repeat with a period (operator 13).

The words of a text are appended one by one to a suffix automaton whose suffix links form
a link-cut tree. Every node knows where it last ended; along the path of a new prefix,
nodes with the same last end form segments. Appending word i walks up that path: a segment
that last ended at p and reaches length L says that the L words before p's end come again
at i, at distance d = i - p. If d is at most L, they touch or overlap: a square of period
d, and the longest stretch ending at i with that period is L + d words long. The walk then
recolours the whole path to i. As each period shows at its latest end first, d is always
the smallest period. Squares that start at one word with one period are one run.

Nearly all text has no such run, and the automaton is spared it by a condition that every
run meets: from its second period on, each group of k words has been seen at most a period
before. Stretches of words that meet it for periods up to 1, 2, 4, 8 ... are found for
many texts at a time by sorting, and the automaton reads those stretches whole. The
condition only leaves out; whatever is reported comes from the automaton.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import as_bytes, narrowed, query, release, table, text_slices, with_column

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
_RUN = "struct<start:bigint,length:bigint,period:bigint>"


def squares(words: list[int]) -> dict[tuple[int, int], int]:
    """``{(start, period): last word}`` of the longest stretches that hold a square of words.

    About 40 bytes of memory a state, of which there are at most two a word.
    """
    size = 2 * len(words) + 3
    # Nodes are states from 1 on; 0 is none. Most states lead to one other, which needs no dictionary.
    first, leads, more = array("i", bytes(4 * size)), array("i", bytes(4 * size)), {}
    depth, link = array("i", bytes(4 * size)), array("i", bytes(4 * size))
    # Segments as splay trees: shallower nodes on the left; up goes to the parent in the tree or to the segment above.
    left, right, up = (array("i", bytes(4 * size)) for _ in range(3))
    color = array("i", bytes(4 * size))  # the segment's last end, at the root of its tree
    found: dict[tuple[int, int], int] = {}

    def splay(x: int) -> None:
        shade = color[x]
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                break
            g = up[p]
            inner = g and (left[g] == p or right[g] == p)
            if not inner:
                shade = color[p]
            elif (left[g] == p) == (left[p] == x):
                rotate(p)
                if not (up[p] and (left[up[p]] == p or right[up[p]] == p)):
                    shade = color[g]
            else:
                top = up[g]
                if not (top and (left[top] == g or right[top] == g)):
                    shade = color[g]
                rotate(x)
            rotate(x)
        color[x] = shade

    def rotate(x: int) -> None:
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = right[x]
            left[p] = b
            right[x] = p
        else:
            b = left[x]
            right[p] = b
            left[x] = p
        if b:
            up[b] = p
        up[p], up[x] = x, g
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    states, last = 1, 1
    color[1] = -1
    for i, word in enumerate(words):
        states += 1
        new = states
        depth[new] = i + 1
        word += 1  # 0 says that a state leads nowhere yet
        p, q = last, 0
        while p:
            if first[p] == word:
                q = leads[p]
                break
            if not first[p]:
                first[p], leads[p] = word, new
            else:
                branches = more.get(p)
                if branches is None:
                    more[p] = {word: new}
                else:
                    q = branches.get(word, 0)
                    if q:
                        break
                    branches[word] = new
            p = link[p]
        if not p:
            parent = 1
        elif depth[p] + 1 == depth[q]:
            parent = q
        else:
            states += 1
            parent = states
            depth[parent], link[parent] = depth[p] + 1, link[q]
            first[parent], leads[parent] = first[q], leads[q]
            if q in more:
                more[parent] = dict(more[q])
            while p:
                if first[p] == word:
                    if leads[p] != q:
                        break
                    leads[p] = parent
                else:
                    branches = more.get(p)
                    if branches is None or branches.get(word) != q:
                        break
                    branches[word] = parent
                p = link[p]
            link[q] = parent
            # The copy has ended where q has, so it joins q's segment just above q.
            splay(q)
            above = left[q]
            left[parent], left[q], up[parent] = above, parent, q
            if above:
                up[above] = parent
        link[new] = up[new] = parent
        last, below, x = new, new, parent
        while x:
            splay(x)
            ended, deeper = color[x], right[x]
            period = i - ended
            if ended >= 0 and period <= depth[x]:
                found[(ended - depth[x] + 1, period)] = i
            if deeper:
                color[deeper] = ended
            right[x] = below
            below, x = x, up[x]
        color[below] = i
    return found


def _stretches(codes: np.ndarray, text_of: np.ndarray, longest: int) -> list[tuple[int, int]]:
    """Stretches of words, as (first, last), outside of which no run can be."""
    n = len(codes)
    place, key, found, distances = np.arange(n), text_of * (int(codes.max()) + 1 if n else 1) + codes, [], {}
    for k in (1, 2, 4, 8):
        if k > 1:  # groups of k words, by where they end, out of two of half the length
            half = k // 2
            key = np.where(place >= half, rank[np.maximum(place - half, 0)], n) * (n + 1) + rank  # noqa: F821
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order], prepend=-1) != 0
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        distance = np.full(n, n + 1)
        again = np.flatnonzero(~new)
        distance[order[again]] = order[again] - order[again - 1]
        distances[k] = distance
    limit = 1
    while LEAST_PERIODS * (limit // 2 + 1) <= longest or limit == 1:
        least = limit // 2 + 1
        k = 1 if limit == 1 else 2 if limit <= 4 else 4 if limit == 8 else 8
        need = max(LEAST_WORDS, LEAST_PERIODS * least) - least - (k - 1)
        close = np.concatenate([[False], distances[k] <= limit, [False]])
        edges = np.flatnonzero(close[1:] != close[:-1]).reshape(-1, 2)
        for a, b in edges[edges[:, 1] - edges[:, 0] >= need].tolist():
            found.append((a - limit - k + 1, b - 1))
        limit *= 2
    return found


def runs_of(codes: np.ndarray, starts: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each text its runs ``(start, length, period)`` by start, then period.

    ``codes`` holds numbered words of all texts, one after another; text t has those from ``starts[t]`` on.
    """
    sizes = np.diff(starts)
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    merged: list[list[int]] = []
    for a, b in sorted((max(a, int(starts[text_of[b]])), b) for a, b in _stretches(codes, text_of, int(sizes.max(initial=0)))):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        part, text = codes[a : b + 1].tolist(), int(text_of[a])
        # Small numbers for the words of this stretch.
        index: dict[int, int] = {}
        low, high, runs = int(starts[text]), int(starts[text + 1]), set()
        for (first, period), end in squares([index.setdefault(c, len(index)) for c in part]).items():
            if end - first + 1 < max(LEAST_WORDS, LEAST_PERIODS * period):
                continue
            first, end = first + a, end + a
            while first > low and codes[first - 1] == codes[first - 1 + period]:
                first -= 1
            while end + 1 < high and codes[end + 1] == codes[end + 1 - period]:
                end += 1
            runs.add((first - low, end - first + 1, period))
        out[text] += runs
    return [sorted(r, key=lambda r: (r[0], r[2])) for r in out]


def _read(texts: list[bytes], ids: list | None, change: Callable | None) -> Iterator[tuple[list, bytes]]:
    """Runs of each text and the text without its repeats."""
    index: dict[bytes, int] = {}
    split = [t.split() for t in texts]
    starts = np.cumsum([0, *map(len, split)])
    codes = np.fromiter((index.setdefault(w, len(index)) for words in split for w in words), np.int64, int(starts[-1]))
    known, changed = list(index), set()
    if change is not None:
        for t, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
            took = change(ids[t], b - a) if b > a else None
            if took is not None:
                codes[a:b] = codes[a:b][took]
                changed.add(t)
    for t, runs in enumerate(runs_of(codes, starts)):
        words = split[t]
        if t in changed:
            words = [known[c] for c in codes[starts[t] : starts[t + 1]].tolist()]
        if runs:
            stays = np.ones(len(words), bool)
            for start, length, period in runs:
                stays[start + period : start + length] = False
            words = [words[i] for i in np.flatnonzero(stays).tolist()]
        yield runs, b" ".join(words)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable | None = None) -> DataFrame:
    """``(id, runs, collapsed)`` of every row.

    Words are what stands between the ASCII white space characters. A run is a stretch of
    at least six words and at least four times its smallest period that cannot be longer on
    either side; runs are given by start (word number from 0), length and period, in the
    order of start and period. ``collapsed`` is the text without the words that some run
    contains after its first period, joined by one space.

    ``change(id, n)`` may say how the n words of a text are read instead: as an array of
    word numbers, or None. A null text is empty: it has no runs and collapses to nothing.
    Rows are independent, so ids may be null or repeated; other columns play no part. An
    empty table gives an empty result.
    """
    source = narrowed(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for start, texts in text_slices(batch.column(1)):
                ids = batch.column(0).slice(start, len(texts))
                read = list(_read(as_bytes(texts), ids.to_pylist() if change else None, change))
                runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in found] for found, _ in read],
                                pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))
                yield pa.RecordBatch.from_arrays([ids, runs, pa.array([c for _, c in read], pa.binary()).cast(pa.string())], ["id", "runs", "collapsed"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, runs array<{_RUN}>, collapsed string")


def without_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every text collapsed as in ``periodic_runs``; all other columns as they are, null texts too."""

    def collapse(texts: pa.Array) -> pa.Array:
        return pa.array([c for _, c in _read(as_bytes(texts), None, None)], pa.binary()).cast(pa.string())

    made = "__collapsed__"
    out = with_column(docs, text_col, made, "string", collapse)
    text = F.col(f"`{text_col}`")
    return out.withColumn(text_col, F.when(text.isNotNull(), F.col(made))).drop(made)


def planted(name: int | str | None, n: int) -> np.ndarray | None:
    """For one document in ten: from some word on, what comes next is read again and again. A null id plants nothing."""
    h = zlib.crc32(str(name).encode()) if name is not None else 1
    if h % 10:
        return None
    g = h // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    took = np.arange(n)
    took[first:] = first + (took[first:] - first) % period
    return took


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    read = periodic_runs(table(spark, folder, "documents"), change=planted)
    # Exact fractions are compared; of equal ones the first in the list stays.
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = read.withColumn("best", F.aggregate("runs", F.lit(None).cast(_RUN), better))
    return best.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.expr("1000 * best.length div best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
