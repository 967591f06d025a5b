"""Trees on binned columns: boosted ones, grown by level or best leaf first, and forests.

The training rows are binned once and kept as packed blocks. A fit is a coroutine that asks
for sums of gradient, curvature and rows by node, feature and bin, and picks the splits from
the answers. What all running fits ask for is answered by one Spark job: each task adds up
its own blocks, and the partial sums meet in a grouped sum. Folds and members of an ensemble
therefore share one table and one job per step. Steps are jobs over a kept RDD, as a fit has
hundreds of them and planning a query takes longer than such a job. Of two siblings only the
smaller one is asked for; the other is the difference to their parent. Features of few bins
are counted together, by their joint bin.

Trees of a forest are grown this way down to nodes of at most ``SMALL`` rows. The rows of
such a node then go to one task, which grows what hangs below it; a task holds the rows of
one node at a time, the driver finished trees in packed form.

Gradients are whole multiples of 2**-20, so sums are exact in any order: models depend on
the rows alone, not on partitions. Where all rows fit one task, packed, each fit, or some
trees of a forest, runs as a task of its own over all blocks and needs no exchange of sums.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import io
import pickle
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Generator, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.statistics import quantiles
from ebbtide.operators.transformers import Stage
from ebbtide.session import shared_folder

MAX_BINS = 256
UNIT = 2.0**20
#: Bins that features counted together have at most, all combinations.
JOINT = 512
#: Cells (node, feature, bin) that one job brings, and trees after which margins are written anew.
CELLS, KEEP = 1 << 20, 10
#: Trees of a forest that one task grows where all rows fit one task.
CHUNK = 10
#: Rows of a forest's node that one task grows to the end, and trees whose rows are dealt out at once.
SMALL, WAVE = 50_000, 100
#: Cells of partial sums that reach the driver unadded; more are added up by tasks first.
GATHERED = 1 << 20
#: Bytes of blocks that a Python worker remembers between jobs, about, and of trees that a task keeps unpacked.
REMEMBERED, UNPACKED = 128 << 20, 32 << 20
#: A split must be worth more than this share of the node's curvature; less is rounding.
LEAST_GAIN = 1e-10
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

#: What a fit goes by, and what holds unless its settings say otherwise.
DEFAULTS = {
    "trees": 100, "rate": 1.0, "depth": 30, "leaves": None, "min_rows": 1, "min_split": 2, "min_curvature": 0.0, "l1": 0.0, "l2": 0.0,
    "gamma": 0.0, "subsample": 1.0, "colsample": 1.0, "per_node": None, "forest": False, "weights": (1.0, 1.0), "without_fold": None, "seed": 42,
}


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Numbers that look random, the same on every machine."""
    with np.errstate(over="ignore"):
        z = np.asarray(x).astype(np.uint64) + np.uint64(salt % (1 << 63)) * _MIX[0] + _MIX[0]
        z = (z ^ (z >> np.uint64(30))) * _MIX[1]
        z = (z ^ (z >> np.uint64(27))) * _MIX[2]
        return z ^ (z >> np.uint64(31))


def _chance(x: np.ndarray, salt: int) -> np.ndarray:
    return (mixed(x, salt) >> np.uint64(11)).astype(np.float64) / 2.0**53


# Probability that a row is drawn at most 0, 1, 2 ... times, as often as there are rows, with replacement.
_DRAWN = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))


class Tree:
    """Nodes as arrays; the left child takes values up to the threshold, a leaf has no children."""

    def __init__(self, feature, bin, threshold, left, right, value, cover, gain):
        self.feature, self.bin, self.threshold = np.array(feature, np.int32), np.array(bin, np.int32), np.array(threshold, np.float64)
        self.left, self.right = np.array(left, np.int32), np.array(right, np.int32)
        self.value, self.cover, self.gain = (np.array(a, np.float64) for a in (value, cover, gain))

    def leaves(self, columns: np.ndarray, limits: str) -> np.ndarray:
        """The leaf of every row, by values or by bins."""
        node, limit = np.zeros(len(columns), np.int32), getattr(self, limits)
        rows = np.flatnonzero(self.left[node] >= 0)
        while len(rows):
            at = node[rows]
            node[rows] = np.where(columns[rows, self.feature[at]] <= limit[at], self.left[at], self.right[at])
            rows = rows[self.left[node[rows]] >= 0]
        return node


    def packed(self) -> bytes:
        return zlib.compress(b"".join(getattr(self, n).tobytes() for n, _ in _COLUMNS), 3)

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        data, start, columns = zlib.decompress(data), 0, []
        count = len(data) // sum(np.dtype(kind).itemsize for _, kind in _COLUMNS)
        for _, kind in _COLUMNS:
            columns.append(np.frombuffer(data, kind, count, start))
            start += columns[-1].nbytes
        return cls(*columns)


_COLUMNS = [*((n, np.int32) for n in ("feature", "bin")), ("threshold", np.float64), *((n, np.int32) for n in ("left", "right")),
            *((n, np.float64) for n in ("value", "cover", "gain"))]


class Packed(Sequence):
    """Trees in packed form; each is unpacked when it is asked for."""

    def __init__(self, parts: list[bytes]):
        self.parts = parts

    def __len__(self) -> int:
        return len(self.parts)

    def __getitem__(self, i):
        return Packed(self.parts[i]) if isinstance(i, slice) else Tree.unpacked(self.parts[i])


class Request:
    """Sums that a fit waits for: of the nodes ``wanted`` of the unfinished tree ``number``, by their ``features``."""

    def __init__(self, fit: int, number: int, splits, wanted, features, widths):
        self.fit, self.number, self.wanted, self.features = fit, number, np.array(wanted, np.int32), np.array(features, np.int32)
        self.splits = [np.array(a, np.int32) for a in splits]
        sizes = widths[self.features]
        self.offsets = (np.cumsum(sizes) - sizes.ravel()).reshape(sizes.shape)
        self.cells = int(sizes.sum())
        self.widths = widths


def joint_features(widths: np.ndarray) -> list[list[int]]:
    """Features in groups of at most ``JOINT`` joint bins, or alone."""
    groups: list[list[int]] = []
    for f in np.argsort(-widths, kind="stable").tolist():
        room = [g for g in groups if widths[g].prod() * widths[f] <= JOINT]
        if room:
            room[0].append(f)
        else:
            groups.append([f])
    return groups


class Block:
    """Binned rows and what a fit knows about each of them."""

    def __init__(self, bins: np.ndarray, label: np.ndarray, row: np.ndarray, fold: np.ndarray):
        self.bins, self.label, self.row, self.fold = bins, label, row, fold
        self.state: dict = {}
        self.joint: list[tuple[list[int], np.ndarray]] = []

    @classmethod
    def of(cls, bins: bytes, label: bytes, row: bytes, fold: bytes) -> Block:
        label = np.frombuffer(label, np.int8)
        return cls(np.frombuffer(bins, np.uint8).reshape(len(label), -1), label, np.frombuffer(row, np.int64), np.frombuffer(fold, np.int8))

    @classmethod
    def joined(cls, packed: list[tuple]) -> Block:
        """All rows of packed blocks; what follows from them does not depend on their order."""
        parts = [cls.of(*p) for p in packed]
        return parts[0] if len(parts) == 1 else cls(*[np.concatenate([getattr(b, n) for b in parts]) for n in ("bins", "label", "row", "fold")])

    def joint_bins(self, widths: np.ndarray) -> list[tuple[list[int], np.ndarray]]:
        """Groups of features and every row's joint bin, the last feature's bin running fastest."""
        if not self.joint:
            columns = np.ascontiguousarray(self.bins.T)
            for group in joint_features(widths):
                at = columns[group[0]].astype(np.int32)
                for f in group[1:]:
                    at = at * np.int32(widths[f]) + columns[f]
                self.joint.append((group, at.astype(np.uint16)))
        return self.joint

    def margins(self, fit: int, done: list[Tree], before: int = 0, known: np.ndarray | None = None) -> np.ndarray:
        """Sums of the finished trees, in their order: the first ``before`` are in ``known``, the others in ``done``."""
        counted, margin = self.state.get(fit, (-1, None))
        if not before <= counted <= before + len(done):
            counted, margin = before, np.zeros(len(self.label)) if known is None else known
        if counted < before + len(done):
            margin = margin.copy()
            for tree in done[counted - before :]:
                margin += tree.value[tree.leaves(self.bins, "bin")]
        self.state[fit] = (before + len(done), margin)
        return margin

    def draws(self, spec: dict, number: int) -> np.ndarray:
        """How often one tree takes every row."""
        drawn = np.ones(len(self.label))
        if spec["forest"]:
            drawn = np.searchsorted(_DRAWN, _chance(self.row, spec["seed"] * 100_003 + number), side="right").astype(np.float64)
        elif spec["subsample"] < 1:
            drawn = (_chance(self.row, spec["seed"] * 100_003 + number) < spec["subsample"]).astype(np.float64)
        return drawn if spec["without_fold"] is None else drawn * (self.fold != spec["without_fold"])

    def gradients(self, spec: dict, number: int, margins) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradient, curvature and number of draws of every row for one tree."""
        drawn = self.draws(spec, number)
        weight = np.where(self.label == 1, spec["weights"][1], spec["weights"][0]) * drawn
        if spec["forest"]:
            return np.rint(weight * self.label * UNIT), np.rint(weight * UNIT), drawn
        share = 1.0 / (1.0 + np.exp(-margins()))
        return np.rint(weight * (share - self.label) * UNIT), np.rint(weight * np.maximum(share * (1 - share), 1e-16) * UNIT), drawn

    def sums(self, spec: dict, request: Request, done: list[Tree], before: int = 0, known: np.ndarray | None = None) -> np.ndarray:
        """Three rows, gradient, curvature and draws, over the cells of the request."""
        if spec["forest"]:  # many trees of a forest grow at once, too many to remember
            weights = self.gradients(spec, request.number, lambda: np.zeros(0))
            rows, at = self._rows_of(request, weights[2])
        else:
            tree = self.state.get(("tree", request.fit))
            if tree is None or tree[0] != request.number or tree[1] > len(request.splits[2]):
                weights = self.gradients(spec, request.number, lambda: self.margins(request.fit, done, before, known))
                tree = (request.number, 0, weights, {0: np.flatnonzero(weights[2] > 0).astype(np.int32)})
            _, _, weights, held = tree
            self._follow(request, held)
            self.state["tree", request.fit] = (request.number, len(request.splits[2]), weights, held)
            parts = [held[n] for n in request.wanted.tolist()]
            rows, at = np.concatenate(parts), np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
        gradient, curvature, drawn = weights
        if spec["per_node"] is None:
            return self._joint_sums(spec, request, rows, at, weights)
        cells = (request.offsets[at] + self.bins[rows[:, None], request.features[at]]).ravel()
        width = request.features.shape[1]
        return np.stack([np.bincount(cells, np.repeat(w[rows], width), request.cells) for w in (gradient, curvature, drawn)])

    def _rows_of(self, request: Request, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The drawn rows of the wanted nodes, from the root down, and each one's place among those nodes."""
        feature, limit, left, right = request.splits
        node = np.zeros(len(self.label), np.int32)
        rows = np.flatnonzero(left[node] >= 0)
        while len(rows):
            at = node[rows]
            node[rows] = np.where(self.bins[rows, feature[at]] <= limit[at], left[at], right[at])
            rows = rows[left[node[rows]] >= 0]
        place = np.full(len(left), -1, np.int32)
        place[request.wanted] = np.arange(len(request.wanted))
        at = place[node]
        rows = np.flatnonzero((at >= 0) & (drawn > 0))
        return rows, at[rows]

    def _follow(self, request: Request, held: dict[int, np.ndarray]) -> None:
        """Drawn rows by node: those of nodes split since the last request go to the children."""
        feature, limit, left, right = request.splits
        todo = [n for n in held if left[n] >= 0]
        while todo:
            node = todo.pop()
            rows = held.pop(node)
            first = self.bins[rows, feature[node]] <= limit[node]
            for child, part in ((int(left[node]), rows[first]), (int(right[node]), rows[~first])):
                held[child] = part
                if left[child] >= 0:
                    todo.append(child)

    def _joint_sums(self, spec: dict, request: Request, rows: np.ndarray, at: np.ndarray, weights) -> np.ndarray:
        """The sums where all nodes ask for the same features: by joint bins first, then by each feature's own."""
        nodes, out = len(request.wanted), np.zeros((3, request.cells))
        column = {f: j for j, f in enumerate(request.features[0].tolist())}
        once = not spec["forest"]  # boosting draws a row once or not at all
        taken = [w.take(rows) for w in (weights[:2] if once else weights)]
        for group, bins in self.joint_bins(request.widths):
            if not any(f in column for f in group):
                continue
            shape = (nodes, *request.widths[group].tolist())
            size = int(np.prod(shape[1:]))
            cell = bins.take(rows).astype(np.intp)
            if nodes > 1:
                cell += at.astype(np.intp) * size
            tables = [np.bincount(cell, w, nodes * size) for w in taken] + ([np.bincount(cell, minlength=nodes * size)] if once else [])
            for axis, f in enumerate(group, 1):
                if f in column:
                    place = request.offsets[:, column[f], None] + np.arange(shape[axis])
                    others = tuple(a for a in range(1, len(shape)) if a != axis)
                    for total, table in zip(out, tables):
                        total[place] = table.reshape(shape).sum(axis=others)
        return out


def _worth(gradient, curvature, spec):
    """What a leaf takes off the loss, times two."""
    if spec["l1"]:
        gradient = np.sign(gradient) * np.maximum(np.abs(gradient) - spec["l1"] * UNIT, 0)
    return gradient * gradient / np.maximum(curvature + spec["l2"] * UNIT, 1e-9) / UNIT


def _value(gradient: float, curvature: float, spec: dict) -> float:
    if spec["forest"]:
        return gradient / curvature if curvature else 0.0
    if spec["l1"]:
        gradient = np.sign(gradient) * max(abs(gradient) - spec["l1"] * UNIT, 0.0)
    bottom = curvature + spec["l2"] * UNIT
    return float(-spec["rate"] * gradient / bottom) if bottom > 0 else 0.0


def best_splits(sums: np.ndarray, request: Request, widths: np.ndarray, spec: dict) -> list[tuple | None]:
    """For each node of the request ``(gain, feature, bin, sums of the left child)``, or None."""
    starts = request.offsets.ravel()
    sizes = widths[request.features].ravel()
    whole = np.add.reduceat(sums, starts, axis=1)
    running = np.cumsum(sums, axis=1)
    left = running - np.repeat((running[:, starts] - sums[:, starts]), sizes, axis=1)
    total = np.repeat(whole, sizes, axis=1)
    right = total - left
    (g, h, n), (gr, hr, nr) = left, right
    least = max(spec["min_curvature"] * UNIT, 1e-9)
    # The published losses have a half, the leaf-wise library's gain has none; gamma belongs to the former.
    gain = 0.5 * (_worth(g, h, spec) + _worth(gr, hr, spec) - _worth(total[0], total[1], spec)) - spec["gamma"]
    gain[(n < spec["min_rows"]) | (nr < spec["min_rows"]) | (h < least) | (hr < least)] = -np.inf
    width = request.features.shape[1]
    firsts = starts[::width]
    top = np.maximum.reduceat(gain, firsts)
    node_of = np.repeat(np.arange(len(firsts)), np.add.reduceat(sizes, np.arange(0, len(sizes), width)))
    at = np.flatnonzero(gain == top[node_of])
    _, first = np.unique(node_of[at], return_index=True)
    out = []
    for i, cell in enumerate(at[first].tolist()):
        slot = int(np.searchsorted(starts, cell, side="right")) - 1
        if not np.isfinite(top[i]) or top[i] <= LEAST_GAIN * whole[1][i * width] / UNIT:
            out.append(None)
        else:
            out.append((float(top[i]), int(request.features.ravel()[slot]), cell - int(starts[slot]), tuple(left[:, cell])))
    return out


def _columns_of(spec: dict, number: int, width: int) -> np.ndarray:
    """The features that a tree may use."""
    every = np.arange(width)
    if spec["colsample"] < 1:
        order = np.argsort(mixed(every, spec["seed"] * 7919 + number), kind="stable")
        every = np.sort(order[: max(1, int(round(spec["colsample"] * width)))])
    return every


def grow(spec: dict, fit: int, number: int, widths: np.ndarray, cuts: list[np.ndarray], ahead: int | None,
         small: int = 0) -> Generator[Request, np.ndarray, Tree]:
    """One tree: yields requests, is sent their sums, returns the tree.

    Leaves are split in the order of their gains. Children of several leaves may be looked at
    ahead of their turn; which splits are taken does not depend on that. Nodes of at most
    ``small`` rows stay leaves; the tree then knows depth and path of its nodes.
    """
    every = _columns_of(spec, number, len(widths))
    feature, limit, left, right = [0], [0], [-1], [-1]
    depth, path, totals, best, kept = [0], [1], [None], {}, {}

    def features_of(node):
        if spec["per_node"] is None:
            return every
        salt = (spec["seed"] * 31 + number) * 1_000_003 + path[node]
        return np.sort(every[np.argsort(mixed(every, salt), kind="stable")[: spec["per_node"]]])

    def worth_asking(node):
        g, h, n = totals[node]
        return depth[node] < spec["depth"] and n >= max(spec["min_split"], 2 * spec["min_rows"], small + 1) and h > 0

    def ask(nodes):
        return Request(fit, number, (feature, limit, left, right), nodes, [features_of(x) for x in nodes], widths)

    def take(nodes, request, sums):
        for node, split in zip(nodes, best_splits(sums, request, widths, spec)):
            best[node] = split
        if spec["per_node"] is None:  # kept for the difference to a child
            edges = np.append(request.offsets[:, 0], request.cells)
            for i, node in enumerate(nodes):
                kept[node] = sums[:, edges[i] : edges[i + 1]]

    request = ask([0])
    sums = yield request
    totals[0] = tuple(np.add.reduce(sums[:, : widths[request.features[0, 0]]], axis=1))
    take([0], request, sums)
    if not worth_asking(0):
        best[0] = None
    # Without a limit the order does not matter, and whole levels are looked at together.
    turn = (lambda x: depth[x]) if spec["leaves"] is None else (lambda x: -best[x][0])
    heap, taken, leaves = [(turn(0), 0)] if best[0] else [], {}, 1
    while heap and (spec["leaves"] is None or leaves < spec["leaves"]):
        if heap[0][1] not in taken:
            room = len(heap) if spec["leaves"] is None else min(spec["leaves"] - leaves, ahead or len(heap))
            new = [x for _, x in heapq.nsmallest(room, heap) if x not in taken]
            wanted, others = [], []
            for node in new:
                _, f, cut, first = best[node]
                second = tuple(a - b for a, b in zip(totals[node], first))
                children = (len(left), len(left) + 1)
                taken[node] = children
                feature[node], limit[node], left[node], right[node] = f, cut, *children
                for side, sums_of in enumerate((first, second)):
                    feature.append(0), limit.append(0), left.append(-1), right.append(-1)
                    depth.append(depth[node] + 1), path.append((path[node] * 2 + side) % (1 << 61)), totals.append(sums_of)
                    best[children[side]] = None
                asked = [c for c in children if worth_asking(c)]
                if len(asked) == 2 and spec["per_node"] is None:
                    lesser = min(children, key=lambda c: totals[c][2])
                    wanted.append(lesser)
                    others.append((node, lesser, sum(children) - lesser))
                else:
                    wanted += asked
            if wanted:
                request = ask(wanted)
                sums = yield request
                take(wanted, request, sums)
                if others:
                    rest = Request(fit, number, ([], [], [], []), [o for _, _, o in others], [features_of(o) for _, _, o in others], widths)
                    take([o for _, _, o in others], rest, np.concatenate([kept[node] - kept[lesser] for node, lesser, _ in others], axis=1))
            for node in new:
                kept.pop(node, None)
        _, node = heapq.heappop(heap)
        leaves += 1
        for child in taken[node]:
            if best[child]:
                heapq.heappush(heap, (turn(child), child))
            else:
                kept.pop(child, None)
        taken[node] = (*taken[node], True)
    # Only the splits whose turn came; nodes numbered from the root down.
    order, columns = [0], [[] for _ in range(8)]
    for node in order:
        g, h, n = totals[node]
        split = node in taken and len(taken[node]) == 3
        f, cut = (best[node][1], best[node][2]) if split else (0, 0)
        threshold = cuts[f][cut] if split else 0.0
        at = len(order) if split else -1
        order += taken[node][:2] if split else ()
        row = (f, cut, threshold, at, at + 1 if split else -1, _value(g, h, spec), n, best[node][0] if split else 0.0)
        for column, cell in zip(columns, row):
            column.append(cell)
    tree = Tree(*columns)
    if small:
        tree.depth, tree.path, tree.small = [depth[x] for x in order], [path[x] for x in order], small
    return tree


def grow_alone(spec: dict, number: int, cuts: list[np.ndarray], bins: np.ndarray, label: np.ndarray, drawn: np.ndarray, depth: int = 0, path: int = 1) -> Tree:
    """A tree of a forest, or what hangs below one of its nodes, over rows that are at hand: the same splits as by ``grow``.

    A level is grown at once. Only cells that hold rows are looked at, so that deep levels of
    small nodes cost no more than their rows.
    """
    weight = np.where(label == 1, spec["weights"][1], spec["weights"][0]) * drawn
    sums = np.stack([np.rint(weight * label * UNIT), np.rint(weight * UNIT), drawn])
    rows = np.flatnonzero(drawn > 0)
    at, totals, paths = np.zeros(len(rows), np.int64), sums[:, rows].sum(axis=1, keepdims=True), np.array([path], np.uint64)
    every = _columns_of(spec, number, len(cuts))
    width = min(spec["per_node"] or len(every), len(every))
    least, fewest = max(spec["min_curvature"] * UNIT, 1e-9), max(spec["min_split"], 2 * spec["min_rows"])
    levels, count = [], 0
    while len(paths):
        nodes = len(paths)
        feature, cut, gain, split = np.zeros(nodes, np.int32), np.zeros(nodes, np.int32), np.zeros(nodes), np.zeros(nodes, bool)
        g, h, n = totals
        able = (n >= fewest) & (h > 0) & (g > 0) & (g < h) & (depth < spec["depth"])  # rows of one class are not split
        active = np.flatnonzero(able)
        firsts = np.zeros((3, nodes))
        if len(active):
            keep = able[at]
            rows, at = rows[keep], at[keep]
            place = (np.cumsum(able) - 1)[at]
            drawn_features = np.broadcast_to(every, (len(active), len(every)))
            if spec["per_node"] is not None:
                salt = np.uint64((spec["seed"] * 31 + number) * 1_000_003) + paths[active]
                order = np.argsort(_mixed_by(every, salt), axis=1, kind="stable")[:, :width]
                drawn_features = np.sort(every[order], axis=1)
            cell = ((place * width)[:, None] + np.arange(width)) * MAX_BINS + bins[rows[:, None], drawn_features[place]]
            cells, of, cell_sums = _by_cell(cell.ravel(), sums[:, rows], width, len(active) * width * MAX_BINS)
            owner = cells // (MAX_BINS * width)
            starts = np.flatnonzero(np.diff(cells // MAX_BINS, prepend=-1))
            running = np.cumsum(cell_sums, axis=1)
            sizes = np.diff(np.append(starts, len(cells)))
            left = running - np.repeat(running[:, starts] - cell_sums[:, starts], sizes, axis=1)
            total = totals[:, active][:, owner]
            right = total - left
            (gl, hl, nl), (gr, hr, nr) = left, right
            worth = 0.5 * (_worth(gl, hl, spec) + _worth(gr, hr, spec) - _worth(total[0], total[1], spec)) - spec["gamma"]
            worth[(nl < spec["min_rows"]) | (nr < spec["min_rows"]) | (hl < least) | (hr < least)] = -np.inf
            top = np.maximum.reduceat(worth, starts[::width])
            tops = np.flatnonzero(worth == top[owner])
            tops = tops[np.unique(owner[tops], return_index=True)[1]]  # the first cell of each node that is worth most
            good = np.isfinite(top) & (top > LEAST_GAIN * h[active] / UNIT)
            tops, taken = tops[good], active[good]
            split[taken], gain[taken], firsts[:, taken] = True, top[good], left[:, tops]
            cut[taken] = cells[tops] % MAX_BINS
            feature[taken] = drawn_features[owner[tops], cells[tops] // MAX_BINS % width]
            keep = split[at]
            rows, at = rows[keep], at[keep]
        down = count + nodes + 2 * (np.cumsum(split) - 1)
        value = np.divide(g, h, out=np.zeros(nodes), where=h > 0)
        threshold = np.array([cuts[f][c] if s else 0.0 for f, c, s in zip(feature.tolist(), cut.tolist(), split.tolist())])
        levels.append((feature, cut, threshold, np.where(split, down, -1), np.where(split, down + 1, -1), value, n, gain))
        count += nodes
        at = 2 * (np.cumsum(split) - 1)[at] + (bins[rows, feature[at]] > cut[at])
        one, other = firsts[:, split], (totals - firsts)[:, split]
        totals = np.stack([one, other], axis=2).reshape(3, -1)
        twice = paths[split] * np.uint64(2)
        paths = np.stack([twice, twice + np.uint64(1)], axis=1).ravel() % np.uint64(1 << 61)
        depth += 1
    return Tree(*[np.concatenate(column) for column in zip(*levels)])


def _mixed_by(x: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """``mixed`` of all ``x`` for each of the salts."""
    z = x.astype(np.uint64) + (salts % np.uint64(1 << 63) * _MIX[0])[:, None] + _MIX[0]
    z = (z ^ (z >> np.uint64(30))) * _MIX[1]
    z = (z ^ (z >> np.uint64(27))) * _MIX[2]
    return z ^ (z >> np.uint64(31))


def _by_cell(cell: np.ndarray, sums: np.ndarray, width: int, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells that occur in ascending order, each row's place among them, and the sums over them; a row has ``width`` cells."""
    if bound <= 4 * len(cell):
        here = np.zeros(bound, bool)
        here[cell] = True
        of = (np.cumsum(here) - 1)[cell]
        cells = np.flatnonzero(here)
    else:
        cells, of = np.unique(cell, return_inverse=True)
    return cells, of, np.stack([np.bincount(of, np.repeat(w, width), len(cells)) for w in sums])


def boost(spec: dict, fit: int, widths, cuts, ahead, done: list[Tree], numbers: range, small: int = 0) -> Generator[Request, np.ndarray, None]:
    """Trees one after another; finished ones are added to ``done``."""
    for number in numbers:
        tree = yield from grow(spec, fit, number, widths, cuts, ahead, small)
        done.append(tree)


def _alone(specs: list[dict], widths: np.ndarray, cuts: list[np.ndarray]):
    """Task side where a task holds all rows: runs its fits over them to their end."""

    def grown(block: Block, fit: int, numbers: range) -> list[bytes]:
        spec, done = specs[fit], []
        if spec["forest"]:
            return [grow_alone(spec, n, cuts, block.bins, block.label, block.draws(spec, n)).packed() for n in numbers]
        growing = boost(spec, fit, widths, cuts, 1, done, numbers)
        request = next(growing, None)
        while request is not None:
            try:
                request = growing.send(block.sums(spec, request, done))
            except StopIteration:
                request = None
        return [tree.packed() for tree in done]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], list[tuple]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault((row["fit"], row["first"], row["last"]), []).append((row["bins"], row["label"], row["row"], row["fold"]))
        while held:
            (fit, first, last), packed = held.popitem()
            block = Block.joined(packed)
            del packed
            yield pa.RecordBatch.from_arrays(
                [pa.array([fit]), pa.array([first]), pa.array([grown(block, fit, range(first, last))], pa.list_(pa.binary()))], ["fit", "first", "trees"])

    return run


#: Bins, labels, row hashes and folds of a block, and the margins of the fits so far.
PackedBlock = tuple[bytes, bytes, bytes, bytes, bytes]
_blocks: OrderedDict[tuple, Block] = OrderedDict()


def _remembered(run: str, block: PackedBlock) -> Block:
    """The block, with what this worker learned about it in earlier jobs of the same run; the least used go first.

    All of it follows from the block and the trees so far, so a worker that knows nothing gives the same sums.
    """
    key = (run, hashlib.blake2b(block[2], digest_size=16).digest())
    found = _blocks.pop(key, None) or Block.of(*block[:4])
    _blocks[key] = found
    while len(_blocks) > 1 and sum(b.bins.nbytes + len(b.label) * (10 + 2 * len(b.joint) + 36 * len(b.state)) for b in _blocks.values()) > REMEMBERED:
        _blocks.popitem(last=False)
    return found


def _pack_sums(cells: np.ndarray, sums: np.ndarray) -> bytes:
    return cells.astype(np.int64).tobytes() + np.ascontiguousarray(sums).tobytes()


def _add_sums(total: np.ndarray, data: bytes) -> None:
    count = len(data) // 32
    cells = np.frombuffer(data, np.int64, count)
    total[:, cells] += np.frombuffer(data, np.float64, 3 * count, 8 * count).reshape(3, count)


def _answers(run_id: str, specs: list[dict], asked: list[tuple[Request, list[Tree], int]], size: int):
    """Task side of a shared step: partial sums of its blocks over the cells of all requests, cut into slices of cells."""

    def run(blocks: Iterator[PackedBlock]) -> Iterator[tuple[int, bytes]]:
        total = None
        for packed in blocks:
            block, margins = _remembered(run_id, packed), pickle.loads(packed[4]) if packed[4] else {}
            sums = np.concatenate([block.sums(specs[r.fit], r, done, before, margins.get(r.fit)) for r, done, before in asked], axis=1)
            total = sums if total is None else total + sums
        if total is not None:
            cells = np.flatnonzero(total[2])
            for i in np.unique(cells // size).tolist():
                part = cells[(cells >= i * size) & (cells < (i + 1) * size)]
                yield i, _pack_sums(part - i * size, total[:, part])

    return run


def _added(size: int):
    """Task side: the sums of whole slices."""

    def run(parts: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        totals: dict[int, np.ndarray] = {}
        for i, data in parts:
            _add_sums(totals.setdefault(i, np.zeros((3, size))), data)
        for i, total in totals.items():
            cells = np.flatnonzero(total[2])
            yield i, _pack_sums(cells, total[:, cells])

    return run


def _sums_over(blocks: RDD, run_id: str, specs: list[dict], asked: list[tuple[Request, list[Tree], int]]) -> np.ndarray:
    """Sums over all blocks by cell of all requests. Where many tasks hold many cells, other tasks add them up by slices of cells."""
    cells = sum(r.cells for r, _, _ in asked)
    slices = -(-cells * blocks.getNumPartitions() // GATHERED)
    size = -(-cells // slices)
    partial = blocks.mapPartitions(_answers(run_id, specs, asked, size))
    if slices > 1:
        partial = partial.partitionBy(slices, int).mapPartitions(_added(size))
    found = np.zeros((3, slices * size))
    for i, data in partial.collect():  # at most GATHERED cells, or the sums alone
        _add_sums(found[:, i * size : (i + 1) * size], data)
    return found


def _with_margins(specs: list[dict], done: dict[int, tuple[int, list[Tree]]]):
    """Task side: a block with the margins of all boosted fits so far."""

    def run(packed: PackedBlock) -> PackedBlock:
        block, margins = Block.of(*packed[:4]), pickle.loads(packed[4]) if packed[4] else {}
        for fit, (before, trees) in done.items():
            margins[fit] = block.margins(fit, trees, before, margins.get(fit))
        return (*packed[:4], pickle.dumps(margins))

    return run


def _pack_rows(block: Block, rows: np.ndarray, drawn: np.ndarray, flags: np.ndarray) -> bytes:
    """Label, draws and bins of rows; features of two bins take a bit each."""
    head = (drawn[rows].astype(np.uint8) << 1 | block.label[rows].astype(np.uint8))[:, None]
    bins = block.bins[rows]
    return np.concatenate([head, np.packbits(bins[:, flags], axis=1), bins[:, ~flags]], axis=1).tobytes()


def _unpack_rows(data: list[bytes], flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bits = -(-int(flags.sum()) // 8)
    table = np.frombuffer(b"".join(data), np.uint8).reshape(-1, 1 + bits + int((~flags).sum()))
    bins = np.empty((len(table), len(flags)), np.uint8)
    bins[:, flags] = np.unpackbits(table[:, 1 : 1 + bits], axis=1, count=int(flags.sum()))
    bins[:, ~flags] = table[:, 1 + bits :]
    return bins, (table[:, 0] & 1).astype(np.int8), (table[:, 0] >> 1).astype(np.float64)


def _dealt(specs: list[dict], tops: list[tuple[int, int, Tree, dict[int, int]]], flags: np.ndarray):
    """Task side: the rows of the small nodes, by the task that grows what hangs below them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.of(row["bins"], row["label"], row["row"], row["fold"])
                for fit, number, tree, task_of in tops:
                    drawn, leaf = block.draws(specs[fit], number), tree.leaves(block.bins, "bin")
                    taken = np.flatnonzero(drawn > 0)
                    taken = taken[np.argsort(leaf[taken], kind="stable")]
                    nodes, starts = np.unique(leaf[taken], return_index=True)
                    packed = [(task_of[n], _pack_rows(block, r, drawn, flags)) for n, r in zip(nodes.tolist(), np.split(taken, starts[1:])) if n in task_of]
                    if packed:
                        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in packed], pa.int64()), pa.array([d for _, d in packed], pa.binary())], ["task", "rows"])

    return run


def _below(specs: list[dict], cuts: list[np.ndarray], tasks: list[tuple[int, int, int, int]], flags: np.ndarray):
    """Task side: rows sorted by task in, the tree below each small node out."""

    def grown(task: int, data: list[bytes]) -> pa.RecordBatch:
        fit, number, depth, path = tasks[task]
        tree = grow_alone(specs[fit], number, cuts, *_unpack_rows(data, flags), depth, path)
        return pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([tree.packed()], pa.binary())], ["task", "tree"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, data = None, []
        for batch in batches:
            for task, rows in zip(*[c.to_pylist() for c in batch.columns]):
                if data and task != at:
                    yield grown(at, data)
                    data = []
                at = task
                data.append(rows)
        if data:
            yield grown(at, data)

    return run


def hung(top: Tree, below: dict[int, Tree]) -> Tree:
    """A tree whose leaves are replaced by trees, numbered from the root down."""
    parts, starts, count = [top], {}, len(top.left)
    for leaf, tree in below.items():
        starts[leaf] = count
        parts.append(tree)
        count += len(tree.left)
    columns = {n: np.concatenate([getattr(p, n) for p in parts]) for n, _ in _COLUMNS}
    offset = np.repeat([0, *starts.values()], [len(p.left) for p in parts])
    for n in ("left", "right"):
        columns[n] = np.where(columns[n] >= 0, columns[n] + offset, -1)
    for leaf, start in starts.items():  # the root of what hangs there takes the leaf's place
        for n in columns:
            columns[n][leaf] = columns[n][start]
    order, level = [], np.zeros(1, np.int64)
    while len(level):
        order.append(level)
        inner = level[columns["left"][level] >= 0]
        level = np.stack([columns["left"][inner], columns["right"][inner]], axis=1).ravel()
    order = np.concatenate(order)
    number = np.full(count, -1)
    number[order] = np.arange(len(order))
    out = {n: c[order] for n, c in columns.items()}
    for n in ("left", "right"):
        out[n] = np.where(out[n] >= 0, number[out[n]], -1)
    return Tree(*out.values())


def _grown_below(blocks: DataFrame, specs: list[dict], cuts: list[np.ndarray], tops: list[tuple[int, int, Tree]]) -> list[bytes]:
    """The packed whole trees; rows of one wave are in a shuffle at a time, the driver holds one tree unpacked."""
    out, flags = [], np.array([len(c) < 2 for c in cuts])
    for start in range(0, len(tops), WAVE):
        tasks, named = [], []
        for fit, number, top in tops[start : start + WAVE]:
            leaves = [x for x in np.flatnonzero(top.left < 0).tolist() if top.cover[x] <= top.small]
            named.append((fit, number, top, {x: len(tasks) + i for i, x in enumerate(leaves)}))
            tasks += [(fit, number, top.depth[x], top.path[x]) for x in leaves]
        dealt = blocks.mapInArrow(_dealt(specs, named, flags), "task bigint, rows binary")
        # About as many tasks as nodes of full size; a task grows its nodes one by one.
        full = sum(top.cover[0] for _, _, top, _ in named) / max(t.small for _, _, t, _ in named)
        dealt = dealt.repartition(max(1, min(len(tasks), 2 * int(full) + len(named))), "task").sortWithinPartitions("task")
        found = {r["task"]: r["tree"] for r in dealt.mapInArrow(_below(specs, cuts, tasks, flags), "task bigint, tree binary").collect()}  # as large as the trees
        for _, _, top, task_of in named:
            out.append(hung(top, {x: Tree.unpacked(found.pop(t)) for x, t in task_of.items() if t in found}).packed())
    return out


_BLOCK = "bins binary, label binary, row binary, fold binary"


def fit_cuts(df: DataFrame, features: list[str], max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Ascending thresholds of every feature: between all values if they are few, else exact quantiles."""
    values = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("double").alias("value")) for i, c in enumerate(features)])
    found = df.select(F.inline(values)).where("value is not null and not isnan(value)").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    sizes = {r["i"]: r["n"] for r in found.groupBy("i").agg(F.count("*").alias("n")).collect()}  # a row per feature
    few, cuts = [i for i, n in sizes.items() if n <= max_bins], [np.empty(0) for _ in features]
    of: dict[int, list[float]] = {i: [] for i in few}
    for r in found.where(F.col("i").isin(few)).collect():  # at most max_bins values a feature
        of[r["i"]].append(r["value"])
    found.unpersist()
    for i, listed in of.items():
        listed = np.sort(np.array(listed))
        cuts[i] = (listed[:-1] + listed[1:]) / 2
    many = [c for i, c in enumerate(features) if sizes.get(i, 0) > max_bins]
    if many:
        for name, listed in _by_column(quantiles(df, many, [k / max_bins for k in range(1, max_bins)])).items():
            cuts[features.index(name)] = np.unique(listed)
    return cuts


def _by_column(table: DataFrame) -> dict[str, list[float]]:
    out: dict[str, list[float]] = {}
    for r in table.collect():  # a value per feature and quantile
        out.setdefault(r["column"], []).append(r["value"])
    return out


def binned(df: DataFrame, features: list[str], cuts: list[np.ndarray], parts: int, fold: str | None = None) -> DataFrame:
    """Packed blocks, one a partition. A missing value goes to the last bin."""
    named = [F.col(f"`{c}`").cast("double") for c in features]
    rows = df.select(*[c.alias(f"_{i}") for i, c in enumerate(named)], F.col("label").cast("int").alias("label"),
                     F.xxhash64(*named, F.col("label").cast("int")).alias("row"), (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"))
    rows = rows.repartition(1) if parts == 1 else rows.repartition(parts, "row")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: list[list[bytes]] = [[], [], [], []]
        for batch in batches:
            *values, label, row, at = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            bins = np.stack([np.searchsorted(c, np.asarray(v, np.float64), side="left") for c, v in zip(cuts, values)], axis=1)
            for kept, part in zip(packed, (bins.astype(np.uint8), label.astype(np.int8), row.astype(np.int64), at.astype(np.int8))):
                kept.append(np.ascontiguousarray(part).tobytes())
        if packed[0]:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(p)], pa.binary()) for p in packed], ["bins", "label", "row", "fold"])

    return rows.mapInArrow(pack, _BLOCK)


def fit_trees(df: DataFrame, features: list[str], specs: list[dict], parts: int, fold: str | None = None, small: int = SMALL, pieces: int = 1) -> list[Packed]:
    """All fits over one binned table. With one part each fit, or ten trees of a forest, is a task over all rows; else all go in step.

    Nodes of a forest with at most ``small`` rows are then grown by one task each. One part may be packed in ``pieces``.
    """
    features, specs = list(features), [{**DEFAULTS, **s} for s in specs]
    cuts = fit_cuts(df, features)
    widths = np.array([len(c) + 1 for c in cuts])
    blocks = binned(df, features, cuts, pieces if parts == 1 else parts, fold)
    return _fit_alone(blocks, specs, widths, cuts) if parts == 1 else _fit_in_step(blocks, specs, widths, cuts, small)


def _fit_alone(blocks: DataFrame, specs, widths, cuts) -> list[Packed]:
    tasks = []
    for i, spec in enumerate(specs):
        step = CHUNK if spec["forest"] else max(1, spec["trees"])
        tasks += [(i, a, min(a + step, spec["trees"])) for a in range(0, spec["trees"], step)]
    tasks.sort(key=lambda t: specs[t[0]]["forest"])  # boosted fits take longest and begin first
    listed = F.array(*[F.struct(F.lit(n).alias("task"), F.lit(i).alias("fit"), F.lit(a).alias("first"), F.lit(b).alias("last")) for n, (i, a, b) in enumerate(tasks)])
    dealt = blocks.select("*", F.inline(listed)).repartitionByRange(len(tasks), "task")
    rows = dealt.mapInArrow(_alone(specs, widths, cuts), "fit bigint, first bigint, trees array<binary>").collect()  # as large as the models
    out: list[list[bytes]] = [[] for _ in specs]
    for row in sorted(rows, key=lambda r: (r["fit"], r["first"])):
        out[row["fit"]] += map(bytes, row["trees"])
    return [Packed(parts) for parts in out]


def _fit_in_step(blocks: DataFrame, specs, widths, cuts, small: int) -> list[Packed]:
    sc, run_id = blocks.sparkSession.sparkContext, uuid.uuid4().hex
    shared_folder(blocks.sparkSession)  # margins are written there
    if any(spec["forest"] for spec in specs):
        blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    # A task for each core; it holds one block at a time.
    kept = blocks.rdd.map(lambda r: (*map(bytes, r), b"")).coalesce(max(2, sc.defaultParallelism)).persist(StorageLevel.MEMORY_AND_DISK)
    done: list[list[Tree]] = [[] for _ in specs]
    base = [0] * len(specs)
    forests: dict[tuple[int, int], list[Tree]] = {}
    running = []
    for i, spec in enumerate(specs):
        if spec["forest"]:
            for number in range(spec["trees"]):
                forests[i, number] = []
                running.append((boost(spec, i, widths, cuts, None, forests[i, number], range(number, number + 1), small), i))
        else:
            running.append((boost(spec, i, widths, cuts, None, done[i], range(spec["trees"])), i))
    waiting = [(fit, i, r) for fit, i in running if (r := next(fit, None)) is not None]
    while waiting:
        # Requests of one job, up to a bound of cells; the others wait for the next one.
        ends = np.cumsum([r.cells for _, _, r in waiting])
        count = max(1, int(np.searchsorted(ends, CELLS, side="right")))
        now, waiting = waiting[:count], waiting[count:]
        asked = [(r, [] if specs[i]["forest"] else done[i][base[i] :], base[i]) for _, i, r in now]
        found = _sums_over(kept, run_id, specs, asked)
        further = []
        for (fit, i, request), end in zip(now, ends):
            try:
                further.append((fit, i, fit.send(found[:, end - request.cells : end])))
            except StopIteration:
                pass
        waiting += further
        if any(len(d) - b >= KEEP for d, b in zip(done, base)):
            new = {i: (b, d[b:]) for i, (d, b) in enumerate(zip(done, base)) if d[b:]}
            older, kept = kept, kept.map(_with_margins(specs, new)).persist(StorageLevel.MEMORY_AND_DISK)
            kept.checkpoint()  # or every step would carry all steps before it
            kept.count()
            older.unpersist()
            base = [len(d) for d in done]
    kept.unpersist()
    packed = [[t.packed() for t in trees] for trees in done]
    if forests:
        tops = [(i, number, trees[0]) for (i, number), trees in sorted(forests.items())]
        for (i, _, _), tree in zip(tops, _grown_below(blocks, specs, cuts, tops)):
            packed[i].append(tree)
        blocks.unpersist()
    return [Packed(trees) for trees in packed]


def pack_trees(trees: Sequence[Tree]) -> str:
    """Text form of trees, as a saved stage keeps it."""
    parts = trees.parts if isinstance(trees, Packed) else [t.packed() for t in trees]
    return base64.b64encode(np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)).decode()


def unpack_trees(text: str) -> Packed:
    data = base64.b64decode(text)
    if data[:2] == b"PK":  # as stages of earlier versions keep them
        with np.load(io.BytesIO(data)) as old:
            cuts = np.cumsum(old["sizes"])[:-1]
            return Packed([Tree(*columns).packed() for columns in zip(*[np.split(old[n], cuts) for n, _ in _COLUMNS])])
    sizes = np.frombuffer(data, np.int64, int(np.frombuffer(data, np.int64, 1)[0]), 8)
    ends = 8 + sizes.nbytes + np.cumsum(sizes)
    return Packed([data[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())])


def margins(trees: list[Tree], values: np.ndarray, forest: bool) -> np.ndarray:
    """Sum of the trees' values for boosting, their mean for a forest. A missing value goes right."""
    total = np.zeros(len(values))
    for tree in trees:
        total += tree.value[tree.leaves(values, "threshold")]
    return total / len(trees) if forest and trees else total


class TreeScores(Stage):
    """Feature vector -> probability vector and class of a forest or of boosted trees."""

    def __init__(self, vector="", trees="", forest=False, probability="", prediction="", width=0):
        super().__init__(vector=vector, trees=trees, forest=forest, probability=probability, prediction=prediction, width=width)

    def members(self) -> Packed:
        return unpack_trees(self["trees"])

    @property
    def forest(self) -> bool:
        return self["forest"]

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        """Shares of the features in the loss that splits take off, averaged over trees."""
        total = np.zeros(self["width"])
        for tree in self.members():
            inner = tree.left >= 0
            gains = np.bincount(tree.feature[inner], np.maximum(tree.gain[inner], 0), self["width"])
            total += gains / gains.sum() if gains.sum() > 0 else 0
        return Vectors.dense(total / total.sum() if total.sum() > 0 else total)

    def _transform(self, df: DataFrame) -> DataFrame:
        packed, forest, kept = self["trees"], self.forest, []

        @F.pandas_udf("double")
        def score(values: pd.Series) -> pd.Series:
            if not kept:
                members = unpack_trees(packed)
                kept.append(list(members) if 4 * len(packed) < UNPACKED else members)
            margin = margins(kept[0], np.stack(values.to_numpy()), forest) if len(values) else np.empty(0)
            return pd.Series(margin if forest else 1.0 / (1.0 + np.exp(-margin)))

        share = f"{self['probability']}_share"
        scored = df.withColumn(share, score(vector_to_array(F.col(self["vector"]))))
        return scored.withColumns({
            self["probability"]: array_to_vector(F.array(1.0 - F.col(share), F.col(share))),
            self["prediction"]: (F.col(share) > 0.5).cast("double"),
        }).drop(share)
