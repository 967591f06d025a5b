"""Best-fit packing of token pieces by a grouping genetic algorithm (operator 3).

Pieces are dealt by hash into shards of a few thousand. Islands evolve packings of a shard
independently, each in a task of its own: a crossover injects whole well-filled bins of
one parent into the other, removes what is then there twice, and puts displaced pieces
into the bins they fit best. Between the rounds each island's best packing migrates to
the next island. Bins that a shard leaves open are packed again together with those of
the other shards.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import narrowed, query, stored, table
from ebbtide.llm.token_files import with_end
from ebbtide.llm.tokens import encoded_slices

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END = 0
SHARD = 8192
ISLANDS = 2
ROUNDS = 2
POPULATION = 3
CHILDREN = 4
#: Share of a parent's bins that a crossover injects.
INJECTED = 0.15
#: A bin with more than this share free is open and goes to the next level.
OPEN = 1 / 16


class Packing:
    """Bins of piece numbers; a piece's size is ``sizes[number]``."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []

    def fit(self, pieces: list[int]) -> None:
        """Put each piece, in this order, into the fullest bin with room for it."""
        sizes, bins, free = self.sizes, self.bins, self.free
        spots: dict[int, list[int]] = {}
        for b, room in enumerate(free):
            spots.setdefault(room, []).append(b)
        rooms = sum(1 << room for room in spots)
        for p in pieces:
            size = sizes[p]
            fitting = rooms >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                at = spots[room]
                b = at.pop()
                if not at:
                    rooms ^= 1 << room
                    del spots[room]
                bins[b].append(p)
                room -= size
            else:
                b, room = len(bins), self.capacity - size
                bins.append([p])
                free.append(room)
            free[b] = room
            at = spots.get(room)
            if at:
                at.append(b)
            else:
                spots[room] = [b]
                rooms |= 1 << room

    def without(self, gone: set[int], broken: set[int] = frozenset()) -> tuple[Packing, list[int]]:
        """A copy without the bins that hold any of ``gone``, or are named, and their other pieces."""
        copy, displaced = Packing(self.sizes, self.capacity), []
        for b, (pieces, room) in enumerate(zip(self.bins, self.free)):
            if b in broken or (gone and not gone.isdisjoint(pieces)):
                displaced += [p for p in pieces if p not in gone]
            else:
                copy.bins.append(list(pieces))
                copy.free.append(room)
        return copy, displaced

    def rank(self) -> tuple[int, int]:
        """Fewer bins are better; among equals, those that gather the free room in few bins."""
        return len(self.bins), -sum(room * room for room in self.free)


def crossed(giver: Packing, taker: Packing, rng: random.Random) -> Packing:
    best = sorted(range(len(giver.bins)), key=lambda b: (giver.free[b], rng.random()))[: max(1, len(giver.bins) // 2)]
    chosen = rng.sample(best, min(len(best), max(1, int(len(giver.bins) * INJECTED))))
    child, displaced = taker.without({p for b in chosen for p in giver.bins[b]})
    child.bins += [list(giver.bins[b]) for b in chosen]
    child.free += [giver.free[b] for b in chosen]
    displaced.sort(key=lambda p: -giver.sizes[p])
    child.fit(displaced)
    return child


def shaken(packing: Packing, rng: random.Random) -> Packing:
    """Break the emptiest bins and some others, and fit their pieces again."""
    order = sorted(range(len(packing.bins)), key=lambda b: -packing.free[b])
    few = max(2, len(order) // 20)
    copy, pieces = packing.without(set(), set(order[:few]) | set(rng.sample(order, min(len(order), few))))
    pieces.sort(key=lambda p: (-packing.sizes[p], rng.random()))
    copy.fit(pieces)
    return copy


def evolved(sizes: list[int], capacity: int, population: list[Packing], seed: int) -> list[Packing]:
    """The population after a round, best first; pieces are numbered from the largest down.

    It ends early once the best packing has no more bins than the sum of sizes needs.
    """
    rng, bound = random.Random(seed), -(-sum(sizes) // capacity)
    while len(population) < POPULATION:
        start = Packing(sizes, capacity)
        blur = 0.0 if not population else 0.2
        start.fit(sorted(range(len(sizes)), key=lambda p: -sizes[p] * (1 + blur * rng.random())))
        population.append(start)
        if len(start.bins) == bound:
            break
    population.sort(key=Packing.rank)
    for _ in range(CHILDREN):
        if len(population[0].bins) == bound or len(population) < 2:
            break
        giver, taker = rng.sample(population, 2)
        child = shaken(crossed(giver, taker, rng), rng)
        if child.rank() < population[-1].rank():
            population = sorted([*population[:-1], child], key=Packing.rank)
    return population


def _island(capacity: int, round_: int):
    """One round of one island, over rows (shard, island, member, uid, length, bin)."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        shard, island = (k.as_py() for k in key)
        columns = {n: rows.column(n).to_numpy() for n in ("member", "uid", "length", "bin")}
        one = columns["member"] == columns["member"].min()
        order = np.lexsort([columns["uid"][one], -columns["length"][one]])
        uids, lengths = columns["uid"][one][order], columns["length"][one][order]
        sizes, population = lengths.tolist(), []
        if round_:
            rank = np.argsort(uids)
            for member in np.unique(columns["member"]):
                mine = columns["member"] == member
                number = rank[np.searchsorted(uids[rank], columns["uid"][mine])]
                packing = Packing(sizes, capacity)
                bins = columns["bin"][mine]
                packing.bins = [[] for _ in range(int(bins.max()) + 1)]
                packing.free = [capacity] * len(packing.bins)
                for p, b in sorted(zip(number.tolist(), bins.tolist())):
                    packing.bins[b].append(p)
                    packing.free[b] -= sizes[p]
                population.append(packing)
        kept = evolved(sizes, capacity, population, (shard * ISLANDS + island) * ROUNDS + round_)[: 1 if round_ == ROUNDS - 1 else 2]
        out = []
        for member, packing in enumerate(kept):
            bin_of = np.empty(len(sizes), np.int64)
            for b, pieces in enumerate(packing.bins):
                bin_of[pieces] = b
            out.append(pa.table({
                "shard": np.full(len(sizes), shard), "island": np.full(len(sizes), island, np.int32),
                "member": np.full(len(sizes), member, np.int32), "uid": uids, "length": lengths, "bin": bin_of,
            }))
        return pa.concat_tables(out)

    return run


def _winner(capacity: int):
    """The best island's packing: (shard, uid, length, bin, offset, open)."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        island, bins, length, uid = (rows.column(n).to_numpy() for n in ("island", "bin", "length", "uid"))

        def rank(i: int) -> tuple[int, int, int]:
            fill = np.bincount(bins[island == i], length[island == i])
            return len(fill), -int(((capacity - fill) ** 2).sum()), i

        mine = island == min(np.unique(island), key=rank)
        order = np.lexsort([uid[mine], bins[mine]])
        uid, bins, length = uid[mine][order], bins[mine][order], length[mine][order]
        fill = np.bincount(bins, length).astype(np.int64)
        ends = np.cumsum(length)
        offset = ends - length - (np.cumsum(fill) - fill)[bins]
        return pa.table({
            "shard": np.full(len(uid), key[0].as_py()), "uid": uid, "length": length, "bin": bins, "offset": offset,
            "open": capacity - fill[bins] > capacity * OPEN,
        })

    return run


_ROWS = "shard bigint, island int, member int, uid bigint, length bigint, bin bigint"


def _level(pieces: DataFrame, capacity: int, shards: int, level: int) -> DataFrame:
    """Pack ``(uid, length)`` shard by shard."""
    state = pieces.select(
        F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(shards)).alias("shard"), F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"),
        F.lit(0).alias("member"), "uid", "length", F.lit(0).cast("bigint").alias("bin"),
    )
    for round_ in range(ROUNDS):
        if round_:
            # The best packing also goes to the next island, under a number of its own.
            goes = F.expr(f"if(member = 0, array(island, (island + 1) % {ISLANDS}), array(island))") if ISLANDS > 1 else F.array("island")
            state = state.withColumn("to", F.explode(goes)).select(
                "shard", F.col("to").alias("island"), (F.col("island") * 2 + F.col("member")).alias("member"), "uid", "length", "bin"
            )
        state = state.groupBy("shard", "island").applyInArrow(_island(capacity, round_), _ROWS)
    packed = state.groupBy("shard").applyInArrow(
        _winner(capacity), "shard bigint, uid bigint, length bigint, bin bigint, offset bigint, open boolean"
    )
    return stored(packed.withColumn("sequence_id", F.expr(f"({level}L << 56) + (shard << 20) + bin")), "packed")


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """``(uid, sequence_id, offset)`` for pieces ``(uid, length)`` with 1 <= length <= capacity.

    ``uid`` must be unique. Sequences are gapless from offset 0 and never above capacity. A
    full piece is a sequence by itself. Sequence numbers are unique, not consecutive. Equal
    input gives equal output. An empty table gives an empty result.
    """
    done = pieces.where(F.col("length") == capacity).select("uid", F.expr("(1L << 62) + uid").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    todo, level, before = pieces.where(F.col("length") < capacity).select("uid", "length"), 0, None
    while True:
        shards = -(-todo.count() // shard)
        if not shards:
            return done
        packed = _level(todo, capacity, shards, level)
        last = shards == 1 or (before is not None and shards > 0.7 * before)
        done = done.union((packed if last else packed.where("not open")).select("uid", "sequence_id", "offset"))
        if last:
            return done
        todo, level, before = packed.where("open").select("uid", "length"), level + 1, shards


def pieces_of(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``: every text's ids and the end id, cut only where longer than the capacity.

    A null text is empty: one piece with the end id. ``with_ids`` adds the ids themselves,
    as little-endian 32-bit numbers.
    """
    source = narrowed(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, ids, counts in encoded_slices(tokenizer, batch.column(1)):
                ids, counts = with_end(ids, counts, end)
                wide = memoryview(ids.astype("<u4")).cast("B")
                pieces = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(counts[doc] - start, capacity)
                at = 4 * ((np.cumsum(counts) - counts)[doc] + start)
                cuts = [wide[a : a + n] for a, n in zip(at.tolist(), (4 * length).tolist())]
                out = [
                    batch.column(0).slice(first, len(counts)).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start),
                    pa.array(length), pa.array([zlib.crc32(c) for c in cuts], pa.int64()),
                ]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.array([c.tobytes() for c in cuts], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def packed_documents(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """The pieces of every text with ``sequence_id`` and ``offset``.

    Repeated rows and null ids are packed like any others, each row by itself. An empty
    table gives an empty result. Extra columns are left out.
    """
    # Written once, so that the numbers of the rows hold whatever is lost later.
    pieces = stored(pieces_of(docs, tokenizer, capacity, end, id_col, text_col, with_ids).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack(pieces.select("uid", "length"), capacity), "uid").drop("uid")


@query("op3_packing")
def op3_packing(spark, folder):
    """Every piece of every document with its sequence and its place there."""
    packed = packed_documents(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
