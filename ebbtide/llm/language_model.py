"""Log-bilinear language model trained with noise-contrastive estimation (operator 10).

The model predicts a word's class from the two words before it. Frequent words are classes
of their own, all others fall into classes by their spelling; within its class a word has
its smoothed share of the class's tokens. Class scores are sums of one product per
context word, so the normaliser of every pair of context classes is one product of two
matrices, and every token's log probability is exactly normalised.

Counts cover all training tokens: tasks count their own, the shuffle adds up. Documents are
dealt into shards by a hash of id and text, as many as the number of tokens asks for; a
copy of the model is trained on each, and the copies are averaged, round by round. So the
model follows from the rows alone, not from how files or cores split them. Words outside a
dictionary of bounded size get their counts by a join.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.common import narrowed, query, stored, table, text_slices

HELD_OUT = 10
SMOOTH = 0.1
#: Words with a class of their own, and classes for all others.
FREQUENT, SPELLINGS = 1792, 255
#: Words whose counts every task holds, at most.
DICTIONARY = 1 << 17
WIDTH = 24
#: Noise words per batch, tokens per batch, step size, rounds of training and averaging.
NOISE, BATCH, STEP, ROUNDS = 40, 4096, 0.08, 2
#: Training tokens of a copy in a round.
COPY_TOKENS = 1 << 21
#: Words a task counts before it hands them on.
AT_ONCE = 1 << 20
SEED = 20
END = 0


def is_held_out(doc_id) -> bool:
    """Whether crc32 of the id as text leaves no remainder; a null id is never held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % HELD_OUT == 0


def held_out_column(name: str = "id"):
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def _words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of a slice of texts, lower-cased and coded, and the number per text."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, bounds = parts.flatten(), parts.offsets.to_numpy()
    full = pc.not_equal(flat, "")
    per_text = np.diff(np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[bounds - bounds[0]])
    return flat.filter(full).dictionary_encode(), per_text


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)`` of all training rows of ``docs`` (columns id and text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for _, texts in text_slices(batch.column(0)):
                words, _ = _words(texts)
                n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                seen.update(dict(zip(words.dictionary.to_pylist(), n.tolist())))
                if len(seen) > AT_ONCE:
                    yield counted()
                    seen.clear()
        if seen:
            yield counted()

    partial = docs.where(~held_out_column()).select("text").mapInArrow(run, "word string, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def spelling(word: str) -> int:
    """Class of a word by its last letters, so that words of one language and form meet."""
    return zlib.crc32(word[-3:].encode()) % SPELLINGS


@dataclass
class Vocabulary:
    """Class numbers (0 ends a text, then frequent words, then spellings) and counts."""

    dictionary: dict[str, int]
    classes: dict[str, int]
    #: Tokens of each class, and distinct words of each spelling class.
    tokens: np.ndarray
    kinds: np.ndarray
    total: int
    distinct: int

    @property
    def first_spelling(self) -> int:
        return len(self.classes) + 1

    def coded(self, words: list[str]) -> np.ndarray:
        """Class of each word."""
        known, first = self.classes, self.first_spelling
        return np.array([known[w] if w in known else first + spelling(w) for w in words], np.int64)


def vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    """From the stored counts and the number of training texts.

    The dictionary holds all words of at least the lowest power of two that keeps it within
    its bound; the most frequent ones of it are classes. Sums over spelling classes are
    aggregated by Spark.
    """
    powers = [F.count_if(F.col("n") >= 1 << k).alias(str(k)) for k in range(48)]
    row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct"), *powers).first()
    least = next(1 << k for k in range(48) if row[str(k)] <= DICTIONARY)
    found = counts.where(F.col("n") >= least).toArrow()
    order = sorted(zip((-n for n in found.column("n").to_pylist()), found.column("word").to_pylist()))
    dictionary = {w: -n for n, w in order}
    classes = {w: i + 1 for i, (_, w) in enumerate(order[:FREQUENT])}

    def by_spelling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, kinds = np.zeros(SPELLINGS, np.int64), np.zeros(SPELLINGS, np.int64)
        for batch in batches:
            of = np.array([spelling(w) for w in batch.column(0).to_pylist()], np.int64)
            tokens += np.bincount(of, batch.column(1).to_numpy(), SPELLINGS).astype(np.int64)
            kinds += np.bincount(of, minlength=SPELLINGS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SPELLINGS)), pa.array(tokens), pa.array(kinds)], ["c", "tokens", "kinds"])

    size = 1 + len(classes) + SPELLINGS
    tokens, kinds = np.zeros(size, np.int64), np.zeros(size, np.int64)
    sums = counts.mapInArrow(by_spelling, "c bigint, tokens bigint, kinds bigint").groupBy("c").agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds"))
    for r in sums.collect():
        tokens[1 + len(classes) + r["c"]], kinds[1 + len(classes) + r["c"]] = r["tokens"], r["kinds"]
    tokens[END] = texts
    for w, c in classes.items():
        at = 1 + len(classes) + spelling(w)
        tokens[c] = dictionary[w]
        tokens[at] -= dictionary[w]
        kinds[at] -= 1
    return Vocabulary(dictionary, classes, tokens, kinds, row["total"] + texts, row["distinct"] + (texts > 0))


def sequences(voc: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Classes of all tokens with the two classes before each, the tokens per text, and the words."""
    words, per_text = _words(texts)
    coded = voc.coded(words.dictionary.to_pylist())[words.indices.to_numpy()] if len(words) else np.empty(0, np.int64)
    size = per_text + 1
    ends = np.cumsum(size) - 1
    now = np.empty(len(coded) + len(size), np.int64)
    body = np.ones(len(now), bool)
    body[ends] = False
    now[body], now[ends] = coded, END
    one, two = np.concatenate([[END], now[:-1]]), np.concatenate([[END, END], now[:-2]])[: len(now)]
    two[ends - size + 1] = END
    return now, one, two, size, words


@dataclass
class Model:
    """Class vectors ``r`` and biases ``b``; context vectors ``c`` for one and two words before."""

    r: np.ndarray
    c: np.ndarray
    b: np.ndarray

    @staticmethod
    def start(tokens: np.ndarray) -> Model:
        rng, size = np.random.default_rng(SEED), len(tokens)
        share = (tokens + SMOOTH) / (tokens.sum() + SMOOTH * size)
        return Model(
            rng.normal(0, 0.1, (size, WIDTH)).astype(np.float32), rng.normal(0, 0.1, (2, size, WIDTH)).astype(np.float32), np.log(share).astype(np.float32)
        )

    def flat(self) -> np.ndarray:
        """One row per class."""
        return np.concatenate([self.r, self.c[0], self.c[1], self.b[:, None]], axis=1)

    @staticmethod
    def of(flat: np.ndarray) -> Model:
        r, one, two, b = np.split(flat.astype(np.float32), [WIDTH, 2 * WIDTH, 3 * WIDTH], axis=1)
        return Model(np.ascontiguousarray(r), np.stack([one, two]), b[:, 0].copy())


def _add(where: np.ndarray, index: np.ndarray, rows: np.ndarray, squares: np.ndarray) -> None:
    """Step along the summed rows of each index, divided by the root of its squares so far."""
    order = np.argsort(index, kind="stable")
    ordered = index[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sums, at = np.add.reduceat(rows[order], first, axis=0), ordered[first]
    squares[at] += (sums * sums).mean(axis=1)
    where[at] += STEP * sums / np.sqrt(squares[at] + 1e-6)[:, None]


def trained(model: Model, noise: np.ndarray, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], seed: int) -> tuple[Model, int]:
    """One pass over (class, one before, two before): tell tokens from noise words of the same batch."""
    rng = np.random.default_rng(seed)
    r, c, b = model.r.copy(), model.c.copy(), model.b.copy()
    sr, sc = np.zeros(len(r), np.float32), np.zeros((2, len(r)), np.float32)
    # log(k q): what a token's score is held against.
    base, below, seen = np.log(NOISE * noise).astype(np.float32), np.cumsum(noise), 0
    for now, one, two in batches:
        for at in range(0, len(now), BATCH):
            w, p, q = now[at : at + BATCH], one[at : at + BATCH], two[at : at + BATCH]
            bad = np.minimum(np.searchsorted(below, rng.random(NOISE)), len(noise) - 1)
            h = c[0][p] + c[1][q]
            true = (h * r[w]).sum(axis=1) + b[w] - base[w]
            false = h @ r[bad].T + (b[bad] - base[bad])
            up = 1 / (1 + np.exp(np.clip(true, -30, 30)))
            down = -1 / (1 + np.exp(np.clip(-false, -30, 30)))
            dh = up[:, None] * r[w] + down @ r[bad]
            _add(r, np.concatenate([w, bad]), np.concatenate([up[:, None] * h, down.T @ h]), sr)
            _add(c[0], p, dh, sc[0])
            _add(c[1], q, dh, sc[1])
            seen += len(w)
    return Model(r, c, b), seen


def train(docs: DataFrame, voc: Vocabulary, rounds: int = ROUNDS, copy_tokens: int = COPY_TOKENS) -> Model:
    """Average of the copies that the shards train, weighted by their tokens, in each round.

    Every training document is used in one round and one shard, by a hash of its id and
    text, and stands in its shard in the order of that hash. Documents without id are dealt
    by their text. What a shard sends is the size of the model, added up in two steps, each
    in the order of the shards.
    """
    shards = max(1, -(-int(voc.total) // (rounds * copy_tokens)))
    model, noise = Model.start(voc.tokens), (voc.tokens + SMOOTH) / (voc.tokens.sum() + SMOOTH * len(voc.tokens))
    training = docs.where(~held_out_column()).withColumn("deal", F.xxhash64("id", "text")).withColumn("turn", F.pmod("deal", F.lit(rounds)))
    for turn in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast((model, voc))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            start, voc = sent.value
            rows = (sequences(voc, t)[:3] for batch in batches for _, t in text_slices(batch.column(0)))
            shard = TaskContext.get().partitionId()
            new, seen = trained(start, noise, rows, SEED + 1000 * shard + turn)
            if seen:
                data = (new.flat().astype(np.float64) * seen).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([seen], pa.int64()), pa.array([data], pa.binary())], ["shard", "seen", "data"])

        def added(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = None, 0
            for batch in rows:
                for n, data in zip(batch.column("seen").to_pylist(), batch.column("data")):
                    one = np.frombuffer(data.as_buffer(), np.float64)
                    total, seen = (one.copy() if total is None else total + one), seen + n
            if total is not None:
                part = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seen], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["shard", "seen", "data"])

        kind = "shard bigint, seen bigint, data binary"
        dealt = training.where(F.col("turn") == turn).select("deal", "text").repartitionById(shards, F.pmod(F.shiftright("deal", 8), F.lit(shards)).cast("int"))
        copies = dealt.sortWithinPartitions("deal", "text").select("text").mapInArrow(run, kind)
        # Each of 32 tasks adds up its share of the copies in the order of the shards; their sums meet here.
        parts = copies.repartitionById(32, (F.col("shard") % 32).cast("int")).sortWithinPartitions("shard")
        sums = sorted(parts.mapInArrow(added, kind).collect(), key=lambda r: r["shard"])
        seen = sum(r["seen"] for r in sums)
        if seen:
            total = sum((np.frombuffer(r["data"], np.float64) for r in sums), np.zeros(model.flat().size))
            model = Model.of((total / seen).reshape(model.flat().shape))
        sent.unpersist()
    return model


class Scorer:
    """Log10 probabilities of classes after any two classes, exactly normalised."""

    def __init__(self, model: Model, voc: Vocabulary):
        self.voc = voc
        first, second = model.c[0] @ model.r.T, model.c[1] @ model.r.T
        high = first.max(axis=1), second.max(axis=1)
        sums = (np.exp(first - high[0][:, None]) * np.exp(model.b)) @ np.exp(second - high[1][:, None]).T
        self.normal = np.log(np.maximum(sums, 1e-37)) + high[0][:, None] + high[1][None, :]
        self.first, self.second, self.b = first, second, model.b
        spelled = voc.first_spelling
        # Log10 of the tokens a spelling class shares out, one unseen word included; 0 for words of their own.
        self.shared = np.zeros(len(voc.tokens))
        self.shared[spelled:] = np.log10(voc.tokens[spelled:] + SMOOTH * (voc.kinds[spelled:] + 1))

    def classes(self, now: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        natural = self.first[one, now] + self.second[two, now] + self.b[now] - self.normal[one, two]
        return natural.astype(np.float64) / np.log(10) - self.shared[now]


_SCORERS: dict[str, Scorer] = {}


def _scorer(name: str, sent) -> Scorer:
    """This worker's scorer of a broadcast model, made once."""
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = Scorer(*sent.value)
    return _SCORERS[name]


def _parts(docs: DataFrame, model: Model, voc: Vocabulary) -> DataFrame:
    """A row per document with its sums over known words, and rows (uid, word, n) for words outside the dictionary."""
    sent, name = docs.sparkSession.sparkContext.broadcast((model, voc)), uuid.uuid4().hex
    id_type = docs.schema["id"].dataType.simpleString()
    arrow_id = docs.select("id").limit(0).toArrow().schema.field("id").type
    kind = f"uid bigint, id {id_type}, n_tokens bigint, n_known bigint, logs double, tail_logs double, model double, word string, n bigint"
    names = ["uid", "id", "n_tokens", "n_known", "logs", "tail_logs", "model", "word", "n"]
    types = [pa.int64(), arrow_id, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.int64()]

    def batch_of(**columns) -> pa.RecordBatch:
        size = len(columns["uid"])
        made = [pa.array(columns[n], t) if n in columns and not isinstance(columns[n], pa.Array) else columns.get(n, pa.nulls(size, t)) for n, t in zip(names, types)]
        return pa.RecordBatch.from_arrays(made, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, uid = _scorer(name, sent), TaskContext.get().partitionId() << 33
        voc = scorer.voc
        for batch in batches:
            for start, texts in text_slices(batch.column(1)):
                now, one, two, size, words = sequences(voc, texts)
                listed, at = words.dictionary.to_pylist(), words.indices.to_numpy()
                count = np.array([voc.dictionary.get(w, 0) for w in listed], np.int64)[at] if len(at) else np.empty(0, np.int64)
                doc = np.repeat(np.arange(len(size)), size)
                ends = np.cumsum(size) - 1
                c = np.zeros(len(now), np.int64)
                body = np.ones(len(now), bool)
                body[ends] = False
                c[body], c[ends] = count, voc.tokens[END]
                inside = c > 0
                inside[ends] = True
                logs = np.where(inside, np.log10(c + SMOOTH), 0.0)
                tail = now >= voc.first_spelling
                sums = lambda x: np.bincount(doc, x, len(size))
                yield batch_of(
                    uid=uid + np.arange(len(size)), id=batch.column(0).slice(start, len(size)), n_tokens=size, n_known=sums(c > 0).astype(np.int64),
                    logs=sums(logs), tail_logs=sums(logs * tail), model=sums(scorer.classes(now, one, two)),
                )
                rest = np.flatnonzero(count == 0)
                if len(rest):
                    pair, n = np.unique(doc[body][rest] * len(listed) + at[rest], return_counts=True)
                    yield batch_of(uid=uid + pair // len(listed), word=words.dictionary.take(pa.array(pair % len(listed))), n=n)
                uid += len(size)

    return stored(docs.mapInArrow(run, kind), "scored")


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base and model log10 probability of every text, the model trained on those not held out.

    Columns: id, held_out, n_tokens, n_known, train_tokens, base_score, score. Tokens are
    the words and one end. A null text is empty and has the end alone. Null ids are never
    held out; repeated rows are scored and, unless held out, counted each. Without training
    rows every word is unseen. An empty table gives an empty result; extra columns are left out.
    """
    source = narrowed(docs, id=id_col, text=text_col)
    counts = stored(word_counts(source), "word_counts")
    texts = source.where(~held_out_column()).count()
    voc = vocabulary(counts, texts)
    parts = _parts(source, train(source, voc), voc)
    # A word outside the dictionary is rarer than all in it, so no key of this join is hot.
    c = F.coalesce(F.col("seen"), F.lit(0))
    rest = (
        parts.where("word is not null").select("uid", "word", "n").join(counts.select("word", F.col("n").alias("seen")), "word", "left")
        .groupBy("uid").agg(F.sum(F.col("n") * F.log10(c + SMOOTH)).alias("rest"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more"))
    )
    extra, more = F.coalesce("rest", F.lit(0.0)), F.coalesce("more", F.lit(0))
    whole = float(np.log10(voc.total + SMOOTH * (voc.distinct + 1)))
    return parts.where("word is null").join(rest, "uid", "left").select(
        "id", held_out_column().alias("held_out"), "n_tokens", (F.col("n_known") + more).alias("n_known"), F.lit(voc.total).cast("bigint").alias("train_tokens"),
        (F.col("logs") + extra - F.col("n_tokens") * F.lit(whole)).alias("base_score"), (F.col("model") + F.col("tail_logs") + extra).alias("score"),
    )


@query("op10_language_model")
def op10_language_model(spark, folder):
    """Every document with its base score and the model's."""
    return scored(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")
