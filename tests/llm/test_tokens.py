import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ebbtide.llm import elias_fano, packing, token_counts, token_files, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text("ab É'.,!<|>endoftxsr \n\t\x1c\xa0İßΣ́é9", max_size=60)), max_size=6))
def test_words_one_by_one_give_the_ids_of_whole_texts(texts):
    import pyarrow as pa

    whole = Tokenizer.from_file(PATH)
    got = [part.tolist() for _, row, n in tokens.encoded_slices(PATH, pa.array(texts, pa.string())) for part in np.split(row, np.cumsum(n)[:-1])]
    assert got == [ids(whole, t) for t in texts]


def test_words_of_a_whole_table(spark, big, tokenizer):
    import pyarrow as pa

    texts = spark.read.parquet(f"{big}/documents.parquet").select("text").toArrow().column(0).combine_chunks().cast(pa.string())
    got = [part.tolist() for _, row, n in tokens.encoded_slices(PATH, texts) for part in np.split(row, np.cumsum(n)[:-1])]
    assert got == [e.ids for e in tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]


def test_forgotten_words_are_asked_for_again(spark, tokenizer, monkeypatch):
    import pyarrow as pa

    from ebbtide.llm import common

    monkeypatch.setattr(tokens, "MEMORY", 40)
    encoder = tokens.Ids(PATH)
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] * 2
    got = []
    for _, part in common.text_slices(pa.array(texts), 1000):
        row, n = encoder.encode(part)
        got += [x.tolist() for x in np.split(row, np.cumsum(n)[:-1])]
    assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), min_size=1, max_size=300) | st.lists(st.integers(0, (1 << 63) - 1), min_size=1, max_size=20))
def test_elias_fano_selects_every_number(values):
    values = np.sort(np.array(values, np.int64))
    data = elias_fano.pack(values)
    read = elias_fano.EliasFano(data)
    assert read.select(np.arange(len(values))).tolist() == values.tolist()
    assert read.select([len(values) // 2]).tolist() == [values[len(values) // 2]]
    assert read.size == len(data)


def test_elias_fano_is_small():
    bounds = np.cumsum(np.random.default_rng(1).integers(0, 2000, 50_000))
    assert 8 * len(elias_fano.pack(bounds)) < 50_000 * (2 + np.log2(1000) + 1.5)


def expected_files(rows, tokenizer, end=1):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    out, at = [], 0
    for i, text in rows:
        mine = [*ids(tokenizer, text), end]
        out.append((i, at, len(mine), crc(mine)))
        at += len(mine)
    return out


def got_files(df):
    return [tuple(r) for r in df.orderBy("start").collect()]


def test_files_round_trip(spark, clashing, corpus, tokenizer, tmp_path):
    for block in (50, 1 << 22):
        path = str(tmp_path / f"files{block}")
        token_files.write_token_files(clashing, path, PATH, block_ids=block)
        assert got_files(token_files.read_token_files(spark, path)) == expected_files([(r[0], r[1]) for r in corpus], tokenizer)


def test_files_of_a_range_are_many_and_small(spark, tokenizer, tmp_path):
    """Ids from end to end of the whole numbers, repeated and missing, in more files than ranges."""
    rows = [(i * 97 - 500, f"text number {i} " * (i % 5)) for i in range(300)]
    rows += [(-(1 << 63), "the least"), ((1 << 63) - 1, "the greatest"), (7, "b"), (7, "b"), (7, "a"), (None, "none"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    path = str(tmp_path / "many")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(setting, 5)
    try:
        token_files.write_token_files(df, path, PATH, block_ids=40, file_blocks=3)
    finally:
        spark.conf.unset(setting)
    files = spark.read.format("binaryFile").load(path).select("content").collect()
    blocks = [len(list(token_files.read_blocks(memoryview(bytes(f[0]))))) for f in files]
    assert max(blocks) == 3 and len(blocks) > 8
    assert got_files(token_files.read_token_files(spark, path)) == expected_files(rows, tokenizer)


def test_document_ids_take_little_space():
    counts = np.full(50_000, 3)
    data = token_files.block_bytes(0, pa.array(np.arange(50_000) * 5 + 10**12), counts, np.zeros(150_000, np.uint16))
    assert len(data) - 300_000 < 50_000 * (5 + 5) / 8


def test_files_of_an_empty_table(spark, nothing, tmp_path):
    token_files.write_token_files(nothing, str(tmp_path / "none"), PATH)
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_files_query(spark, big, tokenizer):
    rows = [tuple(r) for r in spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text").collect()]
    assert got_files(token_files.op7_token_files(spark, big)) == expected_files(rows, tokenizer)


def test_limits_against_plain_sums(spark, clashing, corpus, tokenizer, nothing):
    lengths = sorted(len(ids(tokenizer, r[1])) for r in corpus)
    for span in (7, 4096):
        histogram = token_counts.length_histogram(clashing, PATH)
        rows = token_counts.limits(histogram, span)
        for r in rows.collect():
            at = r["length"]
            assert r["docs"] == lengths.count(at)
            assert r["docs_longer"] == sum(n > at for n in lengths) and r["tokens_longer"] == sum(n for n in lengths if n > at)
            assert r["tokens"] == sum(lengths) and r["truncated_tokens"] == sum(min(n, at) for n in lengths)
            assert r["docs_within"] == sum(n <= at for n in lengths) and r["quantile"] == pytest.approx(r["docs_within"] / len(lengths))
        assert rows.count() == len(set(lengths))
    assert token_counts.truncated_at(rows, 33) == sum(min(n, 33) for n in lengths)
    assert token_counts.length_quantile(rows, 0.5) == lengths[(len(lengths) + 1) // 2 - 1]
    empty = token_counts.limits(token_counts.length_histogram(nothing, PATH))
    assert empty.count() == 0 and token_counts.truncated_at(empty, 5) == 0 and token_counts.length_quantile(empty, 0.5) is None


def test_counts_query(spark, big, tokenizer):
    texts = [r[0] for r in spark.read.parquet(f"{big}/documents.parquet").select("text").collect()]
    lengths = [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    rows = token_counts.op6_token_counts(spark, big).collect()
    assert {(r["length"], r["docs"], r["truncated_tokens"]) for r in rows} == {
        (n, lengths.count(n), sum(min(m, n) for m in lengths)) for n in set(lengths)
    }


def check_packed(rows, want, capacity):
    """rows (doc_id, piece, start, length, crc, sequence, offset) cover ``want`` and fill sequences gaplessly."""
    pieces = sorted((r[0] is not None, r[0] or 0, *r[1:5]) for r in rows)
    expected = sorted(
        (i is not None, i or 0, k, k * capacity, len(part), crc(part))
        for i, mine in want for k, part in enumerate([mine[a : a + capacity] for a in range(0, len(mine), capacity)])
    )
    assert pieces == expected
    sequences = {}
    for r in rows:
        sequences.setdefault(r[5], []).append((r[6], r[3]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(clashing, corpus, tokenizer, nothing):
    columns = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    want = [(r[0], [*ids(tokenizer, r[1]), 0]) for r in corpus]
    for capacity in (64, 2048):
        rows = [tuple(r) for r in packing.packed_documents(clashing, PATH, capacity).select(columns).collect()]
        used = check_packed(rows, want, capacity)
        assert used <= 1.02 * sum(len(m) for _, m in want) / capacity + 1
    assert packing.packed_documents(nothing, PATH).count() == 0


def test_packing_in_shards_and_again(spark):
    rng = np.random.default_rng(3)
    lengths = np.concatenate([rng.integers(1, 101, 3000), [100] * 40])
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "uid bigint, length bigint")
    found = packing.pack(df, 100, shard=500).join(df, "uid")
    assert found.count() == len(lengths)
    filled = found.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert filled.where("n > 100 or n <> end").count() == 0
    assert filled.count() <= 1.02 * lengths.sum() / 100 + 1
    again = packing.pack(df.repartition(3), 100, shard=500)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, packing.pack(df, 100, shard=500).collect()))


def test_genetic_search_beats_best_fit():
    rng = np.random.default_rng(0)
    sizes = sorted(rng.integers(500, 1100, 2000).tolist(), reverse=True)
    plain = packing.Packing(sizes, 2048)
    plain.fit(list(range(len(sizes))))
    best = packing.evolved(sizes, 2048, [], 1)[0]
    assert sorted(p for b in best.bins for p in b) == list(range(len(sizes)))
    assert best.rank() <= plain.rank() and all(sum(sizes[p] for p in b) + f == 2048 for b, f in zip(best.bins, best.free))


def test_packing_query(spark, big, tokenizer):
    rows = [tuple(r) for r in packing.op3_packing(spark, big).collect()]
    docs = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text").collect()
    coded = tokenizer.encode_batch([d[1] or "" for d in docs], add_special_tokens=False)
    check_packed(rows, [(d[0], [*e.ids, 0]) for d, e in zip(docs, coded)], 2048)
