"""Every stage against plain code over its own input, on a whole small table."""

import hashlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ebbtide.llm import quality
from tests.llm.test_mixing import WORD, plain_mix
from tests.llm.test_similar_documents import plain_groups
from tests.llm.test_tokens import PATH, check_packed


@pytest.fixture(scope="module")
def steps(spark, big, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{big}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, big).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        tables.append(docs)
    return [t.collect() for t in tables], tables


def test_columns_and_order(steps):
    rows, tables = steps
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language", "near duplicates", "mixing", "packing"]
    assert all(t.dtypes == tables[0].dtypes for t in tables[1:-1])


def test_quality(steps, spark, big):
    rows, tables = steps
    stats = quality.with_statistics(tables[0], keep=["doc_id"])
    rules = quality.learned_rules(stats, spark.read.parquet(f"{big}/labels.parquet"))
    want = {r.doc_id for r in stats.where(quality.verdict(rules)).collect()}
    assert {r.doc_id for r in rows[1]} == want and set(rows[1]) <= set(rows[0])
    good = {r.doc_id for r in spark.read.parquet(f"{big}/labels.parquet").where("quality = 1").collect()}
    fails = {r.doc_id for r in stats.where(quality.base_failed()).collect()}
    assert len(good - fails - want) <= 0.01 * len(good)


def test_language(steps):
    rows, _ = steps
    assert len(rows[2]) >= 0.99 * len(rows[1])
    before = {r.doc_id: r.lang for r in rows[1]}
    assert sum(before[r.doc_id] == r.lang for r in rows[2]) >= 0.99 * len(rows[2])


def test_one_of_each_group(steps):
    """Five-word shingles and a similarity of 0.8, exact sets of all pairs that share a shingle."""
    rows, _ = steps
    assert sorted(r.doc_id for r in rows[3]) == plain_groups([(r.doc_id, r.text) for r in rows[2]]) and set(rows[3]) <= set(rows[2])


def test_mix(steps):
    rows, _ = steps
    want = {w[0]: w[5] for w in plain_mix([(r.doc_id, r.text, r.source) for r in rows[3]]) if w[5]}
    text = {r.doc_id: r.text for r in rows[3]}
    got = Counter()
    for r in rows[4]:
        assert text[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        got[hashlib.md5(f"{r.doc_id}|{text[r.doc_id]}".encode()).hexdigest()] += len(WORD.findall(r.text))
    assert got == want


def test_packed(steps):
    rows, _ = steps
    coded = Tokenizer.from_file(PATH).encode_batch([r.text for r in rows[4]], add_special_tokens=False)
    want = [(r.doc_id, [*e.ids, 0]) for r, e in zip(rows[4], coded)]
    used = check_packed([tuple(r) for r in rows[5]], want, 2048)
    assert used <= 1.03 * sum(len(m) for _, m in want) / 2048 + 1


def test_run_gives_the_same(spark, big, steps):
    rows, _ = steps
    cut = lambda rs: sorted(tuple(r)[:5] for r in rs)
    assert cut(corpus_pipeline.run(spark, big).collect()) == cut(rows[5])


def test_empty_documents(spark, big):
    docs = spark.read.parquet(f"{big}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, big)
        assert docs.count() == 0
