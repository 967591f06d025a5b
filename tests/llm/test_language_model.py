import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ebbtide.llm import language_model as lm


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def plain_base(rows):
    counts = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    return [
        (i, held(i), len(mine), sum(counts[t] > 0 for t in mine), n, sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in mine))
        for i, text in rows for mine in [tokens(text)]
    ]


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], round(r[5], 4))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g[:5]) == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and math.isfinite(g[6])


def test_base_score_against_plain_code(clashing, corpus, monkeypatch):
    want = plain_base([(r[0], r[1]) for r in corpus])
    same(lm.scored(clashing).collect(), want)
    # Most words outside the dictionary, so that the join brings their counts.
    monkeypatch.setattr(lm, "DICTIONARY", 12)
    same(lm.scored(clashing).collect(), want)


def test_query(spark, big):
    rows = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text").collect()
    found = lm.op10_language_model(spark, big).collect()
    same(found, plain_base([tuple(r) for r in rows]))
    out = [r for r in found if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.1 * sum(r.n_tokens for r in out)


def test_the_model_follows_from_the_rows_alone(spark, clashing, monkeypatch):
    """Other splits of the same rows give the same scores; several shards and empty ones among them."""
    monkeypatch.setattr(lm.train, "__defaults__", (lm.ROUNDS, 3_000))
    key = lambda r: (str(r[0]), r.n_tokens, r.base_score)
    one, two = (sorted(lm.scored(df).collect(), key=key) for df in (clashing.coalesce(1), clashing.repartition(11)))
    assert [tuple(r)[:5] for r in one] == [tuple(r)[:5] for r in two]
    assert [r.score for r in one] == pytest.approx([r.score for r in two], rel=1e-9)


def test_scores_against_plain_code(docs, corpus, monkeypatch):
    """Every text scored again from the model's arrays, a word at a time."""
    source = docs.selectExpr("doc_id AS id", "text")
    kept = []
    train = lm.train
    monkeypatch.setattr(lm, "train", lambda *a: kept.append((a[1], train(*a))) or kept[-1][1])
    rows = lm.scored(docs).collect()
    voc, model = kept[0]
    counts = Counter(t for i, text in [(r[0], r[1]) for r in corpus] if not held(i) for t in tokens(text))
    normal = {}

    def plain(text):
        total, one, two = 0.0, lm.END, lm.END
        for t in tokens(text):
            now = lm.END if t is None else voc.classes.get(t, voc.first_spelling + lm.spelling(t))
            if (one, two) not in normal:
                normal[one, two] = math.log(np.exp((model.r @ (model.c[0][one] + model.c[1][two])).astype(np.float64) + model.b).sum())
            total += (float(model.r[now] @ (model.c[0][one] + model.c[1][two])) + float(model.b[now]) - normal[one, two]) / math.log(10)
            if now >= voc.first_spelling:
                total += math.log10((counts[t] + lm.SMOOTH) / (voc.tokens[now] + lm.SMOOTH * (voc.kinds[now] + 1)))
            one, two = now, one
        return total

    texts = {r["id"]: r["text"] for r in source.collect() if r["id"] is not None and r["id"] > 0}
    checked = [r for r in rows if r["id"] in texts and r["n_tokens"] < 200]
    assert len(checked) > 80
    for r in checked:
        assert r["score"] == pytest.approx(plain(texts[r["id"]]), rel=1e-4, abs=1e-3)


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(30)]
    voc = lm.Vocabulary({w: 9 for w in words}, {w: i + 1 for i, w in enumerate(words[:20])}, np.r_[5, np.full(20, 9), np.arange(lm.SPELLINGS)], np.r_[np.zeros(21, int), np.arange(lm.SPELLINGS) // 2], 1000, 300)
    size = 21 + lm.SPELLINGS
    model = lm.Model(rng.normal(0, 1, (size, lm.WIDTH)).astype("f4"), rng.normal(0, 1, (2, size, lm.WIDTH)).astype("f4"), rng.normal(0, 1, size).astype("f4"))
    scorer = lm.Scorer(model, voc)
    for one, two in ((0, 0), (3, 17), (size - 1, 4)):
        now = np.arange(size)
        logs = scorer.classes(now, np.full(size, one), np.full(size, two)) + scorer.shared
        assert (10**logs).sum() == pytest.approx(1, abs=1e-4)


def test_training_learns_what_follows_what():
    rng = np.random.default_rng(3)
    now = np.zeros(60_000, np.int64)
    for i in range(1, len(now)):  # each class is followed by the next one, mostly
        now[i] = (now[i - 1] + 1) % 8 if rng.random() < 0.9 else rng.integers(8)
    share = np.full(8, 1 / 8)
    start = lm.Model.start(np.full(8, 10))
    model, seen = lm.trained(start, share, iter([(now[2:], now[1:-1], now[:-2])] * 8), 1)
    voc = lm.Vocabulary({}, {f"w{i}": i for i in range(1, 8)}, np.full(8 + lm.SPELLINGS, 10), np.zeros(8 + lm.SPELLINGS, int), 80, 8)
    voc.tokens = np.full(8, 10)
    voc.kinds = np.zeros(8, int)
    logs = lm.Scorer(model, voc).classes(now[2:], now[1:-1], now[:-2])
    assert seen == 8 * (len(now) - 2) and logs.mean() > -0.55 > np.log10(1 / 8)


def test_empty(nothing, spark):
    assert lm.scored(nothing).count() == 0
    ids = [i for i in range(200) if held(i)][:2]
    only = spark.createDataFrame([(i, "a b") for i in ids], "doc_id bigint, text string")
    rows = lm.scored(only).collect()
    assert len(rows) == 2 and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in rows)
