import re
import unicodedata

import numpy as np
import pytest

from ebbtide.llm import quality

SYMBOLS = set("#*$%&|<>")


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    at = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)} if len(words) < 3000 else None
    lines, seen, twice = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in SYMBOLS for c in text or ""), twice, None if at is None else len(at)


def test_counts_against_plain_code(clashing, corpus, docs):
    texts = [r[1] for r in corpus] + ["a b c d e a b c d e", "x\nx\n \n\nx\ty", "é😀 ## <a> é😀", "a a a a a a a", " ".join("ab" * 40)]
    for text in texts:
        got, want = quality.statistics(text)[:5], plain_base(text)
        assert got[:4] == list(want[:4]) and want[4] in (None, got[4])
    rows = quality.with_statistics(clashing.drop("stats"), keep=["doc_id", "text"]).collect()
    assert len(rows) == len(corpus)
    assert all(list(r.stats) == quality.statistics(r.text) for r in rows)


@pytest.mark.parametrize("text, capitals", [
    ("привет как дела сегодня мир 你好 世界", 0), ("Привет МИР", 4), ("ł ő œ Ł Ő Œ ß ẞ", 4), ("Ελληνικά ΑΒΓ", 4), ("مرحبا بالعالم", 0),
    ("नमस्ते दुनिया", 0), ("שלום עולם", 0), ("ABC def É é ÿ", 4), ("こんにちは カタカナ", 0), ("", 0),
])
def test_capitals_in_many_scripts(text, capitals):
    got = dict(zip(quality.COUNTS, quality.statistics(text)))
    assert got["n_upper"] == capitals == sum(unicodedata.category(c) == "Lu" for c in text)


def test_verdict_against_the_printed_rules(spark, docs):
    """The ordered conditional expression says what the rules say in plain code."""
    rules = [quality.Rule((("symbols_per_word", True, 0.5), ("chars_per_word", False, 6.0))), quality.Rule((("distinct_per_word", False, 0.3),))]
    rows = quality.with_statistics(docs, keep=["doc_id"]).select("doc_id", "stats", quality.verdict(rules).alias("kept")).collect()
    for r in rows:
        s = r.stats.asDict()
        share = {n: s[a] / max(s[b], 1) for n, (a, b) in quality.SHARES.items()}
        bad = s["n_words"] < 10 or 100 * s["n_repeat_words"] > 20 * s["n_words"]
        bad |= any(all(share[n] >= at if above else share[n] < at for n, above, at in rule.conditions) for rule in rules)
        assert r.kept == (not bad)


def test_learned_rules_find_planted_thresholds():
    rng = np.random.default_rng(2)
    values = {s: rng.random(4000) for s in quality.SHARES}
    bad = ((values["symbols_per_word"] > 0.8) | ((values["upper_per_letter"] > 0.7) & (values["chars_per_word"] < 0.5)))
    rules = quality.learn(values, bad, np.arange(4000) % 3 == 2)
    fresh = {s: rng.random(4000) for s in quality.SHARES}
    truth = (fresh["symbols_per_word"] > 0.8) | ((fresh["upper_per_letter"] > 0.7) & (fresh["chars_per_word"] < 0.5))
    said = np.any([r.covers(fresh) for r in rules], axis=0)
    assert (said == truth).mean() > 0.97 and all(len(r.conditions) <= quality.CONDITIONS for r in rules)


def test_no_labels_leave_the_base_checks(spark, clashing, corpus, nothing):
    labels = spark.createDataFrame([(None, 0), (3, None)], "doc_id bigint, quality int")
    kept = quality.kept_documents(clashing, labels)
    assert kept.columns == clashing.columns
    want = [r[0] for r in corpus if (s := quality.statistics(r[1]))[0] >= 10 and 100 * s[4] <= 20 * s[0]]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, want))
    assert quality.kept_documents(nothing, labels).count() == 0


def test_held_out_labels(spark):
    """Rules from labels of even ids judge the odd ones."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    stats = quality.with_statistics(docs.join(labels, "doc_id"), keep=["doc_id", "quality"]).cache()
    rules = quality.learned_rules(stats, labels.where("doc_id % 2 = 0"))
    judged = stats.where("doc_id % 2 = 1").select("quality", quality.base_failed().alias("base"), quality.verdict(rules).alias("kept")).where("not base").toPandas()
    good, bad = judged[judged.quality == 1], judged[judged.quality == 0]
    assert good.kept.mean() > 0.99 and bad.kept.mean() < 0.1


def test_query(spark, big):
    rows = quality.op4_quality_rules(spark, big).collect()
    texts = dict(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text").collect())
    assert len(rows) == len(texts)
    for r in rows:
        words, chars, symbols, twice, repeats = plain_base(texts[r.doc_id]) if len(texts[r.doc_id]) < 4000 else [*r[1:6]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (words, chars, symbols, twice) and repeats in (None, r.n_repeat_words)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
