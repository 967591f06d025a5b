import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ebbtide.llm import spelling_variants as sv
from ebbtide.llm.common import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def plain_distance_one(a, b):
    """The usual table of edits."""
    if abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, left[j] + 1, left[j - 1] + (x != y)))
    return row[-1] == 1


def plain_near(words):
    """All pairs of words that share what is left after one deletion, compared."""
    left, near = defaultdict(set), defaultdict(set)
    for w in words:
        for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            left[k].add(w)
    for group in left.values():
        for a in group:
            near[a] |= {b for b in group if b not in near[a] and plain_distance_one(a, b)}
    return near


def plain_variants(words):
    near, form = plain_near(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def rows_of(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def made_up(seed, roots=60, letters="abcdefghilmnoprstuvyzéß×"):
    rng, words = random.Random(seed), {}
    for _ in range(roots):
        word, n = "".join(rng.choice(letters) for _ in range(rng.randint(7, 12))), 4000
        for _ in range(rng.randint(1, 5)):
            words[word] = max(words.get(word, 0), n)
            for _ in range(3):
                at, kind = rng.randrange(len(word)), rng.randrange(3)
                other = word[:at] + (rng.choice(letters) if kind else "") + word[at + (kind != 2) :]
                words.setdefault(other, rng.randint(2, 300))
            word, n = other, max(2, n // rng.choice((9, 10, 11, 30)))
    words |= {"a" * 300: 50, "a" * 299: 5, "a" * 301: 5, "a" * 299 + "b": 5, "aaaaaaa": 700, "aaaaaaab": 7, "aaaaaab": 70}
    return words


def test_words_one_edit_apart():
    rng = random.Random(2)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(120)] + ["b" * 70 + "a", "b" * 70, "b" * 71, "b" * 69 + "ab"]
    known = sv.Words([w.encode() for w in words])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    want = [plain_distance_one(words[i], words[j]) for i, j in zip(a, b)]
    assert known.near(a, b).tolist() == want
    assert [sv.one_edit(words[i].encode(), words[j].encode()) for i, j in zip(a, b)] == want


@pytest.mark.parametrize("shard", [3, 40, sv.SHARD])
def test_variants_of_made_up_words(spark, shard):
    """Shards named by one count and by six, and shards cut into blocks."""
    words = made_up(shard)
    df = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(4)
    want = plain_variants(words)
    assert rows_of(sv.variants(df, shard=shard)) == want
    depth = max(_chain(w, {r[0]: r[1] for r in want}) for w in words)
    assert depth >= 2


def _chain(word, forms):
    steps = 0
    while forms[word] is not None:
        word, steps = forms[word], steps + 1
    return steps


def test_search_spends_its_budget_exactly():
    rng = np.random.default_rng(4)
    counts, queries = rng.integers(0, 3, (300, sv.GROUPS)), rng.integers(0, 3, (50, sv.GROUPS))
    counts[:50] = queries + np.eye(sv.GROUPS, dtype=np.int64)[rng.integers(0, sv.GROUPS, 50)]
    zero = np.zeros(50, np.int64)
    got = {(int(q), int(m)) for rows, at in sv.Trie(counts, 0).search(queries, zero, zero) for q, m in zip(rows, at)}
    change = counts[None] - queries[:, None]
    want = np.argwhere((np.maximum(change, 0).sum(2) <= 1) & (np.maximum(-change, 0).sum(2) <= 1))
    assert got == {tuple(map(int, x)) for x in want} and len(got) >= 50


def test_texts(spark, clashing, corpus):
    more = [(900 + i, f"Rivière RIVIÈRE rivières Straßenbahn strassenbahn straße naïveté {'x' * 400} {'x' * 401} quietly quietly中quietly") for i in range(25)]
    df = clashing.select("doc_id", "text", "word", "id", "n_chars").unionByName(
        spark.createDataFrame([(i, t, 1, 1, 0) for i, t in more], "doc_id bigint, text string, word int, id int, n_chars bigint"))
    rows = [(r[0], r[1]) for r in corpus] + more
    assert rows_of(sv.spelling_variants(df, misread=sv.planted)) == plain_variants(plain_counts(rows))


def test_no_words(nothing, spark):
    assert rows_of(sv.spelling_variants(nothing)) == []
    df = spark.createDataFrame([(1, None), (2, ""), (None, "short words do not count")], "doc_id bigint, text string")
    assert rows_of(sv.spelling_variants(df)) == []


def test_query(spark, big):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op11_spelling_variants"](spark, big)) == plain_variants(plain_counts(rows))
