import hashlib
import random
import zlib

import numpy as np
import pytest

from ebbtide.llm import periodic_runs as pr
from ebbtide.llm.common import QUERIES


def plain_runs(words):
    """Every period tried on the whole text; of a stretch with several periods the smallest counts."""
    n, out = len(words), {}
    index = {}
    codes = np.array([index.setdefault(w, len(index)) for w in words], int)
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[False], codes[q:] == codes[:-q], [False]])
        for a, b in np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2).tolist():
            start, length = a, b - a + q
            if length >= max(6, 4 * q) and not any(s <= start and start + length <= s + m and q % p == 0 for s, m, p in out.values()):
                out[(start, q)] = (start, length, q)
    return sorted(out.values(), key=lambda r: (r[0], r[2]))


def plain_row(i, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (j - a) % p] for j in range(a, n)]
    runs = plain_runs(words)
    drop = {j for s, m, p in runs for j in range(s + p, s + m)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()), sha(b" ".join(w for j, w in enumerate(words) if j not in drop)))


def found(words):
    index = {}
    return pr.runs_of(np.array([index.setdefault(w, len(index)) for w in words], np.int64), np.array([0, len(words)]))[0]


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "abcdefgh"])
def test_short_texts_of_few_words(letters):
    rng = random.Random(len(letters))
    for _ in range(400):
        words = []
        while len(words) < rng.randint(0, 60):
            words += [rng.choice(letters) for _ in range(rng.randint(1, 9))] * rng.choice((1, 1, 2, 4, 5, 7))
        assert found(words) == plain_runs(words), words


def test_all_squares_come_from_the_automaton():
    """Longest stretches that end at some word with their smallest period, by trying all."""
    rng = random.Random(5)
    for _ in range(200):
        words = [rng.randrange(2) for _ in range(rng.randint(1, 40))]
        want = {}
        for q in range(1, len(words)):
            for end in range(2 * q - 1, len(words)):
                start = end - q + 1
                while start > 0 and words[start - 1] == words[start - 1 + q]:
                    start -= 1
                start = start if all(words[j] == words[j + q] for j in range(end - 2 * q + 1, end - q + 1)) else None
                if start is not None and not any(words[end - 2 * q + 1 : end + 1] == (words[end - p + 1 : end + 1] * (2 * q))[-2 * q :] for p in range(1, q) if q % p == 0):
                    want[(start, q)] = end
        assert pr.squares(words) == want


def test_long_periods_and_long_texts():
    rng = random.Random(6)
    words = [rng.randrange(500) for _ in range(30_000)]
    block = [rng.randrange(500) for _ in range(1111)]
    words[7000:7000 + 4 * 1111 + 3] = block * 4 + block[:3]
    words[20_000:20_300] = [1, 2, 3] * 100
    words[20_300:20_340] = [9] * 40
    runs = found(words)
    assert [r for r in runs if r[2] == 1111][0][0] <= 7000 and {r[2] for r in runs} >= {1, 3, 1111}
    assert found([0] * 200_000) == [(0, 200_000, 1)]
    assert runs == plain_runs(words)


def test_many_texts_at_once(spark, clashing, corpus):
    rng = random.Random(9)
    more = [(1000 + i, " \n".join(w for w in [rng.choice("xyz") for _ in range(rng.randint(0, 30))] for _ in range(rng.choice((1, 5, 6))))) for i in range(300)]
    df = clashing.select("doc_id", "text", "id", "size").unionByName(spark.createDataFrame([(*r, 1, 1) for r in more], "doc_id bigint, text string, id int, size int"))
    got = {}
    for r in pr.periodic_runs(df).collect():
        got.setdefault(r.id, []).append(([tuple(x) for x in r.runs], r.collapsed))
    for i, text in [*[(r[0], r[1]) for r in corpus if len(r[1] or "") < 10_000], *more]:
        words = (text or "").encode().split()
        runs = plain_runs(words)
        drop = {j for s, m, p in runs for j in range(s + p, s + m)}
        assert (runs, b" ".join(w for j, w in enumerate(words) if j not in drop).decode()) in got[i]


def test_collapsed_texts_keep_their_rows(clashing, nothing):
    got = pr.without_repeats(clashing)
    assert got.columns == clashing.columns and got.where("text is null").count() == clashing.where("text is null").count()
    assert pr.without_repeats(nothing).count() == 0 and pr.periodic_runs(nothing).count() == 0


def test_query(spark, big):
    rows = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((plain_row(r.doc_id, r.text) for r in rows), key=str)
    got = QUERIES["op13_periodic_runs"](spark, big)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == want and sum(r[1] > 0 for r in want) > 50
