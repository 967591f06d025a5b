import re
from collections import Counter

import numpy as np
import xxhash

from ebbtide.llm import near_duplicates as nd


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    votes = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        votes.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def plain_components(rows):
    """rows (id, fingerprint) -> component per row, by breadth-first search over all pairs."""
    marks = sorted({m for _, m in rows})
    ids = {}
    for i, m in rows:
        ids.setdefault(m, []).append(i)
    left, out = set(marks), {}
    while left:
        todo, group = [left.pop()], []
        while todo:
            m = todo.pop()
            group.append(m)
            near = {x for x in left if (x ^ m).bit_count() <= 4}
            left -= near
            todo += near
        least = min((i for m in group for i in ids[m] if i is not None), default=None)
        out.update(dict.fromkeys(group, least))
    return [(i, m, out[m]) for i, m in rows]


def test_triples_meet_every_four_places():
    from itertools import combinations

    triples = nd.place_triples()
    assert len(triples) == 20
    assert all(any(set(t) <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_against_all_pairs(docs, corpus):
    got = sorted((r.id is None, r.id, r.fingerprint % (1 << 64), r.component_id) for r in nd.near_duplicates(docs).collect())
    want = plain_components([(r[0], plain_fingerprint(r[1])) for r in corpus])
    assert got == sorted((i is None, i, m, c) for i, m, c in want)


def test_query_over_the_whole_table(spark, big):
    rows = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text").collect()
    want = plain_components([(r[0], plain_fingerprint(r[1])) for r in rows])
    got = [tuple(r) for r in nd.op1_simhash(spark, big).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(got) == sorted((i, f"{m:016x}", c) for i, m, c in want)


def test_chains_and_blocks_of_all_sizes(spark):
    rng = np.random.default_rng(5)
    marks = set()
    for _ in range(6):
        m = int(rng.integers(0, 1 << 63))
        for _ in range(60):  # a walk: neighbours are near, its ends far from each other
            marks.add(m)
            for b in rng.integers(0, 63, 3):
                m ^= 1 << int(b)
    marks |= {int(x) for x in rng.integers(0, 1 << 63, 200)}
    want = {m: c for _, m, c in plain_components([(m, m) for m in marks])}
    df = spark.createDataFrame([(m,) for m in marks], "fingerprint bigint")
    for block in (3, 2048):
        got = {r.fingerprint: r.label for r in nd.fingerprint_components(df, block).collect()}
        groups = Counter((got[m], want[m]) for m in marks)
        assert len(groups) == len(set(got.values())) == len(set(want.values()))


def test_one_per_group(docs, corpus, clashing):
    found = plain_components([(r[0], plain_fingerprint(r[1])) for r in corpus])
    want = sorted({i for i, _, c in found if i is not None and i == c})
    kept = nd.one_per_group(clashing).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == want
    assert [r.text for r in kept if r.doc_id is None] == ["no id here at all"]
    assert kept[0].asDict().keys() == clashing.first().asDict().keys()


def test_empty_table(nothing):
    assert nd.near_duplicates(nothing).count() == 0
    assert nd.one_per_group(nothing).count() == 0


def test_one_hash_decides_a_short_text():
    assert nd.simhash(b"One two") == xxhash.xxh64_intdigest(b"one two", seed=42)
    assert nd.simhash(b" \n") == 0
