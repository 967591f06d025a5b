import random
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from ebbtide.llm import near_duplicates as nd
from ebbtide.llm import similar_documents as sd


def plain_sets(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(rows):
    """Rows (id, text): the smallest id of each group, comparing all pairs that share a shingle."""
    sets, lists, top = [plain_sets(t) for _, t in rows], defaultdict(list), list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for k, s in enumerate(sets):
        shared = Counter(o for x in s or {""} for o in lists[x])
        for o, n in shared.items():
            if not s or n / (len(s) + len(sets[o]) - n) >= 0.8:
                top[find(k)] = find(o)
        for x in s or {""}:
            lists[x].append(k)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        groups[find(k)].append(i)
    return sorted(min((i for i in g if i is not None), default=-1) for g in groups.values())


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.randrange(1 << 30)}"
    return " ".join(words)


def test_edited_copies_leave_the_pipeline(spark):
    """Copies at similarity 0.8 to 0.95, which fingerprints four bits apart mostly miss."""
    rng, rows = random.Random(3), []
    for i in range(150):
        words = [f"w{rng.randrange(40_000)}" for _ in range(200)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, edited(rng, words, 1 + i % 4))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, df, "").collect())
    assert got == plain_groups(rows) and len(got) < 160
    assert nd.one_per_group(df).count() > 200


def test_against_all_pairs(clashing, corpus):
    kept = sd.one_per_similar_group(clashing).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept) == plain_groups([(r[0], r[1]) for r in corpus])
    assert [r.text for r in kept if r.doc_id is None] == ["no id here at all"]
    assert kept[0].asDict().keys() == clashing.first().asDict().keys()


def test_no_pair_at_the_limit_is_lost(spark):
    """Pairs at similarity 0.8 that agree in no run of six places, which is one in 1,500."""
    rng, rows = random.Random(14), []
    while len(rows) < 6:
        words = [f"w{rng.randrange(1 << 40)}" for _ in range(184)]
        other = list(words)
        for at in (20, 60, 100, 140):
            other[at + rng.randrange(20)] = f"new{rng.randrange(1 << 40)}"
        pair = [" ".join(words), " ".join(other)]
        a, b = (np.frombuffer(sd.places(sd.shingles(t.encode())), np.uint8) for t in pair)
        if not (a == b).reshape(24, 6).all(axis=1).any():
            rows += [(len(rows) + i, t) for i, t in enumerate(pair)]
    got = sd.one_per_similar_group(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.doc_id for r in got) == plain_groups(rows) == [0, 2, 4]


def test_whole_table(spark, big):
    df = spark.read.parquet(f"{big}/documents.parquet")
    assert sorted(r.doc_id for r in sd.one_per_similar_group(df).collect()) == plain_groups([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_chains_in_blocks(spark):
    """Each text is similar to the next alone; lists are cut into blocks of three."""
    rng = random.Random(8)
    words, rows = [f"c{i}" for i in range(300)], []
    for i in range(40):
        rows.append((i, " ".join(words)))
        words = edited(rng, words, 3).split()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = sd.wide_fingerprints(df, "doc_id", "text").cache()
    labels = {block: [r.label for r in sd.similar_components(marks, df, "text", block=block).collect()] for block in (3, 2048)}
    assert len(set(labels[3])) == len(set(labels[2048])) == len(plain_groups(rows))


def test_empty_table(nothing):
    assert sd.one_per_similar_group(nothing).count() == 0


def test_a_large_group_of_near_copies(spark):
    """Links found against exact pairs, and what leaves the blocks is at most a row for each row that enters."""
    rng = random.Random(21)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, edited(rng, base, rng.choice((0, 1, 1, 2, 2, 3)))) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want, got = plain_groups(rows), [r.doc_id for r in sd.one_per_similar_group(df).collect()]
    # A link missed leaves a document too many; one too many would lose one.
    assert set(want) <= set(got) and len(rows) - len(got) >= 0.97 * (len(rows) - len(want))


def test_rows_that_repeat_an_id(spark):
    other = "nothing of this is like the first text at all"
    rows = [(1, "one text of seven words or so"), (1, other), (1, other), (2, "one text of seven words or so"), (None, other)]
    for _ in range(2):
        got = sd.one_per_similar_group(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        assert sorted(tuple(r) for r in got) == [(1, other), (1, rows[0][1])]
