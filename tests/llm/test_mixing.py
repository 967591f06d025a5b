import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from ebbtide.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2.0):
    """Share out by weight, cap, share the excess out again, until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > epochs * sizes[s]}
        if not above:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: epochs * sizes[s] for s in above}
        left -= sum(epochs * sizes[s] for s in above)
        open_ -= above
    return out


def plain_mix(rows):
    sized, seen = [], {}
    for i, t, s in rows:
        key = hashlib.md5("|".join(x for x in (None if i is None else str(i), t) if x is not None).encode()).hexdigest()
        copy = seen[i, t, s] = seen.get((i, t, s), -1) + 1
        sized.append((i, s, key, len(WORD.findall(t or "")), hashlib.md5(f"{key}#{copy}".encode()).hexdigest() if copy else key))
    sizes = {}
    for _, s, _, n, _ in sized:
        sizes[s] = sizes.get(s, 0) + n
    targets, out = plain_targets(sizes), []
    for s in sizes:
        budget = math.floor(targets[s] + 0.5)
        whole = budget // sizes[s] if sizes[s] else 0
        left = budget - whole * sizes[s]
        for i, _, key, n, _ in sorted((r for r in sized if r[1] == s), key=lambda r: (r[4], r[0] is not None, r[0] or 0)):
            part = min(n, max(0, left))
            left -= part
            out.append((key, s, n, sizes[s], targets[s], whole * n + part))
    return sorted(out, key=str)


def test_against_plain_code(clashing, corpus):
    want = plain_mix([(r[0], r[1], r[3]) for r in corpus])
    for per_range in (3, 65_536):
        found = mixing.mix(clashing, per_range=per_range).select("key", "source", "size", "source_size", "target", "taken").collect()
        got = sorted(map(tuple, found), key=str)
        assert [g[:4] + g[5:] for g in got] == [w[:4] + w[5:] for w in want]
        assert [g[4] for g in got] == pytest.approx([w[4] for w in want])


def test_budgets_are_met_and_nothing_taken_thrice(spark, big):
    rows = mixing.op2_mixing(spark, big).cache()
    assert rows.where("taken > 2 * size or taken < 0").count() == 0
    met = rows.groupBy("source_size", "target").agg(F.sum("taken").alias("taken"))
    assert met.where("abs(taken - target) > 1").count() == 0
    assert rows.agg(F.sum("taken") / F.sum("size")).first()[0] == pytest.approx(1.5, abs=0.001)


def test_the_mix_itself(clashing, docs, corpus):
    taken = {}
    for key, _, _, _, _, n in plain_mix([(r[0], r[1], r[3]) for r in corpus]):
        taken[key] = taken.get(key, 0) + n
    found = mixing.mixed_documents(clashing)
    assert found.columns == clashing.columns
    got = {}
    for r in found.collect():
        whole = [c for c in corpus if c[0] == r.doc_id and c[1] is not None and c[1].startswith(r.text)]
        key = hashlib.md5("|".join(x for x in (None if r.doc_id is None else str(r.doc_id), whole[0][1]) if x is not None).encode()).hexdigest()
        got[key] = got.get(key, 0) + len(WORD.findall(r.text))
    assert got == {k: n for k, n in taken.items() if n}


def test_one_row_that_very_many_repeat(spark):
    """Copies under one id spread over the ranges, however the table is split, and are all counted."""
    from pyspark.sql import functions as F

    copies = [(5, "w " * 7, "s")] * 900 + [(i, f"one two {i}", "s") for i in range(10, 310)] + [(i, "x y z", "t") for i in range(900)]
    df = spark.createDataFrame(copies, "doc_id bigint, text string, source string")
    wide = mixing.mix(df.repartition(7), per_range=50)
    rows = sorted(tuple(r) for r in wide.select("id", "source", "size", "taken").collect())
    assert rows == sorted(tuple(r) for r in mixing.mix(df.coalesce(2), per_range=2_000).select("id", "source", "size", "taken").collect())
    want = plain_mix(copies)
    assert sorted((s, n, t) for _, s, n, _, _, t in want) == sorted((s, n, t) for _, s, n, t in rows)
    numbered = mixing._numbered(df.select(F.col("doc_id").cast("string").alias("ident"), F.lit("k").alias("key"), F.spark_partition_id().alias("place")))
    assert sorted(r["copy"] for r in numbered.where("ident = '5'").collect())[:900:899] == [0, 899]
    assert numbered.where("ident = '5'").select("copy").distinct().count() == 901


def test_rows_alike_but_for_nulls_and_sources_are_kept_apart(spark):
    rows = [(5, "x a b", "s1"), (None, "5|x a b", "s1"), (5, "x a b", "s2"), (None, "x a b", None)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, source string, __size bigint")
    taken = {}
    for r in mixing.mixed_documents(df.drop("__size")).collect():
        taken[r.doc_id, r.source] = taken.get((r.doc_id, r.source), 0) + len(WORD.findall(r.text))
    want = {}
    for r in mixing.mix(df).collect():
        want[r.id, r.source] = want.get((r.id, r.source), 0) + r.taken
    assert taken == {k: n for k, n in want.items() if n}


def test_targets_of_small_and_empty_sources(spark):
    sizes = {"a": 10, "b": 0, "é": 1000, "z": 50, None: 7}
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size bigint, docs bigint")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_nothing_to_mix(nothing, spark):
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0
    blank = spark.createDataFrame([(1, None, None, "x"), (2, " ", None, None)], "doc_id bigint, text string, lang string, source string")
    assert {r.taken for r in mixing.mix(blank).collect()} == {0} and mixing.mixed_documents(blank).count() == 0
