import hashlib

from pyspark.sql import functions as F

from ebbtide.llm import digests


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode()))
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    # Equal ids in rising order of their texts.
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, (r[1] or "").encode()))
    out = []
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        text, following = text or "", following or ""
        changed = digests.edited(text, following).encode()
        a, b = digests.digest(text.encode()), digests.digest(changed)
        out.append((i, len(text), hashlib.sha256(changed).hexdigest(), a, b, digests.likeness(a, b), digests.likeness(a, digests.digest(following.encode()))))
    return sorted(out, key=str)


def test_against_plain_code(clashing, corpus, spark):
    assert sorted(map(tuple, digests.edited_digests(clashing).collect()), key=str) == plain([(r[0], r[1]) for r in corpus])
    one = spark.createDataFrame([(7, "alone")], "doc_id bigint, text string")
    assert [tuple(r) for r in digests.edited_digests(one).collect()] == plain([(7, "alone")])


def test_edit():
    assert digests.edited("abcdefg", "XYZ") == "abcdeXY" and digests.edited("abcdef", "X") == "abcdX"
    assert digests.edited("", "x") == "" and digests.edited("ab", "x") == "ab" and digests.edited("😀é語", "ab") == "😀éa"


def test_likeness_is_a_share():
    marks = [digests.digest(t) for t in (b"", b"a", b"some words here", b"some words there", b"\xff" * 5000)]
    for a in marks:
        assert digests.likeness(a, a) == 1
        assert all(0 <= digests.likeness(a, b) <= 1 and digests.likeness(a, b) == digests.likeness(b, a) for b in marks)


def test_empty(nothing):
    assert digests.edited_digests(nothing).count() == 0


def test_query(spark, big):
    rows = [tuple(r) for r in spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text").collect()]
    found = digests.op5_digests(spark, big).cache()
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows)
    near = found.where("n_chars > 300").agg(F.avg("near_edited"), F.avg("near_next"), F.avg((F.col("near_edited") > F.col("near_next")).cast("int"))).first()
    assert near[0] > near[1] + 0.05 and near[2] > 0.95
