import hashlib
from collections import defaultdict

import numpy as np
import pytest

from ebbtide.llm import exact_duplicates as ed

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    """(id, keep_id, size, sha) of every row and the number of rows kept a text."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str), len(groups)


@pytest.mark.parametrize("count", [0, 1, 2, 1000])
@pytest.mark.parametrize("top", [1 << 3, 1 << 20, (1 << 64) - 1])
def test_golomb_round_trip(count, top):
    rng = np.random.default_rng(count)
    base = min(5, top)
    values = np.unique(rng.integers(base, top, min(count, top // 2), np.uint64, endpoint=True))
    data = ed.golomb_encode(values, base)
    assert ed.golomb_decode(data, base).tolist() == values.tolist()
    if count == 1000 and top == 1 << 20:
        assert len(data) < 1000 * 12.5 / 8 + 16  # log2 of the mean gap and about one and a half bits


@pytest.mark.parametrize("spare, owned", [(ed.SPARE_BITS, ed.OWNED), (ed.SPARE_BITS, 16), (0, 16), (-4, 7)])
def test_against_plain_groups(clashing, corpus, spare, owned):
    """Also with several owners, and with fingerprints so short that most rows are suspects for nothing."""
    rows = [(r[0], r[1]) for r in corpus]
    rows_in = clashing.unionByName(clashing.limit(1).selectExpr(*[
        "500L as doc_id" if c == "doc_id" else "'ÄÖ Shared TEXT' as text" if c == "text" else c for c in clashing.columns])).unionByName(
        clashing.limit(1).selectExpr(*["501L as doc_id" if c == "doc_id" else "'ÄÖ shared text' as text" if c == "text" else c for c in clashing.columns]))
    want, groups = plain([*rows, (500, "ÄÖ Shared TEXT"), (501, "ÄÖ shared text")])
    got = ed.duplicate_groups(rows_in, spare_bits=spare, owned=owned).collect()
    assert sorted(((r.id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == groups == len({r.text_sha256 for r in kept}) and all(r.id == r.keep_id for r in kept)


def test_rows_that_stay_keep_their_columns(clashing, corpus):
    got = ed.without_copies(clashing, owned=32)
    assert got.dtypes == clashing.dtypes
    rows, (want, groups) = got.collect(), plain([(r[0], r[1]) for r in corpus])
    assert len(rows) == groups and {(r.text or "").translate(LOWER) for r in rows} == {(r[1] or "").translate(LOWER) for r in corpus}
    assert {r.doc_id for r in rows} == {k for _, k, _, _ in want}


def test_texts_do_not_travel_but_suspects(docs):
    """The bucketed table is read by block without an exchange."""
    rows = ed._written(docs, "doc_id", "text", False)
    plan = rows.groupBy("block").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_no_rows_and_nulls_alone(nothing, spark):
    assert ed.duplicate_groups(nothing).count() == 0 and ed.without_copies(nothing).count() == 0
    nulls = spark.createDataFrame([(None, None)] * 3 + [(None, "")], "doc_id bigint, text string")
    got = ed.duplicate_groups(nulls).collect()
    assert [(r.keep_id, r.group_size) for r in got] == [(None, 4)] * 4 and sum(r.kept for r in got) == 1


def test_query(spark, big):
    from ebbtide.llm.common import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_exact_duplicates"](spark, big).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == plain(rows)[0]
    assert sum(r.kept for r in got) == plain(rows)[1] and all(r.kept == (r.doc_id == r.keep_id) for r in got)
