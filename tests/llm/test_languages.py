import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.llm import languages

STEMS = {"en": ["the", "with", "that", "thing", "other", "which"], "de": ["der", "und", "nicht", "schön", "über", "zeit"], "fr": ["les", "avec", "être", "qui", "eaux", "très"]}


def text(rng, lang, n):
    return " ".join(rng.choice(STEMS[lang]) + rng.choice(["", *STEMS[lang]]) for _ in range(n))


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(4)
    rows = [(i, text(rng, lang, 30), lang, f"https://www.site{lang}.{lang if lang != 'en' else 'com'}/x{i}") for i in range(150) for lang in [rng.choice(list(STEMS))]]
    rows += [
        (900, text(rng, "fr", 40), "en", "https://www.sitefr.fr/y"), (901, None, "de", "https://a.de/"), (902, "12 34 !!", "fr", None), (903, "", None, None),
        (904, text(rng, "de", 20), None, None), (905, "шш жж щщ юю " * 20, None, "https://b.org"), (906, text(rng, "en", 5000), "en-GB", "plain"),
        (907, "x", "EN_us", "https://c.com:80/?lang=de"), (None, text(rng, "en", 20), "en", "https://d.com"), (None, text(rng, "en", 20), "en", "https://d.com"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


def test_text_outweighs_a_wrong_declaration(mixed):
    names = ("evidence", "said", "host", "domain", "suffix", "posterior", "prior", "found", "n", "likely")
    found = {r.doc_id: r.found for r in languages.identified(mixed.withColumns({n: F.lit(1) for n in names}), keep=["doc_id"]).collect()}
    truth = {r.doc_id: r.lang for r in mixed.where("doc_id < 900").collect()}
    assert all(found[i].language == lang and found[i].kept for i, lang in truth.items())
    assert (found[900].language, found[900].kept) == ("fr", True) and (found[904].language, found[906].language) == ("de", "en")
    assert not any(found[i].kept for i in (901, 902, 903, 905)) and found[905].language == "und"
    assert (found[901].language, found[902].language) == ("de", "fr") and found[901].text_language is None


def test_host_prior_decides_when_nothing_else_does(spark, mixed):
    bare = spark.createDataFrame([(1000 + i, None, None, u) for i, u in enumerate(["https://www.sitede.de/q", "https://new.sitefr.fr/", "https://other.de/"])], mixed.schema)
    found = {r.doc_id: r.found for r in languages.identified(mixed.union(bare), keep=["doc_id"]).collect()}
    assert found[1000].language == "de"
    assert found[1001].confidence < found[1000].confidence + 0.2


def test_hosts(spark):
    rows = [("https://A.b.co.uk:8/x?y=//z",), ("http://u@h.de#q",), ("src1",), ("",), (None,)]
    host, domain, suffix = languages._hosts(F.col("a"))
    got = [tuple(r) for r in spark.createDataFrame(rows, "a string").select(host, domain, suffix).collect()]
    assert got[:3] == [("a.b.co.uk", "co.uk", "uk"), ("h.de", "h.de", "de"), ("src1", "src1", "")]


def test_triplets():
    assert languages.triplet_counts(b"").sum() == 0 and languages.triplet_counts(b" 1 !").sum() == 0
    assert np.array_equal(languages.triplet_counts(b"Ab  c,"), languages.triplet_counts(b"ab c"))
    assert languages.triplet_counts(b"abc").sum() == 3


def test_kept_documents(mixed, nothing):
    kept = languages.kept_documents(mixed.withColumn("n_chars", F.length("text")))
    assert kept.columns == [*mixed.columns, "n_chars"]
    rows = kept.collect()
    assert [r.lang for r in rows if r.doc_id == 900] == ["fr"] and sum(r.doc_id is None for r in rows) == 2
    assert languages.kept_documents(nothing).count() == 0


def test_no_declarations(spark):
    df = spark.createDataFrame([(1, "some words", None, "a"), (2, None, None, None)], "doc_id bigint, text string, lang string, source string")
    assert {r.found.kept for r in languages.identified(df).collect()} == {False}


def test_queries(spark, big):
    docs = languages.op8_language(spark, big)
    assert docs.where("declared = language and kept").count() >= 0.99 * docs.count() == 0.99 * spark.read.parquet(f"{big}/documents.parquet").count()
    found = languages.language_of_pages(spark, big)
    assert found.where("declared = language").count() >= 0.98 * found.count()
