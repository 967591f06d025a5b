import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, words, stems=("the", "rain", "over", "hills", "quiet", "engine", "seven", "rivers", "under", "bright")):
    return " ".join(rng.choice(stems) + rng.choice(("", "s", "ing", "ed", "er", "ly", ",", ".")) for _ in range(words))


@pytest.fixture(scope="session")
def corpus():
    """Copies, near copies, empty, null, wordless, tied and very long texts."""
    rng = random.Random(7)
    base = [prose(rng, rng.randint(12, 120)) for _ in range(60)]
    rows = [(i, t, "en", f"src{i % 4}") for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "en", "src0") for i in range(20)]
    rows += [(200 + i, base[3] + f" tail{i}", "en", "src0") for i in range(30)]
    rows += [(300, None, "en", "src1"), (301, "", "en", None), (302, " \n\t ", None, "src1"), (303, "one two", "en", "src2")]
    rows += [(304, prose(rng, 30_000), "en", "src2"), (305, "Ünïcode wörds über straße 日本語 😀 x", "de", "src2")]
    rows += [(0, base[0], "en", "src0"), (None, base[5], "en", "src1"), (None, "no id here at all", "en", "src1")]
    return [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with further columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = ("id", "label", "fingerprint", "list", "length", "key", "size", "taken", "uid", "word", "u", "v", "_kept", "kept", "stats")
    return docs.withColumns({n: F.lit(1) for n in names})


@pytest.fixture(scope="session")
def big():
    return "/root/testdata/sf0.01"
