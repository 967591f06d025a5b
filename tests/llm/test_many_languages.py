import random

from ebbtide.llm import languages


def test_every_declared_language_has_a_model(spark):
    """Seventy languages with words of their own, the last two on three rows and on one."""
    rng, rows = random.Random(6), []
    for i in range(70):
        code = f"{chr(97 + i // 26)}{chr(97 + i % 26)}"
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 7))) for _ in range(12)]
        rows += [(len(rows) + k, " ".join(rng.choices(words, k=25)), code, "plain") for k in range({68: 3, 69: 1}.get(i, 6))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    kept = {r.doc_id: r.lang for r in languages.kept_documents(df).collect()}
    assert kept == {i: code for i, _, code, _ in rows}


def test_a_thin_declaration_saves_a_row_from_rejection(spark):
    """One short text of a language that is declared once, among many of another on its host."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["the", "with", "that", "thing", "other"], k=200)), "en", "https://a.com") for i in range(60)]
    df = spark.createDataFrame([*rows, (100, "qv", "xal", "https://a.com"), (101, "", "xal", "https://a.com")], "doc_id bigint, text string, lang string, source string")
    found = {r.doc_id: r.found for r in languages.identified(df, keep=["doc_id"]).collect()}
    assert found[100].kept and not found[101].kept
