from ebbtide.llm import pages


def test_rare_names_count_among_many(spark, big):
    """Five thousand names that are on more pages than the one that decides; and the join gives what the weights sent give."""
    many = "".join(f"<i class='q{i}'>x</i>" for i in range(5000))
    learn = "<body><div class='zone9'>" + "teaser words " * 9 + "</div><article><p>" + "text words " * 40 + "</p></article></body>"
    bare = "<div class='zone9'>" + "teaser words " * 9 + "</div><p>" + "text words " * 9 + "</p>"
    html = [learn] * 6 + ["<article>" + many + "</article>"] * 7 + [bare, bare, None]
    df = spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], "page_id bigint, url string, html string")
    joined = {r.page_id: r.text for r in pages.learned_main_texts(df).collect()}
    assert joined[13] == joined[14] == ("text words " * 9).strip() and joined[15] == ""
    assert joined == {r.page_id: r.text for r in pages.learned_main_texts(df, names=10_000).collect()}
    real = spark.read.parquet(f"{big}/pages.parquet").limit(100).cache()
    assert sorted(map(tuple, pages.learned_main_texts(real, names=0).collect())) == sorted(map(tuple, pages.learned_main_texts(real).collect()))
