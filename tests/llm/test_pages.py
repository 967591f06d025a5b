import random
import re
import time
from html import unescape

import pytest

from ebbtide.llm import pages

PLAIN = pages.Weights({}, {})
BODY = "<h1>A title here</h1><p>First <b>bo</b>ld words &amp; more&nbsp;words\n in  a block.</p><p>Second paragraph, it is long enough to count.<br>Line.</p>"
TEXT = "A title here First bold words & more words in a block. Second paragraph, it is long enough to count. Line."
AROUND = (
    "<!DOCTYPE html><html><head><title>A title</title><style>p{x:'</p>'}</style><script>var a='<p>no</p>';</script></head><body>"
    "<header><a href='/'>Site name and a long claim about it</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>"
    "<div class='cookie-notice'>We use cookies, please agree to all of them.</div>"
    "{}<aside>Related things you may want to read</aside><section id=comments><p>Great article, thank you very much indeed!</p></section>"
    "<form><label>Your mail</label><input name=q><button>Send it</button></form><footer>&copy; all rights reserved by somebody</footer></body></html>"
)


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<div role=main>{}</div>", "<div class='content'>{}</div>", "{}", "<ARTICLE>{}"])
def test_surroundings_are_left_out(wrap):
    assert pages.main_text(AROUND.replace("{}", wrap.format(BODY)), PLAIN) == TEXT


def test_parts_inside_the_text_are_left_out():
    inside = BODY.replace("<p>Second", "<div class='ad banner'>Buy this now, it is so cheap today only!</div><!-- <p>hidden</p> --><p>Second")
    for wrap in ("<article>{}</article>", "<main><nav>In this article</nav>{}<div class=comments>Nice</div></main>"):
        assert pages.main_text(AROUND.replace("{}", wrap.format(inside)), PLAIN) == TEXT


@pytest.mark.parametrize("html", [None, "", "  \n", "<html></html>", "<nav>menu only</nav>", "<script>", "<!-- open", "<p></p>"])
def test_pages_without_text(html):
    assert pages.main_text(html, PLAIN) == ""


def test_broken_markup():
    assert pages.main_text("a < b and <p>c > d", PLAIN) == "a < b and c > d"
    assert pages.main_text("<p>one<p>two</b></div>three</p>", PLAIN) == "one two three"
    assert pages.main_text("<article><p>x" + " word" * 200_000, PLAIN) == "x" + " word" * 200_000


def test_weights_come_from_marked_pages(spark):
    html = "<body><div class='zone9'>" + "teaser words " * 9 + "</div><article class=story><p>" + "text words " * 40 + "</p></article></body>"
    df = spark.createDataFrame([(i, "u", html) for i in range(20)] + [(99, None, None)], "page_id bigint, url string, html string")
    weights = pages.learned_weights(df)
    assert weights.names[".zone9"] < -1 < weights.names[".story"] and weights.tags["div"] < weights.tags["p"] < 0
    unmarked = "<div class='zone9'>" + "teaser words " * 9 + "</div><p>" + "text words " * 9 + "</p>"
    assert pages.main_text(unmarked, weights) == ("text words " * 9).strip()


def test_table(spark):
    rows = [(1, "u", AROUND.replace("{}", f"<article>{BODY}</article>"), 5), (1, "u", AROUND.replace("{}", f"<article>{BODY}</article>"), 5), (None, None, None, 6)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = pages.main_texts(df, pages.learned_weights(df)).collect()
    assert sorted(map(tuple, got), key=str) == [(1, "u", TEXT), (1, "u", TEXT), (None, None, "")]
    empty = df.limit(0)
    assert pages.main_texts(empty, pages.learned_weights(empty)).count() == 0


def test_query_finds_the_articles(spark, big):
    found = {r.page_id: r for r in pages.op9_html(spark, big).collect()}
    rows = spark.read.parquet(f"{big}/pages.parquet").collect()
    assert len(rows) == len(found)
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = " ".join(unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())
        assert found[r.page_id].text == want and found[r.page_id].n_chars == len(want)


STORY = "<h1>A head line</h1>" + "<p>" + "some words of the story here. " * 5 + "</p>"


@pytest.mark.parametrize("wrap", [
    "<body class='no-sidebar'>{}</body>", "<body class='has-header single-post'>{}</body>", "<div class='article share-ready'>{}</div>",
    "<main class='main has-sidebar'>{}</main>", "<article class='post search-hit'>{}</article>", "<body class='logged-in cookie-ok'>{}</body>",
    "<body class='sidebar-right'>{}</body>", "<div class=widget>{}</div>", "<div data-class=sidebar>{}</div>",
])
def test_names_that_only_mention_boilerplate_lose_nothing(wrap):
    assert pages.main_text(wrap.format(STORY), PLAIN) == pages.main_text(STORY, PLAIN) == "A head line " + ("some words of the story here. " * 5).strip()


@pytest.mark.parametrize("name", ["sidebar", "cookie-notice", "site-header", "comments_area", "widget-2", "ad banner"])
def test_names_that_are_boilerplate_are_left_out(name):
    assert pages.main_text(f"<body>{STORY}<div class='{name}'><p>Other words that nobody wants</p></div></body>", PLAIN) == pages.main_text(STORY, PLAIN)


def test_headline_in_the_header_of_an_article():
    page = "<header><h1>Site</h1></header><article><header><h1>The headline</h1><p>by somebody</p></header><p>Text follows here.</p></article>"
    assert pages.main_text(page, PLAIN) == "The headline Text follows here."


def test_a_frame_with_most_words_does_not_erase_the_page():
    weights = pages.Weights({".frame": -3.0, ".story": 0.5, ".teaser": -3.0}, {})
    assert pages.main_text(f"<div class=frame>{STORY}</div>", weights) == pages.main_text(STORY, PLAIN)
    assert pages.main_text(f"<div class=frame><div class=story>{STORY}</div><div class=teaser>Read this too</div></div>", weights) == pages.main_text(STORY, PLAIN)
    assert pages.main_text("<div class=cookie-notice>We use cookies, please agree</div>", weights) == ""


@pytest.mark.parametrize("piece", ["<a x=\"1\" ", "<div>", "<! ", "</script ", "<a \"<a\" ", "<a x=\"<a x=\"", "<a ='", "<p class='q w e'>", "</", "<!--", "= ", "<script>"])
def test_broken_markup_takes_linear_time(piece):
    start = time.monotonic()
    pages.main_text("<div><b>" + piece * (1_000_000 // len(piece)) + "</i>" * 1000, PLAIN)
    assert time.monotonic() - start < 30


def random_page(rng):
    def block(depth):
        if depth == 0 or rng.random() < 0.3:
            return "word " * rng.randint(0, 9)
        tag = rng.choice(("div", "p", "ul", "section", "nav", "b"))
        name = rng.choice(("", " class=teaser", " class='story lead'", " id=sidebar", " class=frame"))
        return f"<{tag}{name}>" + "".join(block(depth - 1) for _ in range(rng.randint(0, 4))) + f"</{tag}>"

    return "".join(block(4) for _ in range(3))


def test_the_region_is_the_best_of_all_regions():
    """Every stretch of every unmarked page is summed up; none has more than the one found."""
    rng = random.Random(5)
    weights = pages.Weights({".teaser": -1.5, ".story": 0.4, ".frame": -0.3}, {"div": -0.4, "p": -0.1})
    found = 0
    for _ in range(150):
        rows = list(pages.parts(random_page(rng)))
        worth = weights.of_elements(pages.elements_of(rows), False, float("inf"))
        values = pages.row_values(rows, worth, weights)
        first, last = pages.best_region(values)
        best = max((sum(values[a:b]) for a in range(len(values)) for b in range(a + 1, len(values) + 1)), default=0.0)
        assert sum(values[first : last + 1]) == pytest.approx(max(best, 0.0))
        found += last >= first
    assert found > 50


def test_learned_names_are_counted_once_where_they_nest(spark):
    html = "<article class=story><div class=story><p>one two three</p></div></article><div class='frame story'>four</div>"
    df = spark.createDataFrame([(html,)], "html string")
    got = {(r.kind, r.name): (r.inside, r.outside) for r in pages.page_counts(df).collect()}
    assert got["word", ".story"] == (3, 1) and got["word", ".frame"] == (0, 1)
