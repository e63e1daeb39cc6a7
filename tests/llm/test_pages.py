"""Main text of pages of several layouts."""

import html
import re
import time

import pytest

from stampmill.llm.pages import extract, main_text
from stampmill.llm.tables import table


def test_given_pages(spark, sf):
    pages = table(spark, sf, "pages")
    got = {r["page_id"]: r["text"] for r in extract(pages).collect()}
    for r in pages.collect():
        inside = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        inside = re.sub("<[^>]*>", "", re.sub("</?(p|h1|br)[^>]*>", " ", inside))
        assert got[r["page_id"]] == " ".join(html.unescape(inside).split())


LONG = "Long text, with commas, and more. Really long text here, so it counts."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), (" \n ", ""), ("plain text only", "plain text only"), ("a < b & c &lt; d", "a < b & c < d"),
        (f'<body><header class=site><h1>Site</h1></header><div id="menu"><a href=x>a</a></div><div class="post"><h2>Head &amp; line</h2><p>{LONG}</p><ul><li>one<li>two</ul></div><div class="comments"><p>{LONG} {LONG}</p></div><footer>foot</footer>', f"Head & line {LONG} one two"),
        (f"<main><header><h1>Title</h1></header><p>{LONG}<form><input value='x'>send</form><section class='user-comments'>no</section><p>x&nbsp;y<!-- z --></main>", f"Title {LONG} x y"),
        (f"<body><p>{LONG}</p><div class='cookie-notice'>We use cookies, ok.</div><script>if (a<b) '<p>'</script><style>p{{}}</style></body>", LONG),
        (f"<article><p>one <b>bold<i>er</i></b>word<br>next</p><p hidden>{LONG}</p><aside>{LONG}</aside><p>last</p></article>", "one bolderword next last"),
        ("<script>" * 3, ""), ("<p>unclosed <b>bold<p>next", "unclosed bold next"),
        ('<article><p title="a > b" data-x=\'<p>\'>q</p></article>', "q"),
    ],
)
def test_layouts(page, text):
    assert main_text(page) == text


def test_given_pages_without_article_elements(spark, sf):
    """The ratios find the article where no element names it."""
    right = total = 0
    for r in table(spark, sf, "pages").collect():
        want = main_text(r["html"])
        bare = r["html"].replace("<article>", "<div class='x1'>").replace("</article>", "</div>")
        right, total = right + (main_text(bare) == want), total + 1
        loose = r["html"].replace("<article>", "").replace("</article>", "")
        assert set(main_text(loose).split()) <= set(want.split()) | set(re.findall("[^<>\\s]+", re.sub("<footer>.*|<div.*?</div>", "", loose)))
    assert right >= 0.95 * total


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<body><div class=content><section id=a><p>{LONG} {LONG}</p></section><section id=b><h2>Two</h2><p>{LONG}</p></section></div><div class=x><a href=y>link</a></div>', f"{LONG} {LONG} Two {LONG}"),
        (f'<div class=content>Lead. {LONG}<div><p>{LONG}</p><p>{LONG}</p></div></div>', f"Lead. {LONG} {LONG} {LONG}"),
        (f'<div class="content has-sidebar"><p>{LONG}</p><p>{LONG}</p></div><div class=sidebar>{LONG}</div>', f"{LONG} {LONG}"),
        (f'<div class="sidebar-wrap"><article><p>{LONG}</p></article></div><div class=sidebar>{LONG}</div>', LONG),
        (f'<article class=one><p>{LONG}</p></article><article class=two><h2>Next</h2><p>{LONG}</p></article>', f"{LONG} Next {LONG}"),
        (f'<div class=widget><p>{LONG}</p><p>{LONG}</p></div><p>foot</p>', f"{LONG} {LONG} foot"),
        (f'<div class=post><p>{LONG}</p></div><div class=comments><p>{LONG} {LONG}</p><p>{LONG} {LONG}</p></div>', LONG),
    ],
)
def test_without_one_article(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    "page",
    [
        "<script " * 125_000, "<script " * 125_000 + ">", "<a '" * 250_000, "<a \"x>" * 150_000, "<div>" * 200_000 + LONG, "</b></x>" * 125_000, "<div class=sidebar>" * 50_000 + LONG,
        "<![CDATA[" * 110_000, "<!--" * 250_000, "<!" * 500_000, "<li><dd><td>" * 80_000, "<p>x" * 250_000, "<textarea>" * 100_000,
    ],
)
def test_long_pages_take_linear_time(page):
    began = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - began < 15
    main_text(f"<article>{page}")


def test_long_and_broken_pages():
    assert len(main_text("<p>" + "word " * 200_000)) == 999_999
    assert main_text("<" * 5000 + "x") == "<" * 5000 + "x"
    assert main_text("<div>" * 3000 + LONG + "</div>" * 3000) == LONG


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>é</p>", "x"), (1, "u", "<p>é</p>", "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in extract(pages).collect()) == [(0, "", 0), (1, "é", 1), (1, "é", 1)]
    assert extract(pages.limit(0)).count() == 0
