import html
import re
import time

import pytest

from tabsmith.llm.main_text import main_text, page_report

LONG = "A sentence of some length, with commas, that reads like the text of an article and goes on for a while. "


def article_of(page):
    """The article's blocks by patterns, for pages of the known layout."""
    inner = re.search("<article>(.*)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_pages_equal_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = page_report(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = {r.page_id: article_of(r.html) for r in pages.collect()}
    rows = got.collect()
    assert {r.page_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("no markup &amp; none\n needed", "no markup & none needed"),
        ("<p>one<p>two <b>bold<p>three</b> x", "one\ntwo bold\nthree x"),
        (f"<body><div id=menu><a href=/>Home, sweet, home, page</a></div><div class='story'><p>{LONG}</p><p>{LONG * 2}</p></div>"
         f"<div class=comments><p>{LONG * 9}</p></div></body>", f"{LONG.strip()}\n{(LONG * 2).strip()}"),
        (f"<main><h2>T</h2><div><section><p>{LONG}</section></div><aside><p>{LONG * 8}</aside><p>x</p></main>", f"T\n{LONG.strip()}\nx"),
        (f"<article><p>{LONG}</p><article class='comment'><p>{LONG * 5}</p></article><ul><li>a<li>b</ul><form><p>{LONG}</form></article>",
         f"{LONG.strip()}\na\nb"),
        ("<article><p>a&nbsp;&#8211;&lt;b&gt;<br/>c &unknown;</p><!-- <p>no</p> --><script>var x='</p><p>no';</script></article>",
         "a –<b> c &unknown;"),
        ("<article><p>x<style>p{}</style>y</p><pre> k  l\n m</pre><table><tr><td>1<td>2<tr><td>3</table></article>", "x y\nk l m\n1\n2\n3"),
        ("<ARTICLE><P CLASS=\"a>b\">Upper</P><p hidden>no</p><p style='display: none'>no</p>< 3 & 4 <", "Upper\n< 3 & 4 <"),
        ("<nav><p>only a menu</p></nav>", ""),
        ("<article></article><footer>f</footer>", ""),
        ("</p></div><article>stray <i>and</b> unclosed", "stray and unclosed"),
    ],
)
def test_cases(page, text):
    assert main_text(page) == text


def test_siblings_of_the_best_container_are_kept():
    page = f"<div><h3>Head</h3><div><p>{LONG * 4}</p></div><div><p>{LONG * 3}</p></div><div><a href=x>{LONG}</a></div></div>"
    assert main_text(f"<html><body><header>h</header><div>{page}</div></body></html>") == "\n".join(["Head", (LONG * 4).strip(), (LONG * 3).strip()])


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<main><article><p>{LONG}</p></article><div><p>Rest of it.</p></div></main>", f"{LONG.strip()}\nRest of it."),
        (f"<body><article><p>{LONG}</p></article><article><p>Second part.</p></article><div>Imprint</div></body>", f"{LONG.strip()}\nSecond part."),
        (f"<article><p>{LONG}</p><p class='form'>kept</p><div class='related-work'><p>kept too</p></div><div class='site-footer'>no</div></article>",
         f"{LONG.strip()}\nkept\nkept too"),
        (f"<div><div class='content'><p>{LONG * 3}</p></div><div class='content'><ul><li>a<li>b</ul></div></div>", f"{(LONG * 3).strip()}\na\nb"),
        (f"<article><p>{LONG}</p><p class='ad'>no</p><div class='comment-list'><p>{LONG * 3}</p></div></article>", LONG.strip()),
    ],
)
def test_articles_in_several_containers_and_odd_names(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("part", ["<a ", "<div ", "<x '", "<x \"", "<x ' <y \" ", "</script", "<script></script", "<p><i>", "</q>", "<div>", "<table><tr><td>", "<!--", "<![", "&"])
def test_broken_pages_of_a_megabyte_take_seconds(part):
    n = 1_000_000 // len(part)
    began = time.perf_counter()
    main_text("<article><p>" + LONG + part * n)
    main_text(part * n + f"<p>{LONG}</p>")
    assert time.perf_counter() - began < 40


def test_tags_without_an_end_are_text():
    assert main_text("<p>a <b 1") == "a <b 1"
    assert main_text("<p>a <x 'q> b <i>c</i>") == "a <x 'q> b c"


def test_long_and_deep_pages():
    n = 3000
    assert main_text("<div>" * 20_000 + f"<p>{LONG}</p>" + "</div>" * 20_000) == LONG.strip()
    assert main_text("<article>" + f"<p>{LONG}</p>" * n + "</article>") == "\n".join([LONG.strip()] * n)


def test_edge_rows(spark):
    rows = [(1, "u", None, 1), (1, "u", None, 1), (None, None, "<p>x", 2), (3, "u", "", 3)]
    got = page_report(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, "x", 1), (3, "u", "", 0)], key=str)
    assert page_report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
