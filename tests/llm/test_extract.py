"""op12: the given pages against a plain cut, sites with templates, marked and broken markup, hard rows."""

from __future__ import annotations

import html
import re

import pytest
from pyspark.sql import functions as F

from studylake.llm import extract, queries

from ..oracle import SMALL


def text_of(source: str) -> str:
    return extract.Page(source).text()


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(None).cast("string") for c in ("host", "templates", "text", "hash", "article")})


def plain(source: str) -> str:
    """The given pages' articles have headings and paragraphs only."""
    article = source[source.index("<article>") + 9 : source.index("</article>")]
    blocks = (" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split("</?(?:p|h1)>", article))
    return "\n\n".join(b for b in blocks if b)


def test_given_pages(spark):
    got = {r.page_id: r for r in queries.queries()["op12_site_templates"](spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == plain(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_what_is_no_article():
    page = """<!doctype html><HTML><head><title>T</title><style>x</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav>menu</nav><div class="cookie-notice">Cookies!</div>
      <div class="content with-sidebar"><article class="post share"></article><article class="post"><header><h1>Title</h1><span>by me</span></header><p>One&nbsp; <b>two</b>
      three</p><script>if (a < b) document.write("</p>")</script><aside>Also</aside><div class='ad'>Buy</div><form><input>Mail<textarea></p></textarea></form><ul><li>x<li>y</ul>
      <table><tr><td>c1<td>c2</table><div hidden>h</div><p style="display:none">h</p><p>T&eacute;xt &lt;b&gt; &amp co &#x41;</p><section id="comments"><article><p>Me too</p></article></section></article></div>
      <section class="comments"><article><p>first!</p></article></section><footer>&copy;</footer></body></html>"""
    assert text_of(page) == "Title\n\nOne two three\n\nx\n\ny\n\nc1\n\nc2\n\nTéxt <b> & co A"


@pytest.mark.parametrize(
    "source, want",
    [
        ("", ""), ("plain < text & more", "plain < text & more"), ("<p>a<p>b", "a\n\nb"), ("<p>a<!-- x <p> -->b<!-- open <p>c", "ab"), ("<p>a<script>never", "a"), ("<p>a</p><div class='x", "a"), ("a<br>b<b>c</b>d", "a bcd"),
        ("<b><p>x</b>y</p>z", "xy\n\nz"), ("<div>a</p>b</div></div>c", "a\n\nb\n\nc"), ("<main><p>m</p></main><p>out", "m"), ("<p title=don't>it's</p><p title=\"a>b\">c</p>", "it's\n\nc"),
        ("<p>a</p><article class=comment><p>no</p></article>", "a"), ("<article><p>a<article><p>b</article>c</article><article>d</article>", "a\n\nb\n\nc\n\nd"), ("<table><tr><td><p>a<td>b</table>c", "a\n\nb\n\nc"),
        ("<p>x" * 3 + "<div>" * 50_000 + "deep", "x\n\nx\n\nx\n\ndeep"), ("<p><table><td>" + "<div><b>" * 30_000 + "</i>" * 1000 + "deep", "deep"), ("<p>" + "word " * 200_000, ("word " * 200_000).strip()), ("<SCRIPT>a</Script ><P>b</P>", "b"), ("<p>&am &amp;amp; &#0; &nosuch;</p>", "&am &amp; � &nosuch;"),
    ],
)
def test_blocks(source, want):
    assert text_of(source) == want


def site(n, host="a.example", extra=""):
    return [(i, f"http://U:p@{host.upper()}:80/{i}?q#f", f"<div><p>Welcome to the site</p></div><div class=x><p>Body {i} of {host}.</p><p>Shared license.</p></div><div><span>All rights</span> kept</div>{extra}") for i in range(n)]


def test_recurring_subtrees_go(spark):
    rows = [*site(8), *[(100 + i, u, h) for i, u, h in site(3, "few.example")]]
    got = {r.page_id: r.text for r in extract.extract(pages_of(spark, rows)).collect()}
    assert all(got[i] == f"Body {i} of a.example." for i in range(8))  # without article or main all that recurs goes
    assert got[100] == "Welcome to the site\n\nBody 0 of few.example.\n\nShared license.\n\nAll rights kept"  # too few pages to tell


def test_prose_of_articles_stays(spark):
    rows = [(i, "http://b.example/", f"<article><p>Passage of many documents.</p><p>{i}</p><div>Read <a>more</a></div></article>") for i in range(9)]
    assert {r.text for r in extract.extract(pages_of(spark, rows)).collect()} == {f"Passage of many documents.\n\n{i}" for i in range(9)}


def test_copies_are_one_page(spark):
    """A hundred pages with one article, whatever surrounds it, make no template of it."""
    rows = [(i, "http://c.example/", f"<nav>{i}</nav><article><div>The only text</div></article>") for i in range(100)] + [(100 + i, "http://c.example/", f"<article><div>Another {i}</div></article>") for i in range(5)]
    assert [r.text for r in extract.extract(pages_of(spark, rows)).where("page_id = 7").collect()] == ["The only text"]
    found = extract.templates(pages_of(spark, rows))
    assert found.count() == 0


def test_templates_are_the_counts(spark):
    """Against a plain count of every page's subtrees."""
    rows = [*site(6), *site(6, "d.example", "<nav><ul><li>x</ul></nav>"), (50, None, "<p>a"), (51, "no host", "<p>a"), (52, "http://a.example", None)]
    seen, articles = {}, {}
    for _, url, source in rows:
        if url and "://" in url:
            page = extract.Page(source or "")
            h = re.sub(r".*@|:80.*|http://", "", url.lower())
            whole = page.hashes()[0]
            articles.setdefault(h, set()).add(whole)
            for k, x in enumerate(page.hashes()):
                if x and k and page.tags[k] not in extract.INLINE:
                    seen.setdefault((h, x), set()).add(whole)
    want = {(h, int.from_bytes(x, "little", signed=True)) for (h, x), n in seen.items() if len(n) >= 4 and len(n) >= len(articles[h]) / 4}
    assert {(r.host, x) for r in extract.templates(pages_of(spark, rows)).collect() for x in r.templates} == want


def test_hard_rows_and_no_rows(spark):
    rows = [(None, None, None), (1, "", ""), (1, "", ""), (2, "http://e.example", "<p>x</p>")]
    assert sorted((tuple(r) for r in extract.extract(pages_of(spark, rows)).collect()), key=str) == sorted([(None, None, "", 0), (1, "", "", 0), (1, "", "", 0), (2, "http://e.example", "x", 1)], key=str)
    assert extract.extract(pages_of(spark, [])).columns == ["page_id", "url", "text", "n_chars"] and extract.extract(pages_of(spark, [])).count() == 0
