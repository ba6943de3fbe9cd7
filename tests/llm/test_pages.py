"""Main text of pages against plain Python and planted templates."""

import html
import random
import re

import pytest

from casebrook.llm import htmltree, queries, site_templates
from casebrook.llm.site_templates import main_text


def plain_text(page):
    """The article of the given tables' pages, by patterns."""
    article = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article))
    return "\n".join(b for b in blocks if b)


def test_given_pages(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    expected = sorted((r.page_id, r.url, plain_text(r.html), len(plain_text(r.html))) for r in pages.collect())
    got = queries.op12_main_texts(spark, folder)
    assert sorted((r.page_id, r.url, r.text, r.n_chars) for r in got.collect()) == expected


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""),
        ("just text", "just text"),
        ("<p>one<p>two<div>three</div>four", "one\ntwo\nthree\nfour"),
        ("<article><P CLASS=x>a<b>b</b>c<br>d&nbsp; e\n f</P></article>tail", "abc d e f"),
        ("<body><header>top</header><main><h2>T</h2><p>x &lt; y &amp y &#8364;</p><aside>s</aside></main>", "T\nx < y & y €"),
        ("<article><header><h1>Title</h1></header><p>a</p><form><p>mail</p></form></article>", "Title\na"),
        ("<article><p>a</p><!-- <p>no</p> --><script>'</p>'</script><style>p{}</style><p>b</article>", "a\nb"),
        ('<article><p>a</p><div class="ad">buy</div><div id="CookieNotice">c</div><p>b</p></article>', "a\nb"),
        ('<article><p>a</p></article><section class="comments"><article><p>mine</p></article></section>', "a"),
        ('<article class="post comments-open"><p>a</p></article><article class="comment"><p>c</p></article>', "a"),
        ('<div class="ad">x<article><p>a</p></article></div>', "a"),
        ('<form action="/"><main><p>a</p></main><input value="b"></form>', "a"),
        ('<div role="navigation"><a href="/">x</a></div><p>a</p><div hidden>b</div><p style="display: none">c</p>', "a"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><blockquote>e</blockquote></article>", "a\nb\nc\nd\ne"),
        ('<article><p title="a > b">a</p><p title=">">b</p></article>', "a\nb"),
        ("<article>a</nope></p></b><p>b", "a\nb"),
        ("<article><p>a<script>never closed <p>b</article>", "a"),
        ("<p>a</p><!-- never closed <p>b</p>", "a"),
        ("<title>t</title><p>2 < 3 and <3</p>", "2 < 3 and <3"),
        ('<div id="content"><p>a</p><nav>n</nav></div><p>outside</p>', "a"),
        ("<article><p>a <a href='/x'>link</a>, b</p><pre>c\n  d</pre></article>", "a link, b\nc d"),
    ],
)
def test_markup(page, text):
    assert main_text(page, {}) == text


def test_deep_and_broken_pages():
    deep = "<article>" + "<div>" * 20_000 + "x" + "</div>" * 20_000 + "<p>y</p></article>"
    assert main_text(deep, {1: 1.0}) == "x\ny"
    assert main_text("<p>a</p>" + "<a b='" * 3000, {}) == "a"
    assert main_text("<" * 5000, {}) == "<" * 5000
    rng = random.Random(0)
    parts = ["<p>", "</p>", "<div class='ad'", ">", "</", "<!--", "-->", "&amp", "x ", "<script>", "</script>", '"', "<td>", "<li>"]
    for _ in range(300):
        page = "".join(rng.choice(parts) for _ in range(60))
        nodes = htmltree.parse(page)
        assert len(htmltree.subtree_hashes(nodes)) == len(nodes)
        main_text(page, {0: 1.0})


def site(host, k, rng, article):
    """A page whose template has no telling names."""
    bar = "<div class='q1'>" + "".join(f"<a href='/{i}'>Section {i}</a> " for i in range(5)) + "</div>"
    note = "<div class='q2'><p>All rights are with the owners of this site and nobody else.</p></div>"
    own = f"<div class='q3'><p>Page number {k} of {host}</p></div>"
    return f"<html><body>{bar}<div class='q4'>{article}</div>{own}{note}<script>{rng.random()}</script></body></html>"


def pages_with_templates():
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(15)) + "."
    shared = sentence()
    copied = [sentence() for _ in range(4)]
    rows, expected = [], []
    for k in range(90):
        host = "www.One.example" if k < 60 else "two.example" if k < 85 else "small.example"
        mine = [sentence() for _ in range(5)]
        if k % 6 == 0:
            mine[2] = shared  # a passage that a part of the articles share
        if 20 <= k < 45:
            mine = copied  # one article on many pages
        article = "".join(f"<p>{s}</p>" for s in mine)
        rows.append((k, f"https://{host.lower()}/p/{k}", site(host, k, rng, article)))
        text = mine + [f"Page number {k} of {host}"]
        if host == "small.example":  # too few pages to know a template by
            text = ["Section 0 Section 1 Section 2 Section 3 Section 4", *text]
            text.append("All rights are with the owners of this site and nobody else.")
        expected.append((k, "\n".join(text)))
    return rows, expected


ODD = "page_id long, url string, html string, host string, tree string, share string, text string, salt string"


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
def test_templates_go(spark, most_bytes):
    rows, expected = pages_with_templates()
    rows += [rows[0], rows[0], (None, None, None), (200, "no address", ""), (201, None, "<p>a"), (202, "http://[", "<p>b")]
    expected += [expected[0], expected[0], (None, ""), (200, ""), (201, "a"), (202, "b")]
    df = spark.createDataFrame([r + ("h", "t", "s", "x", "y") for r in rows], ODD).repartition(4)
    got = site_templates.main_texts(df, most_bytes=most_bytes).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == sorted((str(i), t) for i, t in expected)
    assert all(r.n_chars == len(r.text) for r in got)
    assert {(str(r.page_id), r.url) for r in got} == {(str(i), u) for i, u, _ in rows}


def test_templates_are_counted_by_surroundings(spark):
    rows, _ = pages_with_templates()
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = site_templates.site_templates(df).collect()
    assert found and all(r.pages >= site_templates.MIN_PAGES and 0 < r.share <= 1 for r in found)
    none = site_templates.main_texts(df.limit(0))
    assert none.collect() == [] and none.columns == ["page_id", "url", "text", "n_chars"]
