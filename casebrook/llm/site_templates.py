"""Main text of web pages by removal of site templates.

Every element subtree of a page is hashed. Spark counts, for each host, on how
many pages a subtree stands; a subtree that recurs across many pages of its host
is part of the site's template and is deleted. Pages are counted by surroundings:
a subtree counts once for each different parent, so the paragraphs of an article
that stands on many pages as a whole are no template.

How often a subtree must recur depends on what it is. Lists of links need a
hundredth of the host's pages, anything else half of them: passages that many
articles of a host share are text. Both need ``MIN_PAGES``. Templates of a host
are thus at most a hundred times the subtrees of its average page.

Elements that say what they are (menus, footers, forms, adverts, comments; by tag,
role, class or id) go on every host, also on those with a few pages. The article
itself, and whatever holds it, is never deleted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebrook.llm.htmltree import BLOCK, Node, parse, subtree_hashes
from casebrook.llm.scratch import written
from casebrook.operators.sizing import MAX_BYTES

MIN_PAGES = 10
LINK_SHARE = 0.01
TEXT_SHARE = 0.5
SALTS = 32
_TOGETHER = 64  # pages between two batches of output

_HARD = frozenset(
    "head script style noscript template nav aside footer iframe object embed svg math canvas audio "
    "video title textarea xmp noembed noframes link meta base".split()
)
_SOFT = frozenset("form button select input dialog menu search datalist fieldset".split())
_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split()
)
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adslot adsense sponsor sponsored "
    "sponsors promo promos promoted promotion banner banners cookie cookies consent gdpr notice notices "
    "newsletter newsletters subscribe subscription signup popup modal overlay nav navi navigation navbar "
    "menu menus submenu breadcrumb breadcrumbs sidebar sidebars aside footer footers masthead topbar "
    "toolbar pagination pager comment comments disqus respond reply replies share sharing sharebar social "
    "related recommended recommendations teaser teasers widget widgets login search skip".split()
)
_ARTICLE_WORDS = frozenset("post article entry story hentry main content".split())
_CONTENT_IDS = frozenset(
    "article article-body articlebody post post-content post-body entry entry-content story story-body "
    "main main-content maincontent content page-content body-content".split()
)
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NEVER = frozenset(["", "html", "body", "main"])


def _words(node: Node) -> set[str]:
    named = f"{node.attributes.get('class', '')} {node.attributes.get('id', '')}"
    return {w.lower() for w in _SPLIT.split(named) if w} if len(named) > 1 else set()


def _unwanted(node: Node, in_article: bool) -> int:
    """2: goes with all it holds; 1: goes unless it holds the article; 0: stays."""
    if node.tag in _HARD:
        return 2
    if node.tag in _NEVER:
        return 0
    if node.tag in _SOFT:
        return 1
    a = node.attributes
    if not a:
        return int(node.tag == "header" and not in_article)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(a.get("style", "")):
        return 1
    if a.get("role", "").lower() in _ROLES:
        return 1
    words = _words(node)
    if words & _WORDS and not (node.tag == "article" and words & _ARTICLE_WORDS):
        return 1
    heading = node.tag == "header" or "header" in words
    return int(heading and not in_article)


def _is_content(node: Node) -> bool:
    a = node.attributes
    if a.get("role", "").lower() == "main" or a.get("itemprop", "").lower() == "articlebody":
        return True
    names = f"{a.get('class', '')} {a.get('id', '')}".lower().split()
    return any(n in _CONTENT_IDS for n in names)


def _article_roots(nodes: list[Node]) -> list[int]:
    """The outermost elements that hold the article; the whole page if nothing says so."""
    level = [0] * len(nodes)
    found: dict[str, list[int]] = {"article": [], "main": [], "named": []}
    inside: list[set[str]] = [set() for _ in nodes]
    for k in range(1, len(nodes)):
        node = nodes[k]
        p = node.parent
        inside[k] = inside[p]
        own = _unwanted(node, bool(inside[p]))
        level[k] = 2 if level[p] == 2 or own == 2 else 0
        if level[k] == 2:
            continue
        kind = node.tag if node.tag in ("article", "main") else "named" if _is_content(node) else None
        if kind == "article" and own:
            level[k] = 2  # an article that is a comment, an advert or a teaser
        elif kind and kind not in inside[p]:
            inside[k] = inside[p] | {kind}
            found[kind].append(k)
    for kind in ("article", "main", "named"):
        roots = [k for k in found[kind] if not _within_unwanted(nodes, k)]
        if roots or found[kind]:
            return roots or found[kind]
    return [0]


def _within_unwanted(nodes: list[Node], k: int) -> bool:
    """Is the element in another that is a list of comments, adverts or related articles?"""
    k = nodes[k].parent
    while k > 0:
        if nodes[k].tag != "form" and _unwanted(nodes[k], False):
            return True
        k = nodes[k].parent
    return False


def _text_sizes(nodes: list[Node]) -> tuple[list[int], list[int]]:
    """Characters of every subtree, and those of them that are in links."""
    own, linked = [0] * len(nodes), [0] * len(nodes)
    for k in range(len(nodes) - 1, 0, -1):
        own[k] += sum(len(x.strip()) for x in nodes[k].items if not isinstance(x, int))
        if nodes[k].tag == "a":
            linked[k] = own[k]
        own[nodes[k].parent] += own[k]
        linked[nodes[k].parent] += linked[k]
    return own, linked


def main_text(html: str, templates: dict[int, float]) -> str:
    """The text of a page without what its tags name and without templates.

    ``templates``: for hashes of subtrees, the share of the host's pages with them.
    """
    nodes = parse(html)
    roots = _article_roots(nodes)
    protected = set()
    for k in roots:
        while k >= 0 and k not in protected:
            protected.add(k)
            k = nodes[k].parent
    whole = roots == [0]
    gone = [False] * len(nodes)
    hashes = subtree_hashes(nodes) if templates else None
    sizes, linked = _text_sizes(nodes) if templates else ([], [])
    most = sum(sizes[k] for k in roots) / 2 if templates else 0
    for k in range(1, len(nodes)):
        if k in protected:
            continue
        if _unwanted(nodes[k], not whole):
            gone[k] = True
        elif templates:
            share = templates.get(hashes[k], 0.0)
            links = 2 * linked[k] >= sizes[k] > 0
            gone[k] = share >= (LINK_SHARE if links else TEXT_SHARE) and sizes[k] <= most

    blocks: list[str] = []
    pieces: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(pieces).split()):
            blocks.append(text)
        pieces.clear()

    for root in roots:
        stack: list = [root]
        while stack:
            item = stack.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                pieces.append(item)
            elif not gone[item]:
                node = nodes[item]
                if node.tag == "br":
                    pieces.append(" ")
                    continue
                if node.tag in BLOCK:
                    flush()
                    stack.append(None)
                stack.extend(reversed(node.items))
        flush()
    return "\n".join(blocks)


def _prepared(pages: DataFrame) -> DataFrame:
    url = pages["url"].cast("string")
    return pages.select(
        pages["page_id"].cast("long").alias("page_id"),
        url.alias("url"),
        F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"),
        F.xxhash64(F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))).alias("host"),
    )


def _subtrees(rows: DataFrame) -> DataFrame:
    """``host, tree, parent`` of the subtrees of every page; the page itself has parent 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, _TOGETHER):
                part = batch.slice(low, _TOGETHER)
                found = set()
                for host, html in zip(part.column(0).to_pylist(), part.column(1)):
                    nodes = parse(html.as_py())
                    hashes = subtree_hashes(nodes)
                    found.add((host, hashes[0], 0))
                    for k in range(1, len(nodes)):
                        if nodes[k].items:
                            found.add((host, hashes[k], hashes[nodes[k].parent]))
                columns = list(zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=pa.int64()) for c in columns], names=["host", "tree", "parent"]
                )

    return rows.select("host", "html").mapInArrow(run, "host long, tree long, parent long")


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, tree, pages, share``: subtrees that recur across a host's pages.

    ``pages`` counts different surroundings, ``share`` is their part of the
    host's different pages. ``host`` is the hash of the host name.
    """
    return _recurring(_prepared(pages), min_pages)


def _recurring(rows: DataFrame, min_pages: int) -> DataFrame:
    places, _ = written(_subtrees(rows).distinct(), "subtrees")
    hosts = places.where("parent = 0").groupBy("host").agg(F.count("*").alias("of"))
    often = (
        places.where("parent <> 0")
        .groupBy("host", "tree")
        .agg(F.count("*").alias("pages"))
        .where(F.col("pages") >= min_pages)
    )
    joined = often.join(hosts, "host").withColumn("share", F.col("pages") / F.col("of"))
    return joined.where(F.col("share") >= LINK_SHARE).select("host", "tree", "pages", "share")


_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


def _texts(ids: pa.Array, urls: pa.Array, pages: Iterator[tuple[str, dict[int, float]]]) -> pa.RecordBatch:
    texts = [main_text(html, templates) for html, templates in pages]
    return pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, type=pa.string())], names=_SCHEMA.names)


def _by_broadcast(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Pages stay where they lie; each machine holds the templates of all hosts."""
    table = found.select("host", "tree", "share").sort("host", "tree").toPandas()
    held = rows.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() for c in table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts, trees, shares = held.value
        known: dict[int, dict[int, float]] = {}

        def of(host: int) -> dict[int, float]:
            if host not in known:
                low, high = hosts.searchsorted(host), hosts.searchsorted(host, side="right")
                known[host] = dict(zip(trees[low:high].tolist(), shares[low:high].tolist()))
            return known[host]

        for batch in batches:
            for low in range(0, batch.num_rows, _TOGETHER):
                part = batch.slice(low, _TOGETHER)
                pages = ((h.as_py(), of(k.as_py())) for h, k in zip(part.column(2), part.column(3)))
                yield _texts(part.column(0), part.column(1), pages)

    return rows.select("page_id", "url", "html", "host").mapInArrow(run, _SCHEMA)


def _by_shuffle(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Pages and templates are dealt by host and salt; templates come first in each."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    before = found.select(
        "host",
        salts.alias("salt"),
        "tree",
        "share",
        F.lit(None).cast("long").alias("page_id"),
        F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("html"),
    )
    pages = rows.select(
        "host",
        F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("salt"),
        F.lit(None).cast("long").alias("tree"),
        F.lit(None).cast("double").alias("share"),
        "page_id",
        "url",
        "html",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, known = None, {}
        for batch in batches:
            for low in range(0, batch.num_rows, _TOGETHER):
                part = batch.slice(low, _TOGETHER)
                found = []
                for h, tree, share, html in zip(*(part.column(c).to_pylist() for c in (0, 1, 2, 5))):
                    if h != host:
                        host, known = h, {}
                    if html is None:
                        known[tree] = share
                    else:
                        found.append((html, known))
                only = part.filter(part.column(5).is_valid())
                yield _texts(only.column(3), only.column(4), found)

    together = before.unionByName(pages).repartition("host", "salt")
    together = together.sortWithinPartitions("host", "salt", F.col("html").isNotNull())
    return together.select("host", "tree", "share", "page_id", "url", "html").mapInArrow(run, _SCHEMA)


def main_texts(pages: DataFrame, min_pages: int = MIN_PAGES, most_bytes: int = MAX_BYTES) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages(page_id, url, html)``.

    Null or empty pages have an empty text. Pages whose address is null or names
    no host share one host. Repeated rows are reported each and count once for
    templates; an empty table gives no rows; other columns are not read.

    Templates of all hosts go to every machine while they fit ``most_bytes``.
    Beyond it pages are dealt to ``SALTS`` places of their host, so that a host
    with a third of all pages is spread as well, and meet its templates there.
    """
    rows = _prepared(pages)
    found, _ = written(_recurring(rows, min_pages), "site-templates")
    out = (_by_broadcast if 24 * found.count() <= most_bytes else _by_shuffle)(rows, found)
    return out.withColumn("n_chars", F.length("text").cast("long"))
