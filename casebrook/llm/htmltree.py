"""Element trees of raw web pages, in one pass that forgives broken markup.

A page becomes a list of nodes in page order. Raw text elements (scripts, styles)
lose their content at once; a ``p`` ends where a block begins, list items, cells
and options end where the next one begins, and end tags without a start are left
out. Time is linear in the page; no step recurses, so nesting may be any depth.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import xxhash

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)(?:>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SEEN = {"class", "id", "role", "hidden", "style", "itemprop", "aria-hidden"}

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
    "nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_SCOPE = frozenset("table td th caption button html body".split())
#: A start tag ends the nearest open one of these, unless one of the walls is nearer.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "body": ({"head"}, set()),
}


@dataclass
class Node:
    """An element: its tag, the attributes that matter, and texts and elements within."""

    tag: str
    attributes: dict[str, str]
    parent: int
    items: list


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if raw and not raw.isspace():
        for name, *values in _ATTRIBUTE.findall(raw):
            name = name.lower()
            if name in _SEEN and name not in out:
                out[name] = unescape(next((v for v in values if v), ""))
    return out


def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I)


_RAW_END = {tag: _raw_end(tag) for tag in RAW}


def parse(html: str) -> list[Node]:
    """The nodes of a page in page order; node 0 is the page itself."""
    nodes = [Node("", {}, -1, [])]
    open_ = [0]  # the path to the element being read
    counts: dict[str, int] = {}  # how often each tag is open

    def close(depth: int) -> None:
        for k in open_[depth:]:
            counts[nodes[k].tag] -= 1
        del open_[depth:]

    def end(tags: set[str], walls: frozenset | set) -> None:
        if not any(counts.get(t) for t in tags):
            return
        for depth in range(len(open_) - 1, 0, -1):
            tag = nodes[open_[depth]].tag
            if tag in tags:
                return close(depth)
            if tag in walls:
                return

    at, size = 0, len(html)
    while at < size:
        token = _TOKEN.search(html, at)
        start = token.start() if token else size
        if start > at:
            nodes[open_[-1]].items.append(unescape(html[at:start]))
        if token is None:
            break
        at = token.end()
        tag = token.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if token.group(1):
            if counts.get(tag):
                end({tag}, set() if tag in BLOCK else BLOCK)
            continue
        if tag in BLOCK:
            end({"p"}, _SCOPE)
        if tag in _ENDS:
            end(*_ENDS[tag])
        if tag in ("html", "body") and counts.get(tag):
            continue
        nodes.append(Node(tag, _attributes(token.group(3)), open_[-1], []))
        nodes[open_[-1]].items.append(len(nodes) - 1)
        if tag in RAW:
            stop = _RAW_END[tag].search(html, at)
            at = html.find(">", stop.end()) + 1 or size if stop else size
        elif tag not in VOID:
            open_.append(len(nodes) - 1)
            counts[tag] = counts.get(tag, 0) + 1
    return nodes


def subtree_hashes(nodes: list[Node]) -> list[int]:
    """A signed 64-bit hash of every subtree: tags, classes, ids and texts in order."""
    out = [0] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        node = nodes[k]
        parts = [node.tag, node.attributes.get("class", ""), node.attributes.get("id", "")]
        for item in node.items:
            if isinstance(item, int):
                parts.append(f"\x01{out[item]}")
            elif text := " ".join(item.split()):
                parts.append(f"\x02{text}")
        digest = xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass"))
        out[k] = digest - (1 << 64) if digest >> 63 else digest
    return out
