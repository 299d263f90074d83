"""Main text of web pages by composite text density.

Every node of a page's tree gets its characters for each tag, adjusted for the share that lies in links; a node's score is the sum over its children. The
container with the largest score, reached from the body through nodes at least as dense as the thinnest on the way to it, is the article.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

from cambium.llm.frames import in_arrow, unclashed, with_text

_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup: it goes up to their own end tag.
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])|\Z", re.I) for t in "script style textarea title xmp noembed noframes iframe".split()}
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: What can be the article as a whole.
_CONTAINER = frozenset("article body center div main section table tbody td tr".split())
#: A start tag ends an open element of these, up to the nearest of the others.
_ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_ENDS_P = _BLOCK - frozenset("body html head td th tr tbody thead tfoot caption legend".split())
#: Elements that are never part of the article.
_NOISE = frozenset("head script style noscript template textarea title xmp noembed noframes iframe nav footer aside form button select input menu dialog svg object audio video canvas search datalist".split())
_NOISE_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
def _named(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[_-])(?:{words})(?=$|[_-])", re.I)


_NOISE_NAME = _named(
    "ads?|adverts?|advertisements?|advertising|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|footer|gdpr|nav|navbar|navigation|newsletter|pager|pagination|popup|replies|reply|respond"
    "|signup|sponsors?|sponsored|subscribe|subscription"
)
#: Names of the layout as much as of noise: what holds most of a page's text isn't noise for being called so.
_LAYOUT_NAME = _named("banners?|header|masthead|menu|modal|notices?|promos?|promotions?|related|share|sharing|sidebar|side-bar|skip|social|toolbar|widgets?")
#: Words of a class that tell of something else's presence, and names that within an article are its own.
_ABOUT, _OWN_NAME = re.compile(r"(?:no|with|without|has|is|js)[_-]", re.I), re.compile(r"(?:^|[_-])(?:header|masthead)(?=$|[_-])", re.I)
#: How a node is noise: as what it is, or only by its name, which doesn't count if the page's first article lies in it, or by a name that other nodes have as well.
SURE, BY_NAME, BY_LAYOUT = 3, 2, 1
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "thinnest", "score", "noise")

    def __init__(self, tag: str, parent: Node | None, noise: int):
        self.tag, self.parent, self.noise = tag, parent, noise
        self.children: list[Node | str] = []


def noisy(tag: str, attributes: str, in_article: bool) -> int:
    if tag in _NOISE or tag == "header" and not in_article:
        return SURE
    if not attributes or tag in ("html", "body"):
        return 0
    own = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        own.setdefault(name.lower(), "".join(values))
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or own.get("role", "").lower() in _NOISE_ROLE or _HIDDEN.search(own.get("style", "")):
        return SURE
    if tag in ("article", "main"):
        return 0
    names = unescape(f"{own.get('class', '')} {own.get('id', '')}").split()
    names = [n for n in names if not _ABOUT.match(n) and not (in_article and _OWN_NAME.search(n))]
    return BY_NAME if any(map(_NOISE_NAME.search, names)) else BY_LAYOUT if any(map(_LAYOUT_NAME.search, names)) else 0


class _Open:
    """The open elements, and for each tag, and for blocks, where in their stack they are: no search walks the stack."""

    def __init__(self, root: Node):
        self.stack: list[Node] = [root]
        self.places: dict[str, list[int]] = {root.tag: [0]}
        self.blocks: list[int] = []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in _BLOCK or node.tag == "p":
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def last(self, tag: str) -> int:
        """Where the innermost open element of a tag is; 0 if there is none but the root."""
        own = self.places.get(tag)
        return own[-1] if own else 0

    def close(self, i: int) -> None:
        """Ends the element at i and all in it."""
        while len(self.stack) > i:
            self.places[self.stack.pop().tag].pop()
        while self.blocks and self.blocks[-1] >= i:
            self.blocks.pop()

    def ended(self, these: frozenset[str], within: frozenset[str]) -> int:
        """The outermost open element of these inside the innermost of the others; 0 if there is none."""
        edge = max(map(self.last, within))
        found = [own[i] for own in (self.places.get(t, []) for t in these) if (i := bisect_right(own, edge)) < len(own)]
        return min(found, default=0)


def parse(html: str) -> Node:
    """The page's tree. Elements that were left open end with the element around them; a tag, comment or reference cut off by the end of the page is none."""
    root = Node("html", None, 0)
    open_, at, first = _Open(root), 0, True
    while m := _TAG.search(html, at):
        if m.start() > at:
            open_.stack[-1].children.append(unescape(html[at : m.start()]))
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                open_.stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if i := open_.last(tag):
                open_.close(i)
            continue
        if tag == "html" or tag in ("body", "head") and open_.last(tag):
            continue
        if tag == "body" or open_.stack[-1].tag == "head" and tag not in ("meta", "link", "base", "title", "style", "script", "noscript", "template"):
            if i := open_.last("head"):
                open_.close(i)
        if tag in _ENDS_P and open_.blocks and open_.stack[open_.blocks[-1]].tag == "p":
            open_.close(open_.blocks[-1])
        if tag in _ENDS and (i := open_.ended(*_ENDS[tag])):
            open_.close(i)
        if first and tag in ("article", "main"):
            first = False
            for n in open_.stack:
                n.noise = n.noise if n.noise == SURE else 0
        node = Node(tag, open_.stack[-1], noisy(tag, m[3], bool(open_.places.get("article"))))
        open_.stack[-1].children.append(node)
        if tag in _RAW:
            end = _RAW[tag].search(html, at)
            at = html.find(">", end.start()) + 1 or len(html)
        elif tag not in _VOID:
            open_.push(node)
    if at < len(html):
        open_.stack[-1].children.append(unescape(html[at:]))
    return root


def nodes(root: Node, noise: int = 0) -> list[Node]:
    """All that aren't noise, or no surer noise than that, parents before children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node) and c.noise <= noise]
    return out


def pardon(root: Node) -> None:
    """Nodes that are noise by a layout's name, but have half or more of the page's text outside links, aren't noise."""
    own = nodes(root, BY_LAYOUT)
    if not any(n.noise for n in own):
        return
    for node in reversed(own):
        node.chars = 0 if node.tag == "a" else sum(len("".join(c.split())) if isinstance(c, str) else c.chars if c.noise <= BY_LAYOUT else 0 for c in node.children)
    for node in own:
        if node.noise and 2 * node.chars >= root.chars > 0:
            node.noise = 0


def weigh(root: Node) -> list[Node]:
    """Densities and scores of all nodes that aren't noise."""
    own = nodes(root)
    for node in reversed(own):
        inner = [c for c in node.children if isinstance(c, Node) and not c.noise]
        node.chars = sum(len("".join(c.split())) for c in node.children if isinstance(c, str)) + sum(c.chars for c in inner)
        node.tags = len(inner) + sum(c.tags for c in inner)
        link = node.tag == "a"
        node.link_chars = node.chars if link else sum(c.link_chars for c in inner)
        node.link_tags = sum(c.link_tags + (c.tag == "a") for c in inner)
    share = root.link_chars / max(1, root.chars)
    for node in own:
        base = log(node.chars / max(1, node.chars - node.link_chars) * node.link_chars + share * node.chars + e)
        ratio = node.chars / max(1, node.link_chars) * max(1, node.tags) / max(1, node.link_tags)
        node.density = node.chars / max(1, node.tags) * (log(ratio) / max(log(base), 0.01) if ratio > 1 else 0.0)
        node.thinnest = min(node.density, node.parent.thinnest) if node.parent else node.density
    for node in own:
        node.score = sum(c.density for c in node.children if isinstance(c, Node) and not c.noise)
    return own


def article(root: Node) -> Node | None:
    """The container with the largest sum, of equal ones the outermost first in the page, among those the body leads to through nodes not thinner than the thinnest on the way to the largest sum of all."""
    pardon(root)
    own = weigh(root)
    if not root.chars:
        return None
    least = max((n for n in own if n.chars), key=lambda n: n.score).thinnest
    return max((n for n in own if n.chars and (n.tag in _CONTAINER or n is root) and n.thinnest >= least), key=lambda n: n.score, default=root)


def main_text(html: str | None) -> str:
    root = parse(html or "")
    top = article(root)
    if top is None:
        return ""
    blocks: list[list[str]] = [[]]
    todo: list[Node | str | None] = [top]
    while todo:
        x = todo.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(x)
        elif not x.noise:
            edge = [None] if x.tag in _BLOCK else []
            todo += [*edge, *reversed(x.children), *([" "] if x.tag == "br" else []), *edge]
    return "\n".join(filter(None, (" ".join("".join(b).split()) for b in blocks)))


def _texts(batches: Iterator[pa.RecordBatch], place: int, n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            text = [main_text(h) for h in part.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=[*part.schema.names[:n], "text", "n_chars"])


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of pages, then text and n_chars (code points) of the main text of html.

    A block's white space is one space each, blocks are joined by a newline in page order. A null or empty page, or one without text, gives an empty text.
    Pages are read whole; there is no shuffle, and repeated rows give repeated results. A column of keep called text or n_chars is an error.
    """
    unclashed(keep, "text", "n_chars")
    rows, place, schema = with_text(pages, keep, "html")
    return in_arrow(rows, lambda batches: _texts(batches, place, len(keep)), f"{schema}, text string, n_chars long")
