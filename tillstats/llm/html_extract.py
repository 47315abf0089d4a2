"""Main text of web pages by scoring the element tree.

The page is read into a tree: a paragraph ends where another block begins, raw-text elements
hold no markup, what a cut-off page leaves open is closed at its end. Elements that never
hold the article go (menus, page headers, footers, sidebars, notices, adverts, forms, scripts, reader
comments), known by tag, role or the words of class and id; within an article, a word that may also name a part of
it counts only for short or linked text. Every paragraph then passes points, 1 and more for
length and commas, to its ancestors: all to the parent, half to the next, half of that to the next and so on; each
container's sum is discounted by its share of link text. The best container and those of its siblings
that look like parts of the article are kept, whole. Every step takes time in proportion to the page, however deep its tree.

Defined results: null or empty html, or a page without text, gives the empty string. A line
break is white space within its block. Text after an unfinished tag at the page's end is dropped with the tag.
Rows are handled one by one, so repeated rows and null ids pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW = frozenset(["script", "style", "title", "textarea", "xmp", "noembed", "noframes", "iframe"])
_VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: A start tag closes these open elements, up to the nearest of the second set.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: An end tag closes nothing beyond the nearest of these.
_FENCE = frozenset(["article", "body", "td", "th", "table"])
#: A block within these leaves a paragraph around them open.
_KEEPS_P = frozenset(["td", "th", "table", "button", "object", "li", "blockquote", "div", "section", "article"])
_NEVER = frozenset("head script style title noscript template iframe object embed applet audio video canvas svg math map nav footer aside form button select textarea input datalist dialog menu".split())
_NEVER_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar status".split())
#: Words of class or id that name something beside the article.
_BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay "
    "sidebar rail nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer header masthead topbar toolbar comment comments disqus reply replies discussion respond "
    "share sharing social follow related recommended recommendations outbrain taboola newsletter subscribe subscription signup login form search widget skip tracking".split()
)
#: Words of these that may name a part of the article as well.
_EITHER = frozenset("related recommended social follow search discussion notice alert promotion rail widget response banner form share".split())
_COMMENTS = frozenset("comment comments disqus reply replies respond discussion".split())
_ARTICLE = frozenset("article articlebody body content entry main post story text page".split())
_SCORED = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 div section article main".split())


class Node:
    __slots__ = ("children", "parent", "points", "tag", "words", "attributes", "chars", "link_chars")

    def __init__(self, tag: str, parent: Node | None, attributes: dict[str, str] | None = None):
        self.tag, self.parent, self.attributes = tag, parent, attributes or {}
        self.children: list[Node | str] = []
        self.points, self.chars, self.link_chars = 0.0, 0, 0
        named = f"{self.attributes.get('class', '')} {self.attributes.get('id', '')}"
        self.words = frozenset(w.lower() for w in _WORD.findall(named)) if len(named) > 1 else frozenset()


class _Open:
    """The open elements, with the places of each tag among them, so that none is searched for."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def _last(self, tags) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def close(self, targets, fence=frozenset()) -> None:
        """Closes the innermost of ``targets`` and all within it, unless one of ``fence`` lies in between."""
        at = self._last(targets)
        if at and at >= self._last(fence):
            for node in reversed(self.stack[at:]):
                self.places[node.tag].pop()
            del self.stack[at:]


def parse(html: str) -> Node:
    """The element tree of a page."""
    root = Node("#root", None)
    open_, at, n = _Open(root), 0, len(html)

    def text(upto: int) -> None:
        if upto > at:
            open_.stack[-1].children.append(unescape(html[at:upto]))

    while at < n:
        m = _MARKUP.search(html, at)
        if not m:
            text(n)
            break
        text(m.start())
        at = m.end()
        name = (m[2] or "").lower()
        if not name or not m[4]:
            continue  # a comment, a declaration, or a tag that the page's end cuts off
        if m[1]:
            open_.close({name}, _FENCE - {name} if name not in ("html", "body", "article", "main", "div", "section") else frozenset())
            continue
        if name in _BLOCKS:
            open_.close({"p"}, _KEEPS_P)
        if name in _CLOSES:
            open_.close(*_CLOSES[name])
        attributes = {k.lower(): unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(m[3])} if "=" in m[3] or m[3].strip("/ \n\t") else {}
        node = Node(name, open_.stack[-1], attributes)
        open_.stack[-1].children.append(node)
        if name in _RAW:
            at = _raw_end(name).search(html, at).end()
        elif name not in _VOID and not (m[3].endswith("/") and name not in _BLOCKS and name not in ("a", "b", "i", "span", "em", "strong")):
            open_.push(node)
    return root


@cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*>|\Z", re.I)


def _beside(node: Node, within_article: bool) -> bool:
    """Whether an element never is part of the article."""
    a = node.attributes
    if node.tag in _NEVER or a.get("role", "").lower() in _NEVER_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return True
    if "style" in a and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a["style"], re.I):
        return True
    if within_article and not node.link_chars and node.chars >= 200 and node.words & _BESIDE <= _EITHER and not a.get("role"):
        return False
    if node.words & _COMMENTS and not node.tag == "body":
        return True
    if node.tag == "header":
        return not within_article
    if node.tag in ("html", "body", "article", "main", "#root"):
        return False
    return bool(node.words & _BESIDE) and not (node.words & _ARTICLE and node.words <= _ARTICLE | {"header", "page"})


def _prune(root: Node) -> None:
    todo = [(root, False)]
    while todo:
        node, within = todo.pop()
        within = within or node.tag in ("article", "main")
        kept: list[Node | str] = []
        for child in node.children:
            if isinstance(child, str):
                kept.append(child)
            elif not _beside(child, within):
                kept.append(child)
                todo.append((child, within))
            elif child.tag in _BLOCKS:
                kept.append(Node("hr", node))  # what stood around it stays apart
        node.children = kept


def _squeezed(text: str) -> str:
    return " ".join(text.split())


def _measured(root: Node) -> list[tuple[Node, bool]]:
    """Every node with whether it stands in a link, in page order; their text and link text are counted."""
    order, todo = [], [(root, False)]
    while todo:
        node, linked = todo.pop()
        linked = linked or node.tag == "a"
        node.chars = node.link_chars = 0
        order.append((node, linked))
        todo += [(c, linked) for c in reversed(node.children) if not isinstance(c, str)]
    for node, linked in reversed(order):
        own = sum(len(_squeezed(c)) for c in node.children if isinstance(c, str))
        node.chars += own
        node.link_chars += own if linked else 0
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars
    return order


def _score(root: Node) -> list[Node]:
    """Lets every paragraph pass its points on; all containers, in page order."""
    order = [node for node, _ in _measured(root)]
    for node in order:
        if node.tag not in _SCORED:
            continue
        # a paragraph: its text up to the blocks within it
        text = _squeezed(" ".join(_inline(node)))
        if not text:
            continue
        points = min(len(text) / 25, 1.0) * (1 + text.count(",") + min(len(text) / 100, 3))
        points *= 1 - (node.link_chars / node.chars if node.chars else 0)
        # text directly in a container counts for the container itself
        target = node if node.tag in ("div", "section", "article", "main", "td") else node.parent
        if target is not None:
            target.points += points
    root.points = 0.0
    for node in reversed(order):  # children come before their parents
        if node.parent is not None and node.parent.parent is not None:
            node.parent.points += node.points / 2
    return order


def _inline(node: Node) -> Iterator[str]:
    todo: list[Node | str] = list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
        elif x.tag not in _BLOCKS:
            todo += reversed(x.children)


def _density(node: Node) -> float:
    return node.link_chars / node.chars if node.chars else 0.0


def _value(node: Node) -> float:
    weight = 25.0 if node.points and (node.tag in ("article", "main") or node.attributes.get("role", "").lower() in ("main", "article") or node.attributes.get("itemprop", "").lower() == "articlebody") else 0.0
    weight += 10.0 if node.points and node.words & {"article", "content", "entry", "post", "story"} else 0.0
    return (node.points + weight) * (1 - _density(node))


def _blocks(nodes: list[Node]) -> list[str]:
    out: list[str] = []
    current: list[str] = []

    def flush() -> None:
        text = _squeezed("".join(current))
        current.clear()
        if text:
            out.append(text)

    for top in nodes:
        todo: list[Node | str | None] = [None, top, None]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                current.append(x)
            elif x.tag == "br":
                current.append(" ")
            elif x.tag in _BLOCKS:
                flush()
                todo.append(None)
                todo += reversed(x.children)
            else:
                todo += reversed(x.children)
    return out


def extract(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    root = parse(html)
    _measured(root)
    _prune(root)
    nodes = _score(root)
    best = max((x for x in nodes if x.tag != "#root"), key=_value, default=None)
    if best is None or not best.points:
        return "\n".join(_blocks([root]))
    # a container within the article stands for the whole of it
    up = best.parent
    while up is not None and up.tag != "#root":
        if up.tag in ("article", "main") and _density(up) < 0.5:
            best = up
        up = up.parent
    if best.parent is None or best.tag in ("body", "html"):
        return "\n".join(_blocks([best]))
    enough, kept = max(10.0, 0.2 * _value(best)), []
    for sibling in best.parent.children:
        if isinstance(sibling, str):
            continue
        same = 0.2 * _value(best) if sibling.words and sibling.words == best.words else 0.0
        loose = sibling.tag == "p" and sibling.chars > 80 and _density(sibling) < 0.25
        if sibling is best or (sibling.points and _value(sibling) + same >= enough) or loose:
            kept.append(sibling)
    return "\n".join(_blocks(kept))


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 200):
                part = batch.slice(lo, 200)
                found = [extract(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", F.col(html))
    schema = rows.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return rows.mapInArrow(textbuf.lean(run), schema)
