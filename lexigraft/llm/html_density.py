"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import re
from collections import Counter
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

from lexigraft.llm.common import blocks_by_length, map_batches

#: Element names, by what they do. Fixed values of the language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section"
    " summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never hold an article's text. Fixed values.
DROPPED = frozenset(
    "nav footer aside script style noscript template iframe button select textarea svg canvas object head title menu"
    " dialog search math audio video noembed noframes xmp".split()
)
#: Elements, and parts of a class, id or role, that mark what is not the article, unless it holds most of the
#: page's text outside links. Fixed values.
MARKED = frozenset(["form"])
DROPPED_NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary contentinfo consent"
    " cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice notification pagination popup"
    " promo related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: An open element of the second set ends where one of the first starts (up to the element that bounds them).
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",
    re.DOTALL,
)
MARKS = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)


class Node:
    """A block element: its parts in page order (texts, breaks, nodes) and its counts over the whole subtree.

    ``own`` is the density of the text that stands in the node itself.
    """

    __slots__ = ("name", "parent", "parts", "chars", "tags", "link_chars", "link_tags", "density", "own", "sum")

    def __init__(self, name: str, parent: Node | None):
        self.name, self.parent, self.parts = name, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.own = self.sum = 0.0


def _is_dropped(name: str, attributes: str, within_article: bool) -> bool:
    if name in DROPPED or name == "header" and not within_article:
        return True
    return bool(attributes and HIDDEN.search(attributes))


def _is_marked(name: str, attributes: str) -> bool:
    if name in MARKED:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for m in MARKS.finditer(attributes):
        value = (m[1] or m[2] or m[3] or "").lower()
        if not DROPPED_NAMES.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            return True
    return False


def parse(page: str) -> Node:
    """Block tree of a page without what is dropped by name; inline elements are part of their block's text.

    A subtree that is only marked stays if it holds more than half of the page's text outside links.
    Unclosed paragraphs, list items and cells end where the next one starts, other unclosed elements with their parent.
    """
    root = Node("html", None)
    node, at, n = root, 0, len(page)
    # Open elements: (name, node it opened or None); skipping counts the open elements inside a dropped one.
    opened: list[tuple[str, Node | None]] = []
    held: Counter = Counter()
    dropped = links = articles = 0
    dropped_from: list[int] = []
    marked: list[Node] = []

    def text(piece: str) -> None:
        if piece and not dropped:
            if "&" in piece:
                piece = html.unescape(piece)
            node.parts.append(piece)
            length = len(piece) - piece.count(" ") if piece.isspace() else len(piece)
            if not piece.isspace():
                node.chars += length
                if links:
                    node.link_chars += length

    def close_to(depth: int) -> None:
        nonlocal node, dropped, links, articles
        while len(opened) > depth:
            name, own = opened.pop()
            held[name] -= 1
            if dropped_from and dropped_from[-1] == len(opened):
                dropped_from.pop()
                dropped -= 1
            if own is not None:
                node = own.parent
            if name == "a":
                links -= 1
            elif name in ("article", "main"):
                articles -= 1

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, is_end, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if is_end:
            if name == "br":
                node.parts.append(None)
                continue
            for depth in range(len(opened) - 1, -1, -1) if held[name] else ():
                if opened[depth][0] == name:
                    close_to(depth)
                    break
                if opened[depth][0] in ("body", "article", "main", "td", "th", "table") and name in ("p", "a", "b", "i", "span"):
                    break
            continue
        if name == "br":
            if not dropped:
                node.parts.append(None)
            continue
        if name in BLOCKS and held["p"]:
            for depth in range(len(opened) - 1, -1, -1):
                if opened[depth][0] in ("td", "th", "table", "button"):
                    break
                if opened[depth][0] == "p":
                    close_to(depth)
                    break
        if name in CLOSES and any(held[x] for x in CLOSES[name][0]):
            ends, bound = CLOSES[name]
            for depth in range(len(opened) - 1, -1, -1):
                if opened[depth][0] in bound:
                    break
                if opened[depth][0] in ends:
                    close_to(depth)
                    if name in ("li", "dt", "dd", "option", "td", "th"):
                        break
        if name in ("html", "body") and held[name]:
            continue
        if name in RAW:
            # Their content is no markup; all of them are dropped.
            end = re.compile(rf"</{name}[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
            continue
        if name == "body":
            close_to(next((k for k, x in enumerate(opened) if x[0] == "head"), len(opened)))
        is_void = name in VOID or attributes.rstrip().endswith("/") and name in ("svg", "path")
        if not dropped:
            node.tags += 1
            if name == "a":
                node.link_tags += 1
        if is_void:
            if name == "hr" and not dropped:
                node.parts.append(None)
            continue
        drop = not dropped and _is_dropped(name, attributes, articles > 0)
        own = None
        if drop:
            dropped += 1
            dropped_from.append(len(opened))
            node.parts.append(None)
        elif not dropped and (name in BLOCKS or _is_marked(name, attributes)):
            own = Node(name, node)
            node.parts.append(own)
            node = own
            if _is_marked(name, attributes):
                marked.append(own)
        if name == "a":
            links += 1
        elif name in ("article", "main"):
            articles += 1
        opened.append((name, own))
        held[name] += 1
    _drop_marked(root, marked)
    return root


def _drop_marked(root: Node, marked: list[Node]) -> None:
    """Puts a break in the place of every marked node without most of the page's text outside links."""
    if not marked:
        return
    plain = {}
    for x in reversed(_walk(root)):
        plain[x] = x.chars - x.link_chars + sum(plain[p] for p in x.parts if isinstance(p, Node))
    gone = {x for x in marked if 2 * plain[x] <= plain[root]}
    for x in {x.parent for x in gone}:
        x.parts = [None if isinstance(p, Node) and p in gone else p for p in x.parts]


def _walk(top: Node) -> list[Node]:
    """All nodes of a subtree, parents before children, in page order."""
    out, stack = [], [top]
    while stack:
        x = stack.pop()
        out.append(x)
        stack.extend(p for p in reversed(x.parts) if isinstance(p, Node))
    return out


def _density(c: int, tags: int, lc: int, links: int, share: float) -> float:
    tags, links = max(tags, 1), max(links, 1)
    base = log(c / max(c - lc, 1) * lc + share * c + e)
    return c / tags * log(c / max(lc, 1) * tags / links + 1) / log(base + 1)


def score(root: Node) -> list[Node]:
    """Sets the counts, densities and density sums of all nodes; returns the nodes."""
    nodes = _walk(root)
    own = {x: (x.chars, x.link_chars, x.link_tags) for x in nodes}
    for x in reversed(nodes):
        if x.parent is not None:
            p = x.parent
            p.chars += x.chars
            p.tags += x.tags
            p.link_chars += x.link_chars
            p.link_tags += x.link_tags
    body = root
    share = body.link_chars / body.chars if body.chars else 0.0
    for x in nodes:
        if x.chars:
            x.density = _density(x.chars, x.tags, x.link_chars, x.link_tags, share)
        c, lc, links = own[x]
        if c:
            x.own = _density(c, links, lc, links, share)
    for x in nodes:
        x.sum = sum(p.density for p in x.parts if isinstance(p, Node))
        # Text that stands in the node itself counts as a child without tags.
        x.sum += own[x][0] * (1 - (x.link_chars / x.chars if x.chars else 0.0))
    return nodes


def main_node(root: Node) -> Node:
    """The subtree with the largest density sum, and what else on the page reaches the body path's threshold.

    The threshold is the smallest density between that subtree and the body. An ancestor below the body is taken
    instead, whole, if further children of it reach the threshold, or if it is the page's article or main element.
    Outside of it, up to the body, every node and every node's own text that reaches the threshold is kept.
    """
    nodes = score(root)
    best = max(nodes, key=lambda x: x.sum)
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    chosen = best
    for below, x in zip(path, path[1:], strict=False):
        if x.name in ("body", "html"):
            break
        others = [p for p in x.parts if isinstance(p, Node) and p is not below and p.chars]
        if x.name in ("article", "main") or any(p.density >= threshold for p in others):
            chosen = x
    above = set(path[path.index(chosen) + 1 :])
    kept = Node("body", None)
    stack = [(root, iter([root]))]
    while stack:
        parent, parts = stack[-1]
        for part in parts:
            if not isinstance(part, Node):
                if part is None or parent.own >= threshold:
                    kept.parts.append(part)
            elif part is chosen or part not in above and part.chars and part.density >= threshold:
                kept.parts.append(part)
            else:
                kept.parts.append(None)
                stack.append((part, iter(part.parts)))
                break
        else:
            kept.parts.append(None)
            stack.pop()
    return kept


def blocks_of(top: Node) -> list[str]:
    """Texts of the blocks in page order, white space turned into one space, empty ones left out."""
    out, current = [], []

    def end() -> None:
        line = " ".join("".join(current).split())
        if line:
            out.append(line)
        current.clear()

    stack: list = [iter(top.parts)]
    while stack:
        for part in stack[-1]:
            if isinstance(part, str):
                current.append(part)
            else:
                end()
                if part is not None:
                    stack.append(iter(part.parts))
                    break
        else:
            end()
            stack.pop()
    return out


def main_text(page: str | None) -> str:
    return "\n".join(blocks_of(main_node(parse(page)))) if page else ""


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Main text of every row of ``(page_id, url, html)``: ``(page_id, url, text)``, one row per input row.

    Null and empty pages, and pages without text, have an empty text; repeated rows and null ids are handled
    like all others; other columns are ignored. A page is handled on its own; nothing is shuffled.
    """
    kind = dict(pages.dtypes)["page_id"]

    def make():
        def work(batch: pa.RecordBatch):
            for part in blocks_by_length(batch, 2, 4 << 20):
                yield {
                    "page_id": part.column(0),
                    "url": part.column(1),
                    "text": [main_text(x) for x in part.column(2).to_pylist()],
                }

        return work

    return map_batches(pages.select("page_id", "url", "html"), make, f"page_id {kind}, url string, text string")
