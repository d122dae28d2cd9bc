"""Main text of HTML pages by tree scoring.

The page becomes a tree of blocks. Paragraphs pass points for length and commas to the container around them, half
of them to the next one and a third to the one after, discounted by link density; the container with most points, of
equals the innermost, is the best one. Kept with it are what a wrapper or an enclosing ``article`` or ``main`` has beside
it, but for blocks of links, and siblings that are prose, score alike or look alike.

Parsing and scoring take time in proportion to the page, however broken or deeply nested it is.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .common import map_texts

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their own end tag, whatever it looks like.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Never main text.
DROPPED = frozenset("head nav header footer aside form script style textarea title iframe noscript noembed noframes object svg canvas template button select option dialog menu audio video map xmp".split())
INLINE_DROPPED = frozenset("button select option svg object canvas map audio video".split())
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split()) | (DROPPED - INLINE_DROPPED)
#: What may hold the article; points pass from one of these to the next.
CONTAINERS = frozenset("#root html body article main section div td center details fieldset".split())
#: An end tag of another kind does not reach beyond these.
WALLS = frozenset("table td th caption".split())
TABLE_PARTS = frozenset("table tbody thead tfoot tr td th caption".split())
#: A start tag of the key ends open elements of the values, up to the nearest element of STOP.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOP = frozenset("table ul ol dl select article section main body div".split())
#: Words of class, id or role that mark what is not the article.
BOILERPLATE = frozenset(
    "ad ads adsbygoogle adv advert advertisement advertising banner sponsor sponsored promo promoted promotion sidebar aside menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead comment comments discussion reactions guestbook talkback disqus respond reply replies cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations widget widgets toolbar pagination pager search skip copyright legal disclaimer".split()
)
#: Beside these, only words of STRONG mark boilerplate: ``post-alert`` may be the article, ``main-menu`` is not.
ARTICLE = frozenset("article main content post entry story body text".split())
STRONG = frozenset("ad ads adsbygoogle advert advertisement banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer header comment comments discussion reactions guestbook talkback disqus cookie share sharing related newsletter widget".split())
#: What a container has or lacks says nothing of what it is.
ABOUT = ("has-", "with-", "no-", "without-", "is-")


@dataclass(slots=True)
class Node:
    tag: str
    parent: Node | None
    dropped: bool
    look: str = ""
    depth: int = 0
    children: list = field(default_factory=list)  # nodes, and (text, is in a link) pairs
    score: float = 0.0
    own: float = 0.0  # points of the paragraphs that are directly in it
    chars: int = 0
    link_chars: int = 0


def _boilerplate(tag: str, attributes: str) -> bool:
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"):
            return True
        if name in ("class", "id"):
            for word in value.split():
                parts = {x.lower() for x in WORDS.findall(word)}
                if not word.lower().startswith(ABOUT) and (parts & STRONG or parts & BOILERPLATE and not parts & ARTICLE):
                    return True
    return False


class _Tree:
    """Open elements as a stack, with the places of each tag in it, so that every start and end tag looks in one place."""

    def __init__(self):
        self.root = Node("#root", None, False)
        self.stack = [self.root]
        self.places: dict[str, list[int]] = {}
        self.stops = [0]  # places of the elements that lists and paragraphs do not look beyond
        self.walls = [0]

    def open(self, tag: str, attributes: str) -> None:
        top = self.stack[-1]
        look = "".join(x for name, *values in ATTRIBUTE.findall(attributes) if name.lower() == "class" for x in values) if attributes else ""
        node = Node(tag, top, top.dropped or _boilerplate(tag, attributes), look, len(self.stack))
        top.children.append(node)
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in STOP:
            self.stops.append(len(self.stack))
        if tag in WALLS:
            self.walls.append(len(self.stack))
        self.stack.append(node)

    def at(self, tag: str) -> int:
        """Place of the innermost open element ``tag``; -1: none."""
        return self.places[tag][-1] if self.places.get(tag) else -1

    def close(self, place: int) -> None:
        """Close the element at ``place`` and all inside it."""
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()
            for marks in (self.stops, self.walls):
                if marks[-1] == len(self.stack) > 0:
                    marks.pop()

    def near(self, tag: str) -> int:
        """As ``at``, but not beyond the list, table or section that is open."""
        place, stop = self.at(tag), self.stops[-1]
        return place if place > stop or place == stop > 0 else -1


def parse(page: str) -> Node:
    """The tree of a page; broken mark-up (open paragraphs, unclosed inline elements, a cut end) is tolerated."""
    tree = _Tree()
    link = False
    at = 0
    while at < len(page):
        found = TOKEN.search(page, at)
        if found is None or found.start() > at:
            tree.stack[-1].children.append((page[at : found.start() if found else len(page)], link))
        if found is None:
            break
        at = found.end()
        closing, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            place = tree.near(tag) if tag == "p" else tree.at(tag)
            if tag == "a":
                link = False
            if place > 0 and (tag in TABLE_PARTS or place >= tree.walls[-1]):
                tree.close(place)
                link = link and tag not in BLOCKS
        elif tag == "br":
            tree.stack[-1].children.append((" ", False))
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else len(page)
        elif tag in VOID and tag != "hr":
            continue
        elif tag in BLOCKS:
            if (p := tree.near("p")) > 0:
                tree.close(p)
            for other in ENDS.get(tag, ()):
                if (place := tree.near(other)) > 0:
                    tree.close(place)
            link = False
            if tag != "hr":
                tree.open(tag, attributes)
        else:
            if tag == "a":
                if (place := tree.at("a")) > 0 and place >= tree.walls[-1]:
                    tree.close(place)
                link = True
            # Inline elements have no node, but for those that go and what may be taken for their end.
            if tag in INLINE_DROPPED and attributes.endswith("/"):
                continue
            if tag in INLINE_DROPPED or tree.at(tag) > 0 or attributes and _boilerplate(tag, attributes):
                tree.open(tag, attributes)
    return tree.root


def _clean(run: list[str]) -> str:
    """Character references decoded, white space turned into single spaces, trimmed."""
    text = "".join(run)
    return " ".join((html.unescape(text) if "&" in text else text).split())


def _own_blocks(node: Node) -> list[tuple[str, int]]:
    """Runs of text directly in ``node``, between its child blocks: text, and its characters inside links.

    The children become these texts and the child nodes, in page order. Inline elements that go do not end a run."""
    out, parts, run, linked = [], [], [], 0
    for child in [*node.children, None]:
        if isinstance(child, tuple):
            run.append(child[0])
            linked += len(child[0].strip()) if child[1] else 0
            continue
        if child is not None and child.tag not in BLOCKS:
            continue
        if run:
            if text := _clean(run):
                out.append((text, min(linked, len(text))))
                parts.append(text)
            run, linked = [], 0
        if child is not None:
            parts.append(child)
    node.children = parts
    return out


def _order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.dropped)
    return out


def _density(node: Node) -> float:
    return min(1.0, node.link_chars / max(1, node.chars))


def _final(node: Node) -> float:
    return node.score * (1 - _density(node))


def _box(node: Node | None) -> Node | None:
    """The nearest container, ``node`` included."""
    while node is not None and node.tag not in CONTAINERS:
        node = node.parent
    return node


def _prose(node: Node) -> bool:
    """A paragraph, heading, list or table, not a container; not mainly links."""
    return node.tag not in CONTAINERS and node.chars > 0 and _density(node) < 0.25


def _kept_beside(best: Node, top: Node) -> list[Node | str]:
    """What of the children of ``top`` is kept with ``best``, one of them, in page order."""
    limit = max(2.0, 0.2 * _final(best))
    said = best.tag in ("article", "main")  # the page says what is the article: only others like it are, too
    out: list[Node | str] = []
    for child in top.children:
        if isinstance(child, str):
            continue
        alike = child.tag == best.tag and child.look == best.look and child.own > 0 and _density(child) < 0.5
        if said and child.tag != best.tag:
            continue
        if child is best or not child.dropped and (_prose(child) or child.tag in CONTAINERS and _final(child) >= limit and child.own >= limit / 2 or alike and _final(child) >= limit / 4):
            out.append(child)
    return out


def main_text(page: str | None) -> str:
    """The blocks of the article, joined by line breaks; empty if there are none."""
    nodes = _order(parse(page or ""))
    scored = False
    for node in nodes:
        for text, linked in _own_blocks(node):
            node.chars += len(text)
            node.link_chars += linked
            points = (1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)) * (1 - min(1.0, linked / len(text)))
            above, level = _box(node.parent if node.tag == "td" else node), 1  # a cell is a container by its blocks only
            above.own += points
            while above is not None and level <= 5:
                above.score += points / level
                above, level = _box(above.parent), level + 1
            scored = True
    if not scored:
        return ""
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars
    boxes = [n for n in nodes if n.tag in CONTAINERS]
    best = max(boxes, key=lambda n: (round(_final(n), 9), n.depth))  # of equals the innermost, then the first
    article = best
    while article is not None and article.tag not in ("article", "main"):
        article = article.parent
    if article is not None:
        best = article
    else:
        # A wrapper that has only prose beside the best container is part of the article.
        while best.parent is not None and best.parent.tag in CONTAINERS - {"#root", "html", "body"} and all(isinstance(c, str) or c is best or c.dropped or not c.chars or _prose(c) for c in best.parent.children):
            best = best.parent
    kept = [best] if best.parent is None or best.parent.tag == "html" else _kept_beside(best, best.parent)
    return "\n".join(text for top in kept for text in _texts(top))


def _texts(top: Node) -> list[str]:
    """Texts of ``top`` in page order, without what is dropped and blocks inside it that are mainly links."""
    out: list[str] = []
    stack: list = [top]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
        elif node is top or not node.dropped and not _menu(node):
            stack.extend(reversed(node.children))
    return out


def _menu(node: Node) -> bool:
    """A list or container of three links or more and little else."""
    return node.tag in ("ul", "ol", "dl", "div", "section", "table") and node.chars > 0 and _density(node) > 0.8 and sum(isinstance(c, Node) for c in node.children) >= 3


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text of the HTML in ``column``.

    Null and empty pages, and pages without text, give an empty text. Pages are taken one by one and whole,
    so repeated rows get equal texts and an empty table no rows. A column ``text`` of the input is replaced.
    """
    return map_texts(pages, {"text": "string"}, lambda htmls: {"text": [main_text(h) for h in htmls]}, column=column, at_once=64)
