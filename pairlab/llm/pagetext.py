"""Blocks of text of one HTML page and the containers that they stand in.

A tolerant single pass over tags: it never fails, closes what HTML closes by
itself (paragraphs, list items, cells), ignores end tags without a start, and is
linear in the page, however deep it nests.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import xxhash

# Elements by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
CONTAINERS = frozenset("article main section div td center".split())
BLOCKS = CONTAINERS | frozenset(
    "address aside blockquote caption dd details dialog dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li menu nav ol p pre summary table tbody tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tag → the open elements that it ends, and the elements that shield them.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"}), "a": ({"a"}, {"td", "th"})}
CELLS = frozenset("td th caption".split())
TABLE = CELLS | frozenset("table thead tbody tfoot tr".split())
#: Never text of an article, whatever they hold.
NEVER = RAW | frozenset("noscript template svg canvas audio video object button select map".split())
#: Elements that count without attributes.
MATTERS = BLOCKS | NEVER | {"a", "option"}
#: Not text of an article unless the article stands inside.
ASIDE = frozenset("nav header footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words in class names and ids that say the same.
MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs consent cookie cookies footer gdpr header login masthead menu modal nav navbar
    navigation newsletter notice notices overlay pager pagination popup promo promotion recommended related search share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar""".split()
)
COMMENTS = frozenset("comment comments disqus respond replies".split())
#: Class names that state a property of their element and not its kind.
STATES = re.compile(r"^(has|no|with|without|is|js)[-_]|[-_](open|closed|enabled|disabled)$")

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAMED = re.compile(r"class|id\s*=|role|itemprop", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"[0-9]+")


class Kind(NamedTuple):
    """What a tag and its attributes say of an element."""

    block: bool
    container: bool
    name: str
    strong: bool
    comments: bool
    header: bool
    aside: bool
    never: bool


@lru_cache(maxsize=4096)
def kind(tag: str, attributes: str) -> Kind:
    named = _attributes(attributes) if attributes else {}
    classes = [c for c in f"{named.get('class', '')} {named.get('id', '')}".split() if not STATES.search(c)]
    marks = {w.lower() for c in classes for w in _WORDS.findall(c)}
    role = named.get("role", "").lower()
    strong = tag in ("article", "main") or role in ("main", "article") or "articlebody" in named.get("itemprop", "").lower()
    header = tag == "header" or "header" in marks or role == "banner"
    aside = header or tag in ASIDE or role in ROLES or (not strong and bool(marks & MARKS))
    name = _DIGITS.sub("0", ".".join([tag, *(named.get("class") or named.get("id") or "").lower().split()]))
    return Kind(tag in BLOCKS, tag in CONTAINERS, name, strong, bool(marks & COMMENTS), header, aside, tag in NEVER)


class Node:
    """An element; containers have the key of their generalised path."""

    __slots__ = ("parent", "tag", "kind", "link", "key", "depth", "holds_strong", "state", "prose", "plain", "noise")

    def __init__(self, parent: Node | None, tag: str, attributes: str):
        self.parent, self.tag = parent, tag
        self.kind = kind(tag, attributes if attributes and _NAMED.search(attributes) else "")
        self.prose = self.plain = self.noise = self.state = 0
        self.holds_strong = False
        if parent is None:
            self.link, self.depth, self.key = False, 0, 0
            return
        self.link = parent.link or tag == "a"
        self.depth, self.key = parent.depth, parent.key
        if self.kind.container:
            self.depth += 1
            self.key = xxhash.xxh64_intdigest(f"{self.key} {self.kind.name}", seed=12) >> 1


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_ATTRIBUTE.finditer(text)))}


def parse(html: str) -> tuple[list[Node], list[tuple[Node, list[tuple[Node, str]]]]]:
    """(nodes in page order, blocks): a block is its element and its pieces of text, each with the element it stands in."""
    root = Node(None, "body", "")
    nodes, stack, blocks, pieces = [root], [root], [], []
    at = 0

    def text(s: str) -> None:
        if s:
            pieces.append((stack[-1], unescape(s) if "&" in s else s))

    def flush() -> None:
        nonlocal pieces
        if pieces:
            owner = stack[-1]
            while not owner.kind.block and owner.parent:
                owner = owner.parent
            blocks.append((owner, pieces))
            pieces = []

    def close(tags, shields) -> bool:
        """End the innermost open element of these tags that no shield covers."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                if any(x.kind.block for x in stack[i:]):
                    flush()
                del stack[i:]
                return True
            if stack[i].tag in shields:
                return False
        return False

    while m := _TAG.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in ("html", "head", "body"):
            continue
        if m[1]:
            if tag == "br":
                text(" ")
            elif tag not in BLOCKS:
                close({tag}, BLOCKS)
            elif not close({tag}, {"table"} if tag in TABLE else CELLS):
                flush()
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in BLOCKS:
            flush()
            close({"p"}, CELLS)
        if tag in ENDS:
            close(*ENDS[tag])
        if tag in VOID or (not m[3] and tag not in MATTERS):  # plain inline elements change nothing
            continue
        node = Node(stack[-1], tag, m[3])
        nodes.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(html, at)
            at = end.end()
        elif not m[3].endswith("/") or tag not in ("svg", "path"):
            stack.append(node)
    text(html[at:])
    flush()
    return nodes, blocks


KEPT, HEADINGS_ONLY, GONE = 0, 1, 2


def _decide(nodes: list[Node]) -> None:
    """State of every node: boilerplate goes with all inside, unless the article stands inside; a header in an article keeps its headings."""
    for x in reversed(nodes):
        if x.parent and (x.holds_strong or x.kind.strong) and not x.kind.comments:
            x.parent.holds_strong = True
    inside = set()
    for x in nodes[1:]:
        k, own = x.kind, KEPT
        in_article = x.parent in inside
        if in_article or k.strong:
            inside.add(x)
        if k.never or (k.comments and x.tag != "main"):
            own = GONE
        elif k.aside and not k.strong and not x.holds_strong:
            own = HEADINGS_ONLY if k.header and in_article else GONE
        x.state = max(own, x.parent.state)


class Page:
    """A parsed page: its blocks of text without boilerplate, the path of its best container, and the text under a path."""

    def __init__(self, html: str):
        self.nodes, found = parse(html)
        _decide(self.nodes)
        self.blocks = []
        for owner, pieces in found:
            kept = [(x, s) for x, s in pieces if x.state == KEPT or (x.state == HEADINGS_ONLY and owner.tag in HEADINGS)]
            line = " ".join("".join(s for _, s in kept).split())
            if line:
                self.blocks.append((owner, line))
                self._weigh(owner, len(line), sum(len(s) for x, s in kept if x.link))
        for x in reversed(self.nodes[1:]):
            up = x.parent
            up.prose += x.prose
            up.plain += x.plain
            up.noise += x.noise

    @staticmethod
    def _weigh(owner: Node, size: int, linked: int) -> None:
        if linked * 2 > size:
            owner.noise += size
        elif size - linked >= 40:
            owner.prose += size
        else:
            owner.plain += size

    def best(self) -> tuple[int, int] | None:
        """(key, depth) of the best container: most prose, least text in links; articles count a quarter more, and of equals the deepest."""
        found = [((4 * x.prose + x.plain - 2 * x.noise) * (5 if x.kind.strong else 4), x.depth, -i) for i, x in enumerate(self.nodes) if (x.kind.container or not x.parent) and x.prose + x.plain + x.noise]
        if not found:
            return None
        x = self.nodes[-max(found)[2]]
        return x.key, x.depth

    def text(self, keys: list[int]) -> str:
        """Blocks under the first of these paths that has any, else under the page's best, in page order."""
        own = self.best()
        if own is None:
            return ""
        there = {x.key for x in self.nodes if x.prose + x.plain + x.noise}
        key = next((k for k in keys if k in there), own[0])
        under = {}
        for x in self.nodes:
            under[x] = x.key == key or (x.parent is not None and under[x.parent])
        return "\n".join(line for owner, line in self.blocks if under[owner])
