"""Main text of web pages by composite text density of DOM nodes.

A page becomes a tree of elements (unclosed and stray tags as browsers take them). Elements that
never hold article text (scripts, styles, buttons, fields, hidden ones) are left out. Elements whose
tag, class, id or role names a part beside the article (menus, headers and footers of the page, sidebars,
notices, adverts, forms, comments of readers) are left out if their share of the page agrees: a
frame around an article stays, and so does an element that holds nearly all text there is, or, where
the name is only part of a longer one ("has-sidebar"), most of it without being links. If nothing
is left, classes, ids and roles do not count.

For every node the composite density is its characters per
tag, lowered by the share of characters and tags in links; a node's density sum adds
up the densities of its children. The node of the largest sum is the core of the
article; it is widened to the highest ancestor below the body whose density is not
less than the body's, which takes in headings and short paragraphs beside the core. Articles that
stand beside the core's own are taken too if their density is not less than the body's.

The text of that subtree has character references decoded, white space inside a block
turned into one space, blocks trimmed and joined by one space. Null and empty html, and
pages without text, give an empty text. Repeated pages give one row each; null ids and urls stay. Other
columns are not read, whatever their names. One page is handled at a time, so memory is bounded by
the largest page; the time is in proportion to its length, also where tags and quotes are never closed.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from kredenz.llm.batches import slices

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
SCOPE = frozenset("table td th caption button object marquee html body article section main div".split())

#: Elements that never hold article text, and those that name a part beside it; header only outside an article.
OUTSIDE = frozenset(
    "script style noscript template head title iframe noembed noframes xmp button select option "
    "textarea input svg math canvas audio video object".split()
)
BESIDE = frozenset("nav footer aside form menu dialog".split())
#: Words of class, id and role values that name a part beside the article.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner banners menu menus "
    "nav navbar navigation navigationbar breadcrumb breadcrumbs sidebar sidebars aside complementary related recommended "
    "footer footnav masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login comment comments commentlist respond replies reply discussion disqus share sharing "
    "social widget widgets pagination pager skip search contentinfo".split()
)
ARTICLES = frozenset(("article", "main"))
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
#: Attributes up to the end of a tag, by which kinds of quotes still close somewhere.
ATTRIBUTES = {
    quotes: re.compile("(?:" + "|".join([f"[^>{quotes}]++", *(f"{q}[^{q}]*+{q}" for q in quotes)]) + ")*+")
    for quotes in ("\"'", '"', "'", "")
}
ROLE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


class Node:
    """An element: its tag, the nodes and texts in it, and how surely it is beside the article."""

    __slots__ = ("tag", "up", "parts", "outside", "named", "frame", "mass", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, up: "Node | None", named: int = 0, outside: bool = False):
        self.tag, self.up, self.named, self.outside = tag, up, named, outside
        self.frame, self.mass = False, (0, 0)
        self.parts: list = []


WEAK, STRONG = 1, 2
NEVER = (BESIDE | {"header"}) - {"form", "dialog"}  # elements by their own meaning, whatever they hold


def beside(tag: str, attributes: str, inside_article: bool) -> int:
    """How surely names tell that an element is beside the article."""
    if tag in BESIDE or (tag == "header" and not inside_article):
        return WEAK if tag == "form" else STRONG  # whole pages stand in forms
    if tag in ("html", "body", "main") or not attributes:
        return 0
    found = 0
    for m in ROLE.finditer(attributes):
        value = m[1] or m[2] or m[3] or ""
        for name in value.split():
            if name.lower() in ASIDE_WORDS:
                return STRONG
            # an article is named by whole words only: "has-comments" still is one
            if tag != "article" and not ASIDE_WORDS.isdisjoint(SPLIT.split(CAMEL.sub("-", name).lower())):
                found = WEAK
    return found


class Tags:
    """Reads a page's markup once from left to right."""

    def __init__(self, page: str):
        self.page, self.quotes, self.last = page, "\"'", page.rfind(">")

    def next(self, at: int) -> tuple[int, int, str, str, str]:
        """``begin, end, slash, tag, attributes`` of the next markup at or after ``at``; no tag for comments and the like."""
        page, size = self.page, len(self.page)
        while True:
            begin = page.find("<", at)
            if begin < 0 or begin > self.last and not page.startswith("<!--", begin):
                return size, size, "", "", ""
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 4)
                return begin, size if end < 0 else end + 3, "", "", ""
            if page.startswith(("<!", "<?"), begin):
                return begin, page.find(">", begin) + 1, "", "", ""
            named = NAME.match(page, begin + 1)
            if named:
                end = ATTRIBUTES[self.quotes].match(page, named.end()).end()
                while end < size and page[end] != ">":  # a quote that closes nowhere is a sign like any other
                    self.quotes = self.quotes.replace(page[end], "")
                    end = ATTRIBUTES[self.quotes].match(page, named.end()).end()
                if end < size:
                    return begin, end + 1, named[1], named[2].lower(), page[named.end() : end]
                self.quotes = ""  # quoted to the very end: from here on a tag ends where its first bracket closes
            at = begin + 1


def tree(page: str) -> Node:
    """The page's elements, with ends of elements as browsers imply them."""
    root = here = Node("#root", None)
    open_: Counter[str] = Counter()
    body: Node | None = None
    tags = Tags(page)
    position, size = 0, len(page)

    def leave(node: Node) -> Node:
        """Close ``node`` and all in it."""
        inner = here
        while inner is not node.up:
            open_[inner.tag] -= 1
            inner = inner.up
        return node.up

    while position < size:
        stop, end, slash, tag, attributes = tags.next(position)
        if stop > position:
            here.parts.append(page[position:stop])
        position = end
        if not tag:
            continue
        if slash:
            if open_[tag] > 0:
                node = here
                while node.tag != tag:
                    node = node.up
                here = leave(node)
            elif tag == "p":
                here.parts.append(Node("p", here))
            continue
        if tag in CLOSES_P:
            node = here
            while open_["p"] > 0 and node.up is not None and node.tag != "p" and node.tag not in SCOPE:
                node = node.up
            if node.tag == "p":
                here = leave(node)
        elif tag in SIBLINGS and any(open_[t] > 0 for t in SIBLINGS[tag][0]):
            same, limits = SIBLINGS[tag]
            node, last = here, None
            while node.up is not None and node.tag not in limits:
                last = node if node.tag in same else last
                node = node.up
            if last is not None:
                here = leave(last)
        if tag == "body":
            body = body or find(root, "body")
            if body:
                while here is not body and here.up is not None:
                    open_[here.tag] -= 1
                    here = here.up
                if here is not body:
                    open_["body"] += 1
                here = body
                continue
        inside = open_["article"] + open_["main"] > 0
        hidden = tag in OUTSIDE or tag not in ("html", "body", "main") and bool(HIDDEN.search(attributes))
        node = Node(tag, here, beside(tag, attributes, inside), hidden)
        if tag in ARTICLES and not node.named and not hidden:
            frame = here
            while frame.up is not None and not frame.frame:
                frame.frame, frame = True, frame.up
        here.parts.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*+>", re.I).search(page, position)
            position = close.end() if close else size
        elif tag not in VOID:
            here = node
            open_[tag] += 1
    return root


def leave_out(body: Node) -> None:
    """Mark the parts beside the article: names propose, shares of the text decide."""
    nodes = in_order(body)
    for node in reversed(nodes):  # characters, and characters in links
        inner = [x for x in node.parts if isinstance(x, Node) and not x.outside]
        chars = sum(len("".join(x.split())) for x in node.parts if isinstance(x, str)) + sum(x.mass[0] for x in inner)
        node.mass = chars, chars if node.tag == "a" else sum(x.mass[1] for x in inner)
    total = body.mass[0]
    for node in nodes[1:]:
        chars, linked = node.mass
        if not node.named:
            continue
        if node.tag in NEVER:
            node.outside = not node.frame or 2 * chars <= total
        elif not node.frame:
            rest = 0.9 if node.named == STRONG else 0.5  # what it must hold to stay against its name
            node.outside = 2 * linked > chars or chars <= rest * total


def find(root: Node, tag: str) -> Node | None:
    """The element of that tag among the outermost two levels."""
    for node in root.parts:
        if isinstance(node, Node):
            if node.tag == tag:
                return node
            if node.tag == "html" and (inner := find(node, tag)):
                return inner
    return None


def in_order(root: Node, every: bool = False) -> list[Node]:
    """All nodes that are not outside (or all that there are), parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [x for x in reversed(node.parts) if isinstance(x, Node) and (every or not x.outside)]
    return out


def measure(nodes: list[Node]) -> None:
    """Counts, composite densities and density sums, children before parents."""
    body = nodes[0]
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len("".join(part.split()))
            elif not part.outside:
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags + (part.tag == "a")
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags
    share = body.link_chars / max(body.chars, 1)
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, max(node.link_tags, 1)
        if c:
            plain = max(c - lc, 1)
            base = math.log(c / plain * lc + share * c + math.e)
            node.density = c / t * max(math.log(max(c / max(lc, 1) * t / lt, 1.0)) / base, 0.0)
        else:
            node.density = 0.0
        node.sum = sum(x.density for x in node.parts if isinstance(x, Node) and not x.outside)


def cores(root: Node) -> list[Node]:
    """The subtrees that hold the article, in page order."""
    body = find(root, "body") or root
    leave_out(body)
    nodes = in_order(body)
    measure(nodes)
    if not body.chars:  # names left nothing
        for node in in_order(body, every=True):
            node.outside = node.outside and (not node.named or node.tag in NEVER or 2 * node.mass[1] > node.mass[0])
        nodes = in_order(body)
        measure(nodes)
    blocks = [n for n in nodes if n.tag not in INLINE]
    best = max(blocks, key=lambda n: n.sum)  # the first of equals: the outermost
    if best.sum <= 0:
        return [body]
    path, node = [], best
    while node is not body:
        path.append(node)
        node = node.up
    wide = best
    for node in path:
        if node.density >= body.density:
            wide = node
    own = wide
    while own is not body and own.tag != "article":
        own = own.up
    if own is body:
        return [wide]
    beside_it = [x for x in own.up.parts if isinstance(x, Node) and x.tag == "article" and not x.outside]
    return [wide if x is own else x for x in beside_it if x is own or x.density >= body.density]


def text_of(top: Node) -> str:
    """Text of a subtree: blocks in page order, white space as single spaces."""
    blocks, now = [], []

    def close() -> None:
        if line := " ".join(html.unescape("".join(now)).split()):
            blocks.append(line)
        now.clear()

    todo: list = [top]
    while todo:
        item = todo.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            now.append(item)
        elif item.tag == "br":
            now.append(" ")
        elif item.tag in INLINE:
            todo += reversed([x for x in item.parts if isinstance(x, str) or not x.outside])
        else:
            close()
            todo.append(None)
            todo += reversed([x for x in item.parts if isinstance(x, str) or not x.outside])
    close()
    return " ".join(blocks)


def main_text(page: str | None) -> str:
    """Main text of one page."""
    return " ".join(filter(None, map(text_of, cores(tree(page))))) if page else ""


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                found = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("page_id").cast(pa.int64()),
                        part.column("url").cast(pa.string()),
                        pa.array(found, pa.string()),
                        pa.array([len(x) for x in found], pa.int64()),
                    ],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)
