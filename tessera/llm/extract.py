"""Operator 6, main-text extraction by composite text density.

A page's elements form a tree. Elements that are no article by their tag, role
or class (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, reader comments) or that are hidden are cut off. Class words that page
wrappers carry as well (``has-sidebar`` on the column of the article, a form around
the whole page) say nothing on a page where the elements they would cut hold most of
the text in paragraphs: there they cut nothing. Every other node gets the composite
text density of its text: characters per tag, adjusted by how much of the text and
of the tags are links,

    C / T * log(C / LC * T / LT) / log(max(e, ln(C / nLC * LC + LCb / Cb * C + e))),

with C characters, T tags, LC and LT of them in links, nLC = C - LC, and b the
body's. A node's sum adds its children's densities (its own text counts as one
child). The node of the largest sum is the content; the smallest density on its
path to the body is the threshold. From the body down, every node at or over it
marks the maximum-sum node under it and, unless that is itself, its children and its
own text are tested in turn. All marked subtrees and texts, in page order, are the content.
Blocks beside them that are short rather than full of links belong to it too: those between
two marked ones, headings right before the first and paragraphs right after the last.

Defined cases: a null or empty page, or one without text, gives an empty text;
broken markup is read as far as it goes (an unclosed element ends with its
parent, a new paragraph closes an open one); repeated rows and null keys keep a
row each; empty tables give no rows; pages of any length are taken whole;
clashing extra columns are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shipping import ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose text joins the text around them; all others begin a block of their own.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt "
                   "ruby s samp small span strike strong sub sup time tt u var wbr".split())
# Formatting is no structure: these make no node (unless cut off), so bold text is no denser than plain.
FORMATTING = INLINE - {"a"}
SKIPPED_TAGS = frozenset("head script style noscript template title nav header footer aside button select "
                         "textarea input option label legend iframe object svg canvas audio video menu dialog".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form".split())
# Words of a class or id that mark what is not the article, wherever they stand ...
SKIPPED_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr popup modal "
    "comment comments reply replies respond disqus".split())
# ... and those that page wrappers carry as well.
LAYOUT_WORDS = frozenset(
    "promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs notice banner newsletter subscribe "
    "share sharing social related recommended footer header masthead toolbar widget pagination pager login "
    "signup".split())
# Names that say what a page has around it, not what the element is.
STATE = re.compile(r"(?:has|with|without|no|hide|show|is)[-_].*|.*[-_](?:open|closed|enabled|disabled)")
HIDDEN_STYLE = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
WRAPPER_BLOCKS, WRAPPER_SHARE = 3, 4      # paragraphs in wrappers; their text against all other text
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KEPT_TAGS = frozenset(("html", "body", "main", "article"))       # never cut off for a class
CLOSES = {                                                        # a start tag ends these open ones
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",),
}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main "
                   "nav ol p pre section table ul".split())
SCOPE = frozenset("html body table td th ul ol dl article section div aside nav header footer main form".split())
_WORD = re.compile(r"[a-z0-9]+")


class Node:
    __slots__ = ("children", "chars", "density", "link_chars", "link_tags", "own", "parent", "parts",
                 "skip", "sum", "sure", "tag", "tags", "word")

    def __init__(self, tag: str, parent: Node | None, skip: bool):
        self.tag, self.parent, self.skip = tag, parent, skip
        self.sure, self.word = False, None     # cut for certain; the layout word that cuts
        self.parts: list[Node | str] = []      # children and texts in page order
        self.children: list[Node] = []
        self.own = 0                           # characters of texts directly inside
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def _skipped(tag: str, attrs: list[tuple[str, str | None]]) -> bool | str:
    """Whether an element is cut off; the layout word, if only that cuts it."""
    if tag in SKIPPED_TAGS:
        return True
    if tag in ("html", "body"):
        return False
    word: bool | str = "form" if tag == "form" else False
    for name, value in attrs:
        value = (value or "").lower()
        if name == "hidden" and value != "until-found" or name == "style" and HIDDEN_STYLE.search(value):
            return True
        if tag in KEPT_TAGS:
            continue
        if name == "role" and value in SKIPPED_ROLES and (value != "form" or tag != "form"):
            return True
        if name in ("class", "id"):
            words = {w for x in value.split() if not STATE.fullmatch(x) for w in _WORD.findall(x)}
            if not SKIPPED_WORDS.isdisjoint(words):
                return True
            if not LAYOUT_WORDS.isdisjoint(words):
                word = min(words & LAYOUT_WORDS)
    return word


class _Builder(HTMLParser):
    def __init__(self, ignored: frozenset[str] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None, False)
        self.ignored = ignored                 # layout words that cut nothing on this page
        self.held: dict[str, list[int]] = {}   # characters and paragraphs that only a layout word cuts off
        self.rest = 0                          # characters not cut off

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and self.at.skip:
            self._pop_to("head")
        if tag == "html":
            return
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPE - {"tr", "td", "th", "li"} if tag != "li" else SCOPE)
        if tag in ENDS_P:
            self._close(("p",), SCOPE)
        found = _skipped(tag, attrs)
        if found in self.ignored:
            found = False
        skip = self.at.skip or bool(found)
        if tag in FORMATTING and not skip:
            return
        if tag == "br":
            self.at.parts.append(" ")
            return
        node = Node(tag, self.at, skip)
        node.sure = self.at.sure or found is True
        node.word = self.at.word or (found if isinstance(found, str) else None)
        self.at.children.append(node)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and tag not in ("html",):
            self.at = self.at.parent

    def handle_endtag(self, tag):
        if tag in VOID or tag in ("html", "body"):
            return
        self._pop_to(tag)

    def handle_data(self, data):
        at = self.at
        n = len(data) - sum(map(data.count, " \n\t\r\f"))
        if not at.skip:
            at.parts.append(data)
            at.own += n
            self.rest += n
        elif n and not at.sure:
            held = self.held.setdefault(at.word, [0, 0])
            held[0] += n
            held[1] += at.tag == "p" or at.tag in HEADINGS

    def _pop_to(self, tag: str) -> None:
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def _close(self, tags: tuple[str, ...], scope: frozenset) -> None:
        node = self.at
        while node.parent is not None and node.tag not in tags:
            if node.tag in scope:
                return
            node = node.parent
        if node.tag in tags and node.parent is not None:
            self.at = node.parent


def parse(html: str) -> Node:
    """Tree of a page. Layout words whose elements hold most of the text are ignored."""
    ignored: frozenset[str] = frozenset()
    while True:
        b = _Builder(ignored)
        b.feed(html)
        b.close()
        wrappers = {w for w, (chars, blocks) in b.held.items()
                    if blocks >= WRAPPER_BLOCKS and chars > WRAPPER_SHARE * b.rest}
        if not wrappers:
            return b.root
        ignored |= wrappers


def _order(root: Node) -> list[Node]:
    """Nodes that are not cut off, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if not node.skip:
            out.append(node)
            stack.extend(reversed(node.children))
    return out


def _measure(nodes: list[Node], body: Node) -> float:
    """Fills in densities and sums; the body's share of link characters."""
    for node in reversed(nodes):
        link = node.tag == "a"
        node.chars += node.own
        if link:
            node.link_chars, node.link_tags = node.chars, node.tags
        if node.parent is not None:
            p = node.parent
            p.chars += node.chars
            p.tags += node.tags + 1
            p.link_chars += node.link_chars
            p.link_tags += node.link_tags + link
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        node.density = _density(node.chars, node.tags, node.link_chars, node.link_tags, share)
    for node in nodes:
        node.sum = sum(c.density for c in node.children if not c.skip)
        if node.own:
            node.sum += _density(node.own, 1, 0, 0, share)
    return share


def _density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    if not chars:
        return 0.0
    tags, plain = max(1, tags), max(1, chars - link_chars)
    # the logarithm's base is at least e; the first ratio grows as links shrink
    base = max(math.e, math.log(chars / plain * link_chars + share * chars + math.e))
    ratio = chars / max(1, link_chars) * tags / max(1, link_tags)
    return chars / tags * max(0.0, math.log(ratio)) / math.log(base)


def _bests(nodes: list[Node]) -> dict[Node, Node]:
    """Of every node, the node of the largest sum under it (the first on ties)."""
    best: dict[Node, Node] = {}
    for node in reversed(nodes):
        best[node] = node
        for c in node.children:
            if not c.skip and best[c].sum > best[node].sum:
                best[node] = best[c]
    return best


def content(root: Node) -> list[Node | str]:
    """Content subtrees, and texts beside them, in page order."""
    nodes = _order(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    share = _measure(nodes, body)
    bests = _bests(nodes)
    best = bests[body]
    if not best.sum or best is body:
        return [body]
    limit, node = best.density, best
    while node is not body and node.parent is not None:
        limit = min(limit, node.density)
        node = node.parent
    limit -= 1e-9
    marked, entered, todo = {best}, {body}, [body]
    while todo:
        for c in todo.pop().children:
            if not c.skip and c.chars and c.density >= limit:
                marked.add(bests[c])
                if bests[c] is not c:
                    entered.add(c)
                    todo.append(c)
    _beside(marked, entered)
    out: list[Node | str] = []
    stack: list[tuple[Node | str, bool]] = [(body, False)]      # a part, and whether the text around it counts
    while stack:
        x, text = stack.pop()
        if isinstance(x, str):
            out.append(x if text else " ")
        elif x in marked or text and x.tag in INLINE:
            out.append(x)
        elif not x.skip:
            # its own text is one more child
            counts = x in entered and _density(x.own, 1, 0, 0, share) >= limit
            out.append(" ")
            stack.append((" ", True))
            stack.extend((p, counts) for p in reversed(x.parts))
        else:
            out.append(" ")
    return out


def _beside(marked: set[Node], entered: set[Node]) -> None:
    """Marks the short blocks beside marked ones."""
    holds = set(marked)
    for node in marked:
        while node.parent is not None and node.parent not in holds:
            node = node.parent
            holds.add(node)

    def plain(c: Node) -> bool:
        return 2 * c.link_chars <= c.chars and c not in holds

    for x in entered:
        shown = [c for c in x.children if not c.skip and c.chars]
        at = [i for i, c in enumerate(shown) if c in holds]
        if not at:
            continue
        marked.update(filter(plain, shown[at[0]:at[-1]]))
        for c in reversed(shown[:at[0]]):
            if not (plain(c) and _heading(c)):
                break
            marked.add(c)
        for c in shown[at[-1] + 1:]:
            if not (plain(c) and c.tag == "p"):
                break
            marked.add(c)


def _heading(node: Node) -> bool:
    """Whether all text of a node stands in one heading."""
    while node.tag not in HEADINGS:
        shown = [c for c in node.children if not c.skip and c.chars]
        if node.own or len(shown) != 1:
            return False
        node = shown[0]
    return True


def _text(parts: list[Node | str]) -> str:
    out: list[str] = []
    stack: list[Node | str] = list(reversed(parts))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.skip:
            edge = x.tag not in INLINE
            if edge:
                out.append(" ")
                stack.append(" ")
            stack.extend(reversed(x.parts))
        elif x.tag not in INLINE:
            out.append(" ")
    return " ".join("".join(out).split())


def main_text(html: str | None) -> str:
    """Main text of one page."""
    if not html:
        return ""
    return _text(content(parse(html)))


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` without the html column, with ``text`` and ``n_chars`` added."""
    ship(pages.sparkSession)
    names = pages.columns
    keep = [c for c in names if c not in (html, text, "n_chars")]
    base = pages.select(*keep, F.col(html).alias(html))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 256):
                part = b.slice(lo, 256)
                texts = [main_text(h.as_py()) for h in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    [*keep, text, "n_chars"])

    schema = base.select(*keep, F.lit("").alias(text), F.lit(0).cast("bigint").alias("n_chars")).schema
    return base.mapInArrow(run, schema)
