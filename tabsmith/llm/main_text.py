"""Main-text extraction from HTML by tree scoring.

A page is parsed into a small tree (implied end tags, unclosed and stray tags allowed).  Subtrees that
are never article text (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
reader comments) are left out by tag, role and the words of class and id.  Every paragraph gives points
for its length and commas to its ancestors, less with each level; an ancestor's sum is discounted
by its link density.  The best container is kept, or the outermost ``article`` or ``main`` element around it, with its
siblings that score well or read like text.  Class and id words count by whole names.

The text comes out block by block: character references decoded, white space of a block
turned into one blank, blocks joined by a line end.

Defined results: a null or empty page has the empty text; a page without markup is one block; a
page of any length is read whole; rows are independent, so repeated rows and other columns need no care.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Fixed values of HTML: elements without an end tag, elements whose content is not markup, block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# A start tag of the first closes an open element of the second, up to an element of the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
NEVER_TAGS = frozenset(
    "head script style noscript template nav header footer aside form button select textarea input label iframe svg canvas "
    "object embed audio video dialog menu".split()
)
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Words of class and id names: what stands beside an article, what is set into one, and words that say nothing.
BESIDE_WORDS = frozenset(
    "banner overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side footer foot header masthead topbar related recommended "
    "recommendations login signup search pagination pager toolbar skip widget widgets form forms".split()
)
INSET_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent notice notices alert alerts popup "
    "popups modal modals comment comments commentlist disqus reply replies respond discussion share sharing social newsletter subscribe "
    "subscription".split()
)
PLAIN_WORDS = frozenset(
    "the site page main top bottom left right list item items box block wrapper wrap container area section bar links link group inner outer "
    "content global primary secondary sticky fixed mobile desktop thread tree unit slot".split()
)
TEXT_TAGS = frozenset("p pre blockquote li dd dt td th h1 h2 h3 h4 h5 h6".split())
ARTICLE_NAMES = frozenset("article articlebody post entry story content main".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)|[^<]+|<", re.S)
STOP = re.compile("[>\"']")
MAX_DEPTH = 512  # deeper elements stay siblings, as in browsers
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SIBLINGS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd div section article main body".split())


def _unlikely(name: str, tag: str) -> bool:
    """Whether a whole name says that an element is no article text: "ad", "site-footer" or "comment-list", not "related-work"."""
    words = set(re.split("[-_]+", name)) - {""}
    telling = words & (INSET_WORDS if tag in TEXT_TAGS else INSET_WORDS | BESIDE_WORDS)
    return bool(telling) and words - telling <= PLAIN_WORDS


class Node:
    __slots__ = ("tag", "parent", "children", "never", "named", "score", "chars", "link_chars")

    def __init__(self, tag: str, parent: Node | None, attrs: str):
        self.tag, self.parent, self.children = tag, parent, []  # children: nodes and strings in page order
        self.never, self.named = tag in NEVER_TAGS, tag in ("article", "main")
        self.score = 0.0
        self.chars = self.link_chars = 0
        if attrs and tag not in ("html", "body"):
            found = {k.lower(): unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(attrs)}
            role = found.get("role", "").lower()
            names = f"{found.get('class', '')} {found.get('id', '')}".split()
            unlikely = any(_unlikely(n.lower(), tag) for n in names) and ARTICLE_NAMES.isdisjoint(n.lower() for n in names)
            self.named = (self.named or role == "article") and not unlikely
            self.named = self.named or role == "main" or found.get("itemprop", "").lower() == "articlebody"
            hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""))
            if hidden or not self.named and (role in NEVER_ROLES or unlikely):
                self.never = True


class TagEnds:
    """Where tags end: the first ">" outside quotes.  Every place is passed once in vain at most, so broken pages take linear time."""

    def __init__(self, page: str):
        self.page = page
        self.vain: set[int] = set()  # places outside quotes from which no end follows
        self.lost: set[str] = set()  # characters that do not come again

    def find(self, pos: int) -> int:
        passed = []
        while True:
            m = STOP.search(self.page, pos) if ">" not in self.lost else None
            if m is None or m.start() in self.vain:
                break
            if m[0] == ">":
                return m.end()
            passed.append(m.start())
            end = -1 if m[0] in self.lost else self.page.find(m[0], m.end())
            if end < 0:
                self.lost.add(m[0])
                break
            pos = end + 1
        if m is None:
            self.lost.add(">")
        self.vain.update(passed)
        return -1


def parse(page: str) -> Node:
    root = at = Node("#root", None, "")
    depth, pos, size = 0, 0, len(page)
    ends = TagEnds(page)
    opened: Counter[str] = Counter()

    def leave(node: Node) -> Node:
        """Close all elements up to and with ``node``."""
        nonlocal depth
        inner = at
        while inner is not node.parent:
            opened[inner.tag] -= 1
            inner, depth = inner.parent, depth - 1
        return inner

    while pos < size:
        m = TOKEN.match(page, pos)
        begin, pos = m.end(), m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if not (text.startswith("<") and len(text) > 1):
                at.children.append(unescape(text))
            continue
        pos = ends.find(begin)
        if pos < 0:  # no tag, but a sign
            pos = m.start() + 1
            at.children.append("<")
            continue
        attrs = page[begin : pos - 1]
        tag = tag.lower()
        if m[1]:
            if opened[tag] > 0:
                node = at
                while node.tag != tag:
                    node = node.parent
                at = leave(node)
            continue
        closes = IMPLIED.get(tag) or (({"p"}, {"td", "th", "table", "button", "object"}) if tag in BLOCK else None)
        if closes and any(opened[c] > 0 for c in closes[0]):
            node, stop = at, None
            while node is not root and node.tag not in closes[1]:
                if node.tag in closes[0]:
                    stop = node
                    if tag not in ("tr",):
                        break
                node = node.parent
            if stop:
                at = leave(stop)
        node = Node(tag, at, attrs)
        at.children.append(node)
        if tag in RAW:  # its content runs to the matching end tag, whatever it holds
            end = re.compile(f"</{re.escape(tag)}", re.I).search(page, pos)
            after = page.find(">", end.end()) + 1 if end else 0
            if tag in ("textarea", "title", "xmp"):
                node.children.append(unescape(page[pos : end.start() if after else size]))
            pos = after or size
        elif tag not in VOID and not attrs.endswith("/") or tag in BLOCK and tag != "hr":
            if depth < MAX_DEPTH:
                at, depth = node, depth + 1
                opened[tag] += 1
    return root


def _walk(root: Node) -> Iterator[Node]:
    """Nodes in page order without the subtrees that are never text."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.never)


def _score(root: Node) -> list[Node]:
    order = list(_walk(root))
    own: dict[int, str] = {}
    for node in reversed(order):  # children before parents: lengths and link lengths
        words = " ".join("".join(c if isinstance(c, str) else " " for c in node.children).split())
        own[id(node)] = words
        node.chars += len(words)
        if node.tag == "a":
            node.link_chars = node.chars
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars
    for node in order:
        if node.tag not in PARAGRAPHS:
            continue
        inline = [own[id(node)]]  # the paragraph's text: its own and that of inline elements below it
        stack = [c for c in node.children if isinstance(c, Node) and not c.never and c.tag not in BLOCK]
        while stack:
            child = stack.pop()
            inline.append(own[id(child)])
            stack.extend(c for c in child.children if isinstance(c, Node) and not c.never and c.tag not in BLOCK)
        text = " ".join(x for x in inline if x)
        if not text:
            continue
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        level, up = 1, node.parent if node.tag not in ("div", "section", "article", "main", "body") else node
        while up is not None and level <= 5:
            up.score += points / (1 if level == 1 else 2 if level == 2 else 3 * (level - 1))
            level, up = level + 1, up.parent
    for node in order:
        node.score *= 1 - (node.link_chars / node.chars if node.chars else 0)
    return order


def _containers(root: Node) -> list[Node]:
    order = _score(root)
    best = max(order, key=lambda n: n.score)  # the first in page order on a tie
    container, node = best, best
    while node is not None:  # the outermost article or main element around it speaks for all it holds
        if node.named:
            container = node
        node = node.parent
    if not container.named and (best.score <= 0 or best.tag in ("#root", "html", "body")):
        return [best if best.score > 0 else root]
    if container.parent is None:
        return [container]
    least = max(10.0, best.score * 0.2)
    beside = container.parent.tag in ("body", "html", "#root")  # at the top of a page stands much else
    out = []
    for c in container.parent.children:
        if c is container:
            out.append(c)
        elif isinstance(c, Node) and not c.never and c.chars:
            low = c.link_chars < 0.25 * c.chars
            if c.named or c.score >= least or low and (c.tag in SIBLINGS and not container.named or not beside):
                out.append(c)
    return out


def _blocks(containers: list[Node]) -> list[str]:
    blocks: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = " ".join("".join(run).split())
        if text:
            blocks.append(text)
        run.clear()

    stack: list = list(reversed(containers))
    while stack:
        c = stack.pop()
        if c is None:
            close()
        elif isinstance(c, str):
            run.append(c)
        elif c.never and c not in containers:
            run.append(" ")
        elif c.tag == "br":
            run.append(" ")
        else:
            block = c.tag in BLOCK
            if block:
                close()
                stack.append(None)
            stack.extend(reversed(c.children))
    close()
    return blocks


def main_text(page: str | None) -> str:
    return "\n".join(_blocks(_containers(parse(page)))) if page else ""


def main_text_column(html: Column) -> Column:
    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p) for p in batch.tolist()], dtype=object)

    return extract(html)


def page_report(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, its main text and the text's code points."""
    small_batches(pages.sparkSession)
    found = pages.select("page_id", "url", main_text_column(F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
