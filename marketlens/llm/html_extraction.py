"""The main text of web pages by composite text density.

A page becomes a tree of its block elements; inline elements count as tags of
their block. Elements that are not text of the article whatever their density
(scripts, menus, adverts, forms, reader comments and so on, told by their tag,
role, class or id) leave the tree. Every node then has its composite density:
characters a tag, raised or lowered by how much of both belongs to links, against
the share of link characters in the whole body. The densities of a node's
children add up to its density sum, and the node of the greatest sum is the heart
of the article. The smallest density on the path from it up to the body is the
threshold: each node that reaches it marks the node of the greatest sum below it.

The article is the smallest subtree that holds the heart and all marks of the
same part of the body, so that a heading or a short paragraph between them stays,
together with the marks elsewhere. Inside, only unmarked containers below the
threshold that consist of links are left out: menus without a name.

Parsing is one pass, and all passes over the tree are loops over its nodes in
page order: depth costs no recursion.

Defined cases: a null or empty html, or one without text, has the empty text;
unclosed, crossed and unknown tags are taken as browsers take them, as far as
text goes; repeated page_ids are rows of their own; an empty table gives no rows;
further columns of the table are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from marketlens.llm.common import slices

SCHEMA = "page_id long, url string, text string, n_chars long"

# Names of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary"
    " table tbody td tfoot th thead title tr ul xmp".split()
)
HEAD_ONLY = set("base link meta noscript script style template title".split())
# Start tags that end an open element of the second kind, as long as none of the third lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
}
P_SCOPE = {"td", "th", "caption", "table", "button", "object", "html"}

# What is never text of the article, by element, role, and word of a class or id.
NEVER = set("script style noscript template head title iframe object embed applet svg canvas audio video map select datalist textarea button input".split())
FURNITURE = set("nav footer aside form menu dialog fieldset search header".split())
ROLES = set(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status tablist".split()
)
REMARK_ROLES = set("alert alertdialog dialog status".split())
REMARKS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promos promotion"
    " promoted comment comments commentlist disqus respond responses replies cookie cookies consent gdpr notice notices notification"
    " notifications alert modal popup overlay toast newsletter subscribe subscription paywall".split()
)
LAYOUT = set(
    "sidebar side rail menu menus nav navbar navigation topnav subnav breadcrumb breadcrumbs crumbs header masthead banner footer colophon"
    " copyright signup login share sharing social related recommended recommendations widget widgets toolbar pagination pager"
    " dropdown hidden skip sr".split()
)
TITLES = {"header", "masthead", "banner"}
# Names of layout that also mean something within a line of text.
INLINE = set("share sharing social menu nav breadcrumb breadcrumbs pagination hidden skip sr".split())
# A name with one of these words tells a state (comments-open, has-sidebar, ad-free), not what the element is.
STATES = set("no non not without free has with open closed enabled disabled on off".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
MENU_TAGS = set("ul ol dl div section table tbody tr td menu".split())

WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
MENU_LINKS, MENU_SHARE = 3, 2 / 3


class Node:
    """A block element, or the inline run of text between two of them (tag '')."""

    __slots__ = ("tag", "parent", "words", "role", "hidden", "text", "chars", "tags", "link_chars", "link_tags", "pruned", "density", "total", "best", "last", "marked")

    def __init__(self, tag: str, parent: int, attributes: dict[str, str | None]):
        self.tag, self.parent = tag, parent
        self.words = [[w.lower() for w in WORD.findall(name)] for key in ("class", "id") for name in (attributes.get(key) or "").split()]
        self.role = (attributes.get("role") or "").lower()
        self.hidden = "hidden" in attributes or bool(INVISIBLE.search(attributes.get("style") or ""))
        self.text: list[str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.pruned = self.marked = False
        self.density = self.total = 0.0
        self.best = self.last = -1


class Tree(HTMLParser):
    """Nodes of a page in page order; node 0 holds all others."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("", -1, {})]
        # Open elements: name, its node or, of an inline one, -1; of inline ones also whether they belong to no article.
        self.open: list[tuple[str, int, bool]] = [("", 0, False)]
        self.counts: dict[str, int] = {}
        self.block, self.run, self.links, self.muted = 0, -1, 0, 0
        self.feed(html)
        self.close()

    def _run(self) -> Node:
        if self.run < 0:
            self.run = len(self.nodes)
            self.nodes.append(Node("", self.block, {}))
            self.nodes[-1].tags = 1
        return self.nodes[self.run]

    def _push(self, tag: str, node: int, muted: bool) -> None:
        self.open.append((tag, node, muted))
        self.counts[tag] = self.counts.get(tag, 0) + 1
        self.links += tag == "a"
        self.muted += muted

    def _pop(self) -> None:
        tag, node, muted = self.open.pop()
        self.counts[tag] -= 1
        self.links -= tag == "a"
        self.muted -= muted
        if node >= 0:
            self.block, self.run = self.nodes[node].parent, -1

    def _close(self, names: set[str], barrier: set[str]) -> None:
        """End the nearest open element of these names, with all inside it, unless a barrier comes first."""
        if not any(self.counts.get(n) for n in names):
            return
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.open[at][0]
            if tag in names:
                while len(self.open) > at:
                    self._pop()
                return
            if tag in barrier:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body") and self.counts.get(tag):
            return
        if tag not in HEAD_ONLY and tag != "head":
            self._close({"head"}, set())
        if tag == "br":
            self._run().text.append(" ")
            return
        if tag == "hr" or tag in BLOCKS:
            if tag not in ("html", "head", "body", "option", "optgroup", "title"):
                self._close({"p"}, P_SCOPE)
            if tag in HEADINGS and self.open[-1][0] in HEADINGS:
                self._pop()
        if tag in ENDS:
            self._close(*ENDS[tag])
        if tag == "hr":
            self.run = -1
            return
        if tag == "a":
            self._close({"a"}, P_SCOPE)
        if tag in BLOCKS:
            node = len(self.nodes)
            self.nodes.append(Node(tag, self.block, dict(attrs)))
            self.nodes[node].tags = 1
            self.block, self.run = node, -1
            self._push(tag, node, False)
            return
        if tag in VOID:
            if not self.muted:
                self._run().tags += 1
            return
        seen = Node(tag, -1, dict(attrs))
        code = self.counts.get("pre") or self.counts.get("code")
        muted = tag in NEVER or seen.hidden or seen.role in ROLES or not code and named(seen, REMARKS | INLINE)
        self._push(tag, -1, muted)
        if not self.muted:
            self._run().tags += 1
            self.nodes[self.run].link_tags += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("body", "html"):
            return
        if tag == "p" and not self.counts.get("p"):
            self.run = -1
        elif tag == "br":
            self._run().text.append(" ")
        elif tag in HEADINGS:
            self._close(HEADINGS, P_SCOPE)
        elif tag in BLOCKS:
            self._close({tag}, {"td", "th"} if tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th") else {"table"} - {tag})
        else:
            self._close({tag}, BLOCKS)

    def handle_data(self, data: str) -> None:
        if self.muted:
            return
        run = self._run()
        run.text.append(data)
        chars = len("".join(data.split()))
        run.chars += chars
        if self.links:
            run.link_chars += chars


def named(node: Node, words: set[str]) -> bool:
    """Whether a class or id has one of the words."""
    return any(not words.isdisjoint(name) and STATES.isdisjoint(name) for name in node.words)


def called(node: Node, words: set[str]) -> bool:
    """Whether a class or id starts with one of the words."""
    return any(name and name[0] in words and STATES.isdisjoint(name) for name in node.words)


def prune(nodes: list[Node]) -> None:
    """Mark what belongs to no article, with all below.

    Remarks (adverts, notices, reader comments) go unless they hold the page's
    main element or an article that is not itself within remarks. Of what is
    left, furniture (menus, side bars, headers and footers) goes unless it holds
    the main element or half of the text: then it is layout around the article.
    """
    count = len(nodes)
    inside, remarks, holds, main = ([False] * count for _ in range(4))
    for at, node in enumerate(nodes):
        if at:
            inside[at], remarks[at] = inside[node.parent], remarks[node.parent]
        main[at] = node.tag == "main"
        if node.tag in ("article", "main"):
            holds[at] = main[at] or not (remarks[at] or called(node, REMARKS | LAYOUT))
            inside[at] |= holds[at]
        elif node.tag not in ("", "html", "body"):
            remarks[at] |= named(node, REMARKS)
    for at in range(count - 1, 0, -1):
        holds[nodes[at].parent] |= holds[at]
        main[nodes[at].parent] |= main[at]
    for at, node in enumerate(nodes):
        if at and nodes[node.parent].pruned or node.tag in NEVER or node.hidden and node.tag != "body":
            node.pruned = True
        elif node.tag == "article":
            node.pruned = called(node, REMARKS | LAYOUT)
        elif node.tag not in ("", "html", "body", "main") and not holds[at]:
            node.pruned = named(node, REMARKS) or node.role in REMARK_ROLES
    words = [0] * count
    paragraphs = any(n.tag == "" and n.chars and not n.pruned and nodes[n.parent].tag == "p" for n in nodes[1:])
    for at in range(count - 1, 0, -1):
        node = nodes[at]
        if node.tag == "" and not node.pruned and (nodes[node.parent].tag == "p" or not paragraphs):
            words[at] = node.chars - node.link_chars
        words[node.parent] += words[at]
    for at, node in enumerate(nodes):
        if at and nodes[node.parent].pruned:
            node.pruned = True
        elif node.pruned or node.tag in ("", "html", "body", "main", "article") or node.tag in HEADINGS or main[at]:
            continue
        elif inside[at] and node.tag == "header":
            continue
        elif node.tag in FURNITURE or node.role in ROLES or named(node, LAYOUT - TITLES if inside[at] else LAYOUT):
            node.pruned = 2 * words[at] <= words[0]


def measure(nodes: list[Node]) -> None:
    """Densities, their sums, and the node of the greatest sum in each subtree."""
    all_chars, all_links = sum(n.chars for n in nodes if n.tag == ""), sum(n.link_chars for n in nodes if n.tag == "")
    share = all_links / all_chars if all_chars else 0.0
    for at in range(len(nodes) - 1, -1, -1):
        node = nodes[at]
        node.last = max(node.last, at)
        if node.pruned:
            node.chars = node.tags = 0
        if node.best < 0 or node.total >= nodes[node.best].total:
            node.best = at
        node.density = density(node, share)
        if node.parent >= 0:
            up = nodes[node.parent]
            up.last = max(up.last, node.last)
            if not node.pruned:
                up.chars += node.chars
                up.tags += node.tags - (node.tag == "")
                up.link_chars += node.link_chars
                up.link_tags += node.link_tags
                up.total += node.density
                if node.tag and (up.best < 0 or nodes[node.best].total >= nodes[up.best].total):
                    up.best = node.best


def density(node: Node, share: float) -> float:
    if not node.chars:
        return 0.0
    a_tag = node.chars / max(1, node.tags)
    free = max(1, node.chars - node.link_chars)
    base = math.log(node.chars * node.link_chars / free + share * node.chars + math.e)
    if base <= 1:  # a page without links
        return a_tag
    ratio = node.chars / max(1, node.link_chars) * max(1, node.tags) / max(1, node.link_tags)
    return a_tag * max(0.0, math.log(ratio)) / math.log(base)


def article(nodes: list[Node]) -> tuple[list[int], float]:
    """Roots of the article's subtrees in page order, and the threshold; sets `marked`."""
    body = next((i for i, n in enumerate(nodes) if n.tag == "body"), 0)
    heart = nodes[body].best
    path = [heart]
    while path[-1] != body:
        path.append(nodes[path[-1]].parent)
    threshold = min(nodes[i].density for i in path)
    if heart == body:
        return [body], threshold
    marks, at = [], body
    while at <= nodes[body].last:
        node = nodes[at]
        if node.pruned or node.marked:
            at = node.last + 1
            continue
        if node.tag and node.chars and node.density >= threshold and not nodes[node.best].marked:
            nodes[node.best].marked = True
            marks.append(node.best)
        at += not node.marked
    marks.sort()
    part = path[-2]
    near = [m for m in marks if part <= m <= nodes[part].last]
    root = next(i for i in path if i <= near[0] and near[-1] <= nodes[i].last)
    return [m for m in marks if m < part] + [root] + [m for m in marks if m > nodes[part].last], threshold


def main_text(html: str | None) -> str:
    """The article of a page as one line."""
    if not html:
        return ""
    nodes = Tree(html).nodes
    prune(nodes)
    measure(nodes)
    if not nodes[0].chars:
        return ""
    roots, threshold = article(nodes)
    marks_before = list(accumulate((n.marked for n in nodes), initial=0))
    parts = []
    for root in roots:
        at = root
        while at <= nodes[root].last:
            node = nodes[at]
            marks = marks_before[node.last + 1] - marks_before[at]
            if node.pruned or at != root and not marks and node.density < threshold and is_menu(node):
                at = node.last + 1
                continue
            if node.tag == "":
                parts.append("".join(node.text))
            at += 1
    return " ".join(" ".join(parts).split())


def is_menu(node: Node) -> bool:
    """Whether a container consists of links."""
    return node.tag in MENU_TAGS and node.link_tags >= MENU_LINKS and node.link_chars >= MENU_SHARE * node.chars


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its length in code points, of every page."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(html) for html in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.selectExpr("cast(page_id as long) as page_id", "url", "html").mapInArrow(extract, SCHEMA)
