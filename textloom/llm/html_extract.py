"""The main text of web pages by tree scoring.

The page becomes a tree (tags that HTML closes by itself are closed, raw text of scripts and styles is skipped). What is
never article text goes first: scripts, styles, forms, navigation, page headers and footers, asides, hidden elements, and elements that are
named for something else. A name (a word of class or role, or the id) counts if it consists of words of OUTSIDE and LAYOUT alone,
at least one of OUTSIDE: share-buttons does, share-prices and has-sidebar don't. Inside an article names of TOPICS, which may as well
say what a text is about, drop only what holds no paragraph, and paragraphs, tables, headings and the like are dropped by names of ADVERTS
alone. An element with an article or most of the page's paragraphs inside is dropped by no name.

Then every paragraph of 25 characters or more passes points, one and one for each comma and up to three for its length, to its parent, half of
them to its grandparent and ever smaller parts to LEVELS ancestors in all; the tag adds a bonus (an article's is worth some three paragraphs). A
container's score is discounted by the share of its text in links. The container of the best score is taken, and from it the nearest article
around it, if there is one, or else the widest element that holds nothing but it.

Kept are the container and its siblings, in page order: inside an article, main or other element all of them; at the top of the page,
where siblings are parts of the page, those whose paragraphs alone score a fifth of the best's, and headings,
paragraphs, lists, tables, preformatted and quoted text that isn't mostly links. Lists, and parts without a paragraph, that hold nothing but links are
menus wherever they stand.

Text is cut into blocks at block elements, character references are decoded, runs of white space become one space,
and the blocks are joined by line breaks in page order.

Defined cases: null and empty pages give an empty text; a page where nothing scores gives its body without the dropped elements; cut-off markup
ends at the cut; elements may nest to any depth, and end tags without an element are skipped. Other columns are of no effect.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import parts

# Names of HTML and of page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript template iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - frozenset("body html option optgroup legend caption tbody td tfoot th thead tr".split())
SELF_CLOSED = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "td": ("table", "tr"), "th": ("table", "tr"), "tr": ("table",), "option": ("select",)}
DROPPED = frozenset("head nav footer aside form button select input label fieldset dialog menu svg canvas object audio video map".split())
OUTSIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion comment comments commentlist discussion "
    "disqus reply replies respond reader sidebar sidebars rail menu menus nav navbar navigation breadcrumb breadcrumbs footer foot footnav masthead topbar cookie cookies "
    "consent gdpr notice notices alert newsletter subscribe subscription signup login social share sharing sharer related recommended recommendations "
    "popup modal overlay paywall pagination pager widget widgets toolbar skip search copyright legal disclaimer tags tagcloud hidden contentinfo complementary".split()
)
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion".split())
TOPICS = frozenset("alert banner copyright disclaimer discussion foot legal login menu menus notice notices overlay rail reader related replies reply respond search share signup skip social subscription tags".split())
LAYOUT = frozenset(
    "area articles bar block bottom box btn button buttons card cards cell center code col column container content div el element float form global grid group holder icon icons inner "
    "item items js layout left line link links list main message module nav outer page panel part placeholder popup post posts region right root row section site slot small sticky "
    "strip tab text title top unit us view wrap wrapper zone".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCORED = frozenset("p pre td blockquote li dd div section article main".split())
BONUS = {"article": 10.0, "main": 8.0, "div": 5.0, "section": 5.0, "blockquote": 3.0, "td": 3.0, "pre": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "form": -3.0, "th": -5.0}

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_LETTER = re.compile(r"[^\W\d_]")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
WORDED = frozenset("p pre blockquote table caption tbody thead tr td th li dt dd figure figcaption".split()) | HEADINGS
PLAIN = frozenset("p pre blockquote ul ol dl table figure".split()) | HEADINGS
MIN_PARAGRAPH, SIBLING_SHARE, LINKS, LEVELS, MOST = 25, 0.2, 0.5, 6, 0.5
_OTHERS = re.compile(r"\b(?:has|have|with|without|no|not|show|hide)[-_]+[\w-]*", re.I)  # names of what else a layout has


class Node:
    __slots__ = ("article", "attributes", "children", "heading", "inside", "length", "links", "parent", "plain", "points", "prose", "score", "tag")

    def __init__(self, tag: str, attributes: str = "", parent: Node | None = None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []
        self.score, self.points, self.links, self.length = None, 0.0, 0, 0  # points: the score without the tag's bonus
        self.heading = tag in HEADINGS  # or one inside; so is article
        self.plain = False  # whether a letter stands outside of links
        self.article = tag in ("article", "main")
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        self.prose = 0  # characters in paragraphs


def tree(page: str) -> Node:
    """The page as nodes; children are nodes and decoded strings."""
    return _parsed(page)[0]


def _parsed(page: str) -> tuple[Node, list[Node]]:
    """The root and all nodes in page order. How many elements of a tag are open tells whether an end tag has any to end."""
    root = here = Node("#root")
    order, open_ = [root], Counter()
    at, size = 0, len(page)

    def leave(node: Node) -> Node:
        """Close what is open up to and with the node."""
        walk = here
        while walk is not node.parent:
            open_[walk.tag] -= 1
            walk = walk.parent
        return walk

    while at < size:
        m = _MARKUP.search(page, at)
        text = page[at : m.start() if m else size]
        if text:
            here.children.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            if open_[tag] > 0:
                node = here
                while node.tag != tag:
                    node = node.parent
                here = leave(node)
            continue
        if closed := _closed(here, tag, open_):
            here = leave(closed)
        node = Node(tag, attributes, here)
        here.children.append(node)
        order.append(node)
        if tag in RAW:
            stop = re.compile(f"</{re.escape(tag)}[^>]*(?:>|\\Z)", re.I).search(page, at)
            at = stop.end() if stop else size
        elif tag not in VOID:
            here = node
            open_[tag] += 1
    return root, order


def _closed(here: Node, tag: str, open_: Counter) -> Node | None:
    """The element that a new `tag` ends: an open paragraph, or the last element of its own kind."""
    if stops := SELF_CLOSED.get(tag):
        own = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
        if any(open_[x] > 0 for x in own):
            node = here
            while node.parent is not None and node.tag not in stops:
                if node.tag in own:
                    return node
                node = node.parent
    if tag in CLOSES_P and open_["p"] > 0:
        node = here
        while node.parent is not None and node.tag not in BLOCK:
            node = node.parent
        if node.tag == "p":
            return node
    return None


def _outside(node: Node, prose: int) -> bool:
    """Whether the element is never part of an article; prose: the characters in all paragraphs of the page."""
    tag = node.tag
    if tag in DROPPED or tag in RAW:
        return True
    if tag == "header":
        return not node.inside or not (node.heading or node.prose)
    if not node.attributes or tag in ("article", "main", "body", "html"):
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(node.attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True
    if node.article or prose and node.prose > MOST * prose:
        return False
    for word in " ".join(html.unescape(found[k]) for k in ("class", "id", "role") if k in found).split():
        parts = {x.lower() for x in _NAME.findall(_OTHERS.sub(" ", word)) if not x.isdigit()}
        named = parts & OUTSIDE
        if named and parts <= OUTSIDE | LAYOUT and (not node.inside or (named & ADVERTS if tag in WORDED else named - TOPICS or not node.prose)):
            return True
        if "header" in parts and parts - {"header"} <= OUTSIDE | LAYOUT and tag not in WORDED and not (node.inside and (node.heading or node.prose)):
            return True
    return False


def _pruned(root: Node, order: list[Node]) -> list[Node]:
    """Drop what is outside; the rest in page order, with the lengths of text and of linked text."""
    for node in reversed(order):
        if node.tag == "p":
            node.prose = sum(len(c.strip()) for c in node.children if isinstance(c, str)) + node.prose
        if (up := node.parent) is not None:
            up.heading, up.article, up.prose = up.heading or node.heading, up.article or node.article, up.prose + node.prose
    kept, open_ = [], [root]
    while open_:
        node = open_.pop()
        kept.append(node)
        node.children = [c for c in node.children if not isinstance(c, Node) or not _outside(c, root.prose)]
        open_ += [c for c in reversed(node.children) if isinstance(c, Node)]
    for node in reversed(kept):
        for c in node.children:
            if isinstance(c, Node):
                node.length += c.length
                node.links += c.length if c.tag == "a" else c.links
                node.plain = node.plain or c.plain and c.tag != "a"
            else:
                node.length += len(c.strip())
                node.plain = node.plain or _LETTER.search(c) is not None
    return kept


def _density(node: Node) -> float:
    return node.links / node.length if node.length else 0.0


def _own_text(node: Node) -> str:
    """The element's text outside of block children."""
    found, open_ = [], [*reversed(node.children)]
    while open_:
        c = open_.pop()
        if isinstance(c, str):
            found.append(c)
        elif c.tag not in BLOCK:
            open_ += reversed(c.children)
    return " ".join("".join(found).split())


def _score(order: list[Node]) -> None:
    for node in order:
        if node.tag in ("article", "main") and node.length:
            node.score = BONUS[node.tag]
        if node.tag in SCORED:
            text = _own_text(node)
            if len(text) >= MIN_PARAGRAPH:
                points = 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3)
                first = node if node.tag in ("div", "section", "article", "main", "td") else node.parent
                level, up = 0, first
                while up is not None and up.tag != "#root" and level < LEVELS:
                    if up.score is None:
                        up.score = BONUS.get(up.tag, 0.0)
                    part = points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                    up.score, up.points = up.score + part, up.points + part
                    level, up = level + 1, up.parent
    for node in order:
        if node.score is not None:
            node.score *= 1 - _density(node)
            node.points *= 1 - _density(node)


def _kept(root: Node, order: list[Node]) -> list:
    """The best container and the siblings that belong to it, in page order; bare strings are siblings too."""
    scored = [n for n in order if n.score is not None]
    if not scored:
        return [n for n in order if n.tag == "body"][:1] or [root]
    best = top = max(scored, key=lambda n: n.score)
    while top.parent is not None and top.tag != "article":
        top = top.parent
    if top.tag == "article":
        best = top
    while best.parent is not None and best.tag not in ("article", "main", "body") and best.parent.length == best.length:
        best = best.parent
    if best.parent is None or best.tag in ("main", "body"):
        return [best]
    least, apart = max(10.0, best.points * SIBLING_SHARE), best.tag == "article" or best.parent.tag in ("body", "html", "#root")
    return [c for c in best.parent.children if c is best or _belongs(c, least, apart)]


def _belongs(sibling: Node | str, least: float, apart: bool) -> bool:
    """Whether a sibling of the best container is part of the article; apart: the siblings are parts of the page."""
    if isinstance(sibling, str):
        return not apart
    if _list_of_links(sibling):
        return False
    return not apart or (sibling.tag in PLAIN and _density(sibling) <= LINKS) or sibling.points >= least


def _list_of_links(node: Node) -> bool:
    """Whether the element is a list, or a part without paragraphs, of nothing but links."""
    if not node.links or node.plain:
        return False
    return node.tag in ("ul", "ol", "dl", "menu", "table") or node.tag in ("div", "section") and not node.prose


def blocks(nodes: list[Node]) -> list[str]:
    """The text of the nodes, cut at block elements."""
    out: list[str] = []
    run: list[str] = []

    def cut():
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    open_: list = [*reversed(nodes)]
    while open_:
        c = open_.pop()
        if c is None:
            cut()
        elif isinstance(c, str):
            run.append(c)
        elif c.tag in VOID:
            run.append(" ")
            if c.tag == "hr":
                cut()
        elif not _list_of_links(c):
            if c.tag in BLOCK:
                cut()
                open_.append(None)
            open_ += reversed(c.children)
    cut()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root, every = _parsed(page)
    order = _pruned(root, every)
    _score(order)
    return "\n".join(blocks(_kept(root, order)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def extracted(batches):
        for batch in (part for whole in batches for part in parts(whole, 512, column="html")):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = [pages.schema[c] for c in ("page_id", "url")]
    return pages.select("page_id", "url", "html").mapInArrow(extracted, T.StructType([*own, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
