"""Main text of web pages by tree scoring.

Paragraphs pass points for length and commas to the elements above them, less the further up; an element's points are
discounted by the share of its text that is link text.  The best element and those siblings that are not mostly links are
kept, whatever their length.  Menus, page headers and footers, side bars, notices, adverts, forms, scripts, styles and reader comments are
taken out before and never score.  Each page is worked on in its own row, in time and memory linear in its length whatever
its tags; nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantgap.llm.common import ship

# Kinds of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe object svg math noembed noframes xmp".split())
DROP = RAW | set("nav footer aside form button select option dialog menu head input canvas audio video label fieldset".split())
BLOCK = set(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption header address details summary hr center hgroup".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
SCOPE = set("table ul ol dl div section article main body html blockquote td th".split())
NOISE_ROLE = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# A name speaks for an element only as a whole class or id: a noise word, with a word of place or of kind at most.
PLACE = r"(?:(?:main|primary|secondary|site|page|blog|post|global|top|bottom|left|right|mobile|header|footer|article|entry|user|reader)[_-])?"
KIND = r"(?:[_-](?:container|wrapper|wrap|box|block|area|list|section|inner|content|bar|links?|menu|banner|notice|consent|signup|share|icons?|buttons?|form|slot|unit|space|holder|top|bottom|left|right|primary|secondary|main|\d+))?"
NOISE_NAME = re.compile(
    PLACE + r"(?:banner|sponsor(?:ed|s)?|promo(?:s|tions?)?|nav(?:bar|igation)?|menu|breadcrumbs?|pagination|pager|sidebar|aside|widgets?|"
    r"shar(?:e|ing)|social|related(?:[_-](?:posts?|articles|stories))?|recommend(?:ed|ations)?|footer|masthead|site-header|page-header|topbar|toolbar|"
    r"cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscri(?:be|ption)|signup|login|copyright|legal|disclaimer|skip)" + KIND,
    re.I,
)
# Names of adverts and reader comments, which may be the larger part of a page.
SURE_NAME = re.compile(PLACE + r"(?:ads?|advert(?:s|isements?)?|adsense|comments?|disqus(?:[_-]thread)?|repl(?:y|ies)|respond)" + KIND, re.I)
# Other names speak by their parts, "fb-comments" or "sideNav", unless a part tells a state of the page, as "no-sidebar" does.
STATE_PARTS = set("has no not with without is non open opened closed enabled disabled active free blocker layout template theme".split())
TEXT_PARTS = set("content article post entry story body main page text".split())
SURE_PARTS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle adslot adunit dfp gpt doubleclick taboola outbrain "
    "comment comments commentlist commenting commentform disqus dsq livefyre spotim replies respond".split()
)
NOISE_PARTS = set(
    "nav navbar subnav sidenav topnav navigation breadcrumb breadcrumbs sidebar rail cookie cookies gdpr consent newsletter masthead pagination pager "
    "popup modal toolbar topbar addthis sharethis sponsored promo promos skyscraper interstitial".split()
)
NOISE_PAIRS = set(
    "top-bar side-bar side-column left-column right-column left-col right-col left-rail right-rail side-panel share-bar share-buttons social-share "
    "social-links sign-up sign-in log-in".split()
)
# Words that name sections of articles too: as a class they name reader comments, as an id they do not.
CLASS_NAMES = set("discussion discussions responses response-list thread".split())
SIGNED_PARTS = set("author byline avatar username commenter nickname".split())
DATED_PARTS = set("date time timestamp datetime ago published".split())
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(/?)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
SPACE = re.compile(r"\s+")

POINTS_LENGTH = 100  # one point for so many characters, three at most
LINKED = 0.25  # share of link text from which on an element beside the best one is not text
TINY = 0.1  # a text below this share of the page's unlinked text is looked for again without names

ship(__name__)


class Node:
    __slots__ = ("tag", "up", "children", "noise", "named", "kind", "traits", "score", "chars", "links", "weight", "sure", "any", "within", "main", "inside")

    def __init__(self, tag: str, up: "Node | None", noise: bool = False, named: int = 0, kind: str = "", traits: int = 0):
        self.tag, self.up, self.noise, self.named, self.kind, self.traits = tag, up, noise, named, kind, traits
        self.children: list = []
        self.score, self.chars, self.links, self.weight = 0.0, 0, 0, 0.0
        self.sure = self.any = self.within = self.inside = False
        self.main = 0


def judge_name(name: str, is_class: bool = True) -> int:
    """1 if a class or id names noise, 2 if it names adverts or reader comments, else 0."""
    if SURE_NAME.fullmatch(name):
        return 2
    if NOISE_NAME.fullmatch(name):
        return 1
    if is_class and name.lower() in CLASS_NAMES:
        return 1
    parts = [part.lower() for part in PART.findall(name)]
    found = set(parts)
    if found & STATE_PARTS or ":" in name:
        return 0
    if found & SURE_PARTS:
        return 1 if found & TEXT_PARTS else 2
    return 1 if found & NOISE_PARTS or any(f"{a}-{b}" in NOISE_PAIRS for a, b in zip(parts, parts[1:])) else 0


def _read(tag: str, attributes: str, in_main: bool) -> tuple[bool, int, str, int]:
    """``(is noise, what the names say, classes as written, 1 for an author's name + 2 for a date)`` of an element."""
    noise = tag in DROP or (tag == "header" and not in_main)
    traits = 2 if tag == "time" else 0
    if not attributes:
        return noise, 0, "", traits
    named, kind = 0, ""
    whole = tag in ("html", "body", "article", "main")
    for match in ATTRIBUTE.finditer(attributes):
        name, value = match[1].lower(), match[2] or match[3] or match[4] or ""
        if name in ("class", "id"):
            if name == "class" and not kind:
                kind = value
            for word in value.split():
                if not whole:
                    named = max(named, judge_name(word, name == "class"))
                parts = {part.lower() for part in PART.findall(word)}
                traits |= (1 if parts & SIGNED_PARTS else 0) | (2 if parts & DATED_PARTS else 0)
        elif whole:
            continue
        elif name == "role" and value.lower() in NOISE_ROLE or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            noise = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            noise = True
    return noise, named, kind, traits


class Open:
    """The open elements, and for each tag the depths at which it is open: what a tag closes is known without a walk."""

    def __init__(self, root: Node):
        self.nodes, self.depths = [root], {}
        self.scopes, self.table_scopes = [0], [0]  # depths of elements that paragraphs, or cells, do not reach beyond

    def last(self, tag: str) -> int:
        depths = self.depths.get(tag)
        return depths[-1] if depths else 0

    def push(self, node: Node) -> None:
        depth = len(self.nodes)
        self.nodes.append(node)
        self.depths.setdefault(node.tag, []).append(depth)
        if node.tag in SCOPE:
            self.scopes.append(depth)
            if node.tag not in ("td", "th"):
                self.table_scopes.append(depth)

    def close(self, depth: int) -> None:
        """Close the element at ``depth`` and all inside."""
        while len(self.nodes) > depth:
            self.depths[self.nodes.pop().tag].pop()
        for scopes in (self.scopes, self.table_scopes):
            while scopes[-1] >= depth:
                scopes.pop()


def parse(page: str) -> Node:
    """Tree of elements and strings; missing and stray end tags are forgiven, a cut page ends all that is open."""
    root = Node("#root", None)
    opened = Open(root)
    at, end = 0, len(page)
    while at < end:
        here = opened.nodes[-1]
        match = TOKEN.search(page, at)
        if match is None:
            here.children.append(page[at:])
            break
        if match.start() > at:
            here.children.append(page[at : match.start()])
        at = match.end()
        if match[2] is None:
            continue
        tag = match[2].lower()
        if match[1]:  # an end tag closes down to its element, if that is open
            depth = opened.last(tag)
            if depth:
                opened.close(depth)
            elif tag == "p":
                here.children.append(Node("p", here))
            continue
        if tag in RAW and not match[4]:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in BLOCK or tag in CLOSES:  # a block ends an open paragraph, an item the item before it
            ends = CLOSES.get(tag, ())
            scope = (opened.table_scopes if "td" in ends else opened.scopes)[-1]
            reached = max((d for d in map(opened.last, ends) if d > scope), default=scope)
            # Paragraphs inside the item that ends go with it.
            close = reached if reached > scope else opened.last("p")
            if close > scope:
                opened.close(close)
            here = opened.nodes[-1]
        in_main = bool(opened.last("article") or opened.last("main"))
        noise, named, kind, traits = _read(tag, match[3], in_main)
        node = Node(tag, here, here.noise or noise, named, kind, traits)
        here.children.append(node)
        if tag not in VOID and not match[4]:
            opened.push(node)
    return root


def _clean(pieces: list[str]) -> str:
    return SPACE.sub(" ", html.unescape("".join(pieces))).strip()


def blocks(top: Node) -> list[tuple[Node, str, int]]:
    """``(element, text, characters of link text)`` of each run of text that no block divides, in page order."""
    out: list[tuple[Node, str, int]] = []
    pieces: list[str] = []
    linked: list[str] = []
    owner = top

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = _clean(pieces)
            if text:
                out.append((owner, text, len(_clean(linked)) if linked else 0))
        pieces, linked = [], []

    stack: list[tuple[object, Node, bool, bool]] = [(top, top, False, False)]
    while stack:
        item, holder, in_link, closing = stack.pop()
        if closing:
            flush()
            owner = holder
        elif isinstance(item, str):
            pieces.append(item)
            if in_link:
                linked.append(item)
        elif not item.noise:
            if item.tag == "br" or item.tag == "hr":
                pieces.append(" ")
                continue
            if item.tag in BLOCK or item is top:
                flush()
                stack.append((None, owner, False, True))
                owner = item
            stack.extend((child, item, in_link or item.tag == "a", False) for child in reversed(item.children))
    flush()
    return out


def points(owner: Node, text: str) -> float:
    if owner.tag not in ("p", "pre", "td", "blockquote", "li", "div", "section", "article") or len(text) < 25:
        return 0.0
    return 1 + text.count(",") + min(len(text) / POINTS_LENGTH, 3)


def threads(order: list[Node]) -> list[list[Node]]:
    """Groups of two or more neighbours of one tag and class that each carry an author's name and a date: comments, or a list of posts."""
    traits = {id(node): node.traits for node in order}
    for node in reversed(order):
        if node.up is not None and id(node.up) in traits:
            traits[id(node.up)] |= traits[id(node)]
    groups = []
    for node in order:
        alike: dict[tuple[str, str], list[Node]] = {}
        for child in node.children:
            if isinstance(child, Node) and not child.noise and child.tag in BLOCK and traits.get(id(child)) == 3:
                alike.setdefault((child.tag, child.kind), []).append(child)
        groups.extend(group for group in alike.values() if len(group) > 1)
    return groups


def take_out(root: Node, least: int) -> float:
    """Mark what names of ``least`` or above, or its build as a thread, take out; returns the unlinked text of the rest.

    A name of 1 does not count for an element that holds most of the page's points, a main element, or an article if
    there is none outside; nor does a thread whose posts hold a third of the points together.
    """
    order = [node for node in _elements(root) if not node.noise]  # from the top down
    total = unlinked = 0.0
    free = False  # an article or main element with points outside
    for node in order:
        up = node.up
        node.sure = node.named > 1 or up is not None and up.sure
        node.any = node.named > 0 or up is not None and up.any
        node.within = node.tag in ("article", "main") or up is not None and up.within
        node.weight, node.main, node.chars = 0.0, 0, 0
    for owner, text, links in blocks(root):
        worth = points(owner, text)
        owner.chars += len(text)
        if not owner.sure:
            unlinked += len(text) - links
            total += worth
            owner.weight += worth
        free = free or bool(worth and owner.within and not owner.any)
    for node in reversed(order):
        if node.chars and node.tag in ("article", "main"):
            node.main |= 1 if node.tag == "article" else 2
        if node.up is not None:
            node.up.weight += node.weight
            node.up.main |= node.main
            node.up.chars += node.chars
    for node in order:
        if node.named >= least and not (node.named == 1 and (node.weight * 2 > total or node.main & 2 or node.main & 1 and not free)):
            node.noise = True
    for group in threads(order) if least == 1 else ():
        if sum(node.weight for node in group) * 3 < total and not any(node.main & 2 for node in group):
            for node in group:
                node.noise = True
    for node in order:
        node.chars = 0
        node.noise = node.noise or node.up is not None and node.up.noise
    return unlinked


def main_text(page: str | None) -> str:
    """The article of a page; empty if it has no text outside what is taken out.

    Where names take out all text, or nearly all but adverts and comments, the page is read again without them.
    """
    if not page:
        return ""
    best = ""
    for least in (1, 2, 3):
        root = parse(page)
        unlinked = take_out(root, least)
        text = scored_text(root)
        if len(text) > len(best):
            best = text
        if best and (least > 1 or len(best) >= TINY * unlinked):
            break
    return best


def scored_text(root: Node) -> str:
    found = blocks(root)
    if not found:
        return ""
    scored: dict[int, Node] = {}
    for owner, text, links in found:
        value = points(owner, text)
        node, depth = owner if owner.tag in ("div", "section", "article", "main", "body", "td") else owner.up, 0
        owner.chars += len(text)
        owner.links += links
        while value and node is not None and node.tag != "#root" and depth < 5:
            node.score += value / (1 if depth == 0 else 2 if depth == 1 else 3 * depth)
            scored[id(node)] = node
            node, depth = node.up, depth + 1
    order = list(_elements(root))
    for node in reversed(order):
        if node.up is not None:
            node.up.chars += node.chars
            node.up.links += node.links
    worth = lambda n: n.score * (1 - n.links / max(n.chars, 1))
    articles = [n for n in order if n.tag in ("article", "main") and n.chars and not n.noise]
    if scored:
        best = max(scored.values(), key=worth)
        # An element that a page marks as its article holds the best one, or is it.
        node = best
        while node is not None and node.tag not in ("article", "main"):
            node = node.up
        best = node or best
    elif articles:
        best = max(articles, key=lambda n: n.chars)
    else:
        best = root
    kept, loose = {id(best)}, None
    if best.up is not None and best.tag not in ("article", "main"):
        for child in best.up.children:
            if isinstance(child, Node) and not child.noise and child.chars and child.links < LINKED * child.chars:
                kept.add(id(child))
        loose = best.up  # text beside the elements
        # Above it only elements of the same kind are parts of the same text: rows of a page, or its sections.
        node, up = best.up, best.up.up
        while up is not None and node.tag not in ("article", "main", "body"):
            for child in up.children:
                if isinstance(child, Node) and child is not node and child.tag == node.tag and (node.kind or node.tag == "section") and child.kind == node.kind:
                    if not child.noise and child.chars and child.links < LINKED * child.chars:
                        kept.add(id(child))
            node, up = up, up.up
    for node in order:
        node.inside = id(node) in kept or node.up is not None and node.up.inside
    return "\n".join(text for owner, text, links in found if owner.inside or owner is loose and links < LINKED * len(text))


def _elements(root: Node) -> Iterator[Node]:
    """All elements, each after the one that holds it."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in node.children if isinstance(c, Node))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row of ``pages``; null and empty pages give empty texts, repeats stay.

    Very long pages are read whole, one at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(markup).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
