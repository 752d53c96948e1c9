"""Main text of web pages by composite text density over the DOM."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import annotate

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg annotation annotation-xml select object".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "tr ul".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th"}, "tfoot": {"tr", "td", "th"},
}
WALLS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
         "tbody": {"table"}, "tfoot": {"table"}, "option": set()}
# Elements, roles and name parts that mark what is not the article.
NOT_ARTICLE = frozenset("nav aside footer form button menu dialog input label fieldset".split())
NOT_ROLES = frozenset(
    "navigation banner complementary contentinfo search form dialog alertdialog alert menu menubar toolbar status".split())
NOT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox adunit sponsor sponsored sponsors promo "
    "promos promotion promoted nav navbar navigation navi menu menus submenu topbar toolbar breadcrumb breadcrumbs pagination pager "
    "sidebar sidebars aside rail widget widgets footer footers foot colophon masthead comment comments commentlist comentarios "
    "kommentare commentaires disqus replies reply respond discussion cookie cookies consent gdpr notice notices notification "
    "notifications alert alerts banner banners popup modal overlay newsletter subscribe subscription signup login signin search "
    "toast snackbar disclaimer announcement announcements thread threads responses feedback "
    "share sharing social related recommended recommendations teaser teasers skip".split()
)
NEGATIONS = frozenset("has with without no not is".split())  # as in has-sidebar, no-ads
ARTICLE_NOISE = frozenset(
    "ad ads advert advertisement sponsored promo comment comments comentarios kommentare commentaires reply related teaser".split())
PLAIN = frozenset(  # noise as names of page parts, but headings of articles just as well
    "discussion related search feedback responses respond reply replies notice notices alert alerts notification notifications "
    "announcement announcements disclaimer social rail thread threads share sharing recommended recommendations promo promos "
    "promotion promoted subscription teaser teasers".split()
)
NOTICES = frozenset("notice notices alert alerts notification notifications announcement announcements disclaimer".split())
SURE = frozenset(  # adverts, comments and consent, whatever else the name says
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox adunit sponsor sponsored sponsors comment "
    "comments commentlist comentarios kommentare commentaires disqus cookie cookies consent gdpr".split())
COMMENTS = frozenset("comment comments commentlist comentarios kommentare commentaires disqus replies".split())
CASES = frozenset(  # what a part of a page is called besides what it holds: ad-box, nav-wrapper
    "container wrapper wrap box block list area bar item items section inner outer panel module unit slot top bottom left right main link "
    "links button buttons icon icons header title primary secondary fixed sticky inline mobile desktop group row col column zone".split())
PAGE_HEADER = frozenset("header site page top global main wrapper container the".split())
KEEP_ROOTS = frozenset(("html", "body", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"))

TAG = re.compile(
    r"<(?:!--.*?(?:--!?>|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+(?:>|\Z)|/(?=[^a-zA-Z])[^>]*+(?:>|\Z)"
    r"|(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^\"'>])*+)(?:>|\Z)"
    r"|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z))",
    re.S,
)
ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
MAIN_ROLE = re.compile(r"(?:^|[\s\"'/])role\s*=\s*[\"']?main\b", re.I)
PARTS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    """An element: its content in order, and counts over its subtree."""

    __slots__ = ("tag", "up", "content", "chars", "tags", "link_chars", "link_tags", "density", "total", "article", "doubtful",
                 "dropped", "after")

    def __init__(self, tag: str, up: Node | None, article: bool = False, doubtful: bool = False):
        self.tag, self.up, self.content = tag, up, []
        self.article = article  # in an article or main
        self.doubtful = doubtful  # named as noise in an article: goes if it is mostly links
        self.after = False  # behind a paragraph or heading of the same parent
        self.dropped = 0  # of the root: characters left out for a name, comments not counted
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _named(tag: str, attrs: str, in_article: bool, names: frozenset[str]) -> int:
    """3: noise by role or hidden; 2: noise by name; 1: named as noise, but in doubt; 0: neither."""
    found = 0
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "role":
            if value.lower() in NOT_ROLES:
                return 3
        elif name == "hidden":
            return 3
        elif name == "aria-hidden":
            if value.lower() == "true":
                return 3
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return 3
        elif tag not in HEADINGS:
            for one in value.split():
                found = max(found, _noise_name(tag, PARTS.findall(CAMEL.sub(" ", one).lower()), name == "id", in_article, names))
    return found


def _noise_name(tag: str, parts: list[str], is_id: bool, in_article: bool, names: frozenset[str]) -> int:
    """As :func:`_named`.  Ids of sections and paragraphs often come from their text, so in an article no id counts.

    A name of several words is that of its last one (social-history is a history), unless that only says that it is some part
    of the page.  Plain words, which head parts of articles too, leave a doubt: the part's own links then decide.
    """
    if not parts or parts[0] in NEGATIONS or (is_id and (in_article or tag == "p")):
        return 0
    hits = (ARTICLE_NOISE if tag == "article" else names).intersection(parts)
    if not hits or (in_article and tag == "p"):
        return 0
    if in_article and not hits & (ARTICLE_NOISE - PLAIN if tag == "section" else ARTICLE_NOISE):
        return 1
    if tag != "article" and not hits & SURE:
        head = next((x for x in reversed(parts) if x not in CASES), parts[-1])
        if head not in names or hits <= PLAIN - NOTICES:
            return 1
    return 1 if is_id and tag == "section" and hits <= PLAIN else 2


def _is_page_header(attrs: str) -> bool:
    """Named as the header of the page, not of a part of it."""
    for m in ATTR.finditer(attrs):
        if m[1].lower() in ("class", "id"):
            for one in (m[2] or "").strip("\"'").split():
                parts = set(PARTS.findall(CAMEL.sub(" ", one).lower()))
                if "header" in parts and parts <= PAGE_HEADER:
                    return True
    return False


def _noise(tag: str, attrs: str, in_article: bool, in_sentence: bool, names: frozenset[str] | None) -> int:
    """3: noise by element, role or hidden; 2: by name; 1: in doubt; 0: no noise."""
    if tag in KEEP_ROOTS:
        return 0
    if tag in ("button", "label") and in_sentence:  # a word of the sentence; forms are gone as a whole
        return 0
    if tag in NOT_ARTICLE or (tag == "header" and not in_article):
        return 3
    if names is None or not attrs:
        return 0
    if not in_article and tag not in HEADINGS and _is_page_header(attrs):
        return 2
    return _named(tag, attrs, in_article, names)


def parse(page: str, names: frozenset[str] | None = NOT_NAMES) -> Node:
    """The DOM without what is noise by its element and, with ``names``, its role or name; never fails, whatever the input."""
    root = Node("html", None)
    counts = False  # whether what is left out now was named, and not as comments
    at, pos, skip = root, 0, 0  # skip: depth inside a noise element
    open_count: dict[str, int] = {"html": 1}

    def close(until: Node | None) -> None:
        nonlocal at
        while at is not until and at.up is not None:
            open_count[at.tag] -= 1
            at = at.up

    skipped: list[str] = []
    for m in TAG.finditer(page):
        if m.start() < pos:  # inside raw text that has been passed over
            continue
        if m.start() > pos:
            if not skipped:
                at.content.append(page[pos : m.start()])
            elif counts:
                root.dropped += m.start() - pos
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ends, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if skipped:
            if not ends and tag in RAW and not attrs.endswith("/"):
                pos = _raw_end(page, tag, pos)
            elif ends:
                if tag in skipped:
                    while skipped.pop() != tag:
                        pass
                elif tag in ("body", "html", "main", "article") and open_count.get(tag):
                    skipped.clear()
            elif tag not in VOID and not attrs.endswith("/") and tag in BLOCK | NOT_ARTICLE:
                if tag in CLOSES and skipped[-1] in CLOSES[tag] or tag == "p" == skipped[-1]:
                    skipped.pop()
                skipped.append(tag)
            if skipped or ends:
                continue
        if ends:
            if open_count.get(tag, 0) and tag not in ("html", "body"):
                n = at
                while n.tag != tag:
                    n = n.up
                close(n)
                open_count[tag] -= 1
                at = n.up or root
            continue
        if tag in BLOCK and open_count.get("p"):
            n = at
            while n.tag != "p":
                n = n.up
            close(n)
            open_count["p"] -= 1
            at = n.up
        if tag in CLOSES and any(open_count.get(t) for t in CLOSES[tag]):
            n = at
            while n is not None and n.tag not in CLOSES[tag] and n.tag not in WALLS[tag]:
                n = n.up
            if n is not None and n.tag in CLOSES[tag]:
                if tag in ("tr", "tbody", "tfoot"):
                    while n.up is not None and n.up.tag in CLOSES[tag]:
                        n = n.up
                close(n)
                open_count[n.tag] -= 1
                at = n.up
        if tag in ("html", "body", "head"):
            if tag == "body" and not open_count.get("body"):
                close(root)
            else:
                continue
        if tag in RAW:
            if not attrs.endswith("/"):
                pos = _raw_end(page, tag, pos)
            at.content.append(" " if tag not in BLOCK else "\n")
            continue
        noise = _noise(tag, attrs, at.article, bool(open_count.get("p")), names)
        if noise >= 2:
            if tag not in VOID and not attrs.endswith("/"):
                skipped.append(tag)
                counts = noise == 2 and COMMENTS.isdisjoint(PARTS.findall(attrs.lower()))
            at.content.append(Node("hr", at) if tag in BLOCK else " ")
            continue
        node = Node(tag, at, at.article or tag in ("article", "main") or bool(MAIN_ROLE.search(attrs)), noise == 1)
        at.content.append(node)
        if tag not in VOID:
            at = node
            open_count[tag] = open_count.get(tag, 0) + 1
    if pos < len(page) and not skipped:
        at.content.append(page[pos:])
    return root


def _raw_end(page: str, tag: str, pos: int) -> int:
    m = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, pos)
    return m.end() if m else len(page)


def _order(root: Node) -> list[Node]:
    """All elements, parents before children."""
    out = [root]
    for n in out:
        out.extend(c for c in n.content if isinstance(c, Node))
    return out


def measure(root: Node) -> list[Node]:
    """Counts, link-adjusted densities and their sums over children, for every node."""
    nodes = _order(root)
    for n in reversed(nodes):
        own = sum(len(" ".join(c.split())) for c in n.content if isinstance(c, str))
        n.chars += own
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1
        if n.up is not None:
            u = n.up
            u.chars += n.chars
            u.tags += n.tags + 1
            u.link_chars += n.link_chars
            u.link_tags += n.link_tags
    share = root.link_chars / max(root.chars, 1)
    for n in nodes:
        if n.chars:
            tags = max(n.tags, 1)
            plain = max(n.chars - n.link_chars, 1)
            base = math.log(n.chars / plain * n.link_chars + share * n.chars + math.e)
            odds = n.chars / max(n.link_chars, 1) * tags / max(n.link_tags, 1)
            n.density = n.chars / tags * max(math.log(max(odds, 1.0)), 0.01) / max(math.log(base), 0.1)
    for n in nodes:
        after = False
        for c in n.content:
            if isinstance(c, Node):
                c.after = after
                after = after or _is_text(c)
        n.total = sum(c.density for c in n.content if isinstance(c, Node))
        n.total += sum(len(c) for c in n.content if isinstance(c, str) and not c.isspace())
    return nodes


def choose(root: Node) -> list[Node]:
    """Subtrees that hold the article, in page order.

    The node with the greatest sum of child densities is the core, and the least density on the way from there up to the
    body is the threshold.  Inside an ``article``, the outermost one is taken with all articles beside it that are at or
    above the threshold and not mostly links; else inside a ``main``, that element.  Else every node at or above the
    threshold gives its own greatest-sum subtree.
    """
    nodes = measure(root)
    core = max(nodes, key=lambda n: n.total)  # the first of equals
    if core.total <= 0:
        return []
    least, n, around = core.density, core, {}
    while n is not None:
        least = min(least, n.density)
        if n.tag == "article" or n.tag not in around:
            around[n.tag] = n  # the outermost article, the innermost main
        n = n.up
    if "article" in around:
        one = around["article"]
        beside = one.up.content if one.up is not None else [one]
        return [x for x in beside if isinstance(x, Node) and x.tag == "article"
                and (x is one or (x.density >= least and x.link_chars * 2 <= x.chars))]
    if "main" in around:
        return [around["main"]]
    place = {id(x): i for i, x in enumerate(nodes)}
    best: dict[int, Node] = {}  # greatest-sum node of each subtree
    for x in reversed(nodes):
        top = x
        for c in x.content:
            if isinstance(c, Node) and best[id(c)].total > top.total:
                top = best[id(c)]
        best[id(x)] = top
    taken: set[int] = set()
    for x in nodes:
        if (x.density >= least and x.tag not in KEEP_ROOTS | {"ul", "ol"} and x.link_chars * 2 <= x.chars) or x is core:
            taken.add(id(best[id(x)]))
        elif x.tag in HEADINGS and x.up is core.up and place[id(x)] < place[id(core)]:
            taken.add(id(x))
    return [x for x in _document_order(root) if id(x) in taken]


def _document_order(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(c for c in reversed(n.content) if isinstance(c, Node))


def _link_list(n: Node) -> bool:
    """A menu: a list of links that doesn't follow a paragraph, or a heading of a lower level, in its own part of the page."""
    return n.tag in ("ul", "ol", "dl") and n.link_tags > 1 and n.link_chars * 10 >= n.chars * 9 and not n.after


def _is_text(n: Node) -> bool:
    return n.tag in HEADINGS - {"h1"} or (n.tag in ("p", "blockquote", "pre") and 0 < n.chars >= n.link_chars * 2)


def blocks(chosen: list[Node]) -> list[str]:
    """Texts of the blocks of the chosen subtrees, once each, white space folded, character references decoded."""
    out: list[str] = []
    line: list[str] = []
    done: set[int] = set()

    def flush() -> None:
        if line:
            text = " ".join(html.unescape("".join(line)).split())
            if text:
                out.append(text)
            line.clear()

    for top in chosen:
        if id(top) in done:
            continue
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                line.append(x)
            elif id(x) not in done:
                done.add(id(x))
                if x is not top and (_link_list(x) or (x.doubtful and x.link_chars * 3 >= x.chars)):
                    flush()
                    continue
                if x.tag == "header":  # inside an article: its headings only
                    parts = [d for d in _document_order(x) if d.tag in HEADINGS]
                    stack.append(None)
                    stack.extend(reversed(parts))
                    flush()
                    continue
                if x.tag in BLOCK:
                    flush()
                    stack.append(None)
                elif x.tag in ("br", "img", "wbr"):
                    line.append("" if x.tag == "wbr" else " ")
                stack.extend(reversed(x.content))
        flush()
    return out


def main_text(page: str | None) -> str:
    """The article of a page, blocks joined by two line feeds; empty for null, empty and textless pages.

    Names are believed as long as what they leave out doesn't outweigh what is kept.  Then only sure ones (adverts, comments,
    consent) count, and if that leaves nothing, none.
    """
    if not page:
        return ""
    root = parse(page)
    found = "\n\n".join(blocks(choose(root)))
    if root.dropped > len(found):
        more = "\n\n".join(blocks(choose(parse(page, SURE))))
        found = more if len(more) > 2 * len(found) else found
    return found or "\n\n".join(blocks(choose(parse(page, None))))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` (the article) and n_chars (its code points) in place of the html; one row for each row.

    Null, empty and textless pages give an empty text.  Pages of any length are parsed whole, in time that grows with
    their length; broken and cut-off markup is read as far as it goes.  A page is independent of all others, so the work
    needs no shuffle, and repeated rows give equal texts.  Other columns pass through, except a ``text`` or ``n_chars``.
    """
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    run = lambda rows: [[main_text(p) for p in rows]]
    return annotate(pages.select(*kept), html_col, "text string", run, 64).withColumn(
        "n_chars", F.char_length("text").cast("bigint"))
