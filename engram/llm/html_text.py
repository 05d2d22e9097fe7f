"""Main-text extraction by composite text density.

A page becomes a small DOM.  Every node gets its link-adjusted characters per tag,
the composite density, and the sum of its children's densities.  The subtree with the
largest sum is the article's core.  The least density on the path from it up to the
body is the threshold: on that path sibling subtrees join the core when their density
reaches it, and lists of links below it go.

Furniture by tag or role (nav, footer, aside, forms) and reader comments are never
text.  Other words of a class or an id (related, alert, advert) only turn an element's
characters into link characters, so outside the core it has density 0 and is not
chosen.  Inside the core, or beside it in the same article, such an element stays if
without that word it is as dense as the core's own parts are on average: running prose
under a misleading class is text, a line of advertising is not.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from engram.llm.columns import picked

# Element names of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose content is not text of the page.
HIDDEN = frozenset("script style noscript template textarea title head iframe object embed applet canvas svg audio video map frameset noembed noframes xmp datalist".split())
#: Elements that are page furniture by their name.
FURNITURE = frozenset("nav footer aside form button select input option dialog menu label output progress meter".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of a class or an id that name reader comments, and other furniture.
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
HINTS = COMMENT_WORDS | frozenset(
    "nav navbar navigation menu submenu header masthead topbar footer sidebar aside rail widget widgets ad ads adv advert adverts advertisement advertising "
    "adsbygoogle adslot sponsor sponsored sponsors promo promoted promotion banner cookie cookies consent gdpr notice notices notification disclaimer alert popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations trending "
    "breadcrumb breadcrumbs pagination pager toolbar search skip".split()
)
#: A class or id is not believed on an element that holds the page's h1, or more than this share of its plain text and all its articles.
MOST = 1 / 2
#: A list inside the article is a menu from so many links on, if its density is below the threshold.
MENU_LINKS = 3
#: Elements of running text.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
KEEP = frozenset("html body main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: An open element that a new one of the listed names ends.
ENDED_BY = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot", "thead"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option", "optgroup"},
    "p": BLOCKS,
}
#: Open elements that an implied end does not cross.
WALLS = frozenset("article aside body div dl footer form header html main nav ol section table td th ul".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"'>]|\Z)""", re.I)
_SPLIT = re.compile(r"[\s_:.-]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "kids", "parent", "mark", "noise", "soft", "keeps", "articles", "chars", "plain", "tags", "link_chars", "link_tags", "bare_chars", "bare_tags", "density", "bare", "total")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.kids = tag, parent, []
        #: why it may be furniture: '' not at all, 'tag' certainly, 'words' by its class, 'comments'
        self.mark = ""
        #: never text, and in doubt by a class word, with all below it
        self.noise = self.soft = self.keeps = False
        self.articles = self.chars = self.plain = self.tags = 0
        #: links and furniture in characters and elements, and the same as if no class word said so
        self.link_chars = self.link_tags = self.bare_chars = self.bare_tags = 0
        self.density = self.bare = self.total = 0.0


def _mark(tag: str, attributes: str) -> str:
    if tag in FURNITURE:
        return "tag"
    if tag in KEEP or not attributes:
        return ""
    found = ""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return "tag"
        if name == "role" and value.strip().lower() in FURNITURE_ROLES:
            return "tag"
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "tag"
        if name in ("class", "id"):
            for token in value.split():
                words = [w.lower() for w in _SPLIT.split(_CAMEL.sub("-", token)) if w]
                if words and words[0] not in ("has", "no", "with", "without", "is", "js") and not HINTS.isdisjoint(words):
                    if tag == "article" and HINTS.isdisjoint(words[-1:]):
                        continue
                    found = "comments" if found == "comments" or not COMMENT_WORDS.isdisjoint(words) else "words"
    return found


def parse_dom(page: str) -> Node:
    """The body as a tree; kids are nodes and text strings, with None where a line breaks."""
    root = Node("body", None)
    at, open_nodes = root, ["body"]
    pos, end = 0, len(page)
    while pos < end:
        m = _TOKEN.search(page, pos)
        if m is None:
            at.kids.append(page[pos:])
            break
        if m.start() > pos:
            at.kids.append(page[pos : m.start()])
        pos = m.end()
        if m[0].startswith("<![CDATA["):
            at.kids.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in open_nodes[1:]:
                while open_nodes[-1] != tag:
                    open_nodes.pop()
                    at = at.parent
                open_nodes.pop()
                at = at.parent
            elif tag == "p" or tag == "br":
                at.kids.append(None)
            continue
        if tag in ("html", "body"):
            continue
        for k in range(len(open_nodes) - 1, 0, -1):
            name = open_nodes[k]
            if tag in ENDED_BY.get(name, ()):
                for _ in range(len(open_nodes) - k):
                    open_nodes.pop()
                    at = at.parent
                break
            if name in WALLS or name in BLOCKS and name != "p":
                break
        if tag == "br" or tag == "hr":
            at.kids.append(None)
            continue
        node = Node(tag, at)
        node.mark = _mark(tag, m[3])
        if tag not in HIDDEN:
            at.kids.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, pos)
            pos = close.end() if close else end
            continue
        open_nodes.append(tag)
        at = node
    return root


def _length(text: str) -> int:
    """Characters of a text node, 0 if blank."""
    return len(html.unescape(text) if "&" in text else text) if not text.isspace() else 0


def _tree(body: Node) -> list[Node]:
    """All nodes, parents before children."""
    order, todo = [], [body]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [k for k in x.kids if isinstance(k, Node)]
    return order


def _furniture(order: list[Node], hints: bool = True) -> None:
    """Set ``noise`` on furniture and all below it, and ``soft`` where only a class word says so."""
    for x in reversed(order):
        x.plain, x.articles, x.keeps = 0, int(x.tag in ("article", "main")), x.tag in ("main", "h1")
        for k in x.kids:
            if isinstance(k, str):
                x.plain += _length(k)
            elif k is not None:
                x.plain += k.plain
                x.keeps |= k.keeps
                x.articles += k.articles
        if x.tag == "a" or hints and x.mark == "tag":
            x.plain = 0
    if not hints:
        return
    whole, articles = order[0].plain, order[0].articles
    inside, heads = set(), set()  # nodes of an article or main element, and of a header in one
    for x in order[1:]:
        up = x.parent
        x.noise, x.soft = up.noise, up.soft
        if up.tag in ("article", "main") or id(up) in inside:
            inside.add(id(x))
        if x.noise:
            continue
        if x.mark == "tag":
            x.noise = True
        elif x.mark == "comments":
            x.noise = x.plain < whole or not x.keeps and (x.plain <= MOST * whole or x.articles < articles)
        elif x.mark:
            x.soft |= not x.keeps and (x.plain <= MOST * whole or x.articles < articles)
        elif x.tag == "header" and id(x) not in inside:
            x.noise = True
        elif x.tag == "header" or id(up) in heads and x.tag not in HEADINGS:
            # of a header inside an article its headings are text
            heads.add(id(x))
            x.noise = x.tag != "header" and not x.keeps
            x.kids = [k for k in x.kids if isinstance(k, Node)]


def _measure(order: list[Node]) -> None:
    """Link-adjusted characters per tag of every node, and the sums over its children."""
    for x in reversed(order):
        x.chars = x.tags = x.link_chars = x.link_tags = x.bare_chars = x.bare_tags = 0
        for k in x.kids:
            if isinstance(k, str):
                x.chars += _length(k)
            elif k is not None:
                x.chars += k.chars
                x.tags += 1 + k.tags
                x.link_chars += k.link_chars
                x.link_tags += k.link_tags + (k.tag == "a" or k.noise or k.soft)
                x.bare_chars += k.bare_chars
                x.bare_tags += k.bare_tags + (k.tag == "a" or k.noise)
        if x.tag == "a" or x.noise:
            x.link_chars = x.bare_chars = x.chars
        elif x.soft:
            x.link_chars = x.chars
    body = order[0]
    body_links, body_chars = max(1, body.link_chars), max(1, body.chars)
    for x in reversed(order):
        if x.noise or x.soft:
            x.density = 0.0
            x.bare = 0.0 if x.noise else composite_density(x.chars, x.tags, x.bare_chars, x.bare_tags, body_links, body_chars)
        else:
            x.density = x.bare = composite_density(x.chars, x.tags, x.link_chars, x.link_tags, body_links, body_chars)
        x.total = sum(k.density for k in x.kids if isinstance(k, Node))


def composite_density(chars: int, tags: int, link_chars: int, link_tags: int, body_links: int, body_chars: int) -> float:
    """Characters per tag, weighed by how much of them is not links; 0 without text."""
    if not chars:
        return 0.0
    c, t, lc, lt = chars, max(1, tags), max(1, link_chars), max(1, link_tags)
    gain = c / lc * t / lt + (not link_chars)
    if gain <= 1:
        return 0.0
    base = math.log(c / max(1, c - link_chars) * lc + body_links / body_chars * c + math.e)
    return c / t * math.log(gain) / math.log(max(base, 1.0001))


def _content(order: list[Node]) -> tuple[list[Node], float, float]:
    """The subtrees that are the article, in page order, the threshold, and the mean density of the core's parts."""
    body = order[0]
    best, todo = body, [body]
    while todo:  # in page order, so that ties end on the first
        x = todo.pop()
        if x.total > best.total:
            best = x
        todo += [k for k in reversed(x.kids) if isinstance(k, Node)]
    parts = [k.density for k in best.kids if isinstance(k, Node) and k.density > 0]
    mean = sum(parts) / len(parts) if parts else best.density
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    article = max((k for k, x in enumerate(path) if x.tag in ("article", "main")), default=0)
    chosen = {id(best)}
    for at, (child, parent) in enumerate(zip(path, path[1:]), 1):
        if parent is not body and any(isinstance(k, str) and not k.isspace() for k in parent.kids):
            chosen.add(id(parent))  # its own text can't be taken without it
        for k in parent.kids:
            if isinstance(k, Node) and k is not child and _joins(k, best, threshold, mean, at <= article):
                chosen.add(id(k))
    picked, todo = [], [body]
    while todo:
        x = todo.pop()
        if id(x) in chosen:
            picked.append(x)
        else:
            todo += [k for k in reversed(x.kids) if isinstance(k, Node)]
    return picked, threshold, mean


def _joins(x: Node, best: Node, threshold: float, mean: float, same_article: bool) -> bool:
    """Whether a sibling on the core's path to the body is part of the article.

    Its density must reach the threshold, and it must be running text or weigh against
    the core by the sum of its densities.  The tags break ties: a short text has a low
    density whatever it is, so headings and what shares the core's article or main
    element join if most of their characters aren't links.
    """
    if x.soft:
        return same_article and x.bare >= mean > 0
    if x.density <= 0:
        return False
    if x.tag in HEADINGS or same_article:
        return 2 * x.link_chars < x.chars
    return x.density >= threshold and (x.tag in TEXT_TAGS or 4 * x.total >= best.total)


def _dropped(x: Node, threshold: float, mean: float) -> bool:
    """Inside the article: furniture, what a class word doubts unless it is dense, and lists of links whose density is below the threshold."""
    if x.noise:
        return True
    if x.soft and not x.parent.soft:  # below it the first decision holds
        return x.bare < mean
    return x.bare_tags >= MENU_LINKS and x.bare < threshold and x.chars > 0 and 10 * x.bare_chars >= 9 * x.chars and x.tag in BLOCKS


def _blocks(node: Node, threshold: float, mean: float) -> list[str]:
    """Texts of the blocks below a node, white space collapsed, empty ones dropped."""
    out, line = [], []

    def close() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            line.append(x)
        elif x is node or not _dropped(x, threshold, mean):
            if x.tag in BLOCKS:
                close()
                todo.append(None)
            todo += reversed(x.kids)
    close()
    return out


def main_text(page: str | None, density: bool = True, hints: bool = True) -> str:
    """The article of one HTML page; '' for null, empty or text-free pages.

    For comparison: without ``hints`` names of tags and classes say nothing about
    furniture; without ``density`` no subtree is chosen and no class word decides, so the
    body is printed without what its tag or role, or being a comment, excludes.
    """
    if not page:
        return ""
    body = parse_dom(page)
    order = _tree(body)
    _furniture(order, hints)
    if not density:
        return "\n".join(_blocks(body, 0.0, 0.0))
    _measure(order)
    if not body.chars:
        return ""
    picked, threshold, mean = _content(order)
    return "\n".join(b for node in picked for b in _blocks(node, threshold, mean))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row.

    Null html gives an empty text; null ids and urls pass through; repeated rows are
    rows of their own; other columns are ignored; an empty table gives no row.  A page is
    one DOM in memory, in proportion to its length, and deep nesting needs no recursion.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    rows = picked(pages, page_id=(id_col, "long"), url=(url_col, "string"), html=(html_col, "string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
