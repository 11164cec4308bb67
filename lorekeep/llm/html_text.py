"""Main-text extraction from HTML by tree scoring.

A page becomes a tree of block elements. Every paragraph passes points (one, one for each comma, up to three for
length) to its parent, half to the grandparent and ever less further up; a container's points are discounted by the
share of its text that stands in links. The best container is kept, widened to the article or main element around it,
with those of its siblings that score like it or read like prose. Menus, headers, footers, sidebars, notices, adverts,
forms, scripts, comments and hidden parts are left out of the tree by element, role, class or id. Within an article (an
article or main element, or one that is named so) a class or id counts only if all its words are of that kind: a section
named related-work or share-prices stays, a list named related-posts goes; noscript is text there. Formulas stay
everywhere, without their annotations. A class or id does not count where another names the article, where it tells of a state (has-sidebar, header-fixed) or an article's head,
where the element holds more text than all that is kept and the page's main heading, or where nothing would be left.
Lists of links stay within the chosen container; beside it, and where that is the whole body, they count as menus. A
table cell is a container where it holds paragraphs.

Character references are decoded, white space (line breaks included) inside a block becomes one space, and blocks are
joined in page order by a newline. Nothing else is dropped or capped. Each page is worked out in its own row.

Defined cases: null or empty pages, and pages without text, give the empty text; unclosed or crossed elements are
closed as their nesting demands; repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import read_table, ship_package

_PARTS = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+|[^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup"
    " html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_RAW = frozenset("script style noscript template iframe textarea title svg annotation annotation-xml object canvas select button xmp noembed noframes".split())
_DROPPED = frozenset("nav aside footer form menu dialog search head fieldset".split())
_CLOSE_EACH_OTHER = {
    "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
#: Elements that an implied end doesn't reach beyond.
_SCOPE = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",)} | {x: ("table",) for x in ("tr", "td", "th", "thead", "tbody", "tfoot")}
_KEEP_WHATEVER = frozenset("html body article main".split())
_UNLIKELY = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisement|adsense|banner|breadcrumbs?|comments?|commentlist|respond|replies|cookies?|consent|gdpr|disqus|footer|footnav|header|masthead|"
    r"menu|modal|nav|navbar|navigation|newsletter|notice|notification|alert|pagination|pager|popup|overlay|promo|promoted|related|recommended|share|sharing|"
    r"shoutbox|sidebar|skyscraper|social|sponsor|sponsored|subscribe|subscription|toolbar|topbar|widget|outbrain|taboola|login|signup)\d*(?:[-_\s]|$)",
    re.I,
)
#: Class names that tell how an element looks, or of an article's own head, and those that name the article.
_STATE = re.compile(r"(?:has|no|with|without|hide|show|is)[-_].*|.*[-_](?:fixed|sticky|open|closed|enabled|disabled|visible|on|off|left|right)|(?:entry|post|article|page|story|content)[-_]header", re.I)
_ARTICLE = re.compile(r"(?:(?:the|site|page|main|blog|entry|post|article|story)[-_])?(?:article|main|content|post|entry|story)(?:[-_](?:body|content|text|wrap|wrapper|container|inner|\d+))*", re.I)
#: Names of an article's own text, and words that beside an unlikely one leave a name unlikely within an article: there the
#: whole name must be made of such words (``related-posts`` is, ``related-work`` isn't).
_OWN_TEXT = re.compile(r"(?:(?:article|post|entry|story)[-_]?(?:body|content|text)|h-entry|hentry|(?:blog|news)[-_](?:post|article|entry))", re.I)
_UNLIKELY_WORD = re.compile(
    r"ads?|adverts?|advertisement|adsense|banner|breadcrumbs?|comments?|commentlist|respond|replies|cookies?|consent|gdpr|disqus|footer|footnav|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|"
    r"notification|alert|pagination|pager|popup|overlay|promo|promoted|related|recommended|share|sharing|shoutbox|sidebar|skyscraper|social|sponsor|sponsored|subscribe|subscription|toolbar|topbar|widget|outbrain|taboola|login|signup|"
    r"list|lists|posts?|articles?|stories|story|news|items?|links?|buttons?|icons?|box|section|area|wrap|wrapper|container|block|form|bar|slot|unit|inner|outer|top|bottom|left|right|site|page|main|thread|us|this|me|"
    r"primary|secondary|global|mobile|desktop|sticky|content|contents|panel|module|col|column|row|grid|group|media|bookmarks?|network|networks|count|tools?|title|heading|[a-z]?\d*",
    re.I,
)
_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar toolbar form".split())


class _Node:
    __slots__ = ("tag", "parent", "parts", "score", "chars", "linked", "links", "inside")

    def __init__(self, tag: str, parent: _Node | None, inside: bool = False):
        self.tag, self.parent, self.inside = tag, parent, inside  # inside: within an article
        self.parts: list = []  # nodes, and blocks of text as strings
        self.score, self.chars, self.linked, self.links = 0.0, 0, 0, 0


def _names(attributes: dict[str, str]) -> str:
    return entities.unescape(f"{attributes.get('class', '')} {attributes.get('id', '')}")


def _is_article(tag: str, raw: str) -> bool:
    """Whether an element is an article, by its kind or its name."""
    if tag in ("article", "main") or not raw.strip():
        return tag in ("article", "main")
    return any(map(_OWN_TEXT.fullmatch, _names({k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(raw)}).split()))


def _is_unlikely(tag: str, raw: str, inside_article: bool) -> str:
    """Why the element is never main text: "surely" by its kind, "named" by its class or id; empty otherwise."""
    if tag in _DROPPED or tag == "header" and not inside_article:
        return "surely"
    if not raw.strip() or tag in _KEEP_WHATEVER:
        return ""
    attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(raw)}
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
        return "surely"
    if attributes.get("role", "").lower() in _ROLES:
        return "surely"
    names = _names(attributes)
    if inside_article:
        names = " ".join(n for n in names.split() if all(map(_UNLIKELY_WORD.fullmatch, re.split(r"[-_]", n))))
    if not _UNLIKELY.search(names) or any(map(_ARTICLE.fullmatch, names.split())):
        return ""
    return "named" if any(_UNLIKELY.search(n) and not _STATE.fullmatch(n) for n in names.split()) else ""


def _tree(page: str, spared: frozenset[int] | None = frozenset()) -> tuple[_Node, list[tuple[int, int, bool]]]:
    """The page's blocks, without what never is main text; and of each element left out for its class or id its place,
    letters, and whether it holds a main heading. Those at the places ``spared`` are kept (None: all of them)."""
    left_out: list[tuple[int, int, bool]] = []
    named, letters, heading = -1, 0, False
    root = node = _Node("#root", None)
    text: list[str] = []  # of the block that is open
    linked = links = 0
    in_link = False
    skip: list[str] = []  # open elements within one that is left out
    raw: str | None = None

    def close_block():
        nonlocal text, linked, links
        if text:
            block = " ".join("".join(text).split())
            if block:
                node.parts.append(block)
                points = 1 + block.count(",") + min(3.0, len(block) / 100)
                share = min(1.0, linked / len(block))
                up, level = (node.parent if node.tag in _PARAGRAPHS else node), 0
                at = node
                while at is not None:  # text and links count for all that hold them
                    at.chars += len(block)
                    at.linked += min(linked, len(block))
                    at.links += links
                    at = at.parent
                points *= 1 - share
                while up is not None and level < 6:
                    up.score += points / (1, 2, 6, 9, 12, 15)[level]
                    up, level = up.parent, level + 1
            text, linked, links = [], 0, 0

    def add(piece: str):
        nonlocal linked, letters
        if skip and raw is None:
            letters += len(piece.strip())
        elif piece and not skip and raw is None:
            piece = entities.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if in_link:
                linked += len(piece.strip())

    def leave(to: _Node):
        nonlocal node
        close_block()
        node = to

    at = 0
    for m in _PARTS.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, ends = m[2].lower(), bool(m[1])
        if raw is not None:
            if ends and tag == raw:
                raw = None
            continue
        if skip:
            heading = heading or tag in ("h1", "main")
            if ends:
                if tag in skip:
                    while skip.pop() != tag:
                        pass
            elif tag in _RAW and not m[3].endswith("/"):
                raw = tag
            elif tag in _BLOCKS or tag == skip[0]:
                if tag == "p" and skip[-1] == "p" or tag == "li" and skip[-1] == "li":
                    skip.pop()
                skip.append(tag)
            if named >= 0 and (not skip or ends and tag in ("body", "html")):
                left_out.append((named, letters, heading))
                named = -1
            if not skip or not ends or tag not in ("body", "html"):
                continue
            skip = []  # the page ends within it
        if not ends and tag in _RAW and not (tag == "noscript" and node.inside):
            raw = None if m[3].endswith("/") else tag
            continue
        if tag == "br":
            text.append(" ")
        elif tag == "hr":
            close_block()
        elif tag == "a":
            in_link = not ends
            links += not ends
        elif ends:
            if tag in _BLOCKS:
                to = node
                while to is not None and to.tag != tag:
                    to = to.parent
                if to is not None:
                    in_link = False
                    leave(to.parent)
        elif tag in _BLOCKS:
            to = node
            if node.tag == "p":  # every block closes a paragraph
                leave(node.parent)
            elif tag in _CLOSE_EACH_OTHER:
                while to is not None and to.tag not in _CLOSE_EACH_OTHER[tag] and to.tag not in _SCOPE[tag]:
                    to = to.parent
                if to is not None and to.tag in _CLOSE_EACH_OTHER[tag]:
                    last = to
                    while last.parent is not None and last.parent.tag in _CLOSE_EACH_OTHER[tag]:
                        last = last.parent
                    leave(last.parent)
            close_block()
            in_link = False
            why = _is_unlikely(tag, m[3], node.inside)
            if why and not (why == "named" and (spared is None or m.start() in spared)):
                if not m[3].endswith("/"):
                    skip = [tag]
                    named, letters, heading = (m.start() if why == "named" else -1), 0, False
                continue
            child = _Node(tag, node, node.inside or _is_article(tag, m[3]))
            node.parts.append(child)
            node = child
        elif m[3].strip() and not m[3].endswith("/") and tag in ("span", "ins", "small") and _is_unlikely(tag, m[3], True):
            skip = [tag]
    add(page[at:])
    if skip and named >= 0:
        left_out.append((named, letters, heading))
    close_block()
    return root, left_out


def _kept_tree(page: str) -> _Node:
    """The tree, with elements that were left out for a class or id though they hold the page's heading and most text."""
    spared: frozenset[int] = frozenset()
    for _ in range(8):
        root, left_out = _tree(page, spared)
        more = {at for at, letters, heading in left_out if heading and letters > root.chars}
        if not more:
            return root if root.chars or not left_out else _tree(page, None)[0]
        spared |= more
    return _tree(page, None)[0]


_PARAGRAPHS = frozenset("p pre blockquote li td th dd dt h1 h2 h3 h4 h5 h6 figcaption summary address".split())
_LISTS = frozenset("ul ol dl div section table".split())


def _density(node: _Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _blocks(node: _Node, out: list[str], whole: bool = False) -> None:
    """The node's blocks in order; unless ``whole``, without lists that are mostly links."""
    todo = [iter((node,))]
    while todo:
        part = next(todo[-1], None)
        if part is None:
            todo.pop()
        elif isinstance(part, str):
            out.append(part)
        elif whole or part is node or not (part.tag in _LISTS and part.links > 1 and _density(part) > 0.66):
            todo.append(iter(part.parts))


def main_text(page: str | None) -> str:
    """The article's blocks, joined by newlines; empty if there is none."""
    if not page:
        return ""
    root = _kept_tree(page)
    best, best_score, todo = root, -1.0, [root]
    while todo:
        node = todo.pop()
        score = node.score * (1 - _density(node))
        if (node.tag not in _PARAGRAPHS or node.tag == "td" and node.score) and score >= best_score:  # of equals the first in the page, as children are taken from the end
            best, best_score = node, score
        todo += [p for p in node.parts if isinstance(p, _Node)]
    outer = best
    while outer is not None and outer.tag not in ("article", "main"):
        outer = outer.parent
    best = outer or best
    kept: list[str] = []
    siblings = best.parent.parts if best.parent is not None else [best]
    least = max(1.0, 0.2 * best_score)
    for part in siblings:
        if part is best:
            _blocks(part, kept, best.tag not in ("#root", "html", "body"))
        elif isinstance(part, _Node) and best.tag != "main":
            density, score = _density(part), part.score * (1 - _density(part))
            prose = part.tag in _PARAGRAPHS and (density < 0.25 and part.chars > 80 or part.tag[0] == "h" and density < 0.5)
            if score >= least or prose:
                _blocks(part, kept)
    return "\n".join(kept)


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html_col`` in ``text_col``, empty if there is none."""
    ship_package(pages.sparkSession)

    @F.pandas_udf("string")
    def of(html: pd.Series) -> pd.Series:
        return html.map(main_text, na_action=None)

    return pages.withColumn(text_col, of(F.coalesce(F.col(html_col), F.lit(""))))


def op10_html_text(spark, sf_dir):
    found = extract_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
