"""Main text of web pages by a maximum-scoring subsequence (operator 1).

A page is a sequence of words and tags. Words score positive and tags negative; the contiguous part of
the page with the largest sum, found by one linear scan, is its main text. Weights come from labelled
pages: pages that mark their content themselves, by one ``article`` or ``main`` element, tell which words
and tags lie inside and which outside. A feature's weight is the logarithm of the odds of its rates
inside and outside, kept positive for words and negative for tags, and small enough that no single tag
outweighs a paragraph. Words inside elements that hold no content of the page (menus, page headers,
footers, sidebars, notices, adverts, forms, reader comments, by tag, role, class or id) are never part of
the text, and neither they nor their tags score, so that the text goes on behind them; scripts, styles, markup declarations, drawings
and the title are not even read, and a tag that never ends takes what follows with it, as in a browser. An element ends where a browser ends it: at its end tag, at its parent's, or at a
start tag that implies its end (``p``, ``li``, ``td`` and the like); the head needs no end. A class, id or role tells an element without
content only if it names the element itself (``site-header``, ``cookie-bar``), not a layout (``no-sidebar``, ``with-nav``),
a part of the content (``article-header``) or a heading, and ids of common words inside the content are anchors. A form outside
the content that holds paragraphs, headings or the like and more than ``WORDS_A_FIELD`` words for each field is a frame around the page. An article inside an element without content belongs to that,
unless its end tag is missing. The labels only weigh; the scan alone decides where the text begins and ends.

The text's character references are decoded, white space inside a block becomes one space, blocks are
joined in page order by one space. Inline tags do not part words; line breaks and all other tags do.

Defined results: null or empty html, and pages without a word of content, give the empty text; every
row gives one row; without labelled pages the weights are ``WORD`` and ``TAG``; an empty table gives no
row; other columns are not read.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WORD, TAG = 1.0, -0.5
LEAST_WORD, MOST_WORD, LEAST_TAG, MOST_TAG = 0.5, 3.0, -3.0, -0.05
# Elements whose text is never shown as text.
HIDDEN = ("script", "style", "template", "noscript", "iframe", "title")
# Likewise, but these end like other elements, and the first may close itself.
EMBEDDED = ("svg", "object", "canvas", "audio", "video", "map")
# Elements that hold no content.
ASIDE = ("nav", "footer", "aside", "form", "button", "select", "textarea", "input", "fieldset", "dialog", "menu")
# Elements that do not part words.
INLINE = ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr")
# Elements without an end.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
# What a class, id or role of an element without content has among its words.
MARKS = (
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "tabs",
    "header", "masthead", "footer", "sidebar", "aside", "widget", "widgets", "complementary", "contentinfo", "search", "login", "signup", "newsletter", "subscribe", "form",
    "comment", "comments", "disqus", "respond", "replies", "reply", "notice", "notices", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "alert",
    "share", "sharing", "social", "related", "recommended", "recommendations", "copyright", "legal", "disclaimer", "skip",
)
# Marks that stand for the whole page's part only beside words of PAGE, and those that are also common ids of a section's subject.
PLACED = ("header", "footer", "masthead", "banner")
SUBJECTS = ("promotion", "navigation", "menu", "tabs", "search", "login", "signup", "form", "notice", "notices", "consent", "alert", "share", "sharing", "social", "related", "recommended", "recommendations", "copyright", "legal", "disclaimer", "complementary", "subscribe", "newsletter", "advertising", "header", "footer", "cookies")
PAGE = ("site", "page", "global", "main", "top", "bottom", "primary", "secondary", "blog", "web", "website", "app", "wp", "sticky", "fixed", "mobile", "desktop", "l", "c", "m", "o", "u", "js", "id")
# Words behind a mark that leave its sense.
SHAPES = (
    "container", "wrapper", "wrap", "box", "block", "area", "section", "inner", "outer", "bar", "list", "item", "items", "link", "links", "left", "right", "top", "bottom", "main", "primary", "secondary",
    "mobile", "desktop", "slot", "unit", "group", "row", "col", "column", "panel", "icons", "icon", "button", "buttons", "btn", "media", "posts", "post", "articles", "stories", "news", "label", "text", "body", "title", "message", "info", "policy", "law", "dialog", "thread",
)
# Words that make of a mark a state of the layout.
STATES = ("no", "not", "non", "without", "with", "has", "have", "hide", "show", "toggle", "layout", "grid", "enabled", "disabled", "free", "open", "opened", "closed", "collapsed", "expanded", "active", "visible", "on", "off", "above", "below", "under", "after", "before", "beside")
# A class, id or role that names the content, whatever else is said.
CONTENT = ("content", "article", "entry", "story", "main", "maincontent", "main-content", "page-content", "site-content", "post-content", "entry-content", "article-content", "article-body", "post-body", "story-body")
# Marks that have one sense only, whatever follows.
LEADING = ("ad", "ads", "advert", "adverts", "advertisement", "adsense", "sponsored", "sidebar", "navbar", "breadcrumb", "breadcrumbs", "comment", "comments", "disqus", "gdpr")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup")
# Elements that may close themselves.
FOREIGN = ("svg", "math", "mi", "mo", "mn", "ms", "mtext", "mspace", "mrow", "mprescripts", "none")
_ASIDE, _INLINE, _VOID, _MARKS, _EMBEDDED, _PLACED, _SUBJECTS, _PAGE, _SHAPES, _STATES, _CONTENT = map(frozenset, (ASIDE, INLINE, VOID, MARKS, EMBEDDED, PLACED, SUBJECTS, PAGE, SHAPES, STATES, CONTENT))
_NEVER = frozenset(("html", "head", "body", "main", "article", *HEADINGS))
# Start tags that imply the end of open elements: (these, unless one of those is open inside them).
_CELLS = ("td", "th", "caption", "table")
_P = ("p",), (*_CELLS, "button", "object")
_IMPLIED = dict.fromkeys(("address", "article", "aside", "blockquote", "center", "details", "dialog", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul"), (_P,))
_IMPLIED |= {
    "li": ((("li",), ("ul", "ol", "menu", *_CELLS)), _P),
    **dict.fromkeys(("dd", "dt"), ((("dd", "dt"), ("dl", *_CELLS)), _P)),
    **dict.fromkeys(("td", "th"), ((("td", "th", "caption"), ("table",)),)),
    "tr": ((("tr", "caption"), ("table",)),),
    **dict.fromkeys(("tbody", "thead", "tfoot"), ((("tbody", "thead", "tfoot", "tr", "caption"), ("table",)),)),
    "option": ((("option",), ("select", "optgroup")),),
    "optgroup": ((("optgroup", "option"), ("select",)),),
}
# End tags do not reach out of a cell; these do.
_FAR = frozenset(("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption", "article", "main", "body", "html"))
_PIECE = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(" + "|".join(HIDDEN) + r")(?=[\s/>])[^>]*+>(?:.*?</\1(?=[\s/>])[^>]*+(?:>|\Z)|.*\Z)"
    r"|<(/?)([a-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s\"'>]++)))?", re.IGNORECASE)
_MARKED = re.compile(r"class|id|role|hidden|style", re.IGNORECASE)
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.IGNORECASE)
_FIELD = re.compile(r"<(?:select|textarea|button|input(?!(?=[^>]*+)[^>]*?\btype\s*=\s*[\"']?hidden))(?=[\s/>])", re.IGNORECASE)
_BARE = re.compile(r"<(script|style|select|textarea|button)(?=[\s/>]).*?</\1(?=[\s/>])[^>]*+>|<[^>]*+>", re.IGNORECASE | re.DOTALL)
_END_OF_FORM = re.compile(r"</form(?=[\s/>])|\Z", re.IGNORECASE)
_PART = re.compile(r"<(?:p|h[1-6]|article|main|nav|section)(?=[\s/>])", re.IGNORECASE)
_TAG = re.compile(r"<(/?)([a-z][^\s/>]*+)", re.IGNORECASE)
WORDS_A_FIELD = 20  # a form with more words for each of its fields holds a page, not questions
_BREAK = re.compile(r"[^a-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")


def _named(words: list[str], anchor: bool) -> bool:
    """Whether the words of one class, id or role name an element without content; anchor: an id that may just be a link's target."""
    if not _STATES.isdisjoint(words):
        return False
    if words and words[0] in LEADING:
        return True
    last = len(words)
    while last and words[last - 1] not in _MARKS and (words[last - 1] in _SHAPES or words[last - 1].isdigit()):
        last -= 1
    if not last or words[last - 1] not in _MARKS or anchor and words[last - 1] in _SUBJECTS:
        return False
    return words[last - 1] not in _PLACED or all(w in _PAGE or w in _MARKS for w in words[: last - 1])


def _attributes(attributes: str) -> dict[str, str]:
    """Values by name, the first of each; of class, id, role and what hides elements."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name in ("class", "id", "role", "hidden", "style", "aria-hidden"):
            found.setdefault(name, m[2] or m[3] or m[4] or "")
    return found


def _hidden(said: dict[str, str]) -> bool:
    """Whether an element is not shown; a class that hides it only on some screens does not."""
    if "hidden" in said and said["hidden"].lower() != "false" or said.get("aria-hidden", "").strip().lower() == "true" or _UNSEEN.search(said.get("style", "")):
        return True
    classes = said.get("class", "").lower().split()
    return "hidden" in classes and not any(":" in c for c in classes)


def _no_content(name: str, attributes: str, in_content: bool) -> bool:
    if name in _ASIDE:
        return True
    if name == "header" and not in_content:
        return True
    if name in _NEVER or not attributes or not _MARKED.search(attributes):
        return False
    said = _attributes(attributes)
    if _hidden(said):
        return True
    found = False
    for kind in ("class", "id", "role"):
        anchor = kind == "id" and (in_content or name == "section")
        for value in said.get(kind, "").split():
            if value.lower() in _CONTENT:
                return False
            found = found or _named([w for w in _BREAK.split(re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", value).lower()) if w], anchor)
    return found


def _holds_page(page: str, start: int) -> bool:
    """Whether the form that begins before ``start`` is a frame around content: it has parts of a page in it, and few fields for its words."""
    inner = page[start : _END_OF_FORM.search(page, start).start()]
    if not _PART.search(inner):
        return False
    fields = len(_FIELD.findall(inner))
    return len(_BARE.sub(" ", inner).split()) > WORDS_A_FIELD * fields


def _ended(page: str) -> set[int]:
    """Where the start tags stand that have an end tag of their own: each end tag takes the last open one of its name."""
    open_: dict[str, list[int]] = {}
    out = set()
    for m in _TAG.finditer(page):
        held = open_.setdefault(m[2].lower(), [])
        if not m[1]:
            held.append(m.start())
        elif held:
            out.add(held.pop())
    return out


class _Open:
    """The open elements of a page, outermost first."""

    def __init__(self):
        self.names: list[str] = []
        self.at: dict[str, list[int]] = {}  # of each name: its places
        self.blocks: list[int] = []  # places of elements that are not inline

    def last(self, names: tuple[str, ...]) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def cut(self, place: int) -> None:
        while len(self.names) > place:
            self.at[self.names.pop()].pop()
        while self.blocks and self.blocks[-1] >= place:
            self.blocks.pop()

    def imply(self, name: str) -> None:
        """Ends what the start tag ``name`` ends."""
        for ended, walls in _IMPLIED.get(name, ()):
            wall = self.last(walls)
            while (place := self.last(ended)) > wall:
                self.cut(place)

    def start(self, name: str) -> None:
        if name not in _INLINE:
            self.blocks.append(len(self.names))
        self.at.setdefault(name, []).append(len(self.names))
        self.names.append(name)

    def end(self, name: str) -> None:
        """Ends the innermost element of that name with all inside it; inline tags end nothing around a block, others nothing around a cell."""
        place = self.last((name,))
        if place < 0:
            return
        if name in _INLINE:
            wall = self.blocks[-1] if self.blocks else -1
        elif name in _FAR:
            wall = self.last(("table",)) if name in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else -1
        else:
            wall = self.last(("td", "th", "caption"))
        if place > wall:
            self.cut(place)


def pieces(page: str) -> Iterator[tuple[str, str, bool, bool]]:
    """(tag, text, outside, inside): in page order each tag (text empty) or text (tag empty); outside: in or of an element without content; inside: in an article or main."""
    at = 0
    tree = _Open()
    articles, mains = tree.at.setdefault("article", []), tree.at.setdefault("main", [])
    ended: set[int] | None = None
    began = -1  # where the tag of the open element without content stands
    out, out_content, unread = -1, False, False  # place of the open element without content, whether that is in content, and whether it is embedded
    for m in _PIECE.finditer(page):
        if m.start() > at and not unread:
            yield "", page[at : m.start()], out >= 0, bool(articles or mains)
        at = m.end()
        name = m[3]
        if not name:
            continue
        name, attributes, end = name.lower(), m[4], bool(m[2])
        outside = out >= 0
        if end:
            tree.end(name)
        elif not unread:
            tree.imply(name)
        if out >= len(tree.names):
            out, unread = -1, False
        content = bool(articles or mains)
        if not end:
            if name in FOREIGN and attributes.endswith("/"):
                continue
            if name in ("article", "main"):
                if out >= 0 and not out_content:
                    ended = _ended(page) if ended is None else ended
                    if began not in ended:
                        out, unread = -1, False  # the end of what was open is missing: content begins
            elif name == "form" and tree.at.get("form"):
                continue  # forms do not nest
            elif out < 0 and name not in _VOID and (name in _EMBEDDED or _no_content(name, attributes, content)) and not (name == "form" and not content and _holds_page(page, m.end())):
                out, out_content, unread, began = len(tree.names), content, name in _EMBEDDED, m.start()
            if name not in _VOID:
                tree.start(name)
            outside = out >= 0
        if not unread and not (end and name in _EMBEDDED):
            yield name, "", outside, content
    if at < len(page) and not unread:
        yield "", page[at:], out >= 0, bool(articles or mains)


KNOWN = frozenset((*ASIDE, *INLINE, *VOID, "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"))


def _feature(tag: str) -> str:
    return tag if tag in KNOWN else "other"


def learn(pages: DataFrame) -> dict[str, float]:
    """Weights by feature ("" for words), from the counts over all labelled pages; a labelled page has one article, or one main and no article."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                low = page.lower()
                marks = low.count("<article"), low.count("<main")
                if marks[0] != 1 and marks != (0, 1):
                    continue
                for tag, text, outside, inside in pieces(page):
                    if tag:
                        seen[_feature(tag), inside and not outside] += 1
                    else:
                        seen["", inside and not outside] += len(text.split())
        rows = sorted(seen.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.bool_()), pa.array([n for _, n in rows], pa.int64())], names=["feature", "inside", "n"])

    rows = pages.where("html is not null").select("html").mapInArrow(count, "feature string, inside boolean, n long").groupBy("feature", "inside").agg(F.sum("n").alias("n")).collect()
    counts = {(r["feature"], r["inside"]): r["n"] for r in rows}
    total = {side: sum(n for (_, s), n in counts.items() if s is side) for side in (True, False)}
    if not all(total.values()):
        return {"": WORD}
    weights = {}
    for f in {k[0] for k in counts}:
        odds = math.log((counts.get((f, True), 0) + 1) / (total[True] + 1)) - math.log((counts.get((f, False), 0) + 1) / (total[False] + 1))
        weights[f] = min(MOST_TAG, max(LEAST_TAG, odds)) if f else min(MOST_WORD, max(LEAST_WORD, odds))
    return weights


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The page's main text."""
    if not page:
        return ""
    word = weights.get("", WORD)
    parts: list[str] = []
    best = total = 0.0
    start = first = last = 0  # of parts: where the sum at hand, and the best one, begins; where that ends
    for tag, text, outside, _ in pieces(page):
        if tag:
            # What is left out anyway must not end the text around it.
            total += 0.0 if outside else weights.get(_feature(tag), TAG)
            if tag not in _INLINE:
                parts.append(" ")
        else:
            if text.isspace():
                words = 0
            else:
                words = len(text.split())
                total += 0.0 if outside else word * words
            if not outside:
                parts.append(text)
            elif words:
                parts.append(" ")
        if total <= 0:
            total, start = 0.0, len(parts)
        elif total > best:
            best, first, last = total, start, len(parts)
    return " ".join(references.unescape("".join(parts[first:last])).split())


def extract_pages(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """page_id, url and text of every row."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(p, weights) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(texts, "page_id long, url string, text string")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_pages(pages, learn(pages)).withColumn("n_chars", F.char_length("text").cast("long"))
