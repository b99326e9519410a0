"""Main-text extraction from HTML (operator 2).

The standard library's parser streams events; they are folded into lines, one
per block, each with its text, the tags it took and the container it lies in.
Structural boilerplate (menus, asides, forms, scripts, ...) is left out by tag,
role and class, inside a content container by whole names only. Over the remaining lines the ratio of text (outside links) to tags is smoothed with
a Gaussian; lines above the threshold cluster into content regions. A region
selects the content container it lies in (an article, a main part, or the
smallest element that holds the region), and that container's lines are the
text: short paragraphs between long ones stay.

A page is one row: no shuffle, and time and memory grow with the length of the page,
whatever is left unclosed in it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import in_batches, lean

# Elements whose whole content is no article text.
SKIP_TAGS = frozenset("""head script style noscript template nav header footer aside form button select option textarea
    input label iframe object embed svg math canvas audio video map menu dialog datalist""".split())
# Words of class, id and role attributes that mark such content, and ends of longer words.
SKIP_WORDS = frozenset("""ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion
    banner banners nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside header headers masthead
    footer footers cookie cookies consent gdpr notice notices notification notifications alert comment comments commentlist
    commentform disqus reply replies respond discussion related recommended share sharing social newsletter subscribe
    subscription signup login search popup modal overlay paywall widget widgets pagination complementary contentinfo""".split())
SKIP_ENDS = ("nav", "menu", "sidebar", "footer", "header", "banner", "comments", "advert")
COMMENT_WORDS = frozenset("comment comments reply replies".split())
# Inside a content container a name (of class or id) marks boilerplate if it is one of these words alone,
NAMES = frozenset("""ad ads nav navigation menu menus banner banners notice notices notification notifications alert alerts related
    recommended reply replies respond share sharing social subscribe subscription signup search widget widgets consent""".split())
# if any of its words is one of these,
TOKENS = frozenset("""adv advert adverts advertisement advertisements advertising adsbygoogle sponsor sponsored promo promotion navbar
    breadcrumb breadcrumbs sidebar sidebars cookie cookies gdpr comment comments commentlist commentform disqus newsletter paywall
    popup modal pagination masthead""".split())
# or if it is made of such words and of these.
HELPERS = frozenset("""reader readers user users post posts article articles page site story content inline top bottom left right mid
    middle inner google native mobile desktop list form box block area container wrapper section slot slots unit units link links
    button buttons icon icons bar footer header item items thread""".split())
# A state, not what the element is: has-comments, no-sidebar.
_STATES = frozenset("has no with without is not".split())
_ROWS = frozenset("table caption thead tbody tfoot tr th td".split())
CONTENT_TAGS = frozenset(("article", "main"))
CONTENT_WORDS = frozenset("article main content post entry story".split())
# Elements that begin and end a block.
BLOCK_TAGS = frozenset("""html body address article blockquote center dd details dir div dl dt fieldset figcaption figure
    h1 h2 h3 h4 h5 h6 hr li main ol p pre section summary table tbody td tfoot th thead tr ul caption""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr param".split())
# An opening tag that ends these open elements, as browsers do it.
_P_ENDERS = BLOCK_TAGS | {"nav", "header", "footer", "aside", "form", "menu"}
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
           "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset("html body article main section div table ul ol dl nav aside header footer form blockquote".split())
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_TAG_START = re.compile(r"<[A-Za-z/!?]")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HEADING_WORDS = frozenset("header masthead banner".split())


# What a head may hold; any other tag ends it, as browsers do it.
_HEAD_TAGS = frozenset("html head title meta link base style script noscript template bgsound basefont".split())
_RAW = frozenset("noscript template script style".split())
_FOREIGN = frozenset(("svg", "math"))
# Elements that cannot stand in a drawing or formula and end it.
_BREAKOUT = (BLOCK_TAGS | frozenset("""b big br code em embed i img menu meta nobr p ruby s small span strong strike sub sup tt u
    var aside nav header footer form section article main""".split())) - {"summary", "details", "html"}


def _marks(name: str, own_words: bool) -> bool:
    """Is a whole class or id name that of boilerplate? ``own_words``: it may be made
    of the article's own words, so all of its words must be known."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or words[0] in _STATES:
        return False
    known = [w in NAMES or w in TOKENS for w in words]
    if len(words) == 1:
        return words[0] in TOKENS if own_words else known[0]
    return (not own_words and any(w in TOKENS for w in words)) or (
        any(known) and all(k or w in HELPERS for k, w in zip(known, words, strict=True)))


@dataclass
class Line:
    text: str
    tags: int
    plain: int       # characters outside links, white space left out
    at: int          # serial number of the innermost open element, 0 if none
    article: int     # and of the outermost open article and content container
    content: int


def prepared(html: str) -> tuple[str, str]:
    """What the parser can read in one pass, and an unfinished tag at the end, which is
    text. A comment that never ends is none."""
    end = html.rfind("-->") + 1
    html = html[:end] + html[end:].replace("<!--", "")
    end = html.rfind(">") + 1
    start = _TAG_START.search(html, end)
    return (html, "") if start is None else (html[:start.start()], html[start.start():])


class _Lines(HTMLParser):
    """Folds parser events into lines. Elements are numbered in page order, so what
    lies in an element has a number from its own to its ``last``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []   # tag, serial number, is skipped
        self.levels: list[Counter] = [Counter()]      # open tags since the last scope
        self.names: Counter = Counter()               # all open tags
        self.parent, self.last = [0], [0]             # by serial number
        self.content: list[int] = []                  # open ones, outermost first
        self.articles: list[int] = []
        self.skipping = 0
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = self.plain = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, self.tags, self.plain, self.open[-1][1] if self.open else 0,
                                   self.articles[0] if self.articles else 0, self.content[0] if self.content else 0))
            self.tags = self.plain = 0
        self.parts.clear()

    def _push(self, tag: str, skipped: bool, content: bool) -> None:
        serial = len(self.parent)
        self.parent.append(self.open[-1][1] if self.open else 0)
        self.last.append(serial)
        self.open.append((tag, serial, skipped))
        self.names[tag] += 1
        self.levels[-1][tag] += 1
        if tag in _SCOPES:
            self.levels.append(Counter())
        self.skipping += skipped
        if content and not skipped:
            self.content.append(serial)
            if tag == "article":
                self.articles.append(serial)

    def _pop_to(self, i: int) -> None:
        while len(self.open) > i:
            tag, serial, skipped = self.open.pop()
            self.skipping -= skipped
            self.last[serial] = len(self.parent) - 1
            self.names[tag] -= 1
            if tag in _SCOPES:
                self.levels.pop()
            self.levels[-1][tag] -= 1
            for held in (self.content, self.articles):
                if held and held[-1] == serial:
                    held.pop()

    def _leave(self, tag: str) -> None:
        """What a start tag ends although it is not closed: a head, a drawing."""
        if self.names["head"] and tag not in _HEAD_TAGS and not any(self.names[t] for t in _RAW):
            self._pop_to(next(i for i, x in enumerate(self.open) if x[0] == "head"))
        if tag in _BREAKOUT and (self.names["svg"] or self.names["math"]) and not (self.names["foreignobject"] or self.names["desc"]):
            self._pop_to(next(i for i, x in enumerate(self.open) if x[0] in _FOREIGN))

    def handle_starttag(self, tag: str, attrs) -> None:
        self._leave(tag)
        if tag in VOID_TAGS:
            if tag == "br":
                self.parts.append(" ")
            elif tag in BLOCK_TAGS:
                self.flush()
            self.tags += not self.skipping
            return
        if tag in _P_ENDERS or tag in SKIP_TAGS and tag in BLOCK_TAGS:
            self.flush()
            self._close(("p",))
        if tag in _CLOSES:
            self.flush()
            self._close(_CLOSES[tag])
        words, hidden = set(), False
        for k, v in attrs:
            if k in ("class", "id", "role") and v:
                words.update(w.lower() for w in _WORDS.findall(v))
            hidden |= k == "hidden" or k == "style" and "display:none" in (v or "").replace(" ", "").lower()
        if tag in _HEADINGS:
            words -= _HEADING_WORDS       # a title may well be classed as the header of its article
        content = tag in CONTENT_TAGS or tag in ("div", "section") and bool(words & CONTENT_WORDS)
        marked = bool(words & SKIP_WORDS) or any(len(w) > 6 and w.endswith(SKIP_ENDS) for w in words - _HEADING_WORDS)
        if tag in _HEADINGS:
            marked = bool(words & SKIP_WORDS)
        elif tag in ("html", "body", "article", "main"):
            marked = tag == "article" and bool(words & COMMENT_WORDS)
        if self.content and tag not in ("article", "main"):
            marked = self._boilerplate_inside(tag, attrs)
        skipped = tag in SKIP_TAGS or hidden or marked
        if skipped:
            self.flush()
        self._push(tag, skipped, content)
        self.tags += not self.skipping

    @staticmethod
    def _boilerplate_inside(tag: str, attrs) -> bool:
        """Does an element of a content container hold boilerplate? Headings and rows of
        tables are the article's; ids of sections may be made of its own words."""
        if tag in _HEADINGS or tag in _ROWS:
            return False
        for k, v in attrs:
            names = (v or "").split()
            if k == "role" and any(x.lower() in SKIP_WORDS for x in names):
                return True
            if k in ("class", "id") and any(_marks(x, k == "id") for x in names):
                return True
        return False

    def parse_html_declaration(self, i: int) -> int:
        """As browsers: a marked section is a bogus comment up to the next '>', whatever its name."""
        if self.rawdata.startswith("<![", i):
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self._leave(tag)
        if tag in _FOREIGN or self.names["svg"] or self.names["math"]:
            self.tags += not self.skipping      # there a slash closes; elsewhere it means nothing
        else:
            self.handle_starttag(tag, attrs)

    def _close(self, tags: tuple[str, ...]) -> None:
        if any(self.levels[-1][t] for t in tags):
            i = len(self.open) - 1
            while self.open[i][0] not in tags:
                i -= 1
            self._pop_to(i)

    def handle_endtag(self, tag: str) -> None:
        # a stray end tag closes nothing, and no container that it does not name
        if (self.names if tag in _SCOPES else self.levels[-1])[tag]:
            i = len(self.open) - 1
            while self.open[i][0] != tag:
                i -= 1
            if tag in BLOCK_TAGS or any(s or t in BLOCK_TAGS for t, _, s in self.open[i:]):
                self.flush()
            self._pop_to(i)
        self.tags += not self.skipping

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and data.strip():
            self._pop_to(len(self.open) - 1)
        if not self.skipping:
            self.parts.append(data)
            if not self.names["a"]:
                self.plain += sum(map(len, data.split()))


def smooth(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing with a kernel of 2 * ceil(3 sigma) + 1, renormalised at the ends."""
    r = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-r, r + 1)]
    out = []
    for i in range(len(values)):
        num = den = 0.0
        for d, k in zip(range(-r, r + 1), kernel, strict=True):
            if 0 <= i + d < len(values):
                num += k * values[i + d]
                den += k
        out.append(num / den)
    return out


def _common(parser: _Lines, lines: list[Line]) -> int:
    """Serial number of the innermost element that holds all lines; 0 without one."""
    node, most = min(x.at for x in lines), max(x.at for x in lines)
    while node and parser.last[node] < most:
        node = parser.parent[node]
    return node


def extract(html: str | None, sigma: float = 1.0, cut: float = 0.5) -> str:
    """Main text of a page: its blocks in page order, joined by one newline; ''
    for NULL, empty pages and pages without content. ``cut`` is the share of
    the mean smoothed text-to-tag ratio above which a line counts as content."""
    if not html:
        return ""
    parser = _Lines()
    whole, broken = prepared(html)
    parser.feed(whole)
    parser.close()
    if broken:
        parser.handle_data(broken)
    parser.flush()
    parser._pop_to(0)
    lines = parser.lines
    if not lines:
        return ""
    inside = [x for x in lines if x.content]
    pool = inside or lines
    ratio = smooth([x.plain / max(1, x.tags) for x in pool], sigma)
    level = cut * sum(ratio) / len(ratio)
    hot = [x for x, r in zip(pool, ratio, strict=True) if r >= level and x.plain] or pool
    if not inside:
        top = _common(parser, hot)
        kept = [x for x in pool if not top or top <= x.at <= parser.last[top]]
    elif chosen := {x.article for x in hot if x.article}:      # the outermost article of every line of a region,
        kept = [x for x in pool if x.article in chosen]
    else:                                                      # or content container where none holds any
        chosen = {x.content for x in hot}
        kept = [x for x in pool if x.content in chosen]
    return "\n".join(x.text for x in kept)


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
              sigma: float = 1.0, cut: float = 0.5) -> DataFrame:
    """One row per page: page_id, url, text ('' if none), n_chars (code points)."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py(), sigma, cut) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return (in_batches(pages).selectExpr(f"`{page_id}` AS page_id", f"`{url}` AS url", f"`{html}` AS html")
                 .mapInArrow(lean(run), f"page_id {kinds[page_id]}, url {kinds[url]}, text string, n_chars long"))
