"""Main text of web pages by text-to-tag ratios (operator 9).

The standard library's streaming parser turns a page into lines, one per block element.  Each line has its
text length over the number of tags in it.  The ratios are smoothed with a Gaussian over neighbouring lines,
and clustered with a threshold (their standard deviation, never above the mean): runs of lines above it are content,
on every page and wherever they stand.  If the clusters hold at least half of the text of an ``article`` or ``main``
element, or any of the page's only one, they extend to all its lines, so short paragraphs between long ones stay.  On a
page without such an element they extend to the innermost element that holds most of their text, if they hold half of
what it holds; where that is the whole page, only to the lines between the first and the last of them.  Class and id names (adverts,
comments, widgets) and forms are a weight: their lines count an eighth and must by themselves reach the page's mean, unless all
lines of the page are such.  Menus, headers, footers, sidebars, scripts and styles are put in no cluster, but an
article inside such a menu or sidebar is weighed like a named one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.llm.sharing import read, text_or_empty

# fixed values: HTML element names by role
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre
section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("""nav header footer aside script style noscript template button select textarea iframe svg canvas object
menu dialog head title""".split())
RAW = frozenset(("script", "style"))
PLACED = frozenset("nav header footer aside menu dialog".split())  # an article inside is looked at nonetheless
MAIN = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar".split())
WORDS = re.compile(r"(?:^|[^a-z])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|breadcrumb\w*|comment\w*|disqus|cookie\w*|consent|notice\w*"
                   r"|popup|modal|sidebar\w*|side-bar|menu\w*|nav|navbar|navigation|footer|masthead|share|sharing|social|related|newsletter"
                   r"|subscribe\w*|signup|login|widget\w*|pagination|pager|toolbar|skip-link|paywall|replies|reply|respond)(?:$|[^a-z])")
# fixed values: end tags that HTML lets authors leave out, by the start tag that implies them
CLOSES_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr option optgroup legend li dd dt summary figcaption".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",), "optgroup": ("option", "optgroup")}
FENCES = frozenset("table ul ol dl select article main section div body blockquote aside nav header footer form button".split())
SPACE = re.compile(r"[\s]+")
SIGMA = 1.0
RADIUS = 2
OWN = 8
NAMED = 1 / OWN
OFF, SHUT = 1, 2  # never content unless in an article, never content at all


class Line:
    __slots__ = ("text", "tags", "off", "main", "named", "element")

    def __init__(self, off: int, main: int, named: bool, element: int):
        self.text: list[str] = []
        self.tags, self.off, self.main, self.named, self.element = 0, off, main, named, element


class Lines(HTMLParser):
    """Collects block lines from parser events.

    What stands in ``<! >`` and is no comment is left out up to the next ``>``, whatever it holds.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int, bool]] = []  # name, never content, number of the main element, named
        self.places: dict[str, list[int]] = {}        # places in the stack by name, so that no depth makes a search long
        self.fences: list[int] = []
        self.lines: list[Line] = []
        self.mains = 0
        self.parents = [0]                            # of every block element, by its number; 0 is the page, html and body
        self.inside = [0]                             # numbers of the open elements' blocks
        self.line = self.fresh()

    def state(self) -> tuple[int, int, bool]:
        return self.stack[-1][1:] if self.stack else (0, 0, False)

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        return self.rawdata.find(">", i + 2) + 1 or -1

    def fresh(self) -> Line:
        self.line = Line(*self.state(), self.inside[-1])
        self.lines.append(self.line)
        return self.line

    def push(self, tag: str, off: int, main: int, named: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in FENCES:
            self.fences.append(len(self.stack))
        self.stack.append((tag, off, main, named))
        if tag in BLOCK and tag not in ("html", "body"):
            self.parents.append(self.inside[-1])
            self.inside.append(len(self.parents) - 1)
        else:
            self.inside.append(self.inside[-1])

    def nearest(self, tag: str) -> int:
        """Place of the innermost such element that no fence shuts in, or -1."""
        places = self.places.get(tag)
        if not places or tag not in FENCES and self.fences and self.fences[-1] > places[-1]:
            return -1
        return places[-1]

    def cut(self, k: int) -> None:
        while len(self.stack) > k:
            tag = self.stack.pop()[0]
            self.inside.pop()
            self.places[tag].pop()
            if tag in FENCES:
                self.fences.pop()

    def pop_to(self, names: tuple[str, ...]) -> None:
        k = max(map(self.nearest, names))
        if k >= 0:
            self.cut(k)

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self.pop_to(("p",))
        elif tag in CLOSES:
            self.pop_to(CLOSES[tag])
        if tag in BLOCK:
            self.fresh()
        self.line.tags += 1
        if tag in VOID:
            if tag == "br":
                self.line.text.append(" ")
            return
        off, main, named = self.state()
        if off != SHUT:
            a = dict(attrs)
            by_name = tag == "form" or a.get("role") == "form" or bool(WORDS.search(f"{a.get('class') or ''} {a.get('id') or ''}".lower()))
            if "hidden" in a or a.get("aria-hidden") == "true" or tag in NEVER - PLACED:
                off = SHUT if tag not in ("html", "body") else off
            elif tag in MAIN:
                if not main:
                    self.mains += 1
                    main = self.mains
                    # an article is looked at wherever it stands; what its own name says counts only in a named place
                    named = bool(off) or named and by_name
                    off = 0
            elif not off and tag not in ("html", "body"):
                if tag in PLACED and not (tag == "header" and main) or a.get("role") in ROLES:
                    off, main = OFF, 0
                else:
                    named = named or by_name
        self.push(tag, off, main, named)
        if tag in BLOCK:
            self.fresh()
        elif (off, main, named) != (self.line.off, self.line.main, self.line.named):
            self.fresh()

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            if tag not in RAW:
                self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.line.tags += 1
        if tag in VOID:
            return
        k = self.nearest(tag)
        if k >= 0:
            was = self.state()
            self.cut(k)
            if tag in BLOCK or was != self.state():
                self.fresh()

    def handle_data(self, data):
        self.line.text.append(data)


def smoothed(values: list[float]) -> list[float]:
    weights = [math.exp(-k * k / (2 * SIGMA * SIGMA)) for k in range(-RADIUS, RADIUS + 1)]
    out = []
    for i in range(len(values)):
        low, high = max(0, i - RADIUS), min(len(values), i + RADIUS + 1)
        w = weights[low - i + RADIUS:high - i + RADIUS]
        out.append(sum(a * b for a, b in zip(w, values[low:high], strict=True)) / sum(w))
    return out


def read_lines(html: str) -> Lines:
    """A page's lines.  Markup that the page's end cuts off is no text."""
    p = Lines()
    p.feed(html)
    if p.cdata_elem is None and re.match("<[A-Za-z/!?]", p.rawdata):
        p.rawdata = ""
    p.close()
    return p


def held(parents: list[int], element: list[int], size: list[int], ok: list[bool]) -> list[bool]:
    """Whether each line lies in the innermost element that holds more than half of the chosen text, if that is half of its text.

    If that element is the page, the lines between the first and the last chosen one.
    """
    whole, chosen = [0] * len(parents), [0] * len(parents)
    for e, n, c in zip(element, size, ok, strict=True):
        whole[e] += n
        chosen[e] += c * n
    for e in range(len(parents) - 1, 0, -1):
        whole[parents[e]] += whole[e]
        chosen[parents[e]] += chosen[e]
    top = 0
    for e in range(1, len(parents)):
        if parents[e] == top and 2 * chosen[e] > chosen[0]:
            top = e
    if 2 * chosen[top] < whole[top] or True not in ok:
        return [False] * len(ok)
    if not top:
        first, last = ok.index(True), len(ok) - ok[::-1].index(True)
        return [first <= k < last for k in range(len(ok))]
    inside = [False] * len(parents)
    for e in range(top, len(parents)):
        inside[e] = e == top or inside[parents[e]]
    return [inside[e] for e in element]


def main_text(html: str) -> str:
    """Content blocks joined by a blank line; empty if the page has none.

    White space inside a block becomes one space.  Malformed markup is read as far as the parser goes.
    """
    p = read_lines(html)
    lines = []
    for x in p.lines:
        text = SPACE.sub(" ", "".join(x.text)).strip()
        if text:
            lines.append((text, len(text) / max(1, x.tags), x))
    usable = [k for k in lines if not k[2].off]
    if not usable:
        return ""
    weigh = not all(x.named for _, _, x in usable)
    named = [weigh and x.named for _, _, x in lines]
    ratios = [0.0 if x.off else ratio * (NAMED if w else 1) for (_, ratio, x), w in zip(lines, named, strict=True)]
    smooth = smoothed(ratios)
    mean = sum(smooth) / len(smooth)
    spread = math.sqrt(sum((v - mean) ** 2 for v in smooth) / len(smooth))
    limit = min(spread, mean)
    # smoothing lifts a menu between paragraphs, so a line must also have some text of its own
    named_limit = max(limit, sum(ratio for ratio, (_, _, x) in zip(ratios, lines, strict=True) if not x.off) / len(usable))
    content = [not x.off and v >= limit and ratio >= (named_limit if w else limit / OWN)
               for v, ratio, w, (_, _, x) in zip(smooth, ratios, named, lines, strict=True)]
    chosen, whole = Counter(), Counter()
    for ok, w, (text, _, x) in zip(content, named, lines, strict=True):
        if x.main and not x.off and not w:
            whole[x.main] += len(text)
            chosen[x.main] += ok * len(text)
    taken = {m for m in whole if 0 < whole[m] <= 2 * chosen[m] or chosen[m] and len(whole) == 1}
    open_to_all = [not x.off and not w for w, (_, _, x) in zip(named, lines, strict=True)]
    if taken:
        content = [ok or free and x.main in taken for ok, free, (_, _, x) in zip(content, open_to_all, lines, strict=True)]
    elif not whole:
        inside = held(p.parents, [x.element for _, _, x in lines], [len(t) * free for free, (t, _, _) in zip(open_to_all, lines, strict=True)], content)
        content = [ok or free and here for ok, free, here in zip(content, open_to_all, inside, strict=True)]
    return "\n\n".join(t for ok, (t, _, _) in zip(content, lines, strict=True) if ok)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` per page.  A null page gives the empty text; other columns are ignored."""
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_or_empty(html_col).alias("html"))
    return d.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(read(spark, sf_dir, "pages"))
