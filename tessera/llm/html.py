"""Operator 4: the main text of web pages.

The standard library's parser streams a page's events. They are cut into lines, one per block element;
a line has its text, the number of its tags, and what its ancestors say of it. The ratio of text to
tags per line is smoothed with a Gaussian window, and the lines above a threshold made from the spread
of the ratios form the content regions (text-to-tag ratio clustering). Lines within menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments have no ratio and are
never chosen. Where a page marks its article, its plain lines are content at any positive ratio; blocks in it
whose class or id only suggests something else (SOFT) have half their ratio, and the threshold decides on
them, as it does on all lines of pages that mark none.

A class or id names a block by its last word that is no part of a block (comments in comments-area), and
not by what it has or is filed under (has-sidebar, category-legal). A block so named never drops a main or
article element, nor one inside it, and no name drops a heading or a p, as their ids are often words of the text. Only among comments, related pages, sidebars and widgets, where each
entry may be an article element, articles count only if the page marks no other.

Cases. NULL or empty html, or a page without content: an empty text. Unclosed elements end with the
element around them, and a comment without an end reaches to the end of the page. White space inside a line becomes one space. NULL id: kept. Repeated rows: each
has its own result. Empty table: empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that begin and end a line.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Elements with nothing that belongs to an article.
DROPPED = frozenset("nav footer aside form script style noscript template iframe svg head title button select option textarea object canvas audio video menu dialog input fieldset datalist map".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A p, li and so on ends where the next of its kind begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Words of class and id that name what is no article; see named().
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs "
    "footer foot masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "comment comments commentlist disqus replies reply respond related recommended recommendations widget widgets pagination pager toolbar skip copyright legal disclaimer paywall".split()
)
#: Of these, blocks whose entries may be article elements of their own.
ENTRIES = frozenset("sidebar sidebars comment comments commentlist disqus replies reply respond related recommended recommendations widget widgets".split())
#: Of the words, those that stand for parts of an article as well: inside one, the ratio decides.
SOFT = frozenset("widget widgets menu menus nav navigation notice notices banner copyright legal disclaimer alert toolbar skip foot aside overlay".split())
#: What a soft word leaves of a line's ratio.
PRIOR = 0.5
#: Elements whose class and id say nothing of what they hold.
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 hgroup".split())
#: Where a comment begins, or an element in which `<!--` is text.
OPENS = re.compile(r"<!--|<(script|style|textarea|title)\b", re.I)
#: After these words a class or id says what an element has, lacks or is filed under.
MODIFIERS = frozenset("has have with without no not category cat tag tagged topic type format status".split())
#: Words for a part or a box of what the word before them names.
PARTS = frozenset("area areas list box block wrap wrapper container section inner outer left right top bottom primary secondary button buttons link links icon icons item items bar slot unit row col column panel group posts articles stories title heading".split())
#: The same for a page's header, which an article may have too.
HEADER_HINTS = frozenset("header head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: Words of class, id, role and itemprop that mark an article.
MARKS = frozenset("article articlebody main".split())
ARTICLE_HINTS = frozenset("article-body article-content articlebody post-content entry-content post-body story-body main-content page-content article post entry story".split())
SIGMA = 1.0
RADIUS = 3
KERNEL = [math.exp(-(i * i) / (2 * SIGMA * SIGMA)) for i in range(-RADIUS, RADIUS + 1)]
#: Most lines from one line above the threshold to the next of the same region.
GAP = 12
#: The parser is fed so many characters at a time.
CHUNK = 1 << 16
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


def named(token: str) -> str:
    """The word by which a class or id names its element; empty if it only says what the element has or is filed under."""
    words = [x for x in SPLIT.split(re.sub(r"([a-z])([A-Z])", r"\1-\2", token).lower()) if x and not x.isdigit()]
    words = words[: next((i for i, x in enumerate(words) if x in MODIFIERS), len(words))]
    while len(words) > 1 and words[-1] in PARTS:
        words.pop()
    return words[-1] if words else ""


class Lines(HTMLParser):
    """Collects (text, tags, link characters, kind, heading) per line.

    Kinds: 0 dropped, 1 open, 2 within an article, 3 within an article's header, 4 within an article among
    entries, 5 dropped by a class or id, 6 the same among entries, 7 within an article under a soft word.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.stack: list[tuple[str, int]] = []  # open elements that matter, by name, and the kind around each
        self.open: Counter = Counter()  # how many of each name are on the stack
        self.kind, self.tags, self.links, self.link = 1, 0, 0, 0
        self.text: list[str] = []

    def cut(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                heading = bool(self.stack) and self.stack[-1][0] in HEADINGS
                self.lines.append((text, self.tags, self.links, self.kind, heading))
            self.text = []
        self.tags = self.links = 0

    def within(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        """The kind of what stands in an element."""
        if self.kind == 0 or tag in DROPPED:
            return 0
        if tag == "header" and self.kind in (1, 2, 3):
            return 0 if self.kind == 1 else 3
        if self.kind == 3:
            return 2 if tag in HEADINGS else 3
        whole = tag in ("article", "main")
        kind = 2 if tag == "main" else self.kind
        if tag == "article":
            kind = 4 if self.kind in (4, 6) else 2
        for name, value in attrs:
            if not value:
                if name == "hidden":
                    return 0
                continue
            if name in ("class", "id"):
                for token in value.split() if tag not in ("body", "html") and tag not in PLAIN else ():
                    word = named(token)
                    if self.kind in (2, 7) and word in SOFT and not whole:
                        kind = 7 if kind == 2 else kind
                    elif word in ENTRIES and tag != "main":
                        kind = 4 if tag == "article" else 6
                    elif word in HINTS and not whole and kind != 6:
                        kind = 5
                    if kind == 1 and word in HEADER_HINTS:
                        return 0
                    if token.lower() in ARTICLE_HINTS and not whole:
                        kind = 4 if kind in (4, 5, 6) else 2
            elif name == "role":
                if value.lower() in ROLES:
                    return 0
                if value.lower() in MARKS:
                    kind = 2 if kind != 6 or value.lower() == "main" else 4
            elif name == "itemprop" and value.lower() in MARKS:
                kind = 4 if kind in (4, 6) else 2
            elif name == "style" and "display:none" in value.replace(" ", "").lower():
                return 0
            elif name == "aria-hidden" and value.lower() == "true":
                return 0
        return kind

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        if tag in BLOCKS:
            self.cut()
            if (ends := CLOSES.get(tag)) or tag == "p" or tag in HEADINGS:
                self.end_open(ends or {"p"})
        else:
            self.tags += 1
            if tag == "a":
                self.link += 1
        if tag in VOID:
            return
        kind = self.within(tag, attrs) if tag in BLOCKS or tag in DROPPED or attrs else self.kind
        # an inline element matters if it changes the kind, or stands in one of its name that does
        if tag in BLOCKS or kind != self.kind or self.open[tag]:
            if kind != self.kind:
                self.cut()
            self.stack.append((tag, self.kind))
            self.open[tag] += 1
            self.kind = kind

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag != "br":
            self.handle_endtag(tag)

    def end_open(self, names: set[str]) -> None:
        """End the innermost open element if it is one of these."""
        if self.stack and self.stack[-1][0] in names:
            name, self.kind = self.stack.pop()
            self.open[name] -= 1

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.cut()
        elif tag == "a" and self.link:
            self.link -= 1
        # what stands above the element ends with it; an end tag without an open element is passed over at once
        before = self.kind
        while self.open[tag]:
            name, kind = self.stack.pop()
            self.open[name] -= 1
            if kind != before:
                self.cut()
            self.kind = before = kind
            if name == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.kind not in (0, 5, 6):
            self.text.append(data)
            if self.link:
                self.links += len(data)


def smoothed(ratios: list[float]) -> list[float]:
    """Each line's ratio, averaged with its neighbours' by a Gaussian window; beyond the ends the window is cut."""
    out = []
    for i in range(len(ratios)):
        low, high = max(0, i - RADIUS), min(len(ratios), i + RADIUS + 1)
        weights = KERNEL[low - i + RADIUS : high - i + RADIUS]
        out.append(sum(w * x for w, x in zip(weights, ratios[low:high], strict=True)) / sum(weights))
    return out


def extract(page: str | None) -> str:
    """The main text of a whole page."""
    if not page:
        return ""
    parser, page = Lines(), without_open_comment(page)
    for at in range(0, len(page), CHUNK):
        parser.feed(page[at : at + CHUNK])
    parser.close()
    parser.cut()
    article = 2 if any(line[3] == 2 for line in parser.lines) else 4
    inside = (article, 7) if article == 2 else (article,)
    lines = [(text, tags, links, 2 if kind == article else kind if kind == 7 and article == 2 else 0 if kind == 3 else 1, heading) for text, tags, links, kind, heading in parser.lines if kind in (1, 3, *inside)]
    if not lines:
        return ""
    marked = any(kind == 2 for _, _, _, kind, _ in lines)
    # text to tags: characters outside of links for each tag, the line's own two included
    ratios = [0.0 if kind == 0 else (len(text) - (min(links, len(text)) if kind in (1, 7) else 0)) / (1 + tags) * (PRIOR if kind == 7 else 1) for text, tags, links, kind, _ in lines]
    if marked:
        # the article's own lines make the threshold for what is doubtful in it
        held = [i for i, line in enumerate(lines) if line[3] in (2, 7)]
        smooth = smoothed(ratios)
        plain = [smooth[i] for i in held if lines[i][3] == 2]
        least = threshold(plain)
        return "\n".join(lines[i][0] for i in held if (smooth[i] > 0 if lines[i][3] == 2 else smooth[i] >= least and 2 * lines[i][2] <= len(lines[i][0])))
    smooth = smoothed(ratios)
    least = threshold(smooth)
    fits = [kind > 0 and 2 * links <= len(text) for text, _, links, kind, _ in lines]
    above = [i for i, x in enumerate(smooth) if fits[i] and x >= least]
    return "\n".join(lines[i][0] for i in regions(above, fits, [line[4] for line in lines]))


def threshold(smooth: list[float]) -> float:
    """The least smoothed ratio of content: the spread of the ratios, or their mean if that is less."""
    mean = sum(smooth) / len(smooth)
    spread = math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))
    return min(spread, mean) if spread else mean / 2


def without_open_comment(page: str) -> str:
    """The page up to a comment that has no end; one pass, as the parser would look for its end again and again."""
    at = 0
    while found := OPENS.search(page, at):
        if found[1] is None:
            end = page.find("-->", found.end())
            if end < 0:
                return page[: found.start()]
            at = end + 3
        else:
            close = re.compile(f"</{found[1]}", re.I).search(page, found.end())
            if close is None:
                return page
            at = close.end()
    return page


def regions(above: list[int], fits: list[bool], headings: list[bool]) -> list[int]:
    """Lines above the threshold, the fitting ones between two of them that are at most GAP apart, and headings right before a region."""
    out: list[int] = []
    last = None
    for i in above:
        if last is not None and i - last <= GAP:
            out += [j for j in range(last + 1, i) if fits[j]]
        else:
            first = i
            while first and headings[first - 1] and fits[first - 1] and first - 1 != last:
                first -= 1
            out += range(first, i)
        out.append(i)
        last = i
    return out


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [extract(x.as_py()) for x in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["k", "url", "text", "n_chars"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of each page."""
    narrow = pages.select(F.col(id_col).alias("k"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = {x.name: x.dataType.simpleString() for x in narrow.schema}
    return narrow.mapInArrow(_extracted, f"k {kinds['k']}, url {kinds['url']}, text string, n_chars long").withColumnRenamed("k", id_col)


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
