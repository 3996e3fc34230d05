"""Main text of web pages by text-to-tag ratio.

The standard library's streaming parser turns a page into lines (blocks between block-level tags), each with its text, the
part of it in links, the number of tags in it and its container. A line's text-to-tag ratio, links left out, is smoothed by
a Gaussian over the neighbouring lines of its article, and raised to the ratio of its container taken as a whole, to that
of the nearest container around it that is mostly prose of its own (so lists and tables between paragraphs go with them), and, in
an article or main element, to that of all such elements; a list of links no longer than LABEL on average, as in menus,
stays at its own, as any list of links does outside. The ratios are clustered by two means of their logarithms, and the
lines of the upper cluster are the main text. Ratios beyond PROSE, the ratio of prose in any page, count as that, and
ratios that differ by less than a factor of APART are one cluster.

What navigation, headers, footers, sidebars, notices, adverts, forms, comment sections, scripts and styles hold is no line.
Of these, a form and an element that only its class or id tells are lines after all if they hold a main or article
element, or most of the text of a page that has none; a first pass finds them.

Cases: a null or empty page, or one without content, gives the empty string; omitted, unclosed and stray tags are taken as
they come, in time and memory linear in the page; declarations, marked sections and processing instructions end at the
next >; a tag or comment that the page's end cuts off holds the rest of the page, as in browsers; character references are decoded; a page without any markup is one
line per the same rules; repeated rows get equal results; other columns pass through or are ignored, and result columns
replace kept ones of the same name."""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession

from .common import load, map_texts

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr br img input script style".split())
#: Blocks that are lines of their container, not containers.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption pre summary figcaption address option".split())
#: Elements that hold no main text; and those that hold none unless they hold the page.
SKIPPED = frozenset("head title script style noscript template iframe object embed svg canvas audio video map nav footer aside button select option datalist textarea menu menuitem noframes applet".split())
DOUBTED = frozenset("form fieldset dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar dialog alertdialog alert".split())
#: What may stand in a head; anything else ends it.
OF_HEAD = frozenset("head title meta link script style base noscript template".split())
#: Open blocks that a new one ends; any other block ends a paragraph.
ENDS = {"li": "p li", "dt": "p dt dd", "dd": "p dt dd", "option": "option", "td": "p td th", "th": "p td th", "tr": "p td th tr"} | dict.fromkeys(("tbody", "thead", "tfoot"), "p td th tr tbody thead tfoot")
ENDS = {k: frozenset(v.split()) for k, v in ENDS.items()}
PARAGRAPH = frozenset(["p"])
#: Words that make a class or id name one of no main text, and words that may stand beside them.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored sponsors promo promotion sidebar menu submenu nav navbar navigation breadcrumb breadcrumbs footer masthead siteheader pageheader topbar cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe signup login comment comments commentlist disqus replies respond share sharing social related recommended recommendations widget widgets toolbar pagination pager skiplink taglist tagslist alert alerts legal copyright".split()
)
BESIDE = frozenset("site page main top bottom left right side up wrap wrapper container box block area list item items inner outer primary secondary section bar panel link links row col column slot unit group button buttons form text body global mobile desktop sticky fixed post posts article articles stories user users reader readers visitor small large first last".split())
HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Width of the smoothing in lines; the least factor between two clusters; the ratio of prose in any page.
SIGMA, APART, PROSE = 1.0, 3.0, 60.0
#: Characters of a link, on average, up to which a list of links is a menu.
LABEL = 25
COMMENT_END = re.compile("--!?>")
END_TAG = re.compile(r"</([a-zA-Z][^\t\n\r\f />\x00]*)")


def hinted(names: str) -> bool:
    """Whether a class or id attribute names a part of no main text: a name of nothing but such words and those beside them."""
    for name in names.split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        if parts and ("".join(parts) in HINTS or (any(p in HINTS for p in parts) and all(p in HINTS or p in BESIDE for p in parts))):
            return True
    return False


class _Open:
    """An open block: its tag and container's number, how it is skipped (0 not, 1 doubted, 2 surely), and inline elements open in it."""

    __slots__ = ("counts", "inline", "node", "skip", "tag")

    def __init__(self, tag: str, node: int, skip: int):
        self.tag, self.node, self.skip = tag, node, skip
        self.inline: list[tuple[str, int]] = []
        self.counts: Counter = Counter()


class _Lines(HTMLParser):
    """lines: text, characters of it in links, tags and container of each. Containers are numbered, 0 around all; parent
    and kind give each one's container and tag. spared holds the numbers of doubted elements that count after all."""

    def __init__(self, spared: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.parent, self.kind = [0], [""]
        self.stack = [_Open("", 0, 0)]
        self.open: Counter = Counter()
        self.skips = [0, 0, 0]  # open elements by how they are skipped
        self.links = self.tags = self.linked = 0
        self.parts: list[str] = []
        self.made, self.spared = 0, spared
        self.doubted: list[int] = []  # open, innermost last
        self.around: dict[int, int] = {}  # of each doubted element the doubted one around it
        self.held: Counter = Counter()  # characters in doubted elements alone
        self.main: set[int] = set()  # doubted elements that hold a main or article
        self.open_main = False  # a main or article that nothing skips
        self.total = 0

    def spare(self) -> frozenset[int]:
        """Doubted elements around a main or article, or around most of the text of a page without one."""
        held, main = Counter(self.held), set(self.main)
        for n in sorted(self.around, reverse=True):
            if outer := self.around[n]:
                held[outer] += held[n]
                if n in main:
                    main.add(outer)
        return frozenset(main if main or self.open_main else {n for n, size in held.items() if 2 * size > self.total})

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, min(self.linked, len(text)), 1 + self.tags, self.stack[-1].node))
        self.parts.clear()
        self.tags = self.linked = 0

    def _skip_of(self, tag: str, attrs: list) -> int:
        named = {k: v or "" for k, v in attrs}
        if tag in SKIPPED or named.get("role", "").lower() in ROLES or "hidden" in named or named.get("aria-hidden") == "true" or HIDDEN.search(named.get("style", "")):
            return 2
        if tag == "header" and not (self.open["article"] or self.open["main"]):
            return 2
        self.made += 1
        if self.made in self.spared or tag in ("html", "body", "main", "article"):
            return 0
        return int(tag in DOUBTED or any(hinted(named.get(k, "")) for k in ("class", "id")))

    def _enter(self, skip: int) -> None:
        self.skips[skip] += 1
        if skip == 1:
            self.around[self.made] = self.doubted[-1] if self.doubted else 0
            self.doubted.append(self.made)

    def _leave(self, skip: int) -> None:
        self.skips[skip] -= 1
        if skip == 1:
            self.doubted.pop()

    def _close_inline(self, block: _Open) -> None:
        tag, skip = block.inline.pop()
        block.counts[tag] -= 1
        self.links -= tag == "a"
        self._leave(skip)

    def _close_block(self) -> None:
        block = self.stack.pop()
        while block.inline:
            self._close_inline(block)
        self.open[block.tag] -= 1
        self._leave(block.skip)

    def _end_head(self) -> None:
        while self.open["head"]:
            self._close_block()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.open["head"] and tag not in OF_HEAD:
            self._end_head()
        block = self.stack[-1]
        if tag in INLINE:
            if not (self.skips[1] or self.skips[2] or tag in SKIPPED):
                self.tags += 1
            if tag == "br":
                self.parts.append(" ")
            if tag not in VOID:
                while tag == "a" and block.counts["a"]:  # a link ends an open one
                    self._close_inline(block)
                skip = self._skip_of(tag, attrs)
                self._enter(skip)
                block.inline.append((tag, skip))
                block.counts[tag] += 1
                self.links += tag == "a"
            return
        self._end_line()
        ends = ENDS.get(tag, PARAGRAPH)
        while self.stack[-1].tag in ends:
            self._close_block()
        if tag in VOID:
            return
        skip = self._skip_of(tag, attrs)
        self._enter(skip)
        if tag in ("main", "article") and not self.skips[2]:
            self.main.update(self.doubted[-1:])
            self.open_main |= not self.doubted
        node = self.stack[-1].node
        if tag not in LINES:
            self.parent.append(node)
            self.kind.append(tag)
            node = len(self.parent) - 1
        self.stack.append(_Open(tag, node, skip))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        if tag in INLINE:
            block = self.stack[-1]
            while block.counts[tag]:
                last = block.inline[-1][0]
                self._close_inline(block)
                if last == tag:
                    break
            return
        self._end_line()
        while self.open[tag]:
            last = self.stack[-1].tag
            self._close_block()
            if last == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.stack[-1].tag == "head" and not self.stack[-1].inline and data.strip():
            self._end_head()
        if self.skips[2]:
            return
        size = len(data.strip())
        self.total += size
        if self.skips[1]:
            self.held[self.doubted[-1]] += size
            return
        self.parts.append(data)
        if self.links:
            self.linked += size

    def close(self) -> None:
        super().close()
        self._end_line()

    # What the page's end cuts off holds its rest, so that nothing is read twice.

    def _after(self, close: str, i: int) -> int:
        """The place after the next `close`, or the page's end."""
        at = self.rawdata.find(close, i)
        return len(self.rawdata) if at < 0 else at + len(close)

    def parse_starttag(self, i: int) -> int:
        k = super().parse_starttag(i)
        return len(self.rawdata) if k < 0 else k

    def parse_endtag(self, i: int) -> int:
        name, stop = END_TAG.match(self.rawdata, i), self._after(">", i)
        if name:
            self.handle_endtag(name[1].lower())
            self.clear_cdata_mode()
        return stop

    def parse_comment(self, i: int, report: int = 1) -> int:
        for empty in ("<!-->", "<!--->"):
            if self.rawdata.startswith(empty, i):
                return i + len(empty)
        end = COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        return self._after(">", i + 2)

    parse_pi = parse_html_declaration

    def set_cdata_mode(self, elem: str) -> None:
        self.cdata_elem = elem.lower()
        self.interesting = re.compile(rf"</{self.cdata_elem}(?=[\s/>])", re.I)


def smoothed(values: list[float], group: list[int], sigma: float = SIGMA) -> list[float]:
    """Gaussian-weighted means over neighbouring lines of the same group."""
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        pairs = [(kernel[j - i + reach], values[j]) for j in range(max(0, i - reach), min(len(values), i + reach + 1)) if group[j] == group[i]]
        out.append(sum(k * v for k, v in pairs) / sum(k for k, _ in pairs))
    return out


def two_means(values: list[float]) -> tuple[float, float]:
    """The means of the two clusters of values, each value being nearer to its own; equal if there is but one."""
    ordered = sorted(values)
    sums = [0.0]
    for v in ordered:
        sums.append(sums[-1] + v)
    low, high = ordered[0], ordered[-1]
    for _ in range(100):
        cut = (low + high) / 2
        n = next((i for i, v in enumerate(ordered) if v >= cut), len(ordered))
        if not 0 < n < len(ordered):
            return low, low
        new = sums[n] / n, (sums[-1] - sums[n]) / (len(ordered) - n)
        if new == (low, high):
            break
        low, high = new
    return low, high


def line_ratios(lines: list[tuple[str, int, int, int]], parent: list[int], kind: list[str]) -> list[float]:
    """The smoothed and raised text-to-tag ratio of each line."""
    size = len(parent)
    text, linked, tags, count = [0] * size, [0] * size, [0] * size, [0] * size
    prose = [0] * size  # characters of a container's own lines of prose, links left out
    own = [(len(line) - in_links) / n for line, in_links, n, _ in lines]
    for (line, in_links, n, node), ratio in zip(lines, own, strict=True):
        text[node] += len(line)
        linked[node] += in_links
        tags[node] += n
        count[node] += 1
        if ratio >= PROSE:
            prose[node] += len(line) - in_links
    menu = [2 * k > t and t <= LABEL * c for t, k, c in zip(text, linked, count, strict=True)]
    for n in range(size - 1, 0, -1):  # containers as a whole; body and html are their own lines alone
        if kind[parent[n]] not in ("", "html", "body"):
            for of in (text, linked, tags):
                of[parent[n]] += of[n]
    whole = [(t - k) / max(1, g) for t, k, g in zip(text, linked, tags, strict=True)]
    article = [0] * size  # the outermost article or main element around each container
    around = [0.0] * size  # the ratio of the nearest container, itself or around it, that is mostly prose of its own
    for n in range(1, size):
        article[n] = article[parent[n]] or n * (kind[n] in ("article", "main"))
        mostly = prose[n] > 0 and 2 * prose[n] >= text[n] - linked[n]
        around[n] = whole[n] if mostly else around[parent[n]] if kind[parent[n]] not in ("", "html", "body") else 0.0
    outermost = {n for n in article if n}
    articles = sum(text[n] - linked[n] for n in outermost) / max(1, sum(tags[n] for n in outermost))
    near = smoothed(own, [article[node] for *_, node in lines])
    out = []
    for value, (line, in_links, _, node) in zip(near, lines, strict=True):
        if 2 * linked[node] > text[node] and 2 * in_links > len(line) and (menu[node] or not article[node]):  # a list of links
            out.append(whole[node])
        else:
            out.append(max(value, whole[node], around[node], articles if article[node] else 0.0))
    return out


def chosen(ratios: list[float]) -> list[bool]:
    """Whether each line lies in the upper cluster of ratios."""
    logs = [math.log(1 + min(r, PROSE)) for r in ratios]
    low, high = two_means(logs)
    return [high - low < math.log(APART) or 2 * x >= low + high for x in logs]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    if spared := parser.spare():
        parser = _Lines(spared)
        parser.feed(html)
        parser.close()
    if not parser.lines:
        return ""
    marks = chosen(line_ratios(parser.lines, parser.parent, parser.kind))
    return "\n".join(text for (text, *_), mark in zip(parser.lines, marks, strict=True) if mark)


def with_main_text(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns keep of every page with text and n_chars."""

    def make():
        def work(pages):
            texts = [main_text(h) for h in pages]
            return [texts, [len(t) for t in texts]]

        return work

    return map_texts(pages, html_col, "text string, n_chars long", make, keep)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_main_text(load(spark, sf_dir, "pages"), ["page_id", "url"])
