"""Main text of web pages by text-to-tag ratios.

The standard library's streaming parser turns a page into lines, one for each
block.  A line's text-to-tag ratio is its text length over its tags.  Ratios are
smoothed by a Gaussian; lines over the threshold (the standard deviation of the
smoothed ratios) cluster into content, unless most of their text is links.  The
container that holds that content is the content region: all its blocks are kept,
however short, except containers that the page marks as something else
(navigation, adverts, forms, comments and so on).

Marks are hints, ratios decide: a marked container that holds most of the dense
text is no advert or menu but a wrapper, so it is kept.  Words mark a container
only if they make up a whole class name or id with words of layout: "sidebar-left"
does, "with-sidebar" and "related-work" do not.  All steps are linear in the page.
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

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Containers that can be a page's content region.
REGIONS = frozenset("article body center div form html main section table td".split())
#: Blocks of text; only words that cannot stand for a text's subject mark them.
TEXT_BLOCKS = frozenset("address blockquote caption center dd dt figcaption figure h1 h2 h3 h4 h5 h6 hr legend li p pre summary td th tr".split())
#: Never text of a page.
SILENT = frozenset("script style noscript template head title iframe object svg math canvas select textarea audio video datalist".split())
#: Containers that their tag marks.
MARKED_TAGS = frozenset("nav aside footer menu dialog form fieldset".split())
#: Of these, those that hold no article unless it has a tag or a title of its own.
PLAIN_TAGS = frozenset("nav footer menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that mark a container as something else.
MARKS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising adslot banner banners breadcrumb breadcrumbs consent cookie cookies "
    "dialog disclaimer footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain "
    "overlay pager pagination paywall popup promo promoted promotion recommended recommendations related search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription taboola teaser teasers toolbar topbar widget widgets complementary contentinfo alert toc".split()
)
#: Marks of reader comments.
COMMENTS = frozenset("comment comments commentlist commentary disqus discussion respond responses reply replies".split())
#: Marks that hold for a block of text or a piece of a line, too.
STRONG = frozenset("ad ads adbox adsense advert advertisement advertising adslot cookie cookies gdpr outbrain sponsored taboola".split())
#: Words of layout that may stand beside a mark.
LAYOUT = frozenset(
    "a area bar block body bottom box btn button buttons col column container content el element fixed form global group header holder icon icons id inner item items js "
    "l layer left link links list local m main mobile module nav outer page panel post primary r right row secondary section side site slot small sticky text the thread title top "
    "unit user users view wide wp wrap wrapper zone".split()
)
#: Whole class names of a page's header; others, such as entry-header, hold the article's title.
PAGE_HEADERS = frozenset("header site-header page-header top-header global-header banner-header".split())
#: The start of one of these ends an open <p>.
_ENDS_P = BLOCKS - {"body", "html", "head", "option", "legend", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
_SIBLINGS = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
_LISTS = frozenset("ul ol table tbody thead dl select".split())
_SIGMA = 1.0


def _words(name: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())


def _named(value: str, marks: frozenset[str]) -> bool:
    """Whether a whole name in ``value`` says a mark, beside words of layout only."""
    for name in value.split():
        words = _words(name)
        if any(w in marks for w in words) and all(w in marks or w in LAYOUT for w in words):
            return True
    return False


def _mark(tag: str, attrs: list[tuple[str, str | None]]) -> str:
    """What the attributes say of an element: "hidden", "comments", "other" or nothing."""
    found = ""
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return "hidden"
        if not value:
            continue
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            return "hidden"
        if name in ("class", "id", "role"):
            if tag not in BLOCKS or tag in TEXT_BLOCKS:
                found = found or ("hidden" if _named(value, STRONG) else "")
            elif _named(value, COMMENTS):
                found = "comments"
            elif _named(value, MARKS) or not PAGE_HEADERS.isdisjoint(value.lower().split()):
                found = found or "other"
    return found


class _Lines(HTMLParser):
    """Lines of a page and the tree of its containers."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool, bool]] = []  # tag, container, silent, in a link or button
        self.open: Counter[str] = Counter()
        self.inline: list[Counter[str]] = [Counter()]  # open inline tags, by open block
        #: text, tags, container, length of the text in links or buttons
        self.lines: list[tuple[str, int, int, int]] = []
        self.parent, self.kind, self.mark = [-1], [""], [""]
        self.text: list[str] = []
        self.tags = self.linked = 0

    def _here(self) -> tuple[int, bool, bool]:
        return self.stack[-1][1:] if self.stack else (0, False, False)

    def _cut(self) -> None:
        box, _, _ = self._here()
        text = " ".join("".join(self.text).split())
        if text or self.tags:
            self.lines.append((text, self.tags, box, self.linked))
        self.text, self.tags, self.linked = [], 0, 0

    def _pop(self, at: int) -> None:
        """Close the elements from place ``at`` on."""
        while len(self.stack) > at:
            tag = self.stack.pop()[0]
            self.open[tag] -= 1
            if tag in BLOCKS:
                self.inline.pop()
            else:
                self.inline[-1][tag] -= 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            if tag in _ENDS_P and self.open["p"]:
                self._close("p")
            if tag in _SIBLINGS:
                self._close_sibling(tag)
            self._cut()
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        box, silent, linked = self._here()
        mark = _mark(tag, attrs) if attrs and tag not in ("html", "body", "article", "main") else ""
        if tag in BLOCKS:
            if not mark and (tag in MARKED_TAGS or (tag == "header" and not self.open["article"] and not self.open["main"])):
                mark = "other"
            self.parent.append(box)
            self.kind.append(tag)
            self.mark.append(mark)
            box = len(self.parent) - 1
            self.inline.append(Counter())
        else:
            self.inline[-1][tag] += 1
        self.open[tag] += 1
        self.stack.append((tag, box, silent or tag in SILENT or mark == "hidden", linked or tag in ("a", "button")))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math", "iframe"):
            self.handle_endtag(tag)

    def _close_sibling(self, tag: str) -> None:
        like = _SIBLINGS[tag]
        if not any(self.open[t] for t in like):
            return
        for t, *_ in reversed(self.stack):
            if t in like:
                self._close(t)
                return
            if t in _LISTS or (t == "tr" and tag != "tr"):
                return

    def _close(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._cut()
                self._pop(k)
                return
            if tag == "p" and self.stack[k][0] in BLOCKS:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            if self.open[tag]:
                self._cut()
                self._pop(next(k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] == tag))
        elif self.inline[-1][tag]:  # an inline end does not reach beyond its block
            self._pop(next(k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] == tag))

    def handle_data(self, data: str) -> None:
        _, silent, linked = self._here()
        if not silent:
            self.text.append(data)
            if linked:
                self.linked += len("".join(data.split()))

    def finish(self) -> None:
        self.close()
        self._cut()


def smoothed(ratios: list[float], sigma: float = _SIGMA) -> list[float]:
    """Gaussian smoothing with the kernel cut at two standard deviations and renormed at the ends."""
    reach = math.ceil(2 * sigma)
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(ratios)):
        top = below = 0.0
        for d, w in zip(range(-reach, reach + 1), kernel, strict=True):
            if 0 <= i + d < len(ratios):
                top += w * ratios[i + d]
                below += w
        out.append(top / below)
    return out


def dense_lines(lines: list[tuple[str, int, int, int]], quiet: list[bool]) -> list[int]:
    """Places of the lines whose smoothed ratio is over the threshold and that are not mostly links."""
    loud = [k for k, line in enumerate(lines) if line[0] and not quiet[line[2]]]
    ratios = smoothed([0.0 if quiet[box] else len(t) / max(1, n) for t, n, box, _ in lines])
    mean = sum(ratios) / max(1, len(ratios))
    threshold = math.sqrt(sum((r - mean) ** 2 for r in ratios) / max(1, len(ratios)))
    plain = [k for k in loud if 2 * lines[k][3] < len(lines[k][0])]
    return [k for k in plain if ratios[k] >= threshold] or plain or loud


def main_text(html: str | None) -> str:
    """The article of a page, blocks joined by newlines; empty if there is none."""
    page = _Lines()
    page.feed(html or "")
    page.finish()
    lines, parent, kind, mark = page.lines, page.parent, page.kind, page.mark

    def summed(own: list[int]) -> list[int]:
        """Sums over the containers below each one; a container comes after its parent."""
        total = list(own)
        for b in range(len(total) - 1, 0, -1):
            total[parent[b]] += total[b]
        return total

    def weights(places: list[int]) -> list[int]:
        own = [0] * len(parent)
        for k in places:
            own[lines[k][2]] += len(lines[k][0])
        return own

    # What marked containers hold, while nothing is left out but what is hidden.
    quiet = [False] * len(parent)
    for b in range(1, len(parent)):
        quiet[b] = quiet[parent[b]] or mark[b] == "hidden"
    every = weights(dense_lines(lines, quiet))
    held = summed(every)
    titled = summed([int(k in ("article", "main", "h1")) for k in kind])
    whole = held[0]
    talk = [0] * len(parent)  # the outermost container of comments around each
    for b in range(1, len(parent)):
        talk[b] = talk[parent[b]] or (b if mark[b] == "comments" else 0)
    chatter = sum(held[b] for b in range(1, len(parent)) if talk[b] == b)
    for b in range(1, len(parent)):
        wrapper = 2 * held[b] > whole and (titled[b] or kind[b] not in PLAIN_TAGS)
        if mark[b] == "comments" and not titled[b] and chatter < whole:
            wrapper = False
        quiet[b] = quiet[parent[b]] or mark[b] == "hidden" or (bool(mark[b]) and not wrapper)

    loud = [k for k, line in enumerate(lines) if line[0] and not quiet[line[2]]]
    if not loud:
        return ""
    own = weights(dense_lines(lines, quiet))
    weight = summed(own)
    total = weight[0]
    articles = [b for b in range(len(parent)) if kind[b] in ("article", "main") and weight[b] and 2 * weight[b] >= total]
    if articles:
        outer = [b for b in articles if kind[b] == "article"] or articles
        best = max(outer, key=lambda b: (weight[b], -b))
    else:
        # The smallest container with nine tenths of the dense text, and not a text block itself.
        best = max(b for b in range(len(parent)) if 10 * weight[b] >= 9 * total)
        while parent[best] >= 0 and (kind[best] not in REGIONS or 2 * own[best] >= weight[best]):
            best = parent[best]
    inside = [False] * len(parent)
    for b in range(len(parent)):
        inside[b] = b == best or (b > 0 and inside[parent[b]])
    kept = [k for k in loud if inside[lines[k][2]]]
    if not articles:  # menus without a mark: runs of two or more lines of links at either end
        links = lambda k: 10 * lines[k][3] >= 7 * len("".join(lines[k][0].split()))
        for ends in (kept, kept[::-1]):
            run = next((i for i, k in enumerate(ends) if not links(k)), 0)
            if run >= 2:
                gone = set(ends[:run])
                kept = [k for k in kept if k not in gone]
    return "\n".join(lines[k][0] for k in kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars.

    A null page counts as empty and gives an empty text, as does a page without an
    article.  Long pages are parsed whole, in linear time; repeated rows give
    repeated rows, other columns are not read, an empty table gives an empty result.
    """
    schema = pages.select(F.col(id_col), F.col(url_col), F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema.names)

    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInArrow(run, schema)
