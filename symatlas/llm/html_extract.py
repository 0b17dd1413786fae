"""Main text of web pages by two-pass block rules (operator 9).

A page is cut into text blocks at block-level tags. The first pass labels blocks: those in boilerplate
places (menus, page headers, footers, sidebars, forms, notices, adverts, comments: by tag, role or the
words of class and id) and those of mostly link text are bad; long blocks with enough function words
are good, as are long ones in a place marked as the article that holds good ones; the rest, above all short blocks, stay
undecided. In the second pass an undecided block takes the label of its nearest decided neighbour: of the
last decided block before it and the first behind it, the one with fewer steps through the nesting of containers, then
the one that is fewer blocks away, then the good one. A page whose first pass finds nothing
good has its short blocks in the marked place as good ones, or else its longest block. Both passes are linear.

Defined results: null and empty pages have an empty text and 0 characters; unclosed tags end with
their container, but for those whose content is raw text (scripts, styles, titles, text areas, inner frames), which
swallow the rest of the page as in a browser; quotes count in tags only after an equals sign; repeated pages are extracted alike; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common
from .quality_rules import STOP_WORDS

LONG, LINKED, STOPPED = 60, 0.5, 0.12
_GOOD, _BAD, _OPEN = 1, 0, None

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
#: Elements whose content is text up to their end tag, and elements that are no text of the page but nest as others do.
_RAW = frozenset("script style textarea iframe title".split())
_SILENT = frozenset("noscript template svg select".split())
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in _RAW}
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Tags whose nesting is followed; all other block tags only end the block before them.
_PLACE = frozenset("article aside body button details dialog div fieldset figure footer form head header label main menu nav ol section table ul".split())
_BAD_TAG = frozenset("aside button dialog fieldset footer form head label menu nav".split())
_BAD_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_BAD_NAME = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus "
    "donate footer form gdpr header login masthead menu meta modal nav navbar navigation newsletter notice notification outbrain overlay pager pagination popup "
    "promo promotion recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription "
    "tags toc toolbar topbar widget widgets".split()
)
_GOOD_NAME = frozenset("article post entry story content main body text".split())


class _Place:
    __slots__ = ("tag", "bad", "article", "number")  # article: the number of the outermost marked place, or 0

    def __init__(self, tag, bad, article, number):
        self.tag, self.bad, self.article, self.number = tag, bad, article, number


def _judged(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is boilerplate by itself, and whether it is marked as the article."""
    bad, article = tag in _BAD_TAG, tag in ("article", "main")
    if attributes and not attributes.isspace():
        names: set[str] = set()
        for key, *values in _ATTRIBUTE.findall(attributes):
            value = next((v for v in values if v), "")
            key = key.lower()
            if key == "role":
                bad |= value.lower() in _BAD_ROLE
                article |= value.lower() in ("main", "article")
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                bad = True
            elif key in ("class", "id"):
                for word in re.split(r"\s+", value):
                    names.update(x for x in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", word).lower()) if x)
        if tag not in ("body", "html", "article", "main") and names & _BAD_NAME and not (names & _GOOD_NAME and names & {"header", "meta", "tags", "widget"}):
            bad = True
        if names & {"article", "post", "entry", "story"} and not bad and tag in ("div", "section"):
            article = True
    return bad, article


class Block:
    __slots__ = ("text", "linked", "place", "heading", "depth", "low")  # the depth of its container, and the least depth since the block before

    def __init__(self, text, linked, place, heading, depth=0, low=0):
        self.text, self.linked, self.place, self.heading, self.depth, self.low = text, linked, place, heading, depth, low


def _silent_end(page: str, at: int, end: int, tag: str) -> int | None:
    """Where a silent element ends: behind its end tag, or before the end tag of what it lies in; None if neither comes."""
    open_: list[str] = []
    while (found := _TAG.search(page, at, end)) is not None:
        at = found.end()
        if found[2] is None:
            continue
        name = found[2].lower()
        if name in _RAW and not found[1]:
            raw = _RAW_END[name].search(page, at)
            at = raw.end() if raw else end
        elif name == tag or name in _BLOCK or name in _PLACE:
            if not found[1]:
                if not found[3].endswith("/") and name not in ("hr",):
                    open_.append(name)
            elif name in open_:
                while open_.pop() != name:
                    pass
            else:
                return at if name == tag else found.start()
    return None


def blocks(page: str) -> list[Block]:
    """The page's non-empty text blocks, in order."""
    out: list[Block] = []
    root = _Place("", False, 0, 0)
    stack = [root]
    text: list[str] = []
    linked = 0
    in_link = 0
    heading = False
    number = at = low = 0
    # behind the last bracket there are no tags, unless a comment is left open
    end = len(page) if page.rfind("<!--") > page.rfind("-->") else page.rfind(">") + 1
    endless = False

    def flush():
        nonlocal linked, text, low
        low = min(low, len(stack))
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                out.append(Block(joined, linked, stack[-1], heading, len(stack), low))
                low = len(stack)
        text, linked = [], 0

    def add(part: str):
        nonlocal linked
        text.append(part)
        if in_link:
            linked += len(part.strip())

    while True:
        low = min(low, len(stack))
        found = _TAG.search(page, at, end)
        if found is None:
            if at < len(page):
                add(page[at:])
            break
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(found[1])
        if tag in _RAW:
            if not closing and not found[3].endswith("/"):
                raw = _RAW_END[tag].search(page, at)
                at = raw.end() if raw else len(page)
            continue
        if tag in _SILENT:
            if not closing and not found[3].endswith("/") and not endless:
                after = _silent_end(page, at, end, tag)
                endless = after is None  # then no later one ends either
                at = at if after is None else after
            continue
        if tag == "a":
            in_link = 0 if closing else 1
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in _BLOCK and tag not in _PLACE:
            continue
        flush()
        heading = not closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        if tag not in _PLACE:
            if not closing and tag in ("p", "li", "td", "th", "dd", "dt", "section", "span"):
                bad, _ = _judged(tag, found[3]) if found[3] else (False, False)
                if bad:  # a boilerplate paragraph: a place of its own up to the next block tag
                    number += 1
                    mark = _Place(tag, True, stack[-1].article, number)
                    stack.append(mark)
                    continue
            while stack[-1].tag in ("p", "li", "td", "th", "dd", "dt"):
                stack.pop()
            continue
        while stack[-1].tag in ("p", "td", "th", "dd", "dt"):
            stack.pop()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                    break
            in_link = 0
            continue
        bad, article = _judged(tag, found[3])
        if tag in ("article", "main"):
            in_link = 0
            while len(stack) > 1 and stack[-1].tag in ("nav", "header", "ul", "ol", "menu", "head", "form"):
                stack.pop()
        elif tag in ("footer", "body"):
            while len(stack) > 1 and stack[-1].tag in ("head", "ul", "ol"):
                stack.pop()
        above = stack[-1]
        if tag == "header":
            bad = bad or not above.article
        number += 1
        inside = 0 if bad else above.article or (number if article else 0)
        stack.append(_Place(tag, above.bad or bad, inside, number))
    flush()
    return out


def first_label(block: Block, articles: set[int]) -> int | None:
    """Good, bad or undecided, by place, link density, length and function words.

    A mark in `articles` is one more vote: length is enough inside, and function words decide outside.
    """
    if block.place.bad:
        return _BAD
    n = len(block.text)
    if block.linked > LINKED * n and not (block.place.article and n >= 2 * LONG and block.linked < 0.8 * n):
        return _BAD
    if block.place.article in articles:
        return _GOOD if n >= LONG else _OPEN
    if n < LONG:
        return _OPEN
    words = block.text.lower().split()
    stopped = sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)
    if stopped >= STOPPED or n >= 4 * LONG and stopped >= STOPPED / 3:
        return _GOOD
    return _BAD if block.linked > 0.2 * n else _OPEN


def extract(page: str) -> str:
    found = blocks(page)
    # the article is what is marked and good by density; where nothing is good by density, what is marked
    dense = [b.place.article for b in found if first_label(b, set()) == _GOOD]
    articles = {a for a in dense or (b.place.article for b in found if not b.place.bad) if a}
    labels = [first_label(b, articles) for b in found]
    if _GOOD not in labels:  # a page of short blocks: those marked as the article, else the longest one
        rest = [i for i, label in enumerate(labels) if label is _OPEN]
        for i in [i for i in rest if found[i].place.article] or sorted(rest, key=lambda i: -len(found[i].text))[:1]:
            labels[i] = _GOOD
    labels = inherited(found, labels)
    return "\n\n".join(b.text for b, label in zip(found, labels) if label)


def inherited(found: list[Block], labels: list[int | None]) -> list[int]:
    """The labels, each undecided one that of its nearest decided neighbour.

    Between two blocks the least depth that the nesting went through is that of what contains both, so a pass
    in each direction carries the last decided block, and the least depth since.
    """
    nearest: list[tuple] = [()] * len(found)
    for step in (1, -1):
        last, least = None, 0
        for i in range(len(found))[::step]:
            if step > 0:
                least = min(least, found[i].low)
            if labels[i] is not None:
                last, least = i, found[i].depth
            elif last is not None:
                shared = min(least, found[i].depth)
                rank = (found[i].depth + found[last].depth - 2 * shared, abs(i - last), -labels[last])
                nearest[i] = min(nearest[i] or rank, rank)
            if step < 0:
                least = min(least, found[i].low)
    return [label if label is not None else -near[2] if near else _GOOD for label, near in zip(labels, nearest)]


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def make():
        def step(batch):
            found = [extract(h) if h else "" for h in batch.column("html").to_pylist()]
            return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": found, "n_chars": [len(t) for t in found]}

        return step

    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]
    return common.map_batches(pages.select(F.col("page_id").cast("long"), "url", "html"), make, "page_id long, url string, text string, n_chars long", kinds)


def op9(spark, sf_dir):
    return main_text(common.table(spark, sf_dir, "pages", "page_id", "url", "html"))
