"""Main text of web pages by block rules in two passes.

A page becomes blocks of text with the tags they stand in. The first pass decides long,
dense and clearly marked blocks by length, stop-word density, link density and container;
the second gives undecided short blocks the label of their nearest decided neighbours. A
page's article or main element is evidence: its blocks have the better prior in both
passes, and what stands outside is left out unless more good text stands there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Common words of four languages, fixed values.
STOP_WORDS = frozenset(
    """the of and to in a is that it was for on are with as be at by this from or an not have
    der die das und in zu den mit von im ist des auf für nicht als auch ein eine dem sich
    le la les de des du et en un une que qui dans pour par sur est pas avec au aux
    el los las y del que por con para una se al lo como su es no""".split()
)
#: Blocks of fewer characters are short; of at least as many, long. Densities that decide.
SHORT, LONG, LINKS, STOPS_LOW, STOPS_HIGH = 70, 120, 0.33, 0.2, 0.3
#: Elements whose text is dropped with them.
DROPPED = frozenset("head script style noscript template iframe object svg math canvas audio video select option button textarea input dialog menu".split())
#: Elements that do not end a head whose end tag is missing.
METADATA = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
#: Good characters in a form that make it the frame of a page.
FRAME = 500
#: Elements that mark boilerplate, and those that mark the article.
BOILERPLATE, ARTICLE = frozenset("nav footer aside header".split()), frozenset("article main".split())
#: Elements that end a block.
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Raw text runs to the closing tag, whatever stands in it.
RAW = frozenset("script style textarea title noscript iframe xmp".split())
#: Elements that a following one of the same group closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Words of a class, id or role that mark menus, headers, footers, sidebars, notices, adverts and comments.
MARKS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice popup promo related replies respond share sharing sidebar signup social sponsor sponsored subscribe widget".split())
#: Of these, those that an article's own head has; words that make a name say how a page is laid out, before or after.
OWN_HEAD, BEFORE, AFTER = frozenset("header masthead banner".split()), frozenset("has no with without is not js".split()), frozenset("open closed on off enabled disabled none".split())
_PARTS = re.compile(r"[_-]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>|\Z", re.I) for t in RAW}


@dataclass
class Block:
    """Text of a block, its characters inside links, and the context it stands in."""

    text: str
    linked: int
    article: int
    marked: bool
    heading: bool
    form: int


def names_mark(names: str, in_article: bool) -> bool:
    """Whether one of the whole names of an element marks it as no part of the article."""
    for name in names.lower().split():
        parts = [p for p in _PARTS.split(name) if p]
        if parts and parts[0] not in BEFORE and parts[-1] not in AFTER and any(p in MARKS and not (in_article and p in OWN_HEAD) for p in parts):
            return True
    return False


def blocks_of(html: str) -> list[Block]:
    """Blocks of a page in order; markup, comments and dropped elements leave none."""
    out: list[Block] = []
    stack: list[tuple[str, bool]] = []
    articles, forms, frames = 0, 0, set()
    open_: dict[str, int] = {}
    text: list[str] = []
    linked, marks, breaks, dropped = 0, 0, 0, 0

    def end() -> None:
        nonlocal linked, breaks
        said = " ".join(unescape("".join(text)).split()) if text else ""
        if said:
            out.append(Block(said, min(linked, len(said)), articles if any(open_.get(t) for t in ARTICLE) else 0, marks > 0, any(open_.get(f"h{i}") for i in range(1, 7)), forms if open_.get("form") else 0))
        text.clear()
        linked, breaks = 0, 0

    def say(part: str) -> None:
        nonlocal linked, breaks
        if stack and stack[-1][0] == "head" and part.strip():
            pop()
        if part and not dropped:
            text.append(part)
            if not part.isspace():
                breaks = 0
                if open_.get("a"):
                    linked += len(part.strip())

    def pop() -> None:
        nonlocal marks, dropped
        name, marked = stack.pop()
        open_[name] -= 1
        marks -= marked
        dropped -= name in DROPPED

    at, n = 0, len(html)
    while at < n:
        m = _MARKUP.search(html, at)
        say(html[at : m.start() if m else n])
        if not m:
            break
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if name is None:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name = name.lower()
        if name in BLOCK:
            end()
        elif name == "br":
            breaks += 1
            end() if breaks > 1 else text.append(" ")
            breaks = max(breaks, 1)
        if closing:
            if open_.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if open_.get("head") and name not in METADATA:
            while open_.get("head"):
                pop()
        for other in CLOSES.get(name, ()):
            if stack and stack[-1][0] == other:
                pop()
        if name in RAW:
            stop = _RAW_END[name].search(html, at)
            at = stop.end()
            continue
        if name in VOID or attributes.rstrip().endswith("/"):
            continue
        names = " ".join(filter(None, (x for found in _NAMES.findall(attributes) for x in found))) if attributes else ""
        inside = any(open_.get(t) for t in ARTICLE)
        if name == "main" or name == "article" and not inside:
            articles += 1
            frames.add(forms if open_.get("form") else 0)
        if name == "main":
            # What main stands in is the page's frame, whatever its names say.
            stack[:] = [(t, m and t in BOILERPLATE) for t, m in stack]
            marks = sum(m for _, m in stack)
        forms += name == "form" and not open_.get("form")
        marked = name in BOILERPLATE and not (name == "header" and inside) or bool(names and name not in ("html", "body", "main") and names_mark(names, inside))
        stack.append((name, marked))
        open_[name] = open_.get(name, 0) + 1
        marks += marked
        dropped += name in DROPPED
    end()
    for b in out:
        # A form around the article is the page's frame.
        b.form = 0 if b.form in frames else b.form
    return out


def first_pass(b: Block, prior: bool) -> str:
    """good, bad, near (almost good) or short (undecided); with the article's prior a block of few stop words is near."""
    share = b.linked / len(b.text)
    if b.marked or share > LINKS:
        return "bad"
    if len(b.text) < SHORT:
        return "bad" if b.linked and not prior else "short"
    words = b.text.lower().split()
    stops = sum(w.strip(".,;:!?") in STOP_WORDS for w in words) / len(words)
    if stops >= STOPS_HIGH:
        return "good" if len(b.text) > LONG else "near"
    return "near" if stops >= STOPS_LOW or prior else "bad"


def second_pass(blocks: list[Block], labels: list[str], prior: bool) -> list[bool]:
    """Whether each block is kept: near and short ones follow their nearest decided neighbours.

    A short block between a good and a bad one follows the nearer, a tie going to good if
    the block is a heading before good text, or with the article's prior; with near blocks
    on a side, that side counts as good. Near blocks are kept unless both sides are bad.
    With the prior a side without a decided block is good, and marked blocks decide nothing.
    """
    n, edge = len(labels), "good" if prior else "bad"
    before, after = [(0, edge)] * n, [(0, edge)] * n
    for out, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last = (n, edge)
        for i in order:
            out[i] = last
            decides = labels[i] in ("good", "bad") and not (prior and blocks[i].marked)
            last = (1, labels[i]) if decides else (last[0] + 1, last[1])
    kept = []
    for i, label in enumerate(labels):
        (d0, a), (d1, b) = before[i], after[i]
        if label in ("good", "bad"):
            kept.append(label == "good")
        elif a == b:
            kept.append(a == "good")
        elif label == "near":
            kept.append(True)
        else:
            nearer = a if d0 < d1 else b if d1 < d0 else ("good" if prior or blocks[i].heading and b == "good" else "bad")
            kept.append(nearer == "good")
    return kept


def _kept(blocks: list[Block], prior: bool) -> list[bool]:
    return second_pass(blocks, [first_pass(b, prior) for b in blocks], prior)


def main_text(html: str | None) -> str:
    """The kept blocks of a page, joined by an empty line; '' for a null or empty page.

    Forms without much good text are left out. If a page marks an article and at least as
    much good text stands there as outside, its blocks have the article's prior and others
    are left out; else all blocks are judged alike.
    """
    blocks = blocks_of(html or "")
    good = [len(b.text) if not b.marked and first_pass(b, False) == "good" else 0 for b in blocks]
    for form in {b.form for b in blocks} - {0}:
        own = [i for i, b in enumerate(blocks) if b.form == form]
        if sum(good[i] for i in own) < FRAME:
            for i in own:
                blocks[i].marked, good[i] = True, 0
    inside = sum(len(b.text) for b in blocks if b.article and not b.marked and b.linked <= LINKS * len(b.text))
    prior = inside > 0 and inside >= sum(g for b, g in zip(blocks, good, strict=True) if not b.article)
    if prior:
        blocks = [b for b in blocks if b.article]
    return "\n\n".join(b.text for b, keep in zip(blocks, _kept(blocks, prior), strict=True) if keep)


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with a column of main text, '' where there is none.

    Other columns pass through, but one named as ``into`` is replaced; rows are kept as they
    are, repeated ones too, each treated alone. No rows: no rows.
    """

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x) for x in batch], dtype=object)

    return pages.withColumn(into, F.pandas_udf(texts, "string")(html))


def html_digest(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""
    found = extract(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
