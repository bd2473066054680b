"""Main text of web pages by the distribution of text over line blocks."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW = 3  # lines that a block sums
SURGE = 86  # characters of plain text in a block where an article begins

# Element names of HTML by their role.
RAW = frozenset("script style noscript template textarea iframe svg canvas math object audio video select title".split())
DROPPED = frozenset("nav aside footer form button dialog menu head".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOXES = frozenset("div section table ul ol body".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
KEPT = frozenset("html body main article p h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
# Words of class and id names. A name is junk if all its parts are among these and one is a junk word.
JUNK_WORDS = frozenset(
    "ad ads adbox adslot advert advertisement advertising sponsor sponsored sponsors promo promos promotion banner nav navbar navigation menu sidebar breadcrumb breadcrumbs comment comments "
    "disqus replies cookie cookies consent notice notices newsletter subscribe signup share sharing social related popup modal toolbar pagination pager widget widgets masthead footer".split()
)
PLAIN_WORDS = frozenset("area bar block box bottom button buttons container content form group holder icons inner item items left link links list main outer page panel right section site thread top wrap wrapper".split())
OTHER_STORIES = frozenset("recent popular trending latest more related".split()), frozenset("articles news posts stories".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
WHITE = re.compile(r"\s+")


class Tag(NamedTuple):
    start: int
    after: int
    name: str
    closing: bool
    attributes: str


def tags(page: str) -> list[Tag]:
    """The tags of a page in order; a raw element is one tag that goes on behind its end."""
    out, at = [], 0
    while m := TOKEN.search(page, at):
        at = m.end()
        name = (m[2] or "").lower()
        if name in RAW and not m[1]:
            at = re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at).end()
        out.append(Tag(m.start(), at, name, bool(m[1]), m[3] or ""))
    return out


def partners(found: list[Tag]) -> list[int | None]:
    """For each opening tag the place of the tag that closes it, from one pass with a stack per name."""
    out: list[int | None] = [None] * len(found)
    open_: dict[str, list[int]] = {}
    for i, tag in enumerate(found):
        if not tag.closing:
            open_.setdefault(tag.name, []).append(i)
        elif open_.get(tag.name):
            out[open_[tag.name].pop()] = i
    return out


def is_junk_name(name: str) -> bool:
    parts = [p for p in re.split(r"[-_\d]+", name) if p]
    if len(parts) == 2 and parts[0] in OTHER_STORIES[0] and parts[1] in OTHER_STORIES[1]:
        return True
    return any(p in JUNK_WORDS for p in parts) and all(p in JUNK_WORDS or p in PLAIN_WORDS for p in parts)


def _is_junk(name: str, attributes: str, in_article: bool) -> bool:
    if name in DROPPED or (name == "header" and not in_article):
        return True
    if name in KEPT or not attributes:
        return False
    found = {m[0].lower(): (m[1] or m[2] or m[3]).lower() for m in ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    heads = {"header", "site-header", "page-header"}
    return found.get("role") in ROLES or any(is_junk_name(n) for n in names) or (not in_article and not heads.isdisjoint(names))


def page_lines(page: str) -> list[tuple[str, int, bool]]:
    """The page without markup, a line per block: its text, its characters outside links, and whether an article holds it.

    Dropped elements leave ``WINDOW`` empty lines behind, as do the borders of articles, the borders of boxes one, so that blocks fall to zero there.
    """
    lines: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked, in_link, articles, at = 0, False, 0, 0
    found = tags(page)
    ends = partners(found)
    holders = [i for i, tag in enumerate(found) if tag.name in ("article", "main") and not tag.closing]

    def flush() -> None:
        nonlocal linked
        text = WHITE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            lines.append((text, max(0, len(text) - linked), articles > 0))
        parts.clear()
        linked = 0

    i = 0
    while i < len(found):
        tag, here = found[i], i
        i += 1
        piece = page[at : tag.start]
        parts.append(piece)
        if in_link:
            linked += len(WHITE.sub(" ", html.unescape(piece)))
        at = tag.after
        name, closing = tag.name, tag.closing
        if not name or (name in RAW and not closing):
            continue
        if name == "a":
            in_link = not closing
        elif name == "br":
            parts.append(" ")
        if name in BLOCKS:
            flush()
        if name in ("article", "main"):
            articles = max(0, articles + (-1 if closing else 1))
            lines.extend([("", 0, False)] * WINDOW)
        if not closing and name not in VOID and not tag.attributes.endswith("/") and _is_junk(name, tag.attributes, articles > 0):
            end = ends[here]
            # an open end, or a box that only carries a junk name around the article, is no junk
            if end is not None and (name in DROPPED or bisect_right(holders, end) == bisect_right(holders, here)):
                flush()
                lines.extend([("", 0, False)] * WINDOW)
                at, i = found[end].after, end + 1
                continue
        if name in BOXES:
            lines.append(("", 0, False))
    parts.append(page[at:])
    flush()
    return lines


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text of one page.

    Every line opens a block of ``window`` lines. Text is kept from a surge, where the characters of a block rise
    above a threshold, to the next dive, where a block is empty. The threshold is ``surge``, or half the fullest block where that is less;
    links don't count. A line that an article holds weighs ``surge`` + 1 more, so it is a surge by itself. The end of an article is a dive, and
    what stands outside of one must also have half as much text as its fullest block; on other pages all lines are judged alike.
    """
    lines = page_lines(page)
    sizes = [plain + (surge + 1 if inside and text else 0) for text, plain, inside in lines]
    blocks = [sum(sizes[i : i + window]) for i in range(len(sizes))]
    held = [plain if inside else 0 for _, plain, inside in lines]
    limit = min(surge, max(blocks, default=0) / 2)
    outside = max(limit, max((sum(held[i : i + window]) for i in range(len(held))), default=0) / 2)
    kept, keeping = [], False
    for (text, _, inside), block in zip(lines, blocks, strict=True):
        keeping = block > 0 if keeping else block > (limit if inside else outside)
        if keeping and text:
            kept.append(text)
    return "\n".join(kept)


def extract_text(page: Column) -> Column:
    """Column of main texts: blocks in page order joined by newlines, empty if there are none; null pages are empty."""

    @F.pandas_udf("string")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pages.map(lambda p: main_text(p or ""))

    return made(page)
