"""HTML main text by a maximum-scoring subsequence.

A page becomes a sequence of blocks (text between block tags) and tags. A word scores by the kind of
element around its block, every tag scores below zero, and the contiguous stretch with the greatest sum
is the content region (one linear scan). The weights come from labelled pages: pages that mark their
own main text with one ``article`` or ``main`` element are the labels, and a kind of element or tag weighs
the log odds of lying inside the mark. Every page is scored by these weights; its own mark, if
it has just one, only moves a word by ``MARK`` up or down. Menus, headers, footers, sidebars, notices,
adverts, forms, reader comments, scripts and styles are told by tag, role, class or id and never
belong to the text, inside the region or outside.

Bound: at most ``PAGES`` labelled pages are used for weights. Every page is extracted whole.

All words of a block weigh the same, so the scan steps over blocks: no best stretch begins or ends within one.

Defined cases: null, empty or text-free html gives an empty text; unclosed elements end with the
page or, for excluded ones, before the next section, or where HTML implies their end; a tag, comment or
attribute value that the page ends in swallows what follows it, as in HTML; plain text without tags is the
text; repeated rows are treated alike; extra columns pass through, but one named like the text is an error
before any job runs. Time and memory grow with a page's length, whatever is in it: some 300 bytes for each tag.
"""

from __future__ import annotations

import bisect
import functools
import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quiremill.llm.io import fresh

PAGES = 400
#: What a word gains inside the only mark of its page, and loses outside.
MARK = 0.5
#: The most a tag scores; a tag of unknown weight scores this if it breaks no line.
TAG = -0.1

#: Elements of HTML that break a line of text.
BLOCKS = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose content is never main text.
EXCLUDED = set("aside button canvas dialog footer form head iframe input menu nav noscript object script select style svg template textarea title".split())
#: Elements whose content is raw text.
RAW = ("script", "style", "textarea", "title")
ROLES = set("banner navigation complementary contentinfo search dialog alert form menu menubar".split())
#: Words of class or id names that mark what isn't main text.
MARKS = set("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus disclaimer footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager paywall popup promo promoted promotion related replies reply respond responses share sharing sidebar sidenav signup social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|[!?])")
#: The next name, with its value if it has one, or the end of the tag. A quoted value that isn't closed ends with the page.
_ATTR = re.compile(r"""[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*("[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s>"'][^\s>]*)?)?)""")
_PART = re.compile(r"[a-z]+")
#: Sections that end an excluded element which is never closed.
_SECTIONS = ("article", "main", "section")
_CELL = set("td th tr tbody thead tfoot".split())
#: Start tags that end an element without an end tag, and elements inside of which they don't.
ENDS = {
    "p": set("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre search section summary table ul".split()) | _CELL,
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "option": {"option", "optgroup", "hr"},
    "td": _CELL,
    "th": _CELL,
    "tr": _CELL - {"td", "th"},
}
_SCOPES = set("ul ol menu dir dl table select button object template svg".split())
#: A block is (kind, tags before it, text).
Block = tuple[str, list[str], str]


class Tag:
    """A tag: its place in the page, name, whether it closes, attributes, and for start tags whether they are empty."""

    __slots__ = ("attributes", "begin", "closes", "empty", "end", "name")

    def __init__(self, begin: int, end: int, name: str, closes: bool, attributes: list[tuple[str, str]], empty: bool):
        self.begin, self.end, self.name, self.closes, self.attributes, self.empty = begin, end, name, closes, attributes, empty


@functools.cache
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I)


def _attributes(page: str, at: int) -> tuple[list[tuple[str, str]], int]:
    """The attributes from ``at`` and where their tag ends (beyond the page if it doesn't)."""
    found = []
    while m := _ATTR.match(page, at):
        at = m.end()
        if m[1]:
            return found, at
        found.append((m[2].lower(), m[3] or ""))
    return found, len(page) + 1


def tags_of(page: str) -> tuple[list[Tag], list[tuple[int, int]]]:
    """All tags of a page in order, and the stretches of text between them (comments and raw content are neither)."""
    tags, texts, at, last = [], [], 0, 0
    while m := _TAG.search(page, at):
        texts.append((last, m.start()))
        if not m[2]:
            comment = page.startswith("<!--", m.start())
            end = page.find("-->" if comment else ">", m.end())
            at = last = len(page) if end < 0 else end + (3 if comment else 1)
            tags.append(None)
            continue
        attributes, at = _attributes(page, m.end())
        if at > len(page):
            return tags, [*texts, (len(page), len(page))]
        name = m[2].lower()
        tag = Tag(m.start(), at, name, bool(m[1]), attributes, name in _VOID or page[at - 2] == "/")
        tags.append(tag)
        if name in RAW and not m[1] and not tag.empty:
            close = _closing(name).search(page, at)
            at = close.start() if close else len(page)
        last = at
    return tags, [*texts, (last, len(page))]


def excluded(tag: str, attributes: list[tuple[str, str]], in_main: bool) -> bool:
    """Whether an element holds what never is main text; the header of an article is part of it."""
    if tag in EXCLUDED or tag == "header" and not in_main:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, value in attributes:
        words = set(_PART.findall(value.lower()))
        if name == "role" and words & ROLES or name in ("class", "id") and words & MARKS or name == "hidden" or name == "aria-hidden" and "true" in words:
            return True
    return False


def ends_of(tags: list[Tag | None]) -> dict[int, int]:
    """For each start tag that an end tag of its name answers, the number of the tag after that."""
    open_, ends = defaultdict(list), {}
    for i, t in enumerate(tags):
        if t and t.closes:
            if open_[t.name]:
                ends[open_[t.name].pop()] = i + 1
        elif t and not t.empty:
            open_[t.name].append(i)
    return ends


def _implied_end(tags: list[Tag | None], i: int, around: Counter) -> tuple[int, bool]:
    """The number of the tag that follows the element of tag i, and whether the text between is outside: after its end tag, else up to a start tag that ends it or the end of an element around it."""
    name, within, count, scopes = tags[i].name, [], Counter(), 0
    for k in range(i + 1, len(tags)):
        t = tags[k]
        if not t:
            continue
        if t.closes:
            if count[t.name]:
                while True:
                    gone = within.pop()
                    count[gone] -= 1
                    scopes -= gone in _SCOPES
                    if gone == t.name:
                        break
            elif t.name == name:
                return k + 1, True
            elif around[t.name]:
                return k, False
        elif t.name in ENDS[name] and not scopes:
            return k, False
        elif not t.empty and t.name not in RAW:
            within.append(t.name)
            count[t.name] += 1
            scopes += t.name in _SCOPES
    return len(tags), False


def blocks_of(page: str) -> tuple[list[Block], list[bool], bool]:
    """The blocks of a page without excluded elements; which lie inside the marked main element; whether there is just one such mark."""
    tags, texts = tags_of(page)
    ends = ends_of(tags)
    sections = [i for i, t in enumerate(tags) if t and not t.closes and t.name in _SECTIONS]
    blocks, inside, text, before = [], [], [], []
    stack, lines, count = [], [], Counter()  # open elements, those of them that break lines, how many of each name
    depth = marks = 0

    def flush() -> None:
        nonlocal before
        body = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if body:
            blocks.append(((lines[-1] if lines else "none") + "/a" * ("a" in stack[-3:]), before, body))
            inside.append(depth > 0)
            before = []

    def close(name: str) -> None:
        while True:
            gone = stack.pop()
            count[gone] -= 1
            if gone in BLOCKS:
                lines.pop()
            if gone == name:
                break

    i = 0
    while i < len(tags):
        text.append(page[slice(*texts[i])])
        tag = tags[i]
        if not tag:
            i += 1
            continue
        name = tag.name
        if name in BLOCKS or name in EXCLUDED:
            flush()
        if tag.closes:
            before.append(name)
            if count[name]:
                close(name)
            if name in ("article", "main"):
                depth = max(0, depth - 1)
        elif excluded(name, tag.attributes, depth > 0):
            flush()
            if not tag.empty:
                if name in ENDS:
                    i, outside = _implied_end(tags, i, count)
                elif i in ends:
                    i, outside = ends[i], True
                else:
                    later = bisect.bisect(sections, i)
                    i, outside = sections[later] if later < len(sections) else len(tags), False
                if not outside:
                    texts[i] = (0, 0)
                continue
        else:
            before.append(name)
            if name in ("article", "main"):
                depth += 1
                marks += depth == 1
            if name == "p" and count["p"]:
                close("p")
            if not tag.empty:
                stack.append(name)
                count[name] += 1
                if name in BLOCKS:
                    lines.append(name)
        i += 1
    text.append(page[slice(*texts[len(tags)])])
    flush()
    return blocks, inside, marks == 1


def weights_of(pages: list[str], tag_score: float = -0.4) -> dict[str, float]:
    """The weight of a word for each kind of block (log odds, from 0.2 to 2 for body text, below zero for what lies outside) and of each tag (never above ``TAG``)."""
    within, total = Counter(), Counter()
    for page in pages:
        blocks, inside, marked = blocks_of(page)
        if marked:
            for (kind, tags, text), own in zip(blocks, inside, strict=True):
                n = text.count(" ") + 1
                total[kind] += n
                within[kind] += n * own
                for tag in tags:
                    total[f"<{tag}>"] += 1
                    within[f"<{tag}>"] += own
    odds = {k: math.log((within[k] + 5) / (total[k] - within[k] + 1)) for k in total if total[k] >= 20}
    return {"": 1.0, "/a": -0.5, "<tag>": tag_score} | {k: max(-2.0, min(TAG if k[0] == "<" else 2.0, o)) for k, o in odds.items()}


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text: the best contiguous stretch of blocks and the tags between them."""
    blocks, inside, marked = blocks_of(page or "")
    marked = marked and any(inside)
    best, begin, end = 0.0, 0, 0
    score, start = 0.0, 0
    for i, (kind, tags, text) in enumerate(blocks):
        for tag in tags:
            score += weights.get(f"<{tag}>", weights["<tag>"] if tag in BLOCKS else TAG)
        if score <= 0:
            score, start = 0.0, i
        word = weights.get(kind, weights["/a"] if kind.endswith("/a") else weights[""])
        score += (word + MARK * (2 * inside[i] - 1) * marked) * (text.count(" ") + 1)
        if score > best:
            best, begin, end = score, start, i + 1
    return " ".join(text for _, _, text in blocks[begin:end])


def learned(pages: DataFrame, key: str = "page_id", column: str = "html", most: int = PAGES) -> dict[str, float]:
    """Weights from the marked pages whose ids hash least, at most ``most`` of them."""
    marked = pages.where(F.lower(column).rlike("<(article|main)[ >]")).select(key, column)
    few = marked.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(F.lit(4), key), key).limit(most)
    rows = marked.join(F.broadcast(few), key).orderBy(F.xxhash64(F.lit(4), key), key).limit(most).select(column).collect()
    return weights_of([r[0] for r in rows])


def main_text(pages: DataFrame, weights: dict[str, float], column: str = "html", text: str = "text") -> DataFrame:
    """pages with ``text``; all other columns but the html stay."""
    fresh(pages.drop(column), text)
    rest = [f for f in pages.schema.fields if f.name != column]
    schema = T.StructType([*rest, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array((extract(x.as_py(), weights) for x in b[column]), pa.string())
            yield pa.RecordBatch.from_arrays([b[f.name] for f in rest] + [got], names=[f.name for f in rest] + [text])

    return pages.mapInArrow(run, schema)
