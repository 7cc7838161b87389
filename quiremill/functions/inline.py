"""Links and emphasis inside one line of Markdown.

A line becomes two strings of one length: its characters with escapes resolved, and their *shape*, in
which a character that was escaped, or that lies in math, is a dot. Marks are looked for in the shape,
and what they enclose is cut from the characters, so neither escapes nor math need to be put back.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, functions as F, types

_PIECE = types.ArrayType(types.StructType([types.StructField("text", types.StringType()), types.StructField("url", types.StringType())]))
_SPAN = types.ArrayType(types.StructType([types.StructField("text", types.StringType()), types.StructField("bold", types.BooleanType()), types.StructField("italic", types.BooleanType())]))

#: The punctuation of ASCII, which a backslash makes plain.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Of these, the marks that links and emphasis are made of; the others mean the same with a backslash.
MARKS = "!()*<>[]^`$\\"
#: What ends a bare URL beside white space, and what a sentence puts after one.
URL_ENDS = "<>\"「」『』（）〈〉《》，。、·“”‘’"
AFTER_URL = ".,;:!?'\"*"
#: A bare URL doesn't begin inside a word, a path, an address or a link's target.
_BARE = re.compile(rf"https?://[^\s{re.escape(URL_ENDS)}]+")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*:")
_HOST = re.compile(r"https?://[A-Za-z0-9\-._~%:@\[\]]*")
#: What no escape, code or math begins in; where a link may begin.
_UNMARKED = re.compile(r"[^\\`$]+")
_LINK = re.compile(r"[\[<]|https?://")
_ANGLE = re.compile(r"https?://[^\s<>]+")
_TITLE = re.compile(r"\s+\"[^\"]*\"")


def _math_end(text: str, at: int) -> int:
    """Where the math that a dollar at ``at`` opens ends, or ``at`` if it opens none: no space inside the dollars, no digit after, no blank line within."""
    if text.startswith("$$", at):
        close = text.find("$$", at + 2)
        return close + 2 if close > at + 2 else at
    if text[at + 1 : at + 2].strip() == "":
        return at
    limit = text.find("\n\n", at)
    limit = len(text) if limit < 0 else limit
    close = text.find("$", at + 2, limit)
    while close > 0:
        if text[close - 1] not in " \t\n\\" and not (text[close + 1 : close + 2] == "$" or text[close + 1 : close + 2].isdigit()):
            return close + 1
        close = text.find("$", close + 1, limit)
    return at


def shaped(text: str, math: bool = True) -> tuple[str, str]:
    """(characters, shape): escapes are resolved outside code and math; with math, its shape is dots."""
    chars, shape, at = [], [], 0
    while at < len(text):
        if plain := _UNMARKED.match(text, at):
            chars.append(plain[0])
            shape.append(plain[0])
            at = plain.end()
            continue
        c, end = text[at], at + 1
        if c == "\\" and text[end : end + 1] and text[end] in PUNCTUATION:
            chars.append(text[end])
            shape.append("." if text[end] in MARKS else text[end])
            at = end + 1
            continue
        if c == "`":
            while text[end : end + 1] == "`":
                end += 1
            close = text.find(text[at:end], end)
            end = close + end - at if close >= 0 else end
        elif c == "$":
            end = max(end, _math_end(text, at))
        chars.append(text[at:end])
        shape.append("." * (end - at) if math and c == "$" and end > at + 1 else text[at:end])
        at = end
    return "".join(chars), "".join(shape)


def url_length(url: str) -> int:
    """How much of a bare URL isn't the sentence around it: particles glued to an ASCII host or path, closing marks, brackets without a partner."""
    host = _HOST.match(url)
    if not host or host.end() == len("https://" if url[4] == "s" else "http://"):
        return 0
    if url[host.end() : host.end() + 1] not in ("", "/", "?", "#"):
        url = host[0]
    end, asks = len(url), any(c in url for c in "?#")
    while end:
        c = url[end - 1]
        if c in AFTER_URL or c in ")]" and url.count(c, 0, end) > url.count("(["[c == "]"], 0, end):
            end -= 1
            continue
        word = end
        while word and ord(url[word - 1]) > 127:
            word -= 1
        if asks or word == end or not (url[word - 1].isalnum() or url[word - 1] in "-._~%)]"):
            break
        end = word
    return end if end > host[0].index("//") + 2 else 0


def _target(shape: str, at: int) -> tuple[int, int, int] | None:
    """(first, end of the target, end of the link) of the parenthesis at ``at``, if a link's target with a scheme is in it."""
    first = at + 1
    while shape[first : first + 1].isspace():
        first += 1
    angle = shape[first : first + 1] == "<"
    first += angle
    scheme = _SCHEME.match(shape, first)
    if not scheme:
        return None
    end, depth = scheme.end(), 0
    while end < len(shape) and not shape[end].isspace() and shape[end] not in "<>" and (shape[end] != ")" or depth) and (shape[end] != "(" or not depth):
        depth += (shape[end] == "(") - (shape[end] == ")")
        end += 1
    if depth or end == scheme.end():
        return None
    after = end + (shape[end : end + 1] == ">")
    title = _TITLE.match(shape, after)
    after = title.end() if title else after
    while shape[after : after + 1].isspace():
        after += 1
    return (first, end, after + 1) if shape[after : after + 1] == ")" else None


def _link_at(shape: str, at: int) -> tuple[tuple[int, int], tuple[int, int], int] | None:
    """(label, target, end) of the link that begins at ``at``, if one does."""
    before = shape[at - 1] if at else ""
    if shape[at] == "[" and before != "!" and shape[at + 1 : at + 2] != "^":
        close = shape.find("]", at)
        if close > at + 1 and "\n" not in shape[at:close] and shape[close + 1 : close + 2] == "(" and (to := _target(shape, close + 1)):
            return (at + 1, close), to[:2], to[2]
    in_target = shape.endswith(("](", "](<"), 0, at)
    if shape[at] == "<" and not in_target and (m := _ANGLE.match(shape, at + 1)) and shape[m.end() : m.end() + 1] == ">":
        return m.span(), m.span(), m.end() + 1
    if shape[at] == "h" and not in_target and not (before.isalnum() or before and before in "_/@.-") and (m := _BARE.match(shape, at)):
        end = at + url_length(m[0])
        return ((at, end), (at, end), end) if end > at else None
    return None


def link_pieces(text: str) -> list[dict]:
    """The text in pieces; those of links have their URL."""
    chars, shape = shaped(text, math=False)
    out, plain = [], 0
    at = 0
    while begin := _LINK.search(shape, at):
        at = begin.start()
        found = _link_at(shape, at)
        if not found:
            at += 1
            continue
        (a, b), (c, d), end = found
        if at > plain:
            out.append({"text": chars[plain:at], "url": None})
        out.append({"text": chars[a:b], "url": chars[c:d]})
        at = plain = end
    return out + ([{"text": chars[plain:], "url": None}] if plain < len(chars) else [])


def inline_spans(text: str) -> list[dict]:
    """Bold and italic stretches of a text; stretches don't nest and don't cross lines."""
    chars, shape = shaped(text)
    out, plain, at = [], 0, shape.find("*")
    while at >= 0:
        size = 2 if shape.startswith("**", at) else 1
        line = shape.find("\n", at)
        close = shape.find("*" * size, at + size + 1, len(shape) if line < 0 else line)
        while size == 1 and close >= 0 and ("**" in (shape[close - 1 : close + 1], shape[close : close + 2])):
            close = shape.find("*", close + 1, len(shape) if line < 0 else line)
        if close < 0 or size == 1 and shape[at - 1 : at] == "*":
            at = shape.find("*", at + size)
            continue
        out += [(chars[plain:at], False, False), (chars[at + size : close], size == 2, size == 1)]
        plain = close + size
        at = shape.find("*", plain)
    out.append((chars[plain:], False, False))
    return [{"text": t, "bold": b, "italic": i} for t, b, i in out if t]


def _lists(rows: Iterable[list[dict] | None], kind: pa.StructType) -> pa.Array:
    """Lists of structs of kind, built column by column."""
    offsets, columns, n = [], [[] for _ in kind], 0
    for row in rows:
        offsets.append(None if row is None else n)
        for piece in row or ():
            for column, value in zip(columns, piece.values(), strict=True):
                column.append(value)
        n += len(row or ())
    parts = [pa.array(column, f.type) for column, f in zip(columns, kind, strict=True)]
    return pa.ListArray.from_arrays(pa.array([*offsets, n], pa.int32()), pa.StructArray.from_arrays(parts, fields=list(kind)))


@F.arrow_udf(_PIECE)
def links(text: pa.Array) -> pa.Array:
    """SC16: array<struct<text, url>>."""
    kind = pa.struct([("text", pa.string()), ("url", pa.string())])
    return _lists((None if s is None else link_pieces(s) for s in text.to_pylist()), kind)


@F.arrow_udf(_SPAN)
def spans(text: pa.Array) -> pa.Array:
    """SC20: array<struct<text, bold, italic>>."""
    kind = pa.struct([("text", pa.string()), ("bold", pa.bool_()), ("italic", pa.bool_())])
    return _lists((None if s is None else inline_spans(s) for s in text.to_pylist()), kind)


def left_aligned(text: Column, mode: str = "auto", threshold: int = 30) -> Column:
    """SC18: whether a paragraph is aligned left: never (keep), if it has a link (left), or if a link's label holds an unbroken stretch of ``threshold`` characters (auto)."""
    if mode not in ("keep", "left", "auto"):
        raise ValueError(mode)
    if mode == "keep":
        return F.lit(False)
    linked = F.filter(links(text), lambda p: p["url"].isNotNull())
    if mode == "left":
        return F.size(linked) > 0
    return F.exists(linked, lambda p: F.exists(F.split(p["text"], r"(?U)\s+"), lambda w: F.length(w) >= threshold))
