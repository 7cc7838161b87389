"""Scalar rules on text columns. Classes of characters are written out, since Java's ``\\s`` and ``\\w`` only know ASCII."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F, types

#: Kinds of enumerators by the shape of a style's name, in order of precedence.
ENUMERATORS = (
    ("ROMAN", r"^(?:[IVXivx]+|[Ⅰ-Ⅿ])\s*[.)]?$"),
    ("DECIMAL_DOT", r"^[0-9]+\s*\.$"),
    ("DECIMAL_PAREN", r"^[0-9]+\s*\)$"),
    ("CIRCLED", r"^[①-⑳]$"),
    ("HANGUL", r"^[가-힣]\s*[.)]?$"),
    ("LATIN", r"^[A-Za-z]\s*[.)]$"),
)
ENUMERATOR_WORDS = {"로마자": "ROMAN"}
#: Bullet glyphs by nesting rank.
GLYPHS = ("■□▣◼￭▪◾", "●○⦁•◦", "-–—―−", "·ㆍ")
#: Numbering typed in front of a heading.
HEADING_NUMBER = r"^\s*(?:부록\s*[0-9A-Za-z가-힣]+|제?\s*[0-9]+\s*[편장절관항]|[0-9]+(?:\s*[.\-]\s*[0-9]+)+|[0-9]+\s*[.)]|[A-Za-z](?:\s*[.\-]\s*[0-9]+)+|[IVXⅠ-Ⅻ]+\s*[.)])\s*[.)\]:：\-]*\s+(\S)"
#: The frame typed around a caption, and placeholders.
CAPTION_FRAME = r"^\s*(?:[<〈]\s*표\s*[^>〉]*[>〉]|\[\s*그림\s*[^\]]*\])\s*"
PLACEHOLDER = r"\{\{\s*([^{}]+?)\s*\}\}"
#: Display math, then inline math, as in the usual dollar notation: prices are not math.
MATH = r"(?s)(?<![\\$])\$\$.+?\$\$|(?<![\\$])\$[^\s$](?:[^$]*?[^\s\\$])?\$(?![0-9$])"


def _first(pairs: list[tuple[Column, Column | str | int]], otherwise=None) -> Column:  # noqa: ANN001
    chain = reduce(lambda c, p: c.when(*p) if c is not None else F.when(*p), pairs, None)
    return chain.otherwise(otherwise) if otherwise is not None else chain


def placeholders(text: Column) -> Column:
    """Names between double braces, each once, in order of first sight."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(1)), lambda x: F.trim(x)))


def enumerator_class(name: Column) -> Column:
    t = F.trim(name)
    words = [(t == k, F.lit(v)) for k, v in ENUMERATOR_WORDS.items()]
    return _first(words + [(t.rlike(p), F.lit(k)) for k, p in ENUMERATORS])


def glyph_rank(glyph: Column) -> Column:
    c = F.substring(F.trim(F.coalesce(glyph, F.lit(""))), 1, 1)
    return _first([((c != "") & F.contains(F.lit(g), c), F.lit(i)) for i, g in enumerate(GLYPHS)], F.lit(len(GLYPHS))).cast("long")


def glyph_name(name: Column) -> Column:
    """The glyph that is all of a style's name, or null."""
    t = F.trim(name)
    return F.when((F.length(t) == 1) & (glyph_rank(t) < len(GLYPHS)), t)


def role_override(name: Column, eng_name: Column) -> Column:
    """The role that a style's name (or else its English name) declares as ``AI:<ROLE>``; ``H<n>`` is ``HEADING_<n>``."""

    def one(c: Column) -> Column:
        role = F.upper(F.nullif(F.regexp_extract(c, r"^\s*AI:([A-Za-z_][A-Za-z0-9_]*)\s*$", 1), F.lit("")))
        return F.regexp_replace(role, r"^H([0-9]+)$", "HEADING_$1")

    return F.coalesce(one(name), one(eng_name))


def strip_heading_number(text: Column) -> Column:
    """Numbering in front of a title goes, if a title remains."""
    bare = F.trim(F.regexp_replace(text, HEADING_NUMBER, "$1"))
    return F.coalesce(F.nullif(bare, F.lit("")), text)


def chapter_label(title: Column) -> Column:
    """The label that a chapter title's own number spells: ``Ⅲ.`` or ``3장`` or ``부록 A``; null if none."""
    app = F.regexp_extract(title, r"^\s*(부록)(?:\s*[0-9A-Za-z가-힣]+)?(?:\s|$|[.)\]:：-])", 1)
    app_id = F.regexp_extract(title, r"^\s*부록\s*([0-9A-Za-z가-힣]+)(?:\s|$|[.)\]:：-])", 1)
    ko = F.regexp_extract(title, r"^\s*제?\s*([0-9]+)\s*장", 1)
    num = F.regexp_extract(title, r"^\s*([IVXⅠ-Ⅻ]+|[0-9]+)\s*[.)]", 1)
    return F.when(app != "", F.concat(app, app_id)).when(ko != "", ko).when(num != "", num)


def strip_caption_frame(text: Column) -> Column:
    return F.regexp_replace(text, CAPTION_FRAME, "")


def caption_key(text: Column) -> Column:
    """Runs of white space become one space, the ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def label_line(text: Column) -> Column:
    """The label of a line such as ``□ label : ``, null if it isn't one (the tail is blank or date marks)."""
    label = F.regexp_extract(text, r"^\s*[□■○●\-–—ㆍ·*]?\s*([^:：\n]+?)\s*[:：][\s.~·\-년월일]*$", 1)
    return F.nullif(label, F.lit(""))


#: Unchecked and checked glyphs.
CHECKBOXES = (("□", "■"), ("☐", "☑"), ("◻", "◼"))


def checkboxes(text: Column) -> Column:
    """array<struct<label, state>> of the checkbox glyphs in a text: the first word after a glyph, else the last before it; label lines with a blank tail are none."""
    found = []
    for off, on in CHECKBOXES:
        for glyph, state in ((off, "off"), (on, "on")):
            after = F.trim(F.regexp_extract(text, f"(?s){glyph}(.*)$", 1))
            before = F.trim(F.substring_index(text, glyph, 1))
            blank = after.rlike(r"^[^:：]*[:：][\s.~·\-년월일]*$")
            first, last = F.split(after, r"\s+")[0], F.regexp_replace(F.regexp_extract(before, r"(\S+)$", 1), r"^[.·,)：:]+|[.·,)：:]+$", "")
            label = F.when(~F.contains(text, F.lit(glyph)) | blank, None).when(after != "", first).otherwise(F.nullif(last, F.lit("")))
            found.append(F.when(label.isNotNull(), F.struct(label.alias("label"), F.lit(state).alias("state"))))
    return F.array_compact(F.array(*found))


def toggled(text: Column, label: str, on: bool = True) -> Column:
    """The text with the glyph beside a label set or cleared, on either side; nothing changes if it is so already."""
    quoted = "\\Q" + label + "\\E"
    for off, ticked in CHECKBOXES:
        old, new = (off, ticked) if on else (ticked, off)
        left = F.regexp_replace(text, f"{old}(\\s*)({quoted})", f"{new}$1$2")
        text = F.when(left != text, left).otherwise(F.regexp_replace(text, f"({quoted})([^\\w\\n]*){old}", f"$1$2{new}"))
    return text


def tab_slots(text: Column) -> Column:
    """struct<label, tails>: what precedes the first tab, and the current values after each tab."""
    parts = F.split(text, "\t")
    return F.when(F.size(parts) > 1, F.struct(F.trim(parts[0]).alias("label"), F.slice(parts, 2, F.size(parts)).alias("tails")))


def split_run_tokens(joined: Column, runs: Column) -> Column:
    """Placeholders that only show when a paragraph's runs are joined."""
    return F.array_except(placeholders(joined), F.flatten(F.transform(runs, placeholders)))


def document_title(meta_title: Column, first_heading: Column) -> Column:
    """The title given, line breaks as spaces, else the first heading."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(meta_title, r"\s*\n\s*", " ")), F.lit("")), first_heading)


def document_creator(creator: Column, lead: Column, author: Column, profile_name: Column) -> Column:
    """The creator given, else the lead researcher's name, else the author, else the profile's name."""
    name = F.split(F.trim(lead), r"\s+")[0]
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in (creator, name, author, profile_name)))


def is_label_shaped(text: Column) -> Column:
    """Up to 20 characters, no sentence mark at the end, not a number."""
    return F.coalesce((F.length(text) > 0) & (F.length(text) <= 20) & ~F.substring(text, -1, 1).isin(".", "?", "!") & ~text.rlike(r"^[0-9.,/\-\s]+$"), F.lit(False))


def kdate(day: Column) -> Column:
    return F.concat(F.year(day), F.lit(". "), F.month(day), F.lit(". "), F.dayofmonth(day), F.lit("."))


def publication_month(text: Column) -> Column:
    """``2026-08`` becomes ``2026년 8월``; anything else stays."""
    year, month = (F.regexp_extract(text, r"^\s*([0-9]{4})[-.]0?([0-9]{1,2})\s*$", i) for i in (1, 2))
    return F.when(year != "", F.concat(year, F.lit("년 "), month, F.lit("월"))).otherwise(text)


def url_to_command(url: Column) -> Column:
    return F.concat(F.regexp_replace(url, r"([\\:;])", r"\\$1"), F.lit(";1;0;2;"))


def command_to_url(command: Column) -> Column:
    """The part before the first bare semicolon, unescaped; null for targets inside the document."""
    raw = F.regexp_extract(command, r"(?s)^((?:\\.|[^\;])*)", 1)
    url = F.regexp_replace(raw, r"(?s)\\(.)", "$1")
    return F.when((url != "") & ~url.startswith("?"), url)


def math_spans(text: Column) -> Column:
    """array<struct<latex, kind>> of the math in a text."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(MATH), F.lit(0)),
        lambda m: F.when(m.startswith("$$"), F.struct(F.substring(m, F.lit(3), F.length(m) - 4).alias("latex"), F.lit("display").alias("kind"))).otherwise(F.struct(F.substring(m, F.lit(2), F.length(m) - 2).alias("latex"), F.lit("inline").alias("kind"))),
    )


def pipe_cell(text: Column) -> Column:
    """A cell's text for a pipe table: pipes are escaped outside math, line breaks become ``<br>``."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MATH + r"|[^$]+|\$"), F.lit(0))
    kept = F.transform(pieces, lambda p: F.when(p.startswith("$") & (F.length(p) > 1), p).otherwise(F.replace(p, F.lit("|"), F.lit("\\|"))))
    return F.replace(F.array_join(kept, ""), F.lit("\n"), F.lit("<br>"))


def alt_text(comment: Column) -> Column:
    """struct<origname, px_w, px_h> of a picture's description."""
    name = F.nullif(F.trim(F.regexp_extract(comment, r"원본 그림의 이름:\s*(.+)", 1)), F.lit(""))
    size = r"(?s)가로\s*([0-9]+)\s*pixel.*?세로\s*([0-9]+)\s*pixel"
    return F.struct(name.alias("origname"), *(F.nullif(F.regexp_extract(comment, size, i), F.lit("")).cast("int").alias(n) for i, n in ((1, "px_w"), (2, "px_h"))))


def image_format(content: Column) -> Column:
    """png, jpg, gif or bmp by the first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpg").when(head.startswith("474946383761") | head.startswith("474946383961"), "gif").when(head.startswith("424D"), "bmp")


def _number(content: Column, at: int, n: int, little: bool = False) -> Column:
    """The unsigned number in n bytes from a place (counted from 1)."""
    digits = F.hex(F.substring(content, at, n))
    if little:
        digits = F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in range(n - 1, -1, -1)))
    return F.conv(digits, 16, 10).cast("long")


def image_size(content: Column) -> Column:
    """struct<px_w, px_h> from the header of a png, gif, bmp or jpeg; nulls for anything else. Only jpegs go to a helper, with the bytes that hold their header."""
    form, n = image_format(content), F.length(content)
    high = _number(content, 23, 4, little=True)
    tall = F.when(high >= 1 << 31, F.lit(1 << 32) - high).otherwise(high)  # rows from the top down are counted below zero
    w = F.when((form == "png") & (n >= 24), _number(content, 17, 4)).when((form == "gif") & (n >= 10), _number(content, 7, 2, little=True)).when((form == "bmp") & (n >= 26), _number(content, 19, 4, little=True))
    h = F.when((form == "png") & (n >= 24), _number(content, 21, 4)).when((form == "gif") & (n >= 10), _number(content, 9, 2, little=True)).when((form == "bmp") & (n >= 26), tall)
    frame = _jpeg_size(F.when(form == "jpg", F.substring(content, 1, JPEG_HEAD)))
    return F.struct(F.coalesce(w.cast("int"), frame["px_w"]).alias("px_w"), F.coalesce(h.cast("int"), frame["px_h"]).alias("px_h"))


#: Where the frame header of a jpeg is looked for: behind metadata segments of 64 KB each.
JPEG_HEAD = 1 << 20


@F.pandas_udf(types.StructType([types.StructField("px_w", types.IntegerType()), types.StructField("px_h", types.IntegerType())]))
def _jpeg_size(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_frame(bytes(c)) if c is not None else (None, None) for c in content], columns=["px_w", "px_h"], dtype="Int32")


def _frame(b: bytes) -> tuple[int | None, int | None]:
    """Size in the first frame header: segments are a marker and, but for bare ones, a length that counts itself."""
    at = 2
    while at + 9 <= len(b):
        marker = b[at + 1]
        if b[at] != 0xFF or marker == 0xFF:
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD9:
            at += 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(b[at + 7 : at + 9], "big"), int.from_bytes(b[at + 5 : at + 7], "big")
        else:
            at += 2 + int.from_bytes(b[at + 2 : at + 4], "big")
    return None, None


def fitted(width: Column, px_w: Column, px_h: Column, cap: Column) -> Column:
    """struct<width, height, ratio>: the frame's width and the height that keeps the picture's shape; beyond the cap the height is the cap and the width follows. ratio is width over height, to four places (half-way values to the even one)."""
    height = fitted_height(width, px_w, px_h)
    high = height > cap
    own = F.when(high, F.bround(cap * px_w / px_h).cast("long")).otherwise(width.cast("long"))
    tall = F.when(high, cap.cast("long")).otherwise(height)
    return F.struct(own.alias("width"), tall.alias("height"), (F.rint(F.try_divide(own, tall) * 10000) / 10000).alias("ratio"))


def fitted_height(width: Column, px_w: Column, px_h: Column) -> Column:
    """Height for an image in a frame of that width; half-way values go to the even neighbour."""
    return F.bround(width * px_h / px_w).cast("long")


def tail_fit(total: Column, tail: Column, spacing: Column, ratio: Column, min_spacing: int = -5, min_ratio: int = 95) -> Column:
    """struct<spacing, ratio, fittable>: as many one-percent steps as the tail's share needs, first of spacing, then of ratio."""
    steps = F.ceil(F.try_divide(100 * tail, total))
    room = F.greatest(spacing - min_spacing, F.lit(0))
    more = F.greatest(ratio - min_ratio, F.lit(0))
    by_spacing = F.least(steps, room)
    by_ratio = F.least(steps - by_spacing, more)
    good = (total > 0) & (tail > 0)
    return F.struct(
        F.when(good, spacing - by_spacing).otherwise(spacing).cast("long").alias("spacing"),
        F.when(good, ratio - by_ratio).otherwise(ratio).cast("long").alias("ratio"),
        F.coalesce(good & (by_spacing + by_ratio >= steps), F.lit(False)).alias("fittable"),
    )


def em_width(text: Column) -> Column:
    """Width in em: 1 for characters from U+1100, else 0.55."""
    wide = F.regexp_count(text, F.lit(r"[\x{1100}-\x{10FFFF}]"))
    return wide + (F.length(text) - wide) * 0.55


def figure_line(title: Column, paths: Column, label: Column, notes: Column) -> Column:
    """A figure in Markdown: its pictures on one line, the first with the title, the label at the end; each note on a line below."""
    target = F.transform(paths, lambda p: F.when(p.rlike(r"[\s)]"), F.concat(F.lit("<"), p, F.lit(">"))).otherwise(p))
    images = F.transform(target, lambda p, i: F.concat(F.lit("!["), F.when(i == 0, F.coalesce(title, F.lit(""))).otherwise(""), F.lit("]("), p, F.lit(")")))
    line = F.concat(F.array_join(images, " "), F.coalesce(F.concat(F.lit("{#"), label, F.lit("}")), F.lit("")))
    return F.array_join(F.concat(F.array(line), F.filter(F.coalesce(notes, F.array().cast("array<string>")), lambda n: F.trim(n) != "")), "\n")


def rendered(kind: Column, level: Column, text: Column) -> Column:
    """A paragraph in Markdown: headings 1 to 6, bullets and numbers indented by level."""
    return F.when(kind == "HEADING", F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), level)).cast("int")), F.lit(" "), text)).when(kind == "BULLET", F.concat(F.repeat(F.lit("  "), (level - 1).cast("int")), F.lit("* "), text)).when(kind == "ORDERED", F.concat(F.repeat(F.lit("  "), (level - 1).cast("int")), F.lit("1. "), text)).otherwise(text)


@F.pandas_udf(types.StringType())
def normalize_label(text: pd.Series) -> pd.Series:
    """Composed Unicode, letters and digits only, case folded."""
    return text.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFC", s) if c.isalnum()).casefold())


@F.pandas_udf(types.LongType())
def wrapped_lines(text: pd.Series, em: pd.Series) -> pd.Series:
    """Lines that a text takes when glyphs are placed one after the other in lines of ``em``."""

    def one(s: str | None, width: float) -> int | None:
        if s is None:
            return None
        lines, used = 1, 0.0
        for c in s:
            w = 1.0 if ord(c) >= 0x1100 else 0.55
            if used and used + w > width + 1e-9:
                lines, used = lines + 1, 0.0
            used += w
        return lines

    return pd.Series([one(s, w) for s, w in zip(text, em, strict=True)])
