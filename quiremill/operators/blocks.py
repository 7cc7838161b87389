"""Markdown into blocks: lines are classified by column expressions, and windows over a document's lines form the blocks.

``doc_id`` identifies a document; a null text has no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quiremill.functions import text as T
from quiremill.sources.shared import dealt

#: Kinds of lines in order of precedence, note lines below tables and figures.
_IMAGE = r"!\[([^\]]*)\]\((<[^>]*>|[^)\s]+)[^)]*\)"
FIGURE_LINE = rf"^\s*(?:{_IMAGE}\s*)+(?:\{{#[^}}]+\}})?\s*$"
HEADING_LINE = r"^(#{1,6})\s+(.*)$"
ORDERED_LINE = r"^(\s*)[0-9]+[.)]\s+(.*)$"
BULLET_LINE = r"^(\s*)[-*]\s+(.*)$"
LITERAL_BULLET_LINE = r"^(\s*)[-*+■□▣◼￭▪◾●○⦁•◦–—―−·ㆍ]\s+(.*)$"
DELIMITER_ROW = r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$"
NOTE_LINE = r"^\s*<?\s*(?:주|출처|자료)\s*[>)\].:]"
NOTE_DEFINITION = r"^\[\^([^\]\s]+)\]:[ \t]?(.*)$"
FRONT = r"(?s)\A\x{feff}?---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"
#: A cell of a pipe row: escapes and inline math hold no column break.
_CELL = r"((?:\\.|\$[^\s$](?:[^$]*[^\s$\\])?\$(?![0-9$])|[^|])*)\|"


def _is_rule(line: Column) -> Column:
    """A rule: three marks or more of one kind, a dash, a star or a low line, with nothing but blanks between them."""
    marks = F.regexp_replace(line, r"\s", "")
    first = F.substring(marks, 1, 1)
    return (F.length(marks) >= 3) & first.isin("-", "*", "_") & (F.replace(marks, first, F.lit("")) == "")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _by_line():  # noqa: ANN202
    return W.partitionBy("doc_id").orderBy("i")


def _lines(docs: DataFrame, text: Column, breaks: str = r"\r\n|\r|\n") -> DataFrame:
    """(doc_id, i, line)."""
    return dealt(docs, "doc_id").select("doc_id", F.posexplode(F.split(text, breaks)).alias("i", "line"))


def _with_notes(lines: DataFrame) -> DataFrame:
    """Lines with ``head`` (a definition begins) and ``note`` (the line belongs to one: indented lines go on)."""
    head, more = F.col("line").rlike(NOTE_DEFINITION), F.col("line").rlike(r"^[ \t]+\S")
    opened = F.last(F.when(~more, head), ignorenulls=True).over(_by_line())
    return lines.withColumns({"head": head, "note": head | (more & F.coalesce(opened, F.lit(False)))})


def footnote_definitions(docs: DataFrame, text: str = "text") -> DataFrame:
    """SC22: (doc_id, note_id, note); the last definition of an id counts."""
    notes = _with_notes(_lines(docs, F.col(text))).where("note").withColumn("no", F.sum(F.col("head").cast("int")).over(_by_line()))
    said = _stripped(F.when(F.col("head"), F.regexp_extract("line", NOTE_DEFINITION, 2)).otherwise(F.col("line")))
    whole = notes.groupBy("doc_id", "no").agg(
        F.max(F.when(F.col("head"), F.regexp_extract("line", NOTE_DEFINITION, 1))).alias("note_id"),
        F.trim(F.array_join(F.sort_array(F.collect_list(F.struct("i", said.alias("said"))))["said"], " ")).alias("note"),
    )
    return whole.groupBy("doc_id", "note_id").agg(F.max_by("note", "no").alias("note"))


def _cells(line: Column) -> Column:
    inner = F.regexp_replace(F.regexp_replace(F.trim(line), r"^\|", ""), r"(?<!\\)\|$", "")
    return F.transform(F.regexp_extract_all(F.concat(inner, F.lit("|")), F.lit(_CELL), F.lit(1)), lambda c: F.replace(_stripped(c), F.lit("\\|"), F.lit("|")))


def _kinds(lines: DataFrame, bullet: str) -> DataFrame:
    """Lines with n (place), kind (of the line by itself, tables and display math found by windows) and first (of its table or math)."""
    o = W.partitionBy("doc_id").orderBy("n")
    l = lines.withColumns({"n": F.row_number().over(_by_line()), "line": F.regexp_replace("line", r"\s+$", "")})  # noqa: E741
    pipe = F.contains("line", F.lit("|"))
    l = l.withColumn("opens", pipe & F.coalesce(F.lead(F.col("line").rlike(DELIMITER_ROW)).over(o), F.lit(False)))  # noqa: E741
    l = l.withColumn("row", pipe | F.coalesce(F.lag("opens").over(o), F.lit(False)))  # noqa: E741
    l = l.withColumn("run", F.sum((~F.col("row")).cast("int")).over(o))  # noqa: E741
    l = l.withColumn("first", F.min(F.when(F.col("opens"), F.col("n"))).over(W.partitionBy("doc_id", "run")))  # noqa: E741
    l = l.withColumn("table", F.col("row") & F.coalesce(F.col("n") >= F.col("first"), F.lit(False)))  # noqa: E741
    # Display math: on one line, or from a line with one $$ at its beginning to the next with one at its end.
    dollars = F.regexp_count("line", F.lit(r"\$\$"))
    alone = F.col("line").rlike(r"^\s*\$\$\s*\S.*\$\$$") & (dollars == 2)
    edge = ~F.col("table") & (dollars == 1) & F.col("line").rlike(r"^\s*\$\$|\$\$$")
    l = l.withColumns({"alone": alone & ~F.col("table"), "edge": edge}).withColumn("edges", F.sum(F.col("edge").cast("int")).over(o))  # noqa: E741
    l = l.withColumn("pair", F.floor((F.col("edges") - F.col("edge").cast("int")) / 2))  # noqa: E741
    l = l.withColumns({"of_pair": F.sum(F.col("edge").cast("int")).over(W.partitionBy("doc_id", "pair")), "led": F.min(F.when(F.col("edge"), F.struct("n", F.col("line").rlike(r"^\s*\$\$").alias("led")))).over(W.partitionBy("doc_id", "pair"))})  # noqa: E741
    inside = F.col("edge") | (F.col("edges") % 2 == 1)
    display = F.coalesce((F.col("of_pair") == 2) & F.col("led.led") & inside & ~F.col("table"), F.lit(False))
    kind = F.when(F.col("table"), "table").when(F.col("alone") | display, "math").when(F.col("line").rlike(FIGURE_LINE), "figure").when(F.col("line") == "", "blank")
    kind = kind.when(_is_rule(F.col("line")), "rule")
    for name, pattern in (("heading", HEADING_LINE), ("ordered", ORDERED_LINE), ("bullet", bullet)):
        kind = kind.when(F.col("line").rlike(pattern), name)
    first = F.when(F.col("table"), F.col("first")).when(F.col("alone"), F.col("n")).when(display, F.col("led.n"))
    return l.select("doc_id", "n", "line", kind.otherwise("paragraph").alias("kind"), first.alias("first"))


def _grouped(lines: DataFrame) -> DataFrame:
    """Lines with their block's number; notes and captions are lines of their table's or figure's block."""
    o = W.partitionBy("doc_id").orderBy("n")
    said = (F.col("kind") == "paragraph") & F.col("line").rlike(NOTE_LINE)
    under = F.last(F.when(~said, F.col("kind")), ignorenulls=True).over(o)
    l = lines.withColumn("kind", F.when(said & under.isin("table", "figure"), "note").otherwise(F.col("kind")))  # noqa: E741
    next_one, next_two = F.lead("kind", 1).over(o), F.lead("kind", 2).over(o)
    framed = F.col("line").rlike(T.CAPTION_FRAME) & F.ltrim("line").startswith("[") & ((next_one == "figure") | ((next_one == "blank") & (next_two == "figure")))
    l = l.withColumn("kind", F.when((F.col("kind") == "paragraph") & ((next_one == "table") | F.coalesce(framed, F.lit(False))), "caption").otherwise(F.col("kind")))  # noqa: E741
    one, two = F.lag("kind", 1).over(o), F.lag("kind", 2).over(o)
    captioned = (one == "caption") | ((one == "blank") & (two == "caption"))
    goes_on = F.when(F.col("kind").isin("blank", "note"), True).when(F.col("kind").isin("table", "math"), (F.col("n") != F.col("first")) | captioned).when(F.col("kind") == "figure", (one == "figure") | captioned).when(F.col("kind") == "paragraph", one == "paragraph")
    return l.withColumn("block", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(o))


def parse_markdown(docs: DataFrame, text: str = "text", literal_bullets: bool = False) -> DataFrame:
    """SC21: one row for each block of each document (doc_id, text): headings, lists, rules, tables with caption and notes, figures, display math and paragraphs, with the blank lines before each.

    Comments and footnote definitions are no blocks. With literal_bullets, typed glyphs begin list items too.
    """
    body = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    lines = _grouped(_kinds(_with_notes(_lines(docs, body)).where("not note").select("doc_id", "i", "line"), LITERAL_BULLET_LINE if literal_bullets else BULLET_LINE))
    held = F.sort_array(F.collect_list(F.when(F.col("kind") != "blank", F.struct("n", "kind", "line", "first"))))
    blocks = lines.groupBy("doc_id", "block").agg(
        F.max(F.when(~F.col("kind").isin("blank", "note", "caption"), F.col("kind"))).alias("kind"),
        held.alias("held"),
        (F.max("n") - F.coalesce(F.max(F.when(F.col("kind") != "blank", F.col("n"))), F.min("n") - 1)).alias("blanks"),
    )
    o = W.partitionBy("doc_id").orderBy("block")
    blocks = blocks.withColumn("blank_before", F.coalesce(F.lag("blanks").over(o), F.lit(0))).where("kind is not null")

    def of(kind: str) -> Column:
        return F.transform(F.filter("held", lambda x: x["kind"] == kind), lambda x: x["line"])

    whole = F.array_join(F.transform(of("paragraph"), _stripped), " ")
    caption = F.nullif(F.trim(F.array_join(of("caption"), " ")), F.lit(""))
    # A paragraph one blank line above a table without a caption is the caption.
    gives = (F.col("kind") == "paragraph") & (F.col("next_kind") == "table") & ~F.col("next_captioned") & (F.col("next_blank") <= 1)
    blocks = blocks.withColumns({"whole": whole, "own": caption})
    blocks = blocks.withColumns({"next_kind": F.lead("kind").over(o), "next_captioned": F.lead(F.col("own").isNotNull()).over(o), "next_blank": F.lead("blank_before").over(o)})
    blocks = blocks.withColumn("given", F.coalesce(gives, F.lit(False)))
    blocks = blocks.withColumn("caption", F.coalesce("own", F.when(F.lag("given").over(o), F.lag("whole").over(o)))).where("not given")

    line = F.get(of("heading"), F.lit(0))
    title = _stripped(F.regexp_extract(line, HEADING_LINE, 2))
    item = F.coalesce(F.get(of("ordered"), F.lit(0)), F.get(of("bullet"), F.lit(0)))
    mark = LITERAL_BULLET_LINE if literal_bullets else BULLET_LINE
    item_text = _stripped(F.when(F.col("kind") == "ordered", F.regexp_extract(item, ORDERED_LINE, 2)).otherwise(F.regexp_extract(item, mark, 2)))
    indent = F.regexp_replace(F.regexp_extract(item, r"^(\s*)", 1), r"  | ?\t", "xx")
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract(line, HEADING_LINE, 1))).when(F.col("kind").isin("ordered", "bullet"), F.floor(F.length(indent) / 2) + 1).otherwise(0)
    latex = F.regexp_replace(F.array_join(of("math"), "\n"), r"^\s*\$\$\s*|\s*\$\$\s*$", "")
    table = of("table")
    rows = F.transform(F.filter(table, lambda x, i: i != 1), _cells)
    aligns = F.transform(_cells(F.get(table, F.lit(1))), lambda c: F.when(c.startswith(":") & c.endswith(":"), "center").when(c.endswith(":"), "right").otherwise("left"))
    wide = F.size(F.get(rows, F.lit(0)))
    aligns = F.slice(F.concat(aligns, F.array_repeat(F.lit("left"), wide)), F.lit(1), wide)
    figure = F.array_join(of("figure"), " ")
    alts, paths = (F.regexp_extract_all(figure, F.lit(_IMAGE), F.lit(k)) for k in (1, 2))
    alt = F.coalesce(F.try_element_at(F.filter(F.transform(alts, F.trim), lambda a: a != ""), F.lit(1)), F.lit(""))
    said = F.when(F.col("kind") == "paragraph", F.col("whole")).when(F.col("kind") == "heading", T.strip_heading_number(title)).when(F.col("kind").isin("ordered", "bullet"), item_text).when(F.col("kind") == "math", latex).when(F.col("kind") == "figure", alt).otherwise("")
    is_table, is_figure = F.col("kind") == "table", F.col("kind") == "figure"
    caption = F.when(is_figure, F.nullif(F.trim(F.regexp_replace("caption", T.CAPTION_FRAME, "")), F.lit(""))).when(is_table, F.col("caption"))
    return blocks.select(
        "doc_id",
        (F.row_number().over(o) - 1).cast("long").alias("ord"),
        "kind",
        level.cast("long").alias("level"),
        said.alias("text"),
        F.when(F.col("kind") == "heading", title).alias("raw_text"),
        F.col("blank_before").cast("long").alias("blank_before"),
        F.when(is_table, rows).alias("rows"),
        F.when(is_table, aligns).alias("aligns"),
        caption.alias("caption"),
        F.nullif(F.array_join(F.transform(of("note"), _stripped), "\n"), F.lit("")).alias("note"),
        F.when(is_figure, F.transform(paths, lambda p: F.regexp_replace(p, "^<(.*)>$", "$1"))).alias("paths"),
        F.when(is_figure, F.nullif(F.regexp_extract(figure, r"\)\s*\{#([^}]+)\}", 1), F.lit(""))).alias("label"),
    )


def _scalar(raw: Column) -> Column:
    """A value with its quotes resolved: double ones take escapes, in single ones a doubled quote is one."""
    v, inner = F.trim(raw), F.expr("substring(trim(raw), 2, length(trim(raw)) - 2)")
    quoted = F.coalesce(F.from_json(F.concat(F.lit("["), v, F.lit("]")), "array<string>")[0], inner)
    return F.when((F.length(v) > 1) & v.rlike(r'(?s)^".*"$'), quoted).when((F.length(v) > 1) & v.rlike(r"(?s)^'.*'$"), F.replace(inner, F.lit("''"), F.lit("'"))).otherwise(v)


def split_front_matter(docs: DataFrame, text: str = "text") -> DataFrame:
    """SC15: (doc_id, meta, body): the flat keys of a leading block between ``---`` lines, each with its values, and the rest of the text.

    Values are scalars, ``- item`` lines, or the lines of a ``|`` block as one; comments are left out, the
    last of equal keys counts.
    """
    lines = _lines(docs, F.nullif(F.regexp_extract(text, FRONT, 1), F.lit("")), r"\r?\n").where(~F.col("line").rlike(r"^\s*(?:#|$)"))
    inner, bare = F.col("line").rlike(r"^[ \t]"), F.trim("line")
    top = ~inner & F.contains("line", F.lit(":"))
    block = F.coalesce(F.last(F.when(top, F.col("line").rlike(r":\s*\|-?\s*$")), ignorenulls=True).over(_by_line()), F.lit(False))
    l = lines.withColumns({"key": top | (inner & ~block & ~bare.startswith("- ") & F.contains("line", F.lit(":"))), "inner": inner})  # noqa: E741
    l = l.withColumn("no", F.sum(F.col("key").cast("int")).over(_by_line())).where("no > 0 and (key or inner)")  # noqa: E741
    after = F.expr("substring(line, instr(line, ':') + 1)")
    l = l.withColumns({"name": F.when(F.col("key"), F.trim(F.substring_index("line", ":", 1))), "raw": F.when(F.col("key"), after).when(bare.startswith("- "), F.expr("substring(trim(line), 3)"))})  # noqa: E741
    l = l.withColumns({"value": _scalar(F.col("raw")), "bare": bare})  # noqa: E741
    held = F.sort_array(F.collect_list(F.struct("i", "key", "value", "bare")))
    each = l.groupBy("doc_id", "no").agg(F.max("name").alias("name"), held.alias("held"))
    given, below = F.col("held")[0]["value"], F.slice("held", F.lit(2), F.size("held"))
    items = F.transform(F.filter(below, lambda x: x["value"].isNotNull()), lambda x: x["value"])
    values = F.when(given.isin("|", "|-"), F.array(F.array_join(F.transform(below, lambda x: x["bare"]), "\n"))).when(F.size(items) > 0, items).when(given == "", F.array().cast("array<string>")).otherwise(F.array(given))
    last = each.groupBy("doc_id", "name").agg(F.max_by(values, "no").alias("values"))
    meta = last.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "values")))).alias("meta"))
    none = F.expr("cast(map() as map<string, array<string>>)")
    return docs.join(meta, "doc_id", "left").select("doc_id", F.when(F.col(text).isNotNull(), F.coalesce("meta", none)).alias("meta"), F.regexp_replace(text, FRONT, "").alias("body"))
