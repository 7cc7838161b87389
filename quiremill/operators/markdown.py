"""Extraction to Markdown and rules over Markdown blocks: numbering, references, styles, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from quiremill.functions import text as T
from quiremill.operators.edits import TABLE_TOKEN


def body_only(blocks: DataFrame, is_h1: str, order: str) -> DataFrame:
    """PF5: what comes before a document's first level-1 heading goes; documents without one have no body."""
    first = F.min(F.when(F.expr(is_h1), F.col(order))).over(W.partitionBy("doc_id"))
    return blocks.withColumn("first_h1", first).where(F.col(order) >= F.col("first_h1")).drop("first_h1")


def corpus_markdown(classified: DataFrame, tables: DataFrame | None = None, figures: DataFrame | None = None, notes: DataFrame | None = None, body_from_h1: bool = False) -> DataFrame:
    """SC33, SC34, SC35: one text for each document: paragraphs with roles, tables, figures and note definitions, a blank line between blocks.

    classified: doc_id, section_no, para_idx, role_kind, role_level, text; tables (doc_id, section_no, para_idx, markdown) and
    figures (doc_id, section_no, para_idx, title, paths, label, notes) stand in place of their paragraph; notes
    (doc_id, section_no, para_idx, pos, text) are numbered in order, marked at the end of their paragraph
    and defined at the end. Blank paragraphs are left out. With body_from_h1 a document begins with its first heading of
    level 1 that no table or figure stands for, blank or not: nothing before it is rendered, numbered or defined, and a
    document without one has no row.
    """
    at = ["doc_id", "section_no", "para_idx"]
    kinds = {"role_kind": "string", "role_level": "long", "text": "string", "object": "string", "note": "struct<pos:long,text:string>"}

    def rows(df: DataFrame, **have) -> DataFrame:  # noqa: ANN003
        return df.select(*at, *(have.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))

    # Everything about a paragraph comes together in one shuffle by document; all that follows keeps that partitioning.
    every = rows(classified, role_kind=F.coalesce("role_kind", F.lit("")), role_level=F.col("role_level"), text=F.coalesce("text", F.lit("")))
    if tables is not None:
        every = every.unionByName(rows(tables, object=F.col("markdown")))
    if figures is not None:
        every = every.unionByName(rows(figures, object=T.figure_line(F.col("title"), F.col("paths"), F.col("label"), F.col("notes"))))
    if notes is not None:
        every = every.unionByName(rows(notes, note=F.struct(F.col("pos").cast("long").alias("pos"), "text")))
    b = every.repartition("doc_id").groupBy(*at).agg(F.max("role_kind").alias("role_kind"), F.max("role_level").alias("role_level"), F.max("text").alias("text"), F.array_join(F.sort_array(F.collect_list("object")), "\n\n").alias("object"), F.count("object").alias("n_objects"), F.sort_array(F.collect_list("note")).alias("notes"))
    place, doc = F.struct("section_no", "para_idx"), W.partitionBy("doc_id")
    if body_from_h1:
        h1 = (F.col("n_objects") == 0) & (F.col("role_kind") == "HEADING") & (F.col("role_level") == 1)
        b = b.withColumn("begin", F.min(F.when(h1, place)).over(doc)).where(place >= F.col("begin"))
    before = F.coalesce(F.sum(F.size("notes")).over(doc.orderBy("section_no", "para_idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = F.transform("notes", lambda n, i: F.struct((F.col("before") + i + 1).alias("no"), n["text"].alias("text")))
    b = b.withColumn("before", before).withColumn("notes", numbered)
    marks = F.array_join(F.transform("notes", lambda n: F.concat(F.lit("[^"), n["no"], F.lit("]"))), "")
    text = F.concat(F.coalesce("text", F.lit("")), marks)
    said = F.when(text != "", T.rendered(F.nullif("role_kind", F.lit("")), F.greatest(F.coalesce("role_level", F.lit(1)), F.lit(1)), text))
    line = F.when(F.col("n_objects") > 0, F.nullif("object", F.lit(""))).otherwise(said)
    define = F.transform("notes", lambda n: F.concat(F.lit("[^"), n["no"], F.lit("]: "), F.regexp_replace(F.trim(n["text"]), r"\s*\n\s*", " ")))
    whole = F.sort_array(F.collect_list(F.struct("section_no", "para_idx", line.alias("line"), define.alias("define"))))
    texts = b.groupBy("doc_id").agg(whole.alias("w"))
    lines, defined = F.filter("w.line", lambda x: x.isNotNull()), F.flatten("w.define")
    texts = texts.where((F.size(lines) > 0) | (F.size(defined) > 0))
    markdown = F.concat_ws("\n\n", F.when(F.size(lines) > 0, F.array_join(lines, "\n\n")), F.when(F.size(defined) > 0, F.array_join(defined, "\n")))
    return texts.select("doc_id", F.regexp_replace(F.regexp_replace(markdown, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "").alias("markdown"))


def preview(paragraphs: DataFrame, limit: int = 2000) -> DataFrame:
    """WN16: non-blank paragraphs until their running length reaches the limit, the crossing one kept, joined by CRLF."""
    o = W.partitionBy("doc_id").orderBy("section_no", "para_idx").rowsBetween(W.unboundedPreceding, -1)
    p = paragraphs.where("trim(text) <> ''").withColumn("before", F.coalesce(F.sum(F.length("text")).over(o), F.lit(0))).where(F.col("before") < limit)
    return p.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section_no", "para_idx", "text"))), lambda x: x["text"]), "\r\n").alias("preview"))


def caption_numbers(blocks: DataFrame, per_chapter: bool = True) -> DataFrame:
    """WN7: numbers and texts of table and figure captions; plain cells take none; per chapter they restart at each level-1 heading."""
    o = W.partitionBy("doc_id").orderBy("ord")
    h1 = (F.col("kind") == "heading") & (F.col("level") == 1)
    b = blocks.withColumn("chapter", F.sum(h1.cast("int")).over(o) if per_chapter else F.lit(0))
    b = b.withColumn("chapter_label", F.max(F.when(h1, T.chapter_label(F.col("text")))).over(W.partitionBy("doc_id", "chapter")))
    c = b.where("kind in ('table', 'figure') and not coalesce(plain_cell, false)").withColumn("no", F.row_number().over(W.partitionBy("doc_id", "chapter", "kind").orderBy("ord")))
    word = F.when(F.col("kind") == "table", "표 ").otherwise("그림 ")
    number = F.when(F.col("chapter_label").isNotNull() & F.lit(per_chapter), F.concat(word, "chapter_label", F.lit("-"), F.col("no").cast("string"))).otherwise(F.concat(word, F.col("no").cast("string")))
    return c.select("doc_id", "ord", "kind", "label", F.col("no").cast("long").alias("no"), number.alias("number"))


def resolve_references(blocks: DataFrame, captions: DataFrame) -> DataFrame:
    """JN10: every {ref:id} with the number of the first caption that has the label; unresolved ones have none."""
    labels = captions.where("label is not null").groupBy("doc_id", "label").agg(F.min_by("number", "ord").alias("number"))
    asked = blocks.select("doc_id", "ord", F.posexplode(F.regexp_extract_all("text", F.lit(r"\{ref:([^{}\s]+)\}"), F.lit(1))).alias("i", "label"))
    return asked.join(labels, ["doc_id", "label"], "left").select("doc_id", "ord", F.col("i").cast("long").alias("i"), "label", "number")


def referenced_text(blocks: DataFrame, resolved: DataFrame) -> DataFrame:
    """JN10: block texts with resolved references replaced, the others kept."""
    table = resolved.where("number is not null").groupBy("doc_id", "ord").agg(F.map_from_entries(F.collect_set(F.struct("label", "number"))).alias("numbers"))
    pieces = F.split("text", r"\{ref:")
    tail = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p: F.coalesce(F.concat(F.col("numbers")[F.substring_index(p, "}", 1)], F.regexp_replace(p, r"^[^}]*\}", "")), F.concat(F.lit("{ref:"), p)))
    return blocks.join(table, ["doc_id", "ord"], "left").select("doc_id", "ord", F.when(F.col("numbers").isNull(), F.col("text")).otherwise(F.concat(pieces[0], F.array_join(tail, ""))).alias("text"))


def block_styles(blocks: DataFrame, roles: DataFrame) -> DataFrame:
    """JN11: heading and list blocks take the style of their level, clamped to what the template has; else the body's."""
    have = roles.where("role rlike '^(HEADING|BULLET)_[0-9]+$'").withColumns({"k": F.lower(F.split("role", "_")[0]), "n": F.split("role", "_")[1].cast("long")})
    levels = have.groupBy("doc_id", F.col("k").alias("kind")).agg(F.array_sort(F.collect_set("n")).alias("levels"))
    body = roles.where("role = 'BODY'").select("doc_id", F.col("style_id").alias("body_style"))
    depth = F.when(F.col("kind") == "heading", F.least(F.col("level"), F.array_max("levels"))).otherwise(F.element_at("levels", F.least(F.greatest(F.col("level"), F.lit(0)) + 1, F.size("levels")).cast("int")))
    b = blocks.join(levels, ["doc_id", "kind"], "left").withColumn("n", depth)
    own = have.select("doc_id", F.col("k").alias("kind"), "n", "style_id")
    return b.join(own, ["doc_id", "kind", "n"], "left").join(body, "doc_id", "left").select("doc_id", "ord", "kind", F.coalesce("style_id", "body_style").alias("style_id"), (F.col("style_id").isNull() & F.col("kind").isin("heading", "bullet")).alias("fallback"))


def footnote_numbers(notes: DataFrame) -> DataFrame:
    """WN8: numbers of notes (doc_id, position columns) in reference order over the document."""
    return notes.withColumn("no", F.row_number().over(W.partitionBy("doc_id").orderBy("section_no", "para_idx", "pos")).cast("long"))


def heading_gaps(blocks: DataFrame) -> DataFrame:
    """WN9: which headings get a blank paragraph above: not the first block, not directly under a shallower heading."""
    o = W.partitionBy("doc_id").orderBy("ord")
    b = blocks.withColumns({"k": F.lag("kind").over(o), "l": F.lag("level").over(o)})
    under = (F.col("k") == "heading") & (F.col("l") < F.col("level")) & (F.col("blank_before") == 0)
    return b.where("kind = 'heading'").select("doc_id", "ord", (F.col("k").isNotNull() & ~F.coalesce(under, F.lit(False))).alias("gap"))


def running_titles(blocks: DataFrame) -> DataFrame:
    """JN17: the latest level-1 heading for every later paragraph of the section."""
    o = W.partitionBy("doc_id", "section_no").orderBy("para_idx").rowsBetween(W.unboundedPreceding, 0)
    return blocks.withColumn("title", F.last(F.when(F.col("is_h1"), F.col("text")), ignorenulls=True).over(o)).where("title is not null").select("doc_id", "section_no", "para_idx", "title")


def office_holder(ends: DataFrame, holders: DataFrame) -> DataFrame:
    """JN12: ends (doc_id, end_date) with the holder (first, last or null, name) in office on that day.

    Terms are dealt to the years that they touch, so the join is on the year; an open term lasts to the latest end.
    """
    latest = ends.agg(F.max("end_date")).scalar()
    terms = holders.withColumn("until", F.coalesce("last", F.greatest(latest, "first")))
    terms = terms.where("until >= first").select("first", "until", "name", F.explode(F.sequence(F.year("first"), F.year("until"))).alias("year"))
    inside = (F.year("end_date") == F.col("year")) & F.col("end_date").between(F.col("first"), F.col("until"))
    return ends.join(terms, inside, "left").select("doc_id", "end_date", "name")


def instructions(paragraphs: DataFrame, roles: DataFrame) -> DataFrame:
    """PF6: the non-blank paragraphs in the style of the role INSTRUCTION, with the slots that they name."""
    own = roles.where("role = 'INSTRUCTION'").select("doc_id", "style_id").distinct()
    return paragraphs.where(F.trim("text") != "").join(own, ["doc_id", "style_id"], "left_semi").select("doc_id", "section_no", "para_idx", "text", T.placeholders(F.col("text")).alias("slots"))


def meta_slots(tokens: DataFrame, meta: DataFrame, required: list[str]) -> DataFrame:
    """JN13: tokens (doc_id, name, fallback) with their value, else fallback, else blank; blank required ones are reported, and a blank first line of the title (title_1) as a missing title."""
    value = F.coalesce(F.nullif("value", F.lit("")), F.col("fallback"), F.lit(""))
    return tokens.join(meta, ["doc_id", "name"], "left").select("doc_id", "name", value.alias("value"), F.when((value == "") & F.col("name").isin(*required, *(["title_1"] if "title" in required else [])), F.regexp_replace("name", "^title_1$", "title")).alias("missing"))


def merged_meta(meta: DataFrame, known: list[str]) -> DataFrame:
    """ST4: (doc_id, priority, key, value): the value of least priority for each known key."""
    o = W.partitionBy("doc_id", "key").orderBy("priority", "value")
    return meta.where(F.col("key").isin(*known)).withColumn("rn", F.row_number().over(o)).where("rn = 1").select("doc_id", "key", "value")


def co_researchers(df: DataFrame, leads: str, others: str) -> DataFrame:
    """ST5: co-leads first, then the others that aren't among them; repeats of the others stay."""
    return df.withColumn("names", F.concat(F.col(leads), F.filter(F.col(others), lambda x: ~F.array_contains(F.col(leads), x))))


def insertion_marker(paragraphs: DataFrame, known: list[str], token: str | None = None) -> DataFrame:
    """TK2: where content goes: the given token alone, or else ``{{body}}`` anywhere, else the first known marker; without any the last section, with a warning if there are more."""
    tokens = [token] if token else known
    p = paragraphs.select("doc_id", "section_no", "para_idx", F.explode(F.concat(T.placeholders(F.col("text")), F.array(F.lit("")))).alias("token")).where(F.col("token").isin("", *tokens))
    rank = F.when(F.col("token") == (token or "body"), 0).when(F.col("token") != "", 1).otherwise(2)
    section = F.when(rank == 2, -F.col("section_no")).otherwise(F.col("section_no"))
    d = W.partitionBy("doc_id")
    several = F.min("section_no").over(d) < F.max("section_no").over(d)
    p = p.withColumns({"rn": F.row_number().over(d.orderBy(rank, section, "para_idx")), "warned": several & (F.col("token") == "")}).where("rn = 1")
    return p.select("doc_id", "section_no", F.when(F.col("token") != "", F.col("para_idx")).alias("para_idx"), F.nullif("token", F.lit("")).alias("token"), "warned")


def reference_table(tables: DataFrame, pattern: str | None = None) -> DataFrame:
    """TK3: the table that others are modelled on: the first with a {{table...}} caption, or one that a caption pattern finds, else the first; ``designated`` tells which."""
    wanted = F.col("caption").rlike(TABLE_TOKEN)
    if pattern:
        wanted |= F.col("caption").rlike(pattern)
    o = W.partitionBy("doc_id").orderBy(F.desc("designated"), "table_index")
    return tables.withColumn("designated", F.coalesce(wanted, F.lit(False))).withColumn("rn", F.row_number().over(o)).where("rn = 1").select("doc_id", "table_index", "designated")


#: Keys of report metadata in Korean and the slots they stand for.
META_KEYS = {
    "제목": "title", "부제": "subtitle", "부제목": "subtitle", "총서": "report_series", "총서명": "report_series", "시리즈": "report_series",
    "과제번호": "report_number", "보고서번호": "report_number", "발간번호": "report_number", "저자": "authors", "표지저자": "authors",
    "연구책임": "lead_researcher", "공동책임": "co_lead", "공동연구": "co_researchers", "발행일": "pub_date", "발행인": "publisher", "호수": "volume",
    "머리제목": "running_title", "인쇄처": "printer", "종료일": "end_date", "과제종료일": "end_date", "작성자": "creator", "author": "creator",
}


def normalized_meta(meta: DataFrame) -> DataFrame:
    """SC14: (doc_id, key, value) with aliases resolved, blanks dropped, and the values that follow from others: authors, the title's two lines, the subtitle's colon, the month of publication."""
    alias = F.create_map(*(F.lit(x) for kv in META_KEYS.items() for x in kv))
    key = F.trim("key")
    m = meta.select("doc_id", F.coalesce(F.try_element_at(alias, key), key).alias("key"), F.trim("value").alias("value")).where("value <> ''")
    wide = m.groupBy("doc_id").agg(*(F.min(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in ("title", "subtitle", "authors", "lead_researcher", "co_lead", "pub_date")))
    title = F.replace(F.col("title"), F.lit(" // "), F.lit("\n"))
    names = F.transform(F.filter(F.array("lead_researcher", "co_lead"), lambda x: x.isNotNull()), lambda x: F.split(x, r"\s+")[0])
    authors = F.coalesce(F.replace(F.col("authors"), F.lit(" ; "), F.lit("\n")), F.when(F.col("lead_researcher").isNotNull(), F.array_join(names, "·")))
    subtitle = F.when(F.col("subtitle").rlike("^[:\\-—–]"), F.col("subtitle")).otherwise(F.concat(F.lit(": "), "subtitle"))
    derived = {"title": title, "title_1": F.substring_index(title, "\n", 1), "title_2": F.when(F.contains(title, F.lit("\n")), F.replace(F.expr("substr(replace(title, ' // ', '\\n'), instr(replace(title, ' // ', '\\n'), '\\n') + 1)"), F.lit("\n"), F.lit(" "))), "authors": authors, "subtitle": subtitle, "pub_date": T.publication_month(F.col("pub_date"))}
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in derived.items())))
    out = wide.select("doc_id", pairs.alias("p")).select("doc_id", "p.*").where("value is not null")
    return out.unionByName(m.join(out.select("doc_id", "key"), ["doc_id", "key"], "left_anti"))
