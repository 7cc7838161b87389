"""Line and page layout: tails, page breaks, page filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quiremill.functions import text as T


def fit_candidates(paragraphs: DataFrame, heading_styles: DataFrame, notes: bool = False) -> DataFrame:
    """PF7: text paragraphs outside cells (and notes) with plain runs and no heading style."""
    p = paragraphs.where("not in_cell and plain_runs and kind = 'text' and text <> ''")
    p = p if notes else p.where("not in_note")
    return p.join(heading_styles.where("is_heading"), ["doc_id", "style_id"], "left_anti")


def widow_tails(linesegs: DataFrame, paragraphs: DataFrame, most: int = 4) -> DataFrame:
    """SC29: paragraphs of two lines or more whose last line has 1 to ``most`` characters, with the fit that would take it up."""
    last = linesegs.groupBy("doc_id", "section_no", "para_idx").agg(F.count("*").alias("n_lines"), F.max("textpos").alias("last_pos"))
    p = paragraphs.where("line_breaks = 0").select("doc_id", "section_no", "para_idx", F.length("text").alias("total"))
    t = p.join(last, ["doc_id", "section_no", "para_idx"]).withColumn("tail", F.col("total") - F.col("last_pos")).where((F.col("n_lines") >= 2) & F.col("tail").between(1, most))
    return t.withColumn("fit", T.tail_fit(F.col("total"), F.col("tail"), F.lit(0), F.lit(100))).select("doc_id", "section_no", "para_idx", F.col("tail").cast("long").alias("tail"), "fit.spacing", "fit.ratio", "fit.fittable")


def pages(linesegs: DataFrame) -> DataFrame:
    """WN12: the page of every line: a new one where the vertical position drops or a first line is forced over; sections begin anew."""
    o = W.partitionBy("doc_id", "section_no").orderBy("para_idx", "line_no")
    cut = (F.col("vertpos") < F.lag("vertpos").over(o)) | ((F.col("line_no") == 0) & F.col("forced_break") & F.lag("vertpos").over(o).isNotNull())
    l = linesegs.withColumn("cut", F.coalesce(cut, F.lit(False)).cast("int"))
    return l.withColumn("page", F.sum("cut").over(o).cast("long")).drop("cut")


def page_boxes(linesegs: DataFrame) -> DataFrame:
    """WN12: bottom, lines and first paragraph of each page."""
    return pages(linesegs).groupBy("doc_id", "section_no", "page").agg(F.max(F.col("vertpos") + F.col("vertsize")).alias("bottom"), F.count("*").alias("n_lines"), F.min("para_idx").alias("first_para"))


def page_gaps(boxes: DataFrame, height: int, small: float = 10.0) -> DataFrame:
    """WN13 (first part): empty share at the foot of each page but the last, and whether a pull or a gap is to be judged."""
    o = W.partitionBy("doc_id", "section_no").orderBy("page")
    gap = F.round((F.lit(height) - F.col("bottom")) * 100.0 / height, 2)
    b = boxes.withColumns({"gap_pct": gap, "next_lines": F.lead("n_lines").over(o)}).where("next_lines is not null")
    return b.select("doc_id", "section_no", "page", "gap_pct", F.when(F.col("gap_pct") <= small, "full").when(F.col("next_lines") <= 3, "pull").otherwise("gap").alias("kind"))


def ladder(max_spacing_cut: int = 50, max_line_cut: int = 10) -> list[tuple[int, int]]:
    """WN13: (paragraph spacing cut, line spacing cut) in percent: spacing first in steps of 10, then lines in steps of 2."""
    spacing = [*range(10, max_spacing_cut, 10), max_spacing_cut]
    return [(s, 0) for s in spacing] + [(max_spacing_cut, c) for c in [*range(2, max_line_cut, 2), max_line_cut]]


_BLOCK = ("para_idx", "n", "first", "last", "tall", "last_spacing", "last_tall", "notes", "kind", "heading", "sb", "sa", "percent")


def page_blocks(lines: DataFrame, paras: DataFrame) -> DataFrame:
    """WN13: one row for each page of a section: bottom, forced and ``blocks``, what each paragraph has on the page, in order.

    lines: doc_id, section_no, para_idx, line_no, vertpos, vertsize, spacing, forced_break, note_height (of the notes called in the line, 0 if none).
    paras: doc_id, section_no, para_idx, kind (text, empty, object), heading, sb and sa (space before and after), percent (line spacing can be cut).
    """
    para = ["doc_id", "section_no", "para_idx"]
    l = pages(lines).withColumns({"tall": F.col("vertsize") + F.col("spacing"), "bottom": F.col("vertpos") + F.col("vertsize")})  # noqa: E741
    ends = W.partitionBy(*para)
    l = l.withColumns({"from_line": F.min("line_no").over(ends), "to_line": F.max("line_no").over(ends)})  # noqa: E741
    own = F.sort_array(F.collect_list(F.struct("line_no", "tall", "spacing")))
    b = l.groupBy(*para, "page").agg(
        F.count("*").alias("n"),
        F.bool_or(F.col("line_no") == F.col("from_line")).alias("first"),
        F.bool_or(F.col("line_no") == F.col("to_line")).alias("last"),
        F.sum("tall").alias("tall"),
        F.max_by("spacing", "line_no").alias("last_spacing"),
        F.max_by("tall", "line_no").alias("last_tall"),
        F.filter(F.collect_list("note_height"), lambda x: x > 0).alias("notes"),
        F.slice(own, 1, 2).alias("two"),
        F.max("bottom").alias("bottom"),
        F.min_by(F.col("forced_break") & (F.col("line_no") == F.col("from_line")), "line_no").alias("forced"),
    ).join(paras.select(*para, "kind", "heading", "sb", "sa", "percent"), para)
    block = F.struct(*_BLOCK, "two")
    return b.groupBy("doc_id", "section_no", "page").agg(F.max("bottom").alias("bottom"), F.min_by("forced", "para_idx").alias("forced"), F.sort_array(F.collect_list(block)).alias("blocks"))


def _leading_chunk(blocks: Column) -> Column:
    """The blocks at the head of a page that would move back together, or null: see ``page_plan``."""
    head = F.get(blocks, F.array_position(F.transform(blocks, lambda b: b["kind"] != "empty"), True).cast("int") - 1)
    at = F.array_position(F.transform(blocks, lambda b: b["kind"] != "empty"), True).cast("int")
    after = F.get(blocks, at)
    upto = F.slice(blocks, 1, F.greatest(at, F.lit(1)))

    def of(b: Column) -> Column:
        return F.struct(*(b[c].alias(c) for c in _BLOCK))

    two = F.aggregate(after["two"], F.lit(0).cast("long"), lambda s, x: s + x["tall"])
    lead = {"n": F.lit(2).cast("long"), "last": F.lit(False), "tall": two, "last_spacing": F.element_at(after["two"], -1)["spacing"], "last_tall": F.element_at(after["two"], -1)["tall"]}
    part = F.struct(*(lead.get(c, after[c]).alias(c) for c in _BLOCK))
    with_next = F.when(after.isNull() | ~after["first"], None).when((after["kind"] == "text") & (after["n"] >= 4), F.concat(F.transform(upto, of), F.array(part))).when(after["last"], F.transform(F.slice(blocks, 1, at + 1), of))
    whole = F.when((at == 0) | ~head["last"], None).when(~head["heading"], F.transform(upto, of)).otherwise(with_next)
    return F.when(blocks[0]["first"], whole).when(blocks[0]["last"], F.transform(F.slice(blocks, 1, 1), of))


def page_plan(lines: DataFrame, paras: DataFrame, height: int, steps: list[tuple[int, int]], threshold: float = 10.0, max_lines: int = 3, margin: int = 100, note_gap: int = 0) -> DataFrame:
    """WN13: what would fill each page: one row for each boundary inside a section that is worth a change; lines and paras as for ``page_blocks``.

    The chunk that would come back is the rest of a paragraph that ends on the next page, else its first block with the blank
    paragraphs before it; a heading takes the block after it along, of a text of four lines or more its first two. kind is forced (a
    forced break follows a gap), gap (a share of the page beyond the threshold is empty) or pull (a chunk of few lines and no
    object could come back). needed is what the page lacks for the chunk, its spaces and notes. The first step whose gain, in
    paragraph spacing and line spacing of page and chunk, covers the need and the margin is taken; without one the boundary is unfittable.
    """
    o = W.partitionBy("doc_id", "section_no").orderBy("page")
    p = page_blocks(lines, paras)
    p = p.withColumns({"next": F.lead("blocks").over(o), "next_forced": F.lead("forced").over(o)}).where("next is not null").withColumn("chunk", _leading_chunk(F.col("next")))

    def total(blocks: Column, of) -> Column:  # noqa: ANN001
        return F.aggregate(blocks, F.lit(0).cast("long"), lambda s, b: s + F.coalesce(of(b), F.lit(0)).cast("long"))

    heights = F.filter(F.flatten(F.transform("blocks", lambda b: b["notes"])), lambda x: x > 0)
    own_notes = F.when(F.size(heights) > 0, F.lit(note_gap) + F.aggregate(heights, F.lit(0).cast("long"), lambda s, x: s + x)).otherwise(0)
    p = p.withColumn("own_notes", own_notes).withColumn("gap", F.lit(height) - F.col("own_notes") - F.col("bottom"))
    p = p.withColumn("share", F.col("gap") * 100.0 / height)
    chunk, tail, end = F.col("chunk"), F.element_at("blocks", -1), F.element_at("chunk", -1)
    n = total(chunk, lambda b: F.when(b["kind"] != "empty", b["n"]))
    small = (n <= max_lines) & ~F.exists(chunk, lambda b: b["kind"] == "object")
    wide = F.col("share") >= threshold
    kind = F.when(F.col("next_forced"), F.when(wide, "forced")).when(wide, "gap").when(chunk.isNotNull() & small, "pull")
    p = p.withColumn("boundary", kind).where("boundary is not null")
    inner = F.slice(chunk, 1, F.greatest(F.size(chunk) - 1, F.lit(0)))
    add = tail["last_spacing"] + F.when(tail["last"], tail["sa"]).otherwise(0) + total(chunk, lambda b: F.when(b["first"], b["sb"]).otherwise(0) + b["tall"]) + total(inner, lambda b: F.when(b["last"], b["sa"])) - end["last_spacing"]
    more = F.flatten(F.transform(chunk, lambda b: b["notes"]))
    notes = F.when(F.size(more) > 0, F.when(F.col("own_notes") > 0, F.col("own_notes")).otherwise(note_gap) + F.aggregate(more, F.lit(0).cast("long"), lambda s, x: s + x)).otherwise(F.col("own_notes"))
    moves = chunk.isNotNull() & (F.col("boundary") != "forced")
    p = p.withColumn("needed", F.when(moves, F.col("bottom") + add + notes - height).otherwise(0))
    begun = F.filter("blocks", lambda b: b["first"])
    spaces = total(begun, lambda b: b["sb"] + F.when(b["last"], b["sa"]).otherwise(0)) + total(chunk, lambda b: F.when(b["first"], b["sb"])) + total(inner, lambda b: F.when(b["last"], b["sa"]))
    soft = lambda b: b["percent"] & (b["kind"] != "object")
    tall = total(begun, lambda b: F.when(soft(b), b["tall"])) + total(chunk, lambda b: F.when(soft(b), b["tall"])) - F.when(soft(end), end["last_tall"]).otherwise(0)
    p = p.withColumns({"spaces": spaces, "tall": tall, "n": F.when(moves, n).otherwise(0)})
    room = F.array(*(F.struct(F.lit(s).alias("spacing_cut"), F.lit(c).alias("line_cut")) for s, c in steps))
    fit = F.filter(room, lambda x: F.floor((F.col("spaces") * x["spacing_cut"] + F.col("tall") * x["line_cut"]) / 100) >= F.greatest("needed", F.lit(0)) + margin)
    step = F.when(moves, F.get(fit, F.lit(0)))
    status = F.when(F.col("boundary") == "forced", "forced").when(step.isNull(), "unfittable").otherwise("fittable")
    return p.select("doc_id", "section_no", "page", (F.rint(F.col("gap") * 10000.0 / height) / 100).alias("gap_pct"), F.col("boundary").alias("kind"), F.col("n").cast("long").alias("chunk_lines"), F.col("needed").cast("long").alias("needed"), status.alias("status"), *(step[c].cast("long").alias(c) for c in ("spacing_cut", "line_cut")))


def coverage(judged: DataFrame) -> DataFrame:
    """AG17: how many were judged by each engine, and whether one engine judged only a part."""
    n = judged.groupBy("doc_id", "engine").agg(F.count("*").alias("n"))
    return n.withColumn("partial", F.count("*").over(W.partitionBy("doc_id")) > 1)


def depth_ladder(paragraphs: DataFrame) -> DataFrame:
    """WN14: rank of each left indent in its section, 1 outermost."""
    d = paragraphs.select("doc_id", "section_no", "indent").distinct()
    return d.withColumn("depth", F.dense_rank().over(W.partitionBy("doc_id", "section_no").orderBy("indent")).cast("long"))


def row_growth(cells: DataFrame) -> DataFrame:
    """SC27: a row's height times the lines of its tallest cell; cells need em (width in em) and height."""
    lines = T.wrapped_lines(F.col("text"), F.col("em"))
    return cells.withColumn("lines", lines).groupBy("doc_id", "table_index", "row").agg((F.max("height") * F.max("lines")).alias("height"))
