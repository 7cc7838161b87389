"""Forms: slots, labels, filling and table geometry."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quiremill.functions import text as T
from quiremill.sources.shared import common_shares, dealt, joined

AT = ["doc_id", "table_index"]


def full_grid(cells: DataFrame) -> DataFrame:
    """SC32: a row for every covered position, with the anchor cell's text; spans are clipped to the table first."""
    t = W.partitionBy(*AT)
    c = dealt(cells, *AT).withColumns({"rows": F.max("row").over(t), "cols": F.max("col").over(t)})
    rows = F.sequence("row", F.least(F.col("row") + F.col("row_span") - 1, "rows"))
    cols = F.sequence("col", F.least(F.col("col") + F.col("col_span") - 1, "cols"))
    return c.withColumns({"row": F.explode(rows), "cols": cols}).withColumn("col", F.explode("cols")).select(*AT, "row", "col", "text")


def pipe_tables(cells: DataFrame, captions: DataFrame | None = None) -> DataFrame:
    """SC32: each table in Markdown, the first row as header, below its caption (doc_id, table_index, caption) if it has one."""
    rows = full_grid(cells).withColumn("text", T.pipe_cell(F.col("text"))).groupBy(*AT, "row").agg(F.sort_array(F.collect_list(F.struct("col", "text"))).alias("c"))
    line = F.concat(F.lit("| "), F.array_join(F.col("c.text"), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size("c")))
    first = F.row_number().over(W.partitionBy(*AT).orderBy("row")) == 1
    rows = rows.select(*AT, "row", F.when(first, F.concat(line, F.lit("\n"), rule)).otherwise(line).alias("line"))
    tables = rows.groupBy(*AT).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("markdown"))
    if captions is None:
        return tables
    above = F.concat_ws("\n\n", F.nullif(F.trim("caption"), F.lit("")), "markdown")
    return joined(tables, captions.select(*AT, "caption"), AT, "left").select(*AT, above.alias("markdown"))


def label_targets(cells: DataFrame) -> DataFrame:
    """JN2: for each label-shaped cell the blank cell to its right, else below; none below a banner row."""
    g = full_grid(cells)
    across, down, r = W.partitionBy(*AT, "row").orderBy("col"), W.partitionBy(*AT, "col").orderBy("row"), W.partitionBy(*AT, "row")
    banner = (F.count("*").over(r) >= 3) & (F.count("*").over(W.partitionBy(*AT, "row", "text")) >= F.count("*").over(r) - 1)
    right = F.when(F.lead("col").over(across) == F.col("col") + 1, F.lead("text").over(across))
    below = F.when(F.lead("row").over(down) == F.col("row") + 1, F.lead("text").over(down))
    g = g.withColumns({"banner": banner, "right": right, "below": below}).where(T.is_label_shaped(F.trim("text")))
    side = F.when(F.trim("right") == "", "right").when((F.trim("below") == "") & ~F.col("banner"), "below")
    return g.withColumn("side", side).where("side is not null").select(*AT, "row", "col", "text", "side")


def labelled_cell(cells: DataFrame, asked: DataFrame) -> DataFrame:
    """JN7: asked (doc_id, label, direction): the neighbour of the one cell with that label; null if there are none or several."""
    d = W.partitionBy("doc_id", "label")
    found = cells.withColumn("label", T.without_space(F.col("text"))).withColumn("n", F.count("*").over(d)).where("n = 1").select(*AT, "row", "col", "label")
    dr = F.when(F.col("direction") == "down", 1).when(F.col("direction") == "up", -1).otherwise(0)
    dc = F.when(F.col("direction") == "right", 1).when(F.col("direction") == "left", -1).otherwise(0)
    to = joined(asked.withColumn("label", T.without_space(F.col("label"))), found, ["doc_id", "label"], "left").withColumns({"row": F.col("row") + dr, "col": F.col("col") + dc})
    return joined(to, full_grid(cells), [*AT, "row", "col"], "left").select("doc_id", "label", "direction", "table_index", "row", "col", F.col("text").alias("value"))


def repeated_section(cells: DataFrame, columns: dict[str, str], items: DataFrame, n: int | None = None) -> DataFrame:
    """JN4: items (doc_id, i, field, value) go below the first row with two or more known column labels, while there are rows.

    columns: labels and the fields they stand for; labels are compared normalized. Of the cells, those with known labels are
    shuffled, and the last row of each table; the result lies in n tasks by document.
    """
    n = n or common_shares(cells, items)
    pairs = F.create_map(*(F.lit(x) for kv in columns.items() for x in kv))
    labelled = cells.where(F.length(F.trim("text")) > 0).select(*AT, "row", "col", F.try_element_at(pairs, T.normalize_label(F.col("text"))).alias("field"))
    ends = cells.groupBy(*AT).agg(F.max(F.col("row") + F.col("row_span") - 1).alias("last"))
    marks = dealt(labelled.where("field is not null").unionByName(ends, allowMissingColumns=True), "doc_id", n=n)
    # All windows lie within documents and share one order, so a task sorts its marks once and nothing is shuffled for them.
    table, o = W.partitionBy(*AT).orderBy("row"), W.partitionBy("doc_id").orderBy("table_index", "row")
    cols = F.collect_list(F.when(F.col("field").isNotNull(), F.struct("col", "field"))).over(W.partitionBy(*AT, "row"))
    marks = marks.withColumns({"last": F.max("last").over(table.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), "cols": cols})
    heads = marks.where("field is not null and size(cols) >= 2").withColumn("first", F.row_number().over(o)).where("first = 1").select(*AT, F.col("row").alias("head"), "last", "cols")
    placed = joined(items.where("value <> ''"), heads, ["doc_id"], n=n).withColumn("row", F.col("head") + 1 + F.col("i")).where("row <= last")
    col = F.explode(F.transform(F.filter("cols", lambda c: c["field"] == F.col("field")), lambda c: c["col"]))
    return placed.select(*AT, "row", col.alias("col"), "field", "value")


def _keys(kind: Column, name: Column, locator: Column) -> Column:
    """What a slot answers to, the surest first: its locator, kind and name, its name, its name without spaces."""
    prefix = F.when(kind == "inline", "tab").otherwise(kind)
    return F.array(locator, F.concat(prefix, F.lit(":"), name), name, T.without_space(name))


def located(mapping: DataFrame, cells: DataFrame) -> DataFrame:
    """JN6: mapping (doc_id, key, value) with keys like ``label > right`` turned into the cell's locator; those that no single label answers to stay."""
    way = F.regexp_extract("key", r"^(.*?) > (right|below|left|above)$", 2)
    m = mapping.withColumns({"label": F.when(way != "", F.regexp_extract("key", r"^(.*?) > (right|below|left|above)$", 1)), "direction": F.when(way == "below", "down").when(way == "above", "up").otherwise(way)})
    asked = m.where("label is not null")
    found = labelled_cell(cells, asked.select("doc_id", "label", "direction").distinct()).where("value is not null")
    found = found.select("doc_id", "label", "direction", F.concat_ws(":", F.lit("cell"), "table_index", "row", "col").alias("locator"))
    asked = joined(asked.withColumn("label", T.without_space(F.col("label"))), found, ["doc_id", "label", "direction"], "left").select("doc_id", F.coalesce("locator", "key").alias("key"), "value")
    return m.where("label is null").select("doc_id", "key", "value").unionByName(asked)


def fill(slots: DataFrame, mapping: DataFrame) -> DataFrame:
    """JN6: slots (doc_id, kind, locator, name, current) with what mapping (doc_id, key, value) gives them.

    A key is a locator (``cell:0:1:2``), a kind and a name (``checkbox:``, ``tab:``, ``label:``, ``section:``), or a name,
    with or without spaces; a checkbox becomes on or off. Keys with a direction go through ``located`` first.
    """
    m = mapping.groupBy("doc_id", "key").agg(F.min("value").alias("value"))
    asked = slots.select("doc_id", "kind", "locator", F.posexplode(_keys(F.col("kind"), F.col("name"), F.col("locator"))).alias("rank", "key"))
    got = joined(asked, m, ["doc_id", "key"]).groupBy("doc_id", "kind", "locator").agg(F.min_by(F.struct("value"), "rank").alias("got"))
    off = F.lower(F.trim("got.value")).isin("off", "0", "false", "no", "")
    value = F.when(F.col("kind") == "checkbox", F.when(off, "off").otherwise("on")).otherwise(F.col("got.value"))
    filled = F.col("got").isNotNull()
    return joined(slots, got, ["doc_id", "kind", "locator"], "left").select("doc_id", "kind", "locator", "name", F.when(filled, value).otherwise(F.col("current")).alias("value"), filled.alias("filled"))


def missing_keys(slots: DataFrame, mapping: DataFrame) -> DataFrame:
    """JN6: keys of mapping that no slot answers to."""
    keys = slots.select("doc_id", F.explode(_keys(F.col("kind"), F.col("name"), F.col("locator"))).alias("key")).distinct()
    return joined(mapping.select("doc_id", "key").distinct(), keys, ["doc_id", "key"], "left_anti")


def blank_slots(slots: DataFrame, filled: DataFrame) -> DataFrame:
    """ST3: slots that nothing filled."""
    return joined(slots, filled.where("filled"), ["doc_id", "kind", "locator"], "left_anti")


def column_content(cells: DataFrame) -> DataFrame:
    """AG9: text volume and longest word of each column; a merged cell's volume is shared by its columns."""
    words = F.array_max(F.transform(F.split(F.coalesce("text", F.lit("")), r"\s+"), F.length))
    c = cells.withColumns({"share": F.length("text") / F.col("col_span"), "word": words}).withColumn("col", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)))
    longest = F.coalesce(F.max(F.when(F.col("col_span") == 1, F.col("word"))), F.max("word"))
    return c.groupBy(*AT, "col").agg(F.sum("share").alias("volume"), longest.cast("long").alias("longest"))


def column_widths(content: DataFrame, total: int, char_w: int = 1100, floor: int = 1500) -> DataFrame:
    """AG10: widths that add up to total: least widths first, the rest by the root of the volume, what rounding leaves to the first widest column."""
    t = W.partitionBy(*AT)
    least = F.least(F.greatest(F.lit(floor), F.col("longest") * char_w), F.lit(total))
    c = content.withColumn("least", least).withColumn("s", F.sum("least").over(t))
    c = c.withColumn("least", F.when(F.col("s") > total, F.floor(F.col("least") * total / F.col("s"))).otherwise(F.col("least"))).withColumns({"rest": F.lit(total) - F.sum("least").over(t), "root": F.sqrt(F.greatest("volume", F.lit(0.0)))})
    roots = F.sum("root").over(t)
    c = c.withColumn("w", F.col("least") + F.when(roots > 0, F.floor(F.col("rest") * F.col("root") / roots)).otherwise(F.floor(F.col("rest") / F.count("*").over(t))))
    first = F.row_number().over(t.orderBy(F.desc("w"), "col")) == 1
    return c.withColumn("lost", F.lit(total) - F.sum("w").over(t)).select(*AT, "col", (F.col("w") + F.when(first, F.col("lost")).otherwise(0)).cast("long").alias("width"))


def box_height(cells: DataFrame, height: str = "height") -> DataFrame:
    """AG11: the sum over rows of the tallest cell."""
    return dealt(cells, *AT).groupBy(*AT, "row").agg(F.max(height).alias("h")).groupBy(*AT).agg(F.sum("h").alias("height"))


def section_slots(paragraphs: DataFrame) -> DataFrame:
    """WN15: ``label :`` lines followed by empty paragraphs (section slots) or not (label slots); none before a table; the first of each label."""
    o = W.partitionBy("doc_id", "section_no").orderBy("para_idx")
    p = dealt(paragraphs, "doc_id").withColumns({"label": T.label_line(F.col("text")), "next_empty": F.lead(F.col("text") == "").over(o), "next_table": F.lead("has_table").over(o)})
    s = p.where("label is not null and not coalesce(next_table, false)").withColumn("kind", F.when(F.col("next_empty"), "section").otherwise("label"))
    first = F.row_number().over(W.partitionBy("doc_id", "kind", "label").orderBy("section_no", "para_idx")) == 1
    return s.withColumn("first", first).where("first").select("doc_id", "kind", F.col("label").alias("name"), "section_no", "para_idx")


def placeholder_slots(paragraphs: DataFrame) -> DataFrame:
    """ST1 (part): placeholders of a document, each once."""
    return paragraphs.select("doc_id", F.explode(T.placeholders(F.col("text"))).alias("name")).distinct().select("doc_id", F.lit("placeholder").alias("kind"), "name", F.col("name").alias("locator"))


def all_slots(paragraphs: DataFrame, cells: DataFrame) -> DataFrame:
    """ST1: placeholders, cells next to labels, checkboxes, tails after tabs, and section or label lines in one table, each locator once, with what is there now."""
    none, start = F.lit(None).cast("string").alias("current"), F.lit(0).cast("long")
    row = F.when(F.col("side") == "below", F.col("row") + 1).otherwise(F.col("row"))
    col = F.when(F.col("side") == "right", F.col("col") + 1).otherwise(F.col("col"))
    at = [F.col("section_no").cast("long").alias("section_no"), F.col("para_idx").cast("long").alias("place")]
    # What a document has twice is the one that comes first in it: by section, paragraph and place in the text, or by table, row and column.
    by_cell = label_targets(cells).select("doc_id", F.lit("cell").alias("kind"), F.col("text").alias("name"), F.concat_ws(":", F.lit("cell"), "table_index", row, col).alias("locator"), F.lit("").alias("current"), F.col("table_index").cast("long").alias("section_no"), F.col("row").cast("long").alias("place"), F.col("col").cast("long").alias("i"))
    by_line = section_slots(paragraphs).select("doc_id", "kind", "name", F.concat_ws(":", "kind", "name").alias("locator"), none, *at, start.alias("i"))
    boxes = paragraphs.select("doc_id", *at, F.posexplode(T.checkboxes(F.col("text"))).alias("i", "c")).select("doc_id", F.lit("checkbox").alias("kind"), F.col("c.label").alias("name"), F.concat(F.lit("checkbox:"), F.col("c.label")).alias("locator"), F.col("c.state").alias("current"), "section_no", "place", F.col("i").cast("long").alias("i"))
    tails = paragraphs.select("doc_id", *at, T.tab_slots(F.col("text")).alias("t")).where("t is not null and t.label <> ''").select("doc_id", F.lit("inline").alias("kind"), F.col("t.label").alias("name"), F.concat(F.lit("tab:"), F.col("t.label")).alias("locator"), F.trim(F.array_join("t.tails", "")).alias("current"), "section_no", "place", start.alias("i"))
    every = placeholder_slots(paragraphs).select("doc_id", "kind", "name", "locator", none, start.alias("section_no"), start.alias("place"), start.alias("i"))
    for more in (by_cell, by_line, boxes, tails):
        every = every.unionByName(more)
    first = F.min_by(F.struct("name", "current"), F.struct("section_no", "place", "i"))
    return dealt(every, "doc_id", "kind", "locator").groupBy("doc_id", "kind", "locator").agg(first.alias("s")).select("doc_id", "kind", "locator", "s.name", "s.current")


def fill_summary(filled: DataFrame) -> DataFrame:
    """AG16: numbers of filled and blank slots of each document."""
    return filled.groupBy("doc_id").agg(F.count(F.when(F.col("filled"), 1)).alias("n_filled"), F.count(F.when(~F.col("filled"), 1)).alias("n_blank"))


#: Normalized labels and the profile fields they stand for.
ALIASES = {
    "성명": "name", "성명서명": "name", "이름": "name", "신청자": "name", "작성자": "name", "예금주": "name",
    "생년월일": "birthdate", "생일": "birthdate", "성별": "gender", "전문분야": "field", "전공분야": "field",
    "휴대폰": "mobile", "휴대전화": "mobile", "핸드폰": "mobile", "연락처": "mobile",
    "email": "work.email", "이메일": "work.email", "전자우편": "work.email", "메일": "work.email",
    "자택주소": "home.address", "자택전화번호": "home.phone", "직장명": "work.name", "소속": "work.name",
    "직위직급": "work.title", "직위": "work.title", "직급": "work.title", "직장주소": "work.address",
    "직장전화번호": "work.phone", "팩스": "work.fax", "계좌번호": "account.number", "금융기관명": "account.bank", "은행": "account.bank",
}


def _by_person(pairs: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """(person_id, <key>s, <value>s): the rows of a person in two arrays, a row at the same place in both."""
    rows = F.sort_array(F.collect_list(F.struct(key, value)))
    return dealt(pairs, "person_id", n=n).groupBy("person_id").agg(rows.alias("r")).select("person_id", F.col(f"r.{key}").alias(f"{key}s"), F.col(f"r.{value}").alias(f"{value}s"))


def _beside(keys: str, values: str, key: Column) -> Column:
    """A row for each of the values beside a key, one with null if there are none."""
    return F.explode_outer(F.transform(F.filter(F.arrays_zip(F.col(keys), F.col(values)), lambda x: x[keys] == key), lambda x: x[values]))


def matched_slots(slots: DataFrame, people: DataFrame, assigned: DataFrame, own: DataFrame | None = None, labels: bool = False, n: int | None = None) -> DataFrame:
    """JN3: the profile value for each slot (doc_id, locator, name) of the person assigned to the document; own aliases (person_id, label, field) come first, then the common ones, then ``extra.<label>``.

    A profile comes to its documents as one row, so slots are shuffled once, by document; the result lies in n tasks by document.
    With labels, the slots' labels are returned too.
    """
    n = n or common_shares(slots, people, assigned)
    pairs = F.array(*(F.struct(F.lit(k).alias("label"), F.lit(v).alias("common")) for k, v in ALIASES.items()))
    common = slots.sparkSession.range(1).select(F.explode(pairs).alias("a")).select("a.*")
    told = joined(assigned, _by_person(people, "field", "value", n), ["person_id"], "left", n=n)
    if own is not None:
        told = joined(told, _by_person(own.withColumnRenamed("field", "own"), "label", "own", n), ["person_id"], "left", n=n)
    s = joined(slots.select("doc_id", "locator", T.normalize_label(F.col("name")).alias("label")), told, ["doc_id"], n=n)
    s = s.withColumn("own", _beside("labels", "owns", F.col("label")) if own is not None else F.lit(None).cast("string")).join(F.broadcast(common), "label", "left")
    s = s.withColumn("field", F.coalesce("own", "common", F.concat(F.lit("extra."), "label")))
    return s.withColumn("value", _beside("fields", "values", F.col("field"))).select("doc_id", "locator", *(["label"] if labels else []), "field", "value")


#: Labels that today's date answers to.
DATE_LABELS = ("날짜", "작성일", "작성일자", "신청일", "신청일자", "작성년월일")


def build_mapping(matched: DataFrame, repeated: DataFrame, slots: DataFrame, today: str, columns: Iterable[str] = (), n: int | None = None) -> DataFrame:
    """JN5: what to fill: cells of repeated sections own their targets and column labels, then matched values, then today for date labels without one; the rest is blank.

    Matched values may bring the labels of their slots. All is dealt to n tasks by document; what lies so already, as by the same n above, isn't shuffled again.
    """
    n = n or common_shares(matched, repeated, slots)
    cell = F.concat_ws(":", F.lit("cell"), "table_index", "row", "col")
    r = repeated.select("doc_id", cell.alias("locator"), "value", F.lit("repeated").alias("source"))
    taken = dealt(r.select("doc_id", "locator"), "doc_id", n=n).groupBy("doc_id").agg(F.collect_set("locator").alias("taken"))
    if "label" not in matched.columns:
        matched = joined(matched, slots.select("doc_id", "locator", T.normalize_label(F.col("name")).alias("label")), ["doc_id", "locator"], "left", n=n)
    m = joined(matched.select("doc_id", "locator", "label", "value"), taken, ["doc_id"], "left", n=n)
    m = m.where(~F.coalesce(F.array_contains("taken", F.col("locator")) | F.col("label").isin(*columns), F.lit(False)))
    own = F.nullif("value", F.lit("@today"))
    dated = own.isNull() & (F.coalesce(F.col("label").isin(*DATE_LABELS), F.lit(False)) | (F.col("value") == "@today"))
    value = F.when(dated, F.lit(today)).otherwise(own)
    return r.unionByName(m.select("doc_id", "locator", value.alias("value"), F.when(dated, "today").when(own.isNotNull(), "matched").otherwise("blank").alias("source")))


def row_heights(cells: DataFrame) -> DataFrame:
    """AG12: the height of every row: cells of one row fix theirs; a merge with one open row fixes that, the narrower first, as long as one can; merges that still have open rows share their rest among them evenly.

    Only tables with merges over several rows are solved, each by folds over the array of its merges, with the heights so far as
    the state; every round of folds closes a row, so there are as many rounds as open rows. The others are an aggregation.
    """
    c = cells.select(*AT, "row", "col", "row_span", F.coalesce("height", F.lit(0)).cast("long").alias("height"))
    known = c.where("row_span = 1").groupBy(*AT, "row").agg(F.max("height").alias("height"))
    merges = c.groupBy(*AT).agg(F.max(F.col("row") + F.col("row_span")).cast("int").alias("rows"), F.sort_array(F.collect_list(F.when(F.col("row_span") > 1, F.struct(F.col("row_span").cast("int").alias("span"), F.col("row").cast("int").alias("row"), F.col("col").alias("col"), "height")))).alias("merges"))
    rows = merges.select(*AT, F.posexplode(F.sequence(F.lit(1), "rows")).alias("row", "one")).drop("one").join(known, [*AT, "row"], "left")
    state = rows.groupBy(*AT).agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "height"))), lambda r: r["height"]).alias("heights"))
    t = state.join(merges.where(F.size("merges") > 0).select(*AT, "merges"), AT, "left")

    def parts(heights: Column, merge: Column) -> tuple[Column, Column]:
        """Open rows of a merge, and what its height leaves for them."""
        own = F.sequence(merge["row"], merge["row"] + merge["span"] - 1)
        fixed = F.aggregate(F.slice(heights, merge["row"] + 1, merge["span"]), F.lit(0).cast("long"), lambda s, h: s + F.coalesce(h, F.lit(0)))
        return F.filter(own, lambda r: F.get(heights, r).isNull()), F.greatest(merge["height"] - fixed, F.lit(0).cast("long"))

    def close(heights: Column, merge: Column) -> Column:
        free, rest = parts(heights, merge)
        return F.when(F.size(free) == 1, F.transform(heights, lambda h, i: F.when(i == free[0], rest).otherwise(h))).otherwise(heights)

    def share(heights: Column, merge: Column) -> Column:
        free, rest = parts(heights, merge)
        even = F.try_divide(rest - F.pmod(rest, F.greatest(F.size(free), F.lit(1)).cast("long")), F.size(free)).cast("long")
        return F.transform(heights, lambda h, i: F.when(F.array_contains(free, i), even).otherwise(h))

    open_rows = F.size(F.filter("heights", lambda h: h.isNull()))
    rounds = F.when(open_rows > 0, F.sequence(F.lit(1), open_rows)).otherwise(F.array().cast("array<int>"))
    closed = F.aggregate(rounds, F.col("heights"), lambda s, _: F.aggregate(F.col("merges"), s, close))
    t = t.withColumn("heights", F.when(F.col("merges").isNotNull(), closed).otherwise(F.col("heights")))
    t = t.withColumn("heights", F.when(F.col("merges").isNotNull(), F.aggregate("merges", F.col("heights"), share)).otherwise(F.col("heights")))
    return t.select(*AT, F.posexplode("heights").alias("row", "height")).select(*AT, F.col("row").cast("long").alias("row"), F.coalesce("height", F.lit(0)).cast("long").alias("height"))
