"""Document tables derived from the generic tables, with the same rules in SQL (``SQL[name]`` is a common table expression)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quiremill.sources.shared import dealt

#: pos, style_id, name, eng_name, heading_type, outline_level, size_pt, glyph
STYLES = [
    (0, "0", "바탕글", "Normal", "NONE", None, 10.0, None),
    (1, "1", "개요 1", "Outline 1", "OUTLINE", 0, 16.0, None),
    (2, "2", "개요 2", "Outline 2", "OUTLINE", 1, 14.0, None),
    (3, "3", "1.", "", "NONE", None, 13.0, None),
    (4, "4", "글머리표", "Bullet", "BULLET", 0, 10.0, "●"),
    (5, "5", "AI:H3", "", "NONE", None, 12.0, None),
    (6, "6", "Ⅰ.", "", "NONE", None, 20.0, None),
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.col("text"), "\n")).alias("i", "text"))
    n = F.length("text")
    return lines.select(
        "doc_id",
        (F.col("i") % 2).cast("long").alias("section_no"),
        F.col("i").cast("long").alias("para_idx"),
        "text",
        (n % 7).cast("string").alias("style_id"),
        (n % 11 == 0).alias("in_cell"),
        (n % 13 == 0).alias("in_note"),
        (n % 3).cast("long").alias("line_breaks"),
        (n % 4).cast("long").alias("line_segs"),
        (n % 5 != 0).alias("plain_runs"),
        F.when(F.col("text") == "", "empty").when(n % 7 == 6, "object").otherwise("text").alias("kind"),
        (n % 17 == 0).alias("forced_break"),
        (n % 7 == 6).alias("has_table"),
    )


def styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["pos", "style_id", "name", "eng_name", "heading_type", "outline_level", "size_pt", "glyph"]
    kinds = ["long", "string", "string", "string", "string", "long", "double", "string"]
    rows = F.array(*(F.struct(*(F.lit(v).cast(k).alias(n) for n, k, v in zip(names, kinds, row, strict=True))) for row in STYLES))
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(rows).alias("s")).select("doc_id", "s.*")
    name = F.when((F.col("pos") == 5) & (F.col("doc_id") % 3 == 0), "AI:BODY").otherwise(F.col("name"))
    size = F.when((F.col("pos") == 2) & (F.col("doc_id") % 5 == 0), 18.0).otherwise(F.col("size_pt"))
    kind = F.when((F.col("doc_id") % 4 == 1) & (F.col("heading_type") == "OUTLINE"), "NONE").otherwise(F.col("heading_type"))
    level = F.when(kind == "NONE", None).otherwise(F.col("outline_level"))
    return d.select("doc_id", "pos", "style_id", name.alias("name"), "eng_name", kind.alias("heading_type"), level.alias("outline_level"), size.alias("size_pt"), "glyph")


def _numbered(spark: SparkSession, sf_dir: str, n: int | None = None) -> DataFrame:
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return dealt(read(spark, sf_dir, "lineitem"), "l_orderkey", n=n).select("l_orderkey", "l_linenumber", "l_partkey", F.floor("l_quantity").cast("long").alias("qty"), F.row_number().over(order).cast("long").alias("pos"))


def header_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _numbered(spark, sf_dir)
    odd = ((F.col("l_orderkey") + F.col("pos")) % 13 == 0).cast("long")
    cnt = F.count("*").over(W.partitionBy("l_orderkey")) + (F.col("l_orderkey") % 7 == 0).cast("long")
    return d.select(F.col("l_orderkey").alias("doc_id"), F.lit("charPr").alias("item"), "pos", (F.col("pos") - 1 + odd).alias("id"), cnt.alias("item_cnt"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _numbered(spark, sf_dir)
    used = F.when(F.col("l_partkey") % 9 == 0, F.lit(4294967295)).otherwise(F.col("l_partkey") % 8)
    return d.select(F.col("l_orderkey").alias("doc_id"), F.lit("section0").alias("part_name"), F.lit("charPr").alias("item"), used.alias("ref_id"))


def cells(spark: SparkSession, sf_dir: str, n: int | None = None) -> DataFrame:
    """One table for each order: three rows of label and value, a header row, a row for each line item; (0,1) may span two rows."""
    k = F.col("o_orderkey")

    def cell(row, col, text, span=1):  # noqa: ANN001, ANN202
        return F.struct(F.lit(row).cast("long").alias("row"), F.lit(col).cast("long").alias("col"), (span if not isinstance(span, int) else F.lit(span)).cast("long").alias("row_span"), text.alias("text"))

    top = F.array(
        cell(0, 0, F.lit("상태")),
        cell(0, 1, F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderstatus")), F.when(k % 4 == 0, 2).otherwise(1)),
        cell(1, 0, F.lit("우선순위")),
        cell(1, 1, F.col("o_orderpriority")),
        cell(2, 0, F.lit("금액")),
        cell(2, 1, F.when(k % 3 == 0, "").otherwise(F.col("o_custkey").cast("string"))),
        cell(3, 0, F.lit("번호")),
        cell(3, 1, F.lit("수량")),
    )
    head = read(spark, sf_dir, "orders").select(k.alias("doc_id"), F.explode(top).alias("c")).select("doc_id", "c.*").where("not (row = 1 and col = 1 and doc_id % 4 = 0)")
    body = F.array(*(F.struct((F.col("pos") + 3).alias("row"), F.lit(c).cast("long").alias("col"), F.lit(1).cast("long").alias("row_span"), F.col(x).cast("string").alias("text")) for c, x in ((0, "l_linenumber"), (1, "qty"))))
    lines = _numbered(spark, sf_dir, n).select(F.col("l_orderkey").alias("doc_id"), F.explode(body).alias("c")).select("doc_id", "c.*")
    return head.unionByName(lines).select("doc_id", F.lit(0).cast("long").alias("table_index"), "row", "col", "row_span", F.lit(1).cast("long").alias("col_span"), "text")


def form_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents turned into template text: placeholders, label lines, empty and plain paragraphs by turns."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.col("text"), "\n")).alias("i", "t"))
    n, m = F.length("t"), F.col("i") % 5
    token = F.concat(F.lit("{{ t"), (n % 7).cast("string"), F.lit(" }}"))
    text = F.when(m == 0, F.concat(token, F.lit(" and "), token)).when(m == 1, F.concat(F.lit("□ label"), (n % 4).cast("string"), F.lit(" : "))).when((m == 2) & (n % 2 == 0), "").when((m == 3) & (n % 3 == 0), F.concat(F.lit("☑ agree"), (n % 5).cast("string"), F.lit(" here"))).otherwise(F.concat(F.lit("x\t"), F.substring("t", 1, 9)))
    return lines.select("doc_id", F.lit(0).cast("long").alias("section_no"), F.col("i").cast("long").alias("para_idx"), text.alias("text"), (n % 6 == 0).alias("has_table"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles in long form: (person_id, field, value)."""
    c = read(spark, sf_dir, "customer")
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), v.cast("string").alias("value")) for f, v in (("name", F.col("c_name")), ("work.name", F.col("c_mktsegment")), ("account.number", F.col("c_nationkey")))))
    return c.select(F.col("c_custkey").alias("person_id"), F.explode(pairs).alias("p")).select("person_id", "p.*")


def md_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.col("text"), "\n")).alias("ord", "text"))
    n, m = F.length("text"), F.col("ord") % 6
    kind = F.when(m == 0, "heading").when(m == 3, "table").when(m == 4, "figure").when(m == 5, "bullet").otherwise("paragraph")
    level = F.when(m == 0, 1 + n % 3).when(m == 5, n % 4)
    label = F.when(m.isin(3, 4), F.concat(F.lit("t"), (n % 5).cast("string")))
    title = F.when(m == 0, F.concat((1 + F.col("ord") % 9).cast("string"), F.lit(". "), F.col("text"))).when(m == 1, F.concat(F.col("text"), F.lit(" {ref:t"), (n % 7).cast("string"), F.lit("}"))).otherwise(F.col("text"))
    return lines.select("doc_id", F.col("ord").cast("long").alias("ord"), kind.alias("kind"), level.cast("long").alias("level"), title.alias("text"), (n % 2).cast("long").alias("blank_before"), label.alias("label"), ((m == 3) & (n % 4 == 0)).alias("plain_cell"))


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "conversations")
    hashes = F.array_sort(F.array_distinct(F.array(F.col("role"), F.concat(F.lit("h"), (F.length("text") % 5).cast("string")))))
    return d.groupBy(F.col("conv_id").alias("doc_id"), F.col("turn").cast("long").alias("page")).agg(F.min(hashes).alias("hashes"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each labelled document; some aren't judged."""

    def issue(kind: str, detail: str):  # noqa: ANN202
        return F.struct(F.lit(kind).alias("type"), F.lit(detail).alias("detail"))

    issues = F.array_compact(F.array(F.when(F.col("quality") == 0, issue("layout_broken", "q")), F.when(F.col("toxic") == 1, issue("object_overlap", "t"))))
    ok = F.when(F.col("doc_id") % 7 != 3, (F.col("quality") == 1) & (F.col("toxic") == 0))
    return read(spark, sf_dir, "labels").select((F.col("doc_id") % 97).alias("doc_id"), F.col("doc_id").alias("page"), ok.alias("ok"), issues.alias("issues"))


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "events")
    return d.select(F.concat_ws("-", "event_type", (F.col("user_id") % 50).cast("string")).alias("name"), F.col("event_id").alias("file_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("modified_time"), (F.floor("value").cast("long") % 5).alias("declarations"), (F.col("event_id") % 10 < 7).alias("confirmed"))


def packages(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    """Each document as a package: a paragraph for each line, a table of its id and source, a header with a list of styles, and metadata."""
    documents = read(spark, sf_dir, "documents") if documents is None else documents
    return packed(documents.select("doc_id", "text", "source"), lambda d, t, s: _package(int(d), t or "", s))


#: Packages, and bytes of them, that a task holds at a time.
_HELD, _HELD_BYTES = 128, 1 << 21


def packed(documents: DataFrame, made: Callable[..., bytes]) -> DataFrame:
    """(doc_id, content): the package that ``made`` builds of each row, the doc_id first; a few are held at a time, however many a task has."""
    schema = pa.schema([("doc_id", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, contents, size = [], [], 0
            for row in zip(*b.columns, strict=True):
                values = [v.as_py() for v in row]
                ids.append(str(values[0]))
                contents.append(made(*values))
                size += len(contents[-1])
                if len(ids) >= _HELD or size >= _HELD_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(contents, pa.binary())], schema=schema)
                    ids, contents, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(contents, pa.binary())], schema=schema)

    return documents.mapInArrow(run, "doc_id string, content binary")


def _package(doc: int, text: str, source: str | None) -> bytes:
    def cell(col: int, value: str) -> str:
        return f'<p:tc><p:subList><p:p><p:run><p:t>{escape(value)}</p:t></p:run></p:p></p:subList><p:cellAddr rowAddr="0" colAddr="{col}"/><p:cellSpan rowSpan="1" colSpan="1"/></p:tc>'

    lines = "".join(f'<p:p styleIDRef="{len(line) % 7}" paraPrIDRef="0"><p:run><p:t>{escape(line)}</p:t></p:run></p:p>' for line in text.split("\n"))
    table = f'<p:p styleIDRef="0" paraPrIDRef="1"><p:run><p:tbl><p:tr>{cell(0, str(doc))}{cell(1, source or "")}</p:tr></p:tbl></p:run></p:p>'
    parts = {
        "Contents/section0.xml": f'<s:sec xmlns:s="u" xmlns:p="v">{lines}{table}</s:sec>',
        "Contents/header.xml": f'<hh:head xmlns:hh="h"><hh:styles itemCnt="{2 + doc % 2}"><hh:style id="0" name="a"/><hh:style id="{1 + doc % 3}" name="b"/></hh:styles></hh:head>',
        "Contents/content.hpf": f'<opf:package xmlns:opf="o"><opf:metadata><opf:title>T{doc}</opf:title><opf:meta name="creator" content="text">{escape(source or "")}</opf:meta></opf:metadata></opf:package>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in parts.items():
            z.writestr(zipfile.ZipInfo(name), content)  # the same bytes each time
    return out.getvalue()


def pictured(text: str) -> bytes:
    """A package with a paragraph for each line, and a described picture in every line of a length that 3 divides."""
    out = []
    for i, line in enumerate(text.split("\n")):
        n = len(line)
        pic = f'<p:pic><p:sz width="{n}" height="{i}"/><p:img binaryItemIDRef="image{n % 4}"/><p:shapeComment>그림입니다. 원본 그림의 이름: f{i}.png\n원본 그림의 크기: 가로 {n + 1}pixel, 세로 {i + 2}pixel</p:shapeComment></p:pic>' if n and n % 3 == 0 else ""
        out.append(f"<p:p><p:run>{pic}<p:t>{escape(line)}</p:t></p:run></p:p>")
    package = io.BytesIO()
    with zipfile.ZipFile(package, "w") as z:
        z.writestr(zipfile.ZipInfo("Contents/section0.xml"), f'<s:sec xmlns:s="u" xmlns:p="v">{"".join(out)}</s:sec>')
    return package.getvalue()


_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in STYLES)
_NUMBERED = "(SELECT l_orderkey, l_linenumber, l_partkey, floor(l_quantity)::BIGINT AS qty, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos FROM lineitem)"
_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)"

SQL = {
    "form_lines": f"""form_lines AS (SELECT doc_id, 0::BIGINT AS section_no, i::BIGINT AS para_idx, CASE WHEN m = 0 THEN '{{{{ t' || (n % 7) || ' }}}} and {{{{ t' || (n % 7) || ' }}}}' WHEN m = 1 THEN '□ label' || (n % 4) || ' : '
  WHEN m = 2 AND n % 2 = 0 THEN '' WHEN m = 3 AND n % 3 = 0 THEN '☑ agree' || (n % 5) || ' here' ELSE 'x' || chr(9) || substr(text, 1, 9) END AS text, n % 6 = 0 AS has_table FROM (SELECT *, length(text) AS n, i % 5 AS m FROM {_LINES}))""",
    "people": """people AS (SELECT c_custkey AS person_id, unnest(['name', 'work.name', 'account.number']) AS field, unnest([c_name, c_mktsegment, c_nationkey::VARCHAR]) AS value FROM customer)""",
    "paragraphs": f"""paragraphs AS (SELECT doc_id, (i % 2)::BIGINT AS section_no, i::BIGINT AS para_idx, text, (length(text) % 7)::VARCHAR AS style_id,
  length(text) % 11 = 0 AS in_cell, length(text) % 13 = 0 AS in_note, (length(text) % 3)::BIGINT AS line_breaks, (length(text) % 4)::BIGINT AS line_segs,
  length(text) % 5 <> 0 AS plain_runs, CASE WHEN text = '' THEN 'empty' WHEN length(text) % 7 = 6 THEN 'object' ELSE 'text' END AS kind,
  length(text) % 17 = 0 AS forced_break, length(text) % 7 = 6 AS has_table FROM {_LINES})""",
    "styles": f"""styles AS (SELECT doc_id, pos::BIGINT AS pos, style_id, CASE WHEN pos = 5 AND doc_id % 3 = 0 THEN 'AI:BODY' ELSE name END AS name, eng_name, kind AS heading_type,
  CASE WHEN kind = 'NONE' THEN NULL ELSE outline_level::BIGINT END AS outline_level, CASE WHEN pos = 2 AND doc_id % 5 = 0 THEN 18.0 ELSE size_pt END::DOUBLE AS size_pt, glyph
  FROM (SELECT d.doc_id, s.*, CASE WHEN d.doc_id % 4 = 1 AND s.heading_type = 'OUTLINE' THEN 'NONE' ELSE s.heading_type END AS kind FROM documents d,
  (VALUES {_VALUES}) s(pos, style_id, name, eng_name, heading_type, outline_level, size_pt, glyph)))""",
    "header_items": f"""header_items AS (SELECT l_orderkey AS doc_id, 'charPr' AS item, pos, pos - 1 + ((l_orderkey + pos) % 13 = 0)::INT AS id,
  count(*) OVER (PARTITION BY l_orderkey) + (l_orderkey % 7 = 0)::INT AS item_cnt FROM {_NUMBERED})""",
    "refs": f"refs AS (SELECT l_orderkey AS doc_id, 'section0' AS part_name, 'charPr' AS item, CASE WHEN l_partkey % 9 = 0 THEN 4294967295 ELSE l_partkey % 8 END AS ref_id FROM {_NUMBERED})",
    "cells": f"""cells AS (SELECT doc_id, 0::BIGINT AS table_index, "row"::BIGINT AS "row", col::BIGINT AS col, row_span::BIGINT AS row_span, 1::BIGINT AS col_span, text FROM (
  SELECT o_orderkey AS doc_id, 0 AS "row", 0 AS col, 1 AS row_span, '상태' AS text FROM orders
  UNION ALL SELECT o_orderkey, 0, 1, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END, CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderstatus END FROM orders
  UNION ALL SELECT o_orderkey, 1, 0, 1, '우선순위' FROM orders
  UNION ALL SELECT o_orderkey, 1, 1, 1, o_orderpriority FROM orders WHERE o_orderkey % 4 <> 0
  UNION ALL SELECT o_orderkey, 2, 0, 1, '금액' FROM orders
  UNION ALL SELECT o_orderkey, 2, 1, 1, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_custkey::VARCHAR END FROM orders
  UNION ALL SELECT o_orderkey, 3, 0, 1, '번호' FROM orders
  UNION ALL SELECT o_orderkey, 3, 1, 1, '수량' FROM orders
  UNION ALL SELECT l_orderkey, pos + 3, 0, 1, l_linenumber::VARCHAR FROM {_NUMBERED}
  UNION ALL SELECT l_orderkey, pos + 3, 1, 1, qty::VARCHAR FROM {_NUMBERED}))""",
    "md_blocks": f"""md_blocks AS (SELECT doc_id, i::BIGINT AS ord, CASE m WHEN 0 THEN 'heading' WHEN 3 THEN 'table' WHEN 4 THEN 'figure' WHEN 5 THEN 'bullet' ELSE 'paragraph' END AS kind,
  (CASE m WHEN 0 THEN 1 + n % 3 WHEN 5 THEN n % 4 END)::BIGINT AS level,
  CASE m WHEN 0 THEN (1 + i % 9) || '. ' || text WHEN 1 THEN text || ' {{ref:t' || (n % 7) || '}}' ELSE text END AS text, (n % 2)::BIGINT AS blank_before,
  CASE WHEN m IN (3, 4) THEN 't' || (n % 5) END AS label, m = 3 AND n % 4 = 0 AS plain_cell FROM (SELECT *, length(text) AS n, i % 6 AS m FROM {_LINES}))""",
    "page_images": """page_images AS (SELECT conv_id AS doc_id, turn::BIGINT AS page, min(list_sort(list_distinct([role, 'h' || (length(text) % 5)]))) AS hashes FROM conversations GROUP BY 1, 2)""",
    "verdicts": """verdicts AS (SELECT doc_id % 97 AS doc_id, doc_id AS page, CASE WHEN doc_id % 7 <> 3 THEN quality = 1 AND toxic = 0 END AS ok, list_filter([CASE WHEN quality = 0 THEN 'layout_broken' END, CASE WHEN toxic = 1 THEN 'object_overlap' END], lambda x: x IS NOT NULL) AS issues FROM labels)""",
    "revisions": """revisions AS (SELECT event_type || '-' || (user_id % 50) AS name, event_id AS file_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS modified_time, floor(value)::BIGINT % 5 AS declarations, event_id % 10 < 7 AS confirmed FROM events)""",
}


def with_tables(*names: str) -> str:
    """WITH and the common table expressions of the named tables."""
    return "WITH " + ",\n".join(SQL[n] for n in names)
