"""More registered queries: packages, metadata, requests, inline Markdown. SQL twins give the expected rows."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, functions as F

from quiremill.functions import inline, text as T
from quiremill.operators import blocks, checks, edits, forms, layout, markdown, media
from quiremill.plans.queries import _MATCHED, _PLAIN, _TABLES, _TOKENS, ORACLES, QUERIES, _people_slots, _plain, _tables, query
from quiremill.sources import adapters as A, landing, packages
from quiremill.sources.shared import kept, shared_folder


def _contents(s: SparkSession, d: str) -> DataFrame:
    return packages.contents(A.packages(s, d))


@query("src2_parts", "SELECT doc_id::VARCHAR AS doc_id, unnest(['Contents/section0.xml', 'Contents/header.xml', 'Contents/content.hpf']) AS part_name, unnest([0, 1, 2]) AS part_order FROM documents")
def src2(s, d):  # noqa: ANN001, ANN201
    return packages.parts(A.packages(s, d)).where("error is null").select("doc_id", "part_name", "part_order")


@query(
    "src3_paragraphs",
    f"""WITH n AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, source FROM documents)
SELECT doc_id::VARCHAR AS doc_id, 0 AS section_no, i::INT AS para_idx, false AS in_cell, (length(text) % 7)::VARCHAR AS style_id, text, false AS has_table FROM {A._LINES}
UNION ALL SELECT doc_id::VARCHAR, 0, n::INT, false, '0', '', true FROM n UNION ALL SELECT doc_id::VARCHAR, 0, (n + 1)::INT, true, NULL, doc_id::VARCHAR, false FROM n UNION ALL SELECT doc_id::VARCHAR, 0, (n + 2)::INT, true, NULL, source, false FROM n""",
)
def src3(s, d):  # noqa: ANN001, ANN201
    return packages.paragraphs(_contents(s, d)).select("doc_id", "section_no", "para_idx", "in_cell", "style_id", "text", "has_table")


def _landed(s: SparkSession, d: str) -> tuple[str, DataFrame]:
    """The documents landed as packages, and landed again: of ids that end in 7 with a line more, in 9 with another time, without those that end in 5."""

    def packed(docs: DataFrame, *later: int) -> DataFrame:
        """Written once, as each landing reads it several times; time 1 for ids that end in one of later, else 0."""
        modified = F.timestamp_seconds((F.col("doc_id").cast("long") % 10).isin(*later).cast("int"))
        made = A.packages(s, d, docs)
        return kept(made.select("doc_id", F.concat(F.lit("in/"), "doc_id").alias("path"), modified.alias("modified"), F.length("content").cast("long").alias("length"), "content"))

    docs, target = A.read(s, d, "documents").withColumn("last", F.col("doc_id") % 10), shared_folder(s)
    landing.land(packed(docs), target)
    more = F.when(F.col("last") == 7, F.concat("text", F.lit("\nmore"))).otherwise(F.col("text"))
    landing.land(packed(docs.where("last <> 5").withColumn("text", more), 7, 9), target)
    return target, docs


@query(
    "src1_landing",
    """WITH d AS (SELECT doc_id, doc_id % 10 AS x, len(string_split(text, chr(10))) AS n FROM documents WHERE doc_id % 10 <> 5)
SELECT doc_id::VARCHAR AS doc_id, (x = 7)::INT AS rows_run, CASE WHEN x = 9 THEN 'touched' ELSE 'landed' END AS status, (n + 3 + (x = 7)::INT)::BIGINT AS n_paragraphs, 2::BIGINT AS n_cells FROM d""",
)
def src1(s, d):  # noqa: ANN001, ANN201
    target, _ = _landed(s, d)
    n = landing.contents(s, target).groupBy("doc_id").agg(F.count_if(F.col("kind") == "paragraph").alias("n_paragraphs"), F.count_if(F.col("kind") == "cell").alias("n_cells"))
    return landing.current(s, target).join(n, "doc_id").select("doc_id", "rows_run", "status", "n_paragraphs", "n_cells")


@query(
    "src11_landing_log",
    """SELECT doc_id::VARCHAR AS doc_id, unnest(CASE doc_id % 10 WHEN 7 THEN [0, 1] WHEN 9 THEN [0, 1] WHEN 5 THEN [0, 1] ELSE [0] END) AS run, unnest(CASE doc_id % 10 WHEN 7 THEN ['landed', 'landed'] WHEN 9 THEN ['landed', 'touched'] WHEN 5 THEN ['landed', 'removed'] ELSE ['landed'] END) AS status FROM documents""",
)
def src11_log(s, d):  # noqa: ANN001, ANN201
    return landing.log(s, _landed(s, d)[0]).select("doc_id", "run", "status")


@query("src4_cells", "SELECT doc_id::VARCHAR AS doc_id, 0 AS table_index, 0 AS \"row\", unnest([0, 1]) AS col, unnest([doc_id::VARCHAR, source]) AS text FROM documents")
def src4(s, d):  # noqa: ANN001, ANN201
    return packages.cells(_contents(s, d)).select("doc_id", "table_index", "row", "col", "text")


@query("src6_header_items", "SELECT doc_id::VARCHAR AS doc_id, 'styles' AS item, unnest([1, 2]) AS pos, unnest([0, 1 + doc_id % 3]) AS id, 2 + doc_id % 2 AS item_cnt FROM documents")
def src6(s, d):  # noqa: ANN001, ANN201
    return packages.header_items(_contents(s, d))


@query("src7_metadata", "SELECT doc_id::VARCHAR AS doc_id, 'T' || doc_id AS title, NULL AS language, nullif(trim(source), '') AS creator FROM documents")
def src7(s, d):  # noqa: ANN001, ANN201
    return packages.metadata(_contents(s, d)).select("doc_id", "title", "language", "creator")


@query("src10_manifests", "SELECT l_orderkey AS doc_id, string_agg('part ' || (l_partkey % 50), chr(10) || chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS markdown FROM lineitem GROUP BY 1")
def src10(s, d):  # noqa: ANN001, ANN201
    n = A._numbered(s, d).select(F.col("l_orderkey").alias("doc_id"), "pos", F.concat(F.lit("p"), F.col("l_partkey") % 50).alias("path"))
    listed = n.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "path"))), lambda x: x["path"]).alias("parts"))
    files = A.read(s, d, "part").select((F.col("p_partkey") % 50).alias("k")).distinct().select(F.concat(F.lit("p"), "k").alias("path"), F.concat(F.lit("part "), "k").alias("text"))
    return packages.manifests(listed, files)


@query("src11_listing", "SELECT event_type || event_id AS name, event_id AS file_id, ts AS modified_time FROM events WHERE event_type <> 'click'")
def src11(s, d):  # noqa: ANN001, ANN201
    kind = F.when(F.col("event_type") == "click", "folder").otherwise("file")
    return packages.listing(A.read(s, d, "events").select(F.concat("event_type", "event_id").alias("name"), F.col("event_id").alias("file_id"), F.col("ts").alias("modified_time"), kind.alias("file_type")))


@query("src12_spacings", "SELECT l_orderkey AS doc_id, l_linenumber, CASE WHEN l_linenumber % 2 = 0 AND l_partkey >= 1000 THEN l_partkey // 10 ELSE l_partkey END AS ls_percent, l_linenumber % 2 = 0 AND l_partkey >= 1000 AS repaired FROM lineitem")
def src12(s, d):  # noqa: ANN001, ANN201
    p = A.read(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, "PERCENT").otherwise("FIXED").alias("ls_type"), F.col("l_partkey").alias("ls_percent"))
    return edits.repaired_packages(p).select("doc_id", "l_linenumber", "ls_percent", "repaired")


@query("pf6_instructions", f"{A.with_tables('paragraphs')} SELECT doc_id, section_no, para_idx, text FROM paragraphs WHERE style_id = '6' AND trim(text, ' ') <> ''")
def pf6(s, d):  # noqa: ANN001, ANN201
    roles = A.styles(s, d).select("doc_id", F.when(F.col("style_id") == "6", "INSTRUCTION").otherwise("BODY").alias("role"), "style_id")
    return markdown.instructions(A.paragraphs(s, d), roles).drop("slots")


@query("pf10_figure_tables", f"WITH {_TABLES} SELECT doc_id, table_index FROM tables WHERE starts_with(caption, '[그림') AND table_index % 4 < 2")
def pf10(s, d):  # noqa: ANN001, ANN201
    t = _tables(s, d).withColumns({"col_cnt": F.lit(1), "row_cnt": (F.col("table_index") % 2 + 1).cast("int")})
    pics = t.where("table_index % 4 < 2").select("doc_id", "table_index", F.lit(0).alias("row"), F.lit(0).alias("col"))
    return media.figure_tables(t, None, pics).select("doc_id", "table_index")


@query(
    "jn13_meta_slots",
    """WITH t AS (SELECT o_orderkey AS doc_id, unnest(['title', 'title_1', 'printer', 'volume']) AS name, unnest([NULL, NULL, 'P', NULL]) AS fallback FROM orders), m AS (SELECT o_orderkey AS doc_id, 'title' AS name, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_clerk END AS value FROM (SELECT *, 'c' || o_custkey AS o_clerk FROM orders)),
v AS (SELECT t.doc_id, t.name, coalesce(nullif(value, ''), fallback, '') AS value FROM t LEFT JOIN m ON m.doc_id = t.doc_id AND m.name = t.name) SELECT doc_id, name, value, CASE WHEN value = '' AND name IN ('title', 'title_1') THEN 'title' END AS missing FROM v""",
)
def jn13(s, d):  # noqa: ANN001, ANN201
    o = A.read(s, d, "orders").withColumn("doc_id", F.col("o_orderkey"))
    tokens = o.select("doc_id", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(f).cast("string").alias("fallback")) for n, f in (("title", None), ("title_1", None), ("printer", "P"), ("volume", None))))).alias("t")).select("doc_id", "t.*")
    meta = o.select("doc_id", F.lit("title").alias("name"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("c"), "o_custkey")).alias("value"))
    return markdown.meta_slots(tokens, meta, ["title"])


@query(
    "jn15_images",
    """WITH n AS (SELECT l_orderkey, count(*) FILTER (l_linenumber = 1) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey AS doc_id, o_custkey AS request_id, CASE WHEN n = 1 AND o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0 THEN 'image1' END AS ref, CASE WHEN o_orderkey % 5 = 0 THEN 'missing_file' WHEN o_orderkey % 4 = 0 THEN 'bad_image' WHEN coalesce(n, 0) = 0 THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' WHEN o_orderkey % 3 = 0 THEN 'format_mismatch' ELSE 'replaced' END AS status FROM orders LEFT JOIN n ON l_orderkey = o_orderkey""",
)
def jn15(s, d):  # noqa: ANN001, ANN201
    pics = A.read(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("image"), "l_linenumber").alias("ref"), F.lit("cap").alias("caption"), F.lit("png").alias("ext"))
    k = F.col("o_orderkey")
    requests = A.read(s, d, "orders").select(k.alias("doc_id"), F.col("o_custkey").alias("request_id"), F.lit("image1").alias("ref"), F.lit(None).cast("string").alias("caption"), F.when(k % 4 == 0, None).when(k % 3 == 0, "jpg").otherwise("png").alias("ext"), (k % 5 != 0).alias("present"))
    return media.match_images(requests, pics)


@query("st3_blank_slots", f"{A.with_tables('people')},\n{_MATCHED} SELECT doc_id, locator FROM matched WHERE value IS NULL")
def st3(s, d):  # noqa: ANN001, ANN201
    slots, assigned = _people_slots(s, d)
    slots = slots.withColumns({"kind": F.lit("cell"), "current": F.lit("")})
    values = forms.matched_slots(slots, A.people(s, d), assigned).where("value is not null").select("doc_id", F.col("locator").alias("key"), "value")
    return forms.blank_slots(slots, forms.fill(slots, values)).select("doc_id", "locator")


_META = "meta AS (SELECT l_orderkey AS doc_id, l_linenumber AS priority, CASE l_partkey % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'volume' WHEN 2 THEN 'printer' ELSE 'odd' END AS key, l_suppkey::VARCHAR AS value FROM lineitem)"


@query("st4_merged_meta", f"WITH {_META} SELECT doc_id, key, value FROM meta WHERE key <> 'odd' QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY priority, value) = 1")
def st4(s, d):  # noqa: ANN001, ANN201
    m = F.col("l_partkey") % 4
    meta = A.read(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("priority"), F.when(m == 0, "title").when(m == 1, "volume").when(m == 2, "printer").otherwise("odd").alias("key"), F.col("l_suppkey").cast("string").alias("value"))
    return markdown.merged_meta(meta, ["title", "volume", "printer"])


@query("st5_co_researchers", "SELECT o_orderkey, concat_ws(',', o_orderpriority, o_orderstatus, o_orderstatus) AS names FROM orders")
def st5(s, d):  # noqa: ANN001, ANN201
    o = A.read(s, d, "orders").select("o_orderkey", F.array("o_orderpriority").alias("a"), F.array("o_orderpriority", "o_orderstatus", "o_orderstatus").alias("b"))
    return markdown.co_researchers(o, "a", "b").select("o_orderkey", F.array_join("names", ",").alias("names"))


@query("sc8_glyph_rank", f"{A.with_tables('styles')} SELECT doc_id, style_id, CASE WHEN glyph = '●' THEN 1 ELSE 5 END AS rank FROM styles".replace("ELSE 5", f"ELSE {len(T.GLYPHS)}"))
def sc8(s, d):  # noqa: ANN001, ANN201
    return A.styles(s, d).select("doc_id", "style_id", T.glyph_rank(F.col("glyph")).alias("rank"))


@query(
    "sc14_normalized_meta",
    """WITH c AS (SELECT c_custkey AS doc_id, c_name, '2026-0' || (1 + c_custkey % 9) AS d FROM customer)
SELECT doc_id, unnest(['title', 'title_1', 'title_2', 'authors', 'pub_date', 'lead_researcher']) AS key,
  unnest([c_name || chr(10) || 'x y', c_name, 'x y', split_part(c_name, ' ', 1), '2026년 ' || (1 + doc_id % 9) || '월', c_name || ' 위원']) AS value FROM c""",
)
def sc14(s, d):  # noqa: ANN001, ANN201
    k, name = F.col("c_custkey"), F.col("c_name")
    pairs = (("제목", F.concat(name, F.lit(" // x y"))), (" 발행일", F.concat(F.lit("2026-0"), 1 + k % 9)), ("연구책임", F.concat(name, F.lit(" 위원"))), ("부제", F.lit(" ")))
    meta = A.read(s, d, "customer").select(k.alias("doc_id"), F.explode(F.array(*(F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in pairs))).alias("p")).select("doc_id", "p.*")
    return markdown.normalized_meta(meta)


@query("sc15_front_matter", "SELECT doc_id, 'T' || chr(10) || doc_id AS title, 'a 1|it''s' AS co, 'x' || chr(10) || 'y: z' AS note, text AS body FROM documents")
def sc15(s, d):  # noqa: ANN001, ANN201
    head, tail = F.lit('---\ntitle: "T\\n'), F.lit("\"\n# no key: here\nco:\n  - a 1\n  - 'it''s'\nnote: |\n  x\n  y: z\n---\n")
    t = A.read(s, d, "documents").select("doc_id", F.concat(head, "doc_id", tail, "text").alias("text"))
    m = blocks.split_front_matter(t)
    return m.select("doc_id", F.col("meta")["title"][0].alias("title"), F.array_join(F.col("meta")["co"], "|").alias("co"), F.col("meta")["note"][0].alias("note"), "body")


@query("sc18_left_aligned", f"SELECT doc_id, i, length(v) + 1 >= 30 AS aligned FROM {_PLAIN}")
def sc18(s, d):  # noqa: ANN001, ANN201
    t = _plain(s, d).select("doc_id", "i", F.concat(F.lit("see [x"), "v", F.lit("](https://a.kr/b) now")).alias("t"))
    return t.select("doc_id", "i", inline.left_aligned(F.col("t")).alias("aligned"))


@query("sc20_spans", f"SELECT doc_id, i, unnest([0, 1, 2, 3, 4]) AS k, unnest(['a ', 'b' || w || 'b', ' *c* `\\-` $x*y*z$ ', 'd' || v, ' e' || w]) AS text, unnest([false, true, false, false, false]) AS bold, unnest([false, false, false, true, false]) AS italic FROM {_PLAIN}")
def sc20(s, d):  # noqa: ANN001, ANN201
    t = _plain(s, d).select("doc_id", "i", F.concat(F.lit("a **b"), "w", F.lit("b** \\*c\\* `\\-` $x*y*z$ *d"), "v", F.lit("* e"), "w").alias("t"))
    return t.select("doc_id", "i", F.posexplode(inline.spans(F.col("t"))).alias("k", "p")).select("doc_id", "i", "k", "p.text", "p.bold", "p.italic")


_BUILT = "# 1. T{id}\n\na\nb {id}\n\n\n- x\n  - y\n+ no\n1) n\n***\n표 {id}\n| p | q |\n|---|:-:|\n| 1 | $a|b$ |\n주) n\n![f](a.png){#f}\n![](b.png)\n\n$$\nz\n$$\n[^1]: note\n  more\nend"
_ROWS = [
    ("heading", 1, "T{id}", 0, ""), ("paragraph", 0, "a b {id}", 1, ""), ("bullet", 1, "x", 2, ""), ("bullet", 2, "y", 0, ""), ("paragraph", 0, "+ no", 0, ""), ("ordered", 1, "n", 0, ""), ("rule", 0, "", 0, ""),
    ("table", 0, "", 0, "표 {id}/p,q;1,$a|b$/left,center/주) n"), ("figure", 0, "f", 0, "a.png,b.png"), ("math", 0, "z", 1, ""), ("paragraph", 0, "end", 0, ""),
]


def _sql_list(values: list) -> str:
    return "[" + ", ".join(str(v) if isinstance(v, int) else f"replace('{v}', '{{id}}', w)" for v in values) + "]"


@query("sc21_built_blocks", f"SELECT doc_id, {', '.join(f'unnest({_sql_list(c)}) AS {n}' for n, c in (('ord', list(range(len(_ROWS)))), *zip(('kind', 'level', 'text', 'blank_before', 'more'), map(list, zip(*_ROWS, strict=True)), strict=True)))} FROM (SELECT doc_id, 'x' || regexp_replace(text, '[^가-힣a-zA-Z0-9]', '', 'g') AS w FROM documents)")
def sc21_built(s, d):  # noqa: ANN001, ANN201
    words = F.concat(F.lit("x"), F.regexp_replace("text", "[^가-힣a-zA-Z0-9]", ""))
    t = A.read(s, d, "documents").select("doc_id", F.replace(F.lit(_BUILT), F.lit("{id}"), words).alias("text"))
    b = blocks.parse_markdown(t)
    table = F.concat_ws("/", "caption", F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";"), F.array_join("aligns", ","), "note")
    more = F.when(F.col("kind") == "table", table).when(F.col("kind") == "figure", F.array_join("paths", ",")).otherwise("")
    return b.select("doc_id", "ord", "kind", "level", "text", "blank_before", more.alias("more"))


@query("sc22_footnotes", """SELECT doc_id, unnest(['1', 'b']) AS note_id, unnest(['new ' || w || ' more', 'x' || w || 'x']) AS note FROM (SELECT doc_id, regexp_replace(text, '[^가-힣a-zA-Z0-9.,:*|#-]+', ' ', 'g') || 'x' AS w FROM documents)""")
def sc22(s, d):  # noqa: ANN001, ANN201
    """Notes that hold the whole text of a document."""
    w = F.concat(F.regexp_replace("text", "[^가-힣a-zA-Z0-9.,:*|#-]+", " "), F.lit("x"))
    t = A.read(s, d, "documents").select("doc_id", F.concat(F.lit("[^1]: old\na [^1]\n[^b]:x"), w, F.lit("x\n\n  not\n[^1]: new "), w, F.lit("\n\tmore\nend")).alias("text"))
    return blocks.footnote_definitions(t)


@query("sc24_images", "SELECT page_id, CASE WHEN page_id % 4 = 3 THEN NULL ELSE ['png', 'gif', 'bmp'][page_id % 4 + 1] END AS format, CASE page_id % 4 WHEN 3 THEN NULL WHEN 1 THEN length(html) % 60000 ELSE length(html) END AS px_w, CASE WHEN page_id % 4 = 3 THEN NULL ELSE page_id % 60000 END AS px_h FROM pages")
def sc24(s, d):  # noqa: ANN001, ANN201
    """Headers with the length of a page's html as width, and the html itself behind them."""

    def number(c, digits: int, little: bool = False):  # noqa: ANN001, ANN202
        x = F.lpad(F.hex(c.cast("long")), digits, "0")
        return F.unhex(F.concat(*(F.substring(x, i, 2) for i in range(digits - 1, 0, -2))) if little else x)

    k, n, m = F.col("page_id") % 60000, F.length("html"), F.col("page_id") % 4
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), number(n, 8), number(k, 8))
    gif = F.concat(F.unhex(F.lit("474946383961")), number(n % 60000, 4, True), number(k, 4, True))
    bmp = F.concat(F.unhex(F.lit("424D" + "00" * 16)), number(n, 8, True), number((F.lit(1 << 32) - k) % (1 << 32), 8, True))
    image = F.concat(F.when(m == 0, png).when(m == 1, gif).when(m == 2, bmp).otherwise(F.unhex(F.lit("00"))), F.encode("html", "UTF-8"))
    t = A.read(s, d, "pages").select("page_id", image.alias("b"))
    return t.select("page_id", T.image_format(F.col("b")).alias("format"), T.image_size(F.col("b")).alias("s")).select("page_id", "format", F.col("s.px_w").cast("long").alias("px_w"), F.col("s.px_h").cast("long").alias("px_h"))


@query(
    "sc25_fitted",
    """WITH h AS (SELECT p_partkey, p_size * 1000 AS w, 3 + p_partkey % 5 AS x, 1 + p_partkey % 7 AS y, round_even(p_size * 1000.0 * (1 + p_partkey % 7) / (3 + p_partkey % 5), 0)::BIGINT AS h FROM part),
f AS (SELECT *, CASE WHEN h > 30000 THEN round_even(30000.0 * x / y, 0)::BIGINT ELSE w END AS width FROM h) SELECT p_partkey, width, least(h, 30000) AS height, round_even(width::DOUBLE / least(h, 30000) * 10000, 0) / 10000 AS ratio FROM f""",
)
def sc25(s, d):  # noqa: ANN001, ANN201
    k = F.col("p_partkey")
    e = T.fitted(F.col("p_size") * F.lit(1000.0), 3 + k % 5, 1 + k % 7, F.lit(30000))
    return A.read(s, d, "part").select("p_partkey", e.alias("e")).select("p_partkey", "e.*")


@query(
    "sc27_row_growth",
    f"""{A.with_tables("cells")} SELECT doc_id, table_index, "row", 1000 * max(CASE WHEN regexp_matches(text, '[가-힣]') THEN 1 ELSE greatest(1, ceil(length(text) / 9.0)) END)::BIGINT AS height FROM cells GROUP BY 1, 2, 3""",
)
def sc27(s, d):  # noqa: ANN001, ANN201
    return layout.row_growth(A.cells(s, d).withColumns({"em": F.lit(5.0), "height": F.lit(1000).cast("long")}))


@query("sc30_split_tokens", f"{A.with_tables('form_lines')}, r AS (SELECT doc_id, para_idx, {_TOKENS} AS t, {_TOKENS.replace('(text,', '(substr(text, 1, 9),')} AS a, {_TOKENS.replace('(text,', '(substr(text, 10),')} AS b FROM form_lines) SELECT doc_id, para_idx, array_to_string(list_filter(list_distinct(t), lambda x: NOT list_contains(list_concat(a, b), x)), ',') AS tokens FROM r")
def sc30(s, d):  # noqa: ANN001, ANN201
    runs = F.array(F.substring("text", 1, 9), F.expr("substring(text, 10)"))
    return A.form_lines(s, d).select("doc_id", "para_idx", F.array_join(T.split_run_tokens(F.col("text"), runs), ",").alias("tokens"))


@query("uf1_judged_pages", "SELECT conv_id AS doc_id, turn::BIGINT AS page, CASE WHEN length(text) % 11 <> 0 THEN length(text) % 2 = 0 END AS ok, CASE WHEN length(text) % 2 = 1 AND length(text) % 11 <> 0 THEN 'text_truncated' END AS issue, CASE WHEN length(text) % 11 = 0 THEN 'ValueError: no picture' ELSE turn || ' of ' || count(*) OVER (PARTITION BY conv_id) END AS note FROM conversations")
def uf1(s, d):  # noqa: ANN001, ANN201
    """A stand-in for a judge that looks at the length of a page's text, and can't read some."""

    def setup():  # noqa: ANN202
        def judge(image: bytes, page: int, pages: int) -> tuple:
            n = len(image.decode())
            if n % 11 == 0:
                raise ValueError("no picture")
            return n % 2 == 0, [("text_truncated", "")] * (n % 2), f"{page} of {pages}"

        return judge

    c = A.read(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("long").alias("page"), F.encode("text", "UTF-8").alias("image"))
    return media.judge_pages(c, setup).select("doc_id", "page", "ok", F.get("issues", F.lit(0))["type"].alias("issue"), "note")


@query(
    "uf2_page_signatures",
    f"""WITH l AS (SELECT doc_id, i + 1 AS page, 'h' || (length(text) % 5) AS h FROM {A._LINES}), n AS (SELECT doc_id, h FROM l GROUP BY 1, 2 HAVING count(*) >= 2) SELECT l.doc_id, page::BIGINT AS page, coalesce(n.h, '') AS signature FROM l LEFT JOIN n ON n.doc_id = l.doc_id AND n.h = l.h""",
)
def uf2(s, d):  # noqa: ANN001, ANN201
    """Each line of a document as a page with one picture: page hashes from the hook, and from them the signatures of pages."""

    def setup():  # noqa: ANN202
        return lambda content: [{f"h{len(line) % 5}"} for line in content.decode().split("\n")]

    docs = A.read(s, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return media.recurring_hashes(media.hash_pages(docs, setup))


@query("src8_pictures", f"""SELECT doc_id::VARCHAR AS doc_id, i::INT AS para_idx, 'image' || (length(text) % 4) AS ref, text AS caption, 'f' || i || '.png' AS origname, (length(text) + 1)::INT AS px_w, (i + 2)::INT AS px_h FROM {A._LINES} WHERE length(text) % 3 = 0 AND length(text) > 0""")
def src8(s, d):  # noqa: ANN001, ANN201
    """Packages in which some lines hold a picture with a description."""
    made = A.packed(A.read(s, d, "documents").select("doc_id", "text"), lambda _, t: A.pictured(t or ""))
    return packages.pictures(packages.contents(made)).select("doc_id", "para_idx", "ref", "caption", "origname", "px_w", "px_h")


@query("src9_profiles", "SELECT c_custkey AS person_id, c_name AS name, 'n' || c_nationkey AS mobile, [c_mktsegment, c_name] AS schools FROM customer")
def src9(s, d):  # noqa: ANN001, ANN201
    """Customers saved as profile files and read back."""
    c = A.read(s, d, "customer")
    made = c.select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"), F.concat(F.lit("n"), "c_nationkey").alias("mobile"), F.array(F.struct(F.col("c_mktsegment").alias("school")), F.struct(F.col("c_name").alias("school"))).alias("education"))
    made.write.json(folder := shared_folder(s))
    back = s.read.schema(made.schema).json(folder)
    return back.select("person_id", "name", "mobile", F.transform("education", lambda e: e["school"]).alias("schools")).withColumn("schools", F.array_join("schools", "|"))


ORACLES["src9_profiles"] = ORACLES["src9_profiles"].replace("[c_mktsegment, c_name] AS schools", "c_mktsegment || '|' || c_name AS schools")


@query("snk1_texts", ORACLES["sc35_corpus_markdown"].replace("SELECT doc_id, regexp_replace(regexp_replace(concat_ws", "SELECT doc_id, (doc_id % 4)::INT AS part, regexp_replace(regexp_replace(concat_ws"))
def snk1(s, d):  # noqa: ANN001, ANN201
    """Extracted Markdown written by a partition and read back."""
    packages.write_texts(QUERIES["sc35_corpus_markdown"](s, d).withColumn("part", (F.col("doc_id") % 4).cast("int")), folder := shared_folder(s), "part")
    return s.read.parquet(folder)


_FOUND = ["duplicate id", "wrong count", "id order"]


@query(
    "snk2_reports",
    f"""{A.with_tables("header_items")}, f AS (SELECT doc_id, 'duplicate id' AS kind, id::VARCHAR AS w FROM header_items GROUP BY doc_id, item, id HAVING count(*) > 1 UNION ALL SELECT doc_id, 'wrong count', item FROM header_items GROUP BY doc_id, item HAVING max(item_cnt) <> count(*)
  UNION ALL SELECT doc_id, 'id order', item || ':' || pos FROM (SELECT *, lag(id) OVER (PARTITION BY doc_id, item ORDER BY pos) AS before FROM header_items) WHERE id <> coalesce(before, -1) + 1 QUALIFY row_number() OVER (PARTITION BY doc_id, item ORDER BY pos) = 1),
g AS (SELECT doc_id, {", ".join(f"coalesce(list(w ORDER BY w) FILTER (kind = '{k}'), []) AS {k.split()[0]}" for k in _FOUND)} FROM f GROUP BY 1), n AS (SELECT doc_id, count(*) AS items FROM header_items GROUP BY 1)
SELECT doc_id, '{{"doc_id":' || doc_id || ',"items":' || items || ',' || {" || ',' || ".join(f"""'"{k}":' || to_json(coalesce({k.split()[0]}, []))""" for k in _FOUND)} || '}}' AS report FROM n LEFT JOIN g USING (doc_id)""",
)
def snk2(s, d):  # noqa: ANN001, ANN201
    """A report of each order's ids, written twice and read back."""
    items = A.header_items(s, d)
    found = checks.findings(("'duplicate id'", checks.duplicate_ids(items), "id"), ("'wrong count'", checks.wrong_counts(items), "item"), ("'id order'", checks.id_order(items), "concat(item, ':', pos)"))
    made = packages.reports(found, _FOUND, items=items.groupBy("doc_id").agg(F.count("*").alias("value")))
    folder = shared_folder(s)
    for _ in range(2):
        packages.write_reports(made, folder, 8)
    return s.read.text(folder).select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), F.col("value").alias("report"))


_STEPS = ", ".join(f"{{'s': {a}, 'c': {b}}}" for a, b in layout.ladder())


@query(
    "wn13_page_plan",
    f"""WITH x AS (SELECT doc_id, i // 5 AS para_idx, i % 5 AS line_no, length(text) AS n, (i * 1600 + length(text) % 600) % 9000 AS vertpos, 300 + length(text) % 3 * 50 AS spacing, length(text) % 17 = 0 AS fb, CASE WHEN length(text) % 13 = 0 THEN 500 ELSE 0 END AS note FROM {A._LINES}),
pr AS (SELECT doc_id, para_idx, CASE WHEN n % 7 = 0 THEN 'empty' WHEN n % 7 = 6 THEN 'object' ELSE 'text' END AS kind, n % 4 = 1 AS heading, n % 400 AS sb, n % 150 AS sa, n % 9 <> 0 AS soft FROM x WHERE line_no = 0),
ct AS (SELECT *, coalesce(vertpos < lag(vertpos) OVER o OR (line_no = 0 AND fb AND lag(vertpos) OVER o IS NOT NULL), false)::INT AS cut FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY para_idx, line_no)),
pg AS (SELECT *, 1000 + spacing AS tall, sum(cut) OVER (PARTITION BY doc_id ORDER BY para_idx, line_no) AS page, max(line_no) OVER (PARTITION BY doc_id, para_idx) AS endl FROM ct),
lr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, para_idx ORDER BY line_no) AS r FROM pg),
bl AS (SELECT doc_id, page, para_idx, count(*) AS n, bool_or(line_no = 0) AS first, bool_or(line_no = endl) AS last, sum(tall) AS tall, arg_max(spacing, line_no) AS lsp, arg_max(tall, line_no) AS lt, sum(note) AS notes, max(vertpos + 1000) AS bottom, bool_or(fb AND line_no = 0) AS forced,
  sum(CASE WHEN r <= 2 THEN tall END) AS tall2, max(CASE WHEN r = 2 THEN spacing END) AS lsp2, max(CASE WHEN r = 2 THEN tall END) AS lt2 FROM lr GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY para_idx) AS k, count(*) OVER (PARTITION BY doc_id, page) AS size FROM bl JOIN pr USING (doc_id, para_idx)),
hd AS (SELECT doc_id, page, min(CASE WHEN kind <> 'empty' THEN k END) AS h FROM b GROUP BY 1, 2),
lm AS (SELECT hd.doc_id, hd.page, CASE WHEN NOT f.first THEN CASE WHEN f.last THEN 1 END WHEN h IS NULL OR NOT m.last THEN NULL WHEN NOT m.heading THEN h WHEN x.k IS NULL OR NOT x.first THEN NULL WHEN (x.kind = 'text' AND x.n >= 4) OR x.last THEN h + 1 END AS size,
  coalesce(f.first AND m.heading AND x.kind = 'text' AND x.n >= 4, false) AS part FROM hd JOIN b f ON f.doc_id = hd.doc_id AND f.page = hd.page AND f.k = 1 LEFT JOIN b m ON m.doc_id = hd.doc_id AND m.page = hd.page AND m.k = h LEFT JOIN b x ON x.doc_id = hd.doc_id AND x.page = hd.page AND x.k = h + 1),
ch AS (SELECT b.doc_id, b.page, b.k, lm.size, kind, soft, sb, sa, notes, first, CASE WHEN part AND b.k = lm.size THEN 2 ELSE n END AS n, NOT (part AND b.k = lm.size) AND last AS last, CASE WHEN part AND b.k = lm.size THEN tall2 ELSE tall END AS tall, CASE WHEN part AND b.k = lm.size THEN lsp2 ELSE lsp END AS lsp, CASE WHEN part AND b.k = lm.size THEN lt2 ELSE lt END AS lt
  FROM b JOIN lm ON lm.doc_id = b.doc_id AND lm.page = b.page WHERE b.k <= lm.size),
cs AS (SELECT doc_id, page, sum(CASE WHEN kind <> 'empty' THEN n ELSE 0 END) AS n, bool_or(kind = 'object') AS obj, sum(CASE WHEN first THEN sb ELSE 0 END) AS sb, sum(tall) AS tall, sum(CASE WHEN last AND k < size THEN sa ELSE 0 END) AS sa, max(CASE WHEN k = size THEN lsp END) AS lsp, sum(notes) AS notes,
  sum(CASE WHEN soft AND kind <> 'object' THEN tall ELSE 0 END) - max(CASE WHEN k = size THEN CASE WHEN soft AND kind <> 'object' THEN lt ELSE 0 END END) AS soft FROM ch GROUP BY 1, 2),
p AS (SELECT doc_id, page, max(bottom) AS bottom, arg_min(forced, para_idx) AS forced, sum(notes) AS notes, arg_max(lsp + CASE WHEN last THEN sa ELSE 0 END, para_idx) AS tail, sum(CASE WHEN first THEN sb + CASE WHEN last THEN sa ELSE 0 END ELSE 0 END) AS spaces, sum(CASE WHEN first AND soft AND kind <> 'object' THEN tall ELSE 0 END) AS soft FROM b GROUP BY 1, 2),
n AS (SELECT p.*, q.forced AS nf, 8000 - CASE WHEN p.notes > 0 THEN 40 + p.notes ELSE 0 END - p.bottom AS gap, CASE WHEN p.notes > 0 THEN 40 + p.notes ELSE 0 END AS own, cs.n AS cn, obj, cs.sb + cs.tall + cs.sa - cs.lsp AS add, cs.notes AS cnotes, cs.sb + cs.sa AS cspaces, cs.soft AS csoft FROM p JOIN p q ON q.doc_id = p.doc_id AND q.page = p.page + 1 LEFT JOIN cs ON cs.doc_id = q.doc_id AND cs.page = q.page),
k AS (SELECT *, gap * 100.0::DOUBLE / 8000 AS share, CASE WHEN nf THEN CASE WHEN gap * 100.0 / 8000 >= 10 THEN 'forced' END WHEN gap * 100.0 / 8000 >= 10 THEN 'gap' WHEN cn <= 3 AND NOT obj THEN 'pull' END AS kind FROM n),
m AS (SELECT *, kind <> 'forced' AND cn IS NOT NULL AS moves, bottom + tail + add + CASE WHEN cnotes > 0 THEN CASE WHEN own > 0 THEN own ELSE 40 END + cnotes ELSE own END - 8000 AS need FROM k WHERE kind IS NOT NULL),
f AS (SELECT *, CASE WHEN moves THEN list_filter([{_STEPS}], lambda x: floor(((spaces + cspaces) * x.s + (soft + csoft) * x.c) / 100) >= greatest(need, 0) + 100)[1] END AS step FROM m)
SELECT doc_id, 0::BIGINT AS section_no, page::BIGINT AS page, round_even(gap * 10000.0::DOUBLE / 8000, 0) / 100 AS gap_pct, kind, CASE WHEN moves THEN cn ELSE 0 END::BIGINT AS chunk_lines, CASE WHEN moves THEN need ELSE 0 END::BIGINT AS needed, CASE WHEN kind = 'forced' THEN 'forced' WHEN step IS NULL THEN 'unfittable' ELSE 'fittable' END AS status, step.s::BIGINT AS spacing_cut, step.c::BIGINT AS line_cut FROM f""",
)
def wn13_plan(s, d):  # noqa: ANN001, ANN201
    i, n = F.col("i"), F.length("text")
    x = A.read(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    x = x.select("doc_id", F.lit(0).cast("long").alias("section_no"), F.floor(i / 5).alias("para_idx"), (i % 5).alias("line_no"), ((i * 1600 + n % 600) % 9000).alias("vertpos"), F.lit(1000).alias("vertsize"), (300 + n % 3 * 50).alias("spacing"), (n % 17 == 0).alias("forced_break"), F.when(n % 13 == 0, 500).otherwise(0).alias("note_height"), n.alias("n"))
    kind, n = F.when(F.col("n") % 7 == 0, "empty").when(F.col("n") % 7 == 6, "object").otherwise("text"), F.col("n")
    paras = x.where("line_no = 0").select("doc_id", "section_no", "para_idx", kind.alias("kind"), (n % 4 == 1).alias("heading"), (n % 400).alias("sb"), (n % 150).alias("sa"), (n % 9 != 0).alias("percent"))
    return layout.page_plan(x.drop("n"), paras, 8000, layout.ladder(), note_gap=40)
