"""Registered queries over the generic tables and the SQL that says the same.

Each entry derives document tables with the adapters and applies one operator. SQL twins build on the
same tables as common table expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quiremill.functions import inline, text as T
from quiremill.operators import blocks, checks, edits, forms, layout, markdown, media, styles
from quiremill.sources import adapters as A
from quiremill.sources.shared import common_shares, dealt, joined, kept, shared_folder
from quiremill.streaming import revisions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _system(s: SparkSession, d: str) -> DataFrame:
    return styles.style_system(A.styles(s, d), A.paragraphs(s, d))


_SYSTEM = """usage AS (SELECT doc_id, style_id, count(*) AS use_count FROM paragraphs GROUP BY 1, 2),
system AS (SELECT s.*, coalesce(u.use_count, 0) AS use_count FROM styles s LEFT JOIN usage u USING (doc_id, style_id))"""
_OVERRIDE = r"regexp_replace(upper(nullif(regexp_extract(name, '^\s*AI:([A-Za-z_][A-Za-z0-9_]*)\s*$', 1), '')), '^H([0-9]+)$', 'HEADING_\1')"
_ENUM = "CASE WHEN trim(name) = '로마자' THEN 'ROMAN' " + " ".join(f"WHEN regexp_matches(trim(name), '{p}') THEN '{k}'" for k, p in T.ENUMERATORS) + " END"
_ROLES = f"""declared AS (SELECT doc_id, role, style_id FROM (SELECT *, {_OVERRIDE} AS role FROM system) WHERE role IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, role ORDER BY pos DESC) = 1),
auto AS (SELECT doc_id, role, style_id FROM (SELECT *, CASE WHEN heading_type = 'OUTLINE' AND {_ENUM} IS NOT NULL THEN 'ORDERED_' || (outline_level + 1) WHEN heading_type = 'OUTLINE' THEN 'HEADING_' || (outline_level + 1)
    WHEN heading_type = 'BULLET' THEN 'BULLET_' || (outline_level + 1) WHEN lower(trim(name)) IN ('normal', '바탕글') OR lower(trim(eng_name)) IN ('normal', '바탕글') THEN 'BODY' END AS role FROM system WHERE {_OVERRIDE} IS NULL)
  WHERE role IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, role ORDER BY coalesce(regexp_matches(eng_name, '(?i)^\\s*Outline\\s+[0-9]+\\s*$'), false) DESC, use_count DESC, pos) = 1),
roles AS (SELECT * FROM declared UNION ALL SELECT * FROM auto a WHERE NOT EXISTS (SELECT 1 FROM declared d WHERE d.doc_id = a.doc_id AND d.role = a.role))"""
_STYLED = f"{A.with_tables('paragraphs', 'styles')},\n{_SYSTEM}"
_ROLED = f"{_STYLED},\n{_ROLES}"
_KINDS = """kinds AS (SELECT doc_id, style_id, min(role) AS role FROM roles WHERE regexp_matches(role, '^(HEADING|BULLET|ORDERED)_[0-9]+$|^BODY$') GROUP BY 1, 2),
classified AS (SELECT p.doc_id, section_no, para_idx, text, CASE WHEN role IS NOT NULL THEN split_part(role, '_', 1) WHEN heading_type = 'OUTLINE' THEN 'HEADING' WHEN heading_type = 'BULLET' THEN 'BULLET' ELSE 'BODY' END AS role_kind,
  CASE WHEN role = 'BODY' THEN NULL WHEN role IS NOT NULL THEN split_part(role, '_', 2)::BIGINT WHEN heading_type IN ('OUTLINE', 'BULLET') THEN outline_level + 1 END AS role_level
  FROM paragraphs p LEFT JOIN kinds USING (doc_id, style_id) LEFT JOIN styles s USING (doc_id, style_id))"""


@query("src5_style_system", f"{_STYLED}\nSELECT * FROM system")
def src5(s, d):  # noqa: ANN001, ANN201
    return _system(s, d)


@query("ag1_style_usage", f"{A.with_tables('paragraphs')} SELECT doc_id, style_id, count(*) AS use_count FROM paragraphs GROUP BY 1, 2")
def ag1(s, d):  # noqa: ANN001, ANN201
    return styles.style_usage(A.paragraphs(s, d))


@query(
    "ag2_classify",
    f"""{_STYLED}, a AS (SELECT doc_id, sum(use_count) AS n, sum(CASE WHEN heading_type = 'OUTLINE' THEN use_count ELSE 0 END)::BIGINT AS n_outline,
  count(DISTINCT CASE WHEN heading_type = 'OUTLINE' AND use_count > 0 THEN outline_level END) AS n_levels, count(DISTINCT CASE WHEN regexp_matches({_OVERRIDE}, '^HEADING_[0-9]+$') THEN {_OVERRIDE} END) AS n_declared FROM system GROUP BY 1)
SELECT doc_id, CASE WHEN n = 0 THEN 'flat' WHEN n_outline >= 3 AND n_levels >= 2 THEN 'structured' WHEN n_declared >= 2 THEN 'structured' WHEN n_outline = 0 THEN 'flat' ELSE 'weak' END AS classification, n_outline, n_levels, n_declared FROM a""",
)
def ag2(s, d):  # noqa: ANN001, ANN201
    return styles.classify(_system(s, d))


@query("wn1_role_map", f"{_ROLED}\nSELECT * FROM roles")
def wn1(s, d):  # noqa: ANN001, ANN201
    return styles.role_map(_system(s, d))


def _classified(s: SparkSession, d: str) -> DataFrame:
    system = _system(s, d)
    return styles.paragraph_roles(A.paragraphs(s, d), system, styles.role_map(system))


@query("jn1_paragraph_roles", f"{_ROLED},\n{_KINDS}\nSELECT * FROM classified")
def jn1(s, d):  # noqa: ANN001, ANN201
    return _classified(s, d)


_OBJECTS = """w AS (SELECT *, length(text) AS n, string_split(text, ' ') AS w FROM paragraphs),
tbl AS (SELECT doc_id, section_no, para_idx, concat_ws(chr(10) || chr(10), CASE WHEN n % 3 = 0 THEN 'T' || n END, '| ' || replace(coalesce(w[1], ''), '|', '\\|') || ' | ' || replace(coalesce(w[2], ''), '|', '\\|') || ' |' || chr(10) || '|---|---|' || chr(10)
  || '| ' || replace(coalesce(w[3], ''), '|', '\\|') || ' | ' || replace(coalesce(w[3], ''), '|', '\\|') || ' |') AS line FROM w WHERE n % 14 = 6),
fig AS (SELECT doc_id, section_no, para_idx, '![' || substr(text, 1, 9) || '](p' || para_idx || '.png)' || CASE WHEN n % 3 = 0 THEN ' ![](<b c.png>)' ELSE '' END || CASE WHEN n % 4 = 1 THEN '{#f' || (n % 5) || '}' ELSE '' END
  || CASE WHEN n % 3 = 1 THEN chr(10) || '자료: ' || n ELSE '' END AS line FROM w WHERE n % 14 = 13),
NOTESsaid AS (SELECT c.doc_id, c.section_no, c.para_idx, role_kind, greatest(coalesce(role_level, 1), 1) AS level, c.text || coalesce('[^' || nt.no || ']', '') AS text, coalesce(tbl.line, fig.line) AS object
  FROM classified c LEFT JOIN tbl USING (doc_id, section_no, para_idx) LEFT JOIN fig USING (doc_id, section_no, para_idx) LEFT JOIN nt USING (doc_id, section_no, para_idx)),
lines AS (SELECT doc_id, section_no, para_idx, object IS NULL AND role_kind = 'HEADING' AND level = 1 AS h1, CASE WHEN object IS NOT NULL THEN object WHEN role_kind = 'HEADING' THEN repeat('#', least(6, level)::INT) || ' ' || text
  WHEN role_kind = 'BULLET' THEN repeat('  ', (level - 1)::INT) || '* ' || text WHEN role_kind = 'ORDERED' THEN repeat('  ', (level - 1)::INT) || '1. ' || text ELSE text END AS line FROM said WHERE object IS NOT NULL OR text <> '')"""
_WHOLE = """body AS (SELECT doc_id, string_agg(line, chr(10) || chr(10) ORDER BY section_no, para_idx) AS body FROM lines WHERE KEPT GROUP BY 1),
df AS (SELECT doc_id, string_agg('[^' || no || ']: ' || trim(text), chr(10) ORDER BY no) AS defs FROM nt GROUP BY 1)
SELECT doc_id, regexp_replace(regexp_replace(concat_ws(chr(10) || chr(10), body, defs), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS markdown FROM body FULL JOIN df USING (doc_id)"""


def _markdown(s: SparkSession, d: str, body_from_h1: bool) -> DataFrame:
    at = ["doc_id", "section_no", "para_idx"]
    p = A.paragraphs(s, d).withColumns({"n": F.length("text"), "w": F.split("text", " ")})
    table, figure = p.where("n % 14 = 6"), p.where("n % 14 = 13")

    def cell(row: int, col: int, span: int, word: int) -> Column:
        return F.struct(*(F.lit(x).cast("long").alias(k) for k, x in (("row", row), ("col", col), ("row_span", 1), ("col_span", span))), F.coalesce(F.get("w", F.lit(word)), F.lit("")).alias("text"))

    cells = table.select("doc_id", F.col("para_idx").alias("table_index"), F.explode(F.array(cell(0, 0, 1, 0), cell(0, 1, 1, 1), cell(1, 0, 2, 2))).alias("c")).select("doc_id", "table_index", "c.*")
    captions = table.select("doc_id", F.col("para_idx").alias("table_index"), F.when(F.col("n") % 3 == 0, F.concat(F.lit("T"), F.col("n"))).alias("caption"))
    tables = forms.pipe_tables(cells, captions).withColumnRenamed("table_index", "para_idx").join(table.select(*at), ["doc_id", "para_idx"])
    paths = F.concat(F.array(F.concat(F.lit("p"), F.col("para_idx"), F.lit(".png"))), F.when(F.col("n") % 3 == 0, F.array(F.lit("b c.png"))).otherwise(F.array().cast("array<string>")))
    label, said = F.when(F.col("n") % 4 == 1, F.concat(F.lit("f"), F.col("n") % 5)), F.when(F.col("n") % 3 == 1, F.array(F.concat(F.lit("자료: "), F.col("n"))))
    figures = figure.select(*at, F.substring("text", 1, 9).alias("title"), paths.alias("paths"), label.alias("label"), said.alias("notes"))
    notes = p.where("in_note").select(*at, F.lit(0).cast("long").alias("pos"), F.concat(F.lit("note "), F.col("n")).alias("text"))
    return markdown.corpus_markdown(_classified(s, d), tables, figures, notes, body_from_h1)


_NOTES = "nt AS (SELECT doc_id, section_no, para_idx, 'note ' || n AS text, row_number() OVER (PARTITION BY doc_id ORDER BY section_no, para_idx) AS no FROM w FROM_START WHERE in_note),\n"
_STARTS = """starts AS (SELECT doc_id, arg_min(struct_pack(s := section_no, p := para_idx), struct_pack(s := section_no, p := para_idx)) AS start FROM classified c WHERE role_kind = 'HEADING' AND role_level = 1
  AND NOT EXISTS (SELECT 1 FROM tbl t WHERE t.doc_id = c.doc_id AND t.section_no = c.section_no AND t.para_idx = c.para_idx) AND NOT EXISTS (SELECT 1 FROM fig t WHERE t.doc_id = c.doc_id AND t.section_no = c.section_no AND t.para_idx = c.para_idx) GROUP BY 1),
"""
_LATER = "JOIN starts ON starts.doc_id = {0}.doc_id AND struct_pack(s := {0}.section_no, p := {0}.para_idx) >= start"


@query("sc35_corpus_markdown", f"{_ROLED},\n{_KINDS},\n{_OBJECTS},\n{_WHOLE}".replace("NOTES", _NOTES.replace("FROM_START ", "")).replace("KEPT", "true"))
def sc35(s, d):  # noqa: ANN001, ANN201
    return _markdown(s, d, body_from_h1=False)


@query(
    "sc35_body_only",
    f"{_ROLED},\n{_KINDS},\n{_OBJECTS},\n{_WHOLE}".replace("NOTES", _STARTS + _NOTES.replace("SELECT doc_id,", "SELECT w.doc_id,").replace("PARTITION BY doc_id", "PARTITION BY w.doc_id").replace("FROM_START", _LATER.format("w"))).replace("SELECT doc_id, string_agg(line, chr(10) || chr(10) ORDER BY section_no, para_idx) AS body FROM lines WHERE KEPT", f"SELECT lines.doc_id, string_agg(line, chr(10) || chr(10) ORDER BY section_no, para_idx) AS body FROM lines {_LATER.format('lines')}"),
)
def sc35_body(s, d):  # noqa: ANN001, ANN201
    return _markdown(s, d, body_from_h1=True)


@query(
    "wn2_heading_ladder",
    f"""{_STYLED}, x AS (SELECT *, {_ENUM} AS class, bool_or(heading_type = 'OUTLINE' AND use_count > 0) OVER (PARTITION BY doc_id) AS outlined, min(CASE WHEN lower(trim(name)) IN ('normal', '바탕글') OR lower(trim(eng_name)) = 'normal' THEN size_pt END) OVER (PARTITION BY doc_id) AS body_pt FROM system),
c AS (SELECT * FROM x WHERE class IS NOT NULL AND use_count > 0 AND heading_type = 'NONE' AND size_pt > coalesce(body_pt, 10)),
t AS (SELECT doc_id, count(*) AS n, count(DISTINCT class) AS n_class, count(DISTINCT size_pt) AS n_size FROM c GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size_pt DESC, pos) AS rung FROM c)
SELECT doc_id, style_id, class, size_pt, rung, CASE WHEN outlined THEN 'outline in use' WHEN n < 2 THEN 'fewer than two' WHEN n_class < n THEN 'class twice' WHEN n_size < n THEN 'size twice' ELSE 'ok' END AS status FROM r JOIN t USING (doc_id) WHERE rung <= 6""",
)
def wn2(s, d):  # noqa: ANN001, ANN201
    return styles.heading_ladder(_system(s, d))


@query(
    "wn5_ladder_gaps",
    f"""{_ROLED}, h AS (SELECT r.doc_id, split_part(role, '_', 2)::BIGINT AS level, size_pt FROM roles r LEFT JOIN system s USING (doc_id, style_id) WHERE role LIKE 'HEADING_%'),
g AS (SELECT doc_id, unnest(range(min(level), max(level) + 1)) AS level FROM h GROUP BY 1)
SELECT doc_id, level, 'missing level' AS finding FROM g WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = g.doc_id AND h.level = g.level)
UNION ALL SELECT doc_id, level, 'bigger than the level above' FROM (SELECT *, last_value(size_pt IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM h) WHERE size_pt > above""",
)
def wn5(s, d):  # noqa: ANN001, ANN201
    system = _system(s, d)
    return styles.ladder_gaps(system, styles.role_map(system))


@query(
    "tk1_unmapped_styles",
    f"""{_ROLED} SELECT doc_id, style_id, use_count, CASE WHEN {_ENUM} IS NOT NULL OR heading_type IN ('OUTLINE', 'BULLET') THEN 'ladder sibling' ELSE 'structural' END AS kind, row_number() OVER (PARTITION BY doc_id ORDER BY use_count DESC, pos) AS rank
FROM system s WHERE use_count > 0 AND NOT EXISTS (SELECT 1 FROM roles r WHERE r.doc_id = s.doc_id AND r.style_id = s.style_id)""",
)
def tk1(s, d):  # noqa: ANN001, ANN201
    system = _system(s, d)
    return styles.unmapped_styles(system, styles.role_map(system))


@query(
    "pf8_heading_styles",
    f"{A.with_tables('styles')} SELECT doc_id, style_id, coalesce(heading_type = 'OUTLINE' OR (regexp_matches(lower(name), '개요|제목|heading|title|ai:h') AND NOT regexp_matches(lower(name), 'bullet|글머리')), false) AS is_heading FROM styles",
)
def pf8(s, d):  # noqa: ANN001, ANN201
    return styles.is_heading_style(A.styles(s, d))


@query("ag3_duplicate_ids", f"{A.with_tables('header_items')} SELECT doc_id, item, id, count(*) AS n FROM header_items GROUP BY ALL HAVING count(*) > 1")
def ag3(s, d):  # noqa: ANN001, ANN201
    return checks.duplicate_ids(A.header_items(s, d))


@query("ag4_wrong_counts", f"{A.with_tables('header_items')} SELECT doc_id, item, max(item_cnt) AS item_cnt, count(*) AS n FROM header_items GROUP BY 1, 2 HAVING max(item_cnt) <> count(*)")
def ag4(s, d):  # noqa: ANN001, ANN201
    return checks.wrong_counts(A.header_items(s, d))


@query("ag5_sections_without_page", f"{A.with_tables('paragraphs')} SELECT doc_id, section_no FROM paragraphs GROUP BY 1, 2 HAVING NOT bool_or(forced_break)")
def ag5(s, d):  # noqa: ANN001, ANN201
    return checks.sections_without_page(A.paragraphs(s, d), "forced_break")


@query(
    "wn6_id_order",
    f"{A.with_tables('header_items')}, b AS (SELECT *, lag(id) OVER (PARTITION BY doc_id, item ORDER BY pos) AS before FROM header_items) SELECT doc_id, item, pos, id FROM b WHERE id <> coalesce(before, -1) + 1 QUALIFY row_number() OVER (PARTITION BY doc_id, item ORDER BY pos) = 1",
)
def wn6(s, d):  # noqa: ANN001, ANN201
    return checks.id_order(A.header_items(s, d))


@query(
    "jn8_dangling_refs",
    f"""{A.with_tables("header_items", "refs")} SELECT doc_id, item, ref_id, count(*) AS n FROM refs r WHERE ref_id <> 4294967295 AND EXISTS (SELECT 1 FROM header_items h WHERE h.doc_id = r.doc_id AND h.item = r.item)
AND NOT EXISTS (SELECT 1 FROM header_items h WHERE h.doc_id = r.doc_id AND h.item = r.item AND h.id = r.ref_id) GROUP BY 1, 2, 3""",
)
def jn8(s, d):  # noqa: ANN001, ANN201
    return checks.dangling_refs(A.refs(s, d), A.header_items(s, d))


@query("pf2_stale_lines", f"{A.with_tables('paragraphs')} SELECT doc_id, section_no, para_idx, substr(text, 1, 40) AS preview FROM paragraphs WHERE line_segs >= 1 AND line_breaks + 1 > line_segs")
def pf2(s, d):  # noqa: ANN001, ANN201
    return checks.stale_lines(A.paragraphs(s, d))


_CLASSES = f"""cl AS (SELECT doc_id, sum(use_count) AS n, sum(CASE WHEN heading_type = 'OUTLINE' THEN use_count ELSE 0 END)::BIGINT AS n_outline, count(DISTINCT CASE WHEN heading_type = 'OUTLINE' AND use_count > 0 THEN outline_level END) AS n_levels,
  count(DISTINCT CASE WHEN regexp_matches({_OVERRIDE}, '^HEADING_[0-9]+$') THEN {_OVERRIDE} END) AS n_declared FROM system GROUP BY 1),
kl AS (SELECT doc_id, CASE WHEN n = 0 THEN 'flat' WHEN n_outline >= 3 AND n_levels >= 2 THEN 'structured' WHEN n_declared >= 2 THEN 'structured' WHEN n_outline = 0 THEN 'flat' ELSE 'weak' END AS c FROM cl)"""


@query(
    "st2_findings",
    f"""{_ROLED}, {A.SQL["header_items"]}, {A.SQL["refs"]}, {A.SQL["form_lines"]},\n{_CLASSES},
hd AS (SELECT r.doc_id, split_part(role, '_', 2)::BIGINT AS level, size_pt FROM roles r LEFT JOIN system s USING (doc_id, style_id) WHERE role LIKE 'HEADING_%'), gp AS (SELECT doc_id, unnest(range(min(level), max(level) + 1)) AS level FROM hd GROUP BY 1),
tk AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '\\{{\\{{\\s*([^{{}}]+?)\\s*\\}}\\}}', 1), lambda x: trim(x))) AS token FROM form_lines), tc AS (SELECT doc_id, token, count(*) AS n FROM tk GROUP BY 1, 2)
SELECT doc_id, 'not structured' AS kind, c AS "where" FROM kl WHERE c <> 'structured'
UNION ALL SELECT doc_id, 'duplicate id', id::VARCHAR FROM header_items GROUP BY doc_id, item, id HAVING count(*) > 1
UNION ALL SELECT doc_id, 'wrong count', item FROM header_items GROUP BY doc_id, item HAVING max(item_cnt) <> count(*)
UNION ALL SELECT doc_id, 'no page', section_no::VARCHAR FROM paragraphs GROUP BY doc_id, section_no HAVING NOT bool_or(forced_break)
UNION ALL SELECT doc_id, CASE WHEN token NOT IN ('t1', 't2', 't3') THEN 'unrecognized' ELSE 'ambiguous' END, token FROM tc WHERE token NOT IN ('t1', 't2', 't3') OR (n > 1 AND token <> 't3')
UNION ALL SELECT doc_id, 'missing level', level::VARCHAR FROM gp WHERE NOT EXISTS (SELECT 1 FROM hd WHERE hd.doc_id = gp.doc_id AND hd.level = gp.level)
UNION ALL SELECT doc_id, 'bigger than the level above', level::VARCHAR FROM (SELECT *, last_value(size_pt IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM hd) WHERE size_pt > above
UNION ALL SELECT doc_id, 'id order', item || ':' || pos FROM (SELECT *, lag(id) OVER (PARTITION BY doc_id, item ORDER BY pos) AS before FROM header_items) WHERE id <> coalesce(before, -1) + 1 QUALIFY row_number() OVER (PARTITION BY doc_id, item ORDER BY pos) = 1
UNION ALL SELECT DISTINCT doc_id, 'dangling reference', item || ':' || ref_id FROM refs r WHERE ref_id <> 4294967295 AND EXISTS (SELECT 1 FROM header_items h WHERE h.doc_id = r.doc_id AND h.item = r.item) AND NOT EXISTS (SELECT 1 FROM header_items h WHERE h.doc_id = r.doc_id AND h.item = r.item AND h.id = r.ref_id)
UNION ALL SELECT l_orderkey, CASE WHEN l_partkey % 7 = 0 THEN 'begin alone' ELSE 'end alone' END, pos::VARCHAR FROM {A._NUMBERED} WHERE (l_partkey % 5 <> 0) <> (l_partkey % 7 <> 0)
UNION ALL SELECT doc_id, 'stale lines', para_idx::VARCHAR FROM paragraphs WHERE line_segs >= 1 AND line_breaks + 1 > line_segs
UNION ALL SELECT doc_id, 'unmapped style', style_id FROM system s WHERE use_count > 0 AND NOT EXISTS (SELECT 1 FROM roles r WHERE r.doc_id = s.doc_id AND r.style_id = s.style_id)""",
)
def st2(s, d):  # noqa: ANN001, ANN201
    """Each source is read once or twice: lists, fields and sections are aggregated to arrays of findings, the style system is written once for its four rules."""
    system = kept(_system(s, d))
    roles = styles.role_map(system)
    return checks.findings(
        ("'not structured'", styles.classify(system).where("classification <> 'structured'"), "classification"),
        ("kind", checks.list_findings(A.header_items(s, d), A.refs(s, d)), "where"),
        ("kind", checks.paragraph_findings(A.paragraphs(s, d), "forced_break"), "where"),
        ("finding", checks.marker_warnings(checks.marker_census(A.form_lines(s, d)), ["t1", "t2"], ["t3"]), "token"),
        ("finding", styles.ladder_gaps(system, roles), "level"),
        ("kind", checks.field_findings(_fields(s, d)), "where"),
        ("'unmapped style'", styles.unmapped_styles(system, roles), "style_id"),
    )


@query(
    "ag13_page_verdicts",
    f"""{A.with_tables("verdicts")}, d AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 0 ELSE count(*) END AS page_count, CASE WHEN doc_id % 11 = 0 THEN 'no file' ELSE '' END AS error FROM verdicts GROUP BY 1),
a AS (SELECT doc_id, count(*) AS checked, bool_and(ok) AS good, string_agg(CASE WHEN NOT ok THEN page::VARCHAR END, ',' ORDER BY page) AS bad, {", ".join(f"sum(len(list_filter(issues, lambda x: x = '{t}')))::BIGINT AS n_{t}" for t in checks.ISSUES)} FROM verdicts WHERE ok IS NOT NULL GROUP BY 1)
SELECT doc_id, page_count, coalesce(checked, 0) AS checked, error = '' AND page_count > 0 AND coalesce(good, false) AS passed, coalesce(bad, '') AS problem_pages, error, {", ".join(f"coalesce(n_{t}, 0) AS n_{t}" for t in checks.ISSUES)} FROM d LEFT JOIN a USING (doc_id)""",
)
def ag13(s, d):  # noqa: ANN001, ANN201
    v, k = A.verdicts(s, d), F.col("doc_id")
    documents = v.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.when(k % 13 == 0, 0).otherwise(F.col("n")).alias("page_count"), F.when(k % 11 == 0, "no file").alias("error"))
    return checks.page_verdicts(v, documents)


_GRID = """rng AS (SELECT *, max("row") OVER (PARTITION BY doc_id, table_index) AS last_row FROM cells),
grid AS (SELECT doc_id, table_index, unnest(range("row", least("row" + row_span - 1, last_row) + 1)) AS "row", col, text FROM rng)"""


@query("sc32_full_grid", f"{A.with_tables('cells')},\n{_GRID} SELECT * FROM grid")
def sc32_grid(s, d):  # noqa: ANN001, ANN201
    return forms.full_grid(A.cells(s, d))


@query(
    "sc32_pipe_tables",
    f"""{A.with_tables("cells")},\n{_GRID}, r AS (SELECT doc_id, table_index, "row", '| ' || string_agg(replace(replace(text, '|', '\\|'), chr(10), '<br>'), ' | ' ORDER BY col, text) || ' |' AS line, '|' || repeat('---|', count(*)::INT) AS rule FROM grid GROUP BY 1, 2, 3)
SELECT doc_id, table_index, string_agg(CASE WHEN "row" = 0 THEN line || chr(10) || rule ELSE line END, chr(10) ORDER BY "row") AS markdown FROM r GROUP BY 1, 2""",
)
def sc32(s, d):  # noqa: ANN001, ANN201
    return forms.pipe_tables(A.cells(s, d))


_TARGETS = """g AS (SELECT *, count(*) OVER (PARTITION BY doc_id, table_index, "row") AS n, count(*) OVER (PARTITION BY doc_id, table_index, "row", text) AS same,
  CASE WHEN lead(col) OVER a = col + 1 THEN lead(text) OVER a END AS r, CASE WHEN lead("row") OVER b = "row" + 1 THEN lead(text) OVER b END AS b
  FROM grid WINDOW a AS (PARTITION BY doc_id, table_index, "row" ORDER BY col), b AS (PARTITION BY doc_id, table_index, col ORDER BY "row")),
targets AS (SELECT * FROM (SELECT doc_id, table_index, "row", col, text, CASE WHEN trim(r) = '' THEN 'right' WHEN trim(b) = '' AND NOT (n >= 3 AND same >= n - 1) THEN 'below' END AS side FROM g
  WHERE length(trim(text)) BETWEEN 1 AND 20 AND right(trim(text), 1) NOT IN ('.', '?', '!') AND NOT regexp_matches(trim(text), '^[0-9.,/\\-\\s]+$')) WHERE side IS NOT NULL)"""


@query("jn2_label_targets", f"{A.with_tables('cells')},\n{_GRID},\n{_TARGETS} SELECT * FROM targets")
def jn2(s, d):  # noqa: ANN001, ANN201
    return forms.label_targets(A.cells(s, d))


def _asked(s: SparkSession, d: str) -> DataFrame:
    return A.read(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 2 == 0, "금 액").otherwise("상태").alias("label"), F.when(F.col("o_orderkey") % 5 == 0, "down").otherwise("right").alias("direction"))


@query(
    "jn7_labelled_cell",
    f"""{A.with_tables("cells")},\n{_GRID}, asked AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN '금액' ELSE '상태' END AS label, CASE WHEN o_orderkey % 5 = 0 THEN 'down' ELSE 'right' END AS direction FROM orders),
f AS (SELECT doc_id, table_index, "row", col, text AS label FROM cells QUALIFY count(*) OVER (PARTITION BY doc_id, text) = 1),
t AS (SELECT a.*, f.table_index, f."row" + (direction = 'down')::INT AS "row", f.col + (direction = 'right')::INT AS col FROM asked a LEFT JOIN f USING (doc_id, label))
SELECT t.doc_id, label, direction, t.table_index, t."row", t.col, g.text AS value FROM t LEFT JOIN grid g ON g.doc_id = t.doc_id AND g.table_index = t.table_index AND g."row" = t."row" AND g.col = t.col""",
)
def jn7(s, d):  # noqa: ANN001, ANN201
    return forms.labelled_cell(A.cells(s, d), _asked(s, d))


@query(
    "ag9_column_content",
    f"""{A.with_tables("cells")} SELECT doc_id, table_index, col, sum(length(text) / col_span)::DOUBLE AS volume, max(list_max(list_transform(regexp_split_to_array(text, '\\s+'), lambda w: length(w))))::BIGINT AS longest FROM cells GROUP BY 1, 2, 3""",
)
def ag9(s, d):  # noqa: ANN001, ANN201
    return forms.column_content(A.cells(s, d))


@query(
    "ag10_column_widths",
    f"""{A.with_tables("cells")}, c AS (SELECT doc_id, table_index, col, sum(length(text))::DOUBLE AS volume, max(list_max(list_transform(regexp_split_to_array(text, '\\s+'), lambda w: length(w))))::BIGINT AS longest FROM cells GROUP BY 1, 2, 3),
l AS (SELECT *, least(greatest(1500, longest * 1100), 42000) AS lo FROM c), k AS (SELECT *, sum(lo) OVER t AS s FROM l WINDOW t AS (PARTITION BY doc_id, table_index)),
m AS (SELECT *, CASE WHEN s > 42000 THEN floor(lo * 42000.0::DOUBLE / s)::BIGINT ELSE lo END AS lo2 FROM k),
r AS (SELECT *, 42000 - sum(lo2) OVER t AS rest, sqrt(volume) AS root, sum(sqrt(volume)) OVER t AS roots, count(*) OVER t AS n FROM m WINDOW t AS (PARTITION BY doc_id, table_index)),
w AS (SELECT *, lo2 + CASE WHEN roots > 0 THEN floor(rest::DOUBLE * root / roots) ELSE floor(rest::DOUBLE / n) END AS w FROM r)
SELECT doc_id, table_index, col, (w + CASE WHEN row_number() OVER (PARTITION BY doc_id, table_index ORDER BY w DESC, col) = 1 THEN 42000 - sum(w) OVER (PARTITION BY doc_id, table_index) ELSE 0 END)::BIGINT AS width FROM w""",
)
def ag10(s, d):  # noqa: ANN001, ANN201
    return forms.column_widths(forms.column_content(A.cells(s, d)), 42000)


_HEADINGS = "kind = 'heading' AND level = 1"


@query("pf5_body_only", f"{A.with_tables('md_blocks')}, f AS (SELECT *, min(CASE WHEN {_HEADINGS} THEN ord END) OVER (PARTITION BY doc_id) AS f FROM md_blocks) SELECT doc_id, ord, kind, text FROM f WHERE ord >= f")
def pf5(s, d):  # noqa: ANN001, ANN201
    return markdown.body_only(A.md_blocks(s, d), _HEADINGS, "ord").select("doc_id", "ord", "kind", "text")


_CAPTIONS = f"""ch AS (SELECT *, sum(({_HEADINGS})::INT) OVER (PARTITION BY doc_id ORDER BY ord) AS chapter FROM md_blocks),
lb AS (SELECT *, max(CASE WHEN {_HEADINGS} THEN nullif(regexp_extract(text, '^\\s*([IVXⅠ-Ⅻ]+|[0-9]+)\\s*[.)]', 1), '') END) OVER (PARTITION BY doc_id, chapter) AS cl FROM ch),
captions AS (SELECT doc_id, ord, kind, label, row_number() OVER (PARTITION BY doc_id, chapter, kind ORDER BY ord) AS no, cl FROM lb WHERE kind IN ('table', 'figure') AND NOT plain_cell),
numbered AS (SELECT doc_id, ord, kind, label, no, CASE kind WHEN 'table' THEN '표 ' ELSE '그림 ' END || coalesce(cl || '-', '') || no AS number FROM captions)"""


@query("wn7_caption_numbers", f"{A.with_tables('md_blocks')},\n{_CAPTIONS} SELECT * FROM numbered")
def wn7(s, d):  # noqa: ANN001, ANN201
    return markdown.caption_numbers(A.md_blocks(s, d))


_RESOLVED = """asked AS (SELECT doc_id, ord, 0::BIGINT AS i, regexp_extract(text, '\\{ref:([^{}\\s]+)\\}', 1) AS label FROM md_blocks WHERE contains(text, '{ref:')),
firsts AS (SELECT doc_id, label, arg_min(number, ord) AS number FROM numbered WHERE label IS NOT NULL GROUP BY 1, 2), resolved AS (SELECT a.*, f.number FROM asked a LEFT JOIN firsts f USING (doc_id, label))"""


@query("jn10_references", f"{A.with_tables('md_blocks')},\n{_CAPTIONS},\n{_RESOLVED} SELECT doc_id, ord, i, label, number FROM resolved")
def jn10(s, d):  # noqa: ANN001, ANN201
    b = A.md_blocks(s, d)
    return markdown.resolve_references(b, markdown.caption_numbers(b))


@query("jn10_referenced_text", f"{A.with_tables('md_blocks')},\n{_CAPTIONS},\n{_RESOLVED} SELECT b.doc_id, b.ord, CASE WHEN number IS NULL THEN text ELSE replace(text, '{{ref:' || r.label || '}}', number) END AS text FROM md_blocks b LEFT JOIN resolved r ON r.doc_id = b.doc_id AND r.ord = b.ord")
def jn10_text(s, d):  # noqa: ANN001, ANN201
    b = A.md_blocks(s, d)
    return markdown.referenced_text(b, markdown.resolve_references(b, markdown.caption_numbers(b)))


@query("wn9_heading_gaps", f"{A.with_tables('md_blocks')}, b AS (SELECT *, lag(kind) OVER o AS k, lag(level) OVER o AS l FROM md_blocks WINDOW o AS (PARTITION BY doc_id ORDER BY ord)) SELECT doc_id, ord, k IS NOT NULL AND NOT coalesce(k = 'heading' AND l < level AND blank_before = 0, false) AS gap FROM b WHERE kind = 'heading'")
def wn9(s, d):  # noqa: ANN001, ANN201
    return markdown.heading_gaps(A.md_blocks(s, d))


@query(
    "jn17_running_titles",
    f"{A.with_tables('md_blocks')}, t AS (SELECT doc_id, 0::BIGINT AS section_no, ord AS para_idx, last_value(CASE WHEN {_HEADINGS} THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS title FROM md_blocks) SELECT * FROM t WHERE title IS NOT NULL",
)
def jn17(s, d):  # noqa: ANN001, ANN201
    return markdown.running_titles(A.md_blocks(s, d).select("doc_id", F.lit(0).cast("long").alias("section_no"), F.col("ord").alias("para_idx"), "text", F.expr(_HEADINGS).alias("is_h1")))


@query(
    "jn11_block_styles",
    f"""{_ROLED}, {A.SQL["md_blocks"]}, have AS (SELECT doc_id, style_id, lower(split_part(role, '_', 1)) AS kind, split_part(role, '_', 2)::BIGINT AS n FROM roles WHERE regexp_matches(role, '^(HEADING|BULLET)_[0-9]+$')),
lv AS (SELECT doc_id, kind, list_sort(list(DISTINCT n)) AS levels FROM have GROUP BY 1, 2), bd AS (SELECT doc_id, style_id AS body_style FROM roles WHERE role = 'BODY'),
b AS (SELECT m.*, CASE kind WHEN 'heading' THEN least(level, list_max(levels)) ELSE levels[least(greatest(level, 0) + 1, len(levels))] END AS n FROM md_blocks m LEFT JOIN lv USING (doc_id, kind))
SELECT b.doc_id, ord, kind, coalesce(h.style_id, body_style) AS style_id, h.style_id IS NULL AND kind IN ('heading', 'bullet') AS fallback FROM b LEFT JOIN have h USING (doc_id, kind, n) LEFT JOIN bd USING (doc_id)""",
)
def jn11(s, d):  # noqa: ANN001, ANN201
    return markdown.block_styles(A.md_blocks(s, d), styles.role_map(_system(s, d)))


@query(
    "wn16_preview",
    f"""{A.with_tables("paragraphs")}, p AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY section_no, para_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM paragraphs WHERE trim(text) <> '')
SELECT doc_id, string_agg(text, chr(13) || chr(10) ORDER BY section_no, para_idx) AS preview FROM p WHERE before < 2000 GROUP BY 1""",
)
def wn16(s, d):  # noqa: ANN001, ANN201
    return markdown.preview(A.paragraphs(s, d))


@query(
    "pf7_fit_candidates",
    f"""{_STYLED} SELECT doc_id, section_no, para_idx FROM paragraphs p WHERE NOT in_cell AND NOT in_note AND plain_runs AND kind = 'text' AND text <> '' AND NOT EXISTS (SELECT 1 FROM styles s WHERE s.doc_id = p.doc_id AND s.style_id = p.style_id
  AND (heading_type = 'OUTLINE' OR (regexp_matches(lower(name), '개요|제목|heading|title|ai:h') AND NOT regexp_matches(lower(name), 'bullet|글머리'))))""",
)
def pf7(s, d):  # noqa: ANN001, ANN201
    return layout.fit_candidates(A.paragraphs(s, d), styles.is_heading_style(A.styles(s, d))).select("doc_id", "section_no", "para_idx")


@query(
    "sc28_tail_fit",
    f"""WITH x AS (SELECT l_orderkey, pos, qty + 10 AS total, qty % 5 AS tail, CASE WHEN qty % 5 > 0 THEN ceil(100.0 * (qty % 5) / (qty + 10)) END AS steps FROM {A._NUMBERED})
SELECT l_orderkey AS doc_id, pos, total, tail, CASE WHEN tail > 0 THEN -least(steps, 5) ELSE 0 END::BIGINT AS spacing, CASE WHEN tail > 0 THEN 100 - least(steps - least(steps, 5), 5) ELSE 100 END::BIGINT AS ratio, coalesce(tail > 0 AND steps <= 10, false) AS fittable FROM x""",
)
def sc28(s, d):  # noqa: ANN001, ANN201
    x = A._numbered(s, d).select(F.col("l_orderkey").alias("doc_id"), "pos", (F.col("qty") + 10).alias("total"), (F.col("qty") % 5).alias("tail"))
    return x.withColumn("f", T.tail_fit(F.col("total"), F.col("tail"), F.lit(0), F.lit(100))).select("doc_id", "pos", "total", "tail", "f.*")


def _lines(s: SparkSession, d: str) -> DataFrame:
    x = A._numbered(s, d)
    return x.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).cast("long").alias("section_no"), F.col("pos").alias("para_idx"), F.lit(0).cast("long").alias("line_no"), ((F.col("pos") * 1600 + F.col("qty") * 100) % 7000).alias("vertpos"), F.lit(1000).cast("long").alias("vertsize"), (F.col("l_partkey") % 11 == 0).alias("forced_break"))


_PAGED = f"""lines AS (SELECT l_orderkey AS doc_id, 0::BIGINT AS section_no, pos AS para_idx, 0::BIGINT AS line_no, (pos * 1600 + qty * 100) % 7000 AS vertpos, 1000::BIGINT AS vertsize, l_partkey % 11 = 0 AS forced_break FROM {A._NUMBERED}),
cuts AS (SELECT *, coalesce(vertpos < lag(vertpos) OVER o OR (forced_break AND lag(vertpos) OVER o IS NOT NULL), false)::INT AS cut FROM lines WINDOW o AS (PARTITION BY doc_id ORDER BY para_idx)),
paged AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY para_idx)::BIGINT AS page FROM cuts),
boxes AS (SELECT doc_id, section_no, page, max(vertpos + vertsize) AS bottom, count(*) AS n_lines, min(para_idx) AS first_para FROM paged GROUP BY 1, 2, 3)"""


@query("wn12_page_boxes", f"WITH {_PAGED} SELECT * FROM boxes")
def wn12(s, d):  # noqa: ANN001, ANN201
    return layout.page_boxes(_lines(s, d))


@query(
    "wn13_page_gaps",
    f"""WITH {_PAGED}, g AS (SELECT *, round((8000 - bottom) * 100.0::DOUBLE / 8000, 2) AS gap_pct, lead(n_lines) OVER (PARTITION BY doc_id ORDER BY page) AS nx FROM boxes)
SELECT doc_id, section_no, page, gap_pct, CASE WHEN gap_pct <= 10 THEN 'full' WHEN nx <= 3 THEN 'pull' ELSE 'gap' END AS kind FROM g WHERE nx IS NOT NULL""",
)
def wn13(s, d):  # noqa: ANN001, ANN201
    return layout.page_gaps(layout.page_boxes(_lines(s, d)), 8000)


@query(
    "wn10_page_signatures",
    f"""{A.with_tables("page_images")}, e AS (SELECT doc_id, page, unnest(hashes) AS h FROM page_images), n AS (SELECT doc_id, h FROM e GROUP BY 1, 2 HAVING count(DISTINCT page) >= 2)
SELECT p.doc_id, p.page, coalesce(string_agg(DISTINCT n.h, ',' ORDER BY n.h), '') AS signature FROM page_images p LEFT JOIN e ON e.doc_id = p.doc_id AND e.page = p.page LEFT JOIN n ON n.doc_id = e.doc_id AND n.h = e.h GROUP BY 1, 2""",
)
def wn10(s, d):  # noqa: ANN001, ANN201
    return media.recurring_hashes(A.page_images(s, d))


@query(
    "wn11_bands",
    f"""{A.with_tables("page_images").replace("WITH ", "WITH RECURSIVE ")}, e AS (SELECT doc_id, page, unnest(hashes) AS h FROM page_images), hn AS (SELECT doc_id, h FROM e GROUP BY 1, 2 HAVING count(DISTINCT page) >= 2),
sg AS (SELECT p.doc_id, p.page, coalesce(string_agg(DISTINCT hn.h, ',' ORDER BY hn.h), '') AS sig, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.page) AS i FROM page_images p LEFT JOIN e ON e.doc_id = p.doc_id AND e.page = p.page LEFT JOIN hn ON hn.doc_id = e.doc_id AND hn.h = e.h GROUP BY 1, 2),
st AS (SELECT *, coalesce(sig = lag(sig, 2) OVER o AND sig <> lag(sig) OVER o, false) AS goes_on, coalesce(lead(sig) OVER o <> sig, false) AS differs, count(*) OVER (PARTITION BY doc_id) AS n FROM sg WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
en AS (SELECT *, coalesce(min(CASE WHEN NOT goes_on THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 FOLLOWING AND UNBOUNDED FOLLOWING) - 1, n) AS j FROM st),
wk AS (SELECT doc_id, 1::BIGINT AS i FROM en WHERE i = 1 UNION ALL SELECT wk.doc_id, CASE WHEN differs AND j - en.i >= 3 THEN j + 1 ELSE en.i + 1 END FROM wk JOIN en ON en.doc_id = wk.doc_id AND en.i = wk.i),
rn AS (SELECT en.doc_id, en.i AS a, j AS z FROM wk JOIN en ON en.doc_id = wk.doc_id AND en.i = wk.i WHERE differs AND j - en.i >= 3),
mg AS (SELECT en.doc_id, page, en.i, rn.a, CASE WHEN rn.a IS NULL THEN sig ELSE (SELECT coalesce(string_agg(DISTINCT x, ',' ORDER BY x), '') FROM (SELECT unnest(string_split(f.sig, ',')) AS x FROM en f WHERE f.doc_id = en.doc_id AND f.i BETWEEN rn.a AND rn.z) WHERE x <> '') END AS sig FROM en LEFT JOIN rn ON rn.doc_id = en.doc_id AND en.i BETWEEN rn.a AND rn.z),
ct AS (SELECT *, (coalesce(sig <> lag(sig) OVER o, true) OR a IS DISTINCT FROM lag(a) OVER o)::INT AS cut FROM mg WINDOW o AS (PARTITION BY doc_id ORDER BY i)), bn AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS band FROM ct),
bs AS (SELECT doc_id, band, sig, min(page) AS first_page, max(page) AS last_page FROM bn GROUP BY 1, 2, 3), sn AS (SELECT doc_id, sig, min(first_page) AS seen FROM bs WHERE sig <> '' GROUP BY 1, 2), lt AS (SELECT doc_id, sig, row_number() OVER (PARTITION BY doc_id ORDER BY seen) - 1 AS k FROM sn)
SELECT doc_id, first_page, last_page, CASE WHEN k IS NULL THEN '—' ELSE CASE WHEN k >= 26 THEN chr(64 + (k // 26)::INT) ELSE '' END || chr(65 + (k % 26)::INT) END AS letter, count(*) OVER (PARTITION BY doc_id) > 1 AND count(k) OVER (PARTITION BY doc_id) > 0 AS decidable FROM bs LEFT JOIN lt USING (doc_id, sig)""",
)
def wn11(s, d):  # noqa: ANN001, ANN201
    return media.bands(media.recurring_hashes(A.page_images(s, d)))


_SPANNED = r"""sp AS (SELECT doc_id, section_no, para_idx, length(text) AS n, CASE WHEN length(text) % 3 = 0 THEN 'see https://a.kr/x and $a_1$ ' ELSE '$5 and $10 $x$ ' END AS t FROM paragraphs)"""


@query(
    "ag15_link_census",
    f"""{A.with_tables("paragraphs")}, {_SPANNED}, k AS (SELECT l_orderkey AS doc_id, count(*) AS n FROM {A._NUMBERED} WHERE l_partkey % 5 <> 0 AND pos % 2 = 0 GROUP BY 1)
SELECT doc_id, coalesce(k.n, 0) AS n_links, count(*) FILTER (sp.n % 3 = 0) AS n_bare, sum(sp.n % 2)::BIGINT AS n_equations, coalesce(string_agg(CASE WHEN sp.n % 3 = 0 THEN 'a_1' END, ','), '') AS latex_left FROM sp LEFT JOIN k USING (doc_id) GROUP BY 1, 2""",
)
def ag15(s, d):  # noqa: ANN001, ANN201
    n = F.length("text")
    p = A.paragraphs(s, d).select("doc_id", "section_no", "para_idx", (n % 2).alias("equations"), F.when(n % 3 == 0, "see https://a.kr/x and $a_1$ ").otherwise("$5 and $10 $x$ ").alias("text"))
    fields = _fields(s, d).withColumn("field_type", F.when(F.col("field_id").cast("long") % 2 == 0, "HYPERLINK").otherwise("CLICK"))
    return media.link_census(fields, p).withColumn("latex_left", F.array_join("latex_left", ","))


_LATEST = "latest AS (SELECT * FROM revisions QUALIFY row_number() OVER (PARTITION BY name ORDER BY modified_time DESC, file_id DESC) = 1), state AS (SELECT * FROM revisions WHERE confirmed QUALIFY row_number() OVER (PARTITION BY name ORDER BY modified_time DESC, file_id DESC) = 1)"


@query(
    "sm1_revision_changes",
    f"{A.with_tables('revisions')}, {_LATEST} SELECT coalesce(l.name, s.name) AS name, CASE WHEN l.name IS NULL THEN 'disappeared' WHEN s.name IS NULL THEN 'new' WHEN l.modified_time <> s.modified_time THEN 'changed' ELSE 'same' END AS status FROM latest l FULL JOIN state s ON l.name = s.name",
)
def sm1(s, d):  # noqa: ANN001, ANN201
    r = A.revisions(s, d)
    return revisions.changes(r, revisions.latest(r.where("confirmed")))


def _forms(r: DataFrame) -> DataFrame:
    return revisions.latest(r).withColumn("classification", F.when(F.col("file_id") % 3 == 0, "flat").otherwise("structured"))


@query(
    "sm2_regressions",
    f"""{A.with_tables("revisions")}, {_LATEST}, j AS (SELECT l.name, s.file_id % 3 <> 0 AND l.file_id % 3 = 0 AS lost, s.declarations > 0 AND l.declarations < s.declarations AS fewer FROM latest l JOIN state s ON l.name = s.name)
SELECT name, CASE WHEN lost THEN 'no longer structured' ELSE 'fewer declarations' END AS finding FROM j WHERE lost OR fewer""",
)
def sm2(s, d):  # noqa: ANN001, ANN201
    r = A.revisions(s, d)
    return revisions.regressions(_forms(r), _forms(r.where("confirmed")))


@query(
    "sm1_rerun_set",
    f"""{A.with_tables("revisions")}, {_LATEST}, c AS (SELECT l.name, s.name IS NULL OR l.modified_time <> s.modified_time AS changed FROM latest l LEFT JOIN state s ON l.name = s.name) SELECT name, changed FROM c WHERE (SELECT bool_or(changed) FROM c)""",
)
def sm1_rerun(s, d):  # noqa: ANN001, ANN201
    return revisions.rerun_set(sm1(s, d))


@query(
    "sm1_keyed_stream",
    f"""{A.with_tables("revisions")}, {_LATEST}, m AS (SELECT name, max(modified_time) AS seen, epoch_ms(max(modified_time)::TIMESTAMP) + 86400000 < (SELECT epoch_ms(max(modified_time)::TIMESTAMP) FROM revisions) AS gone FROM revisions GROUP BY 1)
SELECT m.name, CASE WHEN gone THEN 'disappeared' WHEN s.name IS NULL THEN 'new' WHEN seen <> s.modified_time THEN 'changed' ELSE 'same' END AS status, CASE WHEN NOT gone THEN seen END AS modified_time, s.modified_time AS confirmed_time, s.declarations FROM m LEFT JOIN state s ON s.name = m.name""",
)
def sm1_stream(s, d):  # noqa: ANN001, ANN201
    """The revisions as a stream: every one is a listing, the confirmed ones are taken over at once."""
    A.revisions(s, d).write.parquet(source := shared_folder(s))
    r = s.readStream.schema(A.revisions(s, d).schema).parquet(source).withColumn("at", F.to_timestamp("modified_time"))
    kinds = F.explode(F.when(F.col("confirmed"), F.array(F.lit("listed"), F.lit("confirmed"))).otherwise(F.array(F.lit("listed"))))
    events = r.select("name", kinds.alias("kind"), "at", F.col("file_id").cast("string").alias("file_id"), "modified_time", F.lit(None).cast("string").alias("classification"), "declarations")
    log = shared_folder(s)
    revisions.followed(revisions.follow(events, late="0 seconds"), log, shared_folder(s)).awaitTermination()
    return revisions.standing(s, log).select("name", "status", "modified_time", "confirmed_time", "declarations")


@query("snk3_confirmed_state", f"{A.with_tables('revisions')}, {_LATEST}, ok AS (SELECT * FROM latest WHERE declarations > 0) SELECT name, modified_time FROM ok UNION ALL SELECT name, modified_time FROM state WHERE name NOT IN (SELECT name FROM ok)")
def snk3(s, d):  # noqa: ANN001, ANN201
    r = A.revisions(s, d)
    return revisions.confirmed_state(revisions.latest(r.where("confirmed")).select("name", "modified_time"), revisions.latest(r).where("declarations > 0").select("name", "modified_time"))


@query("wn14_depth_ladder", f"{A.with_tables('paragraphs')} SELECT doc_id, section_no, indent, dense_rank() OVER (PARTITION BY doc_id, section_no ORDER BY indent) AS depth FROM (SELECT DISTINCT doc_id, section_no, length(text) % 5 * 100 AS indent FROM paragraphs)")
def wn14(s, d):  # noqa: ANN001, ANN201
    return layout.depth_ladder(A.paragraphs(s, d).withColumn("indent", (F.length("text") % 5 * 100).cast("long")))


def _needles(s: SparkSession, d: str) -> DataFrame:
    return A.read(s, d, "documents").select(F.col("doc_id").alias("request_id"), "doc_id", F.substring("text", 1, 3).alias("needle"), F.when(F.col("doc_id") % 3 == 0, 2).cast("long").alias("occurrence"))


_ANCHORS = "needles AS (SELECT doc_id AS request_id, doc_id, substr(text, 1, 3) AS needle, CASE WHEN doc_id % 3 = 0 THEN 2 END AS occurrence FROM documents), anchors AS (SELECT request_id, p.doc_id, section_no, para_idx FROM paragraphs p JOIN needles n USING (doc_id) WHERE contains(text, needle))"


@query("pf1_anchors", f"{A.with_tables('paragraphs')}, {_ANCHORS} SELECT * FROM anchors")
def pf1(s, d):  # noqa: ANN001, ANN201
    return edits.find_anchors(A.paragraphs(s, d), _needles(s, d).drop("occurrence"))


@query(
    "jn18_picked_anchors",
    f"""{A.with_tables("paragraphs")}, {_ANCHORS}, a AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY section_no, para_idx) AS no, count(*) OVER (PARTITION BY request_id) AS n FROM anchors),
r AS (SELECT request_id, occurrence, coalesce(max(n), 0) AS n FROM needles LEFT JOIN a USING (request_id) GROUP BY 1, 2),
t AS (SELECT *, CASE WHEN n = 0 THEN 'not found' WHEN occurrence IS NULL AND n > 1 THEN 'ambiguous' WHEN coalesce(occurrence, 1) > n THEN 'no such occurrence' ELSE 'ok' END AS status FROM r)
SELECT t.request_id, status, CASE WHEN status = 'ok' THEN section_no END AS section_no, CASE WHEN status = 'ok' THEN para_idx END AS para_idx FROM t LEFT JOIN a ON a.request_id = t.request_id AND a.no = coalesce(occurrence, 1)""",
)
def jn18(s, d):  # noqa: ANN001, ANN201
    n = _needles(s, d)
    return edits.pick_anchor(edits.find_anchors(A.paragraphs(s, d), n.drop("occurrence")), n.select("request_id", "occurrence"))


def _strings(s: SparkSession, d: str) -> DataFrame:
    return A.md_blocks(s, d).where("kind = 'heading'").select("doc_id", "ord", "text")


def _scalar(name: str, sql: str, rule: Callable[[Column], Column], kind: str | None = None) -> None:
    @query(name, f"{A.with_tables('md_blocks')} SELECT doc_id, ord, {sql} AS value FROM md_blocks WHERE kind = 'heading'")
    def run(s, d):  # noqa: ANN001, ANN202
        v = rule(F.col("text"))
        return _strings(s, d).select("doc_id", "ord", (v.cast(kind) if kind else v).alias("value"))


_PY_NUMBER = T.HEADING_NUMBER.replace("'", "''")
_scalar("sc10_heading_number", f"coalesce(nullif(trim(regexp_replace(text, '{_PY_NUMBER}', '\\1')), ''), text)", T.strip_heading_number)
_scalar("sc11_chapter_label", "nullif(regexp_extract(text, '^\\s*([IVXⅠ-Ⅻ]+|[0-9]+)\\s*[.)]', 1), '')", T.chapter_label)
_scalar("sc3_without_space", "regexp_replace(text, '\\s+', '', 'g')", T.without_space)
_scalar("sc3_caption_key", "trim(regexp_replace(text, '\\s+', ' ', 'g'))", T.caption_key)
_scalar("pf9_label_shape", "length(text) BETWEEN 1 AND 20 AND right(text, 1) NOT IN ('.', '?', '!') AND NOT regexp_matches(text, '^[0-9.,/\\-\\s]+$')", T.is_label_shaped)
_scalar("sc26_em_width", "round(length(regexp_replace(text, '[^\\x{1100}-\\x{10FFFF}]', '', 'g')) + (length(text) - length(regexp_replace(text, '[^\\x{1100}-\\x{10FFFF}]', '', 'g'))) * 0.55::DOUBLE, 2)", lambda c: F.round(T.em_width(c), 2))
_scalar("sc2_normalize_label", "replace(lower(regexp_replace(nfc_normalize(text), '[^\\pL\\pN]', '', 'g')), 'ß', 'ss')", T.normalize_label)


@query("sc7_enumerator_class", f"{A.with_tables('styles')} SELECT doc_id, style_id, {_ENUM} AS class FROM styles")
def sc7(s, d):  # noqa: ANN001, ANN201
    return A.styles(s, d).select("doc_id", "style_id", T.enumerator_class(F.col("name")).alias("class"))


@query("sc9_role_override", f"{A.with_tables('styles')} SELECT doc_id, style_id, {_OVERRIDE} AS role FROM styles")
def sc9(s, d):  # noqa: ANN001, ANN201
    return A.styles(s, d).select("doc_id", "style_id", T.role_override(F.col("name"), F.col("eng_name")).alias("role"))


@query("sc13_kdate", "SELECT o_orderkey, year(o_orderdate) || '. ' || month(o_orderdate) || '. ' || day(o_orderdate) || '.' AS value FROM orders")
def sc13(s, d):  # noqa: ANN001, ANN201
    return A.read(s, d, "orders").select("o_orderkey", T.kdate(F.col("o_orderdate")).alias("value"))


@query("sc17_url_command", "SELECT page_id, regexp_replace(url, '([\\\\:;])', '\\\\\\1', 'g') || ';1;0;2;' AS command, url AS decoded FROM pages")
def sc17(s, d):  # noqa: ANN001, ANN201
    c = A.read(s, d, "pages").select("page_id", T.url_to_command(F.col("url")).alias("command"))
    return c.withColumn("decoded", T.command_to_url(F.col("command")))


@query("sc25_fitted_height", "SELECT p_partkey, round_even(p_size * 1000.0 * (1 + p_partkey % 7) / (3 + p_partkey % 5), 0)::BIGINT AS height FROM part")
def sc25(s, d):  # noqa: ANN001, ANN201
    return A.read(s, d, "part").select("p_partkey", T.fitted_height(F.col("p_size") * 1000.0, 3 + F.col("p_partkey") % 5, 1 + F.col("p_partkey") % 7).alias("height"))


_TOKENS = r"""list_transform(regexp_extract_all(text, '\{\{\s*([^{}]+?)\s*\}\}', 1), lambda x: trim(x))"""


@query("ag6_marker_census", f"{A.with_tables('form_lines')}, e AS (SELECT doc_id, section_no, unnest({_TOKENS}) AS token FROM form_lines) SELECT doc_id, section_no, token, count(*) AS n FROM e GROUP BY 1, 2, 3")
def ag6(s, d):  # noqa: ANN001, ANN201
    return checks.marker_census(A.form_lines(s, d))


@query(
    "ag7_marker_warnings",
    f"""{A.with_tables("form_lines")}, e AS (SELECT doc_id, unnest({_TOKENS}) AS token FROM form_lines), c AS (SELECT doc_id, token, count(*) AS n FROM e GROUP BY 1, 2)
SELECT doc_id, token, n::BIGINT AS n, CASE WHEN token NOT IN ('t1', 't2', 't3') THEN 'unrecognized' ELSE 'ambiguous' END AS finding FROM c WHERE token NOT IN ('t1', 't2', 't3') OR (n > 1 AND token <> 't3')""",
)
def ag7(s, d):  # noqa: ANN001, ANN201
    return checks.marker_warnings(checks.marker_census(A.form_lines(s, d)), ["t1", "t2"], ["t3"])


@query("ag8_residual_tokens", f"{A.with_tables('form_lines')} SELECT DISTINCT doc_id, unnest({_TOKENS}) AS token FROM form_lines")
def ag8(s, d):  # noqa: ANN001, ANN201
    return checks.residual_tokens(A.form_lines(s, d))


@query("sc1_placeholders", f"{A.with_tables('form_lines')} SELECT doc_id, para_idx, array_to_string(list_distinct({_TOKENS}), ',') AS tokens FROM form_lines")
def sc1(s, d):  # noqa: ANN001, ANN201
    return A.form_lines(s, d).select("doc_id", "para_idx", F.array_join(T.placeholders(F.col("text")), ",").alias("tokens"))


@query("sc4_label_lines", f"{A.with_tables('form_lines')} SELECT doc_id, para_idx, nullif(regexp_extract(text, '^\\s*[□■○●\\-–—ㆍ·*]?\\s*([^:：\\n]+?)\\s*[:：][\\s.~·\\-년월일]*$', 1), '') AS label FROM form_lines")
def sc4(s, d):  # noqa: ANN001, ANN201
    return A.form_lines(s, d).select("doc_id", "para_idx", T.label_line(F.col("text")).alias("label"))


@query("sc5_checkboxes", f"{A.with_tables('form_lines')} SELECT doc_id, para_idx, regexp_extract(text, '☑ (\\S+)', 1) AS label, 'on' AS state FROM form_lines WHERE contains(text, '☑')")
def sc5(s, d):  # noqa: ANN001, ANN201
    return A.form_lines(s, d).select("doc_id", "para_idx", F.explode(T.checkboxes(F.col("text"))).alias("c")).select("doc_id", "para_idx", "c.label", "c.state")


@query("sc6_toggled", f"{A.with_tables('form_lines')} SELECT doc_id, para_idx, replace(text, '☑ agree0', '☐ agree0') AS text FROM form_lines")
def sc6(s, d):  # noqa: ANN001, ANN201
    return A.form_lines(s, d).select("doc_id", "para_idx", T.toggled(F.col("text"), "agree0", on=False).alias("text"))


@query("sc31_tab_slots", f"{A.with_tables('form_lines')} SELECT doc_id, para_idx, trim(string_split(text, chr(9))[1]) AS label, array_to_string(string_split(text, chr(9))[2:], '/') AS tails FROM form_lines WHERE contains(text, chr(9))")
def sc31(s, d):  # noqa: ANN001, ANN201
    t = A.form_lines(s, d).select("doc_id", "para_idx", T.tab_slots(F.col("text")).alias("s")).where("s is not null")
    return t.select("doc_id", "para_idx", "s.label", F.array_join("s.tails", "/").alias("tails"))


_SLOTTED = """p AS (SELECT *, nullif(regexp_extract(text, '^\\s*□?\\s*([^:\\n]+?)\\s*:[\\s.~·\\-]*$', 1), '') AS label, lead(text = '') OVER o AS ne, lead(has_table) OVER o AS nt FROM form_lines WINDOW o AS (PARTITION BY doc_id, section_no ORDER BY para_idx)),
sl AS (SELECT doc_id, CASE WHEN ne THEN 'section' ELSE 'label' END AS kind, label AS name, section_no, para_idx FROM p WHERE label IS NOT NULL AND NOT coalesce(nt, false) QUALIFY row_number() OVER (PARTITION BY doc_id, CASE WHEN ne THEN 'section' ELSE 'label' END, label ORDER BY section_no, para_idx) = 1)"""


@query("wn15_section_slots", f"{A.with_tables('form_lines')},\n{_SLOTTED} SELECT * FROM sl")
def wn15(s, d):  # noqa: ANN001, ANN201
    return forms.section_slots(A.form_lines(s, d))


@query(
    "tk2_insertion_marker",
    f"""{A.with_tables("form_lines")}, e AS (SELECT doc_id, section_no, para_idx, unnest(list_concat({_TOKENS}, [''])) AS token FROM form_lines), f AS (SELECT *, CASE token WHEN 'body' THEN 0 WHEN '' THEN 2 ELSE 1 END AS rank FROM e WHERE token IN ('', 'body', 't1', 't2'))
SELECT doc_id, section_no, CASE WHEN token <> '' THEN para_idx END AS para_idx, nullif(token, '') AS token, token = '' AND min(section_no) OVER (PARTITION BY doc_id) < max(section_no) OVER (PARTITION BY doc_id) AS warned FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rank, CASE WHEN rank = 2 THEN -section_no ELSE section_no END, para_idx) = 1""",
)
def tk2(s, d):  # noqa: ANN001, ANN201
    return markdown.insertion_marker(A.form_lines(s, d), ["body", "t1", "t2"])


def _people_slots(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = A.read(s, d, "orders")
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(f"cell:0:{i}:1").alias("locator")) for i, n in enumerate(("성 명", "소속", "계좌 번호", "비고", "작성일"))))
    slots = o.select(F.col("o_orderkey").alias("doc_id"), F.explode(pairs).alias("p")).select("doc_id", "p.*")
    return slots, o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("person_id"))


_MATCHED = """slots AS (SELECT o_orderkey AS doc_id, o_custkey AS person_id, unnest(['name', 'work.name', 'account.number', 'extra.비고', 'extra.작성일']) AS field, 'cell:0:' || unnest(range(5)) || ':1' AS locator FROM orders),
matched AS (SELECT doc_id, locator, field, value FROM slots LEFT JOIN people USING (person_id, field))"""


@query("jn3_matched_slots", f"{A.with_tables('people')},\n{_MATCHED} SELECT * FROM matched")
def jn3(s, d):  # noqa: ANN001, ANN201
    slots, assigned = _people_slots(s, d)
    return forms.matched_slots(slots, A.people(s, d), assigned)


_ITEMS = """items AS (SELECT l_orderkey AS doc_id, pos - 1 AS i, unnest(['번호', '수량']) AS field, unnest([(pos * 10)::VARCHAR, (pos * 7)::VARCHAR]) AS value FROM NUMBERED),
repeated AS (SELECT i.doc_id, 0::BIGINT AS table_index, 4 + i AS "row", CASE field WHEN '번호' THEN 0 ELSE 1 END::BIGINT AS col, field, value FROM items i JOIN (SELECT doc_id, max("row") AS last FROM cells GROUP BY 1) USING (doc_id) WHERE 4 + i <= last)""".replace("NUMBERED", A._NUMBERED)


def _repeated(s: SparkSession, d: str, n: int) -> DataFrame:
    x = A._numbered(s, d, n)
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), (F.col("pos") * k).cast("string").alias("value")) for f, k in (("번호", 10), ("수량", 7))))
    items = x.select(F.col("l_orderkey").alias("doc_id"), (F.col("pos") - 1).alias("i"), F.explode(pairs).alias("p")).select("doc_id", "i", "p.*")
    orders = dealt(A.read(s, d, "orders").select(F.col("o_orderkey").alias("doc_id")), "doc_id", n=n).distinct()
    return forms.repeated_section(A.cells(s, d, n), {"번호": "번호", "수량": "수량"}, joined(items, orders, ["doc_id"], n=n), n)


def _order_shares(s: SparkSession, d: str) -> int:
    return common_shares(*(A.read(s, d, t) for t in ("orders", "lineitem")))


@query("jn4_repeated_section", f"{A.with_tables('cells')},\n{_ITEMS} SELECT * FROM repeated WHERE doc_id IN (SELECT o_orderkey FROM orders)")
def jn4(s, d):  # noqa: ANN001, ANN201
    return _repeated(s, d, _order_shares(s, d))


@query(
    "jn5_mapping",
    f"""{A.with_tables("cells", "people")},\n{_ITEMS},\n{_MATCHED}, r AS (SELECT doc_id, 'cell:' || table_index || ':' || "row" || ':' || col AS locator, value FROM repeated WHERE doc_id IN (SELECT o_orderkey FROM orders))
SELECT doc_id, locator, value, 'repeated' AS source FROM r UNION ALL
SELECT doc_id, locator, CASE WHEN locator = 'cell:0:4:1' THEN '2026. 6. 4.' ELSE value END, CASE WHEN locator = 'cell:0:4:1' THEN 'today' WHEN value IS NOT NULL THEN 'matched' ELSE 'blank' END FROM matched m WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = m.doc_id AND r.locator = m.locator)""",
)
def jn5(s, d):  # noqa: ANN001, ANN201
    slots, assigned = _people_slots(s, d)
    n = _order_shares(s, d)
    return forms.build_mapping(forms.matched_slots(slots, A.people(s, d), assigned, labels=True, n=n), _repeated(s, d, n), slots, "2026. 6. 4.", n=n)


@query("jn6_filled_slots", f"""{A.with_tables("people")},\n{_MATCHED} SELECT doc_id, 'cell' AS kind, locator, CASE locator WHEN 'cell:0:0:1' THEN '성 명' WHEN 'cell:0:1:1' THEN '소속' WHEN 'cell:0:2:1' THEN '계좌 번호' WHEN 'cell:0:3:1' THEN '비고' ELSE '작성일' END AS name, coalesce(value, '') AS value, value IS NOT NULL AS filled FROM matched""")
def jn6(s, d):  # noqa: ANN001, ANN201
    slots, assigned = _people_slots(s, d)
    values = forms.matched_slots(slots, A.people(s, d), assigned).where("value is not null").select("doc_id", F.col("locator").alias("key"), "value")
    return forms.fill(slots.withColumns({"kind": F.lit("cell"), "current": F.lit("")}), values)


_ROUTES = "m AS (SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN '금 액 > right' WHEN 1 THEN '우선순위 > left' WHEN 2 THEN 'nowhere > below' ELSE 'cell:0:0:1' END AS key, 'v' || o_custkey AS value FROM orders)"


def _routes(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    key = F.when(k == 0, "금 액 > right").when(k == 1, "우선순위 > left").when(k == 2, "nowhere > below").otherwise("cell:0:0:1")
    return A.read(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), key.alias("key"), F.concat(F.lit("v"), "o_custkey").alias("value"))


@query("jn6_located", f"WITH {_ROUTES} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'cell:0:2:1' ELSE key END AS key, value FROM m")
def jn6_located(s, d):  # noqa: ANN001, ANN201
    return forms.located(_routes(s, d), A.cells(s, d))


@query("jn6_missing_keys", f"WITH {_ROUTES} SELECT doc_id, key FROM m WHERE key <> 'cell:0:0:1'")
def jn6_missing(s, d):  # noqa: ANN001, ANN201
    slots, _ = _people_slots(s, d)
    return forms.missing_keys(slots.withColumns({"kind": F.lit("cell"), "current": F.lit("")}), _routes(s, d))


@query("ag16_fill_summary", f"{A.with_tables('people')},\n{_MATCHED} SELECT doc_id, count(value) AS n_filled, count(*) - count(value) AS n_blank FROM matched GROUP BY 1")
def ag16(s, d):  # noqa: ANN001, ANN201
    return forms.fill_summary(jn6(s, d))


@query(
    "ag12_row_heights",
    f"""WITH RECURSIVE c AS (SELECT l_orderkey AS doc_id, pos - 1 AS "row", 0 AS col, 1 + l_partkey % 3 AS span, 500 + qty * 10 AS h FROM {A._NUMBERED} UNION ALL SELECT l_orderkey, pos - 1, 1, 1 + l_partkey % 4, 700 + qty * 7 FROM {A._NUMBERED} WHERE pos % 2 = 1),
one AS (SELECT doc_id, "row", max(h) AS h FROM c WHERE span = 1 GROUP BY 1, 2), size AS (SELECT doc_id, max("row" + span) AS n FROM c GROUP BY 1), rw AS (SELECT doc_id, unnest(range(n)) AS "row" FROM size),
st AS (SELECT rw.doc_id, list(one.h ORDER BY rw."row") AS hs FROM rw LEFT JOIN one ON one.doc_id = rw.doc_id AND one."row" = rw."row" GROUP BY 1), mg AS (SELECT doc_id, list({{'r': "row", 's': span, 'h': h}} ORDER BY span, "row", col) AS ms FROM c WHERE span > 1 GROUP BY 1),
go AS (SELECT st.doc_id, 0 AS k, ms, hs, len(ms) * len(list_filter(hs, lambda x: x IS NULL)) AS steps FROM st JOIN mg ON mg.doc_id = st.doc_id
  UNION ALL SELECT doc_id, k + 1, ms, list_transform(range(1, len(hs) + 1), lambda i: CASE WHEN len(free) > 0 AND list_contains(free, i) AND (len(free) = 1 OR k >= steps) THEN greatest(m.h - known, 0) // len(free) ELSE hs[i] END), steps
  FROM (SELECT *, list_filter(range(m.r + 1, m.r + m.s + 1), lambda i: hs[i] IS NULL) AS free, coalesce(list_sum(hs[m.r + 1:m.r + m.s]), 0) AS known FROM (SELECT *, ms[k % len(ms) + 1] AS m FROM go WHERE k < steps + len(ms)))),
en AS (SELECT doc_id, hs FROM go WHERE k = steps + len(ms) UNION ALL SELECT doc_id, hs FROM st WHERE doc_id NOT IN (SELECT doc_id FROM mg)), fl AS (SELECT doc_id, unnest(hs) AS h, unnest(range(len(hs))) AS "row" FROM en)
SELECT doc_id, 0::BIGINT AS table_index, "row"::BIGINT AS "row", coalesce(h, 0)::BIGINT AS height FROM fl""",
)
def ag12(s, d):  # noqa: ANN001, ANN201
    """Tables whose rows are covered by merges of one to four rows, a cell or two for each."""
    n = A._numbered(s, d)
    first = n.select(F.col("l_orderkey").alias("doc_id"), (F.col("pos") - 1).alias("row"), F.lit(0).alias("col"), (1 + F.col("l_partkey") % 3).alias("row_span"), (500 + F.col("qty") * 10).alias("height"))
    second = n.where("pos % 2 = 1").select(F.col("l_orderkey").alias("doc_id"), (F.col("pos") - 1).alias("row"), F.lit(1).alias("col"), (1 + F.col("l_partkey") % 4).alias("row_span"), (700 + F.col("qty") * 7).alias("height"))
    return forms.row_heights(first.unionByName(second).withColumn("table_index", F.lit(0).cast("long")))


@query("sc21_markdown_blocks")
def sc21(s, d):  # noqa: ANN001, ANN201
    return blocks.parse_markdown(A.read(s, d, "documents").select("doc_id", "text")).select("doc_id", "ord", "kind", "level", "text", "blank_before")


#: Words of a line without marks that mean something in Markdown, and the same without blanks.
_PLAIN = f"(SELECT doc_id, i, regexp_replace(text, '[^가-힣a-zA-Z0-9 ]', '', 'g') AS w, regexp_replace(text, '[^가-힣a-zA-Z0-9]', '', 'g') AS v FROM {A._LINES})"


def _plain(s: SparkSession, d: str) -> DataFrame:
    lines = A.read(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return lines.select("doc_id", "i", F.regexp_replace("text", "[^가-힣a-zA-Z0-9 ]", "").alias("w"), F.regexp_replace("text", "[^가-힣a-zA-Z0-9]", "").alias("v"))


@query(
    "sc16_links",
    f"""SELECT doc_id, i, unnest([0, 1, 2, 3]) AS k, unnest(['see ' || w || ' ', u, ', ', 'x' || w]) AS text, unnest([NULL, u, NULL, u]) AS url FROM (SELECT *, 'https://a.kr/' || v || '/' || doc_id AS u FROM {_PLAIN})""",
)
def sc16(s, d):  # noqa: ANN001, ANN201
    url = F.concat(F.lit("https://a.kr/"), "v", F.lit("/"), "doc_id")
    t = _plain(s, d).select("doc_id", "i", F.concat(F.lit("see "), "w", F.lit(" "), url, F.lit(", [x"), "w", F.lit("]("), url, F.lit(")")).alias("t"))
    return t.select("doc_id", "i", F.posexplode(inline.links(F.col("t"))).alias("k", "p")).select("doc_id", "i", "k", "p.text", "p.url")


def _glyphs(s: SparkSession, d: str) -> DataFrame:
    """Style systems with plain styles named by a glyph, unknown glyphs, equal neighbours and declared ladders."""
    k, m = F.col("style_id"), F.col("doc_id") % 7
    name = F.when((k == "3") & m.isin(1, 2), "-").when((k == "4") & (m == 3), "■ head").when((k == "0") & (m == 4), "•").when((k == "6") & (m == 5), "AI:BULLET_1").otherwise(F.col("name"))
    glyph = F.when((k == "4") & (m == 3), "?").otherwise(F.col("glyph"))
    size = F.when((k == "3") & (m == 2), 10.0).otherwise(F.col("size_pt"))
    kind = F.when((k == "3") & (m == 2), "BULLET").otherwise(F.col("heading_type"))
    return _system(s, d).withColumns({"name": name, "glyph": F.when((k == "3") & (m == 2), "○").otherwise(glyph), "size_pt": size, "heading_type": kind})


_LADDERS = f"""g AS (SELECT * REPLACE (CASE WHEN style_id = '3' AND doc_id % 7 IN (1, 2) THEN '-' WHEN style_id = '4' AND doc_id % 7 = 3 THEN '■ head' WHEN style_id = '0' AND doc_id % 7 = 4 THEN '•' WHEN style_id = '6' AND doc_id % 7 = 5 THEN 'AI:BULLET_1' ELSE name END AS name,
  CASE WHEN style_id = '4' AND doc_id % 7 = 3 THEN '?' WHEN style_id = '3' AND doc_id % 7 = 2 THEN '○' ELSE glyph END AS glyph, CASE WHEN style_id = '3' AND doc_id % 7 = 2 THEN 10.0 ELSE size_pt END AS size_pt, CASE WHEN style_id = '3' AND doc_id % 7 = 2 THEN 'BULLET' ELSE heading_type END AS heading_type) FROM system),
gr AS (SELECT *, CASE WHEN glyph IN ('●', '○') THEN 1 ELSE 4 END AS own, CASE trim(name)[1] WHEN '■' THEN 0 WHEN '•' THEN 1 WHEN '-' THEN 2 ELSE 4 END AS named FROM g WHERE use_count > 0),
gb AS (SELECT *, CASE WHEN heading_type = 'NONE' OR own = 4 THEN named ELSE own END AS rank FROM gr WHERE heading_type = 'BULLET' OR (heading_type = 'NONE' AND trim(name) IN ('-', '•'))),
gt AS (SELECT doc_id, style_id, rank::BIGINT AS rank, row_number() OVER o AS rung, coalesce(lag(rank) OVER o = rank AND lag(size_pt) OVER o IS NOT DISTINCT FROM size_pt, false) AS tie FROM gb WINDOW o AS (PARTITION BY doc_id ORDER BY rank, coalesce(size_pt, 0) DESC, coalesce(outline_level, 0), use_count DESC, style_id::INT)),
bullets AS (SELECT doc_id, style_id, rank, rung, bool_or(tie) OVER (PARTITION BY doc_id) AS aborted FROM gt)"""


@query("wn3_bullet_ladder", f"{_STYLED},\n{_LADDERS} SELECT * FROM bullets")
def wn3(s, d):  # noqa: ANN001, ANN201
    return styles.bullet_ladder(_glyphs(s, d))


@query(
    "wn4_normalization_plan",
    f"""{_STYLED},\n{_LADDERS}, hx AS (SELECT *, {_ENUM} AS class, bool_or(heading_type = 'OUTLINE' AND use_count > 0) OVER (PARTITION BY doc_id) AS outlined, min(CASE WHEN lower(trim(name)) IN ('normal', '바탕글') OR lower(trim(eng_name)) = 'normal' THEN size_pt END) OVER (PARTITION BY doc_id) AS body_pt FROM g),
hc AS (SELECT * FROM hx WHERE class IS NOT NULL AND use_count > 0 AND heading_type = 'NONE' AND size_pt > coalesce(body_pt, 10)), ht AS (SELECT doc_id FROM hc GROUP BY 1 HAVING NOT bool_or(outlined) AND count(*) >= 2 AND count(DISTINCT class) = count(*) AND count(DISTINCT size_pt) = count(*)),
hl AS (SELECT doc_id, style_id, row_number() OVER (PARTITION BY doc_id ORDER BY size_pt DESC, pos) AS rung FROM hc WHERE doc_id IN (FROM ht)), said AS (SELECT doc_id, {_OVERRIDE} AS role FROM g WHERE {_OVERRIDE} IS NOT NULL),
plan AS (SELECT doc_id, style_id, 'HEADING_' || rung AS role FROM hl WHERE rung <= 6 AND doc_id NOT IN (SELECT doc_id FROM said WHERE starts_with(role, 'HEADING_')) UNION ALL SELECT doc_id, style_id, 'BULLET_' || rung FROM bullets WHERE NOT aborted AND doc_id NOT IN (SELECT doc_id FROM said WHERE starts_with(role, 'BULLET_'))),
lv AS (SELECT doc_id, count(DISTINCT role) AS n FROM (SELECT doc_id, role FROM plan UNION ALL SELECT doc_id, role FROM said) WHERE regexp_matches(role, '^HEADING_[0-9]+$') GROUP BY 1),
gc AS (SELECT doc_id, sum(use_count) AS n, sum(CASE WHEN heading_type = 'OUTLINE' THEN use_count ELSE 0 END) AS n_outline, count(DISTINCT CASE WHEN heading_type = 'OUTLINE' AND use_count > 0 THEN outline_level END) AS n_levels, count(DISTINCT CASE WHEN regexp_matches({_OVERRIDE}, '^HEADING_[0-9]+$') THEN {_OVERRIDE} END) AS n_declared FROM g GROUP BY 1),
gk AS (SELECT doc_id, CASE WHEN n = 0 THEN 'flat' WHEN n_outline >= 3 AND n_levels >= 2 THEN 'structured' WHEN n_declared >= 2 THEN 'structured' WHEN n_outline = 0 THEN 'flat' ELSE 'weak' END AS before FROM gc)
SELECT doc_id, style_id, role, before, CASE WHEN coalesce(lv.n, 0) >= 2 THEN 'structured' ELSE before END AS expected FROM plan JOIN gk USING (doc_id) LEFT JOIN lv USING (doc_id)""",
)
def wn4(s, d):  # noqa: ANN001, ANN201
    return styles.normalization_plan(_glyphs(s, d))


@query("jn14_applied_roles", f"{_STYLED}, m AS (SELECT DISTINCT doc_id, unnest(['1.', 'none']) AS name, unnest(['HEADING_1', 'BODY']) AS role FROM documents) SELECT m.doc_id, m.name, m.role, s.style_id, s.style_id IS NULL AS missing FROM m LEFT JOIN system s ON s.doc_id = m.doc_id AND s.name = m.name")
def jn14(s, d):  # noqa: ANN001, ANN201
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(r).alias("role")) for n, r in (("1.", "HEADING_1"), ("none", "BODY"))))
    return styles.apply_roles(_system(s, d), A.read(s, d, "documents").select("doc_id", F.explode(pairs).alias("m")).select("doc_id", "m.*"))


def _fields(s: SparkSession, d: str) -> DataFrame:
    n = A._numbered(s, d)
    f = n.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).cast("long").alias("section_no"), F.col("pos").cast("string").alias("field_id"), "l_partkey")
    return f.where("l_partkey % 5 <> 0").withColumn("side", F.lit("begin")).unionByName(f.where("l_partkey % 7 <> 0").withColumn("side", F.lit("end"))).drop("l_partkey")


@query("jn9_unpaired_fields", f"SELECT l_orderkey AS doc_id, 0::BIGINT AS section_no, pos::VARCHAR AS field_id, CASE WHEN l_partkey % 7 = 0 THEN 'begin alone' ELSE 'end alone' END AS finding FROM {A._NUMBERED} WHERE (l_partkey % 5 <> 0) <> (l_partkey % 7 <> 0)")
def jn9(s, d):  # noqa: ANN001, ANN201
    return checks.unpaired_fields(_fields(s, d))


@query("tk4_next_version", "WITH t AS (SELECT DISTINCT user_id % 500 AS name, event_id % 9 AS version FROM events), g AS (SELECT name, unnest(range(2, 12)) AS v FROM t GROUP BY 1) SELECT name::VARCHAR AS name, min(v) AS next_version FROM g WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.name = g.name AND t.version = g.v) GROUP BY 1")
def tk4(s, d):  # noqa: ANN001, ANN201
    e = A.read(s, d, "events")
    return checks.next_version(e.select((F.col("user_id") % 500).cast("string").alias("name"), (F.col("event_id") % 9).alias("version")))


@query("pf3_kept_lines", f"{A.with_tables('paragraphs')} SELECT doc_id, section_no, para_idx, line_no FROM (SELECT *, unnest(range(line_segs)) AS line_no FROM paragraphs) WHERE NOT (line_segs >= 1 AND line_breaks + 1 > line_segs)")
def pf3(s, d):  # noqa: ANN001, ANN201
    p = A.paragraphs(s, d)
    lines = p.where("line_segs > 0").select("doc_id", "section_no", "para_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("line_segs") - 1)).alias("line_no"))
    return checks.without_stale_lines(lines, p)


@query("wn18_inserted_paragraphs", f"{A.with_tables('paragraphs')}, u AS (SELECT doc_id, section_no, para_idx AS a, 0 AS side, text FROM paragraphs UNION ALL SELECT doc_id, section_no, para_idx, -1, 'new' FROM paragraphs WHERE forced_break) SELECT doc_id, section_no, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY a, side) - 1 AS para_idx, text FROM u")
def wn18(s, d):  # noqa: ANN001, ANN201
    p = A.paragraphs(s, d)
    new = p.where("forced_break").select("doc_id", "section_no", F.col("para_idx").alias("anchor_idx"), F.lit(True).alias("before"), F.lit(0).alias("i"), F.lit("new").alias("text"))
    return edits.insert_paragraphs(p, new)


@query(
    "wn17_deleted_rows",
    f"""{A.with_tables("cells")}, bad AS (SELECT doc_id, min(error) AS error FROM (SELECT doc_id, 'split merge' AS error FROM cells WHERE "row" = 0 AND col = 1 AND row_span = 2 UNION ALL SELECT doc_id, 'out of range' FROM cells GROUP BY 1 HAVING max("row" + row_span - 1) < 2) GROUP BY 1)
SELECT c.doc_id, table_index, CASE WHEN error IS NULL AND "row" > 2 THEN "row" - 2 ELSE "row" END AS "row", col, row_span, text, error FROM cells c LEFT JOIN bad USING (doc_id) WHERE error IS NOT NULL OR "row" NOT IN (1, 2)""",
)
def wn17(s, d):  # noqa: ANN001, ANN201
    c = A.cells(s, d)
    ranges = c.select("doc_id", "table_index").distinct().select("doc_id", "table_index", F.lit(1).cast("long").alias("first"), F.lit(2).cast("long").alias("last"))
    return edits.delete_rows(c, ranges).select("doc_id", "table_index", "row", "col", "row_span", "text", "error")


@query(
    "wn17_repeated_rows",
    f"""{A.with_tables("cells")}, bad AS (SELECT doc_id, 'split merge' AS error FROM cells WHERE "row" = 0 AND col = 1 AND row_span = 2), sz AS (SELECT doc_id, max("row" + row_span - 1) AS last FROM cells GROUP BY 1),
o AS (SELECT c.*, error, last FROM cells c LEFT JOIN bad USING (doc_id) JOIN sz USING (doc_id))
SELECT doc_id, table_index, "row" + CASE WHEN error IS NULL AND "row" > 1 THEN 2 ELSE 0 END AS "row", col, row_span, text, error FROM o
UNION ALL SELECT doc_id, table_index, "row" + k, col, row_span, '', NULL FROM (SELECT *, unnest([1, 2]) AS k FROM o WHERE error IS NULL AND "row" = 1)
UNION ALL SELECT doc_id, table_index, "row" + 3, col, row_span, '', NULL FROM o WHERE error IS NULL AND "row" = last""",
)
def wn17_repeats(s, d):  # noqa: ANN001, ANN201
    c = A.cells(s, d)
    t = c.select("doc_id", "table_index").distinct()
    repeats = t.select("doc_id", "table_index", *(F.lit(x).cast("long").alias(n) for n, x in (("first", 1), ("last", 1), ("n", 2)))).unionByName(t.select("doc_id", "table_index", *(F.lit(x).cast("long").alias(n) for n, x in (("first", None), ("last", None), ("n", 1)))))
    return edits.repeat_rows(c, repeats).select("doc_id", "table_index", "row", "col", "row_span", "text", "error")


def _tables(s: SparkSession, d: str) -> DataFrame:
    o = A.read(s, d, "orders")
    k = F.col("o_orderkey")
    caption = F.when(k % 5 == 0, "{{table_1}}").when(k % 5 == 1, "[그림 1] x").otherwise("표")
    return o.select((k % 500).alias("doc_id"), k.alias("table_index"), caption.alias("caption"), (k % 2).cast("long").alias("treat_as_char"), F.when(k % 3 == 0, "TABLE").otherwise("CELL").alias("page_break"))


_TABLES = "tables AS (SELECT o_orderkey % 500 AS doc_id, o_orderkey AS table_index, CASE o_orderkey % 5 WHEN 0 THEN '{{table_1}}' WHEN 1 THEN '[그림 1] x' ELSE '표' END AS caption, (o_orderkey % 2)::BIGINT AS treat_as_char, CASE WHEN o_orderkey % 3 = 0 THEN 'TABLE' ELSE 'CELL' END AS page_break FROM orders)"


@query("tk3_reference_tables", f"WITH {_TABLES} SELECT doc_id, table_index, starts_with(caption, '{{{{table') OR starts_with(caption, '[') AS designated FROM tables QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY designated DESC, table_index) = 1")
def tk3(s, d):  # noqa: ANN001, ANN201
    return markdown.reference_table(_tables(s, d), r"^\[그림")


@query("pf11_released_tables", f"WITH {_TABLES} SELECT doc_id, table_index, caption, 0::BIGINT AS treat_as_char, 'CELL' AS page_break, treat_as_char = 1 OR page_break = 'TABLE' AS changed FROM tables")
def pf11(s, d):  # noqa: ANN001, ANN201
    return edits.released_tables(_tables(s, d)).withColumn("treat_as_char", F.col("treat_as_char").cast("long"))


@query(
    "pf11_flow_warnings",
    f"""WITH {_TABLES}, m AS (SELECT doc_id % 500 AS doc_id FROM documents GROUP BY 1 HAVING max(length(text)) > 200)
SELECT doc_id, 'may be cut off' AS warning, sum(treat_as_char)::BIGINT AS n FROM tables JOIN m USING (doc_id) GROUP BY 1 HAVING sum(treat_as_char) > 0 UNION ALL SELECT doc_id, 'released', count(*) FROM tables WHERE treat_as_char = 1 OR page_break = 'TABLE' GROUP BY 1""",
)
def pf11_warnings(s, d):  # noqa: ANN001, ANN201
    values = A.read(s, d, "documents").select((F.col("doc_id") % 500).alias("doc_id"), F.col("text").alias("value"))
    t = _tables(s, d)
    return edits.flow_warnings(t, values).unionByName(edits.flow_warnings(t, values, release=True))


@query("pf12_without_residue", f"WITH {_TABLES} SELECT * FROM tables WHERE NOT starts_with(caption, '{{{{table')")
def pf12(s, d):  # noqa: ANN001, ANN201
    return edits.without_residue(_tables(s, d))


def _nodes(s: SparkSession, d: str) -> DataFrame:
    """Each line as an outermost paragraph; some hold a table with a caption and a paragraph in a cell, some a picture."""
    p = A.paragraphs(s, d).select("doc_id", "section_no", "para_idx", "text", F.length("text").alias("n"), (F.col("para_idx") * 10).alias("x"))
    m = F.col("n") % 10
    token = F.when(m == 3, F.concat(F.lit("{{intro}} "), "text")).when(m == 4, F.concat("text", F.lit("{{ Figure_template }}"))).otherwise(F.col("text"))
    table, none = F.col("n") % 7 == 6, F.lit(None).cast("string")

    def node(kind: str, at: int, stop: int, when, text=none, caption=none, ref=none, opens=None):  # noqa: ANN001, ANN202
        fields = {"kind": F.lit(kind), "node": F.col("x") + at, "stop": F.col("x") + stop, "text": text, "caption": caption, "ref": ref, "has_secpr": F.lit(False) if opens is None else opens}
        return F.when(when, F.struct(*(v.alias(k) for k, v in fields.items())))

    some = F.array_compact(F.array(
        node("paragraph", 1, 9, F.lit(True), token, opens=F.col("para_idx") < 2),
        node("table", 2, 6, table, caption=F.when(F.col("n") % 3 == 0, "{{table_template:sample}}").otherwise("표")),
        node("paragraph", 4, 5, table, F.when(F.col("n") % 5 == 0, "{{figure}}").when(F.col("n") % 5 == 1, "{{intro}}").otherwise("x")),
        node("picture", 8, 8, F.col("n") % 2 == 0, ref=F.concat(F.lit("image"), (F.col("n") % 4).cast("string"))),
    ))
    return p.select("doc_id", "section_no", F.explode(some).alias("k")).select("doc_id", "section_no", "k.*")


_RESIDUE = f"""x AS (SELECT doc_id, section_no, para_idx, length(text) AS n FROM paragraphs),
residue AS (SELECT doc_id, section_no, para_idx * 10 + 1 AS top, n, CASE WHEN n % 7 = 6 AND n % 3 = 0 THEN 'table' WHEN n % 10 = 4 OR (n % 7 = 6 AND n % 5 = 0) THEN 'figure' WHEN n % 10 = 3 AND para_idx < 2 THEN 'emptied' WHEN n % 10 = 3 THEN 'marker' END AS reason FROM x)"""


@query("pf12_residue", f"{A.with_tables('paragraphs')},\n{_RESIDUE} SELECT doc_id, section_no, top, reason FROM residue WHERE reason IS NOT NULL")
def pf12_residue(s, d):  # noqa: ANN001, ANN201
    return edits.residue(_nodes(s, d))


@query("pf12_counts", f"{A.with_tables('paragraphs')},\n{_RESIDUE} SELECT doc_id, count(*) FILTER (reason = 'table') AS n_tables, count(*) FILTER (reason = 'figure') AS n_figures, count(*) FILTER (reason IN ('marker', 'emptied')) AS n_markers FROM residue WHERE reason IS NOT NULL GROUP BY 1")
def pf12_counts(s, d):  # noqa: ANN001, ANN201
    return edits.residue_counts(edits.residue(_nodes(s, d)))


@query("pf12_cleared", f"{A.with_tables('paragraphs')},\n{_RESIDUE} SELECT doc_id, count(*) AS n_nodes, count(*) FILTER (coalesce(blank, false)) AS n_blank FROM (SELECT doc_id, unnest(CASE WHEN n % 7 = 6 THEN [top < 20 AND (n = 0 OR reason = 'emptied'), false, false] ELSE [top < 20 AND (n = 0 OR reason = 'emptied')] END || CASE WHEN n % 2 = 0 THEN [false] ELSE [] END) AS blank FROM residue WHERE reason IS NULL OR reason = 'emptied') GROUP BY 1")
def pf12_cleared(s, d):  # noqa: ANN001, ANN201
    n = _nodes(s, d)
    left = edits.cleared(n, edits.residue(n))
    return left.groupBy("doc_id").agg(F.count("*").alias("n_nodes"), F.count_if((F.col("text") == "") & F.col("has_secpr")).alias("n_blank"))


@query(
    "jn16_unused_binaries",
    f"""{A.with_tables("paragraphs")},\n{_RESIDUE}, u AS (SELECT doc_id, 'image' || (n % 4) AS ref, coalesce(reason = 'figure', false) AS figure, reason IS NULL OR reason = 'emptied' AS stays FROM residue WHERE n % 2 = 0 UNION ALL SELECT doc_id, 'image2', false, true FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id, ref FROM u GROUP BY 1, 2 HAVING bool_or(figure) AND NOT bool_or(stays)""",
)
def jn16_unused(s, d):  # noqa: ANN001, ANN201
    n = _nodes(s, d)
    elsewhere = A.read(s, d, "documents").where("doc_id % 3 = 0").select("doc_id", F.lit("image2").alias("ref"))
    return edits.unused_binaries(n, edits.residue(n), elsewhere)


@query(
    "ag11_box_heights",
    f"""{A.with_tables("cells")}, h AS (SELECT doc_id, table_index, "row", max(1000 + length(text) * 10) AS h FROM cells GROUP BY 1, 2, 3) SELECT doc_id, table_index, sum(h)::BIGINT AS height FROM h GROUP BY 1, 2""",
)
def ag11(s, d):  # noqa: ANN001, ANN201
    return forms.box_height(A.cells(s, d).withColumn("height", (1000 + F.length("text") * 10).cast("long")))


@query("ag14_fingerprints", "SELECT conv_id AS doc_id, sha256(string_agg(turn::VARCHAR || chr(0) || text, '' ORDER BY turn::VARCHAR, text)) AS fingerprint FROM conversations WHERE turn <> 3 GROUP BY 1")
def ag14(s, d):  # noqa: ANN001, ANN201
    parts = A.read(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("string").alias("part_name"), F.encode("text", "UTF-8").alias("content"))
    return checks.fingerprints(parts, "3")


@query("ag17_coverage", "WITH n AS (SELECT doc_id % 97 AS doc_id, CASE WHEN doc_id % 4 = 0 THEN 'saved' ELSE 'estimate' END AS engine, count(*) AS n FROM labels GROUP BY 1, 2) SELECT *, count(*) OVER (PARTITION BY doc_id) > 1 AS partial FROM n")
def ag17(s, d):  # noqa: ANN001, ANN201
    judged = A.read(s, d, "labels").select((F.col("doc_id") % 97).alias("doc_id"), F.when(F.col("doc_id") % 4 == 0, "saved").otherwise("estimate").alias("engine"))
    return layout.coverage(judged)


@query("wn8_footnote_numbers", f"{A.with_tables('paragraphs')} SELECT doc_id, section_no, para_idx, 0::BIGINT AS pos, row_number() OVER (PARTITION BY doc_id ORDER BY section_no, para_idx) AS no FROM paragraphs WHERE in_note")
def wn8(s, d):  # noqa: ANN001, ANN201
    return markdown.footnote_numbers(A.paragraphs(s, d).where("in_note").select("doc_id", "section_no", "para_idx", F.lit(0).cast("long").alias("pos")))


@query("jn12_office_holders", "SELECT o_orderkey AS doc_id, o_orderdate::DATE::VARCHAR AS end_date, CASE WHEN o_orderdate::DATE BETWEEN DATE '1992-01-01' AND DATE '1994-06-30' THEN 'A' WHEN o_orderdate::DATE >= DATE '1995-01-01' THEN 'B' END AS name FROM orders")
def jn12(s, d):  # noqa: ANN001, ANN201
    holders = s.createDataFrame([("1992-01-01", "1994-06-30", "A"), ("1995-01-01", None, "B")], "first string, last string, name string").select(F.col("first").cast("date").alias("first"), F.col("last").cast("date").alias("last"), "name")
    return markdown.office_holder(A.read(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("date").alias("end_date")), holders).withColumn("end_date", F.col("end_date").cast("string"))


@query("jn16_unreferenced", "SELECT DISTINCT l_orderkey AS doc_id, l_partkey % 20 AS ref FROM lineitem a WHERE l_quantity < 25 AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_partkey % 20 = a.l_partkey % 20 AND NOT b.l_quantity < 25)")
def jn16(s, d):  # noqa: ANN001, ANN201
    uses = A.read(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 20).alias("ref"), (F.col("l_quantity") < 25).alias("dropped"))
    return media.unreferenced(uses.where("dropped"), uses.where("not dropped").select("doc_id", "ref"))


@query("tk5_next_image", "SELECT l_orderkey AS doc_id, coalesce(max(CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey END), 0) + 1 AS next_id FROM lineitem GROUP BY 1")
def tk5(s, d):  # noqa: ANN001, ANN201
    items = A.read(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.when(F.col("l_linenumber") % 3 != 0, "image").otherwise("ole"), F.col("l_partkey").cast("string")).alias("id"))
    return media.next_image_id(items)


@query(
    "sm3_output_guard",
    "SELECT o_orderkey::VARCHAR AS path, CASE WHEN o_orderkey % 4 = 0 THEN 'new' WHEN o_orderkey % 7 = 0 THEN 'overwrite-own' WHEN o_orderkey % 3 = 0 THEN 'versioned-foreign' WHEN o_custkey % 2 = 0 THEN 'overwrite-own' ELSE 'versioned-drift' END AS status FROM orders",
)
def sm3(s, d):  # noqa: ANN001, ANN201
    o = A.read(s, d, "orders").withColumn("path", F.col("o_orderkey").cast("string"))
    current = o.where("o_orderkey % 4 <> 0").select("path", (F.col("o_custkey") % 2).cast("string").alias("fingerprint"))
    return checks.output_guard(o.select("path", (F.col("o_orderkey") % 7 == 0).alias("force")), o.where("o_orderkey % 3 <> 0").select("path", F.lit("0").alias("fingerprint")), current)


@query("pf4_neutral_numbering", "SELECT l_orderkey AS doc_id, l_linenumber, CASE WHEN l_linenumber % 2 = 0 AND l_partkey % 3 <> 0 AND l_suppkey % 4 <> 0 THEN 'NONE' WHEN l_linenumber % 2 = 0 THEN 'TABLE' ELSE 'NOTE' END AS numbering_type, l_linenumber % 2 = 0 AND l_partkey % 3 <> 0 AND l_suppkey % 4 <> 0 AS changed FROM lineitem")
def pf4(s, d):  # noqa: ANN001, ANN201
    objects = A.read(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, "TABLE").otherwise("NOTE").alias("numbering_type"), (F.col("l_partkey") % 3 == 0).alias("has_caption"), F.when(F.col("l_suppkey") % 4 == 0, "Contents/header.xml").otherwise("Contents/section0.xml").alias("part_name"))
    return checks.neutral_numbering(objects).select("doc_id", "l_linenumber", "numbering_type", "changed")


@query(
    "jn19_indent_templates",
    f"""{A.with_tables("paragraphs")}, p AS (SELECT doc_id, section_no, para_idx, length(text) % 5 * 100 AS indent, forced_break, text FROM paragraphs),
j AS (SELECT a.doc_id, a.section_no, a.para_idx, p.indent, p.para_idx AS template_idx FROM p a JOIN p ON p.doc_id = a.doc_id AND p.section_no = a.section_no AND abs(p.para_idx - a.para_idx) <= 40 WHERE a.forced_break AND trim(p.text, ' ') <> '')
SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY doc_id, section_no, para_idx, indent ORDER BY abs(template_idx - para_idx), template_idx) = 1""",
)
def jn19(s, d):  # noqa: ANN001, ANN201
    p = A.paragraphs(s, d).withColumn("indent", (F.length("text") % 5 * 100).cast("long"))
    return edits.indent_templates(p, p.where("forced_break").select("doc_id", "section_no", "para_idx"))


@query(
    "jn19_picked_templates",
    f"""{A.with_tables("paragraphs")}, p AS (SELECT doc_id, section_no, para_idx, length(text) % 5 * 100 AS indent, text, length(text) AS n FROM paragraphs), an AS (SELECT *, 1 + n % 3 AS anchor_level FROM p WHERE n % 17 = 0 AND n > 0),
j AS (SELECT a.doc_id, a.section_no, a.para_idx, a.anchor_level, a.indent AS own, p.indent, p.para_idx AS template_idx FROM an a JOIN p ON p.doc_id = a.doc_id AND p.section_no = a.section_no AND abs(p.para_idx - a.para_idx) <= 40 WHERE trim(p.text, ' ') <> '' QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.section_no, a.para_idx, p.indent ORDER BY abs(p.para_idx - a.para_idx), p.para_idx) = 1),
l AS (SELECT *, row_number() OVER k - 1 AS rung, count(*) OVER (PARTITION BY doc_id, section_no, para_idx) AS n FROM j WINDOW k AS (PARTITION BY doc_id, section_no, para_idx ORDER BY indent)), bs AS (SELECT doc_id, section_no, para_idx, n, rung - (anchor_level - 1) AS base FROM l WHERE indent = own),
b AS (SELECT bs.*, ord, kind, level, CASE WHEN kind = 'bullet' THEN base + level - 1 END AS wanted FROM bs, (VALUES (0, 'paragraph', 0), (1, 'bullet', 1), (2, 'bullet', 2), (3, 'ordered', 0), (4, 'bullet', 6)) v(ord, kind, level)), c AS (SELECT *, least(greatest(wanted, 0), n - 1) AS pick FROM b)
SELECT c.doc_id, c.section_no, c.para_idx, ord, l.template_idx, (CASE WHEN pick <> wanted THEN pick + 1 - base END)::BIGINT AS clamped_to FROM c JOIN l ON l.doc_id = c.doc_id AND l.section_no = c.section_no AND l.para_idx = c.para_idx AND CASE WHEN wanted IS NULL THEN l.indent = l.own ELSE l.rung = pick END""",
)
def jn19_picked(s, d):  # noqa: ANN001, ANN201
    n = F.length("text")
    p = A.paragraphs(s, d).withColumn("indent", (n % 5 * 100).cast("long"))
    anchors = p.where((n % 17 == 0) & (n > 0)).select("doc_id", "section_no", "para_idx", "indent", (1 + n % 3).cast("long").alias("anchor_level"))
    blocks = F.array(*(F.struct(F.lit(o).alias("ord"), F.lit(k).alias("kind"), F.lit(level).cast("long").alias("level")) for o, k, level in ((0, "paragraph", 0), (1, "bullet", 1), (2, "bullet", 2), (3, "ordered", 0), (4, "bullet", 6))))
    asked = anchors.select("doc_id", "section_no", "para_idx", F.explode(blocks).alias("b")).select("doc_id", "section_no", "para_idx", "b.*")
    return edits.pick_templates(edits.indent_templates(p, anchors.select("doc_id", "section_no", "para_idx")), anchors, asked)


@query("sc29_widow_tails", f"{A.with_tables('paragraphs')}, t AS (SELECT doc_id, section_no, para_idx, length(text) AS total, length(text) % 40 AS tail FROM paragraphs WHERE line_breaks = 0 AND length(text) > 40) SELECT doc_id, section_no, para_idx, tail::BIGINT AS tail, -least(ceil(100.0 * tail / total), 5)::BIGINT AS spacing, (100 - least(ceil(100.0 * tail / total) - least(ceil(100.0 * tail / total), 5), 5))::BIGINT AS ratio, ceil(100.0 * tail / total) <= 10 AS fittable FROM t WHERE tail BETWEEN 1 AND 4")
def sc29(s, d):  # noqa: ANN001, ANN201
    p = A.paragraphs(s, d)
    lines = p.select("doc_id", "section_no", "para_idx", F.posexplode(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(40))).alias("line_no", "textpos"))
    lines = lines.join(p.where(F.length("text") > 40).select("doc_id", "section_no", "para_idx"), ["doc_id", "section_no", "para_idx"], "left_semi")
    return layout.widow_tails(lines, p)


@query(
    "st1_all_slots",
    f"""{A.with_tables("form_lines", "cells")},\n{_SLOTTED},\n{_GRID},\n{_TARGETS}, ph AS (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS name FROM form_lines),
every AS (SELECT doc_id, 'placeholder' AS kind, name AS locator, name, NULL::VARCHAR AS cur, 0 AS place FROM ph UNION ALL SELECT doc_id, kind, kind || ':' || name, name, NULL, para_idx FROM sl
  UNION ALL SELECT doc_id, 'cell', 'cell:' || table_index || ':' || ("row" + (side = 'below')::INT) || ':' || (col + (side = 'right')::INT), text, '', "row" * 100 + col FROM targets
  UNION ALL SELECT doc_id, 'checkbox', 'checkbox:' || regexp_extract(text, '☑ (\\S+)', 1), regexp_extract(text, '☑ (\\S+)', 1), 'on', para_idx FROM form_lines WHERE contains(text, '☑')
  UNION ALL SELECT doc_id, 'inline', 'tab:' || trim(string_split(text, chr(9))[1]), trim(string_split(text, chr(9))[1]), trim(array_to_string(string_split(text, chr(9))[2:], ''), ' '), para_idx FROM form_lines WHERE contains(text, chr(9)))
SELECT doc_id, kind, locator, name, cur AS current FROM every QUALIFY row_number() OVER (PARTITION BY doc_id, kind, locator ORDER BY place) = 1""",
)
def st1(s, d):  # noqa: ANN001, ANN201
    return forms.all_slots(A.form_lines(s, d), A.cells(s, d))


_scalar("sc12_caption_frame", "regexp_replace('<표 ' || ord || '> ' || text, '^\\s*(?:[<〈]\\s*표\\s*[^>〉]*[>〉]|\\[\\s*그림\\s*[^\\]]*\\])\\s*', '')", lambda c: T.strip_caption_frame(F.concat(F.lit("<표 "), F.col("ord").cast("string"), F.lit("> "), c)))
_scalar("sc23_alt_text", "'pic' || ord || '.png/' || (ord + 1) || '/' || (ord + 2)", lambda c: F.concat_ws("/", *(T.alt_text(F.concat(F.lit("원본 그림의 이름: pic"), F.col("ord").cast("string"), F.lit(".png\n원본 그림의 크기: 가로 "), (F.col("ord") + 1).cast("string"), F.lit("pixel, 세로 "), (F.col("ord") + 2).cast("string"), F.lit("pixel")))[k].cast("string") for k in ("origname", "px_w", "px_h"))))
_scalar("sc36_document_title", "coalesce(nullif(trim(CASE WHEN ord % 2 = 0 THEN '' ELSE text END), ''), 'heading')", lambda c: T.document_title(F.when(F.col("ord") % 2 == 0, "").otherwise(c), F.lit("heading")))
_scalar("sc19_math_spans", "'x^' || ord", lambda c: F.array_join(F.transform(T.math_spans(F.concat(F.lit("a $x^"), F.col("ord").cast("string"), F.lit("$ b $5 and $6 "))), lambda m: m["latex"]), ","))
