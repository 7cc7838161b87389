"""Expectations of the library's rules, restated as data; and every SQL twin against its query."""

import hashlib
import io
import json
import os
import random
import zipfile
from datetime import date, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quiremill.functions import inline as I, text as T
from quiremill.operators import blocks as B, checks, edits, forms, layout, markdown, media, styles
from quiremill.plans import extra  # noqa: F401 (adds queries)
from quiremill.plans.queries import ORACLES, QUERIES
from quiremill.sources import landing, packages
from quiremill.streaming import revisions

SF = "/root/testdata/sf0.001"


def column(spark, values, rule, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", rule(F.col("v")).alias("x")).orderBy("i").collect()]


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twins(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    have, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(have.columns) == sorted(want.columns)

    def rows(df):
        return sorted(tuple("NULL" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))

    assert rows(have) == rows(want)


def test_scalars(spark):
    assert column(spark, ["{{ title }} / {{author}} / {{title}}", "", None], T.placeholders) == [["title", "author"], [], None]
    assert column(spark, ["로마자", "Ⅰ.", "1.", "1)", "①", "가.", "a)", "본문"], T.enumerator_class) == ["ROMAN", "ROMAN", "DECIMAL_DOT", "DECIMAL_PAREN", "CIRCLED", "HANGUL", "LATIN", None]
    assert column(spark, ["■", "●", "-", "·", "x", None], T.glyph_rank) == [0, 1, 2, 3, 4, 4]
    assert column(spark, ["1.1 서론", "부록 A: 표", "2024 결산", "제1장 개요", "A형 자료"], T.strip_heading_number) == ["서론", "표", "2024 결산", "개요", "A형 자료"]
    assert column(spark, ["Ⅲ. 결과", "3장 방법", "부록 A", "부록", "결론"], T.chapter_label) == ["Ⅲ", "3", "부록A", "부록", None]
    assert column(spark, ["<표 부록-1> 등급", "[그림 Ⅰ-3] 추세", "그냥"], T.strip_caption_frame) == ["등급", "추세", "그냥"]
    assert column(spark, ["□ 과제유형 : ", "□ 과제기간 :  .  .  . ~", "□ 동의함", "이름: 홍길동"], T.label_line) == ["과제유형", "과제기간", None, None]
    assert column(spark, ["https://a.kr/x;y\\z"], lambda c: T.command_to_url(T.url_to_command(c))) == ["https://a.kr/x;y\\z"]
    assert column(spark, ["?#here;1;0;2;"], T.command_to_url) == [None]
    assert column(spark, ["식 $x^2$ 끝", "$5 and $10", "$$a$$"], lambda c: F.to_json(T.math_spans(c))) == ['[{"latex":"x^2","kind":"inline"}]', "[]", '[{"latex":"a","kind":"display"}]']
    assert column(spark, ["원본 그림의 이름: a.png\n원본 그림의 크기: 가로 12pixel, 세로 34pixel", "x"], T.alt_text) == [("a.png", 12, 34), (None, None, None)]
    assert column(spark, [b"\x89PNG\r\n\x1a\n..", b"\xff\xd8\xff", b"GIF89a", b"BM", b"?"], T.image_format, "binary") == ["png", "jpg", "gif", "bmp", None]
    assert column(spark, ["성 명", "E-Mail", "ÉCOLE", None], T.normalize_label) == ["성명", "email", "école", None]
    assert column(spark, ["가" * 19, "", "ab"], lambda c: T.wrapped_lines(c, F.lit(9.5))) == [3, 1, 1]
    assert column(spark, [date(2026, 6, 4)], T.kdate, "date") == ["2026. 6. 4."]
    assert column(spark, ["2026-08", "봄"], T.publication_month) == ["2026년 8월", "봄"]
    fits = table(spark, "n int, t int", (100, 3), (100, 8), (100, 12), (0, 1), (50, 0)).select(T.tail_fit(F.col("n"), F.col("t"), F.lit(0), F.lit(100)).alias("f"))
    assert [tuple(r.f) for r in fits.collect()] == [(-3, 100, True), (-5, 97, True), (-5, 95, False), (0, 100, False), (0, 100, False)]


def test_links_and_spans(spark):
    cases = ["보기 https://www.law.go.kr에서 끝", "https://a.kr/법령/개인정보보호법.", "(https://a.kr/x_(y))", "[표시](https://b.kr) 뒤", "![그림](https://c.kr/a.png)", "[^1] 주", "<https://d.kr>"]
    got = [[(p["text"], p["url"]) for p in r] for r in column(spark, cases, I.links)]
    urls = [[u for _, u in r if u] for r in got]
    assert urls == [["https://www.law.go.kr"], ["https://a.kr/법령/개인정보보호법"], ["https://a.kr/x_(y)"], ["https://b.kr"], [], [], ["https://d.kr"]]
    assert got[0][-1] == ("에서 끝", None)
    assert column(spark, ["[" + "가" * 30 + "](https://a.kr)", "[짧은 글](https://a.kr)"], I.left_aligned) == [True, False]
    assert [[(s["text"], s["bold"], s["italic"]) for s in r] for r in column(spark, ["a **b** *c* \\*d\\* $x*y*z$"], I.spans)] == [[("a ", False, False), ("b", True, False), (" ", False, False), ("c", False, True), (" *d* $x*y*z$", False, False)]]


def test_markdown(spark):
    text = "# 1. Top\n\ntext one\ntext two\n\n\n- a\n  - b\n1. n\n---\n표 제목\n| x | y |\n|:-:|--:|\n| 1 | a\\|b |\n주) note\n\n![alt](p.png)\n출처) s\n\n$$\nx^2\n$$\n[^1]: foot\n  more\nend [^1]\n<!-- gone -->"
    got = B.parse_markdown(table(spark, "doc_id long, text string", (1, text), (2, None))).orderBy("ord").collect()
    assert [(r.kind, r.level, r.text, r.blank_before) for r in got] == [("heading", 1, "Top", 0), ("paragraph", 0, "text one text two", 1), ("bullet", 1, "a", 2), ("bullet", 2, "b", 0), ("ordered", 1, "n", 0), ("rule", 0, "", 0), ("table", 0, "", 0), ("figure", 0, "alt", 1), ("math", 0, "x^2", 1), ("paragraph", 0, "end [^1]", 0)]
    t = got[6]
    assert t.rows == [["x", "y"], ["1", "a|b"]] and t.aligns == ["center", "right"] and t.caption == "표 제목" and t.note == "주) note" and got[7].note == "출처) s"
    assert B.footnote_definitions(table(spark, "doc_id long, text string", (1, text))).collect() == [(1, "1", "foot more")]
    front = '\ufeff---\ntitle: "a\\nb"\n# c\nco:\n  - x 1\n  - \'it\'\'s\'\nnote: |\n  p: 1\n  - q\nbare: x: y\nnone:\n---\nbody\n---\n'
    got = {r.doc_id: (r.meta, r.body) for r in B.split_front_matter(table(spark, "doc_id long, text string", (1, front), (2, "# none\n---\n"), (3, None))).collect()}
    assert got == {1: ({"title": ["a\nb"], "co": ["x 1", "it's"], "note": ["p: 1\n- q"], "bare": ["x: y"], "none": []}, "body\n---\n"), 2: ({}, "# none\n---\n"), 3: (None, None)}


LINKS = [
    ("plain", [("plain", None)]),
    ('[보고서](https://b.org/r.pdf "제목")', [("보고서", "https://b.org/r.pdf")]),
    ("[위키](https://a.org/(x)) 끝", [("위키", "https://a.org/(x)"), (" 끝", None)]),
    ("https://x.kr/page에서", [("https://x.kr/page", "https://x.kr/page"), ("에서", None)]),
    ("https://e.com/a?x=1&y=2.", [("https://e.com/a?x=1&y=2", "https://e.com/a?x=1&y=2"), (".", None)]),
    ("「https://a.kr/b」", [("「", None), ("https://a.kr/b", "https://a.kr/b"), ("」", None)]),
    ("각주[^a] ![x](https://i.png)", [("각주[^a] ![x](https://i.png)", None)]),
    ("[상대](./a.md) ![x](<https://i.png>)", [("[상대](./a.md) ![x](<https://i.png>)", None)]),
    ("https://e.com/search?q=제주 검색", [("https://e.com/search?q=제주", "https://e.com/search?q=제주"), (" 검색", None)]),
    ("https://e.com/#섹션", [("https://e.com/#섹션", "https://e.com/#섹션")]),
    ("\\[x\\](https://a.kr/b) 끝", [("[x](", None), ("https://a.kr/b", "https://a.kr/b"), (") 끝", None)]),
    ("[a \\*b\\*](https://a.kr)", [("a *b*", "https://a.kr")]),
    ("[a](https://a.kr/c\\_d) [x](https\\://b.kr)", [("a", "https://a.kr/c_d"), (" ", None), ("x", "https://b.kr")]),
    ("https://", [("https://", None)]),
    ("", []),
]


def test_links_of_escapes_and_brackets():
    assert [[(p["text"], p["url"]) for p in I.link_pieces(t)] for t, _ in LINKS] == [want for _, want in LINKS]


def test_spans_of_escapes_code_and_math():
    cases = ["코드 `\\-` 와 `` `\\*` `` 는", r"C:\Users\x", r"\*a\* **b\*c**", "$a*b*c$ *d*", "**a** * b *", "x ** y", r"$x \, y \_ z$", "", "*a\nb*"]
    assert [[(s["text"], s["bold"], s["italic"]) for s in I.inline_spans(t)] for t in cases] == [
        [("코드 `\\-` 와 `` `\\*` `` 는", False, False)],
        [(r"C:\Users\x", False, False)],
        [("*a* ", False, False), ("b*c", True, False)],
        [("$a*b*c$ ", False, False), ("d", False, True)],
        [("a", True, False), (" ", False, False), (" b ", False, True)],
        [("x ** y", False, False)],
        [(r"$x \, y \_ z$", False, False)],
        [],
        [("*a\nb*", False, False)],
    ]


def test_markdown_of_figures_captions_and_rows(spark):
    text = (
        "앞말\n[그림 1] 제목\n![](a.png) ![둘](<b c.png>){#f}\n![](d.png)\n자료: x\n주) y\n\n"
        "표 제목\n\n| a | b |\n|---|:--:|\n| $\\left| x \\right|$ | 1 |\n\n다음 a | b 아님\n+ 아님\n\\- 아님\n\n- - -\n--\n$$\\begin{x}\n y\n$$\n$$ a $$\n$$ open\n## A형 조사"
    )
    got = B.parse_markdown(table(spark, "doc_id long, text string", (1, text))).orderBy("ord").collect()
    assert [(r.kind, r.level, r.text, r.blank_before) for r in got] == [("paragraph", 0, "앞말", 0), ("figure", 0, "둘", 0), ("table", 0, "", 1), ("paragraph", 0, "다음 a | b 아님 + 아님 \\- 아님", 1), ("rule", 0, "", 1), ("paragraph", 0, "--", 0), ("math", 0, "\\begin{x}\n y", 0), ("math", 0, "a", 0), ("paragraph", 0, "$$ open", 0), ("heading", 2, "A형 조사", 0)]
    figure, t = got[1], got[2]
    assert (figure.caption, figure.paths, figure.label, figure.note) == ("제목", ["a.png", "b c.png", "d.png"], "f", "자료: x\n주) y")
    assert t.caption == "표 제목" and t.rows == [["a", "b"], ["$\\left| x \\right|$", "1"]] and t.aligns == ["left", "center"]
    bullets = B.parse_markdown(table(spark, "doc_id long, text string", (1, "● a\n  - b\n\t* c")), literal_bullets=True).orderBy("ord").collect()
    assert [(r.kind, r.level, r.text) for r in bullets] == [("bullet", 1, "a"), ("bullet", 2, "b"), ("bullet", 2, "c")]


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in parts.items():
            z.writestr(zipfile.ZipInfo(name), content)
    return out.getvalue()


def test_packages(spark, tmp_path):
    section = '<s:sec xmlns:s="u" xmlns:p="v"><p:p styleIDRef="1" paraPrIDRef="2"><p:run><p:t>a<p:lineBreak/>b<p:tab/>c</p:t></p:run><p:linesegarray><p:lineseg/></p:linesegarray></p:p><p:p styleIDRef="0"><p:run><p:tbl><p:tr><p:tc><p:subList><p:p><p:run><p:t>cell</p:t></p:run></p:p></p:subList><p:cellAddr rowAddr="0" colAddr="1"/><p:cellSpan rowSpan="2" colSpan="1"/><p:cellSz width="5" height="7"/></p:tc></p:tr></p:tbl></p:run></p:p></s:sec>'
    head = '<hh:head><hh:styles itemCnt="3"><hh:style id="0" name="a"/><hh:style id="2" name="b"/></hh:styles></hh:head>'
    hpf = '<opf:package xmlns:opf="o"><opf:metadata><opf:title>T</opf:title><opf:meta name="creator" content="text">me</opf:meta></opf:metadata></opf:package>'
    (tmp_path / "a.hwpx").write_bytes(package({"Contents/section0.xml": section, "Contents/header.xml": head, "Contents/content.hpf": hpf, "BinData/image1.png": b"x"}))
    (tmp_path / "b.hwpx").write_bytes(b"not a zip")
    (tmp_path / "c.hwpx").write_bytes(package({"Contents/section0.xml": "<s:sec xmlns:s='u'><p", "Contents/section1.xml": "<sec/>"}))
    found = packages.contents(packages.scan(spark, str(tmp_path))).cache()
    assert {(r.doc_id, r.part_name) for r in packages.errors(found).collect()} == {("b.hwpx", None), ("c.hwpx", "Contents/section0.xml")} and found.where("part_name like 'BinData%'").count() == 0
    p = packages.paragraphs(found).orderBy("para_idx").collect()
    assert [(r.text, r.line_breaks, r.line_segs, r.in_cell, r.has_table) for r in p] == [("a\nb\tc", 1, 1, False, False), ("", 0, 0, False, True), ("cell", 0, 0, True, False)]
    assert [tuple(r)[2:] for r in packages.cells(found).collect()] == [(0, 0, 1, 2, 1, 5, 7, "cell")]
    assert [tuple(r)[1:] for r in packages.header_items(found).orderBy("pos").collect()] == [("styles", 1, 0, 3), ("styles", 2, 2, 3)]
    assert packages.metadata(found).select("title", "creator", "language").first() == ("T", "me", None)
    assert {(r.item, r.ref_id, r.n) for r in packages.refs(found).collect()} == {("style", 1, 1), ("style", 0, 1), ("paraPr", 2, 1)}
    assert [tuple(r)[1:] for r in packages.tables(found).collect()] == [(0, 0, 1, 0, 0, None, 0, None)]
    around = {r.kind: (r.node, r.stop) for r in packages.nodes(found).where("doc_id = 'a.hwpx' and coalesce(text, 'x') in ('', 'cell', 'x')").collect() if r.text != "cell"}
    assert around["paragraph"][0] < around["table"][0] <= around["table"][1] <= around["paragraph"][1]
    parts = packages.parts(packages.scan(spark, str(tmp_path)))
    assert parts.where("part_name = 'Contents/section0.xml' and doc_id = 'a.hwpx'").first().content == section.encode()
    assert checks.fingerprints(parts.where("error is null"), "META-INF/fp").count() == 2
    packages.write_texts(p and spark.createDataFrame([(1, "t")], "doc_id long, markdown string"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def damaged(name):
    """Packages that can't be read as a whole: cut, one flipped byte in the data, a member marked as encrypted, one that is too large."""
    good = package({"Contents/section0.xml": "<sec>" + "<p><run><t>text</t></run></p>" * 50 + "</sec>", "Contents/section1.xml": "<sec><p/></sec>"})
    if name == "cut":
        return good[: len(good) // 2]
    if name == "crc":
        at = good.index(b"text") + 1
        return good[:at] + b"T" + good[at + 1 :]
    if name == "deflate":
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("Contents/section0.xml", "<sec>" + "".join(f"<p a='{i * i % 97}'/>" for i in range(500)) + "</sec>")
            z.writestr("Contents/section1.xml", "<sec><p/></sec>")
        raw = bytearray(out.getvalue())
        raw[80:120] = b"\xff" * 40
        return bytes(raw)
    if name == "encrypted":
        raw = bytearray(good)
        for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
            raw[raw.index(mark) + at] |= 1
        return bytes(raw)
    return good


def test_what_cannot_be_read_is_an_error_row(spark):
    names = ["cut", "crc", "deflate", "encrypted", "large", None]
    df = spark.createDataFrame([(str(n), damaged(n) if n else None) for n in names], "doc_id string, content binary").repartition(2)
    found = packages.contents(df, largest=500).cache()
    errors = {(r.doc_id, r.part_name): r.error for r in packages.errors(found).collect()}
    whole = {("cut", None), ("None", None)}
    assert set(errors) == whole | {(n, "Contents/section0.xml") for n in ("crc", "deflate", "encrypted", "large")} and all(errors.values())
    assert {(r.doc_id, r.section_no) for r in packages.paragraphs(found).collect()} == {(n, 1) for n in ("crc", "deflate", "encrypted", "large")}
    found = packages.contents(df)
    errors = {(r.doc_id, r.part_name): r.error.split(":")[0] for r in packages.errors(found).collect()}
    assert {n: errors[n, "Contents/section0.xml"] for n in ("crc", "deflate", "encrypted")} == {"crc": "BadZipFile", "deflate": "error", "encrypted": "RuntimeError"} and ("large", "Contents/section0.xml") not in errors


def test_one_walk_for_all_kinds(spark):
    """All tables come from one Python stage, nested tables keep their cells apart."""
    inner = '<p:tbl rowCnt="1" colCnt="1"><p:tr><p:tc><p:subList><p:p><p:run><p:t>in</p:t></p:run></p:p></p:subList></p:tc></p:tr></p:tbl>'
    caption = '<p:caption><p:subList><p:p><p:run><p:t>{{table 1}}</p:t></p:run></p:p></p:subList></p:caption>'
    outer = f'<p:tbl rowCnt="1" colCnt="2" pageBreak="TABLE"><p:pos treatAsChar="1"/>{caption}<p:tr><p:tc><p:subList><p:p><p:run><p:t>a</p:t>{inner}</p:run></p:p><p:p><p:run><p:t>b</p:t></p:run></p:p></p:subList><p:cellAddr rowAddr="0" colAddr="0"/></p:tc><p:tc><p:cellAddr rowAddr="0" colAddr="1"/></p:tc></p:tr></p:tbl>'
    section = f'<s:sec xmlns:s="u" xmlns:p="v"><p:p><p:run>{outer}<p:t>x<p:mark>y</p:mark>&amp;<p:lineBreak/>z</p:t></p:run></p:p></s:sec>'
    found = packages.contents(spark.createDataFrame([("a", package({"Contents/section0.xml": section}))], "doc_id string, content binary"))
    assert {(r.table_index, r.row, r.col, r.text) for r in packages.cells(found).collect()} == {(0, 0, 0, "a\nb"), (0, 0, 1, ""), (1, 0, 0, "in")}
    assert {tuple(r)[2:] for r in packages.tables(found).collect()} == {(0, 0, 1, 2, "TABLE", 1, "{{table 1}}"), (1, 2, 1, 1, None, 0, None)}
    assert [(r.para_idx, r.text, r.in_cell) for r in packages.paragraphs(found).orderBy("para_idx").collect()] == [(0, "xy&\nz", False), (1, "{{table 1}}", False), (2, "a", True), (3, "in", True), (4, "b", True)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def landed_package(text):
    return package({"Contents/section0.xml": f"<sec><p><run><t>{text}</t></run></p></sec>"})


def texts_of(spark, target):
    return {r.doc_id: r.text for r in packages.paragraphs(landing.contents(spark, target)).collect()}


def test_landing_rewrites_what_changed(spark, tmp_path):
    folder, target = tmp_path / "in", str(tmp_path / "landed")
    folder.mkdir()
    for i in range(100):
        (folder / f"{i}.hwpx").write_bytes(landed_package(f"text {i}"))
    assert landing.land(packages.scan(spark, str(folder)), target) == 0
    (folder / "7.hwpx").write_bytes(landed_package("changed!"))
    os.utime(folder / "8.hwpx", (1, 1))
    (folder / "9.hwpx").unlink()
    (folder / "new.hwpx").write_bytes(b"no package")
    assert landing.land(packages.scan(spark, str(folder)), target) == 1
    second = {r.doc_id: r.status for r in landing.log(spark, target).where("run = 1").collect()}
    assert second == {"7.hwpx": "landed", "8.hwpx": "touched", "9.hwpx": "removed", "new.hwpx": "landed"}
    rows = spark.read.parquet(f"{target}/rows/run=1")
    assert {r.doc_id for r in rows.select("doc_id").distinct().collect()} == {"7.hwpx", "new.hwpx"}
    want = {f"{i}.hwpx": f"text {i}" for i in range(100) if i != 9} | {"7.hwpx": "changed!"}
    assert texts_of(spark, target) == want
    assert [(r.doc_id, r.part_name) for r in packages.errors(landing.contents(spark, target)).collect()] == [("new.hwpx", None)]
    assert landing.land(packages.scan(spark, str(folder)), target) == 2 or landing.log(spark, target).where("run = 2").count() == 0
    (folder / "7.hwpx").write_bytes(landed_package("text 7"))  # back to what it was, and a removed one returns
    (folder / "9.hwpx").write_bytes(landed_package("text 9"))
    landing.land(packages.scan(spark, str(folder)), target)
    assert texts_of(spark, target) == {f"{i}.hwpx": f"text {i}" for i in range(100)}
    landing.compacted(spark, target, str(tmp_path / "compact"))
    assert texts_of(spark, str(tmp_path / "compact")) == texts_of(spark, target) and spark.read.parquet(str(tmp_path / "compact/rows")).where("kind = 'paragraph'").count() == 100


def test_landing_as_a_stream(spark, tmp_path):
    folder, target, checkpoint = tmp_path / "in", str(tmp_path / "landed"), str(tmp_path / "checkpoint")
    for day, texts in ((1, {"a": "one", "b": "two"}), (2, {"a": "one", "b": "three", "c": "four"})):
        (folder / str(day)).mkdir(parents=True)
        for name, text in texts.items():
            (folder / str(day) / f"{name}.hwpx").write_bytes(landed_package(text))
        landing.follow(spark, str(folder), target, checkpoint).awaitTermination()
    assert texts_of(spark, target) == {"a.hwpx": "one", "b.hwpx": "three", "c.hwpx": "four"}
    assert {r.doc_id: (r.status, r.rows_run) for r in landing.current(spark, target).collect()} == {"a.hwpx": ("touched", 0), "b.hwpx": ("landed", 1), "c.hwpx": ("landed", 1)}


def test_forms(spark):
    slots = table(spark, "doc_id long, kind string, locator string, name string, current string", (1, "cell", "cell:0:0:1", "성 명", ""), (1, "placeholder", "title", "title", ""), (1, "label", "기간", "기간", "x"))
    mapping = table(spark, "doc_id long, key string, value string", (1, "성명", "홍"), (1, "title", "T"), (1, "none", "?"))
    filled = forms.fill(slots, mapping)
    assert {(r.locator, r.value, r.filled) for r in filled.collect()} == {("cell:0:0:1", "홍", True), ("title", "T", True), ("기간", "x", False)}
    assert [r.key for r in forms.missing_keys(slots, mapping).collect()] == ["none"]
    assert [r.locator for r in forms.blank_slots(slots, filled).collect()] == ["기간"]
    assert forms.fill_summary(filled).collect() == [(1, 2, 1)]
    p = table(spark, "doc_id long, section_no long, para_idx long, text string, has_table boolean", (1, 0, 0, "□ 변경사항 :", False), (1, 0, 1, "t", True), (1, 0, 2, "□ 변경사유 :", False), (1, 0, 3, "", False), (1, 0, 4, "□ 유형 : ", False), (1, 0, 5, "{{a}} {{a}}", False))
    assert {(r.kind, r.name) for r in forms.section_slots(p).collect()} == {("section", "변경사유"), ("label", "유형")}
    cells = table(spark, "doc_id long, table_index long, row long, col long, row_span long, col_span long, text string, height long", (1, 0, 0, 0, 1, 1, "과제명", 5), (1, 0, 0, 1, 1, 1, "", 9), (1, 0, 1, 0, 1, 1, "책임자", 4), (1, 0, 1, 1, 1, 1, "홍", 4))
    assert [(r.text, r.side) for r in forms.label_targets(cells).collect()] == [("과제명", "right")]
    assert forms.box_height(cells).collect() == [(1, 0, 13)]
    more = table(spark, "doc_id long, section_no long, para_idx long, text string, has_table boolean", (1, 0, 6, "☑ 동의함 x", False), (1, 0, 7, "전화\t02\t03", False))
    every = {(r.kind, r.locator, r.name, r.current) for r in forms.all_slots(p.unionByName(more), cells).collect()}
    assert every == {("placeholder", "a", "a", None), ("cell", "cell:0:0:1", "과제명", ""), ("section", "section:변경사유", "변경사유", None), ("label", "label:유형", "유형", None), ("checkbox", "checkbox:동의함", "동의함", "on"), ("inline", "tab:전화", "전화", "0203")}
    keys = table(spark, "doc_id long, key string, value string", (1, "책임자 > right", "김"), (1, "과제명 > right", "P"), (1, "checkbox:동의함", "0"), (1, "tab:전화", "t"), (1, "section: x", "?"), (1, "없음 > left", "?"))
    asked = forms.located(keys, cells)
    assert {(r.key, r.value) for r in asked.collect()} == {("cell:0:1:1", "김"), ("cell:0:0:1", "P"), ("checkbox:동의함", "0"), ("tab:전화", "t"), ("section: x", "?"), ("없음 > left", "?")}
    routed = {(r.locator, r.value) for r in forms.fill(forms.all_slots(more, cells), asked).where("filled").collect()}
    assert routed == {("cell:0:0:1", "P"), ("checkbox:동의함", "off"), ("tab:전화", "t")}
    piped = table(spark, "doc_id long, table_index long, row long, col long, row_span long, col_span long, text string", (1, 0, 0, 0, 1, 2, "a|b $x|y$"), (1, 0, 1, 0, 1, 1, "p\nq"), (1, 0, 1, 1, 1, 1, None))
    assert forms.pipe_tables(piped, table(spark, "doc_id long, table_index long, caption string", (1, 0, " 표 1 "))).collect() == [(1, 0, "표 1\n\n| a\\|b $x|y$ | a\\|b $x|y$ |\n|---|---|\n| p<br>q |  |")]
    items = table(spark, "doc_id long, i long, field string, value string", (1, 0, "책임자", "김"), (1, 5, "책임자", "far"))
    rep = forms.repeated_section(table(spark, cells.drop("height").schema.simpleString()[7:-1].replace(":", " "), (1, 0, 0, 0, 1, 1, "책임자"), (1, 0, 0, 1, 1, 1, "소속"), (1, 0, 1, 0, 1, 1, ""), (1, 0, 1, 1, 1, 1, "")), {"책임자": "책임자", "소속": "소속"}, items)
    assert [(r.row, r.col, r.value) for r in rep.collect()] == [(1, 0, "김")]


def test_edits(spark):
    cells = table(spark, "doc_id long, table_index long, row long, col long, row_span long, text string", *[(1, 0, r, 0, 1, str(r)) for r in range(5)], *[(2, 0, r, 0, 2, str(r)) for r in (0, 2)])
    ranges = table(spark, "doc_id long, table_index long, first long, last long", (1, 0, 1, 2), (2, 0, 0, 0))
    got = edits.delete_rows(cells, ranges).collect()
    assert sorted((r.doc_id, r.row, r.text, r.error) for r in got if r.doc_id == 1) == [(1, 0, "0", None), (1, 1, "3", None), (1, 2, "4", None)]
    assert {(r.row, r.error) for r in got if r.doc_id == 2} == {(0, "split merge"), (2, "split merge")}
    repeats = table(spark, "doc_id long, table_index long, first long, last long, n long", (1, 0, 0, 1, 2), (1, 0, None, None, 1), (2, 0, 1, 2, 1))
    got = edits.repeat_rows(cells, repeats).collect()
    assert sorted((r.row, r.text) for r in got if r.doc_id == 1) == [(0, "0"), (1, "1"), (2, ""), (3, ""), (4, ""), (5, ""), (6, "2"), (7, "3"), (8, "4"), (9, "")]
    assert {(r.row, r.error) for r in got if r.doc_id == 2} == {(0, "split merge"), (2, "split merge")}
    both = edits.restructure_rows(cells, table(spark, "doc_id long, table_index long, first long, last long", (1, 0, 1, 3)), repeats)
    assert sorted((r.row, r.text, r.error) for r in both.collect() if r.doc_id == 1) == [(i, str(i), "overlap") for i in range(5)]
    p = table(spark, "doc_id long, section_no long, para_idx long, text string", (1, 0, 0, "a"), (1, 0, 1, "b"))
    new = table(spark, "doc_id long, section_no long, anchor_idx long, before boolean, i int, text string", (1, 0, 1, True, 0, "x"), (1, 0, 0, True, 0, "w"), (1, 0, 1, False, 0, "z"))
    assert [r.text for r in edits.insert_paragraphs(p, new).orderBy("para_idx").collect()] == ["w", "a", "x", "b", "z"]
    t = table(spark, "doc_id long, table_index long, caption string", (1, 0, "x"), (1, 1, "표 {{ Table_template:sample }}"), (1, 2, "{{table 1}}"), (1, 3, None), (2, 0, "standard"), (2, 1, "표 7"), (3, 0, None))
    assert [r.table_index for r in edits.without_residue(t.where("doc_id = 1")).orderBy("table_index").collect()] == [0, 2, 3]
    assert sorted(markdown.reference_table(t).collect()) == [(1, 1, True), (2, 0, False), (3, 0, False)]
    assert sorted(markdown.reference_table(t, "표 [0-9]").collect()) == [(1, 1, True), (2, 1, True), (3, 0, False)]
    held = table(spark, "doc_id long, table_index long, treat_as_char long, page_break string", (1, 0, 1, "TABLE"), (1, 1, 0, "TABLE"), (1, 2, 0, "CELL"), (1, 3, 1, None), (2, 0, 0, None))
    assert [tuple(r)[1:] for r in edits.released_tables(held).orderBy("doc_id", "table_index").collect()] == [(0, 0, "CELL", True), (1, 0, "CELL", True), (2, 0, "CELL", False), (3, 0, None, True), (0, 0, None, False)]
    values = table(spark, "doc_id long, key string, value string", (1, "a", "x" * 201), (1, "b", None), (2, "a", "x" * 999))
    assert edits.flow_warnings(held, values).collect() == [(1, "may be cut off", 2)] and edits.flow_warnings(held, values, release=True).collect() == [(1, "released", 3)]
    assert edits.flow_warnings(held, values.where("doc_id = 2")).count() == 0
    ip = table(spark, "doc_id long, section_no long, para_idx long, indent long, text string", (1, 0, 0, 0, "a"), (1, 0, 4, 0, "b"), (1, 0, 90, 5, "c"), (1, 0, 2, 7, " "))
    assert [tuple(r)[3:] for r in edits.indent_templates(ip, table(spark, "doc_id long, section_no long, para_idx long", (1, 0, 2))).collect()] == [(0, 0)]


def test_mapping_of_odd_profiles(spark):
    """Several values of a field, several persons of a document, none, and own aliases; a repeated cell owns its slot in its document alone."""
    slots = table(spark, "doc_id long, locator string, name string", (1, "cell:0:1:0", "성 명"), (1, "b", "비고"), (1, "c", "작성일"), (2, "cell:0:1:0", "성 명"), (3, "d", "성 명"), (4, "e", None))
    assigned = table(spark, "doc_id long, person_id long", (1, 7), (2, 7), (2, 8), (4, None))
    people = table(spark, "person_id long, field string, value string", (7, "name", "김"), (7, "note", "n"), (7, "extra.작성일", "@today"), (8, "name", "이"), (8, "name", None), (8, None, "x"))
    matched = sorted(map(tuple, forms.matched_slots(slots, people, assigned).collect()), key=str)
    assert matched == sorted([(1, "cell:0:1:0", "name", "김"), (1, "b", "extra.비고", None), (1, "c", "extra.작성일", "@today"), (2, "cell:0:1:0", "name", "김"), (2, "cell:0:1:0", "name", "이"), (2, "cell:0:1:0", "name", None), (4, "e", None, None)], key=str)
    own = table(spark, "person_id long, label string, field string", (7, "비고", "note"), (8, "성명", "none"))
    assert {(r.doc_id, r.field, r.value) for r in forms.matched_slots(slots, people, assigned, own).collect()} == {(1, "name", "김"), (1, "note", "n"), (1, "extra.작성일", "@today"), (2, "name", "김"), (2, "none", None), (4, None, None)}
    cells = table(spark, "doc_id long, table_index long, row long, col long, row_span long, col_span long, text string", (1, 0, 0, 0, 1, 1, "A"), (1, 0, 0, 1, 1, 1, "a"), (1, 0, 1, 0, 1, 1, ""), (1, 1, 0, 0, 1, 1, "A"), (1, 1, 0, 1, 1, 1, "A"), (1, 1, 9, 0, 1, 1, ""), (2, 0, 0, 0, 1, 1, "A"), (2, 0, 1, 0, 1, 1, "a"))
    items = table(spark, "doc_id long, i long, field string, value string", (1, 0, "f", "x"), (1, 1, "f", "past the end"), (1, 0, "g", "other"), (2, 0, "f", "no head"))
    repeated = forms.repeated_section(cells, {"a": "f"}, items)
    assert sorted(map(tuple, repeated.collect())) == [(1, 0, 1, 0, "f", "x"), (1, 0, 1, 1, "f", "x")]
    for labels in (False, True):
        got = forms.build_mapping(forms.matched_slots(slots, people, assigned, labels=labels), repeated, slots, "t", ["이름"]).collect()
        assert sorted(map(tuple, got), key=str) == sorted([(1, "cell:0:1:0", "x", "repeated"), (1, "cell:0:1:1", "x", "repeated"), (1, "b", None, "blank"), (1, "c", "t", "today"), (2, "cell:0:1:0", "김", "matched"), (2, "cell:0:1:0", "이", "matched"), (2, "cell:0:1:0", None, "blank"), (4, "e", None, "blank")], key=str)


def test_media(spark):
    p = table(spark, "doc_id long, page long, hashes array<string>", *[(1, i, [h]) for i, h in enumerate("AABBBCC", 1)], *[(2, i, [h]) for i, h in enumerate("xyxyx", 1)], (3, 1, None))
    got = sorted((r.doc_id, r.first_page, r.last_page, r.letter) for r in media.bands(media.recurring_hashes(p)).collect())
    assert got == [(1, 1, 2, "A"), (1, 3, 5, "B"), (1, 6, 7, "C"), (2, 1, 5, "A"), (3, 1, 1, "—")]
    req = table(spark, "doc_id long, request_id long, ref string, caption string, ext string, present boolean", (1, 1, "i1", None, "png", True), (1, 2, None, "cap", "png", True), (1, 3, None, "a", "png", True), (1, 4, None, "zzz", "png", True), (1, 5, "i1", None, "jpg", True), (1, 6, "i1", None, "png", False), (1, 7, "zzz", None, None, True), (1, 8, "i3", None, "jpeg", True))
    pics = table(spark, "doc_id long, ref string, caption string, ext string", (1, "i1", "cap", "png"), (1, "i2", "cap a", "png"), (1, "i3", "a b", "JPG"))
    assert {(r.request_id, r.ref, r.status) for r in media.match_images(req, pics).collect()} == {(1, "i1", "replaced"), (2, "i1", "replaced"), (3, None, "ambiguous"), (4, None, "unmatched"), (5, "i1", "format_mismatch"), (6, None, "missing_file"), (7, None, "bad_image"), (8, "i3", "replaced")}
    assert media.next_image_id(table(spark, "doc_id long, id string", (1, "image9"), (1, "x"), (2, "y"))).orderBy("doc_id").collect() == [(1, 10), (2, 1)]


def test_checks(spark):
    f = table(spark, "doc_id long, section_no long, field_id string, side string", (1, 0, "a", "begin"), (1, 0, "a", "end"), (1, 0, "b", "begin"), (1, 1, "b", "end"))
    assert {(r.section_no, r.finding) for r in checks.unpaired_fields(f).collect()} == {(0, "begin alone"), (1, "end alone")}
    v = table(spark, "name string, version long", ("a", 1), ("a", 2), ("a", 4), ("b", 1))
    assert sorted(checks.next_version(v).collect()) == [("a", 3), ("b", 2)]
    g = checks.output_guard(table(spark, "path string, force boolean", ("new", False), ("own", False), ("drift", False), ("foreign", False), ("f", True)), table(spark, "path string, fingerprint string", ("own", "1"), ("drift", "1")), table(spark, "path string, fingerprint string", ("own", "1"), ("drift", "2"), ("foreign", "3"), ("f", "4")))
    assert dict(g.collect()) == {"new": "new", "own": "overwrite-own", "drift": "versioned-drift", "foreign": "versioned-foreign", "f": "overwrite-own"}
    o = table(spark, "doc_id long, part_name string, numbering_type string, has_caption boolean", (1, "Contents/section0.xml", "TABLE", False), (1, "Contents/section0.xml", "TABLE", True), (1, "Contents/header.xml", "TABLE", False))
    assert [r.numbering_type for r in checks.neutral_numbering(o).collect()] == ["NONE", "TABLE", "TABLE"]
    c = checks.marker_census(table(spark, "doc_id long, section_no long, text string", (1, 0, "{{body}} {{body}} {{odd}} {{title}} {{title}}")))
    assert {(r.token, r.finding) for r in checks.marker_warnings(c, ["body"], ["title"]).collect()} == {("body", "ambiguous"), ("odd", "unrecognized")}
    judged = table(spark, "doc_id long, page long, ok boolean, issues array<struct<type:string,detail:string>>", (1, 1, None, None), (2, 1, True, []), (2, 2, False, [("object_overlap", "a"), ("object_overlap", "b"), ("empty_page", "")]), (3, 1, True, None), (4, 1, True, None), (5, 1, True, None))
    documents = table(spark, "doc_id long, page_count int, error string", (1, 1, None), (2, 3, ""), (3, 1, ""), (4, 1, "no file"), (5, 0, None), (6, 2, None))
    got = {r.doc_id: r for r in checks.page_verdicts(judged, documents).collect()}
    assert {i: (r.checked, r.passed, r.problem_pages) for i, r in got.items()} == {1: (0, False, ""), 2: (2, False, "2"), 3: (1, True, ""), 4: (1, False, ""), 5: (1, False, ""), 6: (0, False, "")}
    assert (got[2].n_object_overlap, got[2].n_empty_page, got[2].n_missing_image, got[6].n_layout_broken, got[4].error) == (2, 1, 0, 0, "no file")
    parts = [(d, n, c) for d, names in (("a", ["Contents/b", "Contents/a", "é", "META-INF/fp"]), ("b", ["x"]), ("c", ["META-INF/fp"])) for n in names for c in [bytes(d + n, "utf-8") * 9]]
    df = spark.createDataFrame([*parts, ("b", "empty", None)], "doc_id string, part_name string, content binary").repartition(3)
    want = {}
    for d, n, c in sorted([*parts, ("b", "empty", b"")], key=lambda p: (p[0], p[1].encode())):
        if n != "META-INF/fp":
            want.setdefault(d, hashlib.sha256()).update(n.encode() + b"\0" + c)
    digests = checks.fingerprints(df, "META-INF/fp")
    assert dict(digests.collect()) == {d: h.hexdigest() for d, h in want.items()}
    assert "collect_list" not in digests._jdf.queryExecution().optimizedPlan().toString()


def test_office_and_meta(spark):
    ends = table(spark, "doc_id long, end_date date", (1, date(2026, 1, 1)), (2, date(2030, 1, 1)), (3, date(2000, 1, 1)))
    holders = table(spark, "first date, last date, name string", (date(2025, 5, 2), date(2026, 10, 5), "A"), (date(2026, 10, 6), None, "B"))
    assert {(r.doc_id, r.name) for r in markdown.office_holder(ends, holders).collect()} == {(1, "A"), (2, "B"), (3, None)}
    m = markdown.merged_meta(table(spark, "doc_id long, priority int, key string, value string", (1, 1, "title", "b"), (1, 0, "title", "a"), (1, 0, "odd", "x")), ["title"])
    assert m.collect() == [(1, "title", "a")]
    s = markdown.meta_slots(table(spark, "doc_id long, name string, fallback string", (1, "title", None), (1, "printer", "P")), table(spark, "doc_id long, name string, value string", (1, "title", "")), ["title"])
    assert {(r.name, r.value, r.missing) for r in s.collect()} == {("title", "", "title"), ("printer", "P", None)}
    brief = markdown.meta_slots(table(spark, "doc_id long, name string, fallback string", (1, "title_1", None), (1, "title_2", None)), table(spark, "doc_id long, name string, value string", (1, "x", "")), ["title"])
    assert {(r.name, r.missing) for r in brief.collect()} == {("title_1", "title"), ("title_2", None)}
    co = markdown.co_researchers(table(spark, "a array<string>, b array<string>", (["x"], ["x", "y", "y"])), "a", "b")
    assert co.first().names == ["x", "y", "y"]


def test_revisions(spark, tmp_path):
    listing = table(spark, "name string, file_id string, modified_time string", ("a", "1", "2"), ("b", "1", "5"), ("n", "1", "1"))
    state = table(spark, "name string, file_id string, modified_time string", ("a", "1", "3"), ("b", "1", "5"), ("gone", "1", "1"))
    assert dict(revisions.changes(listing, state).collect()) == {"a": "changed", "b": "same", "n": "new", "gone": "disappeared"}
    assert dict(revisions.rerun_set(revisions.changes(listing, state)).collect()) == {"a": True, "b": False, "n": True}
    same = revisions.changes(state, state)
    assert revisions.rerun_set(same).count() == 0 and revisions.rerun_set(same, force=True).count() == 3


def test_keyed_revision_stream(spark, tmp_path):
    """Batches with an older time, a repeated batch, a confirmation behind its listing and a restart give the batch query's rows; silence makes a name disappear."""
    source, log, checkpoint = (str(tmp_path / x) for x in ("in", "log", "checkpoint"))
    t = [datetime(2026, 1, 1 + i) for i in range(9)]
    row = dict(zip(("name", "kind", "at", "file_id", "modified_time", "classification", "declarations"), [None] * 7, strict=True))

    def listed(name, at, time, file="1"):
        return row | {"name": name, "kind": "listed", "at": at, "file_id": file, "modified_time": time}

    def confirmed(name, at, time, n=1):
        return row | {"name": name, "kind": "confirmed", "at": at, "modified_time": time, "classification": "structured", "declarations": n}

    state = spark.createDataFrame([("old", t[0], "7", "flat", 0), ("lost", t[0], "7", "flat", 0)], "name string, at timestamp, modified_time string, classification string, declarations long")
    batches = [
        [listed("a", t[1], "5"), listed("b", t[1], "5"), listed("old", t[1], "7"), listed("a", t[1], "5")],
        [listed("a", t[1], "5"), confirmed("a", t[1], "5"), listed("c", t[1], "1", "9"), listed("c", t[1], "1", "8")],
        [listed("a", t[2], "4"), listed("b", t[2], "6"), confirmed("b", t[2], "6", 3), listed("old", t[2], "7")],
        [listed("a", t[2], "4"), listed("b", t[2], "6"), confirmed("b", t[2], "6", 3), listed("old", t[2], "7")],
        [listed("a", t[8], "4"), listed("old", t[8], "8")],
    ]
    wanted = [
        {"a": "new", "b": "new", "old": "same"},
        {"a": "same", "b": "new", "old": "same", "c": "new"},
        {"a": "changed", "b": "same", "old": "same", "c": "new"},
        {"a": "changed", "b": "same", "old": "same", "c": "new"},
        {"a": "changed", "b": "disappeared", "old": "changed", "c": "disappeared", "lost": "disappeared"},
    ]
    schema = spark.createDataFrame([], revisions.EVENTS).schema
    for rows, want in zip(batches, wanted, strict=True):
        spark.createDataFrame([tuple(r.values()) for r in rows], schema).coalesce(1).write.mode("append").parquet(source)
        stream = revisions.follow(spark.readStream.schema(schema).parquet(source), state, patience_ms=3 * 86_400_000, late="12 hours")
        revisions.followed(stream, log, checkpoint).awaitTermination()  # a new start each time, from the checkpoint
        found = {r.name: r for r in revisions.standing(spark, log).collect()}
        assert {n: r.status for n, r in found.items()} == want
    assert (found["b"].confirmed_time, found["b"].declarations, found["lost"].confirmed_time, found["c"].confirmed_time) == ("6", 3, "7", None)
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "done").load().select("key.name", "value.modified_time").collect()
    assert dict(held) == {"a": "5", "b": "6", "old": "7", "lost": "7"}


def test_partitioning_does_not_matter(spark):
    for name in ("wn1_role_map", "wn7_caption_numbers", "wn11_bands"):
        a = sorted(map(str, QUERIES[name](spark, SF).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        b = sorted(map(str, QUERIES[name](spark, SF).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert a == b


def test_ladders(spark):
    s = table(spark, "doc_id long, pos long, style_id string, name string, eng_name string, heading_type string, outline_level long, size_pt double, glyph string, use_count long", (1, 0, "0", "바탕글", "Normal", "NONE", None, 10.0, None, 9), (1, 1, "1", "로마자", "", "NONE", None, 20.0, None, 1), (1, 2, "2", "1.", "", "NONE", None, 13.0, None, 2), (1, 3, "3", "ㄱ", "", "BULLET", 0, 10.0, "■", 1), (1, 4, "4", "ㄴ", "", "BULLET", 1, 10.0, "●", 1))
    assert [(r.style_id, r.rung, r.status) for r in styles.heading_ladder(s).orderBy("rung").collect()] == [("1", 1, "ok"), ("2", 2, "ok")]
    assert [(r.style_id, r.rung, r.aborted) for r in styles.bullet_ladder(s).orderBy("rung").collect()] == [("3", 1, False), ("4", 2, False)]
    more = table(spark, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.schema), (2, 0, "1", "x", "", "BULLET", 0, 10.0, "■", 0), (2, 1, "2", "● head", "", "BULLET", 0, 10.0, "?", 4), (2, 2, "3", " - ", "", "NONE", None, 10.0, None, 1), (2, 3, "4", "- x", "", "NONE", None, 10.0, "●", 9), (3, 0, "1", "a", "", "BULLET", 0, None, "●", 1), (3, 1, "2", "b", "", "BULLET", 1, None, "○", 1), (4, 0, "1", "AI:BULLET_2", "", "NONE", None, 10.0, None, 3), (4, 1, "2", "b", "", "BULLET", 0, 10.0, "●", 3), (4, 2, "3", "1.", "", "NONE", None, 12.0, None, 1), (4, 3, "4", "로마자", "", "NONE", None, 14.0, None, 1))
    assert sorted(tuple(r) for r in styles.bullet_ladder(more.where("doc_id < 4")).collect()) == [(2, "2", 1, 1, False), (2, "3", 2, 2, False), (3, "1", 1, 1, True), (3, "2", 1, 2, True)]
    assert {tuple(r)[1:] for r in styles.normalization_plan(more.where("doc_id = 4")).collect()} == {("4", "HEADING_1", "flat", "structured"), ("3", "HEADING_2", "flat", "structured")}
    assert {(r.style_id, r.role, r.expected) for r in styles.normalization_plan(s).collect()} == {("1", "HEADING_1", "structured"), ("2", "HEADING_2", "structured"), ("3", "BULLET_1", "structured"), ("4", "BULLET_2", "structured")}


def test_layout(spark):
    seg = table(spark, "doc_id long, section_no long, para_idx long, line_no long, textpos long", (1, 0, 0, 0, 0), (1, 0, 0, 1, 97), (1, 0, 1, 0, 0))
    p = table(spark, "doc_id long, section_no long, para_idx long, text string, line_breaks long", (1, 0, 0, "x" * 100, 0), (1, 0, 1, "y", 0))
    assert layout.widow_tails(seg, p).collect() == [(1, 0, 0, 3, -3, 100, True)]
    assert layout.ladder(25, 3) == [(10, 0), (20, 0), (25, 0), (25, 2), (25, 3)]
    cells = table(spark, "doc_id long, table_index long, row long, text string, em double, height long", (1, 0, 0, "가" * 19, 9.5, 100), (1, 0, 0, "a", 9.5, 100))
    assert layout.row_growth(cells).collect() == [(1, 0, 0, 300)]


def plans_of(spark, cases, **how):
    """cases: ((page, para, number of lines, first line), ..., paras): each is a document of its own. A line is 1000 high with 300 below; each page begins at 0."""
    rows, infos = [], []
    for doc, (lines, paras) in enumerate(cases):
        at = {}
        for page, para, n, start in lines:
            for i in range(start, start + n):
                v = at.get(page, 0)
                at[page] = v + 1300
                rows.append((doc, 0, para, i, v, 1000, 300, paras[para].get("break", False) and i == 0, paras[para].get("note", 0) if i == 0 else 0))
        infos += [(doc, 0, i, x.get("kind", "text"), x.get("heading", False), x.get("sb", 0), x.get("sa", 0), True) for i, x in paras.items()]
    l = table(spark, "doc_id long, section_no long, para_idx long, line_no long, vertpos long, vertsize long, spacing long, forced_break boolean, note_height long", *rows)
    p = table(spark, "doc_id long, section_no long, para_idx long, kind string, heading boolean, sb long, sa long, percent boolean", *infos)
    out = [[] for _ in cases]
    for r in layout.page_plan(l, p, 10000, layout.ladder(), **how).orderBy("doc_id", "page").collect():
        out[r.doc_id].append(tuple(r)[2:])
    return out


def test_page_plan(spark):
    text, head = {}, {"heading": True}
    rest, heading, blank, forced = [(0, 0, 7, 0), (1, 0, 2, 7)], [(0, 0, 7, 0), (1, 1, 1, 0)], [(0, 0, 7, 0), (1, 1, 1, 0), (1, 2, 1, 0)], [(0, 0, 7, 0), (1, 1, 1, 0)]
    got = plans_of(spark, [
        (rest, {0: text}),  # bottom 8800; the flow goes on with 300 and two lines of 1300 less the last 300: 1400 too many for line spacing alone
        (rest, {0: {"sb": 3000}}),  # half of the paragraph spacing is enough
        ([*heading, (1, 2, 2, 0)], {0: text, 1: head, 2: text}),  # a heading takes the paragraph of two lines after it along
        ([*heading, (1, 2, 5, 0)], {0: text, 1: head, 2: text}),  # and the first two lines of one of four or more
        (heading, {0: text, 1: head}),  # a heading alone on its page stays
        ([*heading, (1, 2, 3, 0), (2, 2, 1, 3)], {0: text, 1: head, 2: text}),  # and so does one before three lines that go on
        ([(0, 0, 1, 0), (1, 1, 1, 0)], {0: text, 1: {"break": True}}),  # a forced break after a gap
    ])
    assert got[0] == [(0, 12.0, "gap", 2, 1400, "unfittable", None, None)]
    assert got[1] == [(0, 12.0, "gap", 2, 1400, "fittable", 50, 0)]
    assert [g[0][2:5] for g in got[2:4]] == [("gap", 3, 2700)] * 2
    assert [g[0][2:6] for g in got[4:6]] == [("gap", 0, 0, "unfittable")] * 2
    assert got[6] == [(0, 90.0, "forced", 0, 0, "forced", None, None)]
    got = plans_of(spark, [
        (blank, {0: text, 1: {"kind": "empty"}, 2: text}),  # blank paragraphs come along but don't count
        (heading, {0: text, 1: {"kind": "object"}}),  # an object is no pull
        ([(0, 0, 7, 0), (1, 1, 2, 0), (2, 1, 1, 2)], {0: text, 1: text}),  # a paragraph that goes on can't come back, its rest can
        (heading, {0: {"sa": 200}, 1: {"sb": 50, "sa": 999}}),  # spaces between, not behind
        (forced, {0: text, 1: {"break": True}}),  # no gap, nothing to tell
    ], threshold=20.0)
    assert got[0][0][2:5] == ("pull", 1, 8800 + 300 + 2 * 1300 - 300 - 10000)
    assert got[1] == got[4] == []
    assert got[2] == [(1, 77.0, "gap", 1, -6400, "fittable", 50, 4)]
    assert got[3][0][4] == 8800 + 300 + 200 + 50 + 1300 - 300 - 10000
    notes = [(0, 0, 6, 0), (1, 1, 1, 0)]
    got = plans_of(spark, [(notes, {0: text, 1: {"note": 400}}), (notes, {0: {"note": 500}, 1: {"note": 400}})], threshold=99.0, note_gap=30)
    assert [g[0][4] for g in got] == [7500 + 300 + 1000 + 430 - 10000, 7500 + 300 + 1000 + 930 - 10000]


def test_residue_of_templates(spark):
    """What lies in the outermost paragraph of a pattern goes with it; binaries that nothing else uses are found."""

    def p(inside, extra=""):
        return f"<p:p><p:run>{extra}{inside}</p:run></p:p>"

    def pic(ref):
        return f'<p:pic><p:img binaryItemIDRef="{ref}"/></p:pic>'

    def tbl(caption, cell):
        return f"<p:tbl><p:caption><p:subList>{p(f'<p:t>{caption}</p:t>')}</p:subList></p:caption><p:tr><p:tc><p:subList>{cell}</p:subList></p:tc></p:tr></p:tbl>"

    t = "<p:t>{}</p:t>".format
    section = "".join([
        p(t("{{intro}}"), "<p:secPr/>"), p(tbl("표 {{table_template}}", p(pic("i1")))), p(tbl("표", p(t("in {{figure}} cell") + pic("i2")))), p(t("text") + pic("i3")),
        p(t("{{figure_template:sample}}") + pic("i3") + pic("i4")), p(t("{{body}}")), p(tbl("{{table 1}}", p(t("{{intro}}")))), p(t("{{other}}")),
    ])
    n = packages.nodes(packages.contents(spark.createDataFrame([("d", package({"Contents/section0.xml": f'<s:sec xmlns:s="u" xmlns:p="v">{section}</s:sec>'}))], "doc_id string, content binary"))).cache()
    top = {r.node: i for i, r in enumerate(edits.tops(n).where("kind = 'paragraph' and node = top").orderBy("node").collect())}
    found = edits.residue(n)
    assert {(top[r.top], r.reason) for r in found.collect()} == {(0, "emptied"), (1, "table"), (2, "figure"), (4, "figure"), (5, "marker")}
    assert edits.residue_counts(found).collect() == [("d", 1, 2, 2)]
    left = edits.cleared(n, found).where("kind = 'paragraph'").orderBy("node").collect()
    assert [r.text for r in left] == ["", "text", "", "{{table 1}}", "{{intro}}", "{{other}}"]
    elsewhere = table(spark, "doc_id string, ref string", ("d", "i4"))
    assert edits.unused_binaries(n, found, elsewhere.limit(0)).orderBy("ref").collect() == [("d", "i2"), ("d", "i4")]
    assert edits.unused_binaries(n, found, elsewhere).collect() == [("d", "i2")]


def bands_by_loop(sigs):
    """The bands of one document, page by page."""
    n, i, runs = len(sigs), 0, []
    while i < n:
        j = i + 1
        while j < n and sigs[j] != sigs[j - 1] and (j < i + 2 or sigs[j] == sigs[j - 2]):
            j += 1
        if j - i >= 4:
            runs.append((i, j, ",".join(sorted({x for s in sigs[i:j] for x in s.split(",") if x}))))
            i = j
        else:
            if runs and runs[-1][1] == i and runs[-1][2] == sigs[i] and runs[-1][3:] == ("plain",):
                runs[-1] = (runs[-1][0], i + 1, sigs[i], "plain")
            else:
                runs.append((i, i + 1, sigs[i], "plain"))
            i += 1
    letters = {}
    for r in runs:
        if r[2]:
            letters.setdefault(r[2], chr(65 + len(letters)))
    return [(a + 1, z, letters.get(s, "—"), len(runs) > 1 and bool(letters)) for a, z, s, *_ in runs]


def test_bands_against_a_loop(spark):
    """Mirrored runs that overlap, follow each other or hold pages without a signature."""
    r = random.Random(4)
    docs = [[r.choice(["a", "b", "c", "", "a,b"][: r.choice([2, 3, 5])]) for _ in range(r.choice([1, 3, 4, 7, 30]))] for _ in range(150)]
    docs += [list("abab"), list("ababcbcb"), list("ababcbcbcdcd"), list("abacacadadad"), list("ababbabaab"), ["a", "", "a", "", "b"], list("abcbcdcdedef")]
    df = table(spark, "doc_id long, page long, signature string", *((d, i, s) for d, pages in enumerate(docs) for i, s in enumerate(pages, 1)))
    got = {}
    for row in media.bands(df).orderBy("doc_id", "first_page").collect():
        got.setdefault(row.doc_id, []).append(tuple(row)[1:])
    assert got == {d: bands_by_loop(pages) for d, pages in enumerate(docs)}


def test_templates_of_levels(spark):
    """A bullet's level counts from the anchor's on the ladder of indents; beyond the ladder it is clamped with the level that it got."""
    p = table(spark, "doc_id long, section_no long, para_idx long, indent long, text string", (1, 0, 0, 0, "a"), (1, 0, 1, 200, "b"), (1, 0, 2, 400, "c"), (1, 0, 3, 200, "d"), (1, 0, 4, 300, " "))
    anchors = table(spark, "doc_id long, section_no long, para_idx long, indent long, anchor_level long", (1, 0, 3, 200, 1), (1, 0, 1, 200, 2), (1, 0, 4, 300, 1))
    kinds = [("bullet", 1), ("bullet", 2), ("bullet", 3), ("paragraph", 0), ("ordered", 1)]
    blocks = table(spark, "doc_id long, section_no long, para_idx long, ord long, kind string, level long", *((1, 0, i, o, *k) for i in (1, 3, 4) for o, k in enumerate(kinds)))
    got = edits.pick_templates(edits.indent_templates(p, anchors.select("doc_id", "section_no", "para_idx")), anchors, blocks)
    by = {}
    for r in got.orderBy("para_idx", "ord").collect():
        by.setdefault(r.para_idx, []).append((r.template_idx, r.clamped_to))
    assert by == {3: [(3, None), (2, None), (2, 2), (3, None), (3, None)], 1: [(0, None), (1, None), (2, None), (1, None), (0, None)], 4: [(0, None), (3, None), (2, None), (3, None), (0, None)]}


def test_body_begins_with_its_first_heading(spark):
    c = table(spark, "doc_id long, section_no long, para_idx long, role_kind string, role_level long, text string", (1, 0, 0, "BODY", None, "front"), (1, 0, 1, "HEADING", 1, "holds a table"), (1, 0, 2, "HEADING", 1, ""), (1, 0, 3, "BODY", None, "text"), (2, 0, 0, "HEADING", 2, "no body"), (2, 0, 1, "BODY", None, "x"))
    t = table(spark, "doc_id long, section_no long, para_idx long, markdown string", (1, 0, 1, "| t |"))
    notes = table(spark, "doc_id long, section_no long, para_idx long, pos long, text string", (1, 0, 0, 0, "lost"), (1, 0, 3, 0, "kept"), (2, 0, 1, 0, "lost"))
    assert markdown.corpus_markdown(c, t, None, notes, body_from_h1=True).collect() == [(1, "text[^1]\n\n[^1]: kept")]
    assert dict(markdown.corpus_markdown(c, t, None, notes).collect())[1] == "front[^1]\n\n| t |\n\ntext[^2]\n\n[^1]: lost\n[^2]: kept"
    b = table(spark, "doc_id long, ord long, kind string, level long, text string", (1, 0, "paragraph", None, "a"), (1, 1, "heading", 1, "b"), (1, 2, "paragraph", None, "c"), (2, 0, "heading", 2, "d"))
    assert [r.text for r in markdown.body_only(b, "kind = 'heading' and level = 1", "ord").orderBy("ord").collect()] == ["b", "c"]


def test_first_box_of_a_label_and_given_markers(spark):
    p = table(spark, "doc_id long, section_no long, para_idx long, text string, has_table boolean", (1, 0, 0, "■ 동의함", False), (1, 0, 1, "□ 동의함", False), (1, 1, 0, "{{intro}} {{body}} {{end}}", False), (2, 0, 0, "x", False), (2, 1, 0, "y", False))
    cells = table(spark, "doc_id long, table_index long, row long, col long, row_span long, col_span long, text string", (9, 0, 0, 0, 1, 1, "x"))
    assert [(r.locator, r.current) for r in forms.all_slots(p, cells).where("kind = 'checkbox'").collect()] == [("checkbox:동의함", "on")]
    picked = {r.doc_id: (r.section_no, r.token, r.warned) for r in markdown.insertion_marker(p, ["intro", "body"]).collect()}
    assert picked == {1: (1, "body", False), 2: (1, None, True)}
    assert {r.doc_id: (r.section_no, r.token) for r in markdown.insertion_marker(p, ["intro", "body"], token="end").collect()} == {1: (1, "end"), 2: (1, None)}
    assert {r.doc_id: (r.section_no, r.token, r.warned) for r in markdown.insertion_marker(p, ["intro"], token="none").collect()}[1] == (1, None, True)


def test_normalized_meta(spark):
    m = table(spark, "doc_id long, key string, value string", (1, "제목", "First // Second"), (1, "부제", "more"), (1, "연구책임", "Hong  Institute"), (1, "공동책임", "Kim X"), (1, "발행일", "2026-08"), (1, "인쇄처", " "), (2, "author", "me"))
    got = {(r.doc_id, r.key): r.value for r in markdown.normalized_meta(m).collect()}
    assert got[1, "title"] == "First\nSecond" and got[1, "title_1"] == "First" and got[1, "title_2"] == "Second"
    assert got[1, "subtitle"] == ": more" and got[1, "authors"] == "Hong·Kim" and got[1, "pub_date"] == "2026년 8월"
    assert (1, "printer") not in got and got[2, "creator"] == "me" and got[1, "lead_researcher"] == "Hong  Institute"


def test_repairs(spark):
    pr = table(spark, "doc_id long, ls_type string, ls_percent long", (1, "PERCENT", 1600), (1, "PERCENT", 160), (1, "FIXED", 2000))
    tb = table(spark, "doc_id long, page_break string", (1, "TABLE"), (1, "CELL"), (2, "TABLE"), (2, "TABLE"))
    declared = table(spark, "doc_id long, part_name string", (1, "Preview/a.txt"), (2, "Preview/a.txt"), (2, "Contents/x"))
    parts = table(spark, "doc_id long, part_name string", (1, "Preview/a.txt"))
    assert {tuple(r) for r in edits.repairs(pr, tb, declared, parts).collect()} == {(1, "linespacing:1"), (1, "pagebreak:1"), (2, "pagebreak:2"), (2, "preview:Preview/a.txt")}
    assert sorted(r.ls_percent for r in edits.repaired_packages(pr).collect()) == [160, 160, 2000]


def heights_by_loop(cells):
    """cells: (row, col, span, height)."""
    n = max(r + s for r, _, s, _ in cells)
    known = {}
    for r, _, s, h in cells:
        if s == 1:
            known[r] = max(known.get(r, 0), h)
    merges = sorted((s, r, c, h) for r, c, s, h in cells if s > 1)
    while True:
        before = len(known)
        for s, r, _, h in merges:
            free = [i for i in range(r, r + s) if i not in known]
            if len(free) == 1:
                known[free[0]] = max(h - sum(known.get(i, 0) for i in range(r, r + s)), 0)
        if len(known) == before:
            break
    for s, r, _, h in merges:
        free = [i for i in range(r, r + s) if i not in known]
        left = max(h - sum(known.get(i, 0) for i in range(r, r + s)), 0)
        known |= {i: left // len(free) for i in free}
    return [known.get(i, 0) for i in range(n)]


def test_row_heights(spark):
    """Merges that fix one another's open rows, that conflict, and that share what is left."""
    r = random.Random(8)
    tables = [[(0, 0, 1, 10), (0, 1, 2, 25), (2, 0, 2, 40)], [(0, 0, 2, 30), (1, 1, 2, 50), (2, 2, 2, 70), (3, 3, 1, 8)], [(1, 0, 1, 5)], [(0, 0, 3, 100), (0, 1, 2, 30), (1, 2, 2, 10)]]
    tables += [[(i, c, r.choice([1, 2, 3, 4]), r.randint(0, 90)) for i in range(r.randint(1, 7)) for c in range(2) if r.random() < 0.6] or [(0, 0, 1, 1)] for _ in range(40)]
    c = table(spark, "doc_id long, table_index long, row long, col long, row_span long, height long", *((d, 0, *x) for d, cells in enumerate(tables) for x in cells))
    got = {}
    for row in forms.row_heights(c).orderBy("doc_id", "row").collect():
        got.setdefault(row.doc_id, []).append(row.height)
    assert got == {d: heights_by_loop(cells) for d, cells in enumerate(tables)}
    assert got[0] == [10, 15, 20, 20]


def test_checkboxes(spark):
    assert [[tuple(x) for x in r] for r in column(spark, ["□ 동의함", "동의합니다. ■", "□ 기간 : ", "x"], T.checkboxes)] == [[("동의함", "off")], [("동의합니다", "on")], [], []]
    assert column(spark, ["□ 동의함", "동의함. □", "■ 동의함"], lambda c: T.toggled(c, "동의함")) == ["■ 동의함", "동의함. ■", "■ 동의함"]


def test_hooks(spark, tmp_path):
    """A hook is set up once in each worker; a page for which it raises is a row with the error, and the others go on."""
    log = str(tmp_path / "setups")
    pages = table(spark, "doc_id long, page long, image binary", (1, 1, b"x"), (1, 2, b""), (2, 1, b"yy"), (2, 2, None))

    def setup():
        with open(log, "a") as f:
            f.write("x")

        def judge(image, page, pages):
            if not image:
                raise ValueError("blank")
            return len(image) == 1, [("empty_page", f"{page}/{pages}")] * (len(image) - 1), "seen"

        return judge

    got = {(r.doc_id, r.page): (r.ok, [tuple(i) for i in r.issues or []], r.note) for r in media.judge_pages(pages.coalesce(1), setup).collect()}
    assert got[1, 1] == (True, [], "seen") and got[2, 1] == (False, [("empty_page", "1/2")], "seen")
    assert got[1, 2] == (None, [], "ValueError: blank") and got[2, 2][0] is None and "blank" in got[2, 2][2]
    assert len(open(log).read()) <= 4  # at most once for each task
    docs = table(spark, "doc_id long, content binary", (1, b"a,b|a|c"), (2, b""), (3, b"!"))

    def hashes():
        def of(content):
            if content == b"!":
                raise RuntimeError("damaged")
            return [set(p.split(",")) for p in content.decode().split("|") if p]

        return of

    got = media.hash_pages(docs, hashes)
    assert {(r.doc_id, r.page, tuple(r.hashes or []), r.error) for r in got.collect()} == {(1, 1, ("a", "b"), None), (1, 2, ("a",), None), (1, 3, ("c",), None), (3, None, (), "RuntimeError: damaged")}
    assert {(r.page, r.signature) for r in media.recurring_hashes(got.where("error is null")).collect()} == {(1, "a"), (2, "a"), (3, "")}


def test_reports_are_written_once(spark, tmp_path):
    found = table(spark, "doc_id long, kind string, where string", (1, "b", "2"), (1, "b", "1"), (1, "a", "x"), (2, "c", "not asked for"))
    made = packages.reports(found, ["a", "b"], pages=table(spark, "doc_id long, value long", (1, 5), (3, 7)))
    want = {1: {"doc_id": 1, "pages": 5, "a": ["x"], "b": ["1", "2"]}, 2: {"doc_id": 2, "pages": None, "a": [], "b": []}, 3: {"doc_id": 3, "pages": 7, "a": [], "b": []}}
    assert {r.doc_id: json.loads(r.report) for r in made.collect()} == want
    for _ in range(2):
        packages.write_reports(made, str(tmp_path / "out"), 2)
    back = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).select("value").collect()]
    assert sorted(r["doc_id"] for r in back) == [1, 2, 3] and {r["doc_id"]: r for r in back} == want


def test_figures_images_and_instructions(spark):
    f = table(spark, "t string, p array<string>, l string, n array<string>", ("제목", ["a.png", "b c.png"], "f", ["자료: x", " "]), (None, ["a.png"], None, None))
    assert [r[0] for r in f.select(T.figure_line(F.col("t"), F.col("p"), F.col("l"), F.col("n"))).collect()] == ["![제목](a.png) ![](<b c.png>){#f}\n자료: x", "![](a.png)"]
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (300).to_bytes(4, "big") + (200).to_bytes(4, "big")
    jpg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + (20).to_bytes(2, "big") + (30).to_bytes(2, "big") + b"\0"
    bmp = b"BM" + b"\0" * 16 + (7).to_bytes(4, "little") + (-9).to_bytes(4, "little", signed=True)
    got = spark.createDataFrame([(i, c) for i, c in enumerate([png, jpg, bmp, b"GIF89a\x05\0\x06\0", b"\xff\xd8\xff", b"", None])], "i int, c binary").select("i", T.image_size(F.col("c")).alias("s")).orderBy("i").collect()
    assert [tuple(r.s) for r in got] == [(300, 200), (30, 20), (7, 9), (5, 6), (None, None), (None, None), (None, None)]
    e = table(spark, "w long, x long, y long, cap long", (1000, 200, 100, 600), (1000, 100, 200, 600)).select(T.fitted(F.col("w"), F.col("x"), F.col("y"), F.col("cap")).alias("e"))
    assert [tuple(r.e) for r in e.collect()] == [(1000, 500, 2.0), (300, 600, 0.5)]
    p = table(spark, "doc_id long, section_no long, para_idx long, style_id string, text string", (1, 0, 0, "9", "쓰기 {{a}}"), (1, 0, 1, "9", " "), (1, 0, 2, "0", "b"))
    assert [tuple(r) for r in markdown.instructions(p, table(spark, "doc_id long, role string, style_id string", (1, "INSTRUCTION", "9"), (1, "BODY", "0"))).collect()] == [(1, 0, 0, "쓰기 {{a}}", ["a"])]


def test_bands_beyond_the_alphabet(spark):
    pages = table(spark, "doc_id long, page long, signature string", *[(1, i, f"s{i:02d}") for i in range(28)], *[(2, i, "ab"[i % 2]) for i in range(5)], (3, 0, ""))
    got = {(r.doc_id, r.first_page, r.last_page): r.letter for r in media.bands(pages).collect()}
    assert (got[1, 25, 25], got[1, 26, 26], got[1, 27, 27]) == ("Z", "AA", "AB")
    assert got[2, 0, 4] == "A" and got[3, 0, 0] == "—"


def test_lines_fields_and_pictures_of_packages(spark):
    pic = '<p:pic><p:curSz width="70" height="30"/><p:img binaryItemIDRef="image3"/><p:shapeComment>그림입니다. 원본 그림의 이름: a.png\n원본 그림의 크기: 가로 7pixel, 세로 3pixel</p:shapeComment></p:pic>'
    field = '<p:ctrl><p:fieldBegin id="5" type="HYPERLINK"><p:parameters><p:stringParam name="Command">http\\://a.kr;1;0;2;</p:stringParam></p:parameters></p:fieldBegin></p:ctrl><p:t>x</p:t><p:ctrl><p:fieldEnd beginIDRef="5"/></p:ctrl>'
    lines = '<p:linesegarray><p:lineseg textpos="0" vertpos="10" vertsize="5" spacing="2"/><p:lineseg textpos="4" vertpos="20" vertsize="5" spacing="2"/></p:linesegarray>'
    section = f'<s:sec xmlns:s="u" xmlns:p="v"><p:p><p:run>{field}</p:run>{lines}</p:p><p:p><p:run>{pic}<p:t>cap</p:t></p:run></p:p></s:sec>'
    found = packages.contents(spark.createDataFrame([("a", package({"Contents/section2.xml": section}))], "doc_id string, content binary"))
    assert [tuple(r) for r in packages.lines(found).collect()] == [("a", 2, 0, 0, 0, 10, 5, 2), ("a", 2, 0, 1, 4, 20, 5, 2)]
    fields = packages.fields(found)
    assert [tuple(r) for r in fields.collect()] == [("a", 2, 0, "begin", "5", "HYPERLINK", "http://a.kr"), ("a", 2, 1, "end", "5", None, None)]
    assert checks.unpaired_fields(fields).count() == 0
    assert [tuple(r) for r in packages.pictures(found).collect()] == [("a", 2, 1, "image3", 70, 30, "cap", "a.png", 7, 3)]
    p = packages.paragraphs(found).withColumn("equations", F.lit(1))
    assert media.link_census(fields, p).collect() == [("a", 1, 0, 2, [])]
