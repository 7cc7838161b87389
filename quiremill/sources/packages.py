"""Landing packages (ZIP files of XML parts) as tables.

One pass reads a package: its members are inflated and parsed piece by piece, and everything that is found becomes rows of
one table (``contents``) with a column ``kind``; the other functions take their kind of rows from it. What can't be read
- no ZIP file, a damaged, encrypted or oversized member, XML that ends early - is a part row with an error, and that
part gives no other rows.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections import Counter
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quiremill.functions import text as T
from quiremill.sources.sections import Section

#: Rows of all kinds. ``node`` and ``stop`` number the XML elements of a part in the order of their begins: an element holds another if node < other's node <= stop.
CONTENTS = (
    "kind string, doc_id string, part_name string, part_order int, content binary, error string, section_no int, node int, stop int, para_idx int, in_cell boolean, style_id string, "
    "para_pr_id string, text string, line_breaks int, line_segs int, has_table boolean, line_no int, textpos int, vertpos int, vertsize int, spacing int, ord int, side string, "
    "field_id string, field_type string, url string, ref string, width int, height int, comment string, caption string, table_index int, row int, col int, row_span int, col_span int, "
    "row_cnt int, col_cnt int, page_break string, treat_as_char int, has_secpr boolean, item string, ref_id long, n long"
)
PARTS = ["doc_id", "part_name", "part_order", "content", "error"]
PARAGRAPHS = ["doc_id", "section_no", "para_idx", "in_cell", "style_id", "para_pr_id", "text", "line_breaks", "line_segs", "has_table", "has_secpr"]
LINES = ["doc_id", "section_no", "para_idx", "line_no", "textpos", "vertpos", "vertsize", "spacing"]
FIELDS = ["doc_id", "section_no", "ord", "side", "field_id", "field_type"]
CELLS = ["doc_id", "section_no", "table_index", "row", "col", "row_span", "col_span", "width", "height", "text"]
TABLES = ["doc_id", "section_no", "table_index", "para_idx", "row_cnt", "col_cnt", "page_break", "treat_as_char", "caption"]
#: Bytes of a member that are inflated, and bytes that are parsed at a time.
LARGEST, PIECE = 1 << 28, 1 << 16
_ROWS, _BYTES = 1024, 1 << 21


_FILES = "binaryFile"


def scan(spark: SparkSession, folder: str, pattern: str = "*.hwpx") -> DataFrame:
    """SRC1: (doc_id, path, modified, length, content) of every package below a folder."""
    return named(spark.read.format(_FILES).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder))


def opened(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The same of the packages with these paths."""
    return named(spark.read.format(_FILES).load(paths))


def named(files: DataFrame) -> DataFrame:
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("doc_id"), "path", F.col("modificationTime").alias("modified"), "length", "content")


def is_scan(found: DataFrame) -> bool:
    """Whether a table of packages is read from files, so that single packages can be opened by path."""
    return bool(found.inputFiles()) and {"path", "modified", "length", "content"} <= set(found.columns) and _FILES in found._jdf.queryExecution().optimizedPlan().toString()


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (c.strip().split(" ") for c in CONTENTS.split(","))])


def contents(packages: DataFrame, binaries: bool = False, bodies: bool = False, walk: bool = True, largest: int = LARGEST) -> DataFrame:
    """SRC2-SRC4, SRC6, SRC8: the rows of every package (doc_id, content) in one pass.

    Part rows hold the bytes of the members that aren't sections, with ``bodies`` of sections too, with ``binaries`` of pictures
    too. A part's rows are held until its end, so that a damaged part leaves none behind; members over ``largest`` bytes aren't inflated.
    """
    schema = _schema()

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for doc, content in zip(b["doc_id"], b["content"], strict=True):
                for rows in _package_rows(doc.as_py(), content, binaries, bodies, walk, largest):
                    held += rows
                    size += sum(len(r.get("content") or b"") + len(r.get("text") or "") + len(r.get("caption") or "") + len(r.get("comment") or "") for r in rows)
                    if len(held) >= _ROWS or size >= _BYTES:
                        yield from (batch(held[i : i + _ROWS]) for i in range(0, len(held), _ROWS))
                        held, size = [], 0
        yield batch(held)

    return packages.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(run, CONTENTS)


def _package_rows(doc: str, content: pa.BinaryScalar, binaries: bool, bodies: bool, walk: bool, largest: int) -> Iterator[list[dict]]:
    """The rows of one member after the other."""
    try:
        package = zipfile.ZipFile(io.BytesIO(content.as_buffer() if content.is_valid else b""))
    except (zipfile.BadZipFile, ValueError, OSError) as e:
        yield [{"kind": "part", "doc_id": doc, "error": str(e) or "not a package"}]
        return
    with package as z:
        for order, member in enumerate(z.infolist()):
            name = member.filename
            if not binaries and name.startswith("BinData/"):
                continue
            own = {"kind": "part", "doc_id": doc, "part_name": name, "part_order": order}
            section = name.startswith("Contents/section") and name[16:-4].isdigit() and name.endswith(".xml")
            try:
                if member.file_size > largest:
                    raise ValueError(f"{member.file_size} bytes, at most {largest} are read")
                walker = Section(int(name[16:-4])) if section and walk else None
                refs: Counter = Counter()
                data = _read(z, member, name, walker, refs, keep=bodies or not section)
            except (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError, ValueError, expat.ExpatError) as e:
                yield [own | {"error": f"{type(e).__name__}: {e}"}]
                continue
            rows = [own | {"content": data}]
            rows += [{"kind": "ref", "doc_id": doc, "part_name": name, "item": i, "ref_id": r, "n": n} for (i, r), n in refs.items()]
            rows += [{"doc_id": doc, "part_name": name} | r for r in walker.rows] if walker else []
            yield rows


def _read(z: zipfile.ZipFile, member: zipfile.ZipInfo, name: str, walker: Section | None, refs: Counter, keep: bool) -> bytes | None:
    """Inflate a member piece by piece; XML goes through the parser, which counts references and feeds the walker."""
    parser = expat.ParserCreate() if name.endswith((".xml", ".hpf")) else None
    if parser:
        counts = name.endswith(".xml")

        def start(tag: str, attributes: dict[str, str]) -> None:
            if counts:
                for key, value in attributes.items():
                    if key.endswith("IDRef") and value.isdigit():
                        refs[key[:-5], int(value)] += 1
            if walker:
                walker.start(tag.rpartition(":")[2], attributes)

        parser.StartElementHandler = start
        parser.buffer_text = True
        if walker:
            parser.EndElementHandler = lambda tag: walker.end(tag.rpartition(":")[2])
            parser.CharacterDataHandler = walker.characters
    out = []
    with z.open(member) as f:
        while piece := f.read(PIECE):
            if parser:
                parser.Parse(piece)
            if keep:
                out.append(piece)
    if parser:
        parser.Parse(b"", True)
    return b"".join(out) if keep else None


def _of(found: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    return found.where(F.col("kind") == kind).select(*columns)


def parts(packages: DataFrame, binaries: bool = False) -> DataFrame:
    """SRC2: the parts of each package with their bytes; what can't be read is a row with an error."""
    return _of(contents(packages, binaries, bodies=True, walk=False), "part", PARTS)


def errors(found: DataFrame) -> DataFrame:
    """SRC2: what couldn't be read of ``contents``: (doc_id, part_name or null for a whole package, error)."""
    return _of(found, "part", ["doc_id", "part_name", "error"]).where("error is not null")


def paragraphs(found: DataFrame) -> DataFrame:
    """SRC3: the paragraphs of all sections in document order."""
    return _of(found, "paragraph", PARAGRAPHS)


def lines(found: DataFrame) -> DataFrame:
    """SRC3: the saved line layout, for WN12 and SC29."""
    return _of(found, "line", LINES)


def fields(found: DataFrame) -> DataFrame:
    """SRC3: begins and ends of fields in order, for JN9 and AG15; the URL is the field's command, decoded."""
    return _of(found, "field", [*FIELDS, "url"]).withColumn("url", T.command_to_url(F.col("url")))


def pictures(found: DataFrame) -> DataFrame:
    """SRC8: the pictures of all sections: reference, extent, description with original name and pixels, and the text of the paragraph around them as caption."""
    pics = found.where("kind = 'picture'").withColumn("alt", T.alt_text(F.col("comment")))
    return pics.select("doc_id", "section_no", "para_idx", "ref", "width", "height", "caption", "alt.origname", "alt.px_w", "alt.px_h")


def cells(found: DataFrame) -> DataFrame:
    """SRC4: the cells of all tables; covered positions follow from the spans."""
    return _of(found, "cell", CELLS)


def tables(found: DataFrame) -> DataFrame:
    """SRC4: the tables themselves: size, page break, whether they are laid out as characters, caption, and the paragraph around them."""
    return _of(found, "table", TABLES)


def nodes(found: DataFrame) -> DataFrame:
    """Begin and end numbers of paragraphs, tables and pictures: (doc_id, section_no, kind, node, stop, para_idx, table_index, in_cell, text, caption, ref, has_secpr)."""
    return found.where("kind in ('paragraph', 'table', 'picture')").select("doc_id", "section_no", "kind", "node", "stop", "para_idx", "table_index", "in_cell", "text", "caption", "ref", "has_secpr")


def header_items(found: DataFrame) -> DataFrame:
    """SRC6: the ids of each list of the header in order, with the count that the list claims."""
    head = found.where(F.col("part_name").endswith("header.xml")).select("doc_id", F.decode("content", "UTF-8").alias("x"))
    lists = F.regexp_extract_all("x", F.lit(r"(?s)<hh:(\w+)\b[^>]*\bitemCnt=\"[0-9]+\"[^>]*>.*?</hh:\1>"), F.lit(0))
    each = head.select("doc_id", F.explode(lists).alias("l")).select("doc_id", F.regexp_extract("l", r"^<hh:(\w+)", 1).alias("item"), F.regexp_extract("l", r'itemCnt="([0-9]+)"', 1).cast("long").alias("item_cnt"), "l")
    return each.select("doc_id", "item", "item_cnt", F.posexplode(F.regexp_extract_all("l", F.lit(r'<hh:(?!fontface)\w+ [^>]*?\bid="([0-9]+)"'), F.lit(1))).alias("pos", "id")).select("doc_id", "item", (F.col("pos") + 1).cast("long").alias("pos"), F.col("id").cast("long").alias("id"), "item_cnt")


def refs(found: DataFrame) -> DataFrame:
    """SRC6: every *IDRef of every part, counted while it was parsed."""
    return _of(found, "ref", ["doc_id", "part_name", "item", "ref_id", "n"])


def metadata(found: DataFrame) -> DataFrame:
    """SRC7: title, language and named meta elements; blank is null."""
    x = found.where(F.col("part_name").endswith("content.hpf")).select("doc_id", F.decode("content", "UTF-8").alias("x"))

    def at(path: str):  # noqa: ANN202
        return F.nullif(F.trim(F.expr(f"xpath_string(x, '{path}')")), F.lit(""))

    named = {"creator": "creator", "subject": "subject", "description": "description", "keyword": "keyword", "date": "date", "created": "CreatedDate", "modified": "ModifiedDate", "lastsaveby": "lastsaveby"}
    columns = [at('//*[local-name()="title"]').alias("title"), at('//*[local-name()="language"]').alias("language")]
    return x.select("doc_id", *columns, *(at(f'//*[local-name()="meta"][@name="{n}"]').alias(c) for c, n in named.items()))


def profiles(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """SRC9: saved profiles, one JSON object a file."""
    return spark.read.schema(schema).option("multiLine", "true").json(folder)


def manifests(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """SRC10: (doc_id, parts array<string>) with (path, text): one Markdown text for each document, parts in order, joined by a blank line."""
    p = manifest.select("doc_id", F.posexplode("parts").alias("i", "path")).join(files, "path")
    return p.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "\n\n").alias("markdown"))


def listing(files: DataFrame) -> DataFrame:
    """SRC11: names, ids and times of a source folder, folders left out."""
    return files.where("file_type <> 'folder'").select("name", "file_id", "modified_time")


def write_texts(texts: DataFrame, path: str, by: str | None = None) -> None:
    """SNK1: extracted texts as Parquet, partitioned if asked."""
    w = texts.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def reports(findings: DataFrame, kinds: list[str], **scalars: DataFrame) -> DataFrame:
    """SNK2: (doc_id, report): one JSON object for each document, with an array of what was found of each kind, empty ones too.

    findings: (doc_id, kind, where); scalars: tables (doc_id, value) that become plain members, null where a document has none.
    """
    by_kind = [F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("where")))).alias(k) for k in kinds]
    r = findings.groupBy("doc_id").agg(*by_kind)
    for name, df in scalars.items():
        r = r.join(df.select("doc_id", F.col("value").alias(name)), "doc_id", "full")
    members = [F.col(f"`{n}`") for n in scalars] + [F.coalesce(F.col(f"`{k}`"), F.array().cast("array<string>")).alias(k) for k in kinds]
    return r.select("doc_id", F.to_json(F.struct(F.col("doc_id"), *members), {"ignoreNullFields": "false"}).alias("report"))


def write_reports(report: DataFrame, path: str, parts: int = 64) -> None:
    """SNK2: reports (doc_id, report) as JSON lines in ``parts`` folders by document; each folder that a run writes to replaces the one before, so a repeated run leaves the same files.

    A run over some documents must hold all of their folders (``part``), or replaces the rest of them.
    """
    keyed = report.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    keyed.select(F.col("report").alias("value"), "part").repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").text(path)
