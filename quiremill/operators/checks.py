"""Package checks: id lists, references, fields, markers, line caches and guards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T_

from quiremill.functions import text as T
from quiremill.sources.shared import dealt, joined

#: A reference to nothing.
NO_REF = 4294967295


def duplicate_ids(items: DataFrame) -> DataFrame:
    """AG3: ids that a list has more than once."""
    return items.groupBy("doc_id", "item", "id").agg(F.count("*").alias("n")).where("n > 1")


def wrong_counts(items: DataFrame) -> DataFrame:
    """AG4: lists whose itemCnt isn't their length."""
    return items.groupBy("doc_id", "item").agg(F.max("item_cnt").alias("item_cnt"), F.count("*").alias("n")).where("item_cnt <> n")


def sections_without_page(paragraphs: DataFrame, has_secpr: str = "has_secpr") -> DataFrame:
    """AG5: sections of which no paragraph defines the page."""
    return paragraphs.groupBy("doc_id", "section_no").agg(F.bool_or(has_secpr).alias("has")).where("not has").drop("has")


def id_order(items: DataFrame) -> DataFrame:
    """WN6: the first place of each list where the id isn't the one before plus 1."""
    o = W.partitionBy("doc_id", "item").orderBy("pos")
    bad = items.withColumn("before", F.lag("id").over(o)).where("id <> coalesce(before, -1) + 1")
    return bad.groupBy("doc_id", "item").agg(F.min_by(F.struct("pos", "id"), "pos").alias("f")).select("doc_id", "item", "f.pos", "f.id")


def dangling_refs(refs: DataFrame, items: DataFrame) -> DataFrame:
    """JN8: ids that are used but not in the list, for lists that exist; pre-aggregated to distinct ids."""
    used = refs.where(F.col("ref_id") != NO_REF).groupBy("doc_id", "item", "ref_id").agg(F.count("*").alias("n"))
    lists = items.select("doc_id", "item").distinct()
    known = items.select("doc_id", "item", F.col("id").alias("ref_id")).distinct()
    return used.join(lists, ["doc_id", "item"], "left_semi").join(known, ["doc_id", "item", "ref_id"], "left_anti")


def unpaired_fields(fields: DataFrame) -> DataFrame:
    """JN9: begins without an end and ends without a begin, by section."""
    key = ["doc_id", "section_no", "field_id"]
    n = dealt(fields, *key).groupBy(*key).agg(F.count_if(F.col("side") == "begin").cast("int").alias("begins"), F.count_if(F.col("side") == "end").cast("int").alias("ends"))
    # An id that is null pairs with none.
    alone = n.where("begins = 0 or ends = 0 or doc_id is null or section_no is null or field_id is null")
    return alone.select(*key, F.explode(F.concat(F.array_repeat(F.lit("begin alone"), F.col("begins")), F.array_repeat(F.lit("end alone"), F.col("ends")))).alias("finding"))


def stale_lines(paragraphs: DataFrame) -> DataFrame:
    """PF2: paragraphs whose line cache holds fewer lines than their breaks need."""
    return paragraphs.where("line_segs >= 1 and line_breaks + 1 > line_segs").select("doc_id", "section_no", "para_idx", F.substring("text", 1, 40).alias("preview"))


def without_stale_lines(linesegs: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """PF3: line rows of the other paragraphs."""
    return linesegs.join(stale_lines(paragraphs), ["doc_id", "section_no", "para_idx"], "left_anti")


def neutral_numbering(objects: DataFrame) -> DataFrame:
    """PF4: numbered objects without caption lose their numbering, outside headers."""
    hit = F.col("numbering_type").isin("PICTURE", "TABLE", "EQUATION") & ~F.col("has_caption") & F.col("part_name").rlike("(section|masterpage)[0-9]+")
    return objects.withColumn("changed", F.coalesce(hit, F.lit(False))).withColumn("numbering_type", F.when(hit, "NONE").otherwise(F.col("numbering_type")))


def marker_census(paragraphs: DataFrame, instructions: DataFrame | None = None) -> DataFrame:
    """AG6: how often each marker stands in each section; paragraphs of instructions (PF6) aren't counted."""
    if instructions is not None:
        paragraphs = paragraphs.join(instructions, ["doc_id", "section_no", "para_idx"], "left_anti")
    return paragraphs.select("doc_id", "section_no", F.explode(F.transform(F.regexp_extract_all("text", F.lit(T.PLACEHOLDER), F.lit(1)), lambda x: F.trim(x))).alias("token")).groupBy("doc_id", "section_no", "token").agg(F.count("*").alias("n"))


def marker_warnings(census: DataFrame, known: list[str], exempt: list[str]) -> DataFrame:
    """AG7: markers that are there twice or unknown."""
    total = census.groupBy("doc_id", "token").agg(F.sum("n").alias("n"))
    return total.select("doc_id", "token", "n", F.when(~F.col("token").isin(*known, *exempt), "unrecognized").when((F.col("n") > 1) & ~F.col("token").isin(*exempt), "ambiguous").alias("finding")).where("finding is not null")


def residual_tokens(paragraphs: DataFrame) -> DataFrame:
    """AG8: distinct leftovers of each document."""
    return paragraphs.select("doc_id", F.explode(T.placeholders(F.col("text"))).alias("token")).distinct()


def findings(*parts: tuple[str, DataFrame, str]) -> DataFrame:
    """ST2: one long table (doc_id, kind, where) of all findings; kind and where are expressions over each part's columns."""
    return reduce(DataFrame.unionByName, (df.select("doc_id", F.expr(kind).alias("kind"), F.expr(where).cast("string").alias("where")) for kind, df, where in parts))


def _found(kind: Column | str, where: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), where.cast("string").alias("where"))


def list_findings(items: DataFrame, refs: DataFrame) -> DataFrame:
    """ST2: AG3, AG4, WN6 and JN8 of each list of a header from one aggregation of its ids and one of what refers to it: (doc_id, kind, where)."""
    lists = items.groupBy("doc_id", "item").agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("entries"), F.max("item_cnt").alias("cnt"))
    used = refs.where(F.col("ref_id") != NO_REF).groupBy("doc_id", "item").agg(F.collect_set(F.col("ref_id").cast("long")).alias("used"))
    a = joined(lists, used, ["doc_id", "item"], "left").withColumn("used", F.coalesce("used", F.array().cast("array<long>")))
    a = a.withColumn("ids", F.array_sort(F.transform("entries", lambda e: e["id"].cast("long"))))
    first = lambda i: (i == 0) | (F.get("ids", i - 1) != F.get("ids", i))
    twice = F.filter("ids", lambda x, i: first(i) & (F.get("ids", i + 1) == x))
    bad = F.filter("entries", lambda e, i: e["id"] != F.when(i == 0, -1).otherwise(F.get("entries", i - 1)["id"]) + 1)
    found = F.concat(
        F.transform(twice, lambda x: _found("duplicate id", x)),
        F.when(F.col("cnt") != F.size("entries"), F.array(_found("wrong count", F.col("item")))).otherwise(F.array().cast("array<struct<kind:string,where:string>>")),
        F.transform(F.slice(bad, 1, 1), lambda e: _found("id order", F.concat_ws(":", "item", e["pos"].cast("string")))),
        F.transform(F.array_except("used", "ids"), lambda x: _found("dangling reference", F.concat_ws(":", "item", x.cast("string")))),
    )
    return a.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.*")


def field_findings(fields: DataFrame) -> DataFrame:
    """ST2: JN9 from one aggregation by field: a row for every begin without an end, or end without a begin."""
    n = fields.groupBy("doc_id", "section_no", "field_id").agg(F.count_if(F.col("side") == "begin").alias("begins"), F.count_if(F.col("side") == "end").alias("ends"))
    alone = n.where("begins = 0 or ends = 0").withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("begins") + F.col("ends"))))
    return alone.select("doc_id", F.when(F.col("begins") > 0, "begin alone").otherwise("end alone").alias("kind"), F.col("field_id").cast("string").alias("where"))


def paragraph_findings(paragraphs: DataFrame, has_secpr: str = "has_secpr") -> DataFrame:
    """ST2: AG5 and PF2 from one aggregation by section."""
    stale = (F.col("line_segs") >= 1) & (F.col("line_breaks") + 1 > F.col("line_segs"))
    a = paragraphs.groupBy("doc_id", "section_no").agg(F.bool_or(has_secpr).alias("has"), F.collect_list(F.when(stale, F.col("para_idx"))).alias("stale"))
    none = F.array().cast("array<struct<kind:string,where:string>>")
    found = F.concat(F.when(~F.col("has"), F.array(_found("no page", F.col("section_no")))).otherwise(none), F.transform("stale", lambda i: _found("stale lines", i)))
    return a.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.*")


def fingerprints(parts: DataFrame, skip: str) -> DataFrame:
    """AG14: digest of a package's parts but the fingerprint's own: sha256 over name, NUL and bytes in name order.

    Parts are sorted by package and name in each partition and hashed as they stream by, so that only one batch is held
    at a time, whatever a package's size.
    """
    schema = T_.StructType([parts.schema["doc_id"], T_.StructField("fingerprint", T_.StringType())])
    rows = parts.where(F.col("part_name") != skip).select("doc_id", F.encode("part_name", "UTF-8").alias("name"), F.coalesce("content", F.lit(b"")).alias("content"))
    ordered = rows.repartition("doc_id").sortWithinPartitions("doc_id", "name", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, digest = None, None
        for b in batches:
            ids, done = b["doc_id"].to_pylist(), []
            for i, name, content in zip(ids, b["name"], b["content"], strict=True):
                if digest is None or i != doc:
                    if digest is not None:
                        done.append((doc, digest.hexdigest()))
                    doc, digest = i, hashlib.sha256()
                digest.update(name.as_py() + b"\0")
                digest.update(content.as_buffer())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in done], b.schema.field("doc_id").type), pa.array([x for _, x in done])], names=schema.names)
            kind = b.schema.field("doc_id").type
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([doc], kind), pa.array([digest.hexdigest()])], names=schema.names)

    return ordered.mapInArrow(run, schema)


def output_guard(targets: DataFrame, stored: DataFrame, current: DataFrame) -> DataFrame:
    """SM3: what may be done with a target (path, force): new, overwrite-own (it is as we wrote it, or forced), or a version beside it."""
    j = targets.join(stored.withColumnRenamed("fingerprint", "stored"), "path", "left").join(current.withColumnRenamed("fingerprint", "current"), "path", "left")
    status = F.when(F.col("current").isNull(), "new").when(F.col("force"), "overwrite-own").when(F.col("stored").isNull(), "versioned-foreign").when(F.col("stored") == F.col("current"), "overwrite-own").otherwise("versioned-drift")
    return j.select("path", status.alias("status"))


def next_version(taken: DataFrame) -> DataFrame:
    """TK4: the first free version number from 2 for each name; taken: (name, version)."""
    used = taken.where("version >= 2").select("name", "version").distinct()
    o = W.partitionBy("name").orderBy("version")
    run = used.withColumn("i", F.row_number().over(o) + 1).where("version = i").groupBy("name").agg(F.max("version").alias("last"))
    return taken.select("name").distinct().join(run, "name", "left").select("name", (F.coalesce("last", F.lit(1)) + 1).cast("long").alias("next_version"))


#: What can be wrong with a page.
ISSUES = ("missing_image", "layout_broken", "text_truncated", "object_overlap", "empty_page", "render_failure")


def page_verdicts(verdicts: DataFrame, documents: DataFrame) -> DataFrame:
    """AG13: one row for each document of documents (doc_id, page_count, error): how many pages were judged, whether it passed, its problem pages, and its issues by type.

    verdicts: (doc_id, page, ok or null if not judged, issues array<struct<type, detail>>). Passed: no error, at least one page, at least one judged, all judged ones good.
    """
    v = verdicts.where("ok is not null")
    found = F.flatten(F.collect_list(F.transform(F.coalesce("issues", F.array().cast("array<struct<type:string,detail:string>>")), lambda i: i["type"])))
    a = v.groupBy("doc_id").agg(F.count("*").alias("checked"), F.bool_and("ok").alias("good"), F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("page")))).alias("bad"), found.alias("found"))
    d = documents.select("doc_id", F.coalesce("page_count", F.lit(0)).cast("long").alias("page_count"), F.coalesce("error", F.lit("")).alias("error")).join(a, "doc_id", "left")
    passed = (F.col("error") == "") & (F.col("page_count") > 0) & F.coalesce("good", F.lit(False))

    def times(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("found", lambda x: x == kind)), F.lit(0)).cast("long").alias(f"n_{kind}")

    return d.select("doc_id", "page_count", F.coalesce("checked", F.lit(0)).cast("long").alias("checked"), passed.alias("passed"), F.coalesce(F.array_join("bad", ","), F.lit("")).alias("problem_pages"), "error", *map(times, ISSUES))
