"""Pictures, links and page bands."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window as W, functions as F, types as T_

from quiremill.functions import text as T
from quiremill.sources.shared import joined


def recurring_hashes(page_images: DataFrame) -> DataFrame:
    """WN10: each page's signature: its hashes that are on two pages or more of the document, sorted."""
    e = page_images.select("doc_id", "page", F.explode_outer("hashes").alias("h"))
    n = e.where("h is not null").groupBy("doc_id", "h").agg(F.count_distinct("page").alias("n")).where("n >= 2").select("doc_id", "h", F.lit(1).alias("again"))
    s = e.join(n, ["doc_id", "h"], "left").groupBy("doc_id", "page").agg(F.array_join(F.sort_array(F.collect_set(F.when(F.col("again") == 1, F.col("h")))), ",").alias("signature"))
    return s


def _mirrored(signatures: DataFrame) -> DataFrame:
    """Pages with ``first`` and ``last`` of the mirrored run that each is in: four pages or more that alternate between two signatures.

    A page goes on alternating if it repeats the page before the last but not the last. Unbroken such pages, with the two
    before them, are the longest runs; two of them share one page at most. From the front, a run takes its shared page
    unless the run before it took it: one of five pages or more can spare it, of four-page runs in a row every second one gives way.
    """
    d = W.partitionBy("doc_id")
    o = d.orderBy("page")
    s = signatures.withColumn("i", F.row_number().over(o))
    on = F.coalesce((F.col("signature") == F.lag("signature", 2).over(o)) & (F.col("signature") != F.lag("signature").over(o)), F.lit(False))
    s = s.withColumn("on", on).withColumn("island", F.col("i") - F.sum(F.col("on").cast("int")).over(o))
    runs = s.where("on").groupBy("doc_id", "island").agg((F.min("i") - 2).alias("first"), F.max("i").alias("last")).withColumn("n", F.col("last") - F.col("first") + 1)
    r = d.orderBy("first")
    shares = F.coalesce(F.lag("last").over(r) == F.col("first"), F.lit(False))
    runs = runs.withColumn("shares", shares).withColumn("chained", shares & (F.col("n") == 4) & F.coalesce(F.lag("n").over(r) == 4, F.lit(False)))
    # Within a chain of four-page runs the first is taken unless it shares a page with a longer run that is; then every second one.
    runs = runs.withColumn("chain", F.sum((~F.col("chained")).cast("int")).over(r))
    runs = runs.withColumn("step", F.row_number().over(W.partitionBy("doc_id", "chain").orderBy("first")) - 1)
    loses = F.col("shares") & F.coalesce(F.lag("n").over(r) >= 5, F.lit(False))
    runs = runs.withColumn("loses", loses)
    runs = runs.withColumn("behind", F.max(F.when(F.col("step") == 0, F.col("loses").cast("int"))).over(W.partitionBy("doc_id", "chain")))
    taken = (F.col("n") >= 5) | ((F.col("n") == 4) & ((F.col("step") + F.col("behind")) % 2 == 0))
    runs = runs.withColumn("taken", taken)
    cut = F.col("shares") & F.coalesce(F.lag("taken").over(r), F.lit(False))
    runs = runs.withColumn("first", F.when(cut, F.col("first") + 1).otherwise(F.col("first"))).where("taken")
    ends = runs.select("doc_id", F.col("first").alias("i"), "first", "last")
    s = s.join(ends, ["doc_id", "i"], "left").withColumns({"first": F.last("first", ignorenulls=True).over(o), "last": F.last("last", ignorenulls=True).over(o)})
    inside = F.col("i") <= F.col("last")
    return s.select("doc_id", "page", "signature", F.when(inside, F.col("first")).alias("first"), F.when(inside, F.col("last")).alias("last"))


def bands(signatures: DataFrame) -> DataFrame:
    """WN11: runs of pages with one signature, mirrored runs as one with both, lettered by first appearance; a dash for pages without any.

    ``decidable``: the document has more than one band and at least one with a letter.
    """
    d = W.partitionBy("doc_id")
    o = d.orderBy("page")
    m = _mirrored(signatures)
    both = F.array_join(F.array_sort(F.array_distinct(F.split(F.concat_ws(",", F.collect_set(F.nullif("signature", F.lit(""))).over(W.partitionBy("doc_id", "first"))), ","))), ",")
    s = m.withColumn("signature", F.when(F.col("first").isNotNull(), both).otherwise(F.col("signature")))
    begins = (F.col("signature") != F.lag("signature").over(o)) | ~F.col("first").eqNullSafe(F.lag("first").over(o))
    s = s.withColumn("band", F.sum(F.coalesce(begins.cast("int"), F.lit(1))).over(o))
    b = s.groupBy("doc_id", "band", "signature").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    seen = b.where("signature <> ''").groupBy("doc_id", "signature").agg(F.min("first_page").alias("seen"))
    n = F.row_number().over(d.orderBy("seen")) - 1
    letter = seen.select("doc_id", "signature", F.concat(F.when(n >= 26, F.char(F.lit(64) + F.floor(n / 26))).otherwise(""), F.char(F.lit(65) + n % 26)).alias("letter"))
    decidable = (F.count("*").over(d) > 1) & (F.count("letter").over(d) > 0)
    return b.join(letter, ["doc_id", "signature"], "left").select("doc_id", "first_page", "last_page", F.coalesce("letter", F.lit("—")).alias("letter"), decidable.alias("decidable"))


def next_image_id(bin_items: DataFrame) -> DataFrame:
    """TK5: one more than the greatest number of an ``imageN`` id."""
    n = F.nullif(F.regexp_extract("id", "^image([0-9]+)$", 1), F.lit("")).cast("long")
    return bin_items.groupBy("doc_id").agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("next_id"))


def unreferenced(dropped: DataFrame, remaining: DataFrame) -> DataFrame:
    """JN16: binary items that only dropped paragraphs used."""
    return dropped.select("doc_id", "ref").distinct().join(remaining, ["doc_id", "ref"], "left_anti")


def match_images(requests: DataFrame, pics: DataFrame) -> DataFrame:
    """JN15: requests (doc_id, request_id, ref or caption, ext or null if the bytes are no picture, present): by ref, else by exact caption, else by a caption that contains it. What is wrong with the file comes first."""
    p = pics.select("doc_id", F.col("ref").alias("pic"), T.caption_key(F.col("caption")).alias("have"), F.col("ext").alias("slot"))
    j = joined(requests.withColumn("want", T.caption_key(F.col("caption"))), p, ["doc_id"], "left")
    score = F.when(F.col("ref") == F.col("pic"), 3).when(F.col("ref").isNull() & (F.col("want") == F.col("have")), 2).when(F.col("ref").isNull() & F.contains("have", F.col("want")), 1)
    best = F.max("score").over(W.partitionBy("doc_id", "request_id"))
    m = j.withColumn("score", score).withColumn("best", best).where("best is null or score = best")
    a = m.groupBy("doc_id", "request_id", "ext", "present", "best").agg(F.count("score").alias("n"), F.min(F.when(F.col("score").isNotNull(), F.col("pic"))).alias("pic"), F.min("slot").alias("slot"))
    slot, ext = (F.regexp_replace(F.lower(c), "^jpg$", "jpeg") for c in ("slot", "ext"))
    status = F.when(~F.col("present"), "missing_file").when(F.col("ext").isNull(), "bad_image").when(F.col("best").isNull(), "unmatched").when(F.col("n") > 1, "ambiguous").when(slot != ext, "format_mismatch").otherwise("replaced")
    usable = F.col("present") & F.col("ext").isNotNull() & (F.col("n") == 1)
    return a.select("doc_id", "request_id", F.when(usable, F.col("pic")).alias("ref"), status.alias("status"))


def figure_tables(tables: DataFrame, cells: DataFrame, pics: DataFrame) -> DataFrame:
    """PF10: one column, one or two rows, a ``[그림 ...]`` caption and a picture in the first cell."""
    t = tables.where((F.col("col_cnt") == 1) & F.col("row_cnt").isin(1, 2) & F.col("caption").rlike(r"^\s*\[\s*그림[^\]]*\]"))
    return t.join(pics.where("row = 0 and col = 0"), ["doc_id", "table_index"], "left_semi")


def link_census(fields: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """AG15: of each document the hyperlink fields (side, field_type), bare URLs in the text, equations, and LaTeX left as text (math with a backslash, a caret or an underscore), its first 60 characters."""
    linked = fields.where("side = 'begin' and field_type = 'HYPERLINK'").groupBy("doc_id").agg(F.count("*").alias("n_links"))
    bare = F.regexp_count("text", F.lit(r"""(?<![("'=\w])https?://[^\s<>"']+"""))
    left = F.transform(F.filter(T.math_spans(F.col("text")), lambda m: m["latex"].rlike(r"[\\^_]")), lambda m: F.substring(m["latex"], 1, 60))
    p = paragraphs.select("doc_id", "section_no", "para_idx", bare.alias("bare"), left.alias("left"), F.coalesce("equations", F.lit(0)).alias("equations"))
    said = p.groupBy("doc_id").agg(F.sum("bare").cast("long").alias("n_bare"), F.sum("equations").cast("long").alias("n_equations"), F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.size("left") > 0, F.struct("section_no", "para_idx", "left")))), lambda x: x["left"])).alias("latex_left"))
    return said.join(linked, "doc_id", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_bare", "n_equations", "latex_left")


def hooked(rows: DataFrame, setup: Callable[[], Callable[..., Iterable[tuple]]], inputs: list[str], outputs: str) -> DataFrame:
    """A caller's function as a table function, called laterally: for each row its columns and those of every tuple that the function gives for ``inputs``.

    ``setup`` is called once in each worker and returns the function, so that a model is loaded once. A row for which
    it raises has one row with the outputs null and the error's text; ``outputs`` is a schema. The hook's ``error`` is null otherwise.
    """

    class Hook:
        def __init__(self) -> None:
            self._call = None

        def eval(self, *values):  # noqa: ANN002, ANN202, A003
            try:
                self._call = self._call or setup()
                for got in self._call(*values):
                    yield (*got, None)
            except Exception as e:  # noqa: BLE001 (whatever a caller's function raises is that row's result)
                yield (*[None] * width, f"{type(e).__name__}: {e}")

    width = len(T_._parse_datatype_string(outputs).fields)
    table = F.udtf(Hook, returnType=f"{outputs}, error string")
    return rows.lateralJoin(table(*(F.col(c).outer() for c in inputs)))


VERDICT = "ok boolean, issues array<struct<type:string,detail:string>>, note string"


def judge_pages(pages: DataFrame, setup: Callable[[], Callable[[bytes, int, int], tuple]]) -> DataFrame:
    """UF1: pages (doc_id, page, image) through ``judge(image, page, pages of the document) -> (ok, issues, note)``; a page whose judge raises isn't judged (ok null) and names the error in the note."""
    total = pages.withColumn("pages", F.count("*").over(W.partitionBy("doc_id")))

    def one() -> Callable[..., Iterable[tuple]]:
        judge = setup()
        return lambda image, page, n: [judge(image, page, n)]

    got = hooked(total, one, ["image", "page", "pages"], VERDICT)
    return got.select("doc_id", "page", "ok", "issues", F.coalesce("error", "note").alias("note"))


def hash_pages(documents: DataFrame, setup: Callable[[], Callable[[bytes], Iterable[Iterable[str]]]]) -> DataFrame:
    """UF2: documents (doc_id, content) through ``hashes(content) -> one set of hashes for each page``: (doc_id, page from 1, hashes, error), as ``recurring_hashes`` takes them."""

    def one() -> Callable[..., Iterable[tuple]]:
        hashes = setup()
        return lambda content: [(i, sorted(h)) for i, h in enumerate(hashes(content), 1)]

    return hooked(documents, one, ["content"], "page long, hashes array<string>").select("doc_id", "page", "hashes", "error")
