"""Style systems: usage, roles, ladders and their checks. Tables are keyed by doc_id; windows never cross documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from quiremill.functions import text as T
from quiremill.sources.shared import joined


def style_usage(paragraphs: DataFrame) -> DataFrame:
    """AG1: paragraphs per style."""
    return paragraphs.groupBy("doc_id", "style_id").agg(F.count("*").alias("use_count"))


def style_system(styles: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """SRC5: styles with their use count, 0 if unused."""
    return joined(styles, style_usage(paragraphs), ["doc_id", "style_id"], "left").withColumn("use_count", F.coalesce("use_count", F.lit(0)).cast("long"))


def classify(system: DataFrame) -> DataFrame:
    """AG2: structured, weak or flat, from outline paragraphs, their levels and declared headings."""
    outline = (F.col("heading_type") == "OUTLINE") & (F.col("use_count") > 0)
    declared = F.regexp_extract(F.coalesce(T.role_override(F.col("name"), F.col("eng_name")), F.lit("")), r"^(HEADING_[0-9]+)$", 1)
    a = system.groupBy("doc_id").agg(
        F.sum("use_count").alias("n"),
        F.sum(F.when(outline, F.col("use_count")).otherwise(0)).alias("n_outline"),
        F.count_distinct(F.when(outline, F.col("outline_level"))).alias("n_levels"),
        F.count_distinct(F.nullif(declared, F.lit(""))).alias("n_declared"),
    )
    kind = F.when(F.col("n") == 0, "flat").when((F.col("n_outline") >= 3) & (F.col("n_levels") >= 2), "structured").when(F.col("n_declared") >= 2, "structured").when(F.col("n_outline") == 0, "flat").otherwise("weak")
    return a.select("doc_id", kind.alias("classification"), "n_outline", "n_levels", "n_declared")


def role_map(system: DataFrame) -> DataFrame:
    """WN1: (doc_id, role, style_id). Declared roles win, the last style of a name; per level the canonical, then most used, then first style."""
    s = system.withColumn("declared", T.role_override(F.col("name"), F.col("eng_name")))
    last = W.partitionBy("doc_id", "declared").orderBy(F.desc("pos"))
    own = s.where("declared is not null").withColumn("rn", F.row_number().over(last)).where("rn = 1").select("doc_id", F.col("declared").alias("role"), "style_id")
    enumerated = T.enumerator_class(F.col("name")).isNotNull()
    level = (F.col("outline_level") + 1).cast("string")
    auto = F.when((F.col("heading_type") == "OUTLINE") & enumerated, F.concat(F.lit("ORDERED_"), level)).when(F.col("heading_type") == "OUTLINE", F.concat(F.lit("HEADING_"), level)).when(F.col("heading_type") == "BULLET", F.concat(F.lit("BULLET_"), level)).when(F.lower(F.trim("name")).isin("normal", "바탕글") | F.lower(F.trim("eng_name")).isin("normal", "바탕글"), "BODY")
    canonical = F.coalesce(F.col("eng_name").rlike(r"(?i)^\s*Outline\s+[0-9]+\s*$"), F.lit(False))
    best = W.partitionBy("doc_id", "role").orderBy(F.desc(canonical), F.desc("use_count"), "pos")
    rest = s.where("declared is null").withColumn("role", auto).where("role is not null").withColumn("rn", F.row_number().over(best)).where("rn = 1").select("doc_id", "role", "style_id")
    return own.unionByName(joined(rest, own, ["doc_id", "role"], "left_anti"))


def paragraph_roles(paragraphs: DataFrame, system: DataFrame, roles: DataFrame) -> DataFrame:
    """JN1: role and level of each paragraph: its style's role, else what its paragraph property says, else body."""
    kinds = roles.where(F.col("role").rlike("^(HEADING|BULLET|ORDERED)_[0-9]+$|^BODY$")).groupBy("doc_id", "style_id").agg(F.min("role").alias("role"))
    props = system.select("doc_id", "style_id", "heading_type", "outline_level")
    j = paragraphs.join(kinds, ["doc_id", "style_id"], "left").join(props, ["doc_id", "style_id"], "left")
    parts = F.split("role", "_")
    kind = F.when(F.col("role").isNotNull(), parts[0]).when(F.col("heading_type") == "OUTLINE", "HEADING").when(F.col("heading_type") == "BULLET", "BULLET").otherwise("BODY")
    level = F.when(F.col("role") == "BODY", None).when(F.col("role").isNotNull(), F.try_element_at(parts, F.lit(2)).cast("long")).when(F.col("heading_type").isin("OUTLINE", "BULLET"), F.col("outline_level") + 1)
    return j.select("doc_id", "section_no", "para_idx", "text", kind.alias("role_kind"), level.alias("role_level"))


def heading_ladder(system: DataFrame, most: int = 6) -> DataFrame:
    """WN2: enumerator styles bigger than the body, by size; ``status`` says why a document has no ladder."""
    body = system.where("lower(trim(name)) in ('normal', '바탕글') or lower(trim(eng_name)) = 'normal'").groupBy("doc_id").agg(F.min("size_pt").alias("body_pt"))
    s = system.join(body, "doc_id", "left").withColumn("class", T.enumerator_class(F.col("name")))
    d = W.partitionBy("doc_id")
    s = s.withColumn("outlined", F.max((F.col("heading_type") == "OUTLINE") & (F.col("use_count") > 0)).over(d))
    c = s.where("class is not null and use_count > 0 and heading_type = 'NONE' and size_pt > coalesce(body_pt, 10.0)")
    n = F.count("*").over(d)
    c = c.withColumns({"n": n, "n_class": F.size(F.collect_set("class").over(d)), "n_size": F.size(F.collect_set("size_pt").over(d)), "rung": F.row_number().over(d.orderBy(F.desc("size_pt"), "pos"))})
    status = F.when(F.col("outlined"), "outline in use").when(F.col("n") < 2, "fewer than two").when(F.col("n_class") < F.col("n"), "class twice").when(F.col("n_size") < F.col("n"), "size twice").otherwise("ok")
    return c.where(F.col("rung") <= most).select("doc_id", "style_id", "class", "size_pt", F.col("rung").cast("long").alias("rung"), status.alias("status"))


def bullet_ladder(system: DataFrame) -> DataFrame:
    """WN3: used bullets, and used plain styles whose name is one glyph, by glyph rank, size, level and use; tied neighbours abort the document's ladder. A bullet with an unknown glyph goes by the first character of its name."""
    own, named, unknown = T.glyph_rank(F.col("glyph")), T.glyph_rank(F.col("name")), len(T.GLYPHS)
    bullet, plain = F.col("heading_type") == "BULLET", (F.col("heading_type") == "NONE") & T.glyph_name(F.col("name")).isNotNull()
    d = W.partitionBy("doc_id")
    number = F.coalesce(F.when(F.col("style_id").rlike("^[0-9]+$"), F.col("style_id").cast("long")), F.lit(0))
    o = d.orderBy("rank", F.desc(F.coalesce("size_pt", F.lit(0.0))), F.coalesce("outline_level", F.lit(0)), F.desc("use_count"), number, "pos")
    b = system.where((bullet | plain) & (F.col("use_count") > 0)).withColumn("rank", F.when(plain | (own == unknown), named).otherwise(own))
    same = (F.lag("rank").over(o) == F.col("rank")) & F.lag("size_pt").over(o).eqNullSafe(F.col("size_pt"))
    b = b.withColumn("rung", F.row_number().over(o)).withColumn("tie", F.coalesce(same, F.lit(False)))
    return b.select("doc_id", "style_id", "rank", F.col("rung").cast("long").alias("rung"), F.max("tie").over(d).alias("aborted"))


def normalization_plan(system: DataFrame) -> DataFrame:
    """WN4: style -> role for the ladders that a document doesn't declare itself, with the class it has and would have: structured with two heading levels, declared or planned."""
    own = T.role_override(F.col("name"), F.col("eng_name"))
    said = system.select("doc_id", own.alias("role")).where("role is not null")
    known = said.groupBy("doc_id").agg(F.bool_or(F.col("role").startswith("HEADING_")).alias("heads"), F.bool_or(F.col("role").startswith("BULLET_")).alias("bullets"), F.collect_set(F.when(F.col("role").rlike("^HEADING_[0-9]+$"), F.col("role"))).alias("levels"))
    h = heading_ladder(system).where("status = 'ok'").select("doc_id", "style_id", F.concat(F.lit("HEADING_"), F.col("rung").cast("string")).alias("role"))
    b = bullet_ladder(system).where("not aborted").select("doc_id", "style_id", F.concat(F.lit("BULLET_"), F.col("rung").cast("string")).alias("role"))
    plan = h.unionByName(b).join(known, "doc_id", "left")
    plan = plan.where(~F.coalesce(F.when(F.col("role").startswith("HEADING_"), F.col("heads")).otherwise(F.col("bullets")), F.lit(False)))
    planned = F.collect_set(F.when(F.col("role").startswith("HEADING_"), F.col("role"))).over(W.partitionBy("doc_id"))
    n = F.size(F.array_union(planned, F.coalesce("levels", F.array().cast("array<string>"))))
    plan = plan.withColumn("n", n).join(classify(system).select("doc_id", F.col("classification").alias("before")), "doc_id")
    return plan.select("doc_id", "style_id", "role", "before", F.when(F.col("n") >= 2, "structured").otherwise(F.col("before")).alias("expected"))


def ladder_gaps(system: DataFrame, roles: DataFrame) -> DataFrame:
    """WN5: missing heading levels, and levels that are bigger than the last sized level above them."""
    h = joined(roles.where("role like 'HEADING_%'"), system.select("doc_id", "style_id", "size_pt"), ["doc_id", "style_id"], "left").select("doc_id", F.substring_index("role", "_", -1).cast("long").alias("level"), "size_pt")
    span = h.groupBy("doc_id").agg(F.min("level").alias("lo"), F.max("level").alias("hi"))
    gaps = joined(span.select("doc_id", F.explode(F.sequence("lo", "hi")).alias("level")), h.select("doc_id", "level"), ["doc_id", "level"], "left_anti").withColumn("finding", F.lit("missing level"))
    above = F.last("size_pt", ignorenulls=True).over(W.partitionBy("doc_id").orderBy("level").rowsBetween(W.unboundedPreceding, -1))
    big = h.withColumn("above", above).where("size_pt > above").select("doc_id", "level", F.lit("bigger than the level above").alias("finding"))
    return gaps.unionByName(big)


def unmapped_styles(system: DataFrame, roles: DataFrame) -> DataFrame:
    """TK1: used styles without a role, by use; rank tells the three that a warning names."""
    free = joined(system.where("use_count > 0"), roles.select("doc_id", "style_id").distinct(), ["doc_id", "style_id"], "left_anti")
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("use_count"), "pos"))
    sibling = T.enumerator_class(F.col("name")).isNotNull() | F.col("heading_type").isin("OUTLINE", "BULLET")
    return free.select("doc_id", "style_id", "use_count", F.when(sibling, "ladder sibling").otherwise("structural").alias("kind"), rank.cast("long").alias("rank"))


def apply_roles(system: DataFrame, mapping: DataFrame) -> DataFrame:
    """JN14: mapping (doc_id, name, role) to styles: the first style of a name; names that no style has are errors."""
    first = system.withColumn("rn", F.row_number().over(W.partitionBy("doc_id", "name").orderBy("pos"))).where("rn = 1").select("doc_id", "name", "style_id")
    return mapping.join(first, ["doc_id", "name"], "left").select("doc_id", "name", "role", "style_id", F.col("style_id").isNull().alias("missing"))


def is_heading_style(system: DataFrame) -> DataFrame:
    """PF8: styles that head text, by property or by name."""
    name = F.lower("name")
    by_name = name.rlike("개요|제목|heading|title|ai:h") & ~name.rlike("bullet|글머리")
    return system.select("doc_id", "style_id", F.coalesce((F.col("heading_type") == "OUTLINE") | by_name, F.lit(False)).alias("is_heading"))
