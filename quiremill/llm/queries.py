"""Registered queries of this subpackage: thin calls of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quiremill.llm import bpe, decontam, html, infill, jaccard, lm, oracles, quality, repetition, secrets, sharding, substring, toxicity, vectorcodes
from quiremill.llm.io import table, texts
from quiremill.llm.labelled import fold

#: Rank file of the tokenizer; a path that every executor can open.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _decided(scores: DataFrame, held_out, at: float) -> DataFrame:  # noqa: ANN001
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= at).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = texts(spark, sf_dir, "documents", "doc_id", "text"), fold("doc_id", 5) == 0
    models = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), ~held_out)
    return _decided(toxicity.score(docs, models), held_out, 0.5)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(texts(spark, sf_dir, "documents", "doc_id", "text"), RANKS, public_tokenizers.PATTERN)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(texts(spark, sf_dir, "documents", "doc_id", "text"), n=4, num=85, den=100)


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.measure(texts(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = texts(spark, sf_dir, "documents", "doc_id", "text"), fold("doc_id", 4) == 2
    models = quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), ~held_out)
    return _decided(quality.score(docs, models), held_out, 0.7)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = texts(spark, sf_dir, "pages", "page_id", "url", "html")
    return html.main_text(pages, html.learned(pages)).withColumn("n_chars", F.length("text").cast("long"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(texts(spark, sf_dir, "documents", "doc_id", "text"), fold("doc_id", 7) == 2)


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.kept_words(substring.find_repeats(texts(spark, sf_dir, "documents", "doc_id", "text")))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_spans(texts(spark, sf_dir, "documents", "doc_id", "text"))
    kinds = F.transform("found", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, r.kind)) for r in secrets.RULES[: secrets.BASE]]
    counts = [(F.size("found") - n).cast("long").alias(f"n_{r.kind}") for n, r in zip(counts, secrets.RULES, strict=False)]
    base = F.filter("found", lambda s: s["kind_no"] < secrets.BASE)
    return found.select("doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("found")).alias("spans"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(texts(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.infilled(texts(spark, sf_dir, "documents", "doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(infill.restored().cast("binary"), 256).alias("restored_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compressed(table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, text = sharding.sharded(table(spark, sf_dir, "documents", "doc_id", "text")), F.coalesce("text", F.lit(""))
    return placed.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_bpe": op2_bpe,
    "op3_jaccard": op3_jaccard,
    "op4_repetition": op4_repetition,
    "op5_quality": op5_quality,
    "op6_html": op6_html,
    "op7_lm": op7_lm,
    "op8_substring": op8_substring,
    "op9_secrets": op9_secrets,
    "op10_decontam": op10_decontam,
    "op11_infill": op11_infill,
    "op12_vector_codes": op12_vector_codes,
    "op13_sharding": op13_sharding,
}

ORACLES: dict[str, str] = {
    "op3_jaccard": oracles.jaccard(4, 85, 100),
    "op4_repetition": oracles.repetition(),
    "op8_substring": oracles.substring(),
    "op9_secrets": secrets.oracle(),
    "op11_infill": infill.oracle(),
    "op12_vector_codes": vectorcodes.oracle(),
}
