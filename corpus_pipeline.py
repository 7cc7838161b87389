"""Documents to token ids in five stages; each reads what the stage before it wrote.

Defined cases, for every stage: a null or empty text is a text without words; a null id is kept and never the
copy, source or member of anything; repeated rows are treated alike; further columns of documents pass through
all stages but the last, whatever their names: they travel in one struct, so that none meets a name that an operator
uses; an empty table gives an empty table. Ids are whole numbers, others are an error before any job runs. Long texts are
taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quiremill.llm import bpe, decontam, jaccard, quality, secrets
from quiremill.llm.io import discard, saved, small_batches, table, texts, without

#: Documents whose quality score is lower go.
LEAST_QUALITY = 0.5


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as the struct ``own``."""
    others = [docs[f"`{c}`"] for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others).alias("own")) if others else docs.select("doc_id", "text")


def _unpacked(packed: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of like, in their order, from a packed table."""
    return packed.select(*(F.col(c) if c in ("doc_id", "text") else F.col("own").getField(c).alias(c) for c in like.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier, trained on the labelled documents, rejects.

    Null and empty texts have the score of the bias; without usable labels nothing is rejected.
    """
    small_batches(spark)
    models = quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), F.lit(True))
    return _unpacked(quality.score(_packed(docs), models).where(F.col("score") >= LEAST_QUALITY), docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document with the least id stays.

    Texts without words are no duplicates of each other; rows that share an id stay or go together.
    """
    small_batches(spark)
    return _unpacked(jaccard.one_of_each(_packed(docs)), docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a test item, whichever row of an id holds it; a null id stays."""
    small_batches(spark)
    hits = decontam.contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    return _unpacked(without(_packed(docs), "doc_id", saved(hits.select("doc_id").distinct())), docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; no document goes, a null text stays null, n_chars follows the text."""
    return _unpacked(secrets.redacted(_packed(docs)), docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether the decoded ids are the text's bytes; null and empty texts have no ids."""
    small_batches(spark)
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    done = bpe.round_trip(docs.select("doc_id", "text"), ranks, pattern)
    intact = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", intact.alias("intact"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("byte_bpe", byte_bpe),
]

#: SQL cannot express the classifier, so there is none; tests hold every stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, saved(stage(spark, docs, sf_dir))
        discard(before)
    return docs
