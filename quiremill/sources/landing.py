"""Incremental landing: packages of a folder as tables that follow it, rewriting only what changed.

A landing run writes the rows (``packages.contents``) of new and changed documents to a folder of its own, ``rows/run=N/kind=...``, and
then one row for each document that it judged to ``log/run=N``. A document's rows are those of the run that its last log row names, so a
run appears at once with its log, a run that broke off leaves nothing that readers see, and a repeated run replaces itself.
Time and length tell which packages to open, and the SHA-256 of the bytes which of these to parse. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from quiremill.sources import packages

LOG = "doc_id string, path string, modified timestamp, length long, digest string, status string, rows_run int, run int"
#: Up to so many changed packages are opened by their paths; beyond, the folder is read and joined with them.
PATHS = 10_000
_KINDS = packages.CONTENTS.removeprefix("kind string, ") + ", run int, kind string"


def log(spark: SparkSession, target: str) -> DataFrame:
    """Every judgement of every run: landed, touched (same bytes, new time or path) or removed."""
    try:
        return spark.read.schema(LOG).parquet(f"{target}/log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def current(spark: SparkSession, target: str) -> DataFrame:
    """SRC11: the last row of each document that is still there, with the run that holds its rows."""
    last = log(spark, target).groupBy("doc_id").agg(F.max_by(F.struct("path", "modified", "length", "digest", "status", "rows_run"), "run").alias("r"))
    return last.select("doc_id", "r.*").where("status <> 'removed'")


def contents(spark: SparkSession, target: str) -> DataFrame:
    """The rows of all kinds of every current document, as ``packages.contents`` gives them."""
    rows = spark.read.schema(_KINDS).parquet(f"{target}/rows")
    held = current(spark, target).select("doc_id", F.col("rows_run").alias("run"))
    return rows.join(held, ["doc_id", "run"], "left_semi").drop("run")


def pending(listed: DataFrame, known: DataFrame) -> DataFrame:
    """SRC11: listed (doc_id, path, modified, length) against what is current: new, changed or removed documents, with the digest known so far. A document under several paths counts as the latest of them."""
    last = W.partitionBy("doc_id").orderBy(F.desc("modified"), F.desc("path"))
    now = listed.select("doc_id", "path", "modified", "length").withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn")
    then = known.select("doc_id", F.struct("path", "modified", "length", "digest", "rows_run").alias("then"))
    same = (F.col("path") == F.col("then.path")) & (F.col("modified") == F.col("then.modified")) & (F.col("length") == F.col("then.length"))
    status = F.when(F.col("path").isNull(), "removed").when(F.col("then").isNull(), "new").when(~same, "changed")
    return now.join(then, "doc_id", "full_outer").withColumn("status", status).where("status is not null")


def _land(opened: DataFrame, spark: SparkSession, target: str, run: int) -> DataFrame:
    """Rows of the documents of opened (doc_id, path, modified, length, content) whose bytes are new, and the log rows of all of them."""
    known = current(spark, target).where(F.col("rows_run") != run).select("doc_id", F.col("digest").alias("had"), F.col("rows_run").alias("held"))
    seen = opened.withColumn("digest", F.sha2("content", 256))
    judged = seen.drop("content").join(known, "doc_id", "left").withColumn("fresh", ~F.coalesce(F.col("had") == F.col("digest"), F.lit(False)))
    judged = judged.select("doc_id", "path", "modified", "length", "digest", F.when(F.col("fresh"), "landed").otherwise("touched").alias("status"), F.when(F.col("fresh"), F.lit(run)).otherwise(F.col("held")).alias("rows_run"))
    judged.write.mode("overwrite").parquet(f"{target}/judged/run={run}")
    judged = spark.read.schema(judged.schema).parquet(f"{target}/judged/run={run}")
    fresh = opened.join(judged.where("status = 'landed'").select("doc_id"), "doc_id", "left_semi")
    packages.contents(fresh).write.mode("overwrite").partitionBy("kind").parquet(f"{target}/rows/run={run}")
    return judged


def _next(spark: SparkSession, target: str) -> int:
    return log(spark, target).agg(F.coalesce(F.max("run") + 1, F.lit(0))).first()[0]


def land(found: DataFrame, target: str) -> int:
    """SRC1, SRC11: bring target up to date with found (doc_id, path, modified, length, content), a full listing; returns the run.

    Content is read of new and changed documents only where found is a scan of files (its other columns don't need it) and
    these are at most PATHS; otherwise found is joined with them.
    """
    spark = found.sparkSession
    run = _next(spark, target)
    # Who changed is written first: the run's later steps must all see the same list.
    pending(found, current(spark, target)).write.mode("overwrite").parquet(f"{target}/pending/run={run}")
    todo = spark.read.parquet(f"{target}/pending/run={run}")
    opened = todo.where("status <> 'removed'").select("doc_id", "path")
    paths = [r.path for r in opened.select("path").limit(PATHS + 1).collect()]
    files = packages.is_scan(found)
    if files and 0 < len(paths) <= PATHS:
        chosen = packages.opened(spark, paths)
    else:
        chosen = found.join(F.broadcast(opened) if len(paths) <= PATHS else opened, ["doc_id", "path"], "left_semi")
    judged = _land(chosen.select("doc_id", "path", "modified", "length", "content"), spark, target, run)
    gone = todo.where("status = 'removed'").select("doc_id", "then.path", "then.modified", "then.length", "then.digest", "status", "then.rows_run")
    judged.unionByName(gone).write.mode("overwrite").parquet(f"{target}/log/run={run}")
    return run


def follow(spark: SparkSession, folder: str, target: str, checkpoint: str, pattern: str = "*.hwpx") -> StreamingQuery:
    """SRC1 as a stream of files: every micro-batch lands the packages whose paths are new, each batch as a run of its own.

    A document comes again by a new path below the folder; nothing is removed. A repeated batch replaces its run.
    """
    schema = spark.read.format("binaryFile").load(folder).schema
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)

    def merge(batch: DataFrame, number: int) -> None:
        named = packages.named(batch)
        last = named.groupBy("doc_id").agg(F.max_by("path", F.struct("modified", "path")).alias("path"))
        judged = _land(named.join(F.broadcast(last) if last.count() <= PATHS else last, ["doc_id", "path"], "left_semi").select("doc_id", "path", "modified", "length", "content"), spark, target, number)
        judged.write.mode("overwrite").parquet(f"{target}/log/run={number}")

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compacted(spark: SparkSession, source: str, target: str) -> None:
    """A copy of the current state as one run, without the rows that later runs have replaced."""
    contents(spark, source).write.mode("overwrite").partitionBy("kind").parquet(f"{target}/rows/run=0")
    current(spark, source).withColumns({"status": F.lit("landed"), "rows_run": F.lit(0)}).write.mode("overwrite").parquet(f"{target}/log/run=0")
