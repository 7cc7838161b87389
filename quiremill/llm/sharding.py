"""Sharding by a two-pass external shuffle.

First pass: a seeded hash of id, text and input split sends every record to one of n buckets, each small enough for
a task's memory; Spark's shuffle carries them there. Second pass: each task sorts its bucket by the hash, so that the
order in which records arrive doesn't matter, shuffles it by Fisher and Yates with a generator seeded by seed and bucket,
and writes it. The buckets one after the other are the shuffled table; shards are equal stretches of it, so their
row counts are at most one apart (law ``rows``), and a place in a shard follows from the rows of the buckets before.

The input split is part of the hash so that rows that are equal in everything, which may be a third of a table,
still go to many buckets. The same input split the same way and the same seed give the same shards; rows that are equal in
id and text are interchangeable.

Defined cases: a null text counts no bytes, null ids and repeated rows are rows like others; texts stay whole (a bucket's rows are held
in memory about three times); an empty table gives an empty one; a column that is called like a result keeps its
values under that name and ``_input``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from quiremill.llm.io import saved, shared_folder

#: Bytes of texts in a bucket, and what a row counts besides its text.
BUCKET_BYTES, ROW_BYTES = 64 << 20, 128
#: Buckets whose rows are counted up together; up to MANY buckets their offsets (24 bytes each) are broadcast.
BLOCK, MANY = 1024, 1 << 18
_SLICE = 2048


def fisher_yates(n: int, *seed: int) -> np.ndarray:
    """A permutation of range(n), each as likely as any other."""
    draws = np.random.Generator(np.random.PCG64(seed)).integers(0, np.arange(1, n + 1)).tolist() if n else []
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        j = draws[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def aside(df: DataFrame, *names: str) -> DataFrame:
    """df with columns of these names, in whatever case, renamed to the first free name that ends in ``_input``."""
    taken, out = {c.lower() for c in df.columns}, []
    for c in df.columns:
        new = c
        while new.lower() in {x.lower() for x in names} or (new != c and new.lower() in taken):
            new += "_input"
        taken.add(new.lower())
        out.append(new)
    return df.toDF(*out)


def shuffled(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 13, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """(table, buckets): df in shuffled order, written as structs ``own`` of its columns, with ``bucket`` and ``rank`` in it.

    There are as many buckets as memory asks for, and at least as many as the session's shuffle has partitions.
    """
    spark = df.sparkSession
    total = df.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    h = F.xxhash64(F.lit(seed), key, text)
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("own"), h.alias("h"))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("h", F.spark_partition_id()), F.lit(n)).cast("int")).repartitionById(n, F.col("bucket"))
    schema = T.StructType([T.StructField("own", df.schema), T.StructField("bucket", T.IntegerType()), T.StructField("rank", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := [b for b in batches if b.num_rows]):
            return
        rows = pa.Table.from_batches(held)
        order = np.argsort(rows["h"].to_numpy(), kind="stable")
        order = order[fisher_yates(len(order), seed, rows["bucket"][0].as_py())]
        rows = rows.drop_columns(["h"])
        for i in range(0, len(order), _SLICE):
            part = rows.take(pa.array(order[i : i + _SLICE]))
            part = part.append_column("rank", pa.array(np.arange(i, i + len(part), dtype=np.int64)))
            yield from part.combine_chunks().to_batches()

    return saved(dealt.mapInArrow(run, schema)), n


def sharded(df: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", seed: int = 13, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """df in shuffled order with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard)."""
    df = aside(df, "shard", "slot")
    rows, n = shuffled(df, key, text, seed, bucket_bytes)
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("block", F.expr(f"bucket div {BLOCK}"))
    blocks = dict(counts.groupBy("block").agg(F.sum("n")).collect())  # one row for BLOCK buckets
    before, total = {}, 0
    for b in sorted(blocks):
        before[b], total = total, total + blocks[b]
    starts = df.sparkSession.createDataFrame(list(before.items()), "block long, before long")
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("bucket")) - F.col("n")
    offsets = counts.withColumn("inside", inside).join(F.broadcast(starts), "block").select("bucket", (F.col("inside") + F.col("before")).alias("start"))
    at = rows.join(F.broadcast(offsets) if n <= MANY else offsets, "bucket").withColumn("at", F.col("start") + F.col("rank"))
    placed = at.withColumn("shard", F.expr(f"cast(((at + 1) * {shards} - 1) div {max(total, 1)} as int)"))
    return placed.select("own.*", "shard", F.expr(f"at - shard * {total}L div {shards}").alias("slot"))


def write(df: DataFrame, path: str | None = None, **how: object) -> str:
    """Write ``sharded(df, ...)`` as one folder for each shard, in the order of slots within each file; returns the folder."""
    path = path or shared_folder(df.sparkSession)
    sharded(df, **how).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path
