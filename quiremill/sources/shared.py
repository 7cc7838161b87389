"""A folder that all executors share, for tables that jobs and streams write on their way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``; only a local session, as in tests, may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df written once as Parquet below the shared folder and read from there, for several rules that start from it."""
    df.write.parquet(path := shared_folder(df.sparkSession))
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of files whose rows one task of ``dealt`` and ``joined`` holds.
SHARE = 1 << 22


def shares(*tables: DataFrame) -> int:
    """How many tasks rows of tables are dealt to: one for every SHARE bytes of the files that they are read from, as many as there are cores at least.

    Left to itself, adaptive execution joins what was shuffled to as few tasks as there are cores, so that what a task sorts grows with the corpus.
    """
    size = 0
    for t in tables:
        leaves = t._jdf.queryExecution().optimizedPlan().collectLeaves()
        known = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
        size += sum(n for n in known if n < 1 << 60)  # rows without files have no size
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, -(-size // SHARE))


def common_shares(*tables: DataFrame) -> int:
    """Tasks for a chain of joins by one key whose tables are each dealt once: not fewer than Spark's own, for which it would deal them anew."""
    return max(shares(*tables), int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """df with rows of equal keys in one of so many tasks, or of n; windows, groups and joins by these keys shuffle no more."""
    return df.repartition(n or shares(df), *keys)


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", n: int | None = None) -> DataFrame:
    """left joined with right, two tables that grow with the corpus, by sort and merge in so many tasks, or in n.

    Nothing is broadcast: the compressed size of their files, or of what was shuffled, may look small enough where the rows are not.
    A side that is dealt to n tasks by the same keys already isn't shuffled again.
    """
    n = n or shares(left, right)
    return left.repartition(n, *on).join(right.repartition(n, *on).hint("merge"), on, how)
