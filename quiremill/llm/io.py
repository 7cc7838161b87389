"""Reading tables and cutting lineage for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


#: Rows of an Arrow batch of whole texts.
BATCH = 512
#: A table read in fewer splits than this (1 GB at the usual size of a split) is dealt out to all cores first.
FEW_SPLITS = 8


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of texts. A small one in a single file would keep one core busy: it is dealt out; larger ones are read as they lie."""
    df, cores = table(spark, sf_dir, name, *columns), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, FEW_SPLITS) else df


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names. Only a local session, as in tests, may go without: it gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it from there: lineage ends, a lost executor costs no recomputation."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.saved_at = path
    return back


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``saved`` wrote, once nothing reads them any more."""
    for df in tables:
        if path := getattr(df, "saved_at", None):
            removed(df.sparkSession, path)


def fresh(df: DataFrame, *names: str) -> None:
    """An error if df has a column with one of these names, in whatever case."""
    if clash := {x.lower() for x in df.columns} & {x.lower() for x in names}:
        raise ValueError(f"columns {sorted(clash)} are there already")


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand rows to Python ``BATCH`` at a time: of whole texts its usual 10,000 are tens of MB, held on both sides by every worker. A smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, BATCH)


def whole_numbers(df: DataFrame, key: str) -> Column:
    """The column of ids as long; ids of another type than a whole number are an error before any job runs."""
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        raise TypeError(f"ids must be whole numbers, {key} is {df.schema[key].dataType.simpleString()}")
    return F.col(key).cast("long")


def marked(df: DataFrame, column: str, ids: DataFrame, mark: str = "__maybe", bits: int = 1 << 24) -> DataFrame:
    """df with a boolean ``mark``: false only if the row's column surely isn't among ids (one column), so that such rows need no join.

    What is broadcast is a bitmap of ``bits`` hash slots, whatever the number of ids: 2 MB here. When
    ids outnumber the slots it marks everything, and the join does all the work.
    """

    def slot(c: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(6), F.col(c)), F.lit(bits))

    name = ids.columns[0]
    held = ids.select(slot(name).alias("__slot")).groupBy(F.bitmap_bucket_number("__slot").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__slot")).alias("__bits"))
    at = F.bitmap_bit_position("__slot")
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(bitmap_bit_position(__slot) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    known = df.withColumn("__slot", slot(column)).withColumn("__bucket", F.bitmap_bucket_number("__slot")).join(F.broadcast(held), "__bucket", "left")
    return known.select(*(F.col(f"`{c}`") for c in df.columns), F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)).alias(mark))


def maybe_in(df: DataFrame, column: str, ids: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """The rows of df whose column may be among ids (one column): a filter before a join, which alone decides."""
    return marked(df, column, ids, bits=bits).where("__maybe").drop("__maybe")


def without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose key isn't among ids (one column of a table that ``saved`` wrote, read twice); null keys stay.

    Only rows that a bitmap can't rule out are shuffled to the join that decides; all others go on as they lie.
    """
    rows = marked(df.select(df[f"`{key}`"].alias("id"), F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("own")), "id", ids)
    met = rows.where("__maybe").join(ids.select(ids.columns[0]).withColumnRenamed(ids.columns[0], "__gone"), F.col("id") == F.col("__gone"), "left_anti")
    return rows.where("not __maybe").unionByName(met).select(*(F.col("own").getField(c).alias(c) for c in df.columns))
