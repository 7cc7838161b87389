"""Bounded training samples for the classifiers, and scoring of every row with a trained weight vector."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quiremill.llm.io import fresh
from quiremill.llm.kernel import Slab, slabs

#: Tasks that bring the chosen rows to the driver, each some 200 of them: what has come goes on to Python before the next.
DEALT = 32
#: (borders, indices, values) of a slab's rows: sparse vectors, row after row.
Sparse = tuple[np.ndarray, np.ndarray, np.ndarray]


def fold(key: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def bounded(ids: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` ids that hash least: a sample that depends on ids alone."""
    return ids.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(F.lit(5), key), key).limit(most)


def featured(docs: DataFrame, chosen: DataFrame, key: str, text: str, features: Callable[[Slab], Sparse], most: int) -> list:
    """The sparse vectors of the chosen rows (key, y), at most ``most`` rows of each y, in the order of a hash of id and text.

    chosen is bounded by its maker; the bound on rows holds after the join too, so an id that many rows
    share brings no more of them to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches):
            borders, index, value = features(slab)
            at = pa.array(borders, pa.int32())
            cols = [slab.batch["k"], slab.batch["y"], pa.ListArray.from_arrays(at, pa.array(index, pa.int32())), pa.ListArray.from_arrays(at, pa.array(value, pa.float32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["k", "y", "i", "v"])

    order = F.xxhash64(F.lit(5), F.col(key), F.col(text))
    rows = docs.join(F.broadcast(chosen), key).select(order.alias("k"), F.col("y").cast("int").alias("y"), F.col(text).cast("string").alias("text"))
    vectors = rows.mapInArrow(run, "k long, y int, i array<int>, v array<float>")
    got = pa.concat_tables(vectors.where(F.col("y") == y).orderBy("k").limit(most).repartition(DEALT).toArrow() for y in (0, 1))
    order = np.lexsort((got["k"].to_numpy(), got["y"].to_numpy()))
    order = order[np.random.Generator(np.random.PCG64(11)).permutation(len(order))]
    index, value = got["i"].combine_chunks(), got["v"].combine_chunks()
    y = got["y"].to_numpy()
    return [(index[int(i)].values.to_numpy(), value[int(i)].values.to_numpy(), int(y[i])) for i in order]


def scored(docs: DataFrame, text: str, features: Callable[[Slab], Sparse], weights: list[tuple[np.ndarray, float]]) -> DataFrame:
    """docs with ``score``: the mean over the weight vectors of sigmoid(bias + dot product). An empty text has the score of the bias."""
    fresh(docs, "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, text):
            borders, index, value = features(slab)
            score = np.zeros(len(slab))
            for w, bias in shared.value:
                sums = np.concatenate([[0.0], np.cumsum(w[index] * value, dtype=np.float64)])
                score += 1 / (1 + np.exp(-np.clip(sums[borders[1:]] - sums[borders[:-1]] + bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([*slab.batch.columns, pa.array(score / len(shared.value))], names=[*slab.batch.schema.names, "score"])

    return docs.mapInArrow(run, schema)
