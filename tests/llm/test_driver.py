"""What the pipeline's first two stages hold in the driver."""

import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quiremill.llm import jaccard, labelled, quality
from quiremill.llm.kernel import Slab
from .test_operators import brute_components


@pytest.fixture
def frames(spark):
    return type(spark.range(0))


def test_heavy_shingles_come_as_arrow(spark, frames, monkeypatch):
    """Executors pick them, no row of any task is collected; the ranks are those of a plain count, also between ties and with none."""
    texts = [f"a b c d e f{i % 7} {i} x y z" for i in range(300)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    none = spark.createDataFrame([], "text string")

    def collect(_):
        raise AssertionError("rows are collected")

    with monkeypatch.context() as m:
        m.setattr(frames, "collect", collect)
        m.setattr(jaccard, "HEAVY", 12)
        got, empty = jaccard.find_heavy(docs, 3), jaccard.find_heavy(none, 3)
    data = [t.encode() for t in texts]
    slab = Slab(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    count = Counter(jaccard.shingles(slab, 3)[1].tolist())
    top = sorted((h for h in count if count[h] > 3), key=lambda h: (-count[h], h))[:12]
    assert len(top) == 11 and got.dtype == np.uint64 and got.tolist() == [[h, len(top) - top.index(h)] for h in sorted(top)]
    assert empty.shape == (0, 2)


def test_classes_are_joined_once(spark, monkeypatch):
    """Blocks that meet again link components that are known as stars: the second turn of components reads written tables only."""
    plans, real = [], jaccard.components
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "components", lambda edges: plans.append(edges._jdf.queryExecution().optimizedPlan().toString()) or real(edges))
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(40):  # near copies of near copies, and a copy of each
        w = list(base)
        for k in range(i % 9):
            w[r.randrange(120)] = f"c{i}x{k}"
        rows += [(i, " ".join(w)), (100 + i, " ".join(w))]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got.collect()} == brute_components(rows, 5, 4, 5)
    assert len(plans) == 2 and "Join" in plans[0] and "Join" not in plans[1]


def test_chosen_rows_come_in_small_parts(spark, frames, monkeypatch):
    parts, real = [], frames.toArrow
    monkeypatch.setattr(frames, "toArrow", lambda df: parts.append(df.rdd.getNumPartitions()) or real(df))
    docs = spark.createDataFrame([(i, f"text {i % 5} of {i}") for i in range(400)], "doc_id long, text string")
    chosen = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("y"))
    rows = labelled.featured(docs, chosen, "doc_id", "text", quality.ngrams_of, 100)
    assert parts == [labelled.DEALT] * 2 and sorted(y for _, _, y in rows) == [0] * 100 + [1] * 100
    again = labelled.featured(docs.repartition(3), chosen, "doc_id", "text", quality.ngrams_of, 100)
    assert all(np.array_equal(a, b) for x, y in zip(rows, again, strict=True) for a, b in zip(x, y, strict=True))


def test_fit_leaves_nothing(spark, monkeypatch):
    """Weights are taken a few slots at a time (all at once took 67 MB), and Arrow's memory is given back."""
    rows = [(np.array([i, 7 * i + 1]), np.ones(2, np.float32), i % 2) for i in range(20)]
    tracemalloc.start()
    w, bias = quality.ftrl(rows, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert w.dtype == np.float32 and len(w) == 1 << quality.BITS and isinstance(bias, float)
    assert peak < 30e6

    given = []
    monkeypatch.setattr(quality, "pa", SimpleNamespace(default_memory_pool=lambda: SimpleNamespace(release_unused=lambda: given.append(1))), raising=False)
    docs = spark.createDataFrame([(i, f"text {i % 3}") for i in range(60)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    assert len(quality.train(docs, labels, F.lit(True))) == 1 and given == [1]
