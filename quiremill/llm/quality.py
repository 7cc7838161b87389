"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are runs of letters and digits and runs of punctuation, case kept. Features are the hashed
n-grams of one and two tokens, and of a word with itself (one feature for any word), with values
log(1 + count) scaled to length one. Training takes one row at a time (FTRL-proximal with L1 and
L2); a score is the sigmoid of a sparse dot product.

Bounds: at most ``ROWS`` labelled rows are fitted. Every row is scored.

Defined cases: null and empty text get the score of the bias; rows with a null label aren't
learned from; with no usable labels every score is 1 (nothing is known against a text); repeated rows are
scored alike; extra columns pass through, but a column ``score`` is an error before any job runs; an
empty table gives an empty result. A text is taken whole and needs about 150 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quiremill.llm.io import fresh
from quiremill.llm.kernel import LETTERS_AND_MARKS, Slab, Words
from quiremill.llm.labelled import Sparse, bounded, featured, scored

BITS = 20
ROWS = 6000


def ngrams_of(slab: Slab) -> Sparse:
    words = Words(slab, classes=LETTERS_AND_MARKS)
    at, two = words.grams(2)
    again = words.hash[at] == words.hash[at + 1]
    two[again] = np.uint64(0x5851F42D4C957F2D)
    bits, low = np.uint64(BITS), np.uint64((1 << BITS) - 1)
    both = (np.concatenate([words.row, words.row[at]]).astype(np.uint64) << bits) | (np.concatenate([words.hash, two]) >> np.uint64(64 - BITS))
    both, count = np.unique(both, return_counts=True)
    row = (both >> bits).astype(np.int64)
    borders = np.searchsorted(row, np.arange(len(slab) + 1))
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(row, value**2, len(slab)))
    return borders, (both & low).astype(np.int64), (value / norm[row]).astype(np.float32)


def ftrl(rows: list, epochs: int = 10, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> tuple[np.ndarray, float]:
    """FTRL-proximal, row after row; the last slot is the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= l1, 0.0, (np.sign(z[i]) * l1 - z[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))

    random = np.random.Generator(np.random.PCG64(3))
    for _ in range(epochs):
        for r in random.permutation(len(rows)):
            i, v, y = rows[r]
            i, v = np.append(i, 1 << BITS), np.append(v, 0.3)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - y) * v
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    part = 1 << (BITS - 6)  # for all slots at once, every step of weights() would be an array of 8 MB
    w = np.concatenate([weights(np.arange(i, i + part)).astype(np.float32) for i in range(0, 1 << BITS, part)])
    return w, float(weights(np.array([1 << BITS]))[0] * 0.3)


def train(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "quality") -> list[tuple[np.ndarray, float]]:
    known = labels.where(usable).where(F.col(label).isin(0, 1)).select(key, F.col(label).alias("y")).groupBy(key).agg(F.min("y").alias("y"))
    chosen = known.join(F.broadcast(bounded(known, key, ROWS)), key)
    rows = featured(docs.select(key, text), chosen, key, text, ngrams_of, ROWS)
    models = [ftrl(rows)] if rows else []
    del rows
    pa.default_memory_pool().release_unused()  # else the driver holds the rows' memory through all that follows
    return models


def score(docs: DataFrame, models: list[tuple[np.ndarray, float]], text: str = "text") -> DataFrame:
    """docs with ``score`` from 0 to 1."""
    fresh(docs, "score")
    return scored(docs, text, ngrams_of, models) if models else docs.withColumn("score", F.lit(1.0))
