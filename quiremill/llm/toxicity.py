"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic rows are the positives; a sample of all texts, toxic or not and with no label read,
is the unlabelled set. With p the share of toxic text, the risk of a classifier is
p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives)), where R+ and R- are mean logistic
losses against 1 and 0; where the second part falls below zero only the first is
followed. Features are the distinct hashed words of the whole text and the words' beginnings of
several lengths (a stem keeps its weight under any ending). Several classifiers, each with
another order of the batches, are averaged.

Bounds: at most ``POSITIVES`` and ``UNLABELLED`` rows are fitted. Every row is scored. The class prior
is the share of the usable labels that are 1, kept within ``PRIORS``; a feature counts only if it is
``LEAST_Z`` standard errors away from chance, so a handful of positives may leave none.

Defined cases: null and empty text get the score of the bias alone; unlabelled or null labels are
never positive; with no positives at all every score is 0; repeated rows are scored alike; extra columns pass
through, but a column ``score`` is an error before any job runs; an empty table gives an empty result. A
text is taken whole and needs about 150 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from quiremill.llm.io import fresh
from quiremill.llm.kernel import LETTERS, Slab, Words
from quiremill.llm.labelled import Sparse, bounded, featured, scored

BITS = 20
POSITIVES, UNLABELLED = 3000, 9000
#: A word gets a weight if its share of the positives differs from its share of the unlabelled rows by this many standard errors.
LEAST_Z = 6.0
PRIORS = (1e-3, 0.5)


#: Bytes of the beginnings of words that are features beside the words.
STEMS = (3, 4, 5, 6)


def words_of(slab: Slab, live: np.ndarray | None = None) -> Sparse:
    """The distinct hashed words and stems of each row, lower-cased, with the value 1; only those that live marks, if given."""
    words = Words(slab, lower=True, classes=LETTERS)
    rows, slots = [words.row], [words.hash >> np.uint64(64 - BITS)]
    for size in STEMS:
        long = words.end - words.start > size
        start = words.start[long]
        rows.append(words.row[long])
        slots.append(words.spans(start, start + size) * np.uint64(0x2545F4914F6CDD1D) >> np.uint64(64 - BITS))
    row, slot = np.concatenate(rows), np.concatenate(slots)
    if live is not None:
        kept = live[slot]
        row, slot = row[kept], slot[kept]
    both = np.unique((row.astype(np.uint64) << np.uint64(BITS)) | slot)
    row = (both >> np.uint64(BITS)).astype(np.int64)
    return np.searchsorted(row, np.arange(len(slab) + 1)), (both & np.uint64((1 << BITS) - 1)).astype(np.int64), np.ones(len(both), np.float32)


def risk(theta: np.ndarray, positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of theta (weights, then the bias) on rows of feature numbers, and the gradient that is followed."""
    m = len(theta)

    def losses(rows: list[np.ndarray], *labels: int) -> list[tuple[float, np.ndarray]]:
        sizes = np.array([len(r) for r in rows])
        at, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes)
        z = np.bincount(row, theta[at], len(rows)) + theta[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        made = [(np.logaddexp(0, -z if y else z).mean(), p - y) for y in labels]
        return [(loss, np.append(np.bincount(at, g[row], m - 1), g.sum()) / len(rows)) for loss, g in made]

    (found, up), (missed, down) = losses(positives, 1, 0)
    (negative, g) = losses(unlabelled, 0)[0]
    rest = negative - prior * missed
    return prior * found + max(0.0, rest), prior * up + (g - prior * down if rest >= 0 else 0)


def fit(rows: list, prior: float, seed: int, epochs: int = 60, batch: int = 256, rate: float = 0.05, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk; y is 1 for positives and 0 for unlabelled rows."""
    w = np.zeros(1 << BITS, np.float32)
    seen = np.zeros((2, 1 << BITS))
    total = np.zeros((2, 1))
    for i, _, y in rows:
        seen[y, i] += 1
        total[y] += 1
    share = (seen + 0.5) / (total + 1)
    pooled = (seen.sum(0) + 1) / (total.sum() + 2)
    error = np.sqrt(pooled * (1 - pooled) * (1 / total).sum())
    live = np.flatnonzero(np.abs(share[1] - share[0]) >= LEAST_Z * error)
    to = np.full(1 << BITS, -1, np.int64)
    to[live] = np.arange(len(live))
    x = {y: [to[i][to[i] >= 0] for i, _, label in rows if label == y] for y in (0, 1)}
    random, m = np.random.Generator(np.random.PCG64(seed)), len(live) + 1
    theta, first, second, turn = np.zeros(m), np.zeros(m), np.zeros(m), 0
    theta[-1] = np.log(prior / (1 - prior))

    steps = max(1, len(x[0]) // batch)
    for _ in range(epochs):
        unlabelled, positive = random.permutation(len(x[0])), random.permutation(np.resize(np.arange(len(x[1])), max(len(x[1]), steps * 64)))
        for s in range(steps):
            some = [[x[1][i] for i in positive[s * len(positive) // steps : (s + 1) * len(positive) // steps]], [x[0][i] for i in unlabelled[s * batch : (s + 1) * batch]]]
            grad = risk(theta, *some, prior)[1]
            grad[:-1] += decay * theta[:-1]
            turn += 1
            first += 0.1 * (grad - first)
            second += 0.001 * (grad**2 - second)
            theta -= rate * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
    w[live] = theta[:-1]
    return w, float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", classifiers: int = 2) -> list[tuple[np.ndarray, float]]:
    """Classifiers from the usable rows: labels name the positives and give the prior, nothing else."""
    known = labels.where(usable)
    toxic, total = known.where(F.col(label).isNotNull()).agg(F.sum((F.col(label) == 1).cast("long")), F.count("*")).first()
    if not toxic:
        return []
    prior = min(max(toxic / total, PRIORS[0]), PRIORS[1])
    positives = bounded(known.where(F.col(label) == 1), key, POSITIVES).withColumn("y", F.lit(1))
    unlabelled = bounded(docs.where(usable), key, UNLABELLED).withColumn("y", F.lit(0))
    rows = featured(docs.select(key, text), positives.unionByName(unlabelled), key, text, words_of, UNLABELLED)
    return [fit(rows, prior, seed) for seed in range(classifiers)] if {y for _, _, y in rows} == {0, 1} else []


def score(docs: DataFrame, models: list[tuple[np.ndarray, float]], text: str = "text") -> DataFrame:
    """docs with ``score`` from 0 to 1."""
    fresh(docs, "score")
    if not models:
        return docs.withColumn("score", F.lit(0.0))
    live = np.any([w != 0 for w, _ in models], axis=0)
    return scored(docs, text, lambda slab: words_of(slab, live), models)
