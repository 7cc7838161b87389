"""Vector code compression: equal parts of each vector are replaced by the index of the nearest entry of a small codebook.

Codebooks are refined in rounds of whole-number k-means. The nearest entry is found by Orchard search: for
every entry there is a list of all entries in order of distance from it. A search starts at some entry, walks the
list of the best entry so far, jumps to the list of any better one that it meets, never looks at an entry twice, and
stops where the list's distance exceeds twice the distance to the best entry - beyond that the triangle inequality
leaves nothing nearer or as near. All searches of a batch walk side by side, ``LOOK`` places of their lists at a time.

A round is one pass over the vectors; each task adds up its own parts by entry, so only sums travel (at most
parts * entries rows from a task) and a vector that a third of all rows share is added up where it lies. The
driver holds codebooks alone.

Defined cases: rows whose vector is null or holds null, NaN or infinite components go; vectors of another
length than the one with the least id stay with null code and error; null ids come last among ids, equal ids
are ordered by their vectors; fewer rows than entries make a smaller codebook; an empty table gives an empty one.
A length that ``parts`` doesn't divide, and components too large for exact 64-bit distances, are errors. Only the
key, the label and the vector are read, so other columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quiremill.llm.io import discard, saved
from quiremill.llm.kernel import sha256

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Places of a list that are looked at together, and searches that walk side by side.
LOOK, SIDE = 8, 4096


class Orchard:
    """Exact nearest entries (ties to the lower index) among the rows of a codebook."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        apart = np.stack([((self.entries - x) ** 2).sum(axis=1) for x in self.entries])
        self.lists = np.argsort(apart, axis=1, kind="stable")
        self.far = np.take_along_axis(apart, self.lists, axis=1)
        sums = self.entries.sum(axis=1)
        self.by_sum = np.argsort(sums, kind="stable")
        self.sums = sums[self.by_sum]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance to it) of every row."""
        index, squared = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        for i in range(0, len(points), SIDE):
            index[i : i + SIDE], squared[i : i + SIDE] = self._walk(points[i : i + SIDE])
        return index, squared

    def _walk(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = len(self.entries)
        most = max(int(np.abs(points, dtype=np.int64).max(initial=0)), int(np.abs(self.entries).max()))
        largest = points.shape[1] * (2 * most) ** 2
        if largest * k >= 2**62:
            raise OverflowError(f"components up to {most} are too large for exact distances")
        kind = np.int32 if largest < 2**31 else np.int64
        q, entries = points.astype(kind), self.entries.astype(kind)

        def squared(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            d = q[rows] - entries[at]
            return np.einsum("ij,ij->i", d, d).astype(np.int64)

        everyone = np.arange(len(q))
        best = self.by_sum[np.clip(np.searchsorted(self.sums, points.sum(axis=1, dtype=np.int64)), 0, k - 1)]
        near = squared(everyone, best)
        seen = np.zeros((len(q), k), bool)
        seen[everyone, best] = True
        place, walking = np.zeros(len(q), np.int64), everyone
        while len(walking):
            of, columns = best[walking, None], place[walking, None] + np.arange(LOOK)
            there, columns = columns < k, np.minimum(columns, k - 1)
            met = self.lists[of, columns]
            there &= self.far[of, columns] <= 4 * near[walking, None]
            row, column = np.nonzero(there & ~seen[walking[:, None], met])
            found = met[row, column]
            seen[walking[row], found] = True
            ranked = np.full(met.shape, np.iinfo(np.int64).max)
            ranked[row, column] = squared(walking[row], found) * k + found
            ranked = ranked.min(axis=1)
            better = ranked < near[walking] * k + best[walking]
            jump = walking[better]
            near[jump], best[jump] = np.divmod(ranked[better], k)
            place[walking] += LOOK
            place[jump] = 0
            walking = walking[better | there[:, -1]]
        return best, near


def whole(df: DataFrame, key: str, label: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(key, label, v): the usable vectors with components floor(scale * x), written once, as every round reads them."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return saved(df.where(F.col(vector).isNotNull() & finite).select(F.col(key).alias("key"), F.col(label).alias("label"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v")))


def _points(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """(row, part, position) of a batch whose vectors all have the same length."""
    return batch["v"].flatten().to_numpy().reshape(batch.num_rows, parts, -1)


def trained(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """The codebooks (part, entry, position) of vectors as ``whole`` gives them; none if there are no vectors.

    They start as the parts of the ``entries`` least ids; ``rounds`` times every entry becomes the floored mean of the
    parts that are nearest to it, an unused entry stays.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for each part: 1 to 256 entries")
    order = [F.col("key").asc_nulls_last(), "v"]
    if not (first := vectors.orderBy(*order).limit(1).collect()):
        return None
    length = len(first[0].v)
    if not length or length % parts:
        raise ValueError(f"vectors of {length} components don't have {parts} equal parts")
    vectors = vectors.where(F.size("v") == length)
    start = np.array([r.v for r in vectors.orderBy(*order).limit(entries).collect()], np.int64)
    books = start.reshape(len(start), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        books = _refined(vectors, books)
    return books


def _refined(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    parts, entries, width = books.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gardens = [Orchard(b) for b in shared.value]
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            points = _points(batch, parts)
            for p, garden in enumerate(gardens):
                index, _ = garden.nearest(points[:, p])
                np.add.at(sums[p], index, points[:, p])
                counts[p] += np.bincount(index, minlength=entries)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.FixedSizeListArray.from_arrays(pa.array(sums[p, e].ravel()), width).cast(pa.list_(pa.int64()))], names=["p", "e", "n", "s"])

    added = vectors.select("v").mapInArrow(run, "p int, e int, n long, s array<long>").groupBy("p", "e").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[i]) for i in range(width))).alias("s"))
    books = books.copy()
    for r in added.collect():  # a codebook's worth of rows
        books[r.p, r.e] = np.array(r.s, np.int64) // r.n
    shared.destroy()
    return books


def digest(books: np.ndarray) -> str:
    return sha256(",".join(map(str, books.ravel().tolist())).encode())


def encoded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(key, label, code, error) of every vector: two hex digits for each part, and the squared distances added up."""
    parts, _, width = books.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    fields = {f.name: f.dataType for f in vectors.schema}
    schema = T.StructType([T.StructField("key", fields["key"]), T.StructField("label", fields["label"]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gardens = [Orchard(b) for b in shared.value]
        for batch in batches:
            fits = pa.array(np.diff(batch["v"].offsets.to_numpy()) == parts * width)
            for b, known in ((batch.filter(fits), True), (batch.filter(pa.compute.invert(fits)), False)):
                code, error = pa.nulls(b.num_rows, pa.string()), pa.nulls(b.num_rows, pa.int64())
                if known and b.num_rows:
                    points = _points(b, parts)
                    index, squared = zip(*(g.nearest(points[:, p]) for p, g in enumerate(gardens)), strict=True)
                    code = pa.array([x.tobytes().hex() for x in np.stack(index, axis=1).astype(np.uint8)])
                    error = pa.array(np.sum(squared, axis=0))
                yield pa.RecordBatch.from_arrays([b["key"], b["label"], code, error], names=schema.fieldNames())

    return vectors.mapInArrow(run, schema)


def decoded(code: str, books: np.ndarray, scale: int = SCALE) -> Column:
    """The vector that a code stands for, as doubles; null for a null code."""
    tables = [F.array(*(F.array(*(F.lit(float(x) / scale) for x in entry)) for entry in book)) for book in books]
    at = [F.conv(F.substring(F.col(code), 2 * p + 1, 2), 16, 10).cast("int") for p in range(len(books))]
    return F.flatten(F.array(*(F.get(t, i) for t, i in zip(tables, at, strict=True))))


def compressed(df: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every usable row; label_error adds up the errors of a label, nulls together."""
    vectors = whole(df, key, label, vector)
    books = trained(vectors, parts, entries, rounds)
    if books is None:
        books = np.zeros((parts, 1, 1), np.int64)
    codes = saved(encoded(vectors, books))
    discard(vectors)
    by_label = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(F.col("key").alias(key), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The rows of ``compressed`` over ``embeddings`` in SQL: every part is held against every entry."""
    steps = [
        f"k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS i, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS (SELECT i, p, pos, v[p * (len(v) // {parts}) + pos + 1] AS x FROM (SELECT i, v, unnest(range({parts})) AS p FROM k) JOIN range(4096) r(pos) ON pos < len(v) // {parts})",
        f"c0 AS (SELECT p, i - 1 AS e, pos, x FROM p WHERE i <= {entries})",
    ]
    for n in range(rounds + 1):
        steps.append(f"d{n} AS (SELECT p.i, p.p, c.e, sum((p.x - c.x) * (p.x - c.x))::BIGINT AS d FROM p JOIN c{n} c ON c.p = p.p AND c.pos = p.pos GROUP BY ALL), a{n} AS (SELECT i, p, min(row(d, e)) AS m FROM d{n} GROUP BY ALL)")
        if n < rounds:
            steps.append(f"s{n} AS (SELECT p.p, m[2] AS e, pos, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM p JOIN a{n} a ON a.i = p.i AND a.p = p.p GROUP BY ALL), c{n + 1} AS (SELECT c.p, c.e, c.pos, coalesce(s.x, c.x) AS x FROM c{n} c LEFT JOIN s{n} s ON s.p = c.p AND s.e = c.e AND s.pos = c.pos)")
    last = f"""r AS (SELECT i, string_agg(printf('%02x', m[2]), '' ORDER BY p) AS code, sum(m[1])::BIGINT AS error FROM a{rounds} GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, pos)) FROM c{rounds}) AS codebooks_sha256 FROM k JOIN r USING (i)"""
    return "WITH " + ",\n".join([x.replace(" AS (", " AS MATERIALIZED (", 1) for x in steps] + [last])
