"""Substring dedup with a log-structured index of window fingerprints.

A window is ``window`` consecutive words of one document. A window repeats when its word sequence
also starts in a document with a smaller id; every word that a repeated window covers is removed.

The index holds sorted immutable runs of (fp, rid, doc_id), each a Parquet table in buckets of fp with one
sorted file a bucket, so a batch is merge-joined with them where they lie: history is neither dealt out nor
sorted again (``spark.sql.legacy.bucketedTableScan.outputOrdering`` is set for the session). A window's
fingerprint is the least hash of its ``k``-word grams, so equal windows have equal fingerprints while
neighbours share theirs: a run has about one row for every (window - k) / 2 words. What a batch shares with
the runs before it is verified: only the windows behind shared fingerprints get their full 64-bit
hash, compared within one fingerprint (so on 128 bits). Windows that share a fingerprint travel as
one array; equal arrays (copies) are aggregated to their least doc_id before any window is listed by
itself, so a group of copies costs one row for each map task. ``fan`` runs of one level are compacted
to one of the next, and then removed. Tables of a batch go once its result is written; ``close`` removes what is left.

An index in a folder keeps the texts of its documents and a list of its runs there, and
``SubstringIndex.opened`` goes on from it in a later session; one without a folder is for one job.

Batches must come in ascending ranges of doc_id, since a batch is only judged against itself and
what came before. Defined cases: null and empty text have no words; a null doc_id is neither
source nor target; rows with one doc_id never count against each other; repeated rows are judged
alike; ids are whole numbers, others are an error before any job runs; extra columns are not read. An empty
table gives an empty result. A text is taken whole and needs about 100 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quiremill.llm.io import discard, marked, maybe_in, removed, saved, shared_folder, whole_numbers
from quiremill.llm.kernel import Slab, Words, row_sums, sha256, signed, slabs

_RUN = "fp bigint, rid bigint, doc_id bigint"


def row_id(key: str, text: str) -> Column:
    return F.xxhash64(F.lit(8), F.col(key), F.col(text))


def minimizers(words: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, fingerprint) of every window: the least hash of the grams in it."""
    at, h = words.grams(k)
    wide = window - k + 1
    n = len(h) - wide + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, span = h.copy(), 1
    while span * 2 <= wide:
        least[:-span] = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[wide - span : wide - span + n])
    own = words.row[at[:n]] == words.row[at[wide - 1 :]]
    return at[:n][own], least[own]


class SubstringIndex:
    """Runs of historical fingerprints; ``repeats`` judges a batch and then adds it."""

    def __init__(self, spark: SparkSession, folder: str | None = None, window: int = 50, k: int = 10, fan: int = 4, max_run: int = 64, buckets: int | None = None):
        if not 1 <= k <= window:
            raise ValueError("k must be from 1 to window")
        self.spark, self.window, self.k, self.fan, self.max_run = spark, window, k, fan, max_run
        self.kept, self.folder = folder is not None, (folder or shared_folder(spark)).rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version = 0
        self.scratch: list[DataFrame] = []  # tables that only the batch at hand needs
        self.known: set[str] = set()  # runs that this index told the catalog of
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        self.runs: list[tuple[int, str]] = []  # level and name of each run, oldest first
        self.texts: list[DataFrame] = []  # documents that the runs come from

    @classmethod
    def opened(cls, spark: SparkSession, folder: str) -> SubstringIndex:
        """The index that was kept in a folder, as the last batch left it."""
        listed = spark.read.parquet(f"{folder.rstrip('/')}/list")
        last = listed.agg(F.max("version")).first()[0]
        rows = listed.where(F.col("version") == last).orderBy("no").collect()
        r = rows[0]
        index = cls(spark, folder, r.window, r.k, r.fan, r.max_run, r.buckets)
        index.version, index.runs = last, [(x.level, x.name) for x in rows]
        index.texts = [spark.read.parquet(f"{index.folder}/texts")]
        return index

    def run(self, name: str) -> DataFrame:
        """A run as a table in buckets; a session that hasn't seen it yet learns of it here."""
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} ({_RUN}) USING parquet CLUSTERED BY (fp) SORTED BY (fp, rid) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
            self.known.add(name)
        return self.spark.table(name)

    def written(self, rows: DataFrame) -> str:
        """Write a run, one file for each bucket, and give its name."""
        name = f"run_{uuid.uuid4().hex}"
        self.known.add(name)
        rows.repartition(self.buckets, "fp").write.bucketBy(self.buckets, "fp").sortBy("fp", "rid").option("path", f"{self.folder}/{name}").option("compression", "zstd").saveAsTable(name)
        return name

    def met(self, name: str, batch: DataFrame) -> DataFrame:
        """The rows of a run whose fingerprint is among those of a batch (fp, each once): both are read in order of fp."""
        return self.run(name).join(batch.hint("merge"), "fp", "left_semi")

    def dropped(self, *names: str, files: bool = True) -> None:
        """Take runs out of the catalog, and with their files out of the folder."""
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.known.discard(name)
            if files:
                removed(self.spark, f"{self.folder}/{name}")

    def close(self) -> None:
        """Leave nothing in the catalog; an index that isn't kept leaves no files either."""
        self.dropped(*self.known, files=not self.kept)

    def _saved(self, df: DataFrame) -> DataFrame:
        self.scratch.append(saved(df))
        return self.scratch[-1]

    def fingerprints(self, docs: DataFrame) -> DataFrame:
        """(fp, rid, doc_id), once for each fingerprint of a row."""
        window, k = self.window, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for slab in slabs(batches):
                words = Words(slab)
                at, fp = minimizers(words, window, k)
                row = words.row[at]
                new = np.ones(len(fp), bool)
                new[1:] = (fp[1:] != fp[:-1]) | (row[1:] != row[:-1])
                got = np.unique(np.rec.fromarrays([row[new], signed(fp[new])], names="r,f"))
                rid, doc = slab.batch["rid"].to_numpy(), slab.batch["doc_id"].to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(got.f), pa.array(rid[got.r]), pa.array(doc[got.r])], names=["fp", "rid", "doc_id"])

        return docs.select("rid", "doc_id", "text").mapInArrow(run, "fp long, rid long, doc_id long")

    def occurrences(self, docs: DataFrame) -> DataFrame:
        """(rid, doc_id, fp, pos, hs): stretches of windows whose fingerprint is in the row's ``fps``."""
        window, k, most = self.window, self.k, self.max_run

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for slab in slabs(batches):
                words = Words(slab)
                at, fp = minimizers(words, window, k)
                wanted = slab.batch["fps"].flatten().to_numpy().view(np.uint64)
                keep = np.isin(fp, wanted)
                where, full = words.grams(window)
                at, fp, full = at[keep], fp[keep], full[keep]
                if not len(at):
                    continue
                row = words.row[at]
                new = np.ones(len(at), bool)
                new[1:] = (fp[1:] != fp[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
                first = np.flatnonzero(new)
                within = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
                first = np.flatnonzero(within % most == 0)
                offsets = pa.array(np.append(first, len(at)), pa.int32())
                hs = pa.ListArray.from_arrays(offsets, pa.array(signed(full)))
                r = row[first]
                rid, doc = slab.batch["rid"].to_numpy(), slab.batch["doc_id"].to_numpy()
                pos = (at[first] - words.row_at[r]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(rid[r]), pa.array(doc[r]), pa.array(signed(fp[first])), pa.array(pos), hs], names=["rid", "doc_id", "fp", "pos", "hs"])

        return docs.select("rid", "doc_id", "text", "fps").mapInArrow(run, "rid long, doc_id long, fp long, pos int, hs array<long>")

    def repeats(self, docs: DataFrame, last: bool = False) -> DataFrame:
        """(rid, starts) for the rows of this batch that have repeated windows; then the batch joins the index, unless it is the last of a job.

        docs: rid, doc_id, text, without null doc_id.
        """
        new = self.written(self.fingerprints(docs))
        totals = self.run(new).groupBy("fp").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        shared = totals.where("lo < hi").select("fp")
        wanted, texts = self.run(new), docs
        if self.runs:
            hits = [self.met(name, totals.select("fp")) for _, name in self.runs]
            past = self._saved(_union(hits))  # each run and the batch, merged on fp
            shared, wanted = shared.unionByName(past.select("fp")).distinct(), wanted.unionByName(past)
            texts = _union([docs, *self.texts])
        wanted = self._saved(wanted.join(shared, "fp", "left_semi").groupBy("rid").agg(F.collect_set("fp").alias("fps")))
        found = self.verify(maybe_in(texts, "rid", wanted.select("rid")).join(wanted, "rid"))
        if self.runs:
            found = found.join(docs.select("rid").distinct(), "rid", "left_semi")
        found = saved(found)
        discard(*self.scratch)
        self.scratch.clear()
        if last and not self.kept:
            self.dropped(new)
        else:
            self.add(new, docs)
        return found

    def verify(self, candidates: DataFrame) -> DataFrame:
        """(rid, starts): starts of the windows that a smaller doc_id has too."""
        occ = self._saved(self.occurrences(candidates).withColumn("vid", F.xxhash64("fp", "hs")))
        variants = occ.groupBy("fp", "vid", "hs").agg(F.min("doc_id").alias("first"))
        variants = self._saved(variants)
        many = self._saved(variants.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"))
        # Both are written: one fingerprint may have many arrays and one window be in many of them, and joins that count
        # nothing on the way can be split.
        listed = self._saved(variants.join(many, "fp", "left_semi").select("fp", "vid", "first", F.posexplode("hs").alias("i", "h")))
        least = self._saved(listed.groupBy("fp", "h").agg(F.min("first").alias("least"), F.max("first").alias("most")).where("least < most").drop("most"))
        earlier = listed.join(least, ["fp", "h"]).where("least < first")
        earlier = earlier.groupBy("fp", "vid").agg(F.map_from_entries(F.collect_list(F.struct("i", "least"))).alias("earlier"))
        firsts = variants.select("fp", "vid", "first").join(earlier, ["fp", "vid"], "left")
        judged = occ.select("rid", "doc_id", "fp", "vid", "pos", F.size("hs").alias("n")).join(firsts, ["fp", "vid"])
        every = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: i + F.col("pos"))
        some = F.transform(F.filter(F.map_keys("earlier"), lambda i: F.col("earlier")[i] < F.col("doc_id")), lambda i: i + F.col("pos"))
        starts = F.when(F.col("first") < F.col("doc_id"), every).when(F.col("earlier").isNotNull(), some)
        return judged.select("rid", starts.alias("s")).where("size(s) > 0").groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("starts"))

    def add(self, run: str, docs: DataFrame) -> None:
        """Append a run, compact while ``fan`` runs have one level, and note the new state."""
        self.runs.append((0, run))
        old: list[str] = []
        while len(self.runs) >= self.fan and len({level for level, _ in self.runs[-self.fan :]}) == 1:
            merged = self.runs[-self.fan :]
            self.runs[-self.fan :] = [(merged[0][0] + 1, self.written(self.spark.read.schema(_RUN).parquet(*(f"{self.folder}/{name}" for _, name in merged))))]
            old += [name for _, name in merged]
        if not self.kept:
            self.texts.append(docs)
            self.dropped(*old)
            return
        docs.select("rid", "doc_id", "text").write.mode("append").option("compression", "zstd").parquet(f"{self.folder}/texts")
        self.texts = [self.spark.read.parquet(f"{self.folder}/texts")]
        self.version += 1
        rows = [(self.version, no, level, name, self.window, self.k, self.fan, self.max_run, self.buckets) for no, (level, name) in enumerate(self.runs)]
        schema = "version long, no long, level long, name string, window int, k int, fan int, max_run int, buckets int"
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/list")
        self.dropped(*old)  # only now: until the new list is there, the old one holds


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def find_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50, k: int = 10, batches: int = 3, fan: int = 2) -> DataFrame:
    """docs with ``starts`` (array of int, null if none): the first words of repeated windows.

    docs go through the index in ``batches`` ascending ranges of key; with the defaults, the last batch meets the
    compacted run of the two before it.
    """
    index = SubstringIndex(docs.sparkSession, None, window, k, fan)
    own = docs.select(whole_numbers(docs, key).alias("doc_id"), F.col(text).cast("string").alias("text"), row_id(key, text).alias("rid"))
    known = own.where("doc_id is not null")
    cuts = known.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)])).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    parts = []
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        part = known
        if lo is not None:
            part = part.where(F.col("doc_id") > lo)
        if hi is not None:
            part = part.where(F.col("doc_id") <= hi)
        parts.append(index.repeats(part, last=hi is None))
    index.close()
    found = _union(parts)
    # Rows without repeats needn't meet the result: the bitmap leaves them where they are.
    own = marked(own, "rid", found.select("rid"), "hit")
    none = F.lit(None).cast(found.schema["starts"].dataType).alias("starts")
    return own.where("hit").drop("hit").join(found, "rid", "left").unionByName(own.where("not hit").drop("hit").withColumn("starts", none))


def kept_words(found: DataFrame, window: int = 50, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and, if asked, the kept text) from the rows of find_repeats."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches):
            words = Words(slab)
            steps = np.zeros(len(words.start) + 1, np.int64)
            starts = slab.batch["starts"]
            if len(flat := starts.flatten()):
                row = np.repeat(np.arange(len(slab)), starts.value_lengths().fill_null(0).to_numpy())
                at = flat.to_numpy() + words.row_at[row]
                np.add.at(steps, at, 1)
                np.add.at(steps, at + window, -1)
            gone = np.cumsum(steps)[:-1] > 0
            kept = [kept_text(slab, words, gone, i) for i in range(len(slab))]
            cols = [slab.batch["doc_id"], pa.array(words.count, pa.int64()), pa.array(row_sums(gone, words.row_at), pa.int64()), pa.array([sha256(x) for x in kept])]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array([x.decode() for x in kept], pa.string())] * with_text, names=names + ["kept"] * with_text)

    return found.select("doc_id", "text", "starts").mapInArrow(run, schema)


def kept_text(slab: Slab, words: Words, gone: np.ndarray, i: int) -> bytes:
    """The kept words of row i, joined by one space."""
    a, b = words.row_at[i], words.row_at[i + 1]
    left = ~gone[a:b]
    if not left.any():
        return b""
    start, end = words.start[a:b][left], words.end[a:b][left]
    take = np.zeros(slab.offs[i + 1] - slab.offs[i] + 1, np.int8)
    at = slab.offs[i]
    np.add.at(take, start - at, 1)
    np.add.at(take, end - at, -1)
    inside = np.cumsum(take)[:-1] > 0
    inside[end[:-1] - at] = True  # one byte of white space after each word but the last
    out = slab.data[at : slab.offs[i + 1]][inside]
    sizes = np.cumsum(end - start + 1)[:-1] - 1
    out[sizes] = 0x20
    return out.tobytes()
