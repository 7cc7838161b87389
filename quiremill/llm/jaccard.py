"""N-gram Jaccard join: documents whose shingle sets are similar, by prefix trees over ordered sets.

1. Every text becomes its set of word n-gram hashes, in one global order: rare ones by hash, then
   the ``HEAVY`` that most often recur (so common passages never lead a set). Documents with equal
   sets form a class; its least id stands for it.
2. Two sets can only reach the similarity if they share one of their first n - ceil(t * n) + 1
   members. Classes that share such a key join the group of the least class with that key.
3. Each group is split into blocks of about ``BLOCK`` classes or ``BLOCK_SHINGLES`` shingles, whichever is fewer. With a set goes a parity bitmap of
   about its size: the bits in which two bitmaps differ are at most the members in which the sets
   differ, so what that bound rules out needs no text. What may still be similar forms subgroups;
   subgroups with the same members are kept once.
4. A task gets the texts of a subgroup and puts their ordered sets into a trie and sends each set
   down it: sets with a common beginning share its overlap count, and a subtree is left when the
   members that remain in it and in the set cannot reach the required overlap. Pairs already
   connected are skipped, so a subgroup emits at most one link for each of its classes.
5. Keys of groups with more than one block whose classes are still in several components are met
   again by pairs of blocks. After that every pair of similar texts is connected.

Nothing is capped: heavy members only change the order, and any order is valid.

Defined cases: null, empty or white-space texts have an empty set and link with nothing; a text
with fewer words than n has its whole sequence as its one shingle; rows that share an id are one
document, with the links of any of its texts; rows with a null id get a null component; ids are whole
numbers, others are an error before any job runs; extra columns are not read; an empty table gives an
empty result. A text is taken whole and needs about 100 bytes of memory for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quiremill.llm.graph import components
from quiremill.llm.io import maybe_in, saved, whole_numbers, without
from quiremill.llm.kernel import Slab, Words, mix, row_sums, signed, slabs

#: Most recurring shingles that are put last in the order; the bound on what is broadcast for them.
HEAVY = 1 << 16
BLOCK = 512
#: Shingles of a block's sets, some 30 MB of text: a task holds the texts of one block.
BLOCK_SHINGLES = 1 << 22
_TOP = np.uint64(1) << np.uint64(63)


def shingles(slab: Slab, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every n-word run, or of the whole sequence of a row with fewer words; hashes have 63 bits."""
    words = Words(slab, lower=True)
    at, h = words.grams(n)
    rows, hashes = [words.row[at]], [h]
    for m in np.unique(words.count[(words.count > 0) & (words.count < n)]):
        short = np.flatnonzero(words.count == m)
        at, h = words.grams(int(m))
        mine = np.isin(at, words.row_at[short])
        rows.append(words.row[at[mine]])
        hashes.append(mix(h[mine] + np.uint64(m)))
    return np.concatenate(rows), np.concatenate(hashes) >> np.uint64(1)


def ordered_sets(slab: Slab, n: int, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(members, borders): the distinct members of each row in the global order. heavy: sorted hashes, as one column with their ranks."""
    row, h = shingles(slab, n)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy[:, 0], h), len(heavy) - 1)
        h = np.where(heavy[at, 0] == h, _TOP | heavy[at, 1], h)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.searchsorted(row[new], np.arange(len(slab) + 1))


def find_heavy(docs: DataFrame, n: int) -> np.ndarray:
    """Up to HEAVY shingles that recur most, sorted by hash, with the rank as second column (rarest first).

    A task adds up those that recur within a slab of 512 KB, so a passage in one of a thousand texts is met in
    some slabs of a large corpus; only the order depends on that, no result. Executors pick the most recurring
    ones: as Arrow the driver gets 16 bytes for each (a collected limit sends it those of every task, as rows).
    """

    def most(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.argsort(-c, kind="stable")[:HEAVY]
        return h[own], c[own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for slab in slabs(batches, size=1 << 19):
            new, count = np.unique(shingles(slab, n)[1], return_counts=True)
            often = count >= max(2, len(slab) // 200)
            h, at = np.unique(np.concatenate([h, new[often]]), return_inverse=True)
            c = np.bincount(at, np.concatenate([c, count[often]]), len(h)).astype(np.int64)
            if len(h) > 4 * HEAVY:
                h, c = most(h, c)
        h, c = most(h, c)
        yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(c)], names=["h", "c"])

    top = docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(HEAVY).toArrow()
    h, c = (top[name].to_numpy() for name in ("h", "c"))
    h = h[np.lexsort((h, -c))].astype(np.uint64)
    ranked = np.stack([h, np.arange(len(h), 0, -1, dtype=np.uint64)], axis=1)
    return ranked[np.argsort(ranked[:, 0])]


def parity_bitmaps(members: np.ndarray, borders: np.ndarray) -> pa.Array:
    """For each row a bitmap of its members modulo a power of two that is its size or more; a bit is the parity of its members."""
    sizes = np.diff(borders)
    width = np.int64(1) << np.ceil(np.log2(np.maximum(sizes, 256))).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(width)])
    row = np.repeat(np.arange(len(sizes)), sizes)
    bit = at[row] + (members & (width[row] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(bit, minlength=at[-1]) & 1).astype(np.uint8), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((at // 8).astype(np.int32).tobytes()), pa.py_buffer(packed.tobytes())])


def maybe_similar(sizes: np.ndarray, bitmaps: list[np.ndarray], num: int, den: int, side: np.ndarray | None) -> list[list[int]]:
    """Subgroups of two or more sets whose sizes and bitmaps don't rule out that they are similar (of different sides, if given)."""
    order = np.argsort(sizes, kind="stable")
    sizes, bitmaps = sizes[order], [bitmaps[i] for i in order]
    side = side[order] if side is not None else None
    widths = np.array([len(b) for b in bitmaps])
    rows = {w: (np.searchsorted(widths, w), np.stack([bitmaps[i] for i in np.flatnonzero(widths == w)])) for w in np.unique(widths)}
    group = np.arange(len(sizes))
    for i in range(1, len(sizes)):
        low, mine = np.searchsorted(sizes[:i], -(-num * sizes[i] // den)), bitmaps[i]
        while low < i:
            w = len(mine)
            first, matrix = rows.get(w, (i, None))
            lo, hi = max(low, first), min(i, first + len(matrix)) if matrix is not None else i
            if matrix is not None and lo < hi:
                total = sizes[i] + sizes[lo:hi]
                most = total - 2 * -(-num * total // (num + den))
                near = np.bitwise_count(matrix[lo - first : hi - first] ^ mine).sum(1) <= most
                if side is not None:
                    near &= side[lo:hi] != side[i]
                for g in np.unique(group[lo:hi][near]):
                    group[: i + 1][group[: i + 1] == g] = group[i]
            if w == 4:  # the narrowest bitmap
                break
            mine = mine[: w // 2] ^ mine[w // 2 :]
            if not len(rows.get(w // 2, ((), ()))[1]) and w // 2 < widths[low]:
                break
    labels, where, count = np.unique(group, return_inverse=True, return_counts=True)
    return [order[where == k].tolist() for k in np.flatnonzero(count > 1)]


class Trie:
    """Ordered sets in a compressed trie: a node is a stretch of members that all sets below it share."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.vocabulary, ids = np.unique(np.concatenate(self.sets), return_inverse=True)
        self.ids = np.split(ids, np.cumsum([len(s) for s in self.sets])[:-1])
        self.sizes = np.array([len(s) for s in self.sets])

    def similar(self, x: int, num: int, den: int, skip: Callable[[int], bool], before: int) -> Iterator[int]:
        """Sets before position ``before`` whose Jaccard similarity with set x is num / den or more."""
        mine = self.ids[x]
        size = len(mine)
        mark = np.zeros(len(self.vocabulary), np.int32)
        mark[mine] = 1
        low, high = -(-num * size // den), den * size // num
        stack = [(0, before, 0, 0)]
        while stack:
            lo, hi, depth, overlap = stack.pop()
            if hi - lo == 1 and skip(lo):
                continue
            small, large = self.sizes[lo:hi].min(), self.sizes[lo:hi].max()
            if large < low or small > high:
                continue
            first, last = self.ids[lo], self.ids[hi - 1]
            shared = min(len(first), len(last))
            if hi - lo > 1:
                differs = np.flatnonzero(first[depth:shared] != last[depth:shared])
                to = depth + int(differs[0]) if len(differs) else shared
            else:
                to = shared
            overlap += int(mark[first[depth:to]].sum())
            left = size - int(np.searchsorted(mine, first[to - 1], side="right")) if to else size
            needed = -(-num * (size + max(small, low)) // (num + den))
            if overlap + min(left, large - to) < needed:
                continue
            at = lo
            while at < hi and len(self.ids[at]) == to:  # sets that end here
                if not skip(at) and den * overlap >= num * (size + to - overlap):
                    yield at
                at += 1
            while at < hi:
                token, a, b = self.ids[at][to], at + 1, hi
                while a < b:  # the first set with another member here
                    m = (a + b) // 2
                    if self.ids[m][to] == token:
                        a = m + 1
                    else:
                        b = m
                stack.append((at, a, to, overlap))
                at = a


def link_block(ids: np.ndarray, sets: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (id, least id) that connect what is similar in a block; with side, only pairs of different sides are compared."""
    keep = [i for i in range(len(ids)) if len(sets[i])]
    if len(keep) < 2:
        return []
    trie = Trie([sets[i] for i in keep])
    own = ids[keep][trie.order]
    sides = side[keep][trie.order] if side is not None else np.arange(len(own))
    root = list(range(len(own)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for x in range(1, len(own)):
        for y in trie.similar(x, num, den, lambda i: find(i) == find(x) or sides[i] == sides[x], x):  # noqa: B023
            root[find(y)] = find(x)
    least: dict[int, int] = {}
    for i in range(len(own)):
        least[find(i)] = min(least.get(find(i), own[i]), own[i])
    return [(int(own[i]), int(least[find(i)])) for i in range(len(own)) if own[i] != least[find(i)]]


def _linker(n: int, num: int, den: int, heavy):  # noqa: ANN001, ANN202
    def link(rows: pa.Table) -> pa.Table:
        ids, sides, sets = [], [], []
        for slab in slabs(rows.combine_chunks().to_batches()):
            members, borders = ordered_sets(slab, n, heavy.value)
            sets += [members[borders[i] : borders[i + 1]] for i in range(len(slab))]
            ids.append(slab.batch["node"].to_numpy())
            sides.append(slab.batch["side"].to_numpy())
        side = np.concatenate(sides)
        found = link_block(np.concatenate(ids), sets, num, den, side if side.max() > 0 else None)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return link


def _subgroups(num: int, den: int):  # noqa: ANN202
    def split(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        side = rows["side"].to_numpy()
        bitmaps = [np.frombuffer(b.as_buffer(), np.uint64) for b in rows["bits"]]
        found = maybe_similar(rows["n_shingles"].to_numpy(), bitmaps, num, den, side if side.max() > 0 else None)
        node, (g, i, j) = rows["node"].to_numpy(), (rows[c][0].as_py() for c in "gij")
        at = np.concatenate([np.asarray(x, np.int64) for x in found]) if found else np.zeros(0, np.int64)
        part = np.repeat([int(node[x].min()) for x in found], [len(x) for x in found]) if found else at
        return pa.table({"g": pa.array([g] * len(at), pa.int64()), "i": pa.array([i] * len(at), pa.int32()), "j": pa.array([j] * len(at), pa.int32()), "part": pa.array(part, pa.int64()), "node": pa.array(node[at]), "side": pa.array(side[at], pa.int32())})

    return split


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of df: documents link at a Jaccard similarity of num / den or more."""
    docs = df.select(whole_numbers(df, key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    heavy = df.sparkSession.sparkContext.broadcast(find_heavy(docs, n))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches):
            members, borders = ordered_sets(slab, n, heavy.value)
            size = np.diff(borders)
            first = np.where(size > 0, size - -(-num * size // den) + 1, 0)
            at = np.repeat(borders[:-1] - np.concatenate([[0], np.cumsum(first)[:-1]]), first) + np.arange(first.sum())
            keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(first)]), pa.int32()), pa.array(signed(members[at])))
            sums = [row_sums(signed(mix(members * np.uint64(odd))), borders) for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
            cols = [slab.batch["doc_id"], pa.array(size, pa.int64()), *map(pa.array, sums), keys, parity_bitmaps(members, borders)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "s1", "s2", "keys", "bits"])

    rows = saved(docs.mapInArrow(summarise, "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>, bits binary"))
    real = rows.where("n_shingles > 0 and doc_id is not null")
    classes = saved(real.groupBy("s1", "s2").agg(F.min("doc_id").alias("node")))
    nodes = classes.select("node").distinct()
    keyed = real.select("doc_id", "n_shingles", "keys").join(nodes, F.col("doc_id") == F.col("node"), "left_semi").select(F.col("doc_id").alias("node"), "n_shingles", F.explode("keys").alias("k"))
    # What is joined back to the rows that it was counted from is written first: a hot key's rows can be split then.
    groups = saved(keyed.groupBy("k").agg(F.min("node").alias("g"), F.max("node").alias("hi")).where("g < hi").select("k", "g"))
    keyed = saved(keyed.join(groups, "k"))
    member = saved(keyed.groupBy("g", "node").agg(F.max("n_shingles").alias("n_shingles")))
    sizes = saved(member.groupBy("g").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("shingles")))
    blocks = F.ceil(F.greatest(F.col("size") / F.lit(BLOCK - 1), F.col("shingles") / F.lit(BLOCK_SHINGLES))).cast("int")
    placed = saved(member.join(sizes, "g").select("g", "node", blocks.alias("n_blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block")))
    sets = real.select(F.col("doc_id").alias("node"), "n_shingles", "bits")
    split, link = _subgroups(num, den), _linker(n, num, den, heavy)

    def linked(asked: DataFrame) -> DataFrame:
        """Links among what meets in a group (g, i, j), by bitmaps and then by tries."""
        parts = saved(asked.join(sets, "node").groupBy("g", "i", "j").applyInArrow(split, "g long, i int, j int, part long, node long, side int").distinct())
        names = ["g", "i", "j", "part"]
        same = parts.groupBy(*names).agg(F.expr("sum(cast(xxhash64(node, side) as decimal(38, 0)))").alias("sum"), F.count("*").alias("n"))
        once = same.groupBy("sum", "n").agg(F.min(F.struct(*names)).alias("p")).select("p.*")
        kept = saved(parts.join(once, names, "left_semi"))
        texts = kept.join(maybe_in(docs.withColumnRenamed("doc_id", "node").where("text is not null"), "node", kept.select("node")), "node")
        return saved(texts.groupBy(*names).applyInArrow(link, "a long, b long"))

    asked = placed.select("g", F.col("block").alias("i"), F.lit(0).alias("j"), "node", F.lit(0).alias("side"))
    spread = placed.where("node = g and n_blocks > 1").select("g", F.explode(F.expr("filter(sequence(0, n_blocks - 1), x -> x <> block)")).alias("i"), F.lit(0).alias("j"), "node", F.lit(0).alias("side"))
    same = real.join(classes, ["s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    edges = linked(asked.unionByName(spread)).unionByName(same).where("a <> b")
    found = saved(components(edges))
    big = placed.where("n_blocks > 1")
    named = keyed.join(big, ["g", "node"]).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = saved(named)
    torn = named.groupBy("g", "k").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("g", "k")
    again = saved(named.join(torn, ["g", "k"], "left_semi").select("g", "node", "block", "n_blocks").distinct())
    if not again.isEmpty():
        pairs = F.expr("filter(transform(sequence(0, n_blocks - 1), x -> struct(least(x, block) as i, greatest(x, block) as j, cast(x < block as int) as side)), p -> p.i < p.j)")
        asked = again.select("g", "node", F.explode(pairs).alias("p")).select("g", "p.i", "p.j", "node", "p.side")
        # What is connected already comes as stars: the classes aren't joined a second time.
        found = saved(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(linked(asked))))
    return rows.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """df without the rows whose id isn't the least of its component: one document of each group stays, with all columns of df (rows with a null id stay)."""
    gone = jaccard_components(df, key, text, n, num, den).where("component_id <> doc_id").select("doc_id").distinct()
    return without(df, key, saved(gone))
