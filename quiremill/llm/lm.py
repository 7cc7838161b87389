"""Language-model scoring by logistic context mixing.

A text is its tokens: the words, A-Z lower-cased, then one end. All is learned from every training text:

1. Bits. A token is written by a prefix code: each word of the vocabulary has its own code, one code
   is the escape to all other words, one is the end. Every bit is predicted in five contexts: none,
   the last word, the last of the ``FREQUENT`` most frequent words, the last two words, and the last
   three (words outside the vocabulary too). The last four have hashed tables of how often the bit was 1
   and 0. The predictions are mixed in the logistic domain by weights that a gate chooses (by how
   much evidence the contexts of one, two and three words have), and each text refines the weights
   for itself: after 32, 64, 128, ... tokens, then every ``STEP``, they move by what was mispredicted so
   far. Each step only uses what precedes it.
2. Words outside the vocabulary. One bit says whether the word is new (never seen in training, one
   event, as in the base score), predicted by how many of those words were seen only once; a word
   that isn't new has its share of the counts.
3. Gate weights: Newton steps of logistic regression over all training texts, where a bit's own count is
   taken from its slot first. The workers make the sums of each step.

Counts of all words are an exact Spark table that grows with the corpus, joined to the texts. What every
worker holds is bounded: ``VOCABULARY`` words, and tables of up to 2**``MOST_BITS`` slots, sized by the
number of training tokens; contexts that meet in a slot share its counts, and the gate weighs them by that.

``base_score`` is the unigram score with add-one smoothing over exact counts of all tokens.

Defined cases: null and empty text are the end token alone; repeated rows are scored alike; a null
id is never held out of training unless the caller says so; without training texts every bit is a
toss-up and every word is new; extra columns are not read; an empty table gives an empty result. A
text is taken whole: one text's arrays need about 150 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from quiremill.llm.io import saved
from quiremill.llm.kernel import Slab, Words, mix, row_sums, signed, slabs

VOCABULARY = 1 << 16
#: The most slots of a hashed table, as a power of two.
MOST_BITS = 21
FREQUENT = 32
TURNS = 1
SLICES, SALTS = 64, 8
#: Bytes of texts taken together: each slab costs a pass over the counters.
SLAB = 1 << 20
#: Tokens whose bits are expanded at once: few enough that their arrays stay in a core's cache.
BLOCK = 1 << 13
#: Bits that a task counts in counters of 32 bits.
FULL = (1 << 32) - 1
FIRST, STEP = 32, 512
CONTEXTS = 4
INPUTS = CONTEXTS + 2  # with no context and a constant
#: Levels of evidence of the contexts of one, two and three words.
GATES = 64
END = np.uint64(0x0E4D)
_U32, _U64 = np.uint32, np.uint64
#: By which a prediction is multiplied for a bit of 0 or 1, so that it is positive if wrong.
_SIDE = np.array([1, -1], np.float32)
_HASHED = (_U32(0x9E3779B1), _U32(0xC2B2AE35), _U32(0x85EBCA6B), _U32(0x27D4EB2F))
_BACK = (_U64(1), _U64(0x9E3779B97F4A7C15), _U64(0xC2B2AE3D27D4EB4F))


class Code:
    """Canonical Huffman code by counts. The bits of symbol s are at start[s] .. start[s] + length[s]; a node is the bits before, led by a 1."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(counts, kind="stable")
        leaves, n = np.asarray(counts, np.int64)[order].tolist(), len(counts)
        merged, parent = [], [0] * (2 * n - 1)
        i = j = 0
        for k in range(n - 1):
            total = 0
            for _ in range(2):
                if j >= len(merged) or i < n and leaves[i] <= merged[j]:
                    total, parent[i], i = total + leaves[i], n + k, i + 1
                else:
                    total, parent[n + j], j = total + merged[j], n + k, j + 1
            merged.append(total)
        depth = [0] * (2 * n - 1)
        for x in range(2 * n - 3, -1, -1):
            depth[x] = depth[parent[x]] + 1
        self.length = np.zeros(n, np.int64)
        self.length[order] = depth[:n]
        self.start = np.cumsum(self.length) - self.length
        value, at, before = np.zeros(n, _U64), 0, 0
        for size in np.unique(self.length):
            at <<= int(size) - before
            same = np.flatnonzero(self.length == size)
            value[same] = np.arange(at, at + len(same), dtype=_U64)
            at, before = at + len(same), int(size)
        symbol = np.repeat(np.arange(n), self.length)
        place = np.arange(len(symbol)) - self.start[symbol]
        left = (self.length[symbol] - place).astype(_U64)
        node = value[symbol] >> left | _U64(1) << place.astype(_U64)
        self.bit = (value[symbol] >> left - _U64(1) & _U64(1)).astype(np.uint8)
        self.key = (mix(node) >> _U64(32)).astype(_U32)
        self._node, self._weight = node, np.asarray(counts, np.float64)[symbol]

    def seen(self) -> np.ndarray:
        """How often each bit was 0 and 1 in training, in no context. Call it once: what it needs is dropped."""
        nodes, which = np.unique(self._node, return_inverse=True)
        out = np.stack([np.bincount(which, self._weight * (self.bit == b), len(nodes))[which] for b in (0, 1)]).astype(np.float32)
        del self._node, self._weight
        return out


class Tokens:
    """Tokens of a slab: hash, row, place in the row, symbol (the escape for words outside the vocabulary), the words before."""

    def __init__(self, slab: Slab, known: np.ndarray, frequent: np.ndarray):
        words = Words(slab, lower=True)
        n = len(words.hash) + len(slab)
        ends = words.row_at[1:] + np.arange(len(slab))
        own = np.ones(n, bool)
        own[ends] = False
        self.hash = np.full(n, END)
        self.hash[own] = words.hash
        self.borders = np.concatenate([[0], ends + 1])
        self.row = np.repeat(np.arange(len(slab)), np.diff(self.borders))
        self.place = np.arange(n) - self.borders[self.row]
        at = np.minimum(np.searchsorted(known, self.hash), max(len(known) - 1, 0))
        self.symbol = np.where(known[at] == self.hash, at, len(known)) if len(known) else np.zeros(n, np.int64)
        self.symbol[~own] = len(known) + 1
        first, all_at = self.borders[self.row], np.arange(n)
        last = np.maximum.accumulate(np.where(frequent[self.symbol], all_at, -1))
        last = np.concatenate([[-1], last[:-1]])
        # The hash of the word one, two and three places back, 0 before the text.
        back = [np.where(self.place >= k, self.hash[np.maximum(all_at - k, 0)], _U64(0)) for k in (1, 2, 3)]
        two = back[0] * _BACK[0] + back[1] * _BACK[1]
        often = np.where(last >= first, self.hash[np.maximum(last, 0)], _U64(0))
        contexts = (back[0], often, mix(two), mix(two + back[2] * _BACK[2]))
        self.before = [(h >> _U64(32)).astype(_U32) * odd for h, odd in zip(contexts, _HASHED, strict=True)]


def _bits(t: Tokens, sel: np.ndarray, code: Code, bits: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(place in the code, number in sel, slots of the hashed contexts) of every bit of the selected tokens, and where each token's begin."""
    length = code.length[t.symbol[sel]]
    begin = np.cumsum(length) - length
    off = np.repeat(code.start[t.symbol[sel]] - begin, length) + np.arange(length.sum())
    which = np.repeat(np.arange(len(sel)), length)
    key = code.key[off]
    slots = []
    for b in t.before:
        h = b[sel][which]
        h ^= key
        h *= _U32(0x2C1B3C6D)
        h >>= _U32(32 - bits)
        slots.append(h.astype(np.intp))
    return off, which, slots, begin


def _blocks(sel: np.ndarray) -> Iterator[np.ndarray]:
    for i in range(0, len(sel), BLOCK):
        yield sel[i : i + BLOCK]


def stretched(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A counter's prediction in the logistic domain, and its evidence from 0 to 3."""
    total = zeros + ones
    return np.log((ones + 0.4) / (zeros + 0.4)).astype(np.float32), (total > 0).astype(np.uint8) + (total > 4) + (total > 40)


def packed(stretch: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    """Predictions with their evidence in the two lowest bits, so that both are read at once."""
    return (stretch.view(_U32) & ~_U32(3) | evidence).view(np.float32)


class Model:
    """What predicts the bits: vocabulary, code, tables and gate weights."""

    def __init__(self, known: np.ndarray, frequent: np.ndarray, code: Code, seen: np.ndarray, counts: np.ndarray):
        self.known, self.frequent, self.code, self.seen, self.counts = known, frequent, code, seen, counts
        self.bits = int(counts.shape[1]).bit_length() - 1
        self.weights = np.tile([0.3] * (INPUTS - 1) + [0.0], (GATES, 1))

    def __setstate__(self, state: dict) -> None:
        """Tables are copied, so that numpy's own memory (in large pages) holds them, not a pickle's."""
        self.__dict__ = state
        if "tables" in state:
            self.tables = [t.copy() for t in self.tables]

    def ready(self, trained: bool = False) -> Model:
        """The same with tables of predictions in place of counts. If texts are ``trained`` on, each bit's own count is taken away: tables have one entry for each slot and bit."""
        made = Model(self.known, self.frequent, self.code, self.seen, self.counts)
        made.weights, made.trained = self.weights, trained
        bit = self.code.bit
        made.alone = stretched(np.maximum(self.seen[0] - trained * (bit == 0), 0), np.maximum(self.seen[1] - trained * bit, 0))[0]
        made.tables = []
        for zeros, ones in (c.T for c in self.counts):
            both = [(np.maximum(zeros - 1, 0), ones), (zeros, np.maximum(ones - 1, 0))] if trained else [(zeros, ones)]
            made.tables.append(np.stack([packed(*stretched(*x)) for x in both], axis=1).ravel())
        made.seen = made.counts = None
        return made

    def inputs(self, t: Tokens, sel: np.ndarray) -> tuple:
        """(bit, gate, predictions, number in sel) of every bit of the selected tokens, and where each token's begin."""
        off, which, slots, begin = _bits(t, sel, self.code, self.bits)
        bit = self.code.bit[off]
        if self.trained:
            for s in slots:
                s += s
                s += bit
        x = [table.take(s, mode="clip") for table, s in zip(self.tables, slots, strict=True)]
        one, two, three = (x[k].view(_U32) & _U32(3) for k in (0, 2, 3))
        return bit, (three << _U32(4) | two << _U32(2) | one).astype(np.intp), (self.alone[off], *x), which, begin

    def sums(self, t: Tokens) -> np.ndarray:
        """For each gate, gradient (first column) and curvature of the loss of all tokens in the weights."""
        out, weights = np.zeros((GATES, INPUTS, INPUTS + 1)), self.weights.astype(np.float32)
        for sel in _blocks(np.arange(len(t.hash))):
            bit, gate, x, _, _ = self.inputs(t, sel)
            gate = gate.astype(np.uint8)
            order = np.argsort(gate, kind="stable")
            borders = np.concatenate([[0], np.cumsum(np.bincount(gate, minlength=GATES))])
            by_gate, bit = np.ones((INPUTS, len(bit)), np.float32), bit[order]
            for k, a in enumerate(x):
                a.take(order, mode="clip", out=by_gate[k])
            for g in np.flatnonzero(np.diff(borders)):
                own = by_gate[:, borders[g] : borders[g + 1]]
                p = 1 / (1 + np.exp(-(weights[g] @ own)))
                out[g, :, 0] += own @ (p - bit[borders[g] : borders[g + 1]])
                out[g, :, 1:] += own * (p * (1 - p)) @ own.T
        return out

    def log10s(self, t: Tokens, rows: int) -> np.ndarray:
        """log10 probability of each token's symbol; weights are refined within each row, block after block."""
        weights = self.weights.T.astype(np.float32, order="C")
        own = np.zeros((INPUTS, rows), np.float32)
        slope, curve = np.zeros((INPUTS, rows)), np.zeros((INPUTS, rows))
        out = np.zeros(len(t.hash))
        length = np.diff(t.borders)
        longest = int(length.max(initial=0))
        begin, end = 0, FIRST
        while begin < longest:
            now = np.flatnonzero((t.place >= begin) & (t.place < end))
            goes_on = (length > end)[t.row[now]]
            # Only rows that go on learn from these tokens.
            for learns, sel in [(True, b) for b in _blocks(now[goes_on])] + [(False, b) for b in _blocks(now[~goes_on])]:
                bit, gate, x, which, at = self.inputs(t, sel)
                row = t.row[sel]
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                w = weights
                if begin:  # weights by row and gate
                    w = (weights[:, None, :] + own[:, row[first], None]).reshape(INPUTS, -1)
                    gate += np.repeat(np.arange(len(first)) * GATES, np.diff(np.append(first, len(row))))[which]
                z = w[-1].take(gate, mode="clip")
                for k, a in enumerate(x):
                    b = w[k].take(gate, mode="clip")
                    b *= a
                    z += b
                side = _SIDE[bit]
                z *= side
                e = np.exp(-np.abs(z))
                q = e + 1
                out[sel] = -np.log(np.multiply.reduceat(q, at)) - np.add.reduceat(np.maximum(z, 0), at)
                if learns:
                    e[z > 0] = 1
                    wrong = np.divide(e, q, out=e)
                    bend = wrong * (1 - wrong)
                    wrong *= side
                    for k in range(INPUTS):
                        g, h = (wrong * x[k], bend * x[k]) if k < INPUTS - 1 else (wrong, bend)
                        if k < INPUTS - 1:
                            h *= x[k]
                        slope[k][row[first]] += np.add.reduceat(g, at[first])
                        curve[k][row[first]] += np.add.reduceat(h, at[first])
            own = np.clip(own - slope / (100 + INPUTS * curve), -1, 1).astype(np.float32)
            slope[:] = 0
            begin, end = end, end + min(end, STEP)
        return out / math.log(10)


def word_counts(train: DataFrame) -> DataFrame:
    """(h, c): how often each word's hash occurs in the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> pa.RecordBatch:
            h, c = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            order = np.argsort(h)
            h, c = h[order], c[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(signed(h[first])), pa.array(np.add.reduceat(c, first))], names=["h", "c"])

        for slab in slabs(batches, size=SLAB):
            held.append(np.unique(Words(slab, lower=True).hash, return_counts=True))
            held[-1:] = [] if not len(held[-1][0]) else held[-1:]
            if sum(len(x[0]) for x in held) > 1 << 20:
                yield merged()
        if held:
            yield merged()

    return train.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def bit_counts(train: DataFrame, known: np.ndarray, frequent: np.ndarray, code: Code, bits: int) -> np.ndarray:
    """Counts of zeros and ones in every slot of all tables: summed in each task, then slice by slice on the workers."""
    shared = train.sparkSession.sparkContext.broadcast((known, frequent, code))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, frequent, code = shared.value
        # Counters of 32 bits, half the memory to hit at random; before one could overflow they go to those of 64 bits.
        sums, whole, left, any_rows = np.zeros((CONTEXTS, 2 << bits), _U32), np.int64(0), FULL, False
        for slab in slabs(batches, size=SLAB):
            t, any_rows = Tokens(slab, own, frequent), True
            for sel in _blocks(np.arange(len(t.hash))):
                off, _, slots, _ = _bits(t, sel, code, bits)
                bit, ones = code.bit[off], np.ones(len(off), _U32)  # an array of ones of the table's type: numpy's fast loop
                if (left := left - len(off)) < 0:
                    whole, left = whole + sums, FULL - len(off)
                    sums[:] = 0
                for k, s in enumerate(slots):
                    s += s
                    s += bit
                    np.add.at(sums[k], s, ones)
        if any_rows:
            parts = (whole + sums).astype(np.int64).reshape(SLICES, -1)
            salt = TaskContext.get().partitionId() % SALTS
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([salt] * SLICES, pa.int32()), pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True) for x in parts], pa.binary())], names=["slice", "salt", "sums"])

    size = (2 * CONTEXTS << bits) // SLICES

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b["slice"].to_pylist(), b["sums"], strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(pa.decompress(x.as_buffer(), 8 * size, "zstd"), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True) for x in held.values()], pa.binary())], names=["slice", "sums"])

    parts = train.select("text").mapInArrow(count, "slice int, salt int, sums binary").repartition("slice", "salt").mapInArrow(add, "slice int, sums binary")
    out = np.zeros((SLICES, size), np.int64)
    for r in parts.toLocalIterator():
        out[r["slice"]] += np.frombuffer(pa.decompress(r["sums"], 8 * size, "zstd"), np.int64)
    shared.destroy()
    return out.reshape(CONTEXTS, 1 << bits, 2).astype(np.float32)


def gate_weights(train: DataFrame, model: Model) -> np.ndarray:
    """Newton steps over all training texts; the workers make the sums. model: made ready for texts that it is trained on."""
    size, weights = INPUTS * (INPUTS + 1), model.weights
    tables = train.sparkSession.sparkContext.broadcast(model)
    for _ in range(TURNS):

        def run(batches: Iterator[pa.RecordBatch], now: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            m, out = tables.value, np.zeros((GATES, INPUTS, INPUTS + 1))
            m.weights = now
            for slab in slabs(batches, size=SLAB):
                out += m.sums(Tokens(slab, m.known, m.frequent))
            yield pa.RecordBatch.from_arrays([pa.array(range(GATES), pa.int32()), pa.array(out.reshape(GATES, size).tolist(), pa.list_(pa.float64()))], names=["gate", "s"])

        parts = train.select("text").mapInArrow(run, "gate int, s array<double>").select("gate", F.posexplode("s").alias("i", "s"))
        sums = np.zeros((GATES, size))
        for r in parts.groupBy("gate", "i").agg(F.sum("s").alias("s")).collect():
            sums[r.gate, r.i] = r.s
        sums = sums.reshape(GATES, INPUTS, INPUTS + 1)
        weights = np.clip(weights - np.linalg.solve(sums[:, :, 1:] + np.eye(INPUTS), sums[:, :, :1])[:, :, 0], -2, 2)
    tables.destroy()
    return weights


def scores(df: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of df: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Texts that are not held out are learned from. bits_per_byte is the score in bits over the text's
    bytes, null for an empty text.
    """
    docs = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.xxhash64(F.lit(7), F.col(key), F.col(text)).alias("rid"))
    train = docs.where("not held_out")
    counts = saved(word_counts(train))
    n_docs = train.count()
    words, distinct, once = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1)).first()
    total, kinds = words + n_docs, distinct + (n_docs > 0)
    top = counts.where("c > 1").orderBy(F.desc("c"), "h").limit(VOCABULARY).toPandas()
    known = top["h"].to_numpy(np.int64).view(_U64)
    order = np.argsort(known)
    known, often = known[order], top["c"].to_numpy(np.int64)[order]
    rare_words, rare_tokens = distinct - len(known), words - int(often.sum())
    frequent = np.append(often >= np.sort(often)[-FREQUENT:][0] if len(often) else np.zeros(0, bool), [False, False])

    code = Code(np.append(often, [max(1, rare_tokens), max(1, n_docs)]))
    seen, bits = code.seen(), min(MOST_BITS, max(12, total.bit_length()))
    model = Model(known, frequent, code, seen, bit_counts(train, known, frequent, code, bits))
    model.weights = gate_weights(train, model.ready(trained=True))
    shared = df.sparkSession.sparkContext.broadcast((model.ready(), np.log10(np.append(often, [0, n_docs]) + 1.0)))
    by_end = int(n_docs > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, logs = shared.value
        for slab in slabs(batches, size=SLAB):
            t = Tokens(slab, model.known, model.frequent)
            n = np.diff(t.borders)
            rare = t.symbol == len(model.known)
            log10s = model.log10s(t, len(slab))
            logged, score = (np.add.reduceat(x, t.borders[:-1]) for x in (logs[t.symbol], log10s))
            unknown = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(row_sums(rare, t.borders))]), pa.int32()), pa.array(signed(t.hash[rare])))
            cols = [slab.batch["rid"], slab.batch["doc_id"], slab.batch["held_out"], pa.array(n), pa.array(n - 1 + by_end - row_sums(rare, t.borders)), pa.array(logged), pa.array(score), pa.array(np.diff(slab.offs)), unknown]
            yield pa.RecordBatch.from_arrays(cols, names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "logs", "bits", "n_bytes", "rare"])

    schema = f"rid long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, logs double, bits double, n_bytes long, rare array<long>"
    rows = saved(docs.mapInArrow(run, schema))
    copies = rows.groupBy("rid").agg(F.count("*").alias("copies"))
    rare = rows.select("rid", F.explode("rare").alias("h")).join(counts, "h").groupBy("rid").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("more"), F.sum(F.log10(F.col("c").cast("double"))).alias("share"), F.count("*").alias("met"))
    smooth = math.log10(total + (kinds + 1))
    new = (once + 0.5) / (rare_tokens + 1) if rare_words else 1.0
    told = math.log10((1 - new) / rare_tokens) if new < 1 else 0.0
    extra = copies.join(rare, "rid", "left")
    of_copies = [(F.coalesce(F.col(c), F.lit(0.0)) / F.col("copies")).alias(c) for c in ("more", "share", "met")]
    done = rows.join(extra.select("rid", *of_copies), "rid")
    n_rare = F.size("rare")
    score = F.col("bits") + F.col("share") + F.col("met") * told + (n_rare - F.col("met")) * math.log10(new)
    done = done.withColumn("score", score)
    return done.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("met")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("more") - F.col("n_tokens") * F.lit(smooth)).alias("base_score"),
        "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
