"""Benchmark decontamination by spaced-seed hashing.

Words are runs of letters and digits, lower-cased. Each of a few fixed masks picks some of the
window's words and ignores the others; the hashes of the picked words of test items and
of training texts are joined, so a hit survives substitutions at ignored places. Around each hit the
item is laid along the text, and the stretch with the most agreement (a match counts 1, a
difference -1.5) says which of the item's words are there. A document holds an item if these are at
least ``SHARE`` of the item's words and at least eight, or if one stretch has ``PASSAGE`` of them,
however long the item is. Items of less than eight words must be there
word for word.

Two kinds of masks: three long ones of eight words, and all ways in which a stretch of most
agreement can begin, up to its ``WEIGHT``-th match (its sum never falls below zero, so there are
nine). Every alignment with a stretch of ``WEIGHT`` matches is therefore met, whichever words were
changed; one that only a beginning meets counts if its stretch has eight words or the whole item.

Test items come to the workers in blocks of about ``BLOCK_BYTES`` bytes of text, whatever its script (a word
has at least one byte and one separator, and some 200 bytes of hashes are broadcast for it); each block makes one
pass over the texts. Texts are whole, no hit is dropped.

Defined cases: null and empty texts or items have no words and match nothing; items with equal
words are all reported; repeated rows are reported alike, with a null id if theirs is null; ids are
whole numbers, others are an error before any job runs; extra columns are not read; an empty table on either side
gives no rows. A text is taken whole and needs about 100 bytes of memory for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from quiremill.llm.io import saved, whole_numbers
from quiremill.llm.kernel import LETTERS, Words, mix, slabs

DIFFERENCE = 1.5
SHARE = 0.5
LEAST = 8
#: Agreeing words of one stretch that are enough.
PASSAGE = 13
WEIGHT = 5
#: Fixed masks: 1 is a word that must match.
MASKS = ("11101100111", "11011010111", "10111101011")
#: Bytes of test items that are collected and broadcast at once.
BLOCK_BYTES = 1 << 21
_TABLE = 20


def beginnings(weight: int) -> list[str]:
    """Every way in which a stretch of most agreement can begin, up to its weight-th match."""
    done, growing = [], [("1", 1.0)]
    while growing:
        mask, score = growing.pop()
        if mask.count("1") == weight:
            done.append(mask)
            continue
        while score >= 0:
            growing.append((mask + "1", score + 1))
            mask, score = mask + "0", score - DIFFERENCE
    return done


LIGHT = tuple(beginnings(WEIGHT))


def seeds(h: np.ndarray, row: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash of the picked words) of every window inside one row."""
    n = len(h) - len(mask) + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(int(mask, 2)))
    for i, c in enumerate(mask):
        if c == "1":
            out += h[i : i + n] * np.uint64(pow(0xBF58476D1CE4E5B9, i + 1, 2**64))
    at = np.flatnonzero(row[:n] == row[len(mask) - 1 :])
    return at, mix(out[at])


class Items:
    """The test side of one block: words of each item, and sorted seeds of every mask and of every length under ``WEIGHT``."""

    def __init__(self, ids: list, texts: list[str]):
        batch = pa.record_batch({"text": pa.array(texts, pa.string()), "no": pa.array(range(len(texts)))})
        self.ids, self.words = ids, [np.zeros(0, np.uint64)] * len(ids)
        parts: dict[str, list] = {m: [] for m in (*MASKS, *LIGHT)}
        for slab in slabs([batch]):
            words = Words(slab, classes=LETTERS)
            no = slab.batch["no"].to_numpy()
            for i in range(len(slab)):
                self.words[no[i]] = words.hash[words.row_at[i] : words.row_at[i + 1]]
            for mask in [*MASKS, *LIGHT, *("1" * n for n in np.unique(words.count) if 0 < n < WEIGHT)]:
                at, h = seeds(words.hash, words.row, mask)
                if len(mask) < WEIGHT:
                    keep = words.count[words.row[at]] == len(mask)
                    at, h = at[keep], h[keep]
                parts.setdefault(mask, []).append((h, no[words.row[at]].astype(np.int32), (at - words.row_at[words.row[at]]).astype(np.int32)))
        self.seeds = {}
        for mask, found in parts.items():
            if found and sum(len(f[0]) for f in found):
                h, item, at = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(h, kind="stable")
                table = np.zeros(1 << _TABLE, bool)
                table[h >> np.uint64(64 - _TABLE)] = True
                self.seeds[mask] = (h[order], item[order], at[order], table)


def agreeing(equal: np.ndarray) -> np.ndarray:
    """Places that agree inside the stretch with the greatest sum of matches less 1.5 for each difference."""
    sums = np.concatenate([[0.0], np.cumsum(np.where(equal, 1.0, -DIFFERENCE))])
    lowest = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - lowest))
    begin = int(np.argmin(sums[: end + 1]))
    return begin + np.flatnonzero(equal[begin:end])


def overlaps(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """(doc_id, item_no, matched, first_word) for one block of ``Items``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = shared.value
        for slab in slabs(batches):
            words = Words(slab, classes=LETTERS)
            hits = []
            for mask, (h, item, place, table) in test.seeds.items():
                at, s = seeds(words.hash, words.row, mask)
                near = table[s >> np.uint64(64 - _TABLE)]
                at, s = at[near], s[near]
                lo, hi = np.searchsorted(h, s), np.searchsorted(h, s, side="right")
                many = hi - lo
                which = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
                at = np.repeat(at, many)
                row = words.row[at]
                hits.append(np.stack([row, item[which], at - words.row_at[row] - place[which], np.full(len(row), mask in LIGHT)]))
            found: dict[tuple[int, int], tuple[set, int, int]] = {}
            every = np.unique(np.concatenate(hits, axis=1), axis=1) if hits else np.zeros((4, 0), np.int64)
            for row, no, shift, light in every.T.tolist():
                own, text = test.words[no], words.hash[words.row_at[row] : words.row_at[row + 1]]
                lo, hi = max(0, -shift), min(len(own), len(text) - shift)
                equal = own[lo:hi] == text[lo + shift : hi + shift]
                if light and np.count_nonzero(equal) < min(LEAST, len(own)):
                    continue
                places = lo + agreeing(equal)
                if light and len(places) < min(LEAST, len(own)):
                    continue
                seen, first, most = found.get((row, no), (set(), len(text), 0))
                found[row, no] = (seen | set(places.tolist()), min(first, int(places[0]) + shift) if len(places) else first, max(most, len(places)))
            good = [(k, len(seen), first) for k, (seen, first, most) in found.items() if most >= PASSAGE or len(seen) >= max(min(LEAST, len(test.words[k[1]])), SHARE * len(test.words[k[1]]))]
            ids = slab.batch["doc_id"].take(pa.array([k[0] for k, _, _ in good], pa.int64()))
            cols = [ids, *(pa.array(x, pa.int64()) for x in ([k[1] for k, _, _ in good], [n for _, n, _ in good], [f for _, _, f in good]))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_no", "matched", "first_word"])

    return docs.mapInArrow(run, "doc_id long, item_no long, matched long, first_word long")


def contaminated(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, item_words, matched, first_word): a row for every document and every test item that it holds.

    The items are collected block by block, never all at once: with more than one block, each one's
    rows are written before the next block is collected.
    """
    docs = df.select(whole_numbers(df, key).alias("doc_id"), F.lower(F.col(text).cast("string")).alias("text"))
    tests = benchmark.where(F.col(item_text).isNotNull()).select(whole_numbers(benchmark, item).alias("item_id"), F.lower(F.col(item_text).cast("string")).alias("text"))
    blocks = max(1, -(-(tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    out = None
    for b in range(blocks):
        rows = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        items = Items([r.item_id for r in rows], [r.text for r in rows])
        names = docs.sparkSession.createDataFrame([(i, r.item_id, len(items.words[i])) for i, r in enumerate(rows)], "item_no long, item_id long, item_words long")
        shared = docs.sparkSession.sparkContext.broadcast(items)
        found = overlaps(docs, shared).join(F.broadcast(names), "item_no").select("doc_id", "item_id", "item_words", "matched", "first_word")
        if blocks > 1:
            found = saved(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out
