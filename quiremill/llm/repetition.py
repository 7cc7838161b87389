"""Quality rules by repetition coverage.

For several n-gram lengths, rolling hashes of all word n-grams of a text show which occur twice or
more in it; the characters of words inside such n-grams, over all characters of words, are the
coverage of that length. The same is measured for repeated lines. A text whose coverage exceeds the
limit of any length, or of lines, is not kept.

Defined cases: null and empty text have no words and fail the base rules; equal n-grams are told by
64-bit hashes; repeated rows are judged alike; extra columns pass through ``measure``'s caller.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quiremill.llm.kernel import Slab, Words, mix, row_sums, slabs

#: n-gram length -> largest share of word characters inside n-grams that occur twice or more.
LIMITS = {5: 0.25, 8: 0.20, 10: 0.18}
#: Largest share of word characters inside lines equal to an earlier line.
LINE_LIMIT = 0.30
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated(row: np.ndarray, h: np.ndarray, later: bool = False) -> np.ndarray:
    """Which items occur twice or more in their row; with later, only those that have an equal one before them."""
    order = np.argsort(mix(h + (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    h, row = h[order], row[order]
    same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    out = np.zeros(len(h), bool)
    out[order[1:]] = same
    if not later:
        out[order[:-1]] |= same
    return out


def covered(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which words lie inside one of the n-word windows that start at ``at``."""
    steps = np.zeros(total + 1, np.int32)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + n, -1)
    return np.cumsum(steps[:-1]) > 0


def lines_of(slab: Slab, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, first word) of every line with a word, and as last entry of the third the number of words."""
    ends = np.union1d(np.flatnonzero(slab.data == 0x0A), slab.offs[1:] - 1)
    ends = ends[ends >= 0]
    start = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    stop = np.where(slab.data[ends] == 0x0A, ends, ends + 1) if len(ends) else ends
    first = np.searchsorted(words.start, start)
    full = np.diff(np.append(first, len(words.start))) > 0
    return words.row[first[full]], words.spans(start[full], stop[full]), np.append(first[full], len(words.start))


def measure(df: DataFrame, key: str = "doc_id", text: str = "text", limits: dict[int, float] = LIMITS, line_limit: float = LINE_LIMIT) -> DataFrame:
    """For each row: key, the counts, base_failed, the coverage of every length and of lines, and kept."""
    shares = [f"share_{n}" for n in limits]
    schema = f"{key} {df.schema[key].dataType.simpleString()}, " + ", ".join(f"{x} long" for x in _NAMES) + ", base_failed boolean, " + ", ".join(f"{x} double" for x in [*shares, "share_lines"]) + ", kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, text):
            words = Words(slab)
            points = np.concatenate([[0], np.cumsum((slab.data & 0xC0) != 0x80)])
            chars = points[words.end] - points[words.start]
            total = row_sums(chars, words.row_at)
            symbols = row_sums(SYMBOLS[slab.data], slab.offs)
            line_row, line_hash, first = lines_of(slab, words)
            again = repeated(line_row, line_hash, later=True)
            n_lines = np.bincount(line_row[again], minlength=len(slab))
            in_line = row_sums(np.where(np.repeat(again, np.diff(first)), chars, 0), words.row_at)
            share = []
            for n in (3, *limits):
                at, h = words.grams(n)
                inside = covered(at[repeated(words.row[at], h)], n, len(chars))
                if n == 3:
                    repeats = row_sums(inside, words.row_at)
                if n in limits:
                    share.append(row_sums(np.where(inside, chars, 0), words.row_at) / np.maximum(total, 1))
            share.append(in_line / np.maximum(total, 1))
            failed = (words.count < 50) | (100 * repeats > 50 * words.count)
            kept = ~failed & np.all([s <= limit for s, limit in zip(share, [*limits.values(), line_limit], strict=True)], axis=0)
            counts = [words.count, total, symbols, n_lines, repeats]
            cols = [slab.batch[key], *(pa.array(c, pa.int64()) for c in counts), pa.array(failed), *map(pa.array, share), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(cols, names=[key, *_NAMES, "base_failed", *shares, "share_lines", "kept"])

    return df.select(key, text).mapInArrow(run, schema)
