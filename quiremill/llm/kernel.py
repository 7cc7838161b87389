"""Numpy helpers shared by the text operators: words of Arrow string columns as byte spans and 64-bit hashes.

A word is ``[^\\x20\\x09-\\x0D]+``. Hashes are polynomials over random byte codes, modulo 2**64,
so the hash of any span of bytes or words comes from two prefix sums. Texts are taken whole;
a slab is a run of rows whose texts have about ``SLAB`` bytes (a longer text is a slab of its own).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SLAB = 1 << 18
_U = np.uint64
#: Rows of a batch that are looked at together, so that only their texts are copied.
_ROWS = 1024
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD6E8FEB86659FD93 | 1

#: Classes of bytes: runs of one class other than 0 are tokens.
IS_WORD = np.ones(256, dtype=np.uint8)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = 0
#: Letters, digits and all bytes of other scripts; punctuation separates.
LETTERS = np.array([(c >= 128) or chr(c).isalnum() for c in range(256)], dtype=np.uint8)
#: The same, with runs of punctuation as tokens of their own.
LETTERS_AND_MARKS = np.where(IS_WORD == 1, 2 - LETTERS, 0).astype(np.uint8)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_CODES = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (kept between calls)."""
    if base not in _powers or len(_powers[base][0]) < n:
        both, room = [], max(n, SLAB + 4096)
        for b in (base, pow(base, -1, 2**64)):
            a = np.full(room, b, dtype=_U)
            a[0] = 1
            both.append(np.cumprod(a, dtype=_U))
        _powers[base] = (both[0], both[1])
    return _powers[base][0][:n], _powers[base][1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of each value over the whole word."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(29)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(32)
    return h


class Slab:
    """Rows first..last of a batch: ``data`` are the bytes of their texts, ``offs`` the row borders in it."""

    def __init__(self, batch: pa.RecordBatch, data: np.ndarray, offs: np.ndarray):
        self.batch, self.data, self.offs = batch, data, offs

    def __len__(self) -> int:
        return len(self.offs) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()


def slabs(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = SLAB) -> Iterator[Slab]:
    """Cut batches into slabs. A null text counts as empty."""
    for batch in (b.slice(i, _ROWS) for b in batches for i in range(0, b.num_rows, _ROWS)):
        col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
        if col.null_count:
            col = col.fill_null("")
        offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
        raw = col.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, side="right")) - 1)
            own = offs[at : to + 1]
            yield Slab(batch.slice(at, to - at), data[own[0] : own[-1]], own - own[0])
            at = to


class Words:
    """Byte spans (start, end), row and 64-bit hash of every word of a slab."""

    def __init__(self, slab: Slab, lower: bool = False, classes: np.ndarray = IS_WORD):
        data, offs = slab.data, slab.offs
        self.data = data = LOWER[data] if lower else data
        kind = classes[data]
        inside = kind > 0
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= kind[1:] != kind[:-1]
        stops[:-1] &= kind[1:] != kind[:-1]
        full = offs[1:] > offs[:-1]
        first, last = offs[:-1][full], offs[1:][full] - 1
        begins[first] = inside[first]
        stops[last] = inside[last]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.row_at = np.searchsorted(self.start, offs)  # words of row i: row_at[i] .. row_at[i+1]
        self.count = np.diff(self.row_at)
        self.row = np.repeat(np.arange(len(slab)), self.count)
        up, self._down = powers(_BASE, len(data) + 1)
        self._bytes = np.zeros(len(data) + 1, dtype=_U)
        np.cumsum(_CODES[data] * up[:-1], out=self._bytes[1:])
        self.hash = self.spans(self.start, self.end)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each span of bytes."""
        return mix((self._bytes[end] - self._bytes[start]) * self._down[start] + (end - start).astype(_U))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, hash) of every run of k words inside one row."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        up, down = powers(_WORD_BASE, n + 1)
        if not hasattr(self, "_sums"):
            self._sums = np.zeros(n + 1, dtype=_U)
            np.cumsum(self.hash * up[:-1], out=self._sums[1:])
        at = np.flatnonzero(self.row[: n - k + 1] == self.row[k - 1 :])
        return at, mix((self._sums[at + k] - self._sums[at]) * down[at] + _U(k))


def row_sums(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sum of values[borders[i]:borders[i+1]] for each i, empty runs included."""
    sums = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=None if values.dtype.kind == "f" else np.int64)])
    return sums[borders[1:]] - sums[borders[:-1]]


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as int64, as Spark's long has them."""
    return h.view(np.int64)
