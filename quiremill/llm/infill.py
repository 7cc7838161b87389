"""Fill-in-middle transformation: a text's units are cut into prefix, middle and suffix, which change places between markers.

A unit ends with the byte ``end`` (a line: ``\\n``) or with the text. Where the units end is found in the
texts' UTF-8 bytes, eight at a time: a slab of texts is viewed as uint64 words, bytes equal to ``end`` are marked
in each word by arithmetic, ``bitwise_count`` and a running sum give the marks before every word, a binary
search finds the word of the k-th mark, and a multiplication that adds up the word's bytes finds the byte in it.
Code points are counted by the same words, with the continuation bytes marked.

Defined cases: a null text is an empty one; an empty text, and one that holds a marker, is plain and stays as it is;
a null id is drawn as the empty id; repeated rows get the same form; a text is taken whole (some 8 bytes of memory
for each of its bytes); an empty table gives an empty one. Only the key and the columns in ``keep`` pass through,
so other columns never clash; one of these with the name of a result is an error before any job runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quiremill.llm.io import fresh
from quiremill.llm.kernel import slabs

_U = np.uint64
#: One in each byte of a word, and the high and the low seven bits of each byte.
ONES, HIGH, LOW = _U(0x0101010101010101), _U(0x8080808080808080), _U(0x7F7F7F7F7F7F7F7F)
#: What stands before the prefix, the suffix and the middle.
MARKERS = ("<P>", "<S>", "<M>")
RESULTS = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


def as_words(data: np.ndarray) -> np.ndarray:
    """Bytes as little-endian uint64 words, filled up with zero bytes and one zero word at least."""
    padded = np.zeros(len(data) // 8 * 8 + 8, np.uint8)
    padded[: len(data)] = data
    return padded.view("<u8")


def equal_bytes(words: np.ndarray, byte: int) -> np.ndarray:
    """The high bit of every byte that equals ``byte`` (no carry leaves a byte, so no other is marked)."""
    x = words ^ (ONES * _U(byte))
    return ~(((x & LOW) + LOW) | x | LOW)


def continuations(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte 10xxxxxx."""
    return words & ~(words << _U(1)) & HIGH


class Marks:
    """Ranks and places of the marked bytes of a run of words."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many bytes before each place are marked."""
        word, byte = at >> 3, (at & 7).astype(_U)
        return self.before[word] + np.bitwise_count(self.marks[word] & ((_U(1) << (byte * _U(8))) - _U(1)))

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th marked byte, k from 1."""
        word = np.searchsorted(self.before, k) - 1
        nth = (k - self.before[word]).astype(_U)
        upto = (self.marks[word] >> _U(7)) * ONES  # each byte: the marks up to it
        reached = ((upto | HIGH) - nth * ONES) & HIGH
        return word * 8 + 8 - np.bitwise_count(reached)


def cut_places(data: np.ndarray, offs: np.ndarray, h1: np.ndarray, h2: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the texts of a slab: units, byte places where prefix and middle end, code points of prefix and middle."""
    words, start, stop = as_words(data), offs[:-1], offs[1:]
    ends, inner = Marks(equal_bytes(words, end)), Marks(continuations(words))
    first = ends.rank(start)
    whole = ends.rank(stop) - first
    open_end = (stop > start) & (data[np.maximum(stop, 1) - 1] != end) if len(data) else np.zeros(len(start), bool)
    n = whole + open_end
    cuts = []
    for k in (np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))):
        place = np.where(k == 0, start, stop)
        marked = (k > 0) & (k <= whole)
        place[marked] = ends.select((first + k)[marked]) + 1
        cuts.append(place)
    points = [to - inner.rank(to) for to in (start, *cuts)]
    return n, *cuts, points[1] - points[0], points[2] - points[1]


def _draw(key: str, seed: int, group: int) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def infilled(df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), seed: int = 7, rate: int = 100, spm: int = 50, end: str = "\n", markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """For each row: key, the columns in keep, n (units), form, prefix_chars, middle_chars (null if plain) and output.

    ``rate`` percent of texts are transformed, ``spm`` percent of these with the suffix first. ``end`` is one
    ASCII character. No marker may have a marker's first character elsewhere, so that borders can't be mistaken.
    """
    if len(end) != 1 or ord(end) > 127:
        raise ValueError("units end with one ASCII character")
    if any(not m for m in markers) or len(set(markers)) < 3 or {m[0] for m in markers} & set("".join(m[1:] for m in markers)):
        raise ValueError("three different markers, whose first characters occur only there")
    own = df.select(key, *(f"`{c}`" for c in keep))
    fresh(own, *RESULTS)
    schema = T.StructType([*own.schema.fields, *(T.StructField(c, T.LongType() if t == "long" else T.StringType()) for c, t in RESULTS.items())])
    whole = F.coalesce(F.col(text), F.lit(""))
    plain = (F.length(whole) == 0) | F.lit(False)
    for m in markers:
        plain |= whole.contains(m)
    form = F.when(plain | (_draw(key, seed, 3) % 100 >= rate), 0).when(_draw(key, seed, 4) % 100 < spm, 1).otherwise(2)
    rows = df.select(F.struct(key, *(f"`{c}`" for c in keep)).alias("own"), whole.alias("text"), form.alias("form"), _draw(key, seed, 1).alias("h1"), _draw(key, seed, 2).alias("h2"))
    p, s, m = (x.encode() for x in markers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches):
            b = slab.batch
            h1, h2, kind = (b[c].to_numpy(zero_copy_only=False) for c in ("h1", "h2", "form"))
            n, one, two, *chars = cut_places(slab.data, slab.offs, h1, h2, ord(end))
            out = []
            for i, (a, z, x, y) in enumerate(zip(slab.offs, slab.offs[1:], one, two, strict=False)):
                prefix, middle, suffix = (slab.data[u:v].tobytes() for u, v in ((a, x), (x, y), (y, z)))
                out.append((slab.text(i), b"".join((s, suffix, p, prefix, m, middle)), b"".join((p, prefix, s, suffix, m, middle)))[kind[i]])
            forms = pa.array(["plain", "spm", "psm"]).take(pa.array(kind))
            counts = [pa.array(c, pa.int64(), mask=kind == 0) for c in chars]
            columns = [*b["own"].flatten(), pa.array(n, pa.int64()), forms, *counts, pa.array(out, pa.binary()).view(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def restored(output: str = "output", form: str = "form", markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that a transformed row was made of, from its output and form alone."""
    parts = F.split(F.col(output), "|".join(re.escape(m) for m in markers), -1)
    return F.when(F.col(form) == "psm", F.concat(parts[1], parts[3], parts[2])).when(F.col(form) == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(F.col(output))


def oracle(seed: int = 7, rate: int = 100, spm: int = 50) -> str:
    """The digests of ``op11`` in SQL, for lines and the usual markers."""
    h = ", ".join(f"('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), {8 * g - 7}, 8))::BIGINT AS h{g}" for g in (1, 2, 3, 4))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS p, {h} FROM documents),
u AS (SELECT *, len(p) - (p[len(p)] = '')::INT AS n FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, list_transform(range(1, n + 1), lambda i: p[i] || CASE WHEN i < len(p) THEN chr(10) ELSE '' END) AS l,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {rate} THEN 'plain' WHEN h4 % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM u),
x AS (SELECT doc_id, t, n::BIGINT AS n, form, array_to_string(l[1:a], '') AS pre, array_to_string(l[a + 1:b], '') AS mid, array_to_string(l[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM x"""
