"""Byte-level BPE encoding and decoding with a local rank file.

``encode(df, ranks)`` adds token ids, ``decode(df, ranks)`` turns ids back into bytes. Texts are
whole. A long text is first cut where the split pattern surely starts a new match: before a space
or newline that follows a letter or digit of any script or a mark of ASCII. No match holds such a pair in its inside
(white space can only come first in a match), so the pieces' tokens are the text's tokens. A run of
``RUN`` or more white space characters is one match by itself, but for its last character if more
text follows; it is encoded as one piece, without the pattern, whose look-ahead would exhaust the stack there.

Defined cases: null and empty text give no ids; ids that are null give empty bytes; an id outside
the ranks is an error of the task; other columns pass through, and a clash with an output column's
name is an error before any job runs. Texts of several MB, of one class of characters too, take time in
proportion to their length; a text's ids are held in memory, about 40 bytes each.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, types as T

from quiremill.llm.io import fresh
from quiremill.llm.kernel import sha256

PIECE = 1 << 16
#: Before this white space a match of the pattern always starts.
SAFE = re.compile(r"(?<=[!-~\w])(?=[ \n])")
RUN = 1000
#: White space as the library's expressions know it.
_RUNS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN)


@functools.cache
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """One encoder for each Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Cut text at the first safe boundary after every ``size`` characters."""
    at = 0
    while len(text) - at > size and (cut := SAFE.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(enc: tiktoken.Encoding, text: str | None) -> list[int]:
    ids, at = [], 0
    for run in _RUNS.finditer(text or ""):
        end = run.end() - (run.end() < len(text))
        ids += _of_pieces(enc, text[at : run.start()]) + enc._core_bpe.encode_single_piece(text[run.start() : end].encode())
        at = end
    return ids + _of_pieces(enc, text[at:]) if text else ids


def _of_pieces(enc: tiktoken.Encoding, text: str) -> list[int]:
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    return [x for piece in pieces(text) for x in enc.encode_ordinary(piece)]


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the column ``ids`` (array of int) in place of nothing: all other columns stay."""
    fresh(df, ids)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        for b in batches:
            for part in _parts(b, text):
                got = pa.array((encode_text(enc, x.as_py()) for x in part[text]), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, got], names=[*part.schema.names, ids])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ranks: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the raw bytes of ``ids`` as the binary column ``decoded``."""
    fresh(df, decoded)
    schema = T.StructType([*df.schema.fields, T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        for b in batches:
            got = pa.array((enc.decode_bytes(x.as_py() or []) for x in b[ids]), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, got], names=[*b.schema.names, decoded])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """What ``decode`` gives after ``encode``, in one pass: a task keeps one Python worker with its encoder, not two."""
    fresh(df, ids, decoded)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        for b in batches:
            for part in _parts(b, text):
                got = [encode_text(enc, x.as_py()) for x in part[text]]
                cols = [pa.array(got, pa.list_(pa.int32())), pa.array((enc.decode_bytes(x) for x in got), pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*part.schema.names, ids, decoded])

    return df.mapInArrow(run, schema)


def _parts(batch: pa.RecordBatch, text: str, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def digests(df: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key, n_tokens, ids_sha256 of the comma-joined decimal ids, decoded_sha256 of the decoded bytes.

    Encoding and decoding happen in one pass, so neither ids nor bytes leave the worker.
    """
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        names = [str(i) for i in range(enc.n_vocab)]
        for b in batches:
            rows = []
            for x in b[text]:
                ids = encode_text(enc, x.as_py())
                rows.append((len(ids), sha256(",".join([names[i] for i in ids]).encode()), sha256(enc.decode_bytes(ids))))
            n, a, d = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b[key], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(key, text).mapInArrow(run, schema)
