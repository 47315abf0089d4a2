"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

``encode`` adds a binary column of little-endian unsigned 32-bit ids, ``decode``
turns such a column back into raw bytes. A null text counts as empty; an empty
text has no ids and decodes to no bytes. Texts are cut before tiktoken sees them,
only where the splitting pattern always ends a match: at a white space byte
between two characters that surely are none. So no cut changes an id. A long text is read
in parts; its ids, its bytes and a copy of either are held at once, nothing larger. Repeated rows and ids
are handled row by row; other columns pass through unchanged.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf
from .chunkcode import ChunkEncoder, one_by_one

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x0A]] = True
_PRINTED = np.zeros(256, bool)
_PRINTED[0x21:0x7F] = True
#: First two bytes of the white space beyond ASCII: U+0085 and U+00A0; U+1680, U+2000 to U+2FFF's first two rows, U+3000's row.
_MAY_BE_WHITE = np.zeros((256, 256), bool)
_MAY_BE_WHITE[0xC2, [0x85, 0xA0]] = True
_MAY_BE_WHITE[[0xE1, 0xE2, 0xE2, 0xE3], [0x9A, 0x80, 0x81, 0x80]] = True


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Where a text may be cut without changing a match: before a lone space or line feed.

    The characters on either side must surely be none; ASCII is known by its byte, others by their first two.
    """
    n = len(data)
    if n < 3:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(_SPACE[data[1:-1]]) + 1
    back = [data[np.maximum(at - k, 0)] for k in (1, 2, 3)]
    # a character of two bytes opens two places back, one of three three; longer ones are no white space
    before = _PRINTED[back[0]] | ((back[0] >= 0x80) & (at >= 3) & ~_MAY_BE_WHITE[back[1], back[0]] & ~_MAY_BE_WHITE[back[2], back[1]])
    one, two = data[at + 1], data[np.minimum(at + 2, n - 1)]
    after = _PRINTED[one] | ((one >= 0xC2) & ~_MAY_BE_WHITE[one, two])
    return at[before & after]


def _chunks(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    opens = np.zeros(len(data), bool)
    opens[safe_cuts(data)] = True
    opens[offs[:-1][np.diff(offs) > 0]] = True
    starts = np.flatnonzero(opens)
    upto = np.append(0, np.cumsum(opens))[offs]
    return data, np.diff(np.append(starts, len(data))), np.diff(upto)


@cache
def _coder(path: str, pattern: str) -> ChunkEncoder:
    encode = _encoding(path, pattern).encode_ordinary
    return ChunkEncoder(one_by_one(lambda texts: [encode(t) for t in texts]), _chunks, cuts=safe_cuts)


def _with_column(batch: pa.RecordBatch, lo: int, hi: int, name: str, column: pa.Array) -> pa.RecordBatch:
    part = batch.slice(lo, hi - lo)
    return pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, name])


def _binary(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _encoder(path: str, pattern: str, text: str, ids: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in batches:
            data, offs = textbuf.buffer_of(batch.column(batch.schema.names.index(text)))
            for lo, hi in textbuf.slices(offs):
                found, bounds = coder.encode(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                yield _with_column(batch, lo, hi, ids, _binary(found.astype("<u4").view(np.uint8), bounds * 4))

    return textbuf.lean(run)


def _decoder(path: str, pattern: str, ids: str, decoded: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode_bytes = _encoding(path, pattern).decode_bytes
        for batch in batches:
            data, offs = textbuf.buffer_of(batch.column(batch.schema.names.index(ids)))
            for lo, hi in textbuf.slices(offs, 2 * textbuf.SLICE_BYTES):
                rows = [b"".join(decode_bytes(own[k : k + 100_000].tolist()) for k in range(0, len(own), 100_000)) for own in (data[offs[i] : offs[i + 1]].view("<u4") for i in range(lo, hi))]
                yield _with_column(batch, lo, hi, decoded, pa.array(rows, pa.binary()))

    return textbuf.lean(run)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``df`` and ``ids``, the little-endian 32-bit ids of ``text``; a column of that name is replaced."""
    df = df.drop(ids)
    return df.mapInArrow(_encoder(path, pattern, text, ids), df.withColumn(ids, F.lit(b"")).schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns of ``df`` and ``decoded``, the raw bytes that ``ids`` stand for; a column of that name is replaced."""
    df = df.drop(decoded)
    return df.mapInArrow(_decoder(path, pattern, ids, decoded), df.withColumn(decoded, F.lit(b"")).schema)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass: all columns of ``df``, ``ids`` and ``decoded``."""
    df = df.drop("ids", "decoded")
    there, back = _encoder(path, pattern, text, "ids"), _decoder(path, pattern, "ids", "decoded")
    return df.mapInArrow(lambda batches: back(there(batches)), df.withColumn("ids", F.lit(b"")).withColumn("decoded", F.lit(b"")).schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    return round_trip(docs.select("doc_id", "text"), path, pattern).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
