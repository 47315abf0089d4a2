"""Word-level BPE with the tokenizers library, each distinct chunk encoded once.

The tokenizer's splitting pattern never matches white space, its normaliser works
character by character, and nothing composes with a blank; so the ids of a text are the
ids of its chunks between blanks, line feeds, returns and tabs, in order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from . import textbuf
from .chunkcode import ChunkEncoder, marked

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x0A, 0x0D, 0x09]] = True


def _chunks(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, doc = textbuf.spans(data, offs, _BLANK)
    return data[~_BLANK[data]], ends - starts, np.bincount(doc, minlength=len(offs) - 1)


@cache
def coder(path: str) -> ChunkEncoder:
    """The worker's encoder for one tokenizer file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return ChunkEncoder(
        marked(lambda texts: [e.ids for k in range(0, len(texts), 2_000) for e in tokenizer.encode_batch_fast(texts[k : k + 2_000], add_special_tokens=False)]),
        _chunks,
        cuts=lambda data: np.flatnonzero(_BLANK[data[1:]]) + 1,
    )


def encoded(column: pa.Array, path: str, end: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of documents: first, end, the ids as uint32 and their bounds; ``end`` is appended to each document."""
    data, offs = textbuf.buffer_of(column)
    for lo, hi in textbuf.slices(offs):
        ids, bounds = coder(path).encode(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        if end is not None:
            n = hi - lo
            out = np.full(len(ids) + n, end, np.uint32)
            out[textbuf.ragged(bounds[:-1] + np.arange(n), np.diff(bounds))] = ids
            ids, bounds = out, bounds + np.arange(n + 1)
        yield lo, hi, ids, bounds


def crc32(ids: np.ndarray) -> int:
    """Unsigned checksum of ids as little-endian 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
