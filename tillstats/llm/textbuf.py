"""Vectorised passes over UTF-8 text held as one byte buffer plus offsets.

Everything here works on a slice of documents at a time: ``data`` is a uint8
array with the bytes of all documents of the slice, ``offs`` an int64 array with
their bounds (``len(offs) == n_docs + 1``). Null texts count as empty.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once, so that temporary arrays stay near 60 MB.
SLICE_BYTES = (1 << 20) - 1

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a worker returns freed memory to the system, so that idle workers don't keep it from the next stage."""

    def then_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return then_release


def release() -> None:
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = column.cast(pa.large_binary())
    if binary.null_count:
        binary = pc.fill_null(binary, b"")
    offs = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1] if len(binary) else np.zeros(1, np.int64)
    if not len(binary) or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(binary) + 1, np.int64)
    data = np.frombuffer(binary.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]


def slices(offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``most`` bytes; a longer one stands alone."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def spans(data: np.ndarray, offs: np.ndarray, is_separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the maximal runs of bytes that are no separators."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    word = ~is_separator[data]
    opens = np.zeros(n + 1, bool)
    opens[offs[:-1]] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | opens[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | opens[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1 for each i, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting them in place."""
    values.sort()
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


#: What parts words: space and the bytes 0x09 to 0x0D.
WORD_SEPARATOR = np.zeros(256, bool)
WORD_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_STEPS = mix(np.arange(1, 65, dtype=np.uint64) * _M1) | np.uint64(1)
_KEY = b"word shingles"
#: SipHash's initial state.
_SIP = tuple(map(np.uint64, (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)))
_SIP_KEY = tuple(np.frombuffer(hashlib.blake2b(_KEY, digest_size=16).digest(), "<u8").astype(np.uint64))
#: Spans of more 8-byte blocks are hashed one by one.
_MOST_BLOCKS = 32


def strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive strings of the given lengths as an Arrow array over ``data``."""
    bounds = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=bounds[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])


def numbered(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For each string the number of its value, equal by its bytes, and the distinct values."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def words(data: np.ndarray, offs: np.ndarray, fold_case: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Number of each word's value, the distinct words, and how many words each document has."""
    starts, ends, doc = spans(data, offs, WORD_SEPARATOR)
    inner = data[~WORD_SEPARATOR[data]]
    number, distinct = numbered(strings(_FOLDED[inner] if fold_case else inner, ends - starts))
    return number, distinct, np.bincount(doc, minlength=len(offs) - 1)


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _rounds(v: list[np.ndarray], n: int) -> None:
    for _ in range(n):
        a, b, c, d = v
        a, c = a + b, c + d
        b, d = _rotated(b, 13) ^ a, _rotated(d, 16) ^ c
        a, c = _rotated(a, 32) + d, c + b
        v[:] = a, _rotated(b, 17) ^ c, _rotated(c, 32), _rotated(d, 21) ^ a


def keyed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A keyed 64-bit hash of each span: SipHash-2-4, worked out for all spans of one number of 8-byte blocks at once."""
    size = ends - starts
    out = np.empty(len(size), np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words_ = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    blocks = np.minimum(size >> 3, _MOST_BLOCKS)
    for full in np.unique(blocks).tolist():
        own = np.flatnonzero(blocks == full)
        if full == _MOST_BLOCKS:
            out[own] = [int.from_bytes(hashlib.blake2b(data[s:e].tobytes(), digest_size=8, key=_KEY).digest(), "little") for s, e in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]
            continue
        at, n = starts[own], size[own]
        v = [np.full(len(own), c ^ k) for c, k in zip(_SIP, _SIP_KEY * 2, strict=True)]
        rest = (n - 8 * full).astype(np.uint64) * np.uint64(8)
        for block in range(full + 1):
            m = words_[at + 8 * block]
            if block == full:
                m = (m & ((np.uint64(1) << rest) - np.uint64(1))) | (n.astype(np.uint64) << np.uint64(56))
            v[3] = v[3] ^ m
            _rounds(v, 2)
            v[0] = v[0] ^ m
        v[2] = v[2] ^ np.uint64(0xFF)
        _rounds(v, 4)
        out[own] = v[0] ^ v[1] ^ v[2] ^ v[3]
    return out


def word_hashes(data: np.ndarray, offs: np.ndarray, fold_case: bool) -> tuple[np.ndarray, np.ndarray]:
    """The keyed hash of each word, and how many words each document has."""
    starts, ends, doc = spans(data, offs, WORD_SEPARATOR)
    return keyed(_FOLDED[data] if fold_case else data, starts, ends), np.bincount(doc, minlength=len(offs) - 1)


def normalised(data: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """Each document's words in lower case (A-Z), parted by one blank."""
    word = ~WORD_SEPARATOR[data]
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first separator after a word
    keep[offs[:-1][np.diff(offs) > 0]] &= word[offs[:-1][np.diff(offs) > 0]]
    raw = np.where(word[keep], _FOLDED[data[keep]], np.uint8(0x20)).tobytes()
    upto = np.append(0, np.cumsum(keep))[offs].tolist()
    return [raw[a:b].rstrip(b" ") for a, b in zip(upto[:-1], upto[1:], strict=True)]


def shingle_sets(data: np.ndarray, offs: np.ndarray, words_: int = 5, fold_case: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct 64-bit hashes of each document's word shingles, and their bounds.

    With fewer words than ``words_`` the whole sequence is the one shingle; without words the set is empty. A word
    counts by a keyed hash of its bytes, so texts can't be made to collide; who needs equality compares the words.
    """
    n = len(offs) - 1
    if (np.diff(offs) > 2 * SLICE_BYTES).any():
        if n == 1:
            return _long_set(data, words_, fold_case)
        parts = [shingle_sets(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], words_, fold_case) for lo, hi in slices(offs)]
        return np.concatenate([p[0] for p in parts]), np.append(0, np.cumsum(np.concatenate([np.diff(p[1]) for p in parts])))
    hashed, count = word_hashes(data, offs, fold_case)
    begin = np.cumsum(count) - count
    k = min(words_, 64)
    parts = _combined(hashed, k)
    whole = np.flatnonzero(count >= k)
    made = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    out = np.zeros(int(made.sum()), np.uint64)
    at = np.cumsum(made) - made
    out[ragged(at[whole], made[whole])] = parts[ragged(begin[whole], made[whole])]
    for d in np.flatnonzero((count > 0) & (count < k)):
        m = int(count[d])
        short = (hashed[begin[d] : begin[d] + m] * _STEPS[:m]).sum(dtype=np.uint64, keepdims=True)
        out[at[d]] = mix(short + np.full(1, m, np.uint64) * _M2)[0]
    bounds = np.append(at, len(out))
    for d in range(n):
        out[bounds[d] : bounds[d + 1]].sort()
    if not len(out):
        return out, np.zeros(n + 1, np.int64)
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[at[made > 0]] = True
    upto = np.append(0, np.cumsum(keep))
    return out[keep], upto[bounds]


def _combined(hashed: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` neighbouring words."""
    parts = np.zeros(max(0, len(hashed) - k + 1), np.uint64)
    for j in range(k):
        parts += hashed[j : j + len(parts)] * _STEPS[j]
    return mix(parts)


def pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of one long text that end between words."""
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + SLICE_BYTES)
        while hi < len(data) and not WORD_SEPARATOR[data[hi]]:
            ahead = np.flatnonzero(WORD_SEPARATOR[data[hi : hi + 4096]])
            hi = hi + int(ahead[0]) if len(ahead) else min(len(data), hi + 4096)
        yield lo, hi
        lo = hi


def _long_set(data: np.ndarray, words_: int, fold_case: bool) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_sets`` of one long text, read in parts."""
    k = min(words_, 64)
    carried, found = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    fresh: list[np.ndarray] = []
    for lo, hi in pieces(data):
        carried = np.append(carried, word_hashes(data[lo:hi], np.array([0, hi - lo]), fold_case)[0])
        if len(carried) >= k:
            fresh.append(distinct(_combined(carried, k)))
            carried = carried[len(carried) - k + 1 :]
        if sum(map(len, fresh)) > max(1_000_000, len(found)):
            found, fresh = distinct(np.concatenate([found, *fresh])), []
    out = distinct(np.concatenate([found, *fresh]))
    if not len(out) and len(carried):
        out = mix((carried * _STEPS[: len(carried)]).sum(dtype=np.uint64, keepdims=True) + np.full(1, len(carried), np.uint64) * _M2)
    return out, np.array([0, len(out)])


def digests(data: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """128 bits of a cryptographic digest of each document's words in lower case (A-Z)."""
    out: list[bytes] = []
    for lo, hi in slices(offs):
        if hi - lo == 1 and offs[hi] - offs[lo] > 2 * SLICE_BYTES:
            text, own, sep = data[offs[lo] : offs[hi]], hashlib.blake2b(digest_size=16), b""
            for a, b in pieces(text):
                if part := normalised(text[a:b], np.array([0, b - a]))[0]:
                    own.update(sep + part)
                    sep = b" "
            out.append(own.digest())
        else:
            out += [hashlib.blake2b(t, digest_size=16).digest() for t in normalised(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])]
    return out
