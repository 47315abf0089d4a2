"""Document fingerprints by one-permutation MinHash with optimal densification.

Every word shingle is hashed once; its top bits name a bin, and each bin keeps the
smallest hash. An empty bin j copies the first filled bin of a fixed random order
of all bins that belongs to j alone (the same for every document), so equal sets always give
equal fingerprints. Of each bin's hash, scrambled by bin, only the low-order bits are stored; the share of equal bins is
corrected for chance: likeness = (share - 2**-bits) / (1 - 2**-bits), cut to 0..1.

Defined results: a null text counts as empty; a text without words has the empty
fingerprint, which is like itself (1.0) and unlike any other (0.0); a text with fewer
words than a shingle has one shingle, the whole. Rows with equal or null ids keep a fixed
order (null ids last, ties by text), so each row has one next row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textbuf

BINS, BITS = 512, 4
_EMPTY = 255
#: Documents handled at once, beside the limit on bytes.
_MOST_ROWS = 2_000
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


@cache
def _orders(bins: int) -> np.ndarray:
    rng = np.random.default_rng(512)
    return np.stack([rng.permutation(bins) for _ in range(bins)]).astype(np.int32)


def registers(data: np.ndarray, offs: np.ndarray, bins: int = BINS, bits: int = BITS, words: int = 5) -> np.ndarray:
    """One row of stored bits per document; rows without words hold 255 throughout."""
    n, shift = len(offs) - 1, np.uint64(64 - (bins - 1).bit_length())
    hashes, bounds = textbuf.shingle_sets(data, offs, words)
    least = np.zeros((n, bins), np.uint64)
    full = np.zeros((n, bins), bool)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    cell = doc * bins + (hashes >> shift).astype(np.int64)
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]  # hashes ascend within a document, so the first of a bin is its least
    least.reshape(-1)[cell[first]] = hashes[first]
    full.reshape(-1)[cell[first]] = True
    some = bounds[1:] > bounds[:-1]
    row, bin_ = np.nonzero(~full & some[:, None])
    orders, t = _orders(bins), 0
    while len(row):
        source = orders[bin_, t]
        got = full[row, source]
        least[row[got], bin_[got]] = least[row[got], source[got]]
        row, bin_, t = row[~got], bin_[~got], t + 1
    # scrambled by bin, so that bins with one source don't agree by chance all at once
    mixed = textbuf.mix(least + np.arange(1, bins + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.where(some[:, None], mixed & np.uint64((1 << bits) - 1), np.uint64(_EMPTY)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Row by row, the corrected estimate of the Jaccard likeness."""
    chance = 2.0**-bits
    share = (a == b).mean(axis=1)
    out = np.clip((share - chance) / (1 - chance), 0, 1)
    none_a, none_b = a[:, 0] == _EMPTY, b[:, 0] == _EMPTY
    return np.where(none_a | none_b, (none_a & none_b).astype(float), out)


def as_hex(rows: np.ndarray, bits: int = BITS) -> list[str]:
    """The stored bits of each row, packed; empty for a row without words."""
    flat = np.unpackbits(rows[:, :, None], axis=2, bitorder="little", count=bits).reshape(len(rows), -1)
    packed = np.packbits(flat, axis=1, bitorder="little")
    return ["" if r[0] == _EMPTY else p.tobytes().hex() for r, p in zip(rows, packed, strict=True)]


def _registers_of(texts: list[str], bins: int, bits: int, words: int) -> np.ndarray:
    return registers(*textbuf.buffer_of(pa.array(texts, pa.large_string())), bins, bits, words)


def fingerprint(df: DataFrame, text: str = "text", bins: int = BINS, bits: int = BITS, words: int = 5) -> DataFrame:
    """All columns of ``df`` and ``fingerprint``, the hexadecimal packed bits of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = textbuf.buffer_of(batch.column(batch.schema.names.index(text)))
            for lo, hi in textbuf.slices(offs):
                rows = registers(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], bins, bits, words)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(as_hex(rows, bits), pa.string())], names=[*part.schema.names, "fingerprint"])

    df = df.drop("fingerprint")
    return df.mapInArrow(textbuf.lean(run), df.withColumn("fingerprint", F.lit("")).schema)


def _rings(docs: DataFrame) -> DataFrame:
    """(ring, tail, doc_id, text): descending ranges of doc_id, each followed by the row that comes next.

    Bounds are ids that occur, from Spark's fixed-size percentile sketch; the highest id is one.
    """
    n = common.partitions(docs.sparkSession, docs.select("doc_id", "text"))
    steps = [k / n for k in range(1, n)] + [1.0]
    row = docs.select(F.percentile_approx("doc_id", F.lit(steps), F.lit(10_000)).alias("b"), F.max("doc_id").alias("m")).first()
    bounds = np.unique(np.array([*(row["b"] or []), *([row["m"]] if row["m"] is not None else [])], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            value = ids.fill_null(0).to_numpy()
            # ring q holds the ids from the q-th highest bound down to above the next one
            ring = np.where(null, len(bounds), len(bounds) - np.searchsorted(bounds, value, "left")).astype(np.int32)
            again = np.flatnonzero(~null & np.isin(value, bounds))
            before = np.where(ring[again] > 1, ring[again] - 1, len(bounds)).astype(np.int32)
            order = np.concatenate([np.arange(len(ids)), again])
            tail = np.repeat([0, 1], [len(ids), len(again)]).astype(np.int32)
            for lo in range(0, len(order), _MOST_ROWS):
                at = pa.array(order[lo : lo + _MOST_ROWS])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([ring, before])[lo : lo + _MOST_ROWS]), pa.array(tail[lo : lo + _MOST_ROWS]), ids.take(at), batch.column(1).take(at)],
                    names=["ring", "tail", "doc_id", "text"],
                )

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(textbuf.lean(run), "ring int, tail int, doc_id long, text string")
    # a higher bound's row stands for ring q = number of bounds not below it; see ring above
    return rows.repartition(n, "ring").sortWithinPartitions("ring", "tail", F.col("doc_id").desc_nulls_last(), "text")


def edited(docs: DataFrame, bins: int = BINS, bits: int = BITS, words: int = 5) -> DataFrame:
    """Fingerprints of each text and of its edit, whose last half is replaced by the head of the next text.

    The next text is that of the next lower doc_id, after the last the first; see the module for ties.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        """Groups of consecutive rows of a ring, the last one only as a next row."""
        group: list[tuple] = []
        size, head, done = 0, None, False
        for batch in batches:
            for ring, tail, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if group and ring != group[-1][0]:
                    if not done:
                        yield [*group, head]
                    group, size, done = [], 0, False
                if done:
                    continue
                if not group:
                    head = (ring, tail, doc_id, text)
                group.append((ring, tail, doc_id, text))
                size += len(text)
                if tail:
                    yield group
                    done, group = True, group[-1:]
                elif len(group) > 1 and (size >= textbuf.SLICE_BYTES or len(group) > _MOST_ROWS):  # a long text waits for its next
                    yield group
                    group, size = group[-1:], 0
        if group and not done:
            yield [*group, head]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in rows(batches):
            texts = [g[3] for g in group]
            edits = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:], strict=False)]
            own, new = _registers_of(texts, bins, bits, words), _registers_of(edits, bins, bits, words)
            columns = [
                pa.array([g[2] for g in group[:-1]], pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edits]),
                pa.array(as_hex(own[:-1], bits)),
                pa.array(as_hex(new, bits)),
                pa.array(likeness(own[:-1], new, bits)),
                pa.array(likeness(own[:-1], own[1:], bits)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return _rings(docs).mapInArrow(textbuf.lean(run), RESULT)
