"""Best-fit packing of token sequences under several capacities at once.

A bin (sequence) has three capacities: tokens, documents (pieces) and attention
cost (the sum of squared piece lengths). All three demands of a piece follow from
its length, so the corpus is summed up as a histogram of lengths, which never has
more than ``capacity`` rows whatever the corpus. The driver packs that histogram
by vector best-fit in descending length; bins that look alike stay one group with
a multiplicity, so the work depends on the number of lengths, not of pieces. The
plan's events (so many pieces of one length go to so many neighbouring bins at
one offset) are then dealt to the pieces by their rank within their length.

Defined results: a null text counts as empty (one piece, the end id); ties in
length are dealt in (bucket, doc_id, piece) order, repeated rows in any order
since they are alike; an empty table gives no pieces. Only the id and text
columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, textbuf, tokens

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bucket int"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


@dataclass(frozen=True)
class Capacities:
    """What a bin holds at most; None leaves a dimension out. ``weights`` say how much each dimension's room counts in a bin's score."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)


#: A training sequence. Neither further capacity can refuse what 2048 tokens admit, but both weigh in the choice of a bin.
SEQUENCE = Capacities(tokens=2048, documents=2048, attention=2048**2, weights=(1.0, 0.25, 0.5))


class _Bins:
    """Open bins by what is left in them: a row of ``left`` for each state, and the ranges [first bin, bins, offset] in it."""

    def __init__(self, dims: int):
        self.left, self.size = np.full((1024, dims), -1.0), 0
        self.ranges: list[list[list[int]]] = []
        self.row: dict[tuple[float, ...], int] = {}
        self.free: list[int] = []

    def add(self, left: np.ndarray, found: list[int]) -> None:
        key = tuple(left.tolist())
        at = self.row.get(key)
        if at is None:
            if self.free:
                at = self.free.pop()
            else:
                at, self.size = self.size, self.size + 1
                self.ranges.append([])
                if self.size > len(self.left):
                    self.left = np.concatenate([self.left, np.full_like(self.left, -1.0)])
            self.row[key], self.left[at] = at, left
        self.ranges[at].append(found)

    def take(self, at: int, most: int) -> tuple[int, int, int, np.ndarray]:
        """Up to ``most`` bins of a state: first, bins, offset, what was left in them."""
        left, ranges = self.left[at].copy(), self.ranges[at]
        first, n, offset = ranges.pop()
        if n > most:
            ranges.append([first + most, n - most, offset])
        if not ranges:
            del self.row[tuple(left.tolist())]
            self.left[at] = -1.0  # fits nothing
            self.free.append(at)
        return first, min(n, most), offset, left

    def best(self, need: np.ndarray, weight: np.ndarray, score: str) -> int | None:
        """The state with room for ``need`` that scores best, the first of equals."""
        states = self.left[: self.size]
        fits = np.flatnonzero((states >= need).all(axis=1))
        if not len(fits):
            return None
        room = states[fits]
        # weight holds w / cap^2: squares of relative room, or products of relative room and demand
        return int(fits[((room - need) ** 2 @ weight).argmin() if score == "norm" else (room * need @ weight).argmax()])


def plan(lengths: np.ndarray, counts: np.ndarray, capacities: Capacities = Capacities(), score: str = "norm") -> dict[str, np.ndarray]:
    """Packs ``counts[i]`` pieces of ``lengths[i]``; one row per event: length, rank (of the first piece), pieces, sequence, offset.

    ``score`` picks the bin: ``norm`` takes the smallest weighted norm of what is
    left after placing, ``dot`` the largest weighted dot product of demand and
    room, both as shares of the capacities. Only bins with room in every dimension are candidates; a new bin opens if none has.
    """
    if score not in ("norm", "dot"):
        raise ValueError(f"unknown score {score!r}")
    limits = (capacities.tokens, capacities.documents, capacities.attention)
    used = [k for k, c in enumerate(limits) if c]
    cap = np.array([limits[k] for k in used], float)
    weight = np.array([capacities.weights[k] for k in used]) / cap**2
    open_, events, bins = _Bins(len(used)), [], 0
    for length, count in sorted(zip(map(int, lengths), map(int, counts), strict=True), reverse=True):
        need = np.array([length, 1.0, float(length) ** 2])[used]
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        rank = 0
        while count:
            at = open_.best(need, weight, score)
            if at is not None:
                first, take, offset, left = open_.take(at, count)
            else:
                each = max(1, min(count, int(np.floor(cap / need).min())))
                take, first, offset, left = max(1, count // each), bins, 0, cap
                bins += take
            events.append((length, rank, take, first, offset))
            rank, count = rank + take, count - take
            open_.add(left - need, [first, take, offset + length])
    rows = np.array(events, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "pieces", "sequence", "offset"), rows.T, strict=True))


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, buckets: int | None = None) -> DataFrame:
    """The pieces of each document's ids, cut only where they exceed ``capacity``."""
    n = buckets or common.partitions(docs.sparkSession, docs.select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, ids, bounds in tokens.encoded(batch.column(1), path, end):
                size = np.diff(bounds)
                cuts = -(-size // capacity)
                doc = np.repeat(np.arange(hi - lo), cuts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * capacity
                length = np.minimum(capacity, size[doc] - start)
                at = bounds[doc] + start
                sums = [tokens.crc32(ids[a : a + k]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
                own = batch.column(0).slice(lo, hi - lo).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), batch.column(2).slice(lo, hi - lo).take(pa.array(doc))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "bucket"],
                )

    rows = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("bucket"))
    return rows.mapInArrow(textbuf.lean(run), PIECES)


def place(pieces_: DataFrame, capacities: Capacities = Capacities(), score: str = "norm") -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, bucket and more).

    ``pieces_`` is read three times, so it should be a written table.
    """
    per_bucket = pieces_.groupBy("bucket", "length").agg(F.count("*").alias("n"))
    histogram = common.gathered(per_bucket.groupBy("length").agg(F.sum("n").alias("n")))  # at most capacities.tokens rows
    events = plan(histogram["length"], histogram["n"], capacities, score)
    order = np.lexsort((events["rank"], events["length"]))
    lengths, ranks, first, offsets = (events[k][order] for k in ("length", "rank", "sequence", "offset"))
    # one sorted key for (length, rank): ranks stay far below 2**44
    keys = (lengths << 44) + ranks
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select("bucket", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank0"))
    own = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces_.withColumn("rank", F.row_number().over(own).cast("long") - 1).join(starts, ["bucket", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            length, rank = column["length"].to_numpy(), column["rank"].to_numpy()
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            kept = [column[k] for k in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(first[at] + rank - ranks[at]), pa.array(offsets[at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("rank0")).alias("rank")).mapInArrow(textbuf.lean(run), PLACED)


def pack(docs: DataFrame, path: str, capacities: Capacities = Capacities(), end: int = 0, score: str = "norm") -> DataFrame:
    """Tokenizes, cuts and packs whole documents."""
    return place(common.cut(pieces(docs, path, capacities.tokens, end)), capacities, score)
