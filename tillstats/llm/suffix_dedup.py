"""Removal of byte strings that repeat from document to document, by depth-limited radix sort.

Suffixes are ordered only through ``length`` bytes. The first digit is the
minimizer: of the ``length - GRAM + 1`` grams in the window that opens a suffix, the one whose scrambled
value is least, with its place. Equal windows have equal minimizers at equal places, so
this digit deals windows to partitions; a run of neighbouring windows with one minimizer travels as one
string. The further digits are the window's bytes, eight at a time, most
significant first; after each pass only groups of two windows or more are sorted on. What
is equal after the last pass is a repeated window.

Documents are dealt to chunks by id. Tasks send one entry per chunk and distinct
minimizer (then distinct string), whatever the number of documents in the chunk that hold it, and answers
return to the chunk; so a passage in a third of all documents costs a row per chunk.

A minimizer with far more distinct strings than others (a common phrase in ever new surroundings) would send them all to
one task. One that holds more than an eighth of its partition's strings, 50,000 of them at most, has its windows dealt by their
next digit instead, all of their bytes, so that each distinct window travels alone, once a chunk, and a hot phrase spreads over all partitions.

1. chunk -> distinct minimizers with the number of their strings; a minimizer that only one document holds cannot open a repeated window.
2. chunk + live minimizers -> strings of the windows they open, with the chunk's smallest document.
3. radix sort; answer, per string, a bit per window: it also starts in a smaller document of another chunk.
4. chunk + live minimizers + answers -> the bytes to remove, judged on the input.

Defined results: a null text counts as empty; an empty or short text loses nothing; a repeat
within one document stays; rows that repeat an id count as that one document and lose nothing to each other; a
null id orders before all others. Removal works on bytes; ``text`` of ``trim`` leaves out fragments of
characters that a removal cut through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textbuf

#: Bytes of a gram; windows must be at least as long.
GRAM = 20
#: The digit's bits that travel with a minimizer, beside its partition.
_BITS = np.uint64(40)
_LEAST = np.iinfo(np.int64).min
#: Window starts worked on at once.
BLOCK = 1 << 20
#: Share of a partition's distinct strings (counted by chunk, rounded down to a power of two) from which a minimizer is hot,
#: and the least and most strings that this stands for.
HOT_SHARE, LEAST_HOT, MOST_STRINGS = 1 / 8, 256, 50_000
#: Windows ordered at once within a partition.
_MOST_WINDOWS = 400_000
MESSAGES = "to int, chunk int, body binary"
ANSWERS = "chunk int, kind int, to int, body binary"


def minimizers(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values, the place of its least one (the last of equals)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # doubling: least over 1, 2, 4, ... values, then two overlapping runs
    span, at = 1, np.arange(len(values))
    while 2 * span <= width:
        left, right = at[:-span], at[span:]
        at = np.where(values[left] < values[right], left, right)
        span *= 2
    left, right = at[:n], at[width - span : width - span + n]
    return np.where(values[left] < values[right], left, right)


_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for the places of a block; odd numbers have inverses."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.full(BLOCK + 128, np.uint64(base))
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


class SpanHash:
    """64-bit hashes of any spans of a block after one pass over it. They order and deal; equality is judged by bytes."""

    def __init__(self, data: np.ndarray):
        up, self._down = _powers()
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[: len(data)], out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return textbuf.mix((self._sums[ends] - self._sums[starts]) * self._down[starts] + (ends - starts).astype(np.uint64) * _TABLE[0])


class Strings:
    """The strings of a chunk's documents: runs of neighbouring windows of one document with one minimizer.

    For each its first window's start and document, the number of windows, the place of the gram from the
    start, the gram's scrambled value, and a hash of the string and that place. Worked out for blocks of window
    starts, wherever documents end; a run that a block's end parts is two strings, which changes no window.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, length: int):
        parts = [self._of(data, offs, lo, length) for lo in range(0, len(data), BLOCK)]
        kinds = (np.int64, np.int32, np.uint8, np.uint8, np.uint64, np.uint64)
        columns = zip(*parts, strict=True) if parts else [()] * 6
        self.start, self.doc, self.count, self.gram, self.key, self.hash = (np.concatenate([np.zeros(0, k), *c], dtype=k) for c, k in zip(columns, kinds, strict=True))

    @staticmethod
    def _of(data: np.ndarray, offs: np.ndarray, lo: int, length: int) -> tuple[np.ndarray, ...]:
        hi = min(len(data), lo + BLOCK + length - 1)
        n = hi - lo - length + 1
        if n <= 0:
            return (np.zeros(0, np.int64), np.zeros(0, np.int32)) + (np.zeros(0, np.uint8),) * 2 + (np.zeros(0, np.uint64),) * 2
        first, last = int(np.searchsorted(offs, lo, "right")) - 1, int(np.searchsorted(offs, hi, "left"))
        size = np.diff(np.clip(offs[first : last + 1], lo, hi))
        doc = np.repeat(np.arange(first, last, dtype=np.int32), size)[:n]
        end = np.repeat(offs[first + 1 : last + 1] - lo, size)[:n]
        hashed = SpanHash(data[lo:hi])
        every = np.arange(hi - lo - GRAM + 1)
        values = hashed(every, every + GRAM)
        at = minimizers(values, length - GRAM + 1)
        start = np.flatnonzero(every[:n] + length <= end)
        doc, at = doc[start], at[start]
        new = np.ones(len(start), bool)
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(new)))
        start, at = start[first], at[first]
        gram = (at - start).astype(np.uint8)
        whole = hashed(start, start + count + length - 1) ^ textbuf.mix(gram.astype(np.uint64))
        return start + lo, doc[first], count.astype(np.uint8), gram, values[at], whole


def window_hashes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A hash of each window's bytes, eight at a time."""
    padded = np.zeros((len(starts), -(-length // 8) * 8), np.uint8)
    padded[:, :length] = data[starts[:, None] + np.arange(length)]
    out = np.full(len(starts), _TABLE[1])
    for column in padded.view("<u8").T:
        out = textbuf.mix(out ^ column.astype(np.uint64)) + _TABLE[2]
    return out


def _split(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Partition of each key and the digits kept beside it."""
    return (keys % np.uint64(parts)).astype(np.int32), (keys >> (np.uint64(64) - _BITS))


def _five(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].reshape(-1)


def _from_five(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = raw.reshape(-1, 5)
    return out.view("<u8").reshape(-1).astype(np.uint64)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


def _flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n, bitorder="little").astype(bool)


def _body(*parts: bytes) -> bytes:
    """Parts behind a table of their sizes."""
    return np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def _parts(raw: bytes) -> list[bytes]:
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.append(4 + 4 * n, np.frombuffer(raw, "<u4", n, 4))).tolist()
    return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Chunk:
    """The documents of one chunk in ascending order of id, then text."""

    def __init__(self, table: pa.Table, length: int):
        order = pc.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")], null_placement="at_start")
        self.table, self.length = table.take(order), length
        ids = self.table.column("doc_id")
        self.null = ids.is_null().to_numpy()
        self.ids = ids.fill_null(_LEAST).to_numpy()
        self.data, self.offs = textbuf.buffer_of(self.table.column("text"))

    def all_strings(self) -> Strings:
        return Strings(self.data, self.offs, self.length)

    def announced(self, parts: int) -> Iterator[tuple[int, bytes]]:
        """(partition, body): distinct minimizers, whether several documents of the chunk hold each, and the length in bits of its count of strings."""
        w = self.all_strings()
        if not len(w.key):
            return
        order = np.lexsort((w.hash, w.key))
        key, hashed = w.key[order], w.hash[order]
        new = np.append(True, key[1:] != key[:-1])
        other = new | np.append(True, hashed[1:] != hashed[:-1])
        first = np.flatnonzero(new)
        doc = w.doc[order]  # equal ids are neighbours, so the outermost documents tell
        several = self.ids[np.minimum.reduceat(doc, first)] != self.ids[np.maximum.reduceat(doc, first)]
        bits = np.frexp(np.add.reduceat(other, first, dtype=np.int64).astype(float))[1].astype(np.uint8)
        part, digit = _split(key[first], parts)
        order = np.lexsort((digit, part))
        part, digit, several, bits = part[order], digit[order], several[order], bits[order]
        bounds = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        for lo, hi in zip(bounds, np.append(bounds[1:], len(part)), strict=True):
            yield int(part[lo]), _body(_five(digit[lo:hi]).tobytes(), _bits(several[lo:hi]), bits[lo:hi].tobytes())

    def strings(self, parts: int, live: dict[int, bytes]) -> dict:
        """The distinct strings behind live minimizers, in single windows behind hot ones."""
        w = self.all_strings()
        part, digit = _split(w.key, parts)
        alive, hot = np.zeros((2, len(part)), bool)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        for p, body in live.items():
            raw, flags = _parts(body)
            digits = _from_five(np.frombuffer(raw, np.uint8))  # ascending
            own = order[bounds[p] : bounds[p + 1]]
            at = np.minimum(np.searchsorted(digits, digit[own]), len(digits) - 1)
            alive[own] = digits[at] == digit[own]
            hot[own] = alive[own] & _flags(flags, len(digits))[at]
        split = np.flatnonzero(hot)
        rows = np.repeat(split, w.count[split])
        turn = textbuf.ragged(np.zeros(len(split), np.int64), w.count[split].astype(np.int64))
        start = w.start[rows] + turn
        hashed = np.concatenate([np.zeros(0, np.uint64), *(window_hashes(self.data, start[k : k + 20_000], self.length) for k in range(0, len(start), 20_000))])
        alone = _split(hashed, parts)
        alive &= ~hot
        columns = {
            "part": (part[alive], alone[0]), "digit": (digit[alive], alone[1]), "start": (w.start[alive], start), "doc": (w.doc[alive], w.doc[rows]),
            "count": (w.count[alive], np.ones(len(rows), np.uint8)), "minimizer": (w.gram[alive], (w.gram[rows] - turn).astype(np.uint8)), "hash": (w.hash[alive], textbuf.mix(hashed)),
        }
        s = {name: np.concatenate(c) for name, c in columns.items()}
        s["count"] = s["count"].astype(np.int64)
        s["size"] = s["count"] + self.length - 1
        # equal strings of the chunk are one: same bytes, same gram, same digit; equal hashes first, then the bytes themselves
        _, once, number = np.unique(s.pop("hash"), return_index=True, return_inverse=True)
        if not (self._same(s["start"], s["size"], s["minimizer"], once[number]) and np.array_equal(s["digit"], s["digit"][once[number]])):
            _, once, number = np.unique(self._exact(s["start"], s["size"], s["minimizer"], s["digit"]), return_index=True, return_inverse=True)
        least = np.full(len(once), np.iinfo(np.int32).max, np.int32)
        np.minimum.at(least, number, s["doc"])  # documents ascend by id
        return s | {"number": number, "once": once, "head": least[number]}

    def _same(self, start: np.ndarray, size: np.ndarray, minimizer: np.ndarray, other: np.ndarray) -> bool:
        """Whether each string equals the string ``other`` names."""
        if not (np.array_equal(size, size[other]) and np.array_equal(minimizer, minimizer[other])):
            return False
        for lo in range(0, len(start), 20_000):
            own = slice(lo, lo + 20_000)
            if not np.array_equal(self.data[textbuf.ragged(start[own], size[own])], self.data[textbuf.ragged(start[other[own]], size[own])]):
                return False
        return True

    def _exact(self, start: np.ndarray, size: np.ndarray, minimizer: np.ndarray, digit: np.ndarray) -> np.ndarray:
        """Numbers of equal strings by their bytes, where hashes have collided."""
        raw, seen = self.data.tobytes(), {}
        return np.array([seen.setdefault((m, d, raw[s : s + n]), len(seen)) for s, n, m, d in zip(start.tolist(), size.tolist(), minimizer.tolist(), digit.tolist(), strict=True)])

    def sent(self, parts: int, live: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        """(partition, body): the distinct strings with their digit, gram place and smallest document."""
        s = self.strings(parts, live)
        for part, own in _by_part(s, parts):
            size = s["size"][own]
            text = self.data[textbuf.ragged(s["start"][own], size)]
            ids = self.ids[s["head"][own]].astype("<i8")
            yield part, _body(_five(s["digit"][own]).tobytes(), s["minimizer"][own].tobytes(), size.astype(np.uint8).tobytes(), ids.tobytes(), text.tobytes())

    def covered(self, parts: int, live: dict[int, bytes], answers: dict[int, bytes]) -> np.ndarray:
        """Which bytes lie in a window that also starts in a smaller document."""
        s = self.strings(parts, live)
        smaller = np.zeros(len(s["once"]), np.uint64)  # by string: a bit per window
        for part, own in _by_part(s, parts):
            if part in answers:
                at, bits = _parts(answers[part])
                smaller[s["number"][own][np.frombuffer(at, "<u4")]] = np.frombuffer(bits, "<u8")
        repeated = self.ids[s["doc"]] > self.ids[s["head"]]
        step = np.zeros(len(self.data) + 1, np.int8)  # windows start but once at a place, and 50 or so overlap at most
        for lo in range(0, len(s["start"]), 20_000):
            own = slice(lo, lo + 20_000)
            count = s["count"][own]
            rows = np.repeat(np.arange(len(count)), count)
            window = textbuf.ragged(np.zeros(len(count), np.int64), count)
            hit = (smaller[s["number"][own]][rows] >> window.astype(np.uint64) & np.uint64(1)).astype(bool) | repeated[own][rows]
            starts = s["start"][own][rows[hit]] + window[hit]
            step[starts] += 1
            step[starts + self.length] -= 1
        return np.cumsum(step[:-1], dtype=np.int8, out=step[:-1]) > 0


def _by_part(s: dict, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """The distinct strings by partition, in a fixed order."""
    once = s["once"][np.argsort(s["part"][s["once"]], kind="stable")]
    part = s["part"][once]
    if not len(part):
        return
    bounds = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for lo, hi in zip(bounds, np.append(bounds[1:], len(part)), strict=True):
        yield int(part[lo]), once[lo:hi]


def alive(bodies: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """Of the minimizers that chunks announced to one partition, per chunk those that two documents hold, and which of them are hot."""
    digits, several, bits, chunk = [], [], [], []
    for c, body in bodies:
        raw, flags, length = _parts(body)
        digits.append(_from_five(np.frombuffer(raw, np.uint8)))
        several.append(_flags(flags, len(digits[-1])))
        bits.append(np.frombuffer(length, np.uint8))
        chunk.append(np.full(len(digits[-1]), c, np.int32))
    digit, many, length, owner = (np.concatenate(x) for x in (digits, several, bits, chunk))
    order = np.argsort(digit, kind="stable")
    digit, many, length, owner = digit[order], many[order], length[order], owner[order]
    first = np.flatnonzero(np.append(True, digit[1:] != digit[:-1]))
    count = np.diff(np.append(first, len(digit)))
    live = np.repeat((count > 1) | np.logical_or.reduceat(many, first), count)
    strings = np.add.reduceat(np.int64(1) << (length.astype(np.int64) - 1), first)
    limit = min(MOST_STRINGS, max(LEAST_HOT, HOT_SHARE * strings[live[first]].sum()))
    hot = np.repeat(strings > limit, count)
    digit, hot, owner = digit[live], hot[live], owner[live]
    order = np.argsort(owner, kind="stable")
    digit, hot, owner = digit[order], hot[order], owner[order]
    if not len(owner):
        return []
    bounds = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    return [(int(owner[lo]), _body(_five(digit[lo:hi]).tobytes(), _bits(hot[lo:hi]))) for lo, hi in zip(bounds, np.append(bounds[1:], len(owner)), strict=True)]


def radix_groups(text: np.ndarray, starts: np.ndarray, groups: np.ndarray, length: int) -> np.ndarray:
    """Refines ``groups`` of windows by their bytes, eight a pass, most significant first.

    Returns for each window the number of its group of equal windows, -1 for a window without equal.
    """
    out = np.full(len(starts), -1, np.int64)
    order = np.argsort(groups, kind="stable")
    bounds = groups[order]
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    for depth in range(-8, length, 8):
        if depth >= 0:
            at = starts[order] + depth
            digit = np.zeros(len(order), np.uint64)
            for k in range(min(8, length - depth)):
                digit = digit << np.uint64(8) | padded[at + k]
            mixed = np.flatnonzero(np.append(False, (bounds[1:] == bounds[:-1]) & (digit[1:] != digit[:-1])))
            if len(mixed):
                again = np.zeros(int(bounds[-1]) + 1, bool)  # bounds ascend
                again[bounds[mixed]] = True
                own = np.flatnonzero(again[bounds])
                turn = own[np.lexsort((digit[own], bounds[own]))]
                order[own], digit[own] = order[turn], digit[turn]
            new = np.append(True, (bounds[1:] != bounds[:-1]) | (digit[1:] != digit[:-1]))
        else:
            new = np.append(True, bounds[1:] != bounds[:-1])
        bounds = np.cumsum(new)
        size = np.bincount(bounds)[bounds]
        order, bounds = order[size > 1], bounds[size > 1]
        if not len(order):
            return out
    out[order] = bounds
    return out


def judged(bodies: list[tuple[int, bytes]], length: int) -> list[tuple[int, bytes]]:
    """Radix-sorts the windows of the strings sent to one partition; per chunk the answers."""
    cells = [(c, *_parts(b)) for c, b in bodies]
    digit = np.concatenate([_from_five(np.frombuffer(x[1], np.uint8)) for x in cells])
    gram = np.concatenate([np.frombuffer(x[2], np.uint8) for x in cells]).astype(np.int64)
    size = np.concatenate([np.frombuffer(x[3], np.uint8) for x in cells]).astype(np.int64)
    ids = np.concatenate([np.frombuffer(x[4], "<i8") for x in cells])
    text = np.concatenate([np.frombuffer(x[5], np.uint8) for x in cells])
    chunk = np.repeat([x[0] for x in cells], [len(x[3]) for x in cells])
    place = np.concatenate([np.arange(len(x[3])) for x in cells])
    start = np.cumsum(size) - size
    count = size - length + 1
    bits = np.zeros(len(size), np.uint64)
    order = np.argsort(digit, kind="stable")
    upto = np.cumsum(count[order])
    lo = 0
    while lo < len(order):
        # whole digits at a time, so that equal windows meet
        hi = int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _MOST_WINDOWS, "right"))
        hi = min(len(order), max(hi, lo + 1))
        while hi < len(order) and digit[order[hi]] == digit[order[hi - 1]]:
            hi += 1
        own = order[lo:hi]
        row = np.repeat(own, count[own])
        window = textbuf.ragged(np.zeros(len(own), np.int64), count[own])
        first = digit[row] * np.uint64(length) + (gram[row] - window).astype(np.uint64)
        group = radix_groups(text, start[row] + window, first, length)
        some = np.flatnonzero(group >= 0)
        if len(some):
            least = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, group[some], ids[row[some]])
            hit = some[least[group[some]] < ids[row[some]]]
            np.bitwise_or.at(bits, row[hit], np.uint64(1) << window[hit].astype(np.uint64))
        lo = hi
    hit = np.flatnonzero(bits)
    hit = hit[np.argsort(chunk[hit], kind="stable")]
    first = np.flatnonzero(np.append(True, chunk[hit[1:]] != chunk[hit[:-1]])) if len(hit) else hit
    ends = np.append(first[1:], len(hit))
    return [(int(chunk[hit[a]]), _body(place[hit[a:b]].astype("<u4").tobytes(), bits[hit[a:b]].astype("<u8").tobytes())) for a, b in zip(first, ends, strict=False)]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """The messages of each partition, which arrive sorted by it."""
    to, own = None, []
    for batch in batches:
        for t, c, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if t != to and own:
                yield to, own
                own = []
            to = t
            own.append((c, body))
    if own:
        yield to, own


def _table(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.table([pa.array(c, k) for c, (_, k) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


_MESSAGE = [("to", pa.int32()), ("chunk", pa.int32()), ("body", pa.binary())]
_ANSWER = [("chunk", pa.int32()), ("kind", pa.int32()), ("to", pa.int32()), ("body", pa.binary())]


def spans(docs: DataFrame, make, schema, length: int = 50, keep: tuple[str, ...] = ()) -> DataFrame:
    """Applies ``make(chunk, covered)``, which returns an Arrow table, to each chunk of ``docs`` (doc_id, text).

    The columns ``keep`` come along as ``keep0``, ``keep1`` and so on.
    """
    if not GRAM <= length <= 64 + GRAM - 2:
        raise ValueError(f"length must lie between {GRAM} and {64 + GRAM - 2}")
    parts = common.partitions(docs.sparkSession, docs.select("doc_id", "text"))
    dealt = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("chunk"), "doc_id", F.coalesce("text", F.lit("")).alias("text"), *(F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(keep)))
    chunks = dealt.repartition(parts, "chunk")

    def freed(table: pa.Table) -> pa.Table:
        textbuf.release()
        return table

    def announce(key, table):
        return freed(_table([(to, key[0].as_py(), body) for to, body in Chunk(table, length).announced(parts)], _MESSAGE))

    def live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for to, bodies in _gathered(batches):
            yield from _table([(c, 0, to, body) for c, body in alive(bodies)], _ANSWER).to_batches()

    def back(answers: pa.Table) -> tuple[dict[int, bytes], dict[int, bytes]]:
        rows = answers.to_pylist()
        return {r["to"]: r["body"] for r in rows if not r["kind"]}, {r["to"]: r["body"] for r in rows if r["kind"]}

    def send(key, table, answers):
        return freed(_table([(to, key[0].as_py(), body) for to, body in Chunk(table, length).sent(parts, back(answers)[0])] if len(table) and len(answers) else [], _MESSAGE))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for to, bodies in _gathered(batches):
            yield from _table([(c, 1, to, b) for c, b in judged(bodies, length)], _ANSWER).to_batches()

    def finish(key, table, answers):
        chunk = Chunk(table, length)
        found, judgements = back(answers)
        return freed(make(chunk, chunk.covered(parts, found, judgements) if found else np.zeros(len(chunk.data), bool)))

    message, answer = MESSAGES, ANSWERS
    said = chunks.groupBy("chunk").applyInArrow(announce, message)
    alive_ = said.repartition(parts, "to").sortWithinPartitions("to", "chunk").mapInArrow(textbuf.lean(live), answer)
    strings = chunks.groupBy("chunk").cogroup(alive_.groupBy("chunk")).applyInArrow(send, message)
    hits = strings.repartition(parts, "to").sortWithinPartitions("to", "chunk").mapInArrow(textbuf.lean(judge), answer)
    return chunks.groupBy("chunk").cogroup(alive_.union(hits).groupBy("chunk")).applyInArrow(finish, schema)


def _runs(chunk: Chunk, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Removed bytes and maximal removed runs of each document."""
    removed, runs = np.zeros((2, len(chunk.offs) - 1), np.int64)
    for lo, hi in textbuf.slices(chunk.offs):
        offs = chunk.offs[lo : hi + 1] - chunk.offs[lo]
        own = covered[chunk.offs[lo] : chunk.offs[hi]]
        opens = own.copy()
        opens[1:] &= ~own[:-1]
        heads = offs[:-1][np.diff(offs) > 0]
        opens[heads] = own[heads]
        removed[lo:hi] = np.diff(np.append(0, np.cumsum(own))[offs])
        runs[lo:hi] = np.diff(np.append(0, np.cumsum(opens))[offs])
    return removed, runs


def _kept(chunk: Chunk, covered: np.ndarray) -> Iterator[bytes]:
    """What is left of each document."""
    for lo, hi in textbuf.slices(chunk.offs):
        left = ~covered[chunk.offs[lo] : chunk.offs[hi]]
        raw = chunk.data[chunk.offs[lo] : chunk.offs[hi]][left].tobytes()
        upto = np.append(0, np.cumsum(left))[chunk.offs[lo : hi + 1] - chunk.offs[lo]].tolist()
        yield from (raw[a:b] for a, b in zip(upto[:-1], upto[1:], strict=True))


def digests(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row."""

    def make(chunk: Chunk, covered: np.ndarray) -> pa.Table:
        removed, runs = _runs(chunk, covered)
        kept = [hashlib.sha256(k).hexdigest() for k in _kept(chunk, covered)]
        ids = pa.array(chunk.ids, pa.int64(), mask=chunk.null)
        return pa.table([ids, pa.array(np.diff(chunk.offs)), pa.array(removed), pa.array(runs), pa.array(kept, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return spans(docs, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length)


def trimmed(docs: DataFrame, length: int = 50) -> DataFrame:
    """All columns of ``docs``; ``text`` is what is left, without characters that a removal cut through."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))

    def make(chunk: Chunk, covered: np.ndarray) -> pa.Table:
        left = [k.decode("utf-8", "ignore") for k in _kept(chunk, covered)]
        ids = pa.array(chunk.ids, pa.int64(), mask=chunk.null)
        return pa.table([ids, pa.array(left, pa.string()), *(chunk.table.column(f"keep{i}") for i in range(len(others)))], names=["doc_id", "text", *others])

    return spans(docs, make, docs.select("doc_id", "text", *others).schema, length, others).select(*docs.columns)
