"""Tokenizing with a memory of chunks already seen.

A tokenizer that never lets a token cross certain boundaries gives for a text
the ids of its chunks, one after another. Chunks repeat far more than texts do,
so each is given to the library once per worker and its ids are copied from
then on by array operations. A keyed hash finds a chunk in the memory and its
bytes, kept there, confirm it; a chunk whose hash another one holds is encoded anew each time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import textbuf

#: Chunks remembered by one worker before it starts anew (some 50 bytes each), and the bytes of those worth remembering.
MOST_CHUNKS, MOST_BYTES = 1_000_000, 128


Encoded = tuple[np.ndarray, np.ndarray]


def one_by_one(encode: Callable[[list[str]], list[list[int]]]) -> Callable[[np.ndarray, np.ndarray, np.ndarray], Encoded]:
    """Encodes chunks (bytes, starts, ends) by a function of strings; the ids of all and how many each has."""

    def run(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Encoded:
        whole = raw.tobytes()
        ids = encode([whole[s:e].decode("utf-8", "replace") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((i for row in ids for i in row), np.uint32, int(count.sum())), count

    return run


def marked(encode: Callable[[list[str]], list[list[int]]], group: int = 200) -> Callable[[np.ndarray, np.ndarray, np.ndarray], Encoded]:
    """As ``one_by_one`` for an encoder whose ids never cross a blank: many chunks a string, parted by a mark of one known id.

    The mark is U+0000 between blanks. Chunks that hold it themselves are encoded alone.
    """
    alone, known = one_by_one(encode), []

    def run(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Encoded:
        if not known:
            known.extend(encode(["\0"])[0])
        size = ends - starts
        odd = np.zeros(len(starts), bool)
        zeros = np.flatnonzero(raw == 0)
        if len(known) != 1:
            odd[:] = True
        elif len(zeros):
            odd = np.searchsorted(zeros, starts) < np.searchsorted(zeros, ends)
        plain = np.flatnonzero(~odd)
        n = size[plain]
        at = np.cumsum(n + 3) - (n + 3)
        text = np.full(int((n + 3).sum()), 0x20, np.uint8)
        text[textbuf.ragged(at, n)] = raw[textbuf.ragged(starts[plain], n)]
        text[at + n + 1] = 0
        whole, bounds = text.tobytes(), [*at[::group].tolist(), len(text)]
        rows = encode([whole[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]) if len(plain) else []
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(r, np.uint32) for r in rows)])
        marks = np.flatnonzero(ids == known[0]) if known else np.zeros(0, np.int64)
        if len(marks) != len(plain):
            return alone(raw, starts, ends)
        count = np.zeros(len(starts), np.int64)
        count[plain] = np.diff(np.append(-1, marks)) - 1
        found = np.delete(ids, marks)
        if not odd.any():
            return found, count
        others = np.flatnonzero(odd)
        more, count[others] = alone(raw, starts[others], ends[others])
        own = np.zeros(len(starts), np.int64)
        own[plain] = np.cumsum(count[plain]) - count[plain]
        own[others] = np.cumsum(count[others]) - count[others] + len(found)
        return np.concatenate([found, more])[textbuf.ragged(own, count)], count

    return run


class ChunkEncoder:
    """``encode`` maps chunks (bytes, starts, ends) to ids and counts; ``split`` maps (data, offs) to chunk bytes, lengths and chunks of each document.

    ``cuts`` gives places where a text may be cut; with it a long text is read in parts of a slice's size.
    """

    def __init__(self, encode: Callable[[np.ndarray, np.ndarray, np.ndarray], Encoded], split: Callable, most: int = MOST_CHUNKS, cuts: Callable[[np.ndarray], np.ndarray] | None = None):
        self._encode, self._split, self._most, self._cuts = encode, split, most, cuts
        self._forget()

    def _forget(self) -> None:
        self._keys = np.zeros(0, np.uint64)  # ascending; the other columns follow it
        self._place, self._size, self._at, self._count = (np.zeros(0, np.int32) for _ in range(4))
        self._bytes, self._ids = np.zeros(0, np.uint8), np.zeros(0, np.uint32)

    def _found(self, keys: np.ndarray, raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each chunk's key lies in the memory, and whether the chunk there is the same."""
        at = np.searchsorted(self._keys, keys)
        same = at < len(self._keys)
        same[same] = (self._keys[at[same]] == keys[same]) & (self._size[at[same]] == size[same])
        own = np.flatnonzero(same)
        if len(own):
            n = size[own]
            equal = raw[textbuf.ragged(starts[own], n)] == self._bytes[textbuf.ragged(self._place[at[own]].astype(np.int64), n)]
            same[own] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
        return at, same

    def _remember(self, keys: np.ndarray, raw: np.ndarray, starts: np.ndarray, size: np.ndarray, ids: np.ndarray, at: np.ndarray, count: np.ndarray) -> None:
        _, first = np.unique(keys, return_index=True)
        first = first[size[first] <= MOST_BYTES]
        place = np.searchsorted(self._keys, keys[first])
        free = place == len(self._keys)
        free[~free] = self._keys[place[~free]] != keys[first[~free]]
        first, place = first[free], place[free]
        n, c = size[first], count[first]
        self._place = np.insert(self._place, place, np.cumsum(n) - n + len(self._bytes))
        self._at = np.insert(self._at, place, np.cumsum(c) - c + len(self._ids))
        self._keys, self._size, self._count = np.insert(self._keys, place, keys[first]), np.insert(self._size, place, n), np.insert(self._count, place, c)
        self._bytes = np.concatenate([self._bytes, raw[textbuf.ragged(starts[first], n)]])
        self._ids = np.concatenate([self._ids, ids[textbuf.ragged(at[first], c)]])

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents of a slice as uint32, and each document's bounds."""
        if self._cuts is None or len(offs) != 2 or len(data) <= 2 * textbuf.SLICE_BYTES:
            return self._encoded(data, offs)
        found, lo = [], 0
        while lo < len(data):
            hi = min(len(data), lo + textbuf.SLICE_BYTES)
            while hi < len(data):
                at = self._cuts(data[lo:hi])
                if len(at):
                    hi = lo + int(at[-1])
                    break
                hi = min(len(data), 2 * hi - lo)
            found.append(self._encoded(data[lo:hi], np.array([0, hi - lo]))[0])
            lo = hi
        ids = np.concatenate(found)
        return ids, np.array([0, len(ids)])

    def _encoded(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, lengths, chunks = self._split(data, offs)
        if not len(lengths):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        number, distinct = textbuf.numbered(textbuf.strings(raw, lengths))
        raw, bounds = textbuf.buffer_of(distinct)
        starts, size = bounds[:-1], np.diff(bounds)
        keys = textbuf.keyed(raw, starts, bounds[1:])
        place, known = self._found(keys, raw, starts, size)
        new = np.flatnonzero(~known)
        pool, at, count = self._ids, np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at[known], count[known] = self._at[place[known]], self._count[place[known]]
        if len(new):
            fresh, count[new] = self._encode(raw, starts[new], bounds[1:][new])
            own = np.cumsum(count[new]) - count[new]
            at[new], pool = own + len(pool), np.concatenate([pool, fresh])
            if len(self._keys) + len(new) > self._most or len(self._ids) > 8 * self._most:
                self._forget()
            self._remember(keys[new], raw, starts[new], size[new], fresh, own, count[new])
        count = count[number]
        return pool[textbuf.ragged(at[number], count)], np.append(0, np.cumsum(count))[np.append(0, np.cumsum(chunks))]
