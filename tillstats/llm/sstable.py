"""Sorted-string-table shards of token ids.

A shard holds documents in ascending key order. File layout, all numbers little-endian:

* data blocks: u32 entry count, then per entry u16 shared key prefix, u16 rest, u32 ids, the rest of
  the key, the ids; keys are stored as what differs from the key before, anew in each block.
* block index: per block u64 place, u32 size, u16 length and bytes of its first key.
* Bloom filter: bits set by double hashing of each key.
* footer of fixed size: places of index and filter, block count, hash count, entries, ids, id width, magic.

Ids take 2 bytes where the vocabulary allows, else 4. Keys are a byte for null or
present, the big-endian id with its sign bit flipped, and a counter for repeated ids,
so byte order is id order (nulls first). A look-up asks the filter, binary-searches the
index and scans one block. Shards are written under a temporary name and
renamed, so a lost executor leaves no half shard and a repeated task rewrites
the same bytes. Null texts count as empty; an empty table writes no shard.
"""

from __future__ import annotations

import bisect
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textbuf, tokens

MAGIC = b"SSTIDS01"
FOOTER = struct.Struct("<QQQIIQQH8s")
BLOCK_BYTES = 64 << 10
MANIFEST = "shard int, path string, entries long, ids long, first binary, last binary"
ENTRY = struct.Struct("<HHI")
_BITS_PER_KEY, _HASHES = 10, 7


def key_of(doc_id: int | None, repeat: int = 0) -> bytes:
    head = b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))
    return head + struct.pack(">I", repeat)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


def _probes(keys: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions for 64-bit key hashes, one row per hash function."""
    low, high = keys & np.uint64(0xFFFFFFFF), (keys >> np.uint64(32)) | np.uint64(1)
    return (low + np.arange(_HASHES, dtype=np.uint64)[:, None] * high) % np.uint64(bits)


def _hash(keys: list[bytes]) -> np.ndarray:
    return textbuf.mix(np.array([int.from_bytes(k[:9][1:], "big") ^ (int.from_bytes(k[9:], "big") << 1) ^ k[0] for k in keys], np.uint64))


class ShardWriter:
    """Writes entries given in ascending key order to an open binary stream."""

    def __init__(self, out, width: int, block_bytes: int = BLOCK_BYTES):
        self._out, self._width, self._most, self._at = out, width, block_bytes, 0
        self._block, self._count, self._index, self._keys, self._ids = bytearray(), 0, [], [], 0
        self._last = b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self._keys and key <= self._keys[-1]:
            raise ValueError("keys must ascend")
        if not self._count:
            self._first, self._last = key, b""
        shared = next((i for i, (a, b) in enumerate(zip(key, self._last, strict=False)) if a != b), min(len(key), len(self._last)))
        self._block += ENTRY.pack(shared, len(key) - shared, len(ids)) + key[shared:] + ids.astype(f"<u{self._width}").tobytes()
        self._count, self._last, self._ids = self._count + 1, key, self._ids + len(ids)
        self._keys.append(key)
        if len(self._block) >= self._most:
            self._flush()

    def _flush(self) -> None:
        if self._count:
            block = struct.pack("<I", self._count) + bytes(self._block)
            self._index.append(struct.pack("<QIH", self._at, len(block), len(self._first)) + self._first)
            self._write(block)
            self._block, self._count = bytearray(), 0

    def _write(self, data: bytes) -> None:
        self._out.write(data)
        self._at += len(data)

    def close(self) -> tuple[int, int, bytes, bytes]:
        self._flush()
        index_at = self._at
        self._write(b"".join(self._index))
        filter_at = self._at
        bits = max(64, -(-_BITS_PER_KEY * len(self._keys) // 8) * 8)
        flags = np.zeros(bits, bool)
        if self._keys:
            flags[_probes(_hash(self._keys), bits).ravel()] = True
        self._write(np.packbits(flags, bitorder="little").tobytes())
        self._write(FOOTER.pack(index_at, filter_at, self._at, len(self._index), _HASHES, len(self._keys), self._ids, self._width, MAGIC))
        return len(self._keys), self._ids, self._keys[0], self._keys[-1]


class ShardReader:
    """Reads a shard from a random-access file."""

    def __init__(self, file, size: int):
        self._file = file
        file.seek(size - FOOTER.size)
        index_at, filter_at, end, blocks, _, self.entries, self.ids, self._width, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        file.seek(index_at)
        raw, at, self._index = file.read(filter_at - index_at), 0, []
        for _ in range(blocks):
            place, length, n = struct.unpack_from("<QIH", raw, at)
            self._index.append((raw[at + 14 : at + 14 + n], place, length))
            at += 14 + n
        file.seek(filter_at)
        self._bloom = np.frombuffer(file.read(end - filter_at), np.uint8)

    def _block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, place, length = self._index[k]
        self._file.seek(place)
        raw, at, key = self._file.read(length), 4, b""
        for _ in range(struct.unpack_from("<I", raw)[0]):
            shared, rest, n = ENTRY.unpack_from(raw, at)
            at += ENTRY.size
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, np.frombuffer(raw, f"<u{self._width}", n, at)
            at += n * self._width

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self._index)):
            yield from self._block(k)

    def may_hold(self, key: bytes) -> bool:
        at = _probes(_hash([key]), len(self._bloom) * 8).ravel().astype(np.int64)
        return bool((self._bloom[at >> 3] >> (at & 7) & 1).all())

    def get(self, key: bytes) -> np.ndarray | None:
        if not self._index or not self.may_hold(key):
            return None
        lo, hi = 0, len(self._index)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self._index[mid][0] <= key else (lo, mid)
        return next((ids for k, ids in self._block(lo) if k == key), None)


def open_shard(path: str) -> ShardReader:
    fs, place = pafs.FileSystem.from_uri(path)
    return ShardReader(fs.open_input_file(place), fs.get_file_info(place).size)


def _uri(folder: str) -> str:
    return folder if "://" in folder else f"file://{folder.removeprefix('file:')}"


def write(docs: DataFrame, path: str, folder: str, end: int = 2, vocabulary: int = 49_408) -> DataFrame:
    """Encodes ``docs`` (doc_id, text), deals them to shards by ranges of doc_id and writes these; returns the manifest.

    Range bounds are percentiles from Spark's fixed-size sketch; all rows of an id go to one
    shard. Ids are dealt out as narrow integers, not as text. The manifest has a row per shard.
    """
    spark = docs.sparkSession
    shards, width = common.partitions(spark, docs.select("doc_id", "text")), 2 if vocabulary <= 65_536 else 4
    steps = [k / shards for k in range(1, shards)] or [0.5]
    found = docs.select(F.percentile_approx("doc_id", F.lit(steps), F.lit(10_000)).alias("b")).first()["b"] or []
    bounds = np.unique(np.array(found, np.int64))
    target = _uri(folder)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pandas(integer_object_nulls=True)
            shard = np.array([0 if d is None else int(np.searchsorted(bounds, d, "left")) for d in own], np.int32)
            for lo, hi, ids, limits in tokens.encoded(batch.column(1), path, end):
                raw = ids.astype(f"<u{width}").tobytes()
                cells = [raw[a * width : b * width] for a, b in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard[lo:hi]), batch.column(0).slice(lo, hi - lo), pa.array(cells, pa.binary())], names=["shard", "doc_id", "ids"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = pafs.FileSystem.from_uri(target)
        fs.create_dir(place, recursive=True)
        shard, writer, out, previous, rows = None, None, None, None, []

        def finish() -> None:
            entries, n, first, last = writer.close()
            out.close()
            fs.move(name, final := f"{place}/shard-{shard:06d}.sst")
            rows.append((shard, f"{target.rstrip('/')}/{final.rpartition('/')[2]}", entries, n, first, last))

        for batch in batches:
            for s, d, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if s != shard:
                    if writer:
                        finish()
                    shard, previous = s, None
                    name = f"{place}/.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(name)
                    writer = ShardWriter(out, width)
                repeat = previous[1] + 1 if previous and previous[0] == d else 0
                previous = (d, repeat)
                writer.add(key_of(d, repeat), np.frombuffer(ids, f"<u{width}"))
        if writer:
            finish()
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["shard", "path", "entries", "ids", "first", "last"])

    rows = docs.select("doc_id", "text").mapInArrow(textbuf.lean(coded), "shard int, doc_id long, ids binary")
    dealt = rows.repartition(shards, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    manifest = dealt.mapInArrow(textbuf.lean(save), MANIFEST).collect()  # the action that writes: one small row per shard
    return spark.createDataFrame([tuple(r) for r in sorted(manifest, key=lambda r: r["shard"])], MANIFEST)


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every entry of the shards: doc_id, start (ids of all entries before), n_tokens, ids (as written)."""
    rows, shards, total = manifest.orderBy("shard").collect(), [], 0
    for r in rows:
        shards.append((r["path"], total))
        total += r["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cells: list[tuple] = []
                size = 0
                for key, ids in open_shard(path):
                    cells.append((id_of(key), start, len(ids), ids.astype("<u4").tobytes()))
                    start, size = start + len(ids), size + 4 * len(ids)
                    if size >= textbuf.SLICE_BYTES:
                        yield _batch(cells)
                        cells, size = [], 0
                if cells:
                    yield _batch(cells)

    listed = spark.createDataFrame(shards, "path string, start long").repartition(max(1, len(shards)), "path")
    return listed.mapInArrow(textbuf.lean(run), "doc_id long, start long, n_tokens long, ids binary")


def lookup(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and ids of those ids of ``wanted`` (doc_id) that the shards hold, each entry once for each wanted row.

    The manifest, a row a shard, names the shard whose keys span an id; its filter is asked, its index searched, one block read.
    """
    spark = wanted.sparkSession
    shards = [(r["path"], r["first"][:9], r["last"][:9]) for r in manifest.orderBy("shard").collect()]
    lasts = [last for _, _, last in shards]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            at = [bisect.bisect_left(lasts, key_of(d)[:9]) for d in ids]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(0)], names=["shard", "doc_id"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, reader = -1, None
        for batch in batches:
            cells = []
            for k, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k >= len(shards) or key_of(d)[:9] < shards[k][1]:
                    continue
                if k != place:
                    place, reader = k, open_shard(shards[k][0])
                repeat = 0
                while (ids := reader.get(key_of(d, repeat))) is not None:
                    cells.append((d, ids.astype("<u4").tobytes()))
                    repeat += 1
            columns = list(zip(*cells, strict=True)) if cells else [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())], names=["doc_id", "ids"])

    asked = wanted.select("doc_id").mapInArrow(textbuf.lean(dealt), "shard int, doc_id long")
    return asked.repartition(common.partitions(spark), "shard").sortWithinPartitions("shard", "doc_id").mapInArrow(textbuf.lean(found), "doc_id long, ids binary")


def _batch(cells: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*cells, strict=True), kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids"])


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Writes the shards to the shared folder and returns what they hold, ids as a checksum."""
    spark = docs.sparkSession
    manifest = write(docs, path, common.new_folder(spark, "sst"))
    return read(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
