"""Near-duplicate embeddings by cross-polytope hashing with multiprobe buckets.

Vectors turn three times by random signs and a fast Hadamard transform; the hash of a turned vector
is its largest coordinate in absolute value, with sign. Several such hashes make the code of one
table. Each vector lives in its own bucket of every table and also visits the buckets
that its second-largest coordinates name, one hash replaced at a time. Every pair of a resident with a resident or visitor is a
candidate, verified by its cosine in double precision.

The number of hashes grows with the logarithm of the number of vectors, so that unlike vectors share no more buckets in a
large table than in a small one; tables are added to hold recall (``SHAPES``): at a cosine of 0.98 in 64 dimensions a pair
misses all of them with a probability near 1e-7, in 384 dimensions below 2e-5 up to 268 million vectors.

Equal vectors of one label are one class with a weight. A bucket of more than ``BLOCK`` rows is dealt to
blocks, and each pair of blocks is one task's matrix product; no pair leaves a task. What leaves is, per class,
how many vectors it links to, and a spanning forest of the links. A pair that meets in several
buckets counts in the first one only, which both sides know from their codes.

Defined results: null or empty vectors, vectors of zeros or with null or non-finite components, null labels and
null ids link with nothing and are their own component. Vectors of different lengths never link.
Rows that repeat id, vector and label are one vector and each row is returned. Rows that repeat an id with
another vector or label count the links of their own vector, and belong to one component.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph, textbuf

#: Tables for each number of hashes.
SHAPES = {2: 8, 3: 12, 4: 16, 5: 22, 6: 28}
#: A table has at least so many buckets for each vector.
SPARSE = 16
BLOCK = 1024
_FOUND = "kind int, x long, y long"


@dataclass(frozen=True)
class Shape:
    """Hashes to a code, and tables."""

    hashes: int = 2

    @property
    def tables(self) -> int:
        return SHAPES[self.hashes]


def shape_for(vectors: int, length: int) -> Shape:
    """The fewest hashes that give ``SPARSE`` buckets a vector."""
    kinds = 2 * _padded(length)
    return Shape(next((h for h in SHAPES if SPARSE * vectors <= kinds**h), max(SHAPES)))


def _padded(d: int) -> int:
    return 1 << max(1, (d - 1).bit_length())


@cache
def _signs(d: int, shape: Shape) -> np.ndarray:
    return np.random.default_rng([10, d]).choice([-1.0, 1.0], (shape.tables, shape.hashes, 3, d))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


@cache
def _rotations(d: int, shape: Shape) -> np.ndarray:
    """All rotations side by side, as the fast transform turns the unit vectors; (d, tables * hashes * d)."""
    turned = []
    for signs in _signs(d, shape).reshape(-1, 3, d):
        x = np.eye(d)
        for r in range(3):
            x = hadamard(x * signs[r])
        turned.append(x)
    return np.concatenate(turned, axis=1)


def _turned(padded: np.ndarray, shape: Shape) -> np.ndarray:
    """(n, tables * hashes, d): by one matrix product for short vectors, by the fast transform for long ones."""
    n, d = padded.shape
    if d <= 128:
        return (padded @ _rotations(d, shape)).reshape(n, -1, d)
    out = np.empty((n, shape.tables * shape.hashes, d))
    for j, signs in enumerate(_signs(d, shape).reshape(-1, 3, d)):
        x = padded
        for r in range(3):
            x = hadamard(x * signs[r])
        out[:, j] = x
    return out


def codes(unit: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(n, tables) own codes and (n, tables, hashes) codes with one hash replaced by its second choice."""
    n, d0 = unit.shape
    d = _padded(d0)
    padded = np.zeros((n, d))
    padded[:, :d0] = unit
    # near ties would follow rounding: equal inputs must give equal codes whatever the batch
    x = np.round(_turned(padded, shape), 9)
    size, found = np.abs(x), []
    for _ in range(2):
        at = size.argmax(axis=2)[:, :, None]
        found.append((2 * at + (np.take_along_axis(x, at, 2) < 0))[:, :, 0].reshape(n, shape.tables, shape.hashes))
        np.put_along_axis(size, at, -1, 2)
    best, second = found
    weight = (2 * d) ** np.arange(shape.hashes)
    own = (best * weight).sum(axis=2)
    return own, own[:, :, None] + (second - best) * weight


def _unit(column: pa.Array) -> np.ndarray:
    """Rows scaled to length one, in double precision; all rows have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # so that no square overflows
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def _coded(part: pa.RecordBatch, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, (n, tables, 1 + hashes) codes, home first, and the buckets these name, of rows (rep, label, embedding) of one length."""
    unit = _unit(part.column(2))
    own, others = codes(unit, shape)
    visited = np.concatenate([own[:, :, None], others], axis=2)
    salt = textbuf.mix(part.column(1).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(unit.shape[1]))
    key = textbuf.mix(visited.astype(np.uint64) * np.uint64(shape.tables) + np.arange(shape.tables, dtype=np.uint64)[None, :, None] + salt[:, None, None])
    return unit, visited, key


def _by_length(batch: pa.RecordBatch, rows: int = 500):
    """Parts of a batch whose embeddings (column 2) have one length."""
    column = batch.column(2)
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    for d in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == d)
        for lo in range(0, len(own), rows):
            yield batch.take(pa.array(own[lo : lo + rows]))


def _scattered(classes: DataFrame, shape: Shape) -> DataFrame:
    """A narrow row per class and bucket it lives in or visits."""

    def run(batches):
        each = 1 + shape.hashes
        for batch in batches:
            for part in _by_length(batch):
                _, visited, key = _coded(part, shape)
                n = len(part)
                columns = [
                    pa.array(key.reshape(-1).view(np.int64)),
                    pa.array(np.tile(np.repeat(np.arange(shape.tables, dtype=np.int32), each), n)),
                    pa.array(visited.reshape(-1)),
                    pa.array(np.tile([True] + [False] * shape.hashes, n * shape.tables)),
                    part.column(0).take(pa.array(np.repeat(np.arange(n), shape.tables * each))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "t", "code", "home", "rep"])

    return classes.select("rep", "label", "embedding").mapInArrow(textbuf.lean(run), "bucket long, t int, code long, home boolean, rep long")


def _vectors(classes: DataFrame, shape: Shape) -> DataFrame:
    """(rep, w, codes, vector) with the codes of all tables and the unit vector."""

    def run(batches):
        for batch in batches:
            for part in _by_length(batch):
                unit, visited, _ = _coded(part, shape)
                narrow = (2 * _padded(unit.shape[1])) ** shape.hashes < 2**31
                all_codes = [r.tobytes() for r in visited.reshape(len(part), -1).astype("<i4" if narrow else "<i8")]
                columns = [part.column(0), part.column(3), pa.array(all_codes, pa.binary()), pa.array([r.tobytes() for r in unit.astype("<f8")], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["rep", "w", "codes", "vector"])

    return classes.select("rep", "label", "embedding", "w").mapInArrow(textbuf.lean(run), "rep long, w long, codes binary, vector binary")


def _meets_first(a: np.ndarray, b: np.ndarray, t: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Whether pairs of code rows (tables, 1 + hashes) meet in bucket (t, code) before any other."""
    home_a, home_b = a[:, :, 0], b[:, :, 0]
    a_visits, b_visits = (a == home_b[:, :, None]).any(axis=2), (b == home_a[:, :, None]).any(axis=2)
    found = a_visits | b_visits
    first = found.argmax(axis=1) == t
    big, row = np.int64(np.iinfo(np.int64).max), np.arange(len(a))
    least = np.minimum(np.where(a_visits[row, t], home_b[row, t], big), np.where(b_visits[row, t], home_a[row, t], big))
    return first & (least == code)


_SMALL = 48


class _Rows:
    """Columns of a run of rows, sorted by bucket and pair of blocks."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, shape: Shape):
        column = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        self.bucket, self.i, self.j, self.block, self.t, self.code, self.rep, self.w = (column[c].to_numpy() for c in ("bucket", "i", "j", "block", "t", "code", "rep", "w"))
        self.home = column["home"].to_numpy(zero_copy_only=False)
        data, offs = textbuf.buffer_of(column["vector"])
        self.size, self.data, self.offs = np.diff(offs) // 8, data, offs
        codes_, code_offs = textbuf.buffer_of(column["codes"])
        self._codes, self._code_offs, self._shape = codes_, code_offs, shape

    def codes(self, at: np.ndarray) -> np.ndarray:
        """(n, tables, 1 + hashes) codes of rows, which may be stored in different widths."""
        per = self._shape.tables * (1 + self._shape.hashes)
        out, width = np.empty((len(at), per), np.int64), (self._code_offs[at + 1] - self._code_offs[at]) // per
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            out[own] = self._codes[textbuf.ragged(self._code_offs[at[own]], np.full(len(own), w * per))].view(f"<i{w}").reshape(-1, per)
        return out.reshape(len(at), self._shape.tables, 1 + self._shape.hashes)

    def unit(self, at: np.ndarray) -> np.ndarray:
        """The vectors of rows of one length."""
        d = int(self.size[at[0]])
        return self.data[textbuf.ragged(self.offs[at], np.full(len(at), 8 * d))].view("<f8").reshape(-1, d)


def _paired(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows within each group."""
    rows = textbuf.ragged(starts, ends - starts)
    after = np.repeat(ends, ends - starts) - rows - 1
    return np.repeat(rows, after), textbuf.ragged(rows + 1, after)


def _links(rows: _Rows, cosine: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Linked pairs of rows that meet here first, group by group."""
    change = (rows.bucket[1:] != rows.bucket[:-1]) | (rows.i[1:] != rows.i[:-1]) | (rows.j[1:] != rows.j[:-1])
    starts = np.flatnonzero(np.append(True, change))
    ends = np.append(starts[1:], len(rows.rep))
    left, right = [], []

    def keep(a: np.ndarray, b: np.ndarray) -> None:
        near = (rows.home[a] | rows.home[b]) & (rows.rep[a] != rows.rep[b])
        a, b = a[near], b[near]
        first = _meets_first(rows.codes(a), rows.codes(b), rows.t[a], rows.code[a])
        left.append(a[first])
        right.append(b[first])

    small = (ends - starts <= _SMALL) & (rows.i[starts] == rows.j[starts])
    for d in np.unique(rows.size[starts[small]]).tolist():
        own = np.flatnonzero(small & (rows.size[starts] == d))
        for part in np.array_split(own, max(1, len(own) // 200)):
            a, b = _paired(starts[part], ends[part])
            for lo in range(0, len(a), 20_000):
                x, y = a[lo : lo + 20_000], b[lo : lo + 20_000]
                if len(x):
                    near = np.einsum("nd,nd->n", rows.unit(x), rows.unit(y)) >= cosine
                    keep(x[near], y[near])
    for lo, hi in zip(starts[~small], ends[~small], strict=True):
        own = np.arange(lo, hi)
        i, j = rows.i[lo], rows.j[lo]
        one, two = own[rows.block[own] == i], own[rows.block[own] == j]
        if not len(one) or not len(two):
            continue
        other = rows.unit(two).T
        for k in range(0, len(one), 256):
            part = one[k : k + 256]
            near = rows.unit(part) @ other >= cosine
            if i == j:
                near &= part[:, None] < two[None, :]
            x, y = np.nonzero(near)
            for m in range(0, len(x), 50_000):
                keep(part[x[m : m + 50_000]], two[y[m : m + 50_000]])
    return left, right


def _compared(blocks: DataFrame, cosine: float, shape: Shape) -> DataFrame:
    """(kind, x, y): 0 with a class and the weight linked to it, 1 with an edge of a spanning forest."""

    def told(batch: pa.RecordBatch | pa.Table) -> pa.RecordBatch:
        rows = _Rows(batch, shape)
        left, right = _links(rows, cosine)
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
        add = np.zeros(len(rows.rep), np.int64)
        np.add.at(add, a, rows.w[b])
        np.add.at(add, b, rows.w[a])
        some = np.flatnonzero(add)
        root, node = graph.forest(rows.rep[a], rows.rep[b]) if len(a) else (a, b)
        kind = np.repeat(np.array([0, 1], np.int32), [len(some), len(root)])
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([rows.rep[some], root])), pa.array(np.concatenate([add[some], node]))], names=["kind", "x", "y"])

    def run(batches):
        kept: list[pa.RecordBatch] = []  # the last group so far; no larger than a pair of blocks
        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(batch.schema.names.index(c)).to_numpy().astype(np.int64) for c in ("bucket", "i", "j")], axis=1)
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            cut = int(change[-1]) if len(change) else 0
            if not cut:
                head = kept[-1] if kept else None
                if head is not None and [head.column(head.schema.names.index(c))[0].as_py() for c in ("bucket", "i", "j")] != keys[0].tolist():
                    yield told(pa.Table.from_batches(kept).combine_chunks())
                    kept = []
                kept.append(batch)
                continue
            yield told(pa.Table.from_batches([*kept, batch.slice(0, cut)]).combine_chunks())
            kept = [batch.slice(cut)]
        if kept:
            yield told(pa.Table.from_batches(kept).combine_chunks())

    n = common.partitions(blocks.sparkSession)
    return blocks.repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(textbuf.lean(run), _FOUND)


def link(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors`` (vec_id, embedding, label)."""
    # -0.0 and 0.0 group together but NaN never gets here
    usable = F.expr("vec_id is not null and label is not null and size(embedding) > 0 and forall(embedding, v -> v is not null and abs(v) < double('inf') and not isnan(v)) and exists(embedding, v -> v <> 0)")
    rows = vectors.select("vec_id", "embedding", "label").withColumn("usable", F.coalesce(usable, F.lit(False)))
    grouped = rows.where("usable").select("vec_id", "label", "embedding").distinct().groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("w"))
    classes = common.cut(grouped.withColumn("rep", F.monotonically_increasing_id()))  # written, so that the numbers stay
    sizes = classes.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    shape = shape_for(sizes["n"], sizes["d"] or 1)
    # every row's class; the classes of one id belong together
    member = common.cut(rows.join(classes.select("label", "embedding", "rep", F.lit(True).alias("usable")), ["label", "embedding", "usable"], "left").select("vec_id", "rep"))
    several = member.where("rep is not null").groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("vec_id", "a")
    same = member.join(several, "vec_id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()

    scattered = _scattered(classes, shape)
    shared = scattered.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).where("n > 1 and homes > 0")
    blocks = scattered.join(shared.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("s")), "bucket")
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("s")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    blocks = blocks.withColumn("i", F.least("block", "o")).withColumn("j", F.greatest("block", "o")).drop("s", "o")
    # only rows that share a bucket carry their vector
    found = common.cut(_compared(blocks.join(_vectors(classes, shape), "rep"), cosine, shape))
    added = found.where("kind = 0").groupBy(F.col("x").alias("rep")).agg(F.sum("y").alias("added"))
    whole = graph.components(found.where("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b")).union(same))
    placed = classes.select("rep", "least", "w").join(whole, F.col("rep") == F.col("node"), "left").select("rep", "least", "w", F.coalesce("component", "rep").alias("comp"))
    lowest = placed.groupBy("comp").agg(F.min("least").alias("component"))
    per_class = placed.join(lowest, "comp").join(added, "rep", "left").select("rep", (F.col("w") - 1 + F.coalesce("added", F.lit(0))).alias("links"), "component")
    joined = member.join(per_class, "rep", "left")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
