"""Near-duplicate documents by HyperMinHash sketches, banding and full-set verification.

1. Each document becomes the set of its distinct word shingles. Documents with the same words in the same order form one
   class, known by a 128-bit cryptographic digest of these words; classes are numbered (``rep``) when they are written.
2. A HyperMinHash sketch keeps for each of 128 buckets the leading-zero count and
   16 mantissa bits of the bucket's least hash. Bands of 4 compressed registers are hashed; bands without
   any register are left out, since they say nothing. At a likeness of 0.75 a pair
   misses all 32 bands with probability 5e-6 at most; smaller sets miss less often.
3. In every bucket that several classes share, all members are compared with its most central
   member (the one with the fullest buckets). Links are confirmed on the full sets, made of the words of both
   texts themselves (no hash decides), and joined to components. A bucket whose members then belong to one component needs nothing more.
4. The members of the other buckets meet in an exact prefix join: shingles are ordered from rare to
   common, and two sets that reach the threshold share one early enough in that order. Only pairs of different
   components meet; the collision-corrected estimate drops the hopeless, the full sets decide.

So no bucket is capped and no group is expanded into its pairs, yet every link that a
shared bucket could show is either found or made redundant by a path of links.

Defined results: a document without text or words, or with a null id, links with nothing, is its own
component and is kept (its component is its id). Rows that repeat an id are one
document for linking and each row is returned. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph, textbuf

REGISTERS, MANTISSA, ROWS = 128, 16, 4
#: The likeness from which documents link, as 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Slots of the table of shingle counts that orders shingles; it is broadcast, 4 bytes a slot.
COUNT_SLOTS = 1 << 18
#: Chance that two different hashes give one register: equal zeros (1/3) and equal mantissa.
_COLLISION = 2.0**-MANTISSA / 3
SIGNATURES = "doc_id long, row long, n_shingles long, k1 long, k2 long, sketch binary"


def sketches(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading zeros + 1 (0: empty) and mantissa of each bucket's least hash; one row per document."""
    n = len(bounds) - 1
    top = (REGISTERS - 1).bit_length()
    cell = np.repeat(np.arange(n), np.diff(bounds)) * REGISTERS + (hashes >> np.uint64(64 - top)).astype(np.int64)
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    rest = hashes[first] << np.uint64(top)
    zeros = np.where(rest >> np.uint64(11) == 0, 53, 53 - np.frexp((rest >> np.uint64(11)).astype(float))[1]).astype(np.uint64)
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    z, m = np.zeros((n, REGISTERS), np.uint8), np.zeros((n, REGISTERS), np.uint16)
    z.reshape(-1)[cell[first]] = zeros + np.uint64(1)
    m.reshape(-1)[cell[first]] = mantissa
    return z, m


def pack(z: np.ndarray, m: np.ndarray) -> list[bytes]:
    return [a.tobytes() + b.tobytes() for a, b in zip(z, m.astype("<u2"), strict=True)]


def unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, _ = textbuf.buffer_of(column)
    raw = data.reshape(-1, 3 * REGISTERS)
    return raw[:, :REGISTERS], np.ascontiguousarray(raw[:, REGISTERS:]).view("<u2")


def estimate(za, ma, zb, mb) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimate of each row's pair, and the registers it rests on."""
    either = ((za > 0) | (zb > 0)).sum(axis=1)
    equal = ((za > 0) & (za == zb) & (ma == mb)).sum(axis=1)
    raw = equal / np.maximum(either, 1)
    return np.clip((raw - _COLLISION) / (1 - _COLLISION), 0, 1), either


def hopeful(za, ma, zb, mb) -> np.ndarray:
    """False where the estimate lies five standard errors below the threshold."""
    found, m = estimate(za, ma, zb, mb)
    t = PERCENT / 100
    return found >= t - 5 * np.sqrt(t * (1 - t) / np.maximum(m, 1))


def band_keys(z: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of each row's bands and whether the band holds a register."""
    code = (z.astype(np.uint64) << np.uint64(MANTISSA)) | m
    keys = np.zeros((len(z), REGISTERS // ROWS), np.uint64)
    for j in range(ROWS):
        keys = textbuf.mix(keys + code[:, j::ROWS] + np.arange(1, REGISTERS // ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return keys, _any_register(z)


def _any_register(z: np.ndarray) -> np.ndarray:
    out = np.zeros((len(z), REGISTERS // ROWS), bool)
    for j in range(ROWS):
        out |= z[:, j::ROWS] > 0
    return out


def signatures(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, a hash of the text (row), n_shingles, the 128-bit key of the words and the sketch of the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = textbuf.buffer_of(batch.column(1))
            for lo, hi in textbuf.slices(offs):
                hashes, bounds = textbuf.shingle_sets(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], words)
                key = np.frombuffer(b"".join(textbuf.digests(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])), "<i8").reshape(-1, 2)
                columns = [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(np.diff(bounds)), pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy()), pa.array(pack(*sketches(hashes, bounds)), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "n_shingles", "k1", "k2", "sketch"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("row")).mapInArrow(textbuf.lean(run), SIGNATURES)


def _texts_of(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """(rep, text): one text for each class in ``heads`` (rep, doc_id, row)."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("row")).join(common.lookup(heads), ["doc_id", "row"])
    return rows.groupBy("rep").agg(F.min("text").alias("text"))


def exact_sets(texts: pa.Array, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as ascending numbers, and their bounds; equal numbers are equal words throughout."""
    data, offs = textbuf.buffer_of(texts)
    number, _, count = textbuf.words(data, offs)
    begin = np.cumsum(count) - count
    made = np.where(count >= words, count - words + 1, (count > 0).astype(np.int64))
    at = textbuf.ragged(begin, made)
    text = np.repeat(np.arange(len(made), dtype=np.int32), made)
    end = np.repeat(begin + count, made)

    def column(j: int, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The j-th word of shingles; -1 where a text has fewer."""
        place = at[rows] + j
        return np.where(place < end[rows], number[np.minimum(place, len(number) - 1)], -1) if len(number) else place

    hashed = np.zeros(len(at), np.uint64)
    for j in range(words):
        hashed = textbuf.mix(hashed + column(j).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(hashed, kind="stable")
    same = hashed[order[1:]] == hashed[order[:-1]]
    left, right = order[:-1][same], order[1:][same]
    if all((column(j, left) == column(j, right)).all() for j in range(words)):
        shingle = np.empty(len(at), np.int64)
        shingle[order] = np.cumsum(np.append(True, ~same)[: len(at)])
    else:  # unequal words under one hash
        shingle = np.unique(np.stack([column(j) for j in range(words)], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
    most = len(at) + 1
    own = textbuf.distinct(text.astype(np.int64) * most + shingle)
    return own % most, np.searchsorted(own // most, np.arange(len(made) + 1))


def _verified(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Those (a, b) whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.add(pc.binary_length(batch.column(2)), pc.binary_length(batch.column(3))).to_numpy()
            for lo, hi in textbuf.slices(np.append(0, np.cumsum(size, dtype=np.int64))):
                part = batch.slice(lo, hi - lo)
                # a text that stands in many pairs is read once
                both = pa.concat_arrays([part.column(2), part.column(3)]).dictionary_encode()
                shingles, bounds = exact_sets(both.dictionary, words)
                at = both.indices.to_numpy()
                sizes = np.diff(bounds)
                x, y = at[: hi - lo], at[hi - lo :]
                keep = np.zeros(hi - lo, bool)
                for i, (j, k) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
                    own = np.concatenate([shingles[bounds[j] : bounds[j + 1]], shingles[bounds[k] : bounds[k + 1]]])
                    own.sort()
                    common_ = int((own[1:] == own[:-1]).sum())
                    keep[i] = 100 * common_ >= PERCENT * (sizes[j] + sizes[k] - common_)
                kept = pa.array(np.flatnonzero(keep))
                yield pa.RecordBatch.from_arrays([part.column(0).take(kept), part.column(1).take(kept)], names=["a", "b"])

    joined = pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b")
    joined = joined.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a")
    return joined.select("a", "b", "ta", "tb").mapInArrow(textbuf.lean(run), graph.EDGES)


def _set_hashes(texts: DataFrame, words: int) -> DataFrame:
    """(rep, comp, hashes): the set of each text (rep, comp, text) as 64-bit hashes, which only the search for candidates uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = textbuf.buffer_of(batch.column(2))
            for lo, hi in textbuf.slices(offs):
                hashes, bounds = textbuf.shingle_sets(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], words)
                raw = hashes.tobytes()
                sets = [raw[8 * a : 8 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(sets, pa.binary())], names=["rep", "comp", "hashes"])

    return texts.select("rep", "comp", "text").mapInArrow(textbuf.lean(run), "rep long, comp long, hashes binary")


def _hopeful(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs that the sketches don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                at = pa.array(np.flatnonzero(hopeful(*unpack(batch.column(2)), *unpack(batch.column(3)))))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    joined = pairs.join(reps.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
    joined = joined.join(reps.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a")
    return joined.select("a", "b", "sa", "sb").mapInArrow(textbuf.lean(run), graph.EDGES)


def _bands(reps: DataFrame) -> DataFrame:
    """(band, rep, n): a row per class and band with a register."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                keys, some = band_keys(*unpack(batch.column(2)))
                row, col = np.nonzero(some)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(keys[row, col].view(np.int64)), batch.column(0).take(at), batch.column(1).take(at)], names=["band", "rep", "n"])

    return reps.select("rep", "n", "sketch").mapInArrow(textbuf.lean(run), "band long, rep long, n long")


def _prefix_pairs(texts: DataFrame, groups: DataFrame, words: int) -> DataFrame:
    """Pairs (a, b) of different components (``groups``: rep, comp) that could reach the threshold.

    Two sets that do share a shingle whose places in both, ordered from rare to common, leave enough
    common shingles to come; the first shared one does. Shingle counts come from a table of fixed size over all the
    sets, so hot shingles sort last; colliding counts change the order, never the result.
    """
    spark = texts.sparkSession
    mask = COUNT_SLOTS - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNT_SLOTS, np.int64)
        for batch in batches:
            data, _ = textbuf.buffer_of(batch.column(0))
            total += np.bincount((np.ascontiguousarray(data).view(np.uint64) & np.uint64(mask)).astype(np.int64), minlength=COUNT_SLOTS)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], names=["slot", "n"])

    own = common.cut(_set_hashes(texts.join(groups.select("rep", "comp"), "rep"), words))
    table = common.gathered(own.select("hashes").mapInArrow(textbuf.lean(count), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")))
    counts = np.zeros(COUNT_SLOTS, np.uint32)
    counts[table["slot"]] = np.minimum(table["n"], 2**32 - 1)
    shared = spark.sparkContext.broadcast(counts)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            data, offs = textbuf.buffer_of(batch.column(2))
            hashes, bounds = np.ascontiguousarray(data).view(np.uint64), offs // 8
            size = np.diff(bounds)
            keep = size - -(-PERCENT * size // 100) + 1
            picked = []
            for i in range(len(batch)):
                own = hashes[bounds[i] : bounds[i + 1]]
                picked.append(own[np.lexsort((own, counts[(own & np.uint64(mask)).astype(np.int64)]))][: keep[i]])
            row = np.repeat(np.arange(len(batch)), keep)
            at = pa.array(row)
            place = np.arange(len(row)) - np.repeat(np.cumsum(keep) - keep, keep)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(picked).view(np.int64) if picked else np.zeros(0, np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(size[row]), pa.array(place)],
                names=["shingle", "rep", "comp", "n", "place"],
            )

    index = own.select("rep", "comp", "hashes").mapInArrow(textbuf.lean(prefixes), "shingle long, rep long, comp long, n long, place long")
    mixed = index.groupBy("shingle").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("shingle")
    # no shingle of one component only, or of one document, can show a new link
    live = common.cut(index.join(mixed, "shingle"))
    x, y = live.alias("x"), live.alias("y")
    enough = f"{100 + PERCENT} * least(x.n - x.place, y.n - y.place) >= {PERCENT} * (x.n + y.n)"
    return (
        x.join(y, F.expr(f"x.shingle = y.shingle and x.rep < y.rep and x.comp <> y.comp and 100 * least(x.n, y.n) >= {PERCENT} * greatest(x.n, y.n) and {enough}"))
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
        .distinct()
    )


def link(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text)."""
    signed = common.cut(signatures(docs, words))
    some = signed.where("n_shingles > 0 and doc_id is not null")
    # every row of a class has the same words, so any of its sketches and texts will do
    classes = some.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "row", F.col("n_shingles").alias("n"), "sketch")).alias("s"))
    reps = common.cut(classes.select("k1", "k2", "s.n", "s.sketch", "s.doc_id", "s.row").withColumn("rep", F.monotonically_increasing_id()))
    # the classes of one id belong together
    own = some.select("doc_id", "k1", "k2").distinct()
    several = own.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("a"), F.max(F.struct("k1", "k2")).alias("z")).where("a <> z").select("doc_id")
    member = own.join(several, "doc_id").join(reps.select("k1", "k2", "rep"), ["k1", "k2"]).select("doc_id", "rep")
    same = member.join(member.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("a <> rep").select("a", F.col("rep").alias("b"))

    bands = _bands(reps)
    full = bands.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    buckets = common.cut(bands.join(full, "band"))
    central = buckets.groupBy("rep").agg(F.sum("members").alias("weight"))
    weighed = buckets.join(central, "rep")
    lead = weighed.groupBy("band").agg(F.max(F.struct("weight", "rep", "n")).alias("m")).select("band", F.col("m.rep").alias("lead"), F.col("m.n").alias("lead_n"))
    stars = buckets.join(lead, "band").where(f"rep <> lead and 100 * least(n, lead_n) >= {PERCENT} * greatest(n, lead_n)").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    texts = common.cut(_texts_of(docs, reps.join(buckets.select("rep").distinct(), "rep", "left_semi").select("rep", "doc_id", "row")))
    found = common.cut(_verified(_hopeful(stars, reps), texts, words))

    first = graph.components(found).withColumnsRenamed({"node": "rep", "component": "comp"})
    placed = buckets.select("band", "rep").join(first, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    open_ = placed.groupBy("band").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("band")
    groups = common.cut(placed.join(open_, "band", "left_semi").select("rep", "comp").distinct())
    # written first: one Python worker a task, not one for this and one for what follows
    more = common.cut(_verified(_hopeful(_prefix_pairs(texts, groups, words), reps), texts, words))

    whole = graph.components(found.union(more).union(same))
    placed = reps.select("rep", "k1", "k2", "doc_id").join(whole, F.col("rep") == F.col("node"), "left").select("k1", "k2", "doc_id", F.coalesce("component", "rep").alias("comp"))
    least = placed.groupBy("comp").agg(F.min("doc_id").alias("component"))
    per_class = placed.join(least, "comp").select("k1", "k2", "component")
    joined = signed.select("doc_id", "n_shingles", "k1", "k2").join(per_class, ["k1", "k2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, words: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay, one id of each group of near-duplicates, with all their columns."""
    names = docs.columns
    away = common.lookup(link(docs, words).where("not kept").select("doc_id").distinct())
    return docs.alias("d").join(away.alias("gone"), F.col("d.doc_id") == F.col("gone.doc_id"), "left_anti").select(*(F.col(f"`{n}`") for n in names))
