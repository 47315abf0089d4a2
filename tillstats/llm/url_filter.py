"""URL filter: host and path rules, and a character language-model ratio where no rule fits.

Two variable-order Markov models over bytes, one for URLs that a rule allows and one for those a rule
blocks, are interpolated from order ``ORDER`` down to uniform: the estimate of each order
counts as ``STRENGTH`` observations of the next. Counts cover all ruled URLs outside the calibration fold, one
row for each distinct n-gram of either class, known by 64 bits: the table grows with the n-grams that occur, and no two
share a count at any size of input. It stays distributed: URLs are dealt to parts, each part asks for the counts of its own
distinct n-grams, and a task holds no more than these. The score is the difference of log-likelihoods per byte. The ruled URLs of the calibration fold, in a histogram of
fixed bins, turn it into the probability of a block by isotonic regression with both classes weighed alike; from one half
up the verdict is block.

Rules are (host, path, verdict). A rule fits its host and all subdomains if the path starts with the
rule's; of several that fit the longest (host and path) wins, of equally long ones the last in the list.

The models learn from and score the whole URL as it is written, with scheme, query and fragment.

Defined results: a URL without ``://`` has empty host and path and no rule, but a score; a null or empty one has score 0
and is allowed; without ruled URLs of both classes every URL that no rule fits is allowed. Repeated URLs are judged alike and count each time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, textbuf

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
ORDER, STRENGTH, BINS, FOLDS = 4, 2.0, 512, 5
#: Scores beyond this many nats a byte fall into the outermost bins.
SPAN = 4.0
_UNIFORM = 1 / 257


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _grams(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Offsets (each text and one end mark), keys of contexts and of contexts with their next symbol by order, and text lengths."""
    data, offs = textbuf.buffer_of(column)
    n = len(offs) - 1
    size = np.diff(offs)
    ends = offs[1:] + np.arange(n)  # where the end marks go
    symbols = np.full(len(data) + n, 256, np.uint64)
    symbols[textbuf.ragged(offs[:-1] + np.arange(n), size)] = data
    first = np.repeat(offs[:-1] + np.arange(n), size + 1)
    place = np.arange(len(symbols)) - first
    contexts, nexts, hashed = [], [], np.zeros(len(symbols), np.uint64)
    for k in range(ORDER + 1):
        if k:
            before = np.where(place >= k, symbols[np.maximum(np.arange(len(symbols)) - k, 0)], np.uint64(257))
            hashed = textbuf.mix(hashed + before * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k))
        contexts.append(hashed.view(np.int64))
        nexts.append(textbuf.mix(hashed + (symbols + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64))
    return np.append(first[ends - size] if n else np.zeros(0, np.int64), len(symbols)), contexts, nexts, size


class Models:
    """Counts of both classes by n-gram: sorted ``keys`` and ``counts`` of allowed and blocked texts, a column each."""

    def __init__(self, keys: np.ndarray, allowed: np.ndarray, blocked: np.ndarray):
        order = np.argsort(keys)
        # the last row is for n-grams that never occurred
        self.keys = keys[order]
        self.counts = np.append(np.stack([allowed, blocked], axis=1)[order], [[0, 0]], axis=0).astype(float)

    def of(self, keys: np.ndarray) -> np.ndarray:
        distinct, each = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == distinct[known]
        return self.counts[np.where(known, at, len(self.keys))[each]]

    def log_likelihoods(self, contexts: list[np.ndarray], nexts: list[np.ndarray]) -> np.ndarray:
        """For each symbol those of the allowed and of the blocked class."""
        p = np.full((len(contexts[0]), 2), _UNIFORM)
        for c, x in zip(contexts, nexts, strict=True):
            p = (self.of(x) + STRENGTH * p) / (self.of(c) + STRENGTH)
        return np.log(p)


def _scores(column: pa.Array, models: Models) -> np.ndarray:
    """Log-likelihood difference per byte, rejected less accepted; 0 for an empty text."""
    bounds, contexts, nexts, size = _grams(column)
    if not len(size):
        return np.zeros(0)
    accepted, rejected = models.log_likelihoods(contexts, nexts).T
    sums = np.add.reduceat(rejected - accepted, bounds[:-1])
    return np.where(size > 0, sums / np.maximum(size, 1), 0.0)


def grams(rows: DataFrame) -> DataFrame:
    """(key, allowed, blocked): how often each distinct context, alone and with its next symbol, occurs in rows (text, verdict)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = np.array(batch.column(1).to_pylist(), object) == "block"
            for lo in range(0, len(batch), 20_000):
                _, contexts, nexts, size = _grams(batch.column(0).slice(lo, 20_000))
                kind = np.repeat(verdicts[lo : lo + 20_000], size + 1)
                for found in (*contexts, *nexts):
                    keys, each = np.unique(found, return_inverse=True)
                    blocked = np.bincount(each[kind], minlength=len(keys))
                    allowed = np.bincount(each[~kind], minlength=len(keys))
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(allowed), pa.array(blocked)], names=["key", "allowed", "blocked"])

    found = rows.select("text", "verdict").mapInArrow(textbuf.lean(count), "key long, allowed long, blocked long")
    return found.groupBy("key").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))


def train(rows: DataFrame) -> DataFrame | None:
    """Written counts of n-grams (key, allowed, blocked) from rows (text, verdict); None unless both classes occur."""
    counts = common.cut(grams(rows))
    found = counts.agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")).first()
    return counts if found["allowed"] and found["blocked"] else None


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted least-squares fit of a rising sequence to ``y``, whose ``x`` ascend."""
    blocks: list[list[float]] = []
    for value, weight in zip(y.tolist(), w.tolist(), strict=True):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, k, n = blocks.pop()
            u = blocks[-1]
            blocks[-1] = [(u[0] * u[1] + v * k) / (u[1] + k) if u[1] + k else v, u[1] + k, u[2] + n]
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def _bin(score: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((score + SPAN) * (BINS / (2 * SPAN))))).cast("int")


def _scored(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` (text and more) with a column ``score`` by the counts that ``train`` has written."""
    parts = common.partitions(rows.sparkSession, rows)
    dealt = rows.withColumn("part_", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).cast("int"))
    schema = rows.withColumn("score", F.lit(0.0)).schema

    def asked(key, table):
        text, found = table.column("text").combine_chunks(), np.zeros(0, np.int64)
        for lo in range(0, len(text), 20_000):
            _, contexts, nexts, _ = _grams(text.slice(lo, 20_000))
            found = textbuf.distinct(np.concatenate([found, *contexts, *nexts]))
        return pa.table([pa.array(np.full(len(found), key[0].as_py(), np.int32)), pa.array(found)], names=["part_", "key"])

    def score(key, table, known):
        models = Models(*(known.column(c).to_numpy() for c in ("key", "allowed", "blocked")))
        own = table.drop_columns("part_")
        text = own.column("text").combine_chunks()
        found = [_scores(text.slice(lo, 20_000), models) for lo in range(0, len(text), 20_000)]
        return own.append_column("score", pa.array(np.concatenate([np.zeros(0), *found])))

    wanted = dealt.select("part_", "text").groupBy("part_").applyInArrow(asked, "part_ int, key long")
    met = wanted.join(counts, "key")
    return dealt.groupBy("part_").cogroup(met.groupBy("part_")).applyInArrow(score, schema)


def calibrate(scored: DataFrame) -> np.ndarray:
    """Probability of a block by score bin, from rows (verdict, score) that the models haven't seen."""
    found = scored.groupBy("verdict", _bin(F.col("score")).alias("bin")).agg(F.count("*").alias("n")).collect()  # 2 * BINS rows at most
    counts = np.zeros((2, BINS))
    for verdict, k, n in found:
        counts[int(verdict == "block"), int(k)] += n
    if not counts.sum(axis=1).all():
        return (np.arange(BINS) >= BINS / 2).astype(float)
    allowed, blocked = counts / counts.sum(axis=1, keepdims=True)
    weight = allowed + blocked
    some = np.flatnonzero(weight)
    fitted = isotonic(some, blocked[some] / weight[some], weight[some])
    return np.interp(np.arange(BINS), some, fitted)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score and probability of a block for each page's url."""
    text = F.coalesce(F.col("url"), F.lit("")).alias("text")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), text)
    rule, verdict = ruled(rules)
    rows = rows.withColumn("rule", rule).withColumn("verdict", verdict)
    known = rows.where("verdict is not null")
    fold = F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(FOLDS))
    models = train(known.where(fold != 0))
    if models is None:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"), F.lit(0.0).alias("probability"))
    scored = common.cut(_scored(rows, models))
    table = calibrate(scored.where(F.col("verdict").isNotNull() & (fold == 0)))
    scored = scored.withColumn("probability", F.element_at(F.lit(table.tolist()), _bin(F.col("score")) + 1))
    own = F.when((F.col("probability") >= 0.5) & (F.col("text") != ""), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "score", "probability")
