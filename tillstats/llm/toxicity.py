"""Toxicity scores by gradient-boosted trees over dense features, with isotonic calibration.

Only labelled rows outside the held-out quarter (crc32 of the id as text, modulo 4, equal to 2) are learned from, and of them a
bounded sample by hash of the id (``MOST_LABELLED``). They yield a lexicon: words and word stems that toxic texts hold far more
often than others, with their log-odds as weights, beside a fixed list of insults. For training, each
quarter's features use a lexicon learned from the other quarters, so that weights never meet the rows they come from; the
trees' cross-fitted predictions are calibrated by isotonic regression.

Features of a whole text: densities and peaks of both lexicons, hits that only show after undoing look-alike characters,
closeness of hits to second-person words, capitals, punctuation, obfuscated and stretched words.
Label, language, source and id are no features.

Defined results: a null or empty text has no words and gets the score of such features; labels that are null or contradict
(the larger counts) are settled per id; of rows that repeat a labelled id the least text is learned from; without learnable rows of both classes every score is 0. Repeated rows score alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, textbuf
from .url_filter import isotonic

#: Labelled rows that a model learns from at most.
MOST_LABELLED = 40_000
#: Least z value of a term's log-odds, and the toxic texts that must hold it; every term that reaches both is kept.
SUREST, LEAST_TEXTS = 2.8, 3
THRESHOLD = 0.3
#: Terms that a task counts before it hands its sums on.
MOST_COUNTED = 100_000
#: The quarters that may be learned from: remainders 0, 1 and 3.
PARTS = 3
STEMS = (4, 5, 6)
#: Insults known beforehand, in four languages.
INSULTS = frozenset(
    "arse asshole bastard bitch clown creep cretin crap cunt dimwit disgusting dumb dumbass fool freak fuck fucking garbage hate idiot idiotic imbecile jerk "
    "kill loser moron moronic nazi pathetic pig retard retarded scum shit shut slut stupid trash ugly vermin whore worthless "
    "arschloch dumm dummkopf hurensohn idioten schwein trottel wichser abschaum "
    "abruti connard connasse crétin débile imbécile ordure salaud salope stupide "
    "basura cabrón estúpido estúpida gilipollas idiota imbécil mierda puta tonto".split()
)
#: Words that address the reader, in four languages.
SECOND_PERSON = frozenset("you your yours yourself yourselves ur u du dich dir dein deine deiner euch euer ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: Characters that stand in for letters.
LOOKALIKES = str.maketrans("013457@$!|", "oieastasii")
_TOKEN = re.compile(r"[^\W_]+(?:['’*@$!|._-]+[^\W_]+)*")
_INNER = re.compile(r"[a-zA-Z][0-9@$!|*]+[a-zA-Z]")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
FEATURES = (
    "words", "top", "top3", "density", "strong", "strong_density", "insults", "insult_density", "stems", "pronouns", "near", "distance",
    "capitals", "shouted", "exclamations", "questions", "punctuation", "obfuscated", "uncovered", "stretched", "digits", "stem_top",
)
NEAR = 5


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


class Lexicon(dict):
    """Word -> what is notable about it, worked out once per distinct word; None for most words.

    Notable: (weight, weight of its stem, insult, second person, odd); odd words hold other than letters.
    """

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = {w: x for w, x in weights.items() if not w.endswith("+")}
        # stems by their length, which a shorter word's beginning can't have
        self.stems = [(k, {w[:-1]: x for w, x in weights.items() if w.endswith("+") and len(w) == k + 1}) for k in STEMS]

    def weight(self, word: str) -> tuple[float, float]:
        stem = 0.0
        for k, known in self.stems:
            found = known.get(word[:k], 0.0)
            if found > stem:
                stem = found
        own = self.weights.get(word, 0.0)
        return (own if own > stem else stem), stem

    def __missing__(self, word: str) -> tuple | None:
        found = (*self.weight(word), word in INSULTS, word in SECOND_PERSON, not word.isalpha())
        if len(self) > 80_000:
            self.clear()
        self[word] = found = found if any(found) else None
        return found


def plain(word: str) -> str:
    """A word without look-alikes, inner marks and stretched letters."""
    return _LONG.sub(r"\1", re.sub(r"[^\w]|_", "", word.translate(LOOKALIKES)))


def _class(characters: str | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) if isinstance(c, str) else c for c in characters]] = True
    return out


_UPPER, _DIGIT, _MARKS, _LETTER = _class(range(65, 91)), _class(range(48, 58)), _class("!?.,;:#*$%&-\"'()"), _class([*range(65, 91), *range(97, 123)])


def _runs(flags: np.ndarray, least: int = 3) -> int:
    """Runs of at least ``least`` true flags."""
    if len(flags) < least:
        return 0
    full = flags[: len(flags) - 2] & flags[1 : len(flags) - 1] & flags[2:]
    return int(full[0]) + int((full[1:] & ~full[:-1]).sum())


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """One row of FEATURES."""
    text = text or ""
    words = tokens(text)
    n, size = max(1, len(words)), max(1, len(text))
    found = [(i, x) for i, x in enumerate(map(lexicon.__getitem__, words)) if x]
    weights = [x[0] for _, x in found]
    strong = [i for i, x in found if x[0] >= 2]
    insults = [i for i, x in found if x[2]]
    odd = [words[i] for i, x in found if x[4]]
    hidden = [p for p in map(plain, odd) if p in INSULTS or lexicon.weight(p)[0] >= 2]
    you = [i for i, x in found if x[3]]
    hits = sorted({*strong, *insults})
    gaps: list[int] = []
    if you and hits:
        at = np.searchsorted(you, hits)
        left = np.where(at > 0, np.array(hits) - np.array(you)[np.maximum(at - 1, 0)], 99)
        right = np.where(at < len(you), np.array(you)[np.minimum(at, len(you) - 1)] - np.array(hits), 99)
        gaps = np.minimum(left, right).tolist()
    top = sorted((x for x in weights if x > 0), reverse=True)[:3]
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    seen = np.bincount(raw, minlength=256)
    same = (raw[1:] == raw[:-1]) & _LETTER[raw[1:]]
    stretched = int((same[1:] & same[:-1]).sum())  # letters that continue a third time
    return [
        math.log1p(len(words)), top[0] if top else 0.0, sum(top), sum(weights) / n, math.log1p(len(strong)), len(strong) / n, math.log1p(len(insults)), len(insults) / n,
        math.log1p(sum(x[1] >= 2 for _, x in found)), len(you) / n, sum(g <= NEAR for g in gaps), min([20, *gaps]),
        int(seen[_UPPER].sum()) / size, _runs(_UPPER[raw]) / n, int(seen[33]) / size, int(seen[63]) / size, int(seen[_MARKS].sum()) / size,
        sum(_INNER.search(w) is not None for w in odd) / n, math.log1p(len(hidden)), stretched / n, int(seen[_DIGIT].sum()) / size, max((x[1] for _, x in found), default=0.0),
    ]


def learn_lexicons(rows: DataFrame) -> list[dict[str, float]]:
    """Log-odds of the words and stems that mark toxic texts, from rows (text, toxic, part).

    One lexicon without each part in turn, then one from all parts.
    """
    names = [f"{kind}{k}" for kind in "nt" for k in range(PARTS)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter[str]] = [Counter() for _ in names]

        def told() -> pa.RecordBatch:
            terms = list(set().union(*counts))
            out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts)], names=["term", *names])
            for c in counts:
                c.clear()
            return out

        for batch in batches:
            for text, label, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = set(tokens(text or ""))
                words |= {f"{w[:k]}+" for w in list(words) for k in STEMS if len(w) >= k}
                words.add("")  # stands for the text itself
                counts[part].update(words)
                if label:
                    counts[PARTS + part].update(words)
                if sum(map(len, counts)) > MOST_COUNTED:
                    yield told()
        yield told()

    schema = "term string, " + ", ".join(f"{n} long" for n in names)
    counted = common.cut(rows.select("text", "toxic", "part").mapInArrow(textbuf.lean(count), schema).groupBy("term").agg(*(F.sum(n).alias(n) for n in names)))
    total = counted.where("term = ''").first()
    out = []
    for left_out in range(PARTS + 1):
        used = [k for k in range(PARTS) if k != left_out]
        t = float(sum(total[f"t{k}"] for k in used)) if total else 0.0
        o = float(sum(total[f"n{k}"] for k in used)) - t if total else 0.0
        if not t or not o:
            out.append({})
            continue
        toxic = sum((F.col(f"t{k}") for k in used), F.lit(0))
        other = sum((F.col(f"n{k}") for k in used), F.lit(0)) - toxic
        odds = F.log((toxic + 0.5) / (t + 1)) - F.log((other + 0.5) / (o + 1))
        found = counted.where((F.col("term") != "") & (toxic >= LEAST_TEXTS)).select("term", odds.alias("w"), (odds / F.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))).alias("z"))
        # the rows are a bounded sample, and so are their words
        out.append({r["term"]: r["w"] for r in found.where(F.col("z") >= SUREST).orderBy("term").collect()})
    return out


def featured(rows: DataFrame, lexicons: list[dict[str, float]]) -> DataFrame:
    """doc_id, toxic and ``x``, the features of ``text`` by the lexicon learned without the row's part."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicons)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Lexicon(w) for w in shared.value]
        for batch in batches:
            for lo in range(0, len(batch), 1_000):
                part = batch.slice(lo, 1_000)
                x = [features(t, own[k]) for t, k in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    return rows.select("doc_id", "toxic", "text", "part").mapInArrow(textbuf.lean(run), "doc_id long, toxic int, x array<double>")


class Boosted:
    """Gradient-boosted regression trees on the logistic loss, over binned features."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 0.3):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = self._binned(x)
        p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = math.log(p / (1 - p))
        score = np.full(len(y), self.base)
        self.grown = []
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-score))
            tree, leaf = self._grow(binned, y - q, q * (1 - q))
            score += leaf
            self.grown.append(tree)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], axis=1).astype(np.uint8)

    def _grow(self, binned, gradient, curvature):
        """Nodes by level: feature, bin and leaf values; a row goes right if its bin exceeds the node's."""
        n, k = binned.shape
        node, feature, cut = np.zeros(n, np.int64), [], []
        for level in range(self.depth):
            count = 1 << level
            best = np.zeros(count)
            f, c = np.zeros(count, np.int64), np.full(count, 255)
            for j in range(k):
                slot = node * (self.bins + 1) + binned[:, j]
                g = np.bincount(slot, gradient, count * (self.bins + 1)).reshape(count, -1).cumsum(axis=1)
                h = np.bincount(slot, curvature, count * (self.bins + 1)).reshape(count, -1).cumsum(axis=1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt**2 / (ht + 1)
                gain[(h < self.least) | (ht - h < self.least)] = 0
                at = gain.argmax(axis=1)
                value = gain[np.arange(count), at]
                better = value > best + 1e-12
                best[better], f[better], c[better] = value[better], j, at[better]
            feature.append(f)
            cut.append(c)
            node = 2 * node + (binned[np.arange(n), f[node]] > c[node])
        leaves = 1 << self.depth
        value = self.rate * np.bincount(node, gradient, leaves) / (np.bincount(node, curvature, leaves) + 1)
        return (feature, cut, value), value[node]

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned, row = self._binned(x), np.arange(len(x))
        score = np.full(len(x), self.base)
        for feature, cut, value in self.grown:
            node = np.zeros(len(x), np.int64)
            for f, c in zip(feature, cut, strict=True):
                node = 2 * node + (binned[row, f[node]] > c[node])
            score += value[node]
        return 1 / (1 + np.exp(-score))


class Calibrated:
    """Boosted trees whose cross-fitted predictions an isotonic curve maps to rates."""

    def __init__(self, x: np.ndarray, y: np.ndarray, parts: int = 4):
        guess = np.zeros(len(y))
        part = np.arange(len(y)) % parts
        for k in range(parts):
            guess[part == k] = Boosted().fit(x[part != k], y[part != k]).predict(x[part == k])
        order = np.argsort(guess, kind="stable")
        self.at = guess[order]
        # a row's worth of both classes at either end keeps the rates from 0 and 1
        self.rate = np.clip(isotonic(self.at, y[order], np.ones(len(y))), 0.5 / len(y), 1 - 0.5 / len(y))
        self.at, first = np.unique(self.at, return_index=True)
        self.rate = self.rate[first]
        self.trees = Boosted().fit(x, y)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.predict(x), self.at, self.rate)


def train(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], Calibrated] | None:
    """The lexicon and the calibrated trees, or None where there is nothing to learn from."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.where(fold(F.col("doc_id")) != 2)
    share = min(1.0, MOST_LABELLED / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # at most MOST_LABELLED or so narrow rows: bounded, so safe to broadcast; of rows that repeat an id the least text is learned from
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    rows = rows.withColumn("part", F.least(fold(F.col("doc_id")), F.lit(PARTS - 1)).cast("int"))
    lexicons = learn_lexicons(rows)
    sample = common.gathered(featured(rows, lexicons))  # bounded by MOST_LABELLED
    order = np.argsort(sample["doc_id"], kind="stable")
    y = sample["toxic"][order].astype(float)
    if not len(y) or y.min() == y.max():
        return None
    return lexicons[-1], Calibrated(np.stack(sample["x"][order]), y)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs`` (doc_id, text)."""
    held = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")
    model = train(docs, labels)
    if model is None:
        return docs.select("doc_id", held, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, trees = shared.value
        lexicon = Lexicon(weights)
        for batch in batches:
            for lo in range(0, len(batch), 1_000):
                part = batch.slice(lo, 1_000)
                x = np.array([features(t, lexicon) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(trees.predict(x))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(textbuf.lean(run), "doc_id long, score double")
    return scored.select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns."""
    model = train(docs, labels)
    if model is None:
        return docs
    shared, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, trees = shared.value
        lexicon = Lexicon(weights)
        for batch in batches:
            for lo in range(0, len(batch), 1_000):
                part = batch.slice(lo, 1_000)
                x = np.array([features(t, lexicon) for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(trees.predict(x) < THRESHOLD))

    return docs.mapInArrow(textbuf.lean(run), schema)
