"""Operators that SQL can't express, against slow and plain versions of their definitions."""

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tillstats.llm import html_extract, toxicity, url_filter

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

# ---------------------------------------------------------------- pages


class Tree(HTMLParser):
    """A tree of lists [tag, attributes, children] of well-formed markup."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["#root", {}, []]
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, {k: v or "" for k, v in attrs}, []]
        self.stack[-1][2].append(node)
        if tag not in html_extract._VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.stack[-1][2].append([tag, {}, []])

    def handle_endtag(self, tag):
        if any(n[0] == tag for n in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.stack[-1][2].append(data)


SIDE = ("nav", "aside", "footer", "header", "script", "style", "form", "button")


def squeezed(text):
    return " ".join(text.split())


def inline(node):
    """The text of a node up to the blocks within it."""
    return " ".join(c if isinstance(c, str) else inline(c) for c in node[2] if isinstance(c, str) or c[0] not in html_extract._BLOCKS)


def lengths(node, linked=False):
    """(characters, characters within links)."""
    linked = linked or node[0] == "a"
    total = link = 0
    for c in node[2]:
        if isinstance(c, str):
            total, link = total + len(squeezed(c)), link + (len(squeezed(c)) if linked else 0)
        else:
            a, b = lengths(c, linked)
            total, link = total + a, link + b
    return total, link


def points_of(root):
    """Every scored paragraph passes its points to each ancestor, one after another."""
    found = defaultdict(float)

    def walk(node, above):
        for c in node[2]:
            if isinstance(c, str):
                continue
            path = [*above, node]
            if c[0] in html_extract._SCORED and squeezed(inline(c)):
                text = squeezed(inline(c))
                total, link = lengths(c)
                points = min(len(text) / 25, 1.0) * (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - (link / total if total else 0))
                targets = ([c] if c[0] in ("div", "section", "article", "main", "td") else []) + path[::-1]
                for level, t in enumerate(targets):
                    if t[0] != "#root":
                        found[id(t)] += points / 2**level
            walk(c, path)

    walk(root, [])
    return found


def random_page(r):
    words = "alpha beta, gamma delta epsilon, zeta eta theta iota kappa".split()

    def prose(n):
        return " ".join(r.choice(words) for _ in range(n))

    def block(depth):
        kind = r.random()
        if kind < 0.55 or depth > 4:
            return f"<p>{prose(r.randint(3, 60))} <a href='#'>{prose(r.randint(1, 4))}</a> {prose(r.randint(0, 9))}</p>"
        tag = r.choice(["div", "section", "div", "blockquote", "ul"])
        inner = "".join(block(depth + 1) for _ in range(r.randint(1, 4)))
        return f"<ul><li>{prose(5)}</li><li><a href='#'>{prose(3)}</a></li></ul>" if tag == "ul" else f"<{tag}>{inner}</{tag}>"

    side = "".join(f"<{t}>{prose(8)}</{t}>" for t in r.sample(SIDE[:4], 2))
    return f"<html><body>{side}<div><h1>{prose(4)}</h1>{''.join(block(0) for _ in range(r.randint(2, 6)))}</div><div>{block(3)}</div></body></html>"


def test_points_as_passed_one_by_one():
    r = random.Random(11)
    for _ in range(60):
        page = random_page(r)
        slow = Tree()
        slow.feed(page)
        root = slow.root

        def pruned(node):
            node[2] = [pruned(c) if not isinstance(c, str) else c for c in node[2] if isinstance(c, str) or c[0] not in SIDE]
            return node

        expected = points_of(pruned(root))
        own = html_extract.parse(page)
        html_extract._measured(own)
        html_extract._prune(own)
        nodes = [n for n in html_extract._score(own) if n.tag not in ("#root", "hr")]

        def flat(node):
            out = [] if node[0] == "#root" else [node]
            for c in node[2]:
                if not isinstance(c, str):
                    out += flat(c)
            return out

        plain = flat(root)
        assert [n.tag for n in nodes] == [n[0] for n in plain]
        for n, p in zip(nodes, plain, strict=True):
            assert n.points == pytest.approx(expected[id(p)]) and (n.chars, n.link_chars) == lengths(p)
        value = {id(p): expected[id(p)] * (1 - (lengths(p)[1] / lengths(p)[0] if lengths(p)[0] else 0)) for p in plain}
        best = max(plain, key=lambda p: value[id(p)])
        # the chosen container's text is part of what is kept
        text = html_extract.extract(page)
        assert squeezed(inline(best)) in squeezed(text) or best[0] in ("body", "html") or not expected[id(best)]


# ---------------------------------------------------------------- toxicity


def plain_features(text, weights):
    """The features one by one, by their definitions."""
    text = text or ""
    words = [w for w in re.findall(r"[^\W_]+(?:['’*@$!|._-]+[^\W_]+)*", text.lower())]
    n, size = max(1, len(words)), max(1, len(text))

    def stem(w):
        return max([weights.get(w[:k] + "+", 0.0) for k in (4, 5, 6) if len(w) >= k] or [0.0])

    def weight(w):
        return max(weights.get(w, 0.0), stem(w))

    def bare(w):
        w = "".join(c for c in w.translate(toxicity.LOOKALIKES) if c.isalnum())
        return re.sub(r"([^\W\d_])\1{2,}", r"\1", w)

    notable = [weight(w) for w in words]
    hits = [i for i, w in enumerate(words) if weight(w) >= 2 or w in toxicity.INSULTS]
    you = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    gaps = [min(min(abs(h - y) for y in you), 99) for h in hits] if you else []
    top = sorted((x for x in notable if x > 0), reverse=True)
    raw = text.encode()
    odd = [w for w in words if not w.isalpha()]
    runs = len(re.findall(rb"[A-Z]{3,}", raw))
    stretched = sum(raw[i] == raw[i - 1] == raw[i - 2] and chr(raw[i]).isascii() and chr(raw[i]).isalpha() for i in range(2, len(raw)))
    insults, strong = sum(w in toxicity.INSULTS for w in words), sum(x >= 2 for x in notable)
    return [
        math.log1p(len(words)), top[0] if top else 0.0, sum(top[:3]), sum(notable) / n, math.log1p(strong), strong / n, math.log1p(insults), insults / n,
        math.log1p(sum(stem(w) >= 2 for w in words)), len(you) / n, sum(g <= 5 for g in gaps), min([20, *gaps]),
        len(re.findall(rb"[A-Z]", raw)) / size, runs / n, raw.count(b"!") / size, raw.count(b"?") / size, sum(chr(b) in "!?.,;:#*$%&-\"'()" for b in raw) / size,
        sum(bool(re.search(r"[a-zA-Z][0-9@$!|*]+[a-zA-Z]", w)) for w in odd) / n, math.log1p(sum(bare(w) in toxicity.INSULTS or weight(bare(w)) >= 2 for w in odd)), stretched / n,
        len(re.findall(rb"[0-9]", raw)) / size, max([stem(w) for w in words] or [0.0]),
    ]


def test_features_one_by_one(texts):
    weights = {"vile": 3.0, "gros+": 2.5, "meh": 0.7, "blubb+": 1.0}
    own = ["", None, "You vile pig!!! SHUT UP, you idi0t and 1diot", "gross grossly blubbery MEH soooo s.t.u.p.i.d!?", "you you vile x x x x x x x x vile", "AAA BBB AAAb aaa111 !!!", *texts[:20]]
    for t in own:
        assert toxicity.features(t, toxicity.Lexicon(weights)) == pytest.approx(plain_features(t, weights))


def test_trees_one_by_one():
    """Predictions of the boosted trees as walks from node to node."""
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 4))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float)
    model = toxicity.Boosted(trees=12).fit(x, y)
    found = model.predict(x)
    for i in range(0, 400, 17):
        score = model.base
        for feature, cut, value in model.grown:
            node = 0
            for f, c in zip(feature, cut, strict=True):
                j = int(f[node])
                bin_ = sum(e < x[i, j] for e in model.edges[j])
                node = 2 * node + int(bin_ > c[node])
            score += value[node]
        assert found[i] == pytest.approx(1 / (1 + math.exp(-score)))
    assert ((found > 0.5) == y).mean() > 0.9


# ---------------------------------------------------------------- URLs


def test_likelihood_ratio_one_by_one(spark):
    r = random.Random(2)
    texts = [("".join(r.choice("ab/.-") for _ in range(r.randint(1, 12))), r.choice(["allow", "block"])) for _ in range(80)]
    contexts, nexts = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for text, verdict in texts:
        symbols = [*text.encode(), 256]
        for i, s in enumerate(symbols):
            for k in range(url_filter.ORDER + 1):
                c = tuple(symbols[i - j] if i >= j else 257 for j in range(1, k + 1))
                contexts[k, c][verdict == "block"] += 1
                nexts[k, c, s][verdict == "block"] += 1

    def log_likelihood(text, side):
        symbols, total = [*text.encode(), 256], 0.0
        for i, s in enumerate(symbols):
            p = 1 / 257
            for k in range(url_filter.ORDER + 1):
                c = tuple(symbols[i - j] if i >= j else 257 for j in range(1, k + 1))
                p = (nexts[k, c, s][side] + url_filter.STRENGTH * p) / (contexts[k, c][side] + url_filter.STRENGTH)
            total += math.log(p)
        return total

    counts = url_filter.train(spark.createDataFrame(texts, "text string, verdict string").repartition(3))
    asked = ["", "a", "ab/ab", "zzz", "é/", "a", *(t for t, _ in texts[:20])]
    found = url_filter._scored(spark.createDataFrame([(t,) for t in asked], "text string"), counts).collect()
    assert sorted(t for t, _ in found) == sorted(asked)
    for t, score in found:
        expected = (log_likelihood(t, 1) - log_likelihood(t, 0)) / len(t.encode()) if t else 0.0
        assert score == pytest.approx(expected)


# ---------------------------------------------------------------- the pipeline


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def kept_ids(rows):
    """One id, the least, of each component of links between documents."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i for i in ids if root(i) == i}


def trimmed(rows, length=50):
    first, out = {}, {}
    for i, t in sorted((i, (t or "").encode()) for i, t in rows):
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], i)
    for i, t in rows:
        raw = (t or "").encode()
        covered = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if first[raw[k : k + length]] < i:
                covered[k : k + length] = b"\1" * length
        out[i] = bytes(b for b, x in zip(raw, covered, strict=True) if not x).decode("utf-8", "ignore")
    return out


@tables
def test_each_stage(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, seen = spark.read.parquet(f"{DATA}/documents.parquet"), []
    scores = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect()}
    rows = [[(r["doc_id"], r["text"]) for r in docs.collect()]]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs.collect())
        rows.append([(r["doc_id"], r["text"]) for r in seen[-1]] if "text" in docs.columns else None)
    assert sorted(rows[1]) == sorted((i, t) for i, t in rows[0] if scores[i] < toxicity.THRESHOLD)
    ids = kept_ids(rows[1])
    assert sorted(rows[2]) == sorted((i, t) for i, t in rows[1] if i in ids) and len(ids) < len(rows[1])
    assert dict(rows[3]) == trimmed(rows[2])
    word = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole = {i: [*word.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows[3]}
    covered, places = Counter(), defaultdict(list)
    for r in seen[3]:
        piece = whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] <= 2048 and r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
        covered[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert covered == {i: len(ids_) for i, ids_ in whole.items()}
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
