import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tillstats.llm import embed_dedup, fingerprints, graph, near_dedup, suffix_dedup, textbuf

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_sets(texts):
    hashes, bounds = textbuf.shingle_sets(*textbuf.buffer_of(pa.array(texts)))
    assert np.diff(bounds).tolist() == [len(shingles(t)) for t in texts]
    sets = [frozenset(hashes[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    for i, a in enumerate(texts[:60]):
        for j, b in enumerate(texts[:60]):
            assert len(sets[i] & sets[j]) == len(shingles(a) & shingles(b))


def test_fingerprints(docs, empty, texts):
    found = {r["doc_id"]: r for r in fingerprints.edited(docs).collect()}
    assert len(found) == len(texts)
    gaps = []
    for i, t in enumerate(texts):
        t, after = t or "", texts[i - 1] or ""
        edit = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = found[3 * i - 20]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
        for near, other in ((r["near_edited"], edit), (r["near_next"], after)):
            a, b = shingles(t), shingles(other)
            gaps.append(abs(near - (len(a & b) / len(a | b) if a | b else 1.0)))
        assert (r["fingerprint"] == "") == (not shingles(t))
    assert np.mean(gaps) < 0.03 and max(gaps) < 0.2
    assert found[3 * 3 - 20]["fingerprint"] == found[3 * 62 - 20]["fingerprint"] != ""  # equal texts
    assert fingerprints.edited(empty).count() == 0


def test_fingerprint_edges(spark):
    one = spark.createDataFrame([(4, "just one text of six words")], "doc_id long, text string")
    (r,) = fingerprints.edited(one).collect()
    assert r["near_next"] == 1.0
    odd = spark.createDataFrame([(4, "a b"), (4, "a b"), (4, "c"), (None, "d"), (None, None)], "doc_id long, text string")
    rows = fingerprints.edited(odd).collect()
    assert len(rows) == 5 and sorted(str(r["doc_id"]) for r in rows) == ["4", "4", "4", "None", "None"]
    assert fingerprints.edited(odd.where("doc_id is null")).count() == 2
    assert fingerprints.fingerprint(odd.withColumn("fingerprint", odd["doc_id"])).columns == ["doc_id", "text", "fingerprint"]


def test_near_duplicates(docs, empty, texts):
    ids = [3 * i - 20 for i in range(len(texts))]
    sets = {i: shingles(t) for i, t in zip(ids, texts, strict=True)}
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    expected = components(ids, links)
    rows = near_dedup.link(docs).collect()
    assert len(rows) == len(texts) and len(set(expected.values())) < len(texts) - 7
    for r in rows:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), expected[r["doc_id"]], expected[r["doc_id"]] == r["doc_id"])
    assert near_dedup.link(empty).count() == 0
    kept = near_dedup.keep_first(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected.values())) and kept.columns == docs.columns


def test_chains_of_near_copies(spark):
    """Many copies of copies: links run only between neighbours, so stars alone miss them."""
    r = np.random.default_rng(3)
    words = [f"w{k}" for k in range(3_000)]
    rows, text = [], list(r.choice(words, 150))
    for i in range(60):
        rows.append((i, " ".join(text)))
        for at in r.choice(150, 3, replace=False):
            text[at] = str(r.choice(words))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    expected = components(sets, links)
    assert {x["doc_id"]: x["component_id"] for x in near_dedup.link(df).collect()} == expected


def test_odd_ids_link_nothing(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, ""), (0, " ")], "doc_id long, text string")
    rows = near_dedup.link(df).collect()
    assert len(rows) == 6 and all(r["kept"] for r in rows)


def test_every_text_of_a_repeated_id_links(spark):
    """Id 1 has three texts; whichever is the least, each finds its near copy, and they are one document."""
    r = np.random.default_rng(9)
    texts = [[f"{first}{k}" for k in r.integers(0, 10**6, 60)] for first in "amz"]
    near = [" ".join([*t[:-1], "other"]) for t in texts]
    rows = [(1, " ".join(t)) for t in texts] + [(10 + k, t) for k, t in enumerate(near)] + [(5, "quite another text of seven words"), (1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(x["doc_id"], x["component_id"], x["kept"]) for x in near_dedup.link(df).collect()]
    assert sorted(found) == sorted([(1, 1, True)] * 4 + [(10 + k, 1, False) for k in range(3)] + [(5, 5, True)])
    # the same where the repeated id isn't the smallest
    turned = df.selectExpr("100 - doc_id AS doc_id", "text").where("text is not null")
    assert {x["doc_id"]: x["component_id"] for x in near_dedup.link(turned).collect()} == {99: 88, 90: 88, 89: 88, 88: 88, 95: 95}


def test_estimate_is_close(texts):
    hashes, bounds = textbuf.shingle_sets(*textbuf.buffer_of(pa.array(texts[40:56])))
    z, m = near_dedup.sketches(hashes, bounds)
    found, _ = near_dedup.estimate(z[[0]].repeat(15, 0), m[[0]].repeat(15, 0), z[1:], m[1:])
    true = [len(shingles(texts[40]) & shingles(t)) / len(shingles(texts[40]) | shingles(t)) for t in texts[41:56]]
    assert np.abs(found - true).max() < 0.2


def small_edges(r):
    return [(int(a), int(b)) for a, b in r.integers(0, 300, (200, 2))] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, 2000 + k) for k in range(1, 50)]


@pytest.mark.parametrize("scale", [1, 3_000_000_000_000_001, -3_000_000_000_000_001])
def test_components(spark, scale):
    r = np.random.default_rng(5)
    edges = [(a * scale, b * scale) for a, b in small_edges(r)]
    nodes = {n for e in edges for n in e}
    found = {x["node"]: x["component"] for x in graph.components(spark.createDataFrame(edges, graph.EDGES).repartition(5)).collect()}
    expected = components(nodes, edges)
    assert all(found.get(n, n) == expected[n] for n in nodes) and all(n != c for n, c in found.items())
    assert graph.components(spark.createDataFrame([], graph.EDGES)).count() == 0


def removed(rows, length=50):
    first = {}
    for i, t in sorted((i, (t or "").encode()) for i, t in rows):
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], i)
    out = defaultdict(list)
    for i, t in rows:
        raw = (t or "").encode()
        covered = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if first[raw[k : k + length]] < i:
                covered[k : k + length] = b"\1" * length
        out[i].append((len(raw), sum(covered), len(re.findall(b"\1+", bytes(covered))), hashlib.sha256(bytes(b for b, x in zip(raw, covered, strict=True) if not x)).hexdigest()))
    return out


def test_repeats(docs, empty, texts):
    rows = [(3 * i - 20, t) for i, t in enumerate(texts)]
    expected = removed(rows)
    found = suffix_dedup.digests(docs).collect()
    assert len(found) == len(rows) and sum(r["n_removed"] for r in found) > 5_000
    for r in found:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == expected[r["doc_id"]][0]
    assert suffix_dedup.digests(empty).count() == 0
    trimmed = suffix_dedup.trimmed(docs)
    assert trimmed.columns == docs.columns and trimmed.count() == len(rows)


def test_periodic_and_repeated_rows(spark):
    rows = [(1, "ab" * 300), (2, "x" + "ab" * 100 + "y"), (2, "x" + "ab" * 100 + "y"), (3, "ba" * 60), (4, "é" * 60), (5, "z" + "é" * 60), (6, "short")]
    expected = removed(rows)
    for r in suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == expected[r["doc_id"]][0]
    with pytest.raises(ValueError):
        suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string"), 10)


def test_radix_groups():
    r = np.random.default_rng(2)
    text = r.integers(97, 99, 400).astype(np.uint8)
    starts = np.arange(0, 380)
    found = suffix_dedup.radix_groups(text, starts, np.zeros(380, np.int64), 20 - 8)
    windows = [text[s : s + 12].tobytes() for s in starts]
    for i in range(380):
        equal = [j for j in range(380) if windows[j] == windows[i]]
        assert (found[i] == -1) == (len(equal) == 1)
        assert all(found[j] == found[i] for j in equal)


def vectors(n=400):
    r = np.random.default_rng(4)
    x = r.normal(size=(n, 64))
    for k in range(60):
        x[100 + k] = x[k] + 0.15 * r.normal(size=64) * (0.2 + k / 60)
    x[200:260] = x[300] + 0.09 * r.normal(size=(60, 64))  # a crowd
    x[261] = x[260]
    x[262] = 1000 * x[260]
    return x


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)  # crowds span several blocks
    x = vectors()
    label = np.arange(len(x)) % 2
    label[200:260], label[260:263] = 1, 0
    rows = [(i, [float(v) for v in np.float32(e)], int(k), "clash") for i, (e, k) in enumerate(zip(x, label, strict=True))]
    odd = [(900, None, 1, ""), (901, [0.0] * 64, 1, ""), (902, [float("nan")] * 64, 1, ""), (903, [None] * 64, 1, ""), (904, rows[0][1], None, ""), (905, [], 1, ""), (906, [1.0, 2.0], 1, ""), (907, [2.0, 4.0], 1, "")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, bucket string").repartition(3)
    u = np.array([r[1] for r in rows], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(linked, False)
    expected = components(range(len(rows)), zip(*map(list, np.nonzero(linked)), strict=True))
    found = {r["vec_id"]: r for r in embed_dedup.link(df).collect()}
    assert len(found) == len(rows) + len(odd) and linked.sum() > 1_500
    recall = sum(min(found[i]["n_links"], int(linked[i].sum())) for i in range(len(rows))) / linked.sum()
    assert recall == 1.0
    for i in range(len(rows)):
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (int(linked[i].sum()), expected[i], expected[i] == i)
    assert all(found[i]["n_links"] == 0 and found[i]["kept"] for i in range(900, 906))
    assert found[907]["component_id"] == 906
    assert embed_dedup.link(df.limit(0)).count() == 0


def pairs_at(cosine, n, d, seed=6):
    r = np.random.default_rng(seed)
    a = r.normal(size=(n, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = r.normal(size=a.shape)
    o -= (o * a).sum(axis=1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine**2) * o


@pytest.mark.parametrize("vectors_", [1_000, 100_000, 10_000_000])
def test_hash_recall(vectors_):
    shape = embed_dedup.shape_for(vectors_, 64)
    a, b = pairs_at(0.98, 2_000, 64)
    (ca, va), (cb, vb) = embed_dedup.codes(a, shape), embed_dedup.codes(b, shape)
    met = (ca == cb) | (va == cb[:, :, None]).any(axis=2) | (vb == ca[:, :, None]).any(axis=2)
    assert met.mean() > 0.55 and met.any(axis=1).mean() > 0.999


def test_unlike_vectors_rarely_meet():
    """Candidates a vector stay as many, however many vectors there are."""
    r = np.random.default_rng(8)
    for n in (1_000, 4_000, 16_000):
        shape = embed_dedup.shape_for(n, 64)
        x = r.normal(size=(n, 64))
        own, others = embed_dedup.codes(x / np.linalg.norm(x, axis=1, keepdims=True), shape)
        met = 0
        for t in range(shape.tables):
            homes = dict(zip(*np.unique(own[:, t], return_counts=True), strict=True))
            met += sum(homes.get(c, 0) for c in np.append(own[:, t], others[:, t].ravel()).tolist()) - n
        assert met / n < 6


def test_repeated_ids_of_vectors(spark):
    a, b = pairs_at(0.99, 2, 64)
    rows = [(1, a[0].tolist(), 1), (1, a[1].tolist(), 1), (2, b[0].tolist(), 1), (3, b[1].tolist(), 1), (3, b[1].tolist(), 1), (4, a[0].tolist(), 2), (None, a[0].tolist(), 1), (5, None, 1)]
    found = sorted(tuple(r) for r in embed_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).where("vec_id is not null").collect())
    assert found == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True), (5, 0, 5, True)]
