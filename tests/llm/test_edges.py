"""Texts made to collide, hot phrases, very long texts, clashing names."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tillstats.llm import bpe, chunkcode, common, fingerprints, near_dedup, sstable, suffix_dedup, textbuf, tokens, url_filter

RANKS, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


def thue_morse(n):
    """Two complementary words that collide under every polynomial hash modulo 2^64 from 1,024 letters on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


PAIRS = [t for n in (1_024, 4_096) for t in thue_morse(n)]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(list(enumerate(PAIRS, 1)), "doc_id long, text string").coalesce(1)


def test_colliding_texts_have_their_own_ids(spark, pairs):
    from tokenizers import Tokenizer

    byte, word = bpe._encoding(RANKS, public_tokenizers.PATTERN), Tokenizer.from_file(WORDS)
    for r in bpe.digests(pairs, RANKS, public_tokenizers.PATTERN).collect():
        ids = byte.encode_ordinary(PAIRS[r["doc_id"] - 1])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    for r in sstable.round_trip(pairs, WORDS).collect():
        ids = [*word.encode(PAIRS[r["doc_id"] - 1], add_special_tokens=False).ids, 2]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_colliding_texts_are_unlike(pairs):
    assert all(r["near_next"] < 0.1 for r in fingerprints.edited(pairs).collect())
    assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in near_dedup.link(pairs).collect())


def test_chunks_of_one_hash_are_told_apart(monkeypatch, texts):
    monkeypatch.setattr(textbuf, "keyed", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    encode = bpe._encoding(RANKS, public_tokenizers.PATTERN).encode_ordinary
    coder = chunkcode.ChunkEncoder(chunkcode.one_by_one(lambda rows: [encode(t) for t in rows]), bpe._chunks)
    for t in [*texts, *texts]:
        assert coder.encode(*textbuf.buffer_of(pa.array([t])))[0].tolist() == encode(t or "")


def test_long_texts_are_edited(spark):
    r = random.Random(4)
    long = " ".join("".join(r.choice("abcdef") for _ in range(6)) for _ in range(200_000))
    rows = [(5, long), (4, "a b c d e f g"), (3, long[:1_200_000]), (2, None), (1, long)]
    found = {x["doc_id"]: x for x in fingerprints.edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = [t or "" for _, t in rows]
    for (i, _), own, after in zip(rows, texts, [*texts[1:], texts[0]], strict=True):
        half = len(own) // 2
        assert found[i]["n_chars"] == len(own) and found[i]["edited_sha256"] == hashlib.sha256((own[: len(own) - half] + after[:half]).encode()).hexdigest()
    assert found[5]["fingerprint"] == found[1]["fingerprint"] and found[1]["near_next"] == 1.0


def brute_sets(texts, words=5):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("one_hash", [False, True])
def test_exact_sets(monkeypatch, texts, one_hash):
    if one_hash:
        monkeypatch.setattr(textbuf, "mix", lambda x: np.zeros_like(x))
    some = [t or "" for t in texts[30:70]]
    shingles, bounds = near_dedup.exact_sets(pa.array(some))
    sets = [set(shingles[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    true = brute_sets(some)
    for i in range(len(some)):
        assert len(sets[i]) == len(true[i])
        assert all(len(sets[i] & sets[j]) == len(true[i] & true[j]) for j in range(i))


def test_sip_hash():
    # The published outputs of SipHash-2-4 under the key 00..0f for inputs 00.. of 0, 1, 8 and 15 bytes.
    expected = ["310e0edd47db6f72", "fd67dc93c539f874", "6224939a79f5f593", "e545be4961ca29a1"]
    key, textbuf._SIP_KEY = textbuf._SIP_KEY, tuple(np.frombuffer(bytes(range(16)), "<u8").astype(np.uint64))
    try:
        found = textbuf.keyed(np.arange(16, dtype=np.uint8), np.zeros(4, np.int64), np.array([0, 1, 8, 15]))
    finally:
        textbuf._SIP_KEY = key
    assert [h.tobytes().hex() for h in found.astype("<u8")] == expected


def test_long_text_is_one_set():
    r = random.Random(3)
    text = "\n".join(" ".join("".join(r.choice("abcdef") for _ in range(r.randint(1, 9))) for _ in range(40)) for _ in range(15_000))
    hashes, bounds = textbuf.shingle_sets(*textbuf.buffer_of(pa.array([text])))
    assert len(text) > 2 * textbuf.SLICE_BYTES and bounds.tolist() == [0, len(brute_sets([text])[0])]
    # the same text in a slice with another is hashed alike
    part = text[:60_000].rsplit(" ", 1)[0]
    own, at = textbuf.shingle_sets(*textbuf.buffer_of(pa.array([part, "x"])))
    assert np.isin(own[: at[1]], hashes).all()


@pytest.mark.parametrize("text", ["日本語 テスト、 文 です。 " * 60_000, "हिन्दी पाठ है 　 और शब्द " * 30_000, "x" * 300_000, "a b " * 50_000])
def test_long_texts_keep_their_ids(text):
    encode = bpe._encoding(RANKS, public_tokenizers.PATTERN).encode_ordinary
    data, offs = textbuf.buffer_of(pa.array([text]))
    if " " in text and " " not in text:
        assert len(bpe.safe_cuts(data)) > 10_000
    coder = chunkcode.ChunkEncoder(chunkcode.one_by_one(lambda rows: [encode(t) for t in rows]), bpe._chunks)
    assert coder.encode(data, offs)[0].tolist() == encode(text)
    assert tokens.coder(WORDS).encode(data, offs)[1][-1] > 0


def removed(rows, length=50):
    first, out = {}, defaultdict(list)
    for i, t in sorted((i, (t or "").encode()) for i, t in rows):
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], i)
    for i, t in rows:
        raw = (t or "").encode()
        covered = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if first[raw[k : k + length]] < i:
                covered[k : k + length] = b"\1" * length
        out[i] = (len(raw), sum(covered), hashlib.sha256(bytes(b for b, x in zip(raw, covered, strict=True) if not x)).hexdigest())
    return out


def hot_phrase(n, seed=5):
    """Documents that share a phrase of 40 bytes in ever new surroundings; some surroundings come twice."""
    r = random.Random(seed)
    phrase = "all rights reserved by the owner of this"[:40]
    assert len(phrase) == 40

    def noise():
        return "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(30))

    out = []
    for i in range(n):
        text = f"{noise()}{phrase}{noise()}"
        if i % 50 == 7:
            text = out[i - 3][1][3:] + noise()
        out.append((i, text))
    return out


def test_hot_phrase_is_removed_exactly(spark):
    rows = hot_phrase(5_000)
    expected = removed(rows)
    found = suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sum(e[1] for e in expected.values()) > 5_000
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in found} == expected


def test_hot_phrase_spreads_over_partitions():
    parts, chunks = 211, []
    rows = hot_phrase(2_000)
    for c in range(3):
        own = [x for x in rows if x[0] % 3 == c]
        chunks.append(suffix_dedup.Chunk(pa.table({"doc_id": pa.array([i for i, _ in own], pa.int64()), "text": pa.array([t for _, t in own])}), 50))
    said = defaultdict(list)
    for c, chunk in enumerate(chunks):
        for to, body in chunk.announced(parts):
            said[to].append((c, body))
    live = [dict() for _ in chunks]
    for to, bodies in said.items():
        for c, body in suffix_dedup.alive(bodies):
            live[c][to] = body
    load = np.zeros(parts)
    for c, chunk in enumerate(chunks):
        for to, body in chunk.sent(parts, live[c]):
            load[to] += len(body)
    assert load.max() < 0.05 * load.sum() and (load > 0).all()


def test_long_text_loses_its_repeats(spark):
    r = random.Random(9)
    base = "".join(r.choice("abcdefgh \n") for _ in range(1_500_000))
    rows = [(1, base[700_000:700_400]), (2, base), (3, "y" + base[1_048_500:1_048_700])]
    found = {x["doc_id"]: x for x in suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (found[1]["n_removed"], found[2]["n_removed"], found[2]["n_spans"], found[3]["n_removed"]) == (0, 400, 1, 200)
    assert found[2]["kept_sha256"] == hashlib.sha256((base[:700_000] + base[700_400:]).encode()).hexdigest()


def test_clashing_names_survive(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, "a", 1), (2, text, "b", 2), (3, "other", "c", 3)], "doc_id long, text string, __gone string, rep int")
    kept = near_dedup.keep_first(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_ties_and_odd_pages(spark):
    rules = [("a.org", "/x/", "block"), ("a.org", "/x/", "allow"), ("org", "/", "allow")]
    rows = [(1, "http://a.org/x/1"), (1, "http://a.org/x/1"), (None, "http://b.org/"), (2, None), (3, ""), (4, "no scheme")]
    found = [tuple(r)[:5] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()]
    assert sorted(found, key=str) == sorted(
        [(1, "a.org", "/x/1", "a.org/x/", "allow")] * 2 + [(None, "b.org", "/", "org/", "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "", "", None, "allow")], key=str
    )


def test_no_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        common.shared_folder(Session())
