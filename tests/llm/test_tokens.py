import hashlib
import struct
import zlib
from collections import defaultdict
from io import BytesIO

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillstats.llm import bpe, packing, sstable, textbuf, tokens

RANKS, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
ODD = st.text(st.sampled_from("aZé ñ\n\t\r\u00a0\u2003\u3000'sl,.;1日\u0301Σİ"), max_size=40)


@pytest.fixture(scope="module")
def word_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=5))
def test_cuts_change_no_id(texts):
    direct = bpe._encoding(RANKS, public_tokenizers.PATTERN)
    ids, bounds = bpe._coder(RANKS, public_tokenizers.PATTERN).encode(*textbuf.buffer_of(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [direct.encode_ordinary(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=5))
def test_chunks_change_no_word_id(texts):
    from tokenizers import Tokenizer

    direct = Tokenizer.from_file(WORDS) if not hasattr(test_chunks_change_no_word_id, "t") else test_chunks_change_no_word_id.t
    test_chunks_change_no_word_id.t = direct
    ids, bounds = tokens.coder(WORDS).encode(*textbuf.buffer_of(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [direct.encode(t, add_special_tokens=False).ids for t in texts]


def test_forgetting_changes_nothing(texts):
    from tillstats.llm import chunkcode

    encode = bpe._encoding(RANKS, public_tokenizers.PATTERN).encode_ordinary
    small = chunkcode.ChunkEncoder(chunkcode.one_by_one(lambda rows: [encode(t) for t in rows]), bpe._chunks, most=50)
    for t in texts:
        ids, _ = small.encode(*textbuf.buffer_of(pa.array([t])))
        assert ids.tolist() == encode(t or "")


def test_bpe_digests(docs, empty, texts):
    encode = bpe._encoding(RANKS, public_tokenizers.PATTERN).encode_ordinary
    found = {r["doc_id"]: r for r in bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        r, ids = found[3 * i - 20], encode(t or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(packed(ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    again = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert again.where("decode(decoded, 'UTF-8') <> coalesce(text, '')").count() == 0


def check_packing(rows, by_id, capacity=2048):
    bins = defaultdict(list)
    covered = defaultdict(list)
    for r in rows:
        ids = by_id[r["doc_id"]]
        assert r["start"] == capacity * r["piece"] and r["ids_crc32"] == zlib.crc32(packed(ids[r["start"] : r["start"] + r["length"]]))
        covered[r["doc_id"]].append(r["length"])
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {k: sum(v) for k, v in covered.items()} == {k: len(v) for k, v in by_id.items()}
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(docs, empty, texts, word_tokenizer):
    by_id = {3 * i - 20: [*word_tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    n = check_packing(packing.pack(docs, WORDS).collect(), by_id)
    assert n <= -(-sum(map(len, by_id.values())) // 2048) + 1
    assert packing.pack(empty, WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), min_size=1, max_size=20), st.sampled_from(["norm", "dot"]), st.sampled_from([None, 3]), st.sampled_from([None, 64 * 64]))
def test_plan_keeps_every_capacity(histogram, score, documents, attention):
    plan = packing.plan(np.array(list(histogram)), np.array(list(histogram.values())), packing.Capacities(64, documents, attention), score)
    bins = defaultdict(list)
    for length, n in histogram.items():
        own = np.flatnonzero(plan["length"] == length)
        assert sorted(r for i in own for r in range(plan["rank"][i], plan["rank"][i] + plan["pieces"][i])) == list(range(n))
    for i in range(len(plan["length"])):
        for k in range(plan["pieces"][i]):
            bins[plan["sequence"][i] + k].append((plan["offset"][i], plan["length"][i]))
    for placed in bins.values():
        placed.sort()
        assert [o for o, _ in placed] == [sum(x for _, x in placed[:k]) for k in range(len(placed))]
        assert sum(x for _, x in placed) <= 64 and len(placed) <= (documents or 99) and sum(x * x for _, x in placed) <= (attention or 10**9)
    if not documents:
        # first fit decreasing over single pieces is no better
        rooms = []
        for length in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
            fit = next((j for j, room in enumerate(rooms) if room >= length), None)
            if fit is None:
                rooms.append(64 - length)
            else:
                rooms[fit] -= length
        assert len(bins) <= len(rooms) * 1.1 + 1


def test_every_capacity_acts_where_packing_is_run(spark, docs, monkeypatch):
    import corpus_pipeline
    from tillstats.llm import queries

    plan, used = packing.plan, []

    def noted(lengths, counts, capacities, score):
        used.append(capacities)
        return plan(lengths, counts, capacities, score)

    monkeypatch.setattr(packing, "plan", noted)
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    assert queries.op2_best_fit_packing(spark, "").count() == corpus_pipeline.pack(spark, docs, "").count()
    assert len(used) == 2 and all((c.tokens, c.documents, c.attention) == (2048, 2048, 2048**2) for c in used)


def test_further_capacities_choose_bins_but_cost_none():
    r = np.random.default_rng(6)
    lengths, counts = np.arange(1, 2049), r.integers(1, 40, 2048)
    plans = [packing.plan(lengths, counts, c) for c in (packing.Capacities(), packing.SEQUENCE)]
    one, all_ = (p["sequence"] + p["pieces"] for p in plans)
    assert one.max() == all_.max() and any(not np.array_equal(plans[0][k], plans[1][k]) for k in plans[0])


def test_plan_rejects_what_fits_nowhere():
    with pytest.raises(ValueError):
        packing.plan(np.array([65]), np.array([1]), packing.Capacities(64))


def test_shards(spark, docs, empty, texts, word_tokenizer, tmp_path):
    found = {r["doc_id"]: r for r in sstable.round_trip(docs, WORDS).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*word_tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        r = found[3 * i - 20]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(packed(ids)))
        start += len(ids)
    assert sstable.round_trip(empty, WORDS).count() == 0
    manifest = sstable.write(docs, WORDS, str(tmp_path / "s"))
    rows = manifest.orderBy("shard").collect()
    assert [r["first"] for r in rows] == sorted(r["first"] for r in rows) and sum(r["entries"] for r in rows) == len(texts)
    hits = 0
    for r in rows:
        shard = sstable.open_shard(r["path"])
        for i in range(len(texts)):
            ids = shard.get(sstable.key_of(3 * i - 20))
            if ids is not None:
                hits += 1
                assert ids.tolist() == [*word_tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 2]
            assert shard.get(sstable.key_of(3 * i - 19)) is None
    assert hits == len(texts)


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(5, "a b"), (5, "a b"), (None, "c"), (None, None), (-7, "d")], "doc_id long, text string")
    rows = sstable.round_trip(df, WORDS).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, None, -7, 5, 5] and [r["n_tokens"] for r in rows] == [1, 2, 2, 3, 3]
    assert packing.pack(df, WORDS).count() == 5 and bpe.digests(df, RANKS, public_tokenizers.PATTERN).count() == 5


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1), st.lists(st.integers(0, 65_535), max_size=30)), max_size=60, unique_by=lambda x: x[0]), st.integers(1, 300))
def test_shard_format(entries, block):
    entries.sort()
    out = BytesIO()
    writer = sstable.ShardWriter(out, 2, block)
    for key, ids in entries:
        writer.add(sstable.key_of(key), np.array(ids, np.uint32))
    if not entries:
        return
    writer.close()
    shard = sstable.ShardReader(out, len(out.getvalue()))
    assert [(sstable.id_of(k), v.tolist()) for k, v in shard] == entries
    for key, ids in entries:
        assert shard.get(sstable.key_of(key)).tolist() == ids
    with pytest.raises(ValueError):
        writer.add(sstable.key_of(entries[-1][0]), np.zeros(1))


def test_footer_is_checked():
    raw = bytes(sstable.FOOTER.size)
    with pytest.raises(ValueError):
        sstable.ShardReader(BytesIO(raw), len(raw))
    assert struct.calcsize("<QQQIIQQH8s") == sstable.FOOTER.size


def test_lookup(spark, docs, texts, tmp_path, word_tokenizer):
    manifest = sstable.write(docs.unionByName(docs.where("doc_id = 1")), WORDS, str(tmp_path / "shards"))
    wanted = spark.createDataFrame([(3 * i - 20 + k,) for i in range(len(texts)) for k in (0, 1)] + [(10**9,), (-(10**9),), (None,)], "doc_id long")
    found = defaultdict(list)
    for r in sstable.lookup(manifest, wanted).collect():
        found[r["doc_id"]].append(np.frombuffer(r["ids"], "<u4").tolist())
    for i, t in enumerate(texts):
        ids = [*word_tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert found.pop(3 * i - 20) == [ids] * (2 if 3 * i - 20 == 1 else 1)
    assert not found


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab1!\u0301é\0 "), max_size=12), min_size=1, max_size=8))
def test_marks_change_no_word_id(texts):
    from tokenizers import Tokenizer

    direct = Tokenizer.from_file(WORDS) if not hasattr(test_chunks_change_no_word_id, "t") else test_chunks_change_no_word_id.t
    test_chunks_change_no_word_id.t = direct
    ids, bounds = tokens.coder(WORDS).encode(*textbuf.buffer_of(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [direct.encode(t, add_special_tokens=False).ids for t in texts]
