"""Fingerprints, id files, packing and shards against plain Python."""

import hashlib
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fieldledger.llm.dac_files import Codes, read_ids, write_ids
from fieldledger.llm.feistel_shards import shard_documents
from fieldledger.llm.order_minhash import fingerprints
from fieldledger.llm.packing import pack, pack_documents
from fieldledger.llm.tokens import TextEncoder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(5, None), (3, ""), (9, "one"), (7, "a b a b a b a b"), (7, "a b a b a b a b"), (1, "word " * 9000), (4, "x\ty\x0bz é 'S"), (12, "<|endoftext|> A.,b, C"), (None, "no id here at all")]
    return spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, source string, _slice int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_codes_give_random_access():
    rng = np.random.default_rng(1)
    for ids in (np.array([1]), np.array([0, 255, 256, 65535, 65536, 1 << 31]), rng.integers(0, 49408, 5000), np.full(1500, 300), np.arange(200)):
        c = Codes.of(ids)
        assert [c.token(i) for i in range(len(ids))] == ids.tolist()
        for a, b in ((0, len(ids)), (len(ids) // 3, len(ids) // 2), (len(ids), len(ids))):
            assert c.slice(a, b).tolist() == ids[a:b].tolist()


def test_word_by_word_ids_equal_whole_text_ids(docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [r[0] for r in docs.select("text").collect()] + ["", " ", "it's I'LL 12.5,3 é Å Å İx ΣΑΣ, a.. b., $.$,  x　y", "<|endoftext|>a <|STARTOFTEXT|>", "é. 日本,x 9, _a_. \x1c\x85."]
    got = TextEncoder(public_tokenizers.path("word_bpe_49k.json"), room=5000)(texts)
    for text, ids in zip(texts, got, strict=True):
        assert t.encode(text, add_special_tokens=False).ids == ids.tolist(), text[:50]


def expected_ids(rows):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [(i, t.encode(x or "", add_special_tokens=False).ids + [1]) for i, x in rows]


def test_id_files(spark, odd, docs):
    for d in (odd, docs):
        rows = sorted(((r.doc_id, r.text) for r in d.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        got = sorted(map(tuple, read_ids(spark, write_ids(d, slice_bytes=100_000)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
        at = 0
        for (i, ids), g in zip(expected_ids(rows), got, strict=True):
            assert g == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            at += len(ids)


def test_packing_of_lengths():
    rng = np.random.default_rng(3)
    for sizes in ([], [10], [4, 6, 6, 4, 10], [7, 7, 7, 2, 1], rng.integers(1, 11, 400).tolist(), rng.integers(4, 11, 300).tolist(), [1] * 101):
        h = {int(s): sizes.count(s) for s in set(sizes)}
        runs, n = pack(h, 10)
        room, placed = [[] for _ in range(n)], []
        for length, rank, count, seq, at in runs:
            for k in range(count):
                room[seq + k].append((at, length))
                placed.append((length, rank + k))
        assert sorted(placed) == sorted((s, k) for s, c in h.items() for k in range(c))
        for r in room:
            end = 0
            for at, length in sorted(r):
                assert at == end
                end += length
            assert 0 < end <= 10
        assert n <= -(-sum(sizes) // 10) + max(1, len(sizes) // 4)
    assert pack({6: 5, 4: 5}, 10)[1] == 5 and pack({10: 3, 9: 2, 1: 2}, 10)[1] == 5


def test_packed_documents(odd, docs):
    for d, capacity in ((odd, 64), (docs, 4096)):
        got = pack_documents(d, capacity).toPandas()
        want = []
        for i, ids in expected_ids((r.doc_id, r.text) for r in d.collect()):
            want += [(i, k, a, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), capacity)) for p in [ids[a : a + capacity]]]
        have = [tuple(None if pd.isna(v) else int(v) for v in r) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
        assert sorted(have, key=str) == sorted(want, key=str)
        for _, s in got.groupby("sequence_id"):
            s = s.sort_values("offset")
            assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= capacity
        assert got.sequence_id.nunique() <= -(-got.length.sum() // capacity) + 2


def test_shards(odd, docs):
    for d in (odd, docs):
        got = shard_documents(d).toPandas()
        n = got.groupby("shard").size().reindex(range(24), fill_value=0)
        assert n.max() - n.min() <= 1 and len(got) == d.count()
        assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard").slot)
        size = {r.doc_id: (len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in d.collect()}
        assert all(size[None if pd.isna(r.doc_id) else int(r.doc_id)] == (r.size_, r.text_crc32) for r in got.rename(columns={"size": "size_"}).itertuples())
        again = shard_documents(d.repartition(3)).toPandas()
        key = ["doc_id", "shard", "slot"]
        assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))


def test_fingerprints(odd, docs):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    rows.sort(key=lambda r: -r[0])
    want = {}
    for k, (i, text) in enumerate(rows):
        cut = len(text) // 3
        want[i] = (len(text), hashlib.sha256((text[: len(text) - cut] + rows[(k + 1) % len(rows)][1][:cut]).encode()).hexdigest())
    got = {r.doc_id: r for r in fingerprints(docs).collect()}
    assert {i: (r.n_chars, r.edited_sha256) for i, r in got.items()} == want
    by_text = pd.DataFrame([(t, got[i].fingerprint) for i, t in rows], columns=["t", "f"]).groupby("t").f.nunique()
    assert (by_text == 1).all()
    long = [r for i, r in got.items() if r.n_chars > 500]
    assert sum(r.near_edited for r in long) > 5 * sum(r.near_next for r in long)
    few = {(r.doc_id, r.n_chars): r for r in fingerprints(odd).collect()}
    assert len(few) == 8 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in few.values())
    assert few[(9, 3)].edited_sha256 == hashlib.sha256(b"ona").hexdigest()
    assert few[(5, 0)].fingerprint == few[(3, 0)].fingerprint


def test_order_counts(spark):
    """The same pieces in another order give another fingerprint."""
    words = [f"w{k}" for k in range(300)]
    rows = [(3, " ".join(words)), (2, " ".join(words[150:] + words[:150])), (1, " ".join(words[:290]))]
    got = {r.doc_id: r for r in fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 0.3 < got[3].near_next < 0.8


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert shard_documents(none).count() == 0 and pack_documents(none).count() == 0
    assert read_ids(spark, write_ids(none)).count() == 0 and fingerprints(none).count() == 0
