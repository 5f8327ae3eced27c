"""Keys are numbered by a sort of numbers, bytes are looked at as whole arrays; values stay what they were."""

import numpy as np
import pyarrow as pa
import pytest

from fieldledger.llm import suffix_tree
from fieldledger.llm.common import Words, distinct, folded, is_break, mix
from fieldledger.llm.keyed import Dealt


def test_no_sort_of_places_for_the_tokens_of_a_batch(monkeypatch):
    """`np.unique` with the inverse sorts the places of all tokens, which took a third of the time of all rounds."""
    rows = pa.table({"text": ["a b c a b", None, "B c"], "held_out": [False, True, False]})

    def never(*_, **__):
        pytest.fail("places of all tokens are sorted")

    monkeypatch.setattr(np, "unique", never)
    t = suffix_tree.Tokens(rows)
    e = suffix_tree.Entries(t.word, 3)
    asked = e.table(0, 0, n=e.sums(t.train).astype(np.int32))
    which, _, _ = suffix_tree._asked(asked)
    assert sorted(suffix_tree.unpacked(asked.column("n"), np.int32)[0]) == [2, 2, 2, 3] and sorted(which) == [0, 1, 2, 3]
    assert (e.keys[e.which] == t.word).all()


def _same(keys):
    before = keys.copy()
    got, want = distinct(keys), np.unique(keys, return_inverse=True)
    assert got[0].dtype == keys.dtype and (got[0] == want[0]).all() and len(got[0]) == len(want[0])
    assert len(got[1]) == len(want[1]) and (got[1] == want[1]).all() and (keys == before).all()


def test_distinct_keys():
    r = np.random.default_rng(5)
    whole = mix(r.integers(0, 4000, 20_000).astype(np.uint64))
    _same(whole)
    _same(whole >> np.uint64(20))  # short keys keep all their bits
    _same(whole >> np.uint64(53) << np.uint64(53))
    for n in range(4):
        _same(whole[:n])
        _same(np.full(n, 2**64 - 1, np.uint64))
        _same(np.zeros(n, np.uint64))
    top = np.uint64(1) << np.uint64(63)  # alike in the high bits, mixed by place
    _same(np.concatenate([whole, top + r.integers(0, 3, 5000).astype(np.uint64)]))


def test_bytes_and_words():
    every = np.arange(256, dtype=np.uint8)
    assert set(np.flatnonzero(is_break(every))) == {0x20, 9, 10, 11, 12, 13}
    assert folded(every).tobytes() == every.tobytes().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
    w = Words(pa.array(["Ab\x0bÉ@[`{ Z", None, "", " q"]), fold=True)
    assert [w.text(i).decode() for i in range(len(w.start))] == ["ab", "É@[`{", "z", "q"] and list(w.count) == [3, 0, 0, 1]
    x = np.array([0, 1, 2**64 - 1], np.uint64)
    assert mix(x).tolist() == [0, 0x5692161D100B05E5, 0xB4D055FCF2CBBD7B] and x.tolist() == [0, 1, 2**64 - 1]


@pytest.mark.parametrize("buckets", [1, 8, 2500, 1 << 16, (1 << 16) + 1])
def test_dealt_in_the_order_of_keys(buckets):
    keys = np.unique(mix(np.arange(5000, dtype=np.uint64)))
    d, bucket = Dealt(keys, buckets), (keys >> np.uint64(17)) % np.uint64(buckets)
    order = np.lexsort([np.arange(len(keys)), bucket])
    want, first = np.unique(bucket[order], return_index=True)
    assert (d.order == order).all() and d.bucket.dtype == np.int32 and (d.bucket == want).all()
    assert d.ends.tolist() == [*first[1:].tolist(), len(keys)] and d.first == dict(zip(want.tolist(), first.tolist(), strict=True))
    none = Dealt(keys[:0], buckets)
    assert len(none.order) == len(none.bucket) == len(none.ends) == len(none.first) == 0


@pytest.mark.parametrize("kind", [np.int32, np.int64, np.float32])
def test_packed_lists(kind):
    values, ends = np.array([0, -1, 3, 70_000, -70_000, 5], kind), np.array([1, 4, 6])
    got, row = suffix_tree.unpacked(pa.chunked_array([suffix_tree.packed(values, ends)]), kind)
    assert (got == values).all() and got.dtype == kind and row.tolist() == [0, 1, 1, 1, 2, 2]
    assert len(suffix_tree.packed(values[:0], ends[:0])) == 0
