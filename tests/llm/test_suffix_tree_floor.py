"""Two sightings are enough for a context of any length; the divergence test alone decides."""

import math
import zlib

from fieldledger.llm.suffix_tree import NATS, STRENGTH, scores


def test_two_word_contexts_seen_twice(spark):
    """`b` stands before 12 words, twice before each, and the word before `b` tells which; by hand."""
    texts = [f"{w} b {w}{w}" for w in "acdefghijklm" for _ in (0, 1)] + [f"u{k} v{k}" for k in range(20)]
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 1]
    d = spark.createDataFrame(list(zip(ids, texts, strict=False)), "doc_id long, text string")
    got = {k: {r.doc_id: r.score for r in scores(d, depth=k).collect()} for k in (1, 2)}
    n, v = 24 * 4 + 20 * 3, 12 + 1 + 12 + 40 + 1
    root = 2.5 / (n + 0.5 * (v + 1))
    behind_b = (2 + STRENGTH * root) / (24 + STRENGTH)
    assert 24 * math.log(1 / (23 + STRENGTH) / root) > NATS  # `b` is kept
    assert 2 * math.log(1 / (1 + STRENGTH) / behind_b) > NATS  # and so is `a b`
    behind_a_b = (2 + STRENGTH * behind_b) / (2 + STRENGTH)
    for i in ids[:24]:
        assert abs(got[2][i] - got[1][i] - math.log10(behind_a_b / behind_b)) < 1e-6
    assert all(got[2][i] == got[1][i] for i in ids[24:44])
