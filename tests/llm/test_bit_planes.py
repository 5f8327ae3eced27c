"""Hard negatives against plain integer arithmetic."""

import math

import numpy as np
import pytest

from fieldledger.llm.bit_planes import hard_negatives, mine, planes, scaled, scores, subset_sums


def plain(rows):
    """(vec_id, label, vector) -> expected rows; vectors of one length without odd values."""
    v = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * x) for x in vec]) for i, lab, vec in rows]
    out = []
    for i, lab, a in v:
        if i % 100:
            continue
        near = sorted(((-sum(x * y for x, y in zip(a, b, strict=True)), j, m) for j, m, b in v if j != i))
        for p, j, _ in [x for x in near if x[2] == lab][:5]:
            fits = [x for x in near if x[2] != lab and 30 * -p <= 100 * -x[0] <= 90 * -p][:10]
            out += [(i, j, r + 1, x[1], -p, -x[0]) for r, x in enumerate(fits)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(v, i, lab, "x") for i, lab, v in rows], "embedding array<float>, vec_id long, label int, row string")


@pytest.mark.parametrize("size", [3, 8, 21])
def test_against_plain_sums(spark, size):
    rng = np.random.default_rng(size)
    rows = [(i, int(rng.integers(3)), [float(np.float32(x)) for x in rng.integers(-3, 4, size) / 4]) for i in range(0, 2000, 5)]
    assert sorted(tuple(r) for r in hard_negatives(frame(spark, rows)).collect()) == plain(rows)


def test_blocks_do_not_change_the_result(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(2)), [float(x) for x in rng.normal(size=4).astype(np.float32)]) for i in range(150)]
    got = scaled(frame(spark, rows))
    whole = sorted(tuple(r) for r in mine(got, got.where("vec_id % 3 = 0")).collect())
    assert whole and whole == sorted(tuple(r) for r in mine(got, got.where("vec_id % 3 = 0"), part=16, chunk=4).collect())


def test_lookup_sums_are_exact():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-5000, 5000, (3, 13)), rng.integers(-70000, 70000, (50, 13))
    t, p = subset_sums(a), planes(b, 18)
    for k in range(3):
        assert (scores(t[k], p) == b @ a[k]).all()


def test_odd_rows(spark):
    good = [(100, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 2, [0.5, 0.5]), (3, 2, [0.5, 0.5]), (200, 3, [0.0, 0.0]), (4, 3, [0.0, 0.0]), (5, 4, [0.0, 1.0])]
    odd = [(6, None, [1.0, 1.0]), (8, 2, None), (9, 2, [float("nan"), 1.0]), (10, 2, [None, 1.0]), (11, 2, [float("inf"), 0.0]), (12, 2, [1.0]), (None, 2, [0.5, 0.5]), (13, 2, [])]
    twice = [(2, 2, [0.5, 0.5])]
    assert sorted(tuple(r) for r in hard_negatives(frame(spark, good + odd + twice)).collect()) == plain(good)


def test_empty(spark):
    d = hard_negatives(frame(spark, []))
    assert d.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and not d.collect()


def test_scores_past_64_bits_raise(spark):
    with pytest.raises(ValueError):
        hard_negatives(frame(spark, [(100, 1, [1e30, 1.0]), (1, 1, [1e30, 1.0])]))
