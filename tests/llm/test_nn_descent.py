"""Neighbour search against all distances."""

import numpy as np

from fieldledger.llm.nn_descent import nearest


def frame(spark, rows):
    return spark.createDataFrame([(v, i, 1, "x") for i, v in rows], "embedding array<float>, vec_id long, node int, home string")


def plain(rows, top=10):
    ids, v = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=float)
    out = []
    for i in sorted(set(ids[ids % 100 == 0].tolist())):
        d = np.sqrt(((v - v[ids == i][0]) ** 2).sum(1))
        near = [k for k in np.lexsort((ids, d)) if ids[k] != i][:top]
        out += [(i, r + 1, int(ids[k]), float(d[k])) for r, k in enumerate(near)]
    return out


def same(got, want):
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want])


def test_recall_of_a_graph_of_many_blocks(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 12)) * 4
    rows = [(i, [float(x) for x in (centre[i % 6] + rng.normal(size=12)).astype(np.float32)]) for i in range(3000)]
    got = [tuple(r) for r in nearest(frame(spark, rows), k=12, home=512, leaf=96).collect()]
    want = plain(rows)
    exact = {(q, i): s for q, _, i, s in want}
    hits = [(q, i, s) for q, _, i, s in got if (q, i) in exact]
    assert len(got) == len(want) and len(hits) >= 0.9 * len(want)
    assert all(abs(exact[q, i] - s) < 1e-9 for q, i, s in hits)
    assert all(a[0] != b[0] or a[3] <= b[3] for a, b in zip(sorted(got), sorted(got)[1:], strict=False))


def test_copies_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    many = [(i, [1.0, 2.0]) for i in range(0, 260)]  # more copies than a list holds
    rows = many + [(i, [float(x) for x in rng.normal(size=2).astype(np.float32)]) for i in range(260, 330)]
    odd = [(400, None), (401, [0.0, 0.0]), (402, [float("nan"), 1.0]), (403, [None, 1.0]), (404, [1.0]), (None, [1.0, 2.0]), (405, []), (500, [float("inf"), 0.0])]
    got = sorted(tuple(r) for r in nearest(frame(spark, rows + odd + rows[:3])).collect())
    same(got, sorted(plain(rows)))


def test_few_rows_and_none(spark):
    rows = [(100, [1.0, 0.0, 0.0]), (7, [0.0, 1.0, 0.0]), (8, [1.0, 1.0, 0.0])]
    same(sorted(tuple(r) for r in nearest(frame(spark, rows)).collect()), plain(rows))
    assert nearest(frame(spark, [(100, [1.0])])).collect() == []
    none = nearest(frame(spark, []))
    assert none.columns == ["query_id", "rank", "vec_id", "score"] and not none.collect()
