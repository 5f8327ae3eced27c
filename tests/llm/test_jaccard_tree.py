"""Near-duplicate components against all pairs."""

import random

import numpy as np

from fieldledger.llm.components import components
from fieldledger.llm import jaccard_tree
from fieldledger.llm.jaccard_tree import joining, needed, near_components, search


def plain(rows):
    sets = []
    for _, t in rows:
        w = bytes((t or "").encode()).lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    part = list(range(len(rows)))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                part[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), 1 << 60), i)
    return sorted(((i, len(s), least.get(root(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(spark, rows):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, n int")
    return sorted((tuple(r) for r in near_components(df).collect()), key=str)


def near(r, words, edits):
    w = list(words)
    for _ in range(edits):
        w[r.randrange(len(w))] = f"q{r.randrange(9999)}"
    return w


def test_groups_of_near_copies(spark):
    r = random.Random(4)
    rows = [(None, "a b c d e f"), (None, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one TWO"), (5, "one two three"), (6, "x y z v w"), (7, "X y z v w")]
    line = [f"l{k}" for k in range(30)]
    for g in range(25):
        base = [r.choice("abcdefghijklm") * r.randint(1, 4) for _ in range(r.randint(6, 220))]
        for _ in range(r.choice([1, 2, 3, 40])):
            w = near(r, base, r.randint(0, max(1, len(base) // 25)))
            w = w + line if r.random() < 0.3 else w
            rows.append((len(rows) + 100, " ".join(w)))
    rows += [(9000, " ".join(f"long{k % 5000}" for k in range(30000))), (9001, " ".join(f"Long{k % 5000}" for k in range(29990)))]
    rows += rows[-4:]
    assert got(spark, rows) == plain(rows)


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 600").collect()]
    assert got(spark, rows) == plain(rows)


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 6, (12, 64))
    points = np.abs(base[rng.integers(0, 12, 400)] + rng.integers(-1, 2, (400, 64)) * (rng.random((400, 64)) < 0.2)).astype(np.uint16)
    size, part = points.sum(axis=1).astype(np.int64), rng.integers(0, 30, 400)
    i, j = search(points, size, part)
    want = {(a, b) for a in range(400) for b in range(a) if part[a] != part[b] and 5 * min(size[a], size[b]) >= 4 * max(size[a], size[b]) and np.minimum(points[a], points[b]).sum() >= needed(size[a], size[b])}
    assert {(max(a, b), min(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == want and want


def test_links_not_pairs():
    """A tree of n near copies in n parts gives n - 1 links, not n * (n - 1) / 2 pairs, and none to a set of others."""
    common = np.arange(95)
    sets = [np.append(common, [100 + k]) for k in range(300)] + [np.append(np.arange(40), np.arange(1000, 1056))]
    points = np.zeros((301, 64), np.uint16)
    points[:, 0] = 96
    part, none = np.arange(301), np.zeros(301, np.int64)
    found = joining(points, sets, part, 80, (none + 96, none), [np.arange(301), np.arange(301)])
    assert len(found) == 299 and len(set(part[:300])) == 1 and part[300] != part[0]


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    """Near copies in chains that fit no single task: every two blocks meet."""
    monkeypatch.setattr(jaccard_tree, "HELD", 1500)
    monkeypatch.setattr(jaccard_tree, "CENTRES", 1)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[2 * k : 2 * k + 60])) for k in range(150)]
    assert got(spark, rows) == plain(rows) and len({c for _, _, c in plain(rows)}) == 1


def test_components(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(40)] + [(r.randrange(100, 400), r.randrange(100, 400)) for _ in range(150)] + [(500, k) for k in range(501, 600)]
    part = {x: x for e in edges for x in e}
    for _ in range(len(part)):
        for a, b in edges:
            part[a] = part[b] = min(part[a], part[b])
    have = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert have == {k: v for k, v in part.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_empty_table(spark):
    assert near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
