"""Suffix-tree scores against a plain tree over the same words."""

import math
import random
import zlib
from collections import Counter

import fieldledger.llm.suffix_tree as tree
from fieldledger.llm.suffix_tree import scores

FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def plain(rows, depth, nats, a):
    texts = [(i, i is None or zlib.crc32(str(i).encode()) % 5 == 1, [*(t or "").encode().translate(FOLD).split(), None]) for i, t in rows]
    word, pairs = Counter(), [Counter() for _ in range(depth + 1)]
    for _, held, w in texts:
        if not held:
            word.update(w)
            for k in range(1, depth + 1):
                pairs[k].update((tuple(w[p - k : p]), w[p]) for p in range(k, len(w)))
    n, v = sum(word.values()), len(word)
    seen = [None, {(w,): c for w, c in word.items()}] + [Counter({(*s, w): c for (s, w), c in pairs[k].items()}) for k in range(1, depth)]
    root = lambda w: (word[w] + 0.5) / (n + 0.5 * (v + 1))
    kept = {(): True}

    once = Counter(s for k in range(1, depth + 1) for (s, _), c in pairs[k].items() if c == 1)

    def p(s, w):
        while s and not all(kept.get(s[j:]) for j in range(len(s))):
            s = s[1:]
        if not s:
            return root(w)
        c = pairs[len(s)][s, w]
        return ((c if c > 1 else 0) + (once[s] + a) * p(s[1:], w)) / (seen[len(s)][s] + a)

    for k in range(1, depth + 1):
        gain = Counter()
        for (s, w), c in pairs[k].items():
            if (m := seen[k].get(s, 0)) >= 2 and (k == 1 or kept.get(s[1:])):
                gain[s] += c * math.log((c - 1) / (m - 1 + a) / p(s[1:], w)) if c > 1 else math.log((once[s] - 1 + a) / (m - 1 + a))
        kept |= {s: g > nats for s, g in gain.items()}
    out = []
    for i, held, w in texts:
        score = sum(math.log10(p(tuple(w[max(0, q - depth) : q]), x)) for q, x in enumerate(w))
        out.append((i, held, len(w), sum(word[x] > 0 for x in w), n, sum(math.log10(root(x)) for x in w), score))
    return out


def same(spark, rows, **more):
    d = spark.createDataFrame([(t, i, 1.5) for i, t in rows], "text string, doc_id long, score double")
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    got = sorted((tuple(r) for r in scores(d, **more).collect()), key=key)
    want = sorted(plain(rows, more.get("depth", tree.DEPTH), tree.NATS, tree.STRENGTH), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 * (1 + abs(w[5])) and abs(g[6] - w[6]) < 1e-6 * (1 + abs(w[6])), (g, w)


def rows_of(r, n):
    vocabulary = [f"w{k}" for k in range(60)]
    lines = [[r.choice(vocabulary) for _ in range(r.randint(4, 20))] for _ in range(15)]
    rows = [(None, "w1 w2 w3"), (1, None), (2, ""), (2, "W1 É é w2"), (3, " \n"), (4, "the " * 3000)]
    for i in range(n):
        w = sum((r.choice(lines) if r.random() < 0.6 else r.choices(vocabulary, k=8) for _ in range(r.randint(1, 6))), [])
        rows.append((i + 10, " ".join(w)))
    return rows + rows[-3:]


def test_against_a_plain_tree(spark):
    rows = rows_of(random.Random(3), 120)
    same(spark, rows, batch_bytes=3000)
    same(spark, rows, depth=3, batch_bytes=20_000)


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    same(spark, rows)
    got = scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() and (held.score / held.n_tokens).mean() > (held.base_score / held.n_tokens).mean()


def test_empty_table(spark):
    assert scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
