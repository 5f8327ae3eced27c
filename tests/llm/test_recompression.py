"""Repeat removal against a plain window dictionary."""

import random

import pytest

from fieldledger.llm.recompression import remove_repeats


def plain(rows, size):
    words = [[w for w in (t or "").encode().split()] for _, t in rows]
    best = {}
    for (i, _), w in zip(rows, words, strict=True):
        for p in range(len(w) - size + 1):
            k = tuple(w[p : p + size])
            best[k] = min(best.get(k, 1 << 62), 1 << 62 if i is None else i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for p in range(len(w) - size + 1):
            if best[tuple(w[p : p + size])] < (1 << 62 if i is None else i):
                gone.update(range(p, p + size))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        out.append((i, len(w), len(gone), kept))
    return sorted(out, key=str)


def got(spark, rows, size, **more):
    df = spark.createDataFrame([(i, t, "s", 7) for i, t in rows], "doc_id long, text string, source string, n_words int")
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeats(df, size, **more).collect()), key=str)


@pytest.mark.parametrize("size", [7, 50])
def test_random_repeats(spark, size):
    r = random.Random(size)
    rows = [(None, None), (0, ""), (3, " \t\n"), (3, "x " * 200), (8, "x " * 90 + "y"), (9, "ab cd " * 80)]
    passages = [[r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randint(size - 2, 4 * size))] for _ in range(12)]
    for i in range(60):
        w = []
        for _ in range(r.randint(1, 5)):
            w += r.choice(passages) if r.random() < 0.5 else [f"{r.randint(0, 30)}é" for _ in range(r.randint(1, 90))]
        rows.append((r.choice([i + 10, 11, None]) if r.random() < 0.2 else i + 10, r.choice([" ", "\n", "\x0b "]).join(w)))
    rows += rows[-3:]
    assert got(spark, rows, size, batch_bytes=4000) == plain(rows, size)


def test_given_documents_and_long_text(spark):
    d = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    d += [(10_000, " ".join(t for _, t in d[:40])), (10_001, "w" * 100_000 + " " + " ".join(t for _, t in d[20:60]))]
    assert got(spark, d, 50) == plain(d, 50)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
