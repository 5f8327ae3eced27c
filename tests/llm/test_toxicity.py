"""Toxicity: held-out accuracy on given labels, and odd rows."""

import zlib

import numpy as np

from fieldledger.llm.toxicity import label_model, predictions, scored


def test_held_out_accuracy(spark):
    """Planted words of two languages, a third of the labelled rows held out."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(800)]
    bad = [["vonk", "zuth", "quop"], ["xarr", "wymm", "tsol"]]
    docs, labels = [], []
    for i in range(1500):
        text = list(rng.choice(words, rng.integers(5, 60)))
        toxic = rng.random() < 0.15
        if toxic:
            for w in rng.choice(bad[i % 2], rng.integers(1, 4)):
                text.insert(int(rng.integers(0, len(text))), w + str(rng.choice(["", "ed", "s", ","])))
        docs.append((i, " ".join(text), int(toxic)))
        labels.append((i, int(toxic)))
    d = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    got = {r.doc_id: r for r in predictions(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [(got[i], y) for i, _, y in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out for r, _ in held) and sum(r.held_out for r in got.values()) == len(held)
    assert np.mean([r.predicted == y for r, y in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_labels_of_held_out_rows_teach_nothing(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    turned = lab.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    assert sorted(map(tuple, predictions(d, lab).collect())) == sorted(map(tuple, predictions(d, turned).collect()))


def test_odd_rows(spark):
    rows = [(None, None, 1), (1, "", 2), (2, " \n", 3), (3, "idiot " * 60_000, 4), (3, "idiot", 5), (4, "é@ü!!! ***a*b 12", 6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, score int")
    lab = spark.createDataFrame([(3, 1), (None, 1), (1, None)], "doc_id long, toxic int")
    assert {r.score for r in scored(d, lab).collect()} == {0.0}  # one class only: nothing to learn from
    more = spark.createDataFrame([(100 + k, "idiot you fool" if k % 2 else "a fine day out") for k in range(80)], "doc_id long, text string")
    known = more.selectExpr("doc_id", "int(text like 'idiot%') as toxic")
    got = scored(d.drop("score").unionByName(more), known).collect()
    assert len(got) == 86 and all(0 <= r.score <= 1 for r in got)
    assert scored(d.limit(0), lab).count() == 0


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    y = (rng.random(4000) < 0.2).astype(float)
    rate = np.array([0.5, 0.4, 0.3, 0.3, 0.3])
    fires = (rng.random((4000, 5)) < np.where(y[:, None] > 0, rate, [0.01, 0.01, 0.01, 0.3, 0.3])).astype(float)
    fires[:, 4] = fires[:, 3]
    noisy = np.where(rng.random(4000) < 0.1, 1 - y, y)
    q = label_model(fires, np.ones(5), noisy)
    assert q[(fires[:, :3].sum(axis=1) > 1)].mean() > 0.8 and q[fires.sum(axis=1) == 0].mean() < 0.4
