"""Benchmark leaks: planted questions, re-parameterised questions, and plain matching of given passages."""

from fieldledger.llm.template_leaks import Reader, leaks

ITEM = "A train leaves Boston at 9 with 120 passengers and travels 300 km in 5 hours before Anna counts 120 empty seats."
OTHER = "A train leaves Denver at 7 with 88 passengers and travels 450 miles in 6 hours before Peter counts 88 empty seats."
MIXED = "A train leaves Denver at 7 with 88 passengers and travels 450 miles in 6 hours before Peter counts 99 empty seats."


def found(spark, docs, items=((1, ITEM), (2, None), (3, ""), (4, "short item here"), (5, "7 8 9 10 11 12 13 14 15"))):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    return {(r.doc_id, r.item_id): r for r in leaks(d, spark.createDataFrame(list(items), "item_id long, text string")).collect()}


def test_templates():
    t = Reader()("He paid $3,500 to Maria. Then three km more: 12kg of B2 , Bob")
    assert [v for v, s in zip(t.value, t.slot.tolist(), strict=True) if s] == ["$3,500", "maria", "three", "km", "12kg", "b2", "bob"]


def test_planted(spark):
    pad = " ".join(f"word{k}" for k in range(3000))
    docs = [(10, f"{pad} {ITEM} {pad}"), (11, f"{pad}. {OTHER}"), (12, MIXED), (13, pad), (14, None), (15, ""), (None, ITEM), (16, "Some short item here now"), (17, "1 2 3 4 5 6 7 8 9 10 11"), (18, ITEM[: len(ITEM) // 3]), (10, f"{pad} {ITEM} {pad}")]
    got = found(spark, docs)
    assert set(got) == {(10, 1), (11, 1), (None, 1), (16, 4)}
    assert (got[10, 1].changed, got[11, 1].changed, got[10, 1].covered, got[10, 1].at) == (0, 7, 21, 3001)  # the first word opens a sentence in the item alone
    assert found(spark, []) == {} and found(spark, docs, [(1, None)]) == {}


def test_given_passages(spark):
    """Every document with a whole item in it is found, and with half of the words of no item, none is."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    read = Reader()
    whole, some = set(), set()
    values = {i: read(t).value for i, t in items}
    eights = {}
    for i, v in values.items():
        for k in range(len(v) - 7):
            eights.setdefault(tuple(v[k : k + 8]), set()).add(i)
    for d, t in docs:
        v = read(t).value
        line = " " + " ".join(v) + " "
        for i in {i for k in range(len(v) - 7) for i in eights.get(tuple(v[k : k + 8]), ())}:
            some.add((d, i))
            if " " + " ".join(values[i]) + " " in line:
                whole.add((d, i))
    got = set(found(spark, docs, items))
    assert whole and whole <= got <= some
