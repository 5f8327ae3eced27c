"""Items copied with inserted or missing words: hits on several diagonals count together."""

from fieldledger.llm.template_leaks import leaks


def test_moved_diagonals(spark):
    item = [f"plain{k}" for k in range(30)]
    more = item[:10] + ["extra"] + item[10:20] + ["again"] + item[20:]
    less = item[:10] + item[11:20] + item[21:]
    apart = item[:10] + ["far"] * 500 + item[10:20] + ["far"] * 500 + item[20:]
    turned = item[20:] + ["x"] + item[10:20] + ["y"] + item[:10]
    docs = [(1, more), (2, less), (3, apart), (4, turned), (5, item)]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in leaks(d, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (5, 1)}
    assert (got[1, 1].covered, got[2, 1].covered, got[5, 1].covered, got[1, 1].at) == (30, 28, 30, 0)
