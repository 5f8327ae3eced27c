"""The pipeline's stages, each held against plain Python on its own input."""

import corpus_pipeline
from fieldledger.llm.common import saved, table
from fieldledger.llm.toxicity import predictions
from .test_ids_and_order import expected_ids
from .test_jaccard_tree import plain as plain_near
from .test_recompression import plain as plain_cut
from .test_template_leaks import Reader

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "substring_dedup", "decontamination", "packing"]
    states = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = saved(stage(spark, states[-1], SF), name)
        if name != "packing":
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        states.append(out)
    rows = [{r.doc_id: r for r in s.collect()} for s in states[:-1]]

    toxic = {r.doc_id for r in predictions(docs, table(spark, SF, "labels")).collect() if r.predicted}
    assert rows[1] == {i: r for i, r in rows[0].items() if i not in toxic}

    near = plain_near([(i, r.text) for i, r in rows[1].items()])
    assert rows[2] == {i: rows[1][i] for i, _, c in near if i == c}

    for i, _, lost, kept in plain_cut([(i, r.text) for i, r in rows[2].items()], 50):
        was, now = rows[2][i], rows[3][i]
        assert now == was if not lost else (now.text, now.n_chars, now.lang, now.source) == (kept, len(kept), was.lang, was.source)
    assert len(rows[3]) == len(rows[2])

    read = Reader()
    items = [" ".join(read(r.text).value) for r in table(spark, SF, "benchmark").collect()]
    whole = {i for i, r in rows[3].items() if any(f" {x} " in f" {' '.join(read(r.text).value)} " for x in items)}
    assert not whole & set(rows[4]) and set(rows[4].items()) <= set(rows[3].items()) and len(rows[3]) - len(rows[4]) <= 2 * len(whole) + 2

    got = sorted((r.doc_id, r.start, r.length) for r in states[-1].collect())
    want = sorted((i, a, min(4096, len(ids) - a)) for i, ids in expected_ids([(i, r.text) for i, r in rows[4].items()]) for a in range(0, len(ids), 4096))
    assert got == want
    assert corpus_pipeline.run(spark, SF).count() == len(want)


def test_odd_rows(spark):
    rows = [(None, None), (None, "a b c d e f g"), (1, ""), (1, ""), (2, "a b c d e f g"), (3, "w " * 40_000), (4, None)]
    d = spark.createDataFrame([(t, i, "en", "s", len(t or "") or None, 0) for i, t in rows], "text string, doc_id long, lang string, source string, n_chars long, component_id int")
    for _, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, SF)
    assert {r.doc_id for r in d.collect()} == {None, 1, 2, 3, 4}
    none = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
    assert none.count() == 0
