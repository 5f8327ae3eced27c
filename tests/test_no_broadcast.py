"""Joins whose sides look small to the planner but are not must not be collected by the driver."""

from pyspark.sql import functions as F

from fieldledger.operators import joins as J
from fieldledger.plans import filings as PF


def final_plan(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_range_join_over_many_stretches_is_exact_and_merged(spark):
    n = 3 * J.STRETCH + 7
    notes = spark.createDataFrame([("a", f"1.{i}.0", i) for i in range(n)] + [("b", "1.5.0", 0), (None, "1.5.0", 1)], "pkg string, version string, pos long")
    spans = [(0, "a", 0, n), (1, "a", J.STRETCH - 1, J.STRETCH), (2, "a", J.STRETCH, J.STRETCH + 1), (3, "a", 9, 9), (4, "b", 4, 5), (5, None, 0, 9), (6, "a", 10, 5), (6, "a", 10, 5)]
    ups = spark.createDataFrame([(r, p, f"1.{a}.0", f"1.{b}.0") for r, p, a, b in spans], "req long, pkg string, from_version string, to_version string")
    found = J.in_range(notes, ups)
    assert found.columns == ["pkg", "version", "pos", "req", "from_version", "to_version"]
    rows, plan = final_plan(found.select("req", "pos"))
    assert sorted(map(tuple, rows)) == sorted((r, i) for r, p, a, b in spans if p == "a" for i in range(a + 1, min(b, n - 1) + 1)) + [(4, 0)]
    assert "BroadcastHashJoin [_k" not in plan


def test_documents_of_filings_are_not_broadcast(spark):
    hits = spark.createDataFrame([("1-1", "7", "x.xml", "2001-01-01", "D", "Firm")], "accession string, cik string, file_name string, filed_at string, form string, name string")
    docs = spark.createDataFrame([("1-1", "<edgarSubmission/>"), ("1-2", "<edgarSubmission/>"), (None, "<edgarSubmission/>")], "accession string, body string")
    rows, plan = final_plan(PF.funded(hits, docs, {}, F.lit(2001)).select("accession"))
    assert "BroadcastHashJoin [accession" not in plan
