"""Costly values stand in the plan once, and what they give is unchanged."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fieldledger.functions import text as T
from fieldledger.functions import versions as V
from fieldledger.functions.pay import STRUCTURED, structured_pay
from fieldledger.sources import feeds as P

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_links(spark):
    body = '<a href="/job/1?a=1&amp;b=2" data-job-id="1"><h2>A  &amp; B</h2><span class="job-location">Columbus, OH 43215</span></a><a href="/x" data-job-id="2"></a>'
    df = P.talentbrew(spark.createDataFrame([("jobs.acme.com", body), ("jobs.acme.com", None)], "company string, body string"))
    assert [(r.id, r.title, r.location, r.url) for r in df.collect()] == [("talentbrew:acme:1", "A & B", "Columbus, OH", "https://jobs.acme.com/job/1?a=1&b=2")]
    assert not [line for line in plan(df).splitlines() if "Filter (" in line and "<script" in line]


def test_pay_is_parsed_once(spark):
    text = '{"compensationTiers":[{"components":[{"compensationType":"Salary","interval":"1 YEAR","currencyCode":"USD","minValue":50000.0,"maxValue":60000.0}]}]}'
    df = spark.createDataFrame([(text,), ("{}",), (None,)], "c string").select(structured_pay(F.from_json("c", STRUCTURED)).alias("p"))
    assert [(r.p and (r.p["min"], r.p["max"], r.p["period"])) for r in df.collect()] == [(50000.0, 60000.0, "year"), None, None]
    assert plan(df).count("from_json(") == 1


def test_versions_and_severities(spark):
    df = spark.createDataFrame([("v1.02.x",), ("1.0.0-rc.1",), ("2.0.0",), ("none",), (None,)], "v string")
    got = [(tuple(r.k), r.l) for r in df.select(V.version_key("v").alias("k"), V.loose_key("v").alias("l")).collect()]
    assert got == [((1, 2, 0, 0, ".x"), [1, 2]), ((1, 0, 0, 0, "rc.1"), [1, 0, 0, 0, 1]), ((2, 0, 0, 1, ""), [2]), ((0, 0, 0, 1, ""), []), ((0, 0, 0, 0, None), None)]
    df = spark.createDataFrame([("HIGH", None), ("high\n", "9"), ("", "7.5"), (None, "CVSS:3.1/AV:N"), (None, None), ("x", "0")], "n string, s string")
    assert [r[0] for r in df.select(V.severity("n", "s")).collect()] == ["high", "critical", "high", "unknown", "unknown", "low"]


def test_html_without_marks_only_loses_blanks(spark):
    df = spark.createDataFrame([(" a  b \n c\n\n\nd ",), ("a<br>b&nbsp;c",), ("a  b",), ("&lt;p&gt;",), (None,)], "h string")
    assert [r[0] for r in df.select(T.html_to_text("h")).collect()] == ["a b\n c\n\nd", "a\nb c", "a b", "<p>", ""]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["p11_rippling", "p19_talentbrew", "p24_form_d", "p28_advisories"])
def test_rows_are_dealt_before_payloads_are_read(spark, name):
    assert "RepartitionByExpression" in plan(entry.queries()[name](spark, DATA))
