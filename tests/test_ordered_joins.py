"""Joins and windows over an order, against plain loops, with one key that holds most rows."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from fieldledger.functions.versions import version_key
from fieldledger.operators import aggregates as A
from fieldledger.operators import groups as G
from fieldledger.operators import joins as J
from fieldledger.operators import windows as W


def test_counted(spark):
    r = random.Random(4)
    rows = [(i, "hot" if i % 5 else f"k{i % 3}", r.randrange(50), r.random() < 0.3) for i in range(1200)] + [(2000, None, 3, True), (2001, None, 4, False)]
    df = spark.createDataFrame(rows, "i int, k string, t int, f boolean")
    got = {x.i: x.n for x in G.counted(df, ["k"], [F.col("t"), F.col("i")], F.col("f"), "n", 6).collect()}
    assert got == {i: sum(1 for j, q, u, g in rows if q == k and g and (u, j) <= (t, i)) for i, k, t, f in rows}


VERSIONS = ["0.9.0", "1.0.0-rc.1", "1.0.0", "1.0.1", "1.2.0", "1.10.0", "2.0.0-beta", "2.0.0", "2.0.0", "3.1.4", "10.0.0"]


def test_range_join_of_versions(spark):
    r = random.Random(5)
    notes = [("hot" if i % 4 else f"p{i % 7}", r.choice(VERSIONS), f"t{i}") for i in range(160)] + [(None, "1.0.0", "none")]
    ups = [(i, "hot" if i % 3 else f"p{i % 7}", r.choice(VERSIONS), r.choice(VERSIONS)) for i in range(60)] + [(99, None, "0.1.0", "9.0.0"), (98, "nowhere", "0.1.0", "9.0.0")]
    n = spark.createDataFrame(notes, "pkg string, version string, tag string")
    u = spark.createDataFrame(ups, "req int, pkg string, from_version string, to_version string")
    keys = {x.v: tuple(x.k) for x in spark.createDataFrame([(v,) for v in VERSIONS], "v string").select("v", version_key("v").alias("k")).collect()}
    got = sorted((x.req, x.tag, x.pkg, x.version, x.to_version) for x in J.in_range(n, u).collect())
    want = sorted((q, t, p, v, b) for q, up, a, b in ups for p, v, t in notes if p == up and p is not None and q != 99 and keys[a] < keys[v] <= keys[b])
    assert want and got == want
    counts = {x.req: x.n for x in J.count_in_range(n, u, "n").collect()}
    assert counts == {q: sum(1 for w in want if w[0] == q) for q, up, _, _ in ups if up is not None}


@pytest.mark.parametrize("within", [None, 3])
def test_drops_made_good_by_a_later_catch_up(spark, within):
    r = random.Random(6)
    day = lambda: dt.date(2026, 1, 1) + dt.timedelta(days=r.randrange(40))
    drops = list({(s, day(), 100.0) for s in "abc" for _ in range(15)})
    ups = [(r.choice("abcd"), day(), r.randrange(0, 90)) for _ in range(60)]
    got = J.not_recovered(spark.createDataFrame(drops, "source string, started date, usual double"), spark.createDataFrame(ups, "source string, started date, jobs long"), within_days=within)
    good = lambda s, d, n: any(q == s and e > d and j >= n * 0.5 and (within is None or (e - d).days <= within) for q, e, j in ups)
    assert sorted((x.source, x.started) for x in got.collect()) == sorted((s, d) for s, d, n in drops if not good(s, d, n))


def test_usual_counts_without_a_grid(spark):
    r = random.Random(7)
    runs = [(dt.date(2026, 1, 1) + dt.timedelta(days=d), s, r.randrange(100, 1000), d % 6 != 0) for d in range(40) for s in "abc" if s != "c" or 5 < d < 20 or d > 36 if r.random() < 0.8]
    got = {(x.day, x.source): (x.jobs, x.usual) for x in W.rolling_usual(spark.createDataFrame(runs, "day date, source string, jobs long, is_full boolean"), 7).collect()}
    days = sorted({d for d, _, _, full in runs if full})
    jobs = {(d, s): n for d, s, n, full in runs if full}
    want = {}
    for i, d in enumerate(days):
        for s in "abc":
            past = [jobs[e, s] for e in days[max(0, i - 7) : i] if (e, s) in jobs]
            if past:
                want[d, s] = (jobs.get((d, s), 0), statistics.median(past))
    assert got == want


def test_requests_of_the_last_hour_in_a_busy_hour(spark):
    r = random.Random(8)
    at = dt.datetime(2026, 1, 1, 5)
    rows = [(i, r.choice(["hot", "hot", "hot", "b", None]), at + dt.timedelta(seconds=r.choice([0, 1800, 3600, 3601, 7200, r.randrange(9000)]))) for i in range(400)]
    got = {x.i: x.recent for x in W.recent_count(spark.createDataFrame(rows, "i int, c string, ts timestamp"), "c", "ts").collect()}
    hour = dt.timedelta(hours=1)
    assert got == {i: sum(1 for _, d, u in rows if d == c and t - hour <= u <= t) - 1 for i, c, t in rows}


def test_nested_windows_of_the_ledger(spark):
    r = random.Random(9)
    now = dt.datetime(2026, 2, 1)
    rows = [(now - dt.timedelta(hours=r.choice([1, 24, 25, 100, 168, 500, 720, 2000])), r.choice([None, 1, 2, 3, 4]), r.random() < 0.5, r.choice([None, 0.5, 1.25]), 0.25, r.random() < 0.4) for _ in range(200)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, payer int, paid boolean, price double, cost double, cache_hit boolean")
    got = {x.window: x for x in A.ledger_summary(df, F.lit(now).cast("timestamp_ntz")).collect()}
    for name, hours in A.LEDGER_WINDOWS.items():
        own = [x for x in rows if hours is None or x[0] >= now - dt.timedelta(hours=hours)]
        g = got[name]
        assert (g.requests, g.paid_requests, g.cache_hits, g.unique_payers) == (len(own), sum(x[2] for x in own), sum(x[5] for x in own), len({x[1] for x in own} - {None}))
        assert abs(g.revenue - sum(x[3] or 0 for x in own)) < 1e-6 and abs(g.profit - (g.revenue - g.cost)) < 1e-6
    assert A.ledger_summary(df.limit(0), F.lit(now).cast("timestamp_ntz")).collect() == []
