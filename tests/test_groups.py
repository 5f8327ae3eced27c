"""Ordered work in groups against brute force, with one key that holds most rows."""

import random
import statistics

from pyspark.sql import functions as F

from fieldledger.operators import groups as G
from fieldledger.operators import joins as J
from fieldledger.operators import windows as W


def hot_rows(n=3000, seed=7):
    rnd = random.Random(seed)
    return [(i, "hot" if rnd.random() < 0.7 else f"k{rnd.randrange(40)}", rnd.randrange(0, 500), round(rnd.uniform(-50, 900), 2) if rnd.random() > 0.05 else None) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "i int, k string, t int, v double")


def test_numbered(spark):
    rows = hot_rows()
    got = {r.i: r.pos for r in G.numbered(frame(spark, rows), ["k"], [F.col("t"), F.col("i")], F.floor(F.col("t") / 20)).collect()}
    for k in {r[1] for r in rows}:
        want = sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0]))
        assert [got[r[0]] for r in want] == list(range(1, len(want) + 1))


def test_numbered_without_keys(spark):
    rows = hot_rows(500)
    got = {r.i: r.pos for r in G.numbered(frame(spark, rows), [], [F.col("t").desc(), F.col("i")], -F.col("t")).collect()}
    assert [got[r[0]] for r in sorted(rows, key=lambda r: (-r[2], r[0]))] == list(range(1, 501))


def test_carried_down(spark):
    rows = hot_rows()
    df = frame(spark, rows)
    got = {r.i: r.h for r in G.carried_down(df, ["k"], "i", F.floor(F.col("i") / 100), F.when(F.col("t") < 20, F.col("i")), "h").collect()}
    last = {}
    for i, k, t, _ in rows:
        if t < 20:
            last[k] = i
        assert got[i] == last.get(k)


def test_exact_median(spark):
    rows = hot_rows()
    got = {r.k: r.median for r in G.exact_median(frame(spark, rows), ["k"], "v").collect()}
    for k in {r[1] for r in rows}:
        vals = [r[3] for r in rows if r[1] == k and r[3] is not None]
        assert (k in got) == bool(vals)
        if vals:
            assert abs(got[k] - statistics.median(vals)) < 1e-9


def test_median_over_all_rows_and_equal_values(spark):
    df = spark.createDataFrame([(1.0,)] * 5 + [(2.0,)] * 5 + [(-3.0,)], "v double")
    assert G.exact_median(df, [], "v").head().median == 1.0


def test_recent_count(spark):
    rnd = random.Random(3)
    base = 1_700_000_000
    rows = [(i, "hot" if rnd.random() < 0.8 else "c", base + rnd.randrange(0, 20_000)) for i in range(1500)]
    df = spark.createDataFrame(rows, "i int, c string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.i: r.recent for r in W.recent_count(df, "c", "ts").collect()}
    for i, c, s in rows:
        assert got[i] == sum(1 for _, c2, s2 in rows if c2 == c and s - 3600 <= s2 <= s) - 1


def test_outage_guard_seventh_day(spark):
    days = [("a", f"2026-10-{d:02d}", 40 if d > 1 else 100, 100, d != 5) for d in range(1, 20)]
    df = spark.createDataFrame(days, "company string, day string, open int, expected int, loaded boolean")
    got = [r.note for r in W.outage_guard(df, ["company"]).orderBy("day").collect()]
    notes = []
    for _, _, o, e, loaded in days:
        short = loaded and e >= 50 and o < e / 2
        six = len(notes) >= 6 and all(n == "drop" for n in notes[-6:])
        notes.append("error" if not loaded else ("drop accepted" if six else "drop") if short else None)
    assert got == notes


def edits(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(cur[-1] + 1, prev[j] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_near_names_against_all_pairs(spark):
    rnd = random.Random(5)
    known = ["react", "react-dom", "redis", "lodash", "express", "fastify", "pg", "next", "vue", "a"]
    asked = sorted({"".join(w[:i] + rnd.choice(["", "x", w[i : i + 1] * 2]) + w[i + 1 :]) for w in known for i in range(len(w))} | set(known) | {"", "completely-other-name", "recat"})
    got = {r.name: r.near for r in J.near_names(spark.createDataFrame([(a,) for a in asked], "name string"), "name", spark.createDataFrame([(k,) for k in known], "k string"), "k").collect()}
    for a in asked:
        want = sorted(((edits(a, k), k) for k in known if 1 <= edits(a, k) <= 2 and abs(len(a) - len(k)) <= 3))[:3]
        assert [(x["distance"], x["name"]) for x in (got[a] or [])] == want, a


def null_rows():
    rnd = random.Random(11)
    return [(i, rnd.choice([None, None, "a", "b"]), rnd.choice([None, *range(30)]), rnd.choice([None, 1e-9, 2e-9, 1e9 + rnd.random(), 1e9 + 1, -3.5, 0.0, -1e300])) for i in range(600)]


def test_null_keys_dates_and_values(spark):
    """A null key is a group, a null date a bucket of its own, and no row is lost."""
    rows = null_rows()
    df = frame(spark, rows)
    got = {r.i: r.pos for r in G.numbered(df, ["k"], [F.col("t"), F.col("i")], F.col("t")).collect()}
    for k in (None, "a", "b"):
        want = sorted((r for r in rows if r[1] == k), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        assert [got[r[0]] for r in want] == list(range(1, len(want) + 1))
    med = {r.k: r.median for r in G.exact_median(df, ["k"], "v").collect()}
    assert med == {k: statistics.median(r[3] for r in rows if r[1] == k and r[3] is not None) for k in (None, "a", "b")}
    kept = {r.i: r.h for r in G.carried_down(df, ["k"], "i", F.floor(F.col("i") / 50), F.when(F.col("t") < 9, F.col("i")), "h").collect()}
    last = {}
    for i, k, t, _ in rows:
        if t is not None and t < 9:
            last[k] = i
        assert kept[i] == last.get(k)


def test_median_of_close_values(spark):
    """Values that share a coarse bucket, at several sizes."""
    for base, step in ((0.0, 1e-7), (1.7e9, 1.0), (-5.0, 1e-6)):
        values = [base + step * k for k in range(2001)]
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert G.exact_median(df, [], "v").head().median == values[1000]
