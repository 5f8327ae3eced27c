"""Day-by-day scenarios of the job table, the feeds' state, the index and the guards."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldledger.operators import joins as J
from fieldledger.operators import order as O
from fieldledger.operators import upserts as U
from fieldledger.plans import jobs as PJ
from fieldledger.sources import files as S
from fieldledger.sources import index as I
from fieldledger.streaming import feeds as E

JOB = "id string, source string, company string, first_seen timestamp_ntz, last_seen timestamp_ntz"
RUN = "source string, company string, day date, run_at timestamp_ntz, ok boolean, note string"


def ts(day):
    return F.lit(f"2026-10-{day:02d} 08:30:00").cast("timestamp_ntz")


class Crawl:
    """Runs the nightly job day after day and keeps its tables as rows."""

    def __init__(self, spark):
        self.spark, self.jobs, self.runs = spark, [], []

    def day(self, d, fetched, error=()):
        sp = self.spark
        base = sp.createDataFrame(self.jobs, JOB)
        snap = sp.createDataFrame([(f"{c}:{i}", "ats", c) for c, ids in fetched.items() for i in ids], "id string, source string, company string")
        got = sp.createDataFrame([("ats", c, n, True, None) for n, c in enumerate(fetched)] + [("ats", c, 100 + n, False, "HTTP 500") for n, c in enumerate(error)], "source string, company string, seq int, ok boolean, error string")
        runs = sp.createDataFrame(self.runs, RUN)
        out = PJ.nightly(base, snap, got, runs, ts(d), ts(d - 1), ["source", "company"])
        self.jobs = [tuple(r) for r in out["jobs"].select("id", "source", "company", "first_seen", "last_seen").collect()]
        today = out["company_runs"].collect()
        self.runs += [(r.source, r.company, r.day, r.run_at, r.ok, r.note) for r in today]
        self.live = {r.id for r in out["live"].select("id").collect()}
        return {r.company: r for r in today}


def test_a_failed_site_keeps_its_rows_and_their_dates(spark):
    c = Crawl(spark)
    ids = range(60)
    c.day(1, {"a": ids, "b": range(5)})
    r = c.day(2, {"b": range(5)}, error=["a"])
    assert (r["a"].ok, r["a"].note, r["a"].closed, r["a"].error) == (False, "error", None, "HTTP 500")
    c.day(3, {"b": range(4)}, error=["a"])
    assert len([i for i in c.live if i.startswith("a:")]) == 60
    r = c.day(4, {"a": ids, "b": range(4)})
    assert (r["a"].ok, r["a"].open, r["a"].opened) == (True, 60, 0)
    first = {j[3] for j in c.jobs if j[2] == "a"}
    assert first == {dt.datetime(2026, 10, 1, 8, 30)}


def test_half_a_list_is_a_drop_and_a_small_list_is_not(spark):
    c = Crawl(spark)
    c.day(1, {"a": range(120), "small": range(10)})
    r = c.day(2, {"a": range(40), "small": range(2)})
    assert (r["a"].ok, r["a"].note, r["a"].expected, r["a"].closed) == (False, "drop", 120, None)
    assert (r["small"].ok, r["small"].closed) == (True, 8)
    assert len([i for i in c.live if i.startswith("a:")]) == 120


def test_closed_rows_are_archived_once_and_split_without_rest(spark):
    jobs = spark.createDataFrame([(str(i), "s", "c" if i % 2 else "d", dt.datetime(2026, 9, 1), dt.datetime(2026, 10, 1 + i)) for i in range(20)], JOB)
    fails = spark.createDataFrame([("s", "c", dt.datetime(2026, 10, 5))], "source string, company string, since timestamp_ntz")
    gone, kept = U.purge(jobs, fails, ["source", "company"], ts(20))
    g, k = {r.id for r in gone.collect()}, {r.id for r in kept.collect()}
    assert not g & k and len(g | k) == 20
    assert {i for i in g} == {str(i) for i in range(20) if dt.datetime(2026, 10, 1 + i) < dt.datetime(2026, 10, 17, 8, 30) and not (i % 2 and 1 + i >= 5)}
    assert g == {r.id for r in J.closed_rows(jobs, fails, ["source", "company"], ts(20)).collect()}


def test_merge_keeps_first_date_and_touch_only_keeps_attributes(spark):
    base = spark.createDataFrame([("1", "old", dt.datetime(2026, 9, 1), dt.datetime(2026, 10, 1)), ("2", "gone", dt.datetime(2026, 9, 1), dt.datetime(2026, 10, 1))], "id string, title string, first_seen timestamp_ntz, last_seen timestamp_ntz")
    snap = spark.createDataFrame([("1", "new"), ("3", "fresh")], "id string, title string")
    rows = {r.id: r for r in U.merge_snapshot(base, snap, ts(9), ["title"]).collect()}
    now = dt.datetime(2026, 10, 9, 8, 30)
    assert (rows["1"].title, rows["1"].first_seen, rows["1"].last_seen) == ("new", dt.datetime(2026, 9, 1), now)
    assert (rows["2"].title, rows["2"].last_seen) == ("gone", dt.datetime(2026, 10, 1))
    assert (rows["3"].first_seen, rows["3"].last_seen) == (now, now)
    touched = {r.id: r.title for r in U.merge_snapshot(base, snap, ts(9), ["title"], refresh=False).collect()}
    assert touched == {"1": "old", "2": "gone", "3": "fresh"}


def test_mark_moves_forward_only_and_seen_set_keeps_undelivered(spark):
    rows = spark.createDataFrame([(str(i), dt.datetime(2026, 10, i), dt.datetime(2026, 10, i)) for i in range(1, 11)], "id string, posted_at timestamp_ntz, first_seen timestamp_ntz")
    empty = spark.createDataFrame([], "key string, seen_through timestamp_ntz, last_run timestamp_ntz, runs int")
    assert E.new_since(rows, empty, "k").count() == 10
    one = E.advance(empty, "k", ts(5), ts(6))
    assert {r.id for r in E.new_since(rows, one, "k").collect()} == {"6", "7", "8", "9", "10"}
    back = E.advance(one, "k", ts(2), ts(7)).head()
    assert back.seen_through == dt.datetime(2026, 10, 5, 8, 30) and back.runs == 2
    seen = spark.createDataFrame([("f", "10", dt.datetime(2026, 10, 9)), ("f", "9", dt.datetime(2025, 1, 1))], "feed string, id string, at timestamp_ntz")
    out, after = E.seen_feed(rows, seen, "f", ts(11), 3)
    assert [r.id for r in out.collect()] == ["9", "8", "7"]
    assert {r.id for r in after.collect()} == {"10", "9", "8", "7"}


def test_shards_skip_and_undated(spark, tmp_path):
    rows = [(f"{i:03d}", dt.datetime(2026, 1, 1) + dt.timedelta(days=i) if i % 5 else None, dt.datetime(2026, 6, 1)) for i in range(100)]
    schema = "id string, posted_at timestamp_ntz, first_seen timestamp_ntz"
    path = str(tmp_path / "shards")
    I.write_shards(spark.createDataFrame(rows, schema), path, rows=30)
    back = I.read_shards(spark, path, schema + ", shard int")
    stats = {r.shard: r for r in I.shard_stats(back).collect()}
    assert [stats[i]["count"] for i in range(4)] == [30, 30, 30, 10]
    assert [stats[i].undated for i in range(4)] == [0, 0, 10, 10]
    keep = I.surviving(I.shard_stats(back), F.lit("2026-03-20").cast("timestamp_ntz"))
    assert {r.shard for r in keep.collect()} == {0, 2, 3}  # shard 1 is all older; shards with undated rows stay
    assert I.current(spark, str(tmp_path / "none")) is None


def test_publish_swaps_and_drops_the_old_run(spark, tmp_path):
    df = spark.createDataFrame([(str(i), dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 1)) for i in range(9)], "id string, posted_at timestamp_ntz, first_seen timestamp_ntz")
    base = str(tmp_path / "idx")
    I.publish(spark, df, base, "one", 4)
    root = I.publish(spark, df.filter("id > '3'"), base, "two", 4)
    assert I.current(spark, base) == "two" and not I.path_exists(spark, base + "/one")
    assert spark.read.json(root + "/shards").count() == 5


def test_guards(spark, tmp_path):
    with pytest.raises(ValueError):
        O.guarded_replace(spark.range(2), spark.range(3))
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.LongType())])
    assert S.read_registry(spark, str(tmp_path / "no.json"), schema).count() == 0
    (tmp_path / "r.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert S.read_registry(spark, str(tmp_path / "r.json"), schema).count() == 2
