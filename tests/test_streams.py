"""Streams that arrive in parts, late and out of order, against one pass over all rows."""

import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from fieldledger.streaming import feeds as E
from fieldledger.streaming import streams as S


def verdicts(loads):
    """(company, day, loaded, expected, open) in order of day -> notes, by the rule of the last six notes."""
    out, notes, good = {}, {}, {}
    for company, day, loaded, expected, opened in sorted(loads):
        prior = notes.setdefault(company, [])
        note = None if loaded else "error"
        if loaded and expected >= 50 and opened < expected / 2:
            note = "drop accepted" if len(prior) >= 6 and set(prior[-6:]) == {"drop"} else "drop"
        prior.append(note)
        ok = note not in ("error", "drop")
        if ok:
            good[company] = day
        out[company, day] = (note, ok, good.get(company))
    return out


def made_loads(seed=1):
    r = random.Random(seed)
    rows = []
    for c in range(4):
        day, bad = dt.date(2026, 1, 1), 0
        for _ in range(50):
            day += dt.timedelta(days=r.choice([1, 1, 1, 2]))
            bad = bad - 1 if bad else r.choice([0, 0, 0, 9, 16])
            rows.append((f"c{c}", day.isoformat(), r.random() > 0.06, 100, 20 if bad else 90))
    return rows


SCHEMA = "company string, day string, loaded boolean, expected int, open int"


def run(spark, tmp_path, name, parts, **options):
    root = str(tmp_path / name)
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(root + "/in")
        S.guard_stream(S.file_stream(spark, root + "/in", SCHEMA), root + "/out", root + "/cp", **options)
    return {(r.company, r.day): (r.note, r.ok, r.last_good) for r in S.last_update(spark, root + "/out", ["company", "day"]).collect()}


@pytest.fixture(autouse=True)
def few_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_four_parts_out_of_order_give_what_one_gives(spark, tmp_path):
    loads = made_loads()
    want = verdicts(loads)
    r = random.Random(2)
    by_day = sorted(loads, key=lambda x: (x[1], x[0]))
    cut = [by_day[k * len(by_day) // 4 : (k + 1) * len(by_day) // 4] for k in range(4)]
    for k in range(3):  # some rows come one part late
        late = [x for x in cut[k] if r.random() < 0.2]
        cut[k] = [x for x in cut[k] if x not in late]
        cut[k + 1] = late + cut[k + 1]
        r.shuffle(cut[k])
    assert any(n == "drop accepted" for n, _, _ in want.values())
    assert run(spark, tmp_path, "parts", cut) == want == run(spark, tmp_path, "one", [loads])


def test_state_is_bounded_and_later_than_that_is_kept_apart(spark, tmp_path):
    loads = sorted((x for x in made_loads(3) if x[0] == "c0"), key=lambda x: x[1])
    first = loads[0]
    got = run(spark, tmp_path, "short", [loads[:20], loads[20:], [("c0", "2025-12-31", True, 100, 90)]], revised=10)
    want = verdicts(loads)
    assert {k: v for k, v in got.items() if k[1] >= first[1]} == want  # drops in a row go on over the edge of the state
    assert got["c0", "2025-12-31"] == ("late", False, None)


def test_a_load_sent_again_replaces_its_day(spark, tmp_path):
    loads = [("c", f"2026-01-{d:02d}", True, 100, 20) for d in range(1, 10)]
    fixed = ("c", "2026-01-03", True, 100, 95)
    got = run(spark, tmp_path, "again", [loads, [fixed]])
    assert got == verdicts([fixed if x[1] == fixed[1] else x for x in loads])


ROWS = "id string, a string, day timestamp_ntz"


def feed(spark, root, rows):
    spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(root + "/in")
    S.scd_stream(S.file_stream(spark, root + "/in", ROWS), root + "/t", root + "/cp", "day", ["a"], buckets=8, most=3)


def table(spark, root):
    return {r.id: (r.a, r.first_seen, r.last_seen) for r in S.scd_table(spark, root + "/t", ["a"]).collect()}


def test_a_batch_writes_only_the_buckets_it_touches(spark, tmp_path):
    root = str(tmp_path)
    day = lambda d: dt.datetime(2026, 1, d)
    feed(spark, root, [(f"k{i}", "x", day(5)) for i in range(200)])
    feed(spark, root, [("k1", "y", day(6)), ("k1", "late", day(2))])
    files = lambda: set(glob.glob(root + "/t/rows/*/bucket=*/*.parquet"))
    before = files()
    assert len([f for f in before if "batch=1/" in f]) == 1 and len([f for f in before if "batch=0/" in f]) == 8
    want = {f"k{i}": ("x", day(5), day(5)) for i in range(200)} | {"k1": ("y", day(2), day(6))}
    assert table(spark, root) == want
    for d in range(7, 12):  # the bucket's segments are merged, those of older versions go
        feed(spark, root, [("k1", f"v{d}", day(d))])
    after = files()
    assert table(spark, root) == want | {"k1": ("v11", day(2), day(11))}
    live = S.segments(spark, root + "/t", S.current(spark, root + "/t"))
    assert max(len(s) for s in live.values()) <= 3 and len([f for f in after if "batch=0/" in f]) == 7
    assert not [f for f in after if "batch=1/" in f]


def test_a_replayed_batch_gives_the_same_table(spark, tmp_path):
    root = str(tmp_path)
    for d in range(1, 6):
        feed(spark, root, [(f"k{i}", f"a{d}", dt.datetime(2026, 1, d)) for i in range(0, 40, d)])
    want = table(spark, root)
    last = sorted(glob.glob(root + "/cp/commits/[0-9]*"))[-1]
    os.unlink(last)  # as if the driver had died before the batch was noted as done
    side = os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")
    if os.path.exists(side):
        os.unlink(side)
    S.scd_stream(S.file_stream(spark, root + "/in", ROWS), root + "/t", root + "/cp", "day", ["a"], buckets=8, most=3)
    assert table(spark, root) == want


def test_marks_of_many_feeds(spark):
    t = lambda d: dt.datetime(2026, 1, d)
    state = spark.createDataFrame([("a", t(5), t(6), 2), ("b", t(9), t(9), 1), ("idle", t(1), t(1), 4)], "key string, seen_through timestamp_ntz, last_run timestamp_ntz, runs int")
    rows = spark.createDataFrame([("a", 1, t(5)), ("a", 2, t(6)), ("b", 3, t(8)), ("new", 4, t(1))], "key string, i int, first_seen timestamp_ntz")
    assert sorted(r.i for r in E.new_for_feeds(rows, state).collect()) == [2, 4]
    loads = spark.createDataFrame([("a", t(7), True), ("b", t(12), False), ("new", t(7), True)], "key string, indexed_at timestamp_ntz, completed boolean")
    now = F.lit("2026-01-20 00:00:00").cast("timestamp_ntz")
    for moves, b in ((True, t(12)), (False, t(9))):
        got = {r.key: (r.seen_through, r.last_run, r.runs) for r in E.advance_feeds(state, loads, now, moves).collect()}
        assert got == {"a": (t(7), t(20), 3), "b": (b, t(20), 2), "idle": (t(1), t(1), 4), "new": (t(7), t(20), 1)}
    back = E.advance_feeds(state, spark.createDataFrame([("a", t(2), True)], "key string, indexed_at timestamp_ntz, completed boolean"), now)
    assert back.where("key = 'a'").first().seen_through == t(5)
