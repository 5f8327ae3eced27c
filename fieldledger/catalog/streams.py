"""Incremental and streaming operators R01-R09 over the given tables. The tables arrive in spans; each stream runs after each span."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators.order import newest_first
from ..session import shared_dir
from ..streaming import feeds as E
from ..streaming import streams as S
from .registry import query


@contextmanager
def state_sized(spark):
    """State partitions of the queries here: two per core. A stream keeps the number it starts with."""
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    spark.conf.set(key, str(2 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, old)


CUTS = ["2024-01-01", "2024-01-09", "2024-01-17", "2024-01-25", "2025-01-01"]


def arriving(df, column, cuts, path):
    """The table written span by span; after each span the caller runs its stream, which goes on from its checkpoint."""
    for lo, hi in zip(cuts, cuts[1:]):
        df.filter((F.col(column) >= lo) & (F.col(column) < hi)).write.mode("append").parquet(path)
        yield path


MARKS_SQL = """marks AS (SELECT source AS key, max(first_seen) AS mark, max(last_run) AS last_run, CAST(count(DISTINCT last_run) AS INTEGER) AS runs FROM (
  SELECT source, first_seen, date_trunc('year', first_seen) + INTERVAL 1 YEAR AS last_run FROM postings WHERE first_seen < TIMESTAMP '2000-01-01' AND source <> 'machinery') GROUP BY source)"""
A.VIEWS["marks"] = MARKS_SQL


def marks(spark, d):
    """Marks that yearly runs up to 2000 have left, one feed per source; one source has no feed yet."""
    p = A.postings(spark, d).filter((F.col("first_seen") < A.ts("2000-01-01 00:00:00")) & (F.col("source") != "machinery"))
    run = (F.add_months(F.date_trunc("year", "first_seen"), 12)).cast("timestamp_ntz")
    return p.groupBy(F.col("source").alias("key")).agg(F.max("first_seen").alias("seen_through"), F.max(run).alias("last_run"), F.countDistinct(run).cast("int").alias("runs"))


@query("r01_new_since", """
WITH @postings, @marks SELECT id, source, CAST(CASE WHEN mark > TIMESTAMP '2001-08-01' THEN mark ELSE TIMESTAMP '2001-08-01' END AS VARCHAR) AS seen_through, coalesce(runs, 0) + 1 AS runs
FROM postings LEFT JOIN marks ON key = source WHERE mark IS NULL OR first_seen > mark""")
def r01(spark, d):
    p, state = A.postings(spark, d), marks(spark, d)
    feeds = p.select(F.col("source").alias("key")).distinct().withColumns({"indexed_at": A.now(), "completed": F.lit(True)})
    after = E.advance_feeds(state, feeds, A.now())
    new = E.new_for_feeds(p.withColumn("key", F.col("source")), state)
    return new.join(after.select("key", F.col("seen_through").cast("string").alias("seen_through"), "runs"), "key").select("id", "source", "seen_through", "runs")


@query("r02_partial_runs", """
WITH @postings, @marks, k(kind, upto) AS (VALUES ('keeps', NULL), ('moves', TIMESTAMP '2001-03-01'), ('never back', TIMESTAMP '1990-01-01')),
m AS (SELECT kind, key, greatest(mark, coalesce(upto, mark)) AS mark FROM marks, k)
SELECT kind, source, count(*) AS next_rows, max(id) AS last_id FROM postings JOIN m ON source = key AND first_seen > mark GROUP BY kind, source""")
def r02(spark, d):
    """What the run after a cut run returns, for feeds that keep the mark and feeds that move it."""
    p, state = A.postings(spark, d).withColumn("key", F.col("source")), marks(spark, d)
    at = {"keeps": ("2001-03-01 00:00:00", False, False), "moves": ("2001-03-01 00:00:00", False, True), "never back": ("1990-01-01 00:00:00", True, True)}
    runs = []
    for kind, (indexed, completed, moves) in at.items():
        after = E.advance_feeds(state, state.select("key").withColumns({"indexed_at": A.ts(indexed), "completed": F.lit(completed)}), A.now(), moves)
        new = E.new_for_feeds(p.join(after.select("key"), "key", "left_semi"), after)
        runs.append(new.groupBy("source").agg(F.count("*").alias("next_rows"), F.max("id").alias("last_id")).withColumn("kind", F.lit(kind)))
    return runs[0].unionByName(runs[1]).unionByName(runs[2]).select("kind", "source", "next_rows", "last_id")


@query("r03_seen_feed", """
WITH @postings, s AS (SELECT id, TIMESTAMP '2001-08-01' - to_days(CAST(k % 300 AS INTEGER)) AS t FROM postings WHERE k % 2 = 0), live AS (SELECT * FROM s WHERE t >= TIMESTAMP '2001-08-01' - INTERVAL 180 DAY),
o AS (SELECT id FROM postings WHERE id NOT IN (SELECT id FROM live) ORDER BY posted_at DESC NULLS LAST, id LIMIT 500)
SELECT id, 'delivered' AS kind FROM o UNION ALL SELECT id, 'seen' FROM live UNION ALL SELECT id, 'seen' FROM o""")
def r03(spark, d):
    p = A.postings(spark, d)
    seen = p.filter("k % 2 = 0").select(F.lit("f").alias("feed"), "id", (A.now() - F.expr("make_dt_interval(cast(k % 300 AS int))")).alias("at"))
    out, after = E.seen_feed(p, seen, "f", A.now(), 500, newest_first())
    return out.select("id", F.lit("delivered").alias("kind")).unionByName(after.select("id", F.lit("seen").alias("kind")))


@query("r03_seen_stream", "SELECT DISTINCT user_id || ':' || event_type AS id FROM events")
def r03b(spark, d):
    e = A.table(spark, d, "events").select(F.expr("concat(user_id, ':', event_type) AS id"), F.col("ts").cast("timestamp").alias("ts"))
    root = shared_dir(spark, "r03")
    for path in arriving(e, "ts", CUTS, root + "/in"):
        with state_sized(spark):
            S.seen_stream(S.file_stream(spark, path, e.schema), "ts", root + "/out", root + "/cp")
    return spark.read.parquet(root + "/out").select("id")


@query("r04_ingest_stream", """
SELECT 'shop' || c_custkey || '.example.com' AS domain FROM customer WHERE c_custkey % 7 <> 3""")
def r04(spark, d):
    c = A.table(spark, d, "customer").select("c_custkey", F.concat("c_custkey", F.lit(","), F.when(F.col("c_custkey") % 7 == 3, "bad domain").otherwise(F.concat(F.lit("Shop"), "c_custkey", F.lit(".example.com")))).alias("value"))
    root = shared_dir(spark, "r04")
    half = lambda odd: c.filter(f"c_custkey % 2 = {odd}").select("value").write.mode("append").text(root + "/in")
    half(0)
    S.ingest_stream(spark, root + "/in", "ranked", root + "/out", root + "/cp", 1)
    half(1)  # the list grows; a second run reads the new files only
    S.ingest_stream(spark, root + "/in", "ranked", root + "/out", root + "/cp", 1)
    return spark.read.parquet(root + "/out")


@query("r05_scd_stream", """
SELECT user_id || ':' || event_type AS id, event_type AS source, CAST(CAST(min(ts) AS DATE) AS VARCHAR) AS first_seen, CAST(CAST(max(ts) AS DATE) AS VARCHAR) AS last_seen FROM events GROUP BY 1, 2""")
def r05(spark, d):
    e = A.table(spark, d, "events").selectExpr("concat(user_id, ':', event_type) AS id", "event_type AS source", "cast(date_trunc('day', ts) AS timestamp_ntz) AS day")
    root = shared_dir(spark, "r05")
    for path in arriving(e, "day", CUTS, root + "/in"):
        S.scd_stream(S.file_stream(spark, path, e.schema), root + "/table", root + "/cp", "day", ["source"], most=2)
    t = S.scd_table(spark, root + "/table", ["source"])
    day = lambda c: F.to_date(c).cast("string").alias(c)
    return t.select("id", "source", day("first_seen"), day("last_seen"))


@query("r06_rate_stream", """
SELECT CAST(time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(CAST(5 * i AS INTEGER)) AS VARCHAR) AS start, CAST(user_id % 10 AS BIGINT) AS client, count(*) AS requests FROM events, range(12) t(i) GROUP BY 1, 2""")
def r06(spark, d):
    e = A.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 10).alias("client"))
    root = shared_dir(spark, "r06")
    for path in arriving(e, "ts", CUTS, root + "/in"):
        with state_sized(spark):
            S.rate_stream(S.file_stream(spark, path, e.schema), "ts", "client", root + "/out", root + "/cp")
    return S.last_update(spark, root + "/out", ["start", "client"]).withColumn("start", F.col("start").cast("string"))


@query("r07_daily_stream", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS calls, round(sum(value), 4) AS amount FROM events GROUP BY 1")
def r07(spark, d):
    e = A.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value")
    root = shared_dir(spark, "r07")
    for path in arriving(e, "ts", CUTS, root + "/in"):
        with state_sized(spark):
            S.daily_stream(S.file_stream(spark, path, e.schema), "ts", "value", root + "/out", root + "/cp")
    return S.last_update(spark, root + "/out", ["day"]).select(F.to_date("day").cast("string").alias("day"), "calls", F.round("amount", 4).alias("amount"))


@query("r08_guard_stream", """
WITH RECURSIVE @loads, r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY day) AS rn, loaded AND expected >= 50 AND open < expected / 2 AS short FROM loads),
g(company, rn, day, note, run) AS (
  SELECT company, rn, day, CASE WHEN NOT loaded THEN 'error' WHEN short THEN 'drop' END, CASE WHEN loaded AND short THEN 1 ELSE 0 END FROM r WHERE rn = 1
  UNION ALL SELECT r.company, r.rn, r.day, CASE WHEN NOT loaded THEN 'error' WHEN short AND g.run >= 6 THEN 'drop accepted' WHEN short THEN 'drop' END,
    CASE WHEN loaded AND short AND g.run < 6 THEN g.run + 1 ELSE 0 END FROM r JOIN g ON g.company = r.company AND r.rn = g.rn + 1)
SELECT company, CAST(day AS VARCHAR) AS day, note, coalesce(note NOT IN ('error', 'drop'), true) AS ok, CAST(max(CASE WHEN coalesce(note NOT IN ('error', 'drop'), true) THEN day END) OVER (PARTITION BY company ORDER BY day) AS VARCHAR) AS last_good FROM g""")
def r08(spark, d):
    from .windows import loads

    # Every eleventh load comes one span late.
    days = loads(spark, d).withColumn("comes", F.when(F.xxhash64("company", "day") % 11 == 0, F.date_add("day", 8)).otherwise(F.col("day")))
    root = shared_dir(spark, "r08")
    for path in arriving(days, "comes", CUTS, root + "/in"):
        with state_sized(spark):
            S.guard_stream(S.file_stream(spark, path, days.schema).drop("comes"), root + "/out", root + "/cp")
    return S.last_update(spark, root + "/out", ["company", "day"])


@query("r09_late_policy", """
WITH @postings SELECT CAST(CASE WHEN posted_at < first_seen THEN posted_at ELSE first_seen END AS DATE)::VARCHAR AS day, count(*) AS n FROM postings GROUP BY 1""")
def r09(spark, d):
    p = A.postings(spark, d).select("id", F.col("posted_at").cast("timestamp").alias("posted_at"), F.col("first_seen").cast("timestamp").alias("first_seen"))
    root = shared_dir(spark, "r09")
    for path in arriving(p, "first_seen", ["1900-01-01", "1997-01-01", "1999-01-01", "2100-01-01"], root + "/in"):
        with state_sized(spark):
            S.late_policy(S.file_stream(spark, path, p.schema), root + "/out", root + "/cp")
    u = S.last_update(spark, root + "/out", ["start", "day"])
    return u.groupBy(F.col("day").cast("string").alias("day")).agg(F.sum("n").alias("n"))
