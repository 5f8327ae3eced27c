"""Upserts M01-M09 over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import upserts as U
from ..session import shared_dir
from .joins import CO, fails
from .registry import query

DAY = "timestamp_ntz'2024-01-20 00:00:00'"


def base_before(spark, d):
    """Ids seen before 20 January, with their first and last day."""
    e = A.table(spark, d, "events").filter(f"ts < {DAY}")
    return e.groupBy(F.expr("concat(user_id, ':', event_type) AS id")).agg(
        F.expr("max(event_type) AS source"), F.expr("cast(date_trunc('day', min(ts)) AS timestamp_ntz) AS first_seen"), F.expr("cast(date_trunc('day', max(ts)) AS timestamp_ntz) AS last_seen")
    ).select("id", F.concat(F.lit("old "), "source").alias("source"), "first_seen", "last_seen")


def today(spark, d):
    e = A.table(spark, d, "events").filter(f"ts >= {DAY} AND ts < timestamp_ntz'2024-01-21 00:00:00'")
    return e.groupBy(F.expr("concat(user_id, ':', event_type) AS id")).agg(F.expr("max(event_type) AS source"))


@query("m01_merge_snapshot", """
WITH b AS (SELECT user_id || ':' || event_type AS id, 'old ' || max(event_type) AS source, date_trunc('day', min(ts)) AS f, date_trunc('day', max(ts)) AS l FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1),
t AS (SELECT user_id || ':' || event_type AS id, max(event_type) AS source FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-21' GROUP BY 1)
SELECT coalesce(b.id, t.id) AS id, coalesce(t.source, b.source) AS source, CAST(coalesce(f, TIMESTAMP '2024-01-20') AS VARCHAR) AS first_seen, CAST(CASE WHEN t.id IS NOT NULL THEN TIMESTAMP '2024-01-20' ELSE l END AS VARCHAR) AS last_seen FROM b FULL JOIN t ON b.id = t.id""")
def m01(spark, d):
    m = U.merge_snapshot(base_before(spark, d), today(spark, d), A.ts("2024-01-20 00:00:00"), ["source"])
    return m.select("id", "source", F.col("first_seen").cast("string").alias("first_seen"), F.col("last_seen").cast("string").alias("last_seen"))


@query("m02_refresh_text", """
SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END AS text, CASE WHEN doc_id % 3 <> 0 THEN 'desc-' || (doc_id % 10) END AS chunk FROM documents""")
def m02(spark, d):
    doc = A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.concat(F.lit("desc-"), F.col("doc_id") % 10).alias("chunk"))
    new = doc.filter("id % 2 = 0 OR id % 3 = 0").select("id", F.when(F.col("id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return U.refresh_text(doc, new)


@query("m03_merge_company", """
WITH @registry SELECT ats, slug, CASE WHEN k % 3 <> 2 THEN CASE WHEN k % 6 = 0 THEN 0 ELSE job_count + 1 END ELSE job_count END AS job_count, CASE WHEN k % 3 = 0 THEN 'new ' || name WHEN k % 4 = 0 THEN NULL ELSE name END AS name,
  CASE WHEN k % 3 <> 2 THEN CASE WHEN k % 6 = 0 THEN CASE WHEN k % 4 = 0 THEN 1 ELSE empty_streak + 1 END ELSE 0 END ELSE empty_streak END AS empty_streak
FROM (SELECT *, CAST(substr(slug, 10) AS BIGINT) AS k FROM registry) WHERE NOT (k % 4 = 0 AND k % 3 = 2)""")
def m03(spark, d):
    from .aggregates import registry

    r = registry(spark, d).withColumn("k", F.expr("cast(substr(slug, 10) AS bigint)"))
    base = r.filter("k % 4 <> 0").select("ats", "slug", "job_count", "name", A.ts("2001-01-01 00:00:00").alias("first_seen"), A.ts("2001-01-01 00:00:00").alias("last_checked"), "empty_streak")
    hits = r.filter("k % 3 <> 2").selectExpr("ats", "slug", "CASE WHEN k % 6 = 0 THEN 0 ELSE job_count + 1 END AS job_count", "CASE WHEN k % 3 = 0 THEN concat('new ', name) END AS name")
    return U.merge_company(base, hits, A.now()).select("ats", "slug", "job_count", "name", "empty_streak")


@query("m04_merge_domain", """
SELECT 'store-' || s_suppkey AS domain, CASE WHEN s_suppkey % 3 = 0 THEN 'old' ELSE 'new list' END AS source, CASE WHEN s_suppkey % 3 = 0 THEN '2001-01-01 00:00:00' ELSE '2001-08-01 00:00:00' END AS first_seen,
  CASE WHEN s_suppkey % 2 = 0 THEN '2001-08-01 00:00:00' ELSE '2001-01-01 00:00:00' END AS dns_seen FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 2 = 0""")
def m04(spark, d):
    s = A.table(spark, d, "supplier").withColumn("domain", F.concat(F.lit("store-"), "s_suppkey"))
    old = s.filter("s_suppkey % 3 = 0").select("domain", F.lit("old").alias("source"), A.ts("2001-01-01 00:00:00").alias("first_seen"), A.ts("2001-01-01 00:00:00").alias("dns_seen"), F.lit("live").alias("status"))
    m = U.merge_domain(old, s.filter("s_suppkey % 2 = 0").select("domain", F.lit("new list").alias("source")), A.now())
    return m.select("domain", "source", F.col("first_seen").cast("string").alias("first_seen"), F.col("dns_seen").cast("string").alias("dns_seen"))


@query("m05_apply_checks", """
WITH s AS (SELECT s_suppkey AS k, s_suppkey % 5 = 0 AS refused, s_suppkey % 4 AS f0, CASE s_suppkey % 3 WHEN 0 THEN 'live' WHEN 1 THEN 'error' ELSE 'closed' END AS outcome, s_suppkey % 7 <> 0 AS done FROM supplier),
x AS (SELECT *, CASE WHEN NOT done THEN f0 WHEN refused OR outcome = 'error' THEN f0 + 1 ELSE 0 END AS fails FROM s), y AS (SELECT *, done AND refused AND fails < 3 AS light FROM x)
SELECT 'store-' || k AS domain, CASE WHEN NOT done OR light THEN 'live' WHEN refused THEN 'error' ELSE outcome END AS status, fails,
  CASE WHEN NOT done OR light THEN 'old' WHEN NOT refused AND outcome = 'live' THEN 'new' END AS record, CASE WHEN done AND NOT light AND k % 2 = 0 THEN 'n' ELSE 'o' END AS shop_id FROM y""")
def m05(spark, d):
    s = A.table(spark, d, "supplier").withColumn("domain", F.concat(F.lit("store-"), "s_suppkey"))
    old = s.select("domain", F.lit("live").alias("status"), (F.col("s_suppkey") % 4).alias("fails"), F.lit("o").alias("shop_id"), F.lit("old").alias("record"), A.ts("2001-07-01 00:00:00").alias("checked_at"), A.ts("2001-07-20 00:00:00").alias("next_check"))
    checks = s.filter("s_suppkey % 7 <> 0").select(
        "domain", F.expr("CASE s_suppkey % 3 WHEN 0 THEN 'live' WHEN 1 THEN 'error' ELSE 'closed' END AS status"), F.expr("s_suppkey % 5 = 0 AS refused"),
        F.expr("CASE WHEN s_suppkey % 2 = 0 THEN 'n' END AS shop_id"), F.lit("new").alias("record"), A.now().alias("checked_at"),
    )
    return U.apply_checks(old, checks).select("domain", "status", "fails", "record", "shop_id")


@query("m06_replace_day", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, CASE WHEN CAST(ts AS DATE) = DATE '2024-01-10' THEN 2 ELSE 1 END * count(*) AS n FROM events GROUP BY CAST(ts AS DATE), event_type""")
def m06(spark, d):
    path = shared_dir(spark, "m06")
    cells = A.table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    U.replace_day(cells, path)
    U.replace_day(cells.filter("day = DATE'2024-01-10'").withColumn("n", F.col("n") * 2), path)
    return spark.read.parquet(path).select(F.col("day").cast("string").alias("day"), "event_type", "n")


@query("m07_purge", """
WITH @stored, @company_runs, @failing, @closed SELECT s.id, CASE WHEN c.id IS NOT NULL THEN 'archive' ELSE 'keep' END AS fate FROM stored s LEFT JOIN closed c ON c.id = s.id""")
def m07(spark, d):
    gone, kept = U.purge(A.stored(spark, d), fails(spark, d), CO, A.ts("2024-01-30 00:00:00"))
    return gone.select("id", F.lit("archive").alias("fate")).unionByName(kept.select("id", F.lit("keep").alias("fate")))


@query("m08_cache", """
WITH r AS (SELECT 'v2|' || lower(p_name) || '|' || p_size AS key FROM part), k AS (SELECT key, count(*) AS n FROM r GROUP BY key)
SELECT key, CASE WHEN CAST(string_split(key, '|')[3] AS INTEGER) % 2 = 0 THEN n ELSE 0 END AS serves FROM k""")
def m08(spark, d):
    req = A.table(spark, d, "part").select(U.cache_key("v2", F.col("p_name"), F.col("p_size")).alias("key"), "p_size")
    cache = req.filter("p_size % 2 = 0").select("key").distinct().withColumns({"payload": F.lit("stored"), "serves": F.lit(0).cast("bigint")})
    hits, todo = U.cache_split(req, cache)
    computed = todo.select("key", F.lit("computed").alias("payload"))
    return U.cache_put(cache, computed, hits).select("key", "serves")


@query("m09_classify_check", """
WITH c AS (SELECT event_id, CASE event_id % 13 WHEN 0 THEN 429 WHEN 1 THEN 404 ELSE 200 END AS rb, event_id % 11 <> 0 AS allowed, CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 403 WHEN 2 THEN 402 WHEN 3 THEN 404 ELSE 200 END AS ms,
  event_id % 5 <> 0 AS ok, CASE event_id % 7 WHEN 0 THEN 430 ELSE 200 END AS hs, event_id % 8 = 0 AS pw, CASE event_id % 17 WHEN 0 THEN 403 ELSE 200 END AS cs, CASE event_id % 19 WHEN 0 THEN 429 ELSE 200 END AS ps, event_id % 2 = 0 AS need FROM events)
SELECT event_id, CASE WHEN rb = 429 THEN 'error' WHEN NOT allowed THEN 'robots' WHEN ms IS NULL OR ms = 403 THEN 'error' WHEN ms = 402 THEN 'closed' WHEN ms <> 200 OR NOT ok THEN 'not_shopify'
  WHEN hs = 430 THEN 'error' WHEN pw THEN 'password' WHEN (need AND cs = 403) OR ps = 429 THEN 'error' ELSE 'live' END AS status FROM c""")
def m09(spark, d):
    row = A.table(spark, d, "events").selectExpr(
        "event_id", "CASE event_id % 13 WHEN 0 THEN 429 WHEN 1 THEN 404 ELSE 200 END AS robots_status", "event_id % 11 <> 0 AS meta_allowed",
        "CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 403 WHEN 2 THEN 402 WHEN 3 THEN 404 ELSE 200 END AS meta_status", "event_id % 5 <> 0 AS meta_ok", "true AS home_allowed",
        "CASE event_id % 7 WHEN 0 THEN 430 ELSE 200 END AS home_status", "event_id % 8 = 0 AS home_password", "CASE event_id % 17 WHEN 0 THEN 403 ELSE 200 END AS contact_status",
        "event_id % 2 = 0 AS needs_contact", "CASE event_id % 19 WHEN 0 THEN 429 ELSE 200 END AS catalog_status",
    )
    return U.classify_check(row).select("event_id", "status")
