"""The given tables as the tables the operators work on, in Spark and, for checking, as SQL.

Each view has a Spark function and the same view as a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2001-08-01 00:00:00"  # "now" of the postings
EVENTS_NOW = "2024-01-31 00:00:00"  # "now" of the event-based views


def ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


def now():
    return ts(NOW)


def events_now():
    return ts(EVENTS_NOW)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def postings(spark: SparkSession, d: str) -> DataFrame:
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.selectExpr(
        "concat(lower(c_mktsegment), ':customer-', c_custkey, ':', o_orderkey) AS id",
        "lower(c_mktsegment) AS source",
        "concat('customer-', c_custkey) AS company",
        "c_name AS company_name",
        "concat(substr(o_orderpriority, 3), ' ', CASE o_orderstatus WHEN 'F' THEN 'nurse' WHEN 'O' THEN 'engineer' ELSE 'RN manager' END) AS title",
        "n_name AS location",
        "r_name AS country",
        "array(concat(n_name, ' / ', r_name)) AS additional",
        "o_orderkey % 3 = 0 AS remote",
        "o_orderpriority AS department",
        "CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate END AS posted_at",
        "o_orderdate + make_dt_interval(cast(o_orderkey % 5 AS int)) AS first_seen",
        "CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS pay_max",
        "CASE WHEN o_orderkey % 8 < 6 AND o_orderkey % 4 <> 0 THEN round(o_totalprice * 0.8, 2) END AS pay_min",
        "CASE r_name WHEN 'AMERICA' THEN 'USD' WHEN 'EUROPE' THEN 'EUR' WHEN 'ASIA' THEN 'INR' WHEN 'AFRICA' THEN 'ZAR' ELSE 'AED' END AS currency",
        "concat('https://jobs.example.com/', lower(c_mktsegment), '/', o_orderkey) AS url",
        "o_orderkey AS k",
    )


POSTINGS_SQL = """postings AS (
  SELECT lower(c_mktsegment) || ':customer-' || c_custkey || ':' || o_orderkey AS id, lower(c_mktsegment) AS source,
    'customer-' || c_custkey AS company, c_name AS company_name,
    substr(o_orderpriority, 3) || ' ' || CASE o_orderstatus WHEN 'F' THEN 'nurse' WHEN 'O' THEN 'engineer' ELSE 'RN manager' END AS title,
    n_name AS location, r_name AS country, n_name || ' / ' || r_name AS additional, o_orderkey % 3 = 0 AS remote, o_orderpriority AS department,
    CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate END AS posted_at,
    o_orderdate + to_days(CAST(o_orderkey % 5 AS INTEGER)) AS first_seen,
    CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS pay_max,
    CASE WHEN o_orderkey % 8 < 6 AND o_orderkey % 4 <> 0 THEN round(o_totalprice * 0.8, 2) END AS pay_min,
    CASE r_name WHEN 'AMERICA' THEN 'USD' WHEN 'EUROPE' THEN 'EUR' WHEN 'ASIA' THEN 'INR' WHEN 'AFRICA' THEN 'ZAR' ELSE 'AED' END AS currency,
    'https://jobs.example.com/' || lower(c_mktsegment) || '/' || o_orderkey AS url, o_orderkey AS k
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """One row per day and id seen that day."""
    return table(spark, d, "events").selectExpr(
        "to_date(ts) AS day", "concat(user_id, ':', event_type) AS id", "event_type AS source", "concat('u', user_id) AS company"
    ).distinct()


SNAPSHOTS_SQL = """snapshots AS (
  SELECT DISTINCT CAST(ts AS DATE) AS day, user_id || ':' || event_type AS id, event_type AS source, 'u' || user_id AS company FROM events)"""


def stored(spark: SparkSession, d: str) -> DataFrame:
    """The job table the snapshots add up to: first and last day seen per id."""
    return table(spark, d, "events").groupBy(
        F.expr("concat(user_id, ':', event_type) AS id"), F.expr("event_type AS source"), F.expr("concat('u', user_id) AS company")
    ).agg(F.date_trunc("day", F.min("ts")).cast("timestamp_ntz").alias("first_seen"), F.date_trunc("day", F.max("ts")).cast("timestamp_ntz").alias("last_seen"))


STORED_SQL = """stored AS (
  SELECT user_id || ':' || event_type AS id, event_type AS source, 'u' || user_id AS company,
    date_trunc('day', min(ts)) AS first_seen, date_trunc('day', max(ts)) AS last_seen
  FROM events GROUP BY user_id, event_type)"""


def company_runs(spark: SparkSession, d: str) -> DataFrame:
    """One load per company and day it was seen: not good where the day's events hold mostly errors."""
    return table(spark, d, "events").groupBy(
        F.expr("event_type AS source"), F.expr("concat('u', user_id) AS company"), F.expr("to_date(ts) AS day")
    ).agg(
        F.expr("cast(date_trunc('day', min(ts)) AS timestamp_ntz) AS run_at"),
        F.expr("max(event_id) % 3 <> 0 AS ok"),
        F.expr("count(*) AS open"),
    )


COMPANY_RUNS_SQL = """company_runs AS (
  SELECT event_type AS source, 'u' || user_id AS company, CAST(ts AS DATE) AS day, date_trunc('day', min(ts)) AS run_at,
    max(event_id) % 3 <> 0 AS ok, count(*) AS open
  FROM events GROUP BY event_type, user_id, CAST(ts AS DATE))"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Nightly run counts by source; every sixth day is a catch-up."""
    return table(spark, d, "events").groupBy(F.expr("to_date(ts) AS day"), F.expr("event_type AS source")).agg(
        F.expr("count(*) * CASE WHEN (event_type = 'error' AND day(to_date(ts)) % 7 = 1) OR (event_type = 'view' AND day(to_date(ts)) % 7 IN (1, 2)) THEN 1 ELSE 100 END AS jobs")
    ).withColumn("is_full", F.expr("day(day) % 6 <> 0"))


RUNS_SQL = """runs AS (
  SELECT CAST(ts AS DATE) AS day, event_type AS source,
    count(*) * CASE WHEN (event_type = 'error' AND day(CAST(ts AS DATE)) % 7 = 1) OR (event_type = 'view' AND day(CAST(ts AS DATE)) % 7 IN (1, 2)) THEN 1 ELSE 100 END AS jobs,
    day(CAST(ts AS DATE)) % 6 <> 0 AS is_full
  FROM events GROUP BY CAST(ts AS DATE), event_type)"""


def requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(
        "event_id", "ts", "cast(user_id AS string) AS client", "CASE WHEN event_type = 'purchase' THEN user_id END AS payer",
        "event_type = 'purchase' AS paid", "CASE WHEN event_type = 'purchase' THEN value ELSE 0D END AS price", "value / 10 AS cost",
        "cast(get_json_object(props, '$.k') AS int) < 50 AS cache_hit",
    )


REQUESTS_SQL = """requests AS (
  SELECT event_id, ts, CAST(user_id AS VARCHAR) AS client, CASE WHEN event_type = 'purchase' THEN user_id END AS payer,
    event_type = 'purchase' AS paid, CASE WHEN event_type = 'purchase' THEN value ELSE 0 END AS price, value / 10 AS cost,
    CAST(json_extract_string(props, '$.k') AS INTEGER) < 50 AS cache_hit
  FROM events)"""


def health_systems(spark: SparkSession, d: str) -> DataFrame:
    """Nations as health systems: each owns the customers whose key leaves its number modulo forty (25 of 40 are owned)."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    keyed = c.selectExpr("c_custkey % 40 AS owner", "concat(lower(c_mktsegment), ':CUSTOMER-', c_custkey) AS key")
    # A system's keys are spread over rows of a few hundred keys, so no array grows with the table.
    keyed = keyed.groupBy("owner", F.expr("hash(key) % 64 AS part")).agg(F.collect_list("key").alias("keys"))
    return n.join(keyed, n.n_nationkey == keyed.owner).selectExpr(
        "n_name AS system", "n_name AS system_name", "concat('S', n_regionkey) AS system_state", "n_nationkey * 100 AS system_beds", "keys"
    )


HEALTH_SQL = """health AS (
  SELECT lower(c_mktsegment) || ':customer-' || c_custkey AS key, n_name AS system, 'S' || n_regionkey AS system_state, n_nationkey * 100 AS system_beds
  FROM customer JOIN nation ON c_custkey % 40 = n_nationkey)"""


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """Line items as store products."""
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    return li.join(p, li.l_partkey == p.p_partkey).selectExpr(
        "l_suppkey AS store", "concat(l_orderkey, '-', l_linenumber) AS product", "p_type AS product_type", "p_brand AS vendor",
        "array(named_struct('price', cast(l_extendedprice AS string)), named_struct('price', cast(l_extendedprice * 2 AS string))) AS variants",
        "l_extendedprice AS price", "l_shipdate AS published",
    )


CATALOG_SQL = """catalog AS (
  SELECT l_suppkey AS store, l_orderkey || '-' || l_linenumber AS product, p_type AS product_type, p_brand AS vendor,
    l_extendedprice AS price, l_shipdate AS published
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

VIEWS = {
    "postings": POSTINGS_SQL,
    "snapshots": SNAPSHOTS_SQL,
    "stored": STORED_SQL,
    "company_runs": COMPANY_RUNS_SQL,
    "runs": RUNS_SQL,
    "requests": REQUESTS_SQL,
    "health": HEALTH_SQL,
    "catalog": CATALOG_SQL,
}
