"""Aggregations A01-A31 over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions.text import url_host
from ..operators import aggregates as G
from ..operators.joins import days_before
from .filters import market
from .registry import query

CO = ["source", "company"]


def join_list(col, field):
    """Array of structs as one text, so that results compare as plain values."""
    return F.array_join(F.transform(col, lambda x: F.concat(x[field], F.lit("="), x["n"])), ";")


@query("a01_company_rollup", """
WITH @postings SELECT source, company, count(*) AS total, count(*) FILTER (m) AS matching, count(*) FILTER (m AND remote) AS matching_remote,
  count(*) FILTER (m AND first_seen > TIMESTAMP '2000-01-01') AS matching_since, CAST(max(posted_at) FILTER (m) AS VARCHAR) AS latest_posted
FROM (SELECT *, title LIKE '%engineer' AS m FROM postings) GROUP BY source, company""")
def a01(spark, d):
    r = G.company_rollup(A.postings(spark, d), CO, F.col("title").endswith("engineer"), A.ts("2000-01-01 00:00:00"))
    return r.withColumn("latest_posted", F.col("latest_posted").cast("string"))


@query("a02_bulk_days", """
WITH @catalog, d AS (SELECT store % 10 AS store, CAST(date_trunc('year', published) AS DATE) AS posted_day, count(*) AS n FROM catalog WHERE published IS NOT NULL GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER (PARTITION BY store) AS total FROM d)
SELECT store, CAST(posted_day AS VARCHAR) AS posted_day, n, CAST(total AS BIGINT) AS total FROM t WHERE n >= 20 AND n > total * 0.14""")
def a02(spark, d):
    # Years stand in for days (no single day of these tables is bulky), and the share is lowered to match.
    c = A.catalog(spark, d).selectExpr("store % 10 AS store", "cast(date_trunc('year', published) AS timestamp_ntz) AS posted_at")
    return G.bulk_days(c, ["store"], share=0.14).select("store", F.col("posted_day").cast("string").alias("posted_day"), "n", "total")


NEW_SQL = """
WITH @postings, base AS (SELECT source, company, posted_at, first_seen, title LIKE '%nurse' AS m, CAST(posted_at AS DATE) AS pd, CAST(first_seen AS DATE) AS sd,
    CASE WHEN posted_at < first_seen THEN posted_at ELSE first_seen END AS age FROM (SELECT * REPLACE ('all' AS source, 'g' || (k % 40) AS company, date_trunc('month', posted_at) AS posted_at) FROM postings)),
w AS (SELECT *, count(*) OVER (PARTITION BY source, company) AS total, min(first_seen) OVER (PARTITION BY source, company) AS watched,
    count(*) OVER (PARTITION BY source, company, pd) AS on_day FROM base),
f AS (SELECT *, coalesce(pd IS NOT NULL AND on_day >= 20 AND on_day > total * 0.4 AND sd < CAST(watched + INTERVAL 2 DAY AS DATE), false) AS bulk,
    pd IS NOT NULL OR watched < TIMESTAMP '2001-08-01' - INTERVAL 7 DAY AS k7, pd IS NOT NULL OR watched < TIMESTAMP '2001-08-01' - INTERVAL 30 DAY AS k30,
    age >= TIMESTAMP '2001-08-01' - INTERVAL 7 DAY AS i7, age >= TIMESTAMP '2001-08-01' - INTERVAL 30 DAY AS i30 FROM w)
SELECT source, company, count(*) FILTER (NOT bulk AND k7 AND i7) AS new7, count(*) FILTER (NOT bulk AND k30 AND i30) AS new30,
  count(*) FILTER (NOT bulk AND k7 AND i7 AND m) AS matching_new7, count(*) FILTER (NOT bulk AND k30 AND i30 AND m) AS matching_new30,
  count(*) FILTER (bulk OR k30) AS known30, count(*) AS counted FROM f GROUP BY source, company"""


def monthly(spark, d):
    """Postings in forty groups with month-start dates, so that days are shared."""
    p = A.postings(spark, d)
    return p.withColumns({"source": F.lit("all"), "company": F.concat(F.lit("g"), F.col("k") % 40), "posted_at": F.date_trunc("month", "posted_at").cast("timestamp_ntz")})


@query("a03_new_counts", NEW_SQL)
def a03(spark, d):
    return G.new_counts(monthly(spark, d), CO, A.now(), F.col("title").endswith("nurse"))


@query("a04_growth", """
WITH @postings, g AS (SELECT source, company, count(*) AS total, count(*) FILTER (posted_at IS NOT NULL AND k % 5 <> 0) AS known, count(*) FILTER (posted_at >= TIMESTAMP '2000-06-01' AND k % 5 <> 0) AS new FROM postings GROUP BY source, company)
SELECT source, company, CASE WHEN known > 0 AND known * 2 >= total THEN floor(new / known * 100.0 + 0.5) / 100.0 END AS growth FROM g""")
def a04(spark, d):
    known = F.col("posted_at").isNotNull() & (F.col("k") % 5 != 0)
    g = A.postings(spark, d).groupBy(*CO).agg(
        F.count("*").alias("total"), G.count_where(known).alias("known"), G.count_where(known & (F.col("posted_at") >= A.ts("2000-06-01 00:00:00"))).alias("new")
    )
    return g.select(*CO, G.growth(F.col("new"), F.col("known"), F.col("total")).alias("growth"))


@query("a05_top_values", """
WITH @catalog, c AS (SELECT store, vendor, count(*) AS n FROM catalog GROUP BY store, vendor), r AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY n DESC, vendor) AS rk FROM c)
SELECT store, string_agg(vendor || '=' || n, ';' ORDER BY rk) AS top FROM r WHERE rk <= 5 GROUP BY store""")
def a05(spark, d):
    return G.top_values(A.catalog(spark, d), ["store"], "vendor", label="n").select("store", join_list("top", "name").alias("top"))


@query("a06_modal_pay", """
WITH @postings, g AS (SELECT 'seg-' || source AS source, currency, min(coalesce(pay_min, pay_max)) AS lo, max(pay_max) AS hi, count(*) AS n FROM postings WHERE pay_max IS NOT NULL GROUP BY source, currency),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, currency) AS rk, sum(n) OVER (PARTITION BY source) AS with_pay FROM g)
SELECT source, lo AS pay_low, hi AS pay_high, currency AS pay_currency, CAST(with_pay AS BIGINT) AS with_pay FROM r WHERE rk = 1""")
def a06(spark, d):
    return G.modal_pay(A.postings(spark, d).withColumn("source", F.concat(F.lit("seg-"), "source")), ["source"])


@query("a07_newest_k", """
WITH @postings, r AS (SELECT *, row_number() OVER (PARTITION BY source, company ORDER BY posted_at DESC NULLS LAST, id) AS rk FROM postings),
t AS (SELECT source, company, title, min(rk) AS rk FROM r WHERE rk <= 5 GROUP BY source, company, title),
s AS (SELECT source, company, string_agg(id, ';' ORDER BY rk) AS ids FROM r WHERE rk <= 5 GROUP BY source, company)
SELECT s.source, s.company, ids, string_agg(title, '; ' ORDER BY t.rk) AS sample_titles FROM s JOIN t USING (source, company) GROUP BY s.source, s.company, ids""")
def a07(spark, d):
    return G.newest_k(A.postings(spark, d), CO).select(*CO, F.array_join(F.transform("samples", lambda x: x["id"]), ";").alias("ids"), "sample_titles")


@query("a08_distinct_set", """
WITH @postings SELECT source, company, string_agg(DISTINCT department, ';' ORDER BY department) AS departments FROM postings GROUP BY source, company""")
def a08(spark, d):
    return G.distinct_set(A.postings(spark, d), CO, "department").select(*CO, F.array_join("values", ";").alias("departments"))


@query("a09_run_counts", """
WITH @stored, @company_runs, ok AS (SELECT source, company, max(run_at) AS ok_at FROM company_runs WHERE ok AND run_at < TIMESTAMP '2024-01-30' GROUP BY source, company)
SELECT s.source, s.company, count(*) FILTER (last_seen = TIMESTAMP '2024-01-30') AS open, count(*) FILTER (first_seen = TIMESTAMP '2024-01-30') AS opened,
  count(*) FILTER (first_seen < TIMESTAMP '2024-01-30' AND last_seen >= coalesce(ok_at, TIMESTAMP '0001-01-01')) AS expected,
  count(*) FILTER (last_seen < TIMESTAMP '2024-01-30' AND last_seen >= coalesce(ok_at, TIMESTAMP '2024-01-29')) AS closed
FROM stored s LEFT JOIN ok USING (source, company) GROUP BY s.source, s.company""")
def a09(spark, d):
    from ..operators.joins import last_ok

    at = A.ts("2024-01-30 00:00:00")
    return G.run_counts(A.stored(spark, d), last_ok(A.company_runs(spark, d), CO, at), CO, at, A.ts("2024-01-29 00:00:00"))


FETCHES_SQL = """fetches AS (SELECT event_type AS source, 'u' || user_id AS company, event_id AS seq, event_id % 11 <> 0 AS ok, CASE WHEN event_id % 11 = 0 THEN 'HTTP ' || (500 + event_id % 4) END AS error FROM events)"""
A.VIEWS["fetches"] = FETCHES_SQL


def fetches(spark, d):
    return A.table(spark, d, "events").selectExpr(
        "event_type AS source", "concat('u', user_id) AS company", "event_id AS seq", "event_id % 11 <> 0 AS ok", "CASE WHEN event_id % 11 = 0 THEN concat('HTTP ', 500 + event_id % 4) END AS error"
    )


@query("a10_load_status", """
WITH @fetches SELECT source, company, bool_and(ok) AS ok, arg_min(error, seq) FILTER (error IS NOT NULL) AS error FROM fetches GROUP BY source, company""")
def a10(spark, d):
    return G.load_status(fetches(spark, d), CO)


RESULTS_SQL = """results AS (SELECT f.source, f.company, bool_and(f.ok) AS ok, count(*) AS open, count(*) + max(f.seq) % 7 - 2 AS expected, arg_min(f.error, f.seq) FILTER (f.error IS NOT NULL) AS error,
    CASE WHEN NOT bool_and(f.ok) THEN CASE WHEN max(f.seq) % 5 = 0 THEN 'drop' ELSE 'error' END WHEN max(f.seq) % 9 = 0 THEN 'drop accepted' END AS note FROM fetches f GROUP BY f.source, f.company)"""
A.VIEWS["results"] = RESULTS_SQL


def results(spark, d):
    g = fetches(spark, d).groupBy(*CO).agg(
        F.every("ok").alias("ok"), F.count("*").alias("open"), F.max("seq").alias("m"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("error")
    )
    return g.selectExpr(
        "source", "company", "ok", "open", "open + m % 7 - 2 AS expected", "error",
        "CASE WHEN NOT ok THEN CASE WHEN m % 5 = 0 THEN 'drop' ELSE 'error' END WHEN m % 9 = 0 THEN 'drop accepted' END AS note",
    )


@query("a11_run_summary", """
WITH @fetches, @results SELECT count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed, CAST(coalesce(sum(greatest(0, expected - open)) FILTER (NOT ok), 0) AS BIGINT) AS rows_kept,
  count(*) FILTER (NOT ok AND note = 'drop') AS drops, count(*) FILTER (note = 'drop accepted') AS drops_accepted FROM results""")
def a11(spark, d):
    return G.run_summary(results(spark, d))


@query("a11_failure_reasons", """
WITH @fetches, @results SELECT source || ': ' || error AS reason, count(*) AS n FROM results WHERE NOT ok AND error IS NOT NULL GROUP BY 1 ORDER BY n DESC, reason LIMIT 10""")
def a11b(spark, d):
    return G.failure_reasons(results(spark, d))


@query("a11_top_failures", """
WITH @fetches, @results SELECT source, company, expected FROM results WHERE NOT ok ORDER BY expected DESC, source, company LIMIT 15""")
def a11c(spark, d):
    return G.top_failures(results(spark, d)).select("source", "company", "expected")


@query("a12_daily_cells", """
WITH @postings SELECT source AS system, location, department AS role_family, count(*) AS open, count(*) FILTER (first_seen = TIMESTAMP '1999-06-01') AS opened,
  count(*) FILTER (k % 3 = 0) AS with_bonus, CAST(floor(median(CASE WHEN k % 3 = 0 THEN round(pay_max / 100) END) + 0.5) AS BIGINT) AS median_bonus FROM postings GROUP BY 1, 2, 3""")
def a12(spark, d):
    p = A.postings(spark, d).selectExpr(
        "source AS system", "location", "department AS role_family", "first_seen", "k % 3 = 0 AS bonus", "CASE WHEN k % 3 = 0 THEN round(pay_max / 100) END AS bonus_amount"
    )
    return G.daily_cells(p, ["system", "location", "role_family"], A.ts("1999-06-01 00:00:00"))


@query("a13_median_round", """
SELECT l_returnflag, l_linestatus, CAST(floor(median(l_extendedprice) + 0.5) AS BIGINT) AS median FROM lineitem GROUP BY 1, 2""")
def a13(spark, d):
    return G.median_round(A.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


@query("a14_price_band", """
WITH @catalog, r AS (SELECT store, price, row_number() OVER (PARTITION BY store ORDER BY price) AS rn, count(*) OVER (PARTITION BY store) AS n FROM catalog)
SELECT store, min(price) AS price_min, max(CASE WHEN rn = n // 2 + 1 THEN price END) AS price_median, max(price) AS price_max FROM r GROUP BY store""")
def a14(spark, d):
    return G.price_band(A.catalog(spark, d), ["store"], "price")


@query("a15_catalog_facts", """
WITH @catalog, r AS (SELECT store, price, row_number() OVER (PARTITION BY store ORDER BY price) AS rn, count(*) OVER (PARTITION BY store) AS n FROM catalog),
b AS (SELECT store, min(price) AS price_min, max(CASE WHEN rn = n // 2 + 1 THEN price END) AS price_median, max(price) AS price_max FROM r GROUP BY store),
f AS (SELECT store, CAST(max(published) AS VARCHAR) AS newest_product, count(*) FILTER (published >= TIMESTAMP '2001-08-01' - INTERVAL 30 DAY) AS added_30d FROM catalog GROUP BY store),
t AS (SELECT store, product_type AS v, count(*) AS n, row_number() OVER (PARTITION BY store ORDER BY count(*) DESC, product_type) AS rk FROM catalog GROUP BY store, product_type),
v AS (SELECT store, vendor AS v, count(*) AS n, row_number() OVER (PARTITION BY store ORDER BY count(*) DESC, vendor) AS rk FROM catalog GROUP BY store, vendor)
SELECT b.*, f.newest_product, f.added_30d, (SELECT string_agg(v || '=' || n, ';' ORDER BY rk) FROM t WHERE t.store = b.store AND rk <= 5) AS product_types,
  (SELECT string_agg(v || '=' || n, ';' ORDER BY rk) FROM v WHERE v.store = b.store AND rk <= 5) AS vendors FROM b JOIN f USING (store)""")
def a15(spark, d):
    f = G.catalog_facts(A.catalog(spark, d), ["store"], A.now())
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["name"], F.lit("="), x["count"])), ";")
    return f.select("store", "price_min", "price_median", "price_max", F.col("newest_product").cast("string").alias("newest_product"), "added_30d",
                    text("product_types").alias("product_types"), text("vendors").alias("vendors"))


@query("a16_source_counts", """
WITH c AS (SELECT CAST(ts AS DATE) AS run_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT DISTINCT run_id FROM c),
k(source, et) AS (VALUES ('workday','click'), ('oracle','view'), ('smartrecruiters',NULL), ('ats','purchase'))
SELECT CAST(r.run_id AS VARCHAR) AS run_id, k.source, coalesce(c.n, 0) AS jobs FROM r CROSS JOIN k LEFT JOIN c ON c.run_id = r.run_id AND c.event_type = k.et
UNION ALL SELECT CAST(run_id AS VARCHAR), event_type, n FROM c WHERE event_type NOT IN ('click','view','purchase')""")
def a16(spark, d):
    e = A.table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("run_id"), "event_type").agg(F.count("*").alias("n"))
    pick = lambda t: F.max(F.when(F.col("event_type") == t, F.col("n")))
    small = F.map_from_entries(F.collect_list(F.when(~F.col("event_type").isin("click", "view", "purchase"), F.struct("event_type", "n"))))
    # Event types are a handful per day, so the map is too.
    runs = e.groupBy("run_id").agg(
        pick("click").alias("workday_jobs"), pick("view").alias("oracle_jobs"), F.lit(None).cast("bigint").alias("sr_jobs"), pick("purchase").alias("board_jobs"), small.alias("small")
    )
    return G.source_counts(runs)


@query("a17_ledger_summary", """
WITH @requests, w(name, since) AS (VALUES ('24h', TIMESTAMP '2024-01-30'), ('7d', TIMESTAMP '2024-01-24'), ('30d', TIMESTAMP '2024-01-01'), ('all', TIMESTAMP '1900-01-01'))
SELECT name AS "window", count(*) AS requests, count(*) FILTER (paid) AS paid_requests, round(coalesce(sum(price), 0), 4) AS revenue, round(coalesce(sum(cost), 0), 4) AS cost,
  count(*) FILTER (cache_hit) AS cache_hits, count(DISTINCT payer) AS unique_payers, round(round(coalesce(sum(price), 0), 4) - round(coalesce(sum(cost), 0), 4), 4) AS profit
FROM requests JOIN w ON ts >= since GROUP BY name""")
def a17(spark, d):
    return G.ledger_summary(A.requests(spark, d), A.events_now())


REGISTRY_SQL = """registry AS (SELECT lower(c_mktsegment) AS ats, 'customer-' || c_custkey AS slug, c_name AS name, coalesce(n, 0) AS job_count, c_custkey % 7 AS empty_streak
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey)"""
A.VIEWS["registry"] = REGISTRY_SQL


def registry(spark, d):
    c = A.table(spark, d, "customer")
    n = A.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return c.join(n, "c_custkey", "left").selectExpr(
        "lower(c_mktsegment) AS ats", "concat('customer-', c_custkey) AS slug", "c_name AS name", "coalesce(n, 0) AS job_count", "cast(c_custkey % 7 AS int) AS empty_streak"
    )


@query("a18_registry_stats", """
WITH @registry SELECT ats, count(*) AS companies, CAST(coalesce(sum(job_count), 0) AS BIGINT) AS jobs, count(DISTINCT ats) AS systems FROM registry WHERE empty_streak < 5 GROUP BY ROLLUP (ats)""")
def a18(spark, d):
    return G.registry_stats(registry(spark, d))


@query("a19_add_daily", """
WITH @requests SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(sum(cost), 4) AS amount, count(*) AS calls FROM requests GROUP BY 1""")
def a19(spark, d):
    return G.add_daily(A.requests(spark, d), "ts", "cost").withColumn("day", F.col("day").cast("string"))


@query("a20_profile", """
WITH @postings SELECT source, count(*) AS rows, count(DISTINCT company) AS distinct, round(avg(CASE WHEN pay_max IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS share_stated, median(pay_max) AS median FROM postings GROUP BY source""")
def a20(spark, d):
    return G.profile(A.postings(spark, d), ["source"], "company", "pay_max", "pay_max").withColumn("share_stated", F.round("share_stated", 6))


@query("a21_value_counts", """
WITH @postings, c AS (SELECT location AS value, count(*) AS n FROM postings GROUP BY 1) SELECT value, n, round(n / sum(n) OVER (), 6) AS share FROM c ORDER BY n DESC, value LIMIT 12""")
def a21(spark, d):
    return G.value_counts(A.postings(spark, d), "location", 12).withColumn("share", F.round("share", 6))


@query("a22_top_share", """
WITH s AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1), r AS (SELECT v, row_number() OVER (ORDER BY v DESC, o_custkey) AS rn FROM s)
SELECT t.top, round(sum(v) FILTER (rn <= t.top) / sum(v), 6) AS share FROM r, (VALUES (10), (25), (50)) t(top) GROUP BY t.top""")
def a22(spark, d):
    s = A.table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    return G.top_share(s, "v", "o_custkey").withColumn("share", F.round("share", 6))


@query("a23_threshold_counts", """
SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (o_totalprice >= t) AS n, round(count(*) FILTER (o_totalprice >= t) / count(*), 6) AS share FROM orders, (VALUES (1000), (100000), (300000), (450000)) x(t) GROUP BY t""")
def a23(spark, d):
    return G.threshold_counts(A.table(spark, d, "orders"), "o_totalprice", [1000, 100_000, 300_000, 450_000]).withColumn("share", F.round("share", 6))


@query("a24_bands", """
SELECT CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN '1-10' WHEN l_quantity > 10 AND l_quantity <= 25 THEN '11-25' WHEN l_quantity > 25 THEN '26+' END AS band,
  CAST(least(floor((least(l_extendedprice, 60000.0) - 0) / 1000.0), 59) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def a24(spark, d):
    li = A.table(spark, d, "lineitem")
    return li.groupBy(
        G.band("l_quantity", [0, 10, 25, float("inf")], ["1-10", "11-25", "26+"]).alias("band"), G.histogram_bin(F.col("l_extendedprice"), 0.0, 60_000.0, 60).alias("bin")
    ).agg(F.count("*").alias("n"))


@query("a25_list_counts", """
WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS value FROM part) SELECT value, count(*) AS n, round(count(*) / (SELECT count(*) FROM part), 6) AS share FROM w WHERE value <> '' GROUP BY value""")
def a25(spark, d):
    return G.list_counts(A.table(spark, d, "part"), "p_name", " ").withColumn("share", F.round("share", 6))


@query("a26_cooccur", """
SELECT l AS left, r AS right, count(*) FILTER (list_contains(string_split(p_name, ' '), l) AND list_contains(string_split(p_name, ' '), r)) AS n
FROM part, (VALUES ('red'), ('blue'), ('small')) a(l), (VALUES ('ring'), ('bolt'), ('widget')) b(r) GROUP BY 1, 2""")
def a26(spark, d):
    p = A.table(spark, d, "part").withColumn("tags", F.split("p_name", " "))
    return G.cooccur(p, "tags", ["red", "blue", "small"], ["ring", "bolt", "widget"])


@query("a27_supply_demand", """
WITH x AS (SELECT unnest(CASE WHEN p_partkey % 13 = 0 THEN ['(none)'] ELSE string_split(p_name, ' ') END) AS category, p_size AS d FROM part)
SELECT category, count(*) AS supply, CAST(sum(d) AS BIGINT) AS demand, round(sum(d) / count(*), 6) AS ratio FROM x GROUP BY category""")
def a27(spark, d):
    p = A.table(spark, d, "part").withColumn("cats", F.when(F.col("p_partkey") % 13 != 0, F.split("p_name", " ")))
    return G.supply_demand(p, "cats", "p_size").withColumn("ratio", F.round("ratio", 6))


@query("a28_domain_rollup", """
SELECT lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host, CAST(sum(page_id) AS BIGINT) AS calls, max(length(html)) AS max_payers, count(*) AS endpoints,
  round(CAST(coalesce(sum(CASE WHEN page_id % 3 <> 0 THEN page_id * 0.25 * page_id END), 0) AS DOUBLE), 2) AS revenue FROM pages GROUP BY 1""")
def a28(spark, d):
    p = A.table(spark, d, "pages").withColumns({"n": F.length("html"), "price": F.expr("CASE WHEN page_id % 3 <> 0 THEN page_id * 0.25D END")})
    return G.domain_rollup(p, url_host("url"), "page_id", "n", "price")


@query("a29_class_share", """
WITH @postings SELECT location, count(*) AS rows, round(avg(CASE WHEN title LIKE '%nurse' THEN 1.0 ELSE 0 END), 6) AS share, median(pay_max) AS median FROM postings GROUP BY location HAVING count(*) >= 600""")
def a29(spark, d):
    return G.class_share(A.postings(spark, d), ["location"], F.col("title").endswith("nurse"), "pay_max", 600).withColumn("share", F.round("share", 6))


@query("a30_status_dist", """
WITH p AS (SELECT CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 402 WHEN 'view' THEN 200 ELSE 404 END AS status, CASE WHEN user_id % 2 = 0 THEN 'Timeout' ELSE 'DNS' END AS e FROM events)
SELECT status, CASE WHEN status = 0 THEN e END AS error, count(*) AS n, round(count(*) / (SELECT count(*) FROM p), 6) AS share FROM p GROUP BY 1, 2""")
def a30(spark, d):
    p = A.table(spark, d, "events").selectExpr(
        "CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 402 WHEN 'view' THEN 200 ELSE 404 END AS status", "CASE WHEN user_id % 2 = 0 THEN 'Timeout' ELSE 'DNS' END AS e"
    )
    return G.status_dist(p, "status", "e").withColumn("share", F.round("share", 6))


@query("a31_stratified_sample", """
SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE coalesce(o_totalprice, 0) < 400000 ORDER BY md5(o_orderkey || ':42'), o_orderkey LIMIT 200)
UNION ALL SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 400000 ORDER BY o_orderkey LIMIT 150)""")
def a31(spark, d):
    return G.stratified_sample(A.table(spark, d, "orders"), "o_orderkey", "o_totalprice", 400_000).select("o_orderkey", "o_totalprice")
