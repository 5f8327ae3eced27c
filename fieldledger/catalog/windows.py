"""Window and sequence operators W01-W19 over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions.notes import near_key
from ..functions.text import last_segment, url_host
from ..operators import windows as W
from .joins import CO
from .registry import query


@query("w01_latest", """
WITH @company_runs SELECT source, company, CAST(max(day) AS VARCHAR) AS day, arg_max(ok, day) AS ok FROM company_runs GROUP BY source, company""")
def w01(spark, d):
    return W.latest(A.company_runs(spark, d), CO, "day").select(*CO, F.col("day").cast("string").alias("day"), "ok")


@query("w02_last_ok", """
WITH @company_runs SELECT source, company, CAST(max(run_at) AS VARCHAR) AS ok_at FROM company_runs WHERE ok AND run_at < TIMESTAMP '2024-01-25' GROUP BY source, company""")
def w02(spark, d):
    from ..operators.joins import last_ok

    return last_ok(A.company_runs(spark, d), CO, A.ts("2024-01-25 00:00:00")).select(*CO, F.col("ok_at").cast("string").alias("ok_at"))


GUARD_SQL = """loads AS (SELECT 'u' || (user_id % 20) AS company, CAST(ts AS DATE) AS day, count(*) AS open, count(*) * CASE WHEN user_id % 20 < 8 AND day(CAST(ts AS DATE)) BETWEEN 4 AND 24 THEN 3 ELSE 1 END + 40 AS expected,
    max(event_id) % 23 <> 0 AS loaded FROM events GROUP BY user_id % 20, CAST(ts AS DATE))"""
A.VIEWS["loads"] = GUARD_SQL


def loads(spark, d):
    return A.table(spark, d, "events").groupBy(F.expr("user_id % 20 AS u"), F.expr("to_date(ts) AS day")).agg(F.count("*").alias("open"), F.max("event_id").alias("m")).selectExpr(
        "concat('u', u) AS company", "day", "open", "open * CASE WHEN u < 8 AND day(day) BETWEEN 4 AND 24 THEN 3 ELSE 1 END + 40 AS expected", "m % 23 <> 0 AS loaded"
    )


@query("w03_outage_guard", """
WITH RECURSIVE @loads, r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY day) AS rn, loaded AND expected >= 50 AND open < expected / 2 AS short FROM loads),
g(company, rn, day, note, run) AS (
  SELECT company, rn, day, CASE WHEN NOT loaded THEN 'error' WHEN short THEN 'drop' END, CASE WHEN loaded AND short THEN 1 ELSE 0 END FROM r WHERE rn = 1
  UNION ALL SELECT r.company, r.rn, r.day, CASE WHEN NOT loaded THEN 'error' WHEN short AND g.run >= 6 THEN 'drop accepted' WHEN short THEN 'drop' END,
    CASE WHEN loaded AND short AND g.run < 6 THEN g.run + 1 ELSE 0 END FROM r JOIN g ON g.company = r.company AND r.rn = g.rn + 1)
SELECT company, CAST(day AS VARCHAR) AS day, note, coalesce(note NOT IN ('error', 'drop'), true) AS ok FROM g""")
def w03(spark, d):
    return W.outage_guard(loads(spark, d), ["company"]).select("company", F.col("day").cast("string").alias("day"), "note", "ok")


@query("w03_guard_today", """
WITH @loads, past AS (SELECT company, day, open % 2 = 0 AS x, row_number() OVER (PARTITION BY company ORDER BY day DESC) AS rn FROM loads WHERE day < DATE '2024-01-20'),
p AS (SELECT company, count(*) AS n, count(*) FILTER (substr(company, 2)::INT % 4 = 0 OR x) AS d FROM past WHERE rn <= 6 GROUP BY company)
SELECT company, CASE WHEN NOT loaded THEN 'error' WHEN expected >= 50 AND open < expected / 2 THEN CASE WHEN n = 6 AND d = n THEN 'drop accepted' ELSE 'drop' END END AS note
FROM loads LEFT JOIN p USING (company) WHERE day = DATE '2024-01-20'""")
def w03b(spark, d):
    l = loads(spark, d)
    past = l.filter("day < DATE'2024-01-20'").withColumn("note", F.expr("CASE WHEN cast(substr(company, 2) AS int) % 4 = 0 OR open % 2 = 0 THEN 'drop' END"))
    return W.guard_today(l.filter("day = DATE'2024-01-20'"), past, ["company"]).select("company", "note")


@query("w04_source_drops", """
WITH @runs, @usual SELECT CAST(day AS VARCHAR) AS day, source, jobs, usual FROM drops""")
def w04(spark, d):
    return W.source_drops(A.runs(spark, d)).withColumn("day", F.col("day").cast("string"))


@query("w05_cap_per_group", """
WITH @postings SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY source, company ORDER BY posted_at DESC NULLS LAST, id) AS rn FROM postings) WHERE rn <= 3""")
def w05(spark, d):
    from ..operators.order import newest_first

    return W.cap_per_group(A.postings(spark, d), CO, newest_first(), 3).select("id")


@query("w06_latest_per_entity", """
WITH @filings SELECT cik, accession FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filed_at DESC, accession DESC) AS rn FROM filings WHERE filing_type = 'New') WHERE rn = 1""")
def w06(spark, d):
    from .filters import filings

    f = filings(spark, d).filter("filing_type = 'New'")
    return W.latest(f, ["cik"], "filed_at", F.col("accession").desc()).select("cik", "accession")


@query("w07_dedupe_alias", """
WITH @stores, s AS (SELECT *, CASE WHEN k % 3 <> 0 THEN 'shop' || (k % 30) END AS shop FROM stores)
SELECT domain FROM (SELECT *, row_number() OVER (PARTITION BY coalesce('a:' || shop, 'o:' || domain) ORDER BY first_seen DESC, domain) AS rn FROM s) WHERE rn = 1""")
def w07(spark, d):
    from .filters import stores

    s = stores(spark, d).withColumn("shop", F.expr("CASE WHEN k % 3 <> 0 THEN concat('shop', k % 30) END"))
    return W.dedupe_alias(s, "shop", "domain", [F.col("first_seen").desc(), F.col("domain")]).select("domain")


@query("w08_share_best", """
WITH b AS (SELECT s_suppkey AS pos, 't' || (s_suppkey % 25) AS tenant, CASE s_suppkey % 4 WHEN 0 THEN 'Careers' WHEN 1 THEN 't' || (s_suppkey % 25) WHEN 2 THEN 'External' ELSE s_name END AS name FROM supplier),
g AS (SELECT *, name <> tenant AND name NOT IN ('Careers', 'External') AS good FROM b), m AS (SELECT tenant, arg_min(name, pos) AS best FROM g WHERE good GROUP BY tenant)
SELECT pos, CASE WHEN tenant = 't7' THEN 'Given' WHEN good THEN name ELSE coalesce(best, tenant) END AS shared_name FROM g LEFT JOIN m USING (tenant)""")
def w08(spark, d):
    from ..functions.text import is_generic_label

    b = A.table(spark, d, "supplier").selectExpr(
        "s_suppkey AS pos", "concat('t', s_suppkey % 25) AS tenant",
        "CASE s_suppkey % 4 WHEN 0 THEN 'Careers' WHEN 1 THEN concat('t', s_suppkey % 25) WHEN 2 THEN 'External' ELSE s_name END AS name",
    )
    good = (F.col("name") != F.col("tenant")) & ~is_generic_label("name")
    return W.share_best(b, "tenant", "name", good, "pos", {"t7": "Given"}).select("pos", "shared_name")


@query("w09_streak", """
WITH l AS (SELECT user_id, max(ts) FILTER (event_type <> 'error') AS last FROM events GROUP BY user_id)
SELECT e.user_id, count(*) FILTER (last IS NULL OR ts > last) AS streak, count(*) AS checks FROM events e JOIN l USING (user_id) GROUP BY e.user_id""")
def w09(spark, d):
    return W.streak(A.table(spark, d, "events"), ["user_id"], "ts", F.col("event_type") != "error").select("user_id", "streak", "checks")


@query("w10_next_check", """
SELECT event_id, CASE WHEN user_id % 9 = 0 THEN CASE WHEN user_id % 5 < 3 THEN 1 ELSE 30 END WHEN event_type = 'error' AND user_id % 5 >= 3 THEN 30
  ELSE CASE event_type WHEN 'error' THEN 21 WHEN 'click' THEN 14 WHEN 'view' THEN 21 WHEN 'purchase' THEN 45 ELSE 90 END END AS recheck_days FROM events""")
def w10(spark, d):
    e = A.table(spark, d, "events").selectExpr(
        "event_id", "cast(event_id AS string) AS domain", "ts AS checked_at", "cast(user_id % 5 AS int) AS fails", "user_id % 9 = 0 AS refused",
        "CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'live' WHEN 'view' THEN 'password' WHEN 'purchase' THEN 'closed' ELSE 'not_shopify' END AS status",
    )
    return W.next_check(e).select("event_id", "recheck_days")


@query("w11_due", """
SELECT domain FROM (SELECT 'store-' || s_suppkey AS domain, CASE WHEN s_suppkey % 4 = 0 THEN 'new' ELSE 'live' END AS status, CASE WHEN s_suppkey % 4 <> 0 THEN TIMESTAMP '2001-07-01' + to_days(CAST(s_suppkey % 60 AS INTEGER)) END AS nx FROM supplier)
WHERE nx IS NULL OR nx <= TIMESTAMP '2001-08-01' ORDER BY status = 'new' DESC, nx NULLS FIRST, domain LIMIT 40""")
def w11(spark, d):
    s = A.table(spark, d, "supplier").selectExpr(
        "concat('store-', s_suppkey) AS domain", "CASE WHEN s_suppkey % 4 = 0 THEN 'new' ELSE 'live' END AS status",
        "CASE WHEN s_suppkey % 4 <> 0 THEN timestamp_ntz'2001-07-01 00:00:00' + make_dt_interval(cast(s_suppkey % 60 AS int)) END AS next_check",
    )
    return W.due(s, A.now(), 40).select("domain")


@query("w12_seen_span", """
WITH @snapshots SELECT id, CAST(min(day) AS VARCHAR) AS first_seen, CAST(max(day) AS VARCHAR) AS last_seen FROM snapshots GROUP BY id""")
def w12(spark, d):
    s = W.seen_span(A.snapshots(spark, d), ["id"])
    return s.select("id", F.col("first_seen").cast("string").alias("first_seen"), F.col("last_seen").cast("string").alias("last_seen"))


@query("w13_stints", """
WITH @snapshots, g AS (SELECT id, day, CASE WHEN coalesce(day - lag(day) OVER (PARTITION BY id ORDER BY day) > 3, true) THEN 1 ELSE 0 END AS new FROM snapshots),
s AS (SELECT id, day, sum(new) OVER (PARTITION BY id ORDER BY day) AS stint FROM g)
SELECT id, CAST(stint AS BIGINT) AS stint, CAST(min(day) AS VARCHAR) AS first_seen, CAST(max(day) AS VARCHAR) AS last_seen, count(*) AS days FROM s GROUP BY id, stint""")
def w13(spark, d):
    s = W.stints(A.snapshots(spark, d), ["id"])
    return s.select("id", "stint", F.col("first_seen").cast("string").alias("first_seen"), F.col("last_seen").cast("string").alias("last_seen"), "days")


@query("w14_recent_count", """
WITH @requests SELECT event_id, count(*) OVER (PARTITION BY CAST(client AS BIGINT) % 10 ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) - 1 AS recent FROM requests""")
def w14(spark, d):
    r = A.requests(spark, d).withColumn("client", F.col("client").cast("bigint") % 10)
    return W.recent_count(r, "client", "ts").select("event_id", "recent")


@query("w15_refusal_windows", """
WITH p AS (SELECT event_type, row_number() OVER (ORDER BY ts, event_id) AS pos FROM events), w AS (SELECT (pos - 1) // 200 AS win, count(*) AS n, count(*) FILTER (event_type = 'error') AS refused FROM p GROUP BY 1),
f AS (SELECT *, refused / n AS share, refused / n > 0.1 AS bad FROM w WHERE n = 200)
SELECT win AS "window", refused, round(share, 6) AS share, win - coalesce(max(CASE WHEN NOT bad THEN win END) OVER (ORDER BY win), -1) AS bad_streak FROM f""")
def w15(spark, d):
    e = A.table(spark, d, "events")
    r = W.refusal_windows(e, [F.col("ts"), F.col("event_id")], F.col("event_type") == "error")
    return r.select("window", "refused", F.round("share", 6).alias("share"), "bad_streak")


@query("w16_carry_down", """
SELECT event_id, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS heading FROM events""")
def w16(spark, d):
    from ..operators.groups import carried_down

    e = A.table(spark, d, "events").withColumn("doc", F.col("user_id") % 5)
    mark = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return carried_down(e, ["doc"], "event_id", F.floor(F.col("event_id") / 500), mark, "heading").select("event_id", "heading")


@query("w17_dedupe_near", """
WITH f AS (SELECT doc_id AS pos, lang AS doc, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS key, CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 2 END AS conf FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY doc, key ORDER BY conf DESC, pos) AS rn, min(pos) OVER (PARTITION BY doc, key) AS first FROM f)
SELECT doc, key, first AS pos, CASE conf WHEN 3 THEN 'high' ELSE 'medium' END AS confidence FROM r WHERE rn = 1""")
def w17(spark, d):
    f = A.table(spark, d, "documents").select(
        F.col("doc_id").alias("pos"), F.col("lang").alias("doc"), near_key("text").alias("key"), F.when(F.col("doc_id") % 3 == 0, "high").otherwise("medium").alias("confidence")
    )
    return W.dedupe_near(f, ["doc"]).select("doc", "key", "pos", "confidence")


@query("w18_ranks", """
WITH r AS (SELECT n_name AS query, s_name AS name, s_suppkey % 3 = 0 AS own, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT n_name AS query, r.rank, r.name FROM nation LEFT JOIN r ON r.query = n_name AND own""")
def w18(spark, d):


    s, n = A.table(spark, d, "supplier"), A.table(spark, d, "nation")
    from ..operators.groups import numbered

    j = s.join(n, s.s_nationkey == n.n_nationkey).select("n_nationkey", F.col("n_name").alias("query"), F.col("s_name").alias("name"), "s_acctbal", "s_suppkey")
    r = numbered(j, ["n_nationkey"], [F.col("s_acctbal").desc(), F.col("s_suppkey")], F.floor(-F.col("s_acctbal") / 500), "rank")
    return W.ranks(r, n.select(F.col("n_name").alias("query")), F.col("s_suppkey") % 3 == 0)


@query("w19_classify_runs", """
WITH @runs, l AS (SELECT max(day) FILTER (is_full) AS last FROM runs) SELECT CAST(day AS VARCHAR) AS day, source,
  CASE WHEN is_full AND day = last THEN 'latest' WHEN is_full THEN 'previous' WHEN day > last THEN 'catch-up' ELSE 'older catch-up' END AS kind FROM runs, l""")
def w19(spark, d):
    return W.classify_runs(A.runs(spark, d)).select(F.col("day").cast("string").alias("day"), "source", "kind")
