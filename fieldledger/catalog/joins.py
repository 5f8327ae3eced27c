"""Joins J01-J20 over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions.text import normal_key
from ..operators import joins as J
from ..operators.windows import source_drops
from .aggregates import registry
from .registry import query

CO = ["source", "company"]
FAILING = """failing AS (SELECT source, company, coalesce(max(run_at) FILTER (ok), TIMESTAMP '0001-01-01') AS since FROM company_runs GROUP BY source, company HAVING NOT arg_max(ok, day))"""
A.VIEWS["failing"] = FAILING


def fails(spark, d):
    return J.failing(A.company_runs(spark, d), CO)


@query("j01_join_last_ok", """
WITH @stored, @company_runs, ok AS (SELECT source, company, max(run_at) AS ok_at FROM company_runs WHERE ok AND run_at < TIMESTAMP '2024-01-20' GROUP BY source, company)
SELECT s.id, CAST(ok_at AS VARCHAR) AS ok_at FROM stored s LEFT JOIN ok USING (source, company)""")
def j01(spark, d):
    j = J.join_last_ok(A.stored(spark, d), A.company_runs(spark, d), CO, A.ts("2024-01-20 00:00:00"))
    return j.select("id", F.col("ok_at").cast("string").alias("ok_at"))


@query("j02_live_rows", """
WITH @stored, @company_runs, @failing SELECT s.id FROM stored s LEFT JOIN failing f USING (source, company)
WHERE last_seen >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY AND (last_seen >= TIMESTAMP '2024-01-29' OR (since IS NOT NULL AND last_seen >= greatest(since, TIMESTAMP '2024-01-23')))""")
def j02(spark, d):
    return J.live_rows(A.stored(spark, d), fails(spark, d), CO, A.ts("2024-01-30 00:00:00")).select("id")


CLOSED_SQL = """closed AS (SELECT s.* FROM stored s LEFT JOIN failing f USING (source, company)
  WHERE last_seen < TIMESTAMP '2024-01-30' - INTERVAL 3 DAY AND NOT (since IS NOT NULL AND last_seen >= greatest(since, TIMESTAMP '2023-12-31')))"""
A.VIEWS["closed"] = CLOSED_SQL


@query("j03_closed_rows", "WITH @stored, @company_runs, @failing, @closed SELECT id FROM closed")
def j03(spark, d):
    return J.closed_rows(A.stored(spark, d), fails(spark, d), CO, A.ts("2024-01-30 00:00:00")).select("id")


def event_dim(spark, d):
    """Users as a dimension that owns companies: user u is owned by the user at u modulo fifty."""
    u = A.table(spark, d, "events").select("user_id", "event_type").distinct()
    return u.select(
        F.concat(F.lit("own-"), F.col("user_id") % 50).alias("system"), F.array(F.concat("event_type", F.lit(":U"), "user_id")).alias("keys")
    ).filter("NOT endswith(system, '7')")


@query("j04_archive_closed", """
WITH @stored, @company_runs, @failing, @closed SELECT c.id, 'own-' || (CAST(substr(c.company, 2) AS BIGINT) % 50) AS owner, t.tag, CAST(c.last_seen AS VARCHAR) AS last_seen
FROM closed c LEFT JOIN (SELECT user_id || ':' || event_type AS id, max(value) AS tag FROM events WHERE value > 10 GROUP BY 1) t ON t.id = c.id
WHERE (CAST(substr(c.company, 2) AS BIGINT) % 50) % 10 <> 7""")
def j04(spark, d):
    closed = J.closed_rows(A.stored(spark, d), fails(spark, d), CO, A.ts("2024-01-30 00:00:00"))
    tags = A.table(spark, d, "events").filter("value > 10").groupBy(F.expr("concat(user_id, ':', event_type) AS id")).agg(F.max("value").alias("tag"))
    out = J.archive_closed(closed, event_dim(spark, d), tags, "system", "keys", F.concat_ws(":", "source", "company"), A.ts("2024-01-30 00:00:00"))
    return out.select("id", "owner", "tag", F.col("last_seen").cast("string").alias("last_seen"))


@query("j05_tag_dimension", """
WITH @postings, @health SELECT p.id, h.system AS owner FROM postings p JOIN health h ON h.key = p.source || ':' || p.company""")
def j05(spark, d):
    return J.tag_dimension(A.postings(spark, d), A.health_systems(spark, d), "system", "keys", F.concat_ws(":", "source", "company")).select("id", "owner")


@query("j06_attach_text", """
WITH @postings, top AS (SELECT id, k FROM postings ORDER BY posted_at DESC NULLS LAST, id LIMIT 50)
SELECT id, coalesce(d.text, '') AS description FROM top LEFT JOIN documents d ON d.doc_id = top.k""")
def j06(spark, d):
    from ..operators.order import newest_first

    top = A.postings(spark, d).orderBy(*newest_first()).limit(50)
    texts = A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    out = J.attach_text(top.select(F.col("id").alias("pid"), F.col("k").alias("id")), texts, 50)
    return out.select(F.col("pid").alias("id"), "description")


@query("j07_split_new", """
WITH @snapshots, today AS (SELECT * FROM snapshots WHERE day = DATE '2024-01-20'), before AS (SELECT DISTINCT id FROM snapshots WHERE day < DATE '2024-01-20')
SELECT id, CASE WHEN id IN (SELECT id FROM before) THEN 'known' ELSE 'new' END AS kind FROM today""")
def j07(spark, d):
    s = A.snapshots(spark, d)
    new, known = J.split_new(s.filter("day = DATE'2024-01-20'"), s.filter("day < DATE'2024-01-20'"))
    return new.select("id", F.lit("new").alias("kind")).unionByName(known.select("id", F.lit("known").alias("kind")))


@query("j08_exclude_seen", """
SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events s WHERE s.ts < TIMESTAMP '2024-01-03' AND s.user_id = e.user_id AND s.event_type = e.event_type)""")
def j08(spark, d):
    e = A.table(spark, d, "events").withColumn("id", F.concat_ws(":", "user_id", "event_type"))
    return J.exclude_seen(e, e.filter("ts < timestamp_ntz'2024-01-03 00:00:00'").select("id").distinct()).select("event_id")


@query("j09_drop_orphans", """
SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def j09(spark, d):
    return J.drop_orphans(A.table(spark, d, "documents"), A.table(spark, d, "labels"), "doc_id").select("doc_id")


@query("j10_with_names", """
SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 60 < 30 THEN c_name ELSE 'customer-' || c_custkey END AS name FROM customer""")
def j10(spark, d):
    c = A.table(spark, d, "customer")
    names = c.filter("c_custkey % 3 <> 0").select(
        F.expr("concat('customer-', c_custkey) AS company"), F.col("c_name").alias("name"), (A.now() - F.expr("make_dt_interval(cast(c_custkey % 60 AS int))")).alias("fetched_at")
    )
    return J.with_names(c.selectExpr("c_custkey", "concat('customer-', c_custkey) AS company"), names, ["company"], A.now()).select("c_custkey", "name")


@query("j11_by_name", """
WITH k AS (SELECT DISTINCT s_suppkey, unnest(['supplier' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), 's' || s_suppkey]) AS key FROM supplier)
SELECT c_custkey, s_suppkey FROM customer JOIN k ON k.key = replace(lower(CASE WHEN c_custkey % 2 = 0 THEN replace(c_name, 'Customer#', 'SUPPLIER ') ELSE 'S.' || c_custkey END), ' ', '') OR k.key = 's' || c_custkey AND c_custkey % 2 = 1""")
def j11(spark, d):
    asked = A.table(spark, d, "customer").withColumn(
        "asked", F.when(F.col("c_custkey") % 2 == 0, F.replace("c_name", F.lit("Customer#"), F.lit("SUPPLIER "))).otherwise(F.concat(F.lit("S."), "c_custkey"))
    )
    dim = A.table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("s"), "s_suppkey").alias("ident"), "s_name")
    return J.by_name(asked, "asked", dim, "ident", "s_name").select("c_custkey", "s_suppkey")


@query("j12_merge_registry", """
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal ELSE 0.0 END AS jobs, c_custkey % 3 = 0 AS retained FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0""")
def j12(spark, d):
    c = A.table(spark, d, "customer")
    found = c.filter("c_custkey % 3 <> 0").selectExpr("c_custkey AS id", "c_acctbal AS jobs")
    old = c.filter("c_custkey % 2 = 0").selectExpr("c_custkey AS id", "0D AS jobs")
    return J.merge_registry(found, old, ["id"])


VERSIONS_SQL = """versions AS (SELECT DISTINCT p_partkey % 200 AS pkg, p_size || '.' || l_linenumber || '.' || CAST(l_quantity AS INTEGER) AS version, p_size AS a, l_linenumber AS b, CAST(l_quantity AS INTEGER) AS c
  FROM lineitem JOIN part ON l_partkey = p_partkey),
upgrades AS (SELECT p_partkey AS req, p_partkey % 200 AS pkg, (p_size // 2) || '.3.10' AS from_version, p_size // 2 AS fa, p_size || '.4' AS to_version, p_size AS ta FROM part)"""
A.VIEWS["versions"] = VERSIONS_SQL


def versions(spark, d):
    li, p = A.table(spark, d, "lineitem"), A.table(spark, d, "part")
    return li.join(p, li.l_partkey == p.p_partkey).selectExpr("p_partkey % 200 AS pkg", "concat_ws('.', p_size, l_linenumber, cast(l_quantity AS int)) AS version").distinct()


def upgrades(spark, d):
    return A.table(spark, d, "part").selectExpr("p_partkey AS req", "p_partkey % 200 AS pkg", "concat(p_size div 2, '.3.10') AS from_version", "concat(p_size, '.4') AS to_version")


@query("j13_in_range", """
WITH @versions SELECT req, count(*) AS releases, count(DISTINCT v.a) AS majors FROM upgrades u JOIN versions v USING (pkg) WHERE (v.a, v.b, v.c) > (fa, 3, 10) AND (v.a, v.b, v.c) <= (ta, 4, 0) GROUP BY req""")
def j13(spark, d):
    u = upgrades(spark, d)
    r = J.in_range(versions(spark, d), u)
    return r.groupBy("req").agg(F.count("*").alias("releases"), F.countDistinct(F.substring_index("version", ".", 1)).alias("majors"))


@query("j14_target_note", """
WITH c AS (SELECT doc_id % 300 AS req, doc_id % 3 + 1 AS priority, 'v' || doc_id AS tag, length(trim(text, e' \\n\\t')) < 400 OR (regexp_matches(text, '(?i)refer to .{0,40}CHANGELOG|see .{0,40}CHANGELOG|full changelog') AND length(trim(text, e' \\n\\t')) < 1500) AS ptr FROM documents)
SELECT req, tag FROM (SELECT *, row_number() OVER (PARTITION BY req ORDER BY CASE WHEN ptr AND priority < 3 THEN priority + 3 ELSE priority END, tag) AS rn FROM c) WHERE rn = 1""")
def j14(spark, d):
    c = A.table(spark, d, "documents").select(
        (F.col("doc_id") % 300).alias("req"), (F.col("doc_id") % 3 + 1).alias("priority"), F.concat(F.lit("v"), "doc_id").alias("tag"), F.col("text").alias("body")
    )
    return J.target_note(c, ["req"]).select("req", "tag")


@query("j15_advisory_fixed", """
SELECT l_orderkey, l_linenumber, (l_linenumber, CAST(l_quantity AS INTEGER), 0) <= (4, 10, 0) OR l_linenumber % 3 = 0 AS fixed FROM lineitem""")
def j15(spark, d):
    fixed = F.concat_ws(".", "l_linenumber", F.col("l_quantity").cast("int"), F.lit("0"))
    events = F.array(
        F.struct(F.lit("0").alias("introduced"), F.lit(None).cast("string").alias("fixed")),
        F.struct(F.lit(None).cast("string").alias("introduced"), fixed.alias("fixed")),
        F.struct(F.lit(None).cast("string").alias("introduced"), F.when(F.col("l_linenumber") % 3 == 0, "v4.10").alias("fixed")),
    )
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", J.advisory_fixed(events, F.lit("4.10.0")).alias("fixed"))


@query("j16_near_names", """
WITH n AS (SELECT DISTINCT lower(p_name) AS n FROM part), q AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN substr(p_name, 2) ELSE replace(p_name, 'e', 'a') END AS q FROM part),
p AS (SELECT q, n, levenshtein(q, n) AS dist, row_number() OVER (PARTITION BY q ORDER BY levenshtein(q, n), n) AS rk FROM q JOIN n ON levenshtein(q, n) BETWEEN 1 AND 2 AND abs(length(q) - length(n)) <= 3)
SELECT q.q AS name, string_agg(n || ':' || dist, ';' ORDER BY rk) FILTER (rk <= 3) AS near FROM q LEFT JOIN p ON p.q = q.q GROUP BY q.q""")
def j16(spark, d):
    p = A.table(spark, d, "part")
    asked = p.select(F.when(F.col("p_partkey") % 2 == 0, F.expr("substr(p_name, 2)")).otherwise(F.replace("p_name", F.lit("e"), F.lit("a"))).alias("name")).distinct()
    near = J.near_names(asked, "name", p.select(F.lower("p_name").alias("known")), "known")
    return near.select("name", F.array_join(F.transform("near", lambda x: F.concat(x["name"], F.lit(":"), x["distance"])), ";").alias("near"))


@query("j17_attach_citation", """
WITH n AS (SELECT doc_id % 100 AS pkg, 'v' || doc_id AS tag, CAST(doc_id % 7 AS VARCHAR) AS version, 'https://x/' || doc_id AS url, doc_id FROM documents),
c AS (SELECT doc_id AS claim, doc_id % 100 AS pkg, CASE WHEN doc_id % 3 = 0 THEN 'v' || doc_id ELSE 'none' END AS tag, CAST(doc_id % 11 AS VARCHAR) AS version FROM documents)
SELECT claim, coalesce(t.url, v.url) AS url FROM c LEFT JOIN n t ON t.pkg = c.pkg AND t.tag = c.tag LEFT JOIN (SELECT pkg, version, arg_min(url, doc_id) AS url FROM n GROUP BY 1, 2) v ON v.pkg = c.pkg AND v.version = c.version
WHERE coalesce(t.url, v.url) IS NOT NULL""")
def j17(spark, d):
    doc = A.table(spark, d, "documents")
    notes = doc.selectExpr("doc_id % 100 AS pkg", "concat('v', doc_id) AS tag", "cast(doc_id % 7 AS string) AS version", "concat('https://x/', doc_id) AS url", "doc_id AS pos")
    claims = doc.selectExpr(
        "doc_id AS claim", "doc_id % 100 AS pkg", "CASE WHEN doc_id % 3 = 0 THEN concat('v', doc_id) ELSE 'none' END AS claim_tag", "cast(doc_id % 11 AS string) AS claim_version"
    )
    return J.attach_citation(claims, notes, ["pkg"]).select("claim", "url")


@query("j18_drop_alias", """
WITH s AS (SELECT s_suppkey, 'h' || (s_suppkey % 20) || CASE WHEN s_suppkey % 20 = 3 THEN '-test' ELSE '' END || '.example.com' AS host, s_suppkey % 40 AS n FROM supplier)
SELECT s_suppkey, host FROM (SELECT *, row_number() OVER (PARTITION BY host, n ORDER BY s_suppkey) AS rn FROM s WHERE NOT contains(host, '-test.') AND host <> 'h5.example.com') WHERE rn = 1""")
def j18(spark, d):
    s = A.table(spark, d, "supplier").selectExpr(
        "s_suppkey", "concat('h', s_suppkey % 20, CASE WHEN s_suppkey % 20 = 3 THEN '-test' ELSE '' END, '.example.com') AS host", "s_suppkey % 40 AS n"
    )
    return J.drop_alias(s, "host", "n", [F.col("s_suppkey")], ["h5.example.com"]).select("s_suppkey", "host")


USUAL_SQL = """full_runs AS (SELECT day, source, CAST(sum(jobs) AS BIGINT) AS jobs FROM runs WHERE is_full GROUP BY day, source),
days AS (SELECT day, row_number() OVER (ORDER BY day) AS run FROM (SELECT DISTINCT day FROM full_runs)),
grid AS (SELECT d.day, d.run, s.source, f.jobs FROM days d CROSS JOIN (SELECT DISTINCT source FROM full_runs) s LEFT JOIN full_runs f ON f.day = d.day AND f.source = s.source),
usual AS (SELECT g.day, g.source, coalesce(g.jobs, 0) AS jobs, median(h.jobs) AS usual FROM grid g JOIN grid h ON h.source = g.source AND h.run BETWEEN g.run - 7 AND g.run - 1 AND h.jobs IS NOT NULL GROUP BY 1, 2, 3),
drops AS (SELECT * FROM usual WHERE usual >= 500 AND jobs < usual * 0.5)"""
A.VIEWS["usual"] = USUAL_SQL


@query("j19_not_recovered", """
WITH @runs, @usual SELECT CAST(d.day AS VARCHAR) AS day, d.source, d.usual FROM drops d
WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE NOT r.is_full AND r.source = d.source AND r.day > d.day AND r.day <= d.day + 2 AND r.jobs >= d.usual * 0.5)""")
def j19(spark, d):
    runs = A.runs(spark, d)
    drops = source_drops(runs).withColumnRenamed("day", "started")
    # Only catch-ups within two days speak for a drop here.
    later = runs.filter("NOT is_full").select("source", F.col("day").alias("started"), "jobs")
    return J.not_recovered(drops, later, within_days=2).select(F.col("started").cast("string").alias("day"), "source", "usual")


@query("j20_union_latest", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'daily' ELSE 'weekly' END AS feed FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def j20(spark, d):
    c = A.table(spark, d, "customer")
    old = c.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("weekly").alias("feed"))
    new = c.filter("c_custkey % 2 = 0").select("c_custkey", F.lit("daily").alias("feed"))
    return J.union_latest(old, new, ["c_custkey"])
