"""Sorts, limits and set operations K01-K09, U01-U05 over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import order as O
from .joins import CO
from .registry import query


@query("k01_newest_first", """
WITH @postings SELECT id, CAST(row_number() OVER (PARTITION BY source, company ORDER BY posted_at DESC NULLS LAST, id) AS BIGINT) AS pos FROM postings""")
def k01(spark, d):
    from ..operators.groups import placed

    return placed(A.postings(spark, d), CO, O.newest_first()).select("id", F.col("pos").cast("bigint").alias("pos"))


@query("k02_first_n", """
WITH @postings SELECT id FROM postings WHERE title LIKE '%engineer' ORDER BY posted_at DESC NULLS LAST, id LIMIT 100""")
def k02(spark, d):
    return O.first_n(A.postings(spark, d).filter(F.col("title").endswith("engineer")), 100).select("id")


@query("k03_top_k", """
WITH @stores SELECT domain, product_count FROM stores ORDER BY coalesce(product_count, 0) DESC, domain LIMIT 20""")
def k03(spark, d):
    from .filters import stores

    return O.top_k(stores(spark, d), F.coalesce("product_count", F.lit(0)), 20).select("domain", "product_count")


COMPANIES_SQL = """companies AS (SELECT company AS company_name, count(*) AS total, count(*) FILTER (title LIKE '%nurse') AS matching, count(*) FILTER (posted_at >= TIMESTAMP '2000-06-01') AS matching_new30,
  CASE WHEN count(posted_at) > 3 THEN floor(count(*) FILTER (posted_at >= TIMESTAMP '2000-06-01') / count(posted_at) * 100.0 + 0.5) / 100.0 END AS growth FROM postings GROUP BY company)"""
A.VIEWS["companies"] = COMPANIES_SQL


def companies(spark, d):
    from ..functions.text import js_round

    new = F.count(F.when(F.col("posted_at") >= A.ts("2000-06-01 00:00:00"), True))
    return A.postings(spark, d).groupBy(F.col("company").alias("company_name")).agg(
        F.count("*").alias("total"), F.count(F.when(F.col("title").endswith("nurse"), True)).alias("matching"), new.alias("matching_new30"),
        F.when(F.count("posted_at") > 3, js_round(new / F.count("posted_at"), 2)).alias("growth"),
    )


@query("k04_rank_companies", """
WITH @postings, @companies SELECT company_name, growth, total FROM companies ORDER BY coalesce(growth * log10(10 + total), -1) DESC, matching DESC, company_name LIMIT 100""")
def k04(spark, d):
    return O.rank_companies(companies(spark, d), "growth", 100).select("company_name", "growth", "total")


@query("k05_rank_changes", """
WITH f AS (SELECT lang, doc_id, CASE doc_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS score, doc_id % 5 AS syms FROM documents)
SELECT lang, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, syms DESC, doc_id) AS rank FROM f)""")
def k05(spark, d):
    f = A.table(spark, d, "documents").select(
        "lang", "doc_id", F.expr("CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence"),
        F.expr("slice(array('a','b','c','d','e'), 1, cast(doc_id % 5 AS int)) AS symbols"), F.col("doc_id").alias("pos"),
    )
    return O.rank_changes(f, ["lang"], huge=True).select("lang", "doc_id", "rank")


@query("k07_by_size", """
WITH @registry SELECT slug, job_count FROM registry WHERE empty_streak < 5 AND job_count >= 1 ORDER BY job_count DESC, slug LIMIT 60""")
def k07(spark, d):
    from .aggregates import registry

    return O.by_size(registry(spark, d).filter("empty_streak < 5 AND job_count >= 1"), "job_count", 60, "slug").select("slug", "job_count")


@query("k08_cap_state", """
SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn <= 900""")
def k08(spark, d):
    e = A.table(spark, d, "events").select((F.col("user_id") % 4).alias("feed"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return O.cap_state(e, ["feed"], 900).select(F.col("id").alias("event_id"))


@query("k09_citations", """
WITH o AS (SELECT l_orderkey, list(l_linenumber || '.' || l_partkey ORDER BY l_linenumber, l_partkey) AS notes FROM lineitem GROUP BY 1)
SELECT o_orderkey, 'https://registry/' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN ';repo' ELSE '' END || coalesce(';' || array_to_string(notes, ';'), '') || coalesce(';' || array_to_string(notes, ';'), '') AS cites
FROM orders LEFT JOIN o ON l_orderkey = o_orderkey""")
def k09(spark, d):
    o, li = A.table(spark, d, "orders"), A.table(spark, d, "lineitem")
    notes = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(  # an order's lines are few by nature
        F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(x["l_linenumber"], F.lit("."), x["l_partkey"])).alias("notes")
    )
    j = o.join(notes, "o_orderkey", "left").withColumn("notes", F.coalesce("notes", F.array().cast("array<string>")))
    cites = O.citations(F.concat(F.lit("https://registry/"), "o_orderkey"), F.when(F.col("o_orderkey") % 2 == 0, "repo"), F.col("notes"), F.col("notes"))
    return j.select("o_orderkey", F.array_join(cites, ";").alias("cites"))


@query("u01_union_sources", """
SELECT 'c' || c_custkey AS id, c_mktsegment AS department, NULL::INTEGER AS beds FROM customer UNION ALL SELECT 's' || s_suppkey, NULL, NULL FROM supplier UNION ALL SELECT 'n' || n_nationkey, NULL, n_nationkey FROM nation""")
def u01(spark, d):
    return O.union_sources(
        A.table(spark, d, "customer").selectExpr("concat('c', c_custkey) AS id", "c_mktsegment AS department"),
        A.table(spark, d, "supplier").selectExpr("concat('s', s_suppkey) AS id"),
        A.table(spark, d, "nation").selectExpr("concat('n', n_nationkey) AS id", "n_nationkey AS beds"),
    )


@query("u02_distinct_by", """
SELECT host, url FROM (SELECT lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host, url, row_number() OVER (PARTITION BY lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) ORDER BY page_id) AS rn FROM pages) WHERE rn = 1""")
def u02(spark, d):
    from ..functions.text import url_host

    return O.distinct_by(A.table(spark, d, "pages"), url_host("url"), [F.col("page_id")]).select(url_host("url").alias("host"), "url")


@query("u03_minus", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def u03(spark, d):
    misses = A.table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return O.minus(A.table(spark, d, "customer"), misses, "c_custkey").select("c_custkey")


@query("u04_list_union", """
WITH w AS (SELECT p_partkey, p_type, p_name, string_split(p_name, ' ') AS l FROM part) SELECT p_partkey, p_type || ';' || array_to_string(list_filter(l, lambda x: x <> p_type), ';') AS tags FROM w""")
def u04(spark, d):
    return A.table(spark, d, "part").select("p_partkey", F.array_join(O.list_union(F.array("p_type"), F.split("p_name", " ")), ";").alias("tags"))


@query("u05_guarded_replace", "SELECT c_custkey FROM customer")
def u05(spark, d):
    c = A.table(spark, d, "customer").select("c_custkey")
    return O.guarded_replace(c, A.table(spark, d, "supplier"))
