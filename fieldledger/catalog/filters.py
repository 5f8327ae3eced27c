"""Predicates V01-V17 over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import predicates as P
from ..functions.text import url_path
from ..functions.versions import valid_name, valid_version
from ..operators import filters as O
from .registry import query

@query("v01_keyword_match", """
WITH @postings SELECT id, title FROM postings WHERE regexp_matches(lower(title), '(^|[^a-z0-9])rn($|[^a-z0-9])') OR contains(lower(title), 'urgent')""")
def v01(spark, d):
    return A.postings(spark, d).filter(P.keyword_match("title", ["RN", " urgent ", ""])).select("id", "title")


@query("v02_search_text", """
WITH @postings, t AS (SELECT id, coalesce(title,'') || ' | ' || coalesce(location,'') || ' | ' || additional AS text FROM postings)
SELECT id, text FROM t WHERE (contains(lower(text), 'nation_1') OR contains(lower(text), 'asia')) AND NOT contains(lower(text), 'engineer')""")
def v02(spark, d):
    p = A.postings(spark, d).withColumn("text", P.search_text(P.text_parts(F.col("title"), F.col("location")), F.col("additional")))
    return p.filter(P.keyword_match("text", ["NATION_1", "Asia"]) & ~P.keyword_match("text", ["engineer"])).select("id", "text")


@query("v03_in_set", """
WITH @postings SELECT id, source, currency FROM postings WHERE source IN ('building','machinery') AND currency IN ('USD','EUR')""")
def v03(spark, d):
    return A.postings(spark, d).filter(
        P.in_set("source", ["Building", "MACHINERY "]) & P.in_set("currency", ["usd", "eur"], upper=True)
    ).select("id", "source", "currency")


@query("v03_array_in_set", """
SELECT p_partkey, p_name FROM part WHERE list_has_any(string_split(lower(p_name), ' '), ['red','bolt'])""")
def v03b(spark, d):
    return A.table(spark, d, "part").withColumn("tags", F.split("p_name", " ")).filter(P.array_in_set("tags", ["Red", "bolt"])).select("p_partkey", "p_name")


@query("v04_posted_within", """
WITH @postings SELECT id, CAST(coalesce(posted_at, first_seen) AS VARCHAR) AS at FROM postings
WHERE coalesce(posted_at, first_seen) >= TIMESTAMP '2001-08-01' - INTERVAL 400 DAY AND first_seen > TIMESTAMP '2000-09-01'""")
def v04(spark, d):
    p = A.postings(spark, d)
    return p.filter(P.posted_within("posted_at", "first_seen", A.now(), 400) & P.seen_after("first_seen", A.ts("2000-09-01 00:00:00"))).select(
        "id", F.coalesce("posted_at", "first_seen").cast("string").alias("at")
    )


@query("v05_posted_within_live", """
WITH @postings SELECT id FROM postings WHERE posted_at IS NULL OR posted_at >= TIMESTAMP '2001-08-01' - INTERVAL 100 DAY - CASE WHEN k % 2 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END""")
def v05(spark, d):
    text = F.when(F.col("k") % 2 == 0, F.date_format("posted_at", "yyyy-MM-dd")).otherwise(F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return A.postings(spark, d).withColumn("posted_text", text).filter(
        P.posted_within_live("posted_text", F.lit(A.NOW).cast("timestamp"), 100)
    ).select("id")


@query("v07_pay_filter", """
WITH @postings SELECT id, pay_max FROM postings WHERE pay_max IS NOT NULL AND pay_max >= 300000 AND currency IN ('USD','INR')""")
def v07(spark, d):
    return A.postings(spark, d).filter(P.pay_filter("pay_max", "currency", minimum=300_000, currencies=["usd", "inr"])).select("id", "pay_max")


STORE_SQL = """stores AS (
  SELECT 'store-' || s_suppkey || '.example.com' AS domain, s_name AS name, n_name AS city, r_name AS province,
    CASE WHEN s_suppkey % 10 <> 0 THEN 'C' || n_regionkey END AS country, CASE WHEN n_regionkey < 3 THEN 'USD' ELSE 'EUR' END AS currency,
    CASE WHEN s_suppkey % 4 = 0 THEN 'en-us' WHEN s_suppkey % 4 = 1 THEN 'de' END AS language,
    CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 500 END AS product_count, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS price_median,
    s_suppkey AS k, TIMESTAMP '2001-01-01' + to_days(CAST(s_suppkey % 200 AS INTEGER)) AS first_seen
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def stores(spark, d):
    """Suppliers as store records."""
    s, n, r = (A.table(spark, d, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.selectExpr(
        "concat('store-', s_suppkey, '.example.com') AS domain", "s_name AS name", "cast(null AS string) AS description", "n_name AS city", "r_name AS province",
        "CASE WHEN s_suppkey % 10 <> 0 THEN concat('C', n_regionkey) END AS country",
        "CASE WHEN n_regionkey < 3 THEN 'USD' ELSE 'EUR' END AS currency",
        "CASE WHEN s_suppkey % 4 = 0 THEN 'en-us' WHEN s_suppkey % 4 = 1 THEN 'de' END AS language",
        "CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 500 END AS product_count",
        "CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS price_median",
        "CASE WHEN s_suppkey % 6 = 0 THEN array('*') ELSE array(concat('C', n_regionkey), 'C9') END AS ships_to",
        "CASE WHEN s_suppkey % 3 = 0 THEN array('Klaviyo', 'Yotpo') ELSE array('Hotjar') END AS apps",
        "CASE WHEN s_suppkey % 2 = 0 THEN array(concat('a@store-', s_suppkey, '.com')) ELSE array() END AS emails",
        "array('+1 555 0100') AS phones",
        "named_struct('instagram', CASE WHEN s_suppkey % 3 <> 1 THEN 'https://instagram.com/x' END, 'facebook', cast(null AS string)) AS socials",
        "CASE WHEN s_suppkey % 2 = 0 THEN 'Dawn 2' ELSE 'Craft' END AS theme",
        "array(named_struct('name', concat('type ', s_suppkey % 9), 'count', 1)) AS product_types",
        "array(named_struct('name', n_name, 'count', 1)) AS vendors",
        "timestamp_ntz'2001-07-01 00:00:00' + make_dt_interval(cast(s_suppkey % 40 AS int)) AS newest_product",
        "s_suppkey % 30 AS added_30d",
        "timestamp_ntz'2001-01-01 00:00:00' + make_dt_interval(cast(s_suppkey % 200 AS int)) AS first_seen",
        "s_suppkey AS k",
    )


A.VIEWS["stores"] = STORE_SQL


@query("v08_store_filter", """
WITH @stores SELECT domain FROM stores WHERE country IN ('C0','C1','C2') AND currency = 'USD' AND (k % 6 = 0 OR country = 'C1')
  AND coalesce(product_count, 0) >= 0 AND coalesce(product_count, 0) <= 400 AND price_median >= 0 AND k % 2 = 0
  AND TIMESTAMP '2001-07-01' + to_days(CAST(k % 40 AS INTEGER)) >= TIMESTAMP '2001-08-01' - INTERVAL 30 DAY AND k % 30 >= 2
  AND (language LIKE 'en%') AND k % 3 <> 1 AND 'type ' || (k % 9) <> 'type 4'""")
def v08(spark, d):
    q = dict(countries=["c0", "C1", "c2"], currencies=["usd"], ships_to=["C1"], languages=["en"], min_products=0, max_products=400, min_median_price=0,
             require_email=True, require_phone=True, active_within=30, min_added=2, socials=["instagram"], themes=["dawn"], exclude=["type 4"])
    return stores(spark, d).filter(P.store_filter(q, A.now())).select("domain")


HEALTH_POSTINGS_SQL = """hp AS (
  SELECT p.*, h.system AS system_name, h.system_state, h.system_beds,
    CASE WHEN title LIKE '%nurse' THEN 'Registered nurse' WHEN title LIKE '%RN manager' THEN 'Registered nurse' ELSE 'Non-clinical' END AS role_family
  FROM postings p JOIN health h ON h.key = p.source || ':' || p.company)"""


@query("v09_health_filter", "WITH @postings, @health, " + HEALTH_POSTINGS_SQL + """
SELECT id, system_name, role_family FROM hp WHERE system_state IN ('S1','S2') AND system_beds >= 300 AND role_family = 'Registered nurse'
  AND (contains(lower(system_name), 'nation_1') OR contains(lower(company_name), 'nation_1'))""")
def v09(spark, d):
    from ..plans.hospitals import tagged_postings

    q = dict(systems=["nation_1"], states=["s1", "S2"], min_beds=300, families=["Registered nurse"])
    return tagged_postings(A.postings(spark, d), A.health_systems(spark, d)).filter(P.health_filter(q)).select("id", "system_name", "role_family")


FILINGS_SQL = """filings AS (
  SELECT o_orderkey AS accession, o_custkey AS cik, CASE WHEN o_orderkey % 4 = 0 THEN 'Amendment' ELSE 'New' END AS filing_type, o_orderdate AS filed_at,
    o_orderkey % 5 = 0 AS is_fund, CASE o_orderstatus WHEN 'F' THEN 'Technology' WHEN 'O' THEN 'Energy' ELSE 'Retail' END AS sector,
    CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS amount_sold, o_orderkey % 6 = 0 AS indefinite,
    CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice * 2 END AS offering,
    CASE WHEN o_orderkey % 3 = 0 THEN 1990 + o_orderkey % 12 END AS year_of_incorporation,
    CASE WHEN o_orderkey % 3 = 1 THEN 'Within five years' WHEN o_orderkey % 3 = 2 THEN 'Over five years' END AS incorporated_within
  FROM orders)"""
A.VIEWS["filings"] = FILINGS_SQL


def filings(spark, d):
    return A.table(spark, d, "orders").selectExpr(
        "o_orderkey AS accession", "o_custkey AS cik", "CASE WHEN o_orderkey % 4 = 0 THEN 'Amendment' ELSE 'New' END AS filing_type", "o_orderdate AS filed_at",
        "o_orderkey % 5 = 0 AS is_fund", "CASE o_orderstatus WHEN 'F' THEN 'Technology' WHEN 'O' THEN 'Energy' ELSE 'Retail' END AS sector",
        "CASE o_orderstatus WHEN 'F' THEN 'Computers' WHEN 'O' THEN 'Oil and Gas' ELSE 'Retailing' END AS industry",
        "CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS amount_sold", "o_orderkey % 6 = 0 AS indefinite",
        "CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice * 2 END AS offering",
        "CASE WHEN o_orderkey % 3 = 0 THEN 1990 + o_orderkey % 12 END AS year_of_incorporation",
        "CASE WHEN o_orderkey % 3 = 1 THEN 'Within five years' WHEN o_orderkey % 3 = 2 THEN 'Over five years' END AS incorporated_within",
    )


FILING_Q = dict(sectors=["technology", "Oil and gas"], min_raised=100_000, min_offering=300_000, incorporated_within=6)


@query("v10_filing_filter", """
WITH @filings SELECT accession, cik, sector FROM filings WHERE filing_type <> 'Amendment' AND NOT is_fund AND sector IN ('Technology','Energy')
  AND coalesce(amount_sold, 0) >= 100000 AND (indefinite OR coalesce(offering, 0) >= 300000)
  AND CASE WHEN year_of_incorporation IS NOT NULL THEN year_of_incorporation >= 2001 - 6 ELSE incorporated_within = 'Within five years' END""")
def v10(spark, d):
    return filings(spark, d).filter(P.filing_filter(FILING_Q, F.lit(2001))).select("accession", "cik", "sector")


@query("v11_prefilter", """
WITH @postings, light AS (SELECT id, title, CASE WHEN k % 7 = 0 THEN '3 Locations' ELSE location END AS places, (k % 60) AS age, k FROM postings),
v AS (SELECT *, CASE WHEN NOT (contains(lower(title), 'nurse') OR contains(lower(title), 'engineer')) THEN 'no'
    WHEN age > 30 OR (k % 11 = 0 AND age >= 30) THEN 'no'
    WHEN k % 7 <> 0 AND NOT contains(lower(places), 'nation_1') THEN 'no' WHEN k % 7 = 0 THEN 'maybe' ELSE 'yes' END AS verdict FROM light)
SELECT v.id, v.verdict FROM v JOIN postings p ON p.id = v.id WHERE v.verdict = 'yes' OR (v.verdict = 'maybe' AND contains(lower(p.location), 'nation_1'))""")
def v11(spark, d):
    q = dict(title=["nurse", "engineer"], posted_within=30, location=["nation_1"])
    p = A.postings(spark, d)
    light = p.select(
        "id", "title", F.when(F.col("k") % 7 == 0, "3 Locations").otherwise(F.col("location")).alias("places"),
        F.concat(F.lit("Posted "), F.col("k") % 60, F.when(F.col("k") % 11 == 0, "+").otherwise(""), F.lit(" Days Ago")).alias("posted_text"),
    )
    heavy = p.select("id", "location")
    return O.two_phase(light, heavy, P.prefilter(q), P.keyword_match("location", q["location"])).select("id", "verdict")


@query("v12_having", """
WITH @postings SELECT source, company, count(*) AS total, count(*) FILTER (title LIKE '%nurse') AS matching FROM postings GROUP BY source, company
HAVING count(*) FILTER (title LIKE '%nurse') >= 2 AND count(*) BETWEEN 5 AND 20""")
def v12(spark, d):
    from ..operators.aggregates import company_rollup

    r = company_rollup(A.postings(spark, d), ["source", "company"], F.col("title").endswith("nurse"))
    return O.having(r, min_matching=2, min_total=5, max_total=20).select("source", "company", "total", "matching")


@query("v13_drop_stale", """
WITH @postings SELECT count(*) AS read, count(*) FILTER (coalesce(posted_at, first_seen) < TIMESTAMP '2001-08-01' - INTERVAL 365 DAY) AS stale FROM postings""")
def v13(spark, d):
    return O.stale_summary(A.postings(spark, d), A.now(), 365)


@query("v15_path_allowed", """
WITH rules(pattern, allow) AS (VALUES ('/', true), ('/en/', false), ('/en/4', true), ('/fr/*page', false), ('/de/', false)),
urls AS (SELECT page_id, coalesce(regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1), '') AS path FROM pages),
m AS (SELECT page_id, path, pattern, allow, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, allow DESC) AS rn
  FROM urls JOIN rules ON (pattern = '/' AND starts_with(path, '/')) OR (pattern = '/en/' AND starts_with(path, '/en/')) OR (pattern = '/en/4' AND starts_with(path, '/en/4'))
    OR (pattern = '/fr/*page' AND regexp_matches(path, '^/fr/.*page')) OR (pattern = '/de/' AND starts_with(path, '/de/')))
SELECT u.page_id, coalesce(m.allow, true) AS allowed FROM urls u LEFT JOIN m ON m.page_id = u.page_id AND rn = 1""")
def v15(spark, d):
    pages = A.table(spark, d, "pages")
    robots = "User-agent: *\nAllow: /\nDisallow: /en/ # closed\nAllow: /en/4\nDisallow: /fr/*page\nDisallow:\n\nUser-agent: otherbot\nDisallow: /\n\nUser-agent: *\nDisallow: /de/"
    path = F.regexp_extract("url", r"^https?://[^/?#]+([^#]*)", 1)
    return pages.select("page_id", O.path_allowed(F.lit(robots), path, "ourbot").alias("allowed"))


@query("v16_valid_name", """
SELECT p_partkey, regexp_matches(replace(p_name, ' ', CASE WHEN p_partkey % 3 = 0 THEN '-' WHEN p_partkey % 3 = 1 THEN '/' ELSE ' ' END), '^[@a-zA-Z0-9._/-]+$') AND p_partkey % 3 = 0 AS ok,
  p_partkey % 2 = 0 AS ok_version FROM part""")
def v16(spark, d):
    p = A.table(spark, d, "part")
    sep = F.when(F.col("p_partkey") % 3 == 0, "-").when(F.col("p_partkey") % 3 == 1, "/").otherwise(" ")
    version = F.concat(F.lit("1."), F.col("p_size"), F.when(F.col("p_partkey") % 2 == 0, ".0").otherwise(" beta"))
    return p.select("p_partkey", valid_name(F.replace("p_name", F.lit(" "), sep)).alias("ok"), valid_version(version).alias("ok_version"))


MARKET_SQL = """market AS (
  SELECT p_partkey AS item, p_name AS title, p_type AS category, (p_partkey * 37) % 1000 AS users, CASE WHEN p_size % 5 <> 0 THEN p_size / 10.0 END AS rating,
    p_size % 25 AS reviews, CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey % 50) / 100.0 END AS failures, p_retailprice AS price
  FROM part)"""
A.VIEWS["market"] = MARKET_SQL


def market(spark, d):
    return A.table(spark, d, "part").selectExpr(
        "p_partkey AS item", "p_name AS title", "p_type AS category", "(p_partkey * 37) % 1000 AS users", "CASE WHEN p_size % 5 <> 0 THEN p_size / 10D END AS rating",
        "p_size % 25 AS reviews", "CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey % 50) / 100D END AS failures", "p_retailprice AS price",
    )


@query("v17_weak_incumbent", """
WITH @market SELECT item, users FROM market WHERE users >= 100 AND ((coalesce(rating, 0) < 4.3 AND reviews >= 10) OR coalesce(failures, 0) > 0.20) AND NOT regexp_matches(lower(title), 'ring|bolt')""")
def v17(spark, d):
    return market(spark, d).filter(P.weak_incumbent(failures="failures") & ~P.barred_topic("title", pattern="(?i)ring|bolt")).select("item", "users")
