"""Composite dataflows Q01-Q15 over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .. import adapters as A
from ..plans import filings as PF
from ..plans import hospitals as PH
from ..plans import jobs as PJ
from ..plans import releases as PR
from ..plans import reports as PO
from ..plans import stores as PS
from ..session import saver, shared_dir
from ..sources import index as I
from .aggregates import fetches
from .filters import FILING_Q, filings, market, stores
from .joins import CO
from .payloads import filing_docs, js, st
from .registry import query
from .sources import published
from .text import spread
from .upserts import base_before

lit, col, cat = F.lit, F.col, F.concat

JOB_Q = dict(title=["RN", "engineer"], title_exclude=["urgent"], location=["NATION_1", "asia"], posted_within=1500, min_pay=150_000, currencies=["USD", "INR"], per_company=2, max_jobs=200)


@query("q01_job_search", """
WITH @postings, f AS (SELECT * FROM postings WHERE (regexp_matches(lower(title), '(^|[^a-z0-9])rn($|[^a-z0-9])') OR contains(lower(title), 'engineer')) AND NOT contains(lower(title), 'urgent')
  AND (contains(lower(location || ' | ' || additional || ' | ' || country), 'nation_1') OR contains(lower(location || ' | ' || additional || ' | ' || country), 'asia'))
  AND coalesce(posted_at, first_seen) >= TIMESTAMP '2001-08-01' - INTERVAL 1500 DAY AND pay_max >= 150000 AND currency IN ('USD','INR')),
c AS (SELECT *, row_number() OVER (PARTITION BY source, company ORDER BY posted_at DESC NULLS LAST, id) AS rn FROM f), t AS (SELECT * FROM c WHERE rn <= 2 ORDER BY posted_at DESC NULLS LAST, id LIMIT 200)
SELECT t.id, title, CAST(posted_at AS VARCHAR) AS posted_at, coalesce(d.text, '') AS description FROM t LEFT JOIN documents d ON d.doc_id = t.k""")
def q01(spark, d):
    from ..operators.joins import attach_text

    texts = A.table(spark, d, "documents").select(col("doc_id").alias("id"), "text")
    top = PJ.job_search_index(spark, *published(spark, d, "postings whole", A.postings), JOB_Q, A.now()).rows
    # A posting's text is the document of its number.
    out = attach_text(top.select(col("id").alias("pid"), col("k").alias("id"), "title", "posted_at"), texts, JOB_Q["max_jobs"])
    return out.select(col("pid").alias("id"), "title", col("posted_at").cast("string").alias("posted_at"), "description")


COMPANY_Q = dict(title=["nurse", "RN"], max_age_days=1200, min_matching=2, min_total=3, seen_after="1999-01-01 00:00:00", sort_by="growth", max_companies=400)


@query("q02_companies_hiring", """
WITH @postings, p AS (SELECT *, contains(lower(title), 'nurse') OR regexp_matches(lower(title), '(^|[^a-z0-9])rn($|[^a-z0-9])') AS m, CAST(posted_at AS DATE) AS pd, CAST(first_seen AS DATE) AS sd, CASE WHEN posted_at < first_seen THEN posted_at ELSE first_seen END AS age
  FROM postings WHERE coalesce(posted_at, first_seen) >= TIMESTAMP '2001-08-01' - INTERVAL 1200 DAY),
w AS (SELECT *, count(*) OVER (PARTITION BY source, company) AS tot, min(first_seen) OVER (PARTITION BY source, company) AS watched, count(*) OVER (PARTITION BY source, company, pd) AS on_day FROM p),
f AS (SELECT *, coalesce(pd IS NOT NULL AND on_day >= 20 AND on_day > tot * 0.4 AND sd < CAST(watched + INTERVAL 2 DAY AS DATE), false) AS bulk, pd IS NOT NULL OR watched < TIMESTAMP '2001-08-01' - INTERVAL 30 DAY AS k30, age >= TIMESTAMP '2001-08-01' - INTERVAL 30 DAY AS i30 FROM w),
g AS (SELECT source, company, count(*) AS total, count(*) FILTER (m) AS matching, count(*) FILTER (m AND remote) AS matching_remote, count(*) FILTER (m AND first_seen > TIMESTAMP '1999-01-01') AS matching_since, max(posted_at) FILTER (m) AS latest,
  count(*) FILTER (NOT bulk AND k30 AND i30) AS new30, count(*) FILTER (NOT bulk AND k30 AND i30 AND m) AS matching_new30, count(*) FILTER (bulk OR k30) AS known30 FROM f GROUP BY source, company),
h AS (SELECT *, CASE WHEN known30 > 0 AND known30 * 2 >= total THEN floor(new30 / known30 * 100.0 + 0.5) / 100.0 END AS growth FROM g WHERE matching >= 2 AND total >= 3 AND matching_since > 0),
mm AS (SELECT * FROM p WHERE m), dd AS (SELECT source, company, department, count(*) AS n FROM mm GROUP BY 1, 2, 3), dr AS (SELECT *, row_number() OVER (PARTITION BY source, company ORDER BY n DESC, department) AS rk FROM dd),
dt AS (SELECT source, company, string_agg(department || '=' || n, ';' ORDER BY rk) AS top_departments FROM dr WHERE rk <= 5 GROUP BY 1, 2),
cu AS (SELECT source, company, currency, min(coalesce(pay_min, pay_max)) AS lo, max(pay_max) AS hi, count(*) AS n FROM mm WHERE pay_max IS NOT NULL GROUP BY 1, 2, 3), ct AS (SELECT source, company, arg_min(lo, (-n, currency)) AS pay_low, arg_min(hi, (-n, currency)) AS pay_high, arg_min(currency, (-n, currency)) AS pay_currency FROM cu GROUP BY 1, 2),
sr AS (SELECT *, row_number() OVER (PARTITION BY source, company ORDER BY posted_at DESC NULLS LAST, id) AS rk FROM mm), stt AS (SELECT source, company, title, min(rk) AS rk FROM sr WHERE rk <= 5 GROUP BY 1, 2, 3), sa AS (SELECT source, company, string_agg(title, '; ' ORDER BY rk) AS sample_titles FROM stt GROUP BY 1, 2),
nm AS (SELECT DISTINCT source, company, company_name FROM mm)
SELECT h.source, h.company, company_name, total, matching, matching_remote, matching_since, CAST(latest AS VARCHAR) AS latest_posted, new30, matching_new30, growth, top_departments, pay_low, pay_high, pay_currency, sample_titles, 'https://jobs.example.com' AS career_site
FROM h JOIN dt USING (source, company) LEFT JOIN ct USING (source, company) JOIN sa USING (source, company) JOIN nm USING (source, company)
ORDER BY coalesce(growth * log10(10 + total), -1) DESC, matching DESC, company_name LIMIT 400""")
def q02(spark, d):
    r = PJ.companies_hiring(A.postings(spark, d), COMPANY_Q, A.now())
    tops = F.array_join(F.transform("top_departments", lambda x: cat(x["name"], lit("="), x["jobs"])), ";")
    return r.select(*CO, "company_name", "total", "matching", "matching_remote", "matching_since", col("latest_posted").cast("string").alias("latest_posted"), "new30", "matching_new30", "growth", tops.alias("top_departments"), "pay_low", "pay_high", "pay_currency", "sample_titles", "career_site")


def night(spark, d):
    """20 January's crawl over the table of the days before."""
    e = A.table(spark, d, "events")
    day = e.filter("to_date(ts) = DATE'2024-01-20'")
    parts = F.split("id", ":")
    base = base_before(spark, d).select("id", F.get(parts, 1).alias("source"), cat(lit("u"), F.get(parts, 0)).alias("company"), "first_seen", "last_seen")
    snap = day.groupBy(F.expr("concat(user_id, ':', event_type) AS id"), F.expr("event_type AS source"), F.expr("concat('u', user_id) AS company")).agg(F.count("*").alias("_n")).drop("_n")
    got = fetches(spark, d).join(day.select(col("event_id").alias("seq")), "seq", "left_semi")
    runs = A.company_runs(spark, d).filter("day < DATE'2024-01-20'").withColumn("note", F.when(~col("ok"), "error"))
    save = saver(spark, "night")
    return PJ.nightly(base, snap, got, runs, A.ts("2024-01-20 00:00:00"), A.ts("2024-01-19 00:00:00"), ["source", "company"], save)


NIGHT_SQL = """day AS (SELECT * FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-20'),
jobs AS (SELECT user_id || ':' || event_type AS id, event_type AS source, 'u' || user_id AS company, date_trunc('day', min(ts)) AS first_seen, date_trunc('day', max(ts)) AS last_seen FROM events WHERE ts < TIMESTAMP '2024-01-21' GROUP BY user_id, event_type),
old AS (SELECT * FROM company_runs WHERE day < DATE '2024-01-20'), lok AS (SELECT source, company, max(run_at) FILTER (ok) AS ok_at FROM old GROUP BY 1, 2),
ld AS (SELECT event_type AS source, 'u' || user_id AS company, bool_and(event_id % 11 <> 0) AS loaded FROM day GROUP BY event_type, user_id),
cn AS (SELECT j.source, j.company, count(*) FILTER (last_seen = TIMESTAMP '2024-01-20') AS open, count(*) FILTER (first_seen = TIMESTAMP '2024-01-20') AS opened, count(*) FILTER (first_seen < TIMESTAMP '2024-01-20' AND last_seen >= coalesce(ok_at, TIMESTAMP '0001-01-01')) AS expected,
  count(*) FILTER (last_seen < TIMESTAMP '2024-01-20' AND last_seen >= coalesce(ok_at, TIMESTAMP '2024-01-19')) AS closed FROM jobs j LEFT JOIN lok USING (source, company) GROUP BY 1, 2),
td AS (SELECT source, company, loaded AS ok, open, opened, CASE WHEN loaded THEN closed END AS closed, expected, CASE WHEN NOT loaded THEN 'error' END AS note FROM ld JOIN cn USING (source, company)),
allr AS (SELECT source, company, day, run_at, ok FROM old UNION ALL SELECT source, company, DATE '2024-01-20', TIMESTAMP '2024-01-20', ok FROM td),
fl AS (SELECT source, company, coalesce(max(run_at) FILTER (ok), TIMESTAMP '0001-01-01') AS since FROM allr GROUP BY 1, 2 HAVING NOT arg_max(ok, day)),
ar AS (SELECT j.id FROM jobs j LEFT JOIN fl USING (source, company) WHERE last_seen < TIMESTAMP '2024-01-17' AND NOT (since IS NOT NULL AND last_seen >= greatest(since, TIMESTAMP '2023-12-21')))"""
A.VIEWS["night"] = NIGHT_SQL


@query("q03_nightly", "WITH @company_runs, @night SELECT source, company, ok, open, opened, closed, expected, note FROM td")
def q03(spark, d):
    return night(spark, d)["company_runs"].select(*CO, "ok", "open", "opened", "closed", "expected", "note")


@query("q03_nightly_fate", """
WITH @company_runs, @night SELECT j.id, j.id IN (SELECT id FROM ar) AS archived, CAST(first_seen AS VARCHAR) AS first_seen, CAST(last_seen AS VARCHAR) AS last_seen FROM jobs j""")
def q03b(spark, d):
    n = night(spark, d)
    both = n["jobs"].withColumn("archived", lit(False)).unionByName(n["archive"].withColumn("archived", lit(True)))
    return both.select("id", "archived", col("first_seen").cast("string").alias("first_seen"), col("last_seen").cast("string").alias("last_seen"))


# Postings with a pay line, last seen up to eight days ago: rows of an old chunk, rows without text, rows whose chunk
# goes, and rows whose text is new. Every fifth customer's site is failing.
NIGHT_JOBS_SQL = """jobs AS (SELECT *, TIMESTAMP '2001-08-01' - to_days(CAST(k % 9 AS INTEGER)) AS last_seen, CASE WHEN k % 9 = 8 THEN 'desc-20010701-000' WHEN k % 4 = 0 THEN 'desc-20010730-000' END AS chunk, k % 4 <> 2 AS told FROM postings),
live AS (SELECT j.* FROM jobs j LEFT JOIN (SELECT 'customer-' || c_custkey AS company, TIMESTAMP '2001-07-28' AS since FROM customer WHERE c_custkey % 5 = 0) f USING (company)
  WHERE last_seen >= TIMESTAMP '2001-07-25' AND (last_seen >= TIMESTAMP '2001-07-31' OR (since IS NOT NULL AND last_seen >= greatest(since, TIMESTAMP '2001-07-25')))),
fresh AS (SELECT id, 'desc-20010801-' || lpad(CAST((row_number() OVER (ORDER BY id) - 1) // 300 AS VARCHAR), 3, '0') AS chunk FROM live WHERE chunk IS NULL AND told)"""
A.VIEWS["night_jobs"] = NIGHT_JOBS_SQL


def night_jobs(spark, d):
    p = A.postings(spark, d).drop("pay_min", "pay_max", "currency")
    text = cat(F.when(col("title").endswith("engineer"), "").otherwise("BLS needed. "), lit("The pay range is $"), F.format_number(40_000 + col("k"), 0), lit(" - $"), F.format_number(60_000 + col("k"), 0), lit(" a year."))
    none = lambda t: lit(None).cast(t)
    return p.withColumns(
        {
            "last_seen": A.now() - F.expr("make_dt_interval(cast(k % 9 AS int))"), "chunk": F.expr("CASE WHEN k % 9 = 8 THEN 'desc-20010701-000' WHEN k % 4 = 0 THEN 'desc-20010730-000' END"), "description": F.when(col("k") % 4 != 2, text),
            "employment_type": none("string"), "pay_source": none("string"), "pay_min": none("double"), "pay_max": none("double"), "currency": none("string"), "pay_period": none("string"), "annual_min": none("bigint"), "annual_max": none("bigint"),
        }
    )


def published_night(spark, d):
    """Chunks of the nights before, then the night's publish."""
    base = shared_dir(spark, "q04")
    jobs = night_jobs(spark, d)
    jobs.where("chunk IS NOT NULL").select("id", col("description").alias("text"), "chunk").repartition("chunk").write.partitionBy("chunk").parquet(f"{base}/chunks")
    fails = A.table(spark, d, "customer").filter("c_custkey % 5 = 0").select(F.expr("lower(c_mktsegment) AS source"), F.expr("concat('customer-', c_custkey) AS company"), A.ts("2001-07-28 00:00:00").alias("since"))
    root, after = PJ.publish_night(spark, jobs, fails, A.health_systems(spark, d), A.now(), base, "200108010000", 500, 300)
    return base, root, after


@query("q04_publish", """
WITH @postings, @health, @night_jobs, t AS (SELECT l.*, h.system, coalesce(l.chunk, f.chunk) AS in_chunk, row_number() OVER (ORDER BY posted_at DESC NULLS LAST, l.id) AS pos FROM live l LEFT JOIN health h ON h.key = l.source || ':' || l.company LEFT JOIN fresh f ON f.id = l.id)
SELECT id, CAST((pos - 1) // 500 AS INTEGER) AS shard, in_chunk AS chunk, CASE WHEN told THEN CAST(40000 + k AS DOUBLE) END AS pay_min, CASE WHEN told THEN CAST(60000 + k AS DOUBLE) END AS pay_max, CASE WHEN told THEN 'USD' END AS currency, CASE WHEN told THEN 'year' END AS pay_period,
  CASE WHEN system IS NOT NULL THEN CASE WHEN title LIKE '%engineer' THEN 'Non-clinical' ELSE 'Registered nurse' END END AS role_family, CASE WHEN system IS NOT NULL THEN CASE WHEN told AND NOT title LIKE '%engineer' THEN 'BLS' ELSE '' END END AS licenses,
  told AND in_chunk IS NOT NULL AS found, (SELECT count(*) FROM live) AS total, (SELECT count(DISTINCT source || ':' || company) FROM live) AS companies FROM t""")
def q04(spark, d):
    base, root, _ = published_night(spark, d)
    schema = "id string, posted_at timestamp_ntz, first_seen timestamp_ntz, chunk string, pay_min double, pay_max double, currency string, pay_period string, clinical struct<role_family:string,licenses:array<string>>, shard int"
    rows = I.read_shards(spark, f"{root}/shards", schema)
    texts = spark.read.parquet(f"{base}/chunks").select("id", "chunk", col("text").isNotNull().alias("found"))
    totals = spark.read.parquet(f"{root}/totals")
    out = rows.join(texts, ["id", "chunk"], "left").withColumns({"found": F.coalesce("found", lit(False)), "total": totals.select("total").scalar(), "companies": totals.select("companies").scalar()})
    return out.select("id", "shard", "chunk", "pay_min", "pay_max", "currency", "pay_period", col("clinical.role_family").alias("role_family"), F.array_join("clinical.licenses", ";").alias("licenses"), "found", "total", "companies")


@query("q04_chunks_left", """
WITH @postings, @night_jobs, c AS (SELECT coalesce(l.chunk, f.chunk) AS chunk FROM live l LEFT JOIN fresh f ON f.id = l.id WHERE coalesce(l.chunk, f.chunk) IS NOT NULL), named AS (SELECT coalesce(j.chunk, f.chunk) AS chunk FROM jobs j LEFT JOIN fresh f ON f.id = j.id)
SELECT chunk, count(*) AS jobs, max(CAST(chunk IN (SELECT chunk FROM c) AS INTEGER)) AS kept FROM named WHERE chunk IN (SELECT chunk FROM c) GROUP BY chunk""")
def q04b(spark, d):
    base, _, after = published_night(spark, d)
    left = I.published_chunks(spark, f"{base}/chunks").withColumn("kept", lit(1))
    return after.where("chunk IS NOT NULL").groupBy("chunk").agg(F.count("*").alias("jobs")).join(left, "chunk", "full_outer")


@query("q05_health_day", """
WITH @postings, @health, j AS (SELECT *, first_seen + to_days(CAST(k % 400 AS INTEGER)) AS last_seen FROM postings),
l AS (SELECT j.*, h.system FROM j JOIN health h ON h.key = j.source || ':' || j.company LEFT JOIN (SELECT 'customer-' || c_custkey AS company, TIMESTAMP '2001-07-20' AS since FROM customer WHERE c_custkey % 5 = 0) f ON f.company = j.company
  WHERE last_seen >= TIMESTAMP '2001-07-25' AND (last_seen >= TIMESTAMP '2001-07-31' OR (since IS NOT NULL AND last_seen >= greatest(since, TIMESTAMP '2001-07-25'))))
SELECT system, location, CASE WHEN title LIKE '%engineer' THEN 'Non-clinical' ELSE 'Registered nurse' END AS role_family, '' AS specialty, '' AS employment, count(*) AS open, count(*) FILTER (first_seen = TIMESTAMP '2001-08-01') AS opened,
  count(*) FILTER (k % 2 = 0) AS with_bonus, CAST(floor(median(CASE WHEN k % 2 = 0 THEN 1000 * (1 + k % 20) END) + 0.5) AS BIGINT) AS median_bonus FROM l GROUP BY 1, 2, 3""")
def q05(spark, d):
    p = A.postings(spark, d).withColumn("last_seen", F.expr("first_seen + make_dt_interval(cast(k % 400 AS int))"))
    p = p.withColumns({"description": F.when(col("k") % 2 == 0, cat(lit("We pay a $"), F.format_number(1000 * (1 + col("k") % 20), 0), lit(" sign-on bonus."))), "employment_type": lit(None).cast("string"), "department": lit(None).cast("string")})
    fails = A.table(spark, d, "customer").filter("c_custkey % 5 = 0").select(F.expr("lower(c_mktsegment) AS source"), F.expr("concat('customer-', c_custkey) AS company"), A.ts("2001-07-20 00:00:00").alias("since"))
    return PH.health_day(p, A.health_systems(spark, d), fails, CO, A.now())


@query("q06_hospital_search", """
WITH @postings, @health, h2 AS (SELECT p.id, p.posted_at, p.title, h.system, p.source, p.company FROM postings p JOIN health h ON h.key = p.source || ':' || p.company WHERE coalesce(posted_at, first_seen) >= TIMESTAMP '2001-08-01' - INTERVAL 900 DAY AND system_state IN ('S0','S1','S2') AND title NOT LIKE '%engineer'),
c AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY posted_at DESC NULLS LAST, id) AS rn FROM h2) SELECT id, system, 'Registered nurse' AS role_family, title, CAST(posted_at AS VARCHAR) AS posted_at FROM c WHERE rn <= 20 ORDER BY posted_at DESC NULLS LAST, id LIMIT 150""")
def q06(spark, d):
    q = dict(posted_within=900, states=["S0", "S1", "S2"], families=["Registered nurse"], per_system=20, max_jobs=150)
    found = PH.hospital_search_index(spark, *published(spark, d, "postings whole", A.postings), A.health_systems(spark, d), q, A.now())
    return found.rows.select("id", "system", "role_family", "title", col("posted_at").cast("string").alias("posted_at"))


@query("q07_store_search", """
WITH @stores, m AS (SELECT * FROM stores WHERE k % 2 = 0 AND currency = 'USD') SELECT domain, product_count, (SELECT count(*) FROM m) AS matched FROM m ORDER BY coalesce(product_count, 0) DESC, domain LIMIT 25""")
def q07(spark, d):
    index = published(spark, d, "stores", stores, PS.newest_found(), 200, "first_seen")
    found = PS.store_search_index(spark, *index, dict(require_email=True, currencies=["usd"], sort_by="most_products", max_results=25), A.now())
    return found.rows.select("domain", "product_count", lit(found.matched).cast("bigint").alias("matched"))


@query("q07_newest_stores", """
WITH @stores SELECT domain, CAST(first_seen AS VARCHAR) AS first_seen FROM stores WHERE k % 2 = 0 AND currency = 'USD' AND first_seen > TIMESTAMP '2001-03-01' ORDER BY first_seen DESC, domain LIMIT 25""")
def q07b(spark, d):
    index = published(spark, d, "stores", stores, PS.newest_found(), 200, "first_seen")
    found = PS.store_search_index(spark, *index, dict(require_email=True, currencies=["usd"], seen_after="2001-03-01 00:00:00", max_results=25), A.now())
    return found.rows.select("domain", col("first_seen").cast("string").alias("first_seen"))


@query("q08_store_build", """
WITH s AS (SELECT s_suppkey AS k, s_name, CASE WHEN s_suppkey % 11 = 0 THEN 'robots' WHEN s_suppkey % 7 = 0 THEN 'closed' WHEN s_suppkey % 5 = 0 THEN 'password' ELSE 'live' END AS status, 'shop' || (s_suppkey // 2) AS shop FROM supplier),
p AS (SELECT l_suppkey AS k, l_extendedprice AS price, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
b AS (SELECT k, min(price) AS price_min, max(CASE WHEN rn = n // 2 + 1 THEN price END) AS price_median, max(price) AS price_max FROM p GROUP BY k)
SELECT 'd' || s.k || '.com' AS domain, s_name AS name, 'a' || s.k || '@shop.co' || CASE WHEN s.k % 2 = 0 THEN '' ELSE ';help@shop.co' END AS emails, 'Klaviyo' AS apps, 'en' AS language, price_min, price_median, price_max FROM s LEFT JOIN b USING (k)
WHERE status = 'live' AND NOT EXISTS (SELECT 1 FROM s o WHERE o.status = 'live' AND o.shop = s.shop AND o.k > s.k)""")
def q08(spark, d):
    s = A.table(spark, d, "supplier").select(col("s_suppkey").alias("k"), "s_name")
    dom = cat(lit("d"), "k", lit(".com")).alias("domain")
    answer = lambda kind, status, body, df=s: df.select(dom, lit(kind).alias("kind"), status.alias("status"), body.alias("body"), cat(lit("https://d"), "k", lit(".com/"), lit(kind)).alias("final_url"))
    ok = lit(200)
    k = col("k")
    meta = js(name=col("s_name"), currency=lit("usd"), myshopify_domain=cat(lit("shop"), F.floor(k / 2)))
    home = cat(lit('<html lang="en"><a href="mailto:a'), k, lit('@shop.co">m</a><script src="https://static.klaviyo.com/x"></script>'), F.when(k % 2 == 0, '<a href="tel:+1555010203">t</a>').otherwise(""), F.when(k % 5 == 0, '<body class="template-password">').otherwise(""), lit("</html>"))
    contact = lit('<a href="mailto:help@shop.co">m</a>')
    # A store's catalogue comes as pages; here each line item is a page of one product.
    li = A.table(spark, d, "lineitem").select(col("l_suppkey").alias("k"), "l_extendedprice")
    goods = js(products=F.array(st(product_type=lit("x"), vendor=lit("v"), published_at=lit("2001-07-20T00:00:00Z"), variants=F.array(st(price=col("l_extendedprice").cast("string")), st(price=lit("999999999"))))))
    responses = answer("robots", ok, F.when(k % 11 == 0, "User-agent: *\nDisallow: /").otherwise("User-agent: *\nDisallow: /cart"))
    for a in (answer("meta", F.when(k % 7 == 0, 402).otherwise(200), meta), answer("home", ok, home), answer("contact", ok, contact), answer("catalog", ok, goods, li)):
        responses = responses.unionByName(a)
    first = s.select(dom, F.expr("timestamp_ntz'2001-01-01 00:00:00' + make_dt_interval(cast(k AS int))").alias("first_seen"))
    out = PS.store_build(responses, first, A.now())
    return out.select("domain", "name", F.array_join("emails", ";").alias("emails"), F.array_join("apps", ";").alias("apps"), "language", "price_min", "price_median", "price_max")


@query("q09_funded", """
WITH @filings, f AS (SELECT *, CASE WHEN cik = 0 THEN '' ELSE CAST(cik AS VARCHAR) END AS c FROM filings WHERE accession % 10 <> 1 AND filing_type <> 'Amendment' AND NOT is_fund AND sector IN ('Technology','Energy') AND floor(coalesce(amount_sold, 0)) >= 100000 AND (indefinite OR floor(coalesce(offering, 0)) >= 300000)
  AND CASE WHEN year_of_incorporation IS NOT NULL THEN year_of_incorporation >= 2001 - 6 ELSE incorporated_within = 'Within five years' END),
l AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY CAST(filed_at AS DATE) DESC, '0001-01-' || accession DESC) AS rn FROM f) SELECT '0001-01-' || accession AS accession, c AS cik, sector, floor(amount_sold) AS amount_sold FROM l WHERE rn = 1""")
def q09(spark, d):
    docs = filing_docs(spark, d)
    hits = docs.join(filings(spark, d).select(cat(lit("0001-01-"), "accession").alias("accession"), F.when(col("filing_type") == "Amendment", "D/A").otherwise("D").alias("form")), "accession")
    hits = hits.select("accession", "cik", "file_name", "filed_at", "form", cat(lit("Firm "), "cik").alias("name"))
    seen = filings(spark, d).filter("accession % 10 = 1").select(cat(lit("0001-01-"), "accession").alias("accession"))
    q = {**FILING_Q, "latest_per_company": True, "companies": ["firm"]}
    return PF.funded(hits, docs.select("accession", "body"), q, lit(2001), seen).select("accession", "cik", "sector", "amount_sold")


# ---------------------------------------------------------------- releases

def release_tables(spark, d):
    """Packages, notes, changelogs and advisories of parts: package p has versions 1..size of its part, patch level from the line number."""
    p = spread(A.table(spark, d, "part"), "p_partkey")
    pkg = col("p_partkey").alias("pkg")
    ver = lambda i: cat(i, lit(".0.0"))
    packages = p.select(pkg, F.transform(F.sequence(lit(1), F.col("p_size") + 2), ver).alias("versions"))
    notes = p.select(pkg, "p_name", "p_size", F.posexplode(F.sequence(lit(1), col("p_size"))).alias("pos", "i"))
    body = cat(lit("## Breaking changes\n- `run` of the "), "p_name", lit(" now needs a token\n- Removed `opt_"), "i", lit("` for good\n"), F.repeat(lit("Long text about nothing. "), 20))
    short = F.when((col("i") == col("p_size")) & (col("pkg") % 3 == 0), "See the CHANGELOG").otherwise(body)
    notes = notes.select("pkg", "pos", ver(col("i")).alias("version"), cat(lit("v"), ver(col("i"))).alias("tag"), cat(lit("https://x/"), "pkg", lit("/"), "i").alias("url"), short.alias("body"))
    logs = p.filter("p_partkey % 2 = 0").select(pkg, lit("https://x/log").alias("changelog_url"), cat(lit("# Log\n## "), col("p_size"), lit(".0.0\n### Breaking\n- dropped the old door of the house\n## 0.1.0\nfirst")).alias("text"))
    adv = p.filter("p_partkey % 4 = 0").select(pkg, (col("p_size") > 20).alias("fixed_by_upgrade"))
    req = p.select(col("p_partkey").alias("req"), pkg, ver(F.greatest(lit(1), col("p_size") - 3)).alias("from_version"), ver(F.when(col("p_partkey") % 5 == 0, col("p_size") + 1).otherwise(col("p_size"))).alias("to_version"))
    return req, packages, notes, logs, adv


DELTA_SQL = """p AS (SELECT p_partkey AS req, p_size AS s, greatest(1, p_size - 3) AS a, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS b FROM part),
x AS (SELECT *, s - a AS in_notes, CASE WHEN req % 5 = 0 THEN 'none' WHEN s <= a THEN 'none' WHEN req % 3 = 0 THEN 'pointer' ELSE 'good' END AS target FROM p),
y AS (SELECT *, CASE WHEN target <> 'good' AND req % 2 = 0 AND b = s THEN 1 ELSE 0 END AS log FROM x),
z AS (SELECT *, in_notes - CASE WHEN target = 'pointer' AND log = 1 THEN 1 ELSE 0 END + log AS notes_found, (target IN ('good', 'pointer') OR log = 1) AS documented,
  in_notes - CASE WHEN req % 3 = 0 AND in_notes > 0 THEN 1 ELSE 0 END AS opts FROM y),
delta AS (SELECT req, CASE WHEN b = a THEN 'same' ELSE 'major' END AS kind, CAST(b - a AS BIGINT) AS majors, CAST(least(b, s + 2) - a AS BIGINT) AS releases_in_range, CAST(notes_found AS BIGINT) AS notes_found, documented AS target_documented,
  b > a AND NOT documented AS major_undocumented, CAST(CASE WHEN opts > 0 THEN opts + 2 ELSE 0 END + log AS BIGINT) AS breaking, CASE WHEN req % 4 = 0 THEN 1::BIGINT ELSE 0::BIGINT END AS advisories, CASE WHEN req % 4 = 0 AND s > 20 THEN 1::BIGINT ELSE 0::BIGINT END AS fixed FROM z)"""
A.VIEWS["delta"] = DELTA_SQL
DELTA = ["req", "kind", "majors", "releases_in_range", "notes_found", "target_documented", "major_undocumented", "breaking", "advisories", "fixed"]


@query("q10_migration_delta", f"WITH @delta SELECT {', '.join(DELTA)} FROM delta")
def q10(spark, d):
    return PR.migration_delta(*release_tables(spark, d), saver(spark, "q10")).select(*DELTA)


@query("q11_package_check", """
WITH n AS (SELECT DISTINCT lower(p_name) AS n FROM part), q AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE substr(p_name, 2) END AS q FROM part),
p AS (SELECT q, n, row_number() OVER (PARTITION BY q ORDER BY levenshtein(q, n), n) AS rk FROM q JOIN n ON levenshtein(q, n) BETWEEN 1 AND 2 AND abs(length(q) - length(n)) <= 3),
r AS (SELECT q.q AS name, string_agg(n, ';' ORDER BY rk) FILTER (rk <= 3) AS near FROM q LEFT JOIN p ON p.q = q.q GROUP BY q.q)
SELECT name, length(name) % 2 = 0 AS "exists", coalesce(near, '') AS did_you_mean, near IS NOT NULL AND (length(name) % 2 = 1 OR (length(name) % 4 = 0)) AS suspicious FROM r""")
def q11(spark, d):
    p = A.table(spark, d, "part")
    names = p.select(F.when(col("p_partkey") % 3 == 0, col("p_name")).otherwise(F.expr("substr(p_name, 2)")).alias("name")).distinct()
    known = names.filter("length(name) % 2 = 0")
    odd = F.length("name") % 4 == 0
    packages = known.select("name", F.when(odd, "0.0.1").otherwise("2.1.0").alias("latest"), F.when(~odd, "a/b").alias("repository"), lit("text").alias("description"), F.array(lit("1.0"), lit("2.0"), lit("3.0")).alias("versions"))
    r = PR.package_check(names, packages, p.select(F.lower("p_name").alias("name")))
    return r.select("name", "exists", F.array_join("did_you_mean", ";").alias("did_you_mean"), "suspicious")


@query("q12_manifest_delta", f"""
WITH @delta, r AS (SELECT p_partkey AS req, CASE WHEN p_partkey % 17 = 0 THEN 'bad_request' WHEN p_partkey % 19 = 0 THEN 'not_found' ELSE 'ok' END AS status FROM part) SELECT r.req, r.status, CASE WHEN status = 'ok' THEN kind END AS kind, CASE WHEN status = 'ok' THEN breaking END AS breaking FROM r LEFT JOIN delta d ON d.req = r.req""")
def q12(spark, d):
    req, packages, notes, logs, adv = release_tables(spark, d)
    req = req.withColumn("pkg_name", F.when(col("req") % 17 == 0, "../etc").otherwise(cat(lit("pkg-"), "req")))
    packages = packages.filter("pkg % 19 <> 0")
    return PR.manifest_delta(req, packages, notes, logs, adv, saver(spark, "q12")).select("req", "status", "kind", "breaking")


@query("q13_drop_alerts", """
WITH @runs, @usual, l AS (SELECT max(day) AS last FROM runs WHERE is_full) SELECT d.source, d.jobs, CAST(floor(d.usual + 0.5) AS BIGINT) AS usual FROM drops d, l WHERE d.day = l.last
  AND NOT EXISTS (SELECT 1 FROM runs r WHERE NOT r.is_full AND r.source = d.source AND r.day > l.last AND r.jobs >= d.usual * 0.5)""")
def q13(spark, d):
    return PJ.drop_alerts(A.runs(spark, d))


@query("q14_market_gaps", """
WITH @market, m AS (SELECT *, contains(title, 'ring') OR contains(title, 'bolt') AS closed, item % 4 <> 0 AS free FROM market)
SELECT count(*) AS items, CAST(sum(users) AS BIGINT) AS users, CAST(sum(users) FILTER (closed) AS BIGINT) AS users_barred, CAST(sum(users) FILTER (NOT closed) AS BIGINT) AS users_open, CAST(sum(users) FILTER (NOT closed AND free) AS BIGINT) AS users_open_free,
  count(*) FILTER (NOT closed AND users >= 100) AS open_with_demand, count(*) FILTER (NOT closed AND users >= 100 AND rating > 0 AND rating < 4.0 AND reviews >= 10) AS open_weak FROM m""")
def q14(spark, d):
    m = market(spark, d).withColumns({"name": lit(None).cast("string"), "pricing": F.when(col("item") % 4 == 0, "PAID").when(col("item") % 4 == 1, "FREE")})
    return PO.market_gaps(m, ["ring", "bolt"])


@query("q15_dashboard", """
WITH d AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, event_type AS actor, count(*) AS users FROM events GROUP BY 1, 2) SELECT date, actor, CASE WHEN date >= '2024-01-10' THEN users ELSE users + 1 END AS users FROM d""")
def q15(spark, d):
    e = A.table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("date"), col("event_type").alias("actor")).agg(F.count("*").alias("users"))
    return PO.history(e.withColumn("users", col("users") + 1), e.filter("date >= '2024-01-10'"))


@query("q15_rankings", """
WITH r AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, 'q' || (user_id % 20) AS query, event_id AS rank, event_type AS name, event_id % 40 = 0 AS own FROM events), l AS (SELECT max(date) AS last FROM r), q AS (SELECT DISTINCT query FROM r)
SELECT q.query, r.rank, coalesce(r.name, 'Not in top 100') AS name FROM q LEFT JOIN (SELECT r.* FROM r, l WHERE r.date = l.last AND own) r ON r.query = q.query""")
def q15b(spark, d):
    r = A.table(spark, d, "events").selectExpr("cast(to_date(ts) AS string) AS date", "concat('q', user_id % 20) AS query", "event_id AS rank", "event_type AS name", "event_id % 40 = 0 AS own")
    return PO.rankings(r, r.select("query").distinct(), col("own"))


@query("q15_index_figures", """
WITH @postings SELECT 'jobs: rows' AS metric, count(*) AS value FROM postings UNION ALL SELECT 'jobs: companies', count(DISTINCT source || ':' || company) FROM postings""")
def q15c(spark, d):
    return PO.index_figures(I.build_manifest(A.postings(spark, d)), "jobs")
