"""Sources and sinks S01-S17: tables are written in the format, read back, and compared with themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators.order import newest_first
from ..session import shared_dir
from ..sources import files as S
from ..sources import index as I
from .registry import query

ROW = "id string, source string, company string, title string, location string, country string, posted_at timestamp_ntz, first_seen timestamp_ntz"
COLS = ["id", "source", "company", "title", "location", "country", "posted_at", "first_seen"]
ROWS = 1500  # rows per shard of the small tables here; I.SHARD_ROWS is the index's own figure



_INDEXES: dict[tuple, tuple] = {}


def published(spark, d, name, make, order=None, rows=ROWS, posted="posted_at"):
    """(root, schema) of an index of the given tables. A session publishes it once; searches then read it, as they would
    read an index that a nightly run has left."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _INDEXES:
        df = make(spark, d)
        _INDEXES[key] = I.publish(spark, df, shared_dir(spark, "index"), "run1", rows, order, posted=posted), df.schema
    return _INDEXES[key]


def posting_rows(spark, d):
    return A.postings(spark, d).select(*COLS)


def newest_seen():
    return [F.col("first_seen").desc(), F.col("id")]


SHARDS_SQL = f"""shards AS (SELECT *, (row_number() OVER (ORDER BY posted_at DESC NULLS LAST, id) - 1) // {ROWS} AS shard FROM postings),
stats AS (SELECT shard, count(*) AS count, max(posted_at) AS newest, min(posted_at) AS oldest, count(*) FILTER (posted_at IS NULL) AS undated, max(first_seen) AS newest_first_seen FROM shards GROUP BY shard)"""
A.VIEWS["shards"] = SHARDS_SQL


@query("s01_read_shards", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def s01(spark, d):
    path = shared_dir(spark, "s01")
    o = A.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    # Lines with a blank line behind each, one half gzip and one half plain.
    lines = o.select("o_orderkey", F.concat(F.to_json(F.struct("*")), F.lit("\n")).alias("value"))
    lines.filter("o_orderkey % 2 = 0").select("value").write.option("compression", "gzip").text(path + "/a")
    lines.filter("o_orderkey % 2 = 1").select("value").write.text(path + "/b")
    return I.read_shards(spark, [path + "/a", path + "/b"], "o_orderkey bigint, o_orderpriority string, o_totalprice double")


@query("s02_read_index", """
WITH @postings, @shards SELECT id FROM shards JOIN stats USING (shard) WHERE NOT (undated = 0 AND stats.newest < TIMESTAMP '2000-06-01') AND coalesce(posted_at, first_seen) >= TIMESTAMP '2000-06-01'""")
def s02(spark, d):
    root, _ = published(spark, d, "postings", posting_rows)
    cut = A.ts("2000-06-01 00:00:00")
    return I.read_index(spark, f"{root}/shards", ROW, I.read_manifest(spark, root), cutoff=cut).filter(F.coalesce("posted_at", "first_seen") >= cut).select("id")


@query("s03_read_store_index", """
WITH @postings, o AS (SELECT *, (row_number() OVER (ORDER BY first_seen DESC, id) - 1) // 1500 AS shard FROM postings), st AS (SELECT shard, max(first_seen) AS mx FROM o GROUP BY shard)
SELECT id FROM o JOIN st USING (shard) WHERE mx > TIMESTAMP '2000-06-01'""")
def s03(spark, d):
    root, _ = published(spark, d, "postings seen", posting_rows, newest_seen())
    return I.read_store_index(spark, f"{root}/shards", ROW, I.read_manifest(spark, root), A.ts("2000-06-01 00:00:00")).select("id")


@query("s04_write_shards", "WITH @postings, @shards SELECT id, CAST(shard AS INTEGER) AS shard FROM shards")
def s04(spark, d):
    path = shared_dir(spark, "index") + "/shards"
    I.write_shards(posting_rows(spark, d), path, rows=ROWS)
    return I.read_shards(spark, path, ROW + ", shard int").select("id", "shard")


@query("s05_shard_stats", """
WITH @postings, @shards SELECT CAST(shard AS INTEGER) AS shard, count, CAST(newest AS VARCHAR) AS newest, CAST(oldest AS VARCHAR) AS oldest, undated, CAST(newest_first_seen AS VARCHAR) AS newest_first_seen FROM stats""")
def s05(spark, d):
    text = lambda c: F.col(c).cast("string").alias(c)
    return I.shard_stats(I.with_shards(A.postings(spark, d), rows=ROWS)).select("shard", "count", text("newest"), text("oldest"), "undated", text("newest_first_seen"))


@query("s06_build_manifest", """
WITH @postings, t AS (SELECT source, count(*) AS n FROM postings GROUP BY source)
SELECT (SELECT count(*) FROM postings) AS total, (SELECT count(DISTINCT source || ':' || company) FROM postings) AS companies, string_agg(source || '=' || n, ';' ORDER BY source) AS by_source FROM t""")
def s06(spark, d):
    m = I.build_manifest(A.postings(spark, d))
    flat = F.array_join(F.transform(F.map_entries("by_source"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return m.select("total", "companies", flat.alias("by_source"))


@query("s07_append_chunks", """
WITH n AS (SELECT count(*) AS n FROM documents WHERE doc_id % 5 <> 0), c AS (SELECT unnest(range(0, (n + 39) // 40)) AS i, n FROM n)
SELECT 'desc-20240101-' || lpad(CAST(i AS VARCHAR), greatest(3, length(CAST(i AS VARCHAR)))::INTEGER, '0') AS chunk, least(40, n - i * 40) AS texts, least(40, n - i * 40) AS ids FROM c""")
def s07(spark, d):
    doc = A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.when(F.col("doc_id") % 5 == 0, "desc-20230101-000").alias("chunk"))
    path = shared_dir(spark, "chunks")
    I.append_chunks(doc, "20240101", 40).write.mode("append").partitionBy("chunk").parquet(path)
    return spark.read.parquet(path).groupBy("chunk").agg(F.count("text").alias("texts"), F.countDistinct("id").alias("ids"))


@query("s08_publish", """
WITH @postings SELECT 'run2' AS stamp, id, false AS first_run_kept FROM postings WHERE posted_at IS NOT NULL""")
def s08(spark, d):
    base = shared_dir(spark, "publish")
    p = A.postings(spark, d).select(*COLS)
    I.publish(spark, p, base, "run1", ROWS)
    root = I.publish(spark, p.filter("posted_at IS NOT NULL"), base, "run2", ROWS)
    kept = I.path_exists(spark, f"{base}/run1")
    return I.read_shards(spark, f"{root}/shards", ROW).select(F.lit(I.current(spark, base)).alias("stamp"), "id", F.lit(kept).alias("first_run_kept"))


@query("s08_drop_unused_chunks", "SELECT doc_id AS id, CASE WHEN doc_id % 10 < 7 THEN 'c' || (doc_id % 10) END AS chunk FROM documents")
def s08b(spark, d):
    doc = A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("c"), F.col("doc_id") % 10).alias("chunk"))
    return I.drop_unused_chunks(doc, doc.filter("id % 10 < 7").select("chunk")).select("id", "chunk")


@query("s09_read_registry", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def s09(spark, d):
    from pyspark.sql import types as T

    path = shared_dir(spark, "registry")
    n = A.table(spark, d, "nation")
    # A registry is one JSON array in one file; nations are a fixed small table.
    arr = n.agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))))).alias("value"))
    arr.select(F.regexp_replace("value", r"\},\{", "},\n{").alias("value")).coalesce(1).write.text(path)
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])
    return S.read_registry(spark, path, schema).unionByName(S.read_registry(spark, path + "-missing", schema))


@query("s10_read_csv_strict", """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'NA' WHEN c_custkey % 5 = 1 THEN NULL ELSE c_mktsegment END AS country, c_acctbal FROM customer""")
def s10(spark, d):
    path = shared_dir(spark, "csv")
    c = A.table(spark, d, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 5 = 0 THEN 'NA' WHEN c_custkey % 5 = 1 THEN NULL ELSE c_mktsegment END AS country", "c_acctbal")
    c.write.option("header", True).csv(path)
    return S.read_csv_strict(spark, path, "c_custkey bigint, country string, c_acctbal double")


@query("s11_write_daily", """
WITH e AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, event_type AS actor, count(*) AS users FROM events GROUP BY 1, 2)
SELECT date, actor, CASE WHEN date = '2024-01-05' THEN users + 1 ELSE users END AS users FROM e UNION ALL SELECT date, 'extra-' || actor, users FROM e WHERE date = '2024-01-06'""")
def s11(spark, d):
    path = shared_dir(spark, "daily")
    e = A.table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("date"), F.col("event_type").alias("actor")).agg(F.count("*").alias("users"))
    S.write_daily(e, path)
    S.write_daily(e.filter("date = '2024-01-05'").withColumn("users", F.col("users") + 1), path)
    more = e.filter("date = '2024-01-06'")
    more = more.unionByName(more.withColumn("actor", F.concat(F.lit("extra-"), "actor")))
    stored = spark.read.parquet(path).withColumn("date", F.col("date").cast("string"))
    S.append_absent(more, stored, ["date", "actor"]).write.mode("append").partitionBy("date").parquet(path)
    return spark.read.parquet(path).select(F.col("date").cast("string").alias("date"), "actor", "users")


@query("s12_domains", """
SELECT c_custkey, 'shop' || c_custkey || '.example' || CASE WHEN c_custkey % 2 = 0 THEN '.com' ELSE '.co.uk' END AS domain FROM customer WHERE c_custkey % 7 NOT IN (3, 4)""")
def s12(spark, d):
    c = A.table(spark, d, "customer")
    bad = F.when(F.col("c_custkey") % 7 == 3, "x.myshopify.com").when(F.col("c_custkey") % 7 == 4, "not a domain")
    ranked = c.filter("c_custkey % 2 = 0").select("c_custkey", F.concat("c_custkey", F.lit(","), F.coalesce(bad, F.concat(F.lit("SHOP"), "c_custkey", F.lit(".Example.com\r")))).alias("value"))
    rev = F.when(F.col("c_custkey") % 7 == 3, "com.myshopify.x").when(F.col("c_custkey") % 7 == 4, "bad label").otherwise(F.concat(F.lit("uk.co.example.shop"), "c_custkey"))
    reversed_ = c.filter("c_custkey % 2 = 1").select("c_custkey", F.concat("c_custkey", F.lit("\t"), rev, F.lit("\t4")).alias("value"))
    return S.domains(ranked, "ranked").unionByName(S.domains(reversed_, "reversed")).select("c_custkey", "domain")


@query("s13_resume_scan", """
SELECT event_type AS source, event_id AS position FROM events WHERE (event_type = 'click' AND event_id > 3000 AND event_id <= 7000) OR (event_type NOT IN ('click', 'view') AND event_id > 0 AND event_id <= 4000)""")
def s13(spark, d):
    lines = A.table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("event_id").alias("position"))
    saved = lines.select("source").distinct().select("source", F.when(F.col("source") == "click", 3000).otherwise(0).alias("position"), (F.col("source") == "view").alias("done"))
    saved = saved.filter("source IN ('click', 'view')")
    return S.resume_scan(lines, saved, budget=4000)


@query("s13_scan_progress", """
SELECT event_type AS source, max(event_id) FILTER (event_id <= 9990) AS position, max(event_id) <= 9990 AS done FROM events GROUP BY event_type""")
def s13b(spark, d):
    lines = A.table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("event_id").alias("position"))
    return S.scan_progress(lines.filter("position <= 9990"), lines)


@query("s14_harvest", """
SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 'greenhouse' ELSE 'ashby' END AS system, 'acme ' || (c_custkey % 300) AS slug FROM customer WHERE c_custkey % 5 <> 0""")
def s14(spark, d):
    k = F.col("c_custkey")
    host = F.when(k % 2 == 0, "https://boards.greenhouse.io/").otherwise("https://jobs.ashbyhq.com/")
    slug = F.when(k % 5 == 0, F.when(k % 3 == 0, "embed").otherwise("12345")).otherwise(F.concat(F.lit("ACME%20"), k % 300))
    line = F.to_json(F.struct(F.concat(host, slug, F.lit("/jobs/1?x")).alias("url"), F.lit("200").alias("status")))
    return S.harvest(A.table(spark, d, "customer").select(line.alias("value")))


@query("s14_harvest_sites", """
SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 't' || (c_custkey % 90) || '.wd5.myworkdayjobs.com' ELSE 'wd1.myworkdaysite.com' END AS host, 't' || (c_custkey % 90) AS tenant, 'Site' || (c_custkey % 4) AS site FROM customer WHERE NOT (c_custkey % 2 = 0 AND c_custkey % 9 = 0)""")
def s14b(spark, d):
    k = F.col("c_custkey")
    own = F.concat(F.lit("https://T"), k % 90, F.lit(".wd5.myworkdayjobs.com/en-US/"), F.when(k % 9 == 0, "login").otherwise(F.concat(F.lit("Site"), k % 4)), F.lit("/job/x"))
    shared = F.concat(F.lit("https://wd1.myworkdaysite.com/recruiting/t"), k % 90, F.lit("/Site"), k % 4)
    return S.harvest_sites(A.table(spark, d, "customer").select(F.to_json(F.struct(F.when(k % 2 == 0, own).otherwise(shared).alias("url"))).alias("value")))


@query("s15_robots_sites", """
SELECT s_suppkey, 'Ext' || s_suppkey AS site FROM supplier UNION SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def s15(spark, d):
    s, n = A.table(spark, d, "supplier"), A.table(spark, d, "nation")
    j = s.join(n, s.s_nationkey == n.n_nationkey)
    text = F.concat(F.lit("User-agent: *\nAllow: /wday/\nAllow: /Ext"), "s_suppkey", F.lit("/\nSitemap: https://x.wd1.myworkdayjobs.com/"), "n_name", F.lit("/siteMap.xml\nDisallow: /Hidden/\nallow: /Ext"), "s_suppkey", F.lit("/"))
    return S.robots_sites(j.select("s_suppkey", text.alias("robots")))


@query("s16_deliver", """
WITH @postings, m AS (SELECT count(*) AS n FROM postings WHERE remote) SELECT n AS matched, least(n, 250) AS delivered, CASE WHEN n >= 250 THEN 'maxJobs' ELSE 'completed' END AS stopped_because, (SELECT max(id) FROM (SELECT id FROM postings WHERE remote ORDER BY posted_at DESC NULLS LAST, id LIMIT 250)) AS last_id FROM m""")
def s16(spark, d):
    p = A.postings(spark, d).filter("remote")
    return S.delivery_summary(p, 250).withColumn("last_id", S.deliver(p, newest_first(), 250).agg(F.max("id")).scalar())


@query("s17_union_pages", """
SELECT event_id % 700 AS resource, max(event_id) // 1000 AS page, max(event_id) AS event_id FROM events GROUP BY 1""")
def s17(spark, d):
    # The last page that holds a resource wins; within a page a resource stands once here.
    e = A.table(spark, d, "events").groupBy((F.col("event_id") % 700).alias("resource"), F.floor(F.col("event_id") / 1000).alias("page")).agg(F.max("event_id").alias("event_id"))
    return S.union_pages(e, "resource", "page")
