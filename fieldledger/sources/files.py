"""Registries, CSV tables, domain lists, crawl indexes, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.contacts import percent_decoded
from ..functions.text import trimmed
from ..operators.groups import first_per_group
from .index import path_exists

# Hosts that are no stores, address patterns of hosted boards and career sites, path parts that are no company or site.
OWN_HOSTS = r"(^|\.)(shopify|myshopify|shopifycdn|shopifycloud)\.com$"
VALID_DOMAIN = r"^[a-z0-9-]+(\.[a-z0-9-]+)+$"
DOMAIN_MAX = 253
BOARD_PATTERNS = {
    "greenhouse": r"boards\.greenhouse\.io/([^/?#]+)",
    "ashby": r"jobs\.ashbyhq\.com/([^/?#]+)",
}
BOARD_NOISE = [
    "embed", "blog", "about", "pricing", "careers", "jobs", "search", "login", "api", "docs", "www", "assets", "static", "images",
    "privacy", "terms", "legal", "home", "index",
]
SITE_JOBS = r"(?i)^https?://([a-z0-9-]+)\.(wd\d+)\.myworkdayjobs\.com(?::\d+)?/(?:[a-z]{2}(?:-[a-z]{2})?/)?([^/?#]+)"
SITE_SHARED = r"(?i)^https?://(wd\d+)\.myworkdaysite\.com(?::\d+)?/(?:[a-z]{2}(?:-[a-z]{2})?/)?recruiting/([^/?#]+)/([^/?#]+)"
SITE_NOISE = ["robots.txt", "llms.txt", "login", "wday", "favicon.ico", "sitemap.xml"]
ROBOTS_SITE = r"(?im)^(?:Allow:\s*/([^/\s]+)/|Sitemap:\s*https?://[^/]+/([^/\s]+)/siteMap\.xml)"


def read_registry(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON array spread over lines; a missing file is an empty table."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_csv_strict(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Only an empty field is null; "NA" is text."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)


def write_daily(df: DataFrame, path: str, day: str = "date") -> None:
    """A day's rows replace that day's rows."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def append_absent(df: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows not recorded yet."""
    return df.join(stored.select(*keys), keys, "left_anti")


def domain(line: Column, kind: str) -> Column:
    """Domain of a ranked list line ("rank,domain") or of one with reversed labels; null when it is none of a store."""
    raw = F.get(F.split(line, ","), 1) if kind == "ranked" else F.array_join(F.reverse(F.split(F.get(F.split(line, "\t"), 1), r"\.")), ".")
    d = F.regexp_replace(F.lower(trimmed(raw)), r"\.$", "")
    return F.when(d.rlike(VALID_DOMAIN) & (F.length(d) <= DOMAIN_MAX) & ~d.rlike(OWN_HOSTS), d)


def domains(df: DataFrame, kind: str, line: str = "value") -> DataFrame:
    return df.withColumn("domain", domain(F.col(line), kind)).filter(F.col("domain").isNotNull())


def resume_scan(lines: DataFrame, progress: DataFrame, source: str = "source", position: str = "position", budget: int | None = None) -> DataFrame:
    """Lines after each source's saved position, `budget` positions at most; finished sources give none."""
    p = progress.select(source, F.col("position").alias("_at"), F.col("done").alias("_done"))
    j = lines.join(p, source, "left").filter(~F.coalesce("_done", F.lit(False)) & (F.col(position) > F.coalesce("_at", F.lit(0))))
    if budget is not None:
        j = j.filter(F.col(position) <= F.coalesce("_at", F.lit(0)) + budget)
    return j.drop("_at", "_done")


def scan_progress(read: DataFrame, lines: DataFrame, source: str = "source", position: str = "position") -> DataFrame:
    """Positions to save; a source is done when its last line was read."""
    got = read.groupBy(source).agg(F.max(position).alias("position"))
    last = lines.groupBy(source).agg(F.max(position).alias("_last"))
    return got.join(last, source).select(source, "position", (F.col("position") >= F.col("_last")).alias("done"))


def harvest(lines: DataFrame, line: str = "value") -> DataFrame:
    """Crawl-index lines to distinct (system, slug) candidates."""
    url = F.from_json(F.col(line), "url string")["url"]
    hits = F.array(*[F.struct(F.lit(s).alias("system"), F.regexp_extract(url, p, 1).alias("raw")) for s, p in BOARD_PATTERNS.items()])
    flat = lines.select(F.explode(hits).alias("h")).filter("h.raw <> ''")
    slug = F.lower(percent_decoded(F.col("h.raw")))
    cand = flat.select("h.system", slug.alias("slug"))
    good = F.length("slug").between(2, 63) & ~F.col("slug").rlike(r"^\d+$") & ~F.col("slug").isin(*BOARD_NOISE)
    return cand.filter(good).distinct()


def harvest_sites(lines: DataFrame, line: str = "value") -> DataFrame:
    """Crawl-index lines to distinct career sites (host, tenant, site)."""
    url = F.from_json(F.col(line), "url string")["url"]
    own = [F.regexp_extract(url, SITE_JOBS, i) for i in (1, 2, 3)]
    shared = [F.regexp_extract(url, SITE_SHARED, i) for i in (1, 2, 3)]
    low = F.lower
    row = F.when(
        own[0] != "",
        F.struct(low(F.concat_ws(".", own[0], own[1], F.lit("myworkdayjobs.com"))).alias("host"), low(own[0]).alias("tenant"), percent_decoded(own[2]).alias("site")),
    ).when(
        shared[0] != "",
        F.struct(low(F.concat_ws(".", shared[0], F.lit("myworkdaysite.com"))).alias("host"), shared[1].alias("tenant"), percent_decoded(shared[2]).alias("site")),
    )
    out = lines.select(row.alias("r")).filter("r IS NOT NULL").select("r.*")
    return out.filter(~F.lower("site").isin(*SITE_NOISE)).distinct()


def robots_sites(df: DataFrame, text: str = "robots") -> DataFrame:
    """Career sites a robots.txt names."""
    named = F.regexp_extract_all(F.col(text), F.lit(ROBOTS_SITE), F.lit(0))
    site = F.transform(named, lambda m: F.coalesce(*[F.nullif(F.regexp_extract(m, ROBOTS_SITE, i), F.lit("")) for i in (1, 2)]))
    out = df.select(*[c for c in df.columns if c != text], F.explode(site).alias("site"))
    return out.filter(~F.lower("site").isin(*SITE_NOISE)).distinct()


def deliver(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """At most `n` rows."""
    return df.orderBy(*order).limit(n)


def delivery_summary(df: DataFrame, n: int) -> DataFrame:
    """Rows matched, rows delivered and why it stopped."""
    m = df.agg(F.count("*").alias("matched"))
    return m.select("matched", F.least("matched", F.lit(n)).alias("delivered"), F.when(F.col("matched") >= n, "maxJobs").otherwise("completed").alias("stopped_because"))


def union_pages(pages: DataFrame, key: str, page: str) -> DataFrame:
    """Rows of offset pages, the last page that has a key wins."""
    return first_per_group(pages, [key], [F.col(page).desc()])
