"""Store dataflows: Q07 search, Q08 build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.contacts import merge_pages, page_facts
from ..functions.predicates import store_filter
from ..functions.text import parse_date
from ..operators.aggregates import catalog_facts
from ..operators.filters import path_allowed
from ..operators.upserts import classify_check
from ..operators.windows import dedupe_alias
from ..session import saver
from ..sources import index as I
from ..sources.records import store_meta

# Sort orders of the store search; our agent's name in robots files (callers use their own).
SORTS = {
    "newest_found": lambda: F.col("first_seen"),
    "most_products": lambda: F.coalesce("product_count", F.lit(0)),
    "most_added": lambda: F.col("added_30d"),
    "newest_product": lambda: F.col("newest_product"),
}
AGENT = "listingsbot"
KINDS = ("robots", "meta", "home", "contact", "catalog")


def store_search(stores: DataFrame, q: dict, now: Column) -> DataFrame:
    """Q07: the filter, the chosen order, at most `max_results`; ties by domain."""
    key = SORTS[q.get("sort_by", "newest_found")]()
    return stores.filter(store_filter(q, now)).orderBy(key.desc_nulls_last(), "domain").limit(q["max_results"])


def newest_found() -> list[Column]:
    """The order in which store shards are published."""
    return [F.col("first_seen").desc_nulls_last(), F.col("domain")]


def store_search_index(spark: SparkSession, root: str, schema: StructType, q: dict, now: Column) -> I.Found:
    """Q07 over a published index (newest found first). That order ends early, in waves; every other order reads all
    shards the manifest leaves, once."""
    by = q.get("sort_by", "newest_found")
    mark = q.get("seen_after")
    waves = I.in_waves(spark, root, schema, seen_after=F.lit(mark).cast("timestamp_ntz") if mark else None, whole=by != "newest_found")
    order = newest_found() if by == "newest_found" else [SORTS[by]().desc_nulls_last(), F.col("domain")]
    return I.first_in_waves(spark, waves, lambda rows: rows.filter(store_filter(q, now)), [], order, q["max_results"], schema)


def store_build(responses: DataFrame, first_seen: DataFrame, now: Column) -> DataFrame:
    """Q08: captured responses (`domain, kind, status, body, final_url`; one per kind) to classified, merged, de-duplicated stores."""
    one = lambda kind: F.max_by(F.struct("status", "body", "final_url"), F.when(F.col("kind") == kind, F.lit(1))).alias(kind)
    s = responses.groupBy("domain").agg(*[one(k) for k in KINDS])
    meta = store_meta(responses.filter("kind = 'meta' AND status = 200").select("domain", "body"))
    s = s.join(meta, "domain", "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
    rules = F.when(F.col("robots.status") == 200, F.col("robots.body")).otherwise("")
    allowed = lambda path: path_allowed(rules, F.lit(path), AGENT)
    shown = lambda r: (F.col(f"{r}.status") == 200) | F.coalesce(F.col(f"{r}.final_url").contains("/password"), F.lit(False))
    s = s.withColumns({"ok_meta": allowed("/meta.json"), "ok_home": allowed("/"), "ok_contact": allowed("/pages/contact"), "ok_catalog": allowed("/products.json")})
    s = s.withColumn("p1", F.when(F.col("ok_home") & shown("home"), page_facts("home.body", F.col("home.final_url"))))
    needs = F.col("p1").isNotNull() & ((F.size("p1.emails") == 0) | (F.size("p1.phones") == 0)) & F.col("ok_contact")
    s = s.withColumn("needs", F.coalesce(needs, F.lit(False)))
    s = s.withColumn("p2", F.when(F.col("needs") & (F.col("contact.status") == 200), page_facts("contact.body", F.col("contact.final_url"))))
    s = s.withColumn("page", merge_pages(F.col("p1"), F.col("p2")))
    s = classify_check(
        s.withColumns(
            {
                "robots_status": F.col("robots.status"), "meta_allowed": F.col("ok_meta"), "meta_status": F.col("meta.status"), "meta_ok": F.col("valid"), "home_allowed": F.col("ok_home"),
                "home_status": F.when(F.col("ok_home"), F.col("home.status")), "home_password": F.coalesce(F.col("p1.password_protected"), F.lit(False)), "needs_contact": F.col("needs"),
                "contact_status": F.col("contact.status"), "catalog_status": F.when(F.col("ok_catalog"), F.col("catalog.status")),
            }
        )
    )
    schema = "products array<struct<product_type:string,vendor:string,published_at:string,variants:array<struct<price:string>>>>"
    goods = responses.filter("kind = 'catalog' AND status = 200").select("domain", F.explode(F.from_json("body", schema)["products"]).alias("g"))
    goods = goods.select("domain", "g.product_type", "g.vendor", parse_date("g.published_at").cast("timestamp_ntz").alias("published"), "g.variants")
    goods = saver(goods.sparkSession, "store_build")(goods, "goods")  # several figures read the products; they are parsed once
    live = s.filter("status = 'live'").join(catalog_facts(goods, ["domain"], now), "domain", "left").join(first_seen, "domain", "left")
    live = live.withColumns({"emails": F.coalesce("page.emails", F.array().cast("array<string>")), "phones": F.coalesce("page.phones", F.array().cast("array<string>")), "apps": F.coalesce("page.apps", F.array().cast("array<string>")), "language": F.col("page.language"), "theme": F.col("page.theme"), "socials": F.col("page.socials")})
    keep = ["domain", "name", "myshopify_domain", "country", "currency", "ships_to", "product_count", "language", "theme", "emails", "phones", "apps", "socials", "price_min", "price_median", "price_max", "product_types", "vendors", "newest_product", "added_30d", "first_seen"]
    return dedupe_alias(live.select(*keep), "myshopify_domain", "domain", [F.col("first_seen").desc(), F.col("domain")])
