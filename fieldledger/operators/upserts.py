"""Upserts and table maintenance (M01-M09). Each takes the stored table and the new rows and returns the table after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contacts import merge_pages
from .joins import closed_cond


def _paired(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join on the keys with both rows as structs (`o` stored, `n` new)."""
    o = base.select(*keys, F.struct(*[c for c in base.columns if c not in keys]).alias("o"))
    n = new.select(*keys, F.struct(*[c for c in new.columns if c not in keys]).alias("n"))
    return o.join(n, keys, "full_outer")


def merge_snapshot(base: DataFrame, snap: DataFrame, now: Column, attrs: list[str], refresh: bool = True) -> DataFrame:
    """A new id starts now; a known id moves its last sighting and keeps its first. Attributes follow full lists only."""
    j = _paired(base, snap, ["id"])
    seen, known = F.col("n").isNotNull(), F.col("o").isNotNull()
    take = seen if refresh else (seen & ~known)
    cols = [F.when(take, F.col(f"n.{a}")).otherwise(F.col(f"o.{a}")).alias(a) for a in attrs]
    first = F.when(known, F.col("o.first_seen")).otherwise(now).alias("first_seen")
    last = F.when(seen, now).otherwise(F.col("o.last_seen")).alias("last_seen")
    return j.select("id", *cols, first, last)


def refresh_text(base: DataFrame, new: DataFrame) -> DataFrame:
    """Changed text replaces the stored text and leaves its chunk."""
    j = base.join(new.select("id", F.col("text").alias("_t")), "id", "left")
    changed = F.col("_t").isNotNull() & ~F.col("_t").eqNullSafe(F.col("text"))
    return j.withColumn("chunk", F.when(~changed, F.col("chunk"))).withColumn("text", F.when(changed, F.col("_t")).otherwise(F.col("text"))).drop("_t")


def merge_company(base: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """The count is replaced, a missing name keeps the old one, the empty streak grows or ends, the first date stays."""
    j = _paired(base, hits, ["ats", "slug"])
    seen, known = F.col("n").isNotNull(), F.col("o").isNotNull()
    streak = F.when(F.col("n.job_count") > 0, 0).otherwise(F.coalesce("o.empty_streak", F.lit(0)) + 1)
    return j.select(
        "ats",
        "slug",
        F.when(seen, F.col("n.job_count")).otherwise(F.col("o.job_count")).alias("job_count"),
        F.coalesce("n.name", "o.name").alias("name"),
        F.when(known, F.col("o.first_seen")).otherwise(now).alias("first_seen"),
        F.when(seen, now).otherwise(F.col("o.last_checked")).alias("last_checked"),
        F.when(seen, streak).otherwise(F.col("o.empty_streak")).alias("empty_streak"),
    )


def merge_domain(base: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """A known domain only moves its last DNS sighting."""
    j = _paired(base, hits, ["domain"])
    known, seen = F.col("o").isNotNull(), F.col("n").isNotNull()
    return j.select(
        "domain",
        F.when(known, F.col("o.source")).otherwise(F.col("n.source")).alias("source"),
        F.when(known, F.col("o.first_seen")).otherwise(now).alias("first_seen"),
        F.when(seen, now).otherwise(F.col("o.dns_seen")).alias("dns_seen"),
        F.coalesce("o.status", F.lit("new")).alias("status"),
    )


def apply_checks(stores: DataFrame, checks: DataFrame) -> DataFrame:
    """Outcome of a check. A refusal changes the count and the next date only, until the third in a row."""
    from .windows import FAILS_MANY

    c = checks.select("domain", F.struct("status", "refused", "shop_id", "record", "checked_at").alias("n"))
    j = stores.join(c, "domain", "left")
    done = F.col("n").isNotNull()
    failed = F.col("n.refused") | (F.col("n.status") == "error")
    j = j.withColumn("_fails", F.when(~done, F.col("fails")).when(failed, F.col("fails") + 1).otherwise(0))
    light = done & F.col("n.refused") & (F.col("_fails") < FAILS_MANY)
    status = F.when(~done | light, F.col("status")).when(F.col("n.refused"), "error").otherwise(F.col("n.status"))
    out = j.select(
        "domain",
        status.alias("status"),
        F.col("_fails").alias("fails"),
        F.coalesce(F.when(~light, F.col("n.shop_id")), F.col("shop_id")).alias("shop_id"),
        F.when(~done | light, F.col("record")).when(status == "live", F.col("n.record")).alias("record"),
        F.when(done & ~light, F.col("n.checked_at")).otherwise(F.col("checked_at")).alias("checked_at"),
        F.col("next_check").alias("_old"),
        done.alias("_done"),
        F.coalesce(F.col("n.refused"), F.lit(False)).alias("refused"),
        F.col("n.checked_at").alias("_now"),
        F.col("n.status").alias("_outcome"),
    )
    return _with_next(out)


def _with_next(out: DataFrame) -> DataFrame:
    from .windows import next_check

    kept = out.withColumnsRenamed({"status": "_status", "checked_at": "_checked"}).withColumnsRenamed({"_now": "checked_at", "_outcome": "status"})
    nxt = next_check(kept)
    return nxt.select(
        "domain",
        F.col("_status").alias("status"),
        "fails",
        "shop_id",
        "record",
        F.col("_checked").alias("checked_at"),
        F.when(F.col("_done"), F.col("next_check")).otherwise(F.col("_old")).alias("next_check"),
    )


def replace_day(df: DataFrame, path: str, day: str = "day") -> None:
    """Write a day's rows; a second run of the day replaces that day's partition and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def purge(jobs: DataFrame, fails: DataFrame, keys: list[str], now: Column) -> tuple[DataFrame, DataFrame]:
    """Rows to archive and rows to keep, split by one condition so that no row is in both or in neither."""
    j = jobs.join(fails, keys, "left")
    gone = F.coalesce(closed_cond(now), F.lit(False))
    return j.filter(gone).drop("since"), j.filter(~gone).drop("since")


def cache_split(requests: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Requests the cache answers (with their payload) and distinct requests still to compute."""
    hits = requests.join(cache.select(key, "payload"), key)
    todo = requests.join(cache.select(key), key, "left_anti").dropDuplicates([key])
    return hits, todo


def cache_put(cache: DataFrame, computed: DataFrame, hits: DataFrame, key: str = "key") -> DataFrame:
    """The cache after the run: new payloads in, serve counts raised."""
    served = hits.groupBy(key).agg(F.count("*").alias("_s"))
    kept = cache.join(served, key, "left").withColumn("serves", F.col("serves") + F.coalesce("_s", F.lit(0))).drop("_s")
    return kept.unionByName(computed.select(key, "payload", F.lit(0).cast("bigint").alias("serves")))


def cache_key(version: str, *cols: Column) -> Column:
    """A version bump makes every older entry unreachable."""
    return F.lower(F.concat_ws("|", F.lit(version), *cols))


# ---------------------------------------------------------------- M09

REFUSED = (429, 430, 403)
SHUT = (402, 423, 409)


def classify_check(row: DataFrame) -> DataFrame:
    """A store's status from its captured responses, in order of evidence.

    Expects one row per domain with `robots_status, meta_allowed, meta_status, meta_ok, home_allowed, home_status,
    home_password, contact_status, needs_contact, catalog_status` (null = not fetched).
    """
    refused = lambda c: F.coalesce(F.col(c).isin(*REFUSED), F.lit(False))
    late = refused("home_status") | (F.col("needs_contact") & refused("contact_status")) | refused("catalog_status")
    status = (
        F.when(refused("robots_status"), "error")
        .when(~F.col("meta_allowed"), "robots")
        .when(F.col("meta_status").isNull() | refused("meta_status"), "error")
        .when(F.col("meta_status").isin(*SHUT), "closed")
        .when((F.col("meta_status") != 200) | ~F.col("meta_ok"), "not_shopify")
        .when(refused("home_status"), "error")
        .when(F.col("home_password"), "password")
        .when(late, "error")
        .otherwise("live")
    )
    turned_away = refused("robots_status") | (F.col("meta_allowed") & refused("meta_status")) | (
        (F.col("meta_status") == 200) & F.col("meta_ok") & ((status == "error"))
    )
    return row.withColumn("status", status).withColumn("refused", F.coalesce(turned_away, F.lit(False)))


def page_of(home: Column, contact: Column) -> Column:
    """Contact details of the homepage, filled up from the contact page."""
    return merge_pages(home, contact)
