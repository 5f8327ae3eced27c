"""Job dataflows: Q01 search, Q02 hiring companies, Q03 nightly lifecycle, Q04 publish, Q13 drop alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.predicates import job_filter
from ..functions.text import career_site_url, display_name
from ..operators import aggregates as G
from ..operators import filters as O
from ..operators import joins as J
from ..operators import windows as S
from ..operators.groups import struct_list, top_per_group
from ..operators.order import newest_first, rank_companies
from ..operators.upserts import merge_snapshot, purge
from ..session import saver
from ..sources import index as I

KEYS = ["source", "company"]


def job_search(postings: DataFrame, q: dict, now: Column, texts: DataFrame | None = None) -> DataFrame:
    """Q01: filter, per-company cap, newest first, then text for the delivered rows only."""
    hits = postings.filter(job_filter(q, now))
    if q.get("per_company"):
        hits = top_per_group(hits, KEYS, newest_first(), q["per_company"])
    top = hits.orderBy(*newest_first()).limit(q["max_jobs"])
    return J.attach_text(top, texts, q["max_jobs"]) if texts is not None else top


def job_search_index(spark: SparkSession, root: str, schema: StructType, q: dict, now: Column) -> I.Found:
    """Q01 over a published index: shards newest first, in waves, until `max_jobs` rows are found. The manifest rules out
    shards by posting date and by first sight."""
    within, mark = q.get("posted_within"), q.get("seen_after")
    waves = I.in_waves(spark, root, schema, now - F.make_dt_interval(F.lit(within)) if within else None, F.lit(mark).cast("timestamp_ntz") if mark else None)
    caps = [(KEYS, q["per_company"])] if q.get("per_company") else []
    return I.first_in_waves(spark, waves, lambda rows: rows.filter(job_filter(q, now)), caps, newest_first(), q["max_jobs"], schema)


# ---------------------------------------------------------------- Q02

_FACETS = ("department", "location", "country", "currency")


def _facets(matched: DataFrame) -> DataFrame:
    """Top departments and places, countries and pay of each company from one aggregate.

    Each row gives its four values; values are counted per company before anything is ranked or collected.
    """
    paid = F.col("pay_max").isNotNull()
    value = {f: F.trim(F.col(f)) for f in _FACETS} | {"currency": F.when(paid, F.col("currency"))}
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), v.alias("value")) for f, v in value.items()]))
    flat = matched.select(*KEYS, F.coalesce("pay_min", "pay_max").alias("lo"), F.col("pay_max").alias("hi"), each.alias("x")).select(*KEYS, "lo", "hi", "x.*")
    counts = flat.filter("value <> ''").groupBy(*KEYS, "facet", "value").agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    few = top_per_group(counts.filter("facet IN ('department', 'location')"), [*KEYS, "facet"], [F.col("n").desc(), F.col("value")], G.TOP, "rk")
    tops = few.groupBy(*KEYS).agg(
        *[F.sort_array(F.collect_list(F.when(F.col("facet") == f, F.struct("rk", F.struct(F.col("value").alias("name"), F.col("n").alias("jobs")).alias("s"))))).alias(f) for f in ("department", "location")]
    )
    tops = tops.select(*KEYS, *[F.transform(f, lambda x: x["s"]).alias(f"top_{f}s") for f in ("department", "location")])
    cur = F.col("facet") == "currency"
    best = F.min_by(F.struct("value", "lo", "hi"), F.when(cur, F.struct(-F.col("n"), "value")))
    # Countries and currencies are short fixed lists.
    rest = counts.filter("facet IN ('country', 'currency')").groupBy(*KEYS).agg(
        F.sort_array(F.collect_list(F.when(F.col("facet") == "country", F.col("value")))).alias("countries"), best.alias("b"), F.coalesce(F.sum(F.when(cur, F.col("n"))), F.lit(0)).alias("matching_with_pay")
    )
    rest = rest.select(*KEYS, "countries", F.col("b.lo").alias("pay_low"), F.col("b.hi").alias("pay_high"), F.col("b.value").alias("pay_currency"), "matching_with_pay")
    return tops.join(rest, KEYS, "full_outer")


def _samples(matched: DataFrame, k: int = 5) -> DataFrame:
    few = top_per_group(matched.select(*KEYS, "id", "company_name", "title", "location", "department", "posted_at", "url"), KEYS, newest_first(), k, "rk")
    s = struct_list(few, KEYS, "rk", [F.col(c) for c in ("title", "location", "department", "posted_at", "url", "company_name")], "sample_jobs")
    newest = F.get("sample_jobs", 0)
    return s.select(
        *KEYS, "sample_jobs", F.array_join(F.array_distinct(F.transform("sample_jobs", lambda x: x["title"])), "; ").alias("sample_titles"),
        display_name(newest["company_name"], "company").alias("company_name"), career_site_url("source", "company", newest["url"]).alias("career_site"),
    )


def companies_hiring(postings: DataFrame, q: dict, now: Column) -> DataFrame:
    """Q02: one row per company with matching postings.

    Stale rows leave first. Then three passes, each cut down before its shuffle: day cells (all counts), facets of the
    matching rows, and the newest matching rows.
    """
    fresh = O.drop_stale(postings, now, q.get("max_age_days", 365))
    match = job_filter({**q, "seen_after": None}, now)
    fresh = fresh.withColumn("_m", match)
    matched = fresh.filter("_m")
    mark = F.lit(q["seen_after"]).cast("timestamp_ntz") if q.get("seen_after") else None
    rows = G.company_rollup(fresh, KEYS, F.col("_m"), mark).join(G.new_counts(fresh, KEYS, now, F.col("_m")), KEYS)
    rows = rows.withColumn("growth", G.growth(F.col("new30"), F.col("known30"), F.col("total"))).drop("counted")
    rows = O.having(rows, q.get("min_matching", 1), q.get("min_total"), q.get("max_total"), mark is not None)
    rows = rows.join(_facets(matched), KEYS, "left").join(_samples(matched), KEYS)
    return rank_companies(rows, q.get("sort_by", "matching"), q["max_companies"])


# ---------------------------------------------------------------- Q03

def nightly(base: DataFrame, snapshot: DataFrame, fetches: DataFrame, runs: DataFrame, run_at: Column, prev_run: Column, attrs: list[str], save=lambda df, name: df) -> dict[str, DataFrame]:
    """Q03: upsert, load status, counts, outage guard, closure. `save` writes a table and gives it back (it is read several times)."""
    jobs = save(merge_snapshot(base, snapshot, run_at, attrs), "jobs")
    loaded = G.load_status(fetches, KEYS).withColumnRenamed("ok", "loaded")
    counts = G.run_counts(jobs, J.last_ok(runs, KEYS, run_at), KEYS, run_at, prev_run)
    today = loaded.join(counts, KEYS, "left").fillna(0, ["open", "opened", "expected", "closed"])
    today = S.guard_today(today, runs, KEYS)
    today = today.select(
        *KEYS, F.to_date(run_at).alias("day"), run_at.alias("run_at"), "ok", "open", "opened", F.when(F.col("ok"), F.col("closed")).alias("closed"), "expected", "note", F.when(~F.col("loaded"), F.col("error")).alias("error")
    )
    today = save(today, "company_runs")
    all_runs = runs.select(*KEYS, "day", "run_at", "ok").unionByName(today.select(*KEYS, "day", "run_at", "ok"))
    fails = J.failing(all_runs, KEYS)
    archive, kept = purge(jobs, fails, KEYS, run_at)
    return {"jobs": kept, "archive": archive, "company_runs": today, "summary": G.run_summary(today), "live": J.live_rows(kept, fails, KEYS, run_at)}


# ---------------------------------------------------------------- Q04

def enrich(live: DataFrame, systems: DataFrame) -> DataFrame:
    """Q04: pay from text where none was published as data; clinical tags for the health systems' postings."""
    from ..functions.clinical import with_clinical_tags
    from ..functions.pay import with_pay

    text = F.when(F.coalesce(F.col("pay_source"), F.lit("")) != "structured", F.col("description"))
    p = with_pay(live.withColumn("_text", text), "_text", "country", "_pay")
    for have, read in {"pay_min": "min", "pay_max": "max", "currency": "currency", "pay_period": "period", "annual_min": "annual_min", "annual_max": "annual_max"}.items():
        p = p.withColumn(have, F.coalesce(F.when(F.col("pay_source") == "structured", F.col(have)), F.col(f"_pay.{read}")))
    p = p.withColumn("pay_source", F.coalesce(F.when(F.col("pay_source") == "structured", F.col("pay_source")), F.col("_pay.source"))).drop("_pay", "_text")
    key = F.lower(F.concat_ws(":", "source", "company"))
    own = J.owners(systems, "system", "keys").select(F.col("key").alias("_key"), F.col("owner").alias("system"))
    p = p.withColumn("_key", key).join(own, "_key", "left").drop("_key")
    # Only owned rows get a title and a text to tag; the rest cost a null test.
    owned = F.col("system").isNotNull()
    tagged = with_clinical_tags(p.withColumns({f"_{c}": F.when(owned, F.col(c)) for c in ("title", "department", "employment_type", "description")}), "_title", "_department", "_employment_type", "_description")
    tags = ["role_family", "role_type", "specialties", "shift", "shift_hours", "employment", "sign_on_bonus", "licenses", "sign_on_bonus_amount"]
    tagged = tagged.withColumn("clinical", F.when(owned, F.struct(*tags)))
    return tagged.drop(*tags, "_title", "_department", "_employment_type", "_description")


def publish_night(spark: SparkSession, jobs: DataFrame, fails: DataFrame, systems: DataFrame, run_at: Column, base: str, stamp: str, rows: int = I.SHARD_ROWS, texts: int = I.CHUNK_ROWS) -> tuple[str, DataFrame]:
    """Q04: the night's index, whole; gives its folder and the jobs with their chunks.

    In this order, so that a reader or a run cut short always finds a complete index: chunks for the live texts that have
    none, shards of the live rows (pay and clinical tags read from the text, which stays in its chunk) with manifest and
    totals, the pointer, and only then the folders of chunks that no live row names. `stamp` begins with the day.
    """
    save = saver(spark, "publish")
    live = J.live_rows(jobs, fails, KEYS, run_at)
    day = stamp[:8]
    chunked = I.append_chunks(live.withColumnRenamed("description", "text"), day, texts, I.next_chunk(jobs, day)).select("id", "text", "chunk")
    chunked = save(chunked, "chunked")
    if chunked.limit(1).count():
        chunked.repartition("chunk").write.mode("append").partitionBy("chunk").parquet(f"{base}/chunks")
    named = jobs.join(chunked.select("id", F.col("chunk").alias("_new")), "id", "left").withColumn("chunk", F.coalesce("chunk", "_new")).drop("_new")
    named = save(named, "jobs")
    live = J.live_rows(named, fails, KEYS, run_at)
    done = save(enrich(live, systems).drop("description"), "live")
    root = I.publish(spark, done, base, stamp, rows, totals=I.build_manifest(done))
    used = done.select("chunk").where("chunk IS NOT NULL").distinct()
    if I.path_exists(spark, f"{base}/chunks"):
        I.drop_chunk_folders(spark, f"{base}/chunks", used)
    return root, I.drop_unused_chunks(named, used)


# ---------------------------------------------------------------- Q13

def drop_alerts(runs: DataFrame) -> DataFrame:
    """Q13: sources of the latest full run under half of their usual count, unless a later catch-up made it good."""
    last = S.classify_runs(runs).filter("kind IN ('latest', 'catch-up')")
    drops = S.source_drops(runs).join(last.filter("kind = 'latest'").select("day").distinct(), "day", "left_semi")
    started = drops.withColumnRenamed("day", "started")
    out = J.not_recovered(started, last.filter("kind = 'catch-up'").select("source", F.col("day").alias("started"), "jobs"))
    return out.select("source", "jobs", F.floor(F.col("usual") + 0.5).cast("bigint").alias("usual")).orderBy(F.col("usual").desc(), "source")
