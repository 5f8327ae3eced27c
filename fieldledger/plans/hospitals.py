"""Hospital postings: Q05 daily cells, Q06 search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.clinical import with_clinical_tags
from ..functions.predicates import health_filter, job_filter
from ..operators.aggregates import daily_cells
from ..operators.groups import top_per_group
from ..operators.joins import live_rows, owners
from ..operators.order import newest_first
from ..sources import index as I


def system_postings(postings: DataFrame, systems: DataFrame) -> DataFrame:
    """Postings of companies a health system owns, with the system's facts; the key goes first so few columns are exploded."""
    key = F.lower(F.concat_ws(":", "source", "company"))
    facts = systems.select("system", "system_name", "system_state", "system_beds").distinct()
    own = owners(systems, "system", "keys").withColumnRenamed("owner", "system").join(facts, "system")
    return postings.withColumn("_key", key).join(own.withColumnRenamed("key", "_key"), "_key").drop("_key")


def tagged_postings(postings: DataFrame, systems: DataFrame) -> DataFrame:
    p = system_postings(postings, systems)
    for c in ("employment_type", "description"):
        if c not in p.columns:
            p = p.withColumn(c, F.lit(None).cast("string"))
    return with_clinical_tags(p)


def health_day(jobs: DataFrame, systems: DataFrame, fails: DataFrame, keys: list[str], run_at: Column) -> DataFrame:
    """Q05: live hospital rows, tagged, counted by system, place, family, first specialty and employment."""
    live = tagged_postings(live_rows(jobs, fails, keys, run_at), systems)
    cells = live.select(
        "system",
        F.coalesce("location", F.lit("")).alias("location"),
        "role_family",
        F.coalesce(F.get("specialties", 0), F.lit("")).alias("specialty"),
        F.coalesce("employment", F.lit("")).alias("employment"),
        "first_seen",
        F.col("sign_on_bonus").alias("bonus"),
        F.col("sign_on_bonus_amount").alias("bonus_amount"),
    )
    return daily_cells(cells, ["system", "location", "role_family", "specialty", "employment"], run_at)


def hospital_search_index(spark: SparkSession, root: str, schema: StructType, systems: DataFrame, q: dict, now: Column) -> I.Found:
    """Q06 over a published index, in waves: rows are tagged only after the job filter, and only in the shards read."""
    within, mark = q.get("posted_within"), q.get("seen_after")
    waves = I.in_waves(spark, root, schema, now - F.make_dt_interval(F.lit(within)) if within else None, F.lit(mark).cast("timestamp_ntz") if mark else None)
    caps = [(k, q[c]) for c, k in (("per_system", ["system"]), ("per_company", ["source", "company"])) if q.get(c)]
    hits = lambda rows: tagged_postings(rows.filter(job_filter(q, now)), systems).filter(health_filter(q))
    return I.first_in_waves(spark, waves, hits, caps, newest_first(), q["max_jobs"], schema)


def hospital_search(postings: DataFrame, systems: DataFrame, q: dict, now: Column) -> DataFrame:
    """Q06: the job filter first (plain columns, before any tag is made), then the hospital filter, caps and order."""
    hits = tagged_postings(postings.filter(job_filter(q, now)), systems).filter(health_filter(q))
    if q.get("per_system"):
        hits = top_per_group(hits, ["system"], newest_first(), q["per_system"])
    if q.get("per_company"):
        hits = top_per_group(hits, ["source", "company"], newest_first(), q["per_company"])
    return hits.orderBy(*newest_first()).limit(q["max_jobs"])
