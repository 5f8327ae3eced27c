"""Feeds that return what is new since the last run; state is a small keyed table the caller keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import cap_state, newest_first

# Days a delivered row is remembered (jobs, filings).
KEEP_DAYS, KEEP_FILING_DAYS = 180, 400


def monitor_key(*filters: str) -> str:
    """One state row per normalised set of filters."""
    import hashlib

    return hashlib.sha256("\n".join(sorted(f.strip().lower() for f in filters)).encode()).hexdigest()[:16]


def new_since(df: DataFrame, state: DataFrame, key: str, seen: str = "first_seen") -> DataFrame:
    """Rows first seen after the key's mark; without a mark all rows. The mark is a scalar subquery, not collected."""
    mark = state.filter(F.col("key") == key).agg(F.max("seen_through").alias("_mark"))
    return df.withColumn("_mark", mark.scalar()).filter(F.col("_mark").isNull() | (F.col(seen) > F.col("_mark"))).drop("_mark")


def advance(state: DataFrame, key: str, indexed_at: Column, now: Column, completed: bool = True, move_on_partial: bool = True) -> DataFrame:
    """The mark moves to the index read, never back; feeds that keep cut rows do not move it after a cut run."""
    moves = completed or move_on_partial
    old = state.filter(F.col("key") == key)
    fresh = old.agg(F.max("seen_through").alias("_s"), F.coalesce(F.max("runs"), F.lit(0)).alias("_r"))
    through = F.greatest(F.col("_s"), indexed_at) if moves else F.col("_s")
    row = fresh.select(F.lit(key).alias("key"), through.alias("seen_through"), now.alias("last_run"), (F.col("_r") + 1).cast("int").alias("runs"))
    return state.filter(F.col("key") != key).unionByName(row)


def new_for_feeds(df: DataFrame, state: DataFrame, key: str = "key", seen: str = "first_seen") -> DataFrame:
    """R01 for many feeds at once: rows first seen after their own feed's mark; all rows of a feed without one."""
    marks = state.select(F.col("key").alias(key), F.col("seen_through").alias("_mark"))
    return df.join(marks, key, "left").filter(F.col("_mark").isNull() | (F.col(seen) > F.col("_mark"))).drop("_mark")


def advance_feeds(state: DataFrame, loads: DataFrame, now: Column, move_on_partial: bool = True) -> DataFrame:
    """R01, R02 for many feeds at once: `loads` (key, indexed_at, completed) are the feeds that ran. A mark never falls; a
    cut run moves it only where the feed says so. Feeds that did not run stay as they are."""
    old = state.select("key", F.struct("seen_through", "last_run", "runs").alias("_old"))
    ran = loads.groupBy("key").agg(F.max("indexed_at").alias("_at"), F.min("completed").alias("_whole"))
    j = old.join(ran, "key", "full_outer")
    moves = F.col("_at").isNotNull() & (F.col("_whole") | F.lit(move_on_partial))
    through = F.when(moves, F.greatest("_old.seen_through", "_at")).otherwise(F.col("_old.seen_through"))
    last = F.when(F.col("_at").isNotNull(), now).otherwise(F.col("_old.last_run"))
    runs = F.coalesce("_old.runs", F.lit(0)) + F.col("_at").isNotNull().cast("int")
    return j.select("key", through.alias("seen_through"), last.alias("last_run"), runs.alias("runs"))


def seen_feed(df: DataFrame, seen: DataFrame, feed: str, now: Column, n: int, order: list[Column] | None = None, keep_days: int = KEEP_DAYS, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows not delivered within the last `keep_days`, at most `n`; and the seen-set after the run.

    Only delivered rows are remembered, so rows past the limit come next time.
    """
    live = seen.filter(F.col("at") >= now - F.make_dt_interval(F.lit(keep_days)))
    mine = live.filter(F.col("feed") == feed).select("id")
    out = df.join(mine, "id", "left_anti").orderBy(*(order or newest_first())).limit(n)
    after = live.unionByName(out.select(F.lit(feed).alias("feed"), "id", now.alias("at")))
    return out, cap_state(after, ["feed"], cap) if cap else cap_state(after, ["feed"])
