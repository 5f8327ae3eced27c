"""Reports: Q14 market gaps, Q15 dashboard tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import BARRED_WORDS, weak_incumbent
from ..operators.joins import union_latest
from ..operators.windows import ranks


def market_gaps(items: DataFrame, barred: list[str] | None = None) -> DataFrame:
    """Q14: demand on barred and open topics, and the open products with demand and a weak rating, in one pass and one row."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("name", F.lit(""))))
    closed = F.lit(False)
    for w in barred if barred is not None else BARRED_WORDS:
        closed = closed | text.contains(w)
    users = F.coalesce("users", F.lit(0))
    free = F.coalesce("pricing", F.lit("FREE")) == "FREE"
    weak = weak_incumbent(below=4.0, min_reviews=10) & (F.coalesce("rating", F.lit(0)) > 0)
    total = lambda cond: F.coalesce(F.sum(F.when(cond, users)), F.lit(0))
    return items.agg(
        F.count("*").alias("items"), F.sum(users).alias("users"), total(closed).alias("users_barred"), total(~closed).alias("users_open"), total(~closed & free).alias("users_open_free"),
        F.count(F.when(~closed & (users >= 100), True)).alias("open_with_demand"), F.count(F.when(~closed & weak, True)).alias("open_weak"),
    )


def history(weekly: DataFrame, daily: DataFrame) -> DataFrame:
    """Q15: one history of two feeds by day and product, the daily feed wins."""
    return union_latest(weekly, daily, ["date", "actor"])


def rankings(results: DataFrame, queries: DataFrame, own: Column) -> DataFrame:
    """Q15: the latest day's places; a query without one of ours says so."""
    last = results.agg(F.max("date").alias("_d"))
    today = results.filter(F.col("date") == last.scalar())
    return ranks(today, queries, own).withColumn("name", F.coalesce("name", F.lit("Not in top 100")))


def index_figures(manifest: DataFrame, label: str) -> DataFrame:
    """Q15: manifest totals as (metric, value) rows."""
    return manifest.select(F.explode(F.map_from_arrays(F.array(F.lit(f"{label}: rows"), F.lit(f"{label}: companies")), F.array("total", "companies"))).alias("metric", "value"))
