"""Sorts, limits and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.notes import confidence_score
from .groups import first_per_group, placed, top_per_group


def newest_first(posted: str = "posted_at", ident: str = "id") -> list[Column]:
    """Newest first, undated last, id last of all so that the order is total."""
    return [F.col(posted).desc_nulls_last(), F.col(ident)]


def first_n(df: DataFrame, n: int) -> DataFrame:
    """K02."""
    return df.orderBy(*newest_first()).limit(n)


def top_k(df: DataFrame, key: Column, n: int, tie: str = "domain") -> DataFrame:
    """Bounded top-k, ties by name."""
    return df.orderBy(key.desc_nulls_last(), tie).limit(n)


def rank_companies(df: DataFrame, by: str = "matching", n: int | None = None, name: str = "company_name") -> DataFrame:
    """By the chosen figure, then matching rows, then name. Growth is weighted by size; unknown growth comes last."""
    keys = {
        "matching": F.col("matching"),
        "new": F.col("matching_new30"),
        "total": F.col("total"),
        "growth": F.coalesce(F.col("growth") * F.log10(F.col("total") + 10), F.lit(-1.0)),
    }
    out = df.orderBy(keys[by].desc(), F.col("matching").desc(), name)
    return out.limit(n) if n else out


def rank_changes(df: DataFrame, keys: list[str], n: int | None = None, huge: bool = False) -> DataFrame:
    """Rank by most certain, most symbols, then as found; the first `n` per upgrade where a number is asked for.
    `huge` says that a group may hold a large share of all rows: its ranks are then found by range."""
    order = [confidence_score("confidence").desc(), F.size("symbols").desc(), F.col("pos")]
    if n is not None:
        return top_per_group(df, keys, order, n, "rank")
    if huge:
        return placed(df, keys, order, "rank").withColumn("rank", F.col("rank").cast("int"))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def by_size(df: DataFrame, size: str, n: int, *ties: str) -> DataFrame:
    """K07."""
    return df.orderBy(F.col(size).desc(), *ties).limit(n)


def cap_state(state: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """The newest `n` entries of each seen-set, all where no number is asked for."""
    return state if n is None else top_per_group(state, keys, [F.col("at").desc_nulls_last(), F.col("id")], n)


def citations(registry: Column, repo: Column, notes: Column, advisories: Column, most_notes: int | None = None, most_advisories: int | None = None) -> Column:
    """Registry page, repository, notes, advisories; the first of each where a number is asked for."""
    first = lambda a, n: a if n is None else F.slice(a, 1, n)
    return F.concat(
        F.array_compact(F.array(registry, repo)), first(notes, most_notes), first(advisories, most_advisories)
    )


def union_sources(*frames: DataFrame) -> DataFrame:
    """Differently shaped sources under one schema."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_by(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row per normalised key, in a stated order."""
    return first_per_group(df.withColumn("_k", key), ["_k"], order).drop("_k")


def minus(df: DataFrame, misses: DataFrame, key: str) -> DataFrame:
    """U03."""
    return df.join(misses.select(key), key, "left_anti")


def list_union(a: Column, b: Column, limit: int | None = None) -> Column:
    """U04."""
    u = F.array_union(a, b)
    return F.slice(u, 1, limit) if limit else u


def guarded_replace(new: DataFrame, old: DataFrame) -> DataFrame:
    """The new table, refused while it would shrink the old one. Both counts are aggregates; nothing is collected but them."""
    n_new, n_old = new.count(), old.count()
    if n_new < n_old:
        raise ValueError(f"refusing to replace {n_old} rows by {n_new}: {n_old - n_new} would be lost")
    return new
