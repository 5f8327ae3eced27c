"""Filters that need more than one row or one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed


def two_phase(light: DataFrame, heavy: DataFrame, verdict: Column, final: Column, key: str = "id") -> DataFrame:
    """Rows the light table settles, and the "maybe" rows that pass the final test on the heavy table."""
    judged = light.withColumn("verdict", verdict)
    sure = judged.filter(F.col("verdict") == "yes").select(key, "verdict")
    maybe = judged.filter(F.col("verdict") == "maybe").select(key, "verdict").join(heavy, key).filter(final).select(key, "verdict")
    return sure.unionByName(maybe)


def having(df: DataFrame, min_matching: int = 1, min_total: int | None = None, max_total: int | None = None, new_only: bool = False) -> DataFrame:
    """Company-level limits after the roll-up."""
    df = df.filter(F.col("matching") >= max(1, min_matching))
    if min_total:
        df = df.filter(F.col("total") >= min_total)
    if max_total:
        df = df.filter(F.col("total") <= max_total)
    return df.filter(F.col("matching_since") > 0) if new_only else df


def is_stale(now: Column, days: int) -> Column:
    return F.coalesce("posted_at", "first_seen") < now - F.make_dt_interval(F.lit(days)) if days else F.lit(False)


def drop_stale(df: DataFrame, now: Column, days: int = 365) -> DataFrame:
    """Rows older than `days` leave before any count; 0 keeps all."""
    return df.filter(~is_stale(now, days)) if days else df


def stale_summary(df: DataFrame, now: Column, days: int = 365) -> DataFrame:
    return df.agg(F.count("*").alias("read"), F.count(F.when(is_stale(now, days), True)).alias("stale"))


def robots_rules(robots: Column, token: str) -> Column:
    """Rules of the groups that name us, else of the "*" groups: ``array<struct<allow, pattern>>``.

    Read per text: lines become (key, value) pairs; an agent line right behind another rule line opens a group, so the
    group number of a line is the count of such openings so far.
    """
    lines = F.transform(F.split(robots, r"\r?\n"), lambda s: trimmed(F.regexp_replace(s, "#.*", "")))
    pair = lambda s: F.struct(
        F.lower(F.regexp_extract(s, r"^([A-Za-z-]+)\s*:\s*(.*)$", 1)).alias("k"), trimmed(F.regexp_extract(s, r"^([A-Za-z-]+)\s*:\s*(.*)$", 2)).alias("v")
    )
    pairs = F.filter(F.transform(lines, pair), lambda p: p["k"] != "")
    marks = F.transform(pairs, lambda p: F.when(p["k"] == "user-agent", "U").otherwise("R"))
    # "RRUURR" style text; a group starts at each U that no U stands before.
    shape = F.array_join(marks, "")
    group = lambda i: F.size(F.regexp_extract_all(F.left(shape, i + 1), F.lit("(?<!U)U"), F.lit(0)))
    placed = F.transform(pairs, lambda p, i: F.struct(group(i).alias("g"), p["k"].alias("k"), p["v"].alias("v")))
    agents = lambda test: F.transform(F.filter(placed, lambda x: (x["k"] == "user-agent") & test(F.lower(x["v"]))), lambda x: x["g"])
    mine = agents(lambda v: (v != "*") & F.lit(token).contains(v))
    pick = F.when(F.size(mine) > 0, mine).otherwise(agents(lambda v: v == "*"))
    rules = F.filter(placed, lambda x: x["k"].isin("allow", "disallow") & (x["v"] != "") & F.array_contains(pick, x["g"]))
    return F.transform(rules, lambda x: F.struct((x["k"] == "allow").alias("allow"), x["v"].alias("pattern")))


def _rule_regex(pattern: Column) -> Column:
    """A path pattern with * and a closing $ as a regular expression."""
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.left(pattern, F.length(pattern) - 1)).otherwise(pattern)
    escaped = F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(escaped, r"\*", ".*"), F.when(anchored, F.lit("$")).otherwise(F.lit("")))


def path_allowed(robots: Column, path: Column, token: str) -> Column:
    """The longest matching rule decides, allow wins ties, no rule allows."""
    hits = F.filter(robots_rules(robots, token), lambda r: F.rlike(path, _rule_regex(r["pattern"])))
    best = F.array_max(F.transform(hits, lambda r: F.struct(F.length(r["pattern"]).alias("n"), r["allow"].alias("allow"))))
    return F.coalesce(best["allow"], F.lit(True))
