"""Joins (J01-J20).

No broadcast is forced on a table that can grow: Catalyst broadcasts by its own size check and adaptive execution
splits skewed partitions of the sort-merge form. The only hints are on one-row tables and on sides cut by a `limit`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import normal_key
from ..functions.versions import loose_key, version_key
from ..session import cut
from .groups import counted, first_per_group, struct_list, top_per_group

# Days a row stays published, stored, and unseen before it is closed; the join limit of a late text join.
LIVE_DAYS, KEEP_PUBLISHED_DAYS, PURGE_DAYS, KEEP_STORED_DAYS = 1, 7, 3, 30
NEVER = "0001-01-01 00:00:00"


def never() -> Column:
    return F.lit(NEVER).cast("timestamp_ntz")


def days_before(at: Column, n: int) -> Column:
    return at - F.make_dt_interval(F.lit(n))


def last_ok(runs: DataFrame, keys: list[str], before: Column | None = None) -> DataFrame:
    good = F.col("ok") if before is None else F.col("ok") & (F.col("run_at") < before)
    return runs.groupBy(*keys).agg(F.max(F.when(good, F.col("run_at"))).alias("ok_at")).filter(F.col("ok_at").isNotNull())


def join_last_ok(jobs: DataFrame, runs: DataFrame, keys: list[str], before: Column) -> DataFrame:
    """Every row with its company's last good load (none: null)."""
    return jobs.join(last_ok(runs, keys, before), keys, "left")


def failing(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Companies whose latest run is not good, with the start of their last good load."""
    g = runs.groupBy(*keys).agg(F.max_by("ok", "day").alias("_ok"), F.max(F.when(F.col("ok"), F.col("run_at"))).alias("since"))
    return g.filter(~F.col("_ok")).select(*keys, F.coalesce("since", never()).alias("since"))


def live_cond(last_run: Column) -> Column:
    week = days_before(last_run, KEEP_PUBLISHED_DAYS)
    kept = F.col("since").isNotNull() & (F.col("last_seen") >= F.greatest("since", week))
    return (F.col("last_seen") >= week) & ((F.col("last_seen") >= days_before(last_run, LIVE_DAYS)) | kept)


def closed_cond(now: Column) -> Column:
    kept = F.col("since").isNotNull() & (F.col("last_seen") >= F.greatest("since", days_before(now, KEEP_STORED_DAYS)))
    return (F.col("last_seen") < days_before(now, PURGE_DAYS)) & ~kept


def live_rows(jobs: DataFrame, fails: DataFrame, keys: list[str], last_run: Column) -> DataFrame:
    """Seen lately, or of a failing company and seen since its last good load, for a week at most."""
    return jobs.join(fails, keys, "left").filter(live_cond(last_run)).drop("since")


def closed_rows(jobs: DataFrame, fails: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Unseen for three days, unless a failing company keeps them."""
    return jobs.join(fails, keys, "left").filter(closed_cond(now)).drop("since")


def owners(dim: DataFrame, ident: str, keys: str) -> DataFrame:
    """One owner per key of a dimension's key array (lower case); the first owner by id stands."""
    flat = dim.select(F.col(ident).alias("owner"), F.explode(keys).alias("_k")).select("owner", F.lower("_k").alias("key"))
    return flat.groupBy("key").agg(F.min("owner").alias("owner"))


def tag_dimension(df: DataFrame, dim: DataFrame, ident: str, keys: str, key: Column) -> DataFrame:
    """Facts whose key some dimension row owns."""
    return df.withColumn("key", F.lower(key)).join(owners(dim, ident, keys), "key").drop("key")


def archive_closed(closed: DataFrame, dim: DataFrame, tags: DataFrame, ident: str, keys: str, key: Column, now: Column) -> DataFrame:
    """Closed rows of the dimension's companies with their saved tags, if any."""
    return tag_dimension(closed, dim, ident, keys, key).join(tags, "id", "left").withColumn("purged_at", now)


def attach_text(top: DataFrame, texts: DataFrame, limit: int | None = None) -> DataFrame:
    """Text for the delivered rows only.

    The inner join lets the few delivered ids be the small side, whose size the planner sees; the outer join then meets
    only their own hits. Rows cut to a `limit` are checkpointed first, so the search behind them runs once.
    """
    top = cut(top) if limit is not None else top
    hits = texts.join(top.select("id"), "id").select("id", F.col("text").alias("description"))
    return top.join(hits, "id", "left").withColumn("description", F.coalesce("description", F.lit("")))


def split_new(snapshot: DataFrame, known: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows not stored yet (only these need the heavy detail), and rows already stored."""
    ids = known.select(key)
    return snapshot.join(ids, key, "left_anti"), snapshot.join(ids, key, "left_semi")


def exclude_seen(df: DataFrame, seen: DataFrame, *keys: str) -> DataFrame:
    """Rows not delivered before, by one key or several."""
    for k in keys or ("id",):
        df = df.join(seen.select(k), k, "left_anti")
    return df


def drop_orphans(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is still in use; a null key never was."""
    return df.join(ids.select(key), key, "left_semi")


def with_names(df: DataFrame, names: DataFrame, keys: list[str], now: Column, ident: str = "company", days: int = 30) -> DataFrame:
    """Cached names younger than 30 days, else the id."""
    fresh = names.filter(F.col("fetched_at") > now - F.make_dt_interval(F.lit(days))).select(*keys, F.col("name").alias("_name"))
    return df.join(fresh, keys, "left").withColumn("name", F.coalesce("_name", ident)).drop("_name")


def by_name(df: DataFrame, name: str, dim: DataFrame, ident: str, display: str) -> DataFrame:
    """A dimension row is found by its id or its display name, case and punctuation aside."""
    keyed = dim.withColumn("_key", F.explode(F.array_distinct(F.array(normal_key(ident), normal_key(display)))))
    return df.withColumn("_key", normal_key(name)).join(keyed, "_key").drop("_key")


def merge_registry(found: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Found rows win, unfound old rows stay and say so."""
    f = found.select(*keys, F.struct(*[c for c in found.columns if c not in keys]).alias("_f"))
    o = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("_o"))
    j = f.join(o, keys, "full_outer").withColumn("retained", F.col("_f").isNull())
    cols = [F.when(F.col("retained"), F.col(f"_o.{c}")).otherwise(F.col(f"_f.{c}")).alias(c) for c in found.columns if c not in keys]
    return j.select(*keys, *cols, "retained")


#: Places of one package's notes that are shuffled as one stretch.
STRETCH = 256


def _version_places(notes: DataFrame, upgrades: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(notes: _k, _n, _at) and (upgrades: _k, _u, _lo, _hi): a note's place among its package's notes in order of version,
    and how many notes are not above each end of an upgrade."""
    ends = F.explode(F.array(F.struct(version_key("from_version").alias("v"), F.lit("_lo").alias("end")), F.struct(version_key("to_version").alias("v"), F.lit("_hi").alias("end")))).alias("e")
    asked = upgrades.select(F.col(key).alias("_k"), F.struct(*upgrades.columns).alias("_u"), ends).select("_k", "_u", "e.v", "e.end")
    there = notes.select(F.col(key).alias("_k"), F.struct(*notes.columns).alias("_n"), version_key("version").alias("v"))
    both = there.unionByName(asked, allowMissingColumns=True).filter("_k IS NOT NULL")
    note = F.col("end").isNull()
    # At one version notes come before ends, as an end counts the notes of its own version.
    at = counted(both, ["_k"], [F.col("v"), F.col("end").asc_nulls_first()], note, "_at")
    pivot = lambda end: F.max(F.when(F.col("end") == end, F.col("_at")))
    return at.filter(note).select("_k", "_n", "_at"), at.filter(~note).groupBy("_k", "_u").agg(pivot("_lo").alias("_lo"), pivot("_hi").alias("_hi"))


def in_range(notes: DataFrame, upgrades: DataFrame, key: str = "pkg") -> DataFrame:
    """Notes after `from` and up to `to`, by package.

    Notes and the two ends of each upgrade are put in one order of versions per package, so an upgrade's notes are those
    of consecutive places. Places are cut into stretches of `STRETCH`: an upgrade is sent to the stretches it touches and
    meets their notes there. What is shuffled grows with notes, upgrades and stretches touched, the pairs are made where
    they are used, and neither side is collected: the spans look small to the planner before they are listed.
    """
    there, spans = _version_places(notes, upgrades, key)
    part = lambda at: F.floor(at / STRETCH)
    listed = spans.filter("_hi > _lo").select("_k", "_u", "_lo", "_hi", F.explode(F.sequence(part(F.col("_lo") + 1), part(F.col("_hi")))).alias("_part"))
    met = listed.join(there.withColumn("_part", part(F.col("_at"))).hint("merge"), ["_k", "_part"]).filter("_at > _lo AND _at <= _hi")
    return met.select("_n.*", *[F.col("_u")[c].alias(c) for c in upgrades.columns if c != key])


def count_in_range(notes: DataFrame, upgrades: DataFrame, out: str, key: str = "pkg") -> DataFrame:
    """J13 where only the number of notes is wanted: the difference of two places, no note is listed."""
    _, spans = _version_places(notes, upgrades, key)
    return spans.select("_u.*", F.greatest(F.lit(0), F.col("_hi") - F.col("_lo")).alias(out))


def target_note(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One note per upgrade by priority (list, direct tag, changelog); a pointer body gives way to the changelog's."""
    from ..functions.notes import is_pointer

    rank = F.when(is_pointer("body") & (F.col("priority") < 3), F.col("priority") + 3).otherwise(F.col("priority"))
    return first_per_group(candidates.withColumn("_p", rank), keys, [F.col("_p"), F.col("tag")]).drop("_p")


def advisory_fixed(events: Column, to: Column) -> Column:
    """Some `fixed` event at or below the target."""
    return fixed_by_key(events, loose_key(to))


def fixed_by_key(events: Column, to_key: Column) -> Column:
    """J15 where the target's `loose_key` is at hand: it is the same for all advisories of an answer."""
    return F.exists(events, lambda e: e["fixed"].isNotNull() & (e["fixed"] != "") & (loose_key(e["fixed"]) <= to_key))


# ---------------------------------------------------------------- J16 near names

def _cuts(s: Column) -> Column:
    """Every string one deletion away."""
    at = F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))


def _shapes(s: Column) -> Column:
    """The string and everything up to two deletions away: strings within two edits share one of these."""
    one = _cuts(s)
    return F.array_distinct(F.concat(F.array(s), one, F.flatten(F.transform(one, _cuts))))


def near_names(df: DataFrame, name: str, popular: DataFrame, known: str, best: int = 3) -> DataFrame:
    """Known names one or two edits away, the best three, as `near` (an array in order).

    Candidates meet in an equi join on shared deletion shapes, so no name is compared with the whole list; names
    longer than any known name by more than two cannot match and make no shapes.
    """
    known_names = popular.select(F.col(known).alias("_p")).distinct()
    asked = df.select(F.lower(name).alias("_n")).distinct()
    longest = known_names.agg(F.max(F.length("_p")).alias("_max"))
    asked = asked.filter(F.length("_n") <= longest.scalar() + 2)
    left = asked.select("_n", F.explode(_shapes(F.col("_n"))).alias("_s"))
    right = known_names.select("_p", F.explode(_shapes(F.col("_p"))).alias("_s"))
    # The length gap is tested on both strings, and the shared shape already holds it to two.
    pairs = left.join(right, "_s").select("_n", "_p").distinct()
    pairs = pairs.withColumn("_d", F.levenshtein("_n", "_p", 2)).filter(F.col("_d").between(1, 2))
    few = top_per_group(pairs, ["_n"], [F.col("_d"), F.col("_p")], best, "_rk")
    near = struct_list(few, ["_n"], "_rk", [F.col("_p").alias("name"), F.col("_d").alias("distance")], "near")
    return df.withColumn("_n", F.lower(name)).join(near, "_n", "left").drop("_n")


# ---------------------------------------------------------------- J17-J20

def attach_citation(claims: DataFrame, notes: DataFrame, keys: list[str]) -> DataFrame:
    """A claim's note by tag, else by version; a claim with neither is dropped."""
    tags = notes.groupBy(*keys, F.col("tag").alias("claim_tag")).agg(F.max_by("url", "pos").alias("_u1"))
    vers = notes.groupBy(*keys, F.col("version").alias("claim_version")).agg(F.min_by("url", "pos").alias("_u2"))
    j = claims.join(tags, [*keys, "claim_tag"], "left").join(vers, [*keys, "claim_version"], "left")
    return j.withColumn("url", F.coalesce("_u1", "_u2")).filter(F.col("url").isNotNull()).drop("_u1", "_u2")


def drop_alias(sites: DataFrame, host: str, count: str, order: list[Column], test_hosts=()) -> DataFrame:
    """Same host and same count is one list published twice; test and non-production hosts go."""
    from ..functions.text import is_production_host

    real = sites.filter(is_production_host(host) & ~F.col(host).isin(*test_hosts) if test_hosts else is_production_host(host))
    return first_per_group(real, [host, count], order)


def not_recovered(drops: DataFrame, catch_ups: DataFrame, share: float = 0.5, within_days: int | None = None) -> DataFrame:
    """Drops no later catch-up run made good (optionally: within so many days).

    Drops and catch-ups of a source stand in one order of days; a drop looks at the largest catch-up behind it, which is a
    running maximum from the end, or that of the few days asked for.
    """
    day = F.unix_date(F.to_date("started"))
    both = drops.select(F.struct(*drops.columns).alias("_d"), "source", day.alias("_t"), F.lit(None).cast("double").alias("_j")).unionByName(
        catch_ups.select(F.lit(None).alias("_d"), "source", day.alias("_t"), F.col("jobs").cast("double").alias("_j"))
    )
    own = W.partitionBy("source")
    behind = own.orderBy(F.desc("_t")).rangeBetween(W.unboundedPreceding, -1) if within_days is None else own.orderBy("_t").rangeBetween(1, within_days)
    seen = both.withColumn("_best", F.max("_j").over(behind)).filter("_d IS NOT NULL")
    return seen.filter(F.col("_best").isNull() | (F.col("_best") < F.col("_d.usual") * share) | F.col("source").isNull()).select("_d.*")


def union_latest(older: DataFrame, newer: DataFrame, keys: list[str]) -> DataFrame:
    """Two keyed feeds, the later feed wins."""
    both = older.withColumn("_p", F.lit(0)).unionByName(newer.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    return first_per_group(both, keys, [F.col("_p").desc()]).drop("_p")
