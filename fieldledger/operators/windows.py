"""Latest rows, caps, streaks, rolling figures and other sequence logic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.notes import confidence_score
from .groups import carried_down, first_per_group, placed, rejoin, top_per_group

# Outage guard, source drops, response windows, re-check days.
DROP_MIN, DROP_ACCEPT_RUNS = 50, 7
DROP_SHARE, USUAL_MIN, HISTORY_RUNS = 0.5, 500, 7
WINDOW_ROWS, REFUSED_SHARE = 200, 0.1
RECHECK_DAYS = {"new": 0, "live": 14, "password": 21, "closed": 45, "not_shopify": 90, "robots": 60, "error": 21}
FAILS_MANY, RECHECK_MANY, SPREAD_DAYS = 3, 30, 2


def latest(df: DataFrame, keys: list[str], ts: str, *ties: Column) -> DataFrame:
    """The newest row per key."""
    return first_per_group(df, keys, [F.col(ts).desc_nulls_last(), *ties])


def outage_guard(days: DataFrame, keys: list[str]) -> DataFrame:
    """W03 over many days: a load with under half of the expected rows is not believed until the seventh day running.

    A "drop" day needs the six days before it to decide, and they were decided the same way; so within an unbroken
    stretch of such days every seventh is accepted. Rows per company are its days, a bounded number.
    """
    w = W.partitionBy(*keys).orderBy("day")
    short = F.col("loaded") & (F.col("expected") >= DROP_MIN) & (F.col("open") < F.col("expected") / 2)
    d = days.withColumn("_short", short).withColumn("_rn", F.row_number().over(w))
    d = d.withColumn("_isle", F.col("_rn") - F.row_number().over(W.partitionBy(*keys, "_short").orderBy("day")))
    at = F.row_number().over(W.partitionBy(*keys, "_short", "_isle").orderBy("day"))
    d = d.withColumn("_at", at)
    accepted = F.col("_short") & (F.col("_at") % DROP_ACCEPT_RUNS == 0)
    note = F.when(~F.col("loaded"), "error").when(accepted, "drop accepted").when(F.col("_short"), "drop")
    return d.withColumn("note", note).withColumn("ok", F.coalesce(~F.col("note").isin("error", "drop"), F.lit(True))).drop("_short", "_rn", "_isle", "_at")


def guard_today(today: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """W03 for one day: the notes of the six daily rows before it are read from the stored runs."""
    prior = top_per_group(runs, keys, [F.col("day").desc()], DROP_ACCEPT_RUNS - 1)
    prior = prior.groupBy(*keys).agg(F.count("*").alias("_n"), F.count(F.when(F.col("note") == "drop", True)).alias("_d"))
    short = F.col("loaded") & (F.col("expected") >= DROP_MIN) & (F.col("open") < F.col("expected") / 2)
    long_drop = (F.coalesce("_n", F.lit(0)) == DROP_ACCEPT_RUNS - 1) & (F.col("_d") == F.col("_n"))
    out = today.join(prior, keys, "left")
    note = F.when(~F.col("loaded"), "error").when(short & long_drop, "drop accepted").when(short, "drop")
    return out.withColumn("note", note).withColumn("ok", F.coalesce(~F.col("note").isin("error", "drop"), F.lit(True))).drop("_n", "_d")


def rolling_usual(runs: DataFrame, n: int = HISTORY_RUNS) -> DataFrame:
    """Exact median of the previous `n` full runs per source (`usual`); rows are one per run and source.

    Every full run is judged for every source ever seen; a source a run lacks counts 0 for that run but gives no
    history. Runs are numbered by start; each count is handed on to the `n` runs behind it, so a source costs as many
    rows as it has runs, times `n`, and none for runs long after its last.
    """
    full = runs.filter("is_full").groupBy("day", "source").agg(F.sum("jobs").alias("jobs"))
    days = full.select("day").distinct().withColumn("_run", F.row_number().over(W.orderBy("day")))  # one row per run
    own = full.join(days, "day")
    last = days.agg(F.max("_run")).scalar()
    handed = own.select("source", "jobs", F.explode(F.sequence(F.col("_run") + 1, F.col("_run") + n)).alias("_run")).filter(F.col("_run") <= last)
    past = rejoin(handed.groupBy("source", "_run").agg(F.sort_array(F.collect_list("jobs")).alias("_past")), own.select("source", "_run", "jobs"), ["source", "_run"], "left")
    k = F.size("_past")
    usual = (F.get("_past", F.floor((k - 1) / 2).cast("int")) + F.get("_past", F.floor(k / 2).cast("int"))) / 2
    return past.join(days, "_run").select("day", "source", F.coalesce("jobs", F.lit(0)).alias("jobs"), usual.alias("usual"))


def source_drops(runs: DataFrame) -> DataFrame:
    """Sources under half of their usual count."""
    r = rolling_usual(runs)
    return r.filter((F.col("usual") >= USUAL_MIN) & (F.col("jobs") < F.col("usual") * DROP_SHARE))


def cap_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """W05."""
    return top_per_group(df, keys, order, n)


def dedupe_alias(df: DataFrame, alias: str, own: str, order: list[Column]) -> DataFrame:
    """One row per alias group; rows without an alias stand alone (the prefix keeps the two kinds apart)."""
    key = F.coalesce(F.concat(F.lit("a:"), F.col(alias)), F.concat(F.lit("o:"), F.col(own)))
    return first_per_group(df.withColumn("_k", key), ["_k"], order).drop("_k")


def share_best(df: DataFrame, tenant: str, name: str, good: Column, pos: str, given: dict | None = None) -> DataFrame:
    """The tenant's given name, else each row's own good name, else the tenant's first good one, else the tenant."""
    best = df.groupBy(tenant).agg(F.min_by(name, F.when(good, F.col(pos))).alias("_best"))
    from ..functions.labels import literal_map

    fixed = F.try_element_at(literal_map(given), F.col(tenant)) if given else F.lit(None).cast("string")
    own = F.when(good, F.col(name))
    return rejoin(df, best, [tenant], "left").withColumn("shared_name", F.coalesce(fixed, own, "_best", tenant)).drop("_best")


def streak(df: DataFrame, keys: list[str], ts: str, ok: Column) -> DataFrame:
    """Checks since the last good one (all of them when there was none). Two combinable aggregates, no ordered group."""
    last = df.groupBy(*keys).agg(F.max(F.when(ok, F.col(ts))).alias("_last"))
    j = rejoin(df, last, keys)
    since = F.count(F.when(F.col("_last").isNull() | (F.col(ts) > F.col("_last")), True))
    return j.groupBy(*keys).agg(since.alias("streak"), F.max(ts).alias("last_check"), F.count("*").alias("checks"))


def next_check(df: DataFrame, ident: str = "domain") -> DataFrame:
    """When a store is due again, by outcome. The spread over two days comes from the id, so a re-run gives the same day."""
    from ..functions.labels import literal_map

    days = F.when((F.col("status") == "error") & (F.col("fails") >= FAILS_MANY), F.lit(RECHECK_MANY)).otherwise(
        F.try_element_at(literal_map(RECHECK_DAYS), F.col("status"))
    )
    days = F.when(F.col("refused") & (F.col("fails") < FAILS_MANY), F.lit(1)).when(F.col("refused"), F.lit(RECHECK_MANY)).otherwise(days)
    spread = F.when(F.col("refused"), F.lit(0)).otherwise(F.pmod(F.xxhash64(ident), F.lit(SPREAD_DAYS * 86_400)))
    at = F.col("checked_at") + F.make_dt_interval(days, F.lit(0), F.lit(0), spread)
    return df.withColumn("recheck_days", days).withColumn("next_check", at)


def due(df: DataFrame, now: Column, n: int, ident: str = "domain") -> DataFrame:
    """Never-checked rows first, then the longest due."""
    return df.filter(F.col("next_check").isNull() | (F.col("next_check") <= now)).orderBy(
        (F.col("status") == "new").desc(), F.col("next_check").asc_nulls_first(), ident
    ).limit(n)


def seen_span(snapshots: DataFrame, keys: list[str], day: str = "day") -> DataFrame:
    """W12."""
    return snapshots.groupBy(*keys).agg(F.min(day).alias("first_seen"), F.max(day).alias("last_seen"))


def stints(snapshots: DataFrame, keys: list[str], day: str = "day", gap: int = 3) -> DataFrame:
    """One row per unbroken stretch; a gap of more than three days ends one. Days per id are a bounded number."""
    days = snapshots.select(*keys, F.to_date(day).alias("_d")).distinct()
    w = W.partitionBy(*keys).orderBy("_d")
    new = (F.datediff("_d", F.lag("_d").over(w)) > gap).cast("int")
    days = days.withColumn("_new", F.coalesce(new, F.lit(1)))
    days = days.withColumn("stint", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return days.groupBy(*keys, "stint").agg(F.min("_d").alias("first_seen"), F.max("_d").alias("last_seen"), F.count("*").alias("days"))


def recent_count(df: DataFrame, client: str, ts: str, seconds: int = 3600) -> DataFrame:
    """Requests of the client in the hour before each request.

    A client's log is cut into pieces one window long, with one row per moment. The hour before a moment is the rest of
    the piece before, from the moment one window earlier on, and the own piece up to the moment: two running sums, so
    the work is linear however busy an hour is.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    span = seconds * 1_000_000
    rows = df.withColumn("_t", micros)
    moments = rows.groupBy(client, "_t").agg(F.count("*").alias("_n"))
    marks = moments.select(client, F.col("_t").alias("_of"), F.explode(F.array(F.struct(F.col("_t").alias("at"), F.lit(1).alias("kind"), F.col("_n").alias("n")), F.struct((F.col("_t") - span).alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n")))).alias("m")).select(client, "_of", "m.*")
    marks = marks.withColumn("_piece", F.floor(F.col("at") / span))
    piece = W.partitionBy(client, "_piece")
    upto = F.sum("n").over(piece.orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0))
    # The mark one window earlier stands before the requests of its moment, which still count.
    part = marks.withColumn("_part", F.when(F.col("kind") == 1, upto).otherwise(F.sum("n").over(piece) - upto))
    recent = part.groupBy(client, F.col("_of").alias("_t")).agg((F.sum("_part") - 1).alias("recent"))
    return rejoin(rows, recent, [client, "_t"]).drop("_t")


def refusal_windows(responses: DataFrame, order: list[Column], refused: Column) -> DataFrame:
    """Full windows of 200 responses in order, their refused share, and how many bad windows stand in a row."""
    pos = placed(responses, [], order)
    win = pos.withColumn("window", F.floor((F.col("pos") - 1) / WINDOW_ROWS)).groupBy("window").agg(
        F.count("*").alias("n"), F.count(F.when(refused, True)).alias("refused")
    )
    win = win.filter(F.col("n") == WINDOW_ROWS).withColumn("share", F.col("refused") / F.col("n"))
    win = win.withColumn("bad", F.col("share") > REFUSED_SHARE)
    calm = carried_down(win, [], "window", F.floor(F.col("window") / 1000), F.when(~F.col("bad"), F.col("window")), "_calm")
    return calm.withColumn("bad_streak", F.col("window") - F.coalesce("_calm", F.lit(-1))).drop("_calm")


def dedupe_near(df: DataFrame, keys: list[str], key: str = "key", pos: str = "pos") -> DataFrame:
    """One finding per key, the most certain and then the earliest, at the place of the key's first finding."""
    first = df.groupBy(*keys, key).agg(F.min(pos).alias("_first"))
    best = first_per_group(df, [*keys, key], [confidence_score("confidence").desc(), F.col(pos)])
    return rejoin(best, first, [*keys, key]).withColumn(pos, F.col("_first")).drop("_first")


def ranks(results: DataFrame, queries: DataFrame, own: Column) -> DataFrame:
    """Places of our rows per query; a query without any keeps one empty row."""
    mine = results.filter(own).select("query", "rank", "name")
    return queries.join(mine, "query", "left")


def classify_runs(runs: DataFrame) -> DataFrame:
    """The latest full run, the full runs before it, the catch-ups after it. One row decides for all."""
    last = runs.agg(F.max(F.when(F.col("is_full"), F.col("day"))).alias("_last"))
    r = runs.withColumn("_last", last.scalar())
    kind = (
        F.when(F.col("is_full") & (F.col("day") == F.col("_last")), "latest")
        .when(F.col("is_full"), "previous")
        .when(F.col("day") > F.col("_last"), "catch-up")
        .otherwise("older catch-up")
    )
    return r.withColumn("kind", kind).drop("_last")
