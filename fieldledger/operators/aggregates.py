"""Aggregations (A01-A31). All are map-side combinable; group contents are never collected whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.text import js_round
from .groups import exact_median, rejoin, struct_list, top_per_group

# A bulk day, days of a first crawl, rows of a top list.
BULK_MIN, BULK_SHARE, FIRST_CRAWL_DAYS, TOP = 20, 0.4, 2, 5


def count_where(cond: Column) -> Column:
    return F.count(F.when(cond, True))


# ---------------------------------------------------------------- A01-A08 one row per company

def company_rollup(df: DataFrame, keys: list[str], match: Column, mark: Column | None = None) -> DataFrame:
    """Matching rows against all rows in one pass."""
    m = F.coalesce(match, F.lit(False))
    since = count_where(m & (F.col("first_seen") > mark)) if mark is not None else F.lit(0).cast("bigint")
    return df.groupBy(*keys).agg(
        F.count("*").alias("total"),
        count_where(m).alias("matching"),
        count_where(m & F.col("remote")).alias("matching_remote"),
        since.alias("matching_since"),
        F.max(F.when(m, F.col("posted_at"))).alias("latest_posted"),
    )


def day_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by group, posting day and first-seen day: the cells every age count is made from."""
    return df.groupBy(*keys, F.to_date("posted_at").alias("posted_day"), F.to_date("first_seen").alias("seen_day")).agg(F.count("*").alias("n"))


def bulk_days(df: DataFrame, keys: list[str], share: float = BULK_SHARE) -> DataFrame:
    """Posting days that hold 20 rows and over 40 % of the group: a bulk re-post, not hiring."""
    days = df.groupBy(*keys, F.to_date("posted_at").alias("posted_day")).agg(F.count("*").alias("n"))
    days = days.withColumn("total", F.sum("n").over(W.partitionBy(*keys)))
    return days.filter(F.col("posted_day").isNotNull() & (F.col("n") >= BULK_MIN) & (F.col("n") > F.col("total") * share))


def new_counts(df: DataFrame, keys: list[str], now: Column, match: Column) -> DataFrame:
    """New in 7 and 30 days, all and matching, and the rows whose age is known.

    A row is as old as its first sighting at least. Undated rows count as new only where the group was watched before
    the window; rows of a bulk day seen in the group's first two days are known but never new. The table is cut to
    day cells first; what needs the whole group is then read off the cells.
    """
    cut = {n: now - F.make_dt_interval(F.lit(n)) for n in (7, 30)}
    m = F.coalesce(match, F.lit(False))
    age = F.when(F.col("posted_at") < F.col("first_seen"), F.col("posted_at")).otherwise(F.col("first_seen"))
    cells = df.groupBy(*keys, F.to_date("posted_at").alias("pd"), F.to_date("first_seen").alias("sd")).agg(
        F.count("*").alias("n"),
        F.min("first_seen").alias("fs"),
        *[count_where((age >= c)).alias(f"in{d}") for d, c in cut.items()],
        *[count_where((age >= c) & m).alias(f"min{d}") for d, c in cut.items()],
    )
    group = W.partitionBy(*keys)
    day = W.partitionBy(*keys, "pd")
    cells = cells.select("*", F.sum("n").over(group).alias("total"), F.min("fs").over(group).alias("watched"), F.sum("n").over(day).alias("on_day"))
    bulk = F.col("pd").isNotNull() & (F.col("on_day") >= BULK_MIN) & (F.col("on_day") > F.col("total") * BULK_SHARE)
    bulk = bulk & (F.col("sd") < F.to_date(F.col("watched") + F.make_dt_interval(F.lit(FIRST_CRAWL_DAYS))))
    known = {d: F.col("pd").isNotNull() | (F.col("watched") < c) for d, c in cut.items()}
    total = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    return cells.groupBy(*keys).agg(
        total(~bulk & known[7], "in7").alias("new7"),
        total(~bulk & known[30], "in30").alias("new30"),
        total(~bulk & known[7], "min7").alias("matching_new7"),
        total(~bulk & known[30], "min30").alias("matching_new30"),
        total(bulk | known[30], "n").alias("known30"),
        F.sum("n").alias("counted"),
    )


def growth(new30: Column, known30: Column, total: Column) -> Column:
    """Share of known rows that are new, to two places; unknown where under half are known."""
    return F.when((known30 > 0) & (known30 * 2 >= total), js_round(new30 / known30, 2))


def top_values(df: DataFrame, keys: list[str], col: str, n: int = TOP, out: str = "top", label: str = "jobs") -> DataFrame:
    """The commonest values of a column with their counts, ties by name."""
    counts = df.select(*keys, F.trim(F.col(col)).alias("_v")).filter("_v <> ''").groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    few = top_per_group(counts, keys, [F.col("_n").desc(), F.col("_v")], n, "_rk")
    return struct_list(few, keys, "_rk", [F.col("_v").alias("name"), F.col("_n").alias(label)], out)


def modal_pay(df: DataFrame, keys: list[str]) -> DataFrame:
    """Range of stated pay in the commonest currency (ties: first by code), and rows that state pay."""
    paid = df.filter(F.col("pay_max").isNotNull() & F.col("currency").isNotNull())
    cur = paid.groupBy(*keys, "currency").agg(
        F.min(F.coalesce("pay_min", "pay_max")).alias("lo"), F.max("pay_max").alias("hi"), F.count("*").alias("n")
    )
    best = F.min_by(F.struct("currency", "lo", "hi"), F.struct(-F.col("n"), "currency"))
    out = cur.groupBy(*keys).agg(best.alias("_b"), F.sum("n").alias("with_pay"))
    return out.select(*keys, F.col("_b.lo").alias("pay_low"), F.col("_b.hi").alias("pay_high"), F.col("_b.currency").alias("pay_currency"), "with_pay")


def newest_k(df: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """The newest rows of each group as an array of structs, and their distinct titles on one line."""
    few = top_per_group(df, keys, [F.col("posted_at").desc_nulls_last(), F.col("id")], k, "_rk")
    fields = [F.col(c) for c in ("id", "title", "location", "department", "posted_at", "url")]
    out = struct_list(few, keys, "_rk", fields, "samples")
    return out.withColumn("sample_titles", F.array_join(F.array_distinct(F.transform("samples", lambda s: s["title"])), "; "))


def distinct_set(df: DataFrame, keys: list[str], col: str, out: str = "values") -> DataFrame:
    """Sorted distinct values; the distinct pairs are made before any set is."""
    pairs = df.select(*keys, col).filter(F.col(col).isNotNull()).distinct()
    return pairs.groupBy(*keys).agg(F.sort_array(F.collect_list(col)).alias(out))


# ---------------------------------------------------------------- A09-A12 lifecycle counts

def run_counts(jobs: DataFrame, last_ok: DataFrame, keys: list[str], run_at: Column, prev_run: Column) -> DataFrame:
    """Open, opened, expected and closed rows per company, against its last good load."""
    j = jobs.join(last_ok, keys, "left")
    since = F.coalesce("ok_at", F.lit("0001-01-01").cast("timestamp_ntz"))
    return j.groupBy(*keys).agg(
        count_where(F.col("last_seen") == run_at).alias("open"),
        count_where(F.col("first_seen") == run_at).alias("opened"),
        count_where((F.col("first_seen") < run_at) & (F.col("last_seen") >= since)).alias("expected"),
        count_where((F.col("last_seen") < run_at) & (F.col("last_seen") >= F.coalesce("ok_at", prev_run))).alias("closed"),
    )


def load_status(fetches: DataFrame, keys: list[str]) -> DataFrame:
    """A company is loaded only if every site of it was; its first error is kept."""
    return fetches.groupBy(*keys).agg(
        F.every("ok").alias("ok"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("error")
    )


def run_summary(results: DataFrame) -> DataFrame:
    bad = ~F.col("ok")
    return results.agg(
        count_where(F.col("ok")).alias("ok"),
        count_where(bad).alias("failed"),
        F.coalesce(F.sum(F.when(bad, F.greatest(F.lit(0), F.col("expected") - F.col("open")))), F.lit(0)).alias("rows_kept"),
        count_where(bad & (F.col("note") == "drop")).alias("drops"),
        count_where(F.col("note") == "drop accepted").alias("drops_accepted"),
    )


def top_failures(results: DataFrame, n: int = 15) -> DataFrame:
    return results.filter(~F.col("ok")).orderBy(F.col("expected").desc(), "source", "company").limit(n)


def failure_reasons(results: DataFrame, n: int = 10) -> DataFrame:
    why = F.concat(F.col("source"), F.lit(": "), F.col("error"))
    bad = results.filter(~F.col("ok") & F.col("error").isNotNull())
    return bad.groupBy(why.alias("reason")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "reason").limit(n)


def daily_cells(df: DataFrame, keys: list[str], run_at: Column) -> DataFrame:
    """Open, opened and bonus counts per cell, with the exact median bonus of rows that state one."""
    counts = df.groupBy(*keys).agg(
        F.count("*").alias("open"),
        count_where(F.col("first_seen") == run_at).alias("opened"),
        count_where(F.col("bonus")).alias("with_bonus"),
    )
    med = exact_median(df, keys, "bonus_amount", "_m").select(*keys, js_round(F.col("_m")).cast("bigint").alias("median_bonus"))
    return rejoin(counts, med, keys, "left")


def median_round(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    return exact_median(df, keys, value, "_m").select(*keys, js_round(F.col("_m")).cast("bigint").alias(out))


# ---------------------------------------------------------------- A14-A16 catalogues and run statistics

def price_band(df: DataFrame, keys: list[str], price: str) -> DataFrame:
    """Lowest, upper-middle and highest price."""
    ends = df.filter(F.col(price).isNotNull()).groupBy(*keys).agg(F.min(price).alias("price_min"), F.max(price).alias("price_max"))
    return rejoin(ends, exact_median(df, keys, price, "price_median", upper=True), keys).select(*keys, "price_min", "price_median", "price_max")


def catalog_facts(products: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """One row per store from its products (`variants` prices, `product_type`, `vendor`, `published`)."""
    cheapest = F.array_min(F.filter(F.transform("variants", lambda v: v["price"].try_cast("double")), lambda p: p > 0))
    p = products.withColumn("_price", cheapest)
    facts = p.groupBy(*keys).agg(
        F.max("published").alias("newest_product"), count_where(F.col("published") >= now - F.make_dt_interval(F.lit(30))).alias("added_30d")
    )
    for extra in (
        price_band(p, keys, "_price"),
        top_values(p, keys, "product_type", out="product_types", label="count"),
        top_values(p, keys, "vendor", out="vendors", label="count"),
    ):
        facts = rejoin(facts, extra, keys, "left")
    return facts


def source_counts(runs: DataFrame) -> DataFrame:
    """Nested run statistics (fixed counters and a map) to one row per run and source."""
    fixed = {"workday": "workday_jobs", "oracle": "oracle_jobs", "smartrecruiters": "sr_jobs", "ats": "board_jobs"}
    fixed_map = F.create_map(*[x for k, c in fixed.items() for x in (F.lit(k), F.coalesce(F.col(c), F.lit(0)).cast("bigint"))])
    none = F.create_map().cast("map<string,bigint>")
    # A small system never carries a fixed name; map_filter keeps map_concat free of repeats all the same.
    small = F.map_filter(F.coalesce("small", none), lambda k, v: ~k.isin(*fixed))
    return runs.select("run_id", F.explode(F.map_concat(fixed_map, small)).alias("source", "jobs")).withColumn("jobs", F.coalesce("jobs", F.lit(0)))


# ---------------------------------------------------------------- A17-A19 ledger and registry

# The report's windows in hours.
LEDGER_WINDOWS = {"24h": 24, "7d": 168, "30d": 720, "all": None}


def ledger_summary(requests: DataFrame, now: Column) -> DataFrame:
    """Requests, revenue, cost, cache hits and payers for four windows in one pass.

    The windows lie inside one another, so a request belongs to the smallest that holds it, its age class. Sums are made
    per payer and class; a payer counts from its own smallest class on, and a window is the sum over the classes in it.
    """
    hours = list(LEDGER_WINDOWS.values())
    inside = [F.lit(True) if h is None else F.col("ts") >= now - F.make_dt_interval(hours=F.lit(h)) for h in hours]
    age = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(inside)])
    zero = F.lit(0.0)
    measures = {"requests": F.lit(1), "paid_requests": F.when(F.col("paid"), 1), "revenue": F.coalesce("price", zero), "cost": F.coalesce("cost", zero), "cache_hits": F.when(F.col("cache_hit"), 1)}
    aged = requests.withColumn("_age", age)
    per_payer = aged.groupBy("payer").agg(F.min("_age").alias("_first"), *[F.coalesce(F.sum(F.when(F.col("_age") == i, m)), F.lit(0)).alias(f"{n}_{i}") for n, m in measures.items() for i in range(len(hours))])
    total = per_payer.agg(
        *[F.sum(f"{n}_{i}").alias(f"{n}_{i}") for n in measures for i in range(len(hours))],
        *[count_where(F.col("payer").isNotNull() & (F.col("_first") <= i)).alias(f"payers_{i}") for i in range(len(hours))],
    )
    upto = lambda n, i: sum((F.col(f"{n}_{j}") for j in range(1, i + 1)), F.col(f"{n}_0"))
    windows = F.array(
        *[
            F.struct(
                F.lit(name).alias("window"),
                *[(F.round(upto(n, i), 4) if n in ("revenue", "cost") else upto(n, i)).alias(n) for n in measures],
                F.col(f"payers_{i}").alias("unique_payers"),
            )
            for i, name in enumerate(LEDGER_WINDOWS)
        ]
    )
    out = total.select(F.explode(windows).alias("w")).select("w.*").filter("requests > 0")
    return out.withColumn("profit", F.round(F.col("revenue") - F.col("cost"), 4))


# Fixed value: empty checks after which a company is retired.
RETIRED_AT = 5


def registry_stats(df: DataFrame) -> DataFrame:
    """Companies, jobs and systems of the live registry: a total row and one row per system."""
    live = df.filter(F.col("empty_streak") < RETIRED_AT)
    return live.rollup("ats").agg(
        F.count("*").alias("companies"), F.coalesce(F.sum("job_count"), F.lit(0)).alias("jobs"), F.countDistinct("ats").alias("systems")
    )


def add_daily(df: DataFrame, ts: str, amount: str) -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.round(F.sum(amount), 4).alias("amount"), F.count("*").alias("calls"))


# ---------------------------------------------------------------- A20-A31 reports

def profile(df: DataFrame, keys: list[str], distinct: str, stated: str, value: str) -> DataFrame:
    base = df.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.countDistinct(distinct).alias("distinct"),
        F.avg(F.col(stated).isNotNull().cast("double")).alias("share_stated"),
    )
    return rejoin(base, exact_median(df, keys, value, "median"), keys, "left")


def value_counts(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    """Counts and shares of the non-null values, commonest first."""
    c = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("_t"))
    c = c.withColumn("share", F.col("n") / total.scalar())
    return c.orderBy(F.col("n").desc(), "value").limit(n) if n else c


def top_share(df: DataFrame, value: str, tie: str, tops=(10, 25, 50)) -> DataFrame:
    """Share of the total the largest rows hold."""
    head = df.orderBy(F.col(value).desc(), tie).limit(max(tops)).select(value, tie)
    ranked = head.withColumn("_rn", F.row_number().over(W.orderBy(F.col(value).desc(), tie)))  # at most max(tops) rows
    sums = ranked.agg(*[F.sum(F.when(F.col("_rn") <= t, F.col(value))).alias(f"_s{t}") for t in tops])
    total = df.agg(F.sum(value).alias("_total"))
    stacked = F.explode(F.array(*[F.struct(F.lit(t).alias("top"), (F.col(f"_s{t}") / F.col("_total")).alias("share")) for t in tops]))
    return sums.withColumn("_total", total.scalar()).select(stacked.alias("x")).select("x.*")


def threshold_counts(df: DataFrame, col: str, thresholds: list[float]) -> DataFrame:
    """Rows at or above each threshold and their share, in one pass."""
    agg = df.agg(F.count("*").alias("_t"), *[count_where(F.col(col) >= t).alias(f"_c{i}") for i, t in enumerate(thresholds)])
    rows = F.explode(
        F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_c{i}").alias("n"), (F.col(f"_c{i}") / F.col("_t")).alias("share")) for i, t in enumerate(thresholds)])
    )
    return agg.select(rows.alias("x")).select("x.*")


def band(col: Column | str, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins; a value at or below the lowest edge, or null, has none."""
    c = F.col(col) if isinstance(col, str) else col
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges, edges[1:], labels))):
        inside = (c > lo) if hi == float("inf") else ((c > lo) & (c <= hi))
        out = F.when(inside, label).otherwise(out)
    return out


def histogram_bin(col: Column, lo: float, cap: float, bins: int) -> Column:
    """Bin of a value clipped at `cap`; the cap falls in the last bin."""
    width = (cap - lo) / bins
    return F.least(F.floor((F.least(col, F.lit(cap)) - lo) / width), F.lit(bins - 1)).cast("int")


def list_counts(df: DataFrame, col: str, sep: str | None = None) -> DataFrame:
    """Entries of a list column: counts, and the share of all rows that carry them."""
    items = F.split(F.col(col), sep) if sep else F.col(col)
    flat = df.select(F.explode(items).alias("value")).filter("value <> ''")
    total = df.agg(F.count("*").alias("_t"))
    c = flat.groupBy("value").agg(F.count("*").alias("n"))
    return c.select("value", "n", (F.col("n") / total.scalar()).alias("share"))


def cooccur(df: DataFrame, col: str, left: list[str], right: list[str]) -> DataFrame:
    """Rows that carry both tags, for two fixed tag lists: one aggregate, no pairs are made."""
    has = lambda t: F.array_contains(col, t)
    agg = df.agg(*[count_where(has(a) & has(b)).alias(f"_{i}_{j}") for i, a in enumerate(left) for j, b in enumerate(right)])
    cells = [
        F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"_{i}_{j}").alias("n")) for i, a in enumerate(left) for j, b in enumerate(right)
    ]
    return agg.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def supply_demand(df: DataFrame, categories: str, demand: str) -> DataFrame:
    """Items and demand by category (an item may have several, or none)."""
    none = F.array(F.lit("(none)"))
    cats = F.when(F.size(F.coalesce(categories, F.array().cast("array<string>"))) > 0, F.col(categories)).otherwise(none)
    flat = df.select(F.explode(cats).alias("category"), F.coalesce(demand, F.lit(0)).alias("_d"))
    out = flat.groupBy("category").agg(F.count("*").alias("supply"), F.sum("_d").alias("demand"))
    return out.withColumn("ratio", F.col("demand") / F.col("supply"))


def domain_rollup(df: DataFrame, host: Column, calls: str, payers: str, price: str) -> DataFrame:
    return df.groupBy(host.alias("host")).agg(
        F.sum(calls).alias("calls"),
        F.max(payers).alias("max_payers"),
        F.count("*").alias("endpoints"),
        F.round(F.coalesce(F.sum(F.col(price) * F.col(calls)), F.lit(0.0)), 2).alias("revenue"),
    )


def class_share(df: DataFrame, keys: list[str], cond: Column, value: str, at_least: int = 30) -> DataFrame:
    """Share of one class by group and the group's median, for groups of a least size."""
    base = df.groupBy(*keys).agg(F.count("*").alias("rows"), F.avg(F.coalesce(cond, F.lit(False)).cast("double")).alias("share"))
    return rejoin(base.filter(F.col("rows") >= at_least), exact_median(df, keys, value, "median"), keys, "left")


def status_dist(df: DataFrame, status: str, error: str) -> DataFrame:
    c = df.groupBy(F.col(status).alias("status"), F.when(F.col(status) == 0, F.col(error)).alias("error")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("_t"))
    return c.select("status", "error", "n", (F.col("n") / total.scalar()).alias("share"))


def stratified_sample(df: DataFrame, ident: str, value: str, threshold: float, low: int = 200, high: int = 150, seed: int = 42) -> DataFrame:
    """A repeatable sample below the threshold and the first rows at or above it (the sampling is the feature)."""
    small = df.filter(F.coalesce(value, F.lit(0)) < threshold).orderBy(F.md5(F.concat(F.col(ident).cast("string"), F.lit(f":{seed}"))), ident).limit(low)
    return small.unionByName(df.filter(F.col(value) >= threshold).orderBy(ident).limit(high))
