"""Filters as Column expressions; callers pass plain lists and numbers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c


def words(values) -> list[str]:
    """Lower case, trimmed, blanks dropped."""
    return [w for w in ((v or "").strip().lower() for v in values or []) if w]


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def all_of(tests: list[Column]) -> Column:
    """Every test holds; a null test fails."""
    return reduce(lambda a, b: a & b, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(True))


def _escape(word: str) -> str:
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", word)


# ---------------------------------------------------------------- V01 / V02

def keyword_match(col: Column | str, keywords) -> Column:
    """Any keyword: three characters or fewer as whole words, longer ones anywhere."""
    t = F.lower(_c(col))
    tests = [
        t.contains(k) if len(k) > 3 else t.rlike(rf"(^|[^a-z0-9]){_escape(k)}($|[^a-z0-9])") for k in words(keywords)
    ]
    return _any(tests) if tests else F.lit(False)


def search_text(*cols: Column) -> Column:
    """Columns and arrays joined with " | " (missing ones are empty)."""
    return F.array_join(F.flatten(F.array(*cols)), " | ")


def text_parts(*cols: Column) -> Column:
    return F.array(*[F.coalesce(c, F.lit("")) for c in cols])


# ---------------------------------------------------------------- V03

def in_set(col: Column | str, values, upper: bool = False) -> Column:
    vals = [v.upper() if upper else v for v in words(values)]
    return _c(col).isin(*vals)


def array_in_set(col: Column | str, values, wildcard: str | None = None, fold: str = "lower") -> Column:
    vals = [v.upper() if fold == "upper" else v for v in words(values)]
    if wildcard:
        vals.append(wildcard)
    have = F.transform(_c(col), F.lower) if fold == "lower" else _c(col)
    return F.arrays_overlap(have, F.array(*[F.lit(v) for v in vals]))


# ---------------------------------------------------------------- V04 / V05

def posted_within(posted: Column | str, first_seen: Column | str, now: Column, days: int) -> Column:
    return F.coalesce(_c(posted), _c(first_seen)) >= now - F.make_dt_interval(F.lit(days))


def seen_after(first_seen: Column | str, mark: Column) -> Column:
    return _c(first_seen) > mark


def posted_within_live(posted_text: Column | str, now: Column, days: int) -> Column:
    """Live variant over date text: undated rows stay, a date without a time gets a day's grace."""
    p = _c(posted_text)
    at = F.try_to_timestamp(p)
    grace = F.when(F.length(p) == 10, F.make_dt_interval(F.lit(1))).otherwise(F.make_dt_interval(F.lit(0)))
    return F.coalesce(at >= now - F.make_dt_interval(F.lit(days)) - grace, F.lit(True))


# ---------------------------------------------------------------- V07

def pay_filter(top: Column | str, currency: Column | str, only_paid: bool = False, minimum: float | None = None, currencies=()) -> Column:
    """Any pay option makes stated pay a must."""
    tests = []
    if only_paid or minimum or words(currencies):
        tests.append(_c(top).isNotNull())
    if minimum:
        tests.append(_c(top) >= minimum)
    if words(currencies):
        tests.append(in_set(currency, currencies, upper=True))
    return all_of(tests)


# ---------------------------------------------------------------- job filter of the searches

def job_filter(q: dict, now: Column) -> Column:
    """The job search's filter over a postings table; `q` holds plain values, absent keys filter nothing."""
    t = []
    if q.get("seen_after") is not None:
        t.append(seen_after("first_seen", F.lit(q["seen_after"])))
    t.append(pay_filter("pay_max", "currency", q.get("only_with_pay", False), q.get("min_pay"), q.get("currencies", ())))
    if words(q.get("sources")):
        t.append(in_set("source", q["sources"]))
    if words(q.get("title")):
        t.append(keyword_match("title", q["title"]))
    if words(q.get("title_exclude")):
        t.append(~keyword_match("title", q["title_exclude"]))
    if q.get("remote_only"):
        t.append(F.col("remote"))
    if words(q.get("location")):
        where = search_text(text_parts(F.col("location")), F.coalesce("additional", F.array().cast("array<string>")), text_parts(F.col("country")))
        t.append(keyword_match(where, q["location"]))
    if words(q.get("company")):
        who = F.lower(F.concat_ws(" ", "company", "company_name"))
        t.append(_any([who.contains(k) for k in words(q["company"])]))
    if q.get("posted_within"):
        t.append(posted_within("posted_at", "first_seen", now, q["posted_within"]))
    return all_of(t)


# ---------------------------------------------------------------- V08 stores

def store_filter(q: dict, now: Column) -> Column:
    """Twenty store predicates; counts missing are zero, prices missing fail."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    day = lambda n: now - F.make_dt_interval(F.lit(n))
    t = []
    add = t.append
    if q.get("seen_after") is not None:
        add(F.col("first_seen") > F.lit(q["seen_after"]))
    if q.get("found_within"):
        add(F.col("first_seen") >= day(q["found_within"]))
    if words(q.get("countries")):
        add(in_set("country", q["countries"], upper=True))
    if words(q.get("currencies")):
        add(in_set("currency", q["currencies"], upper=True))
    if words(q.get("ships_to")):
        add(array_in_set("ships_to", q["ships_to"], "*", "upper"))
    if words(q.get("languages")):
        add(_any([F.col("language").startswith(x) for x in words(q["languages"])]))
    if q.get("min_products") is not None:
        add(zero("product_count") >= q["min_products"])
    if q.get("max_products") is not None:
        add(zero("product_count") <= q["max_products"])
    if q.get("min_median_price") is not None:
        add(F.col("price_median") >= q["min_median_price"])
    if q.get("max_median_price") is not None:
        add(F.col("price_median") <= q["max_median_price"])
    if q.get("active_within"):
        add(F.col("newest_product") >= day(q["active_within"]))
    if q.get("min_added"):
        add(F.col("added_30d") >= q["min_added"])
    if q.get("require_email"):
        add(F.size("emails") > 0)
    if q.get("require_phone"):
        add(F.size("phones") > 0)
    for net in words(q.get("socials")):
        add(F.col("socials")[net].isNotNull())
    if words(q.get("apps")):
        add(array_in_set("apps", q["apps"]))
    if words(q.get("themes")):
        add(_any([F.lower("theme").contains(x) for x in words(q["themes"])]))
    if words(q.get("location")):
        add(keyword_match(search_text(text_parts(F.col("city"), F.col("province"))), q["location"]))
    text = search_text(
        text_parts(F.col("name"), F.col("description"), F.col("domain")),
        F.transform("product_types", lambda x: x["name"]),
        F.transform("vendors", lambda x: x["name"]),
    )
    if words(q.get("keywords")):
        add(keyword_match(text, q["keywords"]))
    if words(q.get("exclude")):
        add(~keyword_match(text, q["exclude"]))
    return all_of(t)


# ---------------------------------------------------------------- V09 hospitals, V10 filings

def health_filter(q: dict) -> Column:
    """Predicates on a posting joined to its system and tags."""
    t = []
    if words(q.get("systems")):
        t.append(_any([F.lower("system_name").contains(s) | F.lower("company_name").contains(s) for s in words(q["systems"])]))
    if words(q.get("states")):
        t.append(in_set("system_state", q["states"], upper=True))
    if q.get("min_beds"):
        t.append(F.col("system_beds") >= q["min_beds"])
    if q.get("min_hourly"):
        t.append((F.col("pay_period") == "hour") & (F.coalesce("pay_max", "pay_min", F.lit(0)) >= q["min_hourly"]))
    if q.get("families"):
        t.append(F.col("role_family").isin(*q["families"]))
    if q.get("specialties"):
        t.append(F.arrays_overlap("specialties", F.array(*map(F.lit, q["specialties"]))))
    if q.get("employment"):
        t.append(F.col("employment").isin(*q["employment"]))
    if q.get("shifts"):
        t.append(F.arrays_overlap("shift", F.array(*map(F.lit, q["shifts"]))))
    if q.get("only_bonus") or q.get("min_bonus"):
        t.append(F.col("sign_on_bonus"))
    if q.get("min_bonus"):
        t.append(F.coalesce("sign_on_bonus_amount", F.lit(0)) >= q["min_bonus"])
    return all_of(t)


def filing_filter(q: dict, year: Column) -> Column:
    """New or amended, companies or funds, sector or industry, amounts, age of the company."""
    t = []
    if not q.get("amendments"):
        t.append(F.col("filing_type") != "Amendment")
    kind = q.get("company_type", "companies")
    if kind != "all":
        t.append(F.col("is_fund") == (kind == "funds"))
    if words(q.get("sectors")):
        t.append(F.lower("sector").isin(*words(q["sectors"])) | F.lower("industry").isin(*words(q["sectors"])))
    if q.get("min_raised"):
        t.append(F.coalesce("amount_sold", F.lit(0)) >= q["min_raised"])
    if q.get("min_offering"):
        t.append(F.col("indefinite") | (F.coalesce("offering", F.lit(0)) >= q["min_offering"]))
    n = q.get("incorporated_within")
    if n:
        young = (F.col("incorporated_within") == "Yet to be formed") | ((F.col("incorporated_within") == "Within five years") & F.lit(n >= 5))
        t.append(F.when(F.col("year_of_incorporation").isNotNull(), F.col("year_of_incorporation") >= year - n).otherwise(young))
    return all_of(t)


# ---------------------------------------------------------------- V11 light pre-filter

def prefilter(q: dict) -> Column:
    """"yes", "no" or "maybe" from a light list row (`title`, `posted_text`, `places`); only "maybe" needs the heavy row."""
    from .text import min_age_days

    no = []
    if words(q.get("title")):
        no.append(~keyword_match("title", q["title"]))
    if q.get("posted_within"):
        age, n = min_age_days("posted_text"), q["posted_within"]
        no.append(F.coalesce((age > n) | (F.col("posted_text").contains("+") & (age >= n)), F.lit(False)))
    hidden = F.lower(F.coalesce("places", F.lit(""))).rlike(r"^\d+ locations?$")
    maybe = F.lit(bool(q.get("remote_only") or q.get("needs_pay")))
    if words(q.get("location")):
        no.append(~hidden & ~keyword_match(F.coalesce("places", F.lit("")), q["location"]))
        maybe = maybe | hidden
    refused = _any(no) if no else F.lit(False)
    return F.when(refused, "no").when(maybe, "maybe").otherwise("yes")


# ---------------------------------------------------------------- V17 market

# Topics left out of the market reports.
BARRED_TOPICS = (
    r"(?i)instagram|linkedin|facebook|tiktok|twitter|threads|x\.com|meta-|whatsapp|youtube|reddit|zoominfo|apollo|lusha|indeed"
    r"|glassdoor|naukri|crunchbase|yelp|tripadvisor|zillow"
)
BARRED_WORDS = [
    "instagram", "tiktok", "facebook", "linkedin", "twitter", "tweet", "youtube", "threads", "truthsocial", "douyin", "xiaohongshu",
    "amazon", "ebay", "walmart", "etsy", "aliexpress", "zillow", "airbnb", "booking", "redfin", "realtor", "idealista", "rightmove",
    "otodom", "indeed", "glassdoor", "naukri", "yelp", "tripadvisor", "google", "apollo", "crunchbase", "leads", "email",
]


def weak_incumbent(users="users", rating="rating", reviews="reviews", failures: str | None = None, min_users=100, below=4.3, min_reviews=10) -> Column:
    """Demand with a badly rated or often failing product."""
    bad = (F.coalesce(rating, F.lit(0)) < below) & (F.coalesce(reviews, F.lit(0)) >= min_reviews)
    if failures:
        bad = bad | (F.coalesce(failures, F.lit(0.0)) > 0.20)
    return (F.coalesce(users, F.lit(0)) >= min_users) & bad


def barred_topic(*cols: Column | str, pattern: str = BARRED_TOPICS) -> Column:
    return F.concat_ws(" ", *[_c(c) for c in cols]).rlike(pattern)
