"""String and HTML scalars. Everything here is a plain Column expression.

Blank characters: JavaScript-style blanks include the no-break space, which Java's ``\\s`` leaves out,
so `BLANK` names it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\u00a0\ufeff]"

# Longest description kept, remote-work words (boards with an own workplace field use "virtual").
REMOTE_BOARD = r"(?i)\bremote\b|\bwork from home\b|\bwfh\b|\bdistributed\b|\banywhere\b"
REMOTE_SITE = r"(?i)\bremote\b|\bwork from home\b|\bwfh\b|\bvirtual\b|\banywhere\b"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def replace_all(col: Column, *pairs: tuple[str, str]) -> Column:
    for pattern, repl in pairs:
        col = F.regexp_replace(col, pattern, repl)
    return col


def trimmed(col: Column | str) -> Column:
    return F.regexp_replace(_c(col), rf"^{BLANK}+|{BLANK}+$", "")


def blank_to_null(col: Column | str) -> Column:
    t = trimmed(col)
    return F.when(t != "", t)


def first_text(*cols: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def join_present(sep: str, *cols: Column) -> Column:
    """Join the non-empty parts; null when nothing is left."""
    parts = F.filter(F.array(*cols), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(parts) > 0, F.array_join(parts, sep))


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with the value worked out once, however often ``fn`` names it."""
    return F.get(F.transform(F.array(value), fn), 0)


def map_matches(col: Column, pattern: str, fn: Callable[[Column], Column]) -> Column:
    """Replace every match by ``fn(match)`` in one pass (regexp_replace cannot compute its replacement)."""
    parts = F.split(col, pattern, -1)
    hits = F.regexp_extract_all(col, F.lit(pattern), F.lit(0))
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(fn(F.get(hits, i)), F.lit("")))), "")


def code_point(code: Column) -> Column:
    """Character of a code point; null for surrogates and out-of-range values."""
    ok = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


# ---------------------------------------------------------------- T01 / T02 HTML and entities

_NAMED = [(r"&nbsp;|\u00a0", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;|&rsquo;", "'"), ("&quot;|&ldquo;|&rdquo;", '"')]


def shortened(col: Column, limit: int | None) -> Column:
    """The first `limit` characters, where a limit is asked for."""
    return col if limit is None else F.left(col, F.lit(limit))


def html_to_text(col: Column | str, limit: int | None = None) -> Column:
    """HTML fragment to text: blocks end lines, list items get a dash, tags go, blanks collapse.

    Each group of rules runs only on texts that hold what it looks for.
    """
    tags = lambda c: replace_all(
        c,
        (r"(?is)<script.*?</script>", ""),
        (r"(?is)<style.*?</style>", ""),
        (r"(?i)<br\s*/?>", "\n"),
        (r"(?i)</(p|div|li|h[1-6])>", "\n"),
        (r"(?i)<li[^>]*>", "- "),
        (r"<[^>]+>", ""),
    )
    blanks = lambda c: replace_all(c, (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " "))
    c = let(F.coalesce(_c(col), F.lit("")), lambda x: F.when(x.contains("<"), tags(x)).otherwise(x))
    c = let(c, lambda x: F.when(x.contains("&") | x.contains("\u00a0"), replace_all(x, *_NAMED)).otherwise(x))
    c = let(c, lambda x: F.when(x.rlike(r"[ \t][ \t\n]|\n{3}"), blanks(x)).otherwise(x))
    return shortened(trimmed(c), limit)


def board_html_to_text(col: Column | str, limit: int | None = None) -> Column:
    """The board variant: no list dash, and only a closing ``br`` ends a line."""
    named = [(r"&nbsp;", " "), *_NAMED[1:]]
    c = replace_all(
        F.coalesce(_c(col), F.lit("")),
        (r"(?is)<script.*?</script>", ""),
        (r"(?is)<style.*?</style>", ""),
        (r"(?i)</(p|div|li|h[1-6]|br)>", "\n"),
        (r"<[^>]+>", ""),
        *named,
        (r"\n{3,}", "\n\n"),
        (r"[ \t]{2,}", " "),
    )
    return shortened(trimmed(c), limit)


def decode_markup(col: Column | str) -> Column:
    """Undo one level of entity encoding around markup: named, then numeric, ``&amp;`` last."""
    c = replace_all(_c(col), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'))
    c = map_matches(c, r"&#\d+;", lambda m: F.coalesce(code_point(F.regexp_extract(m, r"\d+", 0).try_cast("bigint")), m))
    return F.regexp_replace(c, "&amp;", "&")


def decode_entities(col: Column | str) -> Column:
    """XML entities, decimal and hex references, in one pass; unknown names stay."""
    named = F.create_map(*[F.lit(x) for kv in [("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")] for x in kv])

    def resolve(m: Column) -> Column:
        body = F.regexp_extract(m, r"&(.*);", 1)
        hexa = F.conv(F.regexp_extract(body, r"(?i)^#x([0-9a-f]+)$", 1), 16, 10).try_cast("bigint")
        dec = F.regexp_extract(body, r"^#(\d+)$", 1).try_cast("bigint")
        return F.coalesce(
            F.when(body.rlike("(?i)^#x"), code_point(hexa)).when(body.startswith("#"), code_point(dec)),
            F.try_element_at(named, F.lower(body)),
            m,
        )

    return map_matches(_c(col), r"(?i)&(?:#x[0-9a-f]+|#\d+|[a-z]+);", resolve)


def xml_text(col: Column | str) -> Column:
    """Text of a feed element: CDATA marks off, the five usual entities decoded."""
    return replace_all(
        _c(col), (r"^<!\[CDATA\[|\]\]>$", ""), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#0?39;", "'"), ("&amp;", "&")
    )


def strip_tags(col: Column | str) -> Column:
    return trimmed(F.regexp_replace(xml_text(F.regexp_replace(_c(col), "<[^>]+>", " ")), rf"{BLANK}+", " "))


def decode_name(col: Column | str) -> Column:
    """Names as they arrive: ``\\u0026`` escapes and the common entities."""
    c = map_matches(_c(col), r"(?i)\\u[0-9a-f]{4}", lambda m: code_point(F.conv(F.substring(m, 3, 4), 16, 10).try_cast("bigint")))
    return trimmed(replace_all(c, ("&amp;", "&"), ("&#x27;|&#39;|&apos;", "'"), ("&quot;", '"'), (rf"{BLANK}+", " ")))


# ---------------------------------------------------------------- T03 / T04 dates

_DATE_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]",
    "dd MMM yyyy HH:mm:ss Z",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d MMM yyyy",
    "M/d/yyyy",
    "yyyy-MM-dd HH:mm:ss 'UTC'",
]


def parse_date(col: Column | str) -> Column:
    """Timestamp (UTC) of any date text the sources use, null when it is none."""
    c = F.regexp_replace(trimmed(col), r"^[A-Za-z]{3}, ", "")
    c = F.regexp_replace(c, r" GMT$", " +0000")
    plain = F.when(c.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?($|[T ])"), F.try_to_timestamp(c))
    return F.coalesce(plain, *[F.try_to_timestamp(c, F.lit(f)) for f in _DATE_FORMATS])


def iso_or_null(col: Column | str) -> Column:
    return F.date_format(parse_date(col), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _days_ago(col: Column | str, plus_ok: bool) -> Column:
    t = F.lower(_c(col))
    n = F.regexp_extract(t, r"(\d+)(\+)?\s*days?\s*ago", 1).try_cast("int")
    if not plus_ok:
        n = F.when(F.regexp_extract(t, r"(\d+)(\+)?\s*days?\s*ago", 2) != "+", n)
    return F.when(t.contains("today"), F.lit(0)).when(t.contains("yesterday"), F.lit(1)).otherwise(n)


def posted_on(col: Column | str, now: Column) -> Column:
    """"Posted 3 Days Ago" to a date; "30+ Days" has no date."""
    return F.date_sub(F.to_date(now), _days_ago(col, plus_ok=False))


def min_age_days(col: Column | str) -> Column:
    """Lowest age the text allows: "30+ Days Ago" is at least 30."""
    return _days_ago(col, plus_ok=True)


# ---------------------------------------------------------------- T05 remote

def is_remote(*cols: Column, words: str = REMOTE_SITE) -> Column:
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols]).rlike(words)


# ---------------------------------------------------------------- T06 / T07 names and addresses of companies

def display_name(name: Column | str, ident: Column | str) -> Column:
    words = F.filter(F.split(_c(ident), "[-_]+"), lambda w: w != "")
    pretty = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")
    n = _c(name)
    return F.when((n != "") & (n != _c(ident)), n).otherwise(pretty)


def url_origin(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"(?i)^(https?://[^/?#\s]+)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"(?i)^https?://[^/?#\s]+([^?#]*)", 1)


# Where each hosted board lives, and the path parts that end a company's own site.
HOSTED_BOARDS = {
    "greenhouse": ("https://job-boards.greenhouse.io/", ""),
    "lever": ("https://jobs.lever.co/", ""),
    "ashby": ("https://jobs.ashbyhq.com/", ""),
    "workable": ("https://apply.workable.com/", "/"),
    "rippling": ("https://ats.rippling.com/", "/jobs"),
}
OWN_SITES = ("personio", "bamboohr", "breezy", "teamtailor", "recruitee")
OWN_MARKERS = ("/job/", "/careers/", "/p/", "/jobs/", "/o/")


def career_site_url(source: Column | str, ident: Column | str, url: Column | str) -> Column:
    """A company's job page, worked out from one of its job links."""
    u = _c(url)
    parts = F.struct(_c(source).alias("s"), _c(ident).alias("i"), u.alias("u"), url_origin(u).alias("origin"), url_path(u).alias("path"))

    def site(x: Column) -> Column:
        s, origin, path = x["s"], x["origin"], x["path"]

        def upto(marker: str) -> Column:
            head = F.substring_index(path, marker, 1)
            return F.when(F.contains(path, F.lit(marker)), F.concat(origin, F.when(head == "", "/").otherwise(head)))

        out = F.when(origin.isNull(), x["u"])
        for name, (pre, post) in HOSTED_BOARDS.items():
            out = out.when(s == name, F.concat(F.lit(pre), x["i"], F.lit(post)))
        own = F.regexp_replace(F.coalesce(*map(upto, OWN_MARKERS), origin), "/$", "")
        return (
            out.when(s == "smartrecruiters", F.concat_ws("/", origin, F.nullif(F.get(F.split(path, "/"), 1), F.lit(""))))
            .when(s.isin("workday", "jobvite", "oracle"), F.coalesce(upto("/job/"), origin))
            .when(s == "ukg", F.concat(origin, F.regexp_extract(path, r"^(.*/JobBoard/[^/]+)", 1)))
            .when(s == "bamboohr", F.concat(own, F.lit("/careers")))
            .when(s.isin(*OWN_SITES), own)
            .otherwise(origin)
        )

    return let(parts, site)


# ---------------------------------------------------------------- T08 places

def clean_place(col: Column | str) -> Column:
    """Comma parts trimmed, blanks dropped, repeats of the last part dropped."""
    parts = F.filter(
        F.transform(F.split(_c(col), ","), lambda x: trimmed(F.regexp_replace(x, r"[\u200b\u00a0]", " "))), lambda x: x != ""
    )
    n = F.size(parts)
    return F.array_join(F.filter(parts, lambda x, i: (i == n - 1) | (x != F.element_at(parts, -1))), ", ")


def dashed_place(col: Column | str) -> Column:
    """"US-GA-Covington" to "Covington, GA, US"; other text stays."""
    return F.regexp_replace(_c(col), r"^([A-Z]{2})-([A-Z]{2})-(.+)$", "$3, $2, $1")


def city_state(col: Column | str) -> Column:
    """"Columbus, OH 43215" to "Columbus, OH"; other text stays."""
    hit = F.regexp_extract(_c(col), r"^[^,]+, [A-Z]{2}\b", 0)
    return F.when(hit != "", hit).otherwise(_c(col))


def place_not_count(col: Column | str) -> Column:
    """"3 Locations" names no place."""
    t = replace_all(_c(col), (r"\s+,", ","))
    return F.when(~t.rlike(r"(?i)^\d+ locations?$") & (t != ""), t)


# ---------------------------------------------------------------- T09 / T10 company names

# Legal forms dropped from the end of a name, labels that are no company name, and accounts that are not real.
LEGAL_FORMS = (
    r"GmbH\s*&\s*Co\.?\s*KG|SE\s*&\s*Co\.?\s*KG|GmbH|AG|SE|KG|Ltd\.?|Limited|Inc\.?|LLC|B\.V\.|BV|S\.L\.U?\.?|S\.A\.S?\.?"
    r"|S\.r\.l\.|Sp\. z o\.o\.|Oy|AB|ApS|A/S"
)
GENERIC_LABEL = (
    r"(?i)^(default|all|current|current opportunities|careers?|career opportunities|career site|opportunities|jobs|job board"
    r"|job opportunities|job openings|current openings|all openings|all jobs|search jobs|external|external careers|internal"
    r"|corporate|stores?|retail|hourly|salaried|field|english|spanish|apply|join (?:us|our team)|en|us|usa|board|postings?)$"
)
NOT_REAL = r"(?i)\b(trial|demo|sandbox|test|testing|staging|example|dummy)\b"
NOT_REAL_SLUG = r"(?i)[-_](review|preview|old|copy|internal|uat|qa)$"
NOT_PUBLIC = r"(?i)internal|non-?_?public|nonwd|employee|referral|private|confidential|displaced|direct_appointment"
NOT_PRODUCTION = r"(?i)-(dev|test|tst|stg|stage|staging|uat|sit|qa|pre|preprod|demo|sandbox|trn|train)\d*$"


def clean_legal_name(col: Column | str) -> Column:
    return trimmed(F.regexp_replace(_c(col), rf"(?i)\s*(?:,\s*)?\b({LEGAL_FORMS})\s*$", ""))


def strip_board_words(col: Column | str) -> Column:
    """Drop phrases of a board's internal label; a label of nothing else comes back empty."""
    c = replace_all(
        _c(col),
        (r"(?i)\((?:all-[^)]*|default)\)", ""),
        (r"(?i)^recruiting\s*-\s*", ""),
        (r"(?i)\s*-?\s*\b(?:main\s+|external\s+)?job\s+board\b.*$", ""),
        (r"(?i)\b(?:new\s+)?(?:re)?branding(?:\s+\d{4})?\b", ""),
        (r"(?i)\bdefault\b", ""),
        (r"(?i)^\s*external\s+|\s+external\s*$", ""),
        (r"^[\s-]+|[\s-]+$", ""),
        (r"\s+", " "),
    )
    return F.when(_c(col).rlike("(?i)template"), "").otherwise(F.regexp_replace(trimmed(c), r"^\((.+)\)$", "$1"))


def tidy_company(col: Column | str) -> Column:
    return clean_legal_name(strip_board_words(trimmed(F.regexp_replace(decode_name(col), r"(?i)\s+opt(?:ion)?\s*\d+$", ""))))


def is_generic_label(col: Column | str) -> Column:
    return _c(col).rlike(GENERIC_LABEL)


def name_from_title(html: Column | str) -> Column:
    """Company name from a page title such as "Acme Careers"."""
    t = F.regexp_extract(_c(html), r"(?i)<title>([^<]*)</title>", 1)
    n = replace_all(
        decode_name(t),
        (r"(?i)\s*[|:–-]\s*(jobvite|careers?|jobs).*$", ""),
        (r"(?i)\b(career opportunities|job opportunities|careers? (?:site|page)|careers?|jobs|job openings|openings)\b", ""),
        (r"[\s|:–-]+$", ""),
        (r"\s+", " "),
    )
    n = trimmed(n)
    return F.when((F.length(n) > 1) & ~is_generic_label(n), n)


def name_from_logo(html: Column | str) -> Column:
    """Company name from the first logo text that is not a browser's."""
    alts = F.regexp_extract_all(_c(html), F.lit(r'alt="([^"]+)"'), F.lit(1))
    logo = F.get(F.filter(alts, lambda a: ~a.rlike(r"(?i)\b(chrome|firefox|internet explorer|safari|edge|opera)\b")), 0)
    n = trimmed(replace_all(logo, (r"(?i)\b(brand|logo|image|img|header|banner)\b", ""), (r"\s+", " ")))
    tidy = tidy_company(n)
    return F.when((F.length(n) > 1) & ~is_generic_label(n) & (F.length(tidy) > 1), tidy)


def is_real(name: Column | str, slug: Column | str) -> Column:
    return ~(_c(name).rlike(NOT_REAL) | _c(slug).rlike(NOT_REAL) | _c(slug).rlike(NOT_REAL_SLUG))


def is_public_site(site: Column | str) -> Column:
    return ~_c(site).rlike(NOT_PUBLIC)


def is_production_host(host: Column | str) -> Column:
    return ~F.substring_index(_c(host), ".", 1).rlike(NOT_PRODUCTION)


# ---------------------------------------------------------------- T11 / T12 slugs and company entries

def slug_candidates(col: Column | str) -> Column:
    base = F.lower(trimmed(col))
    alnum = F.regexp_replace(base, "[^a-z0-9]", "")
    dashed = replace_all(base, ("[^a-z0-9]+", "-"), ("^-|-$", ""))
    return F.filter(F.array_distinct(F.array(alnum, dashed, base)), lambda s: F.length(s).between(2, 60))


def parse_entry(col: Column | str) -> Column:
    """A pasted company entry to ``struct<ats, slug, host, site, skip>``: board link, career-site link or bare name."""
    fields = ("ats", "slug", "host", "site", "skip")

    def out(**given) -> Column:
        as_col = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
        return F.struct(*[as_col(given.get(f)).alias(f) for f in fields])

    def read_url(raw: Column) -> Column:
        url = F.when(raw.rlike("(?i)^https?://"), raw).otherwise(F.concat(F.lit("https://"), raw))
        return F.struct(
            raw.alias("raw"),
            F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^@/]*@)?([^/:?#\s]+)", 1)).alias("host"),
            F.filter(F.split(url_path(url), "/"), lambda p: p != "").alias("parts"),
        )

    def judge(x: Column) -> Column:
        raw, host, parts = x["raw"], x["host"], x["parts"]
        board = (
            F.when(host.rlike(r"(^|\.)greenhouse\.io$"), "greenhouse")
            .when(host.rlike(r"(^|\.)lever\.co$"), "lever")
            .when(host.rlike(r"(^|\.)ashbyhq\.com$"), "ashby")
        )
        linky = raw.rlike(r"(?i)^https?://") | raw.rlike(r"(?i)^[a-z0-9.-]+\.(io|co|com)/")
        api_at = F.array_position(F.transform(parts, lambda p: p.isin("boards", "postings", "job-board")), F.lit(True))
        slug = F.lower(F.nullif(F.get(parts, F.when(api_at > 0, api_at).otherwise(0).cast("int")), F.lit("")))
        # A leading locale segment of a career site is presentation only.
        path = F.when(F.get(parts, 0).rlike(r"(?i)^[a-z]{2}(-[a-z]{2})?$"), F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
        own_host = host.rlike(r"^[a-z0-9-]+\.wd\d+\.myworkdayjobs\.com$") & (F.size(path) > 0)
        shared_host = host.rlike(r"^wd\d+\.myworkdaysite\.com$") & (F.get(path, 0) == "recruiting") & (F.size(path) >= 3)
        bare = F.regexp_replace(F.lower(raw), rf"{BLANK}+", "")
        return (
            F.when(F.coalesce(raw, F.lit("")) == "", out(skip="empty entry"))
            .when(own_host, out(ats="workday", slug=F.substring_index(host, ".", 1), host=host, site=F.get(path, 0)))
            .when(shared_host, out(ats="workday", slug=F.get(path, 1), host=host, site=F.get(path, 2)))
            .when(linky & board.isNotNull() & slug.isNotNull(), out(ats=board, slug=slug))
            .when(bare.rlike("[/?#]"), out(skip="not a company slug or job-board link"))
            .otherwise(out(slug=bare))
        )

    return let(let(trimmed(col), read_url), judge)


# ---------------------------------------------------------------- T21 / T42 / T48 / T49 / T50

def norm_text(col: Column | str) -> Column:
    """Dashes, no-break blanks and leftover references made plain before figures are read."""
    return replace_all(
        _c(col),
        (r"(?i)&mdash;|&#8212;|&#x2014;", "—"),
        (r"(?i)&ndash;|&#8211;|&#x2013;", "–"),
        (r"(?i)&nbsp;|&#160;|\u00a0", " "),
        (r"(?i)&amp;", "&"),
        (r"(?i)&#x?[0-9a-f]+;", " "),
        (r"[ \t]+", " "),
    )


def tidy_name(col: Column | str) -> Column:
    """Names filed in capitals get title case; mixed-case names stay."""

    def title_case(v: Column) -> Column:
        words = map_matches(F.lower(v), r"(?:^|[\s'-])\p{L}", F.upper)
        return F.when((v != F.upper(v)) | ~v.rlike("[A-Z]"), v).otherwise(map_matches(words, r"\b(?:Ii|Iii|Iv|Llc|Lp|Inc)\b", F.upper))

    return let(trimmed(F.regexp_replace(_c(col), rf"{BLANK}+", " ")), title_case)


def us_phone(col: Column | str) -> Column:
    d = F.regexp_replace(_c(col), r"\D", "")
    d = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    usa = F.concat(F.lit("+1 "), F.substring(d, 1, 3), F.lit("-"), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4))
    return F.when(_c(col) == "", None).when(F.length(d) == 10, usa).otherwise(trimmed(col))


def not_placeholder(col: Column | str) -> Column:
    """"None", "N/A" and dashes mean nothing was given."""
    return F.when(~_c(col).rlike(r"(?i)^(none|n/a|na|-+|\.)$"), _c(col))


def client_key(ip: Column | str, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), _c(ip)), 256)


def url_host(url: Column | str) -> Column:
    return F.nullif(F.lower(F.regexp_extract(_c(url), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^@/]*@)?([^/:?#\s]+)", 1)), F.lit(""))


def host_key(host: Column | str) -> Column:
    """The company part of a host: the label before the top level."""
    parts = F.split(F.lower(_c(host)), r"\.")
    return F.when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 2)).otherwise(F.lower(_c(host)))


def last_segment(url: Column | str) -> Column:
    return F.element_at(F.filter(F.split(url_path(_c(url)), "/"), lambda p: p != ""), -1)


def json_get(col: Column | str, path: str) -> Column:
    return F.get_json_object(_c(col), path)


def json_set(col: Column | str, schema: str, field: str, value: Column) -> Column:
    """One field of a JSON text replaced, the rest kept as `schema` reads it."""
    return F.to_json(F.from_json(_c(col), schema).withField(field, value))


# ---------------------------------------------------------------- misc shared

def js_round(col: Column, digits: int = 0) -> Column:
    """Half-up rounding of the binary value (not of its decimal text, as SQL ``round`` does)."""
    p = 10**digits
    out = F.floor(col * F.lit(float(p)) + F.lit(0.5))
    return out if digits == 0 else out.cast("double") / F.lit(float(p))


def normal_key(col: Column | str) -> Column:
    """Case and punctuation dropped, for exact look-ups by name."""
    return F.regexp_replace(F.lower(_c(col)), "[^a-z0-9]", "")
