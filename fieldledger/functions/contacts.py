"""Facts of a captured page: emails, phones, social profiles, technology tags, theme, language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, replace_all, trimmed

# Address shapes, addresses that reach nobody, profile links and the paths that are not profiles, technology tags.
EMAIL = r"(?i)[a-z0-9][a-z0-9._%+-]{0,63}@[a-z0-9.-]+\.[a-z]{2,24}"
VALID_EMAIL = r"(?i)^[a-z0-9][a-z0-9._%+-]{0,63}@[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,24}$"
JUNK_EMAIL = (
    r"(?i)\.(png|jpe?g|webp|svg|gif|css|js|avif)$|@(\d+x|2x)|sentry|wixpress|godaddy"
    r"|@(example|domain|email|yourdomain|yourstore|company|test)\."
    r"|^(your|name|you|user|email|someone|john|jane|no-?reply|do-?not-?reply|mailer-daemon|postmaster)@"
    r"|@shopify\.com$|@myshopify\.com$|\\u00|u003e"
)
LINK_END = r"(?=[\"'?#\s<])"
SOCIAL = {
    "instagram": (r"https?://(?:www\.)?instagram\.com/([A-Za-z0-9_.]{2,30})/?", r"^(p|reel|reels|explore|stories|accounts|shopify)$"),
    "facebook": (
        r"https?://(?:www\.|m\.)?facebook\.com/([A-Za-z0-9_.\-]{2,80})/?",
        r"^(sharer|sharer\.php|share|plugins|dialog|tr|shopify|profile\.php|groups|events|watch)$",
    ),
    "tiktok": (r"https?://(?:www\.)?tiktok\.com/(@[A-Za-z0-9_.]{2,30})/?", r"^@shopify$"),
    "youtube": (r"https?://(?:www\.)?youtube\.com/((?:@|c/|channel/|user/)[A-Za-z0-9_.\-]{2,60})/?", r"^@?shopify$"),
    "pinterest": (r"https?://(?:[a-z]{2}\.|www\.)?pinterest\.[a-z.]+/([A-Za-z0-9_]{2,40})/?", r"^(pin|search|shopify)$"),
    "twitter": (r"https?://(?:www\.)?(?:twitter|x)\.com/([A-Za-z0-9_]{2,15})/?", r"^(intent|share|home|shopify|i)$"),
    "linkedin": (r"https?://(?:[a-z]{2,3}\.)?linkedin\.com/((?:company|in)/[A-Za-z0-9_\-%.]{2,80})/?", r"^$"),
}
APPS = [
    ("Klaviyo", r"klaviyo\.com"),
    ("Omnisend", r"omnisnippet|omnisend\.com"),
    ("Mailchimp", r"chimpstatic\.com|list-manage\.com"),
    ("Privy", r"privy\.com/collect"),
    ("Attentive", r"attn\.tv|attentivemobile"),
    ("Postscript", r"postscript\.io"),
    ("Judge.me", r"judge\.me"),
    ("Yotpo", r"yotpo\.com"),
    ("Loox", r"loox\.io"),
    ("Okendo", r"okendo\.io"),
    ("Stamped", r"stamped\.io"),
    ("ReCharge", r"rechargecdn|rechargepayments|rechargeapps"),
    ("Rebuy", r"rebuyengine"),
    ("Smile.io", r"smile\.io"),
    ("LoyaltyLion", r"loyaltylion"),
    ("Gorgias", r"gorgias"),
    ("Tidio", r"tidio\.co"),
    ("Zendesk", r"zdassets\.com"),
    ("Afterpay", r"afterpay"),
    ("Klarna", r"klarna"),
    ("PageFly", r"pagefly"),
    ("GemPages", r"gempages"),
    ("Shogun", r"getshogun|shogun\.io"),
    ("Weglot", r"weglot"),
    ("Route", r"routeapp|route\.com/sdk"),
    ("AfterShip", r"aftership"),
    ("Hotjar", r"hotjar"),
    ("Meta Pixel", r"connect\.facebook\.net/[^\"']*fbevents"),
    ("TikTok Pixel", r"analytics\.tiktok\.com"),
    ("Google Analytics", r"googletagmanager\.com/gtag|google-analytics\.com"),
]


def percent_decoded(col: Column) -> Column:
    """Percent escapes decoded (a plus stays a plus); a malformed text is kept."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(col, r"\+", "%2B")), col)


def emails(html: Column | str, limit: int | None = None) -> Column:
    h = _c(html)
    links = F.transform(F.regexp_extract_all(h, F.lit(r"(?i)mailto:([^\"'?\s<>]+)"), F.lit(1)), lambda m: F.lower(percent_decoded(m)))
    loose = F.transform(F.regexp_extract_all(h, F.lit(EMAIL), F.lit(0)), F.lower)
    good = F.filter(F.array_distinct(F.concat(links, loose)), lambda e: e.rlike(VALID_EMAIL) & ~e.rlike(JUNK_EMAIL))
    return good if limit is None else F.slice(good, 1, limit)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def phones(html: Column | str, limit: int | None = None) -> Column:
    """Numbers of ``tel:`` links, 7 to 15 digits, the first spelling of each number."""
    raw = F.regexp_extract_all(_c(html), F.lit(r"(?i)href=[\"']tel:([^\"']+)[\"']"), F.lit(1))
    raw = F.transform(raw, lambda m: trimmed(F.regexp_replace(percent_decoded(m), r"[\s ]+", " ")))
    ok = F.filter(raw, lambda x: F.length(_digits(x)).between(7, 15))
    nums = F.transform(ok, _digits)
    first = F.filter(ok, lambda x, i: F.array_position(nums, _digits(x)) == i + 1)
    return first if limit is None else F.slice(first, 1, limit)


def _not_handle(pattern: str, skip: str):
    return lambda u: ~F.regexp_extract(u, "(?i)" + pattern, 1).rlike("(?i)" + skip)


def socials(html: Column | str) -> Column:
    """One link per network: the first that is neither a share link nor the platform's own."""
    out = []
    for net, (pattern, skip) in SOCIAL.items():
        links = F.regexp_extract_all(_c(html), F.lit("(?i)" + pattern + LINK_END), F.lit(0))
        own = F.filter(links, _not_handle(pattern, skip))
        out.append(replace_all(F.get(own, 0), ("^http:", "https:"), ("/$", "")).alias(net))
    return F.struct(*out)


def apps(html: Column | str) -> Column:
    return F.array_compact(F.array(*[F.when(_c(html).rlike("(?i)" + p), F.lit(n)) for n, p in APPS]))


def theme(html: Column | str) -> Column:
    h = _c(html)
    hit = [
        F.nullif(F.regexp_extract(h, rf'Shopify\.theme\s*=\s*\{{[^}}]*?"{k}"\s*:\s*"([^"]+)"', 1), F.lit(""))
        for k in ("schema_name", "name")
    ]
    return trimmed(F.regexp_replace(F.coalesce(*hit), r"\\/", "/"))


def page_language(html: Column | str) -> Column:
    hit = F.regexp_extract(_c(html), r"(?i)<html[^>]*\slang=[\"']?([A-Za-z]{2,3}(?:-[A-Za-z0-9]{2,8})?)", 1)
    return F.lower(F.nullif(hit, F.lit("")))


def page_facts(html: Column | str, final_url: Column | None = None) -> Column:
    url = F.coalesce(final_url, F.lit("")) if final_url is not None else F.lit("")
    return F.struct(
        emails(html).alias("emails"),
        phones(html).alias("phones"),
        socials(html).alias("socials"),
        theme(html).alias("theme"),
        apps(html).alias("apps"),
        page_language(html).alias("language"),
        (url.rlike(r"/password(\?|$)") | _c(html).rlike("(?i)template-password|password-page")).alias("password_protected"),
    )


def merge_pages(first: Column, second: Column) -> Column:
    """Contact details of two pages, the first page's first; its other facts stand."""
    both = first.withField("emails", F.array_union(first["emails"], second["emails"]))
    both = both.withField("phones", F.array_union(first["phones"], second["phones"]))
    both = both.withField("socials", F.struct(*[F.coalesce(first["socials"][n], second["socials"][n]).alias(n) for n in SOCIAL]))
    return F.when(second.isNull(), first).otherwise(both)
