r"""Text operators T01-T50 over the given tables.

Where the tables hold no text of the kind (pay lines, clinical titles, contact links), Spark writes it from the
tables' own values row by row, and the SQL states what must be read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import clinical, contacts, labels, notes, pay, text as T, versions as V
from .registry import query


def table(spark, d, name):
    return A.table(spark, d, name)

TRIM = r"regexp_replace({}, '^[\s\x{{00A0}}\x{{FEFF}}]+|[\s\x{{00A0}}\x{{FEFF}}]+$', '', 'g')"


def _chain(col: str, steps) -> str:
    for p, r in steps:
        r = r.replace("'", "''")
        col = f"regexp_replace({col}, '{p}', " + (f"'{r}'" if "\n" not in r else "'" + r.replace("\n", "' || chr(10) || '") + "'") + ", 'g')"
    return col


HTML_STEPS = [
    (r"(?is)<script.*?</script>", ""), (r"(?is)<style.*?</style>", ""), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</(p|div|li|h[1-6])>", "\n"), (r"(?i)<li[^>]*>", "- "),
    (r"<[^>]+>", ""), (r"&nbsp;|\x{00A0}", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;|&rsquo;", "'"), ("&quot;|&ldquo;|&rdquo;", '"'),
    (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " "),
]


@query("t01_html_to_text", f"SELECT page_id, {TRIM.format(_chain('html', HTML_STEPS))} AS text FROM pages")
def t01(spark, d):
    return spread(table(spark, d, "pages").select("page_id", "html"), "page_id").select("page_id", T.html_to_text("html").alias("text"))


BOARD_STEPS = HTML_STEPS[:2] + [(r"(?i)</(p|div|li|h[1-6]|br)>", "\n"), (r"<[^>]+>", ""), ("&nbsp;", " ")] + HTML_STEPS[7:12] + HTML_STEPS[13:]


@query("t01_board_html_to_text", f"SELECT page_id, {TRIM.format(_chain('html', BOARD_STEPS))} AS text FROM pages")
def t01b(spark, d):
    return spread(table(spark, d, "pages").select("page_id", "html"), "page_id").select("page_id", T.board_html_to_text("html").alias("text"))


@query("t02_decode", """
SELECT o_orderkey, '<p>' || chr(CAST(65 + o_orderkey % 26 AS INTEGER)) || chr(CAST(913 + o_orderkey % 20 AS INTEGER)) || ' & "x"</p>' AS markup,
  '<' || chr(CAST(65 + o_orderkey % 26 AS INTEGER)) || chr(128512) || '&nope;''&lt;' AS entities FROM orders""")
def t02(spark, d):
    o = table(spark, d, "orders")
    one = F.concat(F.lit("&lt;p&gt;&#"), 65 + F.col("o_orderkey") % 26, F.lit(";&#"), 913 + F.col("o_orderkey") % 20, F.lit("; &amp; &quot;x&quot;&lt;/p&gt;"))
    two = F.concat(F.lit("&lt;&#x"), F.hex(65 + F.col("o_orderkey") % 26), F.lit(";&#128512;&nope;&apos;&amp;lt;"))
    return o.select("o_orderkey", T.decode_markup(one).alias("markup"), T.decode_entities(two).alias("entities"))


@query("t03_iso_or_null", """
SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 5 THEN strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 6 IN (1, 3) THEN 'T09:30:00.000Z' ELSE 'T00:00:00.000Z' END END AS iso FROM orders""")
def t03(spark, d):
    k, day = F.col("o_orderkey") % 6, F.col("o_orderdate")
    raw = (
        F.when(k == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(k == 1, F.date_format(day, "yyyy-MM-dd'T09:30:00Z'"))
        .when(k == 2, F.date_format(day, "MMM d, yyyy"))
        .when(k == 3, F.date_format(day, "EEE, dd MMM yyyy '09:30:00 GMT'"))
        .when(k == 4, F.date_format(day, "M/d/yyyy"))
        .otherwise(F.lit("soon"))
    )
    return table(spark, d, "orders").select("o_orderkey", T.iso_or_null(raw).alias("iso"))


@query("t04_posted_on", """
SELECT o_orderkey, CAST(DATE '2001-08-01' - CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN NULL ELSE CAST(o_orderkey % 29 AS INTEGER) END AS VARCHAR) AS day,
  CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 30 ELSE CAST(o_orderkey % 29 AS INTEGER) END AS age FROM orders""")
def t04(spark, d):
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, "Posted Today").when(k == 1, "Posted Yesterday").when(k == 2, "Posted 30+ Days Ago").otherwise(F.concat(F.lit("Posted "), F.col("o_orderkey") % 29, F.lit(" Days Ago")))
    return table(spark, d, "orders").select("o_orderkey", T.posted_on(raw, A.now()).cast("string").alias("day"), T.min_age_days(raw).alias("age"))


@query("t05_is_remote", """
SELECT o_orderkey, o_orderkey % 4 IN (0, 1) AS site, o_orderkey % 4 IN (1, 2) AS board FROM orders""")
def t05(spark, d):
    k = F.col("o_orderkey") % 4
    loc = F.when(k == 0, "Virtual office").when(k == 1, "REMOTE, US").when(k == 2, "Distributed team").otherwise("Remoteville")
    return table(spark, d, "orders").select("o_orderkey", T.is_remote(loc, F.col("o_orderpriority")).alias("site"), T.is_remote(loc, words=T.REMOTE_BOARD).alias("board"))


@query("t06_display_name", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'Acme ' || c_custkey || ' ' || upper(substr(c_mktsegment, 1, 1)) || substr(lower(c_mktsegment), 2) END AS name FROM customer""")
def t06(spark, d):
    ident = F.concat(F.lit("acme-"), "c_custkey", F.lit("_"), F.lower("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", T.display_name(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(ident), ident).alias("name"))


@query("t07_career_site_url", """
WITH u AS (SELECT page_id, url, CASE page_id % 6 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'workday' WHEN 2 THEN 'smartrecruiters' WHEN 3 THEN 'bamboohr' WHEN 4 THEN 'phenom' ELSE 'workable' END AS s,
  lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS origin, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages)
SELECT page_id, CASE s WHEN 'greenhouse' THEN 'https://job-boards.greenhouse.io/c' || page_id WHEN 'workable' THEN 'https://apply.workable.com/c' || page_id || '/'
  WHEN 'workday' THEN origin || '/en' WHEN 'smartrecruiters' THEN origin || CASE WHEN regexp_extract(path, '^/([^/]+)', 1) <> '' THEN '/' || regexp_extract(path, '^/([^/]+)', 1) ELSE '' END
  WHEN 'bamboohr' THEN origin || '/careers' ELSE origin END AS site FROM u""")
def t07(spark, d):
    s = F.expr("CASE page_id % 6 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'workday' WHEN 2 THEN 'smartrecruiters' WHEN 3 THEN 'bamboohr' WHEN 4 THEN 'phenom' ELSE 'workable' END")
    url = F.when(s == "workday", F.concat(T.url_origin(F.col("url")), F.lit("/en/job/x-1"))).when(s == "bamboohr", F.concat(T.url_origin(F.col("url")), F.lit("/careers/12"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", T.career_site_url(s, F.concat(F.lit("c"), "page_id"), url).alias("site"))


@query("t08_places", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN n_name || ', ' || r_name ELSE r_name END AS cleaned, n_name || ', GA, US' AS dashed, CASE WHEN c_custkey % 3 = 0 THEN 'Town ' || c_custkey || ', OH' ELSE n_name END AS city,
  CASE WHEN c_custkey % 3 <> 0 THEN n_name || ', x' END AS place FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def t08(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat("n_name", F.lit(" , ,"), "r_name")).otherwise(F.concat("r_name", F.lit(", "), "r_name"))
    return j.select(
        "c_custkey", T.clean_place(raw).alias("cleaned"), T.dashed_place(F.concat(F.lit("US-GA-"), "n_name")).alias("dashed"),
        T.city_state(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Town "), "c_custkey", F.lit(", OH 43215"))).otherwise(F.col("n_name"))).alias("city"),
        T.place_not_count(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.col("c_custkey"), F.lit(" Locations"))).otherwise(F.concat("n_name", F.lit(" , x")))).alias("place"),
    )


@query("t09_clean_company", """
SELECT c_custkey, c_name AS legal, CASE WHEN c_custkey % 4 = 3 THEN '' ELSE c_name END AS label, c_custkey % 5 = 0 AS generic, CASE WHEN c_custkey % 5 <> 0 THEN 'Firm ' || c_custkey END AS titled FROM customer""")
def t09(spark, d):
    k = F.col("c_custkey")
    legal = F.concat("c_name", F.element_at(F.array(*map(F.lit, [" GmbH & Co. KG", ", Inc.", " Ltd", " B.V."])), (k % 4 + 1).cast("int")))
    label = F.when(k % 4 == 0, F.concat(F.lit("Default "), "c_name")).when(k % 4 == 1, F.concat("c_name", F.lit(" - Default"))).when(k % 4 == 2, F.concat("c_name", F.lit(" Job Board"))).otherwise(F.lit("Main Template"))
    generic = F.when(k % 5 == 0, "Current Openings").otherwise(F.col("c_name"))
    title = F.when(k % 5 == 0, "<title>Careers</title>").otherwise(F.concat(F.lit("<TITLE>Firm "), k, F.lit(" Careers</TITLE>")))
    return table(spark, d, "customer").select(
        "c_custkey", T.clean_legal_name(legal).alias("legal"), T.strip_board_words(label).alias("label"), T.is_generic_label(generic).alias("generic"), T.name_from_title(title).alias("titled")
    )


@query("t10_is_real", """
SELECT c_custkey, c_custkey % 4 NOT IN (1, 2) AS real, c_custkey % 3 <> 0 AS public, c_custkey % 5 <> 0 AS production FROM customer""")
def t10(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 4 == 1, F.concat("c_name", F.lit(" Sandbox"))).otherwise(F.col("c_name"))
    slug = F.concat(F.lit("acme"), k, F.when(k % 4 == 2, "-review").otherwise(""))
    host = F.concat(F.lit("acme"), F.when(k % 5 == 0, "-uat2").otherwise(""), F.lit(".example.com"))
    return table(spark, d, "customer").select(
        "c_custkey", T.is_real(name, slug).alias("real"), T.is_public_site(F.when(k % 3 == 0, "Internal_Jobs").otherwise("External")).alias("public"), T.is_production_host(host).alias("production")
    )


@query("t11_slug_candidates", r"""
WITH c AS (SELECT p_partkey, lower(p_name) AS b FROM part) SELECT p_partkey, regexp_replace(b, '[^a-z0-9]', '', 'g') || ';' || regexp_replace(b, '[^a-z0-9]+', '-', 'g') || ';' || b AS slugs FROM c""")
def t11(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(T.slug_candidates(F.concat(F.lit(" "), "p_name")), ";").alias("slugs"))


@query("t12_parse_entry", """
SELECT c_custkey AS k, CASE k0 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'workday' WHEN 3 THEN 'workday' WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE NULL END AS ats,
  CASE k0 WHEN 0 THEN 'acme' || c_custkey WHEN 1 THEN 'acme' || c_custkey WHEN 2 THEN 'acme' || c_custkey WHEN 3 THEN 'acme' || c_custkey WHEN 4 THEN 'acmeco' || c_custkey END AS slug,
  CASE k0 WHEN 2 THEN 'Ext' WHEN 3 THEN 'EXT_' || c_custkey END AS site, CASE k0 WHEN 5 THEN 'not a company slug or job-board link' WHEN 6 THEN 'empty entry' END AS skip FROM (SELECT c_custkey, c_custkey % 7 AS k0 FROM customer)""")
def t12(spark, d):
    k = F.col("c_custkey")
    raw = F.expr("""CASE c_custkey % 7 WHEN 0 THEN concat('https://boards-api.greenhouse.io/v1/boards/Acme', c_custkey, '/jobs') WHEN 1 THEN concat('jobs.lever.co/acme', c_custkey, '?x=1')
      WHEN 2 THEN concat('https://acme', c_custkey, '.wd5.myworkdayjobs.com/en-US/Ext/job/1') WHEN 3 THEN concat('https://wd1.myworkdaysite.com/recruiting/acme', c_custkey, '/EXT_', c_custkey)
      WHEN 4 THEN concat(' Acme Co ', c_custkey) WHEN 5 THEN 'what/is this?' ELSE ' ' END""")
    e = table(spark, d, "customer").select(k.alias("k"), T.parse_entry(raw).alias("e"))
    return e.select("k", "e.ats", "e.slug", "e.site", "e.skip")


EMAIL_RE = r"[a-z0-9][a-z0-9._%+-]{0,63}@[a-z0-9.-]+\.[a-z]{2,24}"
VALID_RE = r"^[a-z0-9][a-z0-9._%+-]{0,63}@[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,24}$"
JUNK_RE = r"\.(png|jpe?g|webp|svg|gif|css|js|avif)$|@(\d+x|2x)|sentry|wixpress|godaddy|@(example|domain|email|yourdomain|yourstore|company|test)\.|^(your|name|you|user|email|someone|john|jane|no-?reply|do-?not-?reply|mailer-daemon|postmaster)@|@shopify\.com$|@myshopify\.com$|\\u00|u003e"


@query("t14_emails", f"""
WITH p AS (SELECT doc_id, regexp_extract_all(text, '{EMAIL_RE}', 0, 'i') AS l FROM documents), u AS (SELECT doc_id, unnest(l) AS e, generate_subscripts(l, 1) AS pos FROM p),
v AS (SELECT doc_id, lower(e) AS e, min(pos) AS pos FROM u GROUP BY 1, 2), g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM v WHERE regexp_matches(e, '{VALID_RE}') AND NOT regexp_matches(e, '{JUNK_RE}'))
SELECT d.doc_id, coalesce(string_agg(e, ';' ORDER BY rn), '') AS emails FROM documents d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id""")
def t14(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(contacts.emails("text"), ";").alias("emails"))


@query("t14_mail_links", """
SELECT c_custkey, 'sales+' || c_custkey || '@shop.co;info@shop' || c_custkey || '.org;sales%2b' || c_custkey || '@shop.co' AS emails FROM customer""")
def t14b(spark, d):
    html = F.concat(F.lit('<p>info@shop'), "c_custkey", F.lit('.org me@example.com a@2x.png</p><a href="mailto:Sales%2B'), "c_custkey", F.lit('@shop.co?subject=hi">mail</a> bad%zz'))
    return table(spark, d, "customer").select("c_custkey", F.array_join(contacts.emails(html), ";").alias("emails"))


@query("t15_phones", """
SELECT c_custkey, '+1 (555) 010-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || ';0800 123456' AS phones FROM customer""")
def t15(spark, d):
    n = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    html = F.concat(F.lit('<a href="tel:+1 (555)%20010-'), n, F.lit('">x</a><a href=\'tel:1555010'), n, F.lit('\'>again</a><a href="tel:123">short</a><a href="tel:0800 123456">y</a>'))
    return table(spark, d, "customer").select("c_custkey", F.array_join(contacts.phones(html), ";").alias("phones"))


@query("t16_socials", """
SELECT c_custkey, 'https://www.instagram.com/shop_' || c_custkey AS instagram, CASE WHEN c_custkey % 2 = 0 THEN 'https://facebook.com/shop.' || c_custkey END AS facebook, 'https://x.com/s' || (c_custkey % 1000) AS twitter, NULL::VARCHAR AS tiktok FROM customer""")
def t16(spark, d):
    k = F.col("c_custkey")
    html = F.concat(
        F.lit('<a href="https://www.instagram.com/explore">e</a><a href="http://www.instagram.com/shop_'), k, F.lit('/">i</a><a href="https://facebook.com/sharer">s</a>'),
        F.when(k % 2 == 0, F.concat(F.lit('<a href="https://facebook.com/shop.'), k, F.lit('">f</a>'))).otherwise(""), F.lit('<a href="https://x.com/intent?x">t</a><a href="https://x.com/s'), k % 1000, F.lit('">t</a>'),
    )
    s = table(spark, d, "customer").select("c_custkey", contacts.socials(html).alias("s"))
    return s.select("c_custkey", "s.instagram", "s.facebook", "s.twitter", "s.tiktok")


@query("t17_apps", """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Klaviyo;' ELSE '' END || CASE WHEN page_id % 3 = 0 THEN 'Judge.me;' ELSE '' END || CASE WHEN page_id % 5 = 0 THEN 'Meta Pixel;' ELSE '' END || 'Google Analytics' AS apps FROM pages""")
def t17(spark, d):
    k = F.col("page_id")
    extra = F.concat(
        F.when(k % 2 == 0, "<script src=//static.KLAVIYO.com/x.js>").otherwise(""), F.when(k % 3 == 0, "cdn.judge.me").otherwise(""),
        F.when(k % 5 == 0, "https://connect.facebook.net/en_US/fbevents.js").otherwise(""), F.lit("googletagmanager.com/gtag/js"),
    )
    return table(spark, d, "pages").select("page_id", F.array_join(contacts.apps(F.concat("html", extra)), ";").alias("apps"))


@query("t18_page_facts", r"""
SELECT page_id, nullif(lower(regexp_extract(html, '(?i)<html[^>]*\slang=["'']?([A-Za-z]{2,3}(?:-[A-Za-z0-9]{2,8})?)', 1)), '') AS language, CASE WHEN page_id % 2 = 0 THEN 'Dawn/2' END AS theme, page_id % 7 = 0 AS locked FROM pages""")
def t18(spark, d):
    extra = F.when(F.col("page_id") % 2 == 0, '<script>Shopify.theme = {"name":"x","id":1,"schema_name":"Dawn\\/2"};</script>').otherwise("")
    url = F.when(F.col("page_id") % 7 == 0, F.lit("https://a.example/password?x")).otherwise(F.col("url"))
    f = table(spark, d, "pages").select("page_id", contacts.page_facts(F.concat("html", extra), url).alias("f"))
    return f.select("page_id", "f.language", "f.theme", F.col("f.password_protected").alias("locked"))


@query("t19_merge_pages", """
SELECT c_custkey, 'a@s' || c_custkey || '.co' || CASE WHEN c_custkey % 3 <> 0 THEN ';b@s.co' ELSE '' END AS emails, CASE WHEN c_custkey % 3 <> 0 THEN 'https://instagram.com/two' END AS instagram FROM customer""")
def t19(spark, d):
    home = F.concat(F.lit('<a href="mailto:a@s'), "c_custkey", F.lit('.co">m</a>'))
    contact = F.concat(home, F.lit('<a href="mailto:b@s.co">m</a><a href="https://instagram.com/two">i</a>'))
    # Facts are made once per page; the merge reads them as columns.
    c = table(spark, d, "customer").withColumns({"p1": contacts.page_facts(home), "p2": F.when(F.col("c_custkey") % 3 != 0, contacts.page_facts(contact))})
    m = c.select("c_custkey", contacts.merge_pages(F.col("p1"), F.col("p2")).alias("m"))
    return m.select("c_custkey", F.array_join("m.emails", ";").alias("emails"), F.col("m.socials.instagram").alias("instagram"))


# ---------------------------------------------------------------- pay

def spread(df, key):
    """The rows dealt over the cluster's tasks: the given tables are files of one or two read splits, and a text costs more
    than its shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def pay_texts(spark, d):
    """Order values written as pay lines in five ways."""
    o = spread(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey").withColumn("n", F.floor(F.col("o_totalprice") / 5 + 20_000).cast("bigint"))
    money = lambda c: F.format_number(c, 0)
    lo, hi = F.col("n"), F.col("n") + 15_000
    k = F.col("o_orderkey") % 6
    text = (
        F.when(k == 0, F.concat(F.lit("We need you.\nThe base pay range is $"), money(lo), F.lit(" &ndash; $"), money(hi), F.lit(" per year. Benefits follow.")))
        .when(k == 1, F.concat(F.lit("Salary: "), money(lo), F.lit(" EUR - "), money(hi), F.lit(" EUR gross")))
        .when(k == 2, F.concat(F.lit("Hourly rate: $"), F.floor(lo / 2080), F.lit(".50 and more")))
        .when(k == 3, F.concat(F.lit("Minimum Salary: £"), money(lo), F.lit(".00 Maximum Salary: £"), money(hi), F.lit(".00")))
        .when(k == 4, F.concat(F.lit("We raised $"), money(lo), F.lit(" million in funding - and no salary is stated")))
        .otherwise(F.concat(F.lit("A sign-on bonus of $"), money(lo), F.lit(" - $"), money(hi)))
    )
    return o.select("o_orderkey", text.alias("description"), F.when(F.col("o_orderkey") % 4 == 0, "Canada").alias("country"))


PAY_SQL = """
WITH p AS (SELECT o_orderkey, o_orderkey % 6 AS k, CAST(floor(o_totalprice / 5 + 20000) AS BIGINT) AS n, CASE WHEN o_orderkey % 4 = 0 THEN 'CAD' ELSE 'USD' END AS dollar FROM orders)
SELECT o_orderkey, CASE WHEN k IN (0, 1, 3) THEN CAST(n AS DOUBLE) WHEN k = 2 THEN n // 2080 + 0.5 END AS "min", CAST(CASE WHEN k IN (0, 1, 3) THEN n + 15000.0 WHEN k = 2 THEN n // 2080 + 0.5 END AS DOUBLE) AS "max",
  CASE k WHEN 0 THEN dollar WHEN 1 THEN 'EUR' WHEN 2 THEN dollar WHEN 3 THEN 'GBP' END AS currency, CASE WHEN k IN (0, 1, 3) THEN 'year' WHEN k = 2 THEN 'hour' END AS period,
  CASE WHEN k IN (0, 1, 3) THEN n WHEN k = 2 THEN (n // 2080) * 2080 + 1040 END AS annual_min, CASE WHEN k IN (0, 1, 3) THEN n + 15000 WHEN k = 2 THEN (n // 2080) * 2080 + 1040 END AS annual_max FROM p"""


@query("t20_extract_pay", PAY_SQL)
def t20(spark, d):
    return pay.with_pay(pay_texts(spark, d)).select("o_orderkey", *[F.col(f"pay.{f}").alias(f) for f in pay.PAY_FIELDS[:6]])


@query("t21_norm_text", r"""
SELECT doc_id, regexp_replace('— – & ' || replace(text, chr(160), ' ') || ' z', '[ \t]+', ' ', 'g') AS text FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)&amp;', '&', 'g'), '(?i)&nbsp;|&#160;|\x{00A0}', ' ', 'g') AS text FROM documents)""")
def t21(spark, d):
    return table(spark, d, "documents").select("doc_id", T.norm_text(F.concat(F.lit("&mdash;\t&#8211; &AMP; "), "text", F.lit("&#x7a9;z"))).alias("text"))


@query("t22_currency", """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'USD' WHEN 1 THEN CASE WHEN o_orderkey % 4 = 1 THEN 'CAD' ELSE 'USD' END WHEN 2 THEN 'GBP' WHEN 3 THEN 'CHF' WHEN 4 THEN NULL ELSE 'AUD' END AS currency,
  CASE o_orderkey % 3 WHEN 0 THEN 'CA' WHEN 1 THEN 'AU' END AS hint FROM orders""")
def t22(spark, d):
    k = F.col("o_orderkey")
    token = F.expr("CASE o_orderkey % 6 WHEN 0 THEN 'us$' WHEN 1 THEN '$' WHEN 2 THEN '£' WHEN 3 THEN 'chf ' WHEN 4 THEN 'xyz' ELSE 'A$' END")
    place = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'Toronto, ON' WHEN 1 THEN 'Sydney' ELSE 'Toronto, US' END")
    return table(spark, d, "orders").select("o_orderkey", pay.currency(token, F.when(k % 4 == 1, "ca").otherwise("US")).alias("currency"), pay.country_hint(place).alias("hint"))


@query("t23_annualise", """
SELECT o_orderkey, CAST(floor(o_totalprice / 1000 * CASE o_orderkey % 5 WHEN 0 THEN 2080 WHEN 1 THEN 260 WHEN 2 THEN 52 WHEN 3 THEN 12 ELSE 1 END + 0.5) AS BIGINT) AS yearly FROM orders""")
def t23(spark, d):
    period = F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'hour' WHEN 1 THEN 'day' WHEN 2 THEN 'week' WHEN 3 THEN 'month' ELSE 'year' END")
    return table(spark, d, "orders").select("o_orderkey", pay.annualise(F.col("o_totalprice") / 1000, period).alias("yearly"))


@query("t24_structured_pay", """
WITH p AS (SELECT o_orderkey, o_orderkey % 4 AS k, floor(o_totalprice / 10) + 20000 AS n FROM orders)
SELECT o_orderkey, CASE WHEN k < 3 THEN n END AS "min", CASE WHEN k < 3 THEN n + 1000 END AS "max", CASE k WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' END AS currency, CASE WHEN k < 3 THEN 'year' END AS period,
  CASE WHEN k < 3 THEN CAST(n AS BIGINT) END AS annual_min FROM p""")
def t24(spark, d):
    n = F.floor(F.col("o_totalprice") / 10) + 20_000
    k = F.col("o_orderkey") % 4
    body = (
        F.when(k == 0, F.concat(F.lit('{"compensationTiers":[{"components":[{"compensationType":"Bonus"},{"compensationType":"Salary","interval":"1 YEAR","currencyCode":"EUR","minValue":'), n, F.lit(',"maxValue":'), n + 1000, F.lit("}]}]}")))
        .when(k == 1, F.concat(F.lit('{"payInputRanges":[{"min_cents":'), n * 100, F.lit(',"max_cents":'), (n + 1000) * 100, F.lit(',"currency_type":"usd"}]}')))
        .when(k == 2, F.concat(F.lit('{"leverSalaryRange":{"min":'), n, F.lit(',"max":'), n + 1000, F.lit(',"currency":"gbp","interval":"per-year-salary"}}')))
        .otherwise(F.lit("{}"))
    )
    o = table(spark, d, "orders").withColumn("c", F.from_json(body, pay.STRUCTURED)).select("o_orderkey", pay.structured_pay("c").alias("p"))
    return o.select("o_orderkey", "p.min", "p.max", "p.currency", "p.period", "p.annual_min")


# ---------------------------------------------------------------- clinical tags

TITLES = [  # title, department, type, description, then the tags that must come out
    ("Registered Nurse RN ICU Nights", "Critical Care", "Full Time", "BLS and ACLS required. 12 hour night shifts. $10,000 sign-on bonus.", "Registered nurse", None, "ICU", "nights", 12, "full time", 10000.0, "BLS;ACLS"),
    ("Assistant Nurse Manager - NICU", None, None, "Current RN license.", "Nursing leadership", "Nurse manager", "NICU", "", None, None, None, "RN license"),
    ("Nursing Assistant PRN Weekend", "Med/Surg", None, None, "Nursing support", "Nursing assistant", "Med-surg", "weekends", None, "per diem", None, ""),
    ("Travel Physical Therapist", "Rehab", "Contract", "Up to $7,500 hiring bonus and $500 more", "Allied health", "Physical therapy", "Rehabilitation", "", None, "travel", 7500.0, ""),
    ("Physician Office Coordinator", None, "Part-Time", "nothing", "Non-clinical", "Business and administration", "", "", None, "part time", None, ""),
    ("Locum Hospitalist", "Emergency", None, "Board certified; DEA", "Physician", None, "Emergency", "", None, "locum", None, "Board certified;DEA"),
    ("Staff Accountant $25,000 Bonus", None, None, None, "Non-clinical", "Business and administration", "", "", None, None, 25000.0, ""),
]


def clinical_rows(spark, d):
    """Orders with one of seven postings each."""
    pick = lambda i: F.element_at(F.array(*[F.lit(t[i]).cast("string") for t in TITLES]), (F.col("o_orderkey") % len(TITLES) + 1).cast("int"))
    return spread(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", pick(0).alias("title"), pick(1).alias("department"), pick(2).alias("employment_type"), pick(3).alias("description"))


def _case(i: int) -> str:
    q = lambda v: "NULL" if v is None else repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"CASE o_orderkey % {len(TITLES)} " + " ".join(f"WHEN {n} THEN {q(t[i])}" for n, t in enumerate(TITLES)) + " END"


@query("t25_role", f"SELECT o_orderkey, {_case(4)} AS family, {_case(5)} AS type FROM orders")
def t25(spark, d):
    return clinical_rows(spark, d).select("o_orderkey", clinical.role("title").alias("r")).select("o_orderkey", "r.family", "r.type")


@query("t26_specialties", f"SELECT o_orderkey, {_case(6)} AS specialties FROM orders")
def t26(spark, d):
    c = clinical_rows(spark, d).withColumn("family", clinical.role("title")["family"])
    return c.select("o_orderkey", F.array_join(clinical.specialties("title", "department", "family"), ";").alias("specialties"))


@query("t27_shift", f"SELECT o_orderkey, {_case(7)} AS shift, {_case(8)} AS hours FROM orders")
def t27(spark, d):
    c = clinical_rows(spark, d)
    return c.select("o_orderkey", F.array_join(clinical.shift("title", "description"), ";").alias("shift"), clinical.shift_hours("title", "description").alias("hours"))


@query("t28_employment", f"SELECT o_orderkey, {_case(9)} AS employment FROM orders")
def t28(spark, d):
    return clinical_rows(spark, d).select("o_orderkey", clinical.employment("title", "employment_type").alias("employment"))


@query("t29_bonus", f"SELECT o_orderkey, CAST({_case(10)} AS DOUBLE) AS amount, {_case(10)} IS NOT NULL AS offered FROM orders")
def t29(spark, d):
    c = clinical_rows(spark, d).withColumn("offered", clinical.has_bonus("title", "description"))
    return c.select("o_orderkey", clinical.bonus_amount("title", "description", F.col("offered")).alias("amount"), "offered")


@query("t30_licenses", f"SELECT o_orderkey, {_case(11)} AS licenses FROM orders")
def t30(spark, d):
    return clinical_rows(spark, d).select("o_orderkey", F.array_join(clinical.licenses("title", "description"), ";").alias("licenses"))


# ---------------------------------------------------------------- versions and notes

@query("t31_tag_version", """
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN a || '.' || b || '.0' WHEN 1 THEN a || '.' || b || '.3-rc.1' WHEN 2 THEN a || '.' || b || '.0b3' WHEN 3 THEN a || '.' || b || '.7' END AS version
FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS a, l_linenumber AS b FROM lineitem)""")
def t31(spark, d):
    a = F.col("l_quantity").cast("int")
    k = F.col("l_linenumber") % 5
    ab = F.concat(a, F.lit("."), "l_linenumber")
    tag = F.when(k == 0, F.concat(F.lit("v"), ab)).when(k == 1, F.concat(F.lit("pkg@"), ab, F.lit(".3-rc.1"))).when(k == 2, F.concat(F.lit("release-"), ab, F.lit("b3"))).when(k == 3, F.concat(ab, F.lit(".7.4"))).otherwise("latest")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", V.tag_version(tag).alias("version"))


@query("t32_version_key", """
SELECT l_orderkey, l_linenumber, ((l_linenumber, CAST(l_quantity AS INTEGER)) > (3, 25)) OR ((l_linenumber, CAST(l_quantity AS INTEGER)) = (3, 25) AND l_returnflag <> 'R') AS later FROM lineitem""")
def t32(spark, d):
    v = F.concat(F.lit("v"), "l_linenumber", F.lit("."), F.col("l_quantity").cast("int"), F.when(F.col("l_returnflag") == "R", "-rc.2").otherwise(".0"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (V.version_key(v) >= V.version_key(F.lit("3.25.0"))).alias("later"))


@query("t33_loose_key", """
SELECT l_orderkey, l_linenumber, (l_linenumber, CAST(l_quantity AS INTEGER), 0, 4) >= (3, 25, 0, 4) AS later FROM lineitem""")
def t33(spark, d):
    v = F.concat(F.lit("v"), "l_linenumber", F.lit("-"), F.col("l_quantity").cast("int"), F.lit(".0+4.0"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (V.loose_key(v) >= V.loose_key(F.lit("3.25.0.4"))).alias("later"))


@query("t34_jump", """
WITH v AS (SELECT p_partkey, p_size AS a, CAST(p_partkey % 5 AS INTEGER) AS b, CAST(p_partkey % 3 AS INTEGER) AS c FROM part)
SELECT p_partkey, CASE WHEN (a, b, c) = (20, 2, 1) THEN 'same' WHEN (20, 2, 1) > (a, b, c) THEN 'downgrade' WHEN a > 20 THEN 'major' WHEN b > 2 THEN 'minor' ELSE 'patch' END AS kind, CAST(greatest(0, a - 20) AS BIGINT) AS majors FROM v""")
def t34(spark, d):
    to = F.concat_ws(".", "p_size", F.col("p_partkey") % 5, F.col("p_partkey") % 3)
    return table(spark, d, "part").select("p_partkey", V.jump(F.lit("20.2.1"), to).alias("kind"), V.majors_crossed(F.lit("20.2.1"), to).alias("majors"))


@query("t35_repo", """
SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN 'own' || p_partkey || '/' || replace(p_name, ' ', '.') END AS repo FROM part""")
def t35(spark, d):
    name = F.concat(F.lit("own"), "p_partkey", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit(".")))
    k = F.col("p_partkey") % 4
    url = F.when(k == 0, F.concat(F.lit("git+https://github.com/"), name, F.lit(".git"))).when(k == 1, F.concat(F.lit("git@GitHub.com:"), name)).when(k == 2, F.concat(F.lit("https://github.com/"), name, F.lit("#readme"))).otherwise("https://gitlab.com/a/b")
    return table(spark, d, "part").select("p_partkey", V.repo(url).alias("repo"))


def release_notes(spark, d):
    """A release note per part: a plain section, a breaking section, a marked line and phrases, each naming the part."""
    p, k = F.regexp_replace("p_name", " ", "_"), F.col("p_partkey")
    body = F.concat(
        F.lit("# Release\n- Fixed a small thing\n- Removed `old_"), p, F.lit("` from the API by @dev in https://github.com/a/b/pull/1\n## "), F.when(k % 2 == 0, "Breaking Changes").otherwise("Other notes"),
        F.lit("\n* The option `"), p, F.lit("` takes a list now ([#12](http://x/y))\n- short\n### Misc\n- Dropped support for `pytest` runs\n"),
        F.when(k % 3 == 0, F.concat(F.lit("BREAKING CHANGE: rename of "), F.col("p_name"), F.lit(" needs a new call\n"))).otherwise(""), F.lit("- removed `_private` helper of the tool"),
    )
    return table(spark, d, "part").select("p_partkey", p.alias("sym"), body.alias("body"))


@query("t36_breaking_lines", """
WITH p AS (SELECT p_partkey AS k, replace(p_name, ' ', '_') AS s, p_name FROM part)
SELECT k AS p_partkey, CASE WHEN k % 2 = 0 THEN 'high:The option `' || s || '` takes a list now ([#12](http://x/y));' ELSE '' END || CASE WHEN k % 3 = 0 THEN 'high:rename of ' || p_name || ' needs a new call;' ELSE '' END
  || 'medium:Removed `old_' || s || '` from the API by @dev in https://github.com/a/b/pull/1;medium:Dropped support for `pytest` runs;medium:removed `_private` helper of the tool' AS lines FROM p""")
def t36(spark, d):
    r = release_notes(spark, d)
    return r.select("p_partkey", F.array_join(F.transform(notes.candidate_lines("body"), lambda x: F.concat(x["confidence"], F.lit(":"), x["text"])), ";").alias("lines"))


@query("t37_breaking_changes", """
WITH p AS (SELECT p_partkey AS k, replace(p_name, ' ', '_') AS s, p_name FROM part)
SELECT k AS p_partkey, CASE WHEN k % 2 = 0 THEN 'The option `' || s || '` takes a list now[' || s || '];' ELSE '' END || CASE WHEN k % 3 = 0 THEN 'rename of ' || p_name || ' needs a new call[];' ELSE '' END || 'Removed `old_' || s || '` from the API[old_' || s || ']' AS changes FROM p""")
def t37(spark, d):
    show = lambda x: F.concat(x["summary"], F.lit("["), F.array_join(x["symbols"], ","), F.lit("]"))
    return release_notes(spark, d).select("p_partkey", F.array_join(F.transform(notes.breaking_changes("body"), show), ";").alias("changes"))


@query("t38_changelog_section", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'The ' || p_name || ' was changed in this release.' WHEN 1 THEN '## ' || p_size || '.2.0-beta.1' || chr(10) || 'Preview of the new ' || p_name || ' parts.' ELSE 'Ruled text about the ' || p_name || ' here.' END AS section FROM part""")
def t38(spark, d):
    v = F.concat("p_size", F.lit(".2.0"))
    k = F.col("p_partkey") % 3
    md = F.concat(F.lit("# Log\n## "), F.col("p_size") + 1, F.lit(".0.0\nnewer things are listed here\n## ["), v, F.lit("] - 2024-01-01\nThe "), F.col("p_name"), F.lit(" was changed in this release.\n\n## 0.1.0\nold"))
    pre = F.concat(F.lit("## "), v, F.lit("\n\n## "), v, F.lit("-beta.1\nPreview of the new "), F.col("p_name"), F.lit(" parts.\n## 0.1.0\nold"))
    ruled = F.concat(F.lit("Changes\n=======\n\nVersion "), v, F.lit("\n-------------\n\nRuled text about the "), F.col("p_name"), F.lit(" here.\n\nVersion 0.1.0\n-------------\nold"))
    text = F.when(k == 0, md).when(k == 1, pre).otherwise(ruled)
    return table(spark, d, "part").select("p_partkey", notes.changelog_section(text, v).alias("section"))


@query("t39_is_pointer", f"""
WITH b AS (SELECT doc_id, {TRIM.format("text || CASE WHEN doc_id % 4 = 0 THEN ' Refer to the CHANGELOG' ELSE '' END")} AS b FROM documents)
SELECT doc_id, length(b) < 400 OR (regexp_matches(b, '(?i)refer to .{{0,40}}CHANGELOG|see .{{0,40}}CHANGELOG|full changelog') AND length(b) < 1500) AS pointer FROM b""")
def t39(spark, d):
    body = F.concat("text", F.when(F.col("doc_id") % 4 == 0, " Refer to the CHANGELOG").otherwise(""))
    return table(spark, d, "documents").select("doc_id", notes.is_pointer(body).alias("pointer"))


@query("t40_severity", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'high' WHEN event_id % 4 = 1 THEN 'unknown' WHEN value >= 9 THEN 'critical' WHEN value >= 7 THEN 'high' WHEN value >= 4 THEN 'moderate' ELSE 'low' END AS severity FROM events""")
def t40(spark, d):
    k = F.col("event_id") % 4
    named = F.when(k == 0, "HIGH").otherwise("")
    score = F.when(k == 1, "CVSS:3.1/AV:N/AC:L").otherwise(F.col("value").cast("string"))
    return table(spark, d, "events").select("event_id", V.severity(named, score).alias("severity"))


@query("t41_edit_distance", "SELECT c_custkey, CAST(levenshtein(c_name, 'Customer#000000123') AS BIGINT) AS distance FROM customer")
def t41(spark, d):
    return table(spark, d, "customer").select("c_custkey", V.edit_distance("c_name", F.lit("Customer#000000123")).cast("bigint").alias("distance"))


@query("t42_tidy_name", """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN list_aggregate([upper(w[1]) || w[2:] FOR w IN string_split(p_name, ' ')], 'string_agg', ' ') || ' LLC' ELSE p_name || ' LLC' END AS name,
  '+1 555-' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || '-0199' AS phone, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS given FROM part""")
def t42(spark, d):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.upper(F.concat("p_name", F.lit("  llc")))).otherwise(F.concat("p_name", F.lit("  LLC")))
    phone = F.concat(F.when(F.col("p_partkey") % 3 == 0, "1").otherwise(""), F.lit("(555) "), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.lit(".0199"))
    return table(spark, d, "part").select("p_partkey", T.tidy_name(raw).alias("name"), T.us_phone(phone).alias("phone"), T.not_placeholder(F.when(F.col("p_partkey") % 5 == 0, "N/A").otherwise(F.col("p_name"))).alias("given"))


@query("t43_labels", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Technology' WHEN 'O' THEN 'Energy' ELSE 'Other' END AS sector, CASE o_orderkey % 3 WHEN 0 THEN 'Rule 506(b)' WHEN 1 THEN 'Investment Company Act Section 3(c)(7)' ELSE '99x' END AS exemption FROM orders""")
def t43(spark, d):
    ind = F.expr("CASE o_orderstatus WHEN 'F' THEN 'Computers' WHEN 'O' THEN 'Oil and Gas' ELSE 'Basket weaving' END")
    code = F.expr("CASE o_orderkey % 3 WHEN 0 THEN '06b' WHEN 1 THEN '3C.7' ELSE '99x' END")
    return table(spark, d, "orders").select("o_orderkey", labels.sector(ind).alias("sector"), labels.exemption(code).alias("exemption"))


@query("t44_job_state", """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'MA' WHEN 1 THEN 'SD' WHEN 2 THEN 'WV' END AS state FROM customer""")
def t44(spark, d):
    loc = F.expr("CASE c_custkey % 4 WHEN 0 THEN concat('Town', c_custkey, '-MA') WHEN 1 THEN 'SD, Sioux Falls' WHEN 2 THEN 'New York office of west virginia University' ELSE 'Memorial Hospital West' END")
    return table(spark, d, "customer").select("c_custkey", labels.job_state(loc).alias("state"))


@query("t45_title_family", """
WITH @postings SELECT id, CASE WHEN title LIKE '%RN manager' THEN 'Registered nurse' ELSE 'Everything else' END AS family, CASE WHEN title LIKE '%engineer' THEN 'Software / engineering' WHEN title LIKE '%nurse' THEN 'Nursing' ELSE 'Nursing;Management' END AS families FROM postings""")
def t45(spark, d):
    return A.postings(spark, d).select("id", labels.title_family("title").alias("family"), F.array_join(labels.title_families("title"), ";").alias("families"))


@query("t46_employment_kind", """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'Per diem / PRN' WHEN 1 THEN 'Full time' WHEN 2 THEN 'Part time' WHEN 3 THEN 'Contract / temporary' WHEN 4 THEN 'Not stated' ELSE 'Other' END AS kind FROM orders""")
def t46(spark, d):
    k = F.col("o_orderkey") % 6
    kind = F.when(k == 1, " Full-Time").when(k == 2, "part time").when(k == 3, "Temporary").when(k == 5, "Seasonal")
    return table(spark, d, "orders").select("o_orderkey", labels.employment_kind(F.when(k == 0, "Nurse (per-diem)").otherwise(F.col("o_orderpriority")), kind).alias("kind"))


@query("t48_client_key", "SELECT event_id, sha256('salt' || CAST(user_id AS VARCHAR)) AS client FROM events")
def t48(spark, d):
    return table(spark, d, "events").select("event_id", T.client_key(F.col("user_id").cast("string"), "salt").alias("client"))


@query("t49_host_key", r"""
SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host, string_split(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '.')[-2] AS key, nullif(regexp_extract(url, '^https?://[^/?#]+(?:/[^?#]*?)?/([^/?#]+)/?(?:[?#]|$)', 1), '') AS last FROM pages""")
def t49(spark, d):
    return table(spark, d, "pages").select("page_id", T.url_host("url").alias("host"), T.host_key(T.url_host("url")).alias("key"), T.last_segment("url").alias("last"))


@query("t50_json_scalar", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, '{"k":' || (CAST(json_extract_string(props, '$.k') AS INTEGER) + 1) || '}' AS changed FROM events""")
def t50(spark, d):
    k = T.json_get("props", "$.k").cast("int")
    return table(spark, d, "events").select("event_id", k.alias("k"), T.json_set("props", "k int", "k", k + 1).alias("changed"))
