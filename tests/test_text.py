from pyspark.sql import functions as F

from fieldledger.functions import contacts, notes, text as T, versions as V
from fieldledger.operators.filters import path_allowed


def one(spark, *cols, **vals):
    df = spark.createDataFrame([tuple(vals.values())], ", ".join(f"{k} string" for k in vals)) if vals else spark.range(1)
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).head()


def test_html_and_entities(spark):
    r = one(spark, T.html_to_text("h"), T.board_html_to_text("h"), T.decode_markup(F.lit("&lt;b&gt;&#8212;&amp;lt;")), T.decode_entities(F.lit("a&#x41;&quot;&zzz;&#128512;")),
            h="<script>x</script><p>One&nbsp;&amp; two</p><ul><li>three</li></ul>four<br/>five")
    assert r.c0 == "One & two\n- three\nfour\nfive"
    assert r.c1 == "One & two\nthree\nfourfive"
    assert r.c2 == "<b>—&lt;"
    assert r.c3 == 'aA"&zzz;\U0001f600'


def test_dates(spark):
    now = F.lit("2026-10-10").cast("timestamp")
    df = spark.createDataFrame([("2026-09-27",), ("Sun, 27 Sep 2026 09:30:00 +0200",), ("Sep 27, 2026",), ("2026-09-27T09:30:00.5Z",), ("soon",), (None,)], "d string")
    assert [r[0] for r in df.select(T.iso_or_null("d")).collect()] == ["2026-09-27T00:00:00.000Z", "2026-09-27T07:30:00.000Z", "2026-09-27T00:00:00.000Z", "2026-09-27T09:30:00.500Z", None, None]
    r = one(spark, T.posted_on(F.lit("Posted 5 Days Ago"), now).cast("string"), T.posted_on(F.lit("Posted 30+ Days Ago"), now), T.min_age_days(F.lit("Posted 30+ Days Ago")))
    assert (r.c0, r.c1, r.c2) == ("2026-10-05", None, 30)


def test_names_and_places(spark):
    r = one(
        spark, T.display_name(F.lit("eleven-labs"), F.lit("eleven-labs")), T.display_name(F.lit("Morgan Stanley"), F.lit("ms")), T.clean_place(F.lit("Austin, , Texas,US,US")), T.dashed_place(F.lit("US-GA-Covington")),
        T.clean_legal_name(F.lit("Personio SE & Co. KG")), T.strip_board_words(F.lit("Delta Sonic Job Board")), T.tidy_name(F.lit("STEPHEN  O'DOE III")), T.us_phone(F.lit("1 (212) 555-0199")), T.host_key(F.lit("jobs.bswhealth.com")),
    )
    assert list(r) == ["Eleven Labs", "Morgan Stanley", "Austin, Texas, US", "Covington, GA, US", "Personio", "Delta Sonic", "Stephen O'Doe III", "+1 212-555-0199", "bswhealth"]


def test_company_entries(spark):
    rows = ["https://boards.greenhouse.io/Acme/jobs/1", "api.lever.co/v0/postings/acme", "https://acme.wd5.myworkdayjobs.com/en-US/Ext/job/1", "Scale AI", "https://example.com/x", " "]
    df = spark.createDataFrame([(r,) for r in rows], "e string").select(T.parse_entry("e").alias("p"))
    got = [(r.p["ats"], r.p["slug"], r.p["site"], r.p["skip"]) for r in df.collect()]
    assert got[:4] == [("greenhouse", "acme", None, None), ("lever", "acme", None, None), ("workday", "acme", "Ext", None), (None, "scaleai", None, None)]
    assert all(g[3] for g in got[4:])


def test_contacts(spark):
    html = '<a href="mailto:Hi%40shop.co?x">a</a> b@shop.co me@example.com <a href="tel:+1 (555) 010-0199">t</a><a href="tel:15550100199">t</a> <a href="https://www.instagram.com/p/">x</a><a href="http://instagram.com/acme/">i</a>'
    r = one(spark, contacts.emails("h"), contacts.phones("h"), contacts.socials("h"), h=html)
    assert r.c0 == ["hi@shop.co", "b@shop.co"]
    assert r.c1 == ["+1 (555) 010-0199"]
    assert r.c2["instagram"] == "https://instagram.com/acme" and r.c2["tiktok"] is None


def test_path_rules(spark):
    robots = "User-agent: *\nDisallow: /admin\nAllow: /admin/open\nDisallow: /*.json$\n\nUser-agent: bot\nUser-agent: other\nDisallow: /x"
    ok = lambda p, who="me": path_allowed(F.lit(robots), F.lit(p), who)
    r = one(spark, ok("/admin/1"), ok("/admin/open/2"), ok("/a/b.json"), ok("/a/b.json?x"), ok("/"), ok("/x/1", "bot"), ok("/admin", "bot"))
    assert list(r) == [False, True, False, True, True, False, True]


def test_versions(spark):
    key, loose = V.version_key, V.loose_key
    r = one(
        spark, key(F.lit("1.9.0")) < key(F.lit("1.10.0")), key(F.lit("1.0.0-rc.1")) < key(F.lit("1.0.0")), key(F.lit("v2.0.0")) == key(F.lit("2.0.0")), key(F.lit("2.0b3")) < key(F.lit("2.0")),
        V.tag_version(F.lit("react@18.2.0")), V.tag_version(F.lit("v2.0")), V.tag_version(F.lit("latest")), loose(F.lit("1.0")) == loose(F.lit("1.0.0")), loose(F.lit("1.0.0.1")) > loose(F.lit("1.0")),
        V.repo(F.lit("git+https://github.com/facebook/react.git")), V.repo(F.lit("https://gitlab.com/a/b")), V.jump(F.lit("1.2.3"), F.lit("1.3.0")),
    )
    assert list(r) == [True, True, True, True, "18.2.0", "2.0.0", None, True, True, "facebook/react", None, "minor"]


def test_breaking_changes(spark):
    body = "## Breaking Changes\n\n- Removed `Dom.render`, see [the guide](https://x.test/g) ([#1](https://x/p))\n- Dropped support for old Node\n\n## Features\n- Added something nice\nBREAKING CHANGE: the `maxSteps` option is gone\n- Renamed `parameters` to `inputSchema` for clarity\n- Removed `_own` thing from the inside\n### \n##\n- \n`"
    got = one(spark, notes.breaking_changes("b"), b=body).c0
    assert [(x["summary"], x["confidence"], x["symbols"]) for x in got] == [
        ("Removed `Dom.render`, see the guide", "high", ["Dom.render"]),
        ("Dropped support for old Node", "high", []),
        ("the `maxSteps` option is gone", "high", ["maxSteps"]),
        ("Removed `Dom.render`, see the guide", "medium", ["Dom.render"]),  # the same line by its phrase; de-duplication drops it
        ("Renamed `parameters` to `inputSchema` for clarity", "medium", ["parameters", "inputSchema"]),
    ]


def test_changelog_sections(spark):
    md = "# Log\n## 6.0.0\nsix things were done here\n## [5.0.0] - 2023\n\nfive things were done here, and more\n### Sub\nx\n## 5.0.0-beta.2\nbeta things were done here\n## 4.9.9\nold"
    empty = "## 5.0.0\n\n\n## 5.0.0-beta.2\nbeta things were done here\n## 5.0.0-beta.1\nmore beta things were done\n## 4.0.0\nx"
    rst = "Version 3.0.0\n-------------\n\nReleased things, many of them\n\nVersion 2.0.0\n-------------\nold"
    r = one(spark, notes.changelog_section("a", F.lit("5.0.0")), notes.changelog_section("b", F.lit("5.0.0")), notes.changelog_section("c", F.lit("3.0.0")), notes.changelog_section("a", F.lit("1.0.0")), a=md, b=empty, c=rst)
    assert r.c0 == "five things were done here, and more\n### Sub\nx"
    assert r.c1 == "## 5.0.0-beta.2\nbeta things were done here\n\n## 5.0.0-beta.1\nmore beta things were done"
    assert r.c2 == "Released things, many of them"
    assert r.c3 is None
