"""Payload normalisers P01-P28: Spark writes the tables' rows as payloads, the normaliser reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..sources import feeds as P
from ..sources import records as R
from .filters import filings
from .registry import query
from .text import spread

lit, col, cat = F.lit, F.col, F.concat


def st(**kw):
    return F.struct(*[v.alias(k) for k, v in kw.items()])


def js(**kw):
    return F.to_json(st(**kw))


def rows(spark, d):
    """Postings with the few extra values payloads carry."""
    return spread(A.postings(spark, d), "k").withColumns(
        {"day": F.date_format("posted_at", "yyyy-MM-dd"), "html": cat(lit("<p>Work on "), "title", lit(" &amp; more</p><ul><li>in "), "location", lit("</li></ul>"))}
    )


def raw(df, body, company=None):
    return df.select((company if company is not None else col("company")).alias("company"), body.alias("body"))


def detail(df, native, body):
    return df.select("company", native.alias("native_id"), body.alias("body"))


TEXT = "'Work on ' || title || ' & more' || chr(10) || '- in ' || location"
BOARD_TEXT = "'Work on ' || title || ' & more' || chr(10) || 'in ' || location"
ISO = "strftime(posted_at, '%Y-%m-%d') || 'T00:00:00.000Z'"


@query("p01_greenhouse", f"""
WITH @postings SELECT 'greenhouse:' || company || ':' || k AS id, title, location || CASE WHEN remote THEN ' (Remote)' ELSE '' END AS location, remote, department, CASE WHEN posted_at IS NOT NULL THEN strftime(posted_at, '%Y-%m-%d') ELSE '2000-01-01' END AS posted_at,
  {BOARD_TEXT} AS description FROM postings""")
def p01(spark, d):
    r = rows(spark, d)
    loc = cat("location", F.when(col("remote"), " (Remote)").otherwise(""))
    content = F.replace(F.replace(F.replace("html", lit("&"), lit("&amp;")), lit("<"), lit("&lt;")), lit(">"), lit("&gt;"))
    job = st(id=col("k"), title=cat(lit(" "), "title"), first_published=col("day"), updated_at=lit("2000-01-01"), absolute_url=col("url"), content=content, location=st(name=loc), departments=F.array(st(name=col("department")), st(name=lit("x"))))
    return P.greenhouse(raw(r, js(jobs=F.array(job)))).select("id", "title", "location", "remote", "department", "posted_at", "description")


@query("p02_lever", f"""
WITH @postings SELECT 'lever:' || company || ':' || k AS id, title, remote AS remote_eligible, false AS remote, {ISO} AS posted_at, 'Intro' || chr(10) || chr(10) || 'Needs' || chr(10) || {BOARD_TEXT} || chr(10) || chr(10) || 'Extra ' || k AS description, department AS employment_type FROM postings""")
def p02(spark, d):
    r = rows(spark, d)
    job = st(
        id=col("k"), text=col("title"), hostedUrl=col("url"), createdAt=F.unix_millis(col("posted_at").cast("timestamp")), descriptionPlain=lit("Intro "), lists=F.array(st(text=lit("Needs"), content=col("html"))),
        additionalPlain=cat(lit("Extra "), "k"), categories=st(location=col("location"), team=lit("T"), commitment=col("department")), workplaceType=F.when(col("remote"), "remote").otherwise("onsite"),
    )
    return P.lever(raw(r, F.to_json(F.array(job)))).select("id", "title", "remote_eligible", "remote", "posted_at", "description", "employment_type")


@query("p03_ashby", """
WITH @postings SELECT 'ashby:' || company || ':' || k AS id, title, remote AS remote_eligible, k % 5 = 0 AND false AS remote, department, url, title || ' text' AS description FROM postings""")
def p03(spark, d):
    r = rows(spark, d)
    job = st(id=col("k").cast("string"), title=col("title"), location=col("location"), team=col("department"), publishedAt=col("day"), jobUrl=F.when(col("k") % 2 == 0, col("url")), applyUrl=col("url"), descriptionPlain=cat("title", lit(" text")), isRemote=col("remote"), compensation=st(x=lit(1)))
    return P.ashby(raw(r, js(jobs=F.array(job)))).select("id", "title", "remote_eligible", "remote", "department", "url", "description")


@query("p04_workable", """
WITH @postings SELECT 'workable:' || company || ':' || k AS id, title, location || ', ' || country AS location, 'Elsewhere, ' || country AS additional, remote, upper(substr(country, 1, 2)) AS country FROM postings""")
def p04(spark, d):
    r = rows(spark, d)
    place = lambda city, hidden=False: st(city=city, region=lit(""), country=col("country"), countryCode=F.upper(F.substring("country", 1, 2)), hidden=lit(hidden))
    job = lambda *spots: st(shortcode=col("k").cast("string"), title=col("title"), telecommuting=col("remote"), department=col("department"), published_on=col("day"), locations=F.array(*spots))
    body = js(name=col("company_name"), jobs=F.array(job(place(col("location"))), job(place(col("location")), place(lit("Elsewhere"))), job(place(lit("Nowhere"), True))))
    return P.workable(raw(r, body)).select("id", "title", "location", F.array_join("additional", ";").alias("additional"), "remote", "country")


@query("p05_workday", f"""
WITH @postings SELECT 'workday:' || company || ':' || CASE WHEN k % 2 = 0 THEN 'R' || k ELSE 'B' || k END AS id, title, CASE WHEN k % 2 = 0 THEN location WHEN k % 3 <> 0 THEN country END AS location, CASE WHEN k % 2 = 0 THEN remote ELSE false END AS remote,
  CASE WHEN k % 2 = 0 THEN coalesce({ISO}, '2001-07-29T00:00:00.000Z') ELSE '2001-07-29T00:00:00.000Z' END AS posted_at, CASE WHEN k % 2 = 0 THEN {TEXT} END AS description FROM postings""")
def p05(spark, d):
    r = rows(spark, d)
    item = st(title=col("title"), externalPath=cat(lit("/job/"), "k"), locationsText=F.when(col("k") % 3 == 0, "3 Locations").otherwise(col("country")), postedOn=lit("Posted 3 Days Ago"), bulletFields=F.array(cat(lit("B"), "k")))
    det = js(jobPostingInfo=st(title=col("title"), jobDescription=col("html"), location=col("location"), startDate=col("day"), remoteType=F.when(col("remote"), "Fully Remote"), jobReqId=cat(lit("R"), "k")))
    out = P.workday(raw(r, js(jobPostings=F.array(item))), detail(r.filter("k % 2 = 0"), cat(lit("/job/"), "k"), det), A.now())
    return out.select("id", "title", "location", "remote", "posted_at", "description")


@query("p06_oracle", f"""
WITH @postings SELECT 'oracle:' || company || ':' || k AS id, title, location, country AS additional, k % 4 = 0 AS remote, CASE WHEN k % 2 = 0 THEN {TEXT} || chr(10) || chr(10) || 'Qualified' END AS description, CASE WHEN k % 2 = 0 THEN 'Full time' ELSE department END AS employment_type FROM postings""")
def p06(spark, d):
    r = rows(spark, d)
    item = st(Id=col("k").cast("string"), Title=col("title"), PostedDate=col("day"), PrimaryLocation=col("location"), PrimaryLocationCountry=lit("US"), WorkplaceType=F.when(col("k") % 4 == 0, "Remote"), JobSchedule=col("department"), secondaryLocations=F.array(st(Name=col("country")), st(Name=lit(""))))
    det = js(items=F.array(st(ExternalDescriptionStr=col("html"), ExternalQualificationsStr=lit("<b>Qualified</b>"), JobSchedule=lit("Full time"))))
    out = P.oracle(raw(r, js(items=F.array(st(requisitionList=F.array(item))))), detail(r.filter("k % 2 = 0"), col("k").cast("string"), det))
    return out.select("id", "title", "location", F.array_join("additional", ";").alias("additional"), "remote", "description", "employment_type")


@query("p07_smartrecruiters", f"""
WITH @postings SELECT 'smartrecruiters:' || company || ':' || k AS id, company_name, location || ', US' AS location, remote, remote OR k % 5 = 0 AS remote_eligible, CASE WHEN remote THEN 'Remote' WHEN k % 5 = 0 THEN 'Hybrid' END AS workplace, {ISO} AS posted_at, department FROM postings""")
def p07(spark, d):
    r = rows(spark, d)
    item = st(id=col("k").cast("string"), name=col("title"), releasedDate=cat("day", lit("T00:00:00.000Z")), company=st(name=col("company_name")), location=st(city=col("location"), country=lit("us"), remote=col("remote"), hybrid=col("k") % 5 == 0), department=st(label=lit("")), function=st(label=col("department")))
    det = js(postingUrl=col("url"), jobAd=st(sections=st(jobDescription=st(text=col("html")))))
    out = P.smartrecruiters(raw(r, js(content=F.array(item))), detail(r, col("k").cast("string"), det))
    return out.select("id", "company_name", "location", "remote", "remote_eligible", "workplace", "posted_at", "department")


@query("p08_bamboohr", """
WITH @postings SELECT 'bamboohr:' || company || ':' || k AS id, CASE WHEN k % 2 = 0 THEN location || ', ' || country ELSE 'Town, ST, ' || country END AS location, CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN 'Remote' ELSE 'Hybrid' END AS workplace, k % 3 = 1 AS remote, k % 3 <> 0 AS remote_eligible, CASE WHEN k % 2 = 0 THEN 'Salary: $50,000' END AS pay_text FROM postings""")
def p08(spark, d):
    r = rows(spark, d)
    item = st(id=col("k").cast("string"), jobOpeningName=col("title"), departmentLabel=col("department"), location=st(city=lit("Town"), state=lit("ST")), atsLocation=st(country=col("country")), locationType=(col("k") % 3).cast("string"))
    det = js(result=st(jobOpening=st(description=col("html"), datePosted=col("day"), location=st(city=col("location"), state=lit(""), addressCountry=col("country")), compensation=lit("$50,000"))))
    out = P.bamboohr(raw(r, js(result=F.array(item))), detail(r.filter("k % 2 = 0"), col("k").cast("string"), det))
    return out.select("id", "location", "workplace", "remote", "remote_eligible", "pay_text")


@query("p09_breezy", """
WITH @postings SELECT 'breezy:' || company || ':' || k AS id, company_name, location, country AS additional, remote, 'Salary: $' || k || ' / hr' AS pay_text, department AS employment_type FROM postings""")
def p09(spark, d):
    r = rows(spark, d)
    job = st(id=col("k").cast("string"), name=col("title"), published_date=col("day"), type=st(name=col("department")), location=st(name=col("location"), country=st(id=lit("US")), is_remote=col("remote")), locations=F.array(st(name=col("location")), st(name=col("country"))), salary=cat(lit("$"), "k", lit(" / hr")), company=st(name=cat("company_name", lit(" "))), description=col("html"))
    out = P.breezy(raw(r, F.to_json(F.array(job))))
    return out.select("id", "company_name", "location", F.array_join("additional", ";").alias("additional"), "remote", "pay_text", "employment_type")


@query("p10_personio", """
WITH @postings SELECT 'personio:' || company || ':' || k AS id, title || ' & co' AS title, location, country AS additional, 'full-time, permanent' AS employment_type, 'Tasks' || chr(10) || title || chr(10) || '- one' AS description FROM postings""")
def p10(spark, d):
    r = rows(spark, d)
    body = cat(
        lit('<?xml version="1.0"?><workzag-jobs><position><id>'), "k", lit("</id><name>"), "title", lit(" &amp; co</name><office>"), "location", lit("</office><additionalOffices><office>"), "country", lit("</office></additionalOffices><department>D</department><schedule>full-time</schedule><employmentType>permanent</employmentType><createdAt>2024-01-02T10:00:00+00:00</createdAt><jobDescriptions><jobDescription><name>Tasks</name><value><![CDATA[<div>"),
        "title", lit("</div><li>one</li>]]></value></jobDescription></jobDescriptions></position></workzag-jobs>"),
    )
    return P.personio(raw(r, body)).select("id", "title", "location", F.array_join("additional", ";").alias("additional"), "employment_type", "description")


@query("p11_rippling", """
WITH @postings SELECT 'rippling:' || company || ':' || k AS id, company_name, location, country AS additional, CASE WHEN remote THEN 'remote' ELSE 'on-site' END AS workplace, remote, CAST(k + 1000 AS DOUBLE) * 100 AS pay_min, 'year' AS period, 'Only this' AS description FROM postings""")
def p11(spark, d):
    from ..functions.pay import STRUCTURED, structured_pay

    r = rows(spark, d)
    spot = lambda n: st(name=n, countryCode=lit("US"), workplaceType=F.when(col("remote"), "REMOTE").otherwise("ON_SITE"))
    item = lambda n: st(id=col("k").cast("string"), name=col("title"), department=st(name=lit("D")), locations=F.array(spot(n)))
    n = (col("k") + 1000) * 100
    det = js(description=st(company=lit("About us"), role=lit("<p>Only this</p>")), createdOn=col("day"), employmentType=st(id=lit("FT")), companyName=col("company_name"), payRangeDetails=F.array(st(currency=lit("USD"), frequency=lit("YEAR"), rangeStart=n, rangeEnd=n + 1)))
    out = P.rippling(raw(r, js(items=F.array(item(col("location")), item(col("country"))))), detail(r, col("k").cast("string"), det))
    pay = structured_pay(F.from_json("compensation", STRUCTURED))
    out = out.withColumn("pay", pay)
    return out.select("id", "company_name", "location", F.array_join("additional", ";").alias("additional"), "workplace", "remote", col("pay.min").alias("pay_min"), col("pay.period").alias("period"), "description")


@query("p12_teamtailor", """
WITH @postings SELECT 'teamtailor:' || company || ':g' || k AS id, company_name, location || ', ' || country AS location, CASE WHEN remote THEN 'Fully' END AS workplace, remote, strftime(first_seen, '%Y-%m-%d') || 'T10:00:00.000Z' AS posted_at, department FROM postings""")
def p12(spark, d):
    r = rows(spark, d)
    body = cat(
        lit('<?xml version="1.0"?><rss xmlns:tt="https://teamtailor.com/locations" version="2.0"><channel><title>'), "company_name", lit("</title><item><title>"), "title", lit("</title><description><![CDATA[<p>x</p>]]></description><pubDate>"),
        F.date_format("first_seen", "EEE, dd MMM yyyy '10:00:00 +0000'"), lit("</pubDate><link>"), "url", lit('</link><guid>g'), "k", lit("</guid><remoteStatus>"), F.when(col("remote"), "fully").otherwise("none"),
        lit("</remoteStatus><tt:locations><tt:location><tt:name>"), "location", lit("</tt:name><tt:country>"), "country", lit("</tt:country></tt:location></tt:locations><tt:department>"), "department", lit("</tt:department></item></channel></rss>"),
    )
    return P.teamtailor(raw(r, body)).select("id", "company_name", "location", "workplace", "remote", "posted_at", "department")


@query("p13_recruitee", """
WITH @postings SELECT 'recruitee:' || company || ':' || k AS id, 'NL' AS country, CASE WHEN remote THEN 'Remote' WHEN k % 5 = 0 THEN 'Hybrid' END AS workplace, CASE WHEN k % 2 = 0 THEN 'Salary: EUR ' || (30000 + k) || ' - EUR ' || (40000 + k) || ' per year' END AS pay_text, title || chr(10) || 'and more' AS description FROM postings""")
def p13(spark, d):
    r = rows(spark, d)
    pay = F.when(col("k") % 2 == 0, st(min=(30_000 + col("k")).cast("string"), max=(40_000 + col("k")).cast("string"), currency=lit("EUR"), period=lit("year")))
    job = st(id=col("k"), title=col("title"), location=col("location"), country_code=lit("nl"), remote=col("remote"), hybrid=col("k") % 5 == 0, published_at=cat("day", lit(" 00:00:00 UTC")), description=cat(lit("<p>"), "title", lit("</p>")), requirements=lit("and more"), salary=pay)
    out = P.recruitee(raw(r, js(offers=F.array(job))))
    return out.select("id", "country", "workplace", "pay_text", F.regexp_replace("description", "\n+", "\n").alias("description"))


@query("p14_ukg", """
WITH @postings SELECT 'ukg:ten' || k || ':' || k AS id, location || ', GA, US' AS location, CASE k % 3 WHEN 2 THEN 'Remote' WHEN 0 THEN 'Hybrid' END AS workplace, k % 3 = 2 AS remote, CASE WHEN k % 2 = 0 THEN 'Full time' ELSE 'Part time' END AS employment_type,
  CASE WHEN k % 2 = 0 THEN 'Salary: USD ' || (50000 + k) || ' - USD ' || (60000 + k) || ' per year' ELSE 'Pay: USD 20.5 - USD 20.5 per hour' END AS pay_text FROM postings""")
def p14(spark, d):
    r = rows(spark, d)
    item = st(Id=col("k").cast("string"), Title=col("title"), FullTime=col("k") % 2 == 0, JobCategoryName=col("department"), PostedDate=col("day"), JobLocationType=F.when(col("k") % 3 == 2, 2).when(col("k") % 3 == 0, 3).otherwise(1), Locations=F.array(st(LocalizedName=lit("L"), Address=st(City=col("location"), State=st(Code=lit("GA")), Country=st(Code=lit("US"))))))
    even = col("k") % 2 == 0
    det = js(Description=col("html"), CompensationCurrencyCode=lit("USD"), CompensationAnnualMinimum=F.when(even, 50_000 + col("k")), CompensationAnnualMaximum=F.when(even, 60_000 + col("k")), CompensationHourlyMinimum=lit(20.5))
    page = cat(lit("<script>var x = new US.Opportunity.CandidateOpportunityDetail("), det, lit(");</script>"))
    co = cat(lit("recruiting2.ultipro.com|ten"), "k", lit("|b1"))
    out = P.ukg(raw(r, js(opportunities=F.array(item)), co), r.select(co.alias("company"), col("k").cast("string").alias("native_id"), page.alias("body")))
    return out.select("id", "location", "workplace", "remote", "employment_type", "pay_text")


@query("p15_jobvite", """
WITH @postings SELECT 'jobvite:' || company || ':j' || k AS id, title, location, department FROM postings UNION ALL SELECT 'jobvite:' || company || ':h' || k, 'Hot one', NULL, NULL FROM postings""")
def p15(spark, d):
    r = rows(spark, d)
    row = lambda i, t: cat(lit('<tr><td class="jv-job-list-name"><a href="/acme/job/'), i, lit('">'), t, lit('<span> | </span>Req#1</a></td> <td class="jv-job-list-location">'), col("location"), lit("</td></tr>"))
    body = cat(
        lit('<h3>Hot Jobs</h3><a href="/acme/job/j'), "k", lit('">Again</a><a href="/acme/job/h'), "k", lit('">Hot one</a><a href="/acme/job/z/apply">apply</a><h3 class="h">'), "department", lit("</h3><table>"), row(cat(lit("j"), "k"), col("title")), lit("</table>")
    )
    return P.jobvite(raw(r, body)).select("id", "title", "location", "department")


@query("p16_phenom", f"""
WITH @postings SELECT 'phenom:bsw:' || CASE WHEN k % 2 = 0 THEN 'S' ELSE 'J' END || k AS id, title, location || ', ' || country AS location, {ISO} AS posted_at, {TEXT} AS description FROM postings""")
def p16(spark, d):
    r = rows(spark, d)
    row = lambda t: st(jobId=cat(lit("J"), "k"), jobSeqNo=F.when(col("k") % 2 == 0, cat(lit("S"), "k")), title=t, cityStateCountry=cat("location", lit(", , "), "country"), category=col("department"))
    page = cat(lit("<script>phApp.ddo = "), js(jobDetail=st(data=st(job=st(description=col("html"), postedDate=col("day"))))), lit("; phApp.x = 1</script>"))
    host = lit("jobs.bsw.com")
    out = P.phenom(raw(r, js(jobs=F.array(row(lit("old title")), row(col("title")))), host), r.select(host.alias("company"), cat(lit("J"), "k").alias("native_id"), page.alias("body")))
    return out.select("id", "title", "location", "posted_at", "description")


@query("p17_icims", """
WITH @postings SELECT 'icims:acme:' || k AS id, CASE WHEN k % 2 = 0 THEN location || ', GA, US' ELSE location || ', Full, US' END AS location, 'Per diem' AS employment_type, department, title || chr(10) || 'duties' || chr(10) || 'skills' AS description FROM postings""")
def p17(spark, d):
    r = rows(spark, d)
    data = st(slug=F.when(col("k") % 3 == 0, col("k").cast("string")), req_id=col("k").cast("string"), title=col("title"), city=col("location"), state=lit("GA"), country=lit("US"), full_location=F.when(col("k") % 2 == 1, cat("location", lit(", Full"))), posted_date=col("day"), employment_type=lit("PER_DIEM"), categories=F.array(st(name=col("department"))), description=col("title"), responsibilities=lit("duties"), qualifications=lit("skills"))
    out = P.icims(raw(r, js(jobs=F.array(st(data=data), st(data=lit(None).cast(data_type(data, r))))), lit("careers.acme.com")))
    return out.select("id", "location", "employment_type", "department", "description")


def data_type(c, df):
    return df.select(c.alias("x")).schema["x"].dataType


@query("p18_icims_portal", """
WITH @postings SELECT 'icims:acme-corp:' || k AS id, title, CASE WHEN k % 2 = 0 THEN location || ', GA, US' ELSE location END AS location, department, 'Day' AS employment_type, 'https://acme-corp.icims.com/jobs/' || k || '/x/job?a=1' AS url FROM postings""")
def p18(spark, d):
    r = rows(spark, d)
    even = col("k") % 2 == 0
    body = cat(
        lit('<ul><li class="iCIMS_JobCardItem"><a href="https://acme-corp.icims.com/jobs/'), "k", lit('/x/job?a=1&amp;in_iframe=1"><h3> '), "title", lit("</h3></a>"),
        F.when(even, cat(lit('<span class="field-label">Location</span> <span>US-GA-'), "location", lit("</span>"))).otherwise(cat(lit('<dt class="iCIMS_JobHeaderField">Location</dt><dd>'), "location", lit("</dd>"))),
        lit('<dt class="iCIMS_JobHeaderField">Category</dt> <dd x><b>'), "department", lit('</b></dd><dt class="iCIMS_JobHeaderField">Job Type</dt><dd>Day</dd></li><li class="iCIMS_JobCardItem">none</li></ul>'),
    )
    return P.icims_portal(raw(r, body, lit("acme-corp.icims.com"))).select("id", "title", "location", "department", "employment_type", "url")


@query("p19_talentbrew", """
WITH @postings SELECT 'talentbrew:acme:' || k AS id, title, 'Columbus, OH' AS location, CASE WHEN k % 3 = 0 THEN department END AS department, 'https://jobs.acme.com/job/' || k || '?a=1&b=2' AS url FROM postings""")
def p19(spark, d):
    r = rows(spark, d)
    k = col("k") % 3
    inner = F.when(k == 0, cat(lit("<h2>"), "title", lit('</h2><span class="job-category">'), "department", lit("</span>"))).when(k == 1, cat(lit('<b class="card-title x">'), "title", lit("</b>"))).otherwise(cat("title", lit("<span>new</span>")))
    a = lambda t: cat(lit('<a href="/job/'), "k", lit('?a=1&amp;b=2" data-job-id="'), "k", lit('">'), t, lit('<span class="job-location">Columbus, OH 43215</span></a>'))
    return P.talentbrew(raw(r, cat(a(inner), a(lit("<h2>again</h2>"))), lit("jobs.acme.com"))).select("id", "title", "location", "department", "url")


@query("p20_taleo", """
WITH @postings SELECT 'taleo:ten:' || CASE WHEN k % 2 = 0 THEN 'C' ELSE 'J' END || k AS id, title, CASE WHEN k % 3 = 0 THEN location ELSE country END AS location, CASE WHEN k % 3 = 0 THEN country ELSE '' END AS additional, strftime(posted_at, '%Y-%m-%d') || 'T00:00:00.000Z' AS posted_at FROM postings""")
def p20(spark, d):
    r = rows(spark, d)
    places = F.when(col("k") % 3 == 0, F.to_json(F.array("location", "country"))).otherwise(col("country"))
    q = lambda t: st(jobId=cat(lit("J"), "k"), contestNo=F.when(col("k") % 2 == 0, cat(lit("C"), "k")).otherwise(""), column=F.array(lit("x"), t, places, F.coalesce(F.date_format("posted_at", "MMM d, yyyy"), lit("soon"))), linkedColumn=lit(1), locationsColumns=F.array(lit(2)))
    out = P.taleo(raw(r, js(requisitionList=F.array(q(col("title")), q(lit("later")))), lit("ten|2|101")))
    return out.select("id", "title", "location", F.array_join("additional", ";").alias("additional"), "posted_at")


@query("p21_to_job", """
WITH @postings SELECT 'demo:customer-' || substr(company, 10) || ':' || k AS id, title, remote OR k % 7 = 0 AS remote, remote OR k % 7 = 0 OR k % 5 = 0 AS remote_eligible, coalesce(nullif(company_name, ''), company) AS company_name FROM postings WHERE k % 4 <> 3""")
def p21(spark, d):
    r = rows(spark, d)
    s = P.staged(
        r, company=F.upper("company"), name=col("company_name"), native_id=col("k"), title=F.when(col("k") % 4 == 3, lit(" \t")).otherwise(cat(lit("\n"), "title", lit(" "))), location=col("location"),
        additional=F.when(col("k") % 7 == 0, F.array(lit("Anywhere, US"))), remote_flag=col("remote"), workplace=F.when(col("k") % 5 == 0, "Hybrid"), posted_raw=col("day"),
    )
    return P.to_job(s, "demo").select("id", "title", "remote", "remote_eligible", "company_name")


@query("p22_jsonld", """
WITH @postings SELECT k, title, strftime(posted_at, '%Y-%m-%d') AS posted, CASE WHEN k % 3 = 2 THEN 'FULL_TIME, PER_DIEM' ELSE 'Full time' END AS kind FROM postings""")
def p22(spark, d):
    r = rows(spark, d)
    item = F.to_json(F.struct(lit("JobPosting").alias("@type"), col("title").alias("title"), col("day").alias("datePosted"), F.when(col("k") % 3 != 2, "FULL_TIME").alias("employmentType")))
    item = F.when(col("k") % 3 == 2, F.regexp_replace(item, r"\}$", ',"employmentType":["FULL_TIME","PER_DIEM"]}')).otherwise(item)
    other = lit('{"@type":"Organization","title":"x"}')
    doc = F.when(col("k") % 3 == 0, item).when(col("k") % 3 == 1, cat(lit("["), other, lit(","), item, lit("]"))).otherwise(cat(lit('{"@graph":['), other, lit(","), item, lit("]}")))
    page = cat(lit('<script type="application/ld+json">not json</script><script type="application/ld+json"> '), doc, lit(" </script>"))
    j = r.select("k", P.jsonld(page).alias("j"))
    return j.select("k", col("j.title").alias("title"), col("j.datePosted").alias("posted"), P.ld_type(col("j.employmentType")).alias("kind"))


@query("p23_hits", """
SELECT 'A-' || o_orderkey AS accession, CASE WHEN o_custkey > 0 THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS cik, CASE WHEN o_orderkey % 2 = 0 THEN 'form.xml' ELSE 'primary_doc.xml' END AS file_name, CASE WHEN o_orderkey % 3 = 0 THEN 'D/A' ELSE 'D' END AS form, 'Firm ' || o_custkey AS name FROM orders""")
def p23(spark, d):
    o = A.table(spark, d, "orders")
    src = st(ciks=F.array(F.lpad(col("o_custkey").cast("string"), 10, "0")), display_names=F.array(cat(lit("Firm "), "o_custkey", lit("  (CIK "), F.lpad(col("o_custkey").cast("string"), 10, "0"), lit(")"))), file_date=F.date_format("o_orderdate", "yyyy-MM-dd"), form=F.when(col("o_orderkey") % 3 == 0, "D/A"))
    hit = st(_id=cat(lit("A-"), "o_orderkey", F.when(col("o_orderkey") % 2 == 0, ":form.xml").otherwise("")), _source=src)
    return R.hits(o.select(js(hits=st(total=st(value=lit(1)), hits=F.array(hit))).alias("body"))).select("accession", "cik", "file_name", "form", "name")


def filing_xml(df):
    """One Form D document per filing row."""
    tag = lambda n, c: cat(lit(f"<{n}>"), c, lit(f"</{n}>"))
    opt = lambda n, c: F.coalesce(tag(n, c), lit(""))
    year = F.when(col("year_of_incorporation").isNotNull(), cat(lit("<withinFiveYears>false</withinFiveYears>"), tag("value", col("year_of_incorporation")))).otherwise(
        F.when(col("incorporated_within") == "Within five years", lit("<withinFiveYears>true</withinFiveYears>")).otherwise(lit("<overFiveYears>true</overFiveYears>"))
    )
    return cat(
        lit('<?xml version="1.0"?><edgarSubmission><submissionType>D</submissionType><primaryIssuer><cik>000'), "cik", lit("</cik><entityName>Firm &amp; Co "), "cik", lit("</entityName><issuerAddress><street1>1 Main St</street1><city>NEW YORK</city><stateOrCountry>NY</stateOrCountry><stateOrCountryDescription>NEW YORK</stateOrCountryDescription><zipCode>1</zipCode></issuerAddress><issuerPhoneNumber>(212) 555-0199</issuerPhoneNumber><jurisdictionOfInc>DELAWARE</jurisdictionOfInc><entityType>Corporation</entityType><yearOfInc>"), year,
        lit("</yearOfInc></primaryIssuer><relatedPersonsList><relatedPersonInfo><relatedPersonName><firstName>ANN</firstName><lastName>O'DOE-"), F.upper("sector"), lit("</lastName></relatedPersonName><relatedPersonAddress><city>BOSTON</city><stateOrCountry>MA</stateOrCountry></relatedPersonAddress><relatedPersonRelationshipList><relationship>Director</relationship><relationship>Promoter</relationship></relatedPersonRelationshipList><relationshipClarification>N/A</relationshipClarification></relatedPersonInfo><relatedPersonInfo><relatedPersonName><firstName>-</firstName><lastName>N/A</lastName></relatedPersonName></relatedPersonInfo></relatedPersonsList><offeringData><industryGroup><industryGroupType>"),
        F.when(col("is_fund"), "Pooled Investment Fund").otherwise(col("industry")), lit("</industryGroupType></industryGroup><issuerSize><revenueRange>Decline to Disclose</revenueRange></issuerSize><federalExemptionsExclusions><item>06b</item><item>3C.7</item></federalExemptionsExclusions><typeOfFiling><newOrAmendment><isAmendment>"),
        (col("filing_type") == "Amendment").cast("string"), lit("</isAmendment></newOrAmendment><dateOfFirstSale><value>2001-01-02</value></dateOfFirstSale></typeOfFiling><typesOfSecuritiesOffered><isEquityType>true</isEquityType><isOtherType>true</isOtherType><descriptionOfOtherType>SAFE</descriptionOfOtherType></typesOfSecuritiesOffered><minimumInvestmentAccepted>0</minimumInvestmentAccepted><offeringSalesAmounts><totalOfferingAmount>"),
        F.when(col("indefinite"), lit("Indefinite")).otherwise(F.format_number(F.floor("offering"), 0)), lit("</totalOfferingAmount>"), opt("totalAmountSold", F.floor("amount_sold").cast("string")),
        lit("</offeringSalesAmounts><investors><hasNonAccreditedInvestors>false</hasNonAccreditedInvestors><totalNumberAlreadyInvested>7</totalNumberAlreadyInvested></investors><signatureBlock><signature><nameOfSigner>Ann Doe</nameOfSigner><signatureTitle>CEO</signatureTitle></signature></signatureBlock></offeringData></edgarSubmission>"),
    )


def filing_docs(spark, d):
    f = spread(filings(spark, d), "accession")
    return f.select(cat(lit("0001-01-"), "accession").alias("accession"), col("cik").cast("string").alias("cik"), lit("primary_doc.xml").alias("file_name"), F.date_format("filed_at", "yyyy-MM-dd").alias("filed_at"), filing_xml(f).alias("body"))


@query("p24_form_d", """
WITH @filings SELECT '0001-01-' || accession AS accession, 'Firm & Co ' || cik AS company_name, filing_type, CASE WHEN is_fund THEN 'Financial Services' ELSE sector END AS sector, is_fund, year_of_incorporation, CASE WHEN year_of_incorporation IS NULL THEN incorporated_within END AS incorporated_within,
  'New York' AS city, '+1 212-555-0199' AS phone, CASE WHEN NOT indefinite THEN floor(offering) END AS offering, indefinite, floor(amount_sold) AS amount_sold, 'Equity;Other: SAFE' AS securities, 'Rule 506(b);Investment Company Act Section 3(c)(7)' AS exemptions, 'Ann O''Doe-' || sector || ' (Director, Promoter)' AS executives_text,
  'https://www.sec.gov/Archives/edgar/data/' || CASE WHEN cik = 0 THEN '' ELSE CAST(cik AS VARCHAR) END || '/000101' || accession || '/0001-01-' || accession || '-index.htm' AS filing_url FROM filings""")
def p24(spark, d):
    f = R.form_d(filing_docs(spark, d))
    text = lambda c: F.array_join(c, ";").alias(c)
    return f.select("accession", "company_name", "filing_type", "sector", "is_fund", col("year_of_incorporation").cast("bigint").alias("year_of_incorporation"), "incorporated_within", "city", "phone", "offering", "indefinite", "amount_sold", text("securities"), text("exemptions"), "executives_text", "filing_url")


@query("p25_store_meta", """
SELECT 'd' || s_suppkey AS domain, s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 AS valid, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 THEN s_name END AS name, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 THEN 'USD' END AS currency, CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 THEN s_suppkey END AS product_count,
  CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 THEN 'US;*' ELSE '' END AS ships_to FROM supplier""")
def p25(spark, d):
    s = A.table(spark, d, "supplier")
    k = col("s_suppkey")
    full = js(name=cat(lit(" "), "s_name"), currency=lit("usd"), city=lit(" "), country=lit("us"), ships_to_countries=F.array(lit("us"), lit("*")), published_products_count=k)
    body = F.when(k % 5 == 0, js(name=col("s_name"), price=lit(1))).when(k % 7 == 0, lit("<html>not json</html>")).otherwise(full)
    return R.store_meta(s.select(cat(lit("d"), k).alias("domain"), body.alias("body"))).select("domain", "valid", "name", "currency", "product_count", F.array_join("ships_to", ";").alias("ships_to"))


@query("p26_packages", """
SELECT 'npm' AS ecosystem, 'pkg-' || p_partkey AS name, '2.0.0;1.0.0;3.0.0-rc.1' AS versions, CASE WHEN p_partkey % 2 = 0 THEN '1.0.0' ELSE '3.0.0-rc.1' END AS latest, 'own/pkg' || p_partkey AS repository, CASE WHEN p_partkey % 2 = 0 THEN 'use other' END AS deprecated FROM part
UNION ALL SELECT 'pypi', 'py-' || p_partkey, '0.9;1.0', '1.0', 'own/py' || p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'yanked' END FROM part""")
def p26(spark, d):
    p = A.table(spark, d, "part")
    k = col("p_partkey")
    npm = cat(
        lit('{"name":"pkg-'), k, lit('","versions":{"1.0.0":{"deprecated":"use other"},"2.0.0":{},"3.0.0-rc.1":{"repository":{"type":"git","url":"git+https://github.com/own/pkg'), k, lit('.git"}}},"time":{"created":"2019-01-01T00:00:00.000Z","1.0.0":"2021-01-01T00:00:00.000Z","2.0.0":"2020-01-01T00:00:00.000Z","3.0.0-rc.1":"2022-01-01T00:00:00.000Z"}'),
        F.when(k % 2 == 0, cat(lit(',"dist-tags":{"latest":"1.0.0"},"repository":"github:x https://github.com/own/pkg'), k, lit('"'))).otherwise(lit("")), lit("}"),
    )
    pypi = cat(
        lit('{"info":{"name":"py-'), k, lit('","version":"1.0","summary":"s","project_urls":{"Docs":"https://x.org","Issue Tracker":"https://github.com/own/py'), k, lit('/issues"},"yanked":'), (k % 3 == 0).cast("string"),
        lit('},"releases":{"1.0":[{"upload_time_iso_8601":"2022-01-01T00:00:00.000Z"}],"0.9":[{"upload_time_iso_8601":"2021-01-01T00:00:00.000Z"}]}}'),
    )
    a = R.npm_packages(p.select(npm.alias("body"))).unionByName(R.pypi_packages(p.select(pypi.alias("body"))))
    return a.select("ecosystem", "name", F.array_join("versions", ";").alias("versions"), "latest", "repository", "deprecated")


@query("p27_releases", """
SELECT p_partkey AS pkg, p_size || '.0.0' AS version, 'v' || p_size || '.0' AS tag, 'Notes of ' || p_name AS body FROM part UNION ALL SELECT p_partkey, '0.1.0-rc.1', 'lib@0.1.0-rc.1', '' FROM part""")
def p27(spark, d):
    p = A.table(spark, d, "part")
    r = lambda tag, body, draft=False: st(tag_name=tag, body=body, published_at=lit("2024-01-01"), html_url=lit("u"), draft=lit(draft))
    body = F.to_json(F.array(r(cat(lit("v"), "p_size", lit(".0")), cat(lit("Notes of "), "p_name")), r(lit("lib@0.1.0-rc.1"), lit(None).cast("string")), r(lit("v9.9.9"), lit("x"), True), r(lit("nightly"), lit("x"))))
    return R.releases(p.select(col("p_partkey").alias("pkg"), body.alias("body")), ["pkg"]).select("pkg", "version", "tag", "body")


@query("p28_advisories", """
SELECT p_partkey AS pkg, i AS pos, 'GHSA-' || p_partkey || '-' || i AS id, CASE i % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'moderate' ELSE 'unknown' END AS severity, p_size <= 25 AND i % 2 = 0 AS fixed_by_upgrade FROM part, range(30) t(i)""")
def p28(spark, d):
    p = spread(A.table(spark, d, "part"), "p_partkey")
    fixed = cat(col("p_size"), lit(".0"))
    vuln = lambda i: st(
        id=cat(lit("GHSA-"), "p_partkey", lit("-"), i), details=lit("long text"), database_specific=st(severity=F.when(i % 3 == 0, "HIGH").otherwise("")), severity=F.array(st(type=lit("CVSS_V3"), score=F.when(i % 3 == 1, "5.0").otherwise("CVSS:3.1/AV:N"))),
        affected=F.array(st(ranges=F.array(st(type=lit("SEMVER"), events=F.array(st(introduced=lit("0"), fixed=lit(None).cast("string")), st(introduced=lit(None).cast("string"), fixed=F.when(i % 2 == 0, fixed))))))),
    )
    body = F.to_json(st(vulns=F.transform(F.sequence(lit(0), lit(29)), vuln)))
    return R.advisories(p.select(col("p_partkey").alias("pkg"), body.alias("body")), ["pkg"], lit("25.0.0")).select("pkg", col("pos").cast("bigint").alias("pos"), "id", "severity", "fixed_by_upgrade")
