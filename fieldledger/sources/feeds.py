"""Payloads of hiring systems to one job schema.

Input is a table of captured payloads: one row per response with `company` and `body` (systems with a detail call:
a second table with `company`, `native_id`, `body`). Each normaliser reads the body with an explicit schema, explodes
its postings and stages the common columns; `to_job` then builds the job row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.pay import STRUCTURED
from ..operators.groups import first_per_group

STAGED = {
    "company": "string", "name": "string", "native_id": "string", "title": "string", "location": "string", "additional": "array<string>", "country": "string",
    "workplace": "string", "remote_flag": "boolean", "department": "string", "posted_raw": "string", "url": "string", "employment_type": "string",
    "description": "string", "pay_text": "string", "compensation": "string",
}


def staged(df: DataFrame, **cols: Column) -> DataFrame:
    """The staging columns, null where a system has none."""
    return df.select(*[(cols[c] if c in cols else F.lit(None)).cast(t).alias(c) for c, t in STAGED.items()])


def _s(c: Column) -> Column:
    """Null for empty text."""
    return F.nullif(c, F.lit(""))


def _rest(a: Column) -> Column:
    return F.slice(a, F.lit(2), F.greatest(F.size(a), F.lit(1)))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def to_job(df: DataFrame, source: str) -> DataFrame:
    """Id, trimmed title (rows without one go), remote from flag or text, hybrid as remote-eligible, ISO date."""
    company = F.lower("company")
    places = F.concat_ws(" ", F.coalesce("location", F.lit("")), F.concat_ws(" ", "additional"), F.coalesce("workplace", F.lit("")))
    remote = _flag(F.col("remote_flag")) | places.rlike(T.REMOTE_SITE)
    return df.withColumn("title", T.trimmed("title")).filter("title <> ''").select(
        F.concat_ws(":", F.lit(source), company, "native_id").alias("id"),
        F.lit(source).alias("source"),
        company.alias("company"),
        F.coalesce(T.blank_to_null("name"), "company").alias("company_name"),
        "title",
        "location",
        F.coalesce("additional", F.array().cast("array<string>")).alias("additional"),
        "country",
        remote.alias("remote"),
        (remote | _flag(F.col("workplace").rlike("(?i)hybrid"))).alias("remote_eligible"),
        "workplace",
        "department",
        T.iso_or_null("posted_raw").alias("posted_at"),
        "url",
        "employment_type",
        _s(F.col("description")).alias("description"),
        "pay_text",
        "compensation",
    )


def board_job(df: DataFrame, source: str) -> DataFrame:
    """The three boards: remote is what place and title say, the board's own flag only makes a row eligible; dates stay as given."""
    remote = T.is_remote(F.col("location"), F.col("title"), words=T.REMOTE_BOARD)
    return df.withColumn("_flag", _flag(F.col("remote_flag"))).select(
        F.concat_ws(":", F.lit(source), "company", "native_id").alias("id"), F.lit(source).alias("source"), "company", F.col("company").alias("company_name"),
        T.trimmed("title").alias("title"), "location", F.array().cast("array<string>").alias("additional"), "country", remote.alias("remote"),
        (remote | F.col("_flag")).alias("remote_eligible"), "workplace", "department", F.col("posted_raw").alias("posted_at"), "url", "employment_type", "description", "pay_text", "compensation",
    )


def _rows(raw: DataFrame, schema: str, path: str | None = None) -> DataFrame:
    """One row per posting `p` of a JSON body; a body that does not parse gives none.

    `_at` is the posting's place: the page's `seq` (0 where a company has one page), then its place on the page.
    """
    doc = F.from_json("body", schema)
    seq = F.col("seq") if "seq" in raw.columns else F.lit(0)
    r = raw.select("company", seq.alias("_seq"), F.posexplode(doc[path] if path else doc).alias("_i", "p"))
    return r.select("company", F.struct("_seq", "_i").alias("_at"), "p")


def _detailed(lists: DataFrame, details: DataFrame, native_id: Column, schema: str, pick=lambda d: d) -> DataFrame:
    """List rows with their detail `d` where one was captured."""
    got = details.select(F.lower("company").alias("_c"), F.col("native_id").alias("_n"), pick(F.from_json("body", schema)).alias("d"))
    keyed = lists.withColumn("_c", F.lower("company")).withColumn("_n", native_id)
    return keyed.join(got, ["_c", "_n"], "left")


# ---------------------------------------------------------------- P01-P04 boards and widget feeds

def greenhouse(raw: DataFrame) -> DataFrame:
    """P01."""
    r = _rows(raw, "jobs array<struct<id:string,title:string,updated_at:string,first_published:string,absolute_url:string,content:string,location:struct<name:string>,departments:array<struct<name:string>>,pay_input_ranges:array<struct<min_cents:double,max_cents:double,currency_type:string>>>>", "jobs")
    p = F.col("p")
    comp = F.when(F.size(p["pay_input_ranges"]) > 0, F.to_json(F.struct(p["pay_input_ranges"].alias("payInputRanges"))))
    return board_job(
        staged(
            r, company=F.col("company"), native_id=p["id"], title=p["title"], location=p["location"]["name"], department=F.get(p["departments"], 0)["name"],
            posted_raw=F.coalesce(p["first_published"], p["updated_at"]), url=p["absolute_url"],
            description=T.board_html_to_text(T.decode_markup(F.coalesce(p["content"], F.lit("")))), compensation=comp,
        ),
        "greenhouse",
    )


def lever(raw: DataFrame) -> DataFrame:
    """Four description parts, dates as epoch milliseconds."""
    r = _rows(raw, "array<struct<id:string,text:string,hostedUrl:string,createdAt:bigint,descriptionPlain:string,lists:array<struct<text:string,content:string>>,additionalPlain:string,salaryDescriptionPlain:string,salaryRange:struct<min:double,max:double,currency:string,interval:string>,categories:struct<location:string,team:string,commitment:string>,workplaceType:string>>")
    p = F.col("p")
    sections = F.transform(F.coalesce(p["lists"], F.array()), lambda x: T.join_present("\n", x["text"], T.board_html_to_text(x["content"])))
    parts = F.concat(F.array(p["descriptionPlain"]), sections, F.array(p["additionalPlain"], p["salaryDescriptionPlain"]))
    parts = F.filter(F.transform(parts, lambda x: T.trimmed(F.coalesce(x, F.lit("")))), lambda x: x != "")
    comp = F.when(p["salaryRange"].isNotNull(), F.to_json(F.struct(p["salaryRange"].alias("leverSalaryRange"))))
    at = F.date_format(F.timestamp_millis(p["createdAt"]), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return board_job(
        staged(
            r, company=F.col("company"), native_id=p["id"], title=p["text"], location=p["categories"]["location"], department=p["categories"]["team"], posted_raw=at,
            url=p["hostedUrl"], remote_flag=p["workplaceType"] == "remote", employment_type=p["categories"]["commitment"],
            description=F.array_join(parts, "\n\n"), compensation=comp,
        ),
        "lever",
    )


def ashby(raw: DataFrame) -> DataFrame:
    """P03."""
    r = _rows(raw, "jobs array<struct<id:string,title:string,location:string,department:string,team:string,publishedAt:string,jobUrl:string,applyUrl:string,descriptionPlain:string,descriptionHtml:string,employmentType:string,isRemote:boolean,compensation:string>>", "jobs")
    p = F.col("p")
    return board_job(
        staged(
            r, company=F.col("company"), native_id=p["id"], title=p["title"], location=p["location"], department=F.coalesce(p["department"], p["team"]),
            posted_raw=p["publishedAt"], url=F.coalesce(p["jobUrl"], p["applyUrl"], F.lit("")), remote_flag=p["isRemote"], employment_type=p["employmentType"],
            description=F.coalesce(p["descriptionPlain"], T.board_html_to_text(p["descriptionHtml"])), compensation=p["compensation"],
        ),
        "ashby",
    )


def workable(raw: DataFrame) -> DataFrame:
    """The feed repeats a job once per place. Places are made distinct before they are collected per job."""
    r = _rows(raw, "name string, jobs array<struct<shortcode:string,title:string,employment_type:string,telecommuting:boolean,department:string,url:string,published_on:string,created_at:string,description:string,locations:array<struct<country:string,countryCode:string,city:string,region:string,hidden:boolean>>>>", "jobs")
    r = r.select("company", F.col("p.shortcode").alias("native_id"), "_at", "p")
    key = ["company", "native_id"]
    jobs = first_per_group(r, key, [F.col("_at")])
    spots = r.select(*key, "_at", F.posexplode("p.locations").alias("_i", "l"))
    where = [F.coalesce(F.col(f"l.{c}"), F.lit("\0")).alias(f"_{c}") for c in ("city", "region", "country")]
    spots = spots.select(*key, *where, F.struct("_at", "_i").alias("_o"), "l").groupBy(*key, "_city", "_region", "_country").agg(F.min(F.struct("_o", "l")).alias("f"))
    spots = spots.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list("f")), lambda x: x["l"]).alias("spots"))
    j = jobs.join(spots, key, "left")
    p = F.col("p")
    seen = F.filter("spots", lambda x: ~_flag(x["hidden"]))
    names = F.filter(F.transform(seen, lambda x: T.join_present(", ", x["city"], x["region"], x["country"])), lambda x: x.isNotNull())
    j = j.withColumn("_names", names)
    return to_job(
        staged(
            j, company=F.col("company"), native_id=F.col("native_id"), title=p["title"], location=F.get("_names", 0), additional=_rest(F.col("_names")), country=F.get("spots", 0)["countryCode"],
            workplace=F.when(p["telecommuting"], "Remote"), remote_flag=p["telecommuting"], department=_s(p["department"]), posted_raw=F.coalesce(p["published_on"], p["created_at"]),
            url=F.coalesce(p["url"], F.concat(F.lit("https://apply.workable.com/j/"), "native_id")), employment_type=_s(p["employment_type"]), description=T.html_to_text(p["description"]),
        ),
        "workable",
    )


# ---------------------------------------------------------------- P05-P07 list and detail

def workday(lists: DataFrame, details: DataFrame, now: Column) -> DataFrame:
    """Detail preferred; "3 Locations" is no place; a relative date stands in for a missing one."""
    r = _rows(lists, "jobPostings array<struct<title:string,externalPath:string,locationsText:string,postedOn:string,bulletFields:array<string>,remoteType:string>>", "jobPostings")
    r = _detailed(r, details, F.col("p.externalPath"), "jobPostingInfo struct<title:string,jobDescription:string,location:string,additionalLocations:array<string>,postedOn:string,startDate:string,timeType:string,remoteType:string,jobReqId:string,externalUrl:string,country:struct<descriptor:string>>", lambda d: d["jobPostingInfo"])
    p, d = F.col("p"), F.col("d")
    rel = F.date_format(T.posted_on(F.coalesce(d["postedOn"], p["postedOn"]), now), "yyyy-MM-dd")
    return to_job(
        staged(
            r, company=F.col("company"), native_id=F.coalesce(d["jobReqId"], F.get(p["bulletFields"], 0), p["externalPath"]), title=F.coalesce(d["title"], p["title"]),
            location=F.coalesce(d["location"], T.place_not_count(p["locationsText"])), additional=d["additionalLocations"], country=d["country"]["descriptor"],
            workplace=F.coalesce(d["remoteType"], p["remoteType"]), posted_raw=F.coalesce(d["startDate"], rel), url=F.coalesce(d["externalUrl"], p["externalPath"]),
            employment_type=d["timeType"], description=T.html_to_text(d["jobDescription"]),
        ),
        "workday",
    ).withColumn("remote_eligible", F.col("remote"))


def _three(parts: list[Column]) -> Column:
    return T.join_present("\n\n", *[T.html_to_text(c) for c in parts])


def oracle(lists: DataFrame, details: DataFrame) -> DataFrame:
    """Three description parts."""
    r = _rows(lists, "items array<struct<requisitionList:array<struct<Id:string,Title:string,PostedDate:string,PrimaryLocation:string,PrimaryLocationCountry:string,WorkplaceType:string,JobFamily:string,JobSchedule:string,secondaryLocations:array<struct<Name:string>>>>>>", "items")
    r = r.select("company", F.explode("p.requisitionList").alias("p"))
    r = _detailed(r, details, F.col("p.Id"), "items array<struct<ExternalDescriptionStr:string,ExternalResponsibilitiesStr:string,ExternalQualificationsStr:string,ExternalPostedStartDate:string,JobSchedule:string,WorkplaceType:string>>", lambda d: F.get(d["items"], 0))
    p, d = F.col("p"), F.col("d")
    return to_job(
        staged(
            r, company=F.col("company"), native_id=p["Id"], title=p["Title"], location=p["PrimaryLocation"],
            additional=F.filter(F.transform(p["secondaryLocations"], lambda x: _s(x["Name"])), lambda x: x.isNotNull()), country=p["PrimaryLocationCountry"],
            workplace=F.coalesce(_s(d["WorkplaceType"]), _s(p["WorkplaceType"])), department=_s(p["JobFamily"]), posted_raw=F.coalesce(d["ExternalPostedStartDate"], p["PostedDate"]),
            url=F.concat(F.lit("/job/"), p["Id"]), employment_type=F.coalesce(_s(d["JobSchedule"]), _s(p["JobSchedule"])),
            description=_three([d["ExternalDescriptionStr"], d["ExternalResponsibilitiesStr"], d["ExternalQualificationsStr"]]),
        ),
        "oracle",
    ).withColumn("remote_eligible", F.col("remote"))


def smartrecruiters(lists: DataFrame, details: DataFrame) -> DataFrame:
    """Remote is the system's own flag; hybrid counts as remote-eligible."""
    r = _rows(lists, "content array<struct<id:string,name:string,releasedDate:string,company:struct<identifier:string,name:string>,location:struct<city:string,region:string,country:string,fullLocation:string,remote:boolean,hybrid:boolean>,department:struct<label:string>,function:struct<label:string>,typeOfEmployment:struct<label:string>>>", "content")
    sec = "struct<title:string,text:string>"
    r = _detailed(r, details, F.col("p.id"), f"postingUrl string, jobAd struct<sections:struct<jobDescription:{sec},qualifications:{sec},additionalInformation:{sec}>>")
    p, d = F.col("p"), F.col("d")
    loc, s = p["location"], d["jobAd"]["sections"]
    job = to_job(
        staged(
            r, company=F.col("company"), name=p["company"]["name"], native_id=p["id"], title=p["name"], location=F.coalesce(loc["fullLocation"], T.join_present(", ", loc["city"], loc["region"], F.upper(loc["country"]))),
            country=F.upper(_s(loc["country"])), workplace=F.when(_flag(loc["remote"]), "Remote").when(_flag(loc["hybrid"]), "Hybrid"), remote_flag=loc["remote"],
            department=F.coalesce(_s(p["department"]["label"]), _s(p["function"]["label"])), posted_raw=p["releasedDate"],
            url=F.coalesce(d["postingUrl"], F.concat(F.lit("https://jobs.smartrecruiters.com/"), "company", F.lit("/"), p["id"])), employment_type=p["typeOfEmployment"]["label"],
            description=_three([s["jobDescription"]["text"], s["qualifications"]["text"], s["additionalInformation"]["text"]]),
        ),
        "smartrecruiters",
    )
    return job.withColumn("remote", _flag(F.col("workplace") == "Remote")).withColumn("remote_eligible", F.col("workplace").isNotNull())


# ---------------------------------------------------------------- P08-P14 small systems

def _salary(text: Column) -> Column:
    """A pay field is read like a pay line of a description."""
    return F.when(_s(text).isNotNull(), F.concat(F.lit("Salary: "), text))


def bamboohr(lists: DataFrame, details: DataFrame) -> DataFrame:
    """Workplace codes 0 on-site, 1 remote, 2 hybrid."""
    r = _rows(lists, "result array<struct<id:string,jobOpeningName:string,departmentLabel:string,employmentStatusLabel:string,location:struct<city:string,state:string>,atsLocation:struct<country:string>,isRemote:boolean,locationType:string>>", "result")
    r = _detailed(r, details, F.col("p.id"), "result struct<jobOpening:struct<description:string,datePosted:string,location:struct<city:string,state:string,addressCountry:string>,compensation:string>>", lambda d: d["result"]["jobOpening"])
    p, d = F.col("p"), F.col("d")
    country = F.coalesce(_s(d["location"]["addressCountry"]), _s(p["atsLocation"]["country"]))
    own = d["location"].isNotNull()
    place = T.join_present(", ", F.when(own, d["location"]["city"]).otherwise(p["location"]["city"]), F.when(own, d["location"]["state"]).otherwise(p["location"]["state"]), country)
    remote = _flag(p["isRemote"]) | _flag(p["locationType"] == "1")
    return to_job(
        staged(
            r, company=F.col("company"), native_id=p["id"], title=p["jobOpeningName"], location=place, country=country, workplace=F.when(remote, "Remote").when(p["locationType"] == "2", "Hybrid"),
            remote_flag=remote, department=_s(p["departmentLabel"]), posted_raw=d["datePosted"], url=F.concat(F.lit("https://"), "company", F.lit(".bamboohr.com/careers/"), p["id"]),
            employment_type=_s(p["employmentStatusLabel"]), description=T.html_to_text(d["description"]), pay_text=_salary(d["compensation"]),
        ),
        "bamboohr",
    )


def breezy(raw: DataFrame) -> DataFrame:
    """P09."""
    r = _rows(raw, "array<struct<id:string,name:string,url:string,published_date:string,type:struct<name:string>,location:struct<name:string,country:struct<id:string,name:string>,is_remote:boolean>,locations:array<struct<name:string>>,department:string,salary:string,company:struct<name:string>,description:string>>")
    p = F.col("p")
    more = F.filter(F.transform(p["locations"], lambda x: _s(x["name"])), lambda x: x.isNotNull() & ~x.eqNullSafe(p["location"]["name"]))
    return to_job(
        staged(
            r, company=F.col("company"), name=p["company"]["name"], native_id=p["id"], title=p["name"], location=p["location"]["name"], additional=more, country=p["location"]["country"]["id"],
            workplace=F.when(p["location"]["is_remote"], "Remote"), remote_flag=p["location"]["is_remote"], department=_s(p["department"]), posted_raw=p["published_date"],
            url=F.coalesce(p["url"], F.concat(F.lit("https://"), "company", F.lit(".breezy.hr/p/"), p["id"])), employment_type=p["type"]["name"], description=T.html_to_text(p["description"]), pay_text=_salary(p["salary"]),
        ),
        "breezy",
    )


PERSONIO = (
    "position array<struct<id:string,name:string,subcompany:string,office:string,additionalOffices:struct<office:array<string>>,department:string,schedule:string,employmentType:string,"
    "createdAt:string,jobDescriptions:struct<jobDescription:array<struct<name:string,value:string>>>>>"
)


def personio(raw: DataFrame) -> DataFrame:
    """P10: XML; further offices, titled description sections."""
    r = raw.select("company", F.explode(F.from_xml("body", PERSONIO)["position"]).alias("p"))
    p = F.col("p")
    sections = F.transform(p["jobDescriptions"]["jobDescription"], lambda x: F.concat(F.lit("<h3>"), F.coalesce(x["name"], F.lit("")), F.lit("</h3>"), F.coalesce(x["value"], F.lit(""))))
    return to_job(
        staged(
            r, company=F.col("company"), native_id=p["id"], title=p["name"], location=p["office"], additional=p["additionalOffices"]["office"], department=p["department"], posted_raw=p["createdAt"],
            url=F.concat(F.lit("https://"), "company", F.lit(".jobs.personio.de/job/"), p["id"]), employment_type=T.join_present(", ", p["schedule"], p["employmentType"]),
            description=T.html_to_text(F.array_join(sections, "")),
        ),
        "personio",
    )


def rippling(lists: DataFrame, details: DataFrame) -> DataFrame:
    """One row per job and place in the list, merged in list order; pay as data."""
    r = _rows(lists, "items array<struct<id:string,name:string,url:string,department:struct<name:string>,locations:array<struct<name:string,countryCode:string,workplaceType:string>>>>", "items")
    # A job's places are few: they are one payload's rows.
    g = r.groupBy("company", F.col("p.id").alias("id")).agg(
        F.max_by("p", "_at").alias("p"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_at", F.coalesce("p.locations", F.array()).alias("l")))), lambda x: x["l"])).alias("spots")
    )
    g = _detailed(g, details, F.col("id"), "description map<string,string>, createdOn string, employmentType struct<id:string>, companyName string, payRangeDetails array<struct<currency:string,frequency:string,rangeStart:double,rangeEnd:double>>")
    p, d = F.col("p"), F.col("d")
    names = F.filter(F.transform("spots", lambda x: _s(x["name"])), lambda x: x.isNotNull())
    kind = F.get(F.filter("spots", lambda x: _s(x["workplaceType"]).isNotNull()), 0)["workplaceType"]
    g = g.withColumns({"_names": names, "_kind": F.lower(F.regexp_replace(kind, "^([^_]*)_", "$1-"))})
    text = F.array_join(F.transform(F.map_entries(F.map_filter(d["description"], lambda k, v: k != "company")), lambda e: e["value"]), "\n")
    first_pay = F.get(F.filter(d["payRangeDetails"], lambda x: _s(x["currency"]).isNotNull() & ((F.coalesce(x["rangeStart"], F.lit(0)) != 0) | (F.coalesce(x["rangeEnd"], F.lit(0)) != 0))), 0)
    comp = T.let(first_pay, lambda pay: F.when(pay.isNotNull() & pay["frequency"].isin("HOUR", "DAY", "WEEK", "MONTH", "YEAR"), F.to_json(F.struct(F.array(F.struct(F.array(F.struct(
        F.lit("Salary").alias("compensationType"), F.concat(F.lit("1 "), pay["frequency"]).alias("interval"), pay["currency"].alias("currencyCode"), pay["rangeStart"].alias("minValue"), pay["rangeEnd"].alias("maxValue"),
    )).alias("components"))).alias("compensationTiers")))))
    return to_job(
        staged(
            g, company=F.col("company"), name=d["companyName"], native_id=F.col("id"), title=p["name"], location=F.get("_names", 0), additional=_rest(F.col("_names")), country=F.get("spots", 0)["countryCode"],
            workplace=F.col("_kind"), remote_flag=F.col("_kind") == "remote", department=p["department"]["name"], posted_raw=d["createdOn"], url=F.coalesce(p["url"], F.concat(F.lit("https://ats.rippling.com/"), "company", F.lit("/jobs/"), "id")),
            employment_type=d["employmentType"]["id"], description=T.html_to_text(text), compensation=comp,
        ),
        "rippling",
    )


TEAMTAILOR = (
    "channel struct<title:string,item:array<struct<guid:string,title:string,link:string,pubDate:string,remoteStatus:string,`tt:department`:string,"
    "`tt:locations`:struct<`tt:location`:array<struct<`tt:name`:string,`tt:city`:string,`tt:country`:string>>>,description:string>>>"
)


def teamtailor(raw: DataFrame) -> DataFrame:
    """RSS; the company is the channel's title."""
    r = raw.select("company", F.from_xml("body", TEAMTAILOR)["channel"].alias("c")).select("company", F.col("c.title").alias("name"), F.explode("c.item").alias("p"))
    p = F.col("p")
    spots = p["tt:locations"]["tt:location"]
    names = F.filter(F.transform(spots, lambda x: T.join_present(", ", F.coalesce(x["tt:name"], x["tt:city"]), x["tt:country"])), lambda x: x.isNotNull())
    kind = F.when(p["remoteStatus"] != "none", F.concat(F.upper(F.substring(p["remoteStatus"], 1, 1)), F.substr(p["remoteStatus"], F.lit(2))))
    return to_job(
        staged(
            r, company=F.col("company"), name=F.col("name"), native_id=F.coalesce(p["guid"], p["link"]), title=p["title"], location=F.get(names, 0), additional=_rest(names), country=F.get(spots, 0)["tt:country"],
            workplace=kind, remote_flag=p["remoteStatus"] == "fully", department=p["tt:department"], posted_raw=p["pubDate"], url=p["link"], description=T.html_to_text(p["description"]),
        ),
        "teamtailor",
    )


def recruitee(raw: DataFrame) -> DataFrame:
    """Pay as data is written out and read like text, which also tests that it is plausible."""
    r = _rows(raw, "offers array<struct<id:string,title:string,careers_url:string,location:string,country_code:string,remote:boolean,hybrid:boolean,department:string,published_at:string,employment_type_code:string,company_name:string,description:string,requirements:string,salary:struct<min:string,max:string,currency:string,period:string>>>", "offers")
    p = F.col("p")
    s = p["salary"]
    lo, hi = F.coalesce(s["min"], s["max"]).try_cast("double"), F.coalesce(s["max"], s["min"]).try_cast("double")
    num = lambda x: F.regexp_replace(F.call_function("format_number", x, F.lit("0.##")), r"\.$", "")
    pay = F.when(_s(s["currency"]).isNotNull() & s["period"].isin("hour", "day", "week", "month", "year") & (lo > 0), F.concat(F.lit("Salary: "), s["currency"], F.lit(" "), num(lo), F.lit(" - "), s["currency"], F.lit(" "), num(hi), F.lit(" per "), s["period"]))
    return to_job(
        staged(
            r, company=F.col("company"), name=p["company_name"], native_id=p["id"], title=p["title"], location=p["location"], country=F.upper(p["country_code"]), workplace=F.when(p["remote"], "Remote").when(p["hybrid"], "Hybrid"),
            remote_flag=p["remote"], department=p["department"], posted_raw=p["published_at"], url=F.coalesce(p["careers_url"], F.concat(F.lit("https://"), "company", F.lit(".recruitee.com/o/"), p["id"])),
            employment_type=p["employment_type_code"], description=T.html_to_text(T.join_present("<br>", p["description"], p["requirements"])), pay_text=pay,
        ),
        "recruitee",
    )


def ukg(lists: DataFrame, details: DataFrame) -> DataFrame:
    """The detail page holds its JSON inside a script; yearly pay before hourly. `company` is host|tenant|board or tenant|board."""
    r = _rows(lists, "opportunities array<struct<Id:string,Title:string,FullTime:boolean,JobCategoryName:string,PostedDate:string,JobLocationType:int,Locations:array<struct<LocalizedName:string,Address:struct<City:string,State:struct<Code:string>,Country:struct<Code:string,Name:string>>>>>>", "opportunities")
    script = F.regexp_extract("body", r"(?s)new US\.Opportunity\.CandidateOpportunityDetail\((\{.*?\})\);", 1)
    details = details.withColumn("body", script)
    r = _detailed(r, details, F.col("p.Id"), "Description string, CompensationCurrencyCode string, PayRangeCurrencyCode string, CompensationAnnualMinimum double, CompensationAnnualMaximum double, CompensationHourlyMinimum double, CompensationHourlyMaximum double")
    p, d = F.col("p"), F.col("d")
    parts = F.split("company", r"\|")
    n = F.size(parts)
    host = F.when(n == 3, F.get(parts, 0)).otherwise("recruiting.ultipro.com")
    tenant, board = F.get(parts, n - 2), F.get(parts, n - 1)
    cur = F.coalesce(d["CompensationCurrencyCode"], d["PayRangeCurrencyCode"])
    num = lambda x: F.regexp_replace(F.call_function("format_number", x, F.lit("0.##")), r"\.$", "")
    line = lambda word, a, b, per: F.concat(F.lit(word + ": "), cur, F.lit(" "), num(F.coalesce(a, b)), F.lit(" - "), cur, F.lit(" "), num(F.coalesce(b, a)), F.lit(f" per {per}"))
    a, b, h, i = (d[c] for c in ("CompensationAnnualMinimum", "CompensationAnnualMaximum", "CompensationHourlyMinimum", "CompensationHourlyMaximum"))
    some = lambda x, y: (F.coalesce(x, F.lit(0)) != 0) | (F.coalesce(y, F.lit(0)) != 0)
    pay = F.when(cur.isNotNull() & some(a, b), line("Salary", a, b, "year")).when(cur.isNotNull() & some(h, i), line("Pay", h, i, "hour"))
    spot = lambda x: F.coalesce(T.join_present(", ", x["Address"]["City"], x["Address"]["State"]["Code"], x["Address"]["Country"]["Code"]), _s(x["LocalizedName"]))
    names = F.filter(F.transform(p["Locations"], spot), lambda x: x.isNotNull())
    return to_job(
        staged(
            r, company=tenant, native_id=p["Id"], title=p["Title"], location=F.get(names, 0), additional=_rest(names), country=F.get(p["Locations"], 0)["Address"]["Country"]["Code"],
            workplace=F.when(p["JobLocationType"] == 2, "Remote").when(p["JobLocationType"] == 3, "Hybrid"), remote_flag=p["JobLocationType"] == 2, department=p["JobCategoryName"], posted_raw=p["PostedDate"],
            url=F.concat(F.lit("https://"), host, F.lit("/"), tenant, F.lit("/JobBoard/"), board, F.lit("/OpportunityDetail?opportunityId="), p["Id"]),
            employment_type=F.when(p["FullTime"], "Full time").when(~p["FullTime"], "Part time"), description=T.html_to_text(d["Description"]), pay_text=pay,
        ),
        "ukg",
    )


# ---------------------------------------------------------------- P15-P20 pages and odd lists

def jobvite(raw: DataFrame) -> DataFrame:
    """A department heading stands for the rows under it; a repeat outside the tables gives way to the table row."""
    parts = F.posexplode(F.split("body", r"(?i)(?=<h3[^>]*>)")).alias("_part", "part")
    r = raw.select("company", parts).withColumn("dept", _s(T.strip_tags(F.regexp_extract("part", r"(?is)^<h3[^>]*>(.*?)</h3>", 1))))
    row = r'(?is)<td class="jv-job-list-name">\s*<a href="/[^"/]+/job/(\w+)"[^>]*>(.*?)</a>\s*</td>(?:\s*<td(?! class="jv-job-list-location")[^>]*>.*?</td>)*?\s*<td class="jv-job-list-location">(.*?)</td>'
    link = r'(?is)<a href="/[^"/]+/job/(\w+)"[^>]*>(.*?)</a>'
    loose = F.filter(F.regexp_extract_all(F.regexp_replace("part", row, ""), F.lit(link), F.lit(0)), lambda m: ~m.contains("/apply"))
    title = lambda h: T.strip_tags(F.regexp_replace(h, r"(?is)<span[^>]*>\s*\|\s*</span>.*$", ""))
    tabled = F.transform(
        F.regexp_extract_all("part", F.lit(row), F.lit(0)),
        lambda m, i: F.struct(F.lit(0).alias("kind"), i.alias("i"), F.regexp_extract(m, row, 1).alias("id"), title(F.regexp_extract(m, row, 2)).alias("title"), T.place_not_count(T.strip_tags(F.regexp_extract(m, row, 3))).alias("location"), F.col("dept").alias("dept")),
    )
    plain = F.transform(
        loose,
        lambda m, i: F.struct(F.lit(1).alias("kind"), i.alias("i"), F.regexp_extract(m, link, 1).alias("id"), title(F.regexp_extract(m, link, 2)).alias("title"), F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("dept")),
    )
    j = r.select("company", "_part", F.explode(F.concat(tabled, plain)).alias("x")).select("company", "_part", "x.*")
    at = lambda s: s * (F.col("_part") * 100_000 + F.col("i"))
    j = first_per_group(j, ["company", "id"], [F.col("kind"), F.when(F.col("kind") == 0, at(-1)).otherwise(at(1))])
    return to_job(
        staged(
            j, company=F.col("company"), native_id=F.col("id"), title=F.col("title"), location=F.col("location"), department=F.col("dept"),
            url=F.concat(F.lit("https://jobs.jobvite.com/"), "company", F.lit("/job/"), "id"),
        ),
        "jobvite",
    )


def phenom(lists: DataFrame, details: DataFrame) -> DataFrame:
    """Keyed by sequence number, else id; the last row of a key wins; the description is JSON inside the page."""
    r = _rows(lists, "jobs array<struct<jobId:string,jobSeqNo:string,title:string,city:string,state:string,country:string,cityStateCountry:string,multi_location:array<string>,category:string,department:string,type:string,postedDate:string,dateCreated:string>>", "jobs")
    r = r.withColumn("_key", F.coalesce(_s(F.col("p.jobSeqNo")), F.col("p.jobId")))
    r = first_per_group(r, ["company", "_key"], [F.col("_at").desc()])
    details = details.withColumn("body", F.regexp_extract("body", r"(?s)phApp\.ddo\s*=\s*(\{.*?\});\s*phApp", 1))
    r = _detailed(r, details, F.col("p.jobId"), "jobDetail struct<data:struct<job:struct<description:string,postedDate:string>>>", lambda d: d["jobDetail"]["data"]["job"])
    p, d = F.col("p"), F.col("d")
    one = F.array(F.coalesce(p["cityStateCountry"], T.join_present(", ", p["city"], p["state"], p["country"]), F.lit("")))
    names = F.filter(F.transform(F.when(F.size(p["multi_location"]) > 0, p["multi_location"]).otherwise(one), T.clean_place), lambda x: x != "")
    return to_job(
        staged(
            r, company=T.host_key("company"), native_id=F.col("_key"), title=p["title"], location=F.get(names, 0), additional=_rest(names), country=p["country"], department=F.coalesce(_s(p["category"]), _s(p["department"])),
            posted_raw=F.coalesce(p["postedDate"], d["postedDate"], p["dateCreated"]), url=F.concat(F.lit("https://"), "company", F.lit("/us/en/job/"), p["jobId"]), employment_type=_s(p["type"]), description=T.html_to_text(d["description"]),
        ),
        "phenom",
    )


def enum_words(col: Column) -> Column:
    """FULL_TIME to "Full time"; other spellings stay."""
    plain = F.concat(F.substring(col, 1, 1), F.lower(F.regexp_replace(F.substr(col, F.lit(2)), "_", " ")))
    return F.when(col.rlike("^[A-Z_]+$"), plain).otherwise(col)


def icims(raw: DataFrame) -> DataFrame:
    """P17."""
    r = _rows(raw, "jobs array<struct<data:struct<slug:string,req_id:string,title:string,city:string,state:string,country:string,country_code:string,full_location:string,posted_date:string,create_date:string,employment_type:string,categories:array<struct<name:string>>,department:string,location_type:string,description:string,qualifications:string,responsibilities:string>>>", "jobs")
    r = r.select("company", F.col("p.data").alias("p")).filter("p IS NOT NULL")
    p = F.col("p")
    ident = F.coalesce(p["slug"], p["req_id"])
    kind = p["employment_type"]
    return to_job(
        staged(
            r, company=T.host_key("company"), native_id=ident, title=p["title"], location=T.join_present(", ", F.coalesce(_s(p["full_location"]), T.join_present(", ", p["city"], p["state"])), p["country"]), country=p["country_code"],
            workplace=_s(p["location_type"]), department=F.coalesce(_s(F.get(p["categories"], 0)["name"]), _s(p["department"])), posted_raw=F.coalesce(p["posted_date"], p["create_date"]),
            url=F.concat(F.lit("https://"), "company", F.lit("/jobs/"), ident), employment_type=F.when(_s(kind).isNotNull(), F.concat(F.substring(kind, 1, 1), F.lower(F.regexp_replace(F.substr(kind, F.lit(2)), "_", " ")))),
            description=T.html_to_text(T.join_present("\n", p["description"], p["responsibilities"], p["qualifications"])),
        ),
        "icims",
    )


def _texts(df: DataFrame, **parts: Column) -> DataFrame:
    """HTML parts as text columns (null for empty): one `transform` over all of them, so the text rules stand in the plan once."""
    made = F.transform(F.array(*parts.values()), lambda h: _s(T.html_to_text(h)))
    # A one-element explode keeps filters on the texts from being pushed below, where each would make them again.
    df = df.select("*", F.explode(F.array(made)).alias("_parts"))
    return df.select("*", *[F.get("_parts", i).alias(n) for i, n in enumerate(parts)]).drop("_parts")


def icims_portal(raw: DataFrame) -> DataFrame:
    """Cards of a portal page."""
    card = r'(?s)<li class="iCIMS_JobCardItem">(.*?)</li>'
    r = raw.select("company", F.explode(F.regexp_extract_all("body", F.lit(card), F.lit(1))).alias("card"))
    link = r'<a href="([^"]*/jobs/(\d+)/[^"]*)"'
    named = lambda x: F.regexp_extract("card", rf'(?s)<dt class="iCIMS_JobHeaderField">{x}</dt>\s*<dd[^>]*>(.*?)</dd>', 1)
    place = r'(?s)field-label">Location</span>\s*<span[^>]*>(.*?)</span>'
    r = _texts(
        r.filter(F.col("card").rlike(link)), head=F.regexp_extract("card", r"(?s)<h3[^>]*>(.*?)</h3>", 1), place=F.regexp_extract("card", place, 1), campus=named("Campus Location"), spot=named("Location"),
        cat1=named("Category"), cat2=named("Job Category"), kind1=named("Schedule"), kind2=named("Job Type"), kind3=named("Position Type"), kind4=named("Employment Type"),
    )
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract("card", link, 1), "&amp;", "&"), r"[?&]in_iframe=1", ""), r"\?$", "")
    return to_job(
        staged(
            r, company=F.substring_index(F.lower("company"), ".", 1), native_id=F.regexp_extract("card", link, 2), title=F.col("head"), location=F.coalesce(T.dashed_place("place"), "campus", "spot"),
            department=F.coalesce("cat1", "cat2"), url=url, employment_type=F.coalesce("kind1", "kind2", "kind3", "kind4"),
        ),
        "icims",
    )


def talentbrew(raw: DataFrame) -> DataFrame:
    """The first row per id; the title by heading, by class, else the link's text without its spans."""
    a = r'(?s)<a\b([^>]*\bdata-job-id="(\d+)"[^>]*)>(.*?)</a>'
    r = raw.select("company", F.posexplode(F.regexp_extract_all("body", F.lit(a), F.lit(0))).alias("_i", "m"))
    r = r.select("company", "_i", F.regexp_extract("m", a, 1).alias("attrs"), F.regexp_extract("m", a, 2).alias("id"), F.regexp_extract("m", a, 3).alias("inner"))
    by_class = lambda names: F.regexp_extract("inner", rf'(?s)<[^>]*class="[^"]*{names}[^"]*"[^>]*>(.*?)</[a-z0-9]+>', 1)
    r = _texts(
        r, head=F.regexp_extract("inner", r"(?s)<h[234][^>]*>(.*?)</h[234]>", 1), named=by_class("title"), bare=F.regexp_replace("inner", r"(?s)<span.*?</span>", ""),
        place=by_class("job-location"), department=by_class("job-(?:department|category)"),
    )
    path = F.regexp_replace(F.regexp_extract("attrs", r'href="([^"]+)"', 1), "&amp;", "&")
    r = r.select("company", "_i", "id", path.alias("path"), F.coalesce("head", "named", "bare").alias("title"), T.city_state("place").alias("location"), "department")
    r = first_per_group(r.filter("path <> '' AND title IS NOT NULL"), ["company", "id"], [F.col("_i")])
    url = F.when(F.col("path").startswith("http"), F.col("path")).otherwise(F.concat(F.lit("https://"), "company", "path"))
    return to_job(staged(r, company=T.host_key("company"), native_id=F.col("id"), title=F.col("title"), location=F.col("location"), department=F.col("department"), url=url), "talentbrew")


def taleo(raw: DataFrame) -> DataFrame:
    """P20: columns by place; places are JSON text or plain text; one row per requisition. `company` is tenant|section|portal."""
    r = _rows(raw, "requisitionList array<struct<jobId:string,contestNo:string,column:array<string>,linkedColumn:int,locationsColumns:array<int>>>", "requisitionList")
    r = r.withColumn("_key", F.coalesce(_s(F.col("p.contestNo")), F.col("p.jobId")))
    r = first_per_group(r, ["company", "_key"], [F.col("_at")])
    p = F.col("p")
    raw_places = F.get(p["column"], F.coalesce(F.get(p["locationsColumns"], 0), F.lit(1)))
    listed = F.filter(F.from_json(raw_places, "array<string>"), lambda x: x.isNotNull() & (x != ""))
    places = F.when(raw_places.rlike(r"^\s*\["), listed).when(_s(raw_places).isNotNull(), F.array(raw_places)).otherwise(F.array().cast("array<string>"))
    r = r.withColumn("_places", places).withColumn("_last", F.get(p["column"], F.size(p["column"]) - 1))
    parts = F.split("company", r"\|")
    posted = F.when(F.col("_last").rlike(r"\b\d{4}\b"), F.col("_last"))
    return to_job(
        staged(
            r, company=F.get(parts, 0), native_id=F.col("_key"), title=T.html_to_text(F.get(p["column"], F.coalesce(p["linkedColumn"], F.lit(0)))), location=F.get("_places", 0), additional=_rest(F.col("_places")), posted_raw=posted,
            url=F.concat(F.lit("https://"), F.get(parts, 0), F.lit(".taleo.net/careersection/"), F.get(parts, 1), F.lit("/jobdetail.ftl?job="), "_key"),
        ),
        "taleo",
    )


# ---------------------------------------------------------------- P22 JSON-LD

LD = "`@type` string, title string, datePosted string, description string, employmentType string"


def jsonld(html: Column, kind: str = "JobPosting") -> Column:
    """The page's first JSON-LD item of a type: an object, a list or a graph."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    fields = LD.replace("`@type` string", "`@type`:string").replace(" string", ":string")

    def items(s: Column) -> Column:
        s = T.trimmed(s)
        one = F.from_json(s, f"{LD}, `@graph` array<struct<{fields}>>")
        obj = F.struct(*[one[n].alias(n) for n in ("@type", "title", "datePosted", "description", "employmentType")])
        return F.when(s.startswith("["), F.from_json(s, f"array<struct<{fields}>>")).otherwise(F.coalesce(one["@graph"], F.array(obj)))

    flat = F.flatten(F.filter(F.transform(scripts, items), lambda x: x.isNotNull()))
    return F.get(F.filter(flat, lambda x: x["@type"] == kind), 0)


def ld_type(col: Column) -> Column:
    """An employment type given as text or as a list, in words."""
    text = F.when(col.startswith("["), F.array_join(F.from_json(col, "array<string>"), ", ")).otherwise(col)
    return enum_words(text)


NORMALISERS = {
    "greenhouse": greenhouse, "lever": lever, "ashby": ashby, "workable": workable, "workday": workday, "oracle": oracle, "smartrecruiters": smartrecruiters,
    "bamboohr": bamboohr, "breezy": breezy, "personio": personio, "rippling": rippling, "teamtailor": teamtailor, "recruitee": recruitee, "ukg": ukg, "jobvite": jobvite,
    "phenom": phenom, "icims": icims, "icims_portal": icims_portal, "talentbrew": talentbrew, "taleo": taleo,
}


def normalise(system: str, raw: DataFrame, *more) -> DataFrame:
    return NORMALISERS[system](raw, *more)


def with_job_pay(jobs: DataFrame) -> DataFrame:
    """Pay of a job: published as data, else its pay field, else its description."""
    from ..functions.pay import structured_pay, with_pay

    j = jobs.withColumn("_comp", F.from_json("compensation", STRUCTURED)).withColumn("_data", structured_pay("_comp"))
    # The pay field stands in front of the description, so the first figure found is the field's.
    j = j.withColumn("_text", F.when(F.col("_data").isNull(), F.concat_ws("\n", "pay_text", "description")))
    j = with_pay(j, "_text", "country", "_read")
    return j.withColumn("pay", F.coalesce("_data", "_read")).drop("_comp", "_data", "_text", "_read")
