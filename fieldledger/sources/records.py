"""Other payloads: filings, stores, packages, releases, advisories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..functions.versions import loose_key, repo, severity, tag_version
from ..operators.joins import fixed_by_key

# Release text kept, advisories read.


def hits(raw: DataFrame) -> DataFrame:
    """Filing references of a search answer."""
    doc = F.from_json("body", "hits struct<hits:array<struct<_id:string,_source:struct<ciks:array<string>,display_names:array<string>,file_date:string,form:string,file_type:string,biz_states:array<string>>>>>")
    h = raw.select(F.explode(doc["hits"]["hits"]).alias("h")).select("h._id", "h._source")
    parts = F.split("_id", ":")
    out = h.select(
        F.get(parts, 0).alias("accession"),
        F.regexp_replace(F.get("_source.ciks", 0), "^0+", "").alias("cik"),
        F.coalesce(F.get(parts, 1), F.lit("primary_doc.xml")).alias("file_name"),
        F.col("_source.file_date").alias("filed_at"),
        F.coalesce("_source.form", "_source.file_type", F.lit("D")).alias("form"),
        T.trimmed(F.regexp_replace(F.coalesce(F.get("_source.display_names", 0), F.lit("")), r"\s*\(CIK \d+\)\s*$", "")).alias("name"),
        F.coalesce("_source.biz_states", F.array().cast("array<string>")).alias("states"),
    )
    return out.filter("accession <> '' AND cik IS NOT NULL")


_FLAGS = " ".join(f"{t}:string," for t in L.SECURITY_TYPES)
FORM_D = (
    "submissionType string, previousAccessionNumber string,"
    "primaryIssuer struct<cik:string,entityName:string,issuerAddress:struct<street1:string,street2:string,city:string,stateOrCountry:string,stateOrCountryDescription:string,zipCode:string>,"
    "issuerPhoneNumber:string,jurisdictionOfInc:string,entityType:string,entityTypeOtherDesc:string,yearOfInc:struct<withinFiveYears:string,overFiveYears:string,yetToBeFormed:string,value:string>>,"
    "issuerList struct<issuer:array<struct<entityName:string>>>,"
    "relatedPersonsList struct<relatedPersonInfo:array<struct<relatedPersonName:struct<firstName:string,middleName:string,lastName:string>,relatedPersonAddress:struct<city:string,stateOrCountry:string>,"
    "relatedPersonRelationshipList:struct<relationship:array<string>>,relationshipClarification:string>>>,"
    "offeringData struct<industryGroup:struct<industryGroupType:string,investmentFundInfo:struct<investmentFundType:string>>,issuerSize:struct<revenueRange:string,aggregateNetAssetValueRange:string>,"
    "federalExemptionsExclusions:struct<item:array<string>>,typeOfFiling:struct<newOrAmendment:struct<isAmendment:string,previousAccessionNumber:string>,dateOfFirstSale:struct<value:string,yetToOccur:string>>,"
    f"typesOfSecuritiesOffered:struct<{_FLAGS}isOtherType:string,descriptionOfOtherType:string>,minimumInvestmentAccepted:string,"
    "salesCompensationList:struct<recipient:array<struct<recipientName:string,associatedBDName:string>>>,"
    "offeringSalesAmounts:struct<totalOfferingAmount:string,totalAmountSold:string,totalRemaining:string,clarificationOfResponse:string>,"
    "investors:struct<hasNonAccreditedInvestors:string,numberNonAccreditedInvestors:string,totalNumberAlreadyInvested:string,clarificationOfResponse:string>,"
    "salesCommissionsFindersFees:struct<salesCommissions:struct<dollarAmount:string>,findersFees:struct<dollarAmount:string>>,useOfProceeds:struct<grossProceedsUsed:struct<dollarAmount:string>>,"
    "signatureBlock:struct<signature:array<struct<nameOfSigner:string,signatureName:string,signatureTitle:string>>>>"
)


def _num(c: Column) -> Column:
    return F.regexp_replace(c, r"[$,\s]", "").try_cast("double")


def _yes(c: Column) -> Column:
    return F.coalesce(F.lower(c) == "true", F.lit(False))


def _join(sep: str, parts: Column) -> Column:
    return F.nullif(F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), sep), F.lit(""))


def form_d(raw: DataFrame) -> DataFrame:
    """Form D documents (`accession`, `cik`, `file_name`, `filed_at`, `body`) to flat records with nested people."""
    # A one-element explode keeps filters on the result from being pushed below the parse, where each would parse again.
    x = raw.select("*", F.explode(F.array(F.from_xml("body", FORM_D))).alias("x"))
    x = x.selectExpr("*", "x.primaryIssuer AS i", "x.offeringData AS o", "x.primaryIssuer.issuerAddress AS a")
    i, o, a = F.col("i"), F.col("o"), F.col("a")
    fund_type = o["industryGroup"]["investmentFundInfo"]["investmentFundType"]
    industry = o["industryGroup"]["industryGroupType"]
    types = o["typesOfSecuritiesOffered"]
    year = i["yearOfInc"]
    amounts, investors = o["offeringSalesAmounts"], o["investors"]
    other = F.when(T.blank_to_null(types["descriptionOfOtherType"]).isNotNull(), F.concat(F.lit("Other: "), types["descriptionOfOtherType"])).otherwise("Other")
    securities = F.array_compact(F.array(*[F.when(_yes(types[t]), F.lit(label)) for t, label in L.SECURITY_TYPES.items()], F.when(_yes(types["isOtherType"]), other)))

    def person(p: Column) -> Column:
        n = p["relatedPersonName"]
        full = _join(" ", F.array(*[T.not_placeholder(n[k]) for k in ("firstName", "middleName", "lastName")]))
        return F.struct(
            T.tidy_name(full).alias("name"),
            F.filter(F.transform(p["relatedPersonRelationshipList"]["relationship"], F.trim), lambda r: r != "").alias("roles"),
            T.not_placeholder(p["relationshipClarification"]).alias("title"),
            T.tidy_name(p["relatedPersonAddress"]["city"]).alias("city"),
            p["relatedPersonAddress"]["stateOrCountry"].alias("state"),
        )

    def broker(r: Column) -> Column:
        who, firm = T.tidy_name(T.not_placeholder(r["recipientName"])), T.not_placeholder(r["associatedBDName"])
        return F.when(who != firm, F.concat(who, F.lit(" ("), firm, F.lit(")"))).otherwise(F.coalesce(who, firm))

    none = F.array().cast("array<string>")
    people = F.filter(F.transform(F.col("x.relatedPersonsList.relatedPersonInfo"), person), lambda p: F.coalesce(p["name"], F.lit("")) != "")
    brokers = F.array_distinct(F.filter(F.transform(o["salesCompensationList"]["recipient"], broker), lambda b: b.isNotNull()))
    amended = _yes(o["typeOfFiling"]["newOrAmendment"]["isAmendment"]) | F.coalesce(F.col("x.submissionType") == "D/A", F.lit(False))
    within = F.when(_yes(year["withinFiveYears"]), "Within five years").when(_yes(year["overFiveYears"]), "Over five years").when(_yes(year["yetToBeFormed"]), "Yet to be formed")
    cik = F.regexp_replace(F.coalesce(i["cik"], F.col("cik")), "^0+", "")
    sig = F.get(o["signatureBlock"]["signature"], 0)
    notes = _join(" ", F.array(T.not_placeholder(amounts["clarificationOfResponse"]), T.not_placeholder(investors["clarificationOfResponse"])))
    base = x.select(
        F.coalesce(i["entityName"], F.lit("")).alias("company_name"), cik.alias("cik"), "accession", "file_name", F.when(amended, "Amendment").otherwise("New").alias("filing_type"), "filed_at",
        o["typeOfFiling"]["dateOfFirstSale"]["value"].alias("first_sale"), _yes(o["typeOfFiling"]["dateOfFirstSale"]["yetToOccur"]).alias("first_sale_yet_to_occur"),
        L.sector(industry).alias("sector"), industry.alias("industry"),
        (F.coalesce(industry == "Pooled Investment Fund", F.lit(False)) | F.coalesce(fund_type != "", F.lit(False)) | _yes(types["isPooledInvestmentFundType"])).alias("is_fund"), fund_type.alias("fund_type"),
        F.when(i["entityType"] == "Other", F.coalesce(i["entityTypeOtherDesc"], F.lit("Other"))).otherwise(i["entityType"]).alias("entity_type"),
        _num(year["value"]).cast("int").alias("year_of_incorporation"), within.alias("incorporated_within"), i["jurisdictionOfInc"].alias("jurisdiction"),
        _join(", ", F.array(a["street1"], a["street2"])).alias("street"), T.tidy_name(a["city"]).alias("city"), a["stateOrCountry"].alias("state"), T.tidy_name(a["stateOrCountryDescription"]).alias("state_name"),
        a["zipCode"].alias("zip"), T.us_phone(i["issuerPhoneNumber"]).alias("phone"), _num(amounts["totalOfferingAmount"]).alias("offering"),
        F.coalesce(amounts["totalOfferingAmount"].rlike("(?i)indefinite"), F.lit(False)).alias("indefinite"), _num(amounts["totalAmountSold"]).alias("amount_sold"), _num(amounts["totalRemaining"]).alias("remaining"),
        _num(o["minimumInvestmentAccepted"]).alias("minimum_investment"), _num(investors["totalNumberAlreadyInvested"]).cast("bigint").alias("investors"),
        F.when(_yes(investors["hasNonAccreditedInvestors"]), _num(investors["numberNonAccreditedInvestors"]).cast("bigint")).otherwise(F.lit(0)).alias("non_accredited"),
        securities.alias("securities"), F.coalesce(F.transform(o["federalExemptionsExclusions"]["item"], lambda c: L.exemption(F.trim(c))), none).alias("exemptions"),
        F.coalesce(o["issuerSize"]["revenueRange"], o["issuerSize"]["aggregateNetAssetValueRange"]).alias("revenue_range"),
        F.coalesce(people, F.expr("array()").cast("array<struct<name:string,roles:array<string>,title:string,city:string,state:string>>")).alias("executives"), F.coalesce(brokers, none).alias("sales_brokers"),
        _num(o["salesCommissionsFindersFees"]["salesCommissions"]["dollarAmount"]).alias("sales_commissions"), _num(o["salesCommissionsFindersFees"]["findersFees"]["dollarAmount"]).alias("finders_fees"),
        _num(o["useOfProceeds"]["grossProceedsUsed"]["dollarAmount"]).alias("proceeds_to_executives"), notes.alias("notes"),
        F.coalesce(o["typeOfFiling"]["newOrAmendment"]["previousAccessionNumber"], F.col("x.previousAccessionNumber")).alias("previous_accession"),
        F.coalesce(F.filter(F.transform(F.col("x.issuerList.issuer"), lambda e: e["entityName"]), lambda n: n != ""), none).alias("other_issuers"),
        F.coalesce(sig["nameOfSigner"], sig["signatureName"]).alias("signed_by"), sig["signatureTitle"].alias("signer_title"),
    )
    folder = F.regexp_replace("accession", "-", "")
    root = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), "cik", F.lit("/"), folder)
    said = F.transform("executives", lambda p: F.concat(p["name"], F.lit(" ("), F.coalesce(p["title"], F.array_join(p["roles"], ", ")), F.lit(")")))
    return base.withColumns(
        {
            "executives_text": F.array_join(said, "; "),
            "filing_url": F.concat(root, F.lit("/"), "accession", F.lit("-index.htm")),
            "form_url": F.concat(root, F.lit("/xslFormDX01/"), "file_name"),
            "company_filings_url": F.concat(F.lit("https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK="), "cik", F.lit("&type=D&dateb=&owner=include&count=40")),
        }
    )


def store_meta(raw: DataFrame) -> DataFrame:
    """P25: a store's meta document; without a name and a marker key it is none (all columns but `domain` null)."""
    schema = "name string, description string, myshopify_domain string, city string, province string, country string, currency string, ships_to_countries array<string>, published_products_count double, published_collections_count double, url string"
    m = F.from_json("body", schema)
    marked = F.array_contains(F.json_object_keys("body"), "myshopify_domain") | F.array_contains(F.json_object_keys("body"), "currency")
    ok = F.coalesce(m["name"].isNotNull() & marked, F.lit(False))
    r = raw.select("domain", F.when(ok, m).alias("m"))
    s = lambda c: T.blank_to_null(F.col(f"m.{c}")).alias(c)
    return r.select(
        "domain", F.col("m").isNotNull().alias("valid"), T.trimmed("m.name").alias("name"), s("description"), s("myshopify_domain"), s("city"), s("province"),
        F.upper(T.blank_to_null("m.country")).alias("country"), F.upper(T.blank_to_null("m.currency")).alias("currency"),
        F.transform(F.coalesce("m.ships_to_countries", F.array().cast("array<string>")), F.upper).alias("ships_to"),
        F.col("m.published_products_count").cast("bigint").alias("product_count"), F.col("m.published_collections_count").cast("bigint").alias("collection_count"), s("url"),
    )


def _by_time(pairs: Column) -> Column:
    """Names of ``array<struct<at, pos, name>>`` in time order; unknown times come first."""
    return F.transform(F.sort_array(pairs), lambda x: x["name"])


def npm_packages(raw: DataFrame) -> DataFrame:
    """Packument to package, versions by publish time."""
    schema = "name string, description string, `dist-tags` map<string,string>, versions map<string,struct<deprecated:string,repository:string>>, time map<string,string>, repository string, homepage string"
    r = raw.select(F.from_json("body", schema).alias("d")).filter("d.name IS NOT NULL").select("d.*")
    names = F.map_keys("versions")
    pairs = F.transform(names, lambda v, i: F.struct(F.coalesce(T.parse_date(F.try_element_at("time", v)), F.lit(0).cast("timestamp")).alias("at"), i.alias("pos"), v.alias("name")))
    r = r.withColumn("vs", _by_time(pairs))
    latest = F.coalesce(F.try_element_at("dist-tags", F.lit("latest")), F.try_element_at("vs", F.lit(-1)))
    r = r.withColumn("latest", latest).withColumn("_v", F.try_element_at("versions", F.col("latest")))
    at = lambda c: F.when(c.startswith("{"), F.get_json_object(c, "$.url")).otherwise(c)
    return r.select(
        F.lit("npm").alias("ecosystem"), "name", F.col("vs").alias("versions"), "latest", repo(F.coalesce(at(F.col("repository")), at(F.col("_v.repository")))).alias("repository"), "homepage", "description",
        F.nullif("_v.deprecated", F.lit("")).alias("deprecated"), F.map_filter("time", lambda k, v: F.array_contains(F.col("vs"), k)).alias("published_at"),
    )


def pypi_packages(raw: DataFrame) -> DataFrame:
    """Project JSON to package; the repository is a link named for it, else any GitHub link, else the home page."""
    schema = "info struct<name:string,version:string,summary:string,home_page:string,project_urls:map<string,string>,yanked:boolean,yanked_reason:string>, releases map<string,array<struct<upload_time_iso_8601:string>>>"
    r = raw.select(F.from_json("body", schema).alias("d")).filter("d.info.name IS NOT NULL").select("d.*")
    times = F.map_filter(F.transform_values("releases", lambda k, f: F.get(f, 0)["upload_time_iso_8601"]), lambda k, t: t.isNotNull())
    r = r.withColumn("published_at", times)
    pairs = F.transform(F.map_keys("releases"), lambda v, i: F.struct(F.coalesce(T.parse_date(F.try_element_at("published_at", v)), F.lit("2000-01-01").cast("timestamp")).alias("at"), i.alias("pos"), v.alias("name")))
    r = r.withColumn("vs", _by_time(pairs))
    urls = F.map_entries(F.coalesce("info.project_urls", F.create_map().cast("map<string,string>")))
    named = F.get(F.filter(urls, lambda e: e["key"].rlike("(?i)source|repo|code|github")), 0)["value"]
    linked = F.get(F.filter(urls, lambda e: e["value"].rlike(r"(?i)github\.com")), 0)["value"]
    return r.select(
        F.lit("pypi").alias("ecosystem"), F.col("info.name").alias("name"), F.col("vs").alias("versions"), F.coalesce("info.version", F.try_element_at("vs", F.lit(-1))).alias("latest"),
        repo(F.coalesce(named, linked, "info.home_page")).alias("repository"), F.col("info.home_page").alias("homepage"), F.col("info.summary").alias("description"),
        F.when(F.col("info.yanked"), F.coalesce("info.yanked_reason", F.lit("yanked"))).alias("deprecated"), "published_at",
    )


def releases(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Release list to notes; drafts and tags without a version go."""
    doc = F.from_json("body", "array<struct<tag_name:string,name:string,body:string,published_at:string,html_url:string,draft:boolean>>")
    r = raw.select(*keys, F.posexplode(doc).alias("pos", "r")).filter("NOT coalesce(r.draft, false)")
    return r.select(
        *keys, "pos", tag_version("r.tag_name").alias("version"), F.col("r.tag_name").alias("tag"), F.col("r.published_at").alias("published_at"), F.col("r.html_url").alias("url"),
        F.coalesce("r.body", F.lit("")).alias("body"),
    ).filter("version IS NOT NULL")


def advisories(raw: DataFrame, keys: list[str], to: Column) -> DataFrame:
    """The advisories of an answer, with severity and whether the target version fixes them."""
    doc = F.from_json("body", "vulns array<struct<id:string,summary:string,details:string,severity:array<struct<type:string,score:string>>,database_specific:struct<severity:string>,affected:array<struct<ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string>>>>>>>>")
    r = raw.select(*keys, loose_key(to).alias("_to"), F.posexplode(doc["vulns"]).alias("pos", "v"))
    none = "array<struct<introduced:string,fixed:string>>"
    ranges = F.flatten(F.transform(F.coalesce("v.affected", F.array()), lambda a: F.coalesce(a["ranges"], F.array())))
    events = F.flatten(F.transform(ranges, lambda g: F.coalesce(g["events"], F.array().cast(none))))
    score = F.get(F.filter("v.severity", lambda s: s["type"].startswith("CVSS")), 0)["score"]
    return r.select(
        *keys, "pos", F.col("v.id").alias("id"), F.coalesce("v.summary", "v.details", F.lit("")).alias("summary"), severity("v.database_specific.severity", score).alias("severity"),
        F.concat(F.lit("https://osv.dev/vulnerability/"), "v.id").alias("url"), F.coalesce(fixed_by_key(events, F.col("_to")), F.lit(False)).alias("fixed_by_upgrade"),
    )
