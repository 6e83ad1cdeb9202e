"""Vendor landing (S9-S13): company and people JSON parsed with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from jobloom.constants import TARGET_COUNTRIES, VENDOR_PEOPLE_CAP
from jobloom.functions.company import city_from_location, format_location, size_bucket
from jobloom.functions.text import company_id_from_name, py_strip, title_case

A_COMPANY = T.StructType([
    T.StructField("status", T.IntegerType()),
    T.StructField("data", T.StructType([
        T.StructField("name", T.StringType()), T.StructField("linkedin_url", T.StringType()),
        T.StructField("website", T.StringType()), T.StructField("industry", T.StringType()),
        T.StructField("summary", T.StringType()), T.StructField("employee_count", T.IntegerType()),
        T.StructField("location", T.StructType([
            T.StructField("locality", T.StringType()), T.StructField("region", T.StringType()),
            T.StructField("country", T.StringType())]))]))])
A_PEOPLE = T.StructType([
    T.StructField("status", T.IntegerType()),
    T.StructField("data", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in (
        "full_name", "job_title", "location_name", "location_locality", "location_country",
        "linkedin_url")])))])
B_COMPANY = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("website", T.StringType()),
    T.StructField("industry", T.StringType()), T.StructField("company_size", T.StringType()),
    T.StructField("location", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("employee_count", T.IntegerType())])
B_PEOPLE = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in (
    "name", "title", "location", "country", "url")]))
METADATA = T.StructType([T.StructField(n, T.StringType()) for n in (
    "company_name", "website_url", "industry", "company_size", "headquarters")])

COMPANY_COLUMNS = ["id", "name", "requested_name", "linkedin_url", "website", "industry",
                   "company_size", "headquarters_location", "description", "total_employees",
                   "source"]


def vendor_a_companies(responses: DataFrame) -> DataFrame:
    """S9 + X2 + X15 + X16: only ``status == 200`` bodies become companies."""
    b = F.from_json(F.col("body"), A_COMPANY)
    d = b.data
    loc = d.location
    rows = responses.select("requested_name", b.alias("b")).where(F.col("b.status") == 200)
    d = F.col("b.data")
    loc = d.location
    return rows.select(
        company_id_from_name("requested_name").alias("id"),
        F.coalesce(d.getField("name"), F.col("requested_name")).alias("name"),
        "requested_name",
        d.linkedin_url.alias("linkedin_url"), d.website.alias("website"), d.industry.alias("industry"),
        size_bucket(d.employee_count).alias("company_size"),
        format_location(loc.locality, loc.region, loc.country).alias("headquarters_location"),
        d.summary.alias("description"), d.employee_count.alias("total_employees"),
        F.lit("vendor_a").alias("source"))


def vendor_b_companies(responses: DataFrame) -> DataFrame:
    """Flat object; an empty object is 'not found'; the website falls back to
    the one that was asked for."""
    b = F.from_json(F.col("body"), B_COMPANY)
    rows = responses.select("requested_name", "website", b.alias("b")).where(
        F.col("b").isNotNull() & (F.size(F.json_object_keys("body")) > 0))
    d = F.col("b")
    return rows.select(
        F.coalesce(d.id, F.lit("")).alias("id"),
        F.coalesce(d.getField("name"), F.col("requested_name")).alias("name"),
        "requested_name",
        d.url.alias("linkedin_url"),
        F.coalesce(F.nullif(d.website, F.lit("")), F.col("website")).alias("website"),
        d.industry.alias("industry"), d.company_size.alias("company_size"),
        d.location.alias("headquarters_location"), d.description.alias("description"),
        d.employee_count.alias("total_employees"), F.lit("vendor_b").alias("source"))


def vendor_a_people(responses: DataFrame) -> DataFrame:
    """S11 + X18: one member row per returned person, in response order."""
    b = F.from_json(F.col("body"), A_PEOPLE)
    rows = responses.select("company_id", b.alias("b")).where(F.col("b.status") == 200)
    p = rows.select("company_id", F.posexplode("b.data").alias("pos", "p"))
    return p.select("company_id", "pos",
                    F.col("p.full_name").alias("name"), F.col("p.job_title").alias("title"),
                    F.col("p.location_name").alias("location"),
                    F.col("p.location_locality").alias("city"),
                    title_case(F.col("p.location_country")).alias("country"),
                    F.col("p.linkedin_url").alias("linkedin_url"))


def vendor_b_people(responses: DataFrame) -> DataFrame:
    """S12 + X17: top-level array; the city is looked up from the location text."""
    b = F.from_json(F.col("body"), B_PEOPLE)
    p = responses.select("company_id", F.posexplode(b).alias("pos", "p"))
    return p.select("company_id", "pos", F.col("p.name").alias("name"),
                    F.col("p.title").alias("title"), F.col("p.location").alias("location"),
                    city_from_location(F.col("p.location"), F.col("p.country")).alias("city"),
                    F.col("p.country").alias("country"), F.col("p.url").alias("linkedin_url"))


def company_metadata(responses: DataFrame) -> DataFrame:
    """Metadata object; a website on the job board's own domain is dropped."""
    m = F.from_json(F.col("body"), METADATA)
    rows = responses.select("page_id", m.alias("m"))
    site = F.col("m.website_url")
    return rows.select("page_id", F.col("m.company_name").alias("company_name"),
                       F.when(site.contains("indeed.com"), F.lit(None)).otherwise(site).alias("website"),
                       F.col("m.industry").alias("industry"), F.col("m.company_size").alias("company_size"),
                       F.col("m.headquarters").alias("headquarters"))


def region_head_count(members: DataFrame) -> DataFrame:
    """A1: number of returned members per company."""
    return members.groupBy("company_id").agg(F.count(F.lit(1)).cast("int").alias("region_team_count"))


# A vendor turns company bodies and people bodies into rows.
VENDORS = {"a": (vendor_a_companies, vendor_a_people), "b": (vendor_b_companies, vendor_b_people)}


def get_vendor(name: str):
    """(companies, people) functions of a vendor; an unknown name raises ValueError."""
    if name not in VENDORS:
        raise ValueError(f"Unknown service: {name}")
    return VENDORS[name]


# ------------------------------------------------------------ landed payloads
def company_responses_a(companies: DataFrame) -> DataFrame:
    """Vendor A company bodies for every company (every 8th: not found)."""
    k = F.col("id").cast("long")
    data = F.struct(
        F.when(k % 5 == 2, F.concat(F.col("name"), F.lit(" Inc"))).otherwise(F.col("name")).alias("name"),
        F.concat(F.lit("https://www.linkedin.com/company/"), F.col("id")).alias("linkedin_url"),
        F.col("website").alias("website"), F.col("industry").alias("industry"),
        F.concat(F.lit("About "), F.col("name")).alias("summary"),
        F.when(k % 6 == 5, F.lit(None)).otherwise((k * 37 % 9000).cast("int")).alias("employee_count"),
        F.struct(F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("City "), (k % 9).cast("string")))
                 .alias("locality"),
                 F.lit("").alias("region"),
                 F.col("headquarters_location").alias("country")).alias("location"))
    body = F.to_json(F.struct(F.when(k % 8 == 7, F.lit(404)).otherwise(F.lit(200)).alias("status"),
                              data.alias("data")))
    return companies.select(F.col("requested_name"), body.alias("body"))


def company_responses_b(companies: DataFrame) -> DataFrame:
    """Vendor B company bodies (every 8th: empty object; every 4th: no website)."""
    k = F.col("id").cast("long")
    obj = F.struct(
        F.col("id").alias("id"), F.col("name").alias("name"),
        F.concat(F.lit("https://www.linkedin.com/company/"), F.col("id")).alias("url"),
        F.when(k % 4 == 1, F.lit(None)).otherwise(F.col("website")).alias("website"),
        F.col("industry").alias("industry"), F.col("company_size").alias("company_size"),
        F.col("headquarters_location").alias("location"),
        F.concat(F.lit("About "), F.col("name")).alias("description"),
        (k * 37 % 9000).cast("int").alias("employee_count"))
    body = F.when(k % 8 == 7, F.lit("{}")).otherwise(F.to_json(obj))
    return companies.select("requested_name",
                            F.concat(F.lit("requested-"), F.col("id"), F.lit(".com")).alias("website"),
                            body.alias("body"))


def people_responses(members: DataFrame, vendor: str, targets=TARGET_COUNTRIES) -> DataFrame:
    """People bodies per company: target-country members, capped at the vendor's
    100 per company (O7, member id order) *before* the list is collected, so no
    company builds an unbounded list."""
    from jobloom.operators.serve import top_per_group
    m = members.where(F.col("country").isin(list(targets)))
    capped = top_per_group(m, "company_id", [F.col("id")], VENDOR_PEOPLE_CAP)
    if vendor == "a":
        person = F.struct(F.col("name").alias("full_name"), F.col("title").alias("job_title"),
                          F.col("location").alias("location_name"),
                          F.col("city").alias("location_locality"),
                          F.lower("country").alias("location_country"),
                          F.col("linkedin_url").alias("linkedin_url"))
    else:
        person = F.struct(F.col("name").alias("name"), F.col("title").alias("title"),
                          F.col("location").alias("location"), F.col("country").alias("country"),
                          F.col("linkedin_url").alias("url"))
    grouped = capped.groupBy("company_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("id").alias("i"), person.alias("p")))).alias("ps"))
    arr = F.transform("ps", lambda x: x.p)
    body = (F.to_json(F.struct(F.lit(200).alias("status"), arr.alias("data"))) if vendor == "a"
            else F.to_json(arr))
    return grouped.select("company_id", body.alias("body"))


def people_table(members: DataFrame, n_companies) -> DataFrame:
    """People with nested experience (J9 input): two employers per person, a
    third entry without a domain for every 5th person."""
    c = F.col("id")
    dom = lambda e: F.concat(F.lit("supplier"), e.cast("string"), F.lit(".com"))
    exp = F.array(
        F.struct(F.struct(dom(c % n_companies).alias("domain_only")).alias("company_website")),
        F.struct(F.struct(dom((c * 7 + 3) % n_companies).alias("domain_only")).alias("company_website")))
    exp = F.when(c % 5 == 0, F.concat(exp, F.array(F.struct(
        F.struct(F.lit(None).cast("string").alias("domain_only")).alias("company_website"))))).otherwise(exp)
    return members.select(c.alias("person_id"), "name", "title", "location", "country",
                          F.col("linkedin_url").alias("url"), exp.alias("experience"))
