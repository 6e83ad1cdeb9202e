"""Scalar-function queries (X1-X23) over the derived tables and driver text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobloom.functions import company as fc, dates as fd, salary as fs, text as ft, web as fw
from jobloom.plans import base
from jobloom.sources.tables import read_table

AS_OF = base.AS_OF


def job_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Job id and vendor-A company id."""
    j = base.jobs(spark, sf)
    return j.select("seq", "id", ft.company_id_from_name("company").alias("company_key"))


def fuzzy_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Fuzzy de-dup key of every landed job."""
    return base.jobs(spark, sf).select("seq", ft.fuzzy_key("company", "title").alias("fuzzy_key"))


def doc_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """X3 on whole multilingual documents; digest of the normalised text."""
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    n = ft.normalise_text("text")
    return d.select("doc_id", F.md5(n).alias("norm_md5"), F.length(n).alias("norm_len"))


def relative_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Both relative-date rules against a fixed as_of."""
    j = base.jobs(spark, sf)
    return j.select("seq", "posted_text",
                    fd.relative_date_a("posted_text", AS_OF).alias("posted_rule_a"),
                    fd.relative_date_b("posted_text", AS_OF).alias("posted_rule_b"))


def salary_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Salary range from free text."""
    j = base.jobs(spark, sf)
    s = fs.parse_salary("salary_text")
    return j.select("seq", s.salary_min.alias("salary_min"), s.salary_max.alias("salary_max"))


def listing_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Remote flag, job URL from a key, item URL, company URL, snippet fallback."""
    j = base.jobs(spark, sf)
    k = F.col("seq")
    key = F.when(k % 13 == 0, F.lit("")).otherwise(k.cast("string"))
    item_url = F.when(k % 3 == 0, F.concat(F.lit("/viewjob?jk="), k.cast("string"))) \
        .when(k % 3 == 1, F.col("url")).otherwise(F.lit(None).cast("string"))
    cmp = F.when(k % 2 == 0, F.concat(F.lit("/cmp/"), F.regexp_replace("company", "#", "-")))
    direct = F.when(k % 5 == 0, F.lit("https://direct.example.com/c"))
    snippet = F.when(k % 2 == 0, F.lit("")).otherwise(F.col("description"))
    items = F.split(F.col("title"), " ")
    return j.select(
        "seq",
        fw.remote_type("location", (k % 7 == 0)).alias("remote_type"),
        fw.job_url_from_key(key).alias("job_url"),
        fw.item_job_url(key, item_url).alias("item_url"),
        fw.resolve_company_url(cmp, direct).alias("company_url"),
        fw.snippet_fallback(snippet, items).alias("description"),
    )


def infer_websites(spark: SparkSession, sf: str) -> DataFrame:
    """X13 / J8 over supplier names with legal suffixes."""
    s = read_table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    suffix = F.get(F.array(*[F.lit(x) for x in (" Inc.", " LLC", " Corporation", " co", "",
                                                 " Ltd", " - Labs Co.")]), (k % 7).cast("int"))
    name = F.concat(F.col("s_name"), suffix)
    return s.select(k.alias("s_suppkey"), name.alias("name"),
                    ft.infer_website(name).alias("website"))


def url_domains(spark: SparkSession, sf: str) -> DataFrame:
    """X14 over every landed page URL (and a scheme-less variant)."""
    p = read_table(spark, sf, "pages").select("page_id", "url")
    bare = F.regexp_replace("url", "^https?://", "")
    return p.select("page_id", fw.url_domain("url").alias("domain"),
                    fw.url_domain(bare).alias("bare_domain"))


def size_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """X15 over a spread of employee counts."""
    c = read_table(spark, sf, "customer").select("c_custkey")
    n = F.when(F.col("c_custkey") % 17 == 0, F.lit(None)).otherwise(
        (F.col("c_custkey") * 7 % 7000).cast("int"))
    return c.select("c_custkey", n.alias("employee_count"), fc.size_bucket(n).alias("company_size"))


def location_format(spark: SparkSession, sf: str) -> DataFrame:
    """Locality, region, country → one string."""
    m = base.members(spark, sf)
    region = F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.col("title"))
    return m.select("id", fc.format_location("city", region, "country").alias("location"))


def member_cities(spark: SparkSession, sf: str) -> DataFrame:
    """Gazetteer city of a free-text location."""
    m = base.members(spark, sf)
    i = F.col("id")
    loc = F.when(i % 5 == 0, F.concat(F.lit("New Taipei City, "), F.coalesce("country", F.lit(""))))\
        .when(i % 5 == 1, F.upper(F.coalesce("location", F.lit("")))).otherwise(F.col("location"))
    ctry = F.when(i % 2 == 0, F.col("country"))
    return m.select("id", loc.alias("location_text"), ctry.alias("country_hint"),
                    fc.city_from_location(loc, ctry).alias("city"))


def title_case(spark: SparkSession, sf: str) -> DataFrame:
    """Vendor-A country title-casing."""
    m = base.members(spark, sf)
    return m.select("id", ft.title_case(F.lower("country")).alias("country"))


def description_truncate(spark: SparkSession, sf: str) -> DataFrame:
    """X19 on whole documents: truncated text digest and length."""
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    t = ft.truncate_description("text")
    return d.select("doc_id", F.md5(t).alias("cut_md5"), F.length(t).alias("cut_len"))


def html_teaser(spark: SparkSession, sf: str) -> DataFrame:
    """X20 on whole landed pages."""
    p = read_table(spark, sf, "pages").select("page_id", "html")
    return p.select("page_id", ft.html_teaser("html").alias("teaser"))


def date_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Age label, ISO and long dates, whole-day age."""
    j = base.jobs(spark, sf)
    return j.select("seq",
                    fd.age_label("posted_date", AS_OF).alias("age_label"),
                    fd.iso_format("posted_date").alias("posted_iso"),
                    fd.long_us_date("posted_date").alias("posted_long"),
                    fd.age_days("posted_date", AS_OF).alias("age_days"))
