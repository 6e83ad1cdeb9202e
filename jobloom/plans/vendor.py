"""Vendor landing queries (S9-S13, J9, O7, A1, K2/K3 from responses)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobloom.operators.enrich import match_employers, people_of_employer
from jobloom.operators.serve import top_per_group
from jobloom.plans import base
from jobloom.sources import vendor
from jobloom.sources.tables import read_table


def vendor_a_company(spark: SparkSession, sf: str) -> DataFrame:
    """Vendor-A company bodies → company rows."""
    return vendor.vendor_a_companies(vendor.company_responses_a(base.companies(spark, sf))) \
        .select(*vendor.COMPANY_COLUMNS)


def vendor_b_company(spark: SparkSession, sf: str) -> DataFrame:
    """Vendor-B company bodies → company rows."""
    return vendor.vendor_b_companies(vendor.company_responses_b(base.companies(spark, sf))) \
        .select(*vendor.COMPANY_COLUMNS)


def vendor_a_people(spark: SparkSession, sf: str) -> DataFrame:
    """S11 + O7: vendor-A people bodies → member rows."""
    return vendor.vendor_a_people(vendor.people_responses(base.members(spark, sf), "a"))


def vendor_b_people(spark: SparkSession, sf: str) -> DataFrame:
    """S12 + O7: vendor-B people bodies → member rows with gazetteer city."""
    return vendor.vendor_b_people(vendor.people_responses(base.members(spark, sf), "b"))


def vendor_head_count(spark: SparkSession, sf: str) -> DataFrame:
    """A1: returned members per company (≤ 100)."""
    return vendor.region_head_count(vendor_a_people(spark, sf))


def company_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Company metadata bodies of landed pages."""
    c = base.companies(spark, sf)
    k = F.col("id").cast("long")
    body = F.to_json(F.struct(
        F.col("name").alias("company_name"),
        F.when(k % 3 == 0, F.concat(F.lit("https://www.indeed.com/cmp/"), F.col("id")))
        .otherwise(F.concat(F.lit("https://"), F.col("website"))).alias("website_url"),
        F.col("industry").alias("industry"), F.col("company_size").alias("company_size"),
        F.col("headquarters_location").alias("headquarters")))
    return vendor.company_metadata(c.select(k.alias("page_id"), body.alias("body")))


def employer_match(spark: SparkSession, sf: str) -> DataFrame:
    """People whose (past or present) employer domain is a company's website."""
    m = base.members(spark, sf)
    n = read_table(spark, sf, "supplier").select(F.count(F.lit(1))).scalar()
    people = vendor.people_table(m, n)
    companies = base.companies(spark, sf).select(F.col("id").alias("company_id"),
                                                 F.col("website").alias("domain"))
    return match_employers(companies, people).select("company_id", "person_id", "name", "country")


def vendor_people(spark: SparkSession, sf: str) -> DataFrame:
    """People of both vendors through the registry, each from its own bodies."""
    m, out = base.members(spark, sf), None
    for name in ("a", "b"):
        _, people = vendor.get_vendor(name)
        rows = people(vendor.people_responses(m, name)).select(
            F.lit(name).alias("vendor"), "company_id", "pos", "name")
        out = rows if out is None else out.unionByName(rows)
    return out


def people_by_employer(spark: SparkSession, sf: str) -> DataFrame:
    """F6 + O7: people in the target countries at one employer, 100 at most."""
    m = base.members(spark, sf).join(base.companies(spark, sf).select(
        F.col("id").alias("company_id"), F.col("name").alias("employer")), "company_id")
    found = people_of_employer(m, "Supplier#000000000")
    return top_per_group(found, "company_id", [F.col("id")], 100).select("id", "company_id", "country")


def people_cap(spark: SparkSession, sf: str) -> DataFrame:
    """At most 100 matched people per company (person id order)."""
    return top_per_group(employer_match(spark, sf), "company_id", [F.col("person_id")], 100)


def company_websites(spark: SparkSession, sf: str) -> DataFrame:
    """Website domain of every landed company page."""
    from jobloom.operators.website import company_website
    from jobloom.sources import html, landed
    pg = landed.company_pages(base.companies(spark, sf))
    return company_website(pg, html.extract_links(pg))


def _websites(spark, sf, ruleset):
    from jobloom.operators.website import company_website
    from jobloom.sources import html, landed
    pg = landed.company_pages(base.companies(spark, sf))
    return company_website(pg, html.extract_links(pg), ruleset)


def company_websites_labelled(spark: SparkSession, sf: str) -> DataFrame:
    """X25, second rule set: label text, info sections, test ids; the raw url."""
    return _websites(spark, sf, "labelled")


def company_websites_plain(spark: SparkSession, sf: str) -> DataFrame:
    """X25, third rule set: the first absolute link to no known site; the raw url."""
    return _websites(spark, sf, "plain")


def company_page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Company-page link of every landed job page."""
    from jobloom.operators.website import company_page_link
    from jobloom.sources import html, landed
    pg = landed.job_detail_pages(base.jobs(spark, sf))
    return company_page_link(html.extract_links(pg), pg)
