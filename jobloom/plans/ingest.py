"""Page / payload ingest queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobloom.functions.text import py_strip
from jobloom.plans import base
from jobloom.sources import boards, embedded, extracted, html, landed, pages
from jobloom.sources.html import dom_to_jobs as _dom_to_jobs
from jobloom.sources.tables import read_table

AS_OF = base.AS_OF
JOB_COLS = ["page_id", "pos", "id", "title", "company", "location", "description", "url",
            "posted_date", "remote_type"]


def _search_pages(spark, sf):
    return landed.search_pages(base.jobs(spark, sf))


def embedded_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """S2 + S4: jobs from the embedded JSON of every search page."""
    return embedded.embedded_jobs(_search_pages(spark, sf), AS_OF).select(
        *JOB_COLS, "salary_min", "salary_max")


def page_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Total job count announced by each page."""
    return embedded.embedded_payload(_search_pages(spark, sf)).select("page_id", "total_count")


def dom_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs from the card markup (Arrow-batched parser)."""
    return _dom_to_jobs(html.extract_cards(_search_pages(spark, sf), "dom"), AS_OF).select(*JOB_COLS)


def selector_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """S6 + S8: declarative selector extraction, then the item mapping."""
    return boards.get_extractor("css")(_search_pages(spark, sf), AS_OF).select(
        *JOB_COLS, "company_website")


def extracted_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """S7 + S8: landed extraction payloads (list or wrapped form) to jobs."""
    payloads = landed.extraction_payloads(base.jobs(spark, sf))
    out = extracted.items_to_jobs(extracted.parse_payload(payloads), AS_OF)
    return out.select(*JOB_COLS, "company_website", "salary_min", "salary_max")


def embedded_dirty(spark: SparkSession, sf: str) -> DataFrame:
    """S4 over lists with explicit nulls and elements that are no objects."""
    return embedded.embedded_jobs(landed.search_pages(base.jobs(spark, sf), dirty=True), AS_OF).select(
        *JOB_COLS, "salary_min", "salary_max")


def embedded_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """What was left out of these lists, and why."""
    return embedded.embedded_rejects(landed.search_pages(base.jobs(spark, sf), dirty=True))


def extracted_dirty(spark: SparkSession, sf: str) -> DataFrame:
    """S7 + S8 over payloads with salaries as text and elements that are no objects."""
    payloads = landed.dirty_extraction_payloads(base.jobs(spark, sf))
    out = extracted.items_to_jobs(extracted.parse_payload(payloads), AS_OF)
    return out.select(*JOB_COLS, "company_website", "salary_min", "salary_max")


def search_results(spark: SparkSession, sf: str, max_results: int = 50) -> DataFrame:
    """The results of each search: its pages in order up to the first page without
    jobs, cut at ``max_results`` jobs."""
    found = embedded.embedded_jobs(_search_pages(spark, sf), AS_OF, keep=("page_id", "search_id", "page_no"))
    return pages.search_results(found, max_results).select("search_id", "rank", "id", "title")


def blocked_pages(spark: SparkSession, sf: str) -> DataFrame:
    """S14 over every landed driver page."""
    return pages.blocked_flags(read_table(spark, sf, "pages"))


def source_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Embedded JSON where present, card markup for the other pages."""
    return pages.jobs_or_cards(_search_pages(spark, sf), AS_OF).select(
        "page_id", "pos", "id", "title", "company", "location", "source")


def hybrid_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """The css rows of a page where it has any, else the rows of its extraction payload."""
    sp = _search_pages(spark, sf).select(
        "page_id", F.when(F.col("page_no") % 3 != 2, F.col("html")).otherwise(F.lit("")).alias("html"))
    pay = landed.extraction_payloads(base.jobs(spark, sf)).select("page_id", "payload")
    out = boards.get_extractor("hybrid")(sp.join(pay, "page_id", "left"), AS_OF)
    return out.select(*JOB_COLS)


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    """Every link of every landed driver page, in page order."""
    return html.extract_links(read_table(spark, sf, "pages"), ["href", "text"])


def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Generic page fields: title and host of every landed page (JVM regex)."""
    from jobloom.functions.web import url_domain
    p = read_table(spark, sf, "pages")
    title = py_strip(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1))
    return p.select("page_id", title.alias("title"), url_domain("url").alias("host"))
