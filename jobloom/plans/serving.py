"""Ranked lists and the flagship query."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobloom.operators.enrich import enrich_jobs, job_team
from jobloom.operators.rank import RankingConfig, rank_jobs, rank_order
from jobloom.plans import base

RANKED_COLUMNS = ["id", "seq", "title", "company", "location", "posted_date", "company_id",
                  "region_team_count", "preferred_city_count", "industry", "company_size",
                  "ranking_score"]


def ranked_top(spark: SparkSession, sf: str, n: int = 50) -> DataFrame:
    """Top-n jobs ranked by regional team (the flagship)."""
    r = base.ranked(spark, sf)
    return r.orderBy(*rank_order()).limit(n).select(*RANKED_COLUMNS)


def ranked_all(spark: SparkSession, sf: str) -> DataFrame:
    """R7 over the whole table: every job above the threshold with its score."""
    return base.ranked(spark, sf).select(*RANKED_COLUMNS)


TARGETS = RankingConfig(target_industries=("saas", "fintech"), target_company_sizes=("11-50", "5000+"),
                        preferred_cities=("Taipei", "Shanghai"), min_team=2)


def ranked_with_targets(spark: SparkSession, sf: str) -> DataFrame:
    """R3 + R4 + R8: scores with target industries, company sizes, cities and a threshold of 2."""
    e = enrich_jobs(base.jobs(spark, sf), base.companies(spark, sf), base.members(spark, sf),
                    base.AS_OF, preferred_cities=TARGETS.preferred_cities)
    return rank_jobs(e, TARGETS, base.AS_OF).select("id", "seq", "industry", "company_size",
                                                   "region_team_count", "ranking_score")


# ------------------------------------------------------------------ serving
from pyspark.sql import Window  # noqa: E402

from jobloom.functions.text import ascii_lower, like_escape  # noqa: E402
from jobloom.operators import search_index, serve  # noqa: E402
from jobloom.operators.skew import salted_join  # noqa: E402
from jobloom.plans import stored  # noqa: E402

SEARCH_TERM = "ring"
LOOKUP_COMPANY = "1"
HOT_COMPANY = "0"


def _store(spark, sf):
    return stored.jobs(spark, sf)


def store_jobs_list(spark: SparkSession, sf: str) -> DataFrame:
    """F1 + F3 + O1: enriched jobs with at least one regional member, best first, 100."""
    s = serve.jobs_filter(_store(spark, sf), min_team=1, enriched_only=True, ui_semantics=False)
    return s.orderBy(*serve.o1()).limit(100).select(*serve.LIST_COLUMNS)


def ui_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """F2 + O1: the UI list (count >= 0 drops null counts), 100."""
    s = serve.jobs_filter(_store(spark, sf), min_team=0, ui_semantics=True)
    return s.orderBy(*serve.o1()).limit(100).select(*serve.LIST_COLUMNS)


def keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    """F4 + O1: keyword over title, company, description; ASCII case folding."""
    s = serve.search(_store(spark, sf), SEARCH_TERM)
    return s.orderBy(*serve.o1()).limit(100).select(*serve.LIST_COLUMNS)


# Whole words, upper case, wildcards, a term that matches nothing and one too short for an index.
INDEXED_TERMS = ("ring", "ECONOMY", "sma%brand#1", "5_low", "d wid", "zzzz", "m ")


def keyword_search_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """F4 + O1 through the trigram index: the first 100 rows of each of several terms."""
    folder = stored.job_index(spark, sf)
    found = [search_index.search(spark, folder, q).orderBy(*serve.o1()).limit(100)
             .select(F.lit(q).alias("term"), *serve.LIST_COLUMNS) for q in INDEXED_TERMS]
    return functools.reduce(DataFrame.unionByName, found)


def search_result_count(spark: SparkSession, sf: str) -> DataFrame:
    """Number of rows of the limited search result."""
    return keyword_search(spark, sf).agg(F.count(F.lit(1)).alias("n_results"))


def job_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """point lookup of a job (the first stored job's id)."""
    s = _store(spark, sf)
    target = s.select(F.min_by("id", "seq")).first()[0]
    return s.where(F.col("id") == F.lit(target)).select(*serve.LIST_COLUMNS)


def company_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """point lookup of a company."""
    return stored.companies(spark, sf).where(F.col("id") == LOOKUP_COMPANY).select(*serve.COMPANY_COLUMNS)


def member_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """point lookup of a team member (integer id)."""
    return stored.members(spark, sf).where(F.col("id") == 7)


def jobs_of_company(spark: SparkSession, sf: str) -> DataFrame:
    """all jobs of one company in the order of O1 (``pos``), no limit."""
    s = _store(spark, sf).where(F.col("company_id") == LOOKUP_COMPANY)
    return serve.in_order(s.select(*serve.LIST_COLUMNS), serve.o1())


def members_of_company(spark: SparkSession, sf: str) -> DataFrame:
    """F11 + O3: members of the largest company, ordered country, city, name."""
    m = stored.members(spark, sf).where(F.col("company_id") == HOT_COMPANY)
    return serve.in_order(m.select("id", "company_id", "name", "city", "country"), serve.o3())


def members_of_company_country(spark: SparkSession, sf: str) -> DataFrame:
    """one country of one company."""
    m = stored.members(spark, sf).where((F.col("company_id") == HOT_COMPANY) & (F.col("country") == "Taiwan"))
    return serve.in_order(m.select("id", "company_id", "name", "city", "country"), serve.o3()[1:])


def job_by_id_clustered(spark: SparkSession, sf: str) -> DataFrame:
    """F9 on the clustered layout."""
    target = _store(spark, sf).select(F.min_by("id", "seq")).first()[0]
    return stored.clustered(spark, sf, "jobs", {"id": (target, target)}).select(*serve.LIST_COLUMNS)


def jobs_of_company_clustered(spark: SparkSession, sf: str) -> DataFrame:
    """F10 on the clustered layout."""
    s = stored.clustered(spark, sf, "jobs", {"company_id": (LOOKUP_COMPANY, LOOKUP_COMPANY)})
    return serve.in_order(s.select(*serve.LIST_COLUMNS), serve.o1())


RECENT = "2001-08-01 00:00:00"


def recent_jobs_of_company(spark: SparkSession, sf: str) -> DataFrame:
    """F10 within a range of days: two clustered columns prune together."""
    s = stored.clustered(spark, sf, "jobs", {"company_id": (LOOKUP_COMPANY, LOOKUP_COMPANY),
                                             "posted_date": (RECENT, None)})
    return serve.in_order(s.select(*serve.LIST_COLUMNS), serve.o1())


def members_of_company_clustered(spark: SparkSession, sf: str) -> DataFrame:
    """F11 on the clustered layout: one country of the largest company."""
    m = stored.clustered(spark, sf, "members", {"company_id": (HOT_COMPANY, HOT_COMPANY),
                                                "country": ("Taiwan", "Taiwan")})
    return serve.in_order(m.select("id", "company_id", "name", "city", "country"), serve.o3()[1:])


def remote_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """remote-only listings."""
    from jobloom.functions.web import remote_type
    j = base.jobs(spark, sf).withColumn("remote_type", remote_type("location"))
    return j.where(F.col("remote_type") == "Remote").select("seq", "id", "title", "location")


def list_view(spark: SparkSession, sf: str) -> DataFrame:
    """Store rows projected to the list columns (real score shown)."""
    return _store(spark, sf).select("id", "title", "company", "location", "url", "posted_date",
                                    "board_source", "ranking_score")


def enriched_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """Every landed job with its enrichment fields and defaults."""
    return base.enriched(spark, sf, salted=True).select(
        "seq", "id", "company_id", "company_size", "industry", "headquarters_location",
        "region_team_count", "enriched_at")


def company_360(spark: SparkSession, sf: str) -> DataFrame:
    """J3 + A7 + A5: every company with open positions, member count and countries."""
    return serve.company_360(stored.companies(spark, sf), _store(spark, sf), stored.members(spark, sf))


def company_people(spark: SparkSession, sf: str) -> DataFrame:
    """J3 + A3: the members behind each country of the company page, as flat rows with the
    country's count; no list is collected for a company."""
    m = stored.members(spark, sf)
    country = F.coalesce(F.nullif(F.col("country"), F.lit("")), F.lit("Unknown"))
    m = m.select("id", "company_id", "name", "title", "city", country.alias("country"))
    counts = serve.members_by_country(m)
    return m.join(counts, ["company_id", "country"])


def company_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """The open positions of every company page, as flat rows."""
    return _store(spark, sf).where(F.col("company_id").isNotNull()).select(
        "company_id", "id", "title", "location", "posted_date", "ranking_score")


def job_company(spark: SparkSession, sf: str) -> DataFrame:
    """Every stored job with its company's name and website."""
    s = _store(spark, sf).select("id", "company_id")
    c = stored.companies(spark, sf).select(F.col("id").alias("company_id"),
                                         F.col("name").alias("company_name"), "website")
    return s.join(c, "company_id", "left").select("id", "company_id", "company_name", "website")


def member_company(spark: SparkSession, sf: str) -> DataFrame:
    """Every member with its company's name."""
    m = stored.members(spark, sf).select("id", "company_id", "name")
    c = stored.companies(spark, sf).select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))
    return salted_join(m, c, "company_id", "left")


def enriched_team(spark: SparkSession, sf: str) -> DataFrame:
    """P2 + J2: the members behind every enriched job, as flat rows."""
    return job_team(base.enriched(spark, sf), base.members(spark, sf)).select(
        "seq", "job_id", "member_id", "name", "title", "city", "country")


def company_list(spark: SparkSession, sf: str) -> DataFrame:
    """O2: companies by regional head-count, 100."""
    c = stored.companies(spark, sf)
    return c.orderBy(F.col("region_team_count").desc_nulls_last(), F.col("id")).limit(100) \
        .select(*serve.COMPANY_COLUMNS)


def members_by_country(spark: SparkSession, sf: str) -> DataFrame:
    """A3: members per company and country ('' / null → 'Unknown')."""
    return serve.members_by_country(stored.members(spark, sf))


def country_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """A4: per company and country plus the per-company 'All' total."""
    return serve.country_rollup(stored.members(spark, sf))


def company_countries(spark: SparkSession, sf: str) -> DataFrame:
    """A5 + O4: distinct non-null countries per company, by name (``pos``)."""
    c = stored.members(spark, sf).where(F.col("country").isNotNull()) \
        .select("company_id", "country").distinct()
    by = Window.partitionBy("company_id").orderBy("country")     # as many rows as countries
    return c.withColumn("pos", F.row_number().over(by))


def jobs_per_company(spark: SparkSession, sf: str) -> DataFrame:
    """Open positions per company."""
    return _store(spark, sf).where(F.col("company_id").isNotNull()) \
        .groupBy("company_id").agg(F.count(F.lit(1)).alias("open_positions"))


def member_preview(spark: SparkSession, sf: str) -> DataFrame:
    """First 12 members of every company in display order."""
    return serve.top_per_group(stored.members(spark, sf), "company_id",
                               serve.o3(), 12) \
        .select("id", "company_id", "name", "city", "country")


def top_jobs_cli(spark: SparkSession, sf: str) -> DataFrame:
    """The CLI's top 20 of the ranked list."""
    return ranked_top(spark, sf, 20)


def distinct_companies(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct company names of the landed jobs."""
    return base.jobs(spark, sf).select("company").distinct()


def enrichment_work_list(spark: SparkSession, sf: str) -> DataFrame:
    """J7 + J8: companies to fetch (no fresh row), one request each."""
    from jobloom.operators.enrich import enrichment_work_list as wl
    j = base.jobs(spark, sf)
    j = j.withColumn("company_website", F.when(F.col("seq") % 2 == 1, F.concat(
        F.lit("https://"), F.lower(F.regexp_replace("company", "#", "")), F.lit(".example.com"))))
    # the cache holds only companies whose name is in the first half of suppliers
    c = stored.companies(spark, sf).where(F.col("id").cast("long") % 2 == 0)
    return wl(j, c, base.AS_OF).select("company", "website", "domain")


def digest_top10(spark: SparkSession, sf: str) -> DataFrame:
    """Top 10 stored jobs by regional team, then recency."""
    return serve.digest_top(_store(spark, sf), 10).select(*serve.LIST_COLUMNS)


def saved_search(spark: SparkSession, sf: str) -> DataFrame:
    """landed jobs paying at least 60k, posted within 14 days, with a regional team."""
    from jobloom.functions.salary import parse_salary
    e = base.enriched(spark, sf)
    s = parse_salary("salary_text")
    e = e.withColumn("salary_min", s.salary_min).withColumn("salary_max", s.salary_max)
    out = serve.saved_search(e, base.AS_OF, min_salary=60000, posted_within_days=14, min_team=1)
    return out.select("seq", "id", "salary_min", "salary_max", "posted_date", "region_team_count")


JOB_TYPES = ("Remote",)


def saved_search_types(spark: SparkSession, sf: str) -> DataFrame:
    """F13 with job types: landed remote jobs posted within 30 days.  Postings carry no other type
    than the one found in the location (X9)."""
    from jobloom.functions.web import remote_type
    e = base.enriched(spark, sf).withColumn("job_type", remote_type("location"))
    return serve.saved_search(e, base.AS_OF, job_types=JOB_TYPES, posted_within_days=30).select(
        "seq", "id", "job_type", "posted_date")
