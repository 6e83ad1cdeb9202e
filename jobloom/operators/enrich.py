"""Enrichment joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from jobloom.constants import DEFAULT_PREFERRED_CITIES, TARGET_COUNTRIES
from jobloom.functions.dates import as_of_col
from jobloom.functions.text import infer_website
from jobloom.operators.skew import salted_join

UNKNOWN_COMPANY = "Unknown"
ENRICH_COLUMNS = ["company_id", "company_size", "industry", "headquarters_location",
                  "region_team_count", "preferred_city_count", "member_count", "enriched_at"]


def fresh_companies(companies: DataFrame, as_of, max_age_days: int = 30) -> DataFrame:
    """F8: companies enriched within ``max_age_days`` of ``as_of``."""
    cutoff = F.timestamp_add("DAY", F.lit(-max_age_days), as_of_col(as_of))
    return companies.where(F.col("enriched_at") >= cutoff)


def member_stats(members: DataFrame, preferred_cities=DEFAULT_PREFERRED_CITIES) -> DataFrame:
    """J2 as an aggregate: per company member count and preferred-city hits (A2).

    A partial (map-side) aggregation: a company holding a third of all
    members costs one row per map task, never one list in one task.
    """
    return members.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("member_count"),
        F.count_if(F.col("city").isin(list(preferred_cities))).alias("preferred_city_count"))


def enrich_jobs(jobs: DataFrame, companies: DataFrame, members: DataFrame, as_of,
                max_age_days: int = 30,
                preferred_cities=DEFAULT_PREFERRED_CITIES, salted: bool = False) -> DataFrame:
    """J1 + P2: left join jobs to fresh companies on the requested name.

    The newest fresh company of each ``requested_name`` is taken, so the join never fans out;
    the placeholder company 'Unknown' is nobody's name and isn't matched.
    The company side is small per key and AQE broadcasts it when its
    measured size is under the threshold, else it is a sort-merge join; ``salted`` spreads the jobs
    of a company that holds far more than others (one more read of the company column).
    """
    stats = member_stats(members, preferred_cities)
    fresh = fresh_companies(companies, as_of, max_age_days).select(
        F.col("requested_name").alias("_cname"),
        F.col("id").alias("company_id"),
        "company_size", "industry", "headquarters_location",
        "region_team_count", F.col("enriched_at").alias("_company_enriched_at"))
    newest = Window.partitionBy("_cname").orderBy(
        F.col("_company_enriched_at").desc(), F.col("company_id"))
    fresh = (fresh.where(F.col("_cname") != UNKNOWN_COMPANY)
             .withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn"))
    fresh = (fresh.join(stats, "company_id", "left")
             .withColumn("member_count", F.coalesce("member_count", F.lit(0)))
             .withColumn("preferred_city_count", F.coalesce("preferred_city_count", F.lit(0))))
    drop = [c for c in ENRICH_COLUMNS if c in jobs.columns]
    jobs = jobs.drop(*drop)
    if salted:
        out = salted_join(jobs, fresh.withColumnRenamed("_cname", "company"), "company", "left")
    else:
        out = jobs.join(fresh, F.col("company") == F.col("_cname"), "left").drop("_cname")
    return (out.withColumn("region_team_count", F.coalesce("region_team_count", F.lit(0)))
            .withColumn("member_count", F.coalesce("member_count", F.lit(0)))
            .withColumn("preferred_city_count", F.coalesce("preferred_city_count", F.lit(0)))
            .withColumnRenamed("_company_enriched_at", "enriched_at"))


def job_team(enriched: DataFrame, members: DataFrame) -> DataFrame:
    """The team members of every enriched job, as flat rows: no list is collected for a job
    or a company, and the members of a company with a very large team are spread."""
    team = members.select("company_id", F.col("id").alias("member_id"), "name", "title", "city", "country")
    jobs = enriched.where(F.col("company_id").isNotNull()).select("company_id", F.col("id").alias("job_id"), "seq")
    return salted_join(team, jobs, "company_id")


def enrichment_work_list(jobs: DataFrame, companies: DataFrame, as_of,
                         max_age_days: int = 30, order_col: str = "seq",
                         website_col: str = "company_website") -> DataFrame:
    """J7 + J8: one request per company name that has no fresh company row.

    The first job of a company (input order) supplies the website; the domain
    to query is that website, else one inferred from the name.
    """
    w = F.col(website_col) if website_col in jobs.columns else F.lit(None).cast("string")
    first = (jobs.select("company", F.struct(F.col(order_col).alias("o"), w.alias("w")).alias("s"))
             .groupBy("company").agg(F.min("s").alias("s"))
             .select("company", F.col("s.w").alias("website"), F.col("s.o").alias("first_seq")))
    fresh = fresh_companies(companies, as_of, max_age_days).select(
        F.col("requested_name").alias("company"))
    todo = first.join(fresh, "company", "left_anti")
    return todo.withColumn("domain", F.coalesce(F.nullif("website", F.lit("")),
                                                infer_website(F.col("company"))))


def match_employers(companies: DataFrame, people: DataFrame, targets=TARGET_COUNTRIES,
                    domain_col: str = "domain") -> DataFrame:
    """People whose experience names the company domain, in the target countries.

    Past employers count, as in the reference.  One row per (company, person).  A domain that many
    people name is spread over several tasks.
    """
    exp = (people.where(F.col("country").isin(list(targets)))
           .select("person_id", "name", "title", "location", "country", "url",
                   F.explode("experience").alias("x"))
           .select("*", F.col("x.company_website.domain_only").alias("_dom")).drop("x")
           .where(F.col("_dom").isNotNull()))
    matched = salted_join(exp, companies.select("company_id", F.col(domain_col).alias("_dom")), "_dom")
    return matched.drop("_dom").dropDuplicates(["company_id", "person_id"])


def people_of_employer(people: DataFrame, employer: str, targets=TARGET_COUNTRIES,
                       name_col: str = "employer") -> DataFrame:
    """the flat form of the vendor query: people in the target countries (compared in lower
    case) whose current employer has this name.  Both predicates reach the scan of a people table."""
    lower = [t.lower() for t in targets]
    return people.where(F.lower("country").isin(lower) & (F.col(name_col) == employer))
