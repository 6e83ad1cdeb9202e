"""Serving operators: list filters, search, lookups, aggregates, top-k (F, J3, A, O)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from jobloom.functions.text import ascii_lower, like_escape
from jobloom.session import materialize

def o1() -> list:
    """O1: score desc, posted desc (nulls last), id as our tiebreak."""
    return [F.col("ranking_score").desc_nulls_last(), F.col("posted_date").desc_nulls_last(),
            F.col("id").asc()]


def o3() -> list:
    """O3: members by country, city, name (nulls first), id as our tiebreak."""
    return [F.col(c).asc_nulls_first() for c in ("country", "city", "name")] + [F.col("id").asc()]


LIST_COLUMNS = ["id", "title", "company", "location", "posted_date", "company_id",
                "region_team_count", "ranking_score", "enriched_at"]
COMPANY_COLUMNS = ["id", "name", "website", "industry", "company_size", "headquarters_location",
                   "region_team_count", "enriched_at"]


def jobs_filter(jobs: DataFrame, min_team: int = 0, enriched_only: bool = False,
                ui_semantics: bool = False, count_col: str = "region_team_count") -> DataFrame:
    """F1 / F2 / F3.

    Store semantics (F1): the threshold applies only when ``min_team > 0``.
    UI semantics (F2): always ``count >= min_team``, so 0 drops null counts.
    """
    out = jobs
    if enriched_only:
        out = out.where(F.col("enriched_at").isNotNull())
    if ui_semantics or min_team > 0:
        out = out.where(F.col(count_col) >= min_team)
    return out


def search(jobs: DataFrame, q: str, min_team: int = 0,
           fields=("title", "company", "description")) -> DataFrame:
    """LIKE '%q%' on any field with SQLite's ASCII-only case folding.
    An empty query falls back to the UI list (F2)."""
    if not q:
        return jobs_filter(jobs, min_team, ui_semantics=True)
    pattern = "%" + like_escape(q.translate(str.maketrans(
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) + "%"
    cond = None
    for f in fields:
        c = ascii_lower(F.col(f)).like(pattern)
        cond = c if cond is None else (cond | c)
    return jobs.where(cond)


def top_per_group(df: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """First ``k`` rows per group.  ``row_number() <= k`` is
    planned with a partial WindowGroupLimit before the shuffle, so a hot
    group sends at most ``k`` rows per map task."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def in_order(df: DataFrame, order: list, pos: str = "pos") -> DataFrame:
    """All rows with their place in a global order, without one task that holds them all.

    Rows are range-sorted; a row's place is its place in its sorted partition plus the rows of
    the partitions before.  The sorted rows are written once, so both uses see the same ranges.
    """
    part, row = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = materialize(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id())
                         .withColumn("_part", part), "ordered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))     # one row a partition
    return ranked.join(base, "_part").withColumn(
        pos, (row + F.col("_base") + 1).cast("long")).drop("_m", "_part", "_n", "_base")


def members_by_country(members: DataFrame) -> DataFrame:
    """A3."""
    country = F.coalesce(F.nullif(F.col("country"), F.lit("")), F.lit("Unknown"))
    return members.groupBy("company_id", country.alias("country")).agg(
        F.count(F.lit(1)).alias("n_members"))


def country_rollup(members: DataFrame) -> DataFrame:
    """A4: per (company, country) counts plus one 'All' row per company."""
    r = members.rollup("company_id", "country").agg(
        F.count(F.lit(1)).alias("n_members"), F.grouping_id().alias("_g"))
    return (r.where(F.col("_g") < 3)
            .select("company_id",
                    F.when(F.col("_g") == 1, F.lit("All")).otherwise(
                        F.coalesce("country", F.lit("Unknown"))).alias("country"),
                    "n_members"))


def company_360(companies: DataFrame, jobs: DataFrame, members: DataFrame) -> DataFrame:
    """Company + open positions + member count + sorted distinct countries.

    All pre-aggregated per company before the joins; the countries list is
    bounded by the number of countries in the world.
    """
    jc = (jobs.where(F.col("company_id").isNotNull()).groupBy("company_id")
          .agg(F.count(F.lit(1)).alias("open_positions")))
    mc = (members.groupBy("company_id")
          .agg(F.count(F.lit(1)).alias("n_members"),
               F.array_join(F.sort_array(F.collect_set("country")), ",").alias("countries")))
    c = companies.select(F.col("id").alias("company_id"), "name", "industry", "company_size",
                         "region_team_count")
    return (c.join(jc, "company_id", "left").join(mc, "company_id", "left")
            .select("company_id", "name", "industry", "company_size", "region_team_count",
                    F.coalesce("open_positions", F.lit(0)).alias("open_positions"),
                    F.coalesce("n_members", F.lit(0)).alias("n_members"),
                    F.coalesce("countries", F.lit("")).alias("countries")))


def saved_search(jobs: DataFrame, as_of, min_salary=None, job_types=None, posted_within_days=None,
                 min_team=None) -> DataFrame:
    """conjunction of the saved-search predicates that are set."""
    from jobloom.functions.dates import age_days
    out = jobs
    if min_salary is not None:
        out = out.where(F.coalesce(F.col("salary_max"), F.col("salary_min")) >= min_salary)
    if job_types:
        out = out.where(F.col("job_type").isin(list(job_types)))
    if posted_within_days is not None:
        out = out.where(age_days(F.col("posted_date"), as_of) <= posted_within_days)
    if min_team is not None:
        out = out.where(F.coalesce(F.col("region_team_count"), F.lit(0)) >= min_team)
    return out


def digest_top(jobs: DataFrame, n: int = 10) -> DataFrame:
    """The alert digest — most regional members first, then newest."""
    return jobs.orderBy(F.col("region_team_count").desc_nulls_last(),
                        F.col("posted_date").desc_nulls_last(), F.col("id")).limit(n)
