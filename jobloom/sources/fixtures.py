"""Derivation of the job-postings tables from the driver tables (FIXTURES.md §C).

One landed job per ``orders`` row, one company per ``supplier`` row, one team
member per ``customer`` row.  All joins are equi-joins on computed keys; the
row counts of ``part`` and ``supplier`` enter as scalar sub-queries (evaluated
once, no cross join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobloom.constants import TARGET_COUNTRIES
from jobloom.functions.text import job_id
from jobloom.sources.tables import read_table

AS_OF = "2001-09-01 12:00:00"

# --- fixed values: fixture vocabularies (FIXTURES.md §C) --------------------
POSTED_TEXTS = ["Just posted", "Today", "3 days ago", "30+ days ago", "2 weeks ago",
                "5 hours ago", "", "PostedPosted 4 days ago"]
SALARY_TEXTS = ["$50,000 - $70,000 a year", "$25 - $35 an hour", "$80K - $100K",
                "$800 a week", "", None]
INDUSTRIES = ["Information Technology", "SaaS Platforms", "Fintech", "Manufacturing", None]
COMPANY_SIZES = ["1-10", "11-50", "51-200", "201-500", "5000+", None]
MEMBER_COUNTRIES = ["Taiwan", "China", "Singapore", "Hong Kong", "Japan", None]
TAIWAN_CITIES = ["Taipei", "Hsinchu", "Tainan"]
CHINA_CITIES = ["Shanghai", "Chengdu", "Beijing"]
JOB_URL_PREFIX = "https://jobs.example.com/viewjob?jk="


def _pick(index_col, values):
    """values[index]: a literal array lookup (0-based)."""
    arr = F.array(*[F.lit(v).cast("string") for v in values])
    return F.get(arr, index_col.cast("int"))


def landed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey",
                                                        "o_orderpriority")
    part = read_table(spark, sf_dir, "part")
    supplier = read_table(spark, sf_dir, "supplier")
    n_part = part.select(F.count(F.lit(1))).scalar()
    n_supp = supplier.select(F.count(F.lit(1))).scalar()
    k = F.col("o_orderkey")
    j = (orders
         .join(part.select("p_partkey", "p_name", "p_type", "p_brand"),
               F.col("p_partkey") == k % n_part)
         .join(supplier.select("s_suppkey", "s_name"),
               F.col("s_suppkey") == F.col("o_custkey") % n_supp))
    pname = F.col("p_name")
    title = (F.when(k % 5 == 0, F.concat(F.lit("Senior "), pname))
             .when(k % 5 == 1, F.concat(F.lit("Sr. "), pname))
             .when(k % 5 == 2, F.concat(pname, F.lit(" - Remote")))
             .when(k % 5 == 3, F.upper(pname))
             .otherwise(pname))
    location = F.when(k % 4 == 0, F.lit("Remote")).otherwise(
        F.concat(F.lit("City "), (F.col("o_custkey") % 9).cast("string")))
    description = F.concat(F.lit("<p>"), F.col("p_type"), F.lit(" "), F.col("p_brand"),
                           F.lit("</p> "), F.col("o_orderpriority"))
    url = F.when(k % 13 == 0, F.lit("")).otherwise(
        F.concat(F.lit(JOB_URL_PREFIX), F.floor(k / 3).cast("string")))
    posted = (F.date_sub(F.lit("2001-09-01").cast("date"), (k % 60).cast("int"))
              .cast("timestamp_ntz") + F.expr("INTERVAL 6 HOURS"))
    out = j.select(
        k.alias("seq"),
        title.alias("title"),
        F.col("s_name").alias("company"),
        location.alias("location"),
        description.alias("description"),
        url.alias("url"),
        _pick(k % 8, POSTED_TEXTS).alias("posted_text"),
        _pick(k % 6, SALARY_TEXTS).alias("salary_text"),
        posted.alias("posted_date"),
        (posted + F.expr("INTERVAL 1 HOURS")).alias("scraped_at"),
        F.lit("indeed").alias("board_source"),
    )
    return out.withColumn("id", job_id("company", "title", "location"))


def team_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read_table(spark, sf_dir, "customer")
    n_supp = read_table(spark, sf_dir, "supplier").select(F.count(F.lit(1))).scalar()
    c = F.col("c_custkey")
    country = _pick(F.col("c_nationkey") % 6, MEMBER_COUNTRIES)
    city = (F.when(country == "Taiwan", _pick(c % 3, TAIWAN_CITIES))
            .when(country == "China", _pick(c % 3, CHINA_CITIES))
            .when(country == "Singapore", F.lit("Singapore"))
            .when(country == "Hong Kong", F.lit("Hong Kong")))
    return customer.select(
        c.alias("id"),
        ((c % 7) * (c % 11) % n_supp).cast("string").alias("company_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("title"),
        F.nullif(F.concat_ws(", ", city, country), F.lit("")).alias("location"),
        city.alias("city"),
        country.alias("country"),
        F.concat(F.lit("https://www.linkedin.com/in/member-"), c.cast("string")).alias("linkedin_url"),
    )


def companies(spark: SparkSession, sf_dir: str, members: DataFrame | None = None,
              targets=TARGET_COUNTRIES) -> DataFrame:
    """Company rows; ``region_team_count`` = members in the target countries (A1)."""
    supplier = read_table(spark, sf_dir, "supplier")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    members = members if members is not None else team_members(spark, sf_dir)
    counts = (members.where(F.col("country").isin(list(targets)))
              .groupBy("company_id").agg(F.count(F.lit(1)).alias("region_team_count")))
    s = F.col("s_suppkey")
    base = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    out = base.select(
        s.cast("string").alias("id"),
        F.col("s_name").alias("name"),
        F.col("s_name").alias("requested_name"),
        F.lit(None).cast("string").alias("linkedin_url"),
        F.concat(F.lit("supplier"), s.cast("string"), F.lit(".com")).alias("website"),
        _pick(s % 5, INDUSTRIES).alias("industry"),
        _pick(s % 6, COMPANY_SIZES).alias("company_size"),
        F.col("n_name").alias("headquarters_location"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("int").alias("total_employees"),
        F.when(s % 10 == 9, F.lit("2001-06-01")).otherwise(F.lit("2001-08-20"))
        .cast("timestamp_ntz").alias("enriched_at"),
        F.lit("fixture").alias("source"),
    )
    return (out.join(counts, out.id == counts.company_id, "left").drop("company_id")
            .withColumn("region_team_count",
                        F.coalesce("region_team_count", F.lit(0)).cast("int")))
