"""CSV exports (K6, K7) and run counters (K8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from jobloom.functions.dates import iso_format
from jobloom.functions.text import truncate_description


def jobs_csv_frame(jobs: DataFrame) -> DataFrame:
    """K6: the 8 exported columns."""
    return jobs.select(
        "title", "company", "location", "url",
        iso_format("posted_date").alias("posted_date"),
        truncate_description("description").alias("description"),
        F.col("board_source").alias("board"),
        iso_format("scraped_at").alias("scraped_at"))


def enriched_csv_frame(jobs: DataFrame) -> DataFrame:
    """K7: the 11 exported columns of ranked jobs."""
    return jobs.select(
        "title", "company", "location", "url",
        F.col("region_team_count").alias("taiwan_team_count"),
        "ranking_score",
        F.coalesce("industry", F.lit("")).alias("industry"),
        F.coalesce("company_size", F.lit("")).alias("company_size"),
        iso_format("posted_date").alias("posted_date"),
        truncate_description("description").alias("description"),
        F.col("board_source").alias("board"))


def write_csv(df: DataFrame, path: str) -> None:
    """Header row, one file per partition; readers treat the folder as one table.

    Quotes are doubled inside quoted fields, and blanks at the ends of a field stay."""
    (df.write.mode("overwrite").option("header", True).option("emptyValue", "")
     .option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
