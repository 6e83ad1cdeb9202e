"""Typed scans of the driver tables and of our stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.  Parquet carries its schema in the footer; every call lists the files
    anew, so files that arrive during a session are read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _schema(**types) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in types.items()])


_S, _L, _I, _D, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampNTZType()

# Declared schemas of the three stored tables (jobs, companies, team members).
STORED = {
    "jobs": _schema(
        seq=_L, id=_S, title=_S, company=_S, location=_S, description=_S, url=_S, posted_date=_TS,
        scraped_at=_TS, board_source=_S, company_id=_S, region_team_count=_I, ranking_score=_D,
        enriched_at=_TS, company_size=_S, industry=_S, headquarters_location=_S),
    "companies": _schema(
        id=_S, name=_S, requested_name=_S, linkedin_url=_S, website=_S, industry=_S,
        company_size=_S, headquarters_location=_S, description=_S, total_employees=_I,
        enriched_at=_TS, source=_S, region_team_count=_I),
    "members": _schema(
        id=_L, company_id=_S, name=_S, title=_S, location=_S, city=_S, country=_S,
        linkedin_url=_S),
}


def write_stored(df: DataFrame, folder: str, name: str, table: str | None = None) -> None:
    """Writes ``folder/name`` with the declared columns and types of ``table`` (by default
    ``name``)."""
    df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in STORED[table or name].fields]) \
        .write.mode("error").parquet(f"{folder}/{name}")


def read_stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table by its declared schema: no footer is read to plan, and filters on its
    columns reach the scan."""
    return spark.read.schema(STORED[name]).parquet(f"{folder}/{name}")
