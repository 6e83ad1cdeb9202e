"""Shared building blocks of the registered queries (fixed as_of, derived tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobloom.operators.enrich import enrich_jobs
from jobloom.operators.rank import RankingConfig, rank_jobs
from jobloom.sources import fixtures

AS_OF = fixtures.AS_OF
DEFAULT_CFG = RankingConfig()


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Landed jobs."""
    return fixtures.landed_jobs(spark, sf)


def members(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.team_members(spark, sf)


def companies(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.companies(spark, sf, members(spark, sf))


def enriched(spark: SparkSession, sf: str, salted: bool = False) -> DataFrame:
    return enrich_jobs(jobs(spark, sf), companies(spark, sf), members(spark, sf), AS_OF, salted=salted)


def ranked(spark: SparkSession, sf: str, cfg: RankingConfig = DEFAULT_CFG) -> DataFrame:
    return rank_jobs(enriched(spark, sf), cfg, AS_OF)
