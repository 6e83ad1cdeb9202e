"""Scoring, threshold and ranking."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from jobloom.constants import DEFAULT_PREFERRED_CITIES
from jobloom.functions.dates import age_days


@dataclass(frozen=True)
class RankingConfig:
    """Weights, target lists and the region-team threshold."""
    team_weight: float = 10.0
    city_weight: float = 5.0
    industry_weight: float = 3.0
    size_weight: float = 3.0
    recency_weight: float = 5.0
    target_industries: tuple = ()
    target_company_sizes: tuple = ()
    preferred_cities: tuple = field(default_factory=lambda: tuple(DEFAULT_PREFERRED_CITIES))
    min_team: int = 1

    @staticmethod
    def from_env(environ=None) -> "RankingConfig":
        """CLI form: comma-separated lists, split without trimming."""
        env = os.environ if environ is None else environ

        def lst(name):
            v = env.get(name, "")
            return tuple(v.split(",")) if v else ()
        kw = {}
        if lst("TARGET_INDUSTRIES"):
            kw["target_industries"] = lst("TARGET_INDUSTRIES")
        if lst("TARGET_COMPANY_SIZES"):
            kw["target_company_sizes"] = lst("TARGET_COMPANY_SIZES")
        if lst("PREFERRED_CITIES"):
            kw["preferred_cities"] = lst("PREFERRED_CITIES")
        if env.get("MIN_TEAM_SIZE"):
            kw["min_team"] = int(env["MIN_TEAM_SIZE"])
        return RankingConfig(**kw)


def score_expr(cfg: RankingConfig, as_of, count="region_team_count",
               city_hits="preferred_city_count", member_total="member_count",
               industry="industry", size="company_size", posted="posted_date") -> Column:
    """R1-R6 as one column expression.

    ``city_hits`` is the number of the job's team members whose city is in
    the preferred list (A2) and ``member_total`` the number of members; both
    come from a per-company aggregate, so no member list is carried.
    """
    n = F.coalesce(F.col(count), F.lit(0))
    team = F.least(n * F.lit(cfg.team_weight), F.lit(50.0))
    if cfg.preferred_cities:
        hits = F.coalesce(F.col(city_hits), F.lit(0))
        city = F.when(F.coalesce(F.col(member_total), F.lit(0)) > 0,
                      F.least(hits * F.lit(cfg.city_weight), F.lit(20.0))).otherwise(F.lit(0.0))
    else:
        city = F.lit(0.0)
    if cfg.target_industries:
        ind = F.lower(F.col(industry))
        any_hit = None
        for t in cfg.target_industries:
            c = ind.contains(t.lower())
            any_hit = c if any_hit is None else (any_hit | c)
        industry_pts = F.when(F.coalesce(F.col(industry), F.lit("")) == "", F.lit(0.0)) \
            .when(any_hit, F.lit(cfg.industry_weight * 5)).otherwise(F.lit(0.0))
    else:
        industry_pts = F.lit(0.0)
    if cfg.target_company_sizes:
        size_pts = F.when(F.col(size).isin(list(cfg.target_company_sizes)),
                          F.lit(cfg.size_weight * 3)).otherwise(F.lit(0.0))
    else:
        size_pts = F.lit(0.0)
    days = age_days(F.col(posted), as_of)
    fresh = F.when(F.col(posted).isNull(), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.lit(cfg.recency_weight) - days / F.lit(7.0)))
    total = team.cast("double") + city + industry_pts + size_pts + fresh
    return F.round(total, 2)


def rank_jobs(enriched: DataFrame, cfg: RankingConfig, as_of) -> DataFrame:
    """Drop jobs under the team threshold, then score.

    Ordering is left to the consumer (O1 / top-k): a global sort of the
    whole table is only paid where an ordered result is actually served.
    """
    kept = enriched.where(F.coalesce(F.col("region_team_count"), F.lit(0)) >= cfg.min_team)
    return kept.withColumn("ranking_score", score_expr(cfg, as_of))


def rank_order(score="ranking_score", posted="posted_date", tiebreak=("id", "seq")) -> list:
    """O1: score desc, posted desc, nulls last; our own id tiebreak for determinism."""
    cols = [F.col(score).desc_nulls_last(), F.col(posted).desc_nulls_last()]
    cols += [F.col(c).asc() for c in tiebreak]
    return cols
