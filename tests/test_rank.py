"""Ranking (R1-R8): relative properties, as the reference's own tests check them."""

import datetime as dt

from jobloom.operators.rank import RankingConfig, rank_jobs, score_expr

AS_OF = dt.datetime(2001, 9, 1, 12, 0)
SCHEMA = ("id string, region_team_count int, member_count int, preferred_city_count int, "
          "industry string, company_size string, posted_date timestamp_ntz")


def scores(spark, rows, cfg=RankingConfig()):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r["id"]: r["s"] for r in df.select("id", score_expr(cfg, AS_OF).alias("s")).collect()}


def test_team_monotone_and_capped(spark):
    s = scores(spark, [(str(n), n, 0, 0, None, None, AS_OF) for n in (1, 3, 5, 10)])
    assert s["1"] < s["3"] < s["5"] == s["10"] == 55.0


def test_city_bonus_capped(spark):
    s = scores(spark, [("a", 1, 1, 1, None, None, None), ("b", 1, 10, 10, None, None, None),
                       ("c", 1, 3, 0, None, None, None)])
    assert s["a"] == 15.0 and s["b"] == 30.0 and s["c"] == 10.0


def test_industry_substring_and_size(spark):
    cfg = RankingConfig(target_industries=("software",), target_company_sizes=("51-200",))
    s = scores(spark, [("a", 1, 0, 0, "Computer Software", "51-200", None),
                       ("b", 1, 0, 0, "Mining", "5000+", None)], cfg)
    assert s["a"] - s["b"] == 15.0 + 9.0


def test_recency(spark):
    s = scores(spark, [("new", 1, 0, 0, None, None, AS_OF), ("old", 1, 0, 0, None, None, AS_OF - dt.timedelta(days=14)),
                       ("ancient", 1, 0, 0, None, None, AS_OF - dt.timedelta(days=70)),
                       ("future", 1, 0, 0, None, None, AS_OF + dt.timedelta(days=7))])
    assert s["future"] > s["new"] > s["old"] > s["ancient"] == 10.0


def test_threshold_drops_unenriched(spark):
    df = spark.createDataFrame([("a", 0, 0, 0, None, None, None), ("b", None, 0, 0, None, None, None),
                                ("c", 2, 0, 0, None, None, None)], SCHEMA)
    assert [r["id"] for r in rank_jobs(df, RankingConfig(), AS_OF).collect()] == ["c"]
    assert rank_jobs(df.limit(0), RankingConfig(), AS_OF).count() == 0


def test_config_from_env():
    cfg = RankingConfig.from_env({"TARGET_INDUSTRIES": "SaaS, Fintech", "MIN_TEAM_SIZE": "3"})
    assert cfg.target_industries == ("SaaS", " Fintech") and cfg.min_team == 3
