"""Registered queries against their DuckDB oracles on the smallest driver tables."""

import pytest

from tests.conftest import SF_SMALL

import __spark_entry__ as E
from jobloom.plans.registry import QUERIES
from tools.compare import digest, duck, row_from_spark

FAST = ["ranked_top50", "ranked_all", "job_ids", "fuzzy_keys", "salary_parse", "relative_dates",
        "url_domains", "member_cities", "store_insert", "company_upsert", "member_replace",
        "keyword_search", "company_360", "country_rollup", "member_preview", "embedded_jobs",
        "dom_jobs", "extracted_jobs", "vendor_a_people", "employer_match", "dedup_jobs", "page_links",
        "job_by_id_clustered", "jobs_of_company_clustered", "recent_jobs_of_company", "members_of_company_clustered"]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


NO_ORACLE: set = set()


def test_every_query_has_an_oracle():
    assert {k for k in E.oracle_sql() if k in QUERIES} == set(QUERIES) - NO_ORACLE


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "ranking_score" in df.columns


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(row_from_spark(x) for x in r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    drows = res.fetchall()
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert digest(df.columns, rows)[0] == digest(dcols, drows)[0]
