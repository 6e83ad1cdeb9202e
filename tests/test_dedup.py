"""Greedy de-dup (D1-D5): single cases, and the definition as a property of random results."""

import datetime as dt
import random

import pytest

from jobloom.functions.text import fuzzy_key, job_id
from jobloom.operators.dedup import DedupStats, exact_id_dedup, greedy_dedup

NOW = dt.datetime(2001, 9, 1, 12, 0)
SCHEMA = "seq long, id string, title string, company string, location string, url string, scraped_at timestamp_ntz"


def frame(spark, jobs):
    rows = []
    for i, j in enumerate(jobs):
        rows.append((i, j.get("id"), j.get("title", "Software Engineer"), j.get("company", "Test Corp"),
                     j.get("location", "Remote"), j.get("url", "https://indeed.com/viewjob?jk=abc123"),
                     j.get("scraped_at", NOW)))
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("id", job_id("company", "title", "location", df["id"]))


def kept(spark, jobs):
    return sorted(r["seq"] for r in greedy_dedup(frame(spark, jobs)).select("seq").collect())


def test_distinct_keys_all_kept(spark):
    jobs = [dict(title=f"T{i}", company=f"C{i}", url=f"https://indeed.com/viewjob?jk=k{i}") for i in range(3)]
    assert kept(spark, jobs) == [0, 1, 2]


def test_same_url_merged(spark):
    jobs = [dict(title="A", company="X"), dict(title="B", company="Y")]
    assert len(kept(spark, jobs)) == 1


def test_empty_url_never_matches(spark):
    jobs = [dict(title=f"T{i}", company="C", url="") for i in range(3)]
    assert kept(spark, jobs) == [0, 1, 2]


def test_senior_equals_sr_and_remote_ignored(spark):
    jobs = [dict(title="Senior Data Engineer", url="u1"), dict(title="Sr. Data Engineer", url="u2"),
            dict(title="Data Engineer - Remote", url="u3"), dict(title="Data Engineer", url="u4")]
    assert len(kept(spark, jobs)) == 2


def test_same_title_two_companies(spark):
    jobs = [dict(company="A", url="u1"), dict(company="B", url="u2")]
    assert kept(spark, jobs) == [0, 1]


def test_newest_wins(spark):
    jobs = [dict(url="u1", scraped_at=NOW - dt.timedelta(days=5)), dict(url="u2", scraped_at=NOW)]
    assert kept(spark, jobs) == [1]


def test_empty_input(spark):
    df = frame(spark, [dict()]).limit(0)
    assert greedy_dedup(df).count() == 0


def test_chain_is_greedy_not_transitive(spark):
    # B duplicates A by URL; C duplicates B by fuzzy key only: greedy keeps A and C.
    jobs = [dict(title="Alpha", company="X", url="u1", scraped_at=NOW),
            dict(title="Beta", company="Y", url="u1", scraped_at=NOW - dt.timedelta(hours=1)),
            dict(title="Beta", company="Y", url="u2", location="Elsewhere",
                 scraped_at=NOW - dt.timedelta(hours=2))]
    assert kept(spark, jobs) == [0, 2]


def share_a_key(a, b):
    return a["id"] == b["id"] or a["fuzzy"] == b["fuzzy"] or bool(a["url"]) and a["url"] == b["url"]


def assert_greedy(spark, jobs, kept_seqs):
    """The definition, as a property of the result: a row is kept if and only if no row that
    comes before it (newer, or as new and earlier in the input) is kept and shares a key."""
    rows = frame(spark, jobs).select(
        "seq", "id", "url", "scraped_at", fuzzy_key("company", "title").alias("fuzzy")).collect()
    before = lambda a, b: (-a["scraped_at"].timestamp(), a["seq"]) < (-b["scraped_at"].timestamp(), b["seq"])
    winners = [r for r in rows if r["seq"] in set(kept_seqs)]
    for r in rows:
        beaten = any(before(k, r) and share_a_key(k, r) for k in winners)
        assert (r["seq"] in kept_seqs) != beaten


@pytest.mark.parametrize("seed", range(6))
def test_result_is_the_greedy_set(spark, seed):
    rnd = random.Random(seed)
    jobs = []
    for _ in range(150):
        jobs.append(dict(
            title=rnd.choice(["Senior Dev", "Sr. Dev", "Dev - Remote", "Dev", "QA", "Junior QA", "Jr QA"]),
            company=rnd.choice(["Acme", "ACME", "Beta Ltd", "Gamma"]),
            location=rnd.choice(["Remote", "Taipei", "Tokyo"]),
            url=rnd.choice(["", "", "u1", "u2", "u3", "u4", "u5", "u6"]),
            scraped_at=NOW - dt.timedelta(hours=rnd.randint(0, 5))))
    stats = DedupStats()
    got = sorted(r["seq"] for r in greedy_dedup(frame(spark, jobs), stats=stats).select("seq").collect())
    assert_greedy(spark, jobs, got)
    assert stats.rounds >= 1


def test_exact_id_keeps_newest(spark):
    jobs = [dict(url="", scraped_at=NOW - dt.timedelta(days=1)), dict(url="", scraped_at=NOW)]
    out = exact_id_dedup(frame(spark, jobs)).collect()
    assert [r["seq"] for r in out] == [1]


def test_a_long_chain_takes_few_rounds(spark):
    """5,000 jobs that alternate as duplicates of the one before: every second one is kept."""
    n = 5000
    jobs = [dict(title=f"T{(i + 1) // 2}", company="X", location=f"L{i}", url=f"u{i // 2}",
                 scraped_at=NOW - dt.timedelta(minutes=i)) for i in range(n)]
    stats = DedupStats()
    got = sorted(r["seq"] for r in greedy_dedup(frame(spark, jobs), stats=stats).select("seq").collect())
    assert got == list(range(0, n, 2)) and stats.rounds <= 15


@pytest.mark.parametrize("seed", range(3))
def test_doubling_alone_gives_the_greedy_set(spark, monkeypatch, seed):
    from jobloom.operators import dedup
    monkeypatch.setattr(dedup, "PLAIN", 0)
    rnd = random.Random(100 + seed)
    jobs = [dict(title=f"T{rnd.randrange(45)}", company="X", location=f"L{rnd.randrange(9)}",
                 url=rnd.choice(["", *[f"u{k}" for k in range(45)]]),
                 scraped_at=NOW - dt.timedelta(hours=rnd.randint(0, 30))) for _ in range(120)]
    got = sorted(r["seq"] for r in greedy_dedup(frame(spark, jobs)).select("seq").collect())
    assert_greedy(spark, jobs, got)
