"""Table maintenance, serving filters, exports and page rules on small literal tables."""

import csv
import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from jobloom.operators import export, serve, store
from jobloom.operators.dedup import DedupStats, greedy_dedup
from jobloom.operators.enrich import enrich_jobs
from jobloom.operators.rank import RankingConfig
from jobloom.session import shared_dir
from jobloom.sources import boards, embedded, extracted, pages
from tests.conftest import rows

AS_OF = dt.datetime(2001, 9, 1, 12)


def test_upsert_last_update_wins(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "id string, v int, run int")
    got = store.upsert(old, new, "id", "run")
    assert sorted((r["id"], r["v"]) for r in rows(got)) == [("a", 1), ("b", 4), ("c", 5)]


def test_replace_children_keeps_old_for_empty_lists_and_nulls(spark):
    old = spark.createDataFrame([(1, "x", "Japan"), (2, "y", "China")], "id int, company_id string, country string")
    new = spark.createDataFrame([(3, "x", None)], "id int, company_id string, country string")
    parents = spark.createDataFrame([("x", 1), ("x", 1), ("y", 0)], "company_id string, n_members int")
    got = {r["id"]: r["country"] for r in rows(store.replace_children(old, new, parents))}
    assert got == {3: None, 2: "China"}
    without = store.replace_children(old, new.drop("country"), parents)
    assert {r["id"]: r["country"] for r in rows(without)} == {3: "Taiwan", 2: "China"}


def test_insert_new_and_expire(spark):
    s = "id string, seq long, scraped_at timestamp_ntz"
    old = spark.createDataFrame([("a", 1, AS_OF)], s)
    batch = spark.createDataFrame([("a", 5, AS_OF), ("b", 7, AS_OF), ("b", 6, None)], s)
    assert [(r["id"], r["seq"]) for r in rows(store.insert_new(old, batch))] == [("b", 6)]
    aged = spark.createDataFrame([("a", 1, AS_OF - dt.timedelta(days=31)), ("b", 2, None),
                                  ("c", 3, AS_OF - dt.timedelta(days=30))], s)
    assert sorted(r["id"] for r in rows(store.expire(aged, AS_OF))) == ["b", "c"]


def _tables(spark):
    jobs = spark.createDataFrame(
        [("j1", "Asked", AS_OF, "old", 9), ("j2", "Other", AS_OF, None, None), ("j3", "Unknown", AS_OF, None, None)],
        "id string, company string, posted_date timestamp_ntz, company_id string, region_team_count int")
    for c, t in (("ranking_score", "double"), ("enriched_at", "timestamp_ntz"), ("company_size", "string"),
                 ("industry", "string"), ("headquarters_location", "string")):
        jobs = jobs.withColumn(c, F.lit(None).cast(t))
    s = ("id string, name string, requested_name string, enriched_at timestamp_ntz, company_size string, "
         "industry string, headquarters_location string, region_team_count int")
    companies = spark.createDataFrame(
        [("c1", "Vendor Name", "Asked", AS_OF - dt.timedelta(days=2), "1-10", "x", "hq", 2),
         ("c2", "Vendor Name", "Asked", AS_OF - dt.timedelta(days=1), "11-50", "y", "hq", 3),
         ("c3", "Unknown", "Unknown", AS_OF, "1-10", "z", "hq", 3)], s)
    members = spark.createDataFrame([("c2", "Taipei", "Taiwan")], "company_id string, city string, country string")
    return jobs, companies, members


def test_enrichment_matches_the_requested_name_once(spark):
    jobs, companies, members = _tables(spark)
    got = {r["id"]: r["company_id"] for r in rows(enrich_jobs(jobs, companies, members, AS_OF))}
    assert got == {"j1": "c2", "j2": None, "j3": None}


def test_enrichment_update_leaves_other_rows(spark):
    jobs, companies, members = _tables(spark)
    got = {r["id"]: r for r in rows(store.update_enrichment(jobs, companies, members, RankingConfig(), AS_OF))}
    assert got["j1"]["company_id"] == "c2" and got["j1"]["region_team_count"] == 3
    assert got["j1"]["ranking_score"] == 40.0 and got["j1"]["enriched_at"] == AS_OF
    assert got["j2"]["company_id"] is None and got["j2"]["region_team_count"] is None
    high = store.update_enrichment(jobs, companies, members, RankingConfig(min_team=4), AS_OF)
    assert {r["id"]: r["company_id"] for r in rows(high)}["j1"] == "old"


@pytest.mark.parametrize("term,found", [("100%", ["a"]), ("_x", ["b"]), ("\\", ["c"]), ("ÉT", []),
                                        ("été", ["d"]), ("PLAIN", ["e"])])
def test_search_terms_are_literal(spark, term, found):
    df = spark.createDataFrame([("a", "100% sure"), ("b", "a_x"), ("c", "back\\slash"), ("d", "été"),
                                ("e", "plain")], "id string, title string")
    df = df.withColumns({"company": F.lit(None).cast("string"), "description": F.lit("")})
    assert sorted(r["id"] for r in rows(serve.search(df, term))) == found


def test_null_counts_in_both_filters(spark):
    df = spark.createDataFrame([("a", None), ("b", 0), ("c", 2)], "id string, region_team_count int")
    ids = lambda d: sorted(r["id"] for r in rows(d))
    assert ids(serve.jobs_filter(df, 0)) == ["a", "b", "c"]
    assert ids(serve.jobs_filter(df, 0, ui_semantics=True)) == ["b", "c"]
    assert ids(serve.search(df, "")) == ["b", "c"]


def test_places_in_a_global_order(spark):
    df = spark.range(0, 500, numPartitions=7).select(((F.col("id") * 37) % 500).alias("v"))
    got = {r["v"]: r["pos"] for r in rows(serve.in_order(df, [F.col("v").desc()]))}
    assert got == {v: 500 - v for v in range(500)}


def test_csv_round_trip(spark):
    data = [('He said "hi", twice', " padded "), ("line\nbreak", ""), ("plain", "x")]
    path = shared_dir(spark, "jobloom/test-csv")
    export.write_csv(spark.createDataFrame(data, "a string, b string").coalesce(1), path)
    name = glob.glob(path.removeprefix("file:") + "/part-*.csv")[0]
    with open(name, newline="", encoding="utf-8") as f:
        got = list(csv.reader(f))
    assert got == [["a", "b"], *map(list, data)]


def test_dedup_counters_and_hot_key(spark):
    df = spark.range(3000).select(
        F.col("id").alias("seq"), F.col("id").cast("string").alias("id"),
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"), F.lit("c").alias("company"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id").cast("string"))).alias("url"),
        F.lit(AS_OF).cast("timestamp_ntz").alias("scraped_at"))
    stats = DedupStats()
    kept = greedy_dedup(df, stats=stats).count()
    assert (stats.input_rows, stats.kept_rows, stats.duplicates) == (3000, kept, 999) and kept == 2001


def test_dedup_long_chain(spark):
    """Each row shares a URL with the one before and a title with the one after: every second stays."""
    n = 24
    df = spark.createDataFrame(
        [(i, f"i{i}", f"t{(i + 1) // 2}", "c", f"u{i // 2}", AS_OF) for i in range(n)],
        "seq long, id string, title string, company string, url string, scraped_at timestamp_ntz")
    stats = DedupStats()
    assert sorted(r["seq"] for r in rows(greedy_dedup(df, stats=stats).select("seq"))) == list(range(0, n, 2))
    assert 2 <= stats.rounds <= n


def test_one_bad_element_spoils_no_other(spark):
    payload = ('[{"title": "A", "salary_min": "60000"}, "x", 7, null, {"title": "B", "salary_min": "n/a"}, '
               '{"title": "C", "salary_min": 5, "salary_max": ""}, {"title": "D", "is_remote": false}]')
    df = spark.createDataFrame([(1, True, payload), (2, False, '{"jobs": [{"title": "E"}]}'),
                                (3, True, '{"jobs": [{"title": "F"}, 1]}'), (4, True, "[{oops"), (5, True, None)],
                               "page_id long, use_llm boolean, payload string")
    got = {(r["page_id"], r["pos"]): r for r in rows(extracted.items_to_jobs(extracted.parse_payload(df), AS_OF))}
    assert sorted((k, r["title"]) for k, r in got.items()) == [
        ((1, 0), "A"), ((1, 5), "C"), ((1, 6), "D"), ((3, 0), "F")]
    assert got[1, 0]["salary_min"] == got[1, 0]["salary_max"] == 60000.0
    assert got[1, 5]["salary_max"] == 5.0


def test_embedded_nulls_and_rejects(spark):
    items = ('{"title": null, "displayTitle": "no", "jobkey": "k1", "formattedRelativeTime": "Today"}',
             '{"title": "t", "formattedLocation": null}', '{"formattedLocation": null, "remoteLocation": true}',
             '"x"', '{"formattedRelativeTime": null}', '{"snippet": "", "jobSnippetHtmlItems": null}',
             '{"extractedSalary": {"min": "5", "max": "a"}}')
    body = ('<script>window.mosaic.providerData["mosaic-provider-jobcards"] = {"metaData":'
            '{"mosaicProviderJobCardsModel":{"results":[' + ",".join(items) + ']}}};</script>')
    df = spark.createDataFrame([(1, body)], "page_id long, html string")
    got = {r["pos"]: r for r in rows(embedded.embedded_jobs(df, AS_OF))}
    assert sorted(got) == [0, 2, 6]
    assert got[0]["title"] is None and got[0]["location"] == "Remote" and got[2]["location"] is None
    assert (got[6]["salary_min"], got[6]["salary_max"], got[6]["company"]) == (5.0, None, "Unknown")
    assert {r["pos"]: r["reason"] for r in rows(embedded.embedded_rejects(df))} == {
        1: "null location", 3: "no object", 4: "null time", 5: "null snippet items"}


def test_fallback_rows_are_dated_by_the_argument(spark):
    card = ('<div class="job_seen_beacon"><h2 class="jobTitle"><a data-jk="k"><span>T</span></a></h2>'
            '<span class="date">Today</span></div>')
    df = spark.createDataFrame([(1, card)], "page_id long, html string")
    when = dt.datetime(2020, 2, 2)
    got = rows(boards.get_extractor("indeed")(df, when))
    assert [(r["title"], r["posted_date"], r["board_source"]) for r in got] == [("T", when, "indeed")]


def test_results_stop_at_the_first_empty_page_and_at_the_limit(spark):
    found = [("s", p, i) for p in (0, 1, 3) for i in range(4)] + [("r", 1, 0)]
    df = spark.createDataFrame(found, "search_id string, page_no int, pos int")
    got = sorted((r["rank"], r["page_no"], r["pos"]) for r in rows(pages.search_results(df, 6)))
    assert got == [(1, 0, 0), (2, 0, 1), (3, 0, 2), (4, 0, 3), (5, 1, 0), (6, 1, 1)]


def test_hybrid_takes_one_source_a_page(spark):
    card = ('<div class="job_seen_beacon" data-company-url="https://direct.example"><h2 class="jobTitle">'
            '<a data-jk="k" href="/viewjob?jk=k">Card</a></h2></div>')
    pay = '[{"title": "Item"}, 3]'
    df = spark.createDataFrame([(1, card, pay), (2, "<p></p>", pay), (3, card, None), (4, None, None)],
                               "page_id long, html string, payload string")
    got = rows(boards.get_extractor("hybrid")(df, AS_OF))
    assert sorted((r["page_id"], r["title"]) for r in got) == [(1, "Card"), (2, "Item"), (3, "Card")]
    with pytest.raises(ValueError):
        boards.get_extractor("nobody")


def test_plans_parse_pages_once(spark):
    df = spark.createDataFrame([(1, "<p></p>", "[]")], "page_id long, html string, payload string")
    for name in ("hybrid", "embedded"):
        plan = boards.get_extractor(name)(df, AS_OF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Exchange" not in plan


def test_vendor_registry():
    from jobloom.sources import vendor
    assert vendor.get_vendor("a")[0] is vendor.vendor_a_companies
    with pytest.raises(ValueError):
        vendor.get_vendor("c")


@pytest.mark.parametrize("ruleset,site", [("full", "site.example"), ("labelled", "https://site.example/x"),
                                          ("plain", "https://other.example")])
def test_website_rule_sets(spark, ruleset, site):
    from jobloom.operators.website import company_website
    from jobloom.sources import html
    page = ('<body><a href="https://other.example">Other</a><p>Website <a href="https://site.example/x">go</a></p>'
            '<ul><li data-testid="companyInfo-companyWebsite"><a href="https://www.site.example/">Visit</a></li></ul>'
            '</body>')
    page = page if ruleset != "labelled" else page.replace('<a href="https://other.example">Other</a>', "")
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    got = company_website(df, html.extract_links(df), ruleset).collect()
    assert [r["website"] for r in got] == [site]
