"""Extraction (S2-S8, S14, X24): parsers on hand-made payloads."""

import datetime as dt
import io
import random
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from jobloom.sources import embedded, extracted, html, pages

AS_OF = dt.datetime(2001, 9, 1, 12, 0)

CARD = ('<div class="job_seen_beacon x"><h2 class="jobTitle"><a data-jk="abc123" href="/rc/clk?jk=abc123">'
        '<span>Data Engineer</span></a></h2><span data-testid="company-name">Acme</span>'
        '<div data-testid="text-location">Remote</div><div class="job-snippet"><ul><li> Build things '
        '</li></ul></div><span class="date">5 days ago</span>'
        '<div class="salary-snippet-container">$80K - $100K</div><a href="/cmp/Acme">c</a></div>')


def test_dom_cards(spark):
    pg = spark.createDataFrame([(1, "<html><body>" + CARD + CARD.replace('data-jk="abc123" ', "")
                                 .replace('<span data-testid="company-name">Acme</span>', "") + "</body></html>")],
                               "page_id long, html string")
    r = html.extract_cards(pg, "dom").orderBy("pos").collect()
    assert [(x.title, x.job_key, x.company, x.location, x.description, x.posted_text) for x in r] == [
        ("Data Engineer", "abc123", "Acme", "Remote", "Build things", "5 days ago"),
        ("Data Engineer", None, "Unknown", "Remote", "Build things", "5 days ago")]


def test_selector_cards(spark):
    pg = spark.createDataFrame([(1, "<div class='jobsearch-ResultsList'>" + CARD + "</div>")],
                               "page_id long, html string")
    r = html.extract_cards(pg, "selector", pages.CARD_SELECTOR_SPEC).collect()
    assert len(r) == 1
    x = r[0]
    assert (x.title, x.salary, x.job_url, x.company_url) == ("Data Engineer", "$80K - $100K",
                                                              "/rc/clk?jk=abc123", "/cmp/Acme")


def test_payload_shapes(spark):
    item = '{"title": " Dev ", "company": "", "location": "", "job_key": "abc123", "salary": "$100,000 - $120,000"}'
    df = spark.createDataFrame([(1, True, "[" + item + "]"), (2, True, '{"jobs": [' + item + "]}"),
                                (3, False, '{"jobs": [' + item + "]}"), (4, True, ""), (5, True, None),
                                (6, True, "[{bad json"), (7, True, '[{"title": ""}]')],
                               "page_id long, use_llm boolean, payload string")
    out = extracted.items_to_jobs(extracted.parse_payload(df), AS_OF).orderBy("page_id").collect()
    assert [r.page_id for r in out] == [1, 2]
    r = out[0]
    assert (r.title, r.company, r.location, r.url, r.salary_min, r.salary_max, r.remote_type) == (
        "Dev", "Unknown", "Remote", "https://www.indeed.com/viewjob?jk=abc123", 100000.0, 120000.0, "Remote")


def test_embedded_json(spark):
    body = ('{"metaData": {"mosaicProviderJobCardsModel": {"results": [{"jobkey": "k1", "displayTitle": "T",'
            ' "snippet": "", "jobSnippetHtmlItems": ["a", "b"], "formattedRelativeTime": "Today"}],'
            ' "tierSummaries": [{"jobCount": 3}, {}]}}}')
    htm = '<script>window.mosaic.providerData["mosaic-provider-jobcards"] =\n' + body + ';</script>'
    df = spark.createDataFrame([(1, htm), (2, "<html>none</html>"), (3, htm.replace('{"metaData"', '{metaData'))],
                               "page_id long, html string")
    tot = {r.page_id: r.total_count for r in embedded.embedded_payload(df).collect()}
    assert tot == {1: 3, 2: 0, 3: 0}
    r = embedded.embedded_jobs(df, AS_OF).collect()
    assert [(x.id, x.title, x.company, x.location, x.description, x.url) for x in r] == [
        ("k1", "T", "Unknown", "Remote", "a b", "https://www.indeed.com/viewjob?jk=k1")]


def test_blocked_flags(spark):
    df = spark.createDataFrame([(1, "<h1>Access Denied</h1>"), (2, "<p>Just a moment...</p>"),
                                (3, "<div class='g-recaptcha'></div>"), (4, "<p>fine</p>" * 2000)],
                               "page_id long, html string")
    r = {x.page_id: x.blocked for x in pages.blocked_flags(df).collect()}
    assert r == {1: True, 2: True, 3: True, 4: False}


def test_links(spark):
    df = spark.createDataFrame([(1, '<a href="/a">A <b>x</b></a><script>var s="<a href=/no>";</script>'
                                    '<a href="https://e.com?a=1&amp;b=2">E</a>')], "page_id long, html string")
    r = [(x.pos, x.href, x.text) for x in html.extract_links(df).collect()]
    assert r == [(0, "/a", "Ax"), (1, "https://e.com?a=1&b=2", "E")]


def test_extractor_factory():
    import pytest as _pt
    from jobloom.sources.boards import get_extractor
    assert callable(get_extractor("indeed")) and callable(get_extractor("hybrid"))
    with _pt.raises(ValueError):
        get_extractor("monster")


def test_hybrid_mode_falls_back_per_page(spark):
    from jobloom.sources.boards import get_extractor
    item = '[{"title": "LLM Dev", "company": "Z", "location": "Taipei"}]'
    df = spark.createDataFrame([(1, "<div class='jobsearch-ResultsList'>" + CARD + "</div>", item),
                                (2, "<p>no cards</p>", item)],
                               "page_id long, html string, payload string")
    out = {(r.page_id, r.title) for r in get_extractor("hybrid")(df, AS_OF).collect()}
    assert out == {(1, "Data Engineer"), (2, "LLM Dev")}


ODD = ('top<div class="a b"><section class="s"><p>one<p data-testid="t">two <a href="/x">li<br>nk</a></section>'
       '<a href>no value</a></b></div><li class="l"><a class="k" href="/y"/>tail<a>no link</a>')


def test_link_context(spark):
    df = spark.createDataFrame([(1, ODD), (2, None), (3, ""), (4, "<![x y"), (5, "<p" * 50)], "page_id long, html string")
    got = {(r.page_id, r.pos): r for r in html.extract_links(df).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (1, 2)]
    x, empty, y = got[1, 0], got[1, 1], got[1, 2]
    assert (x.href, x.text, x.container, x.sections, x.parent_text) == ("/x", "link", "p|t|", "s\na b", "twolink")
    assert (empty.href, empty.text, empty.container, empty.sections) == ("", "no value", "div||a b", "a b")
    assert empty.parent_text == "onetwolinkno value"
    assert (y.href, y.text, y.container, y.parent_text, y.testid) == ("/y", "", "li||l", "tailno link", None)
    top = spark.createDataFrame([(1, "a<a href=z>b</a>c")], "page_id long, html string")
    assert [(r.container, r.parent_text, r.sections) for r in html.extract_links(top).collect()] == [(None, "abc", "")]


def test_selector_lists(spark):
    htm = ('<div class="list"><div id="1"><p class="x y">A</p></div><span><div id="2"></div></span></div>'
           '<div id="3" data-k="pre-mid-post"><ul><i><li>B</li></i></ul></div>')
    nodes = html.with_nodes(spark.createDataFrame([(1, htm)], "page_id long, html string"))

    def ids(selector):
        found = F.transform(html.select(F.col("nodes"), selector), lambda n: F.coalesce(
            html.attr(n, "id"), html.attr(n, "class"), n["tag"]))
        return nodes.select(found.alias("f")).first().f
    assert ids("div.list > div") == ["1"]
    assert ids("div.list div") == ["1", "2"]
    assert ids("ul li, p.x, div.list > span") == ["x y", "span", "li"]
    assert ids("p.y") == ["x y"] and ids("p.z") == [] and ids("ul > li") == []
    assert ids("[data-k*='mid']") == ids("div[data-k^=pre]") == ids("*[data-k$=post]") == ["3"]
    assert ids("[data-k=pre]") == [] and ids("div > p.x, div > p.y") == ["x y"]


def test_batches_keep_rows_and_columns(spark, monkeypatch):
    monkeypatch.setattr(html, "BATCH_NODES", 3)
    df = spark.range(20).select(F.col("id").alias("page_id"), F.concat(
        F.lit("<b>x</b>"), F.repeat(F.lit("<a href=u>t</a>"), (F.col("id") % 4).cast("int"))).alias("html"))
    assert html.extract_links(df, ["href"]).groupBy("page_id").count().orderBy("page_id").collect() == [
        (i, i % 4) for i in range(20) if i % 4]


def _nodes(page, plain=True):
    cols = {n: [] for n in html.NODE.names}
    splitter = html._Splitter(cols)
    if not plain:
        splitter._plain = lambda page: 0
    splitter.split(page)
    return {k: [list(x) if k == "up" else x for x in v] for k, v in cols.items()}


def test_plain_pages_never_reach_the_parser():
    page = "<!DOCTYPE html><html><body><script>a = '<p>';</script><!-- c -->" + CARD + "</body></html>"
    assert html._Splitter({n: [] for n in html.NODE.names})._plain(page) == len(page)
    assert _nodes(page) == _nodes(page, plain=False) and len(_nodes(page)["pos"]) > 20


def test_pages_are_split_as_the_parser_splits_them():
    bits = ["<div>", "<DIV class=\"a b\">", "</div>", "</ div>", "<a href=\"x&amp;y\">", "</a>", "<a href=u>", " a &lt; b",
            "&", "<", "< b", "<br/>", "<img src=\"a>b\" alt>", "<input disabled>", "<input Disabled a = \"1\">",
            "<script>", "</script>", "</SCRIPT >", "</ script>", "<style a=\"1\">x", "</style>", "<!--", "-->", "<!-- c -->",
            "<!---->", "<!doctype html>", "<![CDATA[x]]>", "<?pi?>", "</>", "</p x=\"1\">", "<p id=\"1\" id=\"2\">", "'", "\"",
            "<p\x0bid=\"1\">", "<p id=\"1\" class=\"c\">", "<a href=\"x\" />", "<x-y>", "<p a=\"b\nc\">", "\x00", "<!doctype"]
    rng = random.Random(3)
    for _ in range(5000):
        page = "".join(rng.choices(bits, k=rng.randint(1, 12)))
        assert _nodes(page) == _nodes(page, plain=False), page


def _plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("extended")
    return out.getvalue().split("== Physical Plan ==")[1]


def test_payloads_and_lists_are_parsed_once(spark):
    df = spark.createDataFrame([(1, True, "[]", "s", 0, "")],
                               "page_id long, use_llm boolean, payload string, search_id string, page_no int, html string")
    for parsed, n in ((extracted.parse_payload(df), 3), (extracted.items_to_jobs(extracted.parse_payload(df), AS_OF), 3),
                      (embedded.embedded_jobs(df, AS_OF), 2)):
        plan = _plan(parsed)
        assert 1 <= plan.count("from_json(") <= n and "size(" not in plan.split("Generate")[1].split("from_json(")[0]


def test_found_jobs_are_read_once_for_the_results(spark):
    found = embedded.embedded_jobs(spark.createDataFrame([(1, "s", 0, "")], "page_id long, search_id string, page_no int, html string"),
                                   AS_OF, keep=("page_id", "search_id", "page_no"))
    plan = _plan(pages.search_results(found, 5))
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
