"""Landed payloads built from the driver tables (FIXTURES.md §B).

The reference starts from fetched HTML / vendor JSON.  We land the same
payload shapes from the derived jobs, companies and members, so that every
parser below runs over data that grows with the given tables.  A search page
holds ``PAGE_SIZE`` jobs: the group behind each page is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

PAGE_SIZE = 15
PAGES_PER_SEARCH = 10
CORRUPT_PAGE, NO_MARKER_PAGE = 7, 8  # page_no % 10: bad embedded JSON / no embedded JSON
JOB_COLUMNS = ["seq", "title", "company", "location", "description", "posted_text", "salary_text"]


def _slug(c):
    return F.regexp_replace(c, "[^A-Za-z0-9]", "-")


def _job_key(k):
    return F.when(k % 13 == 0, F.lit(None)).otherwise(k.cast("string"))


def embedded_item(col=F.col):
    """One embedded search-result object per job (nulls are omitted by to_json); ``col`` gives
    the job's columns."""
    k = col("seq")
    return F.struct(
        _job_key(k).alias("jobkey"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(col("title")).alias("title"),
        F.when((k % 11 == 0) & (k % 2 == 0), F.lit(None)).otherwise(col("title")).alias("displayTitle"),
        F.when(k % 17 == 0, F.lit(None)).otherwise(col("company")).alias("company"),
        F.when(k % 19 == 0, F.lit(None)).otherwise(col("location")).alias("formattedLocation"),
        F.when((k % 19 == 0) & (k % 2 == 0), F.lit(None)).otherwise(F.lit("Taipei")).alias("jobLocationCity"),
        F.when(k % 2 == 0, F.lit("")).otherwise(col("description")).alias("snippet"),
        F.array(col("title"), col("location")).alias("jobSnippetHtmlItems"),
        col("posted_text").alias("formattedRelativeTime"),
        (k % 7 == 0).alias("remoteLocation"),
        F.when(k % 3 == 0, F.struct((F.lit(50000) + k % 100).cast("double").alias("min"),
                                    (F.lit(90000) + k % 100).cast("double").alias("max")))
        .alias("extractedSalary"),
        F.concat(F.lit("/cmp/"), _slug(col("company"))).alias("companyOverviewLink"),
    )


def dom_card(col=F.col):
    """One job card of the search-results markup; ``col`` gives the job's columns."""
    k = col("seq")
    key = _job_key(k)
    key_attr = F.when(key.isNull(), F.lit("")).otherwise(F.concat(F.lit(' data-jk="'), key, F.lit('"')))
    company = F.when(k % 23 == 0, F.lit("")).otherwise(
        F.concat(F.lit('<span data-testid="company-name">'), col("company"), F.lit("</span>")))
    location = F.when(k % 29 == 0, F.lit("")).otherwise(
        F.concat(F.lit('<div data-testid="text-location">'), col("location"), F.lit("</div>")))
    snippet = F.regexp_replace(col("description"), "<[^>]*>", "")
    salary = F.coalesce(col("salary_text"), F.lit(""))
    return F.concat(
        F.lit('<div class="job_seen_beacon cardOutline"><h2 class="jobTitle css-1"><a'), key_attr,
        F.lit(' href="/rc/clk?jk='), F.coalesce(key, F.lit("")), F.lit('"><span>'), col("title"),
        F.lit("</span></a></h2>"), F.lit('<div class="company_location">'), company, location,
        F.lit('</div><div class="job-snippet"><ul><li>'), snippet, F.lit("</li></ul></div>"),
        F.lit('<span class="date">'), col("posted_text"), F.lit("</span>"),
        F.lit('<div class="salary-snippet-container">'), salary, F.lit("</div>"),
        F.lit('<a href="/cmp/'), _slug(col("company")), F.lit('">Company</a></div>'))


def _dirty(raw, k):
    """An item's JSON, or on some rows an element that is no object."""
    return F.when(k % 10 == 3, F.lit('"x"')).when(k % 10 == 6, F.lit("7")).otherwise(raw)


def page_of(seq):
    """The page that shows a job."""
    return F.floor(seq / PAGE_SIZE)


def search_of(page_id):
    """(search_id, page_no) of a page."""
    return (F.concat(F.lit("search-"), F.floor(page_id / PAGES_PER_SEARCH).cast("string")),
            page_id % PAGES_PER_SEARCH)


def search_pages(jobs: DataFrame, dirty: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, search_id, page_no, url, html, n_items): embedded JSON plus cards.

    ``dirty``: nulls are written out, and some elements of the list are no objects.  ``keep``: columns
    that all jobs of a page agree on.  What is shuffled, sorted and spilled is the jobs' columns; the
    markup, several times as long, is made of a page's collected jobs."""
    def shown(j):
        raw = F.to_json(embedded_item(lambda c: j[c]), {"ignoreNullFields": str(not dirty).lower()})
        return F.struct(j["seq"].alias("seq"), (_dirty(raw, j["seq"]) if dirty else raw).alias("item"),
                        dom_card(lambda c: j[c]).alias("card"))
    per_job = jobs.select(page_of(F.col("seq")).alias("page_id"), *keep, F.struct(*JOB_COLUMNS).alias("j"))
    pages = per_job.groupBy("page_id", *keep).agg(F.collect_list("j").alias("js")) \
        .withColumn("js", F.sort_array(F.transform("js", shown)))
    cards = F.array_join(F.transform("js", lambda x: x.card), "")
    payload = F.concat(
        F.lit('{"metaData":{"mosaicProviderJobCardsModel":{"results":['),
        F.array_join(F.transform("js", lambda x: x.item), ","),
        F.lit('],"tierSummaries":[{"jobCount":'), F.size("js").cast("string"),
        F.lit('},{"jobCount":5}]}}}'))
    search_id, pno = search_of(F.col("page_id"))
    payload = F.when(pno == CORRUPT_PAGE, F.regexp_replace(payload, '^\\{"', "{")).otherwise(payload)
    script = F.when(pno == NO_MARKER_PAGE, F.lit("")).otherwise(F.concat(
        F.lit('<script>window.mosaic.providerData["mosaic-provider-jobcards"] = '), payload,
        F.lit(";</script>")))
    html = F.concat(F.lit("<!DOCTYPE html><html><head><title>Jobs</title></head><body>"), script,
                    F.lit('<div id="mosaic-jobResults">'), cards, F.lit("</div></body></html>"))
    return pages.select(
        "page_id",
        search_id.alias("search_id"),
        pno.cast("int").alias("page_no"),
        F.concat(F.lit("https://www.indeed.com/jobs?q=x&start="), (pno * 10).cast("string")).alias("url"),
        html.alias("html"),
        F.size("js").alias("n_items"), *keep)


def extraction_item(k=None):
    """One extracted item (CSS / LLM extraction output)."""
    k = F.col("seq") if k is None else k
    return F.struct(
        F.when(k % 31 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("title"), F.lit(" "))).alias("title"),
        F.when(k % 17 == 0, F.lit("")).otherwise(F.col("company")).alias("company"),
        F.when(k % 19 == 0, F.lit(None)).otherwise(F.col("location")).alias("location"),
        F.col("description").alias("description"),
        _job_key(k).alias("job_key"),
        F.when(k % 3 == 0, F.concat(F.lit("/viewjob?jk="), k.cast("string")))
        .when(k % 3 == 1, F.nullif(F.col("url"), F.lit(""))).alias("job_url"),
        F.col("posted_text").alias("posted_date"),
        F.col("salary_text").alias("salary"),
        F.when(k % 10 == 0, (F.lit(60000) + k % 7).cast("double")).alias("salary_min"),
        F.when(k % 20 == 0, (F.lit(80000) + k % 7).cast("double")).alias("salary_max"),
        (k % 7 == 0).alias("is_remote"),
        F.concat(F.lit("/cmp/"), _slug(F.col("company"))).alias("company_url"),
        F.when(k % 5 == 0, F.concat(F.lit("https://www.indeed.com/cmp/"), _slug(F.col("company")),
                                    F.lit("?from=direct"))).alias("company_url_direct"),
    )


def dirty_extraction_payloads(jobs: DataFrame) -> DataFrame:
    """As ``extraction_payloads``, with salaries as text (some of them no number) and elements
    that are no objects between the items."""
    k = F.col("seq")
    text = F.when(k % 30 == 20, F.lit("n/a")).when(k % 10 == 0, (F.lit(60000) + k % 7).cast("string"))
    raw = F.to_json(extraction_item().withField("salary_min", text))
    per_job = jobs.select(F.floor(k / PAGE_SIZE).alias("page_id"),
                          F.struct(k.alias("seq"), _dirty(raw, k).alias("it")).alias("j"))
    pages = per_job.groupBy("page_id").agg(F.sort_array(F.collect_list("j")).alias("js"))
    items = F.concat(F.lit("["), F.array_join(F.transform("js", lambda x: x.it), ","), F.lit("]"))
    return pages.select("page_id", F.lit(True).alias("use_llm"), F.when(
        F.col("page_id") % 2 == 0, items).otherwise(
        F.concat(F.lit('{"jobs":'), items, F.lit("}"))).alias("payload"))


def extraction_payloads(jobs: DataFrame) -> DataFrame:
    """(page_id, use_llm, payload): list form on even pages, ``{"jobs": [...]}`` on odd
    pages (read only in LLM mode); every 9th page is empty and every 11th bad JSON."""
    k = F.col("seq")
    per_job = jobs.select(F.floor(k / PAGE_SIZE).alias("page_id"),
                          F.struct(k.alias("seq"), extraction_item().alias("it")).alias("j"))
    pages = per_job.groupBy("page_id").agg(F.sort_array(F.collect_list("j")).alias("js"))
    items = F.transform("js", lambda x: x.it)
    pid = F.col("page_id")
    payload = (F.when(pid % 9 == 4, F.lit(""))
               .when(pid % 11 == 5, F.lit("[{not json"))
               .when(pid % 2 == 0, F.to_json(items))
               .otherwise(F.to_json(F.struct(items.alias("jobs")))))
    return pages.select("page_id", (pid % 4 != 3).alias("use_llm"), payload.alias("payload"))


def company_pages(companies: DataFrame) -> DataFrame:
    """A landed company profile page per company, in four layouts."""
    k = F.col("id").cast("long")
    site = F.col("website")
    social = F.concat(F.lit('<a href="https://www.linkedin.com/company/'), F.col("id"),
                      F.lit('">LinkedIn</a><a href="/jobs?q='), F.col("id"), F.lit('">Jobs</a>'))
    body = (F.when(k % 4 == 0, F.concat(
                social, F.lit('<ul><li data-testid="companyInfo-companyWebsite"><a href="https://www.'),
                site, F.lit('/about">Visit</a></li></ul>')))
            .when(k % 4 == 1, F.concat(social, F.lit('<p><a href="https://'), site, F.lit('">Home</a></p>')))
            .when(k % 4 == 2, F.concat(social, F.lit('<script type="application/ld+json">{"@type": "Organization", '
                                                     '"url": "https://www.'), site, F.lit('"}</script>')))
            .otherwise(social))
    return companies.select(k.alias("page_id"), F.concat(
        F.lit("<html><body><h1>"), F.col("name"), F.lit("</h1>"), body, F.lit("</body></html>")).alias("html"))


def job_detail_pages(jobs: DataFrame) -> DataFrame:
    """A landed job page per job with its employer links."""
    k = F.col("seq")
    slug = _slug(F.col("company"))
    body = (F.when(k % 4 == 0, F.concat(F.lit('<a href="/cmp/'), slug, F.lit('">C</a><a href="/cmp/'), slug,
                                         F.lit('?campaignid=x">C</a>')))
            .when(k % 4 == 1, F.concat(F.lit('<a href="https://www.indeed.com/cmp/'), slug, F.lit('">C</a>')))
            .when(k % 4 == 2, F.concat(F.lit('<div data-testid="jobsearch-CompanyAvatar"><a href="/other/'), slug,
                                       F.lit('">C</a></div>')))
            .otherwise(F.lit('<a href="/jobs">More</a>')))
    return jobs.select(k.alias("page_id"), F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")).alias("html"))
