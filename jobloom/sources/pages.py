"""Page-level rules: blocked-page flags (S14), source fallback (S15), selector spec."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from jobloom.constants import (BLOCKED_ATTR_PATTERN, BLOCKED_HEADING_PATTERN, CAPTCHA_CLASS_PATTERN,
                               CAPTCHA_TEXT_PATTERN, CHALLENGE_MARKERS, CHALLENGE_PHRASES_CI,
                               SUSPICIOUS_PAGE_CHARS)

# --- fixed values: declarative card selectors of the CSS extraction mode ---
CARD_SELECTOR_SPEC = {
    "base": "div.job_seen_beacon, div[data-testid='job-card'], div.jobsearch-ResultsList > div",
    "fields": [
        {"name": "title", "selector": "h2.jobTitle a, h2.jobTitle span, a[data-jk]"},
        {"name": "company", "selector": "span[data-testid='company-name'], span.companyName, "
                                        "div[data-testid='company-name']"},
        {"name": "location", "selector": "div[data-testid='text-location'], div.companyLocation"},
        {"name": "salary", "selector": "div[class*='salary-snippet'], div[class*='salaryOnly'], "
                                       "div.salary-snippet-container, "
                                       "div[data-testid='attribute_snippet_testid']"},
        {"name": "description", "selector": "div.job-snippet, div[class*='job-snippet'], ul li, "
                                            "div[data-testid='jobsnippet_footer']"},
        {"name": "posted_text", "selector": "span.date, span[class*='date'], "
                                            "span[data-testid='myJobsStateDate']"},
        {"name": "job_key", "selector": "a[data-jk]", "type": "attribute", "attribute": "data-jk"},
        {"name": "job_url", "selector": "h2.jobTitle a, a[data-jk]", "type": "attribute",
         "attribute": "href"},
        {"name": "company_url", "selector": "a[href*='/cmp/']", "type": "attribute", "attribute": "href"},
        {"name": "company_url_direct", "selector": "div.job_seen_beacon, div[data-testid='job-card']",
         "type": "attribute", "attribute": "data-company-url"},
    ],
}


def blocked_flags(pages: DataFrame, n_jobs_col: str | None = None) -> DataFrame:
    """Challenge markers, captcha phrases / elements, blocked elements, small pages."""
    h = F.col("html")
    low = F.lower(h)
    challenge = None
    for m in CHALLENGE_MARKERS:
        c = h.contains(m)
        challenge = c if challenge is None else (challenge | c)
    phrase = None
    for m in CHALLENGE_PHRASES_CI:
        c = low.contains(m)
        phrase = c if phrase is None else (phrase | c)
    captcha_el = (h.rlike(r"(?i)<(div|iframe|form)\b[^>]*\bclass\s*=\s*[\"'][^\"']*"
                          + CAPTCHA_CLASS_PATTERN)
                  | h.rlike(r"(?i)>[^<]*" + CAPTCHA_TEXT_PATTERN))
    blocked_el = (h.rlike(r"(?i)<div\b[^>]*\bclass\s*=\s*[\"'][^\"']*" + BLOCKED_ATTR_PATTERN)
                  | h.rlike(r"(?i)<[a-z0-9]+\b[^>]*\bid\s*=\s*[\"'][^\"']*" + BLOCKED_ATTR_PATTERN)
                  | h.rlike(r"(?i)<h1\b[^>]*>[^<]*" + BLOCKED_HEADING_PATTERN))
    # without a count of extracted jobs, job cards and the embedded list stand for jobs
    n_jobs = F.col(n_jobs_col) if n_jobs_col else (
        h.contains("job_seen_beacon") | h.contains("mosaic-provider-jobcards")).cast("int")
    small = (F.length(h) < SUSPICIOUS_PAGE_CHARS) & (n_jobs == 0)
    return pages.select("page_id", challenge.alias("challenge"), phrase.alias("captcha_phrase"),
                        captcha_el.alias("captcha_element"), blocked_el.alias("blocked_element"),
                        small.alias("suspicious_small"),
                        (challenge | phrase | captcha_el | blocked_el).alias("blocked"))


def with_jobs_or_cards(pages: DataFrame, as_of) -> DataFrame:
    """S15 in one pass: the jobs of a page's embedded list, or those of its cards if it has none, as
    the array ``found`` of a page, in the place of its html.

    The list is parsed once into an array; only a page without jobs keeps its html for the card
    parser.  No join and no shuffle.  ``source`` says which it was.  Without ``as_of`` jobs have their
    ``posted_text`` instead of ``posted_date``."""
    from jobloom.sources import embedded, html
    p = embedded.with_jobs(pages, as_of)
    p = p.withColumn("html", F.when(F.size("jobs") == 0, F.col("html")))
    p = html.with_cards(p, "dom")
    cards = F.transform("cards", lambda c: F.struct(c["pos"].alias("pos"), *html.card_job(c, as_of)))
    return p.select(*[c for c in pages.columns if c != "html"],
                    F.when(F.size("jobs") > 0, "embedded").otherwise("dom").alias("source"),
                    F.concat("jobs", cards).alias("found"))


def jobs_or_cards(pages: DataFrame, as_of) -> DataFrame:
    """A row for each job of ``with_jobs_or_cards``."""
    keep = [c for c in ("page_id", "search_id", "page_no") if c in pages.columns]
    p = with_jobs_or_cards(pages.select(*keep, "html"), as_of)
    return p.select(*keep, "source", F.explode_outer("found").alias("j")) \
        .where(F.col("j").isNotNull()).select("*", "j.*").drop("j")


def search_results(found: DataFrame, max_results: int) -> DataFrame:
    """Jobs of each search in page order (``rank``), up to the first page that has none
    (pages count from 0) and at most ``max_results``; ``found`` has search_id, page_no, pos.

    ``found`` is read and shuffled once: a page's number among the pages of its search and the
    rank are windows over the same partitions, which a search's rows pass in order."""
    order = Window.partitionBy("search_id").orderBy("page_no")
    reached = (found.where(F.col("search_id").isNotNull())
               .withColumn("_n", F.dense_rank().over(order) - 1)
               .where(F.col("_n") == F.col("page_no")).drop("_n"))
    ranked = Window.partitionBy("search_id").orderBy("page_no", "pos")
    return (reached.withColumn("rank", F.row_number().over(ranked))
            .where(F.col("rank") <= max_results))
