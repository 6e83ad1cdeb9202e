"""Website / company-page resolution from landed pages.

Each page's links (X24) are ranked by the rule that would accept them, and the
best (rule, position) wins per page with ``min_by`` — a partial aggregation,
no per-page Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from jobloom.constants import BOARD_BASE_URL
from jobloom.functions.web import url_domain

# --- fixed values: link filters of the website rules -----------------------
INTERNAL_MARKERS = ["indeed.com", "javascript:", "mailto:", "#"]
SKIP_MARKERS = ["indeed.com", "linkedin.com", "facebook.com", "twitter.com", "instagram.com",
                "youtube.com", "glassdoor.com", "javascript:", "mailto:", "#", "/cmp/", "/jobs"]
WEBSITE_TEXT = r"(?i)(company website|visit website|website)"

JSONLD = T.StructType([T.StructField("@type", T.StringType()), T.StructField("url", T.StringType())])


def _none_of(col, markers):
    low = F.lower(col)
    cond = None
    for m in markers:
        c = ~low.contains(m)
        cond = c if cond is None else (cond & c)
    return cond


def _labelled(links: DataFrame) -> DataFrame:
    """Links by a 'website' or 'link' label in their text or parent, then links in an info
    section, then links with a telling test id; the first of them in that order."""
    href, text = F.col("href"), F.lower("text")
    parent = F.lower(F.coalesce("parent_text", F.lit("")))
    external = ~(href.contains("indeed.com") | href.startswith("/") | href.startswith("#")
                 | href.contains("mailto:") | href.contains("tel:"))
    label = (text.contains("website") | parent.contains("website")
             | (parent.contains("link") & (F.length(text) > 5)))
    info = F.coalesce("sections", F.lit("")).rlike(r"(?i)(company.*info|about|details)")
    return links.select("page_id", "pos", F.when(label & external, 1)
                        .when(info & external & (href != "") & (F.length(text) > 3), 2)
                        .when(F.coalesce("testid", F.lit("")).rlike("(?i)(website|link|url)")
                              & (href != "") & ~href.contains("indeed.com") & ~href.startswith("/"), 3)
                        .alias("rank"), href.alias("domain"))


def _plain(links: DataFrame) -> DataFrame:
    """The first absolute link to none of the known sites."""
    href = F.col("href")
    ok = href.startswith("http") & ~(href.contains("indeed.com") | href.contains("linkedin.com")
                                     | href.contains("glassdoor.com"))
    return links.select("page_id", "pos", F.when(ok, 1).alias("rank"), href.alias("domain"))


def company_website(pages: DataFrame, links: DataFrame, ruleset: str = "full") -> DataFrame:
    """X25 by one of three rule sets; None where no link fits.

    ``full``: labelled website link → first external non-social link → JSON-LD url, as a domain.
    ``labelled`` and ``plain`` (above) give the raw url."""
    if ruleset not in ("full", "labelled", "plain"):
        raise ValueError(f"Unknown rule set: {ruleset}")
    if ruleset != "full":
        found = (_labelled if ruleset == "labelled" else _plain)(links).where("rank IS NOT NULL")
        best = found.groupBy("page_id").agg(F.min_by("domain", F.struct("rank", "pos")).alias("website"))
        return pages.select("page_id").join(best, "page_id", "left")
    href = F.col("href")
    internal_ok = (F.coalesce(href, F.lit("")) != "") & _none_of(href, INTERNAL_MARKERS)
    container = F.coalesce(F.col("container"), F.lit(""))
    rank = (F.when(container.startswith("li|companyInfo-companyWebsite|") & internal_ok, 1)
            .when(F.col("text").rlike(WEBSITE_TEXT) & internal_ok, 2)
            .when(F.coalesce(F.col("testid"), F.lit("")).rlike("(?i)website") & internal_ok, 3)
            .when(container.rlike(r"(?i)^div\|[^|]*\|.*company.*info") & internal_ok, 4)
            .when(_none_of(href, SKIP_MARKERS) & href.startswith("http"), 5))
    cands = links.select("page_id", "pos", rank.alias("rank"), url_domain(href).alias("domain")) \
        .where(F.col("rank").isNotNull() & F.col("domain").isNotNull())
    scripts = F.regexp_extract_all("html", F.lit(
        r'(?is)<script[^>]*type\s*=\s*["\']application/ld\+json["\'][^>]*>(.*?)</script>'), F.lit(1))
    ld = F.transform(scripts, lambda s: F.from_json(s, JSONLD))
    ld = F.transform(F.filter(ld, lambda x: x["@type"] == "Organization"), lambda x: url_domain(x["url"]))
    first = F.get(F.filter(ld, lambda d: d.isNotNull()), F.lit(0))     # of all scripts of a page
    ld_c = pages.select("page_id", F.lit(1 << 30).alias("pos"), F.lit(6).alias("rank"),
                        first.alias("domain")).where(F.col("domain").isNotNull())
    best = cands.unionByName(ld_c).groupBy("page_id").agg(
        F.min_by("domain", F.struct("rank", "pos")).alias("website"))
    return pages.select("page_id").join(best, "page_id", "left")


def company_page_link(links: DataFrame, pages: DataFrame, base: str = BOARD_BASE_URL) -> DataFrame:
    """First /cmp/ link with a query, else any /cmp/ link, else an employer
    link, else the avatar container's link; made absolute."""
    href = F.col("href")
    container = F.coalesce(F.col("container"), F.lit(""))
    rank = (F.when(href.rlike(r"/cmp/.*\?"), 1)
            .when(href.contains("/cmp/"), 2)
            .when(F.coalesce(F.col("testid"), F.lit("")).rlike("(?i)employer.*link"), 3)
            .when(container.startswith("div|jobsearch-CompanyAvatar|"), 4))
    absolute = (F.when(href.startswith("/cmp/"), F.concat(F.lit(base), href))
                .when(href.contains("indeed.com/cmp/"), href))
    cands = links.select("page_id", "pos", rank.alias("rank"), absolute.alias("link")) \
        .where(F.col("rank").isNotNull() & F.col("link").isNotNull())
    best = cands.groupBy("page_id").agg(F.min_by("link", F.struct("rank", "pos")).alias("company_page"))
    return pages.select("page_id").join(best, "page_id", "left")
