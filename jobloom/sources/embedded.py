"""Embedded job-card JSON of search pages, parsed on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from jobloom.constants import EMBEDDED_MARKER_PATTERN
from jobloom.functions.dates import posted
from jobloom.functions.text import job_id
from jobloom.functions.web import job_url_from_key, remote_type, snippet_fallback
from jobloom.sources.extracted import RAW_ITEMS, truthy

_TEXT = ("jobkey", "title", "displayTitle", "company", "formattedLocation", "jobLocationCity",
         "snippet", "formattedRelativeTime", "remoteLocation", "companyOverviewLink")
ITEM = T.StructType([T.StructField(n, T.StringType()) for n in _TEXT] + [
    T.StructField("jobSnippetHtmlItems", T.ArrayType(T.StringType())),
    T.StructField("extractedSalary", T.StructType([T.StructField("min", T.StringType()),
                                                   T.StructField("max", T.StringType())])),
])
PAYLOAD = T.StructType([T.StructField("metaData", T.StructType([
    T.StructField("mosaicProviderJobCardsModel", T.StructType([
        T.StructField("results", RAW_ITEMS),
        T.StructField("tierSummaries", T.ArrayType(T.StructType([
            T.StructField("jobCount", T.IntegerType())])))]))]))])


def _model(html: Column) -> Column:
    raw = F.regexp_extract(html, "(?s)" + EMBEDDED_MARKER_PATTERN, 1)
    parsed = F.from_json(F.nullif(raw, F.lit("")), PAYLOAD, {"mode": "PERMISSIVE"})
    return parsed.getField("metaData").getField("mosaicProviderJobCardsModel")


def _results(html: Column) -> Column:
    return _model(html).getField("results")


def embedded_payload(pages: DataFrame) -> DataFrame:
    """S2 + S3: the parsed model of each page (null when absent or not JSON)."""
    model = _model(F.col("html"))
    total = F.aggregate(F.transform(F.coalesce(model.getField("tierSummaries"),
                                               F.array().cast("array<struct<jobCount:int>>")),
                                    lambda t: F.coalesce(t.jobCount, F.lit(0))),
                        F.lit(0), lambda a, b: a + b)
    return pages.select("page_id", model.getField("results").alias("results"),
                        total.alias("total_count"))


def _item(raw: Column, j: Column, keys: Column) -> Column:
    """(it, reason) of one element, its JSON read as ``j`` and the keys that it has.

    A key that is missing takes its default; a key that is there with null stays null.  ``reason``
    says why an element can't become a job (null: it can): it is no object, its location is null
    without a remote flag, its time is null, or it has neither snippet nor snippet items.
    """
    has = lambda k: F.array_contains(keys, k)

    def given(default, *names):
        out = F.lit(default)
        for n in reversed(names):
            out = F.when(has(n), j.getField(n)).otherwise(out)
        return out
    remote = truthy(given(None, "remoteLocation"))
    snippet, time = given("", "snippet"), given("", "formattedRelativeTime")
    items, location = j.getField("jobSnippetHtmlItems"), given(
        "Remote", "formattedLocation", "jobLocationCity")
    broken = F.when(has("jobSnippetHtmlItems"), items.isNull() | F.exists(
        F.coalesce(items, F.array().cast("array<string>")), lambda x: x.isNull())).otherwise(False)
    it = F.struct(
        given("", "jobkey").alias("key"), given("", "title", "displayTitle").alias("title"),
        given("Unknown", "company").alias("company"), location.alias("location"),
        remote.alias("remote"), snippet_fallback(snippet, items).alias("description"),
        time.alias("time"), j.getField("extractedSalary").alias("salary"))
    reason = (F.when(~F.coalesce(raw.startswith("{"), F.lit(False)), "no object")
              .when((F.coalesce(snippet, F.lit("")) == "") & broken, "null snippet items")
              .when(time.isNull(), "null time")
              .when(location.isNull() & ~remote, "null location"))
    return F.struct(it.alias("it"), reason.alias("reason"))


def embedded_items(pages: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(page_id, pos, it, reason): every element of every page's list in page order, with the
    columns ``keep`` of its page."""
    # an outer generator: a plain one has the optimiser test the list first, by parsing it again;
    # and nothing that is asked of an item is pushed below it, to parse the item again
    return pages.select(*keep, F.explode_outer(_items(F.col("html"))).alias("x")) \
        .where(F.col("x").isNotNull()).select(*keep, "x.pos", "x.x.it", "x.x.reason")


def _items(html: Column) -> Column:
    """(pos, (it, reason)) of every element of a page's list; an element is parsed once."""
    def item(r):
        j, keys = F.from_json(r, ITEM), F.coalesce(F.json_object_keys(r), F.array().cast("array<string>"))
        return F.get(F.transform(F.array(F.struct(j.alias("j"), keys.alias("keys"))),
                                 lambda p: _item(r, p["j"], p["keys"])), F.lit(0))
    raw = F.coalesce(_results(html), F.array().cast("array<string>"))
    return F.transform(raw, lambda r, i: F.struct(i.alias("pos"), item(r).alias("x")))


def job_of(it: Column, as_of, board: str = "indeed") -> list[Column]:
    """The job columns of a usable item."""
    return [job_id(it.company, it.title, it.location, it.key).alias("id"),
            it.title.alias("title"), it.company.alias("company"), it.location.alias("location"),
            it.description.alias("description"), job_url_from_key(it.key).alias("url"),
            posted(it.time, as_of),
            F.lit(board).alias("board_source"),
            remote_type(it.location, it.remote).alias("remote_type")]


def with_jobs(pages: DataFrame, as_of, board: str = "indeed", column: str = "jobs") -> DataFrame:
    """``pages`` with an array of the jobs of each page's list (empty without any): the list is
    parsed once for a page, and a page's jobs are as many as it shows."""
    usable = F.filter(_items(F.col("html")), lambda r: r["x"]["reason"].isNull())
    return pages.withColumn(column, F.transform(usable, lambda r: F.struct(
        r["pos"].alias("pos"), *job_of(r["x"]["it"], as_of, board))))


def embedded_rejects(pages: DataFrame) -> DataFrame:
    """The elements that are left out, with the reason."""
    return embedded_items(pages).where("reason IS NOT NULL").select("page_id", "pos", "reason")


def embedded_jobs(pages: DataFrame, as_of, board: str = "indeed",
                  keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """S2 + S4: one job row per usable embedded item, in page order (``pos``), with the columns
    ``keep`` of its page."""
    it = F.col("it")
    return embedded_items(pages, keep).where("reason IS NULL").select(
        *keep, "pos", *job_of(it, as_of, board),
        it.salary.getField("min").try_cast("double").alias("salary_min"),
        it.salary.getField("max").try_cast("double").alias("salary_max"))
