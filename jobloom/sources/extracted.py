"""Extracted-JSON landing (CSS or LLM extraction output), parsed on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from jobloom.functions.dates import date_of_text_b, first_int, text_b
from jobloom.functions.salary import salary_of_values, salary_values
from jobloom.functions.text import job_id, py_strip
from jobloom.functions.web import item_job_url, remote_type, resolve_company_url

# Every field as text: numbers and flags are read with try_cast, so one odd value spoils
# neither its item nor its payload.
ITEM = T.StructType([T.StructField(n, T.StringType()) for n in (
    "title", "company", "location", "description", "job_key", "job_url", "posted_date",
    "salary", "salary_text", "salary_min", "salary_max", "is_remote", "company_url",
    "company_url_direct")])
RAW_ITEMS = T.ArrayType(T.StringType())


def truthy(flag: Column) -> Column:
    """A JSON flag as text: false, 0, '' and null are off."""
    return ~F.coalesce(F.lower(flag), F.lit("")).isin("", "false", "0", "0.0", "null")


def raw_items(items: Column) -> Column:
    """(pos, raw) of the elements that are JSON objects; others are skipped one by one."""
    return F.filter(F.transform(items, lambda x, i: F.struct(i.alias("pos"), x.alias("raw"))),
                    lambda r: r["raw"].startswith("{"))


def payload_items(payload: Column, use_llm: Column) -> Column:
    """(pos, it) of the usable items of a payload, in order; an empty array if there is none.

    A payload is a JSON list of items, or ``{"jobs": [...]}`` when the LLM flag is set; anything
    else ('' / null / bad JSON / other shapes) has no items.  An element that is no object, or
    whose given salary is no number, is left out; the others stay."""
    text = F.nullif(py_strip(payload), F.lit(""))
    as_list = F.when(text.startswith("["), F.from_json(text, RAW_ITEMS))
    wrapped = F.when(text.startswith("{") & use_llm, F.from_json(
        text, T.StructType([T.StructField("jobs", RAW_ITEMS)])).getField("jobs"))
    raw = F.coalesce(as_list, wrapped, F.array().cast("array<string>"))
    items = F.transform(raw_items(raw), lambda r: F.struct(
        r["pos"].alias("pos"), F.from_json(r["raw"], ITEM).alias("it")))

    def usable(r):
        low, high = r["it"]["salary_min"], F.nullif(r["it"]["salary_max"], F.lit(""))
        bad = low.isNotNull() & (low.try_cast("double").isNull()
                                 | (high.isNotNull() & high.try_cast("double").isNull()))
        return ~bad
    return F.filter(items, usable)


def parse_payload(payloads: DataFrame) -> DataFrame:
    """(page_id, pos, it) of all usable items."""
    # an outer generator: a plain one has the optimiser test the array first, by computing it again
    rows = payloads.select("page_id", F.explode_outer(
        payload_items(F.col("payload"), F.col("use_llm"))).alias("r")).where(F.col("r").isNotNull())
    return rows.select("page_id", F.col("r.pos").alias("pos"), F.col("r.it").alias("it"))


def items_to_jobs(items: DataFrame, as_of, board: str = "indeed") -> DataFrame:
    """S8 + F5: trim, defaults, URLs, relative date (rule B), salary, remote flag.

    What several columns read is a column of an inner projection, so that it is computed once."""
    it = F.col("it")
    salary_text = F.coalesce(F.nullif(it.salary, F.lit("")), it.salary_text, F.lit(""))
    inner = items.select(
        "page_id", "pos", "it", py_strip(F.coalesce(it.title, F.lit(""))).alias("_title"),
        py_strip(F.coalesce(F.nullif(it.company, F.lit("")), F.lit("Unknown"))).alias("_company"),
        py_strip(F.coalesce(F.nullif(it.location, F.lit("")), F.lit("Remote"))).alias("_location"),
        text_b(it.posted_date).alias("_posted"), salary_values(salary_text).alias("_amounts"),
        it.salary_min.try_cast("double").alias("_low"), it.salary_max.try_cast("double").alias("_high"))
    inner = inner.withColumn("_number", first_int(F.col("_posted")))
    title, company, location = F.col("_title"), F.col("_company"), F.col("_location")
    sal = salary_of_values(F.col("_amounts"), F.col("_low"), F.col("_high"))
    out = inner.select(
        "page_id", "pos",
        job_id(company, title, location).alias("id"),
        title.alias("title"), company.alias("company"), location.alias("location"),
        py_strip(F.coalesce(it.description, F.lit(""))).alias("description"),
        item_job_url(it.job_key, it.job_url).alias("url"),
        date_of_text_b(F.col("_posted"), F.col("_number"), as_of).alias("posted_date"),
        F.lit(board).alias("board_source"),
        resolve_company_url(it.company_url, it.company_url_direct).alias("company_website"),
        sal.salary_min.alias("salary_min"), sal.salary_max.alias("salary_max"),
        remote_type(location, truthy(it.is_remote)).alias("remote_type"))
    return out.where(F.col("title") != "")
