"""Board adapters as a registry of DataFrame → DataFrame extractors.

An adapter turns a frame of landed pages into job rows; no per-row objects.
``get_extractor`` mirrors the reference factory: an unknown name raises
ValueError.  Extraction modes: ``css`` (declarative selectors), ``llm``
(landed extraction JSON, wrapped form allowed), ``hybrid`` (css rows of a
page if any, else llm rows), ``embedded`` (embedded JSON, card markup as
fallback).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from jobloom.functions.text import py_strip
from jobloom.sources import extracted, html, pages


def _item(c) -> Column:
    """The extraction item of a selected card."""
    null = F.lit(None).cast("string")
    return F.struct(*[c[n].alias(n) for n in ("title", "company", "location", "description",
                                              "job_key", "job_url")],
                    c["posted_text"].alias("posted_date"), c["salary"].alias("salary"),
                    *[null.alias(n) for n in ("salary_text", "salary_min", "salary_max", "is_remote")],
                    c["company_url"].alias("company_url"),
                    c["company_url_direct"].alias("company_url_direct"))


def _css(pg: DataFrame, as_of) -> DataFrame:
    cards = html.with_cards(pg, "selector", pages.CARD_SELECTOR_SPEC)
    rows = cards.select("page_id", F.explode_outer("cards").alias("c")).where(F.col("c").isNotNull())
    return extracted.items_to_jobs(
        rows.select("page_id", F.col("c.pos").alias("pos"), _item(F.col("c")).alias("it")), as_of)


def _llm(payloads: DataFrame, as_of) -> DataFrame:
    return extracted.items_to_jobs(extracted.parse_payload(payloads.withColumn("use_llm", F.lit(True))),
                                   as_of)


def _hybrid(pg: DataFrame, as_of) -> DataFrame:
    """CSS rows where a page has any that count, else the items of its payload (S15), in one
    pass over the pages: both are arrays of a page, and the page takes one of them."""
    p = html.with_cards(pg.select("page_id", "payload", "html"), "selector", pages.CARD_SELECTOR_SPEC)
    css = F.filter(F.transform("cards", lambda c: F.struct(c["pos"].alias("pos"), _item(c).alias("it"))),
                   lambda r: F.coalesce(py_strip(r["it"]["title"]), F.lit("")) != "")
    p = p.withColumn("css", css).withColumn("use_llm", F.lit(True))
    rest = extracted.payload_items(F.when(F.size("css") == 0, F.col("payload")), F.col("use_llm"))
    rows = p.select("page_id", F.explode_outer(F.concat("css", rest)).alias("r")).where(F.col("r").isNotNull())
    return extracted.items_to_jobs(
        rows.select("page_id", F.col("r.pos").alias("pos"), F.col("r.it").alias("it")), as_of)


def _embedded(pg: DataFrame, as_of) -> DataFrame:
    return pages.jobs_or_cards(pg, as_of)


EXTRACTORS = {"embedded": _embedded, "css": _css, "llm": _llm, "hybrid": _hybrid}
BOARDS = {"indeed": "embedded"}


def get_extractor(name: str):
    """Adapter by name; unknown names raise ValueError."""
    key = BOARDS.get(name, name)
    if key not in EXTRACTORS:
        raise ValueError(f"Unknown scraper type: {name}")
    return EXTRACTORS[key]
