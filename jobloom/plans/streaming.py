"""T1 as a registered query: land search pages as files, stream them into the store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from jobloom.plans import base
from jobloom.session import discard, materialize, remove, shared_dir, shuffles_released
from jobloom.sources import landed
from jobloom.streaming.ingest import PAGE_SCHEMA, STORED, run_ingest


def land_pages(spark: SparkSession, sf: str, landing_dir: str, files: int = 8) -> None:
    """Search pages in ``files`` files, as fetchers drop them page by page: the pages of a search
    lie in several files; its last page is marked.

    Jobs are shuffled, not pages: a file's jobs come to its task, which makes their pages.  Jobs are
    written between their shuffles, as those are several times as long and go with each write."""
    jobs = materialize(base.jobs(spark, sf).select(*landed.JOB_COLUMNS), "stream-jobs")
    page_id = landed.page_of(F.col("seq"))
    search_id, page_no = landed.search_of(page_id)
    of_search = Window.partitionBy(search_id)            # PAGES_PER_SEARCH pages at most
    marked = materialize(jobs.withColumn("last", page_no == F.max(page_no).over(of_search)), "stream-jobs")
    discard(jobs)
    pg = landed.search_pages(marked.repartition(files, page_id), keep=("last",))
    with shuffles_released(spark):
        pg.select(*PAGE_SCHEMA.names).write.mode("error").option("compression", "zstd").parquet(landing_dir)
    discard(marked)


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct job ids in the store after the stream drained every landed file."""
    run = shared_dir(spark, f"jobloom/stream-{uuid.uuid4().hex}")
    land_pages(spark, sf, f"{run}/landing")
    run_ingest(spark, f"{run}/landing", f"{run}/store", f"{run}/_checkpoint", base.AS_OF,
               files_per_trigger=4)
    for done in ("landing", "_checkpoint"):              # the stream is drained, its store stays
        remove(spark, f"{run}/{done}")
    return spark.read.schema(STORED).parquet(f"{run}/store").select("id").distinct()
