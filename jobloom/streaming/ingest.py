"""Incremental page ingest with Structured Streaming.

New landed page files -> embedded-JSON extraction with card-markup fallback -> whole searches
(state) -> greedy de-dup within each search -> insert-if-absent into the job store.

Pages are parsed as they come, so the shuffle to the state, the state and its checkpoints hold the jobs
of a page and not its markup, which is several times as long.  Tables and shuffles of a batch are deleted
as soon as the next step has written its own; sort, de-dup and insert go over large batches in slices (of
pages, of searches, of buckets), as their shuffles are several times a batch's rows.

A search is the unit of de-dup (all keys carry its id).  Its pages may land in any files: the
stateful step holds them until the search is whole, so a micro-batch hands out whole searches and
the set of stored ids doesn't depend on how files are grouped into batches.  The store write is
idempotent (known ids are skipped), so a micro-batch that is replayed after a failure adds nothing
twice; the stream's progress and state live in ``checkpointLocation`` on the shared file system.

The store is partitioned by a hash of the id.  A batch lists its hash buckets (BUCKETS at most) and
looks for known ids in those alone, so a small batch doesn't read the ids of the whole store.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from jobloom.functions.dates import as_of_col, relative_date_a
from jobloom.functions.text import fuzzy_key
from jobloom.operators.dedup import greedy_dedup
from jobloom.operators.store import insert_new
from jobloom.session import discard, materialize, release_shuffles, shuffles_released
from jobloom.sources import pages
from jobloom.streaming.searches import state_on_disk, whole_searches

BUCKETS = 64
SLICE_ROWS = 4_000_000    # of sort, de-dup and insert
SLICES = 8                # at most, as each reads the batch's rows

PAGE_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("search_id", T.StringType()),
    T.StructField("page_no", T.IntegerType()), T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()), T.StructField("last", T.BooleanType())])

STORE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("search_id", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("company", T.StringType()),
    T.StructField("location", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("posted_date", T.TimestampNTZType()),
    T.StructField("scraped_at", T.TimestampNTZType()), T.StructField("board_source", T.StringType()),
    T.StructField("remote_type", T.StringType())])

STORED = T.StructType([*STORE_SCHEMA.fields, T.StructField("bucket", T.IntegerType())])
STORE_COLUMNS = [n for n in STORE_SCHEMA.names if n != "scraped_at"]

# A page's jobs while its search is open; dates are made of the texts when it is whole.
HELD = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType())] + [
    T.StructField(n, T.StringType()) for n in (
        "id", "title", "company", "location", "description", "url", "posted_text", "board_source",
        "remote_type")]))


def parsed_pages(pg: DataFrame) -> DataFrame:
    """Pages with their jobs as one JSON text in the place of their markup."""
    found = pages.with_jobs_or_cards(pg.select("page_id", "search_id", "page_no", "last", "html"), None)
    return found.select("page_id", "search_id", "page_no", "last",
                        F.to_json(F.col("found").cast(HELD)).alias("jobs"))


def jobs_of_parsed(parsed: DataFrame, as_of) -> DataFrame:
    """Job rows of ``parsed_pages``, by ``page_id`` and ``pos``."""
    rows = parsed.select("page_id", "search_id", F.explode_outer(F.from_json("jobs", HELD)).alias("j"))
    return rows.where(F.col("j").isNotNull()).select("page_id", "search_id", "j.*").select(
        "page_id", "pos", *[relative_date_a(F.col("posted_text"), as_of).alias(c) if c == "posted_date" else c
                            for c in STORE_COLUMNS])


def slices_of(rows: DataFrame) -> int:
    """Slices of about SLICE_ROWS rows, or SLICES of more; a written table is counted by its footers."""
    return max(1, min(SLICES, -(-rows.count() // SLICE_ROWS)))


def in_page_order(rows: DataFrame, as_of) -> DataFrame:
    """Written job rows with a unique ``seq`` in page order; the table ``rows`` is deleted.  Slices are
    ranges of ``page_id``; their cuts decide only what is sorted together.  ``ingested`` of the result:
    written tables that it reads."""
    n = slices_of(rows)
    cuts = sorted({min(int(q), 2**63 - 1) for q in rows.approxQuantile(
        "page_id", [i / n for i in range(1, n)], 0.1 / n)}) if n > 1 else []
    # a missing page_id sorts first
    place = F.coalesce(sum(((F.col("page_id") >= c).cast("int") for c in cuts), F.lit(0)), F.lit(0))
    # written once, as ids given after a sort have to stay as they are; a slice's ids are below 2^50
    parts = [materialize((rows.where(place == i) if cuts else rows).orderBy("page_id", "pos").select(
        *STORE_COLUMNS, (F.lit(i << 50) + F.monotonically_increasing_id()).alias("seq"),
        as_of_col(as_of).alias("scraped_at")), "ingest") for i in range(len(cuts) + 1)]
    discard(rows)
    out = functools.reduce(DataFrame.unionByName, parts)
    out.ingested = parts
    return out


def jobs_of_pages(pg: DataFrame, as_of) -> DataFrame:
    """Job rows of landed pages with ``search_id`` and a unique ``seq`` in page order."""
    # written before the sort, whose sampling for its ranges would read the pages' contents once more
    return in_page_order(materialize(pages.jobs_or_cards(pg, as_of).select(
        "page_id", "pos", *STORE_COLUMNS), "ingest-pages"), as_of)


def dedup_searches(jobs: DataFrame) -> DataFrame:
    """Greedy de-dup of each search by itself: a key of one search never equals another's, so slices
    of whole searches are decided and written one after another.  ``written`` of the result: the tables
    that it reads."""
    mark = lambda c: F.concat_ws("|", F.col("search_id"), c)
    keyed = jobs.withColumns({
        "_id": F.when(F.col("id").isNotNull(), mark(F.col("id"))),
        "_fuzzy": mark(fuzzy_key("company", "title")),
        "_url": F.when(F.coalesce("url", F.lit("")) != "", mark(F.col("url")))})
    n = slices_of(jobs)
    of_slice = F.pmod(F.xxhash64("search_id"), F.lit(n))
    parts = []
    for i in range(n):
        kept = greedy_dedup(keyed.where(of_slice == i) if n > 1 else keyed,
                            id_col="_id", url_col="_url", fuzzy_col="_fuzzy")
        parts.append(materialize(kept.drop("_id", "_fuzzy", "_url"), "ingest-kept"))
        discard(kept.kept_keys)
    out = functools.reduce(DataFrame.unionByName, parts)
    out.written = parts
    return out


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def bucket_of(key) -> F.Column:
    """The store folder of an id; a null id has one as well."""
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def known_ids(spark: SparkSession, store_dir: str, buckets: list[int]) -> DataFrame:
    """The stored ids of some hash buckets: the others' folders are not read."""
    return spark.read.schema(STORED).parquet(store_dir).where(
        F.col("bucket").isin(buckets)).select("id")


def add_to_store(spark: SparkSession, store_dir: str, jobs: DataFrame) -> None:
    """K1: rows whose id the store doesn't have, first per id in the order of ``seq``.  An id lies in
    one bucket, so slices of buckets are added one after another; ``jobs`` is read once for each, so
    it should be a written table."""
    rows = jobs.select(*STORE_SCHEMA.names, "seq").withColumn("bucket", bucket_of("id"))
    touched = sorted(r[0] for r in rows.select("bucket").distinct().collect())     # BUCKETS at most
    n = min(slices_of(rows), len(touched))
    for some in (touched[i::n] for i in range(n)):
        new = rows.where(F.col("bucket").isin(some))
        known = (known_ids(spark, store_dir, some) if _exists(spark, store_dir)
                 else rows.select("id").limit(0))
        with shuffles_released(rows.sparkSession):
            insert_new(known, new).select(*STORED.names).repartition("bucket").write \
                .partitionBy("bucket").mode("append").option("compression", "zstd").parquet(store_dir)


def make_batch_writer(spark: SparkSession, store_dir: str, as_of):
    def write(batch: DataFrame, epoch_id: int) -> None:
        with shuffles_released(batch.sparkSession):
            # the stateful step runs once: what it hands out is written before it is used
            released = materialize(jobs_of_parsed(batch, as_of), "released")
            release_shuffles(batch)
            if released.isEmpty():
                discard(released)
                return
            found = in_page_order(released, as_of)
            kept = dedup_searches(found)
            for t in found.ingested:
                discard(t)
            add_to_store(spark, store_dir, kept)
            for t in kept.written:
                discard(t)
    return write


def run_ingest(spark: SparkSession, landing_dir: str, store_dir: str, checkpoint: str,
               as_of, files_per_trigger: int = 1) -> None:
    """Drain every landed file now (``availableNow``) and stop.  Searches that aren't whole stay in
    the state of ``checkpoint`` for the next run."""
    src = (spark.readStream.schema(PAGE_SCHEMA)
           .option("maxFilesPerTrigger", files_per_trigger).parquet(landing_dir))
    with state_on_disk(spark):
        q = (whole_searches(parsed_pages(src)).writeStream
             .foreachBatch(make_batch_writer(spark, store_dir, as_of))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
