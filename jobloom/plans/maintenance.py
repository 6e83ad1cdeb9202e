"""De-dup and table-maintenance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from jobloom.operators import dedup, export, store
from jobloom.operators.enrich import enrich_jobs
from jobloom.operators.rank import rank_jobs
from jobloom.plans import base
from jobloom.session import discard, materialize
from jobloom.sources import fixtures

AS_OF = base.AS_OF
FIRST_RUN_END = "2001-08-15 00:00:00"  # landed before this = the earlier run

DEDUP_COLUMNS = ["seq", "id", "title", "company", "url", "scraped_at"]


def dedup_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy three-key de-dup of every landed job."""
    return dedup.greedy_dedup(base.jobs(spark, sf)).select(*DEDUP_COLUMNS)


def dedup_exact_id(spark: SparkSession, sf: str) -> DataFrame:
    """D2 alone: newest row per job id."""
    j = base.jobs(spark, sf).select("id", "seq", "scraped_at")
    return dedup.exact_id_dedup(j).select("id", "seq")


def dedup_counters(spark: SparkSession, sf: str) -> DataFrame:
    """K8: input / kept / duplicate counts of the de-dup run, as one row."""
    stats = dedup.DedupStats()
    dedup.greedy_dedup(base.jobs(spark, sf), stats=stats)
    return spark.createDataFrame([(stats.input_rows, stats.kept_rows, stats.duplicates)],
                                 "input_rows long, kept_rows long, duplicates long")


def run_counters(spark: SparkSession, sf: str) -> DataFrame:
    """K8: saved and skipped rows of the later run, expired rows, ranked and filtered jobs.

    All are observed on the run's own writes (the store's two inserts, the expiry, the ranking): no
    job counts anything again."""
    n = F.count(F.lit(1))
    seen, saved, total, left, jobs, ranked = (Observation() for _ in range(6))
    early, late = _two_runs(spark, sf)
    s1 = materialize(store.insert_new(early.limit(0), early), "run-first")
    s2 = materialize(store.insert_new(s1, late.observe(seen, n.alias("n"))).observe(saved, n.alias("n")), "run-later")
    s3 = materialize(store.expire(s1.unionByName(s2).observe(total, n.alias("n")), AS_OF, 30)
                     .observe(left, n.alias("n")), "run-expired")
    r = materialize(rank_jobs(base.enriched(spark, sf).observe(jobs, n.alias("n")), base.DEFAULT_CFG, AS_OF)
                    .observe(ranked, n.alias("n")).select("seq", "ranking_score"), "run-ranked")
    seen, saved, total, left, jobs, ranked = (o.get["n"] for o in (seen, saved, total, left, jobs, ranked))
    for t in (s1, s2, s3, r):
        discard(t)
    return spark.createDataFrame([(saved, seen - saved, total - left, ranked, jobs - ranked)],
                                 "saved long, skipped long, deleted long, ranked long, filtered long")


def _landed(spark, sf):
    return base.jobs(spark, sf).select("seq", "id", "title", "company", "location", "description",
                                       "url", "posted_date", "scraped_at", "board_source")


def _two_runs(spark, sf):
    landed, end = _landed(spark, sf), F.lit(FIRST_RUN_END).cast("timestamp_ntz")
    return landed.where(F.col("scraped_at") < end), landed.where(F.col("scraped_at") >= end)


def stored_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """K1 twice: the earlier run into an empty store, then the later run."""
    early, late = _two_runs(spark, sf)
    s1 = store.insert_new(early.limit(0), early)
    s2 = store.insert_new(s1, late)
    return s1.unionByName(s2)


def store_with_defaults(spark, sf):
    s = stored_jobs(spark, sf)
    return s.select("*", F.lit(None).cast("string").alias("company_id"),
                    F.lit(0).alias("region_team_count"), F.lit(0.0).alias("ranking_score"),
                    F.lit(None).cast("timestamp_ntz").alias("enriched_at"),
                    F.lit(None).cast("string").alias("company_size"),
                    F.lit(None).cast("string").alias("industry"),
                    F.lit(None).cast("string").alias("headquarters_location"))


def store_insert(spark: SparkSession, sf: str) -> DataFrame:
    """The job store after two incremental runs."""
    return stored_jobs(spark, sf).select("id", "seq", "scraped_at")


def enriched_store(spark: SparkSession, sf: str) -> DataFrame:
    """K4 applied to the store: matched and ranked rows get the enrichment columns."""
    return store.update_enrichment(store_with_defaults(spark, sf), base.companies(spark, sf),
                                   base.members(spark, sf), base.DEFAULT_CFG, AS_OF)


def job_enrichment_update(spark: SparkSession, sf: str) -> DataFrame:
    return enriched_store(spark, sf).select(
        "id", "company_id", "region_team_count", "ranking_score", "enriched_at",
        "company_size", "industry", "headquarters_location")


def company_updates(spark, sf):
    """A later enrichment run: every third company re-fetched with new values (some twice: the
    later fetch counts), plus brand-new companies for suppliers never seen (ids shifted)."""
    c = base.companies(spark, sf)
    k = F.col("id").cast("long")
    now = F.lit(AS_OF).cast("timestamp_ntz")
    upd = (c.where(k % 3 == 0).withColumn("fetch", F.lit(2))
           .withColumn("industry", F.concat(F.coalesce("industry", F.lit("None")), F.lit(" (updated)")))
           .withColumn("enriched_at", now))
    earlier = upd.where(k % 6 == 0).withColumn("fetch", F.lit(1)).withColumn(
        "industry", F.lit("superseded"))
    new = (c.where(k % 4 == 1).withColumn("fetch", F.lit(2))
           .withColumn("id", (k + 1000000).cast("string"))
           .withColumn("name", F.concat("name", F.lit(" Holdings")))
           .withColumn("requested_name", F.col("name"))
           .withColumn("enriched_at", now))
    return earlier.unionByName(upd).unionByName(new)


def company_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """K2: companies after the keyed merge of a re-enrichment run."""
    merged = store.upsert(base.companies(spark, sf), company_updates(spark, sf), "id", "fetch")
    return merged.select("id", "name", "industry", "enriched_at", "region_team_count")


def member_lists(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The new member lists of re-fetched companies, and these companies with their lists' lengths."""
    m = base.members(spark, sf)
    upd = company_updates(spark, sf).select(F.col("id").alias("company_id")).distinct()
    # new member lists: every member re-assigned by custkey; companies whose id
    # is divisible by 6 come back with an empty list
    fresh = (m.withColumn("company_id", (F.col("id") % F.lit(50)).cast("string"))
             .withColumn("country", F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.col("country")))
             .join(upd, "company_id", "left_semi")
             .where(F.col("company_id").cast("long") % 6 != 0))
    counts = fresh.groupBy("company_id").agg(F.count(F.lit(1)).alias("n_members"))
    return fresh, upd.join(counts, "company_id", "left").fillna(0, ["n_members"])


def member_replace(spark: SparkSession, sf: str) -> DataFrame:
    """K3: re-fetched companies replace their members, unless the new list is empty."""
    out = store.replace_children(base.members(spark, sf), *member_lists(spark, sf))
    return out.select("id", "company_id", "name", "city", "country")


def expire_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """K5: the store without jobs scraped over 30 days before as_of."""
    return store.expire(stored_jobs(spark, sf), AS_OF, 30).select("id", "seq", "scraped_at")


def csv_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """K6: CSV rows of the job store."""
    return export.jobs_csv_frame(stored_jobs(spark, sf))


def csv_enriched(spark: SparkSession, sf: str) -> DataFrame:
    """K7: CSV rows of the ranked jobs."""
    r = rank_jobs(enrich_jobs(store_with_defaults(spark, sf), base.companies(spark, sf),
                              base.members(spark, sf), AS_OF), base.DEFAULT_CFG, AS_OF)
    return export.enriched_csv_frame(r)
