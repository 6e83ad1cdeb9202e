"""Queries over stored tables that are kept up to date in place.

Each table is made once for a state of the inputs and of the code: written in partitions, then changed
by the runs that the fixtures describe; later calls only read it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from jobloom.operators import counts, partitions as pt
from jobloom.operators.partitions import PartTable
from jobloom.plans import base, maintenance as mt, stored
from jobloom.session import shared_dir
from jobloom.sources.tables import STORED

POSITIONS = T.StructType([T.StructField("company_id", T.StringType()), T.StructField("n", T.LongType())])
PEOPLE = T.StructType([T.StructField("company_id", T.StringType()), T.StructField("country", T.StringType()),
                       T.StructField("n", T.LongType())])


def _kept(spark: SparkSession, sf: str, name: str, at: Callable[[str], PartTable],
          make: Callable[[PartTable], None]) -> DataFrame:
    """The table ``name``; the call that finds none has ``make`` write and change it."""
    folder = shared_dir(spark, f"jobloom/store-{stored.state(spark, sf)}")
    path = stored.published(spark, folder, name, lambda f, own: make(at(f"{f}/{own}")))
    return at(path).read()


def merge_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """K2 on partitions: companies after the keyed merge of a re-enrichment run."""
    def make(t: PartTable) -> None:
        t.create(stored.companies(spark, sf))
        pt.merge(t, mt.company_updates(spark, sf), "re-enrichment", order_col="fetch")
    merged = _kept(spark, sf, "companies-merged", lambda p: pt.bucketed(spark, p, STORED["companies"], "id"), make)
    return merged.select("id", "name", "industry", "enriched_at", "region_team_count")


def replace_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """K3 on partitions: members after the re-fetched companies replaced theirs."""
    def make(t: PartTable) -> None:
        t.create(stored.members(spark, sf))
        pt.replace(t, *mt.member_lists(spark, sf), "re-enrichment")
    out = _kept(spark, sf, "members-replaced",
                lambda p: pt.bucketed(spark, p, STORED["members"], "company_id"), make)
    return out.select("id", "company_id", "name", "city", "country")


def expire_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """K5 on partitions: the store by day of scraping, without whole days and the part of a day that
    are over 30 days old."""
    def make(t: PartTable) -> None:
        t.create(stored.jobs(spark, sf))
        pt.expire_days(t, base.AS_OF, "expiry")
    return _kept(spark, sf, "jobs-expired", lambda p: pt.by_day(spark, p, STORED["jobs"]), make) \
        .select("id", "seq", "scraped_at")


def company_360_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """J3 + A7 from stored counts: those of the earlier run and of the first member lists, changed by
    the later run (K1), the expiry (K5) and the replaced members (K3)."""
    jobs = stored.jobs(spark, sf).where(F.col("company_id").isNotNull()).select("company_id", "scraped_at")
    later = F.col("scraped_at") >= F.lit(mt.FIRST_RUN_END).cast("timestamp_ntz")
    old = F.col("scraped_at") < F.timestamp_add("DAY", F.lit(-30), F.lit(base.AS_OF).cast("timestamp_ntz"))

    def positions(t: PartTable) -> None:
        t.create(counts.tally(jobs.where(~later), ["company_id"]))
        counts.apply(t, "later-run", ["company_id"], counts.tally(jobs.where(later), ["company_id"]))
        counts.apply(t, "expiry", ["company_id"], counts.tally(jobs.where(old), ["company_id"], -1))

    def people(t: PartTable) -> None:
        members, keys = stored.members(spark, sf), ["company_id", "country"]
        t.create(counts.tally(members, keys))
        counts.apply(t, "re-enrichment", keys, counts.replaced(members, *mt.member_lists(spark, sf), keys))

    return counts.company_page(
        stored.companies(spark, sf),
        _kept(spark, sf, "position-counts", lambda p: pt.bucketed(spark, p, POSITIONS, "company_id"), positions),
        _kept(spark, sf, "people-counts", lambda p: pt.bucketed(spark, p, PEOPLE, "company_id"), people))
