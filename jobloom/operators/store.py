"""Table maintenance (K1-K5): insert-if-absent, keyed upserts, child replacement,
enrichment update and expiry.  Each returns the new table as a DataFrame; the
caller writes it to a new location (never over a path that is being read).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from jobloom.functions.dates import as_of_col
from jobloom.operators.enrich import enrich_jobs
from jobloom.operators.rank import score_expr

ENRICH_UPDATE_COLUMNS = ["company_id", "region_team_count", "ranking_score", "enriched_at",
                         "company_size", "industry", "headquarters_location"]


def first_per_key(df: DataFrame, key: str, *order) -> DataFrame:
    """The first row of every key.  ``row_number() = 1`` is planned with a group limit before
    the shuffle: a key holding a third of the rows sends one row per map task, and no row
    travels inside an aggregate."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def insert_new(store: DataFrame, batch: DataFrame, key: str = "id",
               order_col: str = "seq") -> DataFrame:
    """K1 + J6: rows of ``batch`` whose key is not stored yet (first per key)."""
    fresh = first_per_key(batch, key, F.col(order_col))
    return fresh.join(store.select(key), key, "left_anti")


def upsert(target: DataFrame, updates: DataFrame, key: str = "id",
           order_col: str | None = None) -> DataFrame:
    """K2: keyed merge; an update overwrites the whole row, new keys are inserted.

    Several updates of one key: the last one in ``order_col`` wins.  Without that column the
    keys of ``updates`` have to be unique already.
    """
    cols = target.columns
    if order_col:
        updates = first_per_key(updates, key, F.col(order_col).desc())
    return target.join(updates.select(key), key, "left_anti").select(*cols) \
        .unionByName(updates.select(*cols))


def replace_children(children: DataFrame, new_children: DataFrame, parents: DataFrame,
                     parent_key: str = "company_id", count_col: str = "n_members",
                     default_country: str = "Taiwan") -> DataFrame:
    """K3: a parent with a non-empty new list has all its children replaced;
    an empty list leaves the old children in place.  The default fills a country that the new
    list doesn't carry at all; a country that is null stays null."""
    replacing = parents.where(F.col(count_col) > 0).select(parent_key).distinct()
    kept = children.join(replacing, parent_key, "left_anti")
    new = new_children.join(replacing, parent_key, "left_semi")
    if "country" in children.columns and "country" not in new.columns:
        new = new.withColumn("country", F.lit(default_country))
    return kept.unionByName(new.select(*children.columns))


def update_enrichment(jobs: DataFrame, companies: DataFrame, members: DataFrame, cfg, as_of,
                      max_age_days: int = 30) -> DataFrame:
    """K4: jobs that found a company and pass the ranking threshold get the enrichment columns;
    all others keep theirs.  The update columns come from the enrichment join itself, so the
    store is read once and not joined with itself."""
    old = {c: f"_old_{c}" for c in ENRICH_UPDATE_COLUMNS}
    e = enrich_jobs(jobs.withColumnsRenamed(old), companies, members, as_of, max_age_days)
    hit = F.col("company_id").isNotNull() & (F.col("region_team_count") >= cfg.min_team)
    new = {c: F.col(c) for c in ENRICH_UPDATE_COLUMNS}
    new["ranking_score"] = score_expr(cfg, as_of)
    new["enriched_at"] = as_of_col(as_of)
    return e.select(*[F.when(hit, new[c]).otherwise(F.col(old[c])).alias(c) if c in old
                      else F.col(c) for c in jobs.columns])


def expire(table: DataFrame, as_of, days: int = 30, ts_col: str = "scraped_at") -> DataFrame:
    """K5: drop rows older than ``days`` before ``as_of``; a missing time is kept."""
    cutoff = F.timestamp_add("DAY", F.lit(-days), as_of_col(as_of))
    return table.where(F.col(ts_col).isNull() | (F.col(ts_col) >= cutoff))

