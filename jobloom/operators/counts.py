"""Stored counts kept up to date by signed changes.

A change to a base table is tallied as rows (keys, n) with a sign: +1 for a row that K1 or K3 adds, -1
for one that K3 replaces or K5 drops.  The tallies are pre-aggregated, summed with the stored counts
of the touched buckets alone, and keys that reach zero go.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, functions as F

from jobloom.operators.partitions import PartTable


def tally(rows: DataFrame, keys: list[str], sign: int = 1) -> DataFrame:
    """Signed number of rows per key; null is a key value like any other."""
    return rows.groupBy(*keys).agg((F.count(F.lit(1)) * sign).cast("long").alias("n"))


def summed(keys: list[str], *tallies: DataFrame) -> DataFrame:
    """Counts after the changes; keys without rows go."""
    both = functools.reduce(DataFrame.unionByName, [t.select(*keys, "n") for t in tallies])
    return both.groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")


def replaced(children: DataFrame, new_children: DataFrame, parents: DataFrame, keys: list[str],
             parent_key: str = "company_id", count_col: str = "n_members") -> DataFrame:
    """The change of K3: minus the old children of parents with a non-empty new list, plus the new."""
    lists = parents.where(F.col(count_col) > 0).select(parent_key).distinct()
    old = tally(children.join(lists, parent_key, "left_semi"), keys, -1)
    return summed(keys, old, tally(new_children.join(lists, parent_key, "left_semi"), keys))


def apply(table: PartTable, change: str, keys: list[str], *tallies: DataFrame) -> None:
    """Merges signed tallies into the stored counts, on their buckets only, once per change name."""
    diff = summed(keys, *tallies)
    table.rewrite(change, table.values(diff), lambda old: summed(keys, old, diff))


def company_page(companies: DataFrame, positions: DataFrame, people: DataFrame) -> DataFrame:
    """J3 from stored counts: ``positions`` by company, ``people`` by company and country."""
    open_ = positions.select("company_id", F.col("n").alias("open_positions"))
    members = people.groupBy("company_id").agg(       # at most as many rows as countries a company
        F.sum("n").alias("n_members"),
        F.array_join(F.sort_array(F.collect_set("country")), ",").alias("countries"))
    c = companies.select(F.col("id").alias("company_id"), "name", "industry", "company_size", "region_team_count")
    return (c.join(open_, "company_id", "left").join(members, "company_id", "left")
            .fillna(0, ["open_positions", "n_members"]).fillna("", ["countries"]))
