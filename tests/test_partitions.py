"""Partial rewrites of stored tables, broken ones included, and counts kept up to date."""

import os
import uuid

import pytest
from pyspark.sql import functions as F, types as T

from jobloom.operators import counts, partitions as pt
from jobloom.operators.store import expire, replace_children, upsert
from jobloom.session import shared_dir

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.IntegerType()),
                       T.StructField("scraped_at", T.TimestampNTZType())])
CHILDREN = T.StructType([T.StructField("company_id", T.StringType()), T.StructField("id", T.LongType()),
                         T.StructField("country", T.StringType())])
COUNTS = T.StructType([T.StructField("company_id", T.StringType()), T.StructField("n", T.LongType())])


def folder(spark):
    return shared_dir(spark, f"jobloom/test-parts-{uuid.uuid4().hex}")


def data(spark, n=200):
    day = F.lit("2001-08-20 08:00:00").cast("timestamp_ntz") - F.make_dt_interval((F.col("id") % 40).cast("int"))
    return spark.range(n).select(F.col("id").cast("string").alias("id"), F.col("id").cast("int").alias("v"),
                                 F.when(F.col("id") % 50 == 3, F.lit(None)).otherwise(day).alias("scraped_at"))


def files(table):
    root = table.path.removeprefix("file:")
    return {f: os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def updates(spark):
    return spark.createDataFrame([("5", -5, 1), ("5", -55, 2), ("new", -1, 1)], "id string, v int, turn int") \
        .withColumn("scraped_at", F.lit(None).cast("timestamp_ntz"))


def test_merge_writes_the_touched_buckets_only(spark):
    t = pt.bucketed(spark, folder(spark), SCHEMA, "id", 16).create(data(spark))
    before = files(t)
    pt.merge(t, updates(spark), "u1", order_col="turn")
    assert rows(t.read()) == rows(upsert(data(spark), updates(spark), "id", "turn"))
    touched = {f"bucket={b}" for b in t.values(updates(spark))}
    kept = {f for f, p in before.items() if p.split("/")[-2] not in touched}
    assert kept and kept <= set(files(t))
    assert not any(f in files(t) for f in set(before) - kept)


def test_a_change_takes_effect_once(spark):
    t = pt.bucketed(spark, folder(spark), COUNTS, "company_id", 4).create(
        spark.createDataFrame([("a", 2), ("b", 1)], COUNTS))
    plus = spark.createDataFrame([("a", 3), ("b", -1), ("c", 1), (None, 4)], COUNTS)
    for _ in range(2):
        counts.apply(t, "change", ["company_id"], plus)
    assert rows(t.read()) == rows(spark.createDataFrame([("a", 5), ("c", 1), (None, 4)], COUNTS))


@pytest.mark.parametrize("publishes", [False, True])
def test_a_change_that_dies_is_undone_or_finished(spark, monkeypatch, publishes):
    t = pt.bucketed(spark, folder(spark), SCHEMA, "id", 4).create(data(spark, 40))
    real = pt.PartTable._publish

    def dies(self, change, touched):
        if publishes:                                       # one folder is gone when the run dies
            self._fs().delete(self._at(touched[0]), True)
        raise RuntimeError("lost")
    monkeypatch.setattr(pt.PartTable, "_publish", dies)
    with pytest.raises(RuntimeError):
        pt.merge(t, updates(spark), "u1", order_col="turn")
    monkeypatch.setattr(pt.PartTable, "_publish", real)
    t.recover()                                             # the new rows were whole: finished
    want = rows(upsert(data(spark, 40), updates(spark), "id", "turn"))
    assert rows(t.read()) == want
    pt.merge(t, updates(spark), "u1", order_col="turn")
    assert rows(t.read()) == want


def test_a_change_without_whole_rows_is_cleared(spark):
    t = pt.bucketed(spark, folder(spark), SCHEMA, "id", 4).create(data(spark, 40))

    def fails(old):
        return old.withColumn("v", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        t.rewrite("u1", [0, 1], fails)
    assert rows(t.read()) == rows(data(spark, 40))
    t.recover()
    assert not t._fs().exists(t._at("_pending"))
    pt.merge(t, updates(spark), "u1", order_col="turn")
    assert rows(t.read()) == rows(upsert(data(spark, 40), updates(spark), "id", "turn"))


def test_expiry_drops_days_and_rewrites_one(spark):
    as_of = "2001-09-01 12:00:00"                           # cutoff 2001-08-02 12:00
    t = pt.by_day(spark, folder(spark), SCHEMA).create(data(spark))
    before = files(t)
    pt.expire_days(t, as_of, "e1")
    assert rows(t.read()) == rows(expire(data(spark), as_of, 30))
    assert f"day={pt.NO_VALUE}" in t.folders() and "day=2001-08-02" not in t.folders()
    assert set(files(t)) <= set(before)                     # nothing left of the cutoff's day


def test_expiry_keeps_the_later_part_of_the_day(spark):
    t = pt.by_day(spark, folder(spark), SCHEMA).create(data(spark))
    pt.expire_days(t, "2001-09-01 07:00:00", "e1")
    assert rows(t.read()) == rows(expire(data(spark), "2001-09-01 07:00:00", 30))
    assert "day=2001-08-02" in t.folders()


def test_replacement_and_its_counts(spark):
    old = spark.createDataFrame([("a", 1, "TW"), ("a", 2, None), ("b", 3, "TW"), ("c", 4, "SG"), (None, 5, "SG")], CHILDREN)
    new = spark.createDataFrame([("a", 6, "SG"), ("d", 7, "TW")], CHILDREN)
    parents = spark.createDataFrame([("a", 1), ("b", 0), ("d", 1)], "company_id string, n_members long")
    t = pt.bucketed(spark, folder(spark), CHILDREN, "company_id", 8).create(old)
    pt.replace(t, new, parents, "r1")
    want = replace_children(old, new, parents)
    assert rows(t.read()) == rows(want.select(*CHILDREN.names))
    keys = ["company_id", "country"]
    kept = counts.summed(keys, counts.tally(old, keys), counts.replaced(old, new, parents, keys))
    assert rows(kept) == rows(counts.tally(want, keys))


def test_empty_tables_and_changes(spark):
    t = pt.bucketed(spark, folder(spark), SCHEMA, "id", 4).create(data(spark).limit(0))
    assert t.read().isEmpty() and t.folders() == []
    pt.merge(t, updates(spark).limit(0), "none", order_col="turn")
    assert t.read().isEmpty()
    pt.merge(t, updates(spark), "u1", order_col="turn")
    assert rows(t.read().select("id", "v")) == [("5", -55), ("new", -1)]
    pt.expire_days(pt.by_day(spark, folder(spark), SCHEMA).create(data(spark).limit(0)), "2001-09-01 12:00:00", "e")
