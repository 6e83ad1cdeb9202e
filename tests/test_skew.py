"""Salted joins: hot keys are spread, rows are those of the plain join."""

import pytest
from pyspark.sql import functions as F

from jobloom.operators.enrich import match_employers
from jobloom.operators.skew import heavy_keys, salted_join

SIZES = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"


@pytest.fixture
def plain_plans(spark):
    """Sort-merge joins without run-time changes, so that a task's rows show the dealing."""
    before = {k: spark.conf.get(k) for k in SIZES}
    spark.conf.set(SIZES[0], "-1")
    spark.conf.set(SIZES[1], "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def big(spark, n=30000):
    """A third of the rows on one key, a tenth without a key, the rest on many keys."""
    k = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 10 == 1, F.lit(None)) \
        .otherwise(F.concat(F.lit("k"), F.pmod(F.xxhash64("id"), F.lit(2000)).cast("string")))
    return spark.range(n).select(F.col("id").alias("row"), k.alias("k"))


def small(spark):
    hot = spark.createDataFrame([("hot", -1), ("hot", -2), ("nobody", -3), (None, -4)], "k string, v long")
    return hot.unionByName(spark.range(1500).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"),
                                                    F.col("id").alias("v")))


def test_only_the_hot_key_is_heavy(spark):
    assert [k for k, _ in heavy_keys(big(spark), "k")] == ["hot"]
    assert heavy_keys(big(spark).limit(0), "k") == []


@pytest.mark.parametrize("how", ["inner", "left"])
def test_rows_are_those_of_the_plain_join(spark, how):
    got = salted_join(big(spark), small(spark), "k", how)
    want = big(spark).join(small(spark), "k", how).select(*got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert got.columns == ["k", "row", "v"]


def test_empty_sides(spark):
    none = big(spark).limit(0)
    assert salted_join(none, small(spark), "k").isEmpty()
    assert salted_join(big(spark), small(spark).limit(0), "k", "left").count() == 30000


def largest_and_median(df):
    sizes = sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
    return sizes[-1], sizes[len(sizes) // 2]


def test_no_task_holds_the_hot_key(spark, plain_plans):
    one = small(spark).dropDuplicates(["k"])
    for how in ("inner", "left"):
        top, median = largest_and_median(salted_join(big(spark), one, "k", how))
        assert top <= 3 * median
    top, median = largest_and_median(big(spark).join(one, "k"))
    assert top > 3 * median                                    # what the salt is for


def test_one_domain_on_a_third_of_the_people(spark):
    people = big(spark, 3000).select(
        F.col("row").alias("person_id"), F.lit("n").alias("name"), F.lit("t").alias("title"),
        F.lit("l").alias("location"), F.lit("Taiwan").alias("country"), F.lit("u").alias("url"),
        F.array(F.struct(F.struct(F.col("k").alias("domain_only")).alias("company_website"))).alias("experience"))
    firms = spark.createDataFrame([(1, "hot"), (2, "k7")], "company_id long, domain string")
    got = {(r.company_id, r.person_id) for r in match_employers(firms, people).collect()}
    assert {p for c, p in got if c == 1} == set(range(0, 3000, 3))
    assert {p for c, p in got if c == 2} == {r.row for r in big(spark, 3000).where("k = 'k7'").collect()}
