"""Clustered layout: lookups find all rows, and plan few files."""

import datetime as dt
import uuid

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from jobloom.operators import layout
from jobloom.session import materialize, shared_dir

COLUMNS = ["company", "id", "day"]
N = 6400


@pytest.fixture(scope="module")
def table(spark):
    """A third of the rows in one company, some without one, repeated days."""
    i = F.col("n")
    df = materialize(spark.range(N).withColumnRenamed("id", "n").select(
        F.when(i % 3 == 0, F.lit("c0")).when(i % 50 != 1, F.concat(F.lit("c"), F.pmod(F.xxhash64("n"), F.lit(90))))
        .alias("company"),
        F.md5(i.cast("string")).alias("id"),
        F.when(i % 41 != 2, F.timestamp_add("DAY", F.pmod(F.xxhash64("n", F.lit(1)), F.lit(300)).cast("int"),
                                            F.lit("2001-01-01").cast("timestamp_ntz"))).alias("day"),
        i.alias("n")), "layout-test")
    path = shared_dir(spark, f"jobloom/test-layout-{uuid.uuid4().hex}")
    layout.write(df, path, COLUMNS, rows_per_file=100)
    return df, path


def found(spark, table, wanted):
    df, path = table
    out = layout.lookup(spark, path, df.schema, COLUMNS, wanted)
    return sorted(r.n for r in out.select("n").collect()), len(out.inputFiles())


def expected(df, cond):
    return sorted(r.n for r in df.where(cond).select("n").collect())


def test_no_row_is_lost(spark, table):
    df, path = table
    again = spark.read.schema(df.schema).parquet(path)
    assert again.exceptAll(df).isEmpty() and again.count() == N


def test_lookup_by_key_plans_few_files(spark, table):
    df, _ = table
    n_files = len(spark.read.parquet(table[1]).inputFiles())
    assert n_files >= 48
    for n in (0, 1, 77, 6399):
        key = df.where(F.col("n") == n).first().id
        rows, files = found(spark, table, {"id": (key, key)})
        assert rows == [n] and files <= n_files // 2


def test_lookup_by_company_plans_few_files(spark, table):
    df, _ = table
    n_files = len(spark.read.parquet(table[1]).inputFiles())
    for c in ("c1", "c45", "c89"):
        rows, files = found(spark, table, {"company": (c, c)})
        assert rows == expected(df, F.col("company") == c) and rows and files <= n_files // 2


def test_a_hot_value_is_spread(spark, table):
    df, path = table
    rows, files = found(spark, table, {"company": ("c0", "c0")})
    assert rows == expected(df, F.col("company") == "c0") and len(rows) > N // 3 - 1
    most = spark.read.parquet(f"{path}/{layout.FILES}").agg(F.max("n_rows")).first()[0]
    assert files >= 16 and most <= 400


def test_two_columns_prune_together(spark, table):
    df, _ = table
    low, high = dt.datetime(2001, 3, 1), dt.datetime(2001, 3, 20)
    one = found(spark, table, {"company": ("c7", "c7")})[1]
    text = (str(low), str(high))
    rows, files = found(spark, table, {"company": ("c7", "c7"), "day": text})
    assert files <= one and rows == expected(
        df, (F.col("company") == "c7") & F.expr(f"day between timestamp_ntz'{low}' and timestamp_ntz'{high}'"))


def test_open_ends_and_no_match(spark, table):
    df, _ = table
    assert found(spark, table, {"day": ("2001-10-01", None)})[0] == expected(
        df, F.col("day") >= F.lit("2001-10-01").cast("timestamp_ntz"))
    assert found(spark, table, {"company": (None, "c12")})[0] == expected(df, F.col("company") <= "c12")
    assert found(spark, table, {"company": ("zz", "zz")}) == ([], 0)


@pytest.mark.parametrize("rows", [[], [(None, None)], [("a", 1)], [("a", 1)] * 5 + [(None, 2), ("", None)]])
def test_small_and_odd_tables(spark, rows):
    df = materialize(spark.createDataFrame(rows, "k string, v long"), "layout-odd")
    path = shared_dir(spark, f"jobloom/test-layout-{uuid.uuid4().hex}")
    layout.write(df, path, ["k", "v"], rows_per_file=2)
    assert spark.read.schema(df.schema).parquet(path).count() == len(rows)
    got = layout.lookup(spark, path, df.schema, ["k", "v"], {"k": ("a", "a")})
    assert got.count() == sum(k == "a" for k, _ in rows)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50)), min_size=1, max_size=40))
def test_rank_counts_cut_points(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    cuts = layout.cut_points(df, ["v"], len(values), bits=3)["v"]
    assert len(cuts) == min(7, sum(v is not None for v in values)) and sorted(map(int, cuts)) == list(map(int, cuts))
    kind = df.schema["v"].dataType
    for r in df.select("v", layout.rank("v", cuts, kind, bits=3).alias("rank")).collect():
        assert r["rank"] == (0 if r.v is None else sum(int(c) <= r.v for c in cuts))


def test_bits_in_turn(spark):
    df = spark.createDataFrame([(0b101, 0b011)], "a int, b int")
    assert df.select(layout.interleaved(["a", "b"], bits=3).alias("z")).first().z == 0b100111
