"""Equi-joins whose hot keys are spread over many tasks.

A bounded frequent-items sketch of the large side (one partial aggregate, TRACKED counters a task)
names the keys that hold more than twice a mean partition.  Rows of such a key get a random salt out
of as many pieces as bring it well below a mean partition, and the other side's rows of that key are
repeated once a piece.  All other keys join plainly.  Null keys match nothing and are spread as well.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F, types as T

TOP = 1024          # most keys that can be salted: the size bound of the broadcast table
TRACKED = 65536     # counters of the sketch: an estimate is off by less than a 1/10,000 of the rows
GRAINS = 4          # pieces for each mean partition a key holds, so that collisions even out
SALT, PIECES = "_skew_salt", "_skew_pieces"


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def heavy_keys(df: DataFrame, key: str, top: int = TOP) -> list[tuple]:
    """(key, pieces) of the keys with more than twice the rows of a mean shuffle partition; ``top``
    at most.  Keys beyond these hold less than 1/top of the rows each."""
    n_parts = partitions(df)
    found = df.where(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k(`{key}`, {top}, {max(top, TRACKED)})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [(r["item"], min(GRAINS * n_parts, math.ceil(GRAINS * r["count"] * n_parts / found["n"])))
            for r in found["top"] or [] if r["count"] * n_parts > 2 * found["n"]]


def salted_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``big.join(small, key, how)`` for ``how`` 'inner' or 'left', with the hot keys of ``big``
    spread.  Reads the key column of ``big`` once more, for the sketch."""
    if how not in ("inner", "left"):
        raise ValueError(f"salted_join: {how}")
    n_parts, heavy = partitions(big), heavy_keys(big, key)
    schema = T.StructType([T.StructField(key, big.schema[key].dataType), T.StructField(PIECES, T.IntegerType())])
    hot = F.broadcast(big.sparkSession.createDataFrame(heavy, schema))      # TOP rows at most
    pieces = F.when(F.col(key).isNull(), n_parts).otherwise(F.coalesce(PIECES, F.lit(1)))
    left = big.join(hot, key, "left").withColumn(SALT, F.floor(F.rand(0) * pieces).cast("int")).drop(PIECES)
    right = small.where(F.col(key).isNotNull()).join(hot, key, "left").withColumn(
        SALT, F.explode(F.sequence(F.lit(0), F.coalesce(PIECES, F.lit(1)) - 1))).drop(PIECES)
    return left.join(right, [key, SALT], how).drop(SALT)
