"""Clustered layout of a stored table, for lookups by any of several columns.

Rows lie in Z-order: every clustered column becomes a rank, the number of its cut points at or below
the value, and a row's place is the interleaving of the bits of its ranks.  The table is range
partitioned by that place, so a file covers a narrow range of each column.  ``_files`` below the
table (hidden from readers) keeps the least and greatest value of each column for each file; a lookup
plans only files whose ranges can hold what it asks for, and Parquet's Bloom filters skip the row
groups of these that lack a key.

Of n files, a lookup by one of d columns plans about n^((d-1)/d).  A value that holds a large share
of the rows is still spread over files by the other columns.  Nulls rank first, match no lookup, and
lose no rows.  The cut points come from a bounded sample; they decide where a row lies, never whether
it is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BITS = 8                # of a rank: 255 cut points a column
SAMPLE = 65536          # rows that the cut points are taken from, about
ROWS_PER_FILE = 500000
FILES = "_files"
PLACE = "_z"


def cut_points(df: DataFrame, columns: list[str], n_rows: int, bits: int = BITS) -> dict[str, list[str]]:
    """Evenly spread values of each column as text: 2^bits - 1, or fewer if the sample has fewer
    rows with a value.  One job for all columns; only the cut points reach the driver."""
    sample = df.select(*columns)
    if n_rows > SAMPLE:
        sample = sample.sample(SAMPLE / n_rows, seed=0)
    wanted = (1 << bits) - 1

    def even(c):
        found = F.sort_array(F.collect_list(c))                 # SAMPLE values, about
        n = F.least(F.size(found), F.lit(wanted))
        places = F.when(n > 0, F.sequence(F.lit(1), n))
        step = F.size(found).cast("long")
        return F.transform(places, lambda i: F.get(
            found, F.floor(i * step / (n + 1)).cast("int")).cast("string")).alias(c)
    row = sample.agg(*[even(c) for c in columns]).first()
    return {c: row[c] or [] for c in columns}


def rank(column: str, cuts: list[str], kind: T.DataType, bits: int = BITS) -> Column:
    """The number of cut points at or below the value, by binary search; null: 0."""
    padded = cuts + [None] * ((1 << bits) - 1 - len(cuts))
    points = F.array(*[F.lit(c).cast("string") for c in padded]).cast(T.ArrayType(kind))
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(bits))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.get(points, at + step - 1) <= F.col(column), at + step).otherwise(at))


def interleaved(ranks: list[str], bits: int = BITS) -> Column:
    """The bits of the ranks in turn, highest first; the first rank leads."""
    d, out = len(ranks), F.lit(0).cast("long")
    for bit in range(bits):
        for i, r in enumerate(ranks):
            one = F.shiftright(F.col(r), bit).bitwiseAND(F.lit(1)).cast("long")
            out = out.bitwiseOR(F.shiftleft(one, bit * d + d - 1 - i))
    return out


def write(df: DataFrame, path: str, columns: list[str], rows_per_file: int = ROWS_PER_FILE,
          bits: int = BITS) -> None:
    """Writes the rows of ``df``, a stored table, clustered by ``columns``, and the file ranges."""
    spark, n_rows = df.sparkSession, df.count()
    n_files = max(1, -(-n_rows // rows_per_file))
    cuts = cut_points(df, columns, n_rows, bits)
    ranks = [f"_rank_{i}" for i in range(len(columns))]
    placed = df.withColumns({r: rank(c, cuts[c], df.schema[c].dataType, bits) for r, c in zip(ranks, columns)}) \
        .withColumn(PLACE, interleaved(ranks, bits)).drop(*ranks)
    # the columns themselves split a cell that holds more rows than a file
    out = placed.repartitionByRange(n_files, PLACE, *columns).sortWithinPartitions(PLACE, *columns).drop(PLACE)
    writer = out.write.mode("error")
    for c in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)
    ends = [f(c).alias(f"{name}_{i}") for i, c in enumerate(columns) for name, f in (("low", F.min), ("high", F.max))]
    spark.read.schema(df.schema).parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.count(F.lit(1)).alias("n_rows"), *ends).coalesce(1).write.mode("error").parquet(f"{path}/{FILES}")


def lookup(spark: SparkSession, path: str, schema: T.StructType, columns: list[str], wanted: dict) -> DataFrame:
    """The rows whose columns lie within ``wanted``: column -> (low, high), both included, None for
    an open end.  ``columns`` are those the table was written by; only the names of the files that
    can hold such rows reach the driver."""
    hit, keep = F.lit(True), F.lit(True)
    for c, (low, high) in wanted.items():
        i, kind = columns.index(c), schema[c].dataType
        for bound, ahead in ((low, True), (high, False)):
            if bound is not None:
                value = F.lit(bound).cast(kind)
                hit &= (F.col(f"high_{i}") >= value) if ahead else (F.col(f"low_{i}") <= value)
        if low is not None and low == high:
            keep &= F.col(c) == F.lit(low).cast(kind)           # an equality can use a Bloom filter
        else:
            keep &= F.lit(True) if low is None else F.col(c) >= F.lit(low).cast(kind)
            keep &= F.lit(True) if high is None else F.col(c) <= F.lit(high).cast(kind)
    names = [r.file for r in spark.read.parquet(f"{path}/{FILES}").where(hit).select("file").collect()]
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{n}" for n in sorted(names)]).where(keep)
