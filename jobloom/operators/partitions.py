"""Partial rewrites of stored tables (K2-K5): a change writes only the partitions it touches.

A table lies in folders of one partition column: a hash bucket of its key, or the day of a time.  A
change reads the touched folders, writes their new rows whole to ``_pending`` below the table (hidden
from readers), and then replaces just these folders by dynamic partition overwrite.  A run that dies
before ``_pending`` is whole has changed nothing.  One that dies later is finished by the next change,
or by ``recover``.  A change is known by its name and takes effect once, so signed counts can be
merged by a job that is run again.  There is one writer at a time; readers list the files when they
plan, so a reader that planned before a change has to plan again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from jobloom.functions.dates import as_of_col
from jobloom.operators.store import expire, replace_children, upsert

BUCKETS = 64
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"      # fixed value: Spark's folder name of a null partition


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def day_of(ts: str) -> Column:
    return F.to_date(ts)


@dataclass(frozen=True)
class PartTable:
    """A stored table at ``path``: the columns of ``schema`` in folders of ``by``, whose value is
    ``part`` of a row.  ``by`` is not a column of ``schema``."""
    spark: SparkSession
    path: str
    schema: T.StructType
    by: str
    part: Column

    # ------------------------------------------------------------ reading and writing
    def _typed(self, df: DataFrame) -> DataFrame:
        rows = df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        # AQE splits a folder beyond the advisory size into several files and merges small ones
        return rows.withColumn(self.by, self.part).hint("rebalance", self.by)

    def create(self, df: DataFrame) -> PartTable:
        """Writes the table; an empty one gets its folder and no partition."""
        self._typed(df).write.partitionBy(self.by).mode("error").parquet(self.path)
        return self

    def _all(self) -> DataFrame:
        kind = self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields]) \
            .select(self.part.alias("p")).schema["p"].dataType
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(self.by, kind)])) \
            .parquet(self.path)

    def read(self) -> DataFrame:
        return self._all().select(*self.schema.names)

    def of(self, values: list) -> DataFrame:
        """The rows of some partitions; the others' folders are not read."""
        known = F.col(self.by).isin([v for v in values if v is not None])
        hit = known | F.col(self.by).isNull() if None in values else known
        return self._all().where(hit).select(*self.schema.names)

    def values(self, df: DataFrame, key: Column | None = None) -> list:
        """The partitions that rows fall into: buckets or days, so a bounded list."""
        part = self.part if key is None else key
        return [r[0] for r in df.select(part.alias("p")).distinct().collect()]

    # ------------------------------------------------------------ files
    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folder(self, value) -> str:
        return f"{self.by}={NO_VALUE if value is None else value}"

    def folders(self) -> list[str]:
        """Partition folders, from the file listing."""
        root = self._at("x").getParent()
        names = [s.getPath().getName() for s in self._fs().listStatus(root)]
        return sorted(n for n in names if n.startswith(f"{self.by}="))

    # ------------------------------------------------------------ changes
    def recover(self) -> None:
        """Finishes a change whose new rows are whole, and clears one whose rows aren't."""
        fs, pending = self._fs(), self._at("_pending")
        if not fs.exists(pending):
            return
        if fs.exists(self._at("_pending/rows/_SUCCESS")):
            source = fs.open(self._at("_pending/change"))
            change, touched = source.readUTF(), [source.readUTF() for _ in range(source.readInt())]
            source.close()
            self._publish(change, touched)
        fs.delete(pending, True)

    def _publish(self, change: str, touched: list[str]) -> None:
        fs = self._fs()
        left = {s.getPath().getName() for s in fs.listStatus(self._at("_pending/rows"))}
        if any(name in left for name in touched):
            self.spark.read.schema(self._all().schema).parquet(f"{self.path}/_pending/rows") \
                .hint("rebalance", self.by).write.partitionBy(self.by).mode("overwrite") \
                .option("partitionOverwriteMode", "dynamic").parquet(self.path)
        for name in touched:
            if name not in left:
                fs.delete(self._at(name), True)
        fs.create(self._at(f"_applied/{change}")).close()

    def rewrite(self, change: str, touched: list, make: Callable[[DataFrame], DataFrame]) -> None:
        """Replaces the rows of the touched partitions by ``make`` of them.  A change whose name was
        applied before does nothing."""
        self.recover()
        fs = self._fs()
        if not touched or fs.exists(self._at(f"_applied/{change}")):
            return
        out = fs.create(self._at("_pending/change"))
        out.writeUTF(change)
        out.writeInt(len(touched))
        for value in touched:
            out.writeUTF(self._folder(value))
        out.close()
        self._typed(make(self.of(touched))).write.partitionBy(self.by).mode("error") \
            .parquet(f"{self.path}/_pending/rows")
        self._publish(change, [self._folder(v) for v in touched])
        fs.delete(self._at("_pending"), True)


def bucketed(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = BUCKETS) -> PartTable:
    """A table in hash buckets of ``key``."""
    return PartTable(spark, path, schema, "bucket", bucket_of(key, buckets))


def by_day(spark: SparkSession, path: str, schema: T.StructType, ts: str = "scraped_at") -> PartTable:
    """A table in days of ``ts``; rows without a time have a folder of their own."""
    return PartTable(spark, path, schema, "day", day_of(ts))


def merge(table: PartTable, updates: DataFrame, change: str, key: str = "id", order_col: str | None = None) -> None:
    """K2 on the buckets of the updates' keys.  ``table`` is bucketed by ``key``."""
    touched = table.values(updates)
    table.rewrite(change, touched, lambda old: upsert(old, updates, key, order_col))


def replace(table: PartTable, new_children: DataFrame, parents: DataFrame, change: str,
            parent_key: str = "company_id", count_col: str = "n_members") -> None:
    """K3 on the buckets of the parents with a non-empty new list.  ``table`` is bucketed by
    ``parent_key``."""
    touched = table.values(parents.where(F.col(count_col) > 0))
    table.rewrite(change, touched,
                  lambda old: replace_children(old, new_children, parents, parent_key, count_col))


def expire_days(table: PartTable, as_of, change: str, days: int = 30, ts_col: str = "scraped_at") -> None:
    """K5 on a table by day: days before the cutoff go as whole folders, only the day of the cutoff
    is rewritten, and rows without a time stay."""
    table.recover()
    cutoff = table.spark.range(1).select(
        F.timestamp_add("DAY", F.lit(-days), as_of_col(as_of)).cast("date").alias("d")).first().d
    names, last = table.folders(), f"{table.by}={cutoff}"
    for name in names:
        if not name.endswith(NO_VALUE) and name < last:     # ISO days sort as text
            table._fs().delete(table._at(name), True)
    if last in names:
        table.rewrite(change, [cutoff], lambda old: expire(old, as_of, days, ts_col))
