"""Intermediate tables in the shared folder of the cluster, dropped when a job is past them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobloom.session import shared_dir, shuffles_released


class Scratch:
    """Written tables of one job under ``spark.checkpoint.dir`` (see session.checkpoint_dir)."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = shared_dir(spark, f"jobloom/{name}-{uuid.uuid4().hex}")
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.base}/{self._n}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and reads it back: lineage ends here, on files all executors share."""
        at = self.path(name)
        schema = df.schema
        with shuffles_released(self.spark):
            df.write.parquet(at)
        out = self.spark.read.schema(schema).parquet(at)
        out._scratch_path = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
