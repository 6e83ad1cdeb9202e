"""Spark session construction and the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import os
import tempfile

from pyspark.sql import SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Session settings every job relies on.  AQE re-plans joins at run time
# (size-checked broadcast of small sides, split of skewed partitions,
# coalescing of small shuffle partitions).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "jobloom",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k, v in conf.items():
        if not k.startswith("spark.driver") and not k.startswith("spark.executor"):
            try:
                spark.conf.set(k, v)
            except Exception:  # static conf of an already running session
                pass
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, configuring it if needed.

    On a cluster the folder comes from ``spark.checkpoint.dir`` (a shared
    file system).  Only when the session names none (local tests) do we
    create a private one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder")
        configured = tempfile.mkdtemp(prefix="jobloom-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint area for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


@contextlib.contextmanager
def shuffles_released(spark: SparkSession):
    """Shuffle files of the jobs run inside go when their job ends, not when the driver
    happens to collect garbage; what follows reads the written tables."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialize(df, name: str = "stage"):
    """Cut lineage: write ``df`` once as Parquet to the shared checkpoint folder
    and read it back.  Survives executor loss (the files live on the shared
    file system) and, unlike an eager ``checkpoint()``, computes the plan once.
    """
    import uuid
    spark = df.sparkSession
    path = shared_dir(spark, f"jobloom/{name}-{uuid.uuid4().hex}")
    with shuffles_released(spark):
        df.write.mode("error").option("compression", "zstd").parquet(path)
    out = spark.read.parquet(path)
    out._materialized_at = path
    return out


def discard(df) -> None:
    """Deletes the files of a table from ``materialize`` that no later plan reads."""
    remove(df.sparkSession, df._materialized_at)


def release_shuffles(df) -> None:
    """Deletes the shuffle files behind a micro-batch that has been written: they are of the
    stream's own job, which ``shuffles_released`` doesn't reach."""
    df._jdf.queryExecution().toRdd().cleanShuffleDependencies(True)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, so that Python workers import it wherever the driver
    was started.  Local masters share the driver's path already through PYTHONPATH or not at
    all, so it is sent there as well."""
    import zipfile
    sc = spark.sparkContext
    if getattr(sc, "_jobloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="jobloom-pkg-"), "jobloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("jobloom", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._jobloom_shipped = True
