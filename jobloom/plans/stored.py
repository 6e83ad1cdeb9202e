"""The stored tables (jobs, companies, members) and the search index: written once for a state of
the given tables and of this package, then read by every serving query with declared schemas.

A table is written under a name of its own and renamed when it is whole, so a run that dies half
way blocks nobody, and of two first callers the later one takes the table of the earlier one.
"""

from __future__ import annotations

import functools
import hashlib
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import jobloom
from jobloom.operators import layout, search_index
from jobloom.plans import base, maintenance
from jobloom.session import shared_dir
from jobloom.sources.tables import STORED, read_stored, write_stored

INPUTS = ("orders", "part", "supplier", "customer", "nation")


@functools.cache
def _build() -> str:
    """Names the code that makes the tables: a digest of this package's sources."""
    digest = hashlib.sha256()
    for folder, _, names in sorted(os.walk(os.path.dirname(os.path.abspath(jobloom.__file__)))):
        for name in sorted(n for n in names if n.endswith(".py")):
            with open(os.path.join(folder, name), "rb") as f:
                digest.update(name.encode() + f.read())
    return digest.hexdigest()


def _files(fs, path) -> list[tuple]:
    """(path, length, time) of every file below a path; hidden ones don't count."""
    found, todo = [], [path]
    while todo:
        for s in fs.listStatus(todo.pop()):
            if s.getPath().getName().startswith(("_", ".")):
                continue
            if s.isDirectory():
                todo.append(s.getPath())
            else:
                found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(found)


def state(spark: SparkSession, sf: str) -> str:
    """Names the state of the input files and of the code."""
    jvm, conf, parts = spark._jvm, spark._jsc.hadoopConfiguration(), [_build()]
    for t in INPUTS:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf.rstrip('/')}/{t}.parquet")
        parts += _files(path.getFileSystem(conf), path)
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:24]


def published(spark: SparkSession, folder: str, name: str, write: Callable[[str, str], None]) -> str:
    """The path of a whole table; the run that finds none has ``write(folder, name)`` make it."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    final = path_of(f"{folder}/{name}")
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    done = path_of(final, "_WHOLE")
    if not fs.exists(done):
        own = f"_{name}-{uuid.uuid4().hex}"
        write(folder, own)
        fs.create(path_of(f"{folder}/{own}/_WHOLE")).close()
        if fs.exists(final) and not fs.exists(done):
            fs.delete(final, True)                   # left by a run that died
        if not fs.exists(final):
            fs.rename(path_of(f"{folder}/{own}"), final)
        fs.delete(path_of(f"{folder}/{own}"), True)  # another caller was first
    return final.toString()


def store(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One stored table."""
    build = {"jobs": maintenance.enriched_store, "companies": base.companies,
             "members": base.members}[name]
    folder = shared_dir(spark, f"jobloom/store-{state(spark, sf)}")
    published(spark, folder, name, lambda at, own: write_stored(build(spark, sf), at, own, name))
    return read_stored(spark, folder, name)


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    return store(spark, sf, "jobs")


def companies(spark: SparkSession, sf: str) -> DataFrame:
    return store(spark, sf, "companies")


def members(spark: SparkSession, sf: str) -> DataFrame:
    return store(spark, sf, "members")


def job_index(spark: SparkSession, sf: str) -> str:
    """The folder of the search index over the stored jobs."""
    folder = shared_dir(spark, f"jobloom/store-{state(spark, sf)}")
    return published(spark, folder, "job-index",
                     lambda at, own: search_index.add(jobs(spark, sf), f"{at}/{own}"))


# The columns that lookups go by.
CLUSTERED = {"jobs": ["company_id", "id", "posted_date"], "members": ["company_id", "id", "country"]}


def clustered(spark: SparkSession, sf: str, name: str, wanted: dict) -> DataFrame:
    """The rows of a stored table whose columns lie within ``wanted``, from its clustered copy."""
    folder = shared_dir(spark, f"jobloom/store-{state(spark, sf)}")
    path = published(spark, folder, f"{name}-clustered", lambda at, own: layout.write(
        store(spark, sf, name), f"{at}/{own}", CLUSTERED[name]))
    return layout.lookup(spark, path, STORED[name], CLUSTERED[name], wanted)
