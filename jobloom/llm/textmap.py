"""Shared Spark plumbing: per-text Arrow maps, bounded labelled samples, id hashes."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import blocks

SAMPLE_MAX_CHARS = 200_000
HASHES = 1 << 60                 # the sample's hashes of keys


def fresh(name: str, docs: DataFrame) -> str:
    """A column name that ``docs`` doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def crc_mod(column: str, m: int) -> Column:
    """crc32 of a column written as text, modulo ``m`` (null for a null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % m


def held_out(column: str, m: int, rest: int) -> Column:
    """Rows never learned from; a null id can't be placed, so it is held out as well."""
    return F.coalesce(crc_mod(column, m) == rest, F.lit(True))


def map_texts(docs: DataFrame, text: str, fields: list[T.StructField],
              make: Callable[[], Callable], keep_text: bool = True) -> DataFrame:
    """Adds ``fields`` computed by numpy from the bytes of each whole text.

    ``make()`` runs once per task and returns f(data, offsets, rows) -> list of arrays, one
    per field, for a block of whole rows (see words.blocks).  Input columns named like a
    new field are replaced.  With ``keep_text`` false the text doesn't travel back.
    """
    names = {f.name for f in fields}
    if text in names:
        raise ValueError(f"an output column may not be named as the text column {text!r}")
    extra = [f for f in docs.schema.fields if f.name not in names and f.name != text]
    inputs = [*extra, docs.schema[text]]
    kept = inputs if keep_text else extra
    keep_n = len(kept)
    docs = docs.select(*[F.col(f"`{f.name}`") for f in inputs])

    def run(batches):
        work = make()
        for rows, data, offsets in blocks(batches, text):
            new = [x if isinstance(x, pa.Array) else pa.array(x)
                   for x in work(data, offsets, rows)]
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(i) for i in range(keep_n)), *new],
                names=[*(rows.schema.names[:keep_n]), *(f.name for f in fields)])

    return docs.mapInArrow(run, T.StructType([*kept, *fields]))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, key: str, per_label: int,
                    max_chars: int = SAMPLE_MAX_CHARS, text: str = "text") -> list[tuple]:
    """At most ``per_label`` rows of each label as [(text, label)], chosen by a hash of the key.

    Each label gives the ``per_label`` keys with its smallest hashes, however often a key repeats,
    so the choice doesn't depend on any order; a key with several labels counts for the smallest, one
    with several texts gives the smallest.  The bound: ``per_label`` keys of each label, no text
    longer than ``max_chars``; neither the keys that go to the executors nor the texts that come to
    the driver grow with the tables.  ``labels`` has key and label and may be ``docs`` itself.
    """
    rows = (labels.select(key, label).where(F.col(key).isNotNull() & F.col(label).isNotNull())
            .groupBy(key).agg(F.min(label).alias(label)))
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return []
    place = F.xxhash64(F.col(key).cast("string"), F.lit(7)).bitwiseAND(F.lit(HASHES - 1))
    # twice the wanted keys and some lie below a label's bound, so few rows reach its task
    bound = F.lit(0)
    for value, n in sorted(counts.items(), key=lambda x: str(x[0])):
        bound = F.when(F.col(label) == F.lit(value),
                       F.lit(min(HASHES, (2 * per_label + 60) * HASHES // n))).otherwise(bound)
    first = Window.partitionBy(label).orderBy("_p", key)
    ids = {r[0]: r[1] for r in rows.withColumn("_p", place).where(F.col("_p") < bound)
           .withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= per_label)
           .select(key, label).collect()}
    few = docs.sparkSession.createDataFrame([(k,) for k in ids], f"{key} long")
    got = (docs.select(key, text).where(F.col(text).isNotNull()
                                        & (F.char_length(text) <= max_chars))
           .join(F.broadcast(few), key, "left_semi").groupBy(key).agg(F.min(text)).collect())
    return [(t, ids[k]) for k, t in sorted((r[0], r[1]) for r in got)]
