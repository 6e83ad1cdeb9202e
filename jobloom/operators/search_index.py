"""F4 with an index: trigram posting lists, candidates from the rarest trigrams, then the exact LIKE.

An index is a folder of two tables.  ``rows`` holds the indexed rows with a number ``doc``, in one
folder for each task that wrote them (``part``).  ``postings`` holds, for each trigram of the
lower-cased searched fields, blocks of the documents that have it: the gaps between the sorted
numbers of a block of 2**BLOCK_BITS documents, dealt to SHARDS folders by a hash of the trigram and
sorted by it; a block's list of a trigram may lie in several rows.  A search reads the folders of its
trigrams only (partition filter), in them the row groups of its trigrams (pushed filter), and of the
rows only the folders with candidates.

A search term is a LIKE pattern between two '%': its trigrams are those of the literal runs between
wildcards.  A term without a run of three letters can't use the index and scans the rows.  The exact
LIKE decides at the end, so an index may know rows that are gone: they don't come back.

``add`` appends a generation: new rows are indexed without touching what is there.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from jobloom.functions.text import ascii_lower
from jobloom.operators import serve
from jobloom.session import materialize

FIELDS = ("title", "company", "description")
SHARDS = 64
BLOCK_BITS = 14           # documents of a posting block: 2**14
RUN_CHARS = 4_000_000     # letters whose posting lists are made at once
RAREST = 3                # trigrams whose lists are intersected
POSTINGS = "gram string, block long, n int, gaps array<int>, gen int, shard int"


def _shard(gram):
    return F.pmod(F.xxhash64(gram), F.lit(SHARDS)).cast("int")


def _flush(texts: list[pa.Array], local: np.ndarray, block: int) -> pa.RecordBatch:
    """The posting lists of some documents of a block; ``texts`` has an array for each field."""
    grams, owners = [], []
    for column in texts:
        size = pc.utf8_length(column).to_numpy(zero_copy_only=False)
        chars = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(size)), size)
        whole = owner[:-2] == owner[2:]                 # three letters of one text
        grams.append(((chars[:-2] << 42) | (chars[1:-1] << 21) | chars[2:])[whole])
        owners.append(local[owner[:-2][whole]])
    known, gram = np.unique(np.concatenate(grams), return_inverse=True)
    pairs = np.unique((gram.astype(np.int64) << BLOCK_BITS) | np.concatenate(owners))
    gram, doc = pairs >> BLOCK_BITS, pairs & ((1 << BLOCK_BITS) - 1)
    n = np.bincount(gram, minlength=len(known))
    gaps = np.diff(doc, prepend=0)
    first = (np.cumsum(n) - n)
    gaps[first] = doc[first]
    letters = np.stack([known >> 42, (known >> 21) & 0x1FFFFF, known & 0x1FFFFF], 1).astype("<u4")
    letters = letters.tobytes().decode("utf-32-le")
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)), pa.int32()), pa.array(gaps, pa.int32()))
    return pa.RecordBatch.from_arrays(
        [pa.array([letters[i:i + 3] for i in range(0, len(letters), 3)], pa.string()),
         pa.array(np.full(len(known), block), pa.int64()), pa.array(n, pa.int32()), lists],
        names=["gram", "block", "n", "gaps"])


def _posting_lists(batches):
    """(gram, block, n, gaps) from batches of ``doc`` and lower-cased fields.  Documents come in the
    order they were written in, so a block's lists are made of a few runs of it; a run ends with its
    block or with RUN_CHARS letters."""
    held, chars, at = [], 0, None

    def flush():
        doc = np.concatenate([h.column(0).to_numpy() for h in held])
        texts = [pa.concat_arrays([h.column(c) for h in held]) for c in range(1, held[0].num_columns)]
        return _flush(texts, doc & ((1 << BLOCK_BITS) - 1), at)
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column(0).to_numpy() >> BLOCK_BITS
        size = sum(pc.utf8_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64)
                   for c in range(1, batch.num_columns))
        upto = np.cumsum(size)
        new = np.flatnonzero((np.diff(block) != 0) | (np.diff(upto // RUN_CHARS) != 0)) + 1
        cuts = [0, *new.tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            if held and (block[i] != at or chars >= RUN_CHARS):
                yield flush()
                held, chars = [], 0
            held.append(batch.slice(i, j - i))
            at, chars = int(block[i]), chars + int(size[i:j].sum())
    if held:
        yield flush()


def add(rows: DataFrame, folder: str, fields=FIELDS, generation: int = 0) -> None:
    """Indexes ``rows`` as one generation of the index in ``folder``.

    Rows are numbered as they are written and the postings are made from the written rows, so a
    task that runs again can't number them anew.
    """
    spark = rows.sparkSession
    at = f"{folder}/rows/gen={generation}"
    # an empty file with the columns, as no row may be there to tell them
    rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{folder}/columns")
    numbered = rows.withColumn("doc", F.monotonically_increasing_id())
    numbered.withColumn("part", F.shiftright("doc", 33).cast("int")).write.partitionBy("part").parquet(at)
    texts = spark.read.schema(numbered.schema).parquet(at).select(
        "doc", *[ascii_lower(F.coalesce(F.col(c), F.lit(""))).alias(f"f{i}") for i, c in enumerate(fields)])
    lists = texts.mapInArrow(_posting_lists, "gram string, block long, n int, gaps array<int>")
    (lists.withColumn("shard", _shard("gram"))
     .repartition("shard", F.pmod(F.xxhash64("gram", "block"), F.lit(4)))
     .sortWithinPartitions("shard", "gram", "block")
     .write.partitionBy("shard").parquet(f"{folder}/postings/gen={generation}"))


def term_trigrams(q: str) -> list[str]:
    """Trigrams that every match of the term holds: those of its literal runs."""
    low = q.translate({c: c + 32 for c in range(65, 91)})
    runs = re.split("[%_]", low)
    return sorted({run[i:i + 3] for run in runs for i in range(len(run) - 2)})


def posting_blocks(spark: SparkSession, folder: str, grams: list[str]) -> DataFrame:
    """The posting blocks of some trigrams; only their shards are listed and read."""
    # the same hash as the writer's, evaluated once for the few trigrams of a term
    shards = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string")
              .select(_shard("gram")).distinct().collect()]
    return (spark.read.schema(POSTINGS).parquet(f"{folder}/postings")
            .where(F.col("shard").isin(shards) & F.col("gram").isin(grams)))


def _in_all(lists: int):
    """Of the posting lists of a block (``lists`` trigrams): a bit for each document that is in all."""
    def run(key, table):
        gaps, seen = table.column("gaps").combine_chunks(), np.zeros(1 << BLOCK_BITS, np.int64)
        for i in range(len(gaps)):
            seen[np.cumsum(gaps[i].values.to_numpy(zero_copy_only=False))] += 1
        bits = np.packbits(seen == lists, bitorder="little").view("<i8")
        gen, block = (k.as_py() for k in key)
        hit = [(gen, block, bits)] if bits.any() else []
        return pa.table({"gen": pa.array([h[0] for h in hit], pa.int32()),
                         "block": pa.array([h[1] for h in hit], pa.int64()),
                         "bits": pa.array([h[2] for h in hit], pa.list_(pa.int64()))})
    return run


def candidates(spark: SparkSession, folder: str, grams: list[str]) -> DataFrame | None:
    """(gen, block, bits) of the rows that have the rarest of the trigrams, a bit for each row of a
    block; None if a trigram is unknown."""
    sizes = {r[0]: r[1] for r in posting_blocks(spark, folder, grams).groupBy("gram")
             .agg(F.sum("n")).collect()}
    if len(sizes) < len(grams):
        return None
    rare = sorted(grams, key=lambda g: (sizes[g], g))[:RAREST]
    return posting_blocks(spark, folder, rare).select("gen", "block", "gaps").groupBy("gen", "block") \
        .applyInArrow(_in_all(len(rare)), "gen int, block long, bits array<long>")


def indexed_rows(spark: SparkSession, folder: str) -> DataFrame:
    columns = spark.read.parquet(f"{folder}/columns").schema
    return spark.read.schema(columns.add("doc", "long").add("gen", "integer").add("part", "integer")) \
        .parquet(f"{folder}/rows")


def search(spark: SparkSession, folder: str, q: str, min_team: int = 0,
           fields=FIELDS) -> DataFrame:
    """the rows that match, as ``serve.search`` finds them without an index."""
    rows = indexed_rows(spark, folder)
    grams = term_trigrams(q)
    if grams:
        found = candidates(spark, folder, grams)
        if found is None:
            rows = rows.where(F.lit(False))
        else:
            # a bit for each row: rows meet them by block, not one by one
            found = materialize(found, "candidates")
            # as many as folders of rows at most
            where = [(r[0], r[1]) for r in found.select(
                "gen", F.shiftright("block", 33 - BLOCK_BITS).cast("int")).distinct().collect()]
            rows = rows.where(F.col("gen").isin(sorted({g for g, _ in where}))
                              & F.col("part").isin(sorted({p for _, p in where}))) \
                .withColumn("block", F.shiftright("doc", BLOCK_BITS)).join(found, ["gen", "block"])
            bit = F.expr("shiftright(get(bits, cast(shiftright(doc, 6) & 255 as int)), cast(doc & 63 as int)) & 1")
            # the term is looked for in candidates only, not in all rows below the join
            rows = rows.select(*[F.when(bit == 1, F.col(c)).alias(c) if c in fields else F.col(c)
                                 for c in rows.columns]).where(bit == 1)
    return serve.search(rows, q, min_team, fields).drop("gen", "part", "doc", "block", "bits")
