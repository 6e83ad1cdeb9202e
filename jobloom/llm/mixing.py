"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: the sources, in code-point order with null last, weigh 1, 2, 3, 1, 2, 3 ... and share
all words; a target stops at MAX_REPEATS times its source's words and the excess goes to the
other sources by weight until none is above.

Every source is cut into BLOCKS blocks by the leading bits of a hash of its documents: a random
partition, so block numbers are a random permutation of the source.  A mix takes a whole number
of passes over all blocks, then the first blocks of one more pass up to the target, and from the
block where the target falls the documents up to it, found by narrowing the hash range.  The
block quotas of the sources are split among output shards by a tree: at each node the quota of
every source is divided between the halves of the shards by one multivariate hypergeometric draw,
so shards have exact, disjoint quotas.  A shard's blocks follow one another in the permuted order
of each pass, and the shard orders its documents by another hash: the local shuffle.

The driver sees one row for each source and, while the target's block is narrowed, the sums of
BLOCKS cells of each source: a size that doesn't grow with the documents.

Defined cases: a null text has size 0 and is taken in whole passes only (it adds no words); a
null source is a source of its own; rows that are equal in id and text share a hash and are
ordered within it; an empty table gives an empty table; extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

BLOCKS = 4096
BITS = 12                       # of a hash that one level of blocks uses
SHARDS = 64
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = 11


def targets(sizes: list[tuple[str | None, int]], cycle=WEIGHTS,
            repeats: int = MAX_REPEATS) -> dict[str | None, float]:
    """Target words of each source: shares by weight, stopped at ``repeats`` times its size."""
    order = sorted((s for s, _ in sizes), key=lambda s: (s is None, (s or "").encode()))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    size = dict(sizes)
    out: dict[str | None, float] = {}
    free = [s for s in order if size[s] > 0]
    out.update({s: 0.0 for s in order if size[s] <= 0})
    left = float(sum(size.values()))
    while free:
        total = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / total > repeats * size[s]]
        if not above:
            out.update({s: left * weight[s] / total for s in free})
            break
        for s in above:
            out[s] = float(repeats * size[s])
            left -= repeats * size[s]
        free = [s for s in free if s not in out]
    return out


def split_quotas(quota: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources) block counts: each node of a binary tree over the shards divides the
    blocks it holds by a multivariate hypergeometric draw; columns add up to ``quota``."""
    out = np.zeros((shards, len(quota)), np.int64)

    def split(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        n = int(have.sum()) * (mid - lo) // (hi - lo)
        part = rng.multivariate_hypergeometric(have, n, method="marginals") if n else have * 0
        split(lo, mid, part)
        split(mid, hi, have - part)

    split(0, shards, np.asarray(quota, np.int64))
    return out


@dataclass
class Plan:
    """What every source takes: whole passes, once more the documents with a hash below ``cut``
    (of 60 bits), and ``n_at`` of the ``rows_at`` rows whose hash is ``at``."""
    size: dict
    target: dict
    passes: dict
    cut: dict
    at: dict
    n_at: dict
    rows_at: dict
    shards: np.ndarray            # (shards, sources) block quotas
    order: list


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds ``size`` (words of the text) and the 60-bit permutation hash ``_h``."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))
    return docs.withColumn("size", words.cast("long")).withColumn(
        "_h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 4))


def _cells(rows: DataFrame, level: int) -> DataFrame:
    """Words and rows of each cell of the next BITS bits, by source."""
    cell = F.shiftrightunsigned(F.col("_h"), 60 - BITS * (level + 1)).bitwiseAND(BLOCKS - 1)
    return rows.groupBy("source", cell.alias("cell")).agg(
        F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))


def _nearest(rows: DataFrame, order: list, cut: dict, need: dict) -> dict:
    """source -> (size, hash, rows with that hash) of the document beyond the cut whose size is
    nearest to what is left, one aggregate for all sources."""
    pick = [s for s in order if need[s] > 0]
    if not pick:
        return {}
    left, edge = F.lit(None).cast("double"), F.lit(None).cast("long")
    for s in pick:
        here = F.col("source").eqNullSafe(F.lit(s))
        left = F.when(here, F.lit(float(need[s]))).otherwise(left)
        edge = F.when(here, F.lit(cut[s]).cast("long")).otherwise(edge)
    beyond = rows.where((F.col("size") > 0) & (F.col("_h") >= edge))
    best = beyond.groupBy("source").agg(F.min(F.struct(
        F.abs(F.col("size") - left).alias("d"), "_h", "size")).alias("m")).collect()
    best = {r[0]: (int(r[1]["size"]), int(r[1]["_h"])) for r in best}
    counts = {(r[0], r[1]): r[2] for r in rows.where(
        F.col("_h").isin([h for _, h in best.values()])).groupBy("source", "_h").count().collect()}
    return {s: (*v, counts[s, v[1]]) for s, v in best.items()}


def plan(rows: DataFrame, cycle=WEIGHTS, repeats: int = MAX_REPEATS, shards: int = SHARDS,
         seed: int = SEED) -> Plan:
    """Targets, cuts and shard quotas from sums over all ``rows`` (source, size, _h)."""
    size = {r[0]: int(r[1]) for r in rows.groupBy("source").agg(F.sum("size")).collect()}
    target = targets(list(size.items()), cycle, repeats)
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    passes = {s: int(target[s] // size[s]) if size[s] else 0 for s in order}
    need = {s: target[s] - passes[s] * size[s] for s in order}
    cut = {s: 0 for s in order}
    at = {s: -1 for s in order}
    n_at = {s: 0 for s in order}
    rows_at = {s: 0 for s in order}
    todo = [s for s in order if need[s] > 0]
    level = 0
    while todo and level < 60 // BITS:
        near = rows
        if level:
            shift = 60 - BITS * level
            here = F.lit(None)
            for s in todo:
                here = F.when(F.col("source").eqNullSafe(F.lit(s)),
                              F.lit(cut[s] >> shift)).otherwise(here)
            near = rows.where(F.shiftrightunsigned(F.col("_h"), shift) == here)
        sums: dict = {s: [] for s in todo}
        for r in _cells(near, level).collect():
            if r[0] in sums:
                sums[r[0]].append((r[1], int(r[2]), int(r[3])))
        after = []
        for s in todo:
            place = BLOCKS                            # beyond the last cell: all are taken
            for cell, words, n in sorted(sums[s]):
                if words > need[s]:
                    place = cell
                    if n > 1:
                        after.append(s)
                    break
                need[s] -= words
            cut[s] += place << (60 - BITS * (level + 1))
        todo = after
        level += 1
    # What is left is less than the next document: one more is taken if that comes nearer,
    # the one nearest in size.  Rows with equal hashes are equal rows; some of them may do.
    for s, r in _nearest(rows, order, cut, need).items():
        size_at, hash_at, n = r
        want = max(1, int(need[s] // size_at)) if n > 1 else 1
        if abs(want * size_at - need[s]) < need[s]:
            at[s], n_at[s], rows_at[s] = hash_at, min(n, want), n
    last = {s: max(cut[s], at[s] + 1) for s in order}
    blocks = [BLOCKS * passes[s] + (last[s] + (1 << 60 - BITS) - 1 >> 60 - BITS) for s in order]
    quotas = split_quotas(np.array(blocks, np.int64), shards, np.random.default_rng(seed))
    return Plan(size, target, passes, cut, at, n_at, rows_at, quotas, order)


def _by_source(p: Plan, values: dict, kind: str):
    out = F.lit(None).cast(kind)
    for s in p.order:
        out = F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(values[s]).cast(kind)).otherwise(out)
    return out


def placed(rows: DataFrame, p: Plan) -> DataFrame:
    """Adds ``source_size``, ``target``, ``copies`` and ``shards`` (the shard of each copy)."""
    rows = rows.withColumns({
        "source_size": _by_source(p, p.size, "long"), "target": _by_source(p, p.target, "double"),
        "_passes": _by_source(p, p.passes, "int"), "_cut": _by_source(p, p.cut, "long")})
    at = F.col("_h") == _by_source(p, p.at, "long")
    more = (F.col("_h") < F.col("_cut")) | at
    if any(n > p.n_at[s] for s, n in p.rows_at.items()):     # some of several equal rows
        edge = rows.where(at).withColumn("_rank", F.row_number().over(
            Window.partitionBy("source").orderBy("doc_id")))
        rows = rows.where(~at).withColumn("_rank", F.lit(0)).unionByName(edge)
        more = (F.col("_h") < F.col("_cut")) | (
            at & (F.col("_rank") <= _by_source(p, p.n_at, "int")))
    rows = rows.withColumn("copies", F.col("_passes") + F.when(more, 1).otherwise(0))
    # block b of pass k stands at place k * BLOCKS + b of its source's quota; a pass has an
    # order of blocks of its own (an odd factor permutes them; the last, partial one is in order)
    block = F.shiftrightunsigned("_h", 60 - BITS)
    ends = np.cumsum(p.shards, axis=0)
    edges = _by_array(p, {s: ends[:, i].tolist() for i, s in enumerate(p.order)})
    shard = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: F.size(F.filter(
        edges, lambda e: e <= k * BLOCKS + F.when(
            k < F.col("_passes"), (block * (2 * k + 1) + 977 * k) % BLOCKS).otherwise(block))))
    return rows.withColumn("shards", F.when(F.col("copies") > 0, shard)
                           .otherwise(F.array().cast("array<int>"))) \
        .drop("_passes", "_cut", "_rank")


def _by_array(p: Plan, values: dict):
    out = F.array().cast("array<long>")
    for s in p.order:
        out = F.when(F.col("source").eqNullSafe(F.lit(s)),
                     F.array(*[F.lit(int(v)).cast("long") for v in values[s]])).otherwise(out)
    return out


def _mixed(docs: DataFrame, cycle, repeats: int, shards: int, seed: int) -> DataFrame:
    """A row of ``docs`` as ``_row``, with what the mix makes of it."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                      "doc_id", "source", "text")
    full = sized(row, seed)
    narrow = Scratch(docs.sparkSession, "mix").keep(full.select("source", "size", "_h"), "sizes")
    return placed(full, plan(narrow, cycle, repeats, shards, seed))


def mix(docs: DataFrame, cycle=WEIGHTS, repeats: int = MAX_REPEATS, shards: int = SHARDS,
        seed: int = SEED) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``shards`` (columns of
    these names are replaced, all others pass through)."""
    new = ("size", "source_size", "target", "copies", "shards")
    return _mixed(docs, cycle, repeats, shards, seed).select(
        *[F.col(f"_row.`{c}`") for c in docs.columns if c not in new], *new)


def emit(docs: DataFrame, cycle=WEIGHTS, repeats: int = MAX_REPEATS, shards: int = SHARDS,
         seed: int = SEED) -> DataFrame:
    """The mix itself: one row a copy with the columns of ``docs``, one partition a shard (at
    least), shuffled within it."""
    copies = _mixed(docs, cycle, repeats, shards, seed).select(
        "_row", "_h", F.posexplode("shards").alias("_copy", "_shard"))
    key = F.xxhash64(F.lit(seed + 1), "_h", "_copy")
    return (copies.withColumn("_key", key)
            .repartition(shards, "_shard", F.pmod("_key", F.lit(4)))
            .sortWithinPartitions("_shard", "_key").select("_row.*"))
