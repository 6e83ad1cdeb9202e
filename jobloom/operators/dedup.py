"""Greedy three-key de-duplication (D1-D5) as a distributed fixed point.

Semantics (sequential reference): visit rows newest ``scraped_at`` first,
ties in input order; drop a row when its id, fuzzy key or non-empty URL
equals that of an already *kept* row.  The result is the lexicographically
first maximal independent set of the "shares a key" graph, which we compute
in rounds without ever materialising the graph:

* state ``E``: one row per (undecided job, key) — at most three per job;
* jobs that share no key with any other are kept outright and never enter the loop;
* a job is kept when it holds the best priority in every one of its key
  groups (partial aggregation ``min`` per group, then a count per job);
* every undecided job sharing a group with a kept job is dropped;
* after PLAIN such rounds, a job with a single better undecided neighbour is kept exactly if that
  one isn't, so chains of such jobs are decided at once by pointer doubling over the composed
  keep/drop flips, whatever their length;
* repeat until nothing is undecided.  Each round's state is written as Parquet
  to the shared checkpoint folder so lineage stays short and a lost executor
  only recomputes one round.

No group is ever collected: hot keys (one company or URL holding a third of
the rows) are handled by map-side group limits, partial aggregation and AQE's skew-join
split of the semi join.  Rows are never dropped to save work.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Window, functions as F

from jobloom.functions.text import fuzzy_key
from jobloom.session import checkpoint_dir, discard, materialize

KEY_ID, KEY_FUZZY, KEY_URL = 0, 1, 2
PLAIN = 8                 # rounds without pointer doubling
JUMPS = 3                 # pointer doublings in one job


@dataclass
class DedupStats:
    """K8 counters of one run."""
    input_rows: int = 0
    kept_rows: int = 0
    rounds: int = 0

    @property
    def duplicates(self) -> int:
        return self.input_rows - self.kept_rows


def priority(ts_col: str = "scraped_at", order_col: str = "seq"):
    """Newest first, ties by input order; a missing time sorts last."""
    neg = F.coalesce(-F.unix_micros(F.col(ts_col).cast("timestamp")),
                     F.lit(9223372036854775807))
    return F.struct(neg.alias("t"), F.col(order_col).cast("long").alias("o"))


def key_rows(jobs: DataFrame, ts_col="scraped_at", order_col="seq",
             id_col="id", url_col="url", fuzzy_col=None) -> DataFrame:
    """One row per (job, non-null key): (o, p, kt, kv); a job without keys has one with nulls.

    ``p`` is one unique long per job that sorts like the priority (newest
    first, then input order): a global range-partitioned sort followed by
    ``monotonically_increasing_id`` (increasing across sorted partitions),
    shifted left by two bits to hold the job's number of keys.  All later
    aggregates are then plain hash aggregates on longs.
    """
    fz = F.col(fuzzy_col) if fuzzy_col else fuzzy_key("company", "title")
    url = F.nullif(F.col(url_col), F.lit(""))  # D4: '' and null never match
    keys = F.array(
        F.struct(F.lit(KEY_ID).alias("kt"), F.col(id_col).alias("kv")),
        F.struct(F.lit(KEY_FUZZY).alias("kt"), fz.alias("kv")),
        F.struct(F.lit(KEY_URL).alias("kt"), url.alias("kv")))
    keys = F.filter(keys, lambda k: k.kv.isNotNull())
    base = jobs.select(priority(ts_col, order_col).alias("pr"), keys.alias("keys"))
    ordered = base.orderBy("pr.t", "pr.o").withColumn("_r", F.monotonically_increasing_id())
    p = F.shiftleft(F.col("_r"), 2) + F.size("keys")
    return ordered.select(F.col("pr.o").alias("o"), p.alias("p"), F.explode_outer("keys").alias("k")) \
        .select("o", "p", "k.kt", "k.kv")


def _fates(e: DataFrame) -> DataFrame:
    """One round: (p, o, won, hit) of every undecided job, by hash aggregates on longs.

    ``won``: the job is best in all its groups and is kept; ``hit``: a kept job (itself or
    another) is in one of its groups, so it is decided.
    """
    winners = e.groupBy("kt", "kv").agg(F.min("p").alias("w"))
    kept = (winners.groupBy("w").agg(F.count(F.lit(1)).alias("wins"))
            .where(F.col("wins") == F.col("w").bitwiseAND(3)).select(F.col("w").alias("kw")))
    groups = (winners.join(kept, F.col("w") == F.col("kw"), "left")
              .select("kt", "kv", "w", F.col("kw").isNotNull().alias("gk")))
    return e.join(groups, ["kt", "kv"]).groupBy("p").agg(
        F.max("o").alias("o"), F.max(F.col("gk") & (F.col("w") == F.col("p"))).alias("won"),
        F.max("gk").alias("hit"))


def _standing(e: DataFrame) -> DataFrame:
    """(p, o, best, other) of every undecided job: its best undecided neighbour that comes before it
    (null: none, it is kept), and whether it has another one.

    In a group only the first two jobs can have at most one better neighbour; both are top-k rows,
    limited before the shuffle.
    """
    by = Window.partitionBy("kt", "kv").orderBy("p")
    two = (e.select("kt", "kv", "p").withColumn("_rn", F.row_number().over(by)).where("_rn <= 2")
           .groupBy("kt", "kv").agg(F.min("p").alias("m1"), F.max("p").alias("m2")))
    better = F.when(F.col("p") > F.col("m1"), F.col("m1"))
    return e.join(two, ["kt", "kv"]).groupBy("p").agg(
        F.max("o").alias("o"), F.min(better).alias("best"),
        (F.bool_or(F.col("p") > F.col("m2"))
         | F.coalesce(F.min(better) < F.max(better), F.lit(False)))
        .alias("other"))


def _chains(fates: DataFrame) -> DataFrame:
    """(p, o, to, flip, root): where the chain of single better neighbours leads from a job that has
    none or one.  It is kept if ``root AND NOT flip``.

    A job with a single better neighbour is kept if and only if that one isn't, so a step along the
    chain flips keep and drop.  Steps are composed by pointer doubling, JUMPS doublings a written
    table; a chain of n jobs takes about log2(n) / JUMPS of them.  ``root`` is false where the chain ends
    at a job that is still open.
    """
    now = fates.where("NOT other").select(
        "p", "o", F.coalesce("best", "p").alias("to"), F.col("best").isNotNull().alias("flip"),
        F.col("best").isNull().alias("root"))
    last = None
    while True:
        for _ in range(JUMPS):
            step = now.select(F.col("p").alias("to"), F.col("to").alias("_to"),
                              F.col("flip").alias("_flip"), F.col("root").alias("_root"))
            now = now.join(step, "to", "left").select(
                "p", "o", F.coalesce("_to", "to").alias("to"),
                (F.col("flip") != F.coalesce("_flip", F.lit(False))).alias("flip"),
                F.coalesce("_root", "root").alias("root"),
                F.coalesce(F.col("_to") != F.col("to"), F.lit(False)).alias("moved"))
        seen = Observation()
        now = materialize(now.observe(seen, F.count_if("moved").alias("n")), "dedup-chains")
        if last is not None:
            discard(last)
        if not seen.get.get("n"):
            return now
        last = now


def greedy_dedup(jobs: DataFrame, ts_col: str = "scraped_at", order_col: str = "seq",
                 id_col: str = "id", url_col: str = "url", fuzzy_col: str | None = None,
                 stats: DedupStats | None = None) -> DataFrame:
    """Keep the greedy-first row of every duplicate cluster.

    ``order_col`` must be unique (input order).  Returns the kept input rows.  Every round decides at
    least the best job of each open cluster, so the rounds end.  ``kept_keys`` of the result is the
    written table of the kept jobs' ``order_col``.
    """
    spark = jobs.sparkSession
    checkpoint_dir(spark)
    first = materialize(key_rows(jobs, ts_col, order_col, id_col, url_col, fuzzy_col), "dedup-keys")
    # Jobs without any key, and jobs that are alone in all their groups, are kept outright.
    keyed = first.where("kt IS NOT NULL")
    shared = keyed.groupBy("kt", "kv").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    contested = keyed.join(shared, ["kt", "kv"], "left_semi").select("p").distinct()
    e = materialize(keyed.join(contested, "p", "left_semi"), "dedup-open")
    everyone = first.select("o").distinct()
    tables = [first, e]
    kept_parts = [everyone.join(e.select("o"), "o", "left_anti")]
    rounds = 0
    left = not e.isEmpty()
    while left:
        # most clusters end within a few plain rounds; what is left then are chains
        if rounds < PLAIN:
            made = materialize(_fates(e), "dedup-round")
            tables.append(made)
            kept_parts.append(made.where("won").select("o"))
            after = e.join(made.where("NOT hit"), "p", "left_semi")
        else:
            fates = materialize(_standing(e), "dedup-round")
            made = _chains(fates)
            discard(fates)
            tables.append(made)
            kept = made.where("root AND NOT flip")
            kept_parts.append(kept.select("o"))
            # groups of kept jobs: all their members are decided
            won = e.join(kept.select("p"), "p", "left_semi").select("kt", "kv").distinct()
            hit = e.join(won, ["kt", "kv"], "left_semi").select("p").distinct()
            after = e.join(hit, "p", "left_anti")
        seen = Observation()
        last, e = e, materialize(after.observe(seen, F.count(F.lit(1)).alias("n")), "dedup-open")
        left = bool(seen.get.get("n"))
        # the first table of open keys also tells who was alone; later ones are done with
        if rounds:
            discard(last)
        rounds += 1
    if rounds:
        tables.append(e)
    kept_all = materialize(functools.reduce(DataFrame.unionByName, kept_parts), "dedup-kept")
    if stats is not None:
        stats.rounds = rounds
        stats.input_rows = everyone.count()
        stats.kept_rows = kept_all.count()
    # one long for a kept job is all that a later plan reads
    for done in tables:
        discard(done)
    out = jobs.join(kept_all.withColumnRenamed("o", "_o"),
                    F.col(order_col).cast("long") == F.col("_o"), "left_semi")
    out.kept_keys = kept_all
    return out


def exact_id_dedup(jobs: DataFrame, id_col: str = "id", ts_col: str = "scraped_at",
                   order_col: str = "seq") -> DataFrame:
    """D2 alone: one row per id, the newest (ties: input order); the group limit of
    ``row_number() = 1`` works before the shuffle."""
    w = Window.partitionBy(id_col).orderBy(F.col(ts_col).desc_nulls_last(), F.col(order_col))
    return jobs.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
