"""Hard negatives by lists that the anchors of a cluster share (the MAXIMUS way).

Anchors are clustered by angle.  For a cluster with centroid c, whose members lie within the angle
w of it, a candidate i can't score more with a member a than |a| |i| cos(max(0, angle(i, c) - w)).
The factor besides |a| is the same for all members: candidates are sorted by it once for each
cluster, and every member walks that list from the top until what it still lacks is certain not to
come: the bound of the next candidate lies below its worst kept score, or below its score window.

The candidates are dealt into blocks by a hash, about BLOCK_ROOTS times the root of their number
each; all anchors meet every block, block by block, a cluster's members MEMBERS at a time.  The
first pass finds each anchor's positives (the list of its own label), the second its negatives
(rows of other labels) in the score windows of its positives.  A block hands back the few best of
each anchor; their final choice is a top-k by window.  Where vectors have no structure the bounds
part little and the walk ends with the list: the work is anchors times rows, as products of blocks.

Defined cases: rows without id, label or vector, or with a null or non-finite component, take no
part; rows that agree in id, label and vector are one row; other rows with one id are different
rows, in ties ordered by id and then by a hash of label and vector; shorter vectors count as filled
up with zeros; an anchor without positives, or whose windows hold no row, gives no row; a positive
with a negative score has an empty window; an empty table gives an empty table; extra columns are
not read.  Scores are exact below 2**53.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

CLUSTERS = 16
SAMPLE = 4096              # anchors that the centroids are fitted on, those with the smallest hashes
BLOCK_ROOTS = 16
MEMBERS = 256
FIRST, MOST = 256, 4096    # rows of a list that are looked at together


def quantised(docs: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, label, v, mark) of the rows that take part; v holds floor(scale * x)."""
    usable = F.exists(vector, lambda x: x.isNull() | F.isnan(x)
                      | (F.abs(x.cast("double")) == float("inf")))
    return docs.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()
                      & F.col(vector).isNotNull() & ~usable).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"),
        F.xxhash64("label", vector).alias("mark"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == dim).all():
        return flat.reshape(len(size), dim)
    out = np.zeros((len(size), dim))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def centroids(sample: np.ndarray, k: int = CLUSTERS, rounds: int = 5) -> np.ndarray:
    """Unit centroids by spherical k-means from the first k vectors; a zero vector has no angle."""
    unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
    middle = unit[:k].copy()
    for _ in range(rounds if len(unit) > k else 0):
        best = (unit @ middle.T).argmax(1)
        for j in range(len(middle)):
            total = unit[best == j].sum(0)
            size = np.linalg.norm(total)
            if size > 0:
                middle[j] = total / size
    return middle


def angles(v: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """(rows, centroids) angles; a zero vector counts as lying on every centroid."""
    size = np.linalg.norm(v, axis=1, keepdims=True)
    cos = (v @ middle.T) / np.maximum(size, 1e-300)
    return np.where(size > 0, np.arccos(np.clip(cos, -1, 1)), 0.0)


def _best(score, ids, marks, k):
    return np.lexsort((marks, ids, -score))[:k]


class Found:
    """What a member has kept: the best ``k`` rows in each of its score windows."""

    def __init__(self, windows: list[tuple[float, float]], k: int):
        self.windows, self.k = windows, k
        self.worst = [low for low, _ in windows]
        self.full = [False] * len(windows)
        self.score = np.zeros(0)
        self.at = np.zeros(0, np.int64)

    def least(self) -> float:
        """No row below this score is wanted any more."""
        return min(self.worst, default=math.inf)

    def add(self, score, at, ids, marks) -> None:
        """Rows of the block at ``at`` are offered; those that aren't among the best go."""
        top = max((high for _, high in self.windows), default=-math.inf)
        wanted = (score >= self.least()) & (score <= top)
        if not wanted.any():
            return
        score = np.concatenate([self.score, score[wanted]])
        at = np.concatenate([self.at, at[wanted]])
        keep = np.zeros(len(at), bool)
        for j, (low, high) in enumerate(self.windows):
            own = np.flatnonzero((score >= max(low, self.worst[j])) & (score <= high))
            own = own[_best(score[own], ids[at[own]], marks[at[own]], self.k)]
            keep[own] = True
            if len(own) == self.k:
                self.worst[j], self.full[j] = score[own].min(), True
        self.score, self.at = score[keep], at[keep]

    def certain(self, bound: float) -> bool:
        """No row that scores ``bound`` or less can change what is kept."""
        return all(bound < worst for worst in self.worst)


def walk(rows: np.ndarray, order: np.ndarray, key: np.ndarray, members: np.ndarray,
         found: list[Found], allowed, ids, marks) -> int:
    """Every member walks the list ``order`` (by falling ``key``) until it is certain.

    ``allowed(member, at)`` masks the rows that a member may take.  Returns the products made.
    """
    size = np.linalg.norm(members, axis=1)
    active = [m for m, f in enumerate(found) if f.windows]
    at, width, made = 0, FIRST, 0
    while at < len(order):
        # a hair above the bound, for the rounding of angles
        bound = size * (key[order[at]] + 1e-9 * abs(key[order[at]])) + 1e-6
        active = [m for m in active if not found[m].certain(bound[m])]
        if not active:
            break
        part = order[at:at + width]
        scores = rows[part].astype(np.float64) @ members[active].T
        made += scores.size
        for j, m in enumerate(active):
            s = scores[:, j]
            may = np.flatnonzero(s >= found[m].least())
            may = may[allowed(m, part[may])]
            found[m].add(s[may], part[may], ids, marks)
        at += width
        width = min(2 * width, MOST)
    return made


_MET = "anchor_id long, anchor_mark long, vec_id long, mark long, score double"


def _meet(dim: int, middle: np.ndarray, reach: np.ndarray, k: int, own_label: bool):
    """Rows of a block (kind 0) come first, then the anchors (kind 1) by cluster and label."""
    def block(parts):
        ids, marks, labels = (np.concatenate([p[i] for p in parts]) for i in range(3))
        v = np.concatenate([p[3] for p in parts])
        first = np.unique(np.stack([ids, marks]), axis=1, return_index=True)[1]
        ids, marks, labels, v = ids[first], marks[first], labels[first], v[first]
        return ids, marks, labels, v, np.linalg.norm(v, axis=1), angles(v, middle)

    def ranked(held, cluster, label):
        ids, marks, labels, v, size, angle = held
        key = size * np.cos(np.maximum(0.0, angle[:, cluster] - reach[cluster]))
        at = np.flatnonzero(labels == label) if own_label else np.arange(len(ids))
        return key, at[np.argsort(-key[at], kind="stable")]

    def answers(held, listed, anchors):
        ids, marks, labels, v, _, _ = held
        key, order = listed
        out = []
        for i in range(0, len(anchors), MEMBERS):
            group = anchors[i:i + MEMBERS]
            found = [Found(a[4], k) for a in group]

            def allowed(m, at):
                a = group[m]
                if own_label:
                    return ~((ids[at] == a[0]) & (marks[at] == a[1]))
                return labels[at] != a[2]
            walk(v, order, key, np.stack([a[3] for a in group]), found, allowed, ids, marks)
            out += [(np.full(len(f.at), a[0]), np.full(len(f.at), a[1]), ids[f.at], marks[f.at],
                     f.score) for a, f in zip(group, found) if len(f.at)]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c)) for c in zip(*out)],
                names=["anchor_id", "anchor_mark", "vec_id", "mark", "score"])

    def run(batches):
        now, parts, held, listed, of, anchors = None, [], None, None, None, []
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            chunk, kind, cluster, ids, marks, labels = (
                cols[n].to_numpy(zero_copy_only=False)
                for n in ("chunk", "kind", "cluster", "vec_id", "mark", "label"))
            v = _matrix(cols["v"], dim)
            lows, highs = cols["lows"].to_pylist(), cols["highs"].to_pylist()
            cuts = [0, *(np.flatnonzero((np.diff(chunk) != 0) | (np.diff(kind) != 0)
                                        | (np.diff(cluster) != 0) | (np.diff(labels) != 0)) + 1),
                    len(chunk)]
            for x, y in zip(cuts[:-1], cuts[1:]):
                if kind[x] == 0:
                    if chunk[x] != now:
                        if anchors:
                            yield from answers(held, listed, anchors)
                        now, parts, held, of, anchors = chunk[x], [], None, None, []
                    parts.append((ids[x:y], marks[x:y], labels[x:y], v[x:y].astype(np.float32)
                                  if np.abs(v[x:y]).max(initial=0) < 1 << 24 else v[x:y]))
                    continue
                if chunk[x] != now:
                    continue                                  # a block without rows
                if held is None:
                    held = block(parts)
                if of != (cluster[x], labels[x] if own_label else None):
                    if anchors:
                        yield from answers(held, listed, anchors)
                        anchors = []
                    of = cluster[x], labels[x] if own_label else None
                    listed = ranked(held, cluster[x], labels[x])
                anchors += [(ids[i], marks[i], labels[i], v[i], list(zip(lows[i], highs[i])))
                            for i in range(x, y)]
                if len(anchors) >= MEMBERS:
                    yield from answers(held, listed, anchors)
                    anchors = []
        if anchors:
            yield from answers(held, listed, anchors)
    return run


def _clustered(anchors: DataFrame, dim: int, scratch: Scratch):
    """The anchors with their cluster; the centroids; each cluster's widest angle."""
    few = anchors.orderBy(F.xxhash64("vec_id", "mark"), "vec_id", "mark").limit(SAMPLE).select("v")
    sample = np.zeros((0, dim))
    for r in few.collect():
        row = np.zeros((1, dim))
        row[0, :len(r[0])] = r[0]
        sample = np.concatenate([sample, row])
    middle = centroids(sample) if len(sample) else np.zeros((1, dim))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a = angles(_matrix(batch.column(batch.schema.get_field_index("v")), dim), middle)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(a.argmin(1), pa.int32()), pa.array(a.min(1))],
                names=[*batch.schema.names, "cluster", "angle"])
    placed = scratch.keep(anchors.mapInArrow(
        run, "vec_id long, label long, v array<double>, mark long, cluster int, angle double"),
        "anchors")
    reach = np.zeros(len(middle))
    for r in placed.groupBy("cluster").agg(F.max("angle")).collect():      # CLUSTERS rows at most
        reach[r[0]] = r[1]
    return placed.drop("angle"), middle, reach


def _pass(rows: DataFrame, anchors: DataFrame, blocks: int, run) -> DataFrame:
    """Every block of rows with all anchors in one task each."""
    none = F.array().cast("array<double>")
    mine = rows.select(
        F.pmod(F.xxhash64("vec_id", "mark"), F.lit(blocks)).cast("int").alias("chunk"),
        F.lit(0).alias("kind"), F.lit(-1).alias("cluster"), "label", "vec_id", "mark", "v",
        none.alias("lows"), none.alias("highs"))
    theirs = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("chunk"), F.lit(1).alias("kind"),
        "cluster", "label", "vec_id", "mark", "v", "lows", "highs")
    return mine.unionByName(theirs).repartition(2 * blocks, "chunk").sortWithinPartitions(
        "chunk", "kind", "cluster", "label").mapInArrow(run, _MET)


def hard_negatives(rows: DataFrame, is_anchor: Column | str, positives: int = 5,
                   negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` come from ``quantised`` (labels may have been changed since).  For each anchor and each
    of its first ``positives`` other rows of its label, the first ``negatives`` rows of other
    labels whose score lies between ``low`` and ``high`` hundredths of the positive's.
    """
    scratch = Scratch(rows.sparkSession, "hard-negatives")
    rows = scratch.keep(rows.select("vec_id", "label", "v", "mark"), "rows")
    count, dim = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks = max(1, math.ceil(count / (BLOCK_ROOTS * math.sqrt(max(1, count)))))
    anchors, middle, reach = _clustered(
        rows.where(is_anchor).dropDuplicates(["vec_id", "mark"]), dim, scratch)
    whole = anchors.withColumns({"lows": F.array(F.lit(float("-inf"))),
                                 "highs": F.array(F.lit(float("inf")))})
    anchor = ["anchor_id", "anchor_mark"]
    first = [F.desc("score"), "vec_id", "mark"]
    near = _pass(rows, whole, blocks, _meet(dim, middle, reach, positives, True)).withColumn(
        "n", F.row_number().over(Window.partitionBy(*anchor).orderBy(*first)))
    near = scratch.keep(near.where(F.col("n") <= positives).select(
        *anchor, F.col("vec_id").alias("positive_id"), F.col("mark").alias("positive_mark"),
        F.col("score").cast("long").alias("positive_score")), "positives")

    # windows as whole numbers: ceil(low p / 100) to floor(high p / 100)
    windows = near.where("positive_score >= 0").select(
        F.col("anchor_id").alias("vec_id"), F.col("anchor_mark").alias("mark"), "positive_score") \
        .groupBy("vec_id", "mark").agg(F.sort_array(F.collect_set("positive_score")).alias("p"))
    asked = anchors.join(windows, ["vec_id", "mark"]).select(
        *anchors.columns,
        F.transform("p", lambda p: ((p * low + 99 - F.pmod(p * low + 99, F.lit(100))) / 100))
        .alias("lows"),
        F.transform("p", lambda p: ((p * high - F.pmod(p * high, F.lit(100))) / 100))
        .alias("highs"))
    met = _pass(rows, asked, blocks, _meet(dim, middle, reach, negatives, False)).withColumn(
        "score", F.col("score").cast("long"))
    each = Window.partitionBy(*anchor, "positive_id", "positive_mark").orderBy(*first)
    return met.join(near, anchor).where(
        (F.lit(low) * F.col("positive_score") <= 100 * F.col("score"))
        & (100 * F.col("score") <= F.lit(high) * F.col("positive_score"))).withColumn(
        "rank", F.row_number().over(each)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
