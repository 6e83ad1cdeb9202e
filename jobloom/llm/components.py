"""Connected components of a link table in few shuffles.

Links point from the larger node to the smaller one.  A round first lets every target that has a
smaller target itself move down (pointer jumping, through a join of the distinct targets, so a hub
counts once), deals the links by their larger node and contracts each partition: all links that
meet there become links to the smallest node of their local component.  When a round leaves every
link as it was, each node has one link and it goes to the smallest node of its component.

A round is one written table in the shared checkpoint folder, so a lost executor repeats one round
at most; whether anything changed is observed on that write.  A partition holds its own links only,
about its share of all; the shuffle deals by the larger node, of which a contracted task sends one
row, and the join of the jump deals a hub's links in SALT parts, so a hub is no heavy key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .scratch import Scratch

SALT = 16                          # parts of a hub's links in the pointer-jumping join


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component) of the links between ``a`` and ``b``."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        was = root.copy()
        for side in (root[x], root[y], x, y):
            np.minimum.at(root, side, low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
        if np.array_equal(was, root):
            return nodes, nodes[root]


def _contract(batches):
    """Links (a, b, moved) of one partition as links (a, b) to the local smallest node; ``new``
    marks those that weren't there before."""
    parts = [[c.to_numpy(zero_copy_only=False) for c in x.columns] for x in batches if x.num_rows]
    if not parts:
        return
    a, b, moved = (np.concatenate(x) for x in zip(*parts))
    nodes, root = smallest_reachable(a, b)
    below = nodes != root
    nodes, root = nodes[below], root[below]
    known = np.full(len(nodes), False)
    at = np.searchsorted(nodes, a)
    same = (b == root[at]) & ~moved
    known[at[same]] = True
    # a second target of a node is a change as well: it has just been merged away
    several = np.flatnonzero(b != root[at])
    known[at[several]] = False
    for i in range(0, len(nodes), 65_536):
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes[i:i + 65_536]), pa.array(root[i:i + 65_536]),
             pa.array(~known[i:i + 65_536])], names=["a", "b", "new"])


def _jumped(links: DataFrame) -> DataFrame:
    """(a, b, moved): targets that have a smaller target are replaced by it."""
    least = links.groupBy("a").agg(F.min("b").alias("to")).withColumnRenamed("a", "b")
    moves = links.select("b").distinct().join(least, "b").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = links.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALT)).cast("int"))
    return salted.join(moves, ["b", "salt"], "left").select(
        "a", F.coalesce("to", "b").alias("b"), F.col("to").isNotNull().alias("moved"))


def _down(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root): every node that has a link, with the smallest node of its component.

    ``links`` has two long columns a and b; direction, repeats and self links don't matter; links
    with a null end are left out.
    """
    scratch = scratch or Scratch(links.sparkSession, "components")
    # each task contracts its links before the first shuffle
    now = scratch.keep(_down(links).withColumn("moved", F.lit(False)).mapInArrow(
        _contract, "a long, b long, new boolean").select("a", "b"), "links")
    while True:
        seen = Observation()
        step = _jumped(now).repartition("a").mapInArrow(_contract, "a long, b long, new boolean")
        last, now = now, scratch.keep(step.observe(
            seen, F.count_if("new").alias("new"), F.count(F.lit(1)).alias("links")).select("a", "b"),
            "stars")
        scratch.drop(last)
        if not seen.get.get("new"):
            break
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
