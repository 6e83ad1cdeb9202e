from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, score string, cluster string, v string"


def brute(data, positives=5, negatives=10):
    rows = {(i, tuple(v), (label + 1) % 10 if i % 7 == 0 else label) for i, v, label, *_ in data
            if i is not None and label is not None and v is not None
            and all(x is not None and np.isfinite(x) for x in v)}
    rows = [(i, label, np.floor(256 * np.array(v, np.float64)), v) for i, v, label in rows]

    def dot(a, b):
        n = min(len(a), len(b))
        return int(a[:n] @ b[:n])
    out = []
    for a in rows:
        if a[0] % 100:
            continue
        scored = sorted(((-dot(a[2], b[2]), b[0], b[1]) for b in rows if b is not a),
                        key=lambda x: x[:2])
        for p, pid, _ in [x for x in scored if x[2] == a[1]][:positives]:
            fits = [x for x in scored if x[2] != a[1] and 30 * -p <= 100 * -x[0] <= 90 * -p]
            out += [(a[0], pid, k + 1, x[1], -p, -x[0]) for k, x in enumerate(fits[:negatives])]
    return Counter(out)


def clustered(seed, n, dim=12, spread=0.4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, dim))
    at = rng.integers(0, 6, n)
    v = (middle[at] + spread * rng.normal(size=(n, dim))) / 4
    return [(int(i), [float(np.float32(x)) for x in v[i]], int(rng.integers(0, 4)), "m", "m", "m")
            for i in range(n)]


def negatives(df, **more):
    rows = H.quantised(df)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return H.hard_negatives(rows.withColumn("label", moved), "vec_id % 100 = 0", **more)


@pytest.mark.parametrize("spread", [0.05, 0.4, 3.0])
def test_against_brute_force(spark, spread):
    data = clustered(1, 1500, spread=spread)
    got = negatives(spark.createDataFrame(data, SCHEMA).repartition(4))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                           "negative_score"]
    want = brute(data)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 50


def test_odd_rows(spark):
    data = clustered(2, 300)
    nan, inf = float("nan"), float("inf")
    odd = [(1000, None, 1), (1100, [1.0, None], 1), (1200, [nan, 1.0], 2), (1300, [inf, 1.0], 2),
           (1400, [0.5] * 12, None), (None, [0.5] * 12, 1), (1500, [], 1), (1600, [0.25, 0.5], 2),
           (1700, [0.0] * 12, 3), (-100, [0.1] * 12, 1), (-7, [0.1] * 12, 9)]
    data += [(i, v, label, "m", "m", "m") for i, v, label in odd]
    data += [(2000 + i, [0.125] * 12, i % 2, "m", "m", "m") for i in range(60)]     # all ties
    data += data[:40]                                                             # repeated rows
    got = negatives(spark.createDataFrame(data, SCHEMA).repartition(4)).collect()
    want = brute(data)
    assert Counter(map(tuple, got)) == want and len(want) > 20


def test_walk_ends_early_and_is_certain():
    """Tight clusters: the bounds end the walk long before the list does."""
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(8, 16))
    rows = np.floor(256 * (middle[rng.integers(0, 8, 8000)] + 0.02 * rng.normal(size=(8000, 16))))
    members = rows[:5]
    centre = H.centroids(rows[:1])
    angle = H.angles(rows, centre)[:, 0]
    key = np.linalg.norm(rows, axis=1) * np.cos(np.maximum(0, angle - H.angles(members, centre).max()))
    ids = np.arange(8000)
    found = [H.Found([(-np.inf, np.inf)], 5) for _ in members]
    made = H.walk(rows, np.argsort(-key, kind="stable"), key, members, found,
                  lambda m, at: at >= 0, ids, ids)
    for a, f in zip(members, found):
        s = rows @ a
        assert sorted(f.at.tolist()) == sorted(np.lexsort((ids, -s))[:5].tolist())
    near = [m for m in range(5) if H.angles(members[m:m + 1], centre)[0, 0] < 0.3]
    assert near
    one = H.walk(rows, np.argsort(-key, kind="stable"),
                 np.linalg.norm(rows, axis=1) * np.cos(np.maximum(0, angle - 0.1)), members[:1],
                 [H.Found([(-np.inf, np.inf)], 5)], lambda m, at: at >= 0, ids, ids)
    assert one < 8000 and made <= 5 * 8000


def test_empty_and_no_anchor(spark):
    assert negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert negatives(spark.createDataFrame(clustered(5, 90)[1:], SCHEMA)).count() == 0
