from collections import Counter, defaultdict

import numpy as np
import pytest

from jobloom.llm import mixing as M

from .odd import WORD, empty, frame, rows


def test_targets_share_and_stop():
    got = M.targets([("b", 100), ("a", 1000), (None, 50), ("c", 10)])
    # a, b, c, null weigh 1, 2, 3, 1; c stops at 30, then null at 150, b at 300
    assert got == {"c": 30.0, "b": 300.0, None: 150.0, "a": 680.0}
    assert M.targets([]) == {} and M.targets([("a", 0)]) == {"a": 0.0}
    assert list(M.targets([("Z", 5), ("a", 5), ("ü", 5)]).values()) == [2.5, 5.0, 7.5]


def test_splitting_tree_keeps_exact_quotas():
    quota = np.array([1000, 3, 0, 77])
    got = M.split_quotas(quota, 7, np.random.default_rng(1))
    assert got.shape == (7, 4) and (got >= 0).all() and got.sum(0).tolist() == quota.tolist()
    assert np.ptp(got.sum(1)) <= 7
    assert (got == M.split_quotas(quota, 7, np.random.default_rng(1))).all()


@pytest.mark.parametrize("clashes", [False, True])
def test_mix(spark, clashes):
    data = rows(n=300, long_words=0)
    df = frame(spark, data, clashes)
    got = M.mix(df).collect()
    again = M.mix(df.repartition(5)).collect()
    key = lambda rs: Counter((r.doc_id, r.text, r.copies, tuple(r.shards)) for r in rs)
    assert len(got) == len(data) and key(got) == key(again)
    words = Counter()
    for r in data:
        words[r[3]] += len(WORD.findall(r[1] or ""))
    target, taken = M.targets(list(words.items())), defaultdict(int)
    for r in got:
        assert r.size == len(WORD.findall(r.text or "")) and r.source_size == words[r.source]
        assert abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.copies <= 3 and len(r.shards) == r.copies
        assert all(0 <= s < M.SHARDS for s in r.shards)
        taken[r.source] += r.copies * r.size
    for s in target:
        assert abs(taken[s] - target[s]) <= max(30, 0.01 * target[s])


def test_emitted_rows_are_the_copies(spark):
    data = rows(n=60, long_words=0)
    df = frame(spark, data, clashes=True)
    out = M.emit(df, shards=8)
    assert out.columns == df.columns
    want = Counter()
    for r in M.mix(df, shards=8).collect():
        want[r.doc_id, r.text] += r.copies
    assert Counter((r.doc_id, r.text) for r in out.collect()) == +want


def test_equal_rows_and_one_hot_row(spark):
    data = [(1, "w " * 10, "a", "a", 1)] * 50 + [(2, "v " * 500, "b", "b", 2)]
    got = M.mix(frame(spark, data)).collect()
    taken = sum(r.copies * r.size for r in got if r.source == "a")
    assert abs(taken - got[0].target) <= 10 if got[0].source == "a" else True
    assert max(r.copies for r in got) <= 3


def test_empty(spark):
    assert M.mix(empty(spark)).count() == 0 and M.emit(empty(spark)).count() == 0
    null = frame(spark, [(1, None, None, None, None)])
    assert M.mix(null).collect()[0].copies == 0
