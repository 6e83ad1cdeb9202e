from collections import Counter

import numpy as np

from jobloom.llm import near_dups as N
from jobloom.llm.components import components

from .odd import WORD, empty, frame, rows


def multiset(text):
    w = WORD.findall(text or "")
    if 0 < len(w) < 5:
        return Counter([tuple(w)])
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute(data, threshold=0.8):
    """Smallest id of the component of every row, all pairs of rows compared."""
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    sets = [multiset(r[1]) for r in data]
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            both = sum((x & y).values())
            union = sum(x.values()) + sum(y.values()) - both
            if union and both >= threshold * union:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    least = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], least.get(find(i))) for i, r in enumerate(data)]


def near(rng, text, share):
    w = text.split(" ")
    for i in range(len(w)):
        if rng.random() < share:
            w[i] = f"w{rng.integers(1e9)}"
    return " ".join(w)


def test_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(2)
    x = rng.integers(1, 1 << 63, 60).astype(np.uint64)
    for _ in range(3):
        a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
        own = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        sig = N.signatures(own, np.concatenate([x[a > 0], x[b > 0]]),
                           np.concatenate([a[a > 0], b[b > 0]]), 2, 6000)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def test_classes_against_brute_force(spark):
    rng = np.random.default_rng(8)
    data = rows(long_words=30_000)
    base = next(r[1] for r in data if r[0] == 6)
    data += [(200 + i, near(rng, base, 0.004 * (i % 6)), "en", "a", i) for i in range(30)]
    data += [(300 + i, base if i % 2 else base + " tail", "en", "a", i) for i in range(20)]
    df = frame(spark, data, clashes=True)
    got = N.near_duplicates(df).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == Counter(brute(data))


def test_members_outside_the_first_star_are_compared(spark):
    """A chain in which the smallest member is near one end only."""
    rng = np.random.default_rng(4)
    text = " ".join(f"t{i}" for i in range(400))
    data, last = [], text
    for i in range(12):
        data.append((i + 1, last, "en", "a", 0))
        w = last.split(" ")
        for j in rng.choice(400, 5, replace=False):
            w[j] = f"x{i}_{j}"
        last = " ".join(w)
    got = {r.doc_id: r.class_id for r in N.near_duplicates(frame(spark, data)).collect()}
    assert got == dict(brute(data)) and set(got.values()) == {1}


def test_texts_under_one_id_and_texts_without_id(spark):
    """Only copies go: unlike texts under one id stay, and so do unlike texts without an id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    data = [(1, a, "en", "s", 1), (1, b, "en", "s", 2), (2, a, "en", "s", 3), (3, b + " more", "en", "s", 4),
            (None, c, "en", "s", 5), (None, c, "en", "s", 6), (None, a, "en", "s", 7), (4, None, None, None, 8),
            (4, "", None, None, 9), (1, a, "en", "s", 1)]
    data += [(None, f"text number {i} of many " * 5, "en", "s", 10 + i) for i in range(300)]
    df = frame(spark, data, clashes=True)
    got = N.near_duplicates(df).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == Counter(brute(data))
    kept = N.one_of_each(df)
    assert kept.columns == df.columns
    stay = Counter((r.doc_id, r.text) for r in kept.collect())
    assert stay[1, a] == stay[1, b] == stay[None, c] == stay[4, None] == stay[4, ""] == 1
    assert sum(stay.values()) == 305 and not {(2, a), (3, b + " more"), (None, a)} & set(stay)
    assert stay == Counter((r.doc_id, r.text) for r in N.one_of_each(df.repartition(7)).collect())


def test_empty_and_wordless(spark):
    assert N.near_duplicates(empty(spark)).count() == 0
    data = [(1, None, None, None, None), (2, "", None, None, None), (3, " ", None, None, None)]
    assert {r.doc_id: r.class_id for r in N.near_duplicates(frame(spark, data)).collect()} == \
        {1: 1, 2: 2, 3: 3}


def test_components(spark):
    links = [(9, 3), (3, 9), (4, 4), (5, 6), (6, 7), (7, 8), (8, 5), (2, 9)] + \
        [(100, 100 + i) for i in range(50)] + [(200 + i, 201 + i) for i in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in (2, 3, 9)} == {2} and {got[i] for i in (5, 6, 7, 8)} == {5}
    assert {got[i] for i in range(100, 150)} == {100} and {got[i] for i in range(200, 241)} == {200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
