import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from jobloom.llm import periodic as P

from .odd import WORD, empty, frame, rows


def brute_runs(w):
    """Every maximal stretch of every period, kept where no smaller period has the stretch."""
    found, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q):
                part = w[i:i + length]
                if not any(all(part[k] == part[k + p] for k in range(length - p))
                           for p in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_of_random_sequences(letters):
    rng = random.Random(letters)
    for _ in range(150):
        w = []
        while len(w) < rng.randint(1, 90):
            part = [rng.randrange(letters) for _ in range(rng.randint(1, 7))]
            w += part * rng.choice([1, 1, 4, 5, 9])
        x = np.array(w, np.uint64)
        assert P.runs_of(x, np.array([0, len(x)]))[0] == brute_runs(w)


def test_block_of_texts_keeps_texts_apart():
    texts = [[1] * 5, [1] * 5, [], [1, 2] * 4, [2, 1] * 3, [7] * 6]
    x = np.array([c for t in texts for c in t], np.uint64)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    assert P.runs_of(x, bounds) == [brute_runs(t) for t in texts]


def test_splitting_is_stable_and_loses_no_run():
    rng = random.Random(7)
    w = [rng.randrange(40) for _ in range(300)] + [5, 6, 7] * 5 + [rng.randrange(40) for _ in range(300)]
    x = np.array(w, np.uint64)
    parts = P.segments(x, np.zeros(len(x), np.int64))
    for a, b in parts:
        assert min(Counter(w[a:b]).values()) >= 4
    assert any(a <= 300 and b >= 315 for a, b in parts)
    assert P.runs_of(x, np.array([0, len(x)]))[0] == brute_runs(w)


def test_digests_against_brute_force(spark):
    rng = random.Random(3)
    data = [r for r in rows(n=60, long_words=0)]
    for i in range(400):                                  # many ids, one in ten read periodically
        w = [rng.choice("the of a to in".split()) for _ in range(rng.randint(1, 160))]
        data.append((1000 + i, rng.choice([" ", "\n", " \t"]).join(w), "en", "a", i))
    data.append((5000, "x y z " * 400 + "tail", "en", "a", 1))
    got = P.run_digests(frame(spark, data, clashes=True)).collect()
    want = Counter(brute(r[0], r[1]) for r in data)
    assert Counter(map(tuple, got)) == want
    assert sum(r.n_runs > 0 for r in got) > 30


def test_very_long_periodic_text(spark):
    text = "one two " * 200_000 + " ".join(f"w{i % 9973}" for i in range(100_000))
    r = P.find_runs(frame(spark, [(1, text, "en", "a", 1)], clashes=True)).first()
    assert [tuple(x) for x in r.runs] == [(0, 400_000, 2), (400_000, 100_000, 9973)]
    assert r.collapsed.split() == ["one", "two", *(f"w{i}" for i in range(9973))] and r.size == "mine"


def test_empty(spark):
    assert P.run_digests(empty(spark)).count() == 0 and P.find_runs(empty(spark)).count() == 0
