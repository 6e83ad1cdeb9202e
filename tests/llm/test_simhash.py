from collections import Counter

import numpy as np
import pytest
import xxhash

from jobloom.llm import simhash as S
from jobloom.llm.scratch import Scratch

from .odd import WORD, empty, frame, rows

LOWER = {c: c + 32 for c in range(65, 91)}


def brute_print(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def brute_roots(codes, reach=2):
    """Smallest code of the component of each distinct code, every pair compared."""
    codes = sorted(set(codes))
    root = {c: c for c in codes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(codes):
        for b in codes[:i]:
            if (a ^ b).bit_count() <= reach:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {c: find(c) for c in codes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def near_codes(seed, groups, members, flips):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        base = int(rng.integers(0, 1 << 64, dtype=np.uint64))
        for _ in range(members):
            x = base
            for j in rng.choice(64, rng.integers(0, flips + 1), replace=False):
                x ^= 1 << int(j)
            out.append(x)
    return out


def test_fingerprints_and_components_against_brute_force(spark):
    data = rows(long_words=8_000)
    base = next(r[1] for r in data if r[0] == 6).split(" ")
    for i in range(60):                                   # near copies, a word or two changed
        w = list(base)
        for k in range(i % 3):
            w[(17 * i + 59 * k) % len(w)] = f"new{i}"
        data.append((200 + i, " ".join(w).upper() if i % 2 else "\n ".join(w), "en", "a", i))
    data += [(300, "Two words", "en", "a", 1), (301, "two\x0bWORDS", "en", "a", 1),
             (302, "ÀÉ one", "en", "a", 1), (303, "àé one", "en", "a", 1)]
    got = S.near_duplicates(frame(spark, data, clashes=True), cell=8)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    code = [brute_print(r[1]) for r in data]
    root = brute_roots(code)
    first = {}
    for r, c in zip(data, code):
        if r[0] is not None:
            first[root[c]] = min(first.get(root[c], r[0]), r[0])
    want = Counter((r[0], f"{c:016x}", first.get(root[c])) for r, c in zip(data, code))
    assert Counter(map(tuple, got.collect())) == want
    assert len({c for c in code}) > 60 and max(Counter(root.values()).values()) > 2


@pytest.mark.parametrize("crowded", [10_000, 40])
def test_links_connect_what_all_pairs_connect(spark, crowded):
    codes = near_codes(1, 40, 12, 3) + near_codes(2, 1, 400, 4) + near_codes(3, 300, 1, 0) + [0, 1, 3, 7, 1 << 63]
    want = {signed(k): v for k, v in brute_roots(codes).items()}
    df = spark.createDataFrame([(signed(c),) for c in set(codes)], "code long").repartition(5)
    links = S.code_links(df, Scratch(spark, "t"), cell=32, crowded=crowded).collect()
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 64 for a, b in links)
    root = {c: c for c in want}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    same, got = {}, {}
    for c in want:
        same.setdefault(want[c], set()).add(c)
        got.setdefault(find(c), set()).add(c)
    assert sorted(map(sorted, same.values())) == sorted(map(sorted, got.values()))


def test_pairs_that_may_link_meet_in_a_cell():
    rng = np.random.default_rng(4)
    code = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    near = code.copy()
    for _ in range(2):
        near ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    pivots = code[:S.PIVOTS]
    both = np.concatenate([code, near])
    seen = np.stack([np.bincount(d, minlength=65) for d in S.distances(both, pivots).T])
    splits = S.borders(seen, cell=16)
    assert len(splits) >= 6
    cell, index = S.deal(both, pivots, splits)
    cells = [set() for _ in both]
    for c, i in zip(cell.tolist(), index.tolist()):
        cells[i].add(c)
    assert all(cells[i] & cells[i + 3000] for i in range(3000))
    assert len(cell) < 8 * len(both)


def test_empty(spark):
    assert S.near_duplicates(empty(spark)).count() == 0
    data = [(2, None, None, None, None), (1, "", None, None, None), (None, " ", None, None, None)]
    got = S.near_duplicates(frame(spark, data)).collect()
    assert Counter(map(tuple, got)) == Counter((d, "0" * 16, 1) for d in (1, 2, None))
