import hashlib

import numpy as np
import pytest

from jobloom.llm import fingerprints as P

from .odd import empty, frame, rows


def chunks(raw: bytes):
    """One byte after another, as the definition says."""
    g, out, start = P._GEAR, [], 0
    while start < len(raw):
        end = min(len(raw), start + P.GREATEST)
        for e in range(start + P.LEAST, min(len(raw), start + P.GREATEST) + 1):
            h = 0
            for k in range(P.REACH):
                h += int(g[raw[e - 1 - k]]) << k
            h &= 0xFFFFFFFF
            if h & int(P.STRICT if e < start + P.NORMAL else P.LOOSE) == 0:
                end = e
                break
        out.append((start, end))
        start = end
    return out


def sets(texts):
    raw = [t.encode() for t in texts]
    return P.chunk_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def test_boundaries_follow_the_definition():
    texts = [r[1] or "" for r in rows(long_words=0)]
    raw = [t.encode() for t in texts]
    owner, ends = P.chunk_ends(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    off = np.cumsum([0, *map(len, raw)])
    for i, r in enumerate(raw):
        assert [int(e - off[i]) for e in ends[owner == i]] == [e for _, e in chunks(r)]


def test_shift_keeps_most_chunks_and_equal_texts_agree():
    text = rows(long_words=4000)[-1][1]
    a, b = sets([text, "inserted words here " + text]), sets(["x", text])
    near = P.likeness(a, sets([text, text]), 2)
    assert near[0] == 1.0 and 0.95 < near[1] < 1.0
    assert P.as_text(a, 2)[0] == P.as_text(b, 2)[1]


def test_likeness_is_containment_by_bytes():
    a = (np.array([0, 0]), np.array([1, 2], np.uint64), np.array([30, 70]))
    b = (np.array([0, 0]), np.array([2, 3], np.uint64), np.array([70, 130]))
    assert P.likeness(a, b, 1)[0] == 0.7
    none = (a[0][:0], a[1][:0], a[2][:0])
    assert P.likeness(none, none, 1)[0] == 1.0 and P.likeness(a, none, 1)[0] == 0.0


@pytest.mark.parametrize("per_part", [2000, 7])
def test_pairs_against_brute_force(spark, per_part):
    data = rows(long_words=20_000)
    got = P.fingerprint_pairs(frame(spark, data, clashes=True), rows_per_part=per_part).collect()
    order = sorted(((r[0], r[1] or "") for r in data), key=lambda r: (
        r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for i, (doc, text) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        k = len(text) // 3
        edit = text[:len(text) - k] + nxt[:k] if k else text
        s = sets([text]), sets([edit]), sets([nxt])
        want.append((doc, len(text), hashlib.sha256(edit.encode()).hexdigest(),
                     P.as_text(s[0], 1)[0], P.as_text(s[1], 1)[0],
                     float(P.likeness(s[0], s[1], 1)[0]), float(P.likeness(s[0], s[2], 1)[0])))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_small_tables(spark):
    assert P.fingerprint_pairs(empty(spark)).count() == 0
    one = P.fingerprint_pairs(frame(spark, rows(long_words=0)[:1])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    every = P.fingerprint(frame(spark, rows(long_words=0), clashes=True)).collect()
    assert len(every) == len(rows(long_words=0)) and every[0]["kept"] == "mine"
