import hashlib
from collections import Counter

import pytest

from jobloom.llm import substring_dedup as S

from .odd import WORD, empty, frame, rows


def brute(data, least=20):
    """Per row the mask of removed words; rows with one id don't count as earlier for each other."""
    first = {}
    ids = sorted({r[0] for r in data if r[0] is not None})
    order = {d: i for i, d in enumerate(ids)} | {None: len(ids)}
    for r in data:
        w = WORD.findall(r[1] or "")
        for i in range(len(w) - least + 1):
            k = tuple(w[i:i + least])
            first[k] = min(first.get(k, len(ids)), order[r[0]])
    out = []
    for r in data:
        w = WORD.findall(r[1] or "")
        gone, seen = [False] * len(w), set()
        for i in range(len(w) - least + 1):
            k = tuple(w[i:i + least])
            if first[k] < order[r[0]] or k in seen:
                gone[i:i + least] = [True] * least
            seen.add(k)
        out.append((r[0], w, gone))
    return out


@pytest.mark.parametrize("least", [20, 23])
def test_removals_against_brute_force(spark, least):
    data = rows(long_words=25_000)
    got = S.removals(frame(spark, data, clashes=True), least).collect()
    want = Counter((d, len(w), sum(g), hashlib.sha256(" ".join(
        x for x, y in zip(w, g) if not y).encode()).hexdigest()) for d, w, g in brute(data, least))
    assert Counter(map(tuple, got)) == want
    assert sum(r.n_removed for r in got) > 400


def test_text_without_repeats(spark):
    data = rows(long_words=0)
    df = frame(spark, data, clashes=True)
    out = S.without_repeats(df)
    assert out.columns == [*df.columns, "n_removed"]
    want = Counter((d, tuple(x for x, y in zip(w, g) if not y)) for d, w, g in brute(data))
    got = out.collect()
    assert Counter((r.doc_id, tuple(WORD.findall(r.text))) for r in got) == want
    by = {r.doc_id: r.text for r in got}
    assert by[6] == next(r[1] for r in data if r[0] == 6) and by[7] == ""


def test_doubling_until_no_candidate_survives(spark):
    a = [f"a{i}" for i in range(200)]
    data = [(1, " ".join(a), None, None, None), (2, " ".join(["x", *a[20:110], "y"]), None, None, None),
            (3, " ".join(["p", *a[150:163], "q"]), None, None, None), (4, "z " * 3, None, None, None)]
    got = {r.doc_id: r.longest for r in S.repeat_lengths(frame(spark, data), least=5).collect()}
    assert got == {1: 80, 2: 80, 3: 10}


def test_empty(spark):
    assert S.removals(empty(spark)).count() == 0 and S.without_repeats(empty(spark)).count() == 0
