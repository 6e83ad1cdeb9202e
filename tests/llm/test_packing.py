import bisect
import zlib
from collections import defaultdict

import numpy as np
import pytest

from jobloom.llm import packing as P

from .odd import empty, frame, rows


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(P.default_tokenizer())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, P.END]


def test_encoder_gives_the_tokenizers_ids(tokenizer):
    encode = P.Encoder(P.default_tokenizer())
    texts = [r[1] or "" for r in rows(long_words=3000)] + [
        "a\nb", "a\n\nb", " a", "a ", "a  b", "\n", "x y", "x\u0085y z", "it's I'll\nwe've", "1234 56",
        "tab\tin", "﻿bom", " line", "a\x1cb c", "ß²½Ⅷ ok", "\r\nx", "漢字 かな 😀😀", "'s 's", "a \nb"]
    for t in texts * 2:
        assert np.frombuffer(encode(t), "<u4").tolist() == ids_of(tokenizer, t)[:-1], repr(t[:40])


def test_spans():
    assert P.spans(5, 8) == [(0, 5)] and P.spans(8, 8) == [(0, 8)]
    assert P.spans(16, 8) == [(0, 8), (8, 8)] and P.spans(19, 8) == [(0, 3), (3, 8), (11, 8)]


def test_configurations_reach_the_bound():
    got = P.configurations(np.array([60, 50, 40, 25]), np.array([40, 20, 40, 80]), 100)
    used = sum(n * c for c, n in got)
    assert all((c * [60, 50, 40, 25]).sum() == 100 for c, _ in got)
    assert used.tolist() == [40, 20, 40, 80] and sum(n for _, n in got) == 70


def test_best_fit_over_counts_is_best_fit():
    rng = np.random.default_rng(3)
    for _ in range(20):
        cap = 50
        counts = np.bincount(rng.integers(1, cap + 1, 80), minlength=cap + 1)
        free = np.bincount(rng.integers(0, cap, 10), minlength=cap + 1)
        lengths = np.arange(cap, 0, -1)
        ranges, new = P.best_fit(lengths, counts[lengths], free, cap)
        bins = sorted(r for r in range(1, cap + 1) for _ in range(free[r]))
        opened = 0
        for n in np.repeat(lengths, counts[lengths]).tolist():
            i = bisect.bisect_left(bins, n)
            if i == len(bins):
                opened += 1
                bins.append(cap)
            r = bins.pop(i)
            if r > n:
                bisect.insort(bins, r - n)
        assert new == opened
        load, sizes, q = defaultdict(int), np.repeat(lengths, counts[lengths]), 0
        for at, n, name, first in ranges:
            assert at == q
            for k in range(n):
                load[name, first + k] += int(sizes[q])
                q += 1
        assert q == len(sizes)
        assert all(v <= (cap if name < 0 else name) for (name, _), v in load.items())


def check(packed, data, tokenizer, capacity):
    by = defaultdict(list)
    for r in packed:
        by[r.sequence_id].append(r)
    for rs in by.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    want = []
    for r in data:
        ids = ids_of(tokenizer, r[1])
        for k, (s, n) in enumerate(P.spans(len(ids), capacity)):
            raw = np.array(ids[s:s + n], "<u4").tobytes()
            want.append((r[0], k, s, n, zlib.crc32(raw)))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed]
    key = lambda t: (t[0] is None, t[0] or 0, *t[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    return len(by), sum(w[3] for w in want)


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pack(spark, tokenizer, capacity):
    data = rows(n=60, long_words=8000)
    packed = P.pack(frame(spark, data, clashes=True), capacity=capacity).collect()
    n, total = check(packed, data, tokenizer, capacity)
    assert n <= 1.03 * -(-total // capacity) + 1


def test_sequences_hold_the_ids(spark, tokenizer):
    data = [(i, f"document number {i} " * (i % 9), "en", "a", 1) for i in range(40)]
    packed = P.pack(frame(spark, data), capacity=32, keep_ids=True).persist()
    whole = {r.sequence_id: np.frombuffer(bytes(r.ids), "<u4").tolist()
             for r in P.sequences(packed).collect()}
    for r in packed.collect():
        ids = ids_of(tokenizer, data[r.doc_id][1])
        assert whole[r.sequence_id][r.offset:r.offset + r.length] == ids[r.start:r.start + r.length]


def test_equal_lengths_and_empty(spark, tokenizer):
    data = [(i, "same text here", "en", "a", 1) for i in range(500)] + [(900, None, None, None, None)]
    packed = P.pack(frame(spark, data), capacity=16).collect()
    n, total = check(packed, data, tokenizer, 16)
    assert len(ids_of(tokenizer, "same text here")) == 4 and n == 500 // 4 + 1
    assert P.pack(empty(spark)).count() == 0


def test_configurations_that_waste_a_token_are_used(spark, tokenizer):
    data = [(i, " ".join(["a"] * (25 if i % 3 == 0 else 18)), "en", "a", 1) for i in range(180)]
    packed = P.pack(frame(spark, data), capacity=65).collect()      # 26 + 19 + 19 = 64
    n, _ = check(packed, data, tokenizer, 65)
    assert {r.length for r in packed} == {26, 19} and n == 60       # best fit: 30 + 40


def test_plan_has_the_fewest_sequences_of_all_limits():
    hot = np.zeros(2049, np.int64)
    hot[819], hot[614] = 6000, 12000
    assert P.plan(hot, 2048).sequences == 6000                      # best fit: 7000
    rng = np.random.default_rng(9)
    for cap, top in ((2048, 2048), (100, 100), (100, 40), (97, 60)):
        lengths = np.arange(cap, 0, -1)
        for mult in (1, 3):
            counts = np.bincount(rng.integers(1, top // mult, 3000) * mult, minlength=cap + 1)
            got = P.plan(counts, cap)
            plain = P.best_fit(lengths, counts[lengths], np.zeros(cap + 1, np.int64), cap)[1]
            only = [P.plan(counts, cap, gaps=(g,)).sequences for g in P.GAPS]
            assert got.sequences == min(only) <= plain


def test_free_space_is_that_of_the_placed_pieces():
    rng = np.random.default_rng(4)
    for cap, groups in ((100, 6), (100, 40), (64, 12)):
        counts = np.bincount(rng.integers(1, cap + 1, 2000), minlength=cap + 1)
        for gap in (0, 9, cap):
            p = P.plan(counts, cap, groups, gaps=(gap,)).large
            length = np.repeat(np.arange(cap, 0, -1), counts[np.arange(cap, 0, -1)])
            bins, _ = P.place_large(p, np.arange(len(length)))
            load = np.bincount(bins[bins >= 0], length[bins >= 0], p.bins).astype(int)
            assert (P.free_space(p, counts, cap) == np.bincount(cap - load, minlength=cap + 1)).all()


@pytest.mark.parametrize("sf, most", [("sf0.01", 481), ("sf0.1", 4936)])
def test_half_of_the_sequences_come_from_configurations(spark, sf, most):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    counts = P._histogram(P.pieces(docs, P.default_tokenizer(), P.CAPACITY, False), "length", P.CAPACITY)
    got = P.plan(counts, P.CAPACITY)
    assert got.sequences <= most and 2 * got.large.bins >= got.sequences
