import math
import zlib
from collections import Counter, defaultdict

import pytest

from jobloom.llm import lm_scoring as L
from jobloom.llm.textmap import held_out

from .odd import WORD, empty, frame, rows

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def tokens(text):
    return [w.translate(LOWER) for w in WORD.findall(text or "")] + [None]


class Brute:
    """The model from its definition, over dictionaries."""

    def __init__(self, texts):
        toks = [tokens(t) for t in texts]
        self.c1 = Counter(w for t in toks for w in t)
        self.c2 = Counter(b for t in toks for b in zip(["<s>", *t], t))
        self.n, self.v = sum(self.c1.values()), len(self.c1)
        of = lambda c: L.discounts([Counter(c.values())[k] for k in (1, 2, 3, 4)])
        self.m = Counter(w for _, w in self.c2)
        self.d2, self.d1, self.t = of(self.c2), of(self.m), sum(self.m.values())
        self.free = sum(self.d1[min(n, 3) - 1] for n in self.m.values()) / self.t
        self.ctx = defaultdict(list)
        for (a, _), n in self.c2.items():
            self.ctx[a].append(n)

    def p(self, a, w):
        m = self.m[w]
        low = (m - self.d1[min(m, 3) - 1] if m else 0) / self.t + self.free / (self.v + 1)
        if a not in self.ctx:
            return low
        ns, n = self.ctx[a], self.c2[a, w]
        back = sum(self.d2[min(x, 3) - 1] for x in ns) / sum(ns)
        return (n - self.d2[min(n, 3) - 1] if n else 0) / sum(ns) + back * low

    def score(self, text):
        t = tokens(text)
        return sum(math.log10(self.p(a, w)) for a, w in zip(["<s>", *t], t))

    def base(self, text):
        return sum(math.log10((self.c1[w] + 0.5) / (self.n + 0.5 * (self.v + 1)))
                   for w in tokens(text))


@pytest.mark.parametrize("shard_tokens", [L.SHARD_TOKENS, 700])
def test_scores_against_brute_force(spark, shard_tokens):
    data = rows(long_words=12_000)
    df = frame(spark, data, clashes=True)
    model = L.fit(df.where(~held_out("doc_id", 5, 1)), shard_tokens=shard_tokens, shard_words=300)
    learn = [r[1] for r in data if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 != 1]
    brute = Brute(learn)
    assert abs(sum(brute.p("an", w) for w in brute.c1) + brute.p("an", "unheard-of") - 1) < 1e-9
    got = L.score(df, model).collect()
    assert len(got) == len(data)
    for r in got:
        t = tokens(r.text)
        assert (r.n_tokens, r.n_known) == (len(t), sum(w in brute.c1 for w in t))
        assert r.train_tokens == brute.n and r["kept"] == "mine"
        assert r.base_score == pytest.approx(brute.base(r.text), rel=1e-9)
        assert r.score == pytest.approx(brute.score(r.text), rel=1e-9)


def test_nothing_to_learn_from_and_empty(spark):
    df = frame(spark, rows(long_words=0)[:3])
    model = L.fit(df.limit(0))
    assert all(r.score == 0 and r.n_known == 0 for r in L.score(df, model).collect())
    assert L.score(empty(spark), model).count() == 0


def test_packed_bigrams_survive_the_round_trip():
    import numpy as np
    rng = np.random.default_rng(1)
    c, w = (rng.integers(0, 1 << 48, 1000).astype(np.uint64) for _ in range(2))
    c[:500] = c[0]
    n = rng.integers(1, 1 << 31, 1000).astype(np.uint64)
    back = L._unpacked(L._packed(c, w, n))
    assert set(zip(*(x.tolist() for x in back))) == set(zip(c.tolist(), w.tolist(), n.tolist()))


def test_other_file_systems_are_refused():
    with pytest.raises(ValueError, match="mounted"):
        L.local_folder("hdfs://host/checkpoints/x")
    assert L.local_folder("file:///a%20b/c") == "/a b/c"
