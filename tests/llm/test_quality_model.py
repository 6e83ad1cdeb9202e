import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from jobloom.llm import quality_model as Q
from jobloom.llm.lm_scoring import discounts

from .odd import empty, frame, rows


class Brute:
    def __init__(self, texts):
        self.c = {5: Counter()}
        for t in texts:
            b = bytes(4) + t.encode()
            self.c[5].update(b[j:j + 5] for j in range(len(b) - 4))
        for o in (4, 3, 2, 1):
            self.c[o] = Counter(k[1:] for k in self.c[o + 1])
        self.d = {o: discounts([Counter(c.values())[k] for k in (1, 2, 3, 4)])
                  for o, c in self.c.items()}
        self.ctx = {o: defaultdict(list) for o in self.c}
        for o, c in self.c.items():
            for k, n in c.items():
                self.ctx[o][k[:-1]].append(n)

    def p(self, k):
        o = len(k)
        if not o:
            return 1 / 256
        low, ns, n, d = self.p(k[1:]), self.ctx[o].get(k[:-1]), self.c[o][k], self.d[o]
        if not ns:
            return low
        return ((n - d[min(n, 3) - 1] if n else 0)
                + sum(d[min(x, 3) - 1] for x in ns) * low) / sum(ns)

    def perplexity(self, text):
        b = bytes(4) + (text or "").encode()
        n = len(b) - 4
        return math.exp(-sum(math.log(self.p(b[j:j + 5])) for j in range(n)) / n) if n else None


@pytest.mark.parametrize("block", [Q.BLOCK, 2000])
def test_perplexities_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(Q, "BLOCK", block)
    monkeypatch.setattr(Q, "REQUESTS", 5)
    data = rows(n=60, long_words=1500)
    df = frame(spark, data, clashes=True)
    good = spark.createDataFrame([(i,) for i in range(100, 160)] + [(6,), (6,), (None,)], "doc_id long")
    held = F.col("doc_id") % 4 == 0
    got = Q.classify(df, good, held).collect()
    assert len(got) == len(data) and got[0]["class_id"] == "mine"
    texts = {r[0]: r[1] for r in data if r[0] is not None}
    brute = Brute([texts[i] for i in [*range(100, 160), 6] if i % 4])
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for i in [*range(100, 130), 1, 2, 3, 4, 6, 11, 12, 14, 15]:
        want = brute.perplexity(texts[i])
        assert by[i].perplexity == (want if want is None else pytest.approx(want, rel=1e-4))
        assert by[i].trusted == (i >= 100 or i == 6)
    assert not by[1].kept and not by[12].kept and by[6].kept
    judged = [r for r in got if r.trusted and r.doc_id % 4 == 0]
    assert sum(r.kept for r in judged) == len(judged)
    for lang in {r.lang for r in judged}:
        top = max(r.perplexity for r in judged if r.lang == lang)
        own = {r.threshold for r in got if r.lang == lang}
        assert len(own) == 1 and own.pop() == pytest.approx(top, rel=1e-4)


def test_without_trusted_texts_and_empty(spark):
    df = frame(spark, rows(long_words=0)[:4])
    none = spark.createDataFrame([], "doc_id long")
    got = Q.classify(df, none, F.lit(False)).collect()
    assert all(r.threshold is None and r.kept == (r.n_bytes > 0) for r in got)
    assert all(r.perplexity == pytest.approx(256) for r in got)
    assert Q.classify(empty(spark), none, F.lit(False)).count() == 0


def test_probabilities_of_a_context_add_up():
    import numpy as np
    raw = "".join(r[1] or "" for r in rows(n=5, long_words=0)).encode()
    data, off = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    key, n = Q.distinct(data, off)
    own = Q.shard_of(key) == Q.shard_of(key[:1])[0]
    pairs = Counter({int(k): c for k, c in zip(*np.unique(
        np.unique(Q._shorter(key, 3)) & np.uint64(0xFFFF), return_counts=True))})
    shard = Q.Shard(Q.Low(pairs, {o: (0.5, 1.0, 1.5) for o in (3, 4, 5)}), np.sort(key[own]),
                    n[own][np.argsort(key[own])])
    context = key[own][0] >> np.uint64(8)
    every = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    assert np.exp(shard(every).astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_quality_labels_of_held_out_documents(spark):
    """Neither the untrusted documents nor the held-out trusted ones train the model."""
    from jobloom.llm.queries import op1_quality_classifier
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    found = op1_quality_classifier(spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id")
    share = {r.quality: r.share for r in found.groupBy("quality").agg(
        F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] >= 0.97 and share[0] <= 0.3
