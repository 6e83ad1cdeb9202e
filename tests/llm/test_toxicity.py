import numpy as np
import pytest

from jobloom.llm import toxicity as X

from .odd import empty, frame, prose, rows

BAD = ("vile", "rotten", "wretch", "dolt")


def sample(rng, n, toxic):
    import random
    r = random.Random(int(rng.integers(1e9)))
    out = []
    for _ in range(n):
        words = prose(r, r.randint(20, 200)).split(" ")
        if toxic:
            for k in range(max(2, len(words) // 40)):
                words.insert(r.randrange(len(words)), r.choice(BAD))
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(6)
    data = [(t, 0) for t in sample(rng, 120, False)] + [(t, 1) for t in sample(rng, 60, True)]
    return X.train(data, steps=150)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = X.Network(np.zeros(0, np.uint64), {
        "recur": rng.normal(0, .4, (2, X.HIDDEN, 3 * X.HIDDEN)), "attend": rng.normal(0, .5, 2 * X.HIDDEN),
        "out": rng.normal(0, .5, 2 * X.HIDDEN), "bias": np.array([0.1])})
    gates = rng.normal(0, .5, (2, 3, X.WINDOW, 3 * X.HIDDEN))
    mask = (np.arange(X.WINDOW)[None, :] < np.array([[X.WINDOW], [7], [20]])).astype(float)
    d = rng.normal(0, 1, 3)
    grads, dgates = net.backward(d, net.forward(gates, mask, keep=True)[1])
    loss = lambda: float(net.forward(gates, mask).astype(float) @ d)
    for name, g in (("recur", grads["recur"]), ("attend", grads["attend"]), ("out", grads["out"])):
        for at in ((0, 1, 2), (1, 3, 17)) if name == "recur" else ((2,), (13,)):
            w, e = net.w[name], 1e-2
            old = w[at]
            w[at] = old + e
            up = loss()
            w[at] = old - e
            down = loss()
            w[at] = old
            assert g[at] == pytest.approx((up - down) / (2 * e), rel=3e-2, abs=2e-3)
    assert np.abs(dgates[0, 1, 7:]).max() < 1e-6 and np.abs(dgates[0, 1, :7]).max() > 0


def test_windows_overlap_and_cover():
    bounds = np.cumsum([0, 0, 5, 32, 33, 100])
    owner, start, size = X.window_places(bounds)
    for i in range(5):
        own = owner == i
        got = {j for s, n in zip(start[own], size[own]) for j in range(s, s + n)}
        assert got == set(range(bounds[i], bounds[i + 1]))
    assert (owner == 4).sum() == 6 and size[owner == 0].tolist() == [0]


def test_held_out_texts(model):
    rng = np.random.default_rng(7)
    texts = sample(rng, 40, False) + sample(rng, 40, True)
    raw = [t.encode() for t in texts]
    p = X.Scorer(model)(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert (p[:40] >= X.THRESHOLD).sum() <= 1 and (p[40:] >= X.THRESHOLD).sum() >= 38


def test_odd_rows(spark, model):
    data = rows(long_words=60_000) + [(500, "You VILE rotten wretch, you dolt!", "en", "a", 1)]
    got = X.score(frame(spark, data, clashes=True), model).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].score == by[2].score == by[3].score < X.THRESHOLD and by[500].predicted == 1
    assert by[6].score == by[7].score and by[6]["kept"] == "mine"
    assert X.score(empty(spark), model).count() == 0
    assert {r.score for r in X.score(frame(spark, data), None).collect()} == {0.0}


def test_sample_is_bounded_and_learns_from_labels_only(spark):
    docs = frame(spark, rows(long_words=0))
    labels = spark.createDataFrame(
        [(100 + i, i % 2) for i in range(40)] + [(101, 1), (None, 1), (1, 1), (6, None), (7, 5)],
        "doc_id long, toxic int")
    from jobloom.llm.textmap import labelled_sample
    got = labelled_sample(docs, labels.where("toxic in (0, 1)"), "toxic", "doc_id", 6)
    assert sum(v == 0 for _, v in got) <= 6 and sum(v == 1 for _, v in got) <= 6 and len(got) >= 8
    assert got == labelled_sample(docs.repartition(4), labels.where("toxic in (0, 1)").repartition(7),
                                  "toxic", "doc_id", 6)
    assert X.fit(docs, labels.where("toxic = 1")) is None


def test_sample_is_the_smallest_hashes_however_often_keys_repeat(spark):
    from pyspark.sql import functions as F

    from jobloom.llm.textmap import labelled_sample
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    docs = docs.unionByName(docs)
    label = F.when(F.col("doc_id") >= 397, "rare").otherwise("common").alias("label")
    labels = docs.select("doc_id", label).crossJoin(spark.range(50).select()).where("doc_id is not null")
    hashes = docs.distinct().select(label, "text", F.expr(
        "xxhash64(string(doc_id), 7) & 1152921504606846975").alias("h")).collect()
    want = {(r.text, r.label) for v, k in (("rare", 3), ("common", 6)) for r in sorted(
        (r for r in hashes if r.label == v), key=lambda r: r.h)[:k]}
    for n in (1, 5):
        got = labelled_sample(docs.repartition(n), labels.repartition(n + 1), "label", "doc_id", 6)
        assert len(got) == 9 and set(got) == want
