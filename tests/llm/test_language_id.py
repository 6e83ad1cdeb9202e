import numpy as np
import pytest

from jobloom.llm import language_id as I
from jobloom.llm.queries import QUERIES
from tests.conftest import SF_MID

from .odd import empty, frame, rows


@pytest.fixture(scope="module")
def net():
    rng = np.random.default_rng(1)
    word = {"xx": "abcde", "yy": "nopqr", "zz": "äöüßé"}
    sample = [(" ".join("".join(rng.choice(list(cs), 4)) for _ in range(40)), lang)
              for lang, cs in word.items() for _ in range(30)]
    return I.train(sample, steps=120)


def test_pairs_of_symbols_give_the_sums_of_the_filters(net):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 257, (5, I.WINDOW + 3)).astype(np.int32)
    h = np.maximum(np.concatenate(I._pool(net, x)[0], 1) + net.bias, 0)
    logits = h @ net.out + net.out_bias
    want = logits - np.log(np.exp(logits).sum(1, keepdims=True))
    assert np.allclose(I.Scorer(net).log_probs(x), want, atol=1e-4)


def test_windows_cover_whole_texts():
    data = np.arange(700) % 200
    off = np.array([0, 0, 10, 10 + 256, 700])
    owner, start, size = I.windows_of(data.astype(np.uint8), off)
    for i in range(4):
        got = [j for s, n in zip(start[owner == i], size[owner == i]) for j in range(s, s + n)]
        assert got == list(range(off[i], off[i + 1]))


def test_predictions_of_odd_rows(spark, net):
    data = rows(long_words=200_000)
    data[0] = (100, "bade caba deab " * 300, "xx", "a", 1)
    data[1] = (101, "noqp ropn äöüß " + "nopq " * 90, "yy", "a", 1)
    df = frame(spark, data, clashes=True)
    got = {r.doc_id: r for r in I.predict(df, net).collect()}
    assert got[100].lang_pred == "xx" and got[101].lang_pred == "yy" and got[100]["kept"] == "mine"
    for i in (1, 2, 3, 12):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[6].lang_pred == got[7].lang_pred and got[6].score == got[7].score
    assert all(0 <= r.score <= 1 for r in got.values())
    assert I.predict(empty(spark), net).count() == 0
    assert {r.lang_pred for r in I.predict(df, None).collect()} == {"und"}


def test_held_out_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    got = QUERIES["op10_language_id"](spark, SF_MID).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and len(held) > 200
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
