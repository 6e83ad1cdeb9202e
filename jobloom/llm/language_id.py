"""Language id: a byte convolutional network with multi-width filters and max pooling.

A window of WINDOW bytes goes through filters of several widths over one-hot bytes (so a
filter is a table: width x symbol), is max-pooled over positions, and a softmax layer gives
the languages.  A text's verdict averages the log probabilities of all its windows by their
bytes.  The network is trained in numpy on the driver from a bounded sample of labelled rows
and is applied to whole texts in Arrow batches; its weights have a fixed size.

Defined cases: a text that is null or has no letter is 'und' with score 0; equal texts get
equal predictions; without any labelled row every text is 'und'; extra columns pass through
and columns named like an output are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textmap import fresh, labelled_sample, map_texts

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
PAD = 256                  # the symbol after the end of a text
SYMBOLS = 257
PER_LANG = 1500            # bound of the training sample: rows of each language
STEPS = 900
BATCH = 48
UNDETERMINED = "und"


@dataclass
class Network:
    langs: list[str]
    filters: list[np.ndarray]     # per width: (width, SYMBOLS, FILTERS)
    bias: np.ndarray              # (len(WIDTHS) * FILTERS,)
    out: np.ndarray               # (len(WIDTHS) * FILTERS, languages)
    out_bias: np.ndarray


def windows_of(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW):
    """(text index, first byte, length) of the consecutive windows that cover each text."""
    size = np.diff(offsets)
    n = np.maximum(1, -(-size // window))
    owner = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[:-1][owner] + k * window
    return owner, start, np.minimum(window, offsets[1:][owner] - start)


def symbols(data: np.ndarray, start: np.ndarray, end: np.ndarray, window: int = WINDOW):
    """(windows, window + widest - 1) symbol matrix; PAD beyond the end of a window's text."""
    at = start[:, None] + np.arange(window + max(WIDTHS) - 1)
    inside = at < end[:, None]
    x = data[np.minimum(at, max(len(data) - 1, 0))].astype(np.int32) if len(data) else \
        np.zeros(at.shape, np.int32)
    x[~inside] = PAD
    return x


def _pool(net: Network, x: np.ndarray):
    """Pre-activation maxima over positions and where they are: lists by width."""
    length = x.shape[1] - max(WIDTHS) + 1
    tops, places = [], []
    for w, table in zip(WIDTHS, net.filters):
        a = table[0][x[:, :length]]
        for j in range(1, w):
            a = a + table[j][x[:, j:j + length]]
        places.append(a.argmax(1))
        tops.append(a.max(1))
    return tops, places


def train(sample: list[tuple[str, str]], steps: int = STEPS, batch: int = BATCH,
          seed: int = 1, window: int = WINDOW) -> Network | None:
    """Adam on the cross-entropy of random windows of the sample, languages drawn evenly."""
    by_lang: dict[str, list[np.ndarray]] = {}
    for text, lang in sample:
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw):
            by_lang.setdefault(lang, []).append(raw)
    langs = sorted(by_lang)
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    n_hidden = len(WIDTHS) * FILTERS
    net = Network(langs, [rng.normal(0, 0.3, (w, SYMBOLS, FILTERS)).astype(np.float32)
                          for w in WIDTHS],
                  np.zeros(n_hidden, np.float32),
                  rng.normal(0, 0.2, (n_hidden, len(langs))).astype(np.float32),
                  np.zeros(len(langs), np.float32))
    for table in net.filters:
        table[:, PAD] = -1.0
    params = [*net.filters, net.bias, net.out, net.out_bias]
    m = [np.zeros_like(p) for p in params]
    v = [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        y = rng.integers(0, len(langs), batch)
        rows, size = [], rng.choice([24, 64, window, window], batch)
        for lang, n in zip(y, size):
            texts = by_lang[langs[lang]]
            raw = texts[rng.integers(len(texts))]
            at = int(rng.integers(0, max(1, len(raw) - int(n) + 1)))
            rows.append(raw[at:at + n])
        ends = np.cumsum([len(r) for r in rows])
        x = symbols(np.concatenate(rows), ends - [len(r) for r in rows], ends, window)
        tops, places = _pool(net, x)
        z = np.concatenate(tops, 1) + net.bias
        h = np.maximum(z, 0)
        logits = h @ net.out + net.out_bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(batch), y] -= 1
        p /= batch
        dz = (p @ net.out.T) * (z > 0)
        grads = []
        for i, (w, place) in enumerate(zip(WIDTHS, places)):
            d = dz[:, i * FILTERS:(i + 1) * FILTERS].astype(np.float32)
            g = np.zeros_like(net.filters[i])
            for j in range(w):
                np.add.at(g[j], (x[np.arange(batch)[:, None], place + j],
                                 np.arange(FILTERS)[None, :]), d)
            grads.append(g)
        grads += [dz.sum(0), h.T @ p, p.sum(0)]
        rate = 0.02 * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k, g in enumerate(grads):
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            params[k] -= (rate * (m[k] / (1 - 0.9 ** step))
                          / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return net


class Scorer:
    """Applies a network to blocks of texts; pairs of symbols are looked up together."""

    def __init__(self, net: Network, window: int = WINDOW, rows: int = 128):
        self.net, self.window, self.rows = net, window, rows
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(-1, FILTERS)
        two, three, four = net.filters
        self.two = pair(two[0], two[1])
        self.three, self.third = pair(three[0], three[1]), np.ascontiguousarray(three[2])
        self.four, self.last = pair(four[0], four[1]), pair(four[2], four[3])

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        length = x.shape[1] - 3
        pairs = x[:, :-1] * SYMBOLS + x[:, 1:]
        first = pairs[:, :length]
        a = np.take(self.two, first, axis=0).max(1)
        b = np.take(self.three, first, axis=0)
        b += np.take(self.third, x[:, 2:2 + length], axis=0)
        c = np.take(self.four, first, axis=0)
        c += np.take(self.last, pairs[:, 2:2 + length], axis=0)
        h = np.maximum(np.concatenate([a, b.max(1), c.max(1)], 1) + self.net.bias, 0)
        logits = (h @ self.net.out + self.net.out_bias).astype(np.float64)
        logits -= logits.max(1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(1, keepdims=True))

    def __call__(self, data: np.ndarray, offsets: np.ndarray):
        """(best language index, its probability) of each text."""
        owner, start, size = windows_of(data, offsets, self.window)
        total = np.zeros((len(offsets) - 1, len(self.net.langs)))
        for at in range(0, len(owner), self.rows):
            s = slice(at, at + self.rows)
            x = symbols(data, start[s], offsets[1:][owner[s]], self.window)
            np.add.at(total, owner[s], self.log_probs(x) * np.maximum(size[s], 1)[:, None])
        total /= np.maximum(np.diff(offsets), 1)[:, None]
        p = np.exp(total - total.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return best, p[np.arange(len(p)), best]


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id",
        per_lang: int = PER_LANG) -> Network | None:
    """Trains on at most ``per_lang`` rows of each language of ``docs``."""
    return train(labelled_sample(docs, docs, label, key, per_lang, text=text))


def predict(docs: DataFrame, net: Network | None, text: str = "text",
            keep_text: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the probability of that language)."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    flag = fresh("_has_letter", docs)
    docs = docs.withColumn(flag, F.coalesce(
        F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)) & F.lit(net is not None))

    def make():
        scorer = Scorer(net) if net else None
        langs = np.array(net.langs if net else [], object)

        def work(data, offsets, rows):
            some = np.array(rows.column(rows.schema.get_field_index(flag)).to_pylist(), bool)
            if scorer is None:
                return [[UNDETERMINED] * len(some), np.zeros(len(some))]
            best, p = scorer(data, offsets)
            return [np.where(some, langs[best], UNDETERMINED).tolist(), np.where(some, p, 0.0)]
        return work

    return map_texts(docs, text, fields, make, keep_text).drop(flag)
