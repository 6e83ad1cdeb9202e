"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A text's terms (runs of letters, digits, apostrophes) are lower-cased in A-Z.  A term enters as a
word vector (terms of the training sample; all others share one) and as the mean of vectors of its
character trigrams.  Windows of WINDOW terms, each half overlapped by the next, go through a gated
recurrent layer in both directions; attention over the positions pools the states, and a
logistic layer gives the window's probability.  All windows of a text count: a last logistic layer
takes their sum, mean and maximum.

Training is in numpy on the driver, from a bounded sample of labelled rows.  As labels belong to
texts, a text's loss falls on its most suspicious window.  Scoring works on whole texts in
Arrow batches; the input products of a term are computed once for each distinct term of a block.

Defined cases: a null text is an empty one; a text without terms is scored as one empty window;
without labels of both kinds every text has the score 0; equal texts have equal scores; extra columns
pass through; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textmap import labelled_sample, map_texts
from .words import NOT_IN_TERM, words

WINDOW = 32
STRIDE = 16
HIDDEN = 8
EMBED = 8
TRIGRAMS = 4096
TERMS = 20_000                # bound of the word vectors
PER_LABEL = 2500              # bound of the training sample: rows of each label
STEPS = 350
TEXTS, SHARE = 24, 6          # texts of a step, and windows drawn from each
THRESHOLD = 0.7
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Terms:
    """Terms of a block: hash of each distinct one, its trigrams (flat, with bounds), and for every
    place in the texts which one stands there; ``bounds`` cut the places by text."""
    hashes: np.ndarray
    trigrams: np.ndarray
    cuts: np.ndarray
    places: np.ndarray
    bounds: np.ndarray


def terms_of(data: np.ndarray, offsets: np.ndarray) -> Terms:
    starts, ends, h, bounds = words(data, offsets, lower=True, space=NOT_IN_TERM)
    some, first, places = np.unique(h, return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    size = e - s
    cuts = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    at = np.arange(cuts[-1]) - np.repeat(cuts[:-1], size) + np.repeat(s, size)
    low = _LOWER[data].astype(np.int64) if len(data) else np.zeros(0, np.int64)
    before = np.where(at > np.repeat(s, size), low[np.maximum(at - 1, 0)], 0)
    after = np.where(at + 1 < np.repeat(e, size), low[np.minimum(at + 1, max(len(low) - 1, 0))], 0)
    trigrams = (before * 65599 + low[at] * 257 + after * 31) % TRIGRAMS
    return Terms(some, trigrams, cuts, places, bounds)


def window_places(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first place, terms) of all overlapping windows; the last one ends with the text."""
    n = np.diff(bounds)
    count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(k * STRIDE, np.maximum(n[owner] - WINDOW, 0))
    return owner, bounds[:-1][owner] + start, np.minimum(n[owner], WINDOW)


class Network:
    """Parameters by name; index 0 of the word vectors is the unknown term."""

    def __init__(self, vocabulary: np.ndarray, weights: dict[str, np.ndarray]):
        self.vocabulary, self.w = vocabulary, weights        # sorted hashes

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def inputs(self, t: Terms) -> tuple[np.ndarray, np.ndarray]:
        """(input vectors, word ids) of the distinct terms of a block."""
        ids = self.ids(t.hashes)
        out = np.empty((len(ids), 2 * EMBED), np.float32)
        out[:, :EMBED] = self.w["word"][ids]
        if len(ids):
            sums = np.add.reduceat(self.w["char"][t.trigrams], t.cuts[:-1], axis=0)
            out[:, EMBED:] = sums / np.diff(t.cuts)[:, None]
        return out, ids

    def forward(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Window logits from input products (2, windows, WINDOW, 3 * HIDDEN); the second
        direction comes in reversed order, and so does its mask."""
        w = self.w
        h = np.zeros((2, gates.shape[1], HIDDEN), np.float32)
        states = np.empty((2, gates.shape[1], WINDOW, HIDDEN), np.float32)
        saved = []
        both = np.stack([mask, mask[:, ::-1]])
        for t in range(WINDOW):
            g, u = gates[:, :, t], h @ w["recur"]
            zr = _sigmoid(g[..., :2 * HIDDEN] + u[..., :2 * HIDDEN])
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            n = np.tanh(g[..., 2 * HIDDEN:] + r * u[..., 2 * HIDDEN:])
            m = both[:, :, t, None]
            new = h + m * ((1 - z) * (n - h))
            if keep:
                saved.append((h, z, r, n, u[..., 2 * HIDDEN:], m))
            h = new
            states[:, :, t] = h
        joined = np.concatenate([states[0], states[1][:, ::-1]], 2)
        e = np.where(mask > 0, joined @ w["attend"], -1e9)
        a = np.exp(e - e.max(1, keepdims=True)) * mask
        a /= np.maximum(a.sum(1, keepdims=True), 1e-9)
        pooled = np.einsum("bt,bth->bh", a, joined)
        logit = pooled @ w["out"] + w["bias"][0]
        return (logit, (saved, joined, a, pooled)) if keep else logit

    def backward(self, d: np.ndarray, cache) -> tuple[dict, np.ndarray]:
        """Gradients of the layer weights, and of the input products."""
        saved, joined, a, pooled = cache
        w = self.w
        g = {"out": pooled.T @ d, "bias": np.array([d.sum()], np.float32)}
        dp = d[:, None] * w["out"][None, :]
        da = np.einsum("bth,bh->bt", joined, dp)
        de = a * (da - (a * da).sum(1, keepdims=True))
        g["attend"] = np.einsum("bt,bth->h", de, joined)
        dj = a[..., None] * dp[:, None] + de[..., None] * w["attend"]
        ds = np.stack([dj[..., :HIDDEN], dj[:, ::-1, HIDDEN:]])
        dgates = np.zeros((2, len(d), WINDOW, 3 * HIDDEN), np.float32)
        g["recur"] = np.zeros_like(w["recur"])
        dh = np.zeros((2, len(d), HIDDEN), np.float32)
        back = w["recur"].transpose(0, 2, 1)
        for t in range(WINDOW - 1, -1, -1):
            h, z, r, n, un, m = saved[t]
            dh = dh + ds[:, :, t]
            dm = m * dh
            dn = dm * (1 - z) * (1 - n * n)
            dz = dm * (h - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            dgates[:, :, t] = np.concatenate([dz, dr, dn], 2)
            du = np.concatenate([dz, dr, dn * r], 2)
            g["recur"] += h.transpose(0, 2, 1) @ du
            dh = dm * z + (1 - m) * dh + du @ back
        return g, dgates

    def products(self, x: np.ndarray) -> np.ndarray:
        """(2, terms, 3 * HIDDEN) input products of both directions; the last row pads."""
        x = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
        return np.stack([x @ self.w["input"][k] + self.w["shift"][k] for k in (0, 1)])


def _grid(t: Terms, start: np.ndarray, size: np.ndarray):
    """(windows, WINDOW) of distinct-term numbers (padded with their count), and the mask."""
    at = start[:, None] + np.arange(WINDOW)
    mask = np.arange(WINDOW)[None, :] < size[:, None]
    pad = len(t.hashes)
    places = np.append(t.places, pad)
    return np.where(mask, places[np.minimum(at, len(t.places))], pad), mask.astype(np.float32)


def _sum_rows(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows with each index, 0 to n - 1."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    order = np.argsort(index, kind="stable")
    some = index[order]
    new = np.flatnonzero(np.diff(some, prepend=-1))
    if len(new):
        out[some[new]] = np.add.reduceat(rows[order], new, axis=0)
    return out


def _log_odds(texts: list[Terms], y: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """How much likelier a text with a term is toxic, smoothed, for each vocabulary term."""
    found = np.zeros((2, len(vocabulary)))
    for t, label in zip(texts, y):
        at = np.searchsorted(vocabulary, t.hashes)
        at = at[(at < len(vocabulary)) & (vocabulary[np.minimum(at, len(vocabulary) - 1)] == t.hashes)]
        found[int(label)][at] += 1
    n = np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())])
    share = (found + 0.5) / (n[:, None] + 1)
    return np.log(share[1] / share[0])


def features(p: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sum, logarithm of sum, mean and greatest of the window probabilities of each text."""
    total = np.bincount(owner, p, n)
    count = np.maximum(np.bincount(owner, minlength=n), 1)
    top = np.zeros(n)
    np.maximum.at(top, owner, p)
    sharp = np.bincount(owner, p > 0.5, n)
    return np.stack([np.log1p(total), np.minimum(sharp, 3), np.sqrt(total / count),
                     top, np.log(count), np.ones(n)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Newton's method for a small logistic regression."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = _sigmoid(x @ b)
        g = x.T @ (y - p) - ridge * b
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return b


@dataclass
class Model:
    network: Network
    last: np.ndarray


def train(sample: list[tuple[str, int]], steps: int = STEPS, seed: int = 3) -> Model | None:
    """Adam on texts drawn evenly from both labels; then the last layer on all windows."""
    y = np.array([int(v) for _, v in sample])
    if len(set(y.tolist())) < 2:
        return None
    texts = []
    for text, _ in sample:
        raw = np.frombuffer(text.encode(), np.uint8)
        texts.append(terms_of(raw, np.array([0, len(raw)])))
    rng = np.random.default_rng(seed)
    held = Counter(h for t in texts for h in t.hashes.tolist())
    often = sorted(((-n, h) for h, n in held.items() if n >= 3))[:TERMS]
    vocabulary = np.array(sorted(h for _, h in often), np.uint64)
    scale = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    w = {"word": 0.1 * scale(len(vocabulary) + 1, EMBED), "char": 0.3 * scale(TRIGRAMS, EMBED),
         "input": scale(2, 2 * EMBED, 3 * HIDDEN), "shift": np.zeros((2, 3 * HIDDEN), np.float32),
         "recur": scale(2, HIDDEN, 3 * HIDDEN), "attend": scale(2 * HIDDEN),
         "out": scale(2 * HIDDEN), "bias": np.array([-1.0], np.float32)}
    w["word"][1:, 0] = np.clip(_log_odds(texts, y, vocabulary), -3, 6) / 3   # a start, then learned
    net = Network(vocabulary, w)
    m1 = {k: np.zeros_like(v) for k, v in w.items()}
    m2 = {k: np.zeros_like(v) for k, v in w.items()}
    of = [np.flatnonzero(y == k) for k in (0, 1)]
    cut = [window_places(t.bounds) for t in texts]
    for step in range(1, steps + 1):
        chosen = [int(rng.choice(of[k % 2])) for k in range(TEXTS)]
        grids, masks, parts, own, base = [], [], [], [], 0
        for j, i in enumerate(chosen):
            _, start, size = cut[i]
            pick = rng.permutation(len(start))[:SHARE]
            g, mask = _grid(texts[i], start[pick], size[pick])
            used, g = np.unique(g, return_inverse=True)      # only terms of these windows
            used = used[used < len(texts[i].hashes)]
            grids.append(np.where(mask > 0, g.reshape(mask.shape) + base, -1))
            masks.append(mask)
            own += [j] * len(pick)
            parts.append(_only(texts[i], used))
            base += len(used)
        t = _joined(parts)
        grid, mask, own = np.concatenate(grids), np.concatenate(masks), np.array(own)
        grid[grid < 0] = base
        x, ids = net.inputs(t)
        prod = net.products(x)
        gates = np.stack([prod[0][grid], prod[1][grid[:, ::-1]]])
        logit, cache = net.forward(gates, mask, keep=True)
        best = np.full(TEXTS, -np.inf)
        np.maximum.at(best, own, logit)
        at = np.array([np.flatnonzero((own == j) & (logit == best[j]))[0] for j in range(TEXTS)])
        d = np.zeros(len(logit), np.float32)
        d[at] = (_sigmoid(best) - y[chosen]) / TEXTS
        grads, dgates = net.backward(d, cache)
        dprod = np.stack([
            _sum_rows(cells.ravel(), dgates[k].reshape(-1, 3 * HIDDEN), base + 1)[:-1]
            for k, cells in enumerate((grid, grid[:, ::-1]))])
        grads["input"] = np.stack([x.T @ dprod[k] for k in (0, 1)])
        grads["shift"] = dgates.sum((1, 2))
        dx = sum(dprod[k] @ w["input"][k].T for k in (0, 1))
        grads["word"] = _sum_rows(ids, dx[:, :EMBED], len(w["word"]))
        size = np.diff(t.cuts)
        grads["char"] = _sum_rows(
            t.trigrams, np.repeat(dx[:, EMBED:] / size[:, None], size, axis=0), TRIGRAMS)
        rate = 0.015 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            m1[k] += 0.1 * (g - m1[k])
            m2[k] += 0.01 * (g * g - m2[k])
            w[k] -= (rate * (m1[k] / (1 - 0.9 ** step))
                     / (np.sqrt(m2[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    scorer = Scorer(Model(net, np.zeros(6)))
    x, at = [], 0
    while at < len(sample):                          # about a megabyte of texts at a time
        raw = []
        while at < len(sample) and sum(map(len, raw)) < 1 << 20:
            raw.append(sample[at][0].encode())
            at += 1
        x.append(scorer.features(terms_of(np.frombuffer(b"".join(raw), np.uint8),
                                          np.cumsum([0, *map(len, raw)]))))
    x = np.concatenate(x)
    return Model(net, _logistic(x, y))


def _only(t: Terms, used: np.ndarray) -> Terms:
    """The distinct terms ``used`` (their numbers) of a text, without its places."""
    size = np.diff(t.cuts)[used]
    cuts = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(cuts[-1]) - np.repeat(cuts[:-1], size) + np.repeat(t.cuts[:-1][used], size)
    return Terms(t.hashes[used], t.trigrams[at], cuts, t.places[:0], t.bounds[:1])


def _joined(texts: list[Terms]) -> Terms:
    """Distinct terms of several texts one after another (repeats between texts stay)."""
    shift = np.cumsum([0, *(int(t.cuts[-1]) for t in texts)])
    return Terms(np.concatenate([t.hashes for t in texts]),
                 np.concatenate([t.trigrams for t in texts]),
                 np.concatenate([*(t.cuts[:-1] + s for t, s in zip(texts, shift)), [shift[-1]]]),
                 np.zeros(0, np.int64), np.zeros(1, np.int64))


class Scorer:
    def __init__(self, model: Model, rows: int = 1024):
        self.m, self.rows = model, rows

    def features(self, t: Terms) -> np.ndarray:
        net = self.m.network
        prod = net.products(net.inputs(t)[0])
        owner, start, size = window_places(t.bounds)
        p = np.empty(len(owner))
        for at in range(0, len(owner), self.rows):
            s = slice(at, at + self.rows)
            grid, mask = _grid(t, start[s], size[s])
            gates = np.stack([prod[0][grid], prod[1][grid[:, ::-1]]])
            p[s] = _sigmoid(net.forward(gates, mask).astype(float))
        return features(p, owner, len(t.bounds) - 1)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return _sigmoid(self.features(terms_of(data, offsets)) @ self.m.last)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id",
        per_label: int = PER_LABEL) -> Model | None:
    """Trains on at most ``per_label`` rows of each label; ``labels`` has key and label."""
    return train(labelled_sample(docs, labels.where(F.col(label).isin(0, 1)), label, key, per_label))


def score(docs: DataFrame, model: Model | None, text: str = "text", keep_text: bool = True,
          threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on)."""
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def make():
        scorer = Scorer(model) if model else None

        def work(data, offsets, rows):
            p = scorer(data, offsets) if scorer else np.zeros(len(offsets) - 1)
            return [p, (p >= threshold).astype(np.int32)]
        return work
    return map_texts(docs, text, fields, make, keep_text)
