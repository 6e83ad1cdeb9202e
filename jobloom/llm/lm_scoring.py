"""Language-model scoring: an interpolated modified Kneser-Ney bigram model.

Counted in Spark over all training texts, stored as sorted hash arrays in the shared folder, and
memory-mapped by the workers that score texts.

Counting: a first pass sums the words.  In a second pass each task combines its bigrams and packs
them by shard into byte planes; a shard is the hash range of the bigram's first word, and the
bounded list of words that make up more than half a shard's share alone is spread over all
shards by the second word.  A shard's task sums its bigrams, writes their sorted 64-bit hashes and
their counts, and hands back the sums that the model needs for each first word (context) and each
second word (continuation counts).  The number of shards follows the corpus, so a shard's size
doesn't.

Scoring: P(w|v) = max(c(vw) - D(c), 0) / c(v.) + g(v) P(w), and P(w) from continuation counts with
discounts of their own and a uniform share over the known words and one unknown.  A text is its
words, lower-cased in A-Z, and one end; the first word follows a start symbol, which isn't a token.

The shared folder has to be mounted by all workers (a file: path in spark.checkpoint.dir), since
memory mapping is the point of the method; other folders are refused with a clear error.  Files are
written under another name and renamed, with the same bytes at each attempt, so a lost executor
or a repeated task changes nothing.

Defined cases: a null text is an empty one (its end alone is a token); without training texts every
probability is 1; equal texts score alike; a null id is held out; an empty table gives an empty
table; extra columns pass through.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch
from .textmap import map_texts
from .words import blocks, join_hash, mix, words

START, END = np.uint64(0xA5A5_0000_0000_0001), np.uint64(0x5A5A_0000_0000_0002)
SHORT = np.uint64(16)                   # bigrams name their words by the 48 leading hash bits
FLUSH = 3_000_000                       # bigrams that a task combines at a time
SHARD_TOKENS = 2_000_000                # training tokens for each shard of bigrams
SHARD_WORDS = 1_000_000                 # words for each shard of the vocabulary
RECORD = np.dtype([("count", "<f8"), ("p", "<f8"), ("total", "<f8"), ("backoff", "<f8")])


def local_folder(uri: str) -> str:
    """The path of a shared folder that workers can map into memory."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory mapping needs a mounted shared folder; {uri!r} isn't one")
    return unquote(parts.path)


def tokens(data: np.ndarray, offsets: np.ndarray):
    """(hash of each token, index bounds of the texts): words, then END, for each text."""
    _, _, h, bounds = words(data, offsets, lower=True)
    n = np.diff(bounds) + 1
    ends = np.cumsum(n)
    out = np.empty(int(ends[-1]), np.uint64)
    last = np.zeros(len(out), bool)
    last[ends - 1] = True
    out[last], out[~last] = END, h
    return out, np.concatenate([[0], ends])


def contexts(t: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The token before each token, START before the first of a text."""
    before = np.empty_like(t)
    before[1:] = t[:-1]
    before[bounds[:-1]] = START
    return before


def _write(path: str, array: np.ndarray) -> None:
    part = f"{path}.{os.getpid()}.{np.random.default_rng().integers(1 << 62)}"
    array.tofile(part)
    os.replace(part, path)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all texts by hash, END included."""
    def run(batches):
        for _, data, off in blocks(batches, "text", 4 << 20):
            t, _ = tokens(data, off)
            h, n = np.unique(t, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)],
                                             names=["word", "n"])
    return docs.select("text").mapInArrow(run, "word long, n long") \
        .groupBy("word").agg(F.sum("n").alias("n"))


def shard_of(context: np.ndarray, word: np.ndarray, heavy: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each bigram: by its first word, or by its second if the first is a heavy one."""
    by = np.where(np.isin(context, heavy), word, context) if len(heavy) else context
    return (mix(by + np.uint64(1)) % np.uint64(shards)).astype(np.int64)


def _planes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(raw: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def _packed(context: np.ndarray, word: np.ndarray, n: np.ndarray) -> bytes:
    """Bigrams ordered by context: gaps of contexts, words and counts as byte planes, whose high
    planes are zeros that the shuffle's compression removes."""
    order = np.lexsort((word, context))
    context, word, n = context[order], word[order], n[order]
    return (_planes(np.diff(context, prepend=np.uint64(0)), 6) + _planes(word, 6)
            + _planes(n, 4))


def _unpacked(raw: bytes):
    n = len(raw) // 16
    return (np.cumsum(_from_planes(raw[:6 * n], n, 6), dtype=np.uint64),
            _from_planes(raw[6 * n:12 * n], n, 6), _from_planes(raw[12 * n:], n, 4))


def _combined(context: np.ndarray, word: np.ndarray, n: np.ndarray):
    key = join_hash(context, word)
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.diff(key, prepend=key[0] + np.uint64(1)) != 0) if len(key) else \
        np.zeros(0, np.int64)
    first = order[new]
    total = np.add.reduceat(n[order], new) if len(new) else n[:0]
    return key[new], context[first], word[first], total


def bigram_blobs(docs: DataFrame, heavy: np.ndarray, shards: int) -> DataFrame:
    """(shard, bigrams): the combined bigrams of each task, packed by shard."""
    def flush(cs, ws):
        c, w = np.concatenate(cs), np.concatenate(ws)
        _, c, w, n = _combined(c, w, np.ones(len(c), np.uint64))
        s = shard_of(c, w, heavy, shards)
        order = np.argsort(s, kind="stable")
        c, w, n, s = c[order], w[order], n[order], s[order]
        at = np.searchsorted(s, np.arange(shards + 1))
        for k in np.flatnonzero(np.diff(at)).tolist():
            part = slice(at[k], at[k + 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()),
                 pa.array([_packed(c[part], w[part], n[part])], pa.binary())],
                names=["shard", "bigrams"])

    def run(batches):
        cs, ws, held = [], [], 0
        for _, data, off in blocks(batches, "text"):
            t, bounds = tokens(data, off)
            cs.append(contexts(t, bounds) >> SHORT)
            ws.append(t >> SHORT)
            held += len(t)
            if held >= FLUSH:
                yield from flush(cs, ws)
                cs, ws, held = [], [], 0
        if held:
            yield from flush(cs, ws)
    return docs.select("text").mapInArrow(run, "shard int, bigrams binary")


def stored_bigrams(blobs: DataFrame, folder: str, shards: int) -> DataFrame:
    """Writes the sorted arrays of all shards; returns sums by kind:
    'c' (context, tokens, bigrams of count 1, 2, more), 'w' (word, distinct contexts),
    'n' (count 1 to 4, bigrams with it)."""
    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for shard, raw in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(shard, []).append(_unpacked(raw))
        for shard in sorted(held):
            parts = held.pop(shard)
            key, c, w, n = _combined(*(np.concatenate(x) for x in zip(*parts)))
            del parts
            _write(f"{folder}/bigram-{shard}.key", key)
            _write(f"{folder}/bigram-{shard}.n", n.astype("<u4" if n.max(initial=0) < 1 << 32 else "<u8"))
            ids, at = np.unique(c, return_inverse=True)
            sums = [np.bincount(at, x, len(ids)).astype(np.int64)
                    for x in (n.astype(float), n == 1, n == 2, n > 2)]
            yield _sums("c", ids, *sums)
            ids, many = np.unique(w, return_counts=True)
            yield _sums("w", ids, many)
            yield _sums("n", np.arange(1, 5, dtype=np.uint64),
                        np.array([(n == k).sum() for k in range(1, 5)]))
    return blobs.repartition(shards, "shard").mapInArrow(
        run, "kind string, id long, a long, b long, c long, d long")


def _sums(kind: str, ids: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    zero = np.zeros(len(ids), np.int64)
    columns = [*values, *[zero] * (4 - len(values))]
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(ids)), pa.array(ids.astype(np.int64)),
         *(pa.array(v.astype(np.int64)) for v in columns)],
        names=["kind", "id", "a", "b", "c", "d"])


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more, from the counts of counts 1 to 4.
    A corpus too small for one of them gets the absolute discount 0.5 there."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    out = []
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * b / a if a and y else 0.5
        out.append(min(max(d, 0.05), k - 0.05) if k > 1 else min(max(d, 0.05), 0.95))
    return tuple(out)


@dataclass
class Model:
    """Where the arrays are, and the few numbers that all texts share."""
    folder: str
    word_shards: int
    shards: int
    heavy: list[int]
    tokens: int                 # N
    types: int                  # V
    unknown: float              # probability of the unknown word without context
    discounts: tuple[float, float, float]


def fit(docs: DataFrame, scratch: Scratch | None = None, shard_tokens: int = SHARD_TOKENS,
        shard_words: int = SHARD_WORDS) -> Model:
    """Counts all of ``docs`` (column text) and stores the model in the shared folder."""
    scratch = scratch or Scratch(docs.sparkSession, "bigram-model")
    folder = local_folder(scratch.path("arrays"))
    os.makedirs(folder, exist_ok=True)
    vocabulary = scratch.keep(word_counts(docs), "words")
    n, v = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    shards = max(1, -(-n // shard_tokens))
    # a word of more than half a shard's tokens: fewer than 2 * shards of them
    heavy = [r[0] for r in vocabulary.where(F.col("n") * 2 * shards > F.lit(n)).select(
        F.shiftrightunsigned("word", 16)).collect()] if shards > 1 else []
    heavy = sorted([*heavy, int(START >> SHORT)])
    listed = np.array(heavy, np.uint64)
    sums = scratch.keep(stored_bigrams(bigram_blobs(docs, listed, shards), folder, shards), "sums")
    of_counts = {r[0]: r[1] for r in sums.where("kind = 'n'").groupBy("id").agg(F.sum("a")).collect()}
    d = discounts([of_counts.get(k, 0) for k in (1, 2, 3, 4)])
    # continuation counts: in how many contexts a word stands
    stands = scratch.keep(sums.where("kind = 'w'").groupBy("id").agg(F.sum("a").alias("m")), "stands")
    many = stands.agg(F.coalesce(F.sum("m"), F.lit(0)), *[
        F.count(F.when(F.col("m") == k, 1)) for k in (1, 2, 3, 4)],
        F.count(F.when(F.col("m") > 2, 1))).first()
    low = discounts(list(many[1:5]))
    free = (low[0] * many[1] + low[1] * many[2] + low[2] * many[5]) / many[0] if many[0] else 1.0
    unknown = free / (v + 1)

    def less(c, ds):
        x = F.col(c)
        return F.greatest(x - F.when(x == 1, ds[0]).when(x == 2, ds[1]).otherwise(ds[2]), F.lit(0.0))
    starts = sums.where("kind = 'c'").groupBy("id").agg(
        *[F.sum(c).alias(c) for c in "abcd"])
    keyed = vocabulary.select("word", "n", F.shiftrightunsigned("word", 16).alias("id")).unionByName(
        docs.sparkSession.createDataFrame(
            [(int(START.view(np.int64)), 0, int(START >> SHORT))], "word long, n long, id long"))
    table = (keyed.join(stands, "id", "left").join(starts, "id", "left").select(
        "word", F.col("n").cast("double").alias("count"),
        (F.when(F.col("m") > 0, less("m", low) / float(max(many[0], 1))).otherwise(F.lit(0.0))
         + F.lit(unknown)).alias("p"),
        F.coalesce(F.col("a"), F.lit(0)).cast("double").alias("total"),
        F.when(F.col("a") > 0, (F.lit(d[0]) * F.col("b") + F.lit(d[1]) * F.col("c")
                                + F.lit(d[2]) * F.col("d")) / F.col("a"))
        .otherwise(F.lit(1.0)).alias("backoff")))
    word_shards = max(1, -(-v // shard_words))

    def store(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for shard in np.unique(batch.column(0).to_numpy()).tolist():
                held.setdefault(shard, []).append(
                    batch.filter(pa.compute.equal(batch.column(0), shard)))
        for shard in sorted(held):
            got = pa.Table.from_batches(held.pop(shard))
            h = got.column("word").to_numpy().view(np.uint64)
            order = np.argsort(h)
            records = np.empty(len(h), RECORD)
            for name in RECORD.names:
                records[name] = got.column(name).to_numpy()[order]
            _write(f"{folder}/word-{shard}.key", h[order])
            _write(f"{folder}/word-{shard}.record", records)
            yield pa.RecordBatch.from_arrays([pa.array([len(h)], pa.int64())], names=["n"])
    placed = table.select(F.pmod("word", F.lit(word_shards)).cast("int").alias("shard"), "*")
    scratch.keep(placed.repartition(word_shards, "shard").mapInArrow(store, "n long"), "stored")
    scratch.drop(sums, stands, vocabulary)
    return Model(folder, word_shards, shards, heavy, int(n), int(v), float(unknown), d)


class _Shards:
    """Memory-mapped sorted hash arrays and their values, opened when first asked."""

    def __init__(self, folder: str, name: str, value: str, kind):
        self.folder, self.name, self.value, self.kind = folder, name, value, np.dtype(kind)
        self.maps: dict[int, tuple] = {}

    def _open(self, shard: int) -> tuple:
        if shard not in self.maps:
            path = f"{self.folder}/{self.name}-{shard}"
            some = os.path.exists(f"{path}.key") and os.path.getsize(f"{path}.key") > 0
            # counts are as wide as keys in a shard whose largest needs it
            wide = some and os.path.getsize(f"{path}.{self.value}") == os.path.getsize(f"{path}.key")
            self.maps[shard] = (np.memmap(f"{path}.key", "<u8", "r"),
                                np.memmap(f"{path}.{self.value}", "<u8" if wide and self.kind == "<u4"
                                          else self.kind, "r")) if some else \
                (np.zeros(0, np.uint64), np.zeros(0, self.kind))
        return self.maps[shard]

    def look_up(self, shard: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value) of each key; keys of one shard are looked up in sorted order."""
        out, found = np.zeros(len(key), np.uint64 if self.kind == "<u4" else self.kind), np.zeros(len(key), bool)
        order = np.lexsort((key, shard))
        s = shard[order]
        cuts = np.flatnonzero(np.diff(s, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(s)]):
            keys, values = self._open(int(s[a]))
            if not len(keys):
                continue
            rows = order[a:b]
            at = np.minimum(np.searchsorted(keys, key[rows]), len(keys) - 1)
            hit = keys[at] == key[rows]
            found[rows] = hit
            out[rows[hit]] = values[at[hit]]
        return found, out


class Scorer:
    def __init__(self, model: Model):
        self.m = model
        self.words = _Shards(model.folder, "word", "record", RECORD)
        self.bigrams = _Shards(model.folder, "bigram", "n", "<u4")
        self.heavy = np.array(model.heavy, np.uint64)

    def _records(self, h: np.ndarray):
        """(known, record) for each hash, looked up once for each distinct one."""
        some, back = np.unique(h, return_inverse=True)
        shard = some.view(np.int64) % self.m.word_shards          # pmod, as Spark computed it
        known, record = self.words.look_up(shard, some)
        return known[back], record[back]

    def __call__(self, data: np.ndarray, offsets: np.ndarray):
        """(tokens, known tokens, base score, model score) of each text."""
        m = self.m
        t, bounds = tokens(data, offsets)
        before = contexts(t, bounds)
        _, word = self._records(t)
        met, context = self._records(before)
        p = np.where(word["p"] > 0, word["p"], m.unknown)
        key, back = np.unique(join_hash(before >> SHORT, t >> SHORT), return_index=True)[0:2]
        c, w = (before >> SHORT)[back], (t >> SHORT)[back]
        _, n = self.bigrams.look_up(shard_of(c, w, self.heavy, m.shards), key)
        n = n[np.searchsorted(key, join_hash(before >> SHORT, t >> SHORT))].astype(float)
        d = np.select([n == 0, n == 1, n == 2], [0.0, m.discounts[0], m.discounts[1]],
                      m.discounts[2])
        met &= context["total"] > 0
        total = np.where(met, context["total"], 1.0)
        p = np.where(met, np.maximum(n - d, 0) / total + context["backoff"] * p, p)
        base = np.log10((word["count"] + 0.5) / (m.tokens + 0.5 * (m.types + 1)))
        sums = [np.add.reduceat(x, bounds[:-1]) for x in
                ((word["count"] > 0).astype(np.int64), base, np.log10(p))]
        return np.diff(bounds), *sums


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    fields = [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")] + \
        [T.StructField(n, T.DoubleType()) for n in ("base_score", "score", "perplexity")]

    def make():
        scorer = Scorer(model)

        def work(data, offsets, rows):
            n, known, base, own = scorer(data, offsets)
            return [n, known, np.full(len(n), model.tokens), base, own,
                    10.0 ** np.minimum(-own / n, 300.0)]
        return work
    return map_texts(docs, text, fields, make, keep_text)
