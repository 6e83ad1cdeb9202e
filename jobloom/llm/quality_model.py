"""Quality classifier: an interpolated modified Kneser-Ney model over byte n-grams.

Trained on trusted text, asked for every document through sharded joins, and thresholded at a
quantile of held-out trusted documents of the same language.

An n-gram of ORDER bytes is its own key (a number), and its shard is a hash of the last two bytes
of its context.  All n-grams that the interpolation of one key needs down to order 3 have these two
bytes in the same place, so a shard answers a key alone; orders 2 and 1 are 65,792 numbers at most
and go to every task.  Documents travel in compressed blocks.  A block asks each shard once for
its distinct keys, however often they occur, and the answers (log probabilities) come back to the
block, which sums them by document.  Requests of one shard are spread over copies of it, so
frequent bytes make no task larger; a shard holds distinct n-grams, not occurrences.

Defined cases: a null or empty text has no perplexity and isn't kept; a language without trusted
documents (a null one too) takes the quantile over all; without trusted text nothing has a threshold
and every text with a byte is kept; a null id is never trusted; rows that repeat get a row each;
an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lm_scoring import discounts
from .scratch import Scratch
from .textmap import fresh
from .words import blocks, mix

ORDER = 5
SHARDS = 128
BLOCK = 8 << 20                 # bytes of text in a block
REQUESTS = 2000                 # blocks that one copy of a shard answers
QUANTILE = 0.995
_U = np.uint64


def ngrams(data: np.ndarray, offsets: np.ndarray, piece: int = 1 << 20):
    """Pieces (first byte, keys, texts): the key of the ORDER bytes that end at each byte and the
    text it is in; zeros stand before a text."""
    for at in range(0, len(data), piece):
        to, low = min(at + piece, len(data)), max(at - ORDER + 1, 0)
        where = np.arange(low, to)
        text = np.searchsorted(offsets, where, side="right") - 1
        place = (where - offsets[text])[at - low:]
        raw = data[low:to].astype(np.uint64)
        out = raw[at - low:].copy()
        for j in range(1, ORDER):
            before = np.zeros(to - at, np.uint64)
            some = place >= j
            before[some] = raw[np.flatnonzero(some) + (at - low) - j]
            out |= before << _U(8 * j)
        yield at, out, text[at - low:]


def shard_of(key: np.ndarray, shards: int = SHARDS) -> np.ndarray:
    return (mix(((key >> _U(8)) & _U(0xFFFF)) + _U(1)) % _U(shards)).astype(np.int64)


def distinct(data: np.ndarray, offsets: np.ndarray):
    """Distinct keys of a block of texts, ordered by shard and key, with their numbers."""
    some, n = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for _, key, _ in ngrams(data, offsets):
        k, c = np.unique(key, return_counts=True)
        some.append(k)
        n.append(c)
    key, n = _summed(np.concatenate(some), np.concatenate(n))
    order = np.lexsort((key, shard_of(key)))
    return key[order], n[order]


def _packed(key: np.ndarray) -> bytes:
    """Rising keys as byte planes of their gaps: the high planes are zeros that the shuffle's
    compression removes."""
    gaps = np.diff(key, prepend=_U(0)).astype("<u8")
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :ORDER].T).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    n = len(raw) // ORDER
    out = np.zeros((n, 8), np.uint8)
    out[:, :ORDER] = np.frombuffer(raw, np.uint8).reshape(ORDER, n).T
    return np.cumsum(out.reshape(-1).view("<u8"), dtype=np.uint64)


def _summed(key: np.ndarray, n: np.ndarray):
    some, at = np.unique(key, return_inverse=True)
    return some, np.bincount(at, n, len(some)).astype(np.int64)


def _by_shard(key: np.ndarray):
    s = shard_of(key)
    at = np.searchsorted(s, np.arange(SHARDS + 1))
    return [(k, slice(int(at[k]), int(at[k + 1]))) for k in np.flatnonzero(np.diff(at)).tolist()]


def counts(stored: DataFrame, trusted: DataFrame) -> DataFrame:
    """(shard, keys, n): n-grams of the trusted texts (by doc_id), one row a shard.

    Only ids are joined with the trusted ones; the texts stay in their blocks, and a block gets
    the list of its trusted ids (as long as the block at most)."""
    marks = _places(stored).join(trusted.select("doc_id").distinct(), "doc_id").groupBy(
        "block").agg(F.collect_set("doc_id").alias("ids"))

    def local(batches):
        for batch in batches:
            for raw, ids in zip(*(c.to_pylist() for c in batch.columns)):
                rows, data, off = _unpack(raw)
                own = pa.compute.is_in(rows.column(0), pa.array(ids, pa.int64())).to_numpy(
                    zero_copy_only=False)
                size = np.diff(off)
                key, n = distinct(data[np.repeat(own, size)],
                                  np.concatenate([[0], np.cumsum(size[own])]))
                for shard, part in _by_shard(key):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard], pa.int32()),
                         pa.array([key[part].tobytes()], pa.binary()),
                         pa.array([n[part].tobytes()], pa.binary())],
                        names=["shard", "keys", "n"])

    def total(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for shard, keys, n in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(shard, []).append(
                    (np.frombuffer(keys, _U), np.frombuffer(n, np.int64)))
                if len(held[shard]) >= 16:            # sum early: distinct n-grams bound a shard
                    held[shard] = [_summed(*(np.concatenate(x) for x in zip(*held[shard])))]
        for shard, parts in sorted(held.items()):
            key, n = _summed(*(np.concatenate(x) for x in zip(*parts)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([key.tobytes()], pa.binary()),
                 pa.array([n.tobytes()], pa.binary())], names=["shard", "keys", "n"])
    schema = "shard int, keys binary, n binary"
    return stored.join(marks, "block").select("rows", "ids").mapInArrow(
        local, schema).repartition(SHARDS, "shard").mapInArrow(total, schema)


def _shorter(key: np.ndarray, order: int) -> np.ndarray:
    return key & _U((1 << 8 * order) - 1)


def _levels(key: np.ndarray, n: np.ndarray, lowest: int):
    """order -> (keys, counts): counts of the highest order, continuation counts below it."""
    out = {ORDER: (key, n)}
    for order in range(ORDER - 1, lowest - 1, -1):
        out[order] = np.unique(_shorter(out[order + 1][0], order), return_counts=True)
    return out


def _summary(model: DataFrame) -> DataFrame:
    """(order, key, n): count-of-counts 1 to 4 of orders 3 up, and the order-2 counts."""
    def run(batches):
        for batch in batches:
            for keys, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                levels = _levels(np.frombuffer(keys, _U), np.frombuffer(n, np.int64), 3)
                rows = [(o, k, int((c == k).sum())) for o, (_, c) in levels.items()
                        for k in (1, 2, 3, 4)]
                pairs, c = np.unique(_shorter(levels[3][0], 2), return_counts=True)
                rows += [(2, int(p), int(x)) for p, x in zip(pairs, c)]
                o, k, c = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(o, pa.int32()), pa.array(k, pa.int64()), pa.array(c, pa.int64())],
                    names=["order", "key", "n"])
    return model.mapInArrow(run, "order int, key long, n long").groupBy("order", "key").agg(
        F.sum("n").alias("n"))


def _less(n: np.ndarray, d) -> np.ndarray:
    return np.where(n > 0, n - np.select([n == 1, n == 2], [d[0], d[1]], d[2]), 0.0)


class Low:
    """Probabilities of a byte after one byte, from at most 65,536 pair counts."""

    def __init__(self, pairs: dict[int, int], ds: dict[int, tuple]):
        self.ds = dict(ds)
        n2 = np.zeros(65536)
        n2[list(pairs)] = list(pairs.values())
        n2 = n2.reshape(256, 256)                    # [context, byte]
        n1 = (n2 > 0).sum(0)
        of = lambda n: [int((n == k).sum()) for k in (1, 2, 3, 4)]
        d2, d1 = discounts(of(n2)), discounts(of(n1))
        first = np.full(256, 1 / 256)
        if n1.sum():
            free = sum(d * ((n1 == k) if k < 3 else (n1 > 2)).sum() for k, d in enumerate(d1, 1))
            first = _less(n1, d1) / n1.sum() + free / n1.sum() / 256
        total = n2.sum(1, keepdims=True)
        free = sum(d * ((n2 == k) if k < 3 else (n2 > 2)).sum(1, keepdims=True)
                   for k, d in enumerate(d2, 1))
        seen = np.maximum(total, 1)
        self.p = np.where(total > 0, _less(n2, d2) / seen + free / seen * first, first).ravel()


class Shard:
    """Answers keys of its shard: the interpolated probability from order 3 to ORDER."""

    def __init__(self, low: Low, keys: np.ndarray, n: np.ndarray):
        self.low, self.levels = low, []
        levels = _levels(keys, n, 3) if len(keys) else {}
        for order in sorted(levels):
            key, c = levels[order]
            d = low.ds[order]
            context, at = np.unique(key >> _U(8), return_inverse=True)
            total = np.bincount(at, c)
            free = sum(x * np.bincount(at, (c == k) if k < 3 else (c > 2))
                       for k, x in enumerate(d, 1))
            self.levels.append((order, key, _less(c, d) / total[at], context, free / total))

    def __call__(self, key: np.ndarray) -> np.ndarray:
        p = self.low.p[(_shorter(key, 2)).astype(np.int64)]
        for order, known, own, context, free in self.levels:
            k = _shorter(key, order)
            at = np.minimum(np.searchsorted(context, k >> _U(8)), len(context) - 1)
            met = context[at] == k >> _U(8)
            i = np.minimum(np.searchsorted(known, k), len(known) - 1)
            p = np.where(met, np.where(known[i] == k, own[i], 0.0) + free[at] * p, p)
        return np.log(p).astype(np.float32)


def text_blocks(docs: DataFrame) -> DataFrame:
    """(block, rows): compressed runs of documents (ids as Arrow, texts, offsets)."""
    columns = [c for c in docs.columns if c != "text"]

    def run(batches):
        pack, part, k = zstandard.ZstdCompressor(level=9), TaskContext.get().partitionId(), 0
        for rows, data, off in blocks(batches, "text", BLOCK):
            sink = pa.BufferOutputStream()
            out = pa.RecordBatch.from_arrays(
                [*(rows.column(i) for i in range(len(columns))), pa.array(off[1:])],
                names=[*columns, "end"])
            with pa.ipc.new_stream(sink, out.schema) as w:
                w.write_batch(out)
            head = sink.getvalue().to_pybytes()
            raw = pack.compress(len(head).to_bytes(8, "little") + head + data.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | k], pa.int64()), pa.array([raw], pa.binary())],
                names=["block", "rows"])
            k += 1
    return docs.select(*columns, "text").mapInArrow(run, "block long, rows binary")


def _unpack(raw: bytes):
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int.from_bytes(raw[:8], "little")
    rows = pa.ipc.open_stream(raw[8:8 + n]).read_next_batch()
    off = np.concatenate([[0], rows.column(rows.num_columns - 1).to_numpy()])
    return rows, np.frombuffer(raw, np.uint8)[8 + n:], off


def _places(stored: DataFrame) -> DataFrame:
    """(doc_id, block) of all documents."""
    def run(batches):
        for batch in batches:
            for block, raw in zip(*(c.to_pylist() for c in batch.columns)):
                ids = _unpack(raw)[0].column(0)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.full(len(ids), block))], names=["doc_id", "block"])
    return stored.mapInArrow(run, "doc_id long, block long")


def _requests(stored: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for block, raw in zip(*(c.to_pylist() for c in batch.columns)):
                _, data, off = _unpack(raw)
                key, _ = distinct(data, off)
                for shard, part in _by_shard(key):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard], pa.int32()), pa.array([block], pa.int64()),
                         pa.array([_packed(key[part])], pa.binary())],
                        names=["shard", "block", "keys"])
    return stored.mapInArrow(run, "shard int, block long, keys binary")


def perplexities(docs: DataFrame, trusted: DataFrame, scratch: Scratch) -> DataFrame:
    """The columns of ``docs`` but ``text``, with ``n_bytes`` and ``log_p`` (natural log);
    ``trusted`` has the doc_id of the texts that train the model."""
    columns = ["doc_id", *(c for c in docs.columns if c not in ("doc_id", "text"))]
    docs = docs.select(*columns, "text")
    stored = scratch.keep(text_blocks(docs), "blocks")
    model = scratch.keep(counts(stored, trusted), "counts")
    ds: dict[int, list] = {}
    pairs: dict[int, int] = {}
    for order, key, n in _summary(model).collect():        # 65,536 pairs and 12 counts at most
        if order == 2:
            pairs[key] = n
        else:
            ds.setdefault(order, [0] * 4)[key - 1] = n
    low = Low(pairs, {o: discounts(n) for o, n in ds.items()})
    n_blocks = stored.count()
    copies = max(1, -(-n_blocks // REQUESTS))
    spread = F.pmod(F.xxhash64("block"), F.lit(copies)).cast("int")
    ask = _requests(stored).select("shard", spread.alias("copy"), "block", "keys",
                                   F.lit(None).cast("binary").alias("n"))
    know = model.select("shard", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"),
                        F.lit(-1).cast("long").alias("block"), "keys", "n")

    def answer(batches):
        at, shard = None, Shard(low, np.zeros(0, _U), np.zeros(0, np.int64))
        for batch in batches:
            s, copy, block, keys, n = (c.to_pylist() for c in batch.columns)
            for i in range(batch.num_rows):
                mine = block[i] < 0
                if (s[i], copy[i]) != at:
                    at = s[i], copy[i]
                    shard = Shard(low, *(np.frombuffer(keys[i], _U), np.frombuffer(n[i], np.int64))
                                  if mine else (np.zeros(0, _U), np.zeros(0, np.int64)))
                if not mine:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block[i]], pa.int64()), pa.array([s[i]], pa.int32()),
                         pa.array([shard(_unpacked(keys[i])).tobytes()], pa.binary())],
                        names=["block", "shard", "rows"])
    answers = (ask.unionByName(know).repartition(SHARDS * copies, "shard", "copy")
               .sortWithinPartitions("shard", "copy", "block")
               .mapInArrow(answer, "block long, shard int, rows binary"))
    back = (answers.unionByName(stored.select("block", F.lit(-1).alias("shard"), "rows"))
            .repartition(max(1, n_blocks), "block").sortWithinPartitions("block", "shard"))
    schema = docs.select(*columns).schema.add("n_bytes", "long").add("log_p", "double")

    def collect(batches):
        rows, got = None, []

        def done():
            r, data, off = _unpack(rows)
            key, _ = distinct(data, off)
            logs = np.concatenate(got) if got else np.zeros(0, np.float32)
            sums = np.zeros(len(off) - 1)
            order = np.argsort(key)
            sorted_key, sorted_log = key[order], logs[order]
            for _, k, text in ngrams(data, off):
                logp = sorted_log[np.searchsorted(sorted_key, k)].astype(float)
                sums += np.bincount(text, logp, len(sums))
            out = [r.column(i) for i in range(len(columns))]
            return pa.RecordBatch.from_arrays(
                [*out, pa.array(np.diff(off)), pa.array(sums)],
                names=[*columns, "n_bytes", "log_p"])

        for batch in batches:
            for _, shard, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if shard < 0:
                    if rows is not None:
                        yield done()
                    rows, got = raw, []
                else:
                    got.append(np.frombuffer(raw, np.float32))
        if rows is not None:
            yield done()
    return back.mapInArrow(collect, schema)


def classify(docs: DataFrame, trusted: DataFrame, held: Column, quantile: float = QUANTILE,
             lang: str = "lang") -> DataFrame:
    """``docs`` (without the text) with trusted, n_bytes, perplexity, threshold and kept.

    ``trusted`` has the ids of trusted texts.  Those for which ``held`` (a condition on doc_id) is
    false train the model; the perplexities of the others give each language's quantile.
    """
    scratch = Scratch(docs.sparkSession, "quality-model")
    replaced = ("trusted", "n_bytes", "log_p", "perplexity", "threshold", "kept")
    docs = docs.drop(*replaced)
    ids = trusted.select("doc_id").where("doc_id IS NOT NULL").distinct()
    found = perplexities(docs, ids.where(~held), scratch)
    found = scratch.keep(
        found.join(ids.withColumn("trusted", F.lit(True)), "doc_id", "left").withColumns({
            "trusted": F.coalesce("trusted", F.lit(False)),
            "perplexity": F.when(F.col("n_bytes") > 0, F.exp(-F.col("log_p") / F.col("n_bytes")))}),
        "perplexities")
    judge = found.where(F.col("trusted") & held & F.col("perplexity").isNotNull())
    of = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10000))
    of_lang, own = fresh("_lang", found), fresh("_own", found)
    by_lang = judge.groupBy(F.col(lang).alias(of_lang)).agg(of.alias(own))
    overall = judge.agg(of).first()[0]
    out = found.join(by_lang, found[lang].eqNullSafe(by_lang[of_lang]), "left")
    threshold = F.coalesce(own, F.lit(overall).cast("double"))
    return out.withColumn("threshold", threshold).withColumn("kept", F.coalesce(
        F.col("perplexity") <= F.coalesce("threshold", F.lit(float("inf"))), F.lit(False))).select(
        *[c for c in docs.columns if c != "text"], "trusted", "n_bytes", "perplexity",
        "threshold", "kept")
