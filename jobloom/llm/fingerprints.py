"""Document fingerprints: content-defined chunks, their digests weighted by length.

A boundary follows a byte where a gear hash of the last 16 bytes matches a mask; normalised
chunking uses a strict mask before the normal chunk size and a loose one after it, between a
least and a greatest size.  An insertion moves bytes but not the boundaries after it, so the
set of (digest, length) is shift-resistant.  Likeness of two fingerprints is containment:
the bytes of shared chunks over the bytes of the smaller set.

Defined cases: a null text is an empty one; an empty text has the fingerprint '' and is like
another empty text (1.0) and unlike all others (0.0); equal texts have equal fingerprints;
ties of the id are ordered by the text; one document alone is its own successor; an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import BLOCK_BYTES, mix, powers, text_buffers

LEAST, NORMAL, GREATEST = 16, 64, 256
STRICT = np.uint32(0xFF000000)     # one position in 256 up to NORMAL bytes
LOOSE = np.uint32(0xF0000000)      # one in 16 after that
REACH = 16                         # bytes that a gear hash sees; not above LEAST
_GEAR = np.random.default_rng(77).integers(0, 1 << 32, 256, dtype=np.uint32)
_DIGEST = np.random.default_rng(78).integers(1, 1 << 64, 256, dtype=np.uint64)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
DIGEST_BYTES = 6
MAX_PARTS = 4096
ROWS_PER_PART = 2000


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash at every byte: sum of GEAR[byte] << distance over the last REACH bytes."""
    h = _GEAR[data]
    step = 1
    while step < REACH:
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h, step = more, 2 * step
    return h


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, end) of all chunks; all texts of the block advance together."""
    h = gear(data)
    loose = np.flatnonzero((h & LOOSE) == 0) + 1
    strict = loose[(h[loose - 1] & STRICT) == 0]
    far = np.int64(len(data) + GREATEST + 1)
    loose, strict = np.append(loose, far), np.append(strict, far)
    owner = np.flatnonzero(np.diff(offsets) > 0)
    at, stop = offsets[:-1][owner].astype(np.int64), offsets[1:][owner].astype(np.int64)
    owners, ends = [], []
    while len(owner):
        first = strict[np.searchsorted(strict, at + LEAST)]
        second = loose[np.searchsorted(loose, at + NORMAL)]
        end = np.where(first < at + NORMAL, first, np.minimum(second, at + GREATEST))
        end = np.minimum(end, stop)
        owners.append(owner)
        ends.append(end)
        more = end < stop
        owner, at, stop = owner[more], end[more], stop[more]
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owners, ends = np.concatenate(owners), np.concatenate(ends)
    order = np.lexsort((ends, owners))
    return owners[order], ends[order]


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """48-bit digests of the spans, from prefix sums over pieces that hold whole chunks."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + BLOCK_BYTES, side="right")))
        s, e = starts[at:to] - base, ends[at:to] - base
        n = int(e[-1])
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_DIGEST[data[base:base + n]] * powers(_BASE, n), out=sums[1:])
        out[at:to] = mix((sums[e] - sums[s]) * powers(_INVERSE, n)[s] + (e - s).astype(np.uint64))
        at = to
    return out >> np.uint64(64 - 8 * DIGEST_BYTES)


def chunk_sets(data: np.ndarray, offsets: np.ndarray):
    """Distinct (text, digest, length), ordered by text and digest."""
    owner, ends = chunk_ends(data, offsets)
    starts = np.empty_like(ends)
    starts[1:] = ends[:-1]
    head = np.ones(len(owner), bool)
    head[1:] = owner[1:] != owner[:-1]
    starts[head] = offsets[:-1][owner[head]]
    digest, size = _digests(data, starts, ends), ends - starts
    order = np.lexsort((size, digest, owner))
    owner, digest, size = owner[order], digest[order], size[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (digest[1:] != digest[:-1]) | (size[1:] != size[:-1])
    return owner[new], digest[new], size[new]


def likeness(a, b, n: int) -> np.ndarray:
    """Containment by bytes of text i of set ``a`` and text i of set ``b``, for i below ``n``."""
    total = [np.bincount(s[0], s[2], n)[:n] for s in (a, b)]
    keep = b[0] < n
    key = np.concatenate([a[0][a[0] < n], b[0][keep]])
    digest = np.concatenate([a[1][a[0] < n], b[1][keep]])
    size = np.concatenate([a[2][a[0] < n], b[2][keep]])
    order = np.lexsort((size, digest, key))
    key, digest, size = key[order], digest[order], size[order]
    twin = (key[1:] == key[:-1]) & (digest[1:] == digest[:-1]) & (size[1:] == size[:-1])
    shared = np.bincount(key[1:][twin], size[1:][twin], n)[:n]
    least = np.minimum(*total)
    both_empty = np.maximum(*total) == 0
    return np.where(both_empty, 1.0, np.divide(shared, least, out=np.zeros(n), where=least > 0))


def as_text(sets, n: int) -> list[str]:
    """Fingerprints as text: for each chunk 12 hex digits of digest and 2 of its length - 1."""
    owner, digest, size = sets
    raw = np.empty((len(owner), DIGEST_BYTES + 1), np.uint8)
    raw[:, :DIGEST_BYTES] = digest.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - DIGEST_BYTES:]
    raw[:, DIGEST_BYTES] = size - 1
    at = np.searchsorted(owner, np.arange(n + 1)) * (DIGEST_BYTES + 1)
    text = raw.tobytes().hex()
    return [text[2 * a:2 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _code_points(raw: np.ndarray) -> np.ndarray:
    return np.flatnonzero((raw & 0xC0) != 0x80)


def edited(raw: np.ndarray, following: np.ndarray) -> tuple[int, bytes]:
    """(code points of ``raw``, its text with the last third replaced from ``following``)."""
    points = _code_points(raw)
    n = len(points)
    k = n // 3
    if not k:
        return n, raw.tobytes()
    head = raw[:points[n - k]].tobytes()
    limit = 4 * k                                # bytes that k code points take at most
    after = _code_points(following[:limit + 4])
    end = after[k] if k < len(after) else min(len(following), limit + 4)
    return n, head + following[:end].tobytes()


def _compare(rows: list[tuple], texts: list[np.ndarray]) -> pa.RecordBatch:
    """Results of texts 0 .. len(rows) - 1; ``texts`` has one more, the last one's successor."""
    n = len(rows)
    counts, others = [], []
    for i in range(n):
        count, other = edited(texts[i], texts[i + 1])
        counts.append(count)
        others.append(other)
    own = chunk_sets(np.concatenate(texts),
                     np.cumsum([0, *map(len, texts)]))
    other_raw = np.frombuffer(b"".join(others), np.uint8)
    new = chunk_sets(other_raw, np.cumsum([0, *map(len, others)]))
    shifted = (own[0] - 1, own[1], own[2])
    ahead = tuple(x[own[0] > 0] for x in shifted)
    return pa.RecordBatch.from_arrays([
        pa.array(rows, pa.int64()),
        pa.array(counts, pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in others]),
        pa.array(as_text(own, n)), pa.array(as_text(new, n)),
        pa.array(likeness(own, new, n)), pa.array(likeness(own, ahead, n)),
    ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
              "near_edited", "near_next"])


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")


def _stream(batches):
    """Rows come ordered by (part, id descending); the last row of a part is its successor's."""
    keys: list = []            # (part, extra, id) of rows not yet emitted, with their texts
    texts: list[np.ndarray] = []
    held = 0

    def emit(final: bool):
        nonlocal keys, texts, held
        # cut into runs of one part; a run's last row serves as successor only
        at = 0
        while at < len(keys):
            to = at
            while to < len(keys) and keys[to][0] == keys[at][0]:
                to += 1
            if to - at > 1:
                stop = next((i for i in range(at, to) if keys[i][1]), to - 1)
                rows = [k[2] for k in keys[at:stop]]
                if rows:
                    yield _compare(rows, texts[at:stop + 1])
            if to == len(keys) and not final:
                keys, texts = keys[-1:], texts[-1:]
                held = sum(map(len, texts))
                return
            at = to
        keys, texts, held = [], [], 0

    for batch in batches:
        data, off = text_buffers(batch.column(3))
        parts, extra, ids = (batch.column(i).to_pylist() for i in range(3))
        for i in range(batch.num_rows):
            raw = data[off[i]:off[i + 1]]
            if keys and keys[-1][1] and extra[i] and keys[-1][0] == parts[i]:
                continue                          # one successor is enough
            keys.append((parts[i], extra[i], ids[i]))
            texts.append(raw)
            held += len(raw)
            if held > BLOCK_BYTES and len(keys) > 1:
                yield from emit(False)
        texts = [t.copy() for t in texts]         # they outlive the batch
    yield from emit(True)


def _edges_at_or_above(splits: list[int], step: int = 64) -> Column:
    """How many of the descending ``splits`` are >= doc_id, looked up in two steps."""
    groups = [splits[i:i + step] for i in range(0, len(splits), step)]
    if not groups:
        return F.lit(0)
    ints = lambda xs: F.array(*[F.lit(int(x)).cast("long") for x in xs])
    above = lambda xs: F.size(F.filter(xs, lambda e: e >= F.col("doc_id")))
    whole = above(ints([g[-1] for g in groups]))
    nested = F.array(*[ints(g) for g in groups])
    rest = F.coalesce(above(F.get(nested, whole)), F.lit(0))
    return F.when(whole < len(groups), whole * step + rest).otherwise(F.lit(len(splits)))


def with_successors(docs: DataFrame, rows_per_part: int = ROWS_PER_PART,
                    max_parts: int = MAX_PARTS) -> DataFrame:
    """(part, extra, doc_id, text): each part is a range of descending ids, and the first
    document of the following part stands in it once more (``extra``) as successor.

    Split points and the first id of each part are the only things the driver sees: at most
    ``max_parts`` longs, from the id column alone.  The texts are shuffled once.
    """
    ids = docs.select("doc_id")
    n = ids.count()
    parts = max(1, min(max_parts, -(-n // rows_per_part)))
    splits = []
    if parts > 1:
        got = ids.select(F.percentile_approx(
            "doc_id", F.array(*[F.lit(i / parts) for i in range(1, parts)]),
            F.lit(20 * parts))).first()[0]
        splits = sorted(set(got or []), reverse=True)
    # part 0 has the ids above splits[0], and so on; nulls come last
    part = F.when(F.col("doc_id").isNull(), F.lit(len(splits) + 1)).otherwise(
        _edges_at_or_above(splits))
    placed = docs.select("doc_id", "text", part.cast("int").alias("part"))
    heads = {r[0]: r[1] for r in placed.groupBy("part").agg(F.max("doc_id")).collect()}
    order = sorted(heads)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    every = range(len(splits) + 2)
    first = F.array(*[F.lit(heads.get(p)).cast("long") for p in every])
    previous = F.array(*[F.lit(before.get(p)).cast("int") for p in every])
    here = F.struct(F.col("part"), F.lit(False).alias("extra"))
    there = F.struct(F.element_at(previous, F.col("part") + 1).alias("part"),
                     F.lit(True).alias("extra"))
    is_head = F.element_at(first, F.col("part") + 1).eqNullSafe(F.col("doc_id"))
    placed = placed.withColumn("_to", F.when(is_head, F.array(here, there))
                               .otherwise(F.array(here)))
    placed = placed.select(F.explode("_to").alias("_to"), "doc_id", "text").select(
        "_to.part", "_to.extra", "doc_id", "text")
    width = max(1, len(heads))
    return (placed.withColumn("text", F.coalesce("text", F.lit("")))
            .repartition(width, "part")
            .sortWithinPartitions("part", "extra", F.col("doc_id").desc_nulls_last(), "text"))


def fingerprint_pairs(docs: DataFrame, **parts) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has its last third (code points) replaced by the beginning of the next
    document in descending order of ``doc_id``; after the last comes the first.
    """
    return with_successors(docs, **parts).mapInArrow(_stream, SCHEMA)


def fingerprint(docs: DataFrame, text: str = "text", column: str = "fingerprint",
                keep_text: bool = True) -> DataFrame:
    """``docs`` with the fingerprint of each text in ``column``."""
    from .textmap import map_texts

    def make():
        return lambda data, offsets, rows: [
            as_text(chunk_sets(data, offsets), len(offsets) - 1)]
    return map_texts(docs, text, [T.StructField(column, T.StringType())], make, keep_text)
