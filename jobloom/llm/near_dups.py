"""Near-duplicates by BagMinHash signatures, banding and exact multiset overlap.

A document is the multiset of its five-word shingles.  Each (shingle, count) owns a Poisson
process over weight and time, laid out hierarchically: weight is cut into the intervals
[0,1), [1,2), [2,4), [4,8) ...; the process of an interval draws arrival times, and each
arrival is dealt to one unit of its interval and to one slot of the signature.  A slot keeps
the earliest arrival whose unit lies below the document's count.  Equal slots of two
signatures are an unbiased estimate of weighted Jaccard, and no arrival after the largest
slot matters, so generation stops early.

Bands of the signature give candidate buckets.  Candidates are verified exactly (sizes of
the intersection and union of the multisets), links of at least THRESHOLD are kept, and a
document's class is its connected component.  Pairs inside a bucket aren't emitted:
every bucket is first compared with its smallest member (in SALT parts, so that a bucket with a
third of all texts is dealt to many tasks).  Buckets that share members form a
family; only the members outside a family's largest class so far, its strays, are compared with
members of other classes, in blocks: a task holds BLOCK members and lets the strays pass by, looks
at equal signature slots first, verifies what comes near, and hands back one link for each stray and
class.  Any pair left out is inside one class already, so the classes are those of all
candidate pairs (a pair at the threshold has so few equal slots with a chance below 1e-6).

Defined cases: equal texts are one node whatever their number and ids; a text of one to four words
is one shingle of all its words; a text without words (null, empty) has no shingle and is alone;
different texts under one id are judged apart (a class is named by its smallest id); a row without
an id takes part and never names a class (null where no member has an id); extra columns are the
caller's to join; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .textmap import fresh
from .words import blocks, inside_text, join_hash, mix, window_hashes, words

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 30
ROWS = 5                   # slots of a band: 0.8**5 a band, missed by all 30 with 7e-6
SALT = 64                  # parts of a bucket
BLOCK = 256                # members of a family that a task holds against the strays
NEAR = 0.65                # share of equal slots below which a pair isn't verified: 4.6 sigma
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE):
    """(text index, shingle hash) of all shingles of a block, one row an occurrence."""
    _, _, h, bounds = words(data, offsets)
    n = np.diff(bounds)
    inside = inside_text(bounds, size)
    owner = np.repeat(np.arange(len(n)), n)
    own, x = owner[:len(inside)][inside], window_hashes(h, size)[inside] if len(inside) else h[:0]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        y = np.array([_fold(h[bounds[i]:bounds[i + 1]]) for i in short], np.uint64)
        own, x = np.concatenate([own, short]), np.concatenate([x, y])
    return own, x


def _fold(h: np.ndarray) -> np.uint64:
    out = np.array([len(h)], np.uint64)
    for v in h:
        out = join_hash(out, np.array([v], np.uint64))
    return out[0]


def counted(own: np.ndarray, x: np.ndarray):
    """Distinct (text, shingle) with counts, and the rank of each occurrence among its equals."""
    order = np.lexsort((x, own))
    own, x = own[order], x[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (x[1:] != x[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(own)))
    rank = np.arange(len(own)) - np.repeat(first, count)
    return own, x, first, count, rank


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def signatures(own: np.ndarray, x: np.ndarray, count: np.ndarray, n: int, slots: int):
    """(n, slots) arrival times; a text without shingles keeps infinities."""
    weight = np.bincount(own, count, n)
    sig = np.full(n * slots, np.inf)
    # one row for each interval of weight that a count reaches
    top = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 2))).astype(np.int64), 0)
    rows = np.repeat(np.arange(len(x)), top + 1)
    level = np.arange(len(rows)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    length = np.maximum(low, 1)
    start = join_hash(x[rows], level.astype(np.uint64))
    limit = np.full(n, np.log(slots) + 3.0) / np.maximum(weight, 1)
    todo = np.flatnonzero(weight > 0)
    while len(todo):
        wanted = np.zeros(n, bool)
        wanted[todo] = True
        now = np.flatnonzero(wanted[own[rows]])
        h, t = start[now], np.zeros(len(now))
        while len(now):
            h = mix(h + _SPREAD)
            t = t - np.log(_uniform(h)) / (slots * length[now])
            alive = t < limit[own[rows[now]]]
            now, h, t = now[alive], h[alive], t[alive]
            g = mix(h ^ _SPREAD)
            slot = ((g >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
            unit = low[now] + ((g & np.uint64(0xFFFFFFFF)).astype(np.int64) * length[now] >> 32)
            keep = unit < count[rows[now]]
            np.minimum.at(sig, own[rows[now[keep]]] * slots + slot[keep], t[keep])
        full = np.isfinite(sig.reshape(n, slots)[todo]).all(1)
        todo = todo[~full]
        limit[todo] *= 2
    return sig.reshape(n, slots)


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
    out = np.tile(np.arange(bands, dtype=np.uint64), (len(sig), 1))
    for j in range(rows):
        out = join_hash(out, bits[:, :, j])
    return out


def signature_table(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_key, weight, bands): text_key is a digest of the whole text."""
    def run(batches):
        for block, data, off in blocks(batches, "text"):
            n = len(off) - 1
            own, x, first, count, _ = counted(*shingles(data, off))
            sig = signatures(own[first], x[first], count, n, bands * rows)
            weight = np.bincount(own, minlength=n)
            got = band_hashes(sig, bands, rows).view(np.int64)
            some = weight > 0
            ends = np.concatenate([[0], np.cumsum(some * bands)])
            keys = [hashlib.sha256(data[off[i]:off[i + 1]]).digest()[:16] for i in range(n)]
            yield pa.RecordBatch.from_arrays([
                block.column(0), pa.array(keys, pa.binary()), pa.array(weight, pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                         pa.array(got[some].ravel()))],
                names=["doc_id", "text_key", "weight", "bands"])
    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, text_key binary, weight long, bands array<long>")


def unit_table(docs: DataFrame, slots: int = BANDS * ROWS) -> DataFrame:
    """(node, units, slots): sorted distinct hashes of (shingle, occurrence), eight bytes each, and
    one byte of each signature slot."""
    def run(batches):
        for block, data, off in blocks(batches, "text"):
            n = len(off) - 1
            own, x, first, count, rank = counted(*shingles(data, off))
            sig = signatures(own[first], x[first], count, n, slots)
            low = (mix(sig.view(np.uint64)) >> np.uint64(56)).astype(np.uint8)
            u = join_hash(x, rank.astype(np.uint64))
            order = np.lexsort((u, own))
            own, u = own[order], u[order]
            at = np.searchsorted(own, np.arange(n + 1))
            yield pa.RecordBatch.from_arrays([
                block.column(0),
                pa.array([u[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary()),
                pa.array([r.tobytes() for r in low], pa.binary())],
                names=["node", "units", "slots"])
    return docs.select("doc_id", "text").mapInArrow(
        run, "node long, units binary, slots binary")


def _similarity(p: np.ndarray, q: np.ndarray) -> float:
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both / max(1, len(p) + len(q) - both)


def _strays_against_members(threshold: float):
    """Rows come ordered by block: up to BLOCK members, then the strays of their family."""
    def run(batches):
        at, nodes, roots, units, slots = None, [], [], [], []
        held = None
        for batch in batches:
            key, part, stray, node, root, unit, slot = (c.to_pylist() for c in batch.columns)
            links = []
            for i in range(batch.num_rows):
                if (key[i], part[i]) != at:
                    at, nodes, roots, units, slots, held = (key[i], part[i]), [], [], [], [], None
                if not stray[i]:
                    nodes.append(node[i])
                    roots.append(root[i])
                    units.append(np.frombuffer(unit[i], np.uint64))
                    slots.append(np.frombuffer(slot[i], np.uint8))
                    continue
                if not nodes:
                    continue
                if held is None:
                    held = np.stack(slots), np.array(roots), np.array(list(map(len, units)))
                own = np.frombuffer(unit[i], np.uint64)
                least = np.minimum(held[2], len(own)) >= threshold * np.maximum(held[2], len(own))
                near = (held[0] == np.frombuffer(slot[i], np.uint8)).mean(1)
                met = set()
                for j in np.flatnonzero(least & (near >= NEAR) & (held[1] != root[i])).tolist():
                    if roots[j] not in met and _similarity(own, units[j]) >= threshold:
                        met.add(roots[j])
                        links.append((node[i], nodes[j]))
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def overlaps(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """(a, b, similarity): exact weighted Jaccard of each pair of nodes."""
    def run(batches):
        for batch in batches:
            out = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                out.append(_similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.float64())],
                names=["a", "b", "similarity"])
    left = units.select(F.col("node").alias("a"), F.col("units").alias("x"))
    right = units.select(F.col("node").alias("b"), F.col("units").alias("y"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select(
        "a", "b", "x", "y").mapInArrow(run, "a long, b long, similarity double")


def _fits(threshold: float):
    """The weights alone bound the similarity of a pair."""
    return F.least("wa", "wb") >= F.lit(threshold) * F.greatest("wa", "wb")


def _buckets(nodes: DataFrame) -> DataFrame:
    """(a, wa, b, wb): each member of a bucket with its smallest member, in two steps.

    A bucket is dealt in SALT parts; members meet the smallest of their part, and the smallest ones
    of the parts meet the smallest of all, so a band that very many texts share is no heavy key.
    """
    member = nodes.where("weight > 0").select(
        F.struct("node", "weight").alias("m"), F.explode("bands").alias("band"),
        F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int").alias("salt"))
    part = member.withColumn("lead", F.min("m").over(Window.partitionBy("band", "salt")))
    top = part.where("m = lead").select("band", "m").withColumn(
        "lead", F.min("m").over(Window.partitionBy("band")))
    both = part.where("m <> lead").select("lead", "m").union(
        top.where("m <> lead").select("lead", "m"))
    return both.select(F.col("lead.node").alias("a"), F.col("lead.weight").alias("wa"),
                       F.col("m.node").alias("b"), F.col("m.weight").alias("wb")).distinct()


def _classes(docs: DataFrame, scratch: Scratch, threshold: float, bands: int, rows: int):
    """The signature row of each row of ``docs``; (text_key, doc_id, class_id, first_key) of each
    distinct text with words: its smallest id, the smallest id of its class and the key of the
    text that stands for the class."""
    known = docs.select("doc_id", "text")
    sig = scratch.keep(signature_table(known, bands, rows), "signatures")
    nodes = scratch.keep(sig.where("weight > 0").groupBy("text_key").agg(
        F.min("doc_id").alias("doc_id"), F.first("weight").alias("weight"),
        F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()),
        "nodes")
    sig = sig.select("doc_id", "text_key", "weight")
    crowded = scratch.keep(_buckets(nodes), "crowded")
    families = components(crowded.select("a", "b"), scratch).withColumnRenamed("root", "family")
    wanted = nodes.join(families, "node", "left_semi").select("text_key", "doc_id", "node")
    texts = known.select(F.col("doc_id").alias("id"), "text", F.unhex(
        F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32)).alias("key"))
    chosen = texts.join(wanted, (F.col("key") == F.col("text_key"))
                        & F.col("id").eqNullSafe(F.col("doc_id")))
    # repeated rows of one id and text give equal units
    units = scratch.keep(unit_table(chosen.dropDuplicates(["key", "id"]).select(
        F.col("node").alias("doc_id"), "text"), bands * rows), "units")
    star = crowded.where(_fits(threshold)).select("a", "b")
    links = scratch.keep(overlaps(star, units).where(F.col("similarity") >= threshold)
                         .select("a", "b"), "links")
    roots = components(links, scratch)
    more = _stray_links(families, roots, units, scratch, threshold)
    if more is not None:
        roots = components(links.unionByName(more), scratch)
    scratch.drop(units, crowded)
    placed = nodes.select("text_key", "doc_id", "node").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    # ids first: a text that has one stands before those that have none
    first = placed.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("no"), "doc_id", "text_key")).alias("first"))
    return sig, scratch.keep(placed.join(first, "root").select(
        "text_key", "doc_id", F.col("first.doc_id").alias("class_id"),
        F.col("first.text_key").alias("first_key")), "classes")


def _stray_links(families: DataFrame, roots: DataFrame, units: DataFrame, scratch: Scratch,
                 threshold: float) -> DataFrame | None:
    """Links of the strays of each family with the members of its other classes, in blocks."""
    placed = scratch.keep(families.join(roots, "node", "left").select(
        "family", "node", F.coalesce("root", "node").alias("root")), "placed")
    sizes = placed.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n"))
    main = scratch.keep(sizes.groupBy("family").agg(
        F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("classes")).where("classes > 1 AND n > 2").select(
        "family", F.col("most.root").alias("main"),
        F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "mixed")
    if main.isEmpty():
        return None
    split = placed.join(main, "family").join(units, "node")
    held = split.select(
        "family", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("part"),
        F.lit(False).alias("stray"), "node", "root", "units", "slots")
    strays = split.where("root <> main").select(
        "family", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"),
        F.lit(True).alias("stray"), "node", "root", "units", "slots")
    more = scratch.keep(
        held.unionByName(strays).repartition("family", "part")
        .sortWithinPartitions("family", "part", "stray")
        .mapInArrow(_strays_against_members(threshold), "a long, b long"), "more")
    scratch.drop(placed, main)
    return None if more.isEmpty() else more


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id): one row a row of ``docs``; class_id is its class's smallest id."""
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    sig, classes = _classes(docs, scratch, threshold, bands, rows)
    found = sig.where("weight > 0").join(classes.select("text_key", "class_id"), "text_key")
    return found.select("doc_id", "class_id").union(
        sig.where("weight = 0").select("doc_id", F.col("doc_id").alias("class_id")))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS,
                rows: int = ROWS) -> DataFrame:
    """``docs`` without near-duplicates: of each class the row with the smallest id stays (of equal
    ids the one with the smallest digest of the text, of repeated rows one).  Rows without words
    stay."""
    scratch = Scratch(docs.sparkSession, "one-of-each")
    _, classes = _classes(docs, scratch, threshold, bands, rows)
    key, first, own = fresh("_key", docs), fresh("_first", docs), fresh("_own", docs)
    stay = classes.where("text_key = first_key").select(
        F.col("text_key").alias(first), F.col("class_id").alias(own))
    keyed = docs.withColumn(key, F.when(
        F.col("text").rlike(r"[^\x20\x09-\x0D]"),
        F.unhex(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32))))
    worded = keyed.where(F.col(key).isNotNull()).join(
        stay, (F.col(key) == F.col(first)) & F.col("doc_id").eqNullSafe(F.col(own)))
    return worded.dropDuplicates([key, "doc_id"]).select(*[F.col(f"`{c}`") for c in docs.columns]).union(
        keyed.where(F.col(key).isNull()).select(*[F.col(f"`{c}`") for c in docs.columns]))
