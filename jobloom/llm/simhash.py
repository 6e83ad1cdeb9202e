"""SimHash near-duplicates by pivot distance tables.

A fingerprint holds 64 majority bits of the XXH64 values of a text's three-word shingles.  Equal
fingerprints are one code.  PIVOTS codes, those with the smallest hashes, are the references; the
Hamming distances of a code to them are its row of the pivot table.  Two codes that differ in at
most REACH bits have distances to every reference that differ by at most REACH, so a pair whose
greatest coordinate difference is larger can't link and is discarded; the others are verified.

The same rule deals the work.  A reference splits the codes at a border of its distances; a code
less than REACH below the border goes to both sides, so each pair that may link meets in a cell.
The splits (the references with the evenest split and the fewest codes near the border, from an
exact histogram of all distances) go on until a cell holds about CELL codes.  A task holds one cell
at a time, lists it by distance to one reference, looks at the window of REACH around each code,
discards by the other coordinates, verifies, and hands back links to the smallest code of each
local component, never the pairs.

Codes that lie so close together that no reference parts them (a group of very many near copies)
fill a cell beyond CROWDED.  Such cells don't go to a task: their codes are linked exactly by the
65 words within one bit of each; codes at most two bits apart share one of those, and any two that
share one are at most two bits apart, so each group has at most 65 codes and is linked to its
smallest.

Defined cases: a null text has no words, and no words give the fingerprint zero, which links like
any other; one or two words are one shingle; rows with the same id are rows of their own (they
link if their fingerprints do); a row without an id takes part, has the component of its
fingerprint and never names one (null where no member has an id); an empty table gives an empty
table; other columns of the input are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, smallest_reachable
from .scratch import Scratch
from .words import blocks, words

SHINGLE = 3
SEED = 42
REACH = 2
PIVOTS = 64                # references of the table
CELL = 256                 # codes that the splits aim at
CROWDED = 8192             # rows of a cell above which it is linked by one-bit neighbours
CHUNK = 65_536             # words hashed at a time
PAIRS = 1 << 21            # pairs of a window looked at in one go
_BITS = np.array([[i >> j & 1 for j in range(8)] for i in range(256)], np.int64)
_ONE = np.uint64(1)


def _bit_counts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[int, np.ndarray]:
    """(shingles, how many of them have each of the 64 bits) of one text's words."""
    n = len(starts)
    total, counts = 0, np.zeros(64, np.int64)
    width = min(SHINGLE, n)
    if not n:
        return 0, counts
    for at in range(0, n - width + 1, CHUNK):
        to = min(n, at + CHUNK + width - 1)
        parts = data[starts[at]:ends[to - 1]].tobytes().lower().split()
        text = b" ".join(parts)
        stop = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        first = np.concatenate([[0], stop[:-1] + 1])[:len(parts) - width + 1].tolist()
        h = np.array([xxhash.xxh64_intdigest(text[a:b], SEED)
                      for a, b in zip(first, stop[width - 1:].tolist())], np.uint64)
        total += len(h)
        eight = h.astype("<u8").view(np.uint8).reshape(-1, 8)
        for j in range(8):
            counts[8 * j:8 * j + 8] += np.bincount(eight[:, j], minlength=256) @ _BITS
    return total, counts


def codes_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprints of the texts of a block."""
    starts, ends, _, bounds = words(data, offsets)
    out = np.zeros(len(offsets) - 1, np.uint64)
    for i in range(len(out)):
        total, counts = _bit_counts(data, starts[bounds[i]:bounds[i + 1]],
                                    ends[bounds[i]:bounds[i + 1]])
        out[i] = np.packbits(2 * counts > total, bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, code): a row for each row of ``docs``; the 64 bits as a long."""
    def run(batches):
        for rows, data, off in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(codes_of(data, off).view(np.int64))],
                names=["doc_id", "code"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, code long")


def distances(code: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivot table: (codes, pivots) Hamming distances, a byte each."""
    return np.bitwise_count(code[:, None] ^ pivots[None, :])


def _codes(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)


def _histogram(codes: DataFrame, pivots: np.ndarray) -> np.ndarray:
    """(pivots, 65): how many codes lie at each distance of each reference."""
    def run(batches):
        seen = np.zeros((len(pivots), 65), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                d = distances(_codes(batch.slice(i, CHUNK)), pivots)
                for k in range(len(pivots)):
                    seen[k] += np.bincount(d[:, k], minlength=65)
        k, d = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(k, pa.int32()), pa.array(d, pa.int32()), pa.array(seen[k, d])],
            names=["k", "d", "n"])
    out = np.zeros((len(pivots), 65), np.int64)
    for k, d, n in codes.mapInArrow(run, "k int, d int, n long").groupBy("k", "d").agg(
            F.sum("n")).collect():
        out[k, d] = n
    return out


def borders(seen: np.ndarray, reach: int = REACH, cell: int = CELL) -> list[tuple[int, int]]:
    """(reference, border) of the splits in order, until a pair's cell holds about ``cell`` codes.

    Work falls by the share of pairs that still meet and rows grow by the share that goes to both
    sides; the references with the best ratio come first.
    """
    total = int(seen[0].sum()) if len(seen) else 0
    found = []
    for k, row in enumerate(seen):
        below = np.concatenate([[0], np.cumsum(row)]) / max(1, total)
        for d in range(1, 65):
            low = below[d]
            both = low - below[max(0, d - reach)]
            high = 1 - low + both
            meet = (low * low + high * high) / (low + high)
            if 0 < low < 1 and meet < 0.95:
                found.append((math.log1p(both) / -math.log(meet), k, d, meet))
    found.sort()
    out, used, size = [], set(), float(total)
    for _, k, d, meet in found:
        if size <= cell or len(out) == 62:
            break
        if k not in used:
            used.add(k)
            out.append((k, d))
            size *= meet
    return out


def deal(code: np.ndarray, pivots: np.ndarray, splits: list[tuple[int, int]],
         reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """(cell, index of the code): a code near a border lies on both sides of it."""
    index = np.arange(len(code))
    cell = np.zeros(len(code), np.int64)
    for j, (k, border) in enumerate(splits):
        d = np.bitwise_count(code[index] ^ pivots[k])
        high = d >= border
        near = ~high & (d + reach >= border)
        side = np.int64(1 << j)
        cell, index = (np.concatenate([np.where(high, cell | side, cell), cell[near] | side]),
                       np.concatenate([index, index[near]]))
    return cell, index


def linked(code: np.ndarray, pivots: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """Links (larger, smallest of its component) among the codes of a cell, by their pivot table."""
    if len(code) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = distances(code, pivots)
    order = np.argsort(table[:, 0], kind="stable")
    code, table = code[order], np.ascontiguousarray(table[order].T).astype(np.int8)
    end = np.searchsorted(table[0], table[0] + reach, side="right")
    width = end - np.arange(len(code)) - 1
    ends = np.cumsum(width)
    found_a, found_b, at = [], [], 0
    while at < len(code):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right"))
        to = max(to, at + 1)
        w = width[at:to]
        i = np.repeat(np.arange(at, to), w)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w)
        for row in table[1:]:
            if not len(i):
                break
            near = np.abs(row[i] - row[j]) <= reach      # the greatest difference so far
            i, j = i[near], j[near]
        true = np.bitwise_count(code[i] ^ code[j]) <= reach
        found_a.append(i[true])
        found_b.append(j[true])
        at = to
        if sum(map(len, found_a)) > PAIRS:               # a dense cell: keep a forest only
            node, root = smallest_reachable(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b = [node], [root]
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    signed = code.view(np.int64)
    node, root = smallest_reachable(signed[a], signed[b])
    return node[node != root], root[node != root]


def _cell_links(pivots: np.ndarray, reach: int):
    """Rows (cell, code) come sorted by cell; a cell's links leave when the next one begins."""
    def flush(parts):
        code = np.unique(np.concatenate(parts)).view(np.uint64)
        return linked(code, pivots, reach)

    def batch(out):
        a, b = (np.concatenate(x) for x in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        now, parts, out = None, [], []
        for rows in batches:
            cell = rows.column(0).to_numpy(zero_copy_only=False)
            code = rows.column(1).to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if x == y:
                    continue
                if now is not None and cell[x] != now:
                    out.append(flush(parts))
                    parts = []
                now = cell[x]
                parts.append(code[x:y])
            if sum(len(a) for a, _ in out) > CHUNK:
                yield batch(out)
                out = []
        if parts:
            out.append(flush(parts))
        if out:
            yield batch(out)
    return run


def one_bit_links(codes: DataFrame) -> DataFrame:
    """(a, b): links of distinct codes through the words at most one bit away from them."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << j) - (1 << 64 if j == 63 else 0))
                                             .cast("long") for j in range(64)])
    near = codes.withColumn("flip", F.explode(flips)).select(
        "code", F.col("code").bitwiseXOR(F.col("flip")).alias("word"))
    least = near.groupBy("word").agg(F.collect_list("code").alias("all"))   # 65 codes at most
    return least.where(F.size("all") > 1).withColumn("b", F.array_min("all")).select(
        F.explode("all").alias("a"), "b").where("a <> b").distinct()


def code_links(codes: DataFrame, scratch: Scratch, reach: int = REACH, cell: int = CELL,
               crowded: int = CROWDED) -> DataFrame:
    """(a, b): links among distinct codes (one column ``code``) that connect all codes at most
    ``reach`` bits apart."""
    if not 0 <= reach <= 2:
        raise ValueError("crowded cells are linked exactly for 0, 1 or 2 bits")
    pivots = np.array([r[0] for r in codes.orderBy(F.xxhash64("code"), "code").limit(PIVOTS)
                       .collect()], np.int64).view(np.uint64)
    splits = borders(_histogram(codes, pivots), reach, cell) if len(pivots) else []

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                code = _codes(batch.slice(i, 4096))
                key, index = deal(code, pivots, splits, reach)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(code[index].view(np.int64))], names=["cell", "code"])

    dealt = codes.mapInArrow(run, "cell long, code long")
    full = scratch.keep(dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
                        .where(F.col("n") > crowded).select("cell"), "full-cells")
    if full.isEmpty():
        parted, packed = dealt, None
    else:
        parted = dealt.join(full, "cell", "left_anti")
        packed = one_bit_links(dealt.join(full, "cell", "left_semi").select("code").distinct())
    links = parted.repartition("cell").sortWithinPartitions("cell").mapInArrow(
        _cell_links(pivots, reach), "a long, b long")
    return links if packed is None else links.unionByName(packed)


def near_duplicates(docs: DataFrame, reach: int = REACH, cell: int = CELL,
                    crowded: int = CROWDED) -> DataFrame:
    """(doc_id, fingerprint, component_id): a row for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs), "fingerprints")
    codes = scratch.keep(prints.groupBy("code").agg(F.min("doc_id").alias("first")), "codes")
    links = scratch.keep(code_links(codes.select("code"), scratch, reach, cell, crowded), "links")
    roots = components(links, scratch)
    scratch.drop(links)
    member = codes.join(roots.withColumnRenamed("node", "code"), "code", "left").select(
        "code", "first", F.coalesce("root", "code").alias("root"))
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    named = scratch.keep(member.join(least, "root").select("code", "component_id"), "named")
    return prints.join(named, "code").select(
        "doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
