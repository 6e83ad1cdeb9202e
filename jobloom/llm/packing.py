"""Best-fit packing of token sequences by a linear grouping scheme.

Pieces (documents, or parts of documents longer than a sequence) are ordered by length.  Large
ones are cut into groups of equal cardinality and their lengths rounded up to the group's
largest, which leaves few sizes; the best configurations of these sizes come from the
cutting-stock linear programme, solved by column generation on the driver.  Actual documents
then take the places of rounded ones, and the rest (small ones and the fractions of
configurations) go best-fit, longest first, into what is free.  A gap that a configuration leaves is
lost if no small piece fits it, and best fit needs some large pieces left to end evenly; both depend
on the lengths, so the whole plan is made for each limit of ``GAPS`` and each share of ``SHARES``,
and of those with the fewest sequences the one with most sequences from configurations is taken.

The driver never sees a document: it works on the histogram of lengths (one count for each of
``capacity`` lengths), from which the free space of each plan follows.  Its answer is a list of ranges,
"places q to q+n of the rest go to bins i to i+n with r tokens free", whose length is bounded by
the square of the number of lengths whatever the number of documents.  Documents know their place from a rank
within their length, numbered by the task that wrote them and shifted by the counts of earlier
tasks, so no length is gathered in one task, however many documents share it.

Defined cases: a null text is an empty one, that is the end token alone; repeated rows and equal
ids are packed like others; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import itertools
import json
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

CAPACITY = 2048
END = 0                          # id after each document
GROUPS = 192                     # of equal cardinality among the large pieces
LARGE = 4                        # large: longer than CAPACITY / LARGE
# A configuration is used if it leaves nothing free or at least so many tokens, ...
GAPS = (0, 8, 32, 64, 128, CAPACITY)
SHARES = (1.0, 0.7, 0.5)         # ... and, if it holds several pieces, in this share of its uses.
MEMO = 300_000                   # word encodings that a worker remembers
# Fixed value: the pre-tokenizer pattern of the byte-level BPE vocabulary.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def default_tokenizer() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("byte_bpe_50k.json"))


class _Words(dict):
    """Word as split at single spaces -> its ids as bytes; a word's ids don't depend on others."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(word if word[:1] == "\n" else " " + word), "<u4").tobytes()
        if len(self) < MEMO:
            self[word] = ids
        return ids


class Encoder:
    """Ids of the tokenizer file as little-endian 32-bit bytes.

    Texts whose white space is single spaces and line feeds between words are encoded word by
    word from a memo: the pattern never joins a word with the next one.  All other texts go
    through the same merges as a whole; texts with the name of a special token through the
    tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        visible = [b for b in range(256) if chr(b).isprintable() and b != 0x20 and b != 0xAD]
        visible = [b for b in visible if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in visible]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in token): i
                 for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.merges = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks,
                                        special_tokens={})
        self.whole = Tokenizer.from_file(path)
        self.words = _Words(self.merges.encode_ordinary)

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes()
        if " ".join(text.split()) != text.replace("\n", " "):
            return np.array(self.merges.encode_ordinary(text), "<u4").tobytes()
        first, *rest = text.replace("\n", " \n").split(" ")
        return (np.array(self.merges.encode_ordinary(first), "<u4").tobytes()
                + b"".join(map(self.words.__getitem__, rest)))


def spans(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but for a shorter first."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    cuts = [(0, head)] if head else []
    return cuts + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY,
           keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank[, ids]): rank counts the pieces of
    one length within the task ``part``; write the result before using it twice."""
    end = np.array([END], "<u4").tobytes()

    def run(batches):
        encode, part = Encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, batch.num_rows, 500):
                rows, raw_ids = [], []
                for doc, text in zip(ids[at:at + 500], texts.slice(at, 500).to_pylist()):
                    raw = encode(text or "") + end
                    for k, (start, n) in enumerate(spans(len(raw) // 4, capacity)):
                        piece = raw[4 * start:4 * (start + n)]
                        rows.append((doc, k, start, n, zlib.crc32(piece), part, int(seen[n])))
                        seen[n] += 1
                        if keep_ids:
                            raw_ids.append(piece)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(),
                    pa.int64()))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
                if keep_ids:
                    columns.append(pa.array(raw_ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
        + (", ids binary" if keep_ids else ""))


def _histogram(table: DataFrame, by: str, capacity: int) -> np.ndarray:
    out = np.zeros(capacity + 1, np.int64)
    for value, n in table.groupBy(by).count().collect():
        out[value] = n
    return out


def _global_rank(table: DataFrame, by: str) -> DataFrame:
    """Turns the rank within (part, value) into one within the value, over all parts."""
    counts = table.groupBy(by, "part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(by, "part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    return table.join(base, [by, "part"]).withColumn(
        "rank", F.col("rank") + F.col("_base")).drop("_base", "part")


# --- the driver's part: histograms in, ranges out ----------------------------------------------

class _Prices:
    """The configuration of greatest value: a knapsack filled item by item, for all capacities
    at once; large sizes allow only a few items."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.left = np.arange(capacity + 1)[None, :] - sizes[:, None]
        self.fits = self.left >= 0
        self.left = np.maximum(self.left, 0)

    def best(self, value: np.ndarray) -> tuple[float, np.ndarray]:
        worth, picks = np.zeros(self.capacity + 1), []
        for _ in range(self.capacity // int(self.sizes.min())):
            more = np.where(self.fits, worth[self.left] + value[:, None], 0.0)
            pick = more.argmax(0)
            top = more[pick, np.arange(len(pick))]
            picks.append(np.where(top > 0, pick, -1))
            worth = top
        config, c = np.zeros(len(self.sizes), np.int64), self.capacity
        for pick in reversed(picks):
            i = int(pick[c])
            if i < 0:
                break
            config[i] += 1
            c -= int(self.sizes[i])
        return float(worth[self.capacity]), config


def programme(sizes: np.ndarray, counts: np.ndarray, capacity: int,
              rounds: int = 600) -> list[tuple[np.ndarray, int]]:
    """Configurations of the cutting-stock linear programme with their uses rounded down, the
    most used ones first."""
    k = len(sizes)
    if not k:
        return []
    basis = np.diag((capacity // sizes).astype(float))
    prices = _Prices(sizes, capacity)
    for _ in range(rounds):
        dual = np.linalg.solve(basis.T, np.ones(k))
        worth, config = prices.best(np.maximum(dual, 0))
        if worth <= 1 + 1e-7:
            break
        uses, step = np.linalg.solve(basis, counts.astype(float)), np.linalg.solve(basis, config)
        ratio = np.where(step > 1e-9, uses / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = config
    uses = np.floor(np.linalg.solve(basis, counts.astype(float)) + 1e-6).astype(np.int64)
    return [(np.rint(basis[:, j]).astype(np.int64), int(uses[j])) for j in np.argsort(-uses)]


def taken(found: list[tuple[np.ndarray, int]], sizes: np.ndarray, counts: np.ndarray,
          capacity: int, gap: int = 0, share: float = 1.0) -> list[tuple[np.ndarray, int]]:
    """The configurations that leave nothing or at least ``gap`` free, in ``share`` of their uses,
    as often as the pieces allow."""
    out, left = [], counts.astype(np.int64).copy()
    for config, uses in found:
        if 0 < capacity - (config * sizes).sum() < gap:
            continue                     # its documents go one by one
        some = config > 0
        n = int(min(uses, (left[some] // config[some]).min()))
        if config.sum() > 1:
            n = int(n * share)
        if n > 0:
            out.append((config, n))
            left -= n * config
    return out


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 600,
                   gap: int = 0, share: float = 1.0) -> list[tuple[np.ndarray, int]]:
    """Configurations and whole numbers of uses for the rounded sizes; what the fractions of the
    linear programme leave over stays unplaced."""
    return taken(programme(sizes, counts, capacity, rounds), sizes, counts, capacity, gap, share)


@dataclass
class Large:
    """Places of the large pieces, in the order of falling length.

    Class i holds places edges[i] to edges[i+1]; its places fill runs[i]: (first place, places,
    pieces in a bin, first bin).  ``rest``: place ranges that no configuration took."""
    edges: np.ndarray
    runs: list[list[tuple[int, int, int, int]]]
    rest: list[tuple[int, int]]
    bins: int


def large_classes(counts: np.ndarray, capacity: int, groups: int, large: int):
    """(edges, sizes): the large pieces of a histogram of lengths, grouped and rounded up; no
    length is rounded if there are no more of them than groups."""
    lengths = np.arange(capacity, 0, -1)
    n_of = counts[lengths]
    ends = np.cumsum(n_of)
    some = (lengths > capacity // large) & (n_of > 0)
    n_large = int(n_of[some].sum())
    if some.sum() <= groups:
        return np.append(ends[some] - n_of[some], n_large), lengths[some]
    width = max(1, -(-n_large // groups))
    firsts = np.arange(0, n_large, width)
    rounded = lengths[np.searchsorted(ends, firsts, side="right")] if len(firsts) else firsts
    keep = np.ones(len(firsts), bool)
    keep[1:] = rounded[1:] != rounded[:-1]
    return np.append(firsts[keep], n_large), rounded[keep]


def lay(edges: np.ndarray, configs: list[tuple[np.ndarray, int]], total: int) -> Large:
    """Deals the places of each class out to the configurations."""
    n_class = np.diff(edges)
    runs: list[list] = [[] for _ in n_class]
    taken = np.zeros(len(n_class), np.int64)
    bins = 0
    for config, uses in configs:
        for i in np.flatnonzero(config):
            runs[i].append((int(taken[i]), int(uses * config[i]), int(config[i]), bins))
            taken[i] += uses * config[i]
        bins += uses
    rest = [(int(edges[i] + taken[i]), int(edges[i + 1])) for i in range(len(n_class))
            if taken[i] < n_class[i]]
    if edges[-1] < total:
        rest.append((int(edges[-1]), total))
    return Large(edges, runs, rest, bins)


def free_space(p: Large, counts: np.ndarray, capacity: int) -> np.ndarray:
    """How many bins of the configurations have each number of tokens free.

    Between places where the length changes all bins of a configuration hold the same lengths,
    so a bin of each such stretch stands for all of it."""
    lengths = np.arange(capacity, 0, -1)
    ends = np.append(0, np.cumsum(counts[lengths]))
    tokens = np.append(0, np.cumsum(counts[lengths] * lengths))

    def before(place):                   # tokens of all pieces ahead of a place
        i = np.minimum(np.searchsorted(ends, place, side="right") - 1, capacity - 1)
        return tokens[i] + (place - ends[i]) * lengths[i]

    items: dict[int, list] = {}
    for i, runs in enumerate(p.runs):
        for first, n, per, base in runs:
            items.setdefault(base, []).append((int(p.edges[i]) + first, n // per, per))
    out = np.zeros(capacity + 1, np.int64)
    for parts in items.values():
        uses = parts[0][1]
        cuts = [np.array([0, uses])]
        for start, _, per in parts:
            at = (ends[(ends > start) & (ends < start + uses * per)] - start) // per
            cuts += [at, at + 1]
        cuts = np.unique(np.concatenate(cuts))
        cuts = cuts[cuts <= uses]
        o = cuts[:-1]
        load = sum(before(start + (o + 1) * per) - before(start + o * per)
                   for start, _, per in parts)
        np.add.at(out, capacity - load, np.diff(cuts))
    return out


@dataclass
class Plan:
    """Places of the large pieces, best-fit ranges of the rest, and how many sequences result."""
    large: Large
    ranges: list[tuple[int, int, int, int]]
    sequences: int


def plan(counts: np.ndarray, capacity: int, groups: int = GROUPS, large: int = LARGE,
         gaps: tuple[int, ...] = GAPS, shares: tuple[float, ...] = SHARES) -> Plan:
    """The plan with the fewest sequences over all gaps and shares; of equal ones the one with the
    most sequences from configurations."""
    edges, sizes = large_classes(counts, capacity, groups, large)
    n_class, total = np.diff(edges), int(counts[1:].sum())
    found = programme(sizes, n_class, capacity)
    lengths = np.arange(capacity, 0, -1)
    ends = np.cumsum(counts[lengths])
    starts = ends - counts[lengths]
    best = None
    for gap, share in itertools.product(gaps, shares):
        p = lay(edges, taken(found, sizes, n_class, capacity, gap, share), total)
        left = sum((np.maximum(0, np.minimum(ends, b) - np.maximum(starts, a)) for a, b in p.rest),
                   np.zeros(capacity, np.int64))
        ranges, new = best_fit(lengths, left, free_space(p, counts, capacity), capacity)
        if best is None or (p.bins + new, -p.bins) < (best.sequences, -best.large.bins):
            best = Plan(p, ranges, p.bins + new)
    return best


def place_large(p: Large, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin or -1, place among the rest or -1) of pieces by their place."""
    bins = np.full(len(place), -1, np.int64)
    for i, runs in enumerate(p.runs):
        here = np.flatnonzero((place >= p.edges[i]) & (place < p.edges[i + 1]))
        if not len(here):
            continue
        at = place[here] - p.edges[i]
        for first, n, per, base in runs:
            hit = (at >= first) & (at < first + n)
            bins[here[hit]] = base + (at[hit] - first) // per
    q = np.full(len(place), -1, np.int64)
    before = 0
    for a, b in p.rest:
        hit = (place >= a) & (place < b)
        q[hit] = before + place[hit] - a
        before += b - a
    return bins, q


def best_fit(lengths: np.ndarray, counts: np.ndarray, free: np.ndarray, capacity: int):
    """Best fit, longest first, over counts: ([(first place, bins, free before, first bin)], new).

    ``free`` counts the bins by free tokens.  Bins are named by the space they had at first and
    their rank in it; new ones have the whole capacity.  A range puts one piece in each bin.
    """
    space: dict[int, list] = {r: [(r, 0, int(free[r]))] for r in range(1, len(free)) if free[r]}
    keys = sorted(space)
    new, place, out = 0, 0, []
    for length, n in zip(lengths.tolist(), counts.tolist()):
        while n:
            i = bisect.bisect_left(keys, length)
            if i == len(keys):
                more = -(-n // (capacity // length))
                space[capacity] = [(-1, new, more)]
                bisect.insort(keys, capacity)
                new += more
                continue
            r = keys[i]
            name, first, m = space[r].pop()
            take = min(n, m)
            if take < m:
                space[r].append((name, first + take, m - take))
            if not space[r]:
                del space[r], keys[i]
            out.append((place, take, name, first))
            if r > length:
                if r - length not in space:
                    space[r - length] = []
                    bisect.insort(keys, r - length)
                space[r - length].append((name, first, take))
            place += take
            n -= take
    return out, new


# --- Spark's part ------------------------------------------------------------------------------

def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY,
         groups: int = GROUPS, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of all pieces."""
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.keep(pieces(docs, tokenizer or default_tokenizer(), capacity, keep_ids), "pieces")
    counts = _histogram(cut, "length", capacity)
    if not counts.sum():
        return cut.select("doc_id", "piece", "start", "length", "ids_crc32",
                          F.lit(0).cast("long").alias("sequence_id"),
                          F.lit(0).cast("long").alias("offset"), *(["ids"] if keep_ids else []))
    chosen = plan(counts, capacity, groups)
    ranges, placed = chosen.ranges, chosen.large
    longer = np.concatenate([np.cumsum(counts[::-1])[::-1][1:], [0]])   # pieces longer than each

    @F.pandas_udf("bin long, q long")
    def find(length, rank):
        import pandas as pd
        bins, q = place_large(placed, longer[length.to_numpy()] + rank.to_numpy())
        return pd.DataFrame({"bin": bins, "q": q})

    ranked = scratch.keep(_global_rank(cut, "length").withColumn("_f", find("length", "rank"))
                          .withColumns({"bin": F.col("_f.bin"), "q": F.col("_f.q")})
                          .drop("_f", "rank"), "placed")
    scratch.drop(cut)

    def number(batches):
        seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            room = b.column(1).to_numpy()
            order = np.argsort(room, kind="stable")
            rank = np.empty(len(room), np.int64)
            new = np.flatnonzero(np.diff(room[order], prepend=-1))
            run = np.diff(np.append(new, len(room)))
            rank[order] = np.arange(len(room)) - np.repeat(new, run) + seen[room[order]]
            seen += np.bincount(room, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.full(len(room), part, np.int32)),
                 pa.array(rank)], names=["bin", "room", "part", "rank"])

    used = ranked.where("bin >= 0").groupBy("bin").agg(
        (F.lit(capacity) - F.sum("length")).cast("long").alias("room"))
    rooms = scratch.keep(used.mapInArrow(number, "bin long, room long, part int, rank long"), "rooms")
    at = np.array([x[0] for x in ranges], np.int64)
    name = np.array([x[2] for x in ranges], np.int64)
    first = np.array([x[3] for x in ranges], np.int64)

    @F.pandas_udf("room long, rank long")
    def fit(q):
        import pandas as pd
        v = q.to_numpy()
        i = np.maximum(np.searchsorted(at, v, side="right") - 1, 0)
        if not len(at):
            return pd.DataFrame({"room": v * 0 - 2, "rank": v * 0})
        return pd.DataFrame({"room": name[i], "rank": first[i] + v - at[i]})

    rest = ranked.where("bin < 0").withColumn("_f", fit("q")).withColumns(
        {"room": F.col("_f.room"), "rank": F.col("_f.rank")}).drop("_f", "bin", "q")
    opened = rest.where("room < 0").withColumn("sequence_id", F.lit(placed.bins) + F.col("rank"))
    named = _global_rank(rooms, "room").select("room", "rank", F.col("bin").alias("sequence_id"))
    filled = rest.where("room >= 0").join(named, ["room", "rank"])
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id",
            *(["ids"] if keep_ids else [])]
    every = (ranked.where("bin >= 0").withColumnRenamed("bin", "sequence_id").select(*keep)
             .unionByName(opened.select(*keep)).unionByName(filled.select(*keep)))
    # a sequence holds ``capacity`` pieces at most
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece")
    return every.withColumn("offset", F.coalesce(F.sum("length").over(
        order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from ``pack(..., keep_ids=True)``."""
    parts = packed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.aggregate(
        "p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
