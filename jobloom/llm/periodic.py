"""Periodic run detection by recursive frequency splitting and a lag scan.

A run is a stretch of consecutive words with smallest period q and at least max(LEAST, TIMES * q)
words that can't be extended.  Each of its words occurs TIMES times or more in it, so a word that
occurs less often within its segment is in no run there and splits the segment.  The parts are
counted anew and split again until no part changes; a run always lies whole inside one part.

A surviving segment is scanned lag by lag, smallest first.  A run of period q holds TIMES - 1
consecutive multiples of q that equal the word q further on, so a lag first looks at its multiples
only (all lags of a segment together look at about m ln m words) and extends word by word where that
many in a row agree.  Where they lie inside a run already found, with a smaller period, that run is
all there is: two periods over such a stretch have their common divisor as a period.

Defined cases: a null or blank text has no words and no runs; rows are judged one by one, so equal
rows give equal results; a text longer than a block is worked on whole, its memory follows its
number of words; an empty table gives an empty table; extra columns pass through ``find_runs``
(but for those named like its own: they are replaced).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textmap import map_texts
from .words import blocks, words

LEAST = 6                 # words of the shortest run
TIMES = 4                 # periods of the shortest run


def segments(code: np.ndarray, owner: np.ndarray, times: int = TIMES,
             least: int = LEAST) -> list[tuple[int, int]]:
    """Stable segments (first, end) of word codes that stand one text after another.

    ``owner`` numbers the text of each word; no segment reaches over two texts.
    """
    at = np.arange(len(code))
    seg = owner.astype(np.int64)
    stable = []
    while len(at):
        # codes are renumbered, so that (segment, word) fits one key
        _, word = np.unique(code[at], return_inverse=True)
        key = seg * (int(word.max()) + 1) + word
        _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
        stays = n[inverse] >= times
        # the pieces that stay: new ones begin after a gap or at another segment
        kept, was = at[stays], seg[stays]
        if not len(kept):
            break
        new = np.ones(len(kept), bool)
        new[1:] = (np.diff(kept) > 1) | (was[1:] != was[:-1])
        piece = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(kept)))
        before = np.bincount(seg)[was[first]]
        done = (size == before) & (size >= least)
        stable += [(int(kept[i]), int(kept[i]) + int(s)) for i, s in zip(first[done], size[done])]
        again = (~done & (size >= least))[piece]
        at, seg = kept[again], piece[again]
    return sorted(stable)


def _same(x: np.ndarray, i: int, lag: int, step: int) -> int:
    """How many words on from ``i`` (exclusive), upwards or downwards, equal the word a lag on."""
    n, width, most = 0, 32, len(x) - lag
    while True:
        if step > 0:
            a, b = i + 1 + n, min(most, i + 1 + n + width)
            eq = x[a:b] == x[a + lag:b + lag]
        else:
            a, b = max(0, i - n - width), i - n
            eq = (x[a:b] == x[a + lag:b + lag])[::-1]
        if b <= a:
            return n
        differ = np.flatnonzero(~eq)
        if len(differ):
            return n + int(differ[0])
        n += b - a
        width *= 2


def lag_scan(x: np.ndarray, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a segment, by start and period."""
    m, out = len(x), []
    reach = np.zeros(m + 1, np.int64)          # where the found runs over a word end at most
    for lag in range(1, m // times + 1):
        anchors = x[::lag]
        eq = anchors[:-1] == anchors[1:]
        row = eq[times - 2:].copy()
        for k in range(times - 2):
            row &= eq[k:len(eq) - (times - 2) + k]
        for j in np.flatnonzero(row).tolist():
            i = j * lag
            if reach[i] > i + (times - 1) * lag:
                continue
            start = i - _same(x, i, lag, -1)
            length = i + 1 + _same(x, i, lag, 1) - start + lag
            inside = reach[start] >= start + length       # of a run with a smaller period
            if length >= max(least, times * lag) and not inside:
                out.append((start, length, lag))
                np.maximum(reach[start:start + length], start + length,
                           out=reach[start:start + length])
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def runs_of(code: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """The runs of each text of a block, words numbered within their text."""
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(n)), n)
    out: list[list] = [[] for _ in n]
    for a, b in segments(code, owner):
        k = int(owner[a])
        base = a - int(bounds[k])
        out[k] += [(s + base, length, q) for s, length, q in lag_scan(code[a:b])]
    return out


def dropped_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Mask of the words that a run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge)[:n] > 0


def strongest(runs: list[tuple[int, int, int]]) -> tuple | None:
    """The run with the greatest length/period; ties: smallest start, then period."""
    best = None
    for r in runs:                             # by start and period
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


# How a word sequence is read: None for the words as they stand, else the original word of each.
Reading = Callable[[object, int], np.ndarray | None]


def _as_it_stands(key, n: int) -> None:
    return None


def periodic_reading(key, n: int) -> np.ndarray | None:
    """One id in ten reads its words from a on as the first p of them, again and again."""
    if key is None or not n:
        return None
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


_DIGESTS = T.StructType([
    *[T.StructField(c, T.LongType())
      for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")],
    T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType())])


def _kept(data, starts, ends, source: np.ndarray | None, drop: np.ndarray) -> bytes:
    """The kept words of one text joined by one space."""
    keep = ~drop
    if source is None:
        edge = np.flatnonzero(np.diff(np.concatenate([[0], keep.view(np.int8), [0]])))
        parts = (data[starts[a]:ends[b - 1]].tobytes() for a, b in zip(edge[::2], edge[1::2]))
        return b" ".join(b" ".join(p.split()) for p in parts)
    at = source[keep]
    raw = data.tobytes() if len(data) < 1 << 16 else memoryview(data)
    return b" ".join([bytes(raw[a:b]) for a, b in zip(starts[at].tolist(), ends[at].tolist())])


def _block(data, off, keys, reading: Reading):
    """(word spans, reading, runs, dropped mask) of each text of a block."""
    starts, ends, h, bounds = words(data, off)
    sources = [reading(k, b - a) for k, a, b in zip(
        keys, bounds[:-1].tolist(), bounds[1:].tolist())]
    for source, a, b in zip(sources, bounds[:-1].tolist(), bounds[1:].tolist()):
        if source is not None:
            h[a:b] = h[a:b][source]
    for k, runs in enumerate(runs_of(h, bounds)):
        a, b = int(bounds[k]), int(bounds[k + 1])
        yield starts[a:b], ends[a:b], sources[k], runs, dropped_words(b - a, runs)


def run_digests(docs: DataFrame, reading: Reading = periodic_reading) -> DataFrame:
    """A row for each row of ``docs``: number of runs, the strongest one, digests of all runs and of
    the words that stay."""
    def run(batches):
        for rows, data, off in blocks(batches, "text"):
            out = []
            keys = rows.column(0).to_pylist()
            for key, (starts, ends, source, runs, drop) in zip(
                    keys, _block(data, off, keys, reading)):
                best = strongest(runs)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                out.append((key, len(runs), *(best or (None,) * 3),
                            best and 1000 * best[1] // best[2],
                            hashlib.sha256(listed.encode()).hexdigest(),
                            hashlib.sha256(_kept(data, starts, ends, source, drop)).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if f.name.endswith("256") else pa.int64())
                 for c, f in zip(zip(*out), _DIGESTS)], names=_DIGESTS.names)
    return docs.select("doc_id", "text").mapInArrow(run, _DIGESTS)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with ``runs`` (start, length, period of each, by start and period) and
    ``collapsed``: the text without what repeats in a run, its words joined by one space."""
    def make():
        def work(data, off, rows):
            runs, texts = [], []
            for starts, ends, source, found, drop in _block(
                    data, off, [None] * (len(off) - 1), _as_it_stands):
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                texts.append(_kept(data, starts, ends, source, drop).decode())
            return [pa.array(runs, pa.list_(_RUN)), pa.array(texts, pa.string())]
        return work
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    return map_texts(docs, "text", [T.StructField("runs", T.ArrayType(run)),
                                    T.StructField("collapsed", T.StringType())], make)
