"""Substring de-duplication by level-wise doubling of repeated word windows.

Level 5 looks at five-word windows, level 10 at windows of ten words and so on: only
windows that repeat at one length alone are extended to twice that length.  At the first
level a document offers the windows that are the smallest (by hash) of any stretch of
``least`` words; equal stretches choose equal windows, so a repeated stretch always has a
repeated candidate, with about two candidates in 17 words.  A level is one table of
(window hash, document, occurrences): hashes with two or more occurrences survive, and
the survivors of a document go with its text to the next level.

At length ``least`` a word is removed if a window over it also starts earlier, in a smaller
document or earlier in the same one.  First documents come from a min aggregate, which sums
up each hot passage before the shuffle; no group of occurrences is collected, and the
survivors of one document are bounded by its own length.

Defined cases: a null text has no words; texts shorter than a window keep all words; rows
with the same doc_id are one document to the rule (they don't remove words from each other,
but each is judged against smaller ids and within itself); a null doc_id comes after all
others; an empty table gives an empty table; extra columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch
from .textmap import fresh
from .words import blocks, inside_text, window_hashes, words

LEAST = 20
START = 5
LAST_ID = (1 << 63) - 1            # stands for a null id


def _known(rows: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of a list column."""
    column = rows.column(rows.schema.get_field_index(name))
    if column.null_count:
        column = column.fill_null([])
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    sizes = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(sizes)), sizes), flat


def _among(owner: np.ndarray, h: np.ndarray, set_owner: np.ndarray, set_h: np.ndarray):
    """Which (owner, hash) are in the set of the same owner."""
    if not len(set_h) or not len(h):
        return np.zeros(len(h), bool)
    values, inverse = np.unique(np.concatenate([set_h, h]), return_inverse=True)
    code = np.concatenate([set_owner, owner]).astype(np.int64) * len(values) + inverse
    return np.isin(code[len(set_h):], code[:len(set_h)])


def _spread(at: np.ndarray, n: int, before: int, after: int) -> np.ndarray:
    """Mask of positions from ``before`` below to ``after`` above any of the marked ones."""
    edge = np.zeros(n + 1, np.int64)
    where = np.flatnonzero(at)
    np.add.at(edge, np.maximum(where - before, 0), 1)
    np.add.at(edge, np.minimum(where + after + 1, n), -1)
    return np.cumsum(edge)[:n] > 0


def candidates(h: np.ndarray, bounds: np.ndarray, length: int, least: int,
               known: tuple | None, shorter: int | None = None):
    """(text index, hash) of the windows of ``length`` words that a level looks at.

    Without ``known`` (first level): the smallest window of each stretch of ``least`` words.
    With it: windows of ``length`` that hold a surviving window of the ``shorter`` length.
    """
    inside = inside_text(bounds, length)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    x = window_hashes(h, length)
    chosen = np.zeros(len(x), bool)
    if known is None:
        whole = np.flatnonzero(inside_text(bounds, least))
        if len(whole):
            views = np.lib.stride_tricks.sliding_window_view(x, least - length + 1)
            chosen[np.unique(whole + views[whole].argmin(1))] = True
    elif len(x):
        y = window_hashes(h, shorter)
        hit = _among(owner[:len(y)], y, *known) & inside_text(bounds, shorter)
        chosen = _spread(hit, len(y), length - shorter, 0)[:len(x)] & inside
    return owner[:len(x)][chosen], x[chosen]


def _level(docs: DataFrame, length: int, least: int, shorter: int | None = None) -> DataFrame:
    """(hash, doc_id, n): candidate windows of one level, occurrences within a text summed."""
    def run(batches):
        for rows, data, off in blocks(batches, "text"):
            _, _, h, bounds = words(data, off)
            known = _known(rows, "known") if shorter else None
            owner, x = candidates(h, bounds, length, least, known, shorter)
            order = np.lexsort((x, owner))
            owner, x = owner[order], x[order]
            new = np.ones(len(x), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (x[1:] != x[:-1])
            at = np.flatnonzero(new)
            ids = rows.column(0).take(pa.array(owner[at]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[at].view(np.int64)), ids,
                 pa.array(np.diff(np.append(at, len(x))), pa.int32())],
                names=["hash", "doc_id", "n"])
    return docs.mapInArrow(run, "hash long, doc_id long, n int")


def _of_documents(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id").agg(F.collect_set("hash").alias("known"))


def repeated_windows(docs: DataFrame, scratch: Scratch, least: int = LEAST,
                     start: int = START) -> DataFrame:
    """(hash, doc_id, n) of the candidate windows of ``least`` words: the lengths double from
    ``start`` on, and the last step reaches ``least``."""
    lengths = [min(start, least)]
    while lengths[-1] < least:
        lengths.append(min(2 * lengths[-1], least))
    texts = docs.select("doc_id", "text")
    known, table, shorter = None, None, None
    for length in lengths:
        level = texts if known is None else texts.join(known, "doc_id")
        before, table = table, scratch.keep(
            _level(level, length, least, shorter), f"windows-{length}")
        if before is not None:
            scratch.drop(before, known)
        if length < least:
            again = table.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash")
            known = scratch.keep(_of_documents(table.join(again, "hash")), f"repeats-{length}")
            shorter = length
    return table


def repeat_lengths(docs: DataFrame, start: int = START, least: int = LEAST) -> DataFrame:
    """(doc_id, longest): the greatest doubled length at which a document still repeats.

    The doubling goes on until no candidate survives.
    """
    scratch = Scratch(docs.sparkSession, "repeat-lengths")
    texts = docs.select("doc_id", "text")
    length, known, out = start, None, None
    while True:
        level = texts if known is None else texts.join(known.select("doc_id", "known"), "doc_id")
        table = scratch.keep(_level(level, length, max(least, length),
                                    None if known is None else length // 2), "windows")
        again = table.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash")
        known = scratch.keep(_of_documents(table.join(again, "hash"))
                             .withColumn("longest", F.lit(length)), "repeats")
        found = known.select("doc_id", "longest")
        out = found if out is None else out.unionByName(found)
        if known.isEmpty():
            return out.groupBy("doc_id").agg(F.max("longest").alias("longest"))
        length *= 2


def _later(table: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, known): for each document the windows that a smaller document has as well."""
    first = table.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = first.where("first < last").select("hash", "first")
    return scratch.keep(_of_documents(table.join(first, "hash").where("doc_id > first")), "later")


def covered_words(h: np.ndarray, bounds: np.ndarray, known: tuple, least: int) -> np.ndarray:
    """Mask over words: inside a window that a smaller document has, or that starts earlier here."""
    x = window_hashes(h, least)
    if not len(x):
        return np.zeros(len(h), bool)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:len(x)]
    at = np.flatnonzero(inside_text(bounds, least))
    own, y = owner[at], x[at]
    hit = np.zeros(len(h), bool)
    hit[at] = _among(own, y, *known)
    order = np.lexsort((at, y, own))
    again = (own[order][1:] == own[order][:-1]) & (y[order][1:] == y[order][:-1])
    hit[at[order[1:][again]]] = True
    return _spread(hit, len(h), 0, least - 1)


def _apply(docs: DataFrame, later: DataFrame, least: int, fields: list[T.StructField], make):
    """``docs`` with columns made from (row bytes, word spans, removed mask) of each text."""
    key, mark = fresh("_id", docs), fresh("_known", docs)
    joined = docs.withColumn(key, F.coalesce("doc_id", F.lit(LAST_ID))).join(
        later.select(F.col("doc_id").alias(key), F.col("known").alias(mark)), key, "left")
    keep = [f for f in docs.schema.fields if f.name not in {x.name for x in fields}]
    names = [f.name for f in keep]
    inputs = list(dict.fromkeys(["doc_id", "text", *names]))

    def run(batches):
        for rows, data, off in blocks(batches, "text"):
            starts, ends, h, bounds = words(data, off)
            gone = covered_words(h, bounds, _known(rows, mark), least)
            made = [make(data, starts[a:b], ends[a:b], gone[a:b])
                    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(rows.schema.get_field_index(n)) for n in names),
                 *(pa.array(list(c)) for c in zip(*made))],
                names=[*names, *(f.name for f in fields)])
    return joined.select(*[F.col(f"`{n}`") for n in inputs], mark).mapInArrow(
        run, T.StructType([*keep, *fields]))


def _kept_runs(starts: np.ndarray, ends: np.ndarray, gone: np.ndarray):
    """(first byte, end) of the runs of kept words, white space inside a run included."""
    keep = ~gone
    first = keep.copy()
    first[1:] &= gone[:-1]
    last = keep.copy()
    last[:-1] &= gone[1:]
    return zip(starts[first].tolist(), ends[last].tolist())


def _digest(data, starts, ends, gone):
    kept = b" ".join(x for a, b in _kept_runs(starts, ends, gone)
                     for x in data[a:b].tobytes().split())
    return len(starts), int(gone.sum()), hashlib.sha256(kept).hexdigest()


def _text(data, starts, ends, gone):
    return (int(gone.sum()),
            b" ".join(data[a:b].tobytes() for a, b in _kept_runs(starts, ends, gone)).decode())


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), "text")


def removals(docs: DataFrame, least: int = LEAST, start: int = START) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "substrings")
    table = repeated_windows(_prepared(docs), scratch, least, start)
    later = _later(table, scratch)
    scratch.drop(table)
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
              T.StructField("kept_sha256", T.StringType())]
    return _apply(docs.select("doc_id", "text"), later, least, fields, _digest).drop("text")


def without_repeats(docs: DataFrame, least: int = LEAST, start: int = START) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; the removed words are counted in
    ``n_removed``.  Kept words keep the white space between them; a cut leaves one space."""
    scratch = Scratch(docs.sparkSession, "substrings")
    table = repeated_windows(_prepared(docs), scratch, least, start)
    later = _later(table, scratch)
    scratch.drop(table)
    fields = [T.StructField("n_removed", T.LongType()), T.StructField(kept := fresh("_kept", docs), T.StringType())]
    out = _apply(docs, later, least, fields, _text)
    return out.select(*[F.col(kept).alias("text") if c == "text" else F.col(f"`{c}`")
                        for c in docs.columns if c != "n_removed"], "n_removed")
