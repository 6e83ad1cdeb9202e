"""Vectorised words of Arrow text batches: byte spans, 64-bit hashes and window hashes.

A word is a run of bytes outside space, tab, LF, VT, FF and CR.  Word hashes are
polynomial hashes over random 64-bit byte values, taken from prefix sums modulo 2**64, so
one pass of numpy operations serves all words of a block.  Blocks hold about a megabyte;
a longer text is worked through in pieces that end at white space, so memory follows the
number of words and never eight bytes for each byte of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

# The second set of separators: all ASCII but letters, digits and the apostrophe.
NOT_IN_TERM = np.ones(256, bool)
NOT_IN_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), 39, *range(128, 256)]] = False

_BYTES = np.random.default_rng(20240501).integers(1, 1 << 64, 256, dtype=_U) | _U(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
BYTE_VALUES = {False: _BYTES, True: _BYTES[_LOWER]}

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64 (kept for the next block)."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK_BYTES + 2), base, _U)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=_U)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public MurmurHash3 one): every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the pair (a, b), order-sensitive."""
    return mix(a * _U(0x9E3779B97F4A7C15) + (b ^ (b >> _U(29))) * _U(0xD6E8FEB86659FD93)
               + _U(0x2545F4914F6CDD1D))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all ``width``-word windows by doubling: twice a length from two of one length."""
    if len(h) < width:
        return h[:0]
    if width == 1:
        return h
    half = width // 2
    low = window_hashes(h, half)
    out = join_hash(low[:len(h) - 2 * half + 1], low[half:half + len(h) - 2 * half + 1])
    if width % 2:
        out = join_hash(out[:len(h) - width + 1], h[width - 1:])
    return out


def _piece(data: np.ndarray, starts_at: np.ndarray, values: np.ndarray, space: np.ndarray):
    """Spans and hashes of the words of ``data``; a word also starts at each of ``starts_at``."""
    n = len(data)
    inside = ~space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = starts_at[(starts_at > 0) & (starts_at < n)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    sums = np.empty(n + 1, _U)
    sums[0] = 0
    np.cumsum(values[data] * powers(_BASE, n), out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * powers(_INVERSE, n)[starts] + (ends - starts).astype(_U))
    return starts, ends, h


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False,
          space: np.ndarray = IS_SPACE):
    """Words of texts that stand one after another in ``data``, cut at ``offsets``.

    Returns (starts, ends, hashes, bounds): words of text i are bounds[i]:bounds[i+1].
    """
    values = BYTE_VALUES[lower]
    n = len(data)
    if n <= 2 * BLOCK_BYTES:
        starts, ends, h = _piece(data, offsets, values, space)
    else:
        parts, at = [], 0
        while at < n:
            to = min(n, at + BLOCK_BYTES)
            while to < n:                       # end the piece at white space
                gap = np.flatnonzero(space[data[to:to + BLOCK_BYTES]])
                if len(gap):
                    to += int(gap[0])
                    break
                to = min(n, to + BLOCK_BYTES)
            s, e, x = _piece(data[at:to], offsets - at, values, space)
            parts.append((s + at, e + at, x))
            at = to
        starts, ends, h = (np.concatenate(x) for x in zip(*parts))
    return starts, ends, h, np.searchsorted(starts, offsets)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without a copy; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)
    off = off[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str,
           size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole rows with about ``size`` bytes of text: (rows, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = text_buffers(batch.column(batch.schema.get_field_index(column)))
        at, n = 0, batch.num_rows
        while at < n:
            to = int(np.searchsorted(off, off[at] + size, side="right")) - 1
            to = min(n, max(to, at + 1), at + 20_000)
            yield batch.slice(at, to - at), data[off[at]:off[to]], off[at:to + 1] - off[at]
            at = to


def inside_text(bounds: np.ndarray, width: int) -> np.ndarray:
    """Which of the ``width``-word windows over all words of a block lie inside one text."""
    total = int(bounds[-1])
    if total < width:
        return np.zeros(0, bool)
    end = np.repeat(bounds[1:], np.diff(bounds))
    return np.arange(total - width + 1) + width <= end[:total - width + 1]
