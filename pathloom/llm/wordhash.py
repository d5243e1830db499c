"""Vectorised word splitting and hashing over Arrow string columns.

A word is a run of bytes other than space and 0x09-0x0D.  Those separators are
ASCII, so working on UTF-8 bytes finds the same words as working on code points.
Hashes are 64 bits, fixed over time and machines.

Null texts count as empty.  A long text is hashed in pieces cut at separators,
so that the temporary arrays stay small whatever the text's length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes hashed at once, and bytes of the texts handled together.
PIECE = 1 << 20
CHUNK = 2 << 20

_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
#: As _SEP, and ASCII characters other than letters and digits too.
_SEP_PLAIN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit, in place."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(33)
    return h


#: An odd number for each byte.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_GRAM_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1), modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 8 * PIECE:
            _powers[int(base)] = have
    return have[:n]


def strings(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows (one more than rows)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column, limit: int = CHUNK):
    """(first row, data, offsets) of consecutive rows of about limit bytes together, one row at least."""
    data, offsets = strings(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and start of every word; words don't cross rows.  The order is that of the text.

    lower: A-Z count as a-z.  plain: words hold no ASCII characters but letters and digits.
    """
    separates = _SEP_PLAIN if plain else _SEP
    found, begun, low, n = [], [], 0, len(data)
    row_starts = offsets[:-1]
    while low < n:
        high = low + PIECE
        if high >= n:
            high = n
        else:
            after, step = separates[data[high : high + 4096]], 4096
            while not after.any() and high + step < n:
                step *= 8
                after = separates[data[high : high + step]]
            cut = high + int(after.argmax()) if after.any() else n
            border = int(np.searchsorted(row_starts, high))
            high = min(cut, int(row_starts[border])) if border < len(row_starts) else cut
            high = max(high, low + 1)
        part = data[low:high]
        inside = ~separates[part]
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        a, b = np.searchsorted(row_starts, [low, high])
        edges = row_starts[a:b] - low
        before[edges] = False
        after[edges[edges > 0] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        sums = np.zeros(len(part) + 1, np.uint64)
        np.multiply(_BYTE[_LOWER[part] if lower else part], powers(_BASE, len(part)), out=sums[1:])
        np.cumsum(sums, out=sums)
        h = (sums[ends] - sums[starts]) * powers(_INVERSE, len(part))[starts]
        h += (ends - starts).astype(np.uint64)
        found.append(mix(h))
        begun.append(starts + low)
        low = high
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate(begun)
    return np.concatenate(found), np.searchsorted(offsets, starts, "right") - 1, starts


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of size words, by its first word; runs across rows are included."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if size <= 8:
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out *= _GRAM
            out += h[k : k + n]
        return mix(out)
    out, step = np.empty(n, np.uint64), 1 << 20
    for low in range(0, n, step):
        part = h[low : min(low + step, n) + size - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.multiply(part, powers(_GRAM, len(part)), out=sums[1:])
        np.cumsum(sums, out=sums)
        m = len(part) - size + 1
        out[low : low + m] = (sums[size:] - sums[:m]) * powers(_GRAM_INVERSE, m)
    return mix(out)
