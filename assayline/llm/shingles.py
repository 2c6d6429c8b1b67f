"""Word shingles of whole Arrow string columns as 64-bit hashes (numpy)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WORDS = 5
#: Bytes hashed at once; a longer run is cut at white space.
SLICE = 1 << 19
#: Bytes of rows whose words are held at once.
PIECE = 1 << 22
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _stream(n: int, seed: int, start: int = 0) -> np.ndarray:
    at = np.arange(start + 1, start + n + 1, dtype=np.uint64)
    return mix(at * _U(0x9E3779B97F4A7C15) + _U(seed))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A value a byte, upper-case A-Z as lower case.
_BYTE = _stream(256, 11)
_BYTE[65:91] = _BYTE[97:123]
_PLACE = _stream(1 << 12, 23) | _U(1)
_SLOT = _stream(WORDS, 37) | _U(1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def small_columns(column: pa.Array, size: int = PIECE):
    """(first row, rows) of a string column in pieces of about ``size`` bytes,
    so that the arrays made from a piece stay small."""
    _, off = utf8(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, side="right")) - 1)
        yield lo, column.slice(lo, hi - lo)
        lo = hi


def _slice_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``data`` and where they begin; a word also ends
    at each of ``starts``."""
    ink = ~SPACE[data]
    at = np.flatnonzero(ink)
    if not len(at):
        return np.zeros(0, np.uint64), at
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    first = np.r_[True, (at[1:] != at[:-1] + 1) | edge[at[1:]]]
    begin = np.flatnonzero(first)
    lengths = np.diff(np.r_[begin, len(at)])
    place = np.arange(len(at)) - np.repeat(begin, lengths)
    longest = int(lengths.max())
    table = _PLACE if longest <= len(_PLACE) else _stream(longest, 23) | _U(1)
    h = np.add.reduceat(_BYTE[data[at]] * table[place], begin)
    return mix(h + lengths.astype(np.uint64) * _U(0xD6E8FEB86659FD93)), at[begin]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of every row and the end): words are
    runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased."""
    data, off = utf8(column)
    hashes, places, lo = [], [], 0
    while lo < len(data):
        hi = min(len(data), lo + SLICE)
        while hi < len(data):
            # Cut where a row or a word ends.
            row = off[np.searchsorted(off, hi, side="right") - 1]
            if row > lo:
                hi = int(row)
                break
            gap = np.flatnonzero(SPACE[data[lo:hi]])
            if len(gap):
                hi = lo + int(gap[-1]) + 1
                break
            hi = min(len(data), hi + SLICE)
        own = off[(off >= lo) & (off <= hi)] - lo
        h, at = _slice_words(data[lo:hi], own)
        hashes.append(h)
        places.append(at + lo)
        lo = hi
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    at = np.concatenate(places)
    return np.concatenate(hashes), np.searchsorted(at, off, side="left")


def shingle_hashes(column: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every shingle, first shingle of every row and the end). A row
    of fewer words has one shingle of all of them; a row without words none."""
    slot = _SLOT if size == WORDS else _stream(size, 37) | _U(1)
    words, row = word_hashes(column)
    n = np.diff(row)
    k = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    out_off = np.r_[0, np.cumsum(k)]
    out = np.empty(int(out_off[-1]), np.uint64)
    m = len(words) - size + 1
    if m > 0:
        h = words[:m] * slot[0]
        for j in range(1, size):
            h = h + words[j:j + m] * slot[j]
        h = mix(h)
        whole = np.flatnonzero(n >= size)
        total = int(k[whole].sum())
        if total:
            begin = np.repeat(row[:-1][whole] - (np.cumsum(k[whole]) - k[whole]), k[whole])
            src = begin + np.arange(total)
            to = np.repeat(out_off[:-1][whole] - (np.cumsum(k[whole]) - k[whole]),
                           k[whole]) + np.arange(total)
            out[to] = h[src]
    few = np.flatnonzero((n > 0) & (n < size))
    for c in range(1, size):
        rows = few[n[few] == c]
        h = np.full(len(rows), c, np.uint64) * _U(0xA24BAED4963EE407)
        for j in range(c):
            h = h + words[row[rows] + j] * slot[j]
        out[out_off[rows]] = mix(h)
    return out, out_off
