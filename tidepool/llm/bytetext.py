"""Vectorised text primitives on the UTF-8 buffers of Arrow string arrays.

Everything here works on (bytes, offsets) pairs, so that no Python string is
made for a word.  Word separators are ASCII, hence a UTF-8 text can be cut
without being decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step works on; bounds the memory of a task.
STEP_BYTES = 1 << 20

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)
_S32, _S29 = np.uint64(32), np.uint64(29)
_MASK = np.array([(1 << (8 * k)) - 1 if k < 8 else (1 << 64) - 1 for k in range(9)], dtype=np.uint64)

#: \x20 and \x09-\x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[0x41:0x5B] += 0x20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h * _M1
    h ^= h >> _S32
    h *= _M2
    h ^= h >> _S29
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of len+1) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of rows of about ``limit`` bytes; a longer row is a run of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = b


def span_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: its blocks of eight bytes, then its length."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    h = mix(words[starts] & _MASK[np.minimum(lengths, 8)])
    todo = np.flatnonzero(lengths > 8)
    at = 8
    while len(todo):
        rest = lengths[todo] - at
        h[todo] = mix(h[todo] ^ (words[starts[todo] + at] & _MASK[np.minimum(rest, 8)]))
        at += 8
        todo = todo[rest > 8]
    return mix(h ^ (lengths.astype(np.uint64) * _M2))


def matching(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether each span of ``a`` holds the same bytes as that of ``b``, both of the given lengths; eight bytes follow the last span."""
    x, y = (np.ndarray((len(z) - 7,), dtype="<u8", buffer=z, strides=(1,)) for z in (a, b))
    out, todo, at = np.ones(len(lengths), dtype=bool), np.flatnonzero(lengths > 0), 0
    while len(todo):
        same = ((x[a_starts[todo] + at] ^ y[b_starts[todo] + at]) & _MASK[np.minimum(lengths[todo] - at, 8)]) == 0
        out[todo[~same]] = False
        at += 8
        todo = todo[same & (lengths[todo] > at)]
    return out


def equal_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, other: np.ndarray) -> bool:
    """Whether each span holds the same bytes as the span of number ``other``."""
    if not (lengths == lengths[other]).all():
        return False
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    one = np.flatnonzero(other != np.arange(len(other)))
    return bool(matching(padded, starts[one], padded, starts[other[one]], lengths[one]).all())


def spans_of_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and rows of the words ``[^\\x20\\x09-\\x0D]+``."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~IS_SPACE[data]
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    before[first] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(solid & ~after) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends - starts, rows


def windows(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` items inside rows of ``counts`` items: hash, row, position of the first item."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    inside = row[: n - size + 1] == row[size - 1 :]
    at = np.flatnonzero(inside)
    h = mix(hashes[at] + _M2)
    for k in range(1, size):
        h = mix(h ^ hashes[at + k]) + np.uint64(k)
    return h, row[at], at


def row_of(bounds: np.ndarray, n: int) -> np.ndarray:
    """The row of each of n items, from bounds of len(rows)+1."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
