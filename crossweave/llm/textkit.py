"""Vectorised text helpers shared by the operators that run NumPy inside Spark tasks.

Texts of a batch are handled as one byte array, so the cost per character is a few NumPy passes instead of Python objects.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text handled at a time: bounds the size of the temporary arrays, never what is read.
CHUNK_BYTES = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    return _LOWER[data]


def is_space(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def give_back() -> None:
    """Return freed memory to the system at the end of a task: its worker lives on beside an executor's other work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


def byte_chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets) for runs of rows of about `size` bytes; null is an empty text."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if n and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes other than those `apart`, ASCII white space (a row's end ends a word)."""
    inside = ~apart[data]
    edge = np.empty(len(data), dtype=bool)
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    edge[0] = True
    np.logical_not(inside[:-1], out=edge[1:])
    bounds = offsets[:-1][offsets[:-1] < len(data)]
    edge[bounds] = True
    starts = np.flatnonzero(edge & inside)
    stop = np.empty(len(data), dtype=bool)
    stop[-1] = True
    np.logical_not(inside[1:], out=stop[:-1])
    stop[bounds[bounds > 0] - 1] = True
    ends = np.flatnonzero(stop & inside) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and position in its row of each line; a row without text is one empty line."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    of = np.searchsorted(offsets, breaks, side="right") - 1
    counts = np.bincount(of, minlength=n) + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    rows = np.repeat(np.arange(n), counts)
    pos = np.arange(first[-1]) - first[rows]
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    head = pos == 0
    starts[head], starts[~head] = offsets[:-1], breaks + 1
    tail = pos == counts[rows] - 1
    ends[tail], ends[~tail] = offsets[1:], breaks
    return starts, ends, rows, pos


def stripped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without ASCII white space at either end."""
    solid = np.flatnonzero(~_SPACE[data])
    if not len(solid):
        return starts, starts
    i, j = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
    some = i <= j
    return np.where(some, solid[np.minimum(i, len(solid) - 1)], starts), np.where(some, solid[j] + 1, starts)


def code_points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=sums[1:])
    return sums[ends] - sums[starts]


#: Bytes from which a span is hashed by a digest of its own; shorter ones are mixed eight bytes at a time, all at once.
LONG_SPAN = 256
#: The low k bytes of a number.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each span of bytes, the same wherever it stands; A-Z count as a-z if `lower`.

    Every eight bytes pass the finaliser before the next are added, so no change of bytes cancels another as in a sum. Spans of one length up to
    eight bytes never collide.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = _LOWER[data] if lower else data
    wide = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    out = mix64(size.astype(np.uint64) * _BASE)
    todo = np.flatnonzero(size < LONG_SPAN)
    if len(todo) < len(size):
        for i in np.flatnonzero(size >= LONG_SPAN):
            out[i] = int.from_bytes(hashlib.blake2b(padded[starts[i] : ends[i]], digest_size=8).digest(), "little")
    at, left, h = starts[todo], size[todo], out[todo]
    while len(todo):
        h = mix64(h ^ (wide[at] & MASKS[np.minimum(left, 8)]))
        more = left > 8
        out[todo[~more]] = h[~more]
        todo, at, left, h = todo[more], at[more] + 8, left[more] - 8, h[more]
    return out


def span_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit digest of each span, A-Z as a-z: two columns of int64."""
    low = _LOWER[data].tobytes()
    made = b"".join(hashlib.blake2b(low[i:j], digest_size=16).digest() for i, j in zip(starts.tolist(), ends.tolist(), strict=True))
    return np.frombuffer(made, "<i8").reshape(-1, 2)


#: Odd factors that tell the places of words in a window apart.
_PLACES = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def window_hashes(hashes: np.ndarray, rows: np.ndarray, width: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each window of `width` words; a row with fewer words, but at least one, has its whole sequence as one."""
    counts = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(counts)])
    if len(hashes) >= width:
        acc = np.zeros(len(hashes) - width + 1, dtype=np.uint64)
        for i in range(width):
            acc += hashes[i : len(hashes) - width + 1 + i] * _PLACES[i]
        same = rows[: len(acc)] == rows[width - 1 :]
        got, at = mix64(acc[same]), rows[: len(acc)][same]
    else:
        got, at = np.zeros(0, np.uint64), np.zeros(0, rows.dtype)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.array([np.sum(hashes[first[r] : first[r + 1]] * _PLACES[: counts[r]], dtype=np.uint64) + np.uint64(counts[r]) for r in short], dtype=np.uint64)
        got, at = np.concatenate([got, mix64(extra)]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        got, at = got[order], at[order]
    return got, at
