"""Vectorised byte and word hashing inside tasks; small helpers of the Arrow-mapped operators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
LONG_SPAN = 512
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)
_ODD = (U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9))
BLOCK = 2 << 20  # bytes of text worked on at once; a longer document is a block of its own


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (splitmix64's finisher)."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = U(pow(int(BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.concatenate([[U(1)], np.full(n, BASE)]))
        down = np.multiply.accumulate(np.concatenate([[U(1)], np.full(n, inverse)]))
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n at least."""
    return _powers(1 << max(16, int(n).bit_length()))


@lru_cache(maxsize=8)
def byte_values(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95) + U(seed))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums of 64-bit values; span_hash takes any span's hash from them."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever the span stands. For features only: what must be exact takes digests()."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, nulls as empty, and the offsets of its rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `limit` bytes."""
    data, at = packed(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


@lru_cache(maxsize=4)
def separators(kind: str) -> np.ndarray:
    """Byte classes. space: the six blank characters; letters: all but ASCII letters and bytes over 127."""
    sep = np.zeros(256, bool)
    if kind == "space":
        sep[[32, 9, 10, 11, 12, 13]] = True
    else:
        sep[:128] = True
        sep[97:123] = sep[65:91] = False
    return sep


def words(data: np.ndarray, at: np.ndarray, kind: str = "space") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (with one more at the end)."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(separators(kind)[data], out=inside[1:-1])
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
    if len(edge):
        first[edge] = inside[edge + 1]
        last[edge - 1] = inside[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, halves: int = 2) -> list[np.ndarray]:
    """128 bits of each span in two halves (or only the first), taken in by eight bytes at a time and scrambled after each; spans beyond `LONG_SPAN` by BLAKE2."""
    size = (ends - starts).astype(np.int64)
    lanes = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8).view(U)[:, 0]
    out = [mix(size.astype(U) * BASE + U(k + 1)) for k in range(halves)]
    for at in range(0, min(int(size.max(initial=0)), LONG_SPAN), 8):
        on = np.flatnonzero((size > at) & (size <= LONG_SPAN)) if at else np.flatnonzero(size <= LONG_SPAN)
        x = lanes[starts[on] + at] & _FIRST_BYTES[np.minimum(size[on] - at, 8)]
        out[0][on] = mix((out[0][on] ^ x) * _ODD[0])
        if halves > 1:
            out[1][on] = mix((out[1][on] + x) * _ODD[1])
    for i in np.flatnonzero(size > LONG_SPAN):
        both = np.frombuffer(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest(), U)
        for k in range(halves):
            out[k][i] = both[k]
    return out


def run_hash(values: np.ndarray, n: int, half: int = 0) -> np.ndarray:
    """Hash of every n successive values, joined in pairs, fours and so on with a scramble at each step."""
    run, width, out, done = values, 1, None, 0
    while True:
        if n & width:
            m = len(values) - done - width + 1
            if m <= 0:
                return np.zeros(0, U)
            out = run if out is None else mix((out[:m] * _ODD[half] ^ run[done : done + m]) + U(done))
            done += width
        if 2 * width > n:
            return out
        m = len(run) - width
        if m <= 0:
            return np.zeros(0, U)
        run = mix((run[:m] * _ODD[half] ^ run[width:]) + U(width))
        width *= 2


def order(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """A stable order of 128-bit values."""
    out = np.argsort(h, kind="stable")
    a, b = h[out], g[out]
    return out if not ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any() else np.lexsort((g, h))


def fresh(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Which of ordered 128-bit values differ from the one before."""
    out = np.ones(len(h), bool)
    out[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    return out


def among(h: np.ndarray, g: np.ndarray, known_h: np.ndarray, known_g: np.ndarray) -> np.ndarray:
    """Which 128-bit values are among the known ones."""
    found = np.zeros(len(h), bool)
    if not len(known_h) or not len(h):
        return found
    by = order(known_h, known_g)
    a, b = known_h[by], known_g[by]
    at = np.searchsorted(a, h)
    longest = int(np.diff(np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]]))).max())
    for k in range(longest):
        near = np.minimum(at + k, len(a) - 1)
        found |= (a[near] == h) & (b[near] == g)
    return found


def by_row(ufunc: np.ufunc, values: np.ndarray, first: np.ndarray, empty) -> np.ndarray:
    """ufunc over the values of each row, `first` as words() gives it; rows without values get `empty`."""
    n = len(first) - 1
    out = np.full((n, *values.shape[1:]), empty, values.dtype)
    full = np.flatnonzero(first[1:] > first[:-1])
    if len(full):
        out[full] = ufunc.reduceat(values, first[full], axis=0)
    return out
