"""Vectorised views of text columns: UTF-8 bytes, words and word hashes, without a Python string per row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; the temporaries are about 40 bytes for each.
BLOCK = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_APART = np.zeros(256, bool)
_APART[[*range(0x21), *range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, after which a task's worker gives the memory of its batches back: it goes on to serve other tasks."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return held


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a uint64 over all others, in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, most: int = BLOCK):
    """Row ranges of at most ``most`` bytes, or a single longer row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def plain(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, ASCII punctuation and control bytes as blanks."""
    return np.where(_APART[data], np.uint8(0x20), _LOWER[data])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes other than ASCII white space; runs end with their row."""
    inside = ~_SPACE[data]
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * BLOCK) + 1
        made = []
        for base in (_BASE, _INVERSE):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            made.append(np.multiply.accumulate(t))
        _powers[:] = made
    return _powers


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; equal bytes give equal hashes anywhere. The ranges must be in order of their starts."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        top = int(ends[i:j].max())
        up, down = _tables(top - base)
        sums = np.zeros(top - base + 1, np.uint64)
        np.cumsum((data[base:top].astype(np.uint64) + np.uint64(1)) * up[: top - base], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - base] - sums[starts[i:j] - base]) * down[starts[i:j] - base]
        i = j
    return mix(out)


def windows(h: np.ndarray, kept: tuple[int, ...], span: int, seed: int = 0) -> np.ndarray:
    """Hash of the hashes at positions ``kept`` of every window of ``span`` items (len(h) - span + 1 of them)."""
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, (seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) % (1 << 64), np.uint64)
    for k, p in enumerate(kept):
        out += h[p : p + n] * np.uint64((0xD6E8FEB86659FD93 * (2 * k + 3) + 2 * k) % (1 << 64) | 1)
    return mix(out)


def shingle_sets(column: pa.Array, width: int):
    """(row, sorted distinct uint64 hashes of the ``width``-word shingles) of every row, in order.

    Words are runs other than ASCII white space with A-Z lower-cased. A row of fewer words has its whole sequence
    as one shingle; a row without words has the empty set.
    """
    data, offsets = utf8(column)
    for i, j in blocks(offsets):
        base = int(offsets[i])
        part = lower(data[base : int(offsets[j])])
        starts, ends, row = words(part, offsets[i : j + 1] - base)
        h = hashes(part, starts, ends)
        full = windows(h, tuple(range(width)), width)
        at = np.searchsorted(row, np.arange(j - i + 1))
        for r in range(j - i):
            a, b = int(at[r]), int(at[r + 1])
            if b - a >= width:
                yield i + r, np.unique(full[a : b - width + 1])
            elif b > a:
                yield i + r, windows(h[a:b], tuple(range(b - a)), b - a, seed=b - a)
            else:
                yield i + r, np.zeros(0, np.uint64)
