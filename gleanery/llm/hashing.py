"""Hashes of the words and lines of many texts at once, in numpy: the helper of the Arrow stages.

A word's hash depends on its bytes only, so it is the same in every task and for every batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

# Texts are taken together up to so many bytes; one longer text is taken alone.  What is made of a byte takes some 100
# bytes, in each worker of an executor.
SLICE_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
# Letters and digits, everything beyond ASCII among the letters, against signs; 0 is space.
PIECE_CLASS = np.where(IS_SPACE, 0, 2).astype(np.uint8)
PIECE_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
WORD_CLASS = np.where(IS_SPACE, 0, 1).astype(np.uint8)

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        room = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            made = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(room - 1, b)]), dtype=np.uint64) for b in (_BASE, _INVERSE)]
        if room > 16 * SLICE_BYTES:  # one very long text: not kept
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


class Texts(NamedTuple):
    """The bytes of some texts, and where each begins."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


class Runs(NamedTuple):
    """Words (or lines, or pieces) in order: the text each is in, its first byte and the byte after it, its hash."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Runs of rows with about ``size`` bytes of text; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + size, "right")) - 1)
        stop = min(stop, len(column))
        yield row, stop, Texts(data[ends[row]:ends[stop]], ends[row:stop + 1] - ends[row])
        row = stop
    # A worker process outlives its task: what a batch needed goes back to the system.
    give_back()


def give_back() -> None:
    """Return freed memory to the system; the C library alone keeps it where it knows no ``malloc_trim``."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTE_VALUES[data] * powers(len(data) + 1)[0][:len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def runs(texts: Texts, classes: np.ndarray = WORD_CLASS, sums: np.ndarray | None = None) -> Runs:
    """Maximal runs of bytes of one class that is not 0, none across two texts."""
    data, offsets = texts
    kind = classes[data]
    edge = np.empty(len(kind) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    filled = kind[start] > 0 if len(data) else np.zeros(0, bool)
    start, end = start[filled], end[filled]
    text = np.searchsorted(offsets, start, "right") - 1
    return Runs(text, start, end, span_hashes(prefix_sums(data) if sums is None else sums, start, end))


def lines(texts: Texts, sums: np.ndarray) -> Runs:
    """What lies between line ends, without empty lines."""
    data, offsets = texts
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    breaks = np.flatnonzero(data == 10)
    edge[breaks] = edge[breaks + 1] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    kept = data[start] != 10
    start, end = start[kept], end[kept]
    return Runs(np.searchsorted(offsets, start, "right") - 1, start, end, span_hashes(sums, start, end))


def counts_by_text(texts: Texts, marked: np.ndarray) -> np.ndarray:
    """Marked bytes of each text."""
    total = np.concatenate([[0], np.cumsum(marked, dtype=np.int64)])
    return np.diff(total[texts.offsets])
