"""Whole numbers as few bytes, for rows that carry many of them through a shuffle."""

from __future__ import annotations

import numpy as np

_BYTES = np.arange(8, dtype=np.uint8)


def pack(values: np.ndarray) -> bytes:
    """How many there are, the bytes each needs (half a byte a value), then these bytes; as unsigned 64-bit numbers."""
    values = np.ascontiguousarray(values).astype("<i8", copy=False).view("<u8")
    if not len(values):
        return b""
    width = np.zeros(len(values) + len(values) % 2, np.uint8)
    for k in range(8):
        width[:len(values)] += values >> np.uint64(8 * k) > 0
    used = values.view(np.uint8).reshape(-1, 8)[_BYTES < width[:len(values), None]]
    return np.int64(len(values)).astype("<i8").tobytes() + (width[::2] | width[1::2] << 4).tobytes() + used.tobytes()


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    halves = np.frombuffer(data, np.uint8, (n + 1) // 2, 8)
    width = np.stack([halves & 15, halves >> 4], 1).ravel()[:n]
    values = np.zeros((n, 8), np.uint8)
    values[_BYTES < width[:, None]] = np.frombuffer(data, np.uint8, offset=8 + len(halves))
    return values.view("<i8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Differences to the number before, modulo 2 ** 64: small where numbers are dense and in order, right in any."""
    unsigned = np.ascontiguousarray(values).view(np.uint64)
    return pack(np.diff(unsigned, prepend=np.uint64(0)).view(np.int64))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data).view(np.uint64), dtype=np.uint64).view(np.int64)
