"""Content-defined cuts by a gear rolling hash."""

from __future__ import annotations

import numpy as np

from gleanery.llm.hashing import BYTE_VALUES

GEAR = (BYTE_VALUES >> np.uint64(32)).astype(np.uint32)
# A 32-bit gear hash forgets a byte after 32 steps.
WINDOW = 32


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: ``h = (h << 1) + GEAR[byte]``, all positions at once.

    The hash over the last 2 w bytes is that over the last w plus the one w bytes earlier, shifted by w.
    """
    hashes = GEAR[data]
    width = 1
    while width < WINDOW and width < len(hashes):
        earlier = hashes[:-width] << np.uint32(width)
        hashes[width:] += earlier
        width *= 2
    return hashes


def cuts(data: np.ndarray, bits: int) -> np.ndarray:
    """Positions after which the text is cut, one byte in ``2 ** bits`` on average; they depend on nearby bytes only."""
    return np.flatnonzero(gear_hashes(data) >> np.uint32(32 - bits) == 0) + 1


def valleys(data: np.ndarray, reach: int) -> np.ndarray:
    """Cuts after the bytes whose hash is the least of ``reach`` bytes on both sides.

    Chunks are longer than ``reach``, about twice as long on average, and rarely much longer; whether a byte is a cut
    depends on its neighbourhood only, so cuts behind an insertion stay where they were.  Only in text that repeats
    within ``reach`` bytes are hashes equal: of those, cuts are taken at the distance of some whole repeats.
    """
    hashes = gear_hashes(data)
    n = len(hashes)
    if n <= reach:
        return np.zeros(0, np.int64)
    padded = np.concatenate([np.full(reach, 0xFFFFFFFF, np.uint32), hashes, np.full(reach, 0xFFFFFFFF, np.uint32)])
    least, width = padded, 1  # least[i] is the minimum of width values from i on
    while width * 2 <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    ahead = reach - width
    window = np.minimum(least[:len(least) - ahead], least[ahead:])  # of reach values from i on
    before, after = window[:n], window[reach + 1:reach + 1 + n]
    found = np.flatnonzero((hashes <= before) & (hashes <= after)) + 1
    found = found[(found > reach) & (found <= n - reach)]
    if len(found) < 2 or np.diff(found).min() > reach:
        return found
    taken = [int(found[0])]
    for at in found[1:].tolist():
        if at - taken[-1] > reach:
            taken.append(at)
    return np.array(taken)
