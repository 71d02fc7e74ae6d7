"""64-bit fingerprints of substrings, for whole arrays of places at once."""
from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 19
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: np.ndarray = np.ones(1, np.uint64)
_inverses: np.ndarray = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        def table(base: int) -> np.ndarray:
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            return np.cumprod(steps, dtype=np.uint64)
        _powers, _inverses = table(_BASE), table(pow(_BASE, -1, 1 << 64))
    return _powers, _inverses


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def fingerprints(data: np.ndarray, places: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """For each length, the fingerprints of the bytes that start at ``places``
    (sorted; place + length is within ``data``). Works piece by piece, so memory
    beyond the results doesn't grow with ``data``."""
    out = [np.empty(len(places), np.uint64) for _ in lengths]
    longest, at = max(lengths), 0
    while at < len(places):
        a = int(places[at])
        to = int(np.searchsorted(places, a + _PIECE))
        part = data[a:int(places[to - 1]) + longest]
        powers, inverses = _tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUES[part] * powers[:len(part)], dtype=np.uint64, out=sums[1:])
        here = places[at:to] - a
        low, turn = sums[here], inverses[here]
        for made, length in zip(out, lengths, strict=True):
            made[at:to] = mixed((sums[here + length] - low) * turn)
        at = to
    return out
