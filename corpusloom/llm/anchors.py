"""Content-chosen anchors of fixed-length windows over documents' bytes.

Every window of ``length`` bytes has an anchor: the leftmost of its substrings of ``gram``
bytes with the smallest hash. Equal windows have equal anchors at equal distances, so two
windows can only be equal if their anchors' hashes are. Consecutive windows share
anchors; a run is an anchor with all windows that chose it.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
TILE = 1 << 16
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20240321).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)

_SPREAD = U(0xD1B54A32D192ED03)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, TILE + 4096), _powers(pow(_BASE, -1, 2**64), TILE + 4096)


def shape(length: int) -> tuple[int, int]:
    """Bytes of an anchor, and how many anchors a window chooses from."""
    gram = length // 2 + 1
    if length > 4000:
        raise ValueError("windows of at most 4000 bytes")
    return gram, length - gram + 1


def _slide(v: np.ndarray, width: int) -> np.ndarray:
    """Distance from each place to the leftmost smallest of the ``width`` values from there on."""
    at, size = np.zeros(len(v), np.uint16), 1
    while size < width:
        step = min(size, width - size)
        right = v[step:] < v[:-step]
        at = np.where(right, at[step:] + np.uint16(step), at[:-step])
        v = np.minimum(v[step:], v[:-step])
        size += step
    return at


def runs(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, anchor, first and last window of every run, in order; ``ends`` are the documents' ends in ``data``."""
    gram, width = shape(length)
    keys, anchors, firsts, lasts = [], [], [], []
    for t in range(0, max(0, len(data) - length + 1), TILE):
        part = data[t : t + TILE + length - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _UP[: len(part)], out=total[1:])
        h = (total[gram:] - total[:-gram]) * _DOWN[: len(part) - gram + 1]
        h ^= h >> U(29)
        h *= U(0xBF58476D1CE4E5B9)
        h ^= h >> U(32)
        n = len(part) - length + 1
        anchor = np.arange(n) + _slide((h >> U(32)).astype(np.uint32), width)[:n]
        # Windows that cross an end are none.
        fine = np.ones(n, bool)
        i, j = np.searchsorted(ends, [t, t + n + length], "right")
        for e in ends[i:j].tolist():
            fine[max(0, e - t - length + 1) : max(0, e - t)] = False
        first = fine.copy()
        first[1:] &= (anchor[1:] != anchor[:-1]) | ~fine[:-1]
        last = fine.copy()
        last[:-1] &= (anchor[1:] != anchor[:-1]) | ~fine[1:]
        f, g = np.flatnonzero(first), np.flatnonzero(last)
        keys.append(h[anchor[f]] * _SPREAD)  # smallest hashes are small: spread them over all numbers
        anchors.append(anchor[f] + t)
        firsts.append(f + t)
        lasts.append(g + t)
    if not keys:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in (keys, anchors, firsts, lasts))
