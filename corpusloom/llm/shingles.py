"""Hashed word shingles of texts, vectorised over bytes."""

from __future__ import annotations

import numpy as np

U = np.uint64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_rng = np.random.default_rng(20240101)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE[32] = 0
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
PART = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        n = 1 << n.bit_length()
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def _hash_part(raw: bytes) -> np.ndarray:
    a = np.frombuffer(raw, np.uint8)
    word = a != 32
    edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _tables(len(a) + 1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * up[: len(a)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """A number for every word; A-Z are lower-cased, blanks are 0x20 and 0x09 to 0x0D."""
    if not text:
        return np.empty(0, np.uint64)
    raw = text.encode("utf-8", "surrogatepass").translate(_LOWER)
    if len(raw) <= PART:
        return _hash_part(raw)
    parts, at = [], 0
    while at < len(raw):
        end = raw.find(b" ", at + PART)
        end = len(raw) if end < 0 else end
        parts.append(_hash_part(raw[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct shingles of ``size`` words; of fewer words the whole sequence as one; of none no shingle."""
    w = word_hashes(text)
    n = len(w)
    if not n:
        return w
    k = min(n, size)
    s = np.full(n - k + 1, U(k), np.uint64)
    for i in range(k):
        s += w[i : n - k + 1 + i] * _PLACE[i]
    return np.unique(mix(s))
