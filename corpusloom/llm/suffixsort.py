"""Blockwise suffix sorting with a difference cover.

Suffixes of a byte text are sorted one bucket at a time, so what is held beside the text is a
bucket, not all suffixes. A bucket is sorted by as many bytes as the cover's period has. What
still ties is resolved by ranks: any two places i and j have a distance d below the period
at which both i + d and j + d are in the cover sample, whose suffixes have been ranked
before, so one comparison of ranks orders them however long they agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
#: A perfect difference set modulo its period.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)


def meeting_table() -> np.ndarray:
    """[a, b]: the least d for which a + d and b + d are both in the cover modulo the period."""
    inside = np.zeros(PERIOD, bool)
    inside[list(COVER)] = True
    r = np.arange(PERIOD)
    out = np.full((PERIOD, PERIOD), -1, np.int64)
    for d in range(PERIOD - 1, -1, -1):
        both = inside[(r + d) % PERIOD][:, None] & inside[(r + d) % PERIOD][None, :]
        out[both] = d
    return out


_MEET = meeting_table()
assert _MEET.min() >= 0


def words8(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number in byte order; zeros follow the text."""
    w = np.concatenate([text, np.zeros(7, np.uint8)]).astype(np.uint64)
    for step in (1, 2, 4):
        w = (w[:-step] << U(8 * step)) | w[step:]
    return w


class SuffixSorter:
    def __init__(self, text: np.ndarray, depth: int) -> None:
        """``depth``: bytes up to which suffixes are told apart."""
        self.depth = depth
        self.word = np.concatenate([words8(text), np.zeros(depth + 2 * PERIOD + 16, np.uint64)])
        place = np.arange(len(text) + PERIOD)
        sample = place[np.isin(place % PERIOD, COVER)]
        columns = [self.word[sample + 8 * k] for k in range(-(-depth // 8))]
        order = np.lexsort(columns[::-1])
        new = np.zeros(len(sample), bool)
        for c in columns:
            new[1:] |= np.diff(c[order]) != 0
        self.rank = np.zeros(len(text) + 2 * PERIOD, np.int64)
        self.rank[sample[order]] = np.cumsum(new)

    def sort(self, places: np.ndarray) -> np.ndarray:
        """One bucket's suffixes, in order."""
        columns = [self.word[places + 8 * k] for k in range(-(-PERIOD // 8))]
        order = np.lexsort(columns[::-1])
        out = places[order]
        new = np.ones(len(out), bool)
        new[1:] = False
        for c in columns:
            new[1:] |= np.diff(c[order]) != 0
        # Every group of ties is split in three by its first suffix, until groups are equal in rank.
        group = np.cumsum(new) - 1
        open_ = np.flatnonzero(np.bincount(group)[group] > 1)
        while len(open_):
            p, g = out[open_], group[open_]
            head = np.concatenate([[True], g[1:] != g[:-1]])
            pivot = p[head][np.cumsum(head) - 1]
            d = _MEET[p % PERIOD, pivot % PERIOD]
            side = np.sign(self.rank[p + d] - self.rank[pivot + d])
            order = np.lexsort((side, g))
            p, g, side = p[order], g[order], side[order]
            out[open_] = p
            split = np.concatenate([[True], (g[1:] != g[:-1]) | (side[1:] != side[:-1])])
            part = np.cumsum(split) - 1
            left = (np.bincount(part)[part] > 1) & (side != 0)
            group[open_] = part
            open_ = open_[left]
        return out

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the suffixes at a and b agree in ``depth`` bytes."""
        out = np.ones(len(a), bool)
        for k in range(0, self.depth, 8):
            x = self.word[a + k] ^ self.word[b + k]
            rest = self.depth - k
            out &= (x >> U(8 * (8 - rest)) if rest < 8 else x) == 0
        return out

    def buckets(self, places: np.ndarray, bucket: int = 1 << 19) -> Iterator[np.ndarray]:
        """The suffixes at ``places``, bucket after bucket of about ``bucket`` suffixes, each sorted."""
        n = -(-len(places) // bucket)
        if n <= 1:
            if len(places):
                yield self.sort(places)
            return
        first = self.word[places]
        cuts = np.unique(np.partition(first, [len(first) * k // n for k in range(1, n)])[[len(first) * k // n for k in range(1, n)]])
        which = np.searchsorted(cuts, first, "right").astype(np.int32)
        for k in range(len(cuts) + 1):
            own = places[which == k]
            if len(own):
                yield self.sort(own)


def classes(text: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """A number for each place: equal for those whose next ``depth`` bytes are."""
    sorter, out, n = SuffixSorter(text, depth), np.empty(len(text), np.int64), 0
    for own in sorter.buckets(places):
        new = np.concatenate([[1], ~sorter.same(own[1:], own[:-1])])
        out[own] = n + np.cumsum(new)
        n += len(own)
    return out[places]
