"""Suffix automata of many sequences at once, held in arrays."""

from __future__ import annotations

import numpy as np


def marked(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in one of the spans from ``first`` to ``last``."""
    return np.cumsum(np.bincount(first, minlength=n + 1)[: n + 1] - np.bincount(last + 1, minlength=n + 1)[: n + 1])[:n] > 0


class Automata:
    """The suffix automata of sequences laid end to end; ``owner`` numbers the sequences, ``symbols`` are 64-bit codes.

    A state is a class of substrings that end at the same positions. Sorted by what stands before them, read backwards,
    the end positions of a state are neighbours; so the states are the runs of neighbours that agree in at least
    some length, a state's longest substring has the least agreement in its run as length and the run's size as number of occurrences,
    and its suffix link is the next wider run. The order comes from doubling the compared length, where a position whose class
    has no other member is not looked at again; no substring crosses from one sequence to another.
    """

    def __init__(self, symbols: np.ndarray, owner: np.ndarray) -> None:
        n = self.n = len(symbols)
        self.start = np.zeros(n, dtype=np.int64)
        if n:
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            self.start = np.repeat(first, np.diff(np.r_[first, n]))
        with np.errstate(over="ignore"):
            key = symbols.astype(np.uint64) ^ (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            key = (key ^ (key >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(key)
        rank = np.zeros(n, dtype=np.int64)
        held = key[order]
        new = np.r_[True, held[1:] != held[:-1]] if n else np.zeros(0, dtype=bool)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else 0
        self.levels, size = [rank.astype(np.int32)], 1
        alone = new & np.r_[new[1:], True] if n else new
        left = order[~alone]
        while len(left):
            back = left - size
            second = np.where(back >= self.start[left], rank[np.maximum(back, 0)] + 1, 0)
            key = rank[left] * np.int64(n + 1) + second
            by = np.argsort(key)
            left, key = left[by], key[by]
            base = rank[left]
            at = np.arange(len(left))
            head = np.r_[True, base[1:] != base[:-1]]
            new = np.r_[True, key[1:] != key[:-1]]
            rank[left] = base + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))
            self.levels.append(rank.astype(np.int32))
            left = left[~(new & np.r_[new[1:], True])]
            size *= 2
        self.order = np.empty(n, dtype=np.int64)
        self.order[rank] = np.arange(n)
        self.shared = self._agreement()

    def _agreement(self) -> np.ndarray:
        """How many symbols each position in the order shares with the one before it; 0 at both ends."""
        shared = np.zeros(self.n + 1, dtype=np.int64)
        if self.n < 2:
            return shared
        a, b = self.order[:-1], self.order[1:]
        which = np.flatnonzero(self.levels[0][a] == self.levels[0][b])
        a, b = a[which], b[which]
        low_a, low_b = self.start[a], self.start[b]
        found = np.zeros(len(which), dtype=np.int64)
        for step in range(len(self.levels) - 1, -1, -1):
            x, y = a - found, b - found
            same = (x >= low_a) & (y >= low_b) & (self.levels[step][np.maximum(x, 0)] == self.levels[step][np.maximum(y, 0)])
            found += same * (1 << step)
        shared[which + 1] = found
        return shared

    def longest(self, times: int) -> np.ndarray:
        """At each end position the length of the longest substring that occurs at least ``times``; 0 where there is none."""
        n, out = self.n, np.zeros(self.n, dtype=np.int64)
        if times < 2 or n < times:
            return out
        least = self.shared[1 : n - times + 2].copy()  # of the run of ``times`` neighbours that begins here
        for k in range(2, times):
            np.minimum(least, self.shared[k : n - times + 1 + k], out=least)
        best = np.zeros(n, dtype=np.int64)
        for k in range(times):
            np.maximum(best[k : k + len(least)], least, out=best[k : k + len(least)])
        out[self.order] = best
        return out

    def occurrences(self, length: int) -> np.ndarray:
        """How often the substring of ``length`` that ends at each position occurs; 0 where none of that length ends."""
        out = np.zeros(self.n, dtype=np.int64)
        if self.n:
            run = np.cumsum(self.shared[: self.n] < length) - 1
            out[self.order] = np.bincount(run)[run]
            out[np.arange(self.n) - self.start + 1 < length] = 0
        return out

    def covered(self, times: int) -> np.ndarray:
        """Which positions lie in a substring that occurs at least ``times``."""
        size = self.longest(times)
        last = np.flatnonzero(size)
        return marked(last - size[last] + 1, last, self.n)
