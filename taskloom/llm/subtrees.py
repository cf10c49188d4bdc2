"""Suffix trees of groups of suffixes: their sorted order with common-prefix lengths.

A row has the symbols that a suffix begins with. The tree's internal nodes are
the stretches of the sorted order in which neighbours have at least so many
symbols in common, and more than the neighbours outside; a node's depth is that
number. So nodes are read off the order, and none is ever built.
"""

from __future__ import annotations

import numpy as np

#: Stands behind the end of a text: a symbol that no suffix shares.
END = -1


class Subtree:
    """Rows of symbols, from 0 and padded with END, in suffix order; ``lcp[i]`` symbols are common to the i-th and the one before."""

    def __init__(self, rows: np.ndarray):
        n, width = rows.shape
        self.rows = rows
        top = int(rows.max()) + 2 if rows.size else 2
        bits = max(1, (top - 1).bit_length())
        each = max(1, 63 // bits)
        keys = []
        for a in range(0, width, each):
            key = np.zeros(n, np.uint64)
            for k in range(a, min(a + each, width)):
                key = key << np.uint64(bits) | (rows[:, k] + 1).astype(np.uint64)
            keys.append(key)
        self.order = np.lexsort(keys[::-1]) if keys and n else np.arange(n)
        self.lcp = np.zeros(n, np.int64)
        if n > 1:
            # Whole keys first, symbols only where a key differs.
            open_ = np.arange(1, n)
            for k, key in enumerate(keys):
                sorted_ = key[self.order]
                same = sorted_[open_] == sorted_[open_ - 1]
                differ = open_[~same]
                a, b = k * each, min((k + 1) * each, width)
                equal = rows[self.order[differ], a:b] == rows[self.order[differ - 1], a:b]
                self.lcp[differ] = a + np.cumprod(equal, axis=1).sum(axis=1)
                open_ = open_[same]
                self.lcp[open_] = b
            # Suffixes that end alike share no symbol there.
            length = (rows != END).sum(axis=1)[self.order]
            self.lcp[1:] = np.minimum(self.lcp[1:], np.minimum(length[1:], length[:-1]))

    def deep(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) in the order of the highest nodes of at least this depth, two suffixes or more below each."""
        joined = self.lcp >= depth
        edge = np.diff(np.concatenate(([False], joined[1:], [False])).astype(np.int8))
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1

    def nodes(self, depth: int) -> list[tuple[int, int, int]]:
        """(depth, start, end) of all internal nodes of at least this depth."""
        out: list[tuple[int, int, int]] = []
        stack: list[tuple[int, int]] = []
        for i, d in enumerate([*self.lcp[1:].tolist(), 0], 1):
            start = i - 1
            while stack and stack[-1][0] > d:
                was, start = stack.pop()
                if was >= depth:
                    out.append((was, start, i))
            if d and (not stack or stack[-1][0] < d):
                stack.append((d, start))
        return out

    def maximal_repeats(self, depth: int, before: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(length, places of the suffixes) of repeats that can't grow on either side; ``before``: the symbol left of each suffix."""
        return [(d, self.order[a:b]) for d, a, b in self.nodes(depth) if len(np.unique(before[self.order[a:b]])) > 1 or (before[self.order[a:b]] == END).any()]
