"""Signature trees: which of some token sets overlap enough, by dual traversal of a tree.

A leaf is a set with a bitmap of its tokens. A node holds the OR of its
children's bitmaps, the range of their sizes, and the most tokens by which a
set below outnumbers its bits. Two sets share at most the common bits of their
nodes' bitmaps plus the smaller of these excesses, so a pair of nodes whose
largest possible overlap is short of what their least sizes need is pruned with
all pairs below it; so is a pair whose sets are in one component already.
"""

from __future__ import annotations

import numpy as np

_FAN = 8
_PAIRS = 1 << 15


class _Labels:
    """Union-find with labels as an array."""

    def __init__(self, labels: np.ndarray):
        self.of = np.unique(labels, return_inverse=True)[1]
        self.parent = list(range(int(self.of.max()) + 1 if len(self.of) else 0))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(int(self.of[i])), self.find(int(self.of[j]))
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def roots(self) -> np.ndarray:
        table = np.array([self.find(x) for x in range(len(self.parent))], np.int64)
        return table[self.of]


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the given ones join, all from the least of each component: no long chains."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    labels = _Labels(np.arange(len(nodes)))
    for i, j in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
        labels.join(i, j)
    # Nodes are in ascending order and joins keep the smaller root, so a root is its component's least.
    least = nodes[labels.roots()] if len(nodes) else nodes
    return least[least != nodes], nodes[least != nodes]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct tokens."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


class SignatureTree:
    """A tree over sets ordered by size; ``labels`` are components known before."""

    def __init__(self, sets: list[np.ndarray], percent: int, labels: np.ndarray | None = None):
        self.percent = percent
        size = np.array([len(s) for s in sets], np.int64)
        self.order = np.lexsort((np.array([int(s[-1]) if len(s) else 0 for s in sets], np.uint64), size))
        self.sets = [sets[i] for i in self.order]
        size = size[self.order]
        labels = np.arange(len(sets)) if labels is None else np.asarray(labels)[self.order]
        self.labels = _Labels(labels)
        typical = int(np.median(size)) if len(size) else 0
        bits = 1 << max(8, min(16, int(8 * typical - 1).bit_length() if typical else 8))
        maps = np.zeros((len(sets), bits // 8), np.uint8)
        for i, s in enumerate(self.sets):
            at = (s % np.uint64(bits)).astype(np.int64)
            np.bitwise_or.at(maps[i], at >> 3, (1 << (at & 7)).astype(np.uint8))
        maps = maps.view(np.uint64)
        excess = size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        #: (bitmaps, least size, greatest size, greatest excess) of each level, leaves first.
        self.levels = [(maps, size, size, excess)]
        while len(self.levels[-1][0]) > _FAN:
            m, lo, hi, ex = self.levels[-1]
            at = np.arange(0, len(m), _FAN)
            self.levels.append((np.bitwise_or.reduceat(m, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(ex, at)))

    def _open(self, level: int, i: np.ndarray, j: np.ndarray, uniform: np.ndarray) -> np.ndarray:
        """Which node pairs may hold a link between two components."""
        maps, lo, hi, ex = self.levels[level]
        p = self.percent
        ok = (100 * hi[i] >= p * lo[j]) & (100 * hi[j] >= p * lo[i])
        ok &= (uniform[i] < 0) | (uniform[i] != uniform[j])
        at = np.flatnonzero(ok)
        if len(at):
            a, b = i[at], j[at]
            common = np.bitwise_count(maps[a] & maps[b]).sum(axis=1, dtype=np.int64)
            most = np.minimum(common + np.minimum(ex[a], ex[b]), np.minimum(hi[a], hi[b]))
            ok[at] = (100 + p) * most >= p * (lo[a] + lo[b])
        return ok

    def _uniform(self) -> list[np.ndarray]:
        """For each level: the one component of all sets below a node, or -1."""
        out = [self.labels.roots()]
        for level in self.levels[1:]:
            at = np.arange(0, len(out[-1]), _FAN)
            low, high = np.minimum.reduceat(out[-1], at), np.maximum.reduceat(out[-1], at)
            out.append(np.where(low == high, low, -1))
            del level
        return out

    def _try(self, i: int, j: int) -> bool:
        return linked(self.sets[i], self.sets[j], self.percent) and self.labels.join(i, j)

    def links(self) -> list[tuple[int, int]]:
        """Verified links that join all components that links between the sets join; indices as given."""
        found: list[tuple[int, int]] = []
        n = len(self.sets)
        # Neighbours in the order and a few pivots join dense groups, so that the traversal can prune them.
        for gap in (1, 2, 5):
            for i in range(n - gap):
                if self._try(i, i + gap):
                    found.append((i, i + gap))
        for _ in range(4):
            roots = self.labels.roots()
            ids, counts = np.unique(roots, return_counts=True)
            if len(ids) < 2 or n < 3:
                break
            members = np.flatnonzero(roots == ids[counts.argmax()])
            pivot = int(members[len(members) // 2])
            rest = np.flatnonzero(roots != roots[pivot])
            rest = rest[self._open(0, np.full(len(rest), pivot), rest, roots)]
            for j in rest.tolist():
                if self._try(pivot, j):
                    found.append((pivot, j))
        top = len(self.levels) - 1
        i, j = np.triu_indices(len(self.levels[top][0]))
        stack = [(top, i, j)]
        uniform, changed = self._uniform(), 0
        while stack:
            level, i, j = stack.pop()
            if changed >= 64:
                uniform, changed = self._uniform(), 0
            keep = self._open(level, i, j, uniform[level]) if level else self._open(0, i, j, uniform[0]) & (i != j)
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            if level == 0:
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    if self.labels.find(int(self.labels.of[a])) != self.labels.find(int(self.labels.of[b])) and self._try(a, b):
                        found.append((a, b))
                        changed += 1
                continue
            below = len(self.levels[level - 1][0])
            for at in range(0, len(i), _PAIRS // _FAN**2):
                a, b = i[at : at + _PAIRS // _FAN**2], j[at : at + _PAIRS // _FAN**2]
                ca = (a[:, None, None] * _FAN + np.arange(_FAN)[None, :, None] + np.zeros((1, 1, _FAN), np.int64)).ravel()
                cb = (b[:, None, None] * _FAN + np.arange(_FAN)[None, None, :] + np.zeros((1, _FAN, 1), np.int64)).ravel()
                fit = (ca < below) & (cb < below) & (ca <= cb)
                stack.append((level - 1, ca[fit], cb[fit]))
        return [(int(self.order[a]), int(self.order[b])) for a, b in found]
