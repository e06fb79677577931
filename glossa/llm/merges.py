"""Merging adjacent symbols of many rows at once, each row by a segment tree over the ranks of its adjacent pairs.

Leaf ``i`` of a row's tree holds the rank of the pair that symbol ``i`` forms with its right neighbour, together with ``i``, so
the root is the leftmost pair of the lowest rank. A merge changes three leaves at most; their paths to the root are set
anew. A row of n symbols therefore costs O(n log n), also where one row is a whole text. The trees of rows of like
length lie side by side in one array, so that a step is made for all of them together.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np

NONE = np.iinfo(np.int64).max
# Symbols whose trees lie in one array.
ROOM = 1 << 17


class Merges:
    """The pairs that merge, each with its rank (the lowest comes first) and the symbol it becomes."""

    def __init__(self, pairs: Mapping[tuple[int, int], tuple[int, int]]):
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        # A key that no pair has ends the list, so that every search finds a place.
        self.keys = np.append(keys[order], NONE)
        values = np.array(list(pairs.values()), np.int64).reshape(-1, 2)[order]
        self.ranks, self.becomes = np.append(values[:, 0], NONE), np.append(values[:, 1], -1)

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and new symbol of pairs; a pair of which one is negative, or that does not merge, has rank NONE."""
        keys = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, keys)
        found = (self.keys[at] == keys) & (a >= 0) & (b >= 0)
        return np.where(found, self.ranks[at], NONE), self.becomes[at]

    def merge(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rows that lie one after another in ``flat`` until no pair merges; ``sizes`` are at least 1."""
        flat, kept = np.array(flat, np.int64), np.ones(len(flat), bool)
        sizes = np.asarray(sizes, np.int64)
        starts = np.cumsum(sizes) - sizes
        levels = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
        for level in np.unique(levels[levels > 0]).tolist():
            rows = np.flatnonzero(levels == level)
            strip = max(1, ROOM >> level)
            for i in range(0, len(rows), strip):
                self._merge(flat, kept, starts[rows[i : i + strip]], sizes[rows[i : i + strip]], level)
        return flat[kept], np.add.reduceat(kept, starts, dtype=np.int64) if len(sizes) else sizes

    def _merge(self, flat: np.ndarray, kept: np.ndarray, starts: np.ndarray, sizes: np.ndarray, level: int) -> None:
        width, n = 1 << level, len(starts)
        spot = np.arange(width)
        inside = spot < sizes[:, None]
        # Column ``width`` stands for "no neighbour".
        symbols = np.full((n, width + 1), -1, np.int64)
        symbols[:, :width][inside] = flat[(starts[:, None] + spot)[inside]]
        right = np.tile(np.arange(1, width + 2), (n, 1))
        left = np.tile(np.arange(-1, width), (n, 1))
        left[:, 0] = width
        tree = np.full((n, 2 * width), NONE, np.int64)
        ranks, becomes = self.look(symbols[:, :width], symbols[:, 1:])
        tree[:, width:] = np.where(ranks < NONE, (ranks << level) + spot, NONE) if level < 40 else NONE
        for k in (1 << j for j in reversed(range(level))):
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])

        # One-dimensional views; a row's columns begin at its number times their count.
        symbol, after, before, node, becomes = symbols.ravel(), right.ravel(), left.ravel(), tree.ravel(), becomes.ravel()
        row = np.arange(n)
        while True:
            root = node[row * (2 * width) + 1]
            row, root = row[root < NONE], root[root < NONE]
            if not len(row):
                break
            at, wide = row * (width + 1), row * width
            i = root & (width - 1)
            j = after[at + i]
            new, beyond, back = becomes[wide + i], after[at + j], before[at + i]
            symbol[at + i], symbol[at + j] = new, -1
            after[at + i], before[at + beyond] = beyond, i
            here, made = self.look(new, symbol[at + beyond])
            becomes[wide + i] = made
            here = np.where(here < NONE, (here << level) + i, NONE)
            first = back == width
            there, made = self.look(symbol[at + back], new)
            there = np.where(there < NONE, (there << level) + back, NONE)
            back = np.where(first, i, back)
            becomes[wide + back] = np.where(first, becomes[wide + back], made)
            leaf = row * (2 * width) + width
            node[leaf + j], node[leaf + i] = NONE, here
            node[leaf + back] = np.where(first, here, there)
            paths, base = np.stack([j, i, back]) + width, row * (2 * width)
            for _ in range(level):
                paths >>= 1
                low = base + 2 * paths
                node[base + paths] = np.minimum(node[low], node[low + 1])
        alive = inside & (symbols[:, :width] >= 0)
        place = starts[:, None] + spot
        kept[place[inside & ~alive]] = False
        flat[place[alive]] = symbols[:, :width][alive]
