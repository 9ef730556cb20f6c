"""The two kernels that find repeated windows among contexts which share an anchor.

``columns`` builds a transform of a bounded shard column by column: the contexts are aligned
at their anchors, and each round, from the last column to the first, inserts one symbol of
every context, sorting the contexts by what follows and updating the common prefixes of
neighbours. (Equal windows share an anchor, so only suffixes of one column need an order
among each other: a transform of the collection by columns.) Neighbours with k symbols in
common start the same window.

``earlier`` streams contexts in order against a suffix automaton of those before: where the
matching statistic reaches k, the window that ends there occurs earlier.
"""

from __future__ import annotations

import numpy as np


def columns(groups: np.ndarray, symbols: list[np.ndarray], anchors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of every window of k symbols that another context of its group has at the same place about the anchor.

    ``groups`` ascends; symbols are non-negative integers.
    """
    m, size = len(symbols), np.array([len(x) for x in symbols])
    left = int(anchors.max())
    width = left + int((size - anchors).max())
    grid = np.full((m, width), -1, np.int32)
    for i, (x, a) in enumerate(zip(symbols, anchors.tolist(), strict=True)):
        grid[i, left - a : left - a + len(x)] = x
    grid = np.ascontiguousarray(grid.T)
    order, common = np.arange(m), np.zeros(m + 1, np.int32)
    group = groups.astype(np.int64) << 33
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for t in range(width - 1, -1, -1):
        symbol = grid[t][order]
        key = group[order] + symbol + 1
        if (key[1:] >= key[:-1]).all():
            common[1:-1] = np.where((key[1:] == key[:-1]) & (symbol[1:] >= 0), common[1:-1] + 1, 0)
        else:
            perm = np.argsort(key, kind="stable")
            key, symbol = key[perm], symbol[perm]
            same = np.flatnonzero((key[1:] == key[:-1]) & (symbol[1:] >= 0))
            fresh = np.zeros(m + 1, np.int32)
            if len(same):
                # the least common prefix between both places in the old order
                ends = np.stack((perm[same] + 1, perm[same + 1] + 1), axis=1).ravel()
                fresh[same + 1] = np.minimum.reduceat(common, ends)[::2] + 1
            order, common = order[perm], fresh
        long = common >= k
        hit = order[long[:-1] | long[1:]]
        if len(hit):
            found.append((hit, t - left + anchors[hit]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


class Automaton:
    """A suffix automaton of sequences, one after the other."""

    def __init__(self) -> None:
        self.size, self.link, self.next = [0], [-1], [{}]

    def add(self, sequence: list) -> None:
        size, link, next_ = self.size, self.link, self.next
        last = 0
        for x in sequence:
            have = next_[last].get(x)
            if have is not None and size[have] == size[last] + 1:
                last = have
                continue
            if have is not None:  # a state of its own for the shorter strings
                last = self._split(last, x, have)
                continue
            now = len(size)
            size.append(size[last] + 1)
            next_.append({})
            link.append(0)
            at = last
            while at >= 0 and x not in next_[at]:
                next_[at][x] = now
                at = link[at]
            if at >= 0:
                to = next_[at][x]
                link[now] = to if size[to] == size[at] + 1 else self._split(at, x, to)
            last = now

    def _split(self, at: int, x: object, to: int) -> int:
        copy = len(self.size)
        self.size.append(self.size[at] + 1)
        self.next.append(dict(self.next[to]))
        self.link.append(self.link[to])
        self.link[to] = copy
        while at >= 0 and self.next[at].get(x) == to:
            self.next[at][x] = copy
            at = self.link[at]
        return copy

    def statistics(self, sequence: list) -> list[int]:
        """For each place the length of the longest string that ends there and occurs in what was added."""
        size, link, next_ = self.size, self.link, self.next
        state = length = 0
        out = []
        for x in sequence:
            while state and x not in next_[state]:
                state = link[state]
                length = size[state]
            to = next_[state].get(x)
            if to is None:
                length = 0
            else:
                state, length = to, length + 1
            out.append(length)
        return out


def earlier(groups: np.ndarray, sequences: list[list], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of every window of k symbols that an earlier context of its group has; ``groups`` ascends."""
    who, where = [], []
    for a, b in zip(np.flatnonzero(np.diff(groups, prepend=-1)).tolist(), [*np.flatnonzero(np.diff(groups)) + 1, len(groups)], strict=True):
        if b - a < 2:
            continue
        seen = Automaton()
        for i in range(a, b):
            if i > a:
                ends = [e for e, length in enumerate(seen.statistics(sequences[i])) if length >= k]
                who += [i] * len(ends)
                where += [e - k + 1 for e in ends]
            if i < b - 1:
                seen.add(sequences[i])
    return np.array(who, np.int64), np.array(where, np.int64)
