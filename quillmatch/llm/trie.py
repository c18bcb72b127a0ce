"""A path-compressed trie of item sequences that all follow one global order, and the traversal that counts overlaps.

The sequences come in lexicographic order, so what a sequence has in common with the one before it is an inner path that is
stored, and walked, once. A probe walks the trie level by level: each node adds the probe's items on its own segment to the
overlap of its parent, which all sequences below share, and a subtree is left as soon as neither its longest remainder nor
the probe's can lift its smallest set to the needed overlap.
"""

from __future__ import annotations

import numpy as np


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    k = min(len(a), len(b))
    differ = np.flatnonzero(a[:k] != b[:k])
    return int(differ[0]) if len(differ) else k


class Trie:
    """``sequences`` in lexicographic order, each without repeated items; ``sizes`` are the sizes of the whole sets."""

    def __init__(self, sequences: list[np.ndarray], sizes: np.ndarray):
        self.sizes = np.asarray(sizes, np.int64)
        lengths = np.array([len(x) for x in sequences], np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        joined = np.concatenate(sequences) if len(sequences) else np.zeros(0, np.uint64)
        self.values, flat = np.unique(joined, return_inverse=True)
        self.flat = flat.astype(np.int32)
        self.offsets = offsets
        # Node 0 is the root; a node's segment is a slice of ``flat``.
        begin, length, parent, end = [0], [0], [-1], [0]
        leaf = np.zeros(len(sequences), np.int64)
        stack, before = [0], None
        for j, x in enumerate(sequences):
            shared = _common(before, x) if before is not None else 0
            before, last = x, None
            while end[stack[-1]] > shared:
                last = stack.pop()
            top = stack[-1]
            if end[top] < shared:  # the path forks within a segment
                cut = shared - end[top]
                begin.append(begin[last]), length.append(cut), parent.append(top), end.append(shared)
                middle = len(end) - 1
                begin[last] += cut
                length[last] -= cut
                parent[last] = middle
                stack.append(middle)
            if len(x) > shared:
                begin.append(int(offsets[j]) + shared), length.append(len(x) - shared), parent.append(stack[-1]), end.append(len(x))
                stack.append(len(end) - 1)
            leaf[j] = stack[-1]
        self.begin, self.length, self.parent, end = (np.array(x, np.int64) for x in (begin, length, parent, end))
        self.leaf = leaf
        order = np.argsort(end, kind="stable")
        level = np.zeros(len(end), np.int64)
        up = self.parent.tolist()
        for k in order.tolist()[1:]:
            level[k] = level[up[k]] + 1
        by_level = np.argsort(level, kind="stable")
        self.levels = np.split(by_level, np.flatnonzero(np.diff(level[by_level])) + 1)[1:]
        # Of the sequences below a node: the longest remainder and the smallest set.
        longest, least = np.zeros(len(end), np.int64), np.full(len(end), np.iinfo(np.int64).max >> 8)
        np.maximum.at(longest, leaf, lengths)
        np.minimum.at(least, leaf, self.sizes)
        for nodes in reversed(self.levels):
            np.maximum.at(longest, self.parent[nodes], longest[nodes])
            np.minimum.at(least, self.parent[nodes], least[nodes])
        self.remaining, self.least = longest - end, least
        self._mark = np.zeros(len(self.values) + 1, np.int32)

    def sequence(self, j: int) -> np.ndarray:
        """The ``j``-th sequence, as places in ``values``."""
        return self.flat[self.offsets[j] : self.offsets[j + 1]]

    def places(self, items: np.ndarray) -> np.ndarray:
        """Places in ``values`` of those of ``items`` that occur in the trie."""
        if not len(self.values):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.values, items), len(self.values) - 1)
        return at[self.values[at] == items]

    def linked(self, items: np.ndarray, size: int, percent: int) -> np.ndarray:
        """The sequences whose sets link with a probe of ``size`` items in all, of which ``items`` (places) may be shared."""
        mark, width = self._mark, len(items)
        mark[items] = 1
        overlap = np.zeros(len(self.parent), np.int64)
        alive = np.zeros(len(self.parent), bool)
        alive[0] = True
        for nodes in self.levels:
            nodes = nodes[alive[self.parent[nodes]]]
            if not len(nodes):
                break
            length = self.length[nodes]
            first = np.cumsum(length) - length
            at = np.repeat(self.begin[nodes] - first, length) + np.arange(first[-1] + length[-1])
            have = overlap[self.parent[nodes]] + np.add.reduceat(mark[self.flat[at]], first)
            overlap[nodes] = have
            reach = have + np.minimum(self.remaining[nodes], width - have)
            alive[nodes[(100 + percent) * reach >= percent * (size + self.least[nodes])]] = True
        mark[items] = 0
        return np.flatnonzero(alive[self.leaf] & ((100 + percent) * overlap[self.leaf] >= percent * (size + self.sizes)))
