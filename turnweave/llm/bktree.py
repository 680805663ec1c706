"""BK-trees over binary fingerprints as arrays: many trees side by side, built and searched level by level.

A tree keeps each child under the integer Hamming distance to its parent; a search within radius r follows only the edges from
d-r to d+r, where d is the distance to the node. A fingerprint is a row of 64-bit words.
"""

from __future__ import annotations

import numpy as np

#: Visits that are worked on at a time.
SLAB = 1 << 21


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)


class Trees:
    """``values``: distinct fingerprints of each tree, one tree's behind the other's; ``first``: where each begins, and the end.
    A value is a node; its number is its row. ``parent`` is -1 for roots, ``edge`` the distance to the parent."""

    def __init__(self, values: np.ndarray, first: np.ndarray, parent: np.ndarray | None = None, edge: np.ndarray | None = None):
        self.values, self.first = values, first
        if parent is None:
            parent, edge = self._grown()
        self.parent, self.edge = parent, edge
        self.stride = 64 * values.shape[1] + 1
        key = parent * self.stride + edge
        nodes = np.flatnonzero(parent >= 0)
        order = nodes[np.argsort(key[nodes], kind="stable")]
        self.child, self.key = order, key[order]

    def _grown(self) -> tuple[np.ndarray, np.ndarray]:
        """Inserts all values at once: of those that reach the same edge of a node, the first becomes the child there and the
        others go on from it."""
        n = len(self.values)
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        owner = np.repeat(self.first[:-1], np.diff(self.first))
        todo = np.flatnonzero(np.arange(n) != owner)
        at = owner[todo]
        while len(todo):
            d = distance(self.values[todo], self.values[at])
            order = np.lexsort((todo, d, at))
            todo, at, d = todo[order], at[order], d[order]
            new = np.concatenate([[True], (at[1:] != at[:-1]) | (d[1:] != d[:-1])])
            parent[todo[new]], edge[todo[new]] = at[new], d[new]
            child = todo[np.flatnonzero(new)[np.cumsum(new) - 1]]
            todo, at = todo[~new], child[~new]
        return parent, edge

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int):
        """(query, node, distance) of all nodes within ``radius`` of each query, which starts at its root."""
        found = []
        stack = [(np.arange(len(queries)), roots)]
        while stack:
            query, node = stack.pop()
            if len(query) > SLAB:
                half = len(query) // 2
                stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            d = distance(queries[query], self.values[node])
            near = d <= radius
            found.append((query[near], node[near], d[near]))
            low = np.searchsorted(self.key, node * self.stride + np.maximum(d - radius, 0))
            high = np.searchsorted(self.key, node * self.stride + np.minimum(d + radius, self.stride - 1), "right")
            count = high - low
            if total := int(count.sum()):
                at = np.arange(total) + np.repeat(low - (np.cumsum(count) - count), count)
                stack.append((np.repeat(query, count), self.child[at]))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def forest(n: int, u: np.ndarray, v: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Numbers of the links that make a spanning forest of least weight; ties go to the earlier link. Every component takes its
    lightest link out of it, until none is left."""
    label = np.arange(n)
    rank = np.empty(len(u), np.int64)
    order = np.argsort(weight, kind="stable")
    rank[order] = np.arange(len(u))
    alive, kept = np.arange(len(u)), []
    while len(alive):
        a, b = label[u[alive]], label[v[alive]]
        outward = a != b
        alive, a, b = alive[outward], a[outward], b[outward]
        if not len(alive):
            break
        best = np.full(n, len(u), np.int64)
        np.minimum.at(best, a, rank[alive])
        np.minimum.at(best, b, rank[alive])
        chosen = order[np.unique(best[best < len(u)])]
        kept.append(chosen)
        # components along the chosen links: the least label spreads until nothing changes
        a, b = label[u[chosen]], label[v[chosen]]
        root = np.arange(n)
        while True:
            least = root.copy()
            np.minimum.at(least, a, root[b])
            np.minimum.at(least, b, root[a])
            least = np.minimum(least, least[least])
            if (least == root).all():
                break
            root = least
        label = root[label]
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)
