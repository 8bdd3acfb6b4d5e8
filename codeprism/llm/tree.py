"""A hierarchical k-means tree over unit vectors, searched best bin first.

The tree is two arrays of nodes; a search keeps, for each query, a priority queue of the nodes that
its traversal has reached. The queue of a whole block of queries is one matrix (query x node, minus
infinity where a node has not been reached), so that "take the best node of each queue" is a row-wise
argmax. An inner node puts its children into the queue; a leaf is visited.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Centroids (unit length) and the centroid of each row; at most ``k``, none of them empty."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = np.argmax(x @ c.T, axis=1)
        order = np.argsort(at, kind="stable")
        start = np.searchsorted(at[order], np.arange(len(c)))
        full = np.diff(np.append(start, len(x))) > 0
        c = unit(np.add.reduceat(x[order], start[full], axis=0))
    return c, np.argmax(x @ c.T, axis=1)


@dataclass
class Tree:
    centre: np.ndarray  # node x width
    children: list[np.ndarray]  # of each node; empty: a leaf
    leaf: np.ndarray  # number of the leaf, -1 for an inner node
    node_of: np.ndarray  # node of each leaf

    @property
    def leaves(self) -> int:
        return len(self.node_of)

    def visits(self, q: np.ndarray, margin: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaves in the order of their visit: (row of the query, leaf, margin at which it is visited).

        A query goes on while the best node of its queue is within ``margin`` of the best leaf it has
        seen, ``most`` leaves at most. The third array is the widening that the visit needed.
        """
        parts = [self._visits(q[i : i + 4096], margin, most, i) for i in range(0, len(q), 4096)]
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # type: ignore[return-value]

    def _visits(self, q, margin, most, base):
        score = q @ self.centre.T
        queue = np.full(score.shape, -np.inf, np.float32)
        queue[:, self.children[0]] = score[:, self.children[0]]
        if not len(self.children[0]):
            queue[:, 0] = score[:, 0]
        alive, best = np.arange(len(q)), np.full(len(q), -np.inf)
        widened, seen = np.zeros(len(q)), np.zeros(len(q), np.int64)
        rows, leaves, widths = [], [], []
        inner = [n for n in range(len(self.children)) if len(self.children[n])]
        while len(alive):
            top = np.argmax(queue[alive], axis=1)
            s = queue[alive, top]
            widened[alive] = np.maximum(widened[alive], np.where(np.isfinite(best[alive]), best[alive] - s, 0))
            go = np.isfinite(s) & (widened[alive] <= margin)
            if most is not None:
                go &= seen[alive] < most
            alive, top, s = alive[go], top[go], s[go]
            queue[alive, top] = -np.inf
            number = self.leaf[top]
            hit = number >= 0
            rows.append(alive[hit] + base), leaves.append(number[hit]), widths.append(widened[alive[hit]])
            best[alive[hit]] = np.maximum(best[alive[hit]], s[hit])
            seen[alive[hit]] += 1
            opened = top[~hit]
            for n in (inner if len(inner) < 64 else np.unique(opened)) if len(opened) else ():
                who = alive[~hit][opened == n]
                if len(who):
                    kids = self.children[n]
                    queue[np.ix_(who, kids)] = score[np.ix_(who, kids)]
        return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.concatenate(leaves) if leaves else np.zeros(0, np.int64), np.concatenate(widths) if widths else np.zeros(0)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The first leaf that best bin first reaches for each row: the leaf the row is filed in."""
        rows, leaves, _ = self.visits(x, 0.0, 1)
        out = np.zeros(len(x), np.int64)
        out[rows] = leaves
        return out


def grow(x: np.ndarray, leaves: int, branch: int = 16, rounds: int = 6, seed: int = 7) -> Tree:
    """A tree of about ``leaves`` leaves, fitted on ``x``; a leaf holds about the same share of the rows."""
    rng = np.random.default_rng(seed)
    centre, children, leaf, nodes = [unit(x.mean(axis=0, keepdims=True))[0] if len(x) else np.zeros(x.shape[1], x.dtype)], [np.zeros(0, np.int64)], [-1], []
    target = max(1, len(x) // max(1, leaves))
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        want = min(branch, int(np.ceil(len(rows) / target)))
        c, at = spherical_kmeans(x[rows], want, rounds, rng) if want > 1 else (None, None)
        if c is None or len(c) < 2 or np.bincount(at).max() == len(rows):
            leaf[node] = len(nodes)
            nodes.append(node)
            continue
        kids = []
        for j in range(len(c)):
            if not (at == j).any():
                continue
            kids.append(len(centre))
            centre.append(c[j]), children.append(np.zeros(0, np.int64)), leaf.append(-1)
            todo.append((kids[-1], rows[at == j]))
        children[node] = np.array(kids)
    return Tree(np.asarray(centre, np.float32), children, np.asarray(leaf), np.asarray(nodes))
