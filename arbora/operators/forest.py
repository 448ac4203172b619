"""Rooted forests in numpy: many trees at once, level by level.

A :class:`Forest` is built from the rows of one or more whole neurons, sorted by (neuron, node_id). Rows are addressed by
position; ``parent`` is -1 for roots (negative, null or missing parent ids).
"""

from __future__ import annotations

import numpy as np
import pandas as pd


class Forest:
    def __init__(self, nodes: pd.DataFrame):
        self.nodes = nodes
        self.n = len(nodes)
        self.neuron = pd.factorize(nodes["neuron"])[0].astype(np.int64)
        self.id = nodes["node_id"].to_numpy(np.int64)
        pid = nodes["parent_id"].fillna(-1).to_numpy(np.int64)
        self.ids, rank = np.unique(self.id, return_inverse=True)
        key = self.neuron * len(self.ids) + rank
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]
        self.parent = self.find(self.neuron, pid)
        self.parent[pid < 0] = -1
        has = self.parent >= 0
        self.children = np.bincount(self.parent[has], minlength=self.n)
        self.kids = np.argsort(np.where(has, self.parent, self.n), kind="stable")[: int(has.sum())]
        self.first = np.concatenate([[0], self.children.cumsum()])
        self.levels = self._levels()
        self.xyz = nodes[["x", "y", "z"]].to_numpy(float) if "x" in nodes else np.zeros((self.n, 3))
        self.step = np.where(has, np.sqrt(((self.xyz - self.xyz[self.parent]) ** 2).sum(axis=1)), 0.0)

    def find(self, neuron: np.ndarray, node_id: np.ndarray) -> np.ndarray:
        """Positions of (neuron code, node id), -1 where there is none."""
        if not self.n:
            return np.full(len(node_id), -1)
        rank = np.minimum(np.searchsorted(self.ids, node_id), len(self.ids) - 1)
        key = neuron * len(self.ids) + rank
        at = np.minimum(np.searchsorted(self.key, key), self.n - 1)
        return np.where((self.ids[rank] == node_id) & (self.key[at] == key) & (neuron >= 0), self.order[at], -1)

    def _levels(self) -> list[np.ndarray]:
        out, now, seen = [], np.flatnonzero(self.parent < 0), 0
        while len(now):
            out.append(now)
            seen += len(now)
            n = self.children[now]
            ends = n.cumsum()
            at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[now] - (ends - n), n)
            now = self.kids[at]
        if seen < self.n:
            raise ValueError("the parent links hold a cycle")
        return out

    def down(self, start: np.ndarray, step: np.ndarray | None = None) -> np.ndarray:
        """value[node] = value[parent] + step[node]; roots keep ``start``."""
        out = np.array(start, copy=True)
        for level in self.levels[1:]:
            out[level] = out[self.parent[level]] + (0 if step is None else step[level])
        return out

    def up(self, own: np.ndarray, op=np.add) -> np.ndarray:
        """Combines each node's own value with those of all its descendants."""
        out = np.array(own, copy=True)
        for level in self.levels[:0:-1]:
            op.at(out, self.parent[level], out[level])
        return out

    @property
    def depth(self) -> np.ndarray:
        return self.down(np.zeros(self.n, np.int64), np.ones(self.n, np.int64))

    @property
    def root(self) -> np.ndarray:
        """Position of each node's root."""
        return self.down(np.arange(self.n))

    @property
    def dist_root(self) -> np.ndarray:
        return self.down(np.zeros(self.n), self.step)

    @property
    def type(self) -> np.ndarray:
        return np.where(self.parent < 0, "root", np.where(self.children == 0, "end", np.where(self.children == 1, "slab", "branch")))

    def strahler(self, greedy: bool = False) -> np.ndarray:
        """Leaf 1; one child: inherits; more: the maximum, one more if shared (greedy: the sum)."""
        out = (self.children == 0).astype(np.int64)
        for level in self.levels[:0:-1]:
            p = self.parent[level]
            if greedy:
                np.add.at(out, p, out[level])
                continue
            best = np.zeros(self.n, np.int64)
            np.maximum.at(best, p, out[level])
            times = np.bincount(p, out[level] == best[p], self.n)
            q = np.unique(p)
            out[q] = best[q] + ((times[q] > 1) & (self.children[q] > 1))
        return out

    def paths(self) -> np.ndarray:
        """Longest-path decomposition: for each node the leaf whose path to a root, or to a longer path, it is on.

        At a branch point the child with the farthest leaf carries on (ties: the smaller node id).
        """
        far = self.up(np.where(self.children == 0, self.dist_root, -np.inf), np.maximum)
        leaf = np.arange(self.n)
        for level in self.levels[:0:-1]:
            order = np.lexsort((self.id[level], -far[level], self.parent[level]))
            level = level[order]
            p = self.parent[level]
            first = np.ones(len(p), bool)
            first[1:] = p[1:] != p[:-1]
            leaf[p[first]] = leaf[level[first]]
        return leaf

    def segments(self) -> np.ndarray:
        """For each node with a parent, the distal end (leaf or branch point) of its unbranched stretch; else -1."""
        fix = (self.children != 1) | (self.parent < 0)
        out = np.where(fix, np.arange(self.n), -1)
        for level in self.levels[:0:-1]:
            one = level[self.children[self.parent[level]] == 1]
            p = self.parent[one]
            p_slab = self.parent[p] >= 0
            out[p[p_slab]] = out[one[p_slab]]
        out[self.parent < 0] = -1
        return out

    def lca(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lowest common ancestors of pairs, -1 across components; by doubling."""
        depth = self.depth
        jump = [np.where(self.parent < 0, np.arange(self.n), self.parent)]
        while (1 << len(jump)) <= depth.max(initial=0):
            jump.append(jump[-1][jump[-1]])
        a, b = a.copy(), b.copy()
        swap = depth[a] < depth[b]
        a[swap], b[swap] = b[swap], a[swap]
        gap = depth[a] - depth[b]
        for k, j in enumerate(jump):
            w = (gap >> k) & 1 == 1
            a[w] = j[a[w]]
        for j in jump[::-1]:
            w = j[a] != j[b]
            a[w], b[w] = j[a[w]], j[b[w]]
        out = np.where(a == b, a, jump[0][a])
        return np.where((a == b) | (jump[0][a] == jump[0][b]), out, -1)

    def frame(self, **columns) -> pd.DataFrame:
        """(neuron, node_id) with more columns."""
        return pd.DataFrame({"neuron": self.nodes["neuron"].to_numpy(), "node_id": self.id, **columns})
