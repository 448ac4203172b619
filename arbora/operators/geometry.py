"""Graphs and points in numpy, for use inside tasks: components, breadth-first levels, a k-d tree, shortest bridges."""

from __future__ import annotations

import numpy as np


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each element's component under the links a - b."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            above = label[label]
            if np.array_equal(above, label):
                break
            label = above
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def neighbours(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, near): the neighbours of i are near[first[i] : first[i + 1]], ascending, each once."""
    both = np.unique(np.concatenate([a * n + b, b * n + a]))
    return np.searchsorted(both // max(n, 1), np.arange(n + 1)), both % max(n, 1)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of the ranges [start, start + size), one after another."""
    ends = size.cumsum()
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


def levels(n: int, first: np.ndarray, near: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Steps from the nearest seed, breadth first; -1 where none reaches."""
    out = np.full(n, -1)
    out[seeds] = 0
    now, step = np.asarray(seeds), 0
    while len(now):
        step += 1
        reach = near[ranges(first[now], first[now + 1] - first[now])]
        now = np.unique(reach[out[reach] < 0])
        out[now] = step
    return out


class KdTree:
    """Points cut at the median of their widest axis down to leaves of ``leaf`` points.

    Queries go down the tree in batches: a node meets all queries that may still find something in it, so the work is
    numpy's; it grows as n log n for points that are not all in one place.
    """

    def __init__(self, xyz: np.ndarray, leaf: int = 32):
        self.xyz = xyz = np.ascontiguousarray(xyz, float)
        self.perm = np.arange(len(xyz))
        start, end, left, right, low, high = [], [], [], [], [], []
        todo = [(0, len(xyz), -1, False)] if len(xyz) else []
        while todo:
            s, e, above, is_right = todo.pop()
            me = len(start)
            if above >= 0:
                (right if is_right else left)[above] = me
            own = xyz[self.perm[s:e]]
            lo, hi = own.min(axis=0), own.max(axis=0)
            start.append(s), end.append(e), left.append(-1), right.append(-1), low.append(lo), high.append(hi)
            if e - s > leaf and (hi > lo).any():
                mid = (e - s) // 2
                self.perm[s:e] = self.perm[s:e][np.argpartition(own[:, int((hi - lo).argmax())], mid)]
                todo += [(s + mid, e, me, True), (s, s + mid, me, False)]
        self.start, self.end, self.left, self.right = map(np.array, (start, end, left, right))
        self.low, self.high = np.array(low).reshape(-1, 3), np.array(high).reshape(-1, 3)

    def _gap(self, node: int, at: np.ndarray) -> np.ndarray:
        """Squared distance of places to a node's box."""
        off = np.maximum(np.maximum(self.low[node] - at, at - self.high[node]), 0)
        return (off * off).sum(axis=1)

    def nearest(self, at: np.ndarray, k: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(positions, squared distances) of the ``k`` nearest points of each place, nearest first, ties by position.

        With fewer points the rest is -1 and inf.
        """
        n, m = len(self.xyz), len(at)
        found, dist = np.full((m, k), n), np.full((m, k), np.inf)

        def meet(node: int, q: np.ndarray) -> None:
            for i in range(0, len(q), 4096):
                part = q[i : i + 4096]
                own = np.sort(self.perm[self.start[node] : self.end[node]])
                for j in range(0, len(own), 4096):  # points that all lie in one place stay one leaf
                    some = own[j : j + 4096]
                    d = ((at[part, None] - self.xyz[some][None]) ** 2).sum(axis=2)
                    gain = (d <= dist[part, -1:]).any(axis=1)  # the others keep what they have
                    own_, d = part[gain], d[gain]
                    d = np.concatenate([dist[own_], d], axis=1)
                    p = np.concatenate([found[own_], np.broadcast_to(some, (len(own_), len(some)))], axis=1)
                    best = np.lexsort((p, d))[:, :k]
                    dist[own_], found[own_] = np.take_along_axis(d, best, 1), np.take_along_axis(p, best, 1)

        def visit(node: int, q: np.ndarray, seen: np.ndarray | None) -> None:
            if seen is None:  # way down to the leaf whose box is nearer, for a first bound
                if self.left[node] < 0:
                    home[q] = node
                    return meet(node, q)
                near = self._gap(self.left[node], at[q]) <= self._gap(self.right[node], at[q])
                for child, part in ((self.left[node], q[near]), (self.right[node], q[~near])):
                    if len(part):
                        visit(child, part, None)
                return None
            q = q[self._gap(node, at[q]) <= dist[q, -1]]
            if not len(q):
                return None
            if self.left[node] < 0:
                q = q[home[q] != node]
                return meet(node, q) if len(q) else None
            visit(self.left[node], q, seen)
            return visit(self.right[node], q, seen)

        home = np.full(m, -1)
        if n and m:
            visit(0, np.arange(m), None)
            visit(0, np.arange(m), home)
        return np.where(found == n, -1, found), dist

    def between(self, label: np.ndarray, usable: np.ndarray | None = None, limit: float = np.inf) -> dict[int, tuple[float, int, int]]:
        """For each label the shortest link from its points to another label's: (squared distance, i, j), i < j; ties by (i, j).

        A label's best so far bounds its search, and a node whose points all share a label is passed over by that
        label's points.
        """
        size = int(label.max(initial=-1)) + 1
        best = np.full(size, limit)
        first, second = np.full(size, len(label)), np.full(size, len(label))
        own = label[self.perm]
        ok = np.ones(len(label), bool) if usable is None else usable
        of = np.concatenate([[0], (own[1:] != own[:-1]).cumsum()]) if len(own) else np.zeros(0, int)
        uniform = of[self.end - 1] == of[self.start] if len(own) else np.zeros(0, bool)

        def take(c: np.ndarray, d: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
            i, j = np.minimum(i, j), np.maximum(i, j)
            order = np.lexsort((j, i, d, c))
            order = order[np.concatenate([[True], c[order][1:] != c[order][:-1]])]
            c, d, i, j = c[order], d[order], i[order], j[order]
            less = (d < best[c]) | (d == best[c]) & ((i < first[c]) | (i == first[c]) & (j < second[c]))
            c = c[less]
            best[c], first[c], second[c] = d[less], i[less], j[less]

        def pairs(i: np.ndarray, j: np.ndarray) -> None:
            apart = (label[i] != label[j]) & ok[i] & ok[j]
            i, j = i[apart], j[apart]
            if len(i):
                d = ((self.xyz[i] - self.xyz[j]) ** 2).sum(axis=1)
                take(np.concatenate([label[i], label[j]]), np.tile(d, 2), np.tile(i, 2), np.tile(j, 2))

        for off in (1, 2, 4, 8):  # neighbours in the tree's order give first bounds
            pairs(self.perm[:-off], self.perm[off:])

        def visit(node: int, q: np.ndarray) -> None:
            if uniform[node]:
                q = q[label[q] != own[self.start[node]]]
            q = q[self._gap(node, self.xyz[q]) <= best[label[q]]]
            if not len(q):
                return
            if self.left[node] >= 0:
                visit(self.left[node], q)
                visit(self.right[node], q)
                return
            for s in range(self.start[node], self.end[node], 1024):
                t = self.perm[s : min(s + 1024, self.end[node])]
                t = t[ok[t]]
                for k in range(0, len(q), 1024):
                    d = ((self.xyz[q[k : k + 1024], None] - self.xyz[t][None]) ** 2).sum(axis=2)
                    c = label[q[k : k + 1024]]
                    x, y = np.nonzero((d <= best[c][:, None]) & (c[:, None] != label[t][None]))
                    if len(x):
                        take(c[x], d[x, y], q[k : k + 1024][x], t[y])

        q = np.flatnonzero(ok)
        if len(q):
            visit(0, q)
        return {c: (float(best[c]), int(first[c]), int(second[c])) for c in np.flatnonzero(second < len(label)).tolist()}


def _few_labels(xyz: np.ndarray, label: np.ndarray, limit: float) -> np.ndarray | None:
    """``bridges`` for up to 1,024 labels; None if that would take more than 4,000,000 distances.

    The distances of the labels' first points are bounds from above. A pair whose boxes lie farther apart than the longest step of
    the best way between the two, as those bounds have it, has no part in the tree; only points of the other pairs are compared.
    """
    order = np.argsort(label, kind="stable")
    own = label[order]
    head = np.flatnonzero(np.diff(own, prepend=-1))
    m, size = len(head), np.diff(head, append=len(own))
    if m > 1024:
        return None
    at = xyz[order]
    low, high, rep = np.minimum.reduceat(at, head), np.maximum.reduceat(at, head), at[head]
    upper, lower = np.zeros((m, m)), np.zeros((m, m))
    for c in range(3):
        off = rep[:, None, c] - rep[None, :, c]
        upper += off * off
        gap = np.maximum(low[:, None, c] - high[None, :, c], 0)
        gap = np.maximum(gap, gap.T)
        lower += gap * gap
    worst, best, above, done = np.zeros((m, m)), upper[0].copy(), np.zeros(m, np.int64), np.zeros(m, bool)
    done[0], best[0], place = True, np.inf, np.zeros(m, np.int64)
    for k in range(1, m):
        v = int(best.argmin())
        step, w = best[v], int(above[v])
        if size[v] * size[w] <= 4096:  # the true distance of the two bounds better
            step = ((at[head[v] : head[v] + size[v], None] - at[None, head[w] : head[w] + size[w]]) ** 2).sum(axis=2).min()
        worst[k, :k] = worst[:k, k] = np.maximum(worst[place[w], :k], step)
        place[v] = k
        done[v], best[v] = True, np.inf
        less = ~done & (upper[v] < best)
        best[less], above[less] = upper[v][less], v
    worst = worst[np.ix_(place, place)]
    p, q = np.nonzero(np.triu(lower <= np.minimum(worst, limit) * (1 + 1e-9), 1))
    pairs = size[p] * size[q]
    if pairs.sum() > 4_000_000:
        return None
    which = np.repeat(np.arange(len(p)), pairs)
    place = ranges(0 * pairs, pairs)
    i, j = order[head[p][which] + place // size[q][which]], order[head[q][which] + place % size[q][which]]
    d = ((xyz[i] - xyz[j]) ** 2).sum(axis=1)
    near = np.flatnonzero(d == np.minimum.reduceat(d, pairs.cumsum() - pairs)[which]) if len(d) else np.zeros(0, np.int64)
    i, j, d = np.minimum(i, j)[near], np.maximum(i, j)[near], d[near]
    root, out = list(range(m)), []
    for k in np.lexsort((j, i, d))[: np.count_nonzero(d <= limit)].tolist():
        a, b = int(label[i[k]]), int(label[j[k]])
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[a] = b
            out.append((i[k], j[k]))
    return np.array(out, np.int64).reshape(-1, 2)


def bridges(xyz: np.ndarray, label: np.ndarray, usable: np.ndarray | None = None, max_dist: float | None = None) -> np.ndarray:
    """(m, 2) pairs of points that join the labels at least total length: a minimum spanning tree over the labels.

    Borůvka's rounds: each label takes its shortest link to another, all of them join; at most log2(labels) rounds.
    Equal lengths go by (i, j), so no round closes a cycle. Links longer than ``max_dist`` are not made. Few labels of few points
    do without rounds (``_few_labels``), with the same links.
    """
    keep = np.arange(len(label)) if usable is None else np.flatnonzero(usable)
    limit = np.inf if max_dist is None else float(max_dist) ** 2 * (1 + 1e-12)
    label = np.unique(label[keep], return_inverse=True)[1]
    few = _few_labels(xyz[keep], label, limit) if len(keep) else None
    if few is not None:
        return keep[few]
    tree = KdTree(xyz[keep])
    out: list[tuple[int, int]] = []
    while len(np.unique(label)) > 1:
        found = sorted(set(tree.between(label, None, limit).values()))
        if not found:
            break
        links = np.array([(i, j) for _, i, j in found])
        out += links.tolist()
        size = int(label.max()) + 1
        label = components(size, label[links[:, 0]], label[links[:, 1]])[label]
    return keep[np.array(out, np.int64).reshape(-1, 2)]
