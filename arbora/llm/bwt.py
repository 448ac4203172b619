"""Column-wise construction of the Burrows-Wheeler transform and common prefixes of a collection of strings.

One symbol of every string is inserted each round, from the last to the first, after the published algorithm of
Bauer, Cox and Rosone and its extension to common prefixes. The collection's columns (symbol, first symbol, source
row, common prefix, owner) are rewritten front to back once a round, in runs of rows.
"""

from __future__ import annotations

import numpy as np

_CELL = 64


class _RangeMin:
    """Minimum of any range of an array: minima within cells from both ends, and a sparse table over cells."""

    def __init__(self, x: np.ndarray):
        n = -(-len(x) // _CELL)
        cells = np.full(n * _CELL, 255, np.uint8)
        cells[: len(x)] = x
        self.flat = cells
        cells = cells.reshape(n, _CELL)
        self.head = np.minimum.accumulate(cells, axis=1).ravel()
        self.tail = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [cells.min(axis=1)]
        while len(self.levels[-1]) > (1 << len(self.levels)) // 2:
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            if len(last) <= step:
                break
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minimum over [a, b], a <= b."""
        ca, cb = a // _CELL, b // _CELL
        out = np.minimum(self.tail[a], self.head[b])
        gap = cb - ca - 1
        wide = np.flatnonzero(gap > 0)
        if len(wide):
            level = np.frexp(gap[wide].astype(float))[1] - 1
            lo, hi = ca[wide] + 1, cb[wide]
            best = np.full(len(wide), 255, np.uint8)
            for k in np.unique(level).tolist():
                w = level == k
                best[w] = np.minimum(self.levels[k][lo[w]], self.levels[k][hi[w] - (1 << k)])
            out[wide] = np.minimum(out[wide], best)
        near = np.flatnonzero(gap < 0)
        if len(near):
            lo, hi = a[near], b[near]
            best = np.full(len(near), 255, np.uint8)
            for i in range(int((hi - lo).max()) + 1):
                w = lo + i <= hi
                best[w] = np.minimum(best[w], self.flat[lo[w] + i])
            out[near] = best
        return out


def build(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, length, common) of all suffixes of data[start:start + length], in sorted order.

    ``common`` is the length of the prefix a suffix shares with the one before it. Strings are of 1 to 254 symbols;
    their ends sort before all symbols, and by string.
    """
    m = len(starts)
    symbols = data.astype(np.int16) + 1
    longest = int(lengths.max()) if m else 0
    if longest > 254:
        raise ValueError("strings of 254 symbols at most")
    bwt = symbols[starts + lengths - 1]
    first = np.zeros(m, np.int16)
    source = np.zeros(m, np.int64)  # rows that start with an end mark have no source
    common = np.zeros(m, np.uint8)
    owner = np.arange(m, dtype=np.int32)
    size = np.zeros(m, np.uint8)
    at, active = np.arange(m), np.arange(m)
    for t in range(1, longest + 1):
        live = lengths[active] >= t
        active, at = active[live], at[live]
        c = bwt[at]
        order = np.lexsort((at, c))
        active, at, c = active[order], at[order], c[order]
        key_old = (first.astype(np.int64) << 40) | source
        key_old[:m] = 0
        key = (c.astype(np.int64) << 40) | at
        place = np.searchsorted(key_old, key)  # old row before which each new row goes
        # common prefixes with the neighbours that the new rows get
        n = len(first)
        rmq = _RangeMin(common)
        prev_new = np.full(len(place), -1)
        same = np.flatnonzero((place[1:] == place[:-1])) + 1
        prev_new[same] = same - 1
        old_before, old_after = place - 1, np.minimum(place, n - 1)
        src = np.where(prev_new >= 0, at[prev_new], source[old_before])
        ok = np.where(prev_new >= 0, c[prev_new] == c, first[old_before] == c)
        up = np.zeros(len(place), np.uint8)
        w = np.flatnonzero(ok)
        up[w] = rmq(src[w] + 1, at[w]) + 1
        last_of_place = np.ones(len(place), bool)
        last_of_place[:-1] = place[1:] != place[:-1]
        follow = last_of_place & (place < n) & (first[old_after] == c)
        down_at = place[last_of_place & (place < n)]
        w = np.flatnonzero(follow)
        fix = np.zeros(n, bool)
        fix[down_at] = True
        common = common.copy()
        common[fix] = 0
        common[place[w]] = rmq(at[w] + 1, source[place[w]]) + 1
        # rewrite the columns with the new rows in place
        target = place + np.arange(len(place))
        is_new = np.zeros(n + len(place), bool)
        is_new[target] = True
        old_at = np.flatnonzero(~is_new)

        def merged(old, new):
            out = np.empty(n + len(place), old.dtype)
            out[old_at] = old
            out[target] = new
            return out

        begin = starts[active] + lengths[active] - t - 1
        before = np.where(lengths[active] > t, symbols[np.maximum(begin, 0)], 0)
        source = merged(old_at[source], old_at[at])
        bwt, first, common = merged(bwt, before), merged(first, c), merged(common, up)
        owner, size = merged(owner, active.astype(np.int32)), merged(size, np.uint8(t))
        at = target
    return owner, size, common
