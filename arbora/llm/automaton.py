"""Regular expressions as one deterministic byte automaton: parser, subset construction, minimisation.

Supported syntax: literals, ``\\xNN`` and escaped characters, classes with ranges, groups, ``|``, ``?``, ``*``,
``+``, ``{m}``, ``{m,}`` and ``{m,n}``. Expressions are over bytes (ASCII).
"""

from __future__ import annotations

import numpy as np


class _Parser:
    """Recursive descent to a Thompson automaton kept in flat lists."""

    def __init__(self):
        self.eps: list[list[int]] = []
        self.arc: list[tuple[np.ndarray, int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.arc.append(None)
        return len(self.eps) - 1

    def add(self, pattern: str) -> tuple[int, int]:
        self.p, self.i = pattern, 0
        out = self._either()
        if self.i < len(pattern):
            raise ValueError(f"unexpected {pattern[self.i]!r} at {self.i} of {pattern!r}")
        return out

    def _peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def _either(self) -> tuple[int, int]:
        first, last = self._sequence()
        while self._peek() == "|":
            self.i += 1
            a, b = self._sequence()
            s, e = self.state(), self.state()
            self.eps[s] += [first, a]
            self.eps[last].append(e)
            self.eps[b].append(e)
            first, last = s, e
        return first, last

    def _sequence(self) -> tuple[int, int]:
        first = last = self.state()
        while self._peek() not in ("", "|", ")"):
            begin = self.i
            a, b = self._atom()
            low, high = self._count()
            end = self.i
            parts = [(a, b)]
            for _ in range(max(low, high or 0, 1) - 1 + (high is None)):
                self.i = begin
                parts.append(self._atom())
            self.i = end
            for n, (x, y) in enumerate(parts):
                self.eps[last].append(x)
                e = self.state()
                self.eps[y].append(e)
                if n >= low:
                    self.eps[last].append(e)
                if high is None and n == len(parts) - 1:
                    self.eps[e].append(x)
                last = e
        return first, last

    def _count(self) -> tuple[int, int | None]:
        c = self._peek()
        if c in ("?", "*", "+"):
            self.i += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        if c == "{":
            end = self.p.index("}", self.i)
            low, comma, high = self.p[self.i + 1 : end].partition(",")
            self.i = end + 1
            return int(low), (int(high) if high else None) if comma else int(low)
        return 1, 1

    def _char(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.p[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def _atom(self) -> tuple[int, int]:
        if self._peek() == "(":
            self.i += 1
            out = self._either()
            if self._peek() != ")":
                raise ValueError(f"no ) in {self.p!r}")
            self.i += 1
            return out
        allowed = np.zeros(256, bool)
        if self._peek() == "[":
            self.i += 1
            negate = self._peek() == "^"
            self.i += negate
            while self._peek() != "]":
                low = high = self._char()
                if self._peek() == "-" and self.p[self.i + 1] != "]":
                    self.i += 1
                    high = self._char()
                allowed[low : high + 1] = True
            self.i += 1
            allowed ^= negate
        else:
            allowed[self._char()] = True
        a, b = self.state(), self.state()
        self.arc[a] = (allowed, b)
        return a, b


class Automaton:
    """Transition arrays of the minimal automaton of several expressions.

    ``next[state * classes + byte_class[byte]]`` is the next state times ``classes``; ``accepts[state]`` has bit r
    for each expression r that a match of ends here. State 0 is the start. Unanchored automata start a match at
    every byte; anchored ones have a ``dead`` state without a way out (or None).
    """

    def __init__(self, patterns: list[str], anchored: bool = False):
        p = _Parser()
        start, ends = p.state(), []
        for x in patterns:
            a, b = p.add(x)
            p.eps[start].append(a)
            ends.append(b)
        sets = np.array([x[0] for x in p.arc if x is not None])
        _, self.byte_class = np.unique(sets, axis=1, return_inverse=True)
        self.byte_class = self.byte_class.reshape(-1).astype(np.uint8)
        k = int(self.byte_class.max()) + 1
        sample = [int(np.flatnonzero(self.byte_class == c)[0]) for c in range(k)]
        closure: dict[int, frozenset] = {}

        def close(states) -> frozenset:
            out, todo = set(states), list(states)
            while todo:
                for t in p.eps[todo.pop()]:
                    if t not in out:
                        out.add(t)
                        todo.append(t)
            return frozenset(t for t in out if p.arc[t] is not None or t in final)

        final = {e: r for r, e in enumerate(ends)}
        first = close([start])
        number, order, rows = {first: 0}, [first], []
        for s in order:
            row = []
            for b in sample:
                to = set() if anchored else set(first)
                for t in s:
                    if p.arc[t] is not None and p.arc[t][0][b]:
                        if (c := closure.get(p.arc[t][1])) is None:
                            c = closure[p.arc[t][1]] = close([p.arc[t][1]])
                        to |= c
                to = frozenset(to)
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                row.append(number[to])
            rows.append(row)
        step = np.array(rows)
        accepts = np.array([sum(1 << final[t] for t in s if t in final) for s in order], np.int64)
        step, accepts = _minimal(step, accepts)
        self.classes, self.states, self.accepts = k, len(step), accepts
        self.step = step.astype(np.int32)
        self.next = (step * k).astype(np.int32).ravel()
        dead = [s for s in range(len(step)) if not accepts[s] and (step[s] == s).all()]
        self.dead = dead[0] if anchored and dead else None
        #: Bytes after which the automaton is at its start whatever came before: texts can be cut behind them.
        self.resets = (step == 0).all(axis=0)[self.byte_class]
        two = np.array([(step[step[:, c]] == 0).all(axis=0) for c in range(k)])
        #: Pairs of bytes after which it is there, such as a letter that ends no key and a blank.
        self.pair_resets = two[self.byte_class][:, self.byte_class]

    def longest(self, data: bytes, at: int) -> int:
        """End of the longest match from ``at`` (anchored automata), or -1."""
        state, end, cls, step, acc = 0, -1, self.byte_class, self.step, self.accepts
        for i in range(at, len(data)):
            state = step[state, cls[data[i]]]
            if state == self.dead:
                break
            if acc[state]:
                end = i + 1
        return end

    def scan(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Bits of the expressions that match within each of the runs [start, start + length) of ``data``.

        All runs advance together by a byte a step, in groups of similar length.
        """
        out = np.zeros(len(starts), np.int64)
        cls, nxt, k = self.byte_class[data].astype(np.int32), self.next, self.classes
        hits = self.accepts != 0
        any_hit = np.zeros(self.states * k, bool)
        any_hit[np.flatnonzero(hits) * k] = True
        order = np.argsort(-lengths, kind="stable")
        at = 0
        while at < len(order):
            longest = int(lengths[order[at]])
            if not longest:
                break
            end = int(np.searchsorted(-lengths[order], -(longest // 2), "left"))
            end = max(at + 1, min(end, at + max(1, (4 << 20) // longest)))
            lane = order[at:end]
            s, n = starts[lane], lengths[lane]
            state = np.zeros(len(lane), np.int32)
            live = len(lane)
            counts = len(lane) - np.searchsorted(n[::-1], np.arange(longest), "right")  # lanes longer than i
            for i in range(longest):
                live = counts[i]
                now = nxt[state[:live] + cls[s[:live] + i]]
                state[:live] = now
                h = any_hit[now]
                if h.any():
                    w = np.flatnonzero(h)
                    out[lane[w]] |= self.accepts[now[w] // k]
            at = end
        return out


def _minimal(step: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Moore's refinement; the start stays state 0."""
    _, block = np.unique(accepts, return_inverse=True)
    n = block.max() + 1
    while True:
        key = np.column_stack([block, block[step]])
        _, first, new = np.unique(key, axis=0, return_index=True, return_inverse=True)
        new = new.reshape(-1)
        if len(first) == n:
            break
        block, n = new, len(first)
    rank = np.argsort(np.argsort(np.where(first == 0, -1, first)))
    block, first = rank[new], first[np.argsort(rank)]
    return block[step[first]], accepts[first]
