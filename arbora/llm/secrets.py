"""Secret scans (5): all rules in one byte pass of one deterministic automaton."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C
from .automaton import Automaton


def _any_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_any_case(x) for x in ("password", "passwd", "secret", "token", "api_?key"))
_LEAD = f"({_KEYS})[\"']?\\x20*[:=]\\x20*[\"']?"

#: (kind, expression, least length of the match, expression of a head that does not count for that length).
#: The first three are the base kinds.
RULES: tuple[tuple[str, str, int, str | None], ...] = (
    ("assign", f"{_LEAD}[A-Za-z0-9+/_.=\\-]+", 6, _LEAD),
    ("access", "AKIA[A-Z0-9]+", 20, None),
    ("hex", "[0-9a-f]+", 24, None),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, None),
    ("github", "gh[pousr]_[A-Za-z0-9]+", 40, None),
    ("slack", "xox[abprs]-[A-Za-z0-9\\-]+", 15, None),
    ("google", "AIza[A-Za-z0-9_\\-]+", 39, None),
    ("stripe", "[sr]k_live_[A-Za-z0-9]+", 24, None),
    ("jwt", "eyJ[A-Za-z0-9_\\-]+\\.eyJ[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_\\-]+", 0, None),
)
BASE = 3


class Scanner:
    """Finds the leftmost, longest, non-overlapping matches of each rule; matches that are too short are dropped."""

    def __init__(self, rules=RULES):
        self.rules = rules
        # Short runs of one character class are everywhere, so the scan asks for eight; the exact step does the rest.
        whole = [f"{x[:-1]}{{{min(least, 8)},}}" if x[0] == "[" and x.count("[") == 1 and x.endswith("]+") and not head else x for _, x, least, head in rules]
        self.all = Automaton(whole)
        self.one = [Automaton([x], anchored=True) for _, x, _, _ in rules]
        self.heads = [Automaton([h], anchored=True) if h else None for *_, h in rules]
        first = [a.step[0, a.byte_class] for a in self.one]
        self.first = [f != (a.dead if a.dead is not None else -1) for f, a in zip(first, self.one)]
        self.second = [np.array([[a.step[s, a.byte_class[c]] != a.dead for c in range(256)] for s in range(a.states)]) for a in self.one]

    def runs(self, data: np.ndarray, ends: np.ndarray, least: int = 160) -> tuple[np.ndarray, np.ndarray]:
        """Runs that no match can reach across: cut at texts' ends and behind resetting bytes."""
        reset = self.all.resets[data]
        reset[1:] |= self.all.pair_resets[data[:-1], data[1:]]
        cut = np.flatnonzero(reset) + 1
        if len(cut):  # the first cut in each stretch of ``least`` bytes
            cell = cut // least
            cut = cut[np.concatenate([[True], cell[1:] != cell[:-1]])]
        at = np.unique(np.concatenate([[0], cut, ends, [len(data)]]))
        return at[:-1], np.diff(at)

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text, (start, rule, end) of all matches in code points, in order."""
        raw = [t.encode() for t in texts]
        ends = np.cumsum([len(x) for x in raw])
        joined = b"".join(raw)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not joined:
            return out
        data = np.frombuffer(joined, np.uint8)
        starts, lengths = self.runs(data, ends)
        bits = self.all.scan(data, starts, lengths)
        for i in np.flatnonzero(bits):
            doc = int(np.searchsorted(ends, starts[i], "right"))
            base = int(ends[doc] - len(raw[doc]))
            for r in range(len(self.rules)):
                if bits[i] >> r & 1:
                    out[doc] += [(a - base, r, b - base) for a, b in self._exact(r, joined, int(starts[i]), int(starts[i] + lengths[i]))]
        for found, x in zip(out, raw):
            if found:
                if not x.isascii():
                    cp = np.concatenate([[0], np.cumsum((np.frombuffer(x, np.uint8) & 0xC0) != 0x80)])
                    found[:] = [(int(cp[a]), r, int(cp[b])) for a, r, b in found]
                found.sort()
        return out

    def _exact(self, r: int, joined: bytes, start: int, end: int) -> list[tuple[int, int]]:
        one, head, least = self.one[r], self.heads[r], self.rules[r][2]
        data, out, free = joined[start:end], [], 0
        raw = np.frombuffer(data, np.uint8)
        can = self.first[r][raw]
        if one.states > 3:
            can[:-1] &= self.second[r][one.step[0, one.byte_class[raw[:-1]]], raw[1:]]
        for i in np.flatnonzero(can).tolist():
            if i < free:
                continue
            e = one.longest(data, i)
            if e > i:
                free = e
                size = e - (head.longest(data, i) if head else i)
                if size >= least:
                    out.append((start + i, start + e))
        return out


@lru_cache(maxsize=4)
def scanner(rules=RULES) -> Scanner:
    return Scanner(rules)


def _listed(found, rules) -> str:
    return ",".join(f"{rules[r][0]}:{a}:{b}" for a, r, b in found)


_OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, a digest of the base spans, and all spans as kind:start:end.

    Null texts are empty; empty texts have no spans. Rows are independent, so repeated rows and null ids stay,
    and no row moves between tasks. Extra columns are left out.
    """

    s = scanner(rules)  # built once on the driver; the arrays go out with the function

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "text", 1 << 20):
            rows = s.spans([t or "" for t in b["text"].to_pylist()])
            count = [[sum(x[1] == k for x in found) for found in rows] for k in range(BASE)]
            digest = [hashlib.sha256(_listed([x for x in found if x[1] < BASE], rules).encode()).hexdigest() for found in rows]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, pa.int64()) for c in count), pa.array(digest, pa.string()), pa.array([_listed(found, rules) for found in rows], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return C.keyed(df, id_col, text_col).mapInArrow(run, _OUT)


def redact(df: DataFrame, *, text_col: str = "text", rules=RULES) -> DataFrame:
    """Replaces each span by ``<KIND>`` (overlapping spans: the first one's), all columns kept; n_chars follows.

    Null and empty texts stay as they are, as do texts without a span; rows are independent, so repeated rows stay.
    """
    schema = df.schema

    s = scanner(rules)  # built once on the driver; the arrays go out with the function

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, text_col, 1 << 20):
            texts = b[text_col].to_pylist()
            changed = {}
            for i, found in enumerate(s.spans([t or "" for t in texts])):
                if found:
                    t, parts, at = texts[i], [], 0
                    for a, r, e in found:
                        if a >= at:
                            parts += [t[at:a], f"<{rules[r][0].upper()}>"]
                        at = max(at, e)
                    changed[i] = "".join(parts) + t[at:]
            if changed:
                for i, t in changed.items():
                    texts[i] = t
                k = b.schema.get_field_index(text_col)
                b = b.set_column(k, b.schema.field(k), pa.array(texts, b.schema.field(k).type))
                if (k := b.schema.get_field_index("n_chars")) >= 0:
                    n = b["n_chars"].to_pylist()
                    for i, t in changed.items():
                        n[i] = len(t)
                    b = b.set_column(k, b.schema.field(k), pa.array(n, b.schema.field(k).type))
            yield b

    return df.mapInArrow(run, schema)


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    """Secret spans of all documents."""
    return scan(C.documents(spark, sf_dir))
