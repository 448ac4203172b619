"""Benchmark decontamination (3): SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

For every benchmark item, a document's windows of as many words as the item has are fingerprinted (64-bit SimHash over
``k``-word shingles, weighted by how often each occurs). Fingerprints are cut into blocks; a fingerprint within
``radius`` of an item's differs by at most radius // blocks bits in one block, so looking up every block's neighbourhood
misses none. Candidates are verified by their exact weighted Jaccard similarity (sum of minima / sum of maxima of the
shingles' weights). Windows without any shingle of the item have similarity 0 and are not fingerprinted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BLOCKS, BITS = 8, 8
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_CLEAN = bytes.maketrans(_MARKS, b" " * len(_MARKS))
_NEAR = np.array([bin(x).count("1") for x in range(256)])


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII marks are white space."""
    return text.lower().encode().translate(_CLEAN).split() if text else []


def _signs(h: np.ndarray) -> np.ndarray:
    """(n, 64) of +1 and -1: the bits of hashes."""
    return (np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) << 1) - 1


def simhash(sums: np.ndarray) -> np.ndarray:
    """(n, 64) of weighted sums -> fingerprints."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


class Items:
    """The items of one block: shingles, fingerprints by size, and their block index."""

    def __init__(self, rows: list[tuple[int, str]], k: int, radius: int, percent: int):
        self.k, self.radius, self.percent, self.hashes = k, radius, percent, C.WordHashes()
        self.ids, self.sets, sizes = [], [], []
        for i, text in rows:
            w = words_of(text)
            if w:
                self.ids.append(i)
                self.sets.append(np.sort(self.shingles(self.hashes.of(w), len(w))))
                sizes.append(len(w))
        self.sizes = np.array(sizes, np.int64)
        #: Items of fewer than k words are one shingle of their own length.
        self.short = sorted({s for s in sizes if s < k})
        flat = np.concatenate(self.sets) if self.sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets])
        order = np.lexsort((owner, flat))
        self.shingle, self.owner = flat[order], owner[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(flat & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.print = simhash(np.array([_signs(s).sum(axis=0) for s in self.sets]).reshape(-1, 64))
        # for each block: the items in order of its value, and where each value starts
        own = self.print.view(np.uint8).reshape(-1, BLOCKS)
        #: For a value of a block, the values within the block's share of the radius.
        self.flips = np.flatnonzero(_NEAR <= radius // BLOCKS).astype(np.uint8)
        self.block = {}
        for size in np.unique(self.sizes).tolist():
            which = np.flatnonzero(self.sizes == size)
            order = [which[np.argsort(own[which, b], kind="stable")] for b in range(BLOCKS)]
            self.block[size] = [(o, np.searchsorted(own[o, b], np.arange(257))) for b, o in enumerate(order)]

    def shingles(self, h: np.ndarray, size: int) -> np.ndarray:
        k = min(self.k, size)
        return C.shingle_hashes(h, k) if k == self.k else C.mix64(C.shingle_hashes(h, k) + np.uint64(k))

    def _anchors(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, item) of each shingle of the text that an item has."""
        at = np.flatnonzero(self.maybe[(s & np.uint64((1 << 20) - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(self.shingle, s[at], "left"), np.searchsorted(self.shingle, s[at], "right")
        n = hi - lo
        return np.repeat(at, n), self.owner[C.ragged(lo, n)]

    def find(self, text: str | None) -> list[tuple[int, float, int]]:
        """(item id, similarity, first word) of the best window for each item that the text holds."""
        words = words_of(text)
        h, best = self.hashes.of(words), {}
        for k in [*self.short, self.k]:
            if len(words) < k:
                continue
            s = self.shingles(h, k)
            at, item = self._anchors(s)
            for size in np.unique(self.sizes[item]).tolist() if len(at) else ():
                if (size < self.k) != (k < self.k) or size < self.k and size != k:
                    continue
                n = size - k + 1
                # a text that is shorter than the item is one window
                starts = self._windows(at[self.sizes[item] == size], n, len(s))
                self._match(s, starts, min(n, len(s)), size, best)
        return [(self.ids[i], v, p) for i, (v, p) in sorted(best.items())]

    @staticmethod
    def _windows(at: np.ndarray, n: int, total: int) -> np.ndarray:
        """Starts of the windows of n shingles that hold a shingle at one of the positions."""
        n = min(n, total)
        mark = np.zeros(total + 1, np.int64)
        np.add.at(mark, np.clip(at - n + 1, 0, total - n), 1)
        np.add.at(mark, np.clip(at, 0, total - n) + 1, -1)
        return np.flatnonzero(mark.cumsum()[:-1] > 0)

    def _match(self, s, starts, n, size, best) -> None:
        index = self.block[size]
        step = max(1, min(4096, (1 << 20) // max(1, len(index[0][0]))))  # at most so many windows, and a million candidates a block
        for group in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            if not len(group):
                continue
            for i in range(0, len(group), step):  # bounded memory on very long texts
                part = group[i : i + step]
                a, b = int(part[0]), int(part[-1]) + n
                sums = np.concatenate([np.zeros((1, 64), np.int32), _signs(s[a:b]).cumsum(axis=0)])
                prints = simhash(sums[part - a + n] - sums[part - a])
                blocks = prints.view(np.uint8).reshape(-1, BLOCKS)
                found = [np.empty(0, np.int64)]
                for x, (order, at) in enumerate(index):
                    value = blocks[:, x, None] ^ self.flips
                    w, v = np.nonzero(at[value.astype(np.int64) + 1] > at[value])
                    lo = at[value[w, v]]
                    n_ = at[value[w, v].astype(np.int64) + 1] - lo
                    w, c = np.repeat(w, n_), order[C.ragged(lo, n_)]
                    close = np.bitwise_count(prints[w] ^ self.print[c]) <= self.radius
                    found.append(w[close] * len(self.sets) + c[close])
                for p, item in zip(*(x.tolist() for x in np.divmod(np.unique(np.concatenate(found)), len(self.sets)))):
                    p = int(part[p])
                    v = weighted_jaccard(np.sort(s[p : p + n]), self.sets[item])
                    if 100 * v >= self.percent and v > best.get(item, (-1.0, 0))[0]:
                        best[item] = (v, p)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of minima over sum of maxima of two sorted bags' weights (numbers of occurrences)."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    low = int(np.minimum(n[i], m[j]).sum())
    return low / (len(a) + len(b) - low) if len(a) + len(b) else 0.0


_OUT = "doc_id long, item_id long, similarity double, first_word long"


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, most_bytes: int):
    """Blocks of items of about ``most_bytes`` of text, each small enough to send to every task."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // most_bytes))
    for i in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == i)
        yield [(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()]


def matches(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", k: int = 5, percent: int = 80, radius: int = 23, most_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, item_id, similarity, first_word): the items that each row's text holds, with their best window.

    Null or wordless texts and items hold and match nothing; items with null ids are left out; repeated rows give
    repeated results, an empty table on either side gives none; extra columns are left out. Of equally similar windows
    the first one counts. Items go out in blocks of ``most_bytes``, each its own pass.
    """
    docs, out = C.keyed(df, id_col, text_col), None
    for rows in _blocks(benchmark, item_id_col, item_text_col, most_bytes):
        got = docs.mapInArrow(_finder(Items(rows, k, radius, percent)), _OUT)
        out = got if out is None else out.union(got)
    return out


def _finder(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "text"):
            rows = [(d, *x) for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()) for x in items.find(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["doc_id", "item_id", "similarity", "first_word"])

    return run


def clean(df: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", k: int = 5, percent: int = 80, radius: int = 23, most_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``df``, all columns, that hold no item."""
    for rows in _blocks(benchmark, item_id_col, item_text_col, most_bytes):
        df = df.mapInArrow(_filter(Items(rows, k, radius, percent), text_col), df.schema)
    return df


def _filter(items: Items, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, text_col):
            yield b.filter(pa.array([not items.find(t) for t in b[text_col].to_pylist()], pa.bool_()))

    return run


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents."""
    return matches(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
