"""Packing (10): documents into windows of tokens by lexical retrieval.

Each shard (a bounded run of documents within a task) gets a BM25 inverted index over token ids. A seed document
opens a window; all its unused neighbours by BM25 score over all its terms fill the rest, best first, those that fit
whole first; what is still free takes the start of the best neighbour, whose rest opens the next window. The next seed
is only taken when no neighbour is left. So every window but a task's last is full;
the last is cut into windows whose sizes are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common as C

#: Ranked neighbours that are looked at together.
RUN = 256


class Bm25:
    """Inverted index of one shard; a query is all terms of a document."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, k1: float = 1.2, b: float = 0.75):
        n = len(sizes)
        width = int(ids.max()) + 1 if len(ids) else 1
        key, tf = np.unique(np.repeat(np.arange(n), sizes) * width + ids, return_counts=True)
        doc, term = key // width, key % width
        df = np.bincount(term, minlength=width)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[doc] / max(sizes.mean(), 1)))
        shared = df[term] > 1
        doc, term, weight = doc[shared], term[shared], weight[shared]
        self.query, self.own = term, np.searchsorted(doc, np.arange(n + 1))
        order = np.argsort(term, kind="stable")
        self.n, self.width, self.left = n, width, n
        self._post(doc[order], term[order], weight[order])

    def _post(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        self.doc, self.term, self.weight = doc, term, weight
        self.df = np.bincount(term, minlength=self.width)
        self.at = np.concatenate([[0], self.df.cumsum()])

    def neighbours(self, doc: int, used: np.ndarray) -> np.ndarray:
        """All unused documents that share terms with ``doc``, best first."""
        left = self.n - np.count_nonzero(used)
        if left * 4 < self.left * 3:  # entries of used documents go, a quarter of the documents at a time
            self.left, keep = left, ~used[self.doc]
            self._post(self.doc[keep], self.term[keep], self.weight[keep])
        t = self.query[self.own[doc] : self.own[doc + 1]]
        at = C.ragged(self.at[t], self.df[t])
        if not len(at):
            return at
        score = np.bincount(self.doc[at], self.weight[at], self.n)
        score[used] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


class Packer:
    """Takes shards of tokenised documents, gives pieces; holds the pieces of the open window only."""

    def __init__(self, size: int, first_id: int):
        self.size, self.next = size, first_id
        self.open: list[tuple] = []
        self.room = size
        self.out: list[tuple] = []

    def _put(self, doc_id, ids: np.ndarray, start: int) -> int:
        """Places what fits of ids[start:]; returns the new start."""
        end = min(len(ids), start + self.room)
        self.open.append((doc_id, start, ids[start:end], len(ids)))
        self.room -= end - start
        if not self.room:
            self._close(self.open)
            self.open, self.room = [], self.size
        return end

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            self.out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc_ids: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(sizes)
        ends = sizes.cumsum()
        of = [ids[e - s : e] for e, s in zip(ends.tolist(), sizes.tolist())]
        index = Bm25(np.delete(ids, ends - 1), sizes - 1)  # the end id that all documents share is no term
        used, length = np.zeros(n, bool), sizes.tolist()
        at, seed, start = 0, None, 0
        while True:
            if seed is None:
                while at < n and used[at]:
                    at += 1
                if at == n:
                    break
                seed, start = at, 0
                used[seed] = True
            while start < length[seed]:  # the window fills up, or all of the seed is placed
                start = self._put(doc_ids[seed], of[seed], start)
            near, seed = seed, None
            if self.room == self.size:
                continue
            rest = self._fill(doc_ids, of, sizes, used, index.neighbours(near, used))
            if rest is not None:
                used[rest] = True
                seed, start = rest, 0
        # what is open goes on with the next shard, without holding on to this one's ids
        self.open = [(d, s, x.copy(), t) for d, s, x, t in self.open]

    def _fill(self, doc_ids: list, of: list, sizes: np.ndarray, used: np.ndarray, near: np.ndarray) -> int | None:
        """Places all of ``near`` that fit whole, best first, until the window is full; the best one that did not fit, if room is left."""
        rest = None
        for i in range(0, len(near), RUN):
            part = near[i : i + RUN]
            if rest is not None:  # room only shrinks
                part = part[sizes[part] <= self.room]
            for x in part.tolist():
                if len(of[x]) <= self.room:
                    used[x] = True
                    self._put(doc_ids[x], of[x], 0)
                    if self.room == self.size:
                        return None
                elif rest is None:
                    rest = x
        return rest

    def finish(self) -> None:
        """Cuts the open window into sizes that are powers of two."""
        pieces, left = self.open, self.size - self.room
        self.open, self.room = [], self.size
        while left:
            want = 1 << (left.bit_length() - 1)
            left -= want
            part = []
            while want:
                d, s, x, t = pieces.pop(0)
                part.append((d, s, x[:want], t))
                if len(x) > want:
                    pieces.insert(0, (d, s + want, x[want:], t))
                want -= len(part[-1][2])
            self._close(part)


_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, size: int = 2048, shard_bytes: int = 4 << 20) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null texts are empty documents of one token (the end id). Rows are packed as they come: repeated rows and null ids
    are documents of their own. Extra columns are left out. Sequence ids hold the task's number, so tasks need nothing
    of each other; a task that runs again gives the same pieces. No row is shuffled.
    """
    path = tokenizer or C.tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = C.ChunkEncoder(path), Packer(size, TaskContext.get().partitionId() << 32)
        for b in C.slices(batches, "text", shard_bytes):
            flat, n = enc.ids([t or "" for t in b["text"].to_pylist()])
            packer.add(b["doc_id"].to_pylist(), np.insert(flat, n.cumsum(), end_id).astype(np.uint32), n + 1)
            if packer.out:
                yield _rows(packer)
        packer.finish()
        if packer.out:
            yield _rows(packer)

    return C.keyed(df, id_col, text_col).mapInArrow(run, _OUT)


def _rows(packer: Packer) -> pa.RecordBatch:
    cols, packer.out = list(zip(*packer.out)), []
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in _OUT.split(", ")])


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 tokens."""
    return pack(C.documents(spark, sf_dir))
