"""Token counts (12): heap-and-linked-list byte-pair merging that counts and emits no identifiers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

#: Letters, numbers and white space of Latin-1 as the byte-level split sees them.
_L = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t-\r \x85\xa0"
#: Fixed value: the split of byte-level BPE, written out for Latin-1 text.
_SPLIT = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Pieces of texts above this length are counted one after another, not as a list.
LONG_TEXT = 1 << 20


class Merges:
    """The merge table: left symbol -> right symbol -> rank, and rank -> symbol of the whole. Symbols 0 to 255 are the bytes."""

    def __init__(self, merges: list):
        number = {c: b for b, c in C._byte_letters().items()}
        rank_of: dict[int, dict[int, int]] = {}
        self.whole: list[int] = []
        for rank, m in enumerate(merges):
            left, right = m.split(" ") if isinstance(m, str) else m
            rank_of.setdefault(number[left], {}).setdefault(number[right], rank)
            self.whole.append(number.setdefault(left + right, len(number)))
        self.rank = [rank_of.get(i, {}) for i in range(len(number))]

    def count(self, word: bytes) -> int:
        """Symbols left of ``word``: its bytes minus the merges made.

        Adjacent pairs lie in a heap by (rank, place), one whole number each; the neighbours of each symbol form a
        linked list. The pair of lowest rank, leftmost of equals, is merged; entries whose pair has changed since are
        passed over. A word of n bytes takes O(n log n).
        """
        n, rank = len(word), self.rank
        if n < 2:
            return n
        heap = [rank[a][b] * n + i for i, (a, b) in enumerate(zip(word, word[1:])) if b in rank[a]]
        if not heap:
            return n
        heapify(heap)
        symbol, after, before = [*word, -1], list(range(1, n + 1)), list(range(-1, n - 1))
        left, whole = n, self.whole
        while heap:
            r, i = divmod(heappop(heap), n)
            a, j = symbol[i], after[i]
            if a < 0 or j == n or rank[a].get(symbol[j]) != r:
                continue
            left -= 1
            symbol[j] = -1
            symbol[i] = s = whole[r]
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                x = rank[s].get(symbol[k])
                if x is not None:
                    heappush(heap, x * n + i)
            h = before[i]
            if h >= 0:
                x = rank[symbol[h]].get(s)
                if x is not None:
                    heappush(heap, x * n + h)
        return left


class _Known(dict):
    """piece -> its number of tokens; holds a bounded number of short pieces."""

    def __init__(self, count, limit: int):
        super().__init__()
        self.count, self.limit = count, limit

    def __missing__(self, piece: str) -> int:
        n = self.count(piece)
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = n
        return n


class Counter:
    """Number of tokens of whole texts under a byte-level BPE file, special strings in texts counted as one token each.

    Latin-1 texts are cut by the split written out above, other texts by the library's own split of the file; both
    are then merged here. A file of another kind (normaliser, prefix space, dropout, stripping or normalised special
    tokens) raises ``ValueError``.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        split, model, marks = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens", [])
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
        plain &= model.get("type", "BPE") == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        plain &= not any(m.get(x) for m in marks for x in ("single_word", "lstrip", "rstrip", "normalized"))
        if not plain:
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        self.library = Tokenizer.from_file(path).pre_tokenizer
        merges = Merges(model["merges"])
        of = {c: b for b, c in C._byte_letters().items()}
        self.latin = _Known(lambda piece: merges.count(piece.encode()), limit)
        self.other = _Known(lambda piece: merges.count(bytes(map(of.__getitem__, piece))), limit)
        found = sorted((m["content"] for m in marks if m["content"]), key=len, reverse=True)
        self.marks = re.compile("|".join(map(re.escape, found))) if found else None

    def _part(self, text: str) -> int:
        try:
            if not text.isascii():
                text.encode("latin-1")
        except UnicodeError:
            return sum(self.other[piece] for piece, _ in self.library.pre_tokenize_str(text))
        if len(text) <= LONG_TEXT:
            return sum(map(self.latin.__getitem__, _SPLIT.findall(text)))
        return sum(self.latin[m.group()] for m in _SPLIT.finditer(text))

    def tokens(self, text: str) -> int:
        if self.marks is None:
            return self._part(text)
        n = at = 0
        for m in self.marks.finditer(text):
            n += self._part(text[at : m.start()]) + 1
            at = m.end()
        return n + self._part(text[at:] if at else text)


@lru_cache(2)
def counter(path: str) -> Counter:
    """One counter a worker and file; what it has learnt serves the worker's later tasks."""
    return Counter(path)


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``; no shuffle, one pass.

    Whole texts count. A null or empty text has no bytes and no tokens; null and repeated ids stay, a row each; an
    empty table gives none; other columns are left behind. Memory: one slice of texts and the counts of a bounded
    number of distinct pieces. ``tokenizer``: the file's path, which must be there on all executors.
    """
    path = tokenizer or C.tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path).tokens
        for b in C.slices(batches, "text"):
            size, n = [], []
            for t in b["text"].to_pylist():
                size.append(len(t.encode()) if t else 0)
                n.append(tokens(t) if t else 0)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return C.keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(C.documents(spark, sf_dir))
