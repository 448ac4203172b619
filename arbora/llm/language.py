"""Language identification (7): unigram pieces of a fixed public vocabulary, summed over all segmentations.

Each language has a probability for each piece of the vocabulary. A word's probability is the sum over all ways to
cut it into pieces (a forward algorithm), a text's the product over its words, and the prediction the language with
the highest posterior. Piece probabilities are learnt by expectation maximisation over all segmentations.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: A word begins with this mark, as in the vocabulary file.
MARK = "▁"
_WORD = re.compile(r"[^\W\d_]+")
#: Longer words are scored with scaled probabilities, as plain ones would leave the range of doubles.
RUN = 40
#: Positions of words (their longest length times their number) that are scored together.
CELLS = 800_000


def vocabulary(path: str | None = None, longest: int | None = None) -> list[str]:
    """Pieces of a sentencepiece file that consist of letters and the mark, up to ``longest`` characters if given."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or C.tokenizer_path("piece_bpe_32k.model"))
    pieces = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))}
    return sorted(p for p in pieces if p and (longest is None or len(p) <= longest) and all(c.isalpha() or c == MARK for c in p) and MARK not in p[1:])


def words_of(text: str) -> list[str]:
    """Runs of letters (``str.isalpha``), lower-cased."""
    found = _WORD.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return ["".join(g) for w in found for letters, g in groupby(w, str.isalpha) if letters]  # superscripts, fractions


def batches_of(words: list[str]) -> Iterator[np.ndarray]:
    """Places of words of like length, so that no batch has more than about ``CELLS`` positions (one word at least)."""
    size = np.array([len(w) + 1 for w in words])
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        ends = size[order[at : at + 20_000]]
        n = max(1, int(np.searchsorted(ends * np.arange(1, len(ends) + 1), CELLS, "right")))
        n = min(n, max(1, int(np.searchsorted(ends, RUN + 1, "right")))) if ends[0] <= RUN + 1 else n
        yield order[at : at + n]
        at += n


_P = np.uint64(0x100000001B3)


class Pieces:
    """Looks up all substrings of many words at once, through hashes of their code points."""

    def __init__(self, pieces: list[str], longest: int | None = None):
        self.pieces, self.longest = pieces, longest or max(map(len, pieces), default=1)
        keys = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.number = keys[order], order
        bits = 22
        self.maybe = np.zeros(1 << bits, bool)
        self.mask = np.uint64((1 << bits) - 1)
        self.maybe[(keys & self.mask).astype(np.int64)] = True

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_P) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return int(C.mix64(np.array([h], np.uint64))[0])

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """(word, start, end, piece) of every piece in the marked words, ordered by end, and the longest word.

        A character without a piece of its own gets piece number len(pieces): the unknown character.
        """
        size = np.array([len(w) + 1 for w in words])
        begin = size.cumsum() - size
        code = np.frombuffer((MARK + MARK.join(words)).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        word = np.repeat(np.arange(len(words)), size)
        place = np.arange(len(code)) - begin[word]
        left = size[word] - place
        h = np.zeros(len(code), np.uint64)
        out = []
        for m in range(1, self.longest + 1):
            ok = np.flatnonzero(left >= m)
            if not len(ok):
                break
            h[ok] = h[ok] * _P + code[ok + m - 1]
            full = C.mix64(h[ok])
            near = self.maybe[(full & self.mask).astype(np.int64)]
            at, full = ok[near], full[near]
            i = np.minimum(np.searchsorted(self.keys, full), len(self.keys) - 1)
            hit = self.keys[i] == full
            piece = self.number[i[hit]]
            at = at[hit]
            if m == 1:
                lone = np.ones(len(code), bool)
                lone[at] = False
                lone = np.flatnonzero(lone)
                at, piece = np.concatenate([at, lone]), np.concatenate([piece, np.full(len(lone), len(self.pieces))])
            out.append((word[at], place[at], place[at] + m, piece))
        w, s, e, p = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(e, kind="stable")
        return w[order], s[order], e[order], p[order], int(size.max())


def forward(edges, n_words: int, prob: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray | None]:
    """alpha[word, position, language]: probability of the first ``position`` characters, over all segmentations.

    With words over ``RUN`` letters, alpha is to be multiplied by the exponential of the second table.
    """
    w, s, e, p, longest = edges
    alpha = np.zeros((n_words, longest + 1, prob.shape[1]))
    alpha[:, 0] = 1
    log = np.zeros_like(alpha) if longest > RUN + 1 else None
    cut = np.searchsorted(e, np.arange(1, longest + 2))
    for j in range(1, longest + 1):
        a, b = cut[j - 1], cut[j]
        if a < b:
            np.add.at(alpha, (w[a:b], j), alpha[w[a:b], s[a:b]] * prob[p[a:b]])
        if log is not None:
            _scale(alpha, log, j, max(0, j - reach + 1), j + 1, 1)
    return alpha, log


def backward(edges, n_words: int, ends: np.ndarray, prob: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray | None]:
    w, s, e, p, longest = edges
    beta = np.zeros((n_words, longest + 1, prob.shape[1]))
    beta[np.arange(n_words), ends] = 1
    log = np.zeros_like(beta) if longest > RUN + 1 else None
    order = np.argsort(-s, kind="stable")
    w, s, e, p = w[order], s[order], e[order], p[order]
    cut = np.searchsorted(-s, -np.arange(longest, -2, -1), "left")
    for j, (a, b) in zip(range(longest, -1, -1), zip(cut, cut[1:])):
        if a < b:
            np.add.at(beta, (w[a:b], j), beta[w[a:b], e[a:b]] * prob[p[a:b]])
        if log is not None:
            _scale(beta, log, j, j, j + reach, -1)
    return beta, log


def _scale(table: np.ndarray, log: np.ndarray, j: int, first: int, end: int, step: int) -> None:
    """Every eighth position: what later positions reach back to is divided by its largest value, word by word.

    The next position, still empty, takes over the logarithm, and so on.
    """
    ahead = j + step
    if j % 8 == 0:
        top = table[:, first:end].max(axis=1, keepdims=True)
        top[top == 0] = 1  # nothing there: past the word's end
        table[:, first:end] /= top
        log[:, first:end] += np.log(top)
    if 0 <= ahead < table.shape[1]:
        log[:, ahead] = log[:, j]


@dataclass
class Model:
    langs: list[str]
    pieces: list[str]
    prob: np.ndarray
    prior: np.ndarray
    longest: int

    def scorer(self):
        return _Scorer(self)


class _Scorer(dict):
    """word -> row of log-probabilities by language; remembers words up to a bound."""

    def __init__(self, model: Model, limit: int = 300_000):
        super().__init__()
        self.m, self.look, self.limit = model, Pieces(model.pieces, model.longest), limit
        self._clear()

    def _clear(self):
        self.clear()
        self.new, self.rows = [], [np.zeros((0, len(self.m.langs)))]

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def _learn(self):
        rows = np.zeros((len(self.new), len(self.m.langs)))
        for at in batches_of(self.new):
            part = [self.new[i] for i in at]
            alpha, log = forward(self.look.edges(part), len(part), self.m.prob, self.look.longest)
            ends = np.array([len(w) + 1 for w in part])
            rows[at] = np.log(np.maximum(alpha[np.arange(len(part)), ends], 1e-300)) + (0 if log is None else log[np.arange(len(part)), ends])
        self.rows.append(rows)
        self.new = []
        if len(self.rows) > 1:
            self.rows = [np.concatenate(self.rows)]

    def texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(predicted languages, posteriors); ``und`` and 0 where a text has no letter or nothing was learnt."""
        if len(self) > self.limit:
            self._clear()
        which, size = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            found = words_of(t) if t else []
            which.append(np.fromiter(map(self.__getitem__, found), np.int64, len(found)))
            size[i] = len(found)
        self._learn()
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        some = np.flatnonzero(size)
        if not len(some) or not self.m.langs:
            return lang, score
        rows = self.rows[0][np.concatenate(which)]
        begin = (size.cumsum() - size)[some]
        total = np.add.reduceat(rows, begin, axis=0) + np.log(self.m.prior)
        best = total.argmax(axis=1)
        post = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        for i, b in zip(some.tolist(), best.tolist()):
            lang[i] = self.m.langs[b]
        score[some] = post
        return lang, score


def fit(texts: dict[str, list[str]], pieces: list[str], *, rounds: int = 3, smooth: float = 0.05, longest: int | None = None) -> Model:
    """``learn`` from texts at hand."""
    return learn({x: Counter(w for t in own for w in words_of(t)) for x, own in texts.items()}, {x: len(own) for x, own in texts.items()}, pieces, rounds=rounds, smooth=smooth, longest=longest)


def learn(counts: dict[str, dict[str, int]], sizes: dict[str, int], pieces: list[str], *, rounds: int = 3, smooth: float = 0.05, longest: int | None = None) -> Model:
    """Expectation maximisation over all segmentations of each language's words; ``sizes``: documents a language."""
    langs, longest = sorted(sizes), longest or max(map(len, pieces), default=1)
    if not langs:
        return Model([], pieces, np.zeros((len(pieces) + 1, 0)), np.zeros(0), longest)
    words = sorted({w for own in counts.values() for w in own})
    number = {w: i for i, w in enumerate(words)}
    seen = np.zeros((len(words), len(langs)))
    for i, lang in enumerate(langs):
        for w, n in counts.get(lang, {}).items():
            seen[number[w], i] = n
    look, k = Pieces(pieces, longest), len(pieces) + 1
    prob = np.full((k, len(langs)), 1.0 / k)
    for _ in range(rounds):
        got = np.zeros((k, len(langs)))
        for at in batches_of(words):
            part = [words[i] for i in at]
            edges, ends = look.edges(part), np.array([len(w) + 1 for w in part])
            alpha, la = forward(edges, len(part), prob, longest)
            beta, lb = backward(edges, len(part), ends, prob, longest)
            w, s, e, p, _ = edges
            whole = np.maximum(alpha[np.arange(len(part)), ends], 1e-300)
            share = alpha[w, s] * prob[p] * beta[w, e] / whole[w]
            if la is not None:
                share *= np.exp(la[w, s] + lb[w, e] - la[w, ends[w]])
            np.add.at(got, p, share * seen[at][w])
        prob = got + smooth
        prob /= prob.sum(axis=0)
    prior = np.array([sizes[x] + 1.0 for x in langs])
    return Model(langs, pieces, prob, prior / prior.sum(), longest)


def train(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = 250, held_out: int = 1, folds: int = 3, vocab: str | None = None, **options) -> Model:
    """Learns from at most ``rows`` documents a language, outside the held-out fold, chosen by a hash of the id.

    Ids and languages are sampled first, without texts; words are counted where the sample's texts lie, and the counts
    alone reach the driver.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "text"):
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist()):
                n = Counter(words_of(text))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(n) + 1)), pa.array([None, *n], pa.string()), pa.array([1, *n.values()], pa.int64())], names=["lang", "word", "n"])

    base = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    pool = base.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (C.crc_fold("doc_id", folds) != held_out))
    near = pool.filter("text IS NOT NULL").withColumn("h", F.xxhash64("doc_id")).join(F.broadcast(_smallest(pool, rows)), "lang").filter("h <= top")
    sample = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("rank") <= rows).select("lang", "text")
    counts: dict[str, dict[str, int]] = {}
    sizes: dict[str, int] = {}
    for r in sample.mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect():
        if r.word is None:  # a row a document
            sizes[r.lang] = r.n
        else:
            counts.setdefault(r.lang, {})[r.word] = r.n
    return learn(counts, sizes, vocabulary(vocab), **options)


def _smallest(pool: DataFrame, rows: int) -> DataFrame:
    """lang -> a hash below which about ``rows`` of its documents lie (all of them, where there are fewer)."""
    size = pool.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(rows)) / F.col("n"))
    return size.select("lang", (F.lit(-(2.0**63)) + share * F.lit(2.0**64)).alias("top"))


def predict(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score. Texts that are null or without a letter: ``und`` and 0; ties: the first language.

    Rows are independent; repeated rows and null ids stay, no row moves between tasks, extra columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in C.slices(batches, "text"):
            lang, score = scorer.texts(b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return C.keyed(df, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op7_language(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    docs = C.documents(spark, sf_dir)
    out = predict(docs, train(docs))
    return out.withColumn("held_out", F.coalesce(C.crc_fold("doc_id", 3) == 1, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")
