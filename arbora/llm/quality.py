"""Quality classifier (8): attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded (character-class and word-shape
fractions, then a learnt tanh layer), gated attention weighs the passages, and the weighted representation is scored
by a logistic unit. Only document labels are learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .rules import SPACE, labelled

PASSAGE = 64


def _classes() -> np.ndarray:
    """byte -> character class: each ASCII mark its own, digits, capitals, letters, white space, other bytes."""
    out, n = np.zeros(256, np.int64), 5
    for b in range(256):
        if b in SPACE:
            out[b] = 0
        elif 48 <= b <= 57:
            out[b] = 1
        elif 65 <= b <= 90:
            out[b] = 2
        elif 97 <= b <= 122:
            out[b] = 3
        elif b >= 128 or b < 32 or b == 127:
            out[b] = 4
        else:
            out[b], n = n, n + 1
    return out


_CLASS = _classes()
_N = int(_CLASS.max()) + 1
_BLANK = np.isin(np.arange(256), SPACE)
WIDTH = _N + 6


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, number of passages of each text); a text without words is one zero passage."""
    raw = [t.encode() + b"\n" for t in texts]
    size = np.array([len(x) for x in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    begin = size.cumsum() - size
    blank = _BLANK[data]
    first = ~blank
    first[1:] &= blank[:-1]
    words = first.cumsum()
    before = np.where(begin > 0, words[begin - 1], 0) if len(begin) else begin
    n_words = words[begin + size - 1] - before
    count = np.maximum(1, -(-n_words // PASSAGE))
    base = count.cumsum() - count
    doc = np.repeat(np.arange(len(raw)), size)
    at = base[doc] + np.maximum(words - 1 - before[doc], 0) // PASSAGE
    total = int(count.sum())
    mix = np.bincount(at * _N + _CLASS[data], minlength=total * _N).reshape(total, _N).astype(float)
    n = np.bincount(at[first], minlength=total).astype(float)
    chars = mix[:, 1:].sum(axis=1)
    lines = np.bincount(at[data == 10], minlength=total)
    out = np.zeros((total, WIDTH))
    out[:, :_N] = np.sqrt(mix / np.maximum(chars, 1)[:, None])
    wordlike = mix[:, 1:5].sum(axis=1)
    out[:, _N] = np.log1p(n) / 4
    out[:, _N + 1] = chars / np.maximum(n, 1) / 10
    out[:, _N + 2] = lines / np.maximum(n, 1)
    out[:, _N + 3] = 1 - wordlike / np.maximum(chars, 1)
    # words that start with the same four bytes as the word before: runs of repeated words
    p = np.flatnonzero(first)
    key = np.zeros(len(p), np.int64)
    for i in range(4):
        key = key * 257 + data[np.minimum(p + i, len(data) - 1)]
    same = np.zeros(len(p), bool)
    same[1:] = key[1:] == key[:-1]
    out[:, _N + 4] = np.bincount(at[p[same]], minlength=total) / np.maximum(n, 1)
    pair = np.unique(at[p] * 257**4 + key) // 257**4
    out[:, _N + 5] = np.bincount(pair, minlength=total) / np.maximum(n, 1)
    out[n == 0] = 0
    return out, count


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def score(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each bag; ``x`` has the bags' passages end to end."""
        return _forward(self.p, (x - self.mean) / self.scale, count)[0]


def _forward(p, x, count):
    h = np.tanh(x @ p["W"] + p["b"])
    t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
    e = (t * s) @ p["w"]
    begin = count.cumsum() - count
    bag = np.repeat(np.arange(len(count)), count)
    a = np.exp(e - np.maximum.reduceat(e, begin)[bag])
    a /= np.add.reduceat(a, begin)[bag]
    z = np.add.reduceat(a[:, None] * h, begin, axis=0)
    return 1 / (1 + np.exp(-(z @ p["c"] + p["d"]))), h, t, s, a, z, bag, begin


def fit(x: np.ndarray, count: np.ndarray, y: np.ndarray, *, hidden: int = 32, gate: int = 16, epochs: int = 40, batch: int = 64, rate: float = 3e-3, l2: float = 1e-4, seed: int = 7) -> Model:
    """Adam on the logistic loss of bags. Without rows, a model that scores 0.88 throughout (nothing is rejected)."""
    rng = np.random.default_rng(seed)
    k = x.shape[1] if x.ndim == 2 and x.shape[1] else WIDTH
    p = {"W": rng.normal(0, k**-0.5, (k, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, hidden**-0.5, (hidden, gate)), "U": rng.normal(0, hidden**-0.5, (hidden, gate)), "w": rng.normal(0, gate**-0.5, gate), "c": np.zeros(hidden), "d": np.zeros(1)}
    if not len(y):
        p["d"] += 2
        return Model(np.zeros(k), np.ones(k), p)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.05
    x = (x - mean) / scale
    begin = count.cumsum() - count
    m, v, step = {n: 0 * w for n, w in p.items()}, {n: 0 * w for n, w in p.items()}, 0
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)) if 0 < y.mean() < 1 else np.ones(len(y))
    weight = np.sqrt(weight)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            n = count[rows]
            own = x[C.ragged(begin[rows], n)]
            q, h, t, s, a, z, bag, b0 = _forward(p, own, n)
            d = (q - y[rows]) * weight[rows] / len(rows)
            g = {"c": z.T @ d, "d": d.sum(keepdims=True)}
            dz = d[:, None] * p["c"]
            da = (h * dz[bag]).sum(axis=1)
            de = a * (da - np.add.reduceat(a * da, b0)[bag])
            g["w"] = (t * s).T @ de
            dts = de[:, None] * p["w"]
            dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
            g["V"], g["U"] = h.T @ dt, h.T @ ds
            dh = (a[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
            g["W"], g["b"] = own.T @ dh, dh.sum(axis=0)
            step += 1
            for name, w in p.items():
                grad = g[name] + l2 * w
                m[name] = 0.9 * m[name] + 0.1 * grad
                v[name] = 0.999 * v[name] + 0.001 * grad * grad
                w -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, p)


def train(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows: int = 3000, held_out: int = 2, folds: int = 4, **options) -> Model:
    """Fits on a bounded sample of labelled rows (``rows``), with all passages of their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "text"):
            x, count = passages([t or "" for t in b["text"].to_pylist()])
            cut = np.concatenate([[0], count.cumsum()])
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["y"].cast(pa.float64()), pa.array([x[i:j].astype("<f4").tobytes() for i, j in zip(cut, cut[1:])], pa.binary())], names=["doc_id", "y", "x"])

    sample = labelled(C.keyed(df, id_col, text_col), labels, rows, held_out, folds).select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y double, x binary").toPandas().sort_values("doc_id", kind="stable")
    bags = [np.frombuffer(x, "<f4").reshape(-1, WIDTH).astype(float) for x in sample.x]
    x = np.concatenate(bags) if bags else np.zeros((0, WIDTH))
    return fit(x, np.array([len(b) for b in bags], np.int64), sample.y.to_numpy(float), **options)


def _score(model: Model, texts: list[str]) -> np.ndarray:
    return model.score(*passages(texts)) if texts else np.zeros(0)


def score(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.7) -> DataFrame:
    """Per row: doc_id, score in 0..1, predicted (1 where score >= ``least``).

    Null texts count as empty, which have a score as well. Rows are independent; repeated rows and null ids stay, no
    row moves between tasks, extra columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "text", 1 << 20):
            s = _score(model, [t or "" for t in b["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s), pa.array((s >= least).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return C.keyed(df, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def keep(df: DataFrame, model: Model, *, text_col: str = "text", least: float = 0.7) -> DataFrame:
    """The rows of ``df``, all columns, whose score is at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, text_col, 1 << 20):
            yield b.filter(pa.array(_score(model, [t or "" for t in b[text_col].to_pylist()]) >= least))

    return df.mapInArrow(run, df.schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = C.documents(spark, sf_dir)
    out = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.withColumn("held_out", F.coalesce(C.crc_fold("doc_id", 4) == 2, F.lit(False))).select("doc_id", "held_out", "score", "predicted")
