"""Quality rules (4): base rules, then gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import gbt

SPACE = [9, 10, 11, 12, 13, 32]
SYMBOLS = list(b"#*$%&|<>")
FEATURES = ("log_words", "mean_word", "symbols", "dup_lines", "repeats", "distinct", "digits", "upper", "stops", "line_words")
#: Documents with more symbols, repeated lines or repeated words never score higher for it.
MONOTONE = {FEATURES.index("symbols"): -1, FEATURES.index("dup_lines"): -1, FEATURES.index("repeats"): -1}


def statistics(text: str, hashes: C.WordHashes) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """((n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), features) of one whole text."""
    raw = text.encode()
    n_of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n = len(words)
    chars = len(text) - int(n_of[SPACE].sum())
    symbols = int(n_of[SYMBOLS].sum())
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dups = len(lines) - len(set(lines))
    h = hashes.of(words)
    repeat = 0
    if n >= 4:
        w = C.shingle_hashes(h, 3)
        order = np.argsort(w)
        same = w[order][1:] == w[order][:-1]
        if same.any():
            twice = np.zeros(len(w), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = np.zeros(n, bool)
            for i in range(3):
                cover[i : i + len(w)] |= twice
            repeat = int(cover.sum())
    size = max(n, 1)
    distinct = len(np.unique(h))
    features = [np.log1p(n), chars / size, symbols / max(chars, 1), dups / max(len(lines), 1), repeat / size, distinct / size**0.75, n_of[48:58].sum() / max(chars, 1), n_of[65:91].sum() / max(chars, 1), (n_of[44] + n_of[46]) / size, n / max(len(lines), 1)]
    return (n, chars, symbols, dups, repeat), features


def labelled(docs: DataFrame, labels: DataFrame, rows: int, held_out: int, folds: int) -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out fold, chosen by a hash of the id.

    Labels that are neither 0 nor 1 are left out, as are ids whose labels differ. The sample is bounded by a
    parameter, so its side of the join is small whatever the input.
    """
    few = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (C.crc_fold("doc_id", folds) != held_out))
    few = few.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", "y")
    return docs.join(F.broadcast(few), "doc_id")


_SAMPLE = "y double, x array<double>"


def train(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows: int = 4000, held_out: int = 2, folds: int = 4, **options) -> gbt.Trees:
    """Fits the trees on a bounded sample of labelled rows (``rows``); their statistics alone reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = C.WordHashes()
        for b in C.slices(batches, "text"):
            found = [statistics(t or "", hashes)[1] for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["y"].cast(pa.float64()), pa.array(found, pa.list_(pa.float64()))], names=["y", "x"])

    sample = labelled(C.keyed(df, id_col, text_col), labels, rows, held_out, folds).select("text", "y").mapInArrow(run, _SAMPLE).orderBy("y", "x").toPandas()
    x = np.array(sample.x.tolist(), float).reshape(-1, len(FEATURES))
    return gbt.fit(x, sample.y.to_numpy(), monotone=MONOTONE, **options)


_OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def judge(df: DataFrame, model: gbt.Trees, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Per row: the statistics, the base verdict, the model's score and the verdict.

    Null texts have no words and so fail the base rules. Rows are independent: repeated rows and null ids stay, no row
    moves between tasks. Extra columns are left out. A row is kept when the base rules pass and score >= ``least``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = C.WordHashes()
        for b in C.slices(batches, "text"):
            found = [statistics(t or "", hashes) for t in b["text"].to_pylist()]
            counts = np.array([x[0] for x in found], np.int64)
            score = model.score(np.array([x[1] for x in found], float))
            failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= least))], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"])

    return C.keyed(df, id_col, text_col).mapInArrow(run, _OUT)


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Verdicts of the quality rules on all documents."""
    docs = C.documents(spark, sf_dir)
    return judge(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
