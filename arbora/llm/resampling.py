"""Target-distribution importance resampling (11): array-scored weights, exact integer-score histogram, cutoff and ranks."""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: A-Z become a-z; all other ASCII than 0-9 and a-z separates words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words up to this number of bytes have their shift tables; longer ones go through zlib.
_MOST = 63


def _shifts(most: int) -> np.ndarray:
    """[n, k, v]: the crc32 register v << 8k after n more zero bytes, without start and end inversion."""
    step = np.array([zlib.crc32(bytes([v])) ^ zlib.crc32(b"\0") for v in range(256)], np.uint32)  # linear part of one byte
    out = np.empty((most + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, most + 1):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ step[out[n - 1] & np.uint32(255)]
    return out


class Buckets:
    """Buckets of all runs of one and two consecutive words of texts, with numpy.

    crc32 is linear: the crc of "a b" is that of "a", moved on by the bytes of " b", xor that of " b". Each distinct
    word is hashed once, pairs are put together from three numbers a word.
    """

    def __init__(self, buckets: int, limit: int = 500_000):
        self.buckets, self.limit, self.shift = buckets, limit, _shifts(_MOST + 1)
        self._forget()

    def _forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.crc, self.spaced, self.size = array("I"), array("I"), array("q")

    def _number(self, word: bytes) -> int:
        self.at[word] = n = len(self.at)
        self.crc.append(zlib.crc32(word))
        self.spaced.append(zlib.crc32(b" " + word))
        self.size.append(len(word))
        return n

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket of each feature, text by text: words, then pairs; number of words of each text; of features)."""
        if len(self.at) > self.limit:
            self._forget()
        at, number, words, n = self.at, self._number, [], []
        for t in texts:
            found = t.encode().translate(_WORD_BYTES).split() if t else []
            n.append(len(found))
            words += found
        # every word gets its number at first sight
        ids = np.fromiter((at[w] if w in at else number(w) for w in words), np.int64, len(words))
        n = np.array(n, np.int64)
        crc, spaced, size = np.frombuffer(self.crc or b"\0" * 4, np.uint32), np.frombuffer(self.spaced or b"\0" * 4, np.uint32), np.frombuffer(self.size or b"\0" * 8, np.int64)
        ends = n.cumsum()
        first = np.ones(len(ids), bool)
        first[ends[n > 0] - 1] = False  # the last word of a text begins no pair
        lead = np.flatnonzero(first[: len(ids)])
        a, b = ids[lead], ids[lead + 1]
        x, more, s = crc[a], np.minimum(size[b], _MOST) + 1, self.shift
        two = s[more, 0, x & np.uint32(255)] ^ s[more, 1, (x >> np.uint32(8)) & np.uint32(255)] ^ s[more, 2, (x >> np.uint32(16)) & np.uint32(255)] ^ s[more, 3, x >> np.uint32(24)] ^ spaced[b]
        for i in np.flatnonzero(size[b] > _MOST).tolist():
            two[i] = zlib.crc32(b" " + words[lead[i] + 1], zlib.crc32(words[lead[i]]))
        pairs = np.maximum(n - 1, 0)
        features = n + pairs
        start = features.cumsum() - features
        out = np.empty(len(ids) + len(lead), np.int64)
        out[C.ragged(start, n)] = crc[ids] % np.uint32(self.buckets)
        out[C.ragged(start + n, pairs)] = two % np.uint32(self.buckets)
        del crc, spaced, size
        return out, n, features


def histogram(texts: DataFrame, buckets: int = 10_000, text_col: str = "text") -> np.ndarray:
    """Number of features in each bucket over all rows: one array a task, summed by a shuffle of at most ``buckets`` rows a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for b in C.slices(batches, "text"):
            total += np.bincount(make.of(b["text"].to_pylist())[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    rows = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of the ratio of smoothed shares, target over source) of each bucket, in doubles."""
    k, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + k) / ((float(a) + 1) * (t + k)))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of a document's features, 0 without any."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        make = Buckets(len(own))
        for b in C.slices(batches, "text"):
            bucket, n, features = make.of(b["text"].to_pylist())
            run_ = np.concatenate([[0], own[bucket].cumsum()])
            ends = features.cumsum()
            weight = (run_[ends] - run_[ends - features]) // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return C.keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) of every document; ``rank`` is null where it is not drawn.

    The score is the weight plus Gumbel noise from the id (floored, in thousandths), so the highest scores are a draw
    without replacement in proportion to exp(weight / 1000). Of the N documents with ``least_words`` words,
    floor(percent * N / 100) are drawn. Scores are whole numbers, so their histogram is exact and small: the noise lies between
    -3,200 and 23,000 and a weight between two logarithms, whatever the input, which bounds what the driver gets.
    Sums of it from the top give each score's first rank and the score of the cutoff; only documents from there on
    are numbered, by id within their score. With distinct ids a score holds at most 1/2,700 of a weight's documents.

    Null and empty texts: no features, weight 0, never drawn. Null ids: score and rank null, not among N. Repeated
    rows are rows of their own; of rows with equal score and id, fewer features, then less weight come first. Empty tables: no rows.
    Two passes over the texts; shuffled are arrays of ``buckets`` counts, the histogram and the survivors' ids.
    """
    spark = docs.sparkSession
    gain = gains(histogram(docs, buckets, text_col), histogram(target, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = C.materialize(weights(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + noise), "resampling-scored")
    may = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    counts = pd.DataFrame([tuple(r) for r in scored.filter(may).groupBy("score").count().collect()], columns=["score", "n"]).astype("int64").sort_values("score", ascending=False)
    quota = percent * int(counts["n"].sum()) // 100
    counts["before"] = counts["n"].cumsum() - counts["n"]
    counts = counts[counts["before"] < quota]
    drawn = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    if counts.empty:
        return scored.withColumn("rank", F.lit(None).cast("long")).select(drawn)
    cut = int(counts["score"].min())
    before = spark.createDataFrame(list(counts[["score", "before"]].itertuples(index=False, name=None)), "score long, before long")
    place = F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "n_features", "weight")).cast("long")
    top = scored.filter(may & (F.col("score") >= cut)).withColumn("place", place).join(F.broadcast(before), "score")
    rank = F.col("before") + F.col("place")
    top = top.withColumn("rank", F.when(rank <= quota, rank)).select(drawn)
    return top.unionByName(scored.filter(~(may & F.coalesce(F.col("score") >= cut, F.lit(False)))).withColumn("rank", F.lit(None).cast("long")).select(drawn))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: crc32 in SQL: a table of 256 steps made bit by bit, then one join a byte over all distinct features at once.
ORACLE = rf"""
WITH RECURSIVE step AS (SELECT v, list_reduce(list_concat([v], range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(v)),
texts AS (SELECT 0 AS side, doc_id, {_WORDS} AS w FROM documents UNION ALL SELECT 1, NULL, {_WORDS} FROM benchmark),
numbered AS (SELECT row_number() OVER () AS row, side, doc_id, coalesce(w, []) AS w FROM texts),
features AS (SELECT row, side, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM numbered),
counted AS (SELECT row, side, feature, count(*) AS n FROM features GROUP BY ALL),
crc AS (
  SELECT feature, hex(encode(feature)) AS hx, 0 AS pos, 4294967295 AS c FROM (SELECT DISTINCT feature FROM counted)
  UNION ALL
  SELECT feature, hx, pos + 2, xor(crc.c // 256, step.c) FROM crc JOIN step ON step.v = xor(crc.c % 256, ('0x' || substr(hx, pos + 1, 2))::BIGINT) WHERE pos < length(hx)),
bucket AS (SELECT feature, xor(c, 4294967295) % 10000 AS bucket FROM crc WHERE pos = length(hx)),
known AS (SELECT row, side, bucket, n FROM counted JOIN bucket USING (feature)),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM known GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000)))) AS gain FROM sums),
weight AS (SELECT row, sum(n) AS n_features, floor(sum(n * gain) / sum(n)) AS weight FROM known JOIN gain USING (bucket) WHERE side = 0 GROUP BY row),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM numbered LEFT JOIN weight USING (row) WHERE side = 0),
ranked AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS rank FROM scored)
SELECT doc_id, n_words, n_features, weight, score, CASE WHEN rank <= 25 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100 THEN rank END AS rank FROM ranked
"""
