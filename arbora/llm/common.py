"""Helpers the operators of this subpackage share: shared storage, batching, hashing, tokenising."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is missing, a local session (tests) gets a folder of its own; a cluster
    session raises, as a machine-local folder would not be seen by the other machines.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="arbora-shared-")
    return _OWN[app]


def fresh(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back, which cuts the lineage durably."""
    spark, path = df.sparkSession, fresh(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``materialize`` that no later step reads."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI: ``file:`` here, HDFS, S3 or GCS elsewhere."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of rows whose ``column`` holds about ``max_bytes`` (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.cumsum(np.nan_to_num(pc.binary_length(b[column]).to_numpy(zero_copy_only=False).astype(float)))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + max_bytes, "right")))
            yield b.slice(at, end - at)
            at = end


def side_by_side(batches: Iterator[pa.RecordBatch], key: str, *names: str) -> Iterator[tuple]:
    """(key, list of the other columns' values) of rows that lie side by side."""
    rows = (r for b in batches for r in zip(*(b[n].to_pylist() for n in (key, *names))))
    for k, group in groupby(rows, lambda r: r[0]):
        yield k, list(zip(*((r[1:]) for r in group)))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered up to a bound."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        import xxhash

        self.limit, self.hash = limit, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = self.hash(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_ROT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all windows of ``k`` words, given the words' hashes, in order of position."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mix64(out * _ROT[0] + h[i : i + n] + _ROT[i % 5])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    ends = lengths.cumsum()
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.arange(256, dtype=np.uint8) + 32 * np.isin(np.arange(256), range(65, 91)).astype(np.uint8)
_HEAD = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all words in order, number of words of each text); A-Z count as a-z, ASCII white space cuts."""
    raw = [t.encode() for t in texts]
    data = _LOWER[np.frombuffer(b" ".join(raw) + b" " * 9, np.uint8)]
    blank = _SPACE[data]
    edge = np.flatnonzero(np.diff(blank, prepend=True))
    start = edge[::2]
    size = edge[1::2] - start
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    h = size.astype(np.uint64) * _ROT[0]
    live, off = np.arange(len(start)), 0
    while len(live):  # eight bytes of every word that is that long
        part = np.ascontiguousarray(eight[start[live] + off]).view("<u8").ravel() & _HEAD[np.minimum(size[live] - off, 8)]
        h[live] = mix64(h[live] ^ part) * _ROT[1]
        off += 8
        live = live[size[live] > off]
    ends = np.cumsum([len(x) + 1 for x in raw])
    return h, np.bincount(np.searchsorted(ends, start, "right"), minlength=len(raw)).astype(np.int64)


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """The sorted distinct ``k``-word shingle hashes of each text; with fewer words the whole sequence is the one shingle."""
    h, n = word_hashes(texts)
    end = n.cumsum()
    whole = shingle_hashes(h, k)
    out = []
    for a, b in zip((end - n).tolist(), end.tolist()):
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        elif a == b:
            out.append(np.empty(0, np.uint64))
        else:  # its length tells it from longer texts' shingles
            out.append(mix64(shingle_hashes(h[a:b], b - a) + np.uint64(b - a)))
    return out


#: Fixed value: the split of the tokenizer definition that the fast path below knows.
_KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: That split written out for lower-cased Latin-1 text (letters, numbers, white space of Latin-1).
_LATIN_PIECES = re.compile("[a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r \x85\xa0a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")


def _byte_letters() -> dict[int, str]:
    """byte -> the printable character that stands for it in byte-level BPE."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    """piece -> its number; once learnt, ids of piece i are flat[start[i]:start[i + 1]]."""

    def __init__(self, model):
        from array import array

        super().__init__()
        self.tokenize, self.letters, self.new, self.flat, self.start = model.tokenize, _byte_letters(), [], array("I"), array("q", [0])

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters))
        return n

    def learn(self) -> None:
        """Asks the BPE model for the ids of the pieces that came in since the last time."""
        tokenize, flat, start = self.tokenize, self.flat, self.start
        for piece in self.new:
            flat.extend([t.id for t in tokenize(piece)])
            start.append(len(flat))
        self.new = []


class ChunkEncoder:
    """Token ids of whole texts by a tokenizer file; ``ids`` equals ``encode(text, add_special_tokens=False)``.

    Most words recur, so a text is cut into the tokenizer's own pre-tokens, the library's BPE model is asked
    once for each distinct one, and ids are gathered by numpy. That path takes Latin-1 texts under the
    tokenizer definition it knows; any other text, and any text that may hold a special token, goes through
    the tokenizer whole. The memory is bounded: beyond ``limit`` pieces it starts afresh.
    """

    def __init__(self, path: str, limit: int = 500_000):
        import json

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tk, self.limit = Tokenizer.from_file(path), limit
        with open(path) as f:
            spec = json.load(f)
        norm = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = [x.get("pattern", {}).get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if "pattern" in x]
        marks = [x["content"] for x in spec.get("added_tokens", [])]
        self.known = norm == ["NFC", "Replace", "Lowercase"] and split == [_KNOWN_SPLIT] and all(x.startswith("<|") for x in marks)
        self.vocab = self.tk.get_vocab_size(with_added_tokens=True)
        self.pieces = _Pieces(self.tk.model)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids end to end, number of ids of each text)."""
        if len(self.pieces) > self.limit:
            self.pieces = _Pieces(self.tk.model)
        at, which, whole = self.pieces, [], {}
        for i, t in enumerate(texts):
            try:
                if not self.known or "<|" in t:
                    raise UnicodeError
                if not t.isascii():
                    t.encode("latin-1")
                found = _LATIN_PIECES.findall(t.lower())
                which.append(np.fromiter(map(at.__getitem__, found), np.int64, len(found)))
            except UnicodeError:
                whole[i] = np.asarray(self.tk.encode(t, add_special_tokens=False).ids, np.uint32)
                which.append(np.empty(0, np.int64))
        at.learn()
        flat, start = np.frombuffer(at.flat, np.uint32) if at.flat else np.empty(0, np.uint32), np.frombuffer(at.start, np.int64)
        all_ = np.concatenate(which) if which else np.empty(0, np.int64)
        length = start[all_ + 1] - start[all_]
        out = flat[ragged(start[all_], length)]
        n = np.diff(np.concatenate([[0], length.cumsum()])[np.concatenate([[0], np.cumsum([len(x) for x in which])]).astype(np.int64)])
        del flat, start  # the arrays grow again only when no view of them is left
        if whole:
            parts = np.split(out, n.cumsum()[:-1])
            for i, x in whole.items():
                parts[i], n[i] = x, len(x)
            out = np.concatenate(parts)
        return out, n


def tokenizer_path(name: str = "word_bpe_49k.json", folder: str | None = None) -> str:
    """Where a vocabulary file lies: in ``folder``, or in the installed package of public tokenizers."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just (doc_id long, text string); other columns, clashing names among them, are left behind."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def crc_fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo ``folds`` (null ids: null)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(folds)


def bit_table(df: DataFrame, column: str, bits: int = 1 << 24):
    """A broadcast bit table of fixed size: bit ``pmod(column, bits)`` is set for each value of a long column."""
    at = df.select(F.pmod(column, F.lit(bits)).alias("p")).distinct()
    parts = at.groupBy(F.floor(F.col("p") / 8192).alias("s")).agg(F.collect_list((F.col("p") % 8192).cast("int")).alias("at"))
    table = np.zeros(bits, bool)
    for r in parts.toLocalIterator():
        table[r["s"] * 8192 + np.array(r["at"])] = True
    return df.sparkSession.sparkContext.broadcast(np.packbits(table))


def packed_texts(docs: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """``names`` and the zstd-packed text of the rows of docs(th, text, ...) whose th may be among ``keys``' th.

    The bit table keeps most other texts out of the shuffle; the join that follows is exact.
    """
    bits = 1 << 24
    sent = bit_table(keys, "th", bits)
    schema = docs.select(*names).withColumn("packed", F.lit(b"")).schema

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, own = zstandard.ZstdCompressor(level=3), np.unpackbits(sent.value).astype(bool)
        for b in batches:
            b = b.filter(pa.array(own[b["th"].to_numpy() % bits]))
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*(b[n] for n in names), pa.array([pack.compress(t.encode()) for t in b["text"].to_pylist()], pa.binary())], names=[*names, "packed"])

    return docs.filter("text IS NOT NULL").mapInArrow(near, schema)
