"""Token-id output (9): fixed-width bit-packed files with block offsets for random access.

File format (little-endian)
---------------------------
=========  =====================================================================
bytes      meaning
=========  =====================================================================
0..7       magic ``ARBPACK1``
8..11      uint32 bits per id (the fewest that hold every id of the vocabulary)
12..15     uint32 ids per block
16..       blocks, each of ``ids per block`` ids packed LSB first at ``bits`` bits, on a byte boundary
then       uint64 byte offset of each block, and of the end of the last
then       uint64 first id of each document, and the number of ids
last 32    uint64 offset of the block table, uint64 ids, uint64 documents, magic ``ARBTAIL1``
=========  =====================================================================
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

MAGIC, TAIL, HEAD, FOOT = b"ARBPACK1", b"ARBTAIL1", struct.Struct("<8sII"), struct.Struct("<QQQ8s")


def bits_for(vocab: int) -> int:
    """Bits that hold every id of a vocabulary of this size."""
    return max(1, int(vocab - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids at ``bits`` bits each, least significant bit first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits == 32:
        return ids.astype("<u4").tobytes()
    lanes = ((ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(lanes.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int, first: int = 0) -> np.ndarray:
    """``count`` ids from id ``first`` of a packed block, as uint32."""
    if bits in (16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count, first * bits // 8).astype(np.uint32)
    at = (first + np.arange(count, dtype=np.int64)) * bits
    raw = np.frombuffer(data + b"\0" * 8, np.uint8)
    word = np.zeros(count, np.uint64)
    for i in range((bits + 14) // 8):
        word |= raw[(at >> 3) + i].astype(np.uint64) << np.uint64(8 * i)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Writer:
    """Streams documents' ids to one file; memory holds a block and the offsets."""

    def __init__(self, out, bits: int, block: int):
        self.out, self.bits, self.block = out, bits, block
        self.rest, self.total, self.firsts, self.offsets, self.at = np.empty(0, np.uint32), 0, [], [], HEAD.size
        out.write(HEAD.pack(MAGIC, bits, block))

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.firsts.append(self.total + np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.uint64))
        self.total += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        whole = len(self.rest) // self.block
        for i in range(whole):
            self._put(self.rest[i * self.block : (i + 1) * self.block])
        self.rest = self.rest[whole * self.block :].copy()

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        """Writes the tables."""
        if len(self.rest):
            self._put(self.rest)
        firsts = np.concatenate([*self.firsts, [self.total]]).astype("<u8")
        self.out.write(np.array([*self.offsets, self.at], "<u8").tobytes() + firsts.tobytes() + FOOT.pack(self.at, self.total, len(firsts) - 1, TAIL))
        self.out.close()


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, file):
        self.f = file
        end = file.seek(0, 2)
        file.seek(end - FOOT.size)
        table, self.total, self.docs, tail = FOOT.unpack(file.read(FOOT.size))
        file.seek(table)
        raw = file.read(end - FOOT.size - table)
        file.seek(0)
        magic, self.bits, self.block = HEAD.unpack(file.read(HEAD.size))
        if tail != TAIL or magic != MAGIC:
            raise ValueError("not a token-id file")
        n = -(-self.total // self.block)
        self.offsets = np.frombuffer(raw, "<u8", n + 1).astype(np.int64)
        self.firsts = np.frombuffer(raw, "<u8", self.docs + 1, 8 * (n + 1)).astype(np.int64)

    def ids(self, first: int, count: int) -> np.ndarray:
        """Ids [first, first + count): only their blocks are read."""
        if not count:
            return np.empty(0, np.uint32)
        a, b = first // self.block, (first + count - 1) // self.block
        self.f.seek(int(self.offsets[a]))
        data = self.f.read(int(self.offsets[b + 1] - self.offsets[a]))
        if self.block * self.bits % 8 == 0:  # blocks are back to back, bit for bit
            return unpack(data, self.bits, count, first - a * self.block)
        parts = [unpack(data[self.offsets[i] - self.offsets[a] :], self.bits, min(self.block, self.total - i * self.block)) for i in range(a, b + 1)]
        return np.concatenate(parts)[first - a * self.block :][:count]

    def doc(self, i: int) -> np.ndarray:
        return self.ids(int(self.firsts[i]), int(self.firsts[i + 1] - self.firsts[i]))


_META = T.StructType([T.StructField(n, t) for n, t in (("part", T.LongType()), ("path", T.StringType()), ("docs", T.LongType()), ("ids", T.LongType()), ("doc_ids", T.BinaryType()), ("nulls", T.LongType()))])
_DOCS = "doc_id long, part long, in_file long, n_tokens long, ids_crc32 long"


def write(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, block: int = 4096, partitions: int | None = None) -> DataFrame:
    """Encodes ``text_col`` and writes one packed file per range of ids, in ascending order of ids.

    Returns the manifest, a written table with a row per file: part (its place in the order), path, docs, ids,
    doc_ids (int64 ids of its documents, packed), nulls (how many of its first documents have a null id).
    A file gets its own name in each attempt and counts only through the manifest, which Spark commits, so lost
    executors leave no half-written file behind in the result. Null ids come first, equal ids are ordered by
    text; null texts are empty. An empty table gives an empty manifest.
    """
    spark = df.sparkSession
    path, folder = tokenizer or C.tokenizer_path(), C.fresh(spark, "tokenids")
    docs = C.keyed(df, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    by = [F.asc_nulls_first("doc_id")]
    docs = (docs.repartitionByRange(partitions, *by) if partitions else docs.repartitionByRange(*by)).sortWithinPartitions(*by, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = C.ChunkEncoder(path)
        part, writer, ids = TaskContext.get().partitionId(), None, []
        for b in C.slices(batches, "text"):
            if writer is None:
                fs, base = C.filesystem(folder)
                fs.create_dir(base, recursive=True)
                name = f"{part:06d}-{uuid.uuid4().hex}.ids"
                writer = Writer(fs.open_output_stream(f"{base}/{name}", compression=None), bits_for(max(enc.vocab, end_id + 1)), block)
            flat, n = enc.ids(b["text"].to_pylist())
            ends = n.cumsum()
            writer.add(np.insert(flat, ends, end_id).astype(np.uint32), n + 1)
            ids.append(b["doc_id"])
        if writer is not None:
            writer.close()
            arr = pa.chunked_array(ids)
            values = np.concatenate([x.fill_null(0).to_numpy() for x in arr.chunks]).astype("<i8")
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/{name}"], "docs": [len(values)], "ids": [writer.total], "doc_ids": [values.tobytes()], "nulls": [arr.null_count]}, schema=_arrow(_META))

    return C.materialize(docs.mapInArrow(run, _META), "tokenids-manifest")


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def read(manifest: DataFrame) -> DataFrame:
    """The documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Files are read back a run of blocks at a time, each file by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                fs, path = C.filesystem(row["path"])
                with fs.open_input_file(path) as f:
                    r, names = Reader(f), np.frombuffer(row["doc_ids"], "<i8")
                    if (r.docs, r.total) != (row["docs"], row["ids"]):
                        raise ValueError(f"{path} does not hold what its manifest says")
                    at = 0
                    while at < r.docs:  # about a million ids at a time
                        end = max(at + 1, int(np.searchsorted(r.firsts, r.firsts[at] + (1 << 20), "right")) - 1)
                        first = r.firsts[at : end + 1]
                        data = r.ids(int(first[0]), int(first[-1] - first[0])).astype("<u4").tobytes()
                        cut = ((first - first[0]) * 4).tolist()
                        crc = [zlib.crc32(data[i:j]) for i, j in zip(cut, cut[1:])]
                        yield pa.RecordBatch.from_arrays([pa.array(names[at:end], mask=np.arange(at, end) < row["nulls"]), pa.array([row["part"]] * (end - at), pa.int64()), pa.array(first[:-1]), pa.array(np.diff(first)), pa.array(crc, pa.int64())], names=["doc_id", "part", "in_file", "n_tokens", "ids_crc32"])
                        at = end

    from pyspark.sql import Window

    # One row a file; a running sum over them gives where each file starts.
    begins = manifest.select("part", "ids").withColumn("before", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = manifest.count()  # its rows are tiny: without a number AQE would read all files in a task
    found = manifest.repartition(max(1, n), "path").mapInArrow(run, _DOCS)
    return found.join(begins.select("part", "before"), "part").select("doc_id", (F.col("before") + F.col("in_file")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_ids(spark, sf_dir: str) -> DataFrame:
    """All documents written as token-id files and read back."""
    return read(write(C.documents(spark, sf_dir)))
