"""WARC archives (1): seekable Zstandard bundles with a record index.

Records are grouped into independent Zstandard frames; a footer seek table (the public "seekable format":
a skippable frame 0x184D2A5E with the compressed and decompressed size of each frame) makes every frame
reachable, and the index maps each record to (bundle, frame, offset within the frame, length).
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Fixed values of the seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1


class BundleWriter:
    """Appends records to frames of about ``frame_bytes``; memory holds one frame and the seek table."""

    def __init__(self, out, frame_bytes: int = 1 << 18, level: int = 3):
        import zstandard

        self.out, self.frame_bytes = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.frame, self.held, self.table = [], 0, []

    def add(self, record: bytes) -> tuple[int, int]:
        """(number of the frame, offset of the record within the decompressed frame)."""
        if self.held and self.held + len(record) > self.frame_bytes:
            self._flush()
        at = (len(self.table), self.held)
        self.frame.append(record)
        self.held += len(record)
        return at

    def _flush(self) -> None:
        data = self.zstd.compress(b"".join(self.frame))
        self.out.write(data)
        self.table.append((len(data), self.held))
        self.frame, self.held = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()


class BundleReader:
    """Random access to the frames of a bundle through its seek table."""

    def __init__(self, file):
        import zstandard

        self.f, self.zstd = file, zstandard.ZstdDecompressor()
        end = file.seek(0, 2)
        file.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        each = 12 if flags & 0x80 else 8
        file.seek(end - 9 - n * each)
        raw = file.read(n * each)
        sizes = np.frombuffer(raw, "<u4").reshape(n, each // 4)[:, :2].astype(np.int64)
        self.start = np.concatenate([[0], sizes[:, 0].cumsum()])
        self.size = sizes[:, 1]

    def frame(self, i: int) -> bytes:
        self.f.seek(int(self.start[i]))
        return self.zstd.decompress(self.f.read(int(self.start[i + 1] - self.start[i])), max_output_size=int(self.size[i]))


def _head(kind: str, fields: list[tuple[str, str]], length: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode()


def record(kind: str, page_id, url, payload: bytes, digest: str, refers_to=None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record with an HTTP response; a revisit has its payload's digest and length, not the payload."""
    name = lambda x: f"<urn:page:{'null' if x is None else x}>"
    target = "" if url is None else "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in url)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    fields = [("WARC-Record-ID", name(page_id)), ("WARC-Target-URI", target), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response")]
    if kind == "revisit":
        fields[3:3] = [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        payload = b""
    return _head(kind, fields, len(http) + len(payload)) + http + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


_INDEX = "page_id long, path string, frame long, offset long, length long"
_PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def plan(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 100) -> DataFrame:
    """Adds digest, record type and refers_to to the pages.

    Of pages with equal payloads of at least ``least`` bytes the one with the smallest id is the response (all of
    them, where several rows have that id, or where all ids are null); the others revisit it. Digests are
    counted with a partial aggregation first, and only digests that recur are joined back, so a payload that
    very many pages share is one small row; the page side of that join is one AQE can split.
    """
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(body_col).cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html").cast("long"))
    again = pages.filter(F.col("size") >= least).groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    joined = pages.join(again, (F.col("digest") == F.col("d")) & (F.col("size") >= least), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).alias("refers_to"))


def write(df: DataFrame, *, frame_bytes: int = 1 << 18, level: int = 3, **columns) -> DataFrame:
    """Writes a WARC record per row, a bundle per task; returns the record index, a written table.

    Null bodies are empty payloads, null ids and urls are written as such. Bundles of failed attempts are not in
    the index. Options as for ``plan``.
    """
    folder = C.fresh(df.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in C.slices(batches, "html", 8 << 20):
            if out is None:
                fs, base = C.filesystem(folder)
                fs.create_dir(base, recursive=True)
                name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
                out = BundleWriter(fs.open_output_stream(f"{base}/{name}", compression=None), frame_bytes, level)
            frame, offset, length = [], [], []
            for page, url, html, digest, kind, refers in zip(*(c.to_pylist() for c in b.columns)):
                data = record(kind, page, url, html.encode(), digest, refers)
                i, at = out.add(data)
                frame.append(i)
                offset.append(at)
                length.append(len(data))
            yield pa.RecordBatch.from_arrays([b["page_id"], pa.array([f"{folder}/{name}"] * b.num_rows), *(pa.array(x, pa.int64()) for x in (frame, offset, length))], names=["page_id", "path", "frame", "offset", "length"])
        if out is not None:
            out.close()

    return C.materialize(plan(df, **columns).mapInArrow(run, _INDEX), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """Reads records through the index: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Payloads of responses are read in full and must have the digest and the length their record states.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = file = None
        number = lambda x: None if x == "<urn:page:null>" else int(x[len("<urn:page:") : -1])
        for b in batches:
            rows = []
            for page, where, frame, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if where != path:
                    if file:
                        file.close()
                    fs, local = C.filesystem(where)
                    file = fs.open_input_file(local)
                    path, bundle, held = where, BundleReader(file), None
                if held != frame:
                    data, held = bundle.frame(frame), frame
                f, payload = parse(data[offset : offset + length])
                digest, size, kind = f["WARC-Payload-Digest"].partition(":")[2], int(f["X-Payload-Length"]), f["WARC-Type"]
                if number(f["WARC-Record-ID"]) != page:
                    raise ValueError(f"the index has page {page} where {path} has {f['WARC-Record-ID']}")
                if kind == "response":
                    if (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                        raise ValueError(f"the payload of page {page} is not what its record states")
                rows.append((page, size, digest, kind, number(f["WARC-Refers-To"]) if kind == "revisit" else None))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if file:
            file.close()

    n = index.agg(F.countDistinct("path")).first()[0]  # index rows are tiny: without a number AQE would read all bundles in a task
    by_bundle = index.repartition(max(1, n), "path").sortWithinPartitions("path", "frame", "offset")
    return by_bundle.mapInArrow(run, _PAGES)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written as WARC bundles and read back."""
    return read(write(spark.read.parquet(f"{sf_dir}/pages.parquet")))


ORACLE = """
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
        min(page_id) OVER (PARTITION BY sha256(coalesce(html, ''))) AS first FROM pages) t
"""
