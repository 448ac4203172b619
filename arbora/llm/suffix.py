"""Suffix-array dedup (6): bytes covered by a long string that also starts earlier are removed.

Windows of ``length`` bytes are grouped by their minimiser (the smallest hash of their 32-byte pieces), so equal
windows always meet; runs of windows with one minimiser travel together as one string of at most ``length + 63`` bytes.
Equal strings are folded to their first place. The different strings that share a minimiser form bounded collections,
whose Burrows-Wheeler transform and common prefixes are built column by column; rows with common prefixes of ``length``
are equal windows, and all but the earliest are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bwt
from . import common as C

GRAM, RUN = 32, 64
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
#: Stands for a null id: such documents come last.
NULL_ID = (1 << 63) - 1
#: A string's start, number of windows and two flags in one long: fewer columns to sort and move.
_START, _N = 30, 2


def _grams(data: np.ndarray) -> np.ndarray:
    """Hashes of all pieces of GRAM bytes."""
    h = data.astype(np.uint64) + np.uint64(1)
    for i in range(5):
        step = 1 << i
        h = h[:-step] * _ODD[i] + h[step:] if len(h) > step else h[:0]
    return C.mix64(h)


def _smallest(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    step = 1
    while 2 * step <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    rest = width - step
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def strings(data: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, start, windows, minimiser, digest, inner) of the strings of texts that lie end to end in ``data``.

    ``inner``: a window of the string holds its minimiser twice, so the string may repeat within itself.
    """
    empty = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    count = np.maximum(sizes - length + 1, 0)
    begin = sizes.cumsum() - sizes
    total = int(count.sum())
    if not total:
        return empty
    h = _grams(data)
    # The place in the low bits: ascending in one minimum, descending in the other, so that they differ on a tie.
    low = np.uint64(0xFFFF)
    place = np.arange(len(h), dtype=np.uint64) & low
    left = _smallest(h & ~low | place, length - GRAM + 1)
    right = _smallest(h & ~low | (low - place), length - GRAM + 1)
    where = C.ragged(begin, count)  # starts of the windows that lie in one text
    doc = np.repeat(np.arange(len(sizes)), count)
    key = left[where] >> np.uint64(16)
    tie = ((left + right) & low)[where] != low
    new = np.ones(total, bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    run = np.flatnonzero(new)
    n = np.diff(np.append(run, total))
    long = np.flatnonzero(n > RUN)  # equal minimisers over a long stretch (periodic text): cut
    if len(long):
        parts = -(-n // RUN)
        first = np.repeat(run, parts)
        k = np.arange(len(first)) - np.repeat(parts.cumsum() - parts, parts)
        end = np.repeat(run + n, parts)
        run = first + k * RUN
        n = np.minimum(RUN, end - run)
    at, size = where[run], n + length - 1
    digest = n.astype(np.uint64)
    for i in range(0, length + RUN - 1, GRAM):
        digest = C.mix64(digest * _ODD[0] + h[at + np.minimum(i, size - GRAM)])
    return doc[run], at - begin[doc[run]], n, key[run], digest, np.logical_or.reduceat(tie, run)


_ROWS = "key long, digest long, doc_id long, th long, place long"


def _cut(docs: DataFrame, length: int) -> DataFrame:
    """Strings of all texts; what is a copy within a task's batch is known at once and only reported."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "text", 1 << 19):  # arrays that fit the processor's caches
            ids, th = (b[n].to_numpy(zero_copy_only=False) for n in ("id", "th"))
            order = np.lexsort((th, ids))
            raw = [x.encode() for x in b["text"].take(pa.array(order)).to_pylist()]
            doc, start, n, key, digest, inner = strings(np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64), length)
            if not len(doc):
                continue
            _, first, inverse = np.unique(digest, return_index=True, return_inverse=True)
            known = np.ones(len(doc), bool)
            known[first] = False
            # the same text of the same document may come twice: both are its first place
            key, digest = key.view(np.int64).copy(), digest.view(np.int64)
            row = order[doc]
            lead = first[inverse.reshape(-1)]
            twin = known & (ids[row] == ids[order[doc[lead]]]) & (th[row] == th[order[doc[lead]]]) & (start == start[lead])
            keep = ~twin
            # neighbouring known strings are one report
            join = np.zeros(len(doc), bool)
            join[1:] = known[1:] & known[:-1] & (doc[1:] == doc[:-1]) & keep[1:] & keep[:-1]
            head = np.flatnonzero(keep & ~join)
            group = np.cumsum(~join & keep) - 1
            total = np.bincount(group[keep], n[keep], len(head)).astype(np.int64) if len(head) else n[:0]
            row, is_known = row[head], known[head]
            key = np.where(is_known, C.mix64(start[head].astype(np.uint64) + th[row].view(np.uint64)).view(np.int64), key[head])
            digest = np.where(is_known, key, digest[head])
            place = (start[head] << _START) | (total << _N) | (is_known.astype(np.int64) << 1) | inner[head]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, digest, ids[row], th[row], place)], names=[x.split()[0] for x in _ROWS.split(", ")])

    return docs.mapInArrow(run, _ROWS)


_SETTLED = "removed boolean, key long, doc_id long, th long, start int, n int"


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted strings -> places of later copies (removed), and the first places of strings that share a key
    or may repeat within themselves."""
    before = pivot = None  # (key, digest, doc_id, th, start) of the last row; first row of the open key
    out = True
    for b in batches:
        if not b.num_rows:
            continue
        key, digest, place = (b[n].to_numpy() for n in ("key", "digest", "place"))
        known, inner = place & 2 > 0, place & 1 > 0
        rows = np.column_stack([key, b["doc_id"].to_numpy(), b["th"].to_numpy(), place >> _START, (place >> _N) & ((1 << (_START - _N)) - 1)])
        new = np.ones(len(rows), bool)
        new[1:] = key[1:] != key[:-1]
        new[0] = before is None or key[0] != before[0]
        copy = np.zeros(len(rows), bool)
        copy[1:] = ~new[1:] & (digest[1:] == digest[:-1])
        copy[0] = not new[0] and digest[0] == before[1]
        # a repeated row (same document, same place) is no copy of itself: it is passed over
        again = np.zeros(len(rows), bool)
        again[1:] = copy[1:] & (rows[1:, 1:4] == rows[:-1, 1:4]).all(axis=1)
        again[0] = copy[0] and tuple(rows[0, 1:4].tolist()) == before[2:]
        first = ~copy & ~known
        # a key's first string is needed once another one follows
        at = np.maximum.accumulate(np.where(new, np.arange(len(rows)), -1))
        other = first & ~new
        need = other | first & inner
        heads = at[other]
        if len(heads):
            inside = heads[heads >= 0]
            need[inside] = True
        extra = [pivot] if (heads < 0).any() and not out else []
        if (heads < 0).any():
            out = True
        removed = (known | copy) & ~again
        picked = np.flatnonzero(removed | need)
        got = np.concatenate([np.array(extra, np.int64).reshape(-1, 5), rows[picked]])
        flag = np.concatenate([np.zeros(len(extra), bool), removed[picked]])
        if len(got):
            yield pa.RecordBatch.from_arrays([pa.array(flag), *(pa.array(got[:, i]) for i in range(3)), *(pa.array(got[:, i].astype(np.int32)) for i in (3, 4))], names=[x.split()[0] for x in _SETTLED.split(", ")])
        before = int(key[-1]), int(digest[-1]), *rows[-1, 1:4].tolist()
        if at[-1] >= 0:
            pivot, out = rows[at[-1]].copy(), bool(need[at[-1]])


_PIECES = "chunk long, strings binary"
_SPANS = "doc_id long, th long, start int, n int"


def _windows(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows of ``length`` bytes that start at places of ``data``."""
    h = _grams(data)
    w = np.zeros(len(at), np.uint64)
    for i in [*range(0, length - GRAM, GRAM), length - GRAM]:
        w = C.mix64(w * _ODD[0] + h[at + i])
    return w


def _collections(chunks: int, length: int):
    """Packed texts with their strings -> the strings' bytes, in one row for each collection that they go to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for big in batches:
            for b in (big.slice(i, 256) for i in range(0, big.num_rows, 256)):
                raw = [unpack.decompress(x) for x in b["packed"].to_pylist()]
                data = np.frombuffer(b"".join(raw), np.uint8)
                base = np.cumsum([0, *map(len, raw)])[:-1]
                found = b["found"].flatten()
                key, start, n, hot = (found.field(c).to_numpy(zero_copy_only=False) for c in ("key", "start", "n", "hot"))
                row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b["found"]).to_numpy())
                chunk, start, n = key % chunks, start.astype(np.int64), n.astype(np.int64)
                if hot.any():  # keys of very many strings: by single windows
                    w = np.flatnonzero(hot)
                    row_, start_ = np.repeat(row[w], n[w]), C.ragged(start[w], n[w])
                    chunk_ = (_windows(data, base[row_] + start_, length) % np.uint64(chunks)).astype(np.int64)
                    w = np.flatnonzero(~hot)
                    chunk, row, start, n = (np.concatenate([x[w], y]) for x, y in ((chunk, chunk_), (row, row_), (start, start_), (n, np.ones(len(row_), np.int64))))
                order = np.argsort(chunk, kind="stable")
                chunk, row, start, size = chunk[order], row[order], start[order], n[order] + length - 1
                ids, th = (b[c].to_numpy()[row] for c in ("doc_id", "th"))
                cut = np.flatnonzero(np.diff(chunk, prepend=-1, append=-1))
                out = [b"".join((np.int64(e - a).tobytes(), *(c[a:e].tobytes() for c in (ids, th, start, size)), data[C.ragged(base[row[a:e]] + start[a:e], size[a:e])].tobytes())) for a, e in zip(cut.tolist(), cut[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(chunk[cut[:-1]]), pa.array(out, pa.binary())], names=["chunk", "strings"])

    return run


def _recurring(data: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of each string's windows whose hash occurs twice in the collection; no other window can recur."""
    count, begin = size - length + 1, size.cumsum() - size
    at = C.ragged(begin, count)
    w = _windows(data, at, length)
    order = np.argsort(w)
    same = w[order][1:] == w[order][:-1]
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    place, head = at - np.repeat(begin, count), count.cumsum() - count
    return np.minimum.reduceat(np.where(twice, place, len(data)), head), np.maximum.reduceat(np.where(twice, place + 1, 0), head)


def _later(length: int):
    """Collections -> their windows that equal an earlier one, as spans."""

    def spans(doc, th, start, n):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(th), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc_id", "th", "start", "n"])

    def cut(data, size, doc, th, start):
        """What may recur of the strings."""
        first, end = _recurring(data, size, length)
        w = np.flatnonzero(end)
        kept = (end - first)[w] + length - 1
        return data[C.ragged((size.cumsum() - size + first)[w], kept)], kept, doc[w], th[w], (start + first)[w]

    def later(parts: tuple[bytes]) -> Iterator[pa.RecordBatch]:
        cols = [[], [], [], []]
        data = []
        for p in parts:
            m = int.from_bytes(p[:8], "little")
            for i, c in enumerate(cols):
                c.append(np.frombuffer(p, np.int64, m, 8 + 8 * m * i))
            data.append(np.frombuffer(p, np.uint8, offset=8 + 32 * m))
        doc, th, start, size = (np.concatenate(c) for c in cols)
        data, size, doc, th, start = cut(np.concatenate(data), size, doc, th, start)
        _, once = np.unique(np.column_stack([doc, th, start]), axis=0, return_index=True)  # of repeated rows, and in order of place
        joined, end = data.tobytes(), size.cumsum()
        strings = [joined[end[i] - size[i] : end[i]] for i in once.tolist()]
        size, doc, th, start = (c[once] for c in (size, doc, th, start))
        # equal strings are one for the transform; all but the earliest of them are copies as a whole
        lead: dict[bytes, int] = {}
        copy = np.array([lead.setdefault(x, i) != i for i, x in enumerate(strings)], bool)
        yield spans(*(c[copy] for c in (doc, th, start, size - length + 1)))
        if copy.all():
            return
        own = np.flatnonzero(~copy)
        data, size, doc, th, start = cut(np.frombuffer(b"".join([strings[i] for i in own.tolist()]), np.uint8), *(c[own] for c in (size, doc, th, start)))
        if not len(size):
            return
        owner, depth, common = bwt.build(data, size.cumsum() - size, size)
        group = np.cumsum(common < length)
        full = np.flatnonzero(depth >= length)
        owner, group = owner[full], group[full]
        at = start[owner] + size[owner] - depth[full]
        order = np.lexsort((at, th[owner], doc[owner], group))
        owner, group, at = owner[order], group[order], at[order]
        w = 1 + np.flatnonzero(group[1:] == group[:-1])
        w = w[np.lexsort((at[w], owner[w]))]
        o, a = owner[w], at[w]
        h = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (a[1:] != a[:-1] + 1)])) if len(w) else w
        yield spans(doc[o[h]], th[o[h]], a[h], np.diff(np.append(h, len(w))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (parts,) in C.side_by_side(batches, "chunk", "strings"):
            yield from later(parts)

    return run


def _remainder(length: int):
    """Texts with their removed windows -> what is left of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for doc, th, packed, found in zip(*(b[n].to_pylist() for n in ("doc_id", "th", "packed", "found"))):
                text = np.frombuffer(unpack.decompress(packed), np.uint8)
                mark = np.zeros(len(text) + 1, np.int64)
                start = np.array([s["start"] for s in found])
                np.add.at(mark, start, 1)
                np.add.at(mark, start + np.array([s["n"] for s in found]) + length - 1, -1)
                gone = mark.cumsum()[:-1] > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((doc, th, int(gone.sum()), spans, hashlib.sha256(text[~gone].tobytes()).hexdigest()))
            if rows:
                types = (pa.int64(),) * 4 + (pa.string(),)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "th", "removed", "spans", "sha"])

    return run


def dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, chunk_bytes: int = 4 << 20, hot: int = 20_000) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 of its text without the removed bytes.

    A byte goes when a string of ``length`` bytes over it also starts earlier: in a document with a smaller id, or in
    its own. Documents of null ids come last, documents of one id in the order of a hash of their texts; repeated rows
    (same id and text) are one document and get the same result. Null texts are empty. Extra columns are left out.
    ``length`` is at least 64 and at most 190. Keys of more than ``hot`` strings are split by windows.
    """
    if not 64 <= length <= 190:
        raise ValueError("length from 64 to 190")
    docs = C.keyed(df, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("th", F.xxhash64("text"))
    docs = docs.withColumn("id", F.coalesce("doc_id", F.lit(NULL_ID)))
    cut = _cut(docs.filter(F.octet_length("text") >= length).select("id", "th", "text"), length)
    order = ("key", "digest", "doc_id", "th", "place")
    settled = C.materialize(cut.repartition("key").sortWithinPartitions(*order).mapInArrow(_settle, _SETTLED), "suffix-settled")
    need = settled.filter("NOT removed").select("key", "doc_id", "th", "start", "n")
    many = C.materialize(need.groupBy("key").agg(F.count("*").alias("c")).filter(F.col("c") > hot).select("key", F.lit(True).alias("hot")), "suffix-hot")
    need = need.withColumn("hot", F.lit(False)) if many.isEmpty() else need.join(many, "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    by_doc = C.materialize(need.groupBy("doc_id", "th").agg(F.collect_set(F.struct("key", "start", "n", "hot")).alias("found")), "suffix-need")
    place = ["doc_id", "th"]
    base = docs.select(F.col("id").alias("doc_id"), "th", "text")
    total = by_doc.agg(F.coalesce(F.sum(F.aggregate("found", F.lit(0).cast("long"), lambda a, s: a + F.when(s["hot"], s["n"] * length).otherwise(s["n"] + length))), F.lit(0))).first()[0]
    spans = settled.filter("removed").select(*place, "start", "n")
    if total:
        chunks = max(1, -(-total // chunk_bytes))
        texts = C.packed_texts(base, by_doc, place).join(by_doc, place)
        pieces = texts.mapInArrow(_collections(chunks, length), _PIECES)
        spans = spans.union(pieces.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_later(length), _SPANS))
    removed = C.materialize(spans.groupBy(*place).agg(F.collect_list(F.struct("start", "n")).alias("found")), "suffix-spans")
    C.discard(settled, many, by_doc)
    changed = C.packed_texts(base, removed, place).join(removed, place).mapInArrow(_remainder(length), "doc_id long, th long, removed long, spans long, sha string")
    changed = changed.dropDuplicates(place)
    whole = docs.select(F.col("id").alias("doc_id"), "th", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    out = whole.join(changed, place, "left")
    return out.select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "n_bytes", F.coalesce("removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"))


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated strings of 100 bytes and more in all documents."""
    return dedup(C.documents(spark, sf_dir))
