"""N-gram Jaccard join (2): adaptive multi-match prefixes over word shingles.

Every document is its set of distinct ``k``-word shingles (64-bit hashes). Under one global order of shingles, rare
ones first, two documents with enough overlap share at least l shingles among the first n - t + l of each (n: size of
the set, t: the overlap a partner needs at least). Each document picks its own l: a longer prefix costs more list
entries but asks for more shared ones before a pair is verified, and the estimated cost decides. A pair is a candidate
when it shares min(l, l') prefix shingles; candidates are verified exactly.

The order needs frequencies, and those are counted exactly, by shuffles and without a table of fixed size:

1. Of each set the smallest hashes (its region) are counted over all sets. A set with a partner must have a certain
   number of hashes there that other sets have in theirs, too; most sets have not and leave.
2. The remaining sets' whole shingles are counted. Frequencies go back to the sets, which then know their prefixes.

Hashes travel packed: sorted runs of a bucket of hash values from a run of documents. They are cut to 32 bits within
the bucket; two that fall together only add candidates.

Links are only needed up to connectivity. Candidates go first through each list's pivot (a star, linear in the list's
length); what is then in one component needs no more work, and the remaining lists give pairs across components only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .graph import components

#: What a verification costs, in list entries.
VERIFY = 2.0
#: Lists of more sets than this are split, each part with a pivot of its own.
SHORT = 4096
#: A region is so many times what a set may have beyond a partner, and a few more.
REGION, EXTRA = 3, 8
#: Names of rows (16 bytes each) that are sent to all tasks at most.
SENT = 2_000_000
#: Hashes, and sets, that travel together.
TOKENS, SETS = 1 << 20, 60_000


def fingerprint(s: np.ndarray) -> int:
    """Signed 64-bit name of a set. Among n distinct sets, two share a name with a chance of about n^2 / 2^65."""
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)) - (1 << 63)


class Need:
    """What similar sets have in common, by their sizes; remembers sizes."""

    def __init__(self, percent: int):
        self.percent, self.known = percent, {}

    def overlap(self, n):
        """A partner of a set of n shares at least so many."""
        return -(-n * self.percent // 100)

    def shared(self, n, m):
        """Sets of n and m that link share at least so many."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def region(self, n):
        return np.minimum(n, REGION * (n - self.overlap(n)) + EXTRA)

    def least(self, n: int) -> int:
        """A set of n with a partner has at least so many hashes in its region that the partner has in its own.

        A partner of m shares o = shared(n, m) or more. A shared hash has at most m - o others
        before it there that are not before it here, so those among the first region(m) - (m - o) are in both regions.
        """
        if n not in self.known:
            m = np.arange(self.overlap(n), 100 * n // self.percent + 1)
            o = self.shared(n, m)
            self.known[n] = int((np.minimum(self.region(n), self.region(m) - (m - o)) - (n - o)).min())
        return self.known[n]


def _planes(x: np.ndarray) -> bytes:
    """Byte 0 of all numbers, then byte 1 of all, and so on: small numbers leave zeros side by side."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _numbers(raw: np.ndarray, dtype: str) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _pack(tokens: np.ndarray, *others: np.ndarray) -> bytes:
    """Sorted 32-bit hashes as differences, and columns beside them."""
    return _planes(np.diff(tokens, prepend=np.uint32(0)).astype("<u4")) + b"".join(map(_planes, others))


def _unpack(parts: list[bytes], *others: str) -> tuple[np.ndarray, ...]:
    """(number of rows of each part, hashes, the other columns) of packed parts, end to end."""
    dtypes, cols, size = ("<u4", *others), [[] for _ in range(1 + len(others))], []
    width = sum(np.dtype(d).itemsize for d in dtypes)
    for p in parts:
        raw, n, at = np.frombuffer(p, np.uint8), len(p) // width, 0
        size.append(n)
        for c, d in zip(cols, dtypes):
            c.append(_numbers(raw[at : (at := at + n * np.dtype(d).itemsize)], d))
        cols[0][-1] = np.cumsum(cols[0][-1], dtype=np.uint32)
    return np.array(size), *(np.concatenate(c) for c in cols)


class _Runs:
    """Collects sets, gives rows (bucket, batch, payload): the hashes of a bucket with the sets' places in the batch."""

    def __init__(self, bits: int):
        self.bits, self.serial, self.part = bits, 0, TaskContext.get().partitionId()
        self._clear()

    def _clear(self):
        self.images, self.count, self.batch = [], 0, self.part << 20 | self.serial
        self.serial += 1

    def add(self, image: np.ndarray) -> int:
        """Takes the cut hashes of a set; returns the set's place in the batch."""
        self.images.append(image)
        self.count += len(image)
        return len(self.images) - 1

    def full(self) -> bool:
        return self.count >= TOKENS or len(self.images) >= SETS

    def rows(self) -> list[tuple[int, int, bytes]]:
        if not self.images:
            return []
        token = np.concatenate(self.images)
        local = np.repeat(np.arange(len(self.images)), [len(x) for x in self.images]).astype("<u2")
        order = np.argsort(token, kind="stable")
        token, local = token[order], local[order]
        bucket = (token >> np.uint64(32)).astype(np.int64)
        cut = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        low, batch = token.astype(np.uint32), self.batch
        out = [(int(bucket[a]), batch, _pack(low[a:b], local[a:b])) for a, b in zip(cut, cut[1:])]
        self._clear()
        return out


def _image(s: np.ndarray, bits: int) -> np.ndarray:
    """Hashes cut to a bucket of ``bits`` bits and 32 bits within it, in order, distinct."""
    x = s >> np.uint64(32 - bits)
    return x[np.diff(x, prepend=~x[:1]) != 0]


def _rows(rows: list[tuple], types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types.values())], names=list(types))


def _bits(docs: DataFrame) -> int:
    """Binary digits of the number of buckets, 8 at least; a bucket has about 4 MB of the input, so its hashes fit a task."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 12 if size >= 1 << 60 else max(8, (size >> 22).bit_length())  # that size stands for an unknown one


_L, _I, _B = pa.int64(), pa.int32(), pa.binary()
_INFO = {"doc_id": _L, "n": _L, "fp": _L, "th": _L, "rk": _L, "own": _L, "least": _I, "bucket": _I, "batch": _L, "payload": _B}
_NAMES = {_L: "long", _I: "int", _B: "binary", pa.bool_(): "boolean"}


def _ddl(types: dict) -> str:
    return ", ".join(f"{n} {_NAMES[t]}" for n, t in types.items())


def _describe(docs: DataFrame, k: int, percent: int, bits: int) -> DataFrame:
    """A row per document (doc_id, size and name of the set, hashes of text and row) and the regions' packed hashes.

    ``own`` names the set in the packed rows, ``least`` is what it needs there; copies within a task leave them null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, need, seen = _Runs(bits), Need(percent), set()

        def packed():
            rows = runs.rows()
            if rows:
                yield _rows([(None,) * 7 + r for r in rows], _INFO)

        for b in C.slices(batches, "text", 1 << 19):
            rows = []
            for doc, th, rk, s in zip(b["doc_id"].to_pylist(), b["th"].to_pylist(), b["rk"].to_pylist(), C.shingle_sets([t or "" for t in b["text"].to_pylist()], k)):
                fp, own, least = fingerprint(s) if len(s) else None, None, None
                if fp is not None and fp not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(fp)
                    image = _image(s, bits)
                    own = runs.batch << 16 | runs.add(image[: int(need.region(len(s)))])
                    least = need.least(len(s)) - (len(s) - len(image))
                rows.append((doc, len(s), fp, th, rk, own, least, None, None, None))
                if runs.full():
                    yield from packed()
            yield _rows(rows, _INFO)
        yield from packed()

    return C.materialize(docs.mapInArrow(run, _ddl(_INFO)), "jaccard-regions")


_FOUND = {"own": _L, "shared": _L}


def _shared(regions: DataFrame) -> DataFrame:
    """(own, shared): how many hashes of a region other regions have, too."""
    back = {"batch": _L, "payload": _B}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in C.side_by_side(batches, "bucket", "batch", "payload"):
            ids, parts = rows
            size, token, local = _unpack(parts, "<u2")
            order = np.argsort(token, kind="stable")
            same = token[order][1:] == token[order][:-1]
            twice = np.zeros(len(token), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            end = size.cumsum()
            out = [(i, x.tobytes()) for i, a, b in zip(ids, (end - size).tolist(), end.tolist()) if len(x := local[a:b][twice[a:b]])]
            if out:
                yield _rows(out, back)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (parts,) in C.side_by_side(batches, "batch", "payload"):
            n = np.bincount(np.frombuffer(b"".join(parts), "<u2"))
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(batch << 16 | at), pa.array(n[at])], names=list(_FOUND))

    packed = regions.filter("bucket IS NOT NULL").select("bucket", "batch", "payload")
    found = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, _ddl(back))
    return found.repartition("batch").sortWithinPartitions("batch").mapInArrow(add, _ddl(_FOUND))


def _texts(docs: DataFrame, alive: DataFrame) -> DataFrame:
    """(fp, packed text) of the sets that may have a partner, one text each, as a written table.

    ``alive`` names a row for each set. That side is counted; up to ``SENT`` rows go to all tasks, more are joined by a
    shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, seen = zstandard.ZstdCompressor(level=3), set()
        for b in batches:
            rows = []
            for fp, text in zip(b["fp"].to_pylist(), b["text"].to_pylist()):
                if fp not in seen:
                    seen.add(fp)
                    rows.append((fp, pack.compress(text.encode())))
            if rows:
                yield _rows(rows, {"fp": _L, "packed": _B})

    few = alive.count() <= SENT
    some = docs.select("text", "rk").join(F.broadcast(alive) if few else alive, "rk").select("fp", "text").mapInArrow(run, "fp long, packed binary")
    return C.materialize(some.dropDuplicates(["fp"]), "jaccard-texts")


def prefix(n: int, image: int, often: np.ndarray, need: Need, longest: int | None = None) -> tuple[int, int]:
    """(entries of the prefix, its l) of a set of n.

    ``often``: frequencies of its recurring hashes in order, which come after the image - len(often) that are its own.
    """
    alone, base, equal = image - len(often), n - need.overlap(n), n - need.shared(n, n)
    most = min(longest or n, need.overlap(n))
    meets = np.concatenate([[0], (often - 1).cumsum()])
    met = meets[np.clip(np.arange(equal + 1, equal + most + 1) - alone, 0, len(often))]  # by a partner of that size
    l = 1 + int(np.argmin(met * (1 + VERIFY / np.arange(1, most + 1))))  # at most met / l pairs share l
    return max(0, min(base + l, image) - alone), l


_ENTRY = {"token": _L, "part": _L, "fp": _L, "n": _I, "l": _I, "place": _I, "alone": _I}


def _entries(texts: DataFrame, k: int, percent: int, bits: int) -> DataFrame:
    """Entries (token, part, fp, n, l, place, alone) of all lists: the sets' prefixes.

    Hashes of one set alone are left out; ``alone`` is their number.
    """
    there = {"bucket": _I, "batch": _L, "head": pa.bool_(), "payload": _B}
    back = {"batch": _L, "bucket": _I, "payload": _B}

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, runs, head = zstandard.ZstdDecompressor(), _Runs(bits), []

        def packed():
            if head:
                batch = runs.batch
                raw = b"".join(_planes(np.array(c, t)) for c, t in zip(zip(*head), ("<i8", "<u4", "<u4")))
                yield _rows([(batch & 255, batch, True, raw)] + [(b, i, False, p) for b, i, p in runs.rows()], there)
                head.clear()

        for big in batches:
            for b in (big.slice(i, 128) for i in range(0, big.num_rows, 128)):
                for fp, s in zip(b["fp"].to_pylist(), C.shingle_sets([unpack.decompress(x).decode() for x in b["packed"].to_pylist()], k)):
                    image = _image(s, bits)
                    runs.add(image)
                    head.append((fp, len(s), len(image)))
                    if runs.full():
                        yield from packed()
        yield from packed()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (ids, heads, parts) in C.side_by_side(batches, "bucket", "batch", "head", "payload"):
            out = [(i, -1, p) for i, h, p in zip(ids, heads, parts) if h]
            own = [(i, p) for i, h, p in zip(ids, heads, parts) if not h]
            if own:
                size, token, local = _unpack([p for _, p in own], "<u2")
                _, inverse, times = np.unique(token, return_inverse=True, return_counts=True)
                often = times[inverse].astype("<u4")
                end = size.cumsum()
                for (i, _), a, b in zip(own, (end - size).tolist(), end.tolist()):
                    w = a + np.flatnonzero(often[a:b] > 1)
                    if len(w):
                        out.append((i, bucket, _pack(token[w], local[w], often[w])))
            yield _rows(out, back)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need = Need(percent)
        for _, (buckets, parts) in C.side_by_side(batches, "batch", "bucket", "payload"):
            raw = np.frombuffer(parts[0], np.uint8)
            m = len(raw) // 16
            fps, sizes, images = _numbers(raw[: 8 * m], "<i8"), _numbers(raw[8 * m : 12 * m], "<u4").astype(np.int64), _numbers(raw[12 * m :], "<u4").astype(np.int64)
            if len(parts) == 1:
                continue
            size, low, local, often = _unpack(list(parts[1:]), "<u2", "<u4")
            token = np.repeat(np.array(buckets[1:], np.int64), size) << 32 | low
            order = np.lexsort((token, often, local))
            token, often = token[order], often[order].astype(np.int64)
            end = np.bincount(local, minlength=m).cumsum()
            cols: list[list] = [[] for _ in _ENTRY]
            for i, (a, b) in enumerate(zip([0, *end.tolist()], end.tolist())):
                if a < b:
                    n = int(sizes[i])
                    size_, l = prefix(n, int(images[i]), often[a:b], need)
                    if size_:
                        w = slice(a, a + size_)
                        split = -(-often[w] // SHORT)
                        alone = int(images[i]) - (b - a)
                        for c, x in zip(cols, (token[w], np.where(split > 1, 1 + int(fps[i]) % split, 0), np.full(size_, fps[i]), np.full(size_, n), np.full(size_, l), alone + np.arange(size_), np.full(size_, alone))):
                            c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(t.to_pandas_dtype())) for c, t in zip(cols, _ENTRY.values())], names=list(_ENTRY))

    packed = texts.mapInArrow(emit, _ddl(there)).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, _ddl(back))
    return packed.repartition("batch").sortWithinPartitions("batch", "bucket").mapInArrow(choose, _ddl(_ENTRY))


def _verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, counted exactly."""
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, last, left = zstandard.ZstdDecompressor(), None, None
        for big in batches:
            for b in (big.slice(i, 128) for i in range(0, big.num_rows, 128)):
                a, found = b["a"].to_pylist(), []
                lead = [i for i, x in enumerate(a) if x != (a[i - 1] if i else last)]
                texts_ = [unpack.decompress(x).decode() for x in (*(b["ta"][i].as_py() for i in lead), *b["tb"].to_pylist())]
                sets = C.shingle_sets(texts_, k)
                lead = dict(zip(lead, sets))
                for i, right in enumerate(sets[len(lead) :]):
                    left = lead.get(i, left)
                    both = len(np.intersect1d(left, right, assume_unique=True))
                    found.append(100 * both >= percent * (len(left) + len(right) - both))
                last = a[-1]
                yield b.select(["a", "b"]).filter(pa.array(found))

    with_b = pairs.join(texts.select(F.col("fp").alias("b"), F.col("packed").alias("tb")), "b")
    both = with_b.join(texts.select(F.col("fp").alias("a"), F.col("packed").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _sizes_fit(n: str, m: str, percent: int):
    return (100 * F.least(n, m)) >= (percent * F.greatest(n, m))


def links(df: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id.

    Two rows link when 100 * intersection >= percent * union of their shingle sets; component_id is the smallest doc_id
    that links reach, itself included. Equal sets are one node throughout, so copies cost a row each and no pairs.
    Null and wordless texts have no shingles and link with nothing: their component is their own id. Repeated rows
    stay, null ids count in no minimum, extra columns are left out, an empty table gives an empty result.
    """
    return _grouped(df, k, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def _candidates(x: DataFrame, y: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share min(l, l') entries and whose remaining hashes could suffice.

    A pair's sizes tell the overlap t that it needs, mostly more than either set alone needs of any partner; only entries
    among the first n - t + l of each set count.
    """
    early = lambda s: (F.col("n" + s) - F.col("place" + s) + F.col("l" + s) - 1) * (100 + percent) >= percent * (F.col("nx") + F.col("ny"))
    pairs = x.join(y, "token").filter((F.col("fpx") < F.col("fpy")) & (F.col("cx") != F.col("cy")) & _sizes_fit("nx", "ny", percent) & early("x") & early("y"))
    got = pairs.groupBy("fpx", "fpy", "nx", "ny").agg(F.count("*").alias("shared"), F.min(F.least("lx", "ly")).alias("l"), F.max("placex").alias("px"), F.max("placey").alias("py"))
    most = F.col("shared") + F.least(F.col("nx") - 1 - F.col("px"), F.col("ny") - 1 - F.col("py"))
    return got.filter((F.col("shared") >= F.col("l")) & (most * (100 + percent) >= percent * (F.col("nx") + F.col("ny")))).select(F.col("fpx").alias("a"), F.col("fpy").alias("b"))


def _grouped(df: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``links`` with the hash of the text (th) and the name of the group (label; null without words)."""
    docs = C.keyed(df, id_col, text_col).withColumn("th", F.xxhash64("text")).withColumn("rk", F.xxhash64("doc_id", "text"))
    bits = _bits(docs)
    regions = _describe(docs, k, percent, bits)
    info = regions.filter("bucket IS NULL").select("doc_id", "n", "fp", "th", "rk", "own", "least")
    info = info.join(_shared(regions), "own", "left").withColumn("alive", F.col("least") <= F.coalesce("shared", F.lit(0)))
    info = C.materialize(info.select("doc_id", "n", "fp", "th", "rk", "alive"), "jaccard-sets")
    C.discard(regions)
    alive = C.materialize(info.filter("alive").groupBy("fp").agg(F.min("rk").alias("rk")), "jaccard-alive")
    texts = _texts(docs, alive)
    C.discard(alive)
    # A list's pivot is the set with least of its own: of a group of copies the one that was edited least.
    by = Window.partitionBy("token", "part").orderBy("alone", "fp")
    pivots = [F.first(c).over(by).alias("p" + c) for c in ("fp", "n", "l")]
    lists = C.materialize(_entries(texts, k, percent, bits).select("*", *pivots).drop("alone"), "jaccard-lists")
    # Entries shared with the pivot are counted over all lists that it leads. Pivots of one list's parts meet the first of them.
    star = lists.filter("fp <> pfp").groupBy(F.col("pfp").alias("a"), F.col("fp").alias("b"), "n", "l", "pn", "pl").agg(F.count("*").alias("shared"))
    star = star.filter((F.col("shared") >= F.least("l", "pl")) & _sizes_fit("n", "pn", percent)).select("a", "b")
    heads = lists.filter("part > 0").groupBy("token").agg(F.min("pfp").alias("a")).join(lists.filter("part > 0").select("token", F.col("pfp").alias("b")).distinct(), "token").filter("a <> b").select("a", "b")
    star = C.materialize(star.union(heads).distinct(), "jaccard-star")
    found = C.materialize(_verify(star, texts, k, percent), "jaccard-links")
    C.discard(star)
    label = components(found)
    # What remains: lists that still hold several components.
    known = lists.join(label.select(F.col("node").alias("fp"), F.col("label").alias("c")), "fp", "left").withColumn("c", F.coalesce("c", "fp"))
    open_ = known.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("token")
    rest = C.materialize(known.join(open_, "token").select("token", "fp", "n", "l", "c", "place"), "jaccard-rest")
    C.discard(lists)
    x, y = (rest.select("token", *(F.col(n).alias(n + side) for n in ("fp", "n", "l", "c", "place"))) for side in "xy")
    across = C.materialize(_candidates(x, y, percent), "jaccard-across")
    C.discard(rest)
    if not across.isEmpty():
        more = _verify(across, texts, k, percent)
        label = components(C.materialize(found.union(more), "jaccard-links"))
    of = info.filter("fp IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("first")).join(label.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    of = C.materialize(of, "jaccard-names")
    C.discard(texts, across)
    linked = of.filter("label <> fp").select("label").distinct()  # most sets are alone: only the others meet again
    group = of.join(linked, "label", "left_semi").groupBy("label").agg(F.min("first").alias("component_id"))
    of = of.join(group, "label", "left").select("fp", "label", F.coalesce("component_id", "first").alias("component_id"))
    out = info.select("doc_id", F.col("n").alias("n_shingles"), "fp", "th").join(of, "fp", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "th", "label")


def deduplicate(df: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that lead their group: those with the smallest id of their component.

    Rows without words belong to no group and stay, as do rows with null ids. A decision holds for an id and a text, so
    an id may lead with one text and go with another. Where several rows of a group have its smallest id, the one with
    the smallest hash of the text stays, then of all columns.
    """
    own = C.materialize(_grouped(df, k, percent, id_col, text_col), "jaccard-rows")
    key = [F.col("doc_id").alias("__id"), F.col("th").alias("__th")]
    leads = own.filter("label IS NOT NULL AND doc_id = component_id")
    several = leads.groupBy("label").agg(F.min("th").alias("least"), F.count("*").alias("rows")).filter("rows > 1")
    again = C.materialize(leads.join(several, "label").select(*key, (F.col("th") == F.col("least")).alias("__stays")).distinct(), "jaccard-again")
    gone = own.filter("doc_id <> component_id").select(*key).distinct()
    on = (F.col(id_col).cast("long") == F.col("__id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__th"))
    if again.isEmpty():
        return df.join(gone, on, "left_anti")
    once = df.join(again.filter("__stays").select("__id", "__th"), on).groupBy("__id", "__th").agg(F.min_by(F.struct(*df.columns), F.xxhash64(*df.columns)).alias("__row")).select("__row.*")
    return df.join(gone.union(again.select("__id", "__th")), on, "left_anti").unionByName(once)


def op2_jaccard(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return links(C.documents(spark, sf_dir), k=4, percent=85)
