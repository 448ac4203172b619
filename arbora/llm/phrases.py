"""Phrase collocation mining (13): merged count-min sketches, an exact second pass over what survives, scores, subsumption."""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: A-Z become a-z, the characters that end a piece become a full stop, tabs become spaces.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?" or 10 <= b <= 13 else 32 if b == 9 else b for b in range(256))
#: Rows of the sketch, and the most cells (2 ** LARGEST) that one merging task holds.
ROWS, LARGEST = 2, 24


class Grams:
    """The distinct runs of one to three words of a block of texts, with exact counts and a 64-bit hash each.

    Words are numbered by language; pairs and triples are numbered by whole numbers made of those, so counts are exact.
    Hashes serve the sketch only, where one that two runs share can only raise an estimate.
    """

    def __init__(self, langs: list[str], texts: list[str | None]):
        known: dict[str, dict[bytes, int]] = {}
        self.words, self.langs, marks, ids = [b"."], [""], [np.uint64(0)], array("q", [0])
        for lang, text in zip(langs, texts):
            at = known.setdefault(lang, {b".": 0})
            found = text.encode().translate(_BYTES).replace(b".", b" . ").split(b" ") if text else []
            for w in found:
                if w:
                    n = at.get(w)
                    if n is None:
                        at[w] = n = len(self.words)
                        self.words.append(w)
                        self.langs.append(lang)
                    ids.append(n)
            ids.append(0)
        seq, v = np.frombuffer(ids, np.int64), len(self.words)
        self.v = v
        hash_ = C.WordHashes().hash
        marks = np.fromiter((hash_(b"%b\0%b" % (lang.encode(), w)) for lang, w in zip(self.langs, self.words)), np.uint64, v)
        one = np.bincount(seq, minlength=v)
        one[0] = 0
        word = seq > 0
        p2 = np.flatnonzero(word[:-1] & word[1:])
        self.two, inverse, two = np.unique(seq[p2] * v + seq[p2 + 1], return_inverse=True, return_counts=True)
        of_two = np.full(len(seq), -1, np.int64)
        of_two[p2] = inverse
        del inverse, word
        p3 = p2[of_two[np.minimum(p2 + 1, len(seq) - 1)] >= 0]
        self.three, first, three = np.unique(of_two[p3] * v + seq[p3 + 2], return_index=True, return_counts=True)
        #: for each triple the numbers of its two pairs
        self.head, self.tail = of_two[p3[first]], of_two[p3[first] + 1]
        self.counts = np.concatenate([one, two, three])
        a, b = self.two // v, self.two % v
        pair = C.mix64(marks[a] * C._ROT[0] + marks[b] + C._ROT[1])
        triple = C.mix64(C.mix64(pair[self.head] + C._ROT[2]) * C._ROT[0] + marks[self.three % v])
        self.hash = np.concatenate([marks, pair, triple])

    def cells(self, row: int, bits: int) -> np.ndarray:
        """The cell of each run in a row of 2 ** ``bits`` cells."""
        return C.mix64(self.hash + np.uint64(row + 1) * C._ROT[3]) >> np.uint64(64 - bits)

    def kept(self, ok: np.ndarray) -> tuple[list[str], list[bytes], np.ndarray, np.ndarray]:
        """(language, phrase, count, hash) of the runs that may be frequent; a run needs its parts to be."""
        v, n2 = self.v, len(self.two)
        words, one = self.words, ok[:v] & (self.counts[:v] > 0)
        two = ok[v : v + n2] & one[self.two // v] & one[self.two % v]
        three = ok[v + n2 :] & two[self.head] & two[self.tail]
        i1, i2, i3 = map(np.flatnonzero, (one, two, three))
        a2, b2 = (self.two // v).tolist(), (self.two % v).tolist()
        f1 = i1.tolist()
        f2 = [(a2[i], b2[i]) for i in i2.tolist()]
        f3 = [(a2[h], b2[h], c) for h, c in zip(self.head[i3].tolist(), (self.three[i3] % v).tolist())]
        phrases = [words[i] for i in f1] + [b"%b %b" % (words[a], words[b]) for a, b in f2] + [b"%b %b %b" % (words[a], words[b], words[c]) for a, b, c in f3]
        langs = [self.langs[i] for i in f1] + [self.langs[x[0]] for x in f2] + [self.langs[x[0]] for x in f3]
        at = np.concatenate([i1, v + i2, v + n2 + i3])
        return langs, phrases, self.counts[at], self.hash[at]


def _pack(cells: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending cells and their counts: gaps by byte plane, then the counts, compressed."""
    import zstandard

    gaps = np.diff(cells, prepend=np.uint64(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(gaps.tobytes() + counts.astype(np.uint8).tobytes())


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    n = len(raw) // 5
    gaps = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view("<u4").ravel()
    return gaps.cumsum(dtype=np.int64), raw[4 * n :]


def _pack_runs(phrases: list[bytes], counts: np.ndarray) -> bytes:
    """Phrases (no line ends in them) and their counts, compressed; neighbours that share words make it small."""
    import zstandard

    text, planes = b"\n".join(phrases), counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(len(counts).to_bytes(8, "little") + planes + text)


def _unpack_runs(packed: bytes) -> tuple[list[bytes], list[int]]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(packed)
    end = 8 + 8 * int.from_bytes(raw[:8], "little")
    counts = np.ascontiguousarray(np.frombuffer(raw[8:end], np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return raw[end:].split(b"\n"), counts.tolist()


def frequent(docs: DataFrame, least: int = 10, block_bytes: int = 6 << 20, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, k, phrase, a): exact counts of all runs of k = 1 to 3 words found ``least`` times or more in a language;
    k = 0 gives each language's number of words.

    Rows are dealt by chance to blocks of about ``block_bytes`` and written, so both passes see the same blocks and
    no copy group or language is one. First pass: each block gives a count-min sketch of two rows, as packed lists of the cells
    it fills. A row has a cell for every word of the input or two, cut into ranges; each range is merged in a task
    of its own, which sends back to each block one bit a cell: whether the sum reaches ``least``. Sums are never too
    low, so nothing frequent is lost. Second pass: each block counts exactly, and sends on by name, only runs whose cells and
    whose parts all survive, dealt by hash to as many parts as grow with the input. Nothing is broadcast; shuffled are the texts, about two bytes
    for each distinct run of a block, the bits, and the survivors, packed.
    """
    if not 1 <= least <= 255:
        raise ValueError("least must be from 1 to 255")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    bits = min(48, max(10, math.ceil(math.log2(total / 6 + 1))))
    low = min(LARGEST, bits - 6)  # 64 ranges a row at least
    parts = max(48, blocks // 4)
    path = C.fresh(spark, "phrases-blocks")
    texts.withColumn("block", F.floor(F.rand(13) * blocks).cast("int")).write.option("compression", "zstd").parquet(path)
    dealt = spark.read.schema("lang string, text string, block int").parquet(path)

    def edges(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ranges that hold some of the ascending cells, where each begins and the end)."""
        ranges = (cells >> np.uint64(low)).astype(np.int64)
        head = np.flatnonzero(np.diff(ranges, prepend=-1))
        return ranges[head], np.append(head, len(cells))

    def grams(t: pa.Table) -> Grams:
        return Grams(t["lang"].to_pylist(), t["text"].to_pylist())

    def sketch(t: pa.Table) -> pa.Table:
        g, out = grams(t), []
        for row in range(ROWS):
            cells = g.cells(row, bits)
            order = np.argsort(cells)
            cells = cells[order]
            head = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
            counts = np.minimum(np.add.reduceat(g.counts[order], head), 255)
            cells = cells[head]
            which, at = edges(cells)
            for s, a, b in zip(which.tolist(), at[:-1].tolist(), at[1:].tolist()):
                out.append((t["block"][0].as_py(), row, s, _pack(cells[a:b] - np.uint64(s << low), counts[a:b])))
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["block", "row", "range", "cells"])

    def merge(t: pa.Table) -> pa.Table:
        total_ = np.zeros(1 << low, np.uint8)
        for x in t["cells"]:
            at, n = _unpack(x.as_py())
            total_[at] = np.minimum(total_[at].astype(np.uint16) + n, 255)
        reach = total_ >= least
        bits_ = [np.packbits(reach[_unpack(x.as_py())[0]]).tobytes() for x in t["cells"]]
        return pa.table([t["block"], t["row"], t["range"], pa.array(bits_, pa.binary())], names=["block", "row", "range", "bits"])

    def exact(t: pa.Table, sent: pa.Table) -> pa.Table:
        names, kinds = ["part", "lang", "runs"], (pa.int32(), pa.string(), pa.binary())
        if not t.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        g = grams(t)
        ok = np.ones(len(g.hash), bool)
        by = {(r, s): b for r, s, b in zip(sent["row"].to_pylist(), sent["range"].to_pylist(), sent["bits"].to_pylist())}
        for row in range(ROWS):
            cells, inverse = np.unique(g.cells(row, bits), return_inverse=True)
            which, at = edges(cells)
            reach = [np.unpackbits(np.frombuffer(by[row, s], np.uint8), count=n) for s, n in zip(which.tolist(), np.diff(at).tolist())]
            ok &= np.concatenate(reach)[inverse].astype(bool)
            del cells, inverse, reach
        langs, phrases, n, part = g.kept(ok)
        words: dict[str, int] = {}
        for lang, c in zip(g.langs[1:], g.counts[1 : g.v].tolist()):
            words[lang] = words.get(lang, 0) + c
        del g, ok, by
        langs, phrases = langs + list(words), phrases + [b""] * len(words)
        n = np.concatenate([n, np.fromiter(words.values(), np.int64, len(words))])
        part = np.concatenate([(part % np.uint64(parts)).astype(np.int64), np.zeros(len(words), np.int64)])
        number = {x: i for i, x in enumerate(dict.fromkeys(langs))}
        lang_no = np.fromiter(map(number.__getitem__, langs), np.int64, len(langs))
        group = part * max(len(number), 1) + lang_no
        order = np.argsort(group, kind="stable")  # within a group the runs of one first word stay together
        at = np.flatnonzero(np.diff(group[order], prepend=-1, append=-1))
        out = [(int(part[order[x]]), langs[order[x]], _pack_runs([phrases[i] for i in order[x:y].tolist()], n[order[x:y]])) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out) if out else ((), (), ()), kinds)], names=names)

    def total_up(t: pa.Table) -> pa.Table:
        sums: dict[str, dict[bytes, int]] = {}
        for lang, packed in zip(t["lang"], t["runs"]):
            own = sums.setdefault(lang.as_py(), {})
            for x, c in zip(*_unpack_runs(packed.as_py())):
                own[x] = own.get(x, 0) + c
        rows = [(lang, x.count(b" ") + 1 if x else 0, x.decode(), c) for lang, own in sums.items() for x, c in own.items() if c >= least or not x]
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows) if rows else ((),) * 4, kinds)], names=["lang", "k", "phrase", "a"])

    sketches = dealt.groupBy("block").applyInArrow(sketch, "block int, row int, range long, cells binary")
    reached = sketches.groupBy("row", "range").applyInArrow(merge, "block int, row int, range long, bits binary")
    some = dealt.groupBy("block").cogroup(reached.groupBy("block")).applyInArrow(exact, "part int, lang string, runs binary")
    return some.groupBy("part").applyInArrow(total_up, "lang string, k int, phrase string, a long")


def _wide(name: str):
    return F.col(name).cast("decimal(19,0)")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, k, phrase, a, l, r, score) of all candidates (k of 2 or 3) of ``frequent``, each by its lowest-scoring cut."""
    some = counts.filter("k >= 2").withColumn("cut", F.explode(F.expr("sequence(1, k - 1)")))
    some = some.withColumn("left", F.expr("substring_index(phrase, ' ', cut)")).withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    parts = counts.filter("k IN (1, 2)")
    some = some.join(parts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    # decimals of 38 digits: exact to 10 ** 16 occurrences; the quotient is at most a million, as a <= l and a <= r
    some = some.withColumn("up", F.lit(1_000_000).cast("decimal(7,0)") * (_wide("a") * _wide("a")).cast("decimal(31,0)")).withColumn("down", _wide("l") * _wide("r"))
    lowest = F.min(F.struct(F.expr("up div down").alias("score"), "cut", "l", "r")).alias("m")
    return some.groupBy("lang", "k", "phrase", "a").agg(lowest).select("lang", "k", "phrase", "a", "m.l", "m.r", "m.score")


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, subsumed: int = 50, block_bytes: int = 6 << 20, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two or three words of each language.

    Words are runs of other than space and tab in pieces between ``. , ; : ! ?`` and line ends, A-Z lower-cased. A
    phrase of two words goes if one of three that holds it has ``subsumed`` percent of its occurrences or more. Ranks go by score, then a,
    both falling, then phrase in the order of its bytes. Null texts are empty, null languages ``und``; documents without words and
    empty tables give nothing; repeated rows count each time; ids and other columns are not read.
    """
    counts = C.materialize(frequent(docs, least, block_bytes, lang_col, text_col), "phrases-counts")
    all_ = C.materialize(scored(counts), "phrases-scored")
    three = counts.filter("k = 3").withColumn("phrase", F.explode(F.array(F.expr("substring_index(phrase, ' ', 2)"), F.expr("substring(phrase, instr(phrase, ' ') + 1)"))))
    longer = three.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = all_.join(longer, ["lang", "phrase"], "left").filter(f"longer IS NULL OR k = 3 OR 100 * longer < {subsumed} * a")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # a language may hold most phrases: the first of each of 64 parts are found before the first of all
    parts = Window.partitionBy("lang", "part").orderBy(*order)
    few = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("place", F.row_number().over(parts)).filter(F.col("place") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    total = counts.filter("k = 0").select("lang", F.col("a").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(C.documents(spark, sf_dir))


ORACLE = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
runs AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM words, range(1, 4) t(k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= 10),
cuts AS (SELECT lang, k, phrase, a, c, array_to_string(string_split(phrase, ' ')[1:c], ' ') AS lhs, array_to_string(string_split(phrase, ' ')[c + 1:], ' ') AS rhs FROM f, range(1, 3) t(c) WHERE k >= 2 AND c < k),
scores AS (SELECT cuts.lang, cuts.k, cuts.phrase, cuts.a, c, x.a AS l, y.a AS r, ((1000000::HUGEINT * cuts.a * cuts.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lhs JOIN f y ON y.lang = cuts.lang AND y.phrase = rhs),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
longer AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase FROM f WHERE k = 3) GROUP BY ALL),
stay AS (SELECT lowest.* FROM lowest LEFT JOIN longer USING (lang, phrase) WHERE k = 3 OR most IS NULL OR 100 * most < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM stay)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
