"""Resampling (11), token counts (12) and phrases (13) against plain versions, and their edge cases."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from arbora.llm import common as C
from arbora.llm import counting, phrases, resampling

LONG = " ".join(f"w{i % 900}{i % 7}" for i in range(60_000))
ROWS = [(1, "a b c", "en"), (1, "a b c", "en"), (2, None, None), (None, "one two " * 20, "en"), (None, "", ""), (3, LONG, "en"), (4, "½ ² 12 日本 語", "x"), (5, "Ab, cd " * 30, None)]
SCHEMA = "doc_id long, text string, lang string, score long, rank int, k int, n string, block string, size int, bucket string"


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1, 2, 3, "n", "b", 4, "c") for r in rows], SCHEMA)


def rng_texts(n, seed):
    rng = random.Random(seed)
    vocabulary = [rng.choice(["ab", "Ba", "é", "the", "x" * rng.randint(1, 90), "日本", "z9"]) + str(rng.randint(0, 30)) for _ in range(80)]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 120))) + rng.choice(["", ". ", "\n", "\x00,"]) * 2 for _ in range(n)]


def features(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return len(w), [zlib.crc32(x.encode()) % 10_000 for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def test_buckets():
    texts = [None, "", *rng_texts(60, 1), "a " + "b" * 500 + " c", "one"]
    made = resampling.Buckets(10_000, limit=50)
    for part in (texts, texts[::-1]):
        bucket, n, size = made.of(part)
        at = np.concatenate([[0], size.cumsum()])
        for i, t in enumerate(part):
            assert (int(n[i]), bucket[at[i] : at[i + 1]].tolist()) == features(t)


def plain_resample(rows, target, percent):
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(features(x)[1])
    for x in target:
        t.update(features(x)[1])
    big_s, big_t = s.total(), t.total()
    out, may = {}, []
    for i, x in rows:
        n, f = features(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * (big_s + 10_000) / ((s[b] + 1.0) * (big_t + 10_000)))) for b in f) // len(f) if f else 0
        h = int(sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        if n >= 20:
            may.append(i)
    for rank, i in enumerate(sorted(may, key=lambda i: (-out[i][2], i))[: percent * len(may) // 100], 1):
        out[i][3] = rank
    return out


@pytest.mark.parametrize("percent", [0, 25, 100])
def test_resample(spark, percent):
    rows = list(enumerate([None, "", *rng_texts(300, 2)]))
    target = [None, *rng_texts(5, 3)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id int, text string, weight int").repartition(5)
    got = resampling.resample(d, spark.createDataFrame([(x,) for x in target], "text string"), percent).collect()
    assert {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in got} == plain_resample(rows, target, percent)


def test_resample_edges(spark):
    none = docs(spark, [])
    assert resampling.resample(none, docs(spark)).count() == 0
    got = resampling.resample(docs(spark), none, percent=100).collect()
    assert len(got) == len(ROWS)
    assert sorted((r.doc_id, r["rank"]) for r in got if r["rank"]) in ([(3, 1), (5, 2)], [(3, 2), (5, 1)])
    assert all(r.score is None for r in got if r.doc_id is None) and all(r.weight == 0 for r in got if not r.n_features)
    twice = resampling.resample(docs(spark, [(7, "a b " * 10, "en")] * 5 + [(8, "q " * 30, "en")]), none, percent=100).collect()
    assert sorted(r["rank"] for r in twice) == [1, 2, 3, 4, 5, 6]  # rows with one id are numbered one after another


def test_token_counts(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(C.tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(4)
    bits = ["a", "the", "ing", " ", "  ", "\n", "\t", "'s", "'re", "'S", "12", "²", "é", "\xa0", "\x85", "\x1c", "<|endoftext|>", "<|end", "日本", "я", "😀", ".", "!?", " ", "ͅ", "٣", "՘"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [None, "", "ab" * 30_000, LONG]
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id int, text string, n_tokens int")
    for r in counting.count_tokens(d).collect():
        t = texts[r.doc_id] or ""
        n = len(tk.encode(t, add_special_tokens=False).ids)
        assert tuple(r)[1:] == (len(t.encode()), n, n > 512), t[:100]


def test_token_counts_long_texts_one_piece_at_a_time(monkeypatch):
    made = counting.Counter(C.tokenizer_path("byte_bpe_50k.json"), limit=100)
    want = [made.tokens(t) for t in rng_texts(50, 5)]
    monkeypatch.setattr(counting, "LONG_TEXT", 10)
    assert [made.tokens(t) for t in rng_texts(50, 5)] == want


def test_token_counts_edges(spark, tmp_path):
    assert counting.count_tokens(docs(spark, [])).count() == 0
    got = counting.count_tokens(docs(spark)).collect()
    assert len(got) == len(ROWS) and all((r.n_tokens == 0) == (r.n_bytes == 0) for r in got)
    with pytest.raises(ValueError):
        counting.Counter(C.tokenizer_path("word_bpe_49k.json"))


def pieces_of(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [w for w in (re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", low)) if w]


def plain_phrases(rows, least, top):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces_of(text):
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(b >= least and 100 * b >= 50 * a for q, b in c.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            score, _, l, r = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for i, x in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least,block", [(10, 4000), (2, 1 << 24), (1, 9000)])
def test_phrases(spark, least, block):
    rng = random.Random(6)
    texts = rng_texts(150, 7) + ["In the, END of the\tday. " * 12, "of the day\x0bof the!day\x00 x y"] * 3
    rows = [(rng.choice(["en", "en", "fr", None, "und"]), t) for t in texts] + [("fr", None), ("de", ""), ("de", " .,\n")]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, n int, phrase int").repartition(4)
    got = phrases.collocations(d, least, 40, block_bytes=block).collect()
    assert sorted(map(tuple, got)) == plain_phrases(rows, least, 40)


def test_phrases_edges(spark):
    assert phrases.collocations(docs(spark, [])).count() == 0
    got = phrases.collocations(docs(spark)).collect()
    assert sorted(map(tuple, got)) == plain_phrases([(r[2], r[1]) for r in ROWS], 10, 2000)


def test_sketch_never_too_low():
    g = phrases.Grams(["en", "en", "fr"], ["a b a b. a c", None, "a b"])
    langs, runs, n, _ = g.kept(np.ones(len(g.hash), bool))
    assert sorted(zip(langs, runs, n.tolist())) == sorted(
        [("en", b"a", 3), ("en", b"b", 2), ("en", b"c", 1), ("en", b"a b", 2), ("en", b"a c", 1), ("en", b"b a", 1), ("en", b"a b a", 1), ("en", b"b a b", 1), ("fr", b"a", 1), ("fr", b"b", 1), ("fr", b"a b", 1)]
    )
    assert phrases._unpack_runs(phrases._pack_runs(runs, n)) == (runs, n.tolist())
    cells, counts = np.array([0, 3, 70_000, 2**24 - 1], np.uint64), np.array([1, 255, 3, 9])
    at, n = phrases._unpack(phrases._pack(cells, counts))
    assert at.tolist() == cells.tolist() and n.tolist() == counts.tolist()


def test_held_out_figures(spark, tmp_path):
    from arbora.llm import measure

    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["the cat", "and a dog", "one house"] if i % 2 else ["der hund", "und ein haus", "die katze"]) for _ in range(60)), "en" if i % 2 else "de") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = measure.figures(spark, str(tmp_path))
    assert got["op7_language"]["right"] == 1.0 and 0 <= got["op8_quality"]["right"] <= 1 and got["op8_quality"]["rows"] > 5
