"""Similarities in several blocks and slices against a plain version, and what they move."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from arbora.operators import connectivity as N

ROWS = [(1, 1, 3.0), (1, 2, 1.0), (1, None, 2.0), (2, 1, 1.0), (2, 3, 4.0), (3, 9, 1.0), (4, 1, 2.0), (4, 2, 2.0), (4, 3, 1.0), (5, 4, 0.0), (None, 1, 1.0), (20, 2, 5.0)]


def plain(metric, a, b):
    w = lambda s: {i if t is None else t: v for i, (x, t, v) in enumerate(ROWS) if x == s for i in [f"none {i}"]}
    x, y = w(a), w(b)
    both = [(x.get(t, 0.0), y.get(t, 0.0)) for t in x.keys() | y.keys()]
    shared = [(p, q) for p, q in both if p and q]
    lo, hi = [min(z) for z in both], [max(z) for z in both]
    f = sum(p - 0.5 * q * math.exp(-p) for p, q in zip(lo, hi))
    least, most = sum(-0.5 * q for q in hi), sum(q - 0.5 * q * math.exp(-q) for q in hi)
    return {
        "matching_index": len(shared) / len(both),
        "matching_index_synapses": sum(p + q for p, q in shared) / sum(p + q for p, q in both),
        "matching_index_weighted_synapses": sum(p for p, _ in shared) / sum(x.values()) * sum(q for _, q in shared) / sum(y.values()),
        "vertex": f,
        "vertex_normalized": (f - least) / (most - least),
        "cosine": sum(p * q for p, q in both) / math.sqrt(sum(p * p for p, _ in both) * sum(q * q for _, q in both)),
    }[metric]


@pytest.mark.parametrize("metric", ["matching_index", "matching_index_synapses", "matching_index_weighted_synapses", "vertex", "vertex_normalized", "cosine"])
def test_blocks_give_every_pair(spark, monkeypatch, metric):
    e = spark.createDataFrame(ROWS, "source long, target long, weight double")
    ids = [1, 2, 3, 4, 20]
    some = spark.createDataFrame([(1,), (20,), (7,)], "a long")
    for block in (2_000_000, 3):
        monkeypatch.setattr(N, "BLOCK_WEIGHTS", block)
        monkeypatch.setattr(N, "TASKS", 4)
        monkeypatch.setattr(N, "AT_ONCE", 2)
        for q, want in ((None, list(itertools.combinations(ids, 2))), (some, [(a, b) for a in (1, 20) for b in ids if a != b])):
            got = {(r.a, r.b): r.similarity for r in N.connectivity_similarity(e, metric, queries=q).collect()}
            assert got == {p: pytest.approx(plain(metric, *p), abs=1e-12) for p in want}


def test_ids_may_be_text(spark):
    e = spark.createDataFrame([("a", "x", 1), ("b", "x", 1), ("b", "y", 1)], "source string, target string, weight int")
    assert [tuple(r) for r in N.connectivity_similarity(e, "cosine").collect()] == [("a", "b", pytest.approx(math.sqrt(0.5)))]


def test_no_row_of_a_pair_is_moved(spark):
    e = spark.range(300).select((F.col("id") % 30).alias("source"), (F.col("id") % 7).alias("target"), F.lit(1).alias("weight"))
    plan = N.connectivity_similarity(e, "cosine")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("MapInArrow")
