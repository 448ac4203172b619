"""Formulas by values worked by hand, and the traversal models against each other."""

import pytest
from pyspark.sql import functions as F

from arbora.operators import connectivity as N


def edges(spark, rows):
    return spark.createDataFrame(rows, "source long, target long, weight double")


def test_sparseness(spark):
    e = edges(spark, [(1, 9, 1.0), (2, 9, 1.0), (3, 9, 2.0)])
    one = lambda which, **k: N.connectivity_sparseness(e, which, **k).first().sparseness
    a = (4 / 3) ** 2 / 2  # of weights 1, 1, 2
    assert one("activity_ratio") == pytest.approx(1 - a)
    assert one("LTS") == pytest.approx((1 - a) / (1 - 1 / 3))
    wider = e.union(edges(spark, [(4, 8, 1.0)]))
    got = {r.target: r.sparseness for r in N.connectivity_sparseness(wider, "activity_ratio").collect()}
    assert got[9] == pytest.approx(1 - 1 / (6 / 4)) and got[8] == pytest.approx(1 - (1 / 16) / (1 / 4))
    assert N.connectivity_sparseness(wider, "activity_ratio", dense=False).filter("target = 8").first().sparseness == 0


def test_similarity_without_overlap(spark):
    e = edges(spark, [(1, 10, 2.0), (2, 11, 3.0)])
    assert N.connectivity_similarity(e, "vertex").first().similarity == pytest.approx(-2.5)
    assert N.connectivity_similarity(e, "cosine").first().similarity == 0
    assert N.connectivity_similarity(e, "rank_index").first().similarity == pytest.approx(1 - 2 / 2)


@pytest.fixture(scope="module")
def diamond(spark):
    return edges(spark, [(0, 1, 0.15), (0, 2, 0.15), (1, 3, 0.15), (2, 3, 0.15)]), spark.range(1).withColumnRenamed("id", "node")


def test_bayesian_diamond(spark, diamond):
    e, seeds = diamond
    got = {r.node: r.layer_mean for r in N.bayesian_summary(N.bayesian_traverse(e, seeds, 15)).collect()}
    assert got[0] == 1 and got[1] == pytest.approx(3, abs=0.01) and 3.9 < got[3] < 4.02
    sink = [r.cmf for r in N.bayesian_traverse(e, seeds, 4).filter("node = 3").orderBy("step").collect()]
    assert sink[:2] == [0, 0] and sink[2] == pytest.approx(1 - 0.75**2)


def test_traversal_agrees_with_bayesian(spark, diamond):
    e, seeds = diamond
    runs = N.traverse(e, seeds, 12, iterations=4000, seed=3)
    assert runs.exceptAll(N.traverse(e, seeds, 12, iterations=4000, seed=3)).count() == 0
    got = {r.node: r.m for r in runs.groupBy("node").agg(F.avg("step").alias("m")).collect()}
    want = {r.node: r.layer_mean for r in N.bayesian_summary(N.bayesian_traverse(e, seeds, 12)).collect()}
    assert all(got[n] == pytest.approx(want[n], abs=0.08) for n in want)
