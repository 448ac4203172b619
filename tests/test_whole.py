"""Queries without SQL take whole tables: no neuron, point or edge is left out."""

import itertools
import math
import os
from collections import Counter

import pytest

from arbora.operators import scoring as S
from arbora.plans import fixtures as X
from arbora.plans.registry import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def ids(df, column="neuron"):
    return {r[0] for r in df.select(column).distinct().collect()}


@pytest.fixture
def orders(spark, tmp_path):
    """Folder with a small lineitem of 30 neurons of 70 nodes and 60 suppliers, each with a part of its own and three that it shares with one partner."""
    rows = [(64 * n + i // 2, i, s, 10 * ((s + 1) // 2) + n % 3 if n % 2 else 400 + s, float(1000 * n + 37 * i), 1.0 + i % 9) for n in range(30) for i in range(70) for s in [1 + (n * 70 + i) % 60]]
    t = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_extendedprice double, l_quantity double")
    t.selectExpr("*", "0.0D AS l_discount", "0.0D AS l_tax", "DATE'2000-01-01' AS l_shipdate", "'A' AS l_returnflag", "'O' AS l_linestatus").coalesce(2).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def brute_scores(points):
    """Forward scores of all pairs over all points."""
    import numpy as np

    by = {}
    for r in sorted(points, key=lambda r: (r.neuron, r.pid)):
        by.setdefault(r.neuron, []).append((r.x, r.y, r.z, r.vx, r.vy, r.vz))
    by = {k: np.array(v) for k, v in by.items()}
    out = {}
    for q, a in by.items():
        for t, b in by.items():
            d = np.sqrt(((a[:, None, :3] - b[None, :, :3]) ** 2).sum(2))
            at = d.argmin(1)
            dot = np.abs((a[:, 3:] * b[at, 3:]).sum(1))
            out[q, t] = 1.0 if q == t else float(np.sqrt(dot * np.exp(-(d.min(1) ** 2) / (2 * 100.0 * 100.0))).sum() / len(a))
    return out


def test_nblast_smart_and_clusters_take_all_points(spark, orders):
    points = X.points(spark, orders)
    want = brute_scores(points.collect())
    got = {(r.query, r.target): r.score for r in QUERIES["nblast_smart"](spark, orders).collect()}
    assert {q for q, _ in got} == set(range(30)) and {t for _, t in got} == set(range(30))
    assert all(abs(v - want[k]) < 2e-6 for k, v in got.items())
    c = QUERIES["clusters"](spark, orders).collect()
    assert {r.neuron for r in c} == set(range(30)) and len({r.cluster for r in c}) == 3
    mean = spark.createDataFrame([(q, t, (v + want[t, q]) / 2) for (q, t), v in want.items()], "query long, target long, score double")
    same = lambda rows: Counter(frozenset(r.neuron for r in rows if r.cluster == k) for k in range(3))
    assert same(c) == same(S.clusters(mean, 3).collect())


def test_bipartite_match_takes_all_sources(spark, orders):
    w = {}
    for r in X.edges(spark, orders).collect():
        w.setdefault(r.source, {})[r.target] = r.weight
    norm = {a: math.sqrt(sum(x * x for x in v.values())) for a, v in w.items()}
    score = {(a, b): sum(w[a][t] * w[b][t] for t in w[a].keys() & w[b].keys()) / norm[a] / norm[b] for a, b in itertools.combinations(sorted(w), 2) if w[a].keys() & w[b].keys()}
    assert len(w) == 60 and score
    got = {(r.query, r.target): r.score for r in QUERIES["bipartite_match"](spark, orders).collect()}
    assert all(abs(v - score[k]) < 2e-6 for k, v in got.items())
    # the fixture's sources share targets with one partner each, so every pair is a match
    assert got.keys() == score.keys()


def test_voxel_components_take_all_neurons(spark, orders):
    assert ids(QUERIES["voxel_components"](spark, orders)) == set(range(30))


def test_average_skeletons_take_all_neurons(spark, orders):
    by = {}
    for r in X.nodes(spark, orders).collect():
        by.setdefault(r.neuron, {})[r.node_id] = (r.x, r.y, r.z)
    want = {}
    for node, p in by[1].items():
        near = [min((math.dist(p, q), i, q) for i, q in o.items()) for k, o in by.items() if k != 1]
        met = [p, *(q for d, _, q in near if d < 300)]
        want[node] = tuple(sum(c) / 30 for c in zip(*met)) if len(met) == 30 else p
    got = {r.node_id: (r.x, r.y, r.z) for r in QUERIES["average_skeletons"](spark, orders).collect()}
    assert got.keys() == want.keys() and all(math.dist(got[k], want[k]) < 1e-3 for k in want)
