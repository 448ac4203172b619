"""Hand-checkable trees, edge cases and contracts between operators."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arbora.operators import connectivity as N
from arbora.operators import morphometry as M
from arbora.operators import topology as T
from arbora.operators.forest import Forest


def table(spark, rows):
    return spark.createDataFrame([(n, i, p, float(x), 0.0, 0.0, 1.0, "0") for n, i, p, x in rows], "neuron long, node_id long, parent_id long, x double, y double, z double, radius double, label string")


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_flow_of_two_fragments(spark):
    nodes = table(spark, [(1, 0, -1, 0), (1, 1, 0, 1), (1, 2, 1, 2), (1, 3, 2, 3), (1, 10, -1, 10), (1, 11, 10, 11), (1, 12, 11, 12), (1, 13, 12, 13)])
    cn = spark.createDataFrame([(1, 1, 0, "post"), (1, 2, 2, "pre"), (1, 3, 10, "post"), (1, 4, 12, "pre")], "neuron long, connector_id long, node_id long, type string")
    assert as_dict(M.synapse_flow_centrality(nodes, cn), "node_id", "flow") == {0: 0, 1: 1, 2: 1, 3: 0, 10: 0, 11: 1, 12: 1, 13: 0}


def test_strahler_and_cable(spark):
    nodes = table(spark, [(1, 1, -1, 0), (1, 2, 1, 1), (1, 3, 2, 2), (1, 4, 2, 4)])
    assert as_dict(M.strahler_index(nodes), "node_id", "strahler_index") == {1: 2, 2: 2, 3: 1, 4: 1}
    assert as_dict(M.cable_length(nodes), "neuron", "cable_length") == {1: 5.0}


@pytest.mark.parametrize("fn", [M.cable_length, M.strahler_index, T.connected_components, M.persistence_points, T.simplify_graph])
def test_empty_tables(spark, fn):
    assert fn(table(spark, [])).count() == 0


def test_cycles_are_refused():
    with pytest.raises(ValueError):
        Forest(pd.DataFrame({"neuron": [1, 1], "node_id": [1, 2], "parent_id": [2, 1]}))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-1, 30), min_size=1, max_size=30))
def test_forest_contracts(parents):
    n = len(parents)
    pid = [p if p < i else -1 for i, p in enumerate(parents)]
    f = Forest(pd.DataFrame({"neuron": 1, "node_id": range(n), "parent_id": pid, "x": np.arange(n) * 1.0, "y": 0.0, "z": 0.0}))
    assert (f.up(np.ones(n, int))[f.parent < 0]).sum() == n
    assert f.strahler().min() >= 1
    a, b = np.arange(n), np.arange(n)[::-1]
    m = f.lca(a, b)
    d = f.dist_root
    ok = m >= 0
    assert (d[a[ok]] + d[b[ok]] - 2 * d[m[ok]] >= -1e-9).all()
    assert (f.root[a] == f.root[b]).tolist() == ok.tolist()


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    from itertools import permutations

    for _ in range(20):
        s = rng.random((4, 5))
        col = N.assignment(s)
        assert np.isclose(s[np.arange(4), col].sum(), max(s[np.arange(4), list(p)].sum() for p in permutations(range(5), 4)))


def test_reroot_twice_is_identity(spark):
    nodes = table(spark, [(1, 1, -1, 0), (1, 2, 1, 1), (1, 3, 2, 2), (1, 4, 2, 4)])
    one = lambda i: spark.createDataFrame([(1, i)], "neuron long, node_id long")
    back = T.reroot(T.reroot(nodes, one(4)), one(1))
    assert as_dict(back, "node_id", "parent_id") == as_dict(nodes, "node_id", "parent_id")


def test_directed_pairs_with_a_way(spark):
    rng = np.random.default_rng(3)
    rows = [(n, i, int(rng.integers(1, i)) if i > 1 and i % 17 else -1, *map(float, rng.normal(size=3))) for n in (1, 2, 3) for i in range(1, 60)]
    nodes = spark.createDataFrame(rows, "neuron long, node_id long, parent_id long, x double, y double, z double")
    goals = spark.createDataFrame([(n, i) for n in (1, 2, 9) for i in (1, 2, 5, 17, 99)], "neuron long, node_id long")
    for limit in (None, 3.0):
        every = T.geodesic_matrix(nodes, None, goals, directed=True, max_dist=limit)
        want = sorted(map(tuple, every.filter("dist < double('infinity')").collect()))
        assert want and sorted(map(tuple, T.geodesic_matrix(nodes, None, goals, finite=True, directed=True, max_dist=limit).collect())) == want
