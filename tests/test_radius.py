"""Guessed radii against a plain version that walks path by path, and values worked out by hand."""

import math

import pytest

from arbora.operators import editing as E
from arbora.plans import fixtures as X

SF = "/root/testdata/sf0.001"
NODES = "neuron long, node_id long, parent_id long, x double, y double, z double, radius double, label string"
CONNECTORS = "neuron long, connector_id long, node_id long, type string, x double, y double, z double"


def paths(parent):
    """Paths of most nodes, longest first (ties: the smaller leaf), each with the node that it joins."""
    kids = {}
    for n, p in parent.items():
        if p in parent:
            kids.setdefault(p, []).append(n)
    depth = {}
    for n in parent:
        m, depth[n] = n, 1
        while parent[m] in parent:
            m, depth[n] = parent[m], depth[n] + 1
    far: dict = {}
    for n in sorted(parent, key=lambda n: -depth[n]):
        far[n] = max((far[k] for k in kids.get(n, [])), default=depth[n])
    best = {n: min(k, key=lambda c: (-far[c], c)) for n, k in kids.items()}
    out = []
    for leaf in (n for n in parent if n not in kids):
        path = [leaf]
        while parent[path[-1]] in parent:
            path.append(parent[path[-1]])
            if best[path[-1]] != path[-2]:
                break
        out.append(path)
    return sorted(out, key=lambda p: (-len(p), p[0]))


def plain(nodes, connectors, smooth=5):
    """Radii of one neuron."""
    at = {n.node_id: n for n in nodes}
    r = {n.node_id: n.radius if n.radius > 0 else None for n in nodes}
    found = {}
    for c in connectors:
        n = at[c.node_id]
        found.setdefault(c.node_id, []).append(math.sqrt(int((n.x - c.x) ** 2 + (n.y - c.y) ** 2)))
    r.update({k: max(v) for k, v in found.items()})
    parent = {n.node_id: n.parent_id for n in nodes}
    step = lambda n: math.dist([getattr(at[n], a) for a in "xyz"], [getattr(at[parent[n]], a) for a in "xyz"]) if parent[n] in at else 0.0
    for path in paths(parent):
        along, total = [], 0.0
        for n in path:
            total += step(n)
            along.append(total)
        has = [i for i, n in enumerate(path) if r[n] is not None]
        if not has:
            continue
        new = []
        for i, n in enumerate(path):
            before, after = [j for j in has if j <= i], [j for j in has if j >= i]
            if r[n] is not None:
                new.append(r[n])
            elif not before or not after:
                new.append(r[path[after[0] if after else before[-1]]])
            else:
                a, b = before[-1], after[0]
                t = (along[i] - along[a]) / (along[b] - along[a])
                new.append(r[path[a]] + t * (r[path[b]] - r[path[a]]))
        for i, n in enumerate(path):
            r[n] = max(new[max(0, i - smooth + 1) : i + 1])
    return {n: -1.0 if v is None else v for n, v in r.items()}


def test_guess_radius_plain(spark):
    nodes = X.nodes(spark, SF).filter("neuron < 6").selectExpr("neuron", "node_id", "parent_id", "x", "y", "z", "if(node_id % 4 = 0, radius, -1D) AS radius", "label").cache()
    beside = X.connectors(spark, SF).filter("neuron < 6").selectExpr("neuron", "connector_id", "node_id", "type", "x + node_id % 13 AS x", "y + 2.5 AS y", "z").cache()
    got = {(r.neuron, r.node_id): r.radius for r in E.guess_radius(nodes, beside).collect()}
    rows, near = nodes.collect(), beside.collect()
    for neuron in {r.neuron for r in rows}:
        want = plain([r for r in rows if r.neuron == neuron], [c for c in near if c.neuron == neuron])
        assert len(want) > 50
        for n, v in want.items():
            assert got[neuron, n] == pytest.approx(v), (neuron, n)


def test_guess_radius_by_hand(spark):
    line = [(1, i, i - 1 if i else -1, float(i), 0.0, 0.0, -1.0, "a") for i in range(9)]
    other = [(2, 0, -1, 0.0, 0.0, 0.0, None, "a"), (2, 1, 0, 1.0, 0.0, 0.0, 0.0, "a")]
    nodes = spark.createDataFrame(line + other, NODES)
    # 0.9 away in z only is 0 in the plane; (2, 1.5): 6.25, cut to 6
    beside = spark.createDataFrame([(1, 7, 8, "pre", 8.0, 0.0, 0.9), (1, 8, 0, "pre", 2.0, 1.5, 0.0)], CONNECTORS)
    got = {(r.neuron, r.node_id): r.radius for r in E.guess_radius(nodes, beside, smooth=0).collect()}
    # distances count from a node to its parent; that of the leaf comes first and the root's is 0
    assert got[1, 8] == 0 and got[1, 0] == pytest.approx(6**0.5) and got[1, 1] == pytest.approx(6**0.5)
    assert got[1, 4] == pytest.approx(4 / 7 * 6**0.5)
    assert got[2, 0] == got[2, 1] == -1
    few = {(r.neuron, r.node_id): r.radius for r in E.guess_radius(nodes, beside, limit=2, smooth=0).collect()}
    assert few[1, 4] == -1 and few[1, 6] == got[1, 6] and few[1, 2] == got[1, 2]
    assert E.guess_radius(nodes.limit(0), beside).count() == 0
