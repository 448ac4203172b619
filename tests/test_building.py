"""Operators without SQL against plain versions and their own invariants."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from arbora.operators import building as B
from arbora.operators import topology as T
from arbora.plans import fixtures as X

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def nodes(spark):
    return X.nodes(spark, SF).filter("neuron < 6").cache()


def test_dotprops_axis(spark):
    rng = np.random.default_rng(0)
    line = [(1, i, float(i), 2.0 * i, 0.0) for i in range(30)]
    cloud = [(2, i, *map(float, rng.normal(size=3))) for i in range(40)]
    got = B.make_dotprops(spark.createDataFrame(line + cloud + [(3, 0, 1.0, 1.0, 1.0), (3, 1, None, 1.0, 1.0)], "neuron long, node_id long, x double, y double, z double"), k=5).collect()
    on = [r for r in got if r.neuron == 1]
    assert all(r.alpha == pytest.approx(1) and abs(abs(r.vx) - 1 / 5**0.5) < 1e-6 for r in on)
    assert [r.alpha for r in got if r.neuron == 3] == [0.0]
    xyz = np.array([c[2:] for c in cloud])
    for r in (r for r in got if r.neuron == 2):
        near = xyz[np.argsort(((xyz - [r.x, r.y, r.z]) ** 2).sum(axis=1))[:5]]
        u, s, v = np.linalg.svd(near - near.mean(axis=0))
        assert abs(v[0] @ [r.vx, r.vy, r.vz]) == pytest.approx(1) and r.alpha == pytest.approx((s[0] ** 2 - s[1] ** 2) / (s**2).sum())


def test_chunks(nodes):
    parent = {(r.neuron, r.node_id): r.parent_id for r in nodes.collect()}
    groups = {}
    for r in B.chunks(nodes, 25).collect():
        groups.setdefault((r.neuron, r.chunk), set()).add(r.node_id)
    assert sum(map(len, groups.values())) == len(parent)
    for (n, _), own in groups.items():
        assert len(own) <= 25 and sum(parent[n, i] in own for i in own) == len(own) - 1  # connected
    assert {len(g) for g in groups.values()} != {25}
    assert all(r["count"] == 25 for r in B.chunks(nodes, 25, "discard").groupBy("neuron", "chunk").count().collect())


def test_pca_and_warp(nodes):
    p = nodes.select("neuron", "node_id", "x", "y", "z")
    for _, g in B.align_pca(p).toPandas().groupby("neuron"):
        x = g[["x", "y", "z"]].to_numpy()
        c = x.T @ x
        assert np.allclose(x.mean(axis=0), 0, atol=1e-6) and np.allclose(c, np.diag(np.diag(c)), atol=1e-3 * c.max()) and (np.diff(np.diag(c)) <= 0).all()
    a, b = (B.warp(p, seed=3).orderBy("neuron", "node_id").toPandas() for _ in range(2))
    assert a.equals(b) and B.warp(p, 0.0).exceptAll(p).count() == 0
    assert B.augment(nodes, warp_by=0.02, shift=(1, 2, 3), scale=1.1).count() == nodes.count()


def test_rewire_is_reroot(nodes):
    links = nodes.filter("parent_id >= 0").selectExpr("neuron", "node_id AS a", "parent_id AS b")
    roots = nodes.filter("node_id = 7").select("neuron", "node_id")
    assert B.rewire(nodes, links, roots).exceptAll(T.reroot(nodes, roots)).count() == 0


def test_surface_samples(spark):
    v = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 1.0, 0.0, 0.0), (1, 2, 0.0, 1.0, 0.0), (1, 3, 0.0, 3.0, 0.0)], "neuron long, vid long, x double, y double, z double")
    f = spark.createDataFrame([(1, 0, 1, 2), (1, 1, 2, 3)], "neuron long, v0 long, v1 long, v2 long")
    got = [r.face for r in B.sample_surface(v, f, 30).orderBy("sample").collect()]
    assert got == [0] * 10 + [1] * 20  # areas 1/2 and 1


def test_nearest_by_tree_is_the_plain_one(monkeypatch):
    import numpy as np

    from arbora.operators import building

    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 12, (300, 3)).astype(float), rng.integers(0, 12, (900, 3)).astype(float)
    for k in (1, 20):
        plain = [np.concatenate(x) for x in zip(*((near, d) for _, near, d in building._nearest_blocks(a, b, k)))]
        monkeypatch.setattr(building, "TREE_FROM", 100)
        tree = [np.concatenate(x) for x in zip(*((near, d) for _, near, d in building._nearest_blocks(a, b, k)))]
        monkeypatch.setattr(building, "TREE_FROM", 4096)
        assert (plain[0] == tree[0]).all() and np.allclose(plain[1], tree[1])


def test_many_nodes_of_one_neuron_take_no_square(spark):
    import numpy as np

    from arbora.operators import building

    x = np.cumsum(np.random.default_rng(2).normal(size=(30_000, 3)), axis=0)
    t = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(x)], "neuron long, node_id long, x double, y double, z double")
    got = building.make_dotprops(t, 5).select("alpha").toPandas()
    assert len(got) == 30_000 and got["alpha"].between(0, 1).all()


def test_links_are_joined_in_ranges_first(spark):
    rng = np.random.default_rng(5)
    links = [*((i, i + 1) for i in range(0, 900) if i % 100 != 99), *rng.integers(1000, 1400, (150, 2)).tolist(), (3, 1002), (2000, 2000)]
    best = {x: x for pair in links for x in pair}
    while True:
        now = dict(best)
        for a, b in links:
            now[a] = now[b] = min(now[a], now[b])
        if now == best:
            break
        best = now
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        t = spark.createDataFrame(links, "a long, b long")
        stars = B._stars(t)
        assert stars.select(F.spark_partition_id()).distinct().count() > 1
        assert stars.count() < 1.2 * len(best)
        assert dict(map(tuple, B.components_of_links(t).collect())) == best
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
