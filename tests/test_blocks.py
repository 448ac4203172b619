"""Work on all pairs where blocks meet, against plain versions."""

import itertools

import numpy as np
import pytest

from arbora.operators import editing as E
from arbora.operators import morphometry as M


def test_persistence_distances_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_VECTORS", 4)
    monkeypatch.setattr(M, "SLICES", 2)
    monkeypatch.setattr(M, "AT_ONCE", 5)
    d = np.random.default_rng(1).random((13, 6)) + 0.1
    d[4], d[5] = d[3] * 2, d[3] + [1e-7, 0, 0, 0, 0, 0]  # the same direction, and one next to it
    v = spark.createDataFrame([(int(n), int(i), float(x)) for (n, i), x in np.ndenumerate(d)], "neuron long, i int, density double")
    u = d / np.sqrt((d * d).sum(axis=1))[:, None]
    want = {(a, b): np.sqrt(((u[a] - u[b]) ** 2).sum()) for a, b in itertools.product(range(13), repeat=2)}
    got = M.persistence_distances(v)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # no row of a pair is joined
    for t, known in ((got, lambda a, b: a < b), (M.persistence_distances(v, v.filter("neuron % 4 = 0").selectExpr("neuron AS a")), lambda a, b: a != b and a % 4 == 0)):
        rows = {(r.a, r.b): r.distance for r in t.collect()}
        assert sorted(rows) == sorted(k for k in want if known(*k)) and len(rows) == t.count()
        assert all(abs(x - want[k]) < 1e-13 for k, x in rows.items())
    with pytest.raises(Exception, match="equally many"):
        M.persistence_distances(v.filter("neuron <> 3 OR i > 0")).collect()


def test_average_is_the_plain_one(spark, monkeypatch):
    monkeypatch.setattr(E, "SLICES", 3)
    monkeypatch.setattr(E, "PAIRS", 7)
    r = np.random.default_rng(2)
    base = r.integers(0, 12, (40, 3)).astype(float)  # whole places, so there are ties
    sets = {1: base, **{n: base[r.permutation(40)[:30]] + r.integers(-1, 2, (30, 3)) for n in (2, 3, 7, 9)}}
    rows = [(n, i, -1, *map(float, p), 1.0, "a") for n, ps in sets.items() for i, p in enumerate(ps)] + [(3, 90, -1, None, 1.0, 1.0, 1.0, "a")]
    t = spark.createDataFrame(rows, "neuron long, node_id long, parent_id long, x double, y double, z double, radius double, label string")
    want, moved = {}, 0
    for i, p in enumerate(base):
        hit = []
        for n in (2, 3, 7, 9):
            d = np.sqrt(((sets[n] - p) ** 2).sum(axis=1))
            if d.min() < 2.5:
                hit.append(sets[n][d.argmin()])
        whole = len(hit) == 4
        moved += whole
        want[i] = (p + np.sum(hit, axis=0)) / 5 if whole else p
    out = E.average(t, 1, 2.5)
    assert out.columns == t.columns and 0 < moved < 40
    got = {x.node_id: (x.x, x.y, x.z) for x in out.collect()}
    assert sorted(got) == list(range(40)) and all(np.allclose(got[i], want[i]) for i in got)
    # a neuron without any place keeps all nodes where they are; an unknown base gives no rows
    lost = spark.createDataFrame([(5, 1, -1, None, None, None, 1.0, "a")], t.schema)
    assert {x.node_id: (x.x, x.y, x.z) for x in E.average(t.union(lost), 1, 2.5).collect()} == {i: tuple(p) for i, p in enumerate(base)}
    assert not E.average(t, 77, 2.5).collect()
