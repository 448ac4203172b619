"""Coherent point drift recovers known motions; blocks, samples and mirrors."""

import numpy as np
import pytest

from arbora.operators import alignment as A


def tree(n=240, seed=1):
    """Points along a branched line, no two axes alike."""
    rng = np.random.default_rng(seed)
    main = np.cumsum(rng.normal([2.0, 0.3, 0.1], 0.3, (n // 2, 3)), axis=0)
    arm = main[n // 5] + np.cumsum(rng.normal([0.2, 1.4, 0.5], 0.3, (n - n // 2, 3)), axis=0)
    return np.concatenate([main, arm])


def turned(angle, axis=(1.0, 2.0, 3.0)):
    k = np.array(axis) / np.linalg.norm(axis)
    c = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    return np.eye(3) + np.sin(angle) * c + (1 - np.cos(angle)) * c @ c


@pytest.mark.parametrize("scale", [1.0, 1.3])
def test_rigid_motion_is_found(scale):
    y, r, t = tree(), turned(0.4), np.array([30.0, -20.0, 5.0])
    x = (scale * y @ r.T + t)[np.random.default_rng(2).permutation(len(y))]
    f = A.fit_rigid(x, y, scale=scale != 1)
    assert f.converged and np.allclose(f.rotation, r, atol=1e-3) and f.scale == pytest.approx(scale, abs=1e-3)
    assert np.abs(f.apply(y) - (scale * y @ r.T + t)).max() < 1e-3 * A._radius(x) and f.nrms < 1e-3


def test_rigid_with_outliers_and_bounds():
    y, r = tree(), turned(-0.3)
    x = np.concatenate([y @ r.T, np.random.default_rng(3).uniform(-60, 260, (25, 3))])
    assert np.allclose(A.fit_rigid(x, y, w=0.2).rotation, r, atol=0.02)
    assert A.fit_rigid(2 * y, y, scale=True, scale_bounds=(0.9, 1.1)).scale == 1.1


def test_expectation_in_blocks_is_the_plain_one(monkeypatch):
    x, y = tree(50), tree(40, 5)
    d = ((x[:, None] - y[None]) ** 2).sum(axis=2)
    for w in (0.0, 0.3):
        p = np.exp(-d / 200)
        p /= p.sum(axis=1, keepdims=True) + ((2 * np.pi * 100) ** 1.5 * w / (1 - w) * 40 / 50 if w else 0)
        got = A._expect(x, y, 100.0, w)
        assert np.allclose(got[0], p.sum(axis=1)) and np.allclose(got[1], p.sum(axis=0)) and np.allclose(got[2], p.T @ x) and got[3] == pytest.approx((p * d).sum())


def test_expectation_leaves_no_normal_doubles(monkeypatch):
    x, y = tree(50), tree(40, 5)
    want = A._expect(x, y, 0.05, 0.0)
    monkeypatch.setattr(A, "PAIRS", 200)
    with np.errstate(under="raise"):  # exp is slow there
        got = A._expect(x, y, 0.05, 0.0)
    assert all(np.allclose(a, b) for a, b in zip(got, want)) and got[1].sum() == pytest.approx(50)


def test_modes_are_the_largest_of_the_kernel():
    y = tree(120) / 50
    q, value = A.modes(y, 0.5, 20)
    want = np.sort(np.linalg.eigvalsh(A._kernel(y, y, 0.5)))[::-1][:20]
    assert np.allclose(value, want, atol=1e-6 * want[0]) and np.allclose(q.T @ q, np.eye(len(value)), atol=1e-8)


def test_warp_beats_rigid_beats_nothing():
    y = tree()
    bend = y + np.stack([0 * y[:, 0], 6 * np.sin(y[:, 0] / 40), 4 * np.cos(y[:, 1] / 30)], axis=1) + [8.0, 3.0, -4.0]
    near = lambda p: np.sqrt(((p[:, None] - bend[None]) ** 2).sum(axis=2)).min(axis=1).mean()
    rigid, warp = A.fit_rigid(bend, y), A.fit_deform(bend, y)
    assert near(warp.apply(y)) < 0.5 * near(rigid.apply(y)) < 0.5 * near(y)
    # the warp is a function of place: half the points, fitted alone, carry the others
    half = A.fit_deform(bend[::2], y[::2])
    assert near(half.apply(y)) < near(rigid.apply(y))


def test_axes():
    y, r = tree(), turned(2.0)
    f = A.fit_axes(y @ r.T + 5, y)
    assert np.allclose(f.apply(y), y @ r.T + 5, atol=1e-6)


def test_pairs(spark):
    y, r = tree(), turned(0.3)
    sets = {1: y, 2: y @ r.T + [9.0, 9, 9], 3: y * [-1.0, 1, 1] + [4.0, 0, 0], 4: y[:2]}
    p = spark.createDataFrame([(n, i, *map(float, v), "x") for n, vs in sets.items() for i, v in enumerate(vs)] + [(1, 999, None, 0.0, 0.0, "x")], "neuron long, node_id long, x double, y double, z double, source string")
    pairs = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (1, 3), (4, 1), (1, 77)], "source long, target long")
    moved, fits = A.align(p, pairs, mirror_axis="x")
    by = {(f.source, f.target): f for f in fits.collect()}
    assert set(by) == {(1, 2), (2, 1), (1, 3)} and all(f.nrms < 1e-2 for f in by.values())
    assert np.linalg.det(np.array(by[1, 3].rotation).reshape(3, 3)) == pytest.approx(-1) and np.linalg.det(np.array(by[1, 2].rotation).reshape(3, 3)) == pytest.approx(1)
    got = {(m.source, m.target, m.node_id): (m.x, m.y, m.z) for m in moved.collect()}
    assert len(got) == 3 * len(y)
    for (s, t, i), place in got.items():
        assert np.allclose(place, sets[t][i], atol=0.5), (s, t)
    part, _ = A.align(p, pairs.filter("target = 2"), "rigid", sample=0.5)
    assert part.count() == len(y) and np.allclose([(m.x, m.y, m.z) for m in part.orderBy("node_id").collect()], sets[2], atol=0.5)
    for method in ("deform", "rigid+deform", "pca"):
        m, f = A.align(p, pairs.filter("target = 2"), method)
        assert m.count() == len(y) and f.count() == 1
    assert A.align(p, pairs.limit(0))[0].count() == 0
    for bad in ({"method": "x"}, {"mirror_axis": "w"}):
        with pytest.raises(ValueError):
            A.align(p, pairs, **bad)


def test_the_query_fits_until_it_converges(spark, tmp_path):
    from arbora.plans import fixtures as X
    from arbora.plans.registry import QUERIES, rounded

    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").filter("l_orderkey < 192").write.parquet(str(tmp_path / "lineitem.parquet"))
    n = X.nodes(spark, str(tmp_path)).select("neuron", "node_id", "x", "y", "z")
    pairs = spark.createDataFrame([(1, 0), (2, 0)], "source long, target long")
    rows = lambda t: sorted(map(tuple, t.collect()))
    whole, cut = (rows(rounded(A.align(n, pairs, "rigid+deform", **o)[0], 3)) for o in ({}, {"max_iterations": 30}))
    assert rows(QUERIES["align_deform"](spark, str(tmp_path))) == whole != cut
