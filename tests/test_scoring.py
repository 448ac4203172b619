"""Point scores in several blocks and slices against a plain version."""

import itertools

import numpy as np
import pytest

from arbora.operators import scoring as S

SCORE = S.analytic(2.0)


def clouds():
    r = np.random.default_rng(5)
    return {n: (r.normal(size=(k, 3)) * 4, r.normal(size=(k, 3))) for n, k in ((20, 30), (21, 7), (40, 18), (43, 1), (60, 25))}


def table(spark, c):
    rows = [(n, i, *map(float, (*p, *(v / np.linalg.norm(v))))) for n, (xyz, vec) in c.items() for i, (p, v) in enumerate(zip(xyz, vec))]
    return spark.createDataFrame(rows, "neuron long, pid long, x double, y double, z double, vx double, vy double, vz double")


def met(a, b):
    d = np.sqrt(((a[0][:, None] - b[0][None]) ** 2).sum(axis=2))
    near = d.argmin(axis=1)
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    return d.min(axis=1), np.abs((unit(a[1]) * unit(b[1])[near]).sum(axis=1))


@pytest.fixture(params=[1_000_000, 40])
def blocks(request, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_POINTS", request.param)
    monkeypatch.setattr(S, "TASKS", 4)
    monkeypatch.setattr(S, "HELD_ROWS", 50)


def test_both_directions(spark, blocks):
    c = clouds()
    t = table(spark, c)
    one = lambda a, b, cap: (SCORE.array(*met(c[a], c[b])) if cap is None else SCORE.array(np.minimum(met(c[a], c[b])[0], cap), np.where(met(c[a], c[b])[0] < cap, met(c[a], c[b])[1], 0))).sum() / len(c[a][0])
    asked = [(20, 21), (20, 43), (60, 60), (40, 20), (60, 40)]
    pairs = spark.createDataFrame(asked, "query long, target long")
    for some, cap in ((None, None), (pairs, None), (pairs, 3.0)):
        want = {p: (1.0, 1.0) if p[0] == p[1] else (one(*p, cap), one(*p[::-1], cap)) for p in (asked if some is not None else itertools.product((20, 40, 60), c))}
        got = S.nblast(t.filter("neuron % 20 = 0"), t, SCORE, "both", max_dist=cap, pairs=some).collect()
        assert len(got) == len(want)
        for r in got:
            assert (r.forward, r.reverse) == pytest.approx(want[r.query, r.target], abs=1e-9)


def test_lookup_counts_where_points_meet(spark, blocks):
    t = table(spark, clouds())
    q = t.filter("neuron % 20 = 0")
    dist, dot = [0, 1, 2, 4, 1e9], [0, 0.3, 0.6, 1]
    nn = S.nearest_points(q, t, None)
    assert nn.count() == 4 * (30 + 18 + 25)
    want = S.build_lookup(nn.filter("(query + target) % 2 = 0"), nn.filter("(query + target) % 2 = 1"), dist, dot)
    got = S.build_lookup_of_pairs(q, t, lambda a, b: (a + b) % 2 == 0, dist, dot)
    assert np.allclose(got.cells, want.cells)


def test_rows_of_pairs_are_made_whole_where_they_meet(spark, blocks):
    t = table(spark, clouds())
    s = S.raw_scores(t.filter("neuron % 20 = 0"), t, SCORE, both=True, normalized=True)
    assert s.columns == ["query", "target", "score", "back"]
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("MapInArrow")[0]
    full = S.nblast(t.filter("neuron % 20 = 0"), t, SCORE, "mean")._jdf.queryExecution().optimizedPlan().toString()
    # only the rows of ids with themselves are joined: nothing above the step where pairs meet
    above = [line for line in full.split("\n") if "Join" in line]
    meets = next(line for line in full.split("\n") if "MapInArrow" in line)
    assert all(len(a) - len(a.lstrip(" :+-")) >= len(meets) - len(meets.lstrip(" :+-")) for a in above)


def test_far_queries_are_not_compared(spark, monkeypatch):
    from arbora.operators import scoring as S

    rng = np.random.default_rng(11)
    rows = [(n, i, *(rng.random(3) * 50 + [0, 400.0 * (n // 2), 0]).tolist(), *(rng.normal(size=3)).tolist()) for n in range(6) for i in range(20)]
    points = spark.createDataFrame(rows, "neuron long, pid long, x double, y double, z double, vx double, vy double, vz double")
    for sigma, cap in ((2.0, None), (10.0, 200.0), (10.0, None)):
        score = S.analytic(sigma)
        got = {(r.query, r.target): (r.score, r.back) for r in S.raw_scores(points, points, score, cap, both=True).collect()}
        assert len(got) == 30
        hits = {}
        for a in range(6):
            for b in range(6):
                p, q = (np.array([r[2:] for r in rows if r[0] == n]) for n in (a, b))
                d = np.sqrt(((p[:, None, :3] - q[None, :, :3]) ** 2).sum(axis=2))
                near = d.argmin(axis=1)
                d, dot = d.min(axis=1), np.abs((p[:, 3:] * q[near, 3:]).sum(axis=1))
                hits[a, b] = score.array(d if cap is None else np.minimum(d, cap), dot if cap is None else np.where(d < cap, dot, 0.0)).sum()
        for (a, b), (s, back) in got.items():
            assert np.isclose(s, hits[a, b], rtol=1e-9, atol=0) and np.isclose(back, hits[b, a], rtol=1e-9, atol=0)
    seen = []
    monkeypatch.setattr(S, "_meet", lambda query, target, pairs, each, schema, reach=None, far=None: seen.append(reach))
    S.raw_scores(points, points, S.analytic(10.0), 200.0)
    S.raw_scores(points, points, S.analytic(2.0))
    S.raw_scores(points, points, S.Lookup([0, 1, 2], [0, 0.5, 1], [[1, 2], [3, 4]]), 200.0)
    assert seen[0] == 200.0 and 76 < seen[1] < 78 and seen[2] is None


def synapses():
    r = np.random.default_rng(6)
    return {n: (r.normal(size=(k, 3)) * 4, [kinds[i % len(kinds)] for i in range(k)]) for n, k, kinds in ((20, 30, "ab"), (21, 7, "a"), (40, 18, ["b", None]), (43, 1, "c"), (60, 25, "abc"))}


def test_synapses_meet_those_of_their_type(spark, blocks):
    c = synapses()
    t = spark.createDataFrame([(n, i, *map(float, p), k) for n, (xyz, kinds) in c.items() for i, (p, k) in enumerate(zip(xyz, kinds))], "neuron long, pid long, x double, y double, z double, type string")

    def one(a, b):
        (p, k), (q, m) = c[a], c[b]
        d = np.sqrt(((p[:, None] - q[None]) ** 2).sum(axis=2))
        d[np.array([[x is None or x != y for y in m] for x in k])] = np.inf
        return SCORE.array(d.min(axis=1), np.ones(len(p))).mean()

    for scores in ("forward", "both"):
        got = S.synblast(t.filter("neuron % 20 = 0"), t, SCORE, by_type=True, scores=scores).collect()
        assert {(r.query, r.target) for r in got} == set(itertools.product((20, 40, 60), c)) and len(got) == 15
        for r in got:
            want = (1.0, 1.0) if r.query == r.target else (one(r.query, r.target), one(r.target, r.query))
            assert tuple(r)[2:] == pytest.approx(want[: len(tuple(r)) - 2], abs=1e-9)


def test_no_row_of_a_pair_is_joined_by_type(spark):
    t = spark.createDataFrame([(20, 1, 0.0, 0.0, 0.0, "a"), (21, 2, 1.0, 0.0, 0.0, "a")], "neuron long, pid long, x double, y double, z double, type string")
    s = S.synblast(t.filter("neuron % 20 = 0"), t, SCORE, by_type=True)
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
