"""Cable overlap against a plain version."""

import numpy as np
import pytest

from arbora.operators import connectivity as N


def test_cable_overlap(spark):
    r = np.random.default_rng(3)
    c = {n: np.round(r.normal(size=(k, 3)) * 5) for n, k in ((1, 700), (2, 300), (3, 1), (4, 5))}
    c[4] += 1000
    length = {n: r.integers(1, 100, len(x)) / 4 for n, x in c.items()}
    t = spark.createDataFrame([(n, i, *map(float, p), float(length[n][i])) for n, x in c.items() for i, p in enumerate(x)], "neuron long, pid long, x double, y double, z double, length double")
    asked = [(1, 2), (2, 1), (1, 3), (1, 1), (1, 4), (4, 9), (1, 2)]
    got_plan = N.cable_overlap(t, spark.createDataFrame(asked, "a long, b long"), 3.0)
    want = {}
    for a, b in set(asked):
        if a in c and b in c:
            d = np.sqrt(((c[b][:, None] - c[a][None]) ** 2).sum(axis=2))
            hit = d.min(axis=1) < 3.0
            if hit.any():
                want[a, b] = length[a][d.argmin(axis=1)[hit]].sum()
    got = got_plan.collect()
    assert {(x.a, x.b): x.overlap for x in got} == pytest.approx(want) and len(got) == len(want)
    # points meet by pair, without 27 copies
    assert "explode" not in got_plan._jdf.queryExecution().optimizedPlan().toString()
