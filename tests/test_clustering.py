"""Spanning forests, clusters and matches against plain versions."""

import itertools
import random

import pytest

from arbora.operators import clustering as K
from arbora.operators import connectivity as N


def greedy(score, ids, method, n):
    """Merges the best pair of clusters, one at a time; absent scores are the lowest one."""
    floor = min((v for (a, b), v in score.items() if a != b), default=0.0)
    s = lambda a, b: (score.get((a, b), floor) + score.get((b, a), floor)) / 2
    groups = [frozenset([i]) for i in sorted(ids)]
    fold = {"single": max, "complete": min, "average": lambda v: sum(v) / len(v)}[method]
    while len(groups) > n:
        x, y = max(itertools.combinations(groups, 2), key=lambda p: fold([s(a, b) for a in p[0] for b in p[1]]))
        groups = [g for g in groups if g not in (x, y)] + [x | y]
    return set(groups)


@pytest.mark.parametrize("method", ["single", "average", "complete"])
def test_clusters(spark, method):
    rnd = random.Random(5)
    ids = list(range(3, 19))
    score = {(a, b): rnd.uniform(-1, 1) for a in ids for b in ids if a == b or method == "average" or rnd.random() < 0.9}
    df = spark.createDataFrame([(a, b, v) for (a, b), v in score.items()], "query long, target long, score double")
    rows = K.clusters(df, 4, method).collect()
    got = {frozenset(r.neuron for r in rows if r.cluster == c) for c in {r.cluster for r in rows}}
    assert got == greedy(score, ids, method, 4)
    first = [min(r.neuron for r in rows if r.cluster == c) for c in range(4)]
    assert first == sorted(first) and len(rows) == len(ids)


def test_clusters_of_odd_tables(spark):
    schema = "query long, target long, score double"
    assert K.clusters(spark.createDataFrame([], schema), 2).count() == 0
    alone = spark.createDataFrame([(1, 1, 1.0), (2, 2, 1.0), (5, 5, 1.0), (None, 2, 3.0)], schema)
    assert {(r.neuron, r.cluster) for r in K.clusters(alone, 3).collect()} == {(1, 0), (2, 1), (5, 2)}
    ties = spark.createDataFrame([(a, b, 0.5) for a in range(6) for b in range(6)] + [(1, 2, 0.5)], schema)
    assert len({r.cluster for r in K.clusters(ties, 2).collect()}) == 2
    pair = spark.createDataFrame([(1, 2, 0.9), (2, 1, 0.9), (2, 3, 0.2), (3, 2, 0.2)], schema)
    assert {(r.neuron, r.cluster) for r in K.clusters(pair, least=0.5).collect()} == {(1, 0), (2, 0), (3, 1)}
    with pytest.raises(ValueError):
        K.clusters(pair, 2, "median")
    with pytest.raises(ValueError):
        K.clusters(pair)


def test_spanning_forest_equals_kruskal(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(40), rnd.randrange(40), float(rnd.randrange(9))) for _ in range(45)] + [(i, i + 1, 1.0) for i in range(100, 160)] + [(7, 7, 9.0), (None, 3, 5.0)]
    tree, labels = K.spanning_forest(spark.createDataFrame(links, "a long, b long, score double"))
    top = {n: n for a, b, _ in links if a is not None and a != b for n in (a, b)}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    total, n = 0.0, 0
    for a, b, s in sorted((x for x in links if x[0] is not None and x[0] != x[1]), key=lambda x: -x[2]):
        if find(a) != find(b):
            top[find(a)] = find(b)
            total, n = total + s, n + 1
    got = tree.collect()
    assert len(got) == n and sum(r.score for r in got) == total
    of = {r.node: r.label for r in labels.collect()}
    assert of.keys() == top.keys() and all((of[a] == of[b]) == (find(a) == find(b)) for a in of for b in of)
    least = {r.node: r.label for r in K.components(spark.createDataFrame(links, "a long, b long, score double")).collect()}
    assert all(least[a] == min(b for b in of if of[b] == of[a]) for a in of)


def test_matches_by_parts(spark):
    rnd = random.Random(8)
    rows = [(10 * g + q, 10 * g + t, rnd.uniform(0, 1)) for g in range(3) for q in range(4) for t in range(5) if rnd.random() < 0.6]
    df = spark.createDataFrame(rows, "query long, target long, score double")
    score = {(q, t): s for q, t, s in rows if s >= 0.2}
    got = {(r.query, r.target) for r in N.bipartite_match(df, 0.2).collect()}
    assert len({q for q, _ in got}) == len(got) == len({t for _, t in got})
    want = 0.0
    for g in range(3):
        some = {k: s for k, s in score.items() if k[0] // 10 == g}
        best = (0, 0.0)
        for pick in itertools.product([None, *range(5)], repeat=4):
            pairs = [(10 * g + q, 10 * g + t) for q, t in enumerate(pick) if t is not None]
            if len({t for _, t in pairs}) == len(pairs) and all(p in some for p in pairs):
                best = max(best, (len(pairs), sum(some[p] for p in pairs)))
        want += best[1]
    assert abs(sum(score[p] for p in got) - want) < 1e-9
    parts = spark.createDataFrame([(q, t, s, q // 10) for q, t, s in rows], "query long, target long, score double, side long")
    assert {(r.query, r.target) for r in N.bipartite_match(parts, 0.2, "side").collect()} == got
