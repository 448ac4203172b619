"""Surfaces, skeletons and bridges against plain versions on small objects."""

import itertools
from collections import Counter, deque

import numpy as np
import pandas as pd
import pytest

from arbora.operators.space import face_table
from arbora.operators import geometry as G
from arbora.operators import meshes as M


def voxel_table(spark, objects):
    return spark.createDataFrame([(n, *map(int, v)) for n, vs in objects.items() for v in vs], "neuron long, i long, j long, k long")


def mesh_table(spark, meshes):
    v = spark.createDataFrame([(n, i, *map(float, p)) for n, (ps, _) in meshes.items() for i, p in enumerate(ps)], "neuron long, vid long, x double, y double, z double")
    f = spark.createDataFrame([(n, *map(int, t)) for n, (_, ts) in meshes.items() for t in ts], "neuron long, v0 long, v1 long, v2 long")
    return v, f


def collect_mesh(vertices, faces):
    out = {}
    for r in vertices.collect():
        out.setdefault(r.neuron, ({}, []))[0][r.vid] = np.array([r.x, r.y, r.z])
    for r in faces.collect():
        out[r.neuron][1].append((r.v0, r.v1, r.v2))
    return out


def volume(points, faces):
    return sum(np.dot(points[a], np.cross(points[b], points[c])) for a, b, c in faces) / 6


def blobs():
    rng = np.random.default_rng(1)
    out = {n: np.unique(rng.integers(-2, 3, (int(rng.integers(1, 110)), 3)), axis=0) for n in range(12)}
    out[20] = np.array([(0, 0, 0)])
    out[21] = np.array([(0, 0, 0), (1, 1, 0), (2, 2, 1)])  # an edge, then a corner in common
    out[22] = np.array(sorted(set(itertools.product(range(2), repeat=3)) - {(0, 0, 0), (1, 1, 1)}))
    return out


@pytest.mark.parametrize("method", ["cubes", "blocks", "nets"])
def test_surfaces(spark, method):
    objects = blobs()
    got = collect_mesh(*M.voxels_to_mesh(voxel_table(spark, objects), method))
    assert set(got) == set(objects)
    for n, (points, faces) in got.items():
        used = Counter((t[i], t[(i + 1) % 3]) for t in faces for i in range(3))
        assert all(used[b, a] == c for (a, b), c in used.items())  # closed, wound one way
        assert {x for t in faces for x in t} == set(points)
        cells = {tuple(np.array(v) - c) for v in objects[n] for c in itertools.product((0, 1), repeat=3)}
        if method == "cubes":
            assert set(used.values()) == {1}
            assert 0 < volume(points, faces) and abs(volume(points, faces) - len(objects[n])) < len(cells)
        if method == "blocks":
            assert volume(points, faces) == pytest.approx(len(objects[n]))
        if method == "nets":
            assert len(points) == len(cells) - sum(all(tuple(np.array(c) + o) in set(map(tuple, objects[n])) for o in itertools.product((0, 1), repeat=3)) for c in cells)


def test_every_case_of_a_cube():
    full = {frozenset(((c >> n & 1) for n in range(3))) for c in range(8)}
    assert full and len(M.surface_cases()) == 254
    for mask, tris in M.surface_cases().items():
        crossed = {(c, a) for c in range(8) for a in range(3) if not c >> a & 1 and (mask >> c & 1) != (mask >> (c | 1 << a) & 1)}
        assert {e for t in tris for e in t} == crossed
        inner = Counter(frozenset(x) for t in tris for x in itertools.combinations(t, 2))
        assert max(inner.values()) <= 2 and all(M._same_side(*x) for x, c in inner.items() if c == 1)


def test_surface_options(spark):
    big = voxel_table(spark, {1: list(itertools.product(range(4), repeat=3)), 2: [(0, 0, 0)]})
    (points, faces) = collect_mesh(*M.renumber(*M.voxels_to_mesh(big, "blocks", (1.0, 2.0, 3.0), step=2)))[1]
    assert volume(points, faces) == pytest.approx(64 * 6) and sorted(points) == list(range(26))
    assert M.voxels_to_mesh(big.filter("neuron = 9"))[1].count() == 0
    with pytest.raises(ValueError):
        M.voxels_to_mesh(big, "other")


def tube(rings, around=6, at=(0, 0, 0), tip=True):
    """An apex, then rings along z."""
    p = [(at[0], at[1], at[2])] if tip else []
    f = []
    for r in range(rings):
        p += [(at[0] + np.cos(2 * np.pi * i / around), at[1] + np.sin(2 * np.pi * i / around), at[2] + 1 + r) for i in range(around)]
    ring = lambda r, i: 1 + r * around + i % around
    f += [(0, ring(0, i), ring(0, i + 1)) for i in range(around)]
    f += [t for r in range(rings - 1) for i in range(around) for t in ((ring(r, i), ring(r + 1, i), ring(r + 1, i + 1)), (ring(r, i), ring(r + 1, i + 1), ring(r, i + 1)))]
    return p, f


def test_tube_is_a_line(spark):
    p, f = tube(10)
    nodes, of = M.mesh_to_skeleton(*mesh_table(spark, {7: (p, f)}))
    got = {r.node_id: r for r in nodes.collect()}
    assert len(got) == 11
    for n, r in got.items():
        # a ring is reached a step at a time, so its points come together
        assert r.parent_id == (n - 1 if n > 1 else -1)
        assert (round(r.x, 9), round(r.y, 9)) == (0, 0) and r.z == pytest.approx(n - 1)
        assert r.radius == pytest.approx(1.0 if n > 1 else 0.0)
    assert Counter(r.node_id for r in of.collect()) == {1: 1, **{i: 6 for i in range(2, 12)}}


def test_y_of_tubes_has_one_branch_point(spark):
    p, f = tube(6)
    base, top = len(p), 1 + 5 * 6
    for shift in (-3.0, 3.0):  # two arms on the same last ring, each a tube of four rings
        start = len(p)
        for r in range(4):
            p += [(np.cos(2 * np.pi * i / 6) + shift * (r + 1), np.sin(2 * np.pi * i / 6), 7.0 + r) for i in range(6)]
        first = lambda i: top + i % 6
        f += [t for i in range(6) for t in ((first(i), start + i, start + (i + 1) % 6), (first(i), start + (i + 1) % 6, first(i + 1)))]
        f += [t for r in range(3) for i in range(6) for t in ((start + r * 6 + i, start + r * 6 + 6 + i, start + r * 6 + 6 + (i + 1) % 6), (start + r * 6 + i, start + r * 6 + 6 + (i + 1) % 6, start + r * 6 + (i + 1) % 6))]
    nodes, of = M.mesh_to_skeleton(*mesh_table(spark, {1: (p, f)}))
    rows = nodes.collect()
    kids = Counter(r.parent_id for r in rows)
    assert len(rows) == 7 + 8 and sorted(kids.values()) == [1] * 13 + [2] or sorted(c for n, c in kids.items() if n > 0) == [1] * 12 + [2]
    assert of.count() == len(p) and base < len(p)


def plain_rings(n, links):
    near = {i: set() for i in range(n)}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    wave = {}
    for s in range(n):
        if s not in wave:
            wave[s], todo = 0, deque([s])
            while todo:
                x = todo.popleft()
                for y in near[x]:
                    if y not in wave:
                        wave[y] = wave[x] + 1
                        todo.append(y)
    ring = {}
    for s in range(n):
        if s not in ring:
            ring[s], todo = s, [s]
            while todo:
                x = todo.pop()
                for y in near[x]:
                    if y not in ring and wave[y] == wave[s]:
                        ring[y] = s
                        todo.append(y)
    return near, wave, ring


def test_wavefront_against_plain_version():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(1, 80))
        links = sorted({tuple(sorted(x)) for x in rng.integers(0, n, (int(rng.integers(0, 120)), 2)).tolist() if x[0] != x[1]})
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        xyz = rng.integers(0, 9, (n, 3)).astype(float)
        nodes, of = M.wavefront(n, a, b, xyz, shave=False)
        near, wave, ring = plain_rings(n, links)
        assert len({(of[i], ring[i]) for i in range(n)}) == len(set(ring.values())) == len(nodes)
        centre = {r: xyz[[i for i in range(n) if ring[i] == r]].mean(axis=0) for r in set(ring.values())}
        name = {of[i]: ring[i] for i in range(n)}
        for r in nodes.itertuples():
            assert np.allclose((r.x, r.y, r.z), centre[name[r.node_id]])
            above = {ring[y] for x in range(n) if of[x] == r.node_id for y in near[x] if wave[y] == wave[x] - 1}
            assert (r.parent_id == -1) == (not above)
            if above:
                d = lambda q: round(float(((centre[q] - centre[name[r.node_id]]) ** 2).sum()), 9)  # noqa: B023, E731
                assert name[r.parent_id] in above and d(name[r.parent_id]) == min(map(d, above))


def test_shaved_bristles():
    # a line of five with one bristle on its middle
    nodes, of = M.wavefront(6, np.array([0, 1, 2, 3, 2]), np.array([1, 2, 3, 4, 5]), np.array([(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 0, 0), (2, 1, 0)], float))
    assert nodes.parent_id.tolist() == [-1, 1, 2, 3, 4] and of.tolist() == [1, 2, 3, 4, 5, 3]


def test_voxel_skeletons(spark):
    line = [(i, 0, 0) for i in range(9)]
    y = [(i, 5, 5) for i in range(6)] + [(5 + i, 5 + i, 5) for i in range(1, 4)] + [(5 + i, 5 - i, 5) for i in range(1, 4)]
    nodes, of = M.voxels_to_skeleton(voxel_table(spark, {1: line, 2: y, 3: [(0, 0, 0)]}), (2.0, 2.0, 2.0))
    rows = nodes.collect()
    assert [(r.node_id, r.parent_id, r.x) for r in sorted((r for r in rows if r.neuron == 1), key=lambda r: r.node_id)] == [(i + 1, i if i else -1, 2.0 * i + 1) for i in range(9)]
    assert all(r.radius == pytest.approx(2 / np.pi**0.5) for r in rows if r.neuron == 1)
    assert sorted(Counter(r.parent_id for r in rows if r.neuron == 2 and r.parent_id > 0).values())[-1] == 2
    assert len([r for r in rows if r.neuron == 2]) == 12 and of.count() == 9 + 12 + 1


def brute_bridges(xyz, label, ok, limit):
    n = len(xyz)
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(axis=2)
    links = sorted((d[i, j], i, j) for i in range(n) for j in range(i + 1, n) if label[i] != label[j] and ok[i] and ok[j] and (limit is None or d[i, j] <= limit * limit))
    own, out = label.copy(), []
    for _, i, j in links:
        if own[i] != own[j]:
            own[own == own[j]] = own[i]
            out.append((i, j))
    return sorted(out)


def test_bridges_are_a_minimum_spanning_tree():
    rng = np.random.default_rng(5)
    for t in range(40):
        n = int(rng.integers(1, 150))
        xyz, label, ok = rng.integers(0, int(rng.integers(2, 30)), (n, 3)).astype(float), rng.integers(0, int(rng.integers(1, 12)), n), rng.random(n) < 0.8
        limit = None if t % 2 else 3.0
        assert sorted(map(tuple, G.bridges(xyz, label, ok, limit).tolist())) == brute_bridges(xyz, label, ok, limit)


def test_bridges_of_many_points_take_no_square():
    n = 60_000
    xyz = np.cumsum(np.random.default_rng(6).normal(size=(n, 3)), axis=0)
    assert len(G.bridges(xyz, np.arange(n) // 500)) == n // 500 - 1


def test_nearest_points():
    rng = np.random.default_rng(7)
    for n, k in ((1, 1), (7, 9), (400, 5)):
        xyz, at = rng.integers(0, 9, (n, 3)).astype(float), rng.integers(-2, 12, (60, 3)).astype(float)
        found, dist = G.KdTree(xyz, 8).nearest(at, k)
        d = ((at[:, None] - xyz[None]) ** 2).sum(axis=2)
        best = np.argsort(d, axis=1, kind="stable")[:, :k]
        assert (found[:, : best.shape[1]] == best).all() and (found[:, n:] == -1).all() and np.isinf(dist[:, n:]).all()


def test_heal_mesh(spark):
    tri = [(0, 1, 2), (3, 4, 5), (6, 7, 8)]
    p = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (5, 0, 0), (6, 0, 0), (5, 1, 0), (5, 9, 0), (6, 9, 0), (5, 10, 0), (50, 0, 0)]
    v, f = mesh_table(spark, {1: (p, tri)})
    links = lambda **o: sorted((r.a, r.b, r.dist) for r in M.heal_mesh(v, f, **o).collect())
    assert links() == [(1, 3, 4.0), (4, 9, 44.0), (5, 6, 8.0)]
    assert links(max_dist=8.0) == [(1, 3, 4.0), (5, 6, 8.0)] and links(min_size=2) == [(1, 3, 4.0), (5, 6, 8.0)]
    mask = spark.createDataFrame([(1, x) for x in (0, 3, 7)], "neuron long, vid long")
    assert [x[:2] for x in links(mask=mask)] == [(0, 3), (3, 7)]
    found = M.heal_mesh(v, f)
    assert {r.component for r in M.mesh_components(v, f, found).collect()} == {0} and M.heal_mesh(v, f, extra=found).count() == 0
    big, faces = M.keep_largest(v, f, found.filter("a = 1"))
    assert sorted(r.vid for r in big.collect()) == list(range(6)) and faces.count() == 2
    assert M.heal_mesh(v.filter("neuron = 2"), f).count() == 0


def test_defects_of_meshes(spark):
    v = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 0, 9.0, 9.0, 9.0), (1, 1, 1.0, 0.0, 0.0), (1, 2, 0.0, 1.0, 0.0), (1, 3, None, 0.0, 0.0), (1, None, 1.0, 1.0, 1.0)], "neuron long, vid long, x double, y double, z double")
    f = spark.createDataFrame([(1, 0, 1, 2), (1, 0, 0, 1), (1, 0, 1, 3), (1, 0, 1, 77), (1, None, 1, 2)], "neuron long, v0 long, v1 long, v2 long")
    assert sorted((r.vid, r.component, r.size) for r in M.mesh_components(v, f).collect()) == [(0, 0, 3), (1, 0, 3), (2, 0, 3)]
    nodes, of = M.mesh_to_skeleton(v, f)
    assert nodes.count() == 2 and of.count() == 3


@pytest.mark.parametrize("seed", range(6))
def test_bridges_of_few_labels_are_those_of_the_rounds(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(20, 150))
    xyz, label = rng.integers(0, 6, (n, 3)) * np.array([2.0, 3.0, 5.0]), rng.integers(0, n // 4, n)
    few = [{tuple(sorted(x)) for x in G.bridges(xyz, label, use, far).tolist()} for use, far in ((None, None), (rng.random(n) < 0.7, None), (None, 4.0))]
    rng = np.random.default_rng(seed)
    rng.integers(20, 150), rng.integers(0, 6, (n, 3)), rng.integers(0, n // 4, n)
    monkeypatch.setattr(G, "_few_labels", lambda *_: None)
    assert few == [{tuple(sorted(x)) for x in G.bridges(xyz, label, use, far).tolist()} for use, far in ((None, None), (rng.random(n) < 0.7, None), (None, 4.0))]


def test_many_meshes_in_one_call_are_kept_apart():
    rows = [(neuron, 0, v, 0, 0, float(v), 0.0, 0.0) for neuron in (3, 8) for v in range(4)]
    rows = sorted(rows + [(3, 1, 0, 1, 2, *[np.nan] * 3), (8, 1, 1, 2, 3, *[np.nan] * 3), (8, 1, 1, 2, 9, *[np.nan] * 3), (8, 2, 0, 3, 0, *[np.nan] * 3)])
    m = M.Mesh(pd.DataFrame(rows, columns=["neuron", "kind", "a", "b", "c", "x", "y", "z"]))
    assert m.neuron.tolist() == [3] * 4 + [8] * 4 and m.faces.tolist() == [[0, 1, 2], [5, 6, 7]] and m.extra.tolist() == [[4, 7]]
    nodes, of = M.wavefront(m.n, *m.links(), m.xyz, shave=False, owner=m.neuron)
    assert nodes.groupby("owner")["node_id"].apply(list).to_dict() == {3: [1, 2, 3], 8: [1, 2, 3]} and of.tolist() == [1, 3, 3, 2] * 2


def test_faces_of_blocks_with_their_corners(spark):
    cells = {1: [(0, 0, 0), (1, 0, 0), (1, 1, 1)], 2: list(itertools.product(range(-1, 2), repeat=3))}
    v, f = M.voxels_to_mesh(voxel_table(spark, cells), "blocks", (2.0, 3.0, 5.0))
    own = M.voxels_to_mesh(voxel_table(spark, cells), "blocks", (2.0, 3.0, 5.0), corners=True)[1]
    names = ["neuron", "v0", "v1", "v2", *(f"{k}{c}" for k in "abc" for c in "xyz")]
    got = own.select(*names).collect()
    assert len(got) == f.count() and sorted(got) == sorted(face_table(v, f).select(*names).collect())
    assert "Join" not in [w for line in face_table(v, own)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "mask" not in line for w in line.split()]
