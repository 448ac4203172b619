"""Decimation, openness and closed holes on spheres and boxes, against brute force."""

from collections import Counter

import numpy as np
import pytest

from arbora.operators import meshes as M
from arbora.operators import surfaces as S
from tests.test_meshes import collect_mesh, mesh_table, volume, voxel_table


def sphere(rounds, radius=1.0, at=(0.0, 0.0, 0.0)):
    """An octahedron, each face in four, ``rounds`` times, pushed out to the sphere."""
    v = [np.array(x, float) for x in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))]
    f = [(x, y, z) if (x == 0) ^ (y == 2) ^ (z == 4) ^ False else (y, x, z) for x in (0, 1) for y in (2, 3) for z in (4, 5)]
    for _ in range(rounds):
        half = {}

        def mid(a, b):
            key = (min(a, b), max(a, b))
            if key not in half:
                half[key] = len(v)
                p = v[a] + v[b]
                v.append(p / np.linalg.norm(p))
            return half[key]

        f = [t for a, b, c in f for x, y, z in [(mid(a, b), mid(b, c), mid(c, a))] for t in ((a, x, z), (x, b, y), (z, y, c), (x, y, z))]
    return np.array(v) * radius + np.array(at), np.array(f)


def directed(faces):
    return Counter((int(t[i]), int(t[(i + 1) % 3])) for t in faces for i in range(3))


def closed(faces):
    e = directed(faces)
    return all(e[b, a] == n for (a, b), n in e.items())


def test_sphere_is_wound_outward():
    v, f = sphere(2)
    assert closed(f) and volume(v, f) > 3.5


@pytest.mark.parametrize("target", [2000, 400, 60])
def test_decimated_sphere(target):
    v, f = sphere(4)
    p, tri, into, error = S.decimate(v, f, target, np.zeros(len(v), bool))
    used = np.unique(tri)
    assert len(tri) == target and closed(tri) and max(directed(tri).values()) == 1
    assert len(used) - 3 * len(tri) // 2 + len(tri) == 2 and set(into.tolist()) == set(used.tolist())
    # no face is turned over
    n = np.cross(p[tri[:, 1]] - p[tri[:, 0]], p[tri[:, 2]] - p[tri[:, 0]])
    assert ((n * p[tri].mean(axis=1)).sum(axis=1) > 0).all()
    # each vertex lies within the error of the planes of the faces that it stands for
    a = v[f[:, 0]]
    unit = np.cross(v[f[:, 1]] - a, v[f[:, 2]] - a)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    for k in range(3):
        assert np.abs(((p[into[f[:, k]]] - a) * unit).sum(axis=1)).max() <= error + 1e-9
    assert abs(volume(p, tri) - volume(v, f)) < 4 * np.pi * (1 + error) ** 2 * (error + 0.02)


def test_decimation_keeps_what_is_locked():
    v, f = sphere(3)
    locked = np.zeros(len(v), bool)
    locked[::7] = True
    p, tri, into, _ = S.decimate(v, f, 10, locked)
    assert (into[locked] == np.flatnonzero(locked)).all() and (p[locked] == v[locked]).all() and closed(tri)
    p, tri, _, error = S.decimate(v, f, 10, np.zeros(len(v), bool), max_error=0.1)
    assert error <= 0.1 and 10 < len(tri) < len(f)


def test_flat_faces_cost_nothing():
    grid = [(x, y) for x in range(6) for y in range(6)]
    v = np.array([(x, y, 0) for x, y in grid], float)
    at = {g: i for i, g in enumerate(grid)}
    f = np.array([t for x in range(5) for y in range(5) for t in ((at[x, y], at[x + 1, y], at[x, y + 1]), (at[x + 1, y], at[x + 1, y + 1], at[x, y + 1]))])
    border = np.zeros(len(v), bool)
    border[S._border(f).ravel()] = True
    p, tri, _, error = S.decimate(v, f, 1, border)
    n = np.cross(p[tri[:, 1]] - p[tri[:, 0]], p[tri[:, 2]] - p[tri[:, 0]])
    assert len(tri) == 18 and error < 1e-9 and n[:, 2].min() > 0 and n[:, 2].sum() / 2 == pytest.approx(25)


def test_simplify_meshes(spark):
    meshes = {1: sphere(3), 2: sphere(1), 3: (sphere(2)[0], sphere(2)[1][:-5])}
    v, f = mesh_table(spark, meshes)
    new, tri, went = S.simplify_mesh(v, f, 0.5)
    got = collect_mesh(new, tri)
    assert {n: len(x[1]) for n, x in got.items()} == {1: 256, 2: 16, 3: 61} and went.count() == sum(len(x[0]) for x in meshes.values())
    rim = set(S._border(np.array(meshes[3][1])).ravel().tolist())
    assert all(np.allclose(got[3][0][i], meshes[3][0][i]) for i in rim)
    lock = spark.createDataFrame([(1, i) for i in range(0, 258, 5)], "neuron long, vid long")
    got = collect_mesh(*S.simplify_mesh(v, f, 40, lock=lock)[:2])
    assert all(np.allclose(got[1][0][i], meshes[1][0][i]) for i in range(0, 258, 5))
    with pytest.raises(ValueError):
        S.simplify_mesh(v, f, 0)
    assert S.simplify_mesh(v.filter("neuron = 9"), f.filter("neuron = 9"), 0.5)[1].count() == 0


def test_simplify_in_blocks_fits_together(spark):
    meshes = {1: sphere(4), 2: sphere(2, 0.3, (5, 5, 5))}
    v, f = mesh_table(spark, meshes)
    new, tri, went = S.simplify_mesh(v, f, 0.4, block=0.7)
    got = collect_mesh(new, tri)
    assert new.groupBy("neuron", "vid").count().filter("count > 1").count() == 0
    for n, (points, faces) in got.items():
        assert closed(faces) and len(faces) < 0.75 * len(meshes[n][1]) and volume(points, faces) == pytest.approx(volume(*meshes[n]), rel=0.05 if n == 1 else 0.25)
    assert went.groupBy("neuron", "vid").count().filter("count > 1").count() == 0


def brute_open(v, f, n_rays, seed):
    start, way = S.rays(v, f, np.arange(len(f)), n_rays, None, seed)
    out = []
    for s, d in zip(start, way):
        hit = False
        for a, b, c in v[f]:
            m = np.stack([b - a, c - a, -d], axis=1)
            if abs(np.linalg.det(m)) > 1e-14:
                x, y, t = np.linalg.solve(m, s - a)
                hit |= x >= 0 and y >= 0 and x + y <= 1 and t > 0
        out.append(not hit)
    return np.array(out).reshape(-1, n_rays).mean(axis=1)


def test_openness_is_brute_force(spark):
    rng = np.random.default_rng(2)
    blobs = {n: [tuple(x) for x in np.unique(rng.integers(0, 3, (14, 3)), axis=0).tolist()] for n in range(2)}
    got = collect_mesh(*M.voxels_to_mesh(voxel_table(spark, blobs), "cubes"))
    for points, faces in got.values():
        ids = sorted(points)
        v, f = np.array([points[i] for i in ids]), np.searchsorted(ids, np.array(faces))
        v = v + rng.normal(0, 1e-3, v.shape)
        for shift in (0.0, 3.0):  # also rays beside the mesh
            assert np.allclose(S.face_openness(v + shift, f, 8, None, 5), brute_open(v + shift, f, 8, 5))
    v, f = mesh_table(spark, {1: sphere(2)})
    assert {r.open for r in S.openness(v, f).collect()} == {1.0}
    part = S.face_openness(*sphere(2), 16, None, 1985, np.array([3, 5]))
    assert part.tolist() == [1.0, 1.0]


def test_spray_is_denser_towards_the_normal():
    d = S.spray(20_000, 1)
    assert np.allclose((d**2).sum(axis=1), 1) and (d[:, 2] >= 0).all() and d[:, 2].mean() == pytest.approx(2 / 3, abs=0.01)


def test_buried_sphere_goes(spark):
    outer, inner = sphere(3), sphere(2, 0.4)
    both = np.concatenate([outer[0], inner[0]]), np.concatenate([outer[1], inner[1] + len(outer[0])])
    v, f = mesh_table(spark, {1: both, 2: outer})
    points, tri = S.drop_internals(v, f)
    got = collect_mesh(points, tri)
    assert len(got[1][1]) == len(outer[1]) == len(got[2][1]) and max(got[1][0]) == len(outer[0]) - 1
    assert S.drop_internals(v.filter("neuron = 9"), f.filter("neuron = 9"))[1].count() == 0


def test_closed_holes():
    rng = np.random.default_rng(4)
    for rounds in (1, 2, 3):
        v, f = sphere(rounds)
        for share in (0.05, 0.3, 0.6):
            cut = f[rng.random(len(f)) > share]
            assert closed(S._closed(v, cut))
    v, f = sphere(2)
    around = f[~(f == 0).any(axis=1)]
    (loop,) = S.hole_loops(around)
    assert len(loop) == 4 and volume(v, S._closed(v, around)) > 0.9 * volume(v, around)
    assert len(S._closed(v, around, largest=3)) == len(around)


def test_fill_holes(spark):
    v, f = sphere(2)
    got = S.fill_holes(*mesh_table(spark, {1: (v, f[3:]), 2: (v, f)})).collect()
    assert closed([(r.v0, r.v1, r.v2) for r in got if r.neuron == 1]) and sum(r.neuron == 2 for r in got) == len(f)
