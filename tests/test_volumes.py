"""Points in volumes and somata, where edges, corners and pieces decide."""

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from arbora.operators import building as B
from arbora.operators import meshes as M
from tests.test_meshes import mesh_table, voxel_table
from tests.test_surfaces import sphere


def points(spark, rows):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rows)], "pid long, x double, y double, z double")


def inside(spark, rows, v, f):
    out = {}
    for r in B.in_volumes(points(spark, rows), v, f).collect():
        out.setdefault(r.volume, set()).add(r.pid)
    return out


def test_rays_through_edges_and_corners(spark):
    cells = {1: list(itertools.product(range(2), repeat=3)), 2: [(0, 0, 0), (1, 1, 1), (3, 0, 0)]}
    v, f = M.voxels_to_mesh(voxel_table(spark, cells), "blocks")
    grid = list(itertools.product(np.arange(-0.5, 4.5, 0.25), np.arange(-0.25, 2.5, 0.25), np.arange(-0.25, 2.5, 0.25)))
    got = inside(spark, grid, v, f)
    for n, own in cells.items():
        for i, p in enumerate(grid):
            strictly = any(all(c < x < c + 1 for c, x in zip(cell, p)) for cell in own)
            if n == 1:
                strictly = all(0 < x < 2 for x in p)
            beside = all(any(x < c or x > c + 1 for c, x in zip(cell, p)) for cell in own)
            if strictly or beside:  # what lies on the surface itself may count as either
                assert (i in got[n]) == strictly, (n, p)


def test_centre_of_a_cube_of_two_triangles_a_side(spark):
    corners = list(itertools.product((0, 1), repeat=3))
    quads = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    for turn in (0, 1):
        f = [t for q in quads for r in [q[turn:] + q[:turn]] for t in ((r[0], r[1], r[2]), (r[0], r[2], r[3]))]
        v, faces = mesh_table(spark, {7: (corners, f)})
        places = [(0.5, 0.5, 0.5), (0.5, 0.25, 0.75), (0.5, 0.3, 0.7), (0.1, 0.9, 0.1), (0.1, 0.7, 0.7), (1.5, 0.5, 0.5), (-0.5, 0.5, 0.5), (0.5, 1.5, 0.5), (-1, 0, 0), (-1, 1, 1), (-1, 0.5, 0.5)]
        assert inside(spark, places, v, faces) == {7: {0, 1, 2, 3, 4}}


def test_sphere_from_all_sides(spark):
    v, f = sphere(3)
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.normal(size=(500, 3)) * 0.7, v * 0.5, v * 1.5, v[:, [1, 0, 2]] * [0.3, 1, 1] * 0.5])
    tables = mesh_table(spark, {1: (v, f), 2: (v * 0.01 + 0.2, f), 3: (v * 1000, f)})
    got = inside(spark, rows, *tables)
    size = np.linalg.norm(rows, axis=1)
    sure = (size < 0.97) | (size > 1)
    assert {i for i in got[1] if sure[i]} == set(np.flatnonzero(size < 0.97).tolist())
    assert len(got[3]) == len(rows) and all(np.linalg.norm(rows[i] - 0.2) < 0.01 for i in got.get(2, ()))


def test_soma_by_label_is_the_largest_piece(spark):
    rows = [(1, i, i - 1 if i > 1 else -1, 10.0 * i, "s" if i in (2, 3, 6, 7, 8) else "n", -1.0) for i in range(1, 10)] + [(2, 1, -1, 0.0, "n", 5.0), (3, 1, -1, 0.0, "s", 5.0)]
    t = spark.createDataFrame([(n, i, p, x, 0.0, 0.0, r, s) for n, i, p, x, s, r in rows], "neuron long, node_id long, parent_id long, x double, y double, z double, radius double, label string")
    got = lambda **o: {r.neuron: r.soma for r in B.find_soma(t, **o).collect()}
    assert got(label="s") == {1: 7, 3: 1}
    assert got(label="s", min_radius=1.0) == {1: 7, 3: 1}  # no radius is known: the label decides
    assert got(min_radius=1.0) == {2: 1, 3: 1} and got() == {}


def test_axis_planes_are_those_of_the_plain_formula(spark):
    import random

    from arbora.operators.space import resample_along_axis

    r = random.Random(7)
    edges = {i: (r.randrange(1000, 100_000) / 100, r.randrange(1000, 100_000) / 100, 10.0 * r.randrange(500), 5000.0 + 10 * r.randrange(500)) for i in range(50)}
    rows = [row for i, (x, px, z, pz) in edges.items() for row in ((i, 1, -1, px, 0.0, pz), (i, 2, 1, x, 0.0, z))]
    got = resample_along_axis(spark.createDataFrame(rows, "neuron long, node_id long, parent_id long, x double, y double, z double"), 70.0).collect()
    assert len(got) > 1000
    for t in got:
        x, px, z, pz = edges[t.neuron]
        assert t.x == x + (px - x) * (t.plane * 70.0 - z) / (pz - z)


def test_no_row_of_a_point_and_a_volume_is_moved(spark):
    cells = {n: list(itertools.product(range(n), repeat=3)) for n in (1, 2, 3)}
    v, f = M.voxels_to_mesh(voxel_table(spark, cells), "blocks")
    places = list(itertools.product((0.4, 1.4, 2.4), repeat=3))
    q = spark.createDataFrame([(i % 2, i, *p) for i, p in enumerate(places)], "neuron long, pid int, x double, y double, z double")
    want = {(n, k): sum(i for i, p in enumerate(places) if i % 2 == k and max(p) < n) for n in cells for k in (0, 1)}
    t = B.intersection_matrix(q, v, f, value="pid")
    assert {(r.volume, r.neuron): r.value for r in t.collect()} == {k: s for k, s in want.items() if any(i % 2 == k[1] and max(p) < k[0] for i, p in enumerate(places))}
    for df in (t, B.in_volumes(q, v, f)):  # points find their volumes without a join by place
        assert not re.search(r"Join Inner, .*\bx#", df._jdf.queryExecution().optimizedPlan().toString())


def test_points_on_a_face_are_outside(spark):
    v, f = M.voxels_to_mesh(voxel_table(spark, {1: [(0, 0, 0)], 2: [(0, 0, 0), (1, 0, 0), (1, 1, 0)]}), "blocks")
    grid = [(x, y, 0.25) for x in (0.0, 0.5, 1.0, 1.5, 2.0) for y in (0.25, 0.75, 1.25)]
    got = inside(spark, grid, v, f)
    assert {grid[i] for i in got[1]} == {(0.5, 0.25, 0.25), (0.5, 0.75, 0.25)}
    assert {grid[i] for i in got[2]} == {(x, y, 0.25) for x in (0.5, 1.0, 1.5) for y in (0.25, 0.75)} | {(1.5, 1.25, 0.25)}


def test_a_point_in_many_volumes_is_given_once(spark, monkeypatch):
    monkeypatch.setattr(B, "FEW", 2)
    v, f = M.voxels_to_mesh(voxel_table(spark, {n: [(i, 0, 0) for i in range(n % 7 + 1)] for n in range(1, 40)}), "blocks")
    rows = [(1, i + 1, i, float(i) + 0.5, 0.5, 0.5, 1.0, "0") for i in range(9)]
    nodes = spark.createDataFrame(rows, "neuron long, node_id long, parent_id long, x double, y double, z double, radius double, label string").withColumn("parent_id", F.when(F.col("parent_id") == 0, -1).otherwise(F.col("parent_id")))
    own = nodes.select("neuron", "node_id", *"xyz")
    given = B._held(own, v, f, lambda rows, at, volume: rows.take(pa.array(at)), own.schema, once=True).collect()
    assert sorted(r.node_id for r in given) == [1, 2, 3, 4, 5, 6, 7]
    assert sorted(r.node_id for r in B.prune_by_volume(nodes, v, f).collect()) == [1, 2, 3, 4, 5, 6, 7]
    assert sorted(r.node_id for r in B.prune_by_volume(nodes, v, f, "OUT").collect()) == [8, 9]


def test_points_are_given_in_parts(monkeypatch):
    monkeypatch.setattr(B, "HELD_PAIRS", 100)
    t = [((0, 0, 0), (0, 8, 0), (0, 0, 8)), ((4, 0, 0), (4, 8, 0), (4, 0, 8))]
    corners = np.array([np.ravel(x) for _ in range(10) for x in t], float)
    faces = B._Faces(corners, np.full(20, 8.0), np.zeros(20), np.zeros(20), np.repeat(np.arange(10), 2))
    x = np.tile([-1.0, 0.0, 1.0, 3.0, 4.0, 5.0], 50)
    parts = list(faces.around(x, np.ones(300), np.ones(300)))
    assert len(parts) > 10 and max(len(at) for at, _ in parts) <= 100
    assert sorted(zip(*(np.concatenate(c).tolist() for c in zip(*parts)))) == [(i, n) for i in range(300) if 0 < x[i] < 4 for n in range(10)]
