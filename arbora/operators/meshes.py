"""Surfaces: voxels to meshes, meshes and voxels to skeletons, bridges between fragments, decimation, openness.

A mesh is two long tables, ``vertices`` (neuron, vid, x, y, z) and ``faces`` (neuron, v0, v1, v2). What looks at one
cell at a time is joins and aggregates; what walks over a surface runs on whole meshes in numpy, many in a task,
after one shuffle by neuron. Memory is then one batch and the mesh still open: about 400 bytes a vertex; several hundred million
vertices in one mesh are cut into objects of their own first (``topology.split_components``, grid cells).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import durable, per_neuron, written
from . import geometry as G

XYZ = ["x", "y", "z"]
#: Cells and edges are named by one whole number: twenty bits an axis.
_HALF = 1 << 19
#: Rows of meshes that are looked at in one call, where that is done for many at once.
AT_ONCE = 200_000


# --- voxels to meshes ----------------------------------------------------------------------------------------------
def _corner_cycle(axis: int, side: int) -> list[int]:
    """Corners of a cube's face, counter-clockwise seen from outside. Corner c lies at (c & 1, c >> 1 & 1, c >> 2)."""
    u, v = 1 << (axis + 1) % 3, 1 << (axis + 2) % 3
    ring = [0, u, u | v, v]
    return [c | side << axis for c in (ring if side else ring[::-1])]


def _edge(a: int, b: int) -> tuple[int, int]:
    """(lower corner, axis) of the cube edge between two corners."""
    return min(a, b), (a ^ b).bit_length() - 1


def _same_side(a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Whether two cube edges lie in one face of the cube."""
    corners = [a[0], a[0] | 1 << a[1], b[0], b[0] | 1 << b[1]]
    return any(len({c >> x & 1 for c in corners}) == 1 for x in range(3))


def _ears(loop: list, links: set) -> list[tuple] | None:
    """Triangles of a loop without a chord inside a face of the cube, where a neighbour could have the same chord."""
    if len(loop) == 3:
        return [tuple(loop)]
    for i in range(1, len(loop) - 1):
        a, b, c = loop[0], loop[i], loop[-1]
        left, right = loop[: i + 1], loop[i:]
        if all(frozenset(x) in links or not _same_side(*x) for x in ((a, b), (b, c))):
            parts = [_ears(x, links | {frozenset((a, b)), frozenset((b, c))}) if len(x) > 2 else [] for x in (left, right)]
            if None not in parts:
                return [(a, b, c), *parts[0], *parts[1]]
    return None


@lru_cache(1)
def surface_cases() -> dict[int, list[tuple]]:
    """filled corners of a cube -> triangles of its crossed edges, outward; made by rule.

    On each face of the cube every run of filled corners is cut off on its own, so two cubes agree on the face they share
    and diagonal corners stay apart; the cuts chain up to loops, and loops are split into triangles.
    """
    out = {}
    for mask in range(1, 255):
        after = {}
        for axis, side in itertools.product(range(3), (0, 1)):
            ring = _corner_cycle(axis, side)
            full = [mask >> c & 1 for c in ring]
            for i in range(4):
                if full[i] and not full[i - 1]:
                    j = i
                    while full[(j + 1) % 4]:
                        j += 1
                    after[_edge(ring[i - 1], ring[i])] = _edge(ring[j % 4], ring[(j + 1) % 4])
        tris: list[tuple] = []
        while after:
            loop = [next(iter(after))]
            while (x := after.pop(loop[-1])) != loop[0]:
                loop.append(x)
            links = {frozenset(x) for x in zip(loop, loop[1:] + loop[:1])}
            tris += _ears(loop, links)
        out[mask] = tris
    return out


def _cells(voxels: DataFrame) -> DataFrame:
    """(neuron, i, j, k, mask): cubes between voxels and which of their corners are filled; (i, j, k) is the lowest corner."""
    v = voxels.select("neuron", *"ijk").distinct()
    corner = F.explode(F.array(*(F.struct(*(F.lit(c >> n & 1).alias(x) for n, x in enumerate("abc")), F.lit(1 << c).alias("bit")) for c in range(8)))).alias("c")
    at = v.select("neuron", *"ijk", corner).select("neuron", *((F.col(x) - F.col(f"c.{y}")).alias(x) for x, y in zip("ijk", "abc")), "c.bit")
    return at.groupBy("neuron", *"ijk").agg(F.bit_or("bit").alias("mask")).filter("mask < 255")


def _name(axis: int, *off: int) -> int:
    """What an edge (axis 0 to 2) or a cell (3), that many places on, adds to the name of a place (``_place``)."""
    for c in off or (0, 0, 0):
        axis = axis * 2 * _HALF + c
    return axis


def _place() -> F.Column:
    """One whole number for a place (i, j, k); names of what lies around it are this and a constant."""
    i, j, k = map(F.col, "ijk")
    near = (F.abs(i) < _HALF) & (F.abs(j) < _HALF) & (F.abs(k) < _HALF)
    known = ((i + _HALF) * (2 * _HALF) + j + _HALF) * (2 * _HALF) + k + _HALF
    return F.when(near, known).otherwise(F.raise_error(F.lit("voxels must lie within 2 ** 19 of the origin")).cast("long"))


def voxels_to_mesh(voxels: DataFrame, method: str = "nets", spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), step: int = 1, corners: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) of the surface of each object's voxels (neuron, i, j, k); voxel (i, j, k) fills [i, i + 1) on each axis.

    ``nets``: one vertex a cube of eight voxels that the surface passes, at the mean of its crossings; ``blocks``: the voxels' own
    faces, corners on the grid; ``cubes``: marching cubes with vertices halfway between a filled and an empty voxel. The
    last is always closed, two faces an edge, and touches itself nowhere: voxels that meet in an edge or corner only stay apart.
    ``blocks`` holds exactly the voxels' volume. ``step`` merges that many voxels along each axis first. Faces are wound outward. Null
    places are left out, repeated voxels count once. Ids name places, so they are unique in an object but not
    consecutive (``renumber``). ``corners``: faces of ``blocks`` also hold their corners' coordinates (ax .. cz), so measures of them
    join nothing. Joins and aggregates by cell only: one large object is spread like many small ones.
    """
    if method not in ("nets", "blocks", "cubes"):
        raise ValueError("method must be nets, blocks or cubes")
    if corners and method != "blocks":
        raise ValueError("only faces of blocks hold corners")
    v = voxels.dropna(subset=["i", "j", "k"])
    if step > 1:
        v, spacing = v.select("neuron", *(F.floor(F.col(c) / step).alias(c) for c in "ijk")), tuple(s * step for s in spacing)
    v = v.select("neuron", *(F.col(c).cast("long").alias(c) for c in "ijk"))
    cells = _cells(v)
    spark = voxels.sparkSession
    if method == "cubes":
        rows = [(m, *(_name(a, *(c >> n & 1 for n in range(3))) for c, a in t)) for m, ts in surface_cases().items() for t in ts]
        table = spark.createDataFrame(rows, "mask int, d0 long, d1 long, d2 long")
        t = cells.withColumn("at", _place()).join(F.broadcast(table), "mask")
        faces = t.select("neuron", *((F.col("at") + F.col(f"d{n}")).alias(f"v{n}") for n in range(3)))
        # a crossing belongs to the edge's lower voxel, so each is found once: at corner 0 of that voxel's cube
        cross = F.explode(F.filter(F.array(*(F.struct(F.lit(n).alias("axis"), F.lit(_name(n)).alias("d"), ((F.col("mask").bitwiseAND(1) > 0) != (F.col("mask").bitwiseAND(1 << (1 << n)) > 0)).alias("on")) for n in range(3))), lambda x: x["on"])).alias("e")
        p = cells.select("neuron", *"ijk", _place().alias("at"), cross)
        vertices = p.select("neuron", (F.col("at") + F.col("e.d")).alias("vid"), *(((F.col(c) + 0.5 + F.when(F.col("e.axis") == n, 0.5).otherwise(0.0)) * s).alias(x) for n, (c, x, s) in enumerate(zip("ijk", XYZ, spacing))))
        return vertices, faces
    if method == "nets":
        means = []
        for m in range(1, 255):
            at = [[(c >> n & 1) + (0.5 if n == a else 0.0) for n in range(3)] for c in range(8) for a in range(3) if not c >> a & 1 and (m >> c & 1) != (m >> (c | 1 << a) & 1)]
            means.append((m, *np.mean(at, axis=0).tolist()))
        t = cells.join(F.broadcast(spark.createDataFrame(means, "mask int, ox double, oy double, oz double")), "mask")
        place = [F.col(c) + 0.5 + F.col(f"o{x}") for c, x in zip("ijk", XYZ)]
    else:
        t, place = cells, [F.col(c) + 1.0 for c in "ijk"]
    vertices = t.select("neuron", (_place() + _name(3)).alias("vid"), *((p * s).alias(x) for p, x, s in zip(place, XYZ, spacing)))
    rows = []
    for n in range(3):  # the four cubes around a crossed edge, in the sense of a filled lower voxel
        u, w = [0, 0, 0], [0, 0, 0]
        u[(n + 1) % 3], w[(n + 2) % 3] = -1, -1
        ring = [(0, 0, 0), tuple(u), tuple(a + b for a, b in zip(u, w)), tuple(w)]
        for m in range(1, 255):
            low, high = m & 1 > 0, m >> (1 << n) & 1 > 0
            if low != high:
                order = (0, 1, 2, 3) if low else (0, 3, 2, 1)
                rows += [(m, *(_name(3, *ring[order[x]]) for x in tri), *(c for x in tri for c in ring[order[x]])) for tri in ((0, 1, 2), (0, 2, 3))]
    names = [f"{k}{c}" for k in "abc" for c in XYZ]
    table = spark.createDataFrame(rows, "mask int, d0 long, d1 long, d2 long, " + ", ".join(f"o{x} int" for x in names))
    t = cells.withColumn("at", _place()).join(F.broadcast(table), "mask")
    own = [((F.col("ijk"[m % 3]) + 1.0 + F.col(f"o{x}")) * spacing[m % 3]).alias(x) for m, x in enumerate(names) if corners]
    faces = t.select("neuron", *((F.col("at") + F.col(f"d{n}")).alias(f"v{n}") for n in range(3)), *own)
    return vertices, faces


def renumber(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same mesh with vertices 0, 1, 2 ... of each object, in order of their ids (one window by neuron)."""
    from pyspark.sql import Window

    number = vertices.withColumn("__n", (F.row_number().over(Window.partitionBy("neuron").orderBy("vid")) - 1).cast("long"))
    for c in ("v0", "v1", "v2"):
        faces = faces.join(number.select("neuron", F.col("vid").alias(c), F.col("__n").alias(f"__{c}")), ["neuron", c])
    return number.withColumn("vid", F.col("__n")).drop("__n"), faces.select("neuron", *(F.col(f"__{c}").alias(c) for c in ("v0", "v1", "v2")))


def edges(faces: DataFrame) -> DataFrame:
    """(neuron, a, b, n): edges a < b and how many faces have them."""
    e = F.explode(F.array(*(F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))))).alias("e")
    return faces.select("neuron", e).groupBy("neuron", "e.a", "e.b").agg(F.count("*").alias("n"))


# --- whole meshes in a task ----------------------------------------------------------------------------------------
class Mesh:
    """One mesh, or several at once: ``vid`` ascending in each neuron (``neuron`` by vertex, ``name`` of the first), ``xyz``, ``faces`` as positions in them,
    ``extra`` links between vertices."""

    def __init__(self, rows: pd.DataFrame):
        kind = rows["kind"].to_numpy()
        known, own = np.unique(rows["neuron"].to_numpy(np.int64), return_inverse=True)
        v = kind == 0
        vid, xyz = rows["a"].to_numpy(np.int64)[v], rows[XYZ].to_numpy(float)[v]
        self._ids, at = np.unique(vid, return_inverse=True)
        key = own[v] * max(len(self._ids), 1) + at
        keep = np.concatenate([[True], key[1:] != key[:-1]]) & np.isfinite(xyz).all(axis=1) if len(key) else np.zeros(0, bool)
        self.vid, self.xyz, self._key = vid[keep], xyz[keep], key[keep]
        self.n = len(self.vid)
        self.neuron, self.name = known[own[v][keep]], known[0]
        ids = rows[["a", "b", "c"]].to_numpy(np.int64)
        self.faces = self._at(own[kind == 1], ids[kind == 1])
        self.faces = self.faces[(self.faces[:, 0] != self.faces[:, 1]) & (self.faces[:, 1] != self.faces[:, 2]) & (self.faces[:, 2] != self.faces[:, 0])]
        self.extra = self._at(own[kind == 2], ids[kind == 2][:, :2])

    def _at(self, own: np.ndarray, ids: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.zeros((0, ids.shape[1]), np.int64)
        at = np.minimum(np.searchsorted(self._ids, ids), len(self._ids) - 1)
        key = own[:, None] * len(self._ids) + at
        place = np.minimum(np.searchsorted(self._key, key), self.n - 1)
        return place[((self._ids[at] == ids) & (self._key[place] == key)).all(axis=1)]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Ends of all edges, each once, extra links too."""
        e = np.concatenate([self.faces[:, [0, 1]], self.faces[:, [1, 2]], self.faces[:, [2, 0]], self.extra])
        key = np.unique(e.min(axis=1) * max(self.n, 1) + e.max(axis=1))
        return key // max(self.n, 1), key % max(self.n, 1)


def per_mesh(vertices: DataFrame, faces: DataFrame, fn: Callable[[Mesh], pd.DataFrame], schema: str, extra: DataFrame | None = None, at_once: bool = False) -> DataFrame:
    """Runs ``fn`` on whole meshes, many in a task: one shuffle of vertices and faces together.

    Repeated vertices count once; faces and links to unknown vertices, vertices without a place and faces with a repeated
    corner are left out. ``fn`` gives a frame without the neuron, which is put before it. Tables with a column ``part``
    are cut by it: a part, not a neuron, is what ``fn`` gets. ``at_once``: ``fn`` gets many meshes as one ``Mesh`` and gives the neuron, too.
    """
    key = ["part", "neuron"] if "part" in vertices.columns else ["neuron"]
    none = [F.lit(None).cast("double").alias(c) for c in XYZ]
    long = lambda c, n: F.col(c).cast("long").alias(n)
    rows = vertices.select(*key, F.lit(0).alias("kind"), long("vid", "a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c"), *(F.col(c).cast("double").alias(c) for c in XYZ)).dropna(subset=["a"])
    rows = rows.union(faces.select(*key, F.lit(1), long("v0", "a"), long("v1", "b"), long("v2", "c"), *none).dropna(subset=["a", "b", "c"]))
    if extra is not None:
        rows = rows.union(extra.select(*key, F.lit(2), long("a", "a"), long("b", "b"), F.lit(0).cast("long"), *none).dropna(subset=["a", "b"]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if at_once:
            return fn(Mesh(pdf))
        out = []
        for _, g in pdf.groupby(key[0], sort=False):
            t = fn(Mesh(g))
            t.insert(0, "neuron", g["neuron"].iloc[0])
            out.append(t)
        return pd.concat(out, ignore_index=True)

    return per_neuron(rows, run, schema, key=key[0], order=("kind", "a", "b", "c"), least=AT_ONCE if at_once else 0, union=True)


# --- skeletons -----------------------------------------------------------------------------------------------------
def wavefront(n: int, a: np.ndarray, b: np.ndarray, xyz: np.ndarray, step: int = 1, shave: bool = True, radius=None, owner: np.ndarray | None = None) -> tuple[pd.DataFrame, np.ndarray]:
    """(nodes, node of each point) of a graph: a wave from the first point of each component, each ring one node.

    Points that are equally many steps away (``step`` of them together) and connected among themselves are a ring; its node lies at
    their mean. Its parent is the ring of the step before that it touches, the nearest of several (ties: the earlier),
    so a component is one tree. ``shave`` drops leaves that hang on a branch point; their points go to it. ``radius``: function of (points of a ring,
    mean distance to its node); else that distance; a ring of one point has half its parent's radius. ``owner``: ascending number of each point's
    graph, if there are several; each one's nodes are numbered from 1, and the nodes' graphs are given as ``owner``.
    """
    owner = np.zeros(n, np.int64) if owner is None else owner
    first, near = G.neighbours(n, a, b)
    seeds = np.flatnonzero(G.components(n, a, b) == np.arange(n))
    wave = G.levels(n, first, near, seeds) // step
    same = wave[a] == wave[b]
    head, ring = np.unique(G.components(n, a[same], b[same]), return_inverse=True)
    order = np.lexsort((head, wave[head], owner[head]))  # parents come before their children
    number = np.empty(len(head), np.int64)
    number[order] = np.arange(len(head))
    ring, head = number[ring], head[order]
    size = np.bincount(ring, minlength=len(head))
    centre = np.stack([np.bincount(ring, xyz[:, c], len(head)) for c in range(3)], axis=1) / np.maximum(size, 1)[:, None]
    spread = np.bincount(ring, np.sqrt(((xyz - centre[ring]) ** 2).sum(axis=1)), len(head)) / np.maximum(size, 1)
    r = spread if radius is None else radius(size, spread)
    up, down = np.where(wave[a] < wave[b], a, b)[~same], np.where(wave[a] < wave[b], b, a)[~same]
    pairs = np.unique(ring[down] * max(len(head), 1) + ring[up])
    child, parent_ = pairs // max(len(head), 1), pairs % max(len(head), 1)
    gap = np.round(((centre[child] - centre[parent_]) ** 2).sum(axis=1), 9)
    by = np.lexsort((parent_, gap, child))
    by = by[np.concatenate([[True], child[by][1:] != child[by][:-1]])] if len(by) else by
    parent = np.full(len(head), -1)
    parent[child[by]] = parent_[by]
    if shave:
        kids = np.bincount(parent[parent >= 0], minlength=len(head))
        gone = (kids == 0) & (parent >= 0)
        gone[gone] = kids[parent[gone]] > 1
        ring = np.where(gone[ring], parent[ring], ring)
        stay = np.cumsum(~gone) - 1
        parent = np.where(parent >= 0, stay[parent], -1)[~gone]
        ring, centre, r = stay[ring], centre[~gone], r[~gone]
    r = np.where((r == 0) & (parent >= 0), r[parent] / 2, r)
    of = np.empty(len(parent), np.int64)
    of[ring] = owner  # every node has a point
    number = np.arange(1, len(parent) + 1) - np.searchsorted(of, of)
    nodes = pd.DataFrame({"owner": of, "node_id": number, "parent_id": np.where(parent >= 0, number[parent], -1), "x": centre[:, 0], "y": centre[:, 1], "z": centre[:, 2], "radius": r})
    return nodes, number[ring]


_SKELETON = "neuron long, kind int, id long, node_id long, parent_id long, x double, y double, z double, radius double"


def _two(rows: DataFrame, id_name: str) -> tuple[DataFrame, DataFrame]:
    """Skeleton nodes and the map of points to nodes, from rows written once."""
    rows = durable(rows)
    nodes = rows.filter("kind = 0").select("neuron", "node_id", "parent_id", *XYZ, "radius", F.lit(0).alias("label"))
    return nodes, rows.filter("kind = 1").select("neuron", F.col("id").alias(id_name), "node_id")


def _rows(nodes: pd.DataFrame, ids: np.ndarray, of: np.ndarray, owner: np.ndarray | int = 0) -> pd.DataFrame:
    a = nodes.assign(kind=0, id=0)
    b = pd.DataFrame({"owner": owner, "kind": 1, "id": ids, "node_id": of, "parent_id": -1, **{c: np.nan for c in (*XYZ, "radius")}})
    return pd.concat([a, b], ignore_index=True)[["owner", "kind", "id", "node_id", "parent_id", *XYZ, "radius"]]


def mesh_to_skeleton(vertices: DataFrame, faces: DataFrame, step: int = 1, shave: bool = True, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, map): each mesh's skeleton by wavefronts, and (neuron, vid, node_id) for every vertex.

    See ``wavefront``. Each component of a mesh is a tree of its own, rooted at its smallest vertex (``editing.heal`` joins
    trees); ``extra`` links (neuron, a, b), such as those of ``heal_mesh``, carry the wave, too. A vertex without faces is a tree of one node.
    """

    def fn(m: Mesh) -> pd.DataFrame:
        nodes, of = wavefront(m.n, *m.links(), m.xyz, step, shave, owner=m.neuron)
        return _rows(nodes, m.vid, of, m.neuron).rename(columns={"owner": "neuron"})

    return _two(per_mesh(vertices, faces, fn, _SKELETON, extra, at_once=True), "vid")


def together(voxels: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, pd.DataFrame]]:
    """(number of each voxel's object, place, rows): all objects at once where one whole number can name a voxel, else one by one. Rows are sorted by object."""
    at = voxels[["i", "j", "k"]].to_numpy(np.int64)
    ids, own = np.unique(voxels["neuron"].to_numpy(), return_inverse=True)
    wide = int(len(ids)) * int(np.prod([int(x) + 4 for x in np.ptp(at, axis=0)], dtype=object)) if len(at) else 0
    if wide < 1 << 62:
        yield own, at, voxels
        return
    for _, g in voxels.groupby("neuron", sort=False):
        yield np.zeros(len(g), np.int64), g[["i", "j", "k"]].to_numpy(np.int64), g


def voxel_names(at: np.ndarray, own: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(name of each voxel, what a step along each axis adds to it); names of rows sorted by (own, i, j, k) ascend, and no step leads to another object's."""
    low = at.min(axis=0) - 1
    span = at.max(axis=0) - low + 2
    key = ((own * span[0] + at[:, 0] - low[0]) * span[1] + at[:, 1] - low[1]) * span[2] + at[:, 2] - low[2]
    return key, np.array([span[1] * span[2], span[2], 1])


def voxel_links(at: np.ndarray, connectivity: int = 26, own: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbouring voxels, of rows that are sorted by (own, i, j, k) and distinct; ``own``: number of each one's object."""
    key, steps = voxel_names(at, own)
    reach = {6: 1, 18: 2, 26: 3}[connectivity]
    a, b = [], []
    for o in itertools.product((-1, 0, 1), repeat=3):
        if o > (0, 0, 0) and sum(map(abs, o)) <= reach:
            other = key + np.dot(o, steps)
            at_ = np.minimum(np.searchsorted(key, other), len(key) - 1)
            hit = np.flatnonzero(key[at_] == other)
            a.append(hit)
            b.append(at_[hit])
    return np.concatenate(a), np.concatenate(b)


def voxels_to_skeleton(voxels: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), step: int = 1, shave: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, map): skeletons of voxels (neuron, i, j, k) by wavefronts over all 26 neighbours; the map has i, j, k, node_id.

    Nodes lie at the mean of their voxels' centres. Radii keep the volume: a ring of m voxels is a disc of that volume, as
    thick as the step of the wave.
    """
    size = np.array(spacing, float)
    thick = float(np.prod(size)) ** (1 / 3) * step
    v = voxels.select("neuron", *(F.col(c).cast("long").alias(c) for c in "ijk")).dropna()

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for own, at, g in together(pdf.drop_duplicates(["neuron", "i", "j", "k"])):
            names = g["neuron"].to_numpy()
            nodes, of = wavefront(len(at), *voxel_links(at, own=own), (at + 0.5) * size, step, shave, lambda m, _: np.sqrt(m * np.prod(size) / (np.pi * thick)), names)
            t = _rows(nodes, np.zeros(len(of), np.int64), of, names).rename(columns={"owner": "neuron"})
            for n, c in enumerate("ijk"):
                t[c] = np.concatenate([np.zeros(len(nodes), np.int64), at[:, n]])
            out.append(t)
        return pd.concat(out, ignore_index=True)

    rows = written(per_neuron(v, fn, _SKELETON + ", i long, j long, k long", order=("i", "j", "k"), least=AT_ONCE))
    nodes = rows.filter("kind = 0").select("neuron", "node_id", "parent_id", *XYZ, "radius", F.lit(0).alias("label"))
    return nodes, rows.filter("kind = 1").select("neuron", *"ijk", "node_id")


# --- fragments -----------------------------------------------------------------------------------------------------
def mesh_components(vertices: DataFrame, faces: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(neuron, vid, component, size): the smallest vertex of each vertex' fragment and the fragment's vertices."""

    def fn(m: Mesh) -> pd.DataFrame:
        label = G.components(m.n, *m.links())
        return pd.DataFrame({"neuron": m.neuron, "vid": m.vid, "component": m.vid[label], "size": np.bincount(label, minlength=m.n)[label]})

    return per_mesh(vertices, faces, fn, "neuron long, vid long, component long, size long", extra, at_once=True)


def heal_mesh(vertices: DataFrame, faces: DataFrame, max_dist: float | None = None, min_size: int | None = None, mask: DataFrame | None = None, extra: DataFrame | None = None) -> DataFrame:
    """(neuron, a, b, dist): links that join each mesh's fragments at least total length (a minimum spanning tree).

    Only connectivity is mended, no vertex or face changes. ``max_dist`` bounds a link; fragments of fewer than ``min_size`` vertices stay
    as they are; ``mask`` (neuron, vid): the only vertices that links may start from. ``extra``: links that are there
    already. The shortest links are found by a k-d tree in Borůvka's rounds, so a mesh of n vertices takes about n log n.
    """
    masked = mask is not None
    if masked:
        mark = mask.select("neuron", F.col("vid").alias("a"), F.col("vid").alias("b")).distinct()
        extra = mark if extra is None else extra.select("neuron", "a", "b").union(mark)

    def fn(m: Mesh) -> pd.DataFrame:
        keep = np.ones(m.n, bool)
        if masked:  # marks travel as links of a vertex to itself
            own = m.extra[:, 0] == m.extra[:, 1]
            keep[:] = False
            keep[m.extra[own, 0]] = True
        label = G.components(m.n, *m.links())
        if min_size:
            keep &= np.bincount(label, minlength=m.n)[label] >= min_size
        cut = np.append(np.flatnonzero(np.diff(m.neuron, prepend=m.neuron[:1] - 1)), m.n).tolist()
        found = np.concatenate([np.zeros((0, 2), np.int64), *(s + G.bridges(m.xyz[s:e], label[s:e], keep[s:e], max_dist) for s, e in zip(cut, cut[1:]))])
        return pd.DataFrame({"neuron": m.neuron[found[:, 0]], "a": m.vid[found[:, 0]], "b": m.vid[found[:, 1]], "dist": np.sqrt(((m.xyz[found[:, 0]] - m.xyz[found[:, 1]]) ** 2).sum(axis=1))})

    return per_mesh(vertices, faces, fn, "neuron long, a long, b long, dist double", extra, at_once=True)


def keep_largest(vertices: DataFrame, faces: DataFrame, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Each mesh without its fragments but the largest; of equal ones that with the smallest vertex stays."""
    c = mesh_components(vertices, faces, extra)
    best = c.groupBy("neuron").agg(F.min(F.struct(-F.col("size"), "component")).alias("m")).select("neuron", F.col("m.component").alias("component"))
    stay = c.join(best, ["neuron", "component"]).select("neuron", "vid")
    return vertices.join(stay, ["neuron", "vid"], "left_semi"), faces.join(stay.withColumnRenamed("vid", "v0"), ["neuron", "v0"], "left_semi").select(*faces.columns)
