"""Point clouds with directions, somata, compartments, chunks and warps: objects made from other objects."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.tables import durable, per_neuron
from .forest import Forest
from .geometry import KdTree, components
from .space import face_table

XYZ = ["x", "y", "z"]
#: Below this number of points a plain product is quicker than a tree; results are the same.
TREE_FROM = 4096


# --- neighbours within a neuron ------------------------------------------------------------------------------------
def _nearest_blocks(a: np.ndarray, b: np.ndarray, k: int):
    """(rows of a, positions in b of their k nearest, nearest first, distances) in blocks; ties by position. Many points meet through a tree."""
    if len(b) > TREE_FROM:
        tree = KdTree(b, max(32, 2 * k))
        for i in range(0, len(a), 100_000):
            near, d = tree.nearest(a[i : i + 100_000], k)
            yield slice(i, i + 100_000), near, np.sqrt(d)
        return
    step = max(1, (1 << 21) // max(1, len(b)))
    for i in range(0, len(a), step):
        d = ((a[i : i + step, None] - b[None]) ** 2).sum(axis=2)
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        yield slice(i, i + step), near, np.sqrt(np.take_along_axis(d, near, 1))


def make_dotprops(points: DataFrame, k: int = 20, pid: str = "node_id") -> DataFrame:
    """Points with direction and shape from their ``k`` nearest points of the same neuron, themselves included.

    (vx, vy, vz) is the principal axis of those points, alpha = (l1 - l2) / (l1 + l2 + l3) of the eigenvalues of their
    scatter. Points with null coordinates are left out; neurons with fewer points use all they have; points that all
    coincide have alpha 0. Skeletons' edge tangents are ``topology.tangents``.
    """
    p = points.select("neuron", F.col(pid).cast("long").alias("pid"), *(F.col(c).cast("double").alias(c) for c in XYZ)).dropna(subset=XYZ)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby("neuron", sort=False):
            xyz = g[XYZ].to_numpy()
            axis, alpha, total = np.zeros((len(g), 3)), np.zeros(len(g)), np.zeros(len(g))
            for rows, near, _ in _nearest_blocks(xyz, xyz, k):
                own = xyz[near] - xyz[near].mean(axis=1, keepdims=True)
                value, vector = np.linalg.eigh(np.einsum("nki,nkj->nij", own, own))
                total[rows] = value.sum(axis=1)
                alpha[rows] = np.where(total[rows] > 0, (value[:, 2] - value[:, 1]) / np.maximum(total[rows], 1e-300), 0.0)
                axis[rows] = vector[:, :, 2]
            out.append(g.assign(vx=axis[:, 0], vy=axis[:, 1], vz=axis[:, 2], alpha=alpha, spread=total))
        return pd.concat(out)

    return per_neuron(p, fn, "neuron long, pid long, x double, y double, z double, vx double, vy double, vz double, alpha double, spread double", order=("pid",))


def nearest_node(points: DataFrame, nodes: DataFrame, pid: str = "pid") -> DataFrame:
    """(neuron, pid, node_id, dist): for each location or mesh vertex the nearest node of its neuron; ties: smaller id."""
    a = nodes.select("neuron", F.lit(0).alias("kind"), F.col("node_id").alias("id"), *XYZ)
    b = points.select("neuron", F.lit(1).alias("kind"), F.col(pid).cast("long").alias("id"), *XYZ)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for neuron, g in pdf.groupby("neuron", sort=False):
            n, p = g[g["kind"] == 0], g[g["kind"] == 1]
            if len(n) and len(p):
                own, ids = n[XYZ].to_numpy(), n["id"].to_numpy()
                at, far = (np.concatenate(x) for x in zip(*((near[:, 0], d[:, 0]) for _, near, d in _nearest_blocks(p[XYZ].to_numpy(), own, 1))))
                out.append(pd.DataFrame({"neuron": neuron, "pid": p["id"].to_numpy(), "node_id": ids[at], "dist": far}))
        return pd.concat(out) if out else pd.DataFrame(columns=["neuron", "pid", "node_id", "dist"])

    return per_neuron(a.union(b), fn, "neuron long, pid long, node_id long, dist double", order=("kind", "id"), union=True)


# --- somata and compartments ---------------------------------------------------------------------------------------
def find_soma(nodes: DataFrame, min_radius: float | None = None, label: str | None = None, dist_factor: float = 3.0) -> DataFrame:
    """(neuron, soma): the fattest node of the region whose candidates have the largest mean radius.

    Candidates have at least ``min_radius`` and, if given, the label. A candidate's region is the candidates within
    ``dist_factor`` times its radius. Without ``min_radius``, and in neurons where no node has a radius, the label decides: of the largest
    connected piece of labelled nodes (ties: the smallest node id) the node nearest to the piece's centre (ties likewise). Neurons
    without a candidate have no row.
    """
    if min_radius is None and label is None:
        return nodes.select("neuron", F.col("node_id").alias("soma")).limit(0)
    labelled = F.lit(True) if label is None else F.col("label").cast("string") == F.lit(label)
    n = nodes.select("neuron", "node_id", "parent_id", "radius", *XYZ, F.coalesce(labelled, F.lit(False)).alias("mark"))

    def by_label(g: pd.DataFrame) -> int | None:
        g = g[g["mark"]]
        if not len(g):
            return None
        ids, xyz = g["node_id"].to_numpy(np.int64), g[XYZ].to_numpy(float)
        parent = g["parent_id"].fillna(-1).to_numpy(np.int64)
        at = np.minimum(np.searchsorted(ids, parent), len(ids) - 1)
        child = np.flatnonzero((ids[at] == parent) & (parent >= 0))
        piece = components(len(ids), child, at[child])
        size = np.bincount(piece, minlength=len(ids))
        own = np.flatnonzero(piece == size.argmax())
        off = xyz[own] - xyz[own].mean(axis=0)
        return int(ids[own[np.round((off * off).sum(axis=1), 6).argmin()]])

    def by_radius(g: pd.DataFrame) -> int | None:
        g = g[g["mark"] & (g["radius"] > 0) & (g["radius"] >= min_radius)]
        if not len(g):
            return None
        xyz, r, ids = g[XYZ].to_numpy(float), g["radius"].to_numpy(float), g["node_id"].to_numpy()
        best = (-np.inf, None)
        for i in range(0, len(g), 512):
            near = ((xyz[i : i + 512, None] - xyz[None]) ** 2).sum(axis=2) <= (dist_factor * r[i : i + 512, None]) ** 2
            mean = (near @ r) / near.sum(axis=1)
            j = int(mean.argmax())
            if mean[j] > best[0]:
                best = mean[j], near[j]
        inside = np.flatnonzero(best[1])
        return int(ids[inside[r[inside].argmax()]])

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for neuron, g in pdf.groupby("neuron", sort=False):
            radius = min_radius is not None and (g["radius"] > 0).any()
            soma = by_radius(g) if radius else by_label(g) if label is not None else None
            if soma is not None:
                rows.append((neuron, soma))
        return pd.DataFrame(rows, columns=["neuron", "soma"])

    return per_neuron(n, fn, "neuron long, soma long")


def soma_features(nodes: DataFrame, somata: DataFrame | None = None) -> DataFrame:
    """Per neuron: radius and surface of the soma (the root, if none is given) and the number of its stems."""
    s = somata.select("neuron", F.col("soma").alias("node_id")) if somata is not None else nodes.filter(F.col("parent_id") < 0).groupBy("neuron").agg(F.min("node_id").alias("node_id"))
    own = s.join(nodes.select("neuron", "node_id", "radius"), ["neuron", "node_id"])
    stems = nodes.select("neuron", F.col("parent_id").alias("node_id")).join(s, ["neuron", "node_id"]).groupBy("neuron").agg(F.count("*").alias("num_stems"))
    return own.join(stems, "neuron", "left").select("neuron", F.col("radius").alias("soma_radius"), (4 * np.pi * F.col("radius") * F.col("radius")).alias("soma_surface"), F.coalesce("num_stems", F.lit(0)).alias("num_stems"))


def compartment_features(nodes: DataFrame, compartment: str, somata: DataFrame | None = None) -> DataFrame:
    """Per neuron, of the nodes with a label: their number, cable to parents of the same label, stems at the soma, and
    where the compartment's root nearest to the soma leaves it (distance from its surface, angle in the plane)."""
    s = somata.select("neuron", F.col("soma").alias("sid")) if somata is not None else nodes.filter(F.col("parent_id") < 0).groupBy("neuron").agg(F.min("node_id").alias("sid"))
    s = s.join(nodes.select("neuron", F.col("node_id").alias("sid"), F.col("radius").alias("sr"), *(F.col(c).alias(f"s{c}") for c in XYZ)), ["neuron", "sid"])
    p = nodes.select("neuron", F.col("node_id").alias("parent_id"), F.col("label").alias("plabel"), *(F.col(c).alias(f"p{c}") for c in XYZ))
    t = nodes.filter(F.col("label").cast("string") == compartment).join(p, ["neuron", "parent_id"], "left").join(s, "neuron")
    same = F.coalesce(F.col("plabel").cast("string") == compartment, F.lit(False))
    length = F.sqrt(sum((F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in XYZ))
    away = F.sqrt(sum((F.col(c) - F.col(f"s{c}")) * (F.col(c) - F.col(f"s{c}")) for c in XYZ))
    first = F.min(F.when(~same, F.struct(away.alias("d"), "node_id", F.atan2(F.col("y") - F.col("sy"), F.col("x") - F.col("sx")).alias("theta"), "sr")))
    g = t.groupBy("neuron").agg(F.count("*").alias("num_nodes"), F.sum(F.when(same, length).otherwise(0.0)).alias("total_length"), F.count_if(F.col("parent_id") == F.col("sid")).alias("num_stems"), first.alias("f"))
    return g.select("neuron", "num_nodes", "total_length", "num_stems", F.greatest(F.col("f.d") - F.greatest(F.coalesce("f.sr", F.lit(0.0)), F.lit(0.0)), F.lit(0.0)).alias("exit_distance"), F.col("f.theta").alias("exit_theta"))


# --- trees ---------------------------------------------------------------------------------------------------------
def prune(nodes: DataFrame, where: DataFrame, side: str = "distal") -> DataFrame:
    """Without what lies distal to the given nodes (neuron, node_id), or with only those nodes and what is distal to them,
    which makes them roots. The nodes themselves stay. Neurons without a given node stay whole."""
    from .topology import _pairs

    def fn(f: Forest, b: pd.DataFrame) -> pd.DataFrame:
        at = f.find(b["code"].to_numpy(np.int64), b["node_id"].to_numpy(np.int64))
        mark = np.zeros(f.n, np.int64)
        mark[at[at >= 0]] = 1
        above = f.down(mark, mark)  # marks on the way from the root, the node's own included
        keep = (above - mark == 0) if side == "distal" else above > 0
        parent = np.where(f.parent >= 0, f.id[f.parent], -1)
        if side != "distal":
            parent = np.where((mark > 0) & (above == 1), -1, parent)
        return f.frame(kept=parent)[keep][["neuron", "node_id", "kept"]]

    got = _pairs(nodes, where, fn, "neuron long, node_id long, kept long")
    whole = nodes.join(where.select("neuron").distinct(), "neuron", "left_anti")
    return nodes.join(got, ["neuron", "node_id"]).withColumn("parent_id", F.col("kept")).select(*nodes.columns).union(whole.select(*nodes.columns))


def prune_by_volume(nodes: DataFrame, vertices: DataFrame, faces: DataFrame, mode: str = "IN") -> DataFrame:
    """The part of each neuron inside (IN) or outside (OUT) of any of the volumes; cut links make roots."""
    from .topology import subset

    def give(rows: pa.RecordBatch, at: np.ndarray, volume: np.ndarray) -> pa.RecordBatch:
        return rows.take(pa.array(at))

    own = nodes.select("neuron", "node_id", *XYZ)
    inside = _held(own, vertices, faces, give, own.schema, once=True).select("neuron", "node_id").distinct()
    return subset(nodes, inside if mode == "IN" else nodes.select("neuron", "node_id").join(inside, ["neuron", "node_id"], "left_anti"))


def is_acyclic(nodes: DataFrame) -> DataFrame:
    """(neuron, acyclic, n_cyclic): whether following parents always ends, and how many nodes lie on cycles."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for neuron, g in pdf.groupby("neuron", sort=False):
            at = pd.Series(np.arange(len(g)), index=g["node_id"].to_numpy())
            parent = at.reindex(g["parent_id"]).fillna(-1).to_numpy(np.int64)
            jump = np.append(parent, -1)  # position -1 stays where it is
            for _ in range(max(1, len(g).bit_length())):
                jump = jump[jump]
            on = np.zeros(len(g) + 1, bool)
            now = np.unique(jump[jump >= 0])  # after that many steps whatever is left walks on cycles
            while len(now) and not on[now].all():
                on[now] = True
                now = parent[now]
            rows.append((neuron, not on.any(), int(on.sum())))
        return pd.DataFrame(rows, columns=["neuron", "acyclic", "n_cyclic"])

    return per_neuron(nodes.select("neuron", "node_id", "parent_id"), fn, "neuron long, acyclic boolean, n_cyclic long")


def rewire(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes under new parents: those of the given links (neuron, a, b), followed outwards from the roots."""
    from .topology import edges_to_forest

    parent = edges_to_forest(edges, roots).select("neuron", "node_id", F.col("parent_id").alias("__p"))
    return nodes.join(parent, ["neuron", "node_id"]).withColumn("parent_id", F.col("__p")).select(*nodes.columns)


def chunks(nodes: DataFrame, size: int, undersized: str = "keep") -> DataFrame:
    """(neuron, node_id, chunk): disjoint connected groups of up to ``size`` nodes that cover each neuron.

    A group grows from the smallest node without one, always to the nearest free neighbour along the tree. Groups that
    stay smaller are kept or discarded.
    """

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Forest(pdf)
        near = [[] for _ in range(f.n)]
        for i, p in enumerate(f.parent.tolist()):
            if p >= 0:
                near[i].append((p, f.step[i]))
                near[p].append((i, f.step[i]))
        chunk, free = np.full(f.n, -1), np.ones(f.n, bool)
        count = {}
        for start in range(f.n):
            if not free[start]:
                continue
            g = int(f.neuron[start])
            number = count[g] = count.get(g, -1) + 1
            todo, own, seen = [(0.0, start)], [], {start}
            while todo and len(own) < size:
                d, i = heapq.heappop(todo)
                own.append(i)
                for j, step in near[i]:
                    if free[j] and j not in seen:
                        seen.add(j)
                        heapq.heappush(todo, (d + step, j))
            free[own] = False
            if len(own) == size or undersized == "keep":
                chunk[own] = number
        return f.frame(chunk=chunk)[chunk >= 0][["neuron", "node_id", "chunk"]]

    return per_neuron(nodes.select("neuron", "node_id", "parent_id", *XYZ), fn, "neuron long, node_id long, chunk long")


# --- volumes -------------------------------------------------------------------------------------------------------
#: Points of a task that looks into volumes, about, and tasks that share a cell's faces at most; pairs of point and face that a task holds at once.
TASK_POINTS, SHARED, HELD_PAIRS = 20_000, 64, 1 << 20
#: Volumes that are asked at a time where one that holds a point is enough.
FEW = 16
_CORNERS = [f"{k}{x}" for k in "abc" for x in XYZ]


class _Faces:
    """Faces of one cell of the largest size class, by the smaller cells that they span."""

    def __init__(self, corners: np.ndarray, size: np.ndarray, gy: np.ndarray, gz: np.ndarray, volume: np.ndarray):
        self.volumes, self.of = np.unique(volume, return_inverse=True)
        a, b, c = corners[:, :3].T, corners[:, 3:6].T, corners[:, 6:].T
        u, v = b - a, c - a
        n0, n1, n2 = u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]
        self.top, self.a, self.sy, self.sz = np.maximum(np.maximum(a[0], b[0]), c[0]), a, n1 / n0, n2 / n0
        self.low, self.high = corners[:, ::3].min(), self.top.max()
        self.edges = [self._edge(p, q) for p, q in ((a, b), (b, c), (c, a))]
        self.classes = []
        for s in np.unique(size):
            own = np.flatnonzero(size == s)
            ys, zs = np.unique(gy[own]), np.unique(gz[own])
            code = np.searchsorted(ys, gy[own]) * len(zs) + np.searchsorted(zs, gz[own])
            order = np.argsort(code, kind="stable")
            self.classes.append((s, ys, zs, code[order], own[order]))

    @staticmethod
    def _edge(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
        """An edge in (y, z), its ends in one order whatever the face: two faces that share an edge then compute the same side
        of it. The last two: the side of points on the edge, moved by an infinitely small (e, e * e), and whether the ends were turned."""
        turned = (p[1] > q[1]) | ((p[1] == q[1]) & (p[2] > q[2]))
        (y0, y1), (z0, z1) = ((np.where(turned, q[i], p[i]), np.where(turned, p[i], q[i])) for i in (1, 2))
        return y0, z0, y1 - y0, z1 - z0, (z1 < z0) | ((z1 == z0) & (y1 > y0)), turned

    def _crossed(self, x: np.ndarray, y: np.ndarray, z: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the ray from each point along x crosses its face, and whether the point lies on it."""
        side = []
        for y0, z0, u, v, tie, turned in self.edges:
            s = u[f] * (z - z0[f]) - v[f] * (y - y0[f])
            side.append(((s > 0) | ((s == 0) & tie[f])) != turned[f])
        hit = self.a[0][f] - self.sy[f] * (y - self.a[1][f]) - self.sz[f] * (z - self.a[2][f])
        over = (side[0] == side[1]) & (side[1] == side[2])
        return over & (self.top[f] > x) & (hit > x), over & (hit == x)

    def around(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions of points, volumes) for each volume that holds a point, those of about ``HELD_PAIRS`` pairs with faces at a time."""
        own = np.flatnonzero((x >= self.low) & (x < self.high))  # before and behind all faces none holds a point
        for at, volume in self._around(x[own], y[own], z[own]):
            yield own[at], volume

    def _around(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        spans = []
        for s, ys, zs, code, own in self.classes:
            gy, gz = np.floor(y / s), np.floor(z / s)
            iy, iz = np.minimum(np.searchsorted(ys, gy), len(ys) - 1), np.minimum(np.searchsorted(zs, gz), len(zs) - 1)
            at, known = iy * len(zs) + iz, (ys[iy] == gy) & (zs[iz] == gz)
            first = np.searchsorted(code, at)
            spans.append((own, first, np.where(known, np.searchsorted(code, at, "right") - first, 0)))
        total = np.sum([n for _, _, n in spans], axis=0).cumsum()
        many, held, lo = len(self.volumes), 0, 0
        while lo < len(x):
            hi = max(lo + 1, int(np.searchsorted(total, held + HELD_PAIRS, "right")))
            keys, touched = [], []
            for own, first, n in spans:
                n = n[lo:hi]
                p = np.repeat(np.arange(lo, hi), n)
                f = own[np.arange(len(p)) - np.repeat(n.cumsum() - n, n) + np.repeat(first[lo:hi], n)]
                crossed, on_face = self._crossed(x[p], y[p], z[p], f)
                key = (p - lo) * many + self.of[f]
                keys.append(key[crossed])
                touched.append(key[on_face])
            key, times = np.unique(np.concatenate(keys), return_counts=True)
            key, on = key[times % 2 == 1], np.concatenate(touched)
            key = key[~np.isin(key, on)] if len(on) else key
            if len(key):
                yield key // many + lo, self.volumes[key % many]
            held, lo = int(total[hi - 1]), hi


def _held(points: DataFrame, vertices: DataFrame, faces: DataFrame, give, schema: StructType, once: bool = False) -> DataFrame:
    """Runs ``give(rows of points, positions in them, volumes)``, a part of a batch of points at a time; a point is named once for each volume that
    holds it, or (``once``) only for the first that is found: volumes are then asked a few at a time, for the points that none has held.

    A ray along x crosses an odd number of a volume's faces. A ray through an edge or corner crosses as if moved aside a
    little, so it meets one of the faces there, not two or none. A point on a face is outside (on one along x: either). Faces go to the (y, z) cells that they span, of a size
    of their own class (powers of two), so a large face covers few cells and small ones meet only points near them; a
    point looks in its cell of each class that occurs. Cells of the largest class hold those of all others whole: a task has the faces
    of one of them and lets its share of the points pass by, so what moves is each point once and each face ``SHARED`` times at most.
    Each volume counts for itself, so overlapping ones do not cancel.
    """
    t = face_table(vertices, faces).select(F.col("neuron").alias("volume"), *_CORNERS)
    c = F.col
    extent = F.greatest(*(F.greatest(*(c(f"{k}{x}") for k in "abc")) - F.least(*(c(f"{k}{x}") for k in "abc")) for x in "yz"), F.lit(1e-9))
    t = t.withColumn("size", F.pow(F.lit(2.0), F.ceil(F.log2(extent))))
    for x in "yz":
        t = t.withColumn(f"g{x}", F.explode(F.sequence(*(F.floor(f(*(c(f"{k}{x}") for k in "abc")) / c("size")) for f in (F.least, F.greatest)))))
    largest = t.agg(F.max("size").alias("largest"))
    u, v = ([c(f"{k}{x}") - c(f"a{x}") for x in "yz"] for k in "bc")
    t = t.filter(u[0] * v[1] - u[1] * v[0] != 0)  # a face along the ray is crossed by none
    p = points.dropna(subset=XYZ)
    n = p.count()
    slices = min(SHARED, max(1, -(-n // TASK_POINTS)))
    p = p.select(F.lit(1).alias("__kind"), F.pmod(F.xxhash64(*XYZ), F.lit(slices)).cast("int").alias("__slice"), *points.columns, *(c(x).cast("double").alias(f"__{x}") for x in XYZ))
    t = t.select(F.lit(0).alias("__kind"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("__slice"), F.struct("volume", *_CORNERS, "size", "gy", "gz").alias("__face"), *((c(f"g{x}") * c("size")).alias(f"__{x}") for x in "yz"))
    both = p.unionByName(t, allowMissingColumns=True).crossJoin(F.broadcast(largest))  # one row
    both = both.withColumns({f"__r{x}": F.floor(c(f"__{x}") / c("largest")) for x in "yz"}).drop("largest")
    names = points.columns

    def parted(faces: list[np.ndarray]) -> list[_Faces]:
        if not once:
            return [_Faces(*faces)]
        group = np.unique(faces[-1], return_inverse=True)[1] // FEW
        return [_Faces(*(c[group == g] for c in faces)) for g in range(group.max() + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, known = None, [], None
        for b in batches:
            key = np.stack([b[x].to_numpy(zero_copy_only=False) for x in ("__slice", "__ry", "__rz", "__kind")])
            ends = [*(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip([0, *ends], ends):
                if hi == lo:
                    continue
                if (cell := tuple(key[:3, lo])) != now:
                    now, held, known = cell, [], None
                part = b.slice(lo, hi - lo)
                if not key[3, lo]:
                    face = dict(zip((f.name for f in part["__face"].type), part["__face"].flatten()))
                    held.append([np.stack([face[x].to_numpy() for x in _CORNERS], axis=1), *(face[x].to_numpy() for x in ("size", "gy", "gz", "volume"))])
                    continue
                if not held:
                    continue
                known = known or parted([np.concatenate(x) for x in zip(*held)])
                place, left = np.stack([part[f"__{x}"].to_numpy() for x in XYZ]), np.arange(part.num_rows)
                for some in known:
                    found = []
                    for at, volume in some.around(*(place if len(known) == 1 else place[:, left])):
                        if once:
                            at, first = np.unique(at, return_index=True)
                            at, volume = left[at], volume[first]
                            found.append(at)
                        yield give(part.select(names), at, volume)
                    if once:
                        left = np.setdiff1d(left, np.concatenate(found)) if found else left

    order = ["__slice", "__ry", "__rz"]
    return both.repartition(min(4096, max(64, n // TASK_POINTS)), *order).sortWithinPartitions(*order, "__kind").mapInArrow(run, schema)


def _volume(faces: DataFrame) -> StructField:
    return StructField("volume", faces.schema["neuron"].dataType)


def in_volumes(points: DataFrame, vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """The points inside each volume: their rows with ``volume`` (the mesh's id), a row for each volume that holds them."""

    def give(rows: pa.RecordBatch, at: np.ndarray, volume: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.take(pa.array(at)).columns, pa.array(volume)], names=[*rows.schema.names, "volume"])

    return _held(points, vertices, faces, give, StructType([*points.schema.fields, _volume(faces)]))


def intersection_matrix(points: DataFrame, vertices: DataFrame, faces: DataFrame, value: str | None = None) -> DataFrame:
    """(volume, neuron, value): number, or sum of a column, of each neuron's points in each volume; absent pairs are 0.

    Points are summed where they meet a volume; no row of a point and a volume is moved.
    """
    own = F.col(value) if value else F.lit(1)
    kind = points.select(F.sum(own).alias("value")).schema["value"].dataType
    some = points.select("neuron", *XYZ, own.cast(kind).alias("__value"))

    def give(rows: pa.RecordBatch, at: np.ndarray, volume: np.ndarray) -> pa.RecordBatch:
        t = pa.table({"volume": volume, "neuron": rows["neuron"].take(pa.array(at)), "value": rows["__value"].take(pa.array(at))})
        return t.group_by(["volume", "neuron"]).aggregate([("value", "sum")]).select(["volume", "neuron", "value_sum"]).rename_columns(["volume", "neuron", "value"]).combine_chunks().to_batches()[0]

    schema = StructType([_volume(faces), points.schema["neuron"], StructField("value", kind)])
    return _held(some, vertices, faces, give, schema).groupBy("volume", "neuron").agg(F.sum("value").cast(kind).alias("value"))


def sample_surface(vertices: DataFrame, faces: DataFrame, n: int) -> DataFrame:
    """(neuron, sample, face, x, y, z): ``n`` points spread evenly over each mesh by area, at the centres of their faces.

    Faces lie end to end by area (in order of their vertices); sample i is at (i + 1/2) / n of the whole.
    """
    t = face_table(vertices, faces)
    u, v = ([F.col(f"{k}{x}") - F.col(f"a{x}") for x in XYZ] for k in "bc")
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    t = t.withColumn("area", F.sqrt(sum(x * x for x in cross)) / 2)
    by = Window.partitionBy("neuron").orderBy("v0", "v1", "v2")
    t = t.withColumns({"face": F.row_number().over(by) - 1, "end": F.sum("area").over(by), "all": F.sum("area").over(Window.partitionBy("neuron"))})
    lo, hi = (F.ceil(x / F.col("all") * n - 0.5 - 1e-9) for x in (F.col("end") - F.col("area"), F.col("end")))
    t = t.withColumn("sample", F.explode(F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<bigint>"))))
    return t.filter((F.col("sample") >= 0) & (F.col("sample") < n)).select("neuron", "sample", "face", *(((F.col(f"a{c}") + F.col(f"b{c}") + F.col(f"c{c}")) / 3).alias(c) for c in XYZ))


# --- shapes --------------------------------------------------------------------------------------------------------
def align_pca(points: DataFrame, order: str = "node_id") -> DataFrame:
    """Coordinates in each neuron's own principal axes, longest first, from its centre. Axes point where most points are."""
    schema = points.schema

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby("neuron", sort=False):
            x = g[XYZ].to_numpy(float)
            x = x - x.mean(axis=0)
            axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
            y = x @ axes
            y *= np.where((y**3).sum(axis=0) < 0, -1, 1)
            out.append(g.assign(**dict(zip(XYZ, y.T))))
        return pd.concat(out)[schema.names]

    return per_neuron(points, fn, schema, order=(order,))


def warp(points: DataFrame, magnitude: float = 0.05, grid: int = 3, seed: int = 0, order: str = "node_id") -> DataFrame:
    """A smooth random deformation: the corners of a coarse grid over each neuron move by normal steps of ``magnitude``
    times its largest extent, points in between by trilinear interpolation. The same seed gives the same warp."""
    schema = points.schema

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for neuron, g in pdf.groupby("neuron", sort=False):
            x = g[XYZ].to_numpy(float)
            low, extent = x.min(axis=0), np.maximum(np.ptp(x, axis=0), 1e-12)
            moves = np.random.default_rng([seed, int(neuron) & 0xFFFFFFFF]).normal(0, magnitude * extent.max(), (grid, grid, grid, 3))
            at = (x - low) / extent * (grid - 1)
            cell = np.minimum(at.astype(int), grid - 2)
            part, shift = at - cell, 0.0
            for corner in np.ndindex(2, 2, 2):
                w = np.prod(np.where(corner, part, 1 - part), axis=1)
                shift = shift + w[:, None] * moves[tuple((cell + corner).T)]
            out.append(g.assign(**dict(zip(XYZ, (x + shift).T))))
        return pd.concat(out)[schema.names]

    return per_neuron(points, fn, schema, order=(order,))


def augment(nodes: DataFrame, *, drop: float | None = None, warp_by: float | None = None, rotation=None, scale: float | None = None, shift=None, jitter: float | None = None, seed: int = 0) -> DataFrame:
    """A chain of augmentations of skeletons, in this order; those that are not given are left out."""
    from . import editing, space

    if drop:
        nodes = editing.drop_nodes(nodes, drop, seed)
    if warp_by:
        nodes = warp(nodes, warp_by, seed=seed)
    if rotation is not None:
        nodes = space.rotate(nodes, rotation)
    if scale:
        nodes = space.rescale(nodes, scale)
    if shift is not None:
        nodes = space.translate(nodes, shift)
    return space.jitter(nodes, jitter, seed) if jitter else nodes


#: Links that a task joins at once.
HELD_LINKS = 2_000_000


def _stars(links: DataFrame) -> DataFrame:
    """(id, c): each end of a share of the links (a, b) and the smallest end that the share's links reach from it."""
    kind = links.schema["a"].dataType

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        ids, at = np.unique(np.concatenate([t[c].to_numpy() for c in "ab"]), return_inverse=True)
        label = components(len(ids), at[: len(t)], at[len(t) :])
        return pa.RecordBatch.from_arrays([pa.array(x, t.schema.field("a").type) for x in (ids, ids[label])], names=["id", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= HELD_LINKS:
                yield joined(held)
                held, n = [], 0
        if n:
            yield joined(held)

    return links.repartitionByRange(F.least("a", "b")).mapInArrow(run, StructType([StructField("id", kind), StructField("c", kind)]))


def components_of_links(links: DataFrame) -> DataFrame:
    """(id, component) of links (a, b) between any objects: the smallest id that links reach.

    Links go to tasks by ranges of ids and are joined there first; what remains are links between the tasks' pieces. Over those labels
    spread by joins until none changes, each round checkpointed.
    """
    whole = durable(links.select("a", "b").dropna())
    stars = durable(_stars(whole).groupBy("id").agg(F.min("c").alias("c"), F.collect_set("c").alias("all")).select("id", "c", F.when(F.size("all") > 1, F.col("all")).alias("all")))
    between = stars.filter("all IS NOT NULL").select(F.col("c").alias("a"), F.explode("all").alias("b")).filter("a <> b").distinct()
    label = _spread(between).select(F.col("id").alias("c"), F.col("component").alias("m"))
    return stars.join(label, "c", "left").select("id", F.coalesce("m", "c").alias("component"))


def _spread(links: DataFrame) -> DataFrame:
    """(id, component) by rounds of joins."""
    e = links.select("a", "b").union(links.select("b", "a")).distinct()
    label = durable(e.groupBy(F.col("a").alias("id")).agg(F.least("a", F.min("b")).alias("c")))
    while True:
        near = e.join(label, F.col("b") == F.col("id")).groupBy("a").agg(F.min("c").alias("m"))
        new = label.join(near, label["id"] == near["a"]).select("id", F.least("c", "m").alias("c"), (F.col("m") < F.col("c")).alias("moved"))
        # a label's own label is nearer to the end
        new = durable(new.join(new.select(F.col("id").alias("c"), F.col("c").alias("cc")), "c", "left").select("id", F.least("c", F.coalesce("cc", "c")).alias("c"), "moved"))
        if new.filter("moved").isEmpty():
            return new.select("id", F.col("c").alias("component"))
        label = new.drop("moved")
