"""Coordinates, voxels, meshes and samples."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import per_neuron, with_parent
from .forest import Forest

XYZ = ("x", "y", "z")


# --- transforms ----------------------------------------------------------------------------------------------------
class Transform:
    """Maps rows with x, y, z; chains by ``|``, inverts by ``-`` where it can."""

    def __call__(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def __or__(self, other: Transform) -> Chain:
        return Chain([self, other])


class Affine(Transform):
    """A 4 x 4 matrix as column arithmetic."""

    def __init__(self, matrix):
        self.m = np.asarray(matrix, float)

    def __call__(self, df):
        m = self.m
        return df.withColumns({c: sum(F.col(d) * float(m[i, j]) for j, d in enumerate(XYZ)) + float(m[i, 3]) for i, c in enumerate(XYZ)})

    def __neg__(self):
        return Affine(np.linalg.inv(self.m))


class Alias(Transform):
    """The same coordinates under another name of their space."""

    def __call__(self, df):
        return df

    def __neg__(self):
        return self


class Function(Transform):
    """A function of an (n, 3) array, in Arrow batches."""

    def __init__(self, fn):
        self.fn = fn

    def __call__(self, df):
        fn = self.fn

        def run(batches):
            for b in batches:
                b[list(XYZ)] = fn(b[list(XYZ)].to_numpy(float))
                yield b

        return df.mapInPandas(run, df.schema)


class Chain(Transform):
    """Transforms one after the other; neighbouring affine ones become one matrix."""

    def __init__(self, parts):
        flat = [q for p in parts for q in (p.parts if isinstance(p, Chain) else [p])]
        self.parts = []
        for p in flat:
            if isinstance(p, Alias):
                continue
            if self.parts and isinstance(p, Affine) and isinstance(self.parts[-1], Affine):
                self.parts[-1] = Affine(p.m @ self.parts[-1].m)
            else:
                self.parts.append(p)

    def __call__(self, df):
        for p in self.parts:
            df = p(df)
        return df

    def __neg__(self):
        return Chain([-p for p in reversed(self.parts)])


class ThinPlate(Transform):
    """Thin plate spline through landmarks: solved once, applied in Arrow batches."""

    def __init__(self, source, target):
        s, t = np.asarray(source, float), np.asarray(target, float)
        n = len(s)
        k = np.zeros((n + 4, n + 4))
        k[:n, :n] = np.sqrt(((s[:, None] - s[None]) ** 2).sum(axis=2))
        k[:n, n], k[:n, n + 1 :] = 1, s
        k[n:, :n] = k[:n, n:].T
        self.s, self.t, self.w = s, t, np.linalg.lstsq(k, np.vstack([t, np.zeros((4, 3))]), rcond=None)[0]

    def points(self, p: np.ndarray) -> np.ndarray:
        d = np.sqrt(((p[:, None] - self.s[None]) ** 2).sum(axis=2))
        n = len(self.s)
        return d @ self.w[:n] + self.w[n] + p @ self.w[n + 1 :]

    def __call__(self, df):
        return Function(self.points)(df)

    def __neg__(self):
        return ThinPlate(self.t, self.s)


class MovingLeastSquares(Transform):
    """Affine moving least squares from landmarks, weights 1 / d^2."""

    def __init__(self, source, target):
        self.s, self.t = np.asarray(source, float), np.asarray(target, float)

    def points(self, p: np.ndarray) -> np.ndarray:
        out = np.empty_like(p)
        for i in range(0, len(p), 1024):
            q = p[i : i + 1024]
            w = 1 / np.maximum(((q[:, None] - self.s[None]) ** 2).sum(axis=2), 1e-12)
            w /= w.sum(axis=1, keepdims=True)
            cs, ct = w @ self.s, w @ self.t
            a, b = self.s[None] - cs[:, None], self.t[None] - ct[:, None]
            m = np.linalg.pinv(np.einsum("nk,nki,nkj->nij", w, a, a)) @ np.einsum("nk,nki,nkj->nij", w, a, b)
            out[i : i + 1024] = np.einsum("ni,nij->nj", q - cs, m) + ct
        return out

    def __call__(self, df):
        return Function(self.points)(df)

    def __neg__(self):
        return MovingLeastSquares(self.t, self.s)


class Grid(Transform):
    """A displacement field on a regular grid, trilinear; outside points stay."""

    def __init__(self, field, spacing=(1, 1, 1), offset=(0, 0, 0)):
        self.f, self.sp, self.o = np.asarray(field, float), np.asarray(spacing, float), np.asarray(offset, float)

    def points(self, p: np.ndarray) -> np.ndarray:
        g = (p - self.o) / self.sp
        top = np.array(self.f.shape[:3]) - 1
        ok = ((g >= 0) & (g <= top)).all(axis=1)
        i = np.minimum(np.floor(np.where(ok[:, None], g, 0)).astype(int), np.maximum(top - 1, 0))
        t = np.where(ok[:, None], g, 0) - i
        d = np.zeros_like(p)
        for c in range(8):
            b = np.array([c & 1, c >> 1 & 1, c >> 2 & 1])
            j = np.minimum(i + b, top)
            d += np.prod(np.where(b, t, 1 - t), axis=1)[:, None] * self.f[j[:, 0], j[:, 1], j[:, 2]]
        return np.where(ok[:, None], p + d, p)

    def __call__(self, df):
        return Function(self.points)(df)


def similarity(pairs: DataFrame, scale: bool = True) -> Affine:
    """Least-squares rotation, scale and shift from (x, y, z) to (tx, ty, tz): sums on the cluster, one SVD here."""
    names = [*XYZ, *(f"t{c}" for c in XYZ)]
    aggs = [F.count("*").alias("n"), *(F.sum(c).alias(c) for c in names), *(F.sum(F.col(a) * F.col(f"t{b}")).alias(f"{a}_{b}") for a in XYZ for b in XYZ), F.sum(sum(F.col(c) * F.col(c) for c in XYZ)).alias("ss")]
    r = pairs.agg(*aggs).first()
    n = r["n"]
    ms, mt = np.array([r[c] for c in XYZ]) / n, np.array([r[f"t{c}"] for c in XYZ]) / n
    cov = np.array([[r[f"{a}_{b}"] for b in XYZ] for a in XYZ]) / n - np.outer(ms, mt)
    u, d, vt = np.linalg.svd(cov)
    sign = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))])
    rot = vt.T @ sign @ u.T
    s = (d * np.diag(sign)).sum() / (r["ss"] / n - ms @ ms) if scale else 1.0
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = s * rot, mt - s * rot @ ms
    return Affine(m)


def mirror(df: DataFrame, size: float, axis: str = "x", warp: Transform | None = None) -> DataFrame:
    """Flips about the middle of an axis of the given size; an optional warp follows."""
    out = df.withColumn(axis, float(size) - F.col(axis))
    return warp(out) if warp else out


class Registry:
    """Named spaces and the transforms between them; finds the cheapest chain."""

    def __init__(self):
        self.edges: dict[str, list[tuple[str, float, Transform]]] = {}
        self.mirrors: dict[str, tuple[float, str, Transform | None]] = {}

    def register(self, source: str, target: str, transform: Transform, weight: float = 1.0, inverse_weight: float | None = 0.5) -> None:
        """Inverses are used as well where there is one; each step back costs its weight plus ``inverse_weight``."""
        self.edges.setdefault(source, []).append((target, weight, transform))
        self.edges.setdefault(target, [])
        if inverse_weight is not None and hasattr(transform, "__neg__"):
            self.edges[target].append((source, weight + inverse_weight, -transform))

    def register_mirror(self, space: str, size: float, axis: str = "x", warp: Transform | None = None) -> None:
        self.mirrors[space] = size, axis, warp

    def path(self, source: str, target: str, via: list[str] | None = None, avoid: tuple[str, ...] = ()) -> list[Transform]:
        import heapq

        stops, out = [source, *(via or []), target], []
        for a, b in zip(stops, stops[1:]):
            todo, seen = [(0.0, 0, a, [])], set()
            n = 0
            while todo:
                cost, _, at, way = heapq.heappop(todo)
                if at == b:
                    out += way
                    break
                if at in seen:
                    continue
                seen.add(at)
                for to, w, t in self.edges.get(at, []):
                    if to not in avoid:
                        n += 1
                        heapq.heappush(todo, (cost + w, n, to, [*way, t]))
            else:
                raise ValueError(f"no way from {a} to {b}")
        return out

    def xform(self, df: DataFrame, source: str, target: str, **options) -> DataFrame:
        return Chain(self.path(source, target, **options))(df)

    def mirror(self, df: DataFrame, space: str) -> DataFrame:
        size, axis, warp = self.mirrors[space]
        return mirror(df, size, axis, warp)


# --- augmentation --------------------------------------------------------------------------------------------------
def jitter(df: DataFrame, sigma: float, seed: int | None = None) -> DataFrame:
    return df.withColumns({c: F.col(c) + F.randn(None if seed is None else seed + i) * sigma for i, c in enumerate(XYZ)})


def rescale(df: DataFrame, factor: float | Column, key: str = "neuron") -> DataFrame:
    """About each neuron's centroid."""
    c = df.groupBy(key).agg(*(F.avg(a).alias(f"__{a}") for a in XYZ))
    t = df.join(c, key)
    return t.withColumns({a: F.col(f"__{a}") + (F.col(a) - F.col(f"__{a}")) * factor for a in XYZ}).select(*df.columns)


def rotate(df: DataFrame, matrix, key: str = "neuron") -> DataFrame:
    """About each neuron's centroid, by a 3 x 3 matrix."""
    m = np.asarray(matrix, float)
    c = df.groupBy(key).agg(*(F.avg(a).alias(f"__{a}") for a in XYZ))
    t = df.join(c, key)
    return t.withColumns({a: F.col(f"__{a}") + sum((F.col(b) - F.col(f"__{b}")) * float(m[i, j]) for j, b in enumerate(XYZ)) for i, a in enumerate(XYZ)}).select(*df.columns)


def translate(df: DataFrame, shift) -> DataFrame:
    return df.withColumns({c: F.col(c) + float(s) for c, s in zip(XYZ, shift)})


def normalize(df: DataFrame, center: str = "centroid", scale: str | None = "rms", key: str = "neuron") -> DataFrame:
    """Centre (centroid or bbox) to the origin, then size (rms, extent or max distance) to 1."""
    mid = {a: F.avg(a) if center == "centroid" else (F.min(a) + F.max(a)) / 2 for a in XYZ}
    t = df.join(df.groupBy(key).agg(*(m.alias(f"__{a}") for a, m in mid.items())), key)
    t = t.withColumns({a: F.col(a) - F.col(f"__{a}") for a in XYZ}).select(*df.columns)
    if scale is None:
        return t
    r2 = sum(F.col(a) * F.col(a) for a in XYZ)
    size = {"rms": F.sqrt(F.avg(r2)), "max": F.sqrt(F.max(r2)), "extent": F.greatest(*(F.max(a) - F.min(a) for a in XYZ))}[scale]
    s = t.groupBy(key).agg(size.alias("__s"))
    return t.join(s, key).withColumns({a: F.when(F.col("__s") > 0, F.col(a) / F.col("__s")).otherwise(F.col(a)) for a in XYZ}).select(*df.columns)


# --- voxels --------------------------------------------------------------------------------------------------------
def voxelize(points: DataFrame, pitch: float, offset=(0.0, 0.0, 0.0), key: str = "neuron") -> DataFrame:
    """Numbers of points per cell of a grid."""
    at = [F.floor((F.col(c) - float(o)) / pitch).cast("long").alias(n) for c, o, n in zip(XYZ, offset, "ijk")]
    return points.groupBy(key, *at).agg(F.count("*").alias("value"))


def _shift(vox: DataFrame, offsets: list[tuple[int, int, int]], *extra: Column) -> DataFrame:
    o = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in offsets)))
    t = vox.withColumn("o", o)
    return t.select("neuron", (F.col("i") + F.col("o.a")).alias("i"), (F.col("j") + F.col("o.b")).alias("j"), (F.col("k") + F.col("o.c")).alias("k"), *extra)


FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def surface_voxels(vox: DataFrame, inverse: bool = False) -> DataFrame:
    """Voxels that lack one of their six neighbours (or those that have all)."""
    n = _shift(vox.select("neuron", "i", "j", "k"), FACES).groupBy("neuron", "i", "j", "k").agg(F.count("*").alias("n"))
    t = vox.join(n, ["neuron", "i", "j", "k"], "left")
    full = F.coalesce(F.col("n"), F.lit(0)) == 6
    return t.filter(full if inverse else ~full).select(*vox.columns)


def smooth_voxels(vox: DataFrame, sigma: float = 1.0, truncate: float = 4.0, epsilon: float = 0.0) -> DataFrame:
    """Gaussian filter, one axis after the other (each a shift and a sum); values up to ``epsilon`` go."""
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    total = sum(w)
    out = vox.select("neuron", "i", "j", "k", F.col("value").cast("double").alias("value"))
    for axis in "ijk":
        o = F.explode(F.array(*(F.struct(F.lit(i).alias("d"), F.lit(x / total).alias("w")) for i, x in zip(range(-r, r + 1), w))))
        t = out.withColumn("o", o).withColumn(axis, F.col(axis) + F.col("o.d")).withColumn("value", F.col("value") * F.col("o.w"))
        out = t.groupBy("neuron", "i", "j", "k").agg(F.sum("value").alias("value"))
    return out.filter(F.col("value") > epsilon)


def overlap_coefficients(vox: DataFrame, pairs: DataFrame) -> DataFrame:
    """Intersection over union and Dice coefficient of the voxel sets of pairs (a, b)."""
    v = vox.select("neuron", "i", "j", "k").distinct()
    n = v.groupBy("neuron").agg(F.count("*").alias("n"))
    both = pairs.join(v.withColumnRenamed("neuron", "a"), "a").join(v.withColumnRenamed("neuron", "b"), ["b", "i", "j", "k"]).groupBy("a", "b").agg(F.count("*").alias("m"))
    t = pairs.join(both, ["a", "b"], "left").fillna(0, ["m"]).join(n.select(F.col("neuron").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("neuron").alias("b"), F.col("n").alias("nb")), "b")
    return t.select("a", "b", (F.col("m") / (F.col("na") + F.col("nb") - F.col("m"))).alias("iou"), (2 * F.col("m") / (F.col("na") + F.col("nb"))).alias("dice"))


def voxel_components(vox: DataFrame, connectivity: int = 6) -> DataFrame:
    """Component of each voxel within its neuron, 0 the largest; one neuron in one task."""
    reach = {6: 1, 18: 2, 26: 3}[connectivity]
    offsets = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if 0 < abs(a) + abs(b) + abs(c) <= reach and (a, b, c) > (0, 0, 0)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, g in pdf.groupby("neuron", sort=False):
            ijk = g[["i", "j", "k"]].to_numpy()
            at = {tuple(x): n for n, x in enumerate(ijk.tolist())}
            label = np.arange(len(ijk))

            def top(x):
                while label[x] != x:
                    label[x] = label[label[x]]
                    x = label[x]
                return x

            for n, (i, j, k) in enumerate(ijk.tolist()):
                for a, b, c in offsets:
                    m = at.get((i + a, j + b, k + c))
                    if m is not None:
                        x, y = top(n), top(m)
                        if x != y:
                            label[max(x, y)] = min(x, y)
            roots = np.array([top(x) for x in range(len(ijk))])
            ids, inv, size = np.unique(roots, return_inverse=True, return_counts=True)
            low = np.array([min(map(tuple, ijk[inv == q].tolist())) for q in range(len(ids))]) if len(ids) < 2000 else ijk[ids]
            order = np.lexsort((low[:, 2], low[:, 1], low[:, 0], -size))
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            out.append(pd.DataFrame({"neuron": key, "i": ijk[:, 0], "j": ijk[:, 1], "k": ijk[:, 2], "component": rank[inv]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["neuron", "i", "j", "k", "component"])

    return per_neuron(vox.select("neuron", "i", "j", "k"), run, "neuron long, i long, j long, k long, component long", order=("i", "j", "k"))


# --- samples -------------------------------------------------------------------------------------------------------
def downsample(nodes: DataFrame, factor: int) -> DataFrame:
    """Roots, branch points, leaves and every ``factor``-th slab, counted from each stretch's distal end."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Forest(pdf)
        seg, depth = f.segments(), f.depth
        fix = (f.children != 1) | (f.parent < 0)
        pos = np.where(seg >= 0, depth[seg] - depth, 0)
        keep = fix | (pos % factor == 0)
        near = f.parent.copy()
        for level in f.levels[1:]:
            up = f.parent[level]
            near[level] = np.where(keep[up], up, near[up])
        return f.frame(parent_id=np.where(near >= 0, f.id[near], -1))[keep]

    links = per_neuron(nodes.select("neuron", "node_id", "parent_id"), fn, "neuron long, node_id long, parent_id long")
    return nodes.drop("parent_id").join(links, ["neuron", "node_id"]).select(*nodes.columns)


def resample(nodes: DataFrame, spacing: float) -> DataFrame:
    """New nodes about ``spacing`` apart along each stretch, linear; ends keep their ids, new ids go on from the highest."""
    return per_neuron(nodes, _resampled(spacing), "neuron long, node_id long, parent_id long, x double, y double, z double, radius double")


#: New nodes that a task holds before it gives them.
HELD_NODES = 100_000


def resampler(spacing: float):
    """The same as a function of whole neurons' rows."""
    return lambda pdf: pd.concat(list(_resampled(spacing)(pdf)), ignore_index=True)


def _resampled(spacing: float, held: int | None = None):
    """The same, giving about ``held`` nodes at a time: a long stretch has any number of them."""
    held = HELD_NODES if held is None else held

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("neuron", "node_id", "parent_id", "x", "y", "z", "radius"), map(np.concatenate, zip(*rows)))))

    def fn(pdf: pd.DataFrame):
        f = Forest(pdf)
        seg, d = f.segments(), f.dist_root
        radius = pdf["radius"].to_numpy(float)
        value = np.column_stack([f.xyz, radius])
        out, n_out, top_id = [], 0, pd.Series(f.id).groupby(f.neuron).max().to_dict()
        own = np.flatnonzero(seg >= 0)
        own = own[np.lexsort((-d[own], seg[own]))]
        cut = np.flatnonzero(np.diff(seg[own])) + 1
        names = pdf["neuron"].to_numpy()
        for chain in np.split(own, cut):
            if not len(chain):
                continue
            chain = np.append(chain, f.parent[chain[-1]])
            along = np.concatenate([[0], f.step[chain[:-1]].cumsum()])
            n = max(1, int(round(along[-1] / spacing)))
            code = f.neuron[chain[0]]
            for s in range(0, n, held):
                at = np.arange(s, min(s + held, n))
                place = at * (along[-1] / n)  # as linspace has them
                new = [np.interp(place, along, value[chain, c]) for c in range(4)]
                ids = np.append(top_id[code] + at, top_id[code] + at[-1] + 1).astype(np.int64)
                if s == 0:
                    ids[0] = f.id[chain[0]]
                if at[-1] == n - 1:
                    ids[-1] = f.id[chain[-1]]
                out.append((np.repeat(names[chain[:1]], len(at)), ids[:-1], ids[1:], *new))
                n_out += len(at)
                if n_out >= held:
                    yield frame(out)
                    out, n_out = [], 0
            top_id[code] += n - 1
        r = np.flatnonzero(f.parent < 0)
        out.append((names[r], f.id[r], np.full(len(r), -1), *f.xyz[r].T, radius[r]))
        yield frame(out)

    return fn


def sample_cable(nodes: DataFrame, spacing: float) -> DataFrame:
    """Points every ``spacing`` along the cable, edges laid end to end by node id: neuron, node_id, t, x, y, z."""
    e = with_parent(nodes, "x", "y", "z").filter("px IS NOT NULL")
    length = F.sqrt(sum((F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in XYZ))
    e = e.withColumn("len", length).filter("len > 0").withColumn("end", F.sum("len").over(Window.partitionBy("neuron").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumn("begin", F.col("end") - F.col("len"))
    first, last = F.ceil(F.col("begin") / spacing), F.ceil(F.col("end") / spacing) - 1
    e = e.filter(last >= first).withColumn("s", F.explode(F.sequence(first, last)))
    t = (F.col("s") * spacing - F.col("begin")) / F.col("len")
    return e.withColumn("t", t).select("neuron", "node_id", F.col("s").alias("sample"), "t", *((F.col(c) + (F.col(f"p{c}") - F.col(c)) * F.col("t")).alias(c) for c in XYZ))


def resample_along_axis(nodes: DataFrame, interval: float, axis: str = "z") -> DataFrame:
    """Places where edges cross the planes at multiples of ``interval``."""
    e = with_parent(nodes, *XYZ).filter(f"p{axis} IS NOT NULL AND {axis} <> p{axis}")
    lo, hi = F.least(axis, f"p{axis}"), F.greatest(axis, f"p{axis}")
    first, last = F.ceil(lo / interval), F.floor(hi / interval)
    e = e.filter(last >= first).withColumn("s", F.explode(F.sequence(first, last)))
    part, whole = F.col("s") * interval - F.col(axis), F.col(f"p{axis}") - F.col(axis)
    e = e.filter((part / whole > 0) & (part / whole < 1))
    # the product before the quotient: a place that is a whole number of thousandths stays one
    return e.select("neuron", "node_id", F.col("s").alias("plane"), *((F.col(c) + (F.col(f"p{c}") - F.col(c)) * part / whole).alias(c) for c in XYZ))


def estimate_spacing(points: DataFrame, key: str = "neuron", pid: str = "pid") -> DataFrame:
    """Median distance to the nearest other point."""
    a = points.select(key, F.col(pid).alias("a"), *XYZ)
    b = points.select(key, F.col(pid).alias("b"), *(F.col(c).alias(f"t{c}") for c in XYZ))
    d = F.sqrt(sum((F.col(c) - F.col(f"t{c}")) * (F.col(c) - F.col(f"t{c}")) for c in XYZ))
    return a.join(b, key).filter("a <> b").groupBy(key, "a").agg(F.min(d).alias("d")).groupBy(key).agg(F.median("d").alias("spacing"))


# --- meshes --------------------------------------------------------------------------------------------------------
def face_table(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with their corners' coordinates (ax .. cz); faces that have them stay as they are."""
    if "ax" in faces.columns:
        return faces
    out = faces
    for k, v in zip("abc", ("v0", "v1", "v2")):
        out = out.join(vertices.select("neuron", F.col("vid").alias(v), *(F.col(c).alias(f"{k}{c}") for c in XYZ)), ["neuron", v])
    return out


def _cross(a: str, b: str, c: str) -> list[Column]:
    u = [F.col(f"{b}{i}") - F.col(f"{a}{i}") for i in XYZ]
    v = [F.col(f"{c}{i}") - F.col(f"{a}{i}") for i in XYZ]
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def _total(value: Column) -> Column:
    """A sum that does not hang on the order of its rows: what lies on a grid of 2 ** -10 adds up exactly (below 2 ** 43), the rest is too small to matter."""
    grid = F.rint(value * 1024) / 1024
    return F.sum(grid) + F.sum(value - grid)


def mesh_measures(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Area and signed volume (divergence theorem) of each mesh."""
    t = face_table(vertices, faces)
    n = _cross("a", "b", "c")
    return t.groupBy("neuron").agg(_total(F.sqrt(sum(x * x for x in n)) / 2).alias("area"), F.sum(sum(F.col(f"a{i}") * x for i, x in zip(XYZ, n)) / 6).alias("volume"), F.count("*").alias("n_faces"))


def smooth_mesh(vertices: DataFrame, faces: DataFrame, iterations: int = 1, lamb: float = 0.5) -> DataFrame:
    """Laplacian: each vertex moves by ``lamb`` towards the mean of its neighbours."""
    e = faces.select("neuron", F.explode(F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))))).alias("e")).select("neuron", "e.a", "e.b")
    e = e.union(e.select("neuron", F.col("b"), F.col("a"))).distinct()
    for _ in range(iterations):
        near = e.join(vertices.select("neuron", F.col("vid").alias("b"), *XYZ), ["neuron", "b"]).groupBy("neuron", F.col("a").alias("vid")).agg(*(F.avg(c).alias(f"m{c}") for c in XYZ))
        t = vertices.join(near, ["neuron", "vid"], "left")
        vertices = t.select("neuron", "vid", *((F.col(c) + lamb * (F.coalesce(f"m{c}", c) - F.col(c))).alias(c) for c in XYZ))
    return vertices


def in_volume(points: DataFrame, vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Points with ``inside``: whether any of the volumes holds them (``building.in_volumes`` says which)."""
    from .building import in_volumes

    held = in_volumes(points.select(*XYZ).distinct(), vertices, faces).select(*XYZ).distinct().withColumn("__in", F.lit(True))
    return points.join(held, list(XYZ), "left").select(*points.columns, F.coalesce("__in", F.lit(False)).alias("inside"))


# --- sets of voxels ------------------------------------------------------------------------------------------------
_CELL = ("neuron", "i", "j", "k")
_SIX = [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def _cells(v: DataFrame) -> DataFrame:
    return v.select(*_CELL)


def voxel_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells that either of two objects of one id fills."""
    return _cells(a).union(_cells(b)).distinct()


def voxel_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return _cells(a).distinct().join(_cells(b), list(_CELL), "left_semi")


def voxel_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return _cells(a).distinct().join(_cells(b), list(_CELL), "left_anti")


def voxel_symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return voxel_difference(a, b).union(voxel_difference(b, a))


def _near(connectivity: int) -> list[tuple[int, int, int]]:
    """A cell and its neighbours: over faces (6), edges too (18), corners too (26)."""
    if connectivity == 6:
        return _SIX
    reach = {18: 2, 26: 3}[connectivity]
    return [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if abs(a) + abs(b) + abs(c) <= reach]


def _around(v: DataFrame, connectivity: int = 6) -> DataFrame:
    """Each cell and its neighbours, once for each cell that they come from."""
    o = F.explode(F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(("di", "dj", "dk"), t))) for t in _near(connectivity)))).alias("o")
    return _cells(v).distinct().select(*_CELL, o).select("neuron", *((F.col(c) + F.col(f"o.d{c}")).alias(c) for c in "ijk"))


def voxel_dilate(v: DataFrame, iterations: int = 1, connectivity: int = 6) -> DataFrame:
    """The cells and their neighbours."""
    for _ in range(iterations):
        v = _around(v, connectivity).distinct()
    return v


def voxel_erode(v: DataFrame, iterations: int = 1, connectivity: int = 6) -> DataFrame:
    """Cells whose neighbours are all filled: such a cell is met once by each of them and by itself."""
    for _ in range(iterations):
        v = _around(v, connectivity).groupBy(*_CELL).agg(F.count("*").alias("n")).filter(F.col("n") == connectivity + 1).select(*_CELL)
    return v


def voxel_opening(v: DataFrame, iterations: int = 1, connectivity: int = 6) -> DataFrame:
    return voxel_dilate(voxel_erode(v, iterations, connectivity), iterations, connectivity)


def voxel_closing(v: DataFrame, iterations: int = 1, connectivity: int = 6) -> DataFrame:
    return voxel_erode(voxel_dilate(v, iterations, connectivity), iterations, connectivity)


def with_values(cells: DataFrame, v: DataFrame, fill: float | None = None) -> DataFrame:
    """Cells with the values that ``v`` has for them; new ones get ``fill``, or else their object's largest value."""
    known = v.groupBy(*_CELL).agg(F.max("value").alias("value"))
    t = cells.join(known, list(_CELL), "left")
    if fill is None:
        t = t.join(v.groupBy("neuron").agg(F.max("value").alias("__f")), "neuron", "left")
    return t.select(*_CELL, F.coalesce("value", F.col("__f") if fill is None else F.lit(fill)).alias("value"))


def voxel_threshold(v: DataFrame, least: float) -> DataFrame:
    """Cells of at least that value."""
    return v.filter(F.col("value") >= least)


def voxel_flip(v: DataFrame, axis: str, shape: int | None = None) -> DataFrame:
    """Mirrored along an axis within the grid of ``shape`` cells, else the one that ends at each object's last cell."""
    if shape is not None:
        return v.withColumn(axis, shape - 1 - F.col(axis))
    m = v.groupBy("neuron").agg(F.max(axis).alias("__m"))
    return v.join(m, "neuron").withColumn(axis, F.col("__m") - F.col(axis)).select(*v.columns)


def voxel_strip(v: DataFrame) -> DataFrame:
    """Cells counted from each object's lowest corner, which is given as oi, oj, ok."""
    m = v.groupBy("neuron").agg(*(F.min(c).alias(f"o{c}") for c in "ijk"))
    return v.join(m, "neuron").withColumns({c: F.col(c) - F.col(f"o{c}") for c in "ijk"}).select(*v.columns, "oi", "oj", "ok")


def voxel_downscale(v: DataFrame, factor: int) -> DataFrame:
    """Sums of blocks of ``factor`` cells along each axis."""
    return v.groupBy("neuron", *(F.floor(F.col(c) / factor).alias(c) for c in "ijk")).agg(F.sum("value").alias("value"))
