"""Alignment of point sets: coherent point drift, rigid and deformable, and principal axes; a pair of objects is a unit of work.

Coherent point drift takes the source as centres of Gaussians that move as one and the target as their draw, and finds the motion by
expectation maximisation. Pairs are dealt to tasks with copies of their points; a fit meets source and target in blocks, so
memory grows with a pair's points, time with their product. ``sample`` fits on a share of the points; the motion is
a function of place and moves all of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import durable, per_neuron

XYZ = ["x", "y", "z"]
METHODS = ("rigid", "deform", "rigid+deform", "pca")


#: Pairs of points held at a time, and the lowest exponent: exp is slow where its value leaves the normal doubles, and beside a row's
#: largest value, 1, what is smaller than exp(-690) adds nothing.
PAIRS, LOWEST = 1 << 17, -690.0


def _expect(x: np.ndarray, y: np.ndarray, sigma2: float, w: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(mass of each target point, of each source point, sum of target places by source point, matched squared distance).

    Target points come in blocks of about ``PAIRS`` pairs, which stay in the cache.
    """
    n, m = len(x), len(y)
    outlier = (2 * np.pi * sigma2) ** 1.5 * w / (1 - w) * m / n if w else 0.0
    pt1, p1, px = np.empty(n), np.zeros(m), np.zeros((m, 3))
    xx, yy, ones = (x * x).sum(axis=1), (y * y).sum(axis=1), np.ones(m)
    # |x|^2 - 2 x y + |y|^2 is one product with two more coordinates
    left, right = np.column_stack([x, xx, np.ones(n)]), np.concatenate([-2 * y.T, ones[None], yy[None]])
    step = max(1, PAIRS // max(m, 1))
    for i in range(0, n, step):
        part, d = x[i : i + step], left[i : i + step] @ right
        low = d.min(axis=1, keepdims=True)  # taken out before exp, so a far point still has its nearest
        p = np.subtract(low, d, out=d)
        p *= 1 / (2 * sigma2)
        if p.min(initial=0) < LOWEST:
            np.maximum(p, LOWEST, out=p)
        np.exp(p, out=p)
        mass = p @ ones
        share = 1 / (mass + (outlier * np.exp(np.minimum(np.maximum(low[:, 0], 0) / (2 * sigma2), 600)) if w else 0.0))
        pt1[i : i + step] = mass * share
        p1 += share @ p
        px += p.T @ (part * share[:, None])
    return pt1, p1, px, max(float(pt1 @ xx - 2 * (px * y).sum() + p1 @ yy), 0.0)


class Fit:
    """A motion: ``apply`` moves places; ``rms`` is the matched residual, ``nrms`` its share of the target's radius."""

    def __init__(self, scale: float, rotation: np.ndarray, shift: np.ndarray, sigma2: float, iterations: int, converged: bool, rms: float, radius: float, warp=None):
        self.scale, self.rotation, self.shift, self.sigma2 = scale, rotation, shift, sigma2
        self.iterations, self.converged, self.rms, self.nrms, self.warp = iterations, converged, rms, rms / max(radius, 1e-300), warp

    def apply(self, p: np.ndarray) -> np.ndarray:
        if self.warp is not None:
            return self.warp(p)
        return self.scale * p @ self.rotation.T + self.shift


def _start(x: np.ndarray, y: np.ndarray) -> float:
    """Mean squared distance of all pairs by axis, from sums."""
    n, m = len(x), len(y)
    return max(float(m * (x * x).sum() + n * (y * y).sum() - 2 * x.sum(axis=0) @ y.sum(axis=0)) / (3 * n * m), 1e-12)


def _radius(x: np.ndarray) -> float:
    return float(np.sqrt(((x - x.mean(axis=0)) ** 2).sum(axis=1).mean()))


def fit_rigid(x: np.ndarray, y: np.ndarray, scale: bool = False, scale_bounds: tuple[float, float] | None = None, w: float = 0.0, tolerance: float = 1e-6, max_iterations: int = 200) -> Fit:
    """Rotation, shift and, if asked for, scale of ``y`` onto ``x``; both are first brought to the target's size, each round its own centre."""
    cx, cy, size = x.mean(axis=0), y.mean(axis=0), max(_radius(x), 1e-300)
    a, b = (x - cx) / size, (y - cy) / size
    s, r, t = 1.0, np.eye(3), np.zeros(3)
    sigma2, converged, i, off, total = _start(a, b), False, 0, 0.0, 1.0
    for i in range(1, max_iterations + 1):
        pt1, p1, px, off = _expect(a, s * b @ r.T + t, sigma2, w)
        total = max(p1.sum(), 1e-300)
        mx, my = pt1 @ a / total, p1 @ b / total
        cross = px.T @ b - total * np.outer(mx, my)
        u, _, vt = np.linalg.svd(cross)
        r = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt
        spread_y = float(p1 @ (b * b).sum(axis=1) - total * my @ my)
        spread_x = float(pt1 @ (a * a).sum(axis=1) - total * mx @ mx)
        gain = float(np.trace(cross.T @ r))
        if scale:
            s = gain / max(spread_y, 1e-300)
            if scale_bounds:
                s = float(np.clip(s, *scale_bounds))
        t = mx - s * r @ my
        new = max((spread_x - 2 * s * gain + s * s * spread_y) / (3 * total), 1e-14)
        done = abs(new - sigma2) <= tolerance * sigma2 or new <= 1e-14
        sigma2 = new
        if done:
            converged = True
            break
    shift = cx + size * t - s * r @ cy
    return Fit(s, r, shift, sigma2 * size * size, i, converged, float(np.sqrt(3 * sigma2)) * size, size)


#: Values of a kernel held at a time.
HELD = 4_000_000


def _kernel(p: np.ndarray, y: np.ndarray, beta: float) -> np.ndarray:
    d = np.maximum((p * p).sum(axis=1)[:, None] - 2 * p @ y.T + (y * y).sum(axis=1)[None], 0) / (-2 * beta * beta)
    return np.exp(np.maximum(d, LOWEST, out=d), out=d)


def _smooth(p: np.ndarray, y: np.ndarray, beta: float, values: np.ndarray) -> np.ndarray:
    """Kernel between places and points times values, in blocks."""
    step = max(1, HELD // max(len(y), 1))
    return np.concatenate([_kernel(p[i : i + step], y, beta) @ values for i in range(0, len(p), step)]) if len(p) else np.zeros((0, values.shape[1]))


def modes(y: np.ndarray, beta: float, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, values) of the ``k`` largest modes of the kernel among the points: its range by block power iteration.

    A kernel of at most ``HELD`` values is made once, a larger one again in each round.
    """
    k = min(k, len(y))
    whole = _kernel(y, y, beta) if len(y) ** 2 <= HELD else None
    times = lambda q: _smooth(y, y, beta, q) if whole is None else whole @ q
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(y), min(len(y), k + 10))))[0]
    for _ in range(3):
        q = np.linalg.qr(times(q))[0]
    value, vector = np.linalg.eigh(q.T @ times(q))
    top = np.argsort(value)[::-1][:k]
    keep = value[top] > 1e-10 * max(value.max(), 1e-300)
    return q @ vector[:, top[keep]], value[top[keep]]


def fit_deform(x: np.ndarray, y: np.ndarray, alpha: float = 2.0, beta: float = 0.2, num_modes: int = 100, w: float = 0.0, tolerance: float = 1e-6, max_iterations: int = 200) -> Fit:
    """A smooth warp of ``y`` onto ``x``: a sum of Gaussians of width ``beta`` (in radii of the target) held back by ``alpha``.

    The kernel is kept by its ``num_modes`` largest modes, so a round solves a system of that size. Places beside the points
    move by the same modes.
    """
    cx, size = x.mean(axis=0), max(_radius(x), 1e-300)
    a, b = (x - cx) / size, (y - cx) / size
    q, value = modes(b, beta, num_modes)
    moved, coefficient = b.copy(), np.zeros((q.shape[1], 3))
    sigma2, converged, i = _start(a, b), False, 0
    for i in range(1, max_iterations + 1):
        pt1, p1, px, _ = _expect(a, moved, sigma2, w)
        # weights are q @ c: (value^-1 alpha sigma2 + q' P q) (value c) = q' (P x - P y)
        system = (q * p1[:, None]).T @ q + np.diag(alpha * sigma2 / value)
        coefficient = np.linalg.solve(system, q.T @ (px - p1[:, None] * b)) / value[:, None]
        moved = b + q @ (value[:, None] * coefficient)
        total = max(p1.sum(), 1e-300)
        new = max(float(pt1 @ (a * a).sum(axis=1) - 2 * (px * moved).sum() + p1 @ (moved * moved).sum(axis=1)) / (3 * total), 1e-14)
        done = abs(new - sigma2) <= tolerance * sigma2 or new <= 1e-14
        sigma2 = new
        if done:
            converged = True
            break
    weights = q @ coefficient

    def warp(p: np.ndarray) -> np.ndarray:
        own = (p - cx) / size
        return (own + _smooth(own, b, beta, weights)) * size + cx

    return Fit(1.0, np.eye(3), np.zeros(3), sigma2 * size * size, i, converged, float(np.sqrt(3 * sigma2)) * size, size, warp)


def fit_axes(x: np.ndarray, y: np.ndarray) -> Fit:
    """The rotation and shift that lay ``y``'s centre and principal axes on ``x``'s; axes point where most points are."""

    def frame(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = p.mean(axis=0)
        axes = np.linalg.eigh((p - c).T @ (p - c))[1][:, ::-1]
        axes = axes * np.where((((p - c) @ axes) ** 3).sum(axis=0) < 0, -1, 1)
        axes[:, 2] = np.cross(axes[:, 0], axes[:, 1])
        return c, axes

    (cx, fx), (cy, fy) = frame(x), frame(y)
    r = fx @ fy.T
    return Fit(1.0, r, cx - r @ cy, 0.0, 1, True, 0.0, _radius(x))


def align(points: DataFrame, pairs: DataFrame, method: str = "rigid", targets: DataFrame | None = None, pid: str = "node_id", sample: float | None = None, mirror_axis: str | None = None, scale: bool = False, scale_bounds: tuple[float, float] | None = None, alpha: float = 2.0, beta: float = 0.2, num_modes: int = 100, w: float = 0.0, tolerance: float = 1e-6, max_iterations: int = 200) -> tuple[DataFrame, DataFrame]:
    """(aligned, fits) for ``pairs`` (source, target): each source's points moved onto each of its targets.

    ``aligned``: source, target, the points' id, x, y, z. ``fits``: scale, rotation (nine numbers by row), shift, sigma2, rms, nrms,
    iterations, converged; of ``rigid+deform`` the rigid part and the warp's residual. ``method``: ``rigid``, ``deform``, ``rigid+deform`` or ``pca``.
    ``mirror_axis``: rigid fits are tried mirrored along it too, and the one with the smaller residual stays (its rotation has
    determinant -1). ``sample``: share of points to fit on, by a hash of their ids (four at least). ``targets``: points of the targets, if others
    than ``points``. Null places are left out; pairs in which either side has fewer than three points have no rows; repeated pairs count once.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    if mirror_axis not in (None, "x", "y", "z"):
        raise ValueError("mirror_axis must be x, y or z")
    own = pairs.select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target")).distinct()
    place = lambda t: t.select("neuron", F.col(pid).cast("long").alias("id"), *(F.col(c).cast("double").alias(c) for c in XYZ)).dropna(subset=XYZ)
    rows = own.join(place(points).withColumnRenamed("neuron", "source"), "source").select("source", "target", F.lit(0).alias("kind"), "id", *XYZ)
    rows = rows.union(own.join(place(points if targets is None else targets).withColumnRenamed("neuron", "target"), "target").select("source", "target", F.lit(1), "id", *XYZ))
    rows = rows.withColumn("pair", F.concat_ws(">", "source", "target"))
    flip = None if mirror_axis is None else np.diag([-1.0 if c == mirror_axis else 1.0 for c in XYZ])
    common = {"w": w, "tolerance": tolerance, "max_iterations": max_iterations}

    def few(p: np.ndarray, ids: np.ndarray) -> np.ndarray:
        if sample is None:
            return p
        order = np.argsort((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11), kind="stable")
        return p[np.sort(order[: max(4, round(sample * len(p)))])]

    def chain(x: np.ndarray, y: np.ndarray) -> list[Fit]:
        if method == "pca":
            return [fit_axes(x, y)]
        out = []
        if method != "deform":
            out.append(fit_rigid(x, y, scale, scale_bounds, **common))
            if flip is not None:
                other = fit_rigid(x, y @ flip, scale, scale_bounds, **common)
                if other.rms < out[0].rms:
                    other.rotation = other.rotation @ flip
                    out[0] = other
        if method != "rigid":
            out.append(fit_deform(x, out[0].apply(y) if out else y, alpha, beta, num_modes, **common))
        return out

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby("pair", sort=False):
            s, t = g[g["kind"] == 0], g[g["kind"] == 1]
            if len(s) < 3 or len(t) < 3:
                continue
            y, x, ids = s[XYZ].to_numpy(), t[XYZ].to_numpy(), s["id"].to_numpy()
            fits = chain(few(x, t["id"].to_numpy()), few(y, ids))
            moved = y
            for f in fits:
                moved = f.apply(moved)
            name = {"source": s["source"].iloc[0], "target": s["target"].iloc[0]}
            out.append(pd.DataFrame({**name, "kind": 0, "id": ids, **dict(zip(XYZ, moved.T)), "fit": None}))
            a, b = fits[0], fits[-1]
            values = [a.scale, *a.rotation.ravel(), *a.shift, b.sigma2, b.rms, b.nrms, float(sum(f.iterations for f in fits)), float(all(f.converged for f in fits))]
            out.append(pd.DataFrame({**name, "kind": 1, "id": 0, "x": 0.0, "y": 0.0, "z": 0.0, "fit": [list(map(float, values))]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["source", "target", "kind", "id", *XYZ, "fit"])

    rows = durable(per_neuron(rows, fn, "source long, target long, kind int, id long, x double, y double, z double, fit array<double>", key="pair", order=("kind", "id"), union=True))
    v = lambda i: F.col("fit")[i]
    fits = rows.filter("kind = 1").select("source", "target", v(0).alias("scale"), F.slice("fit", 2, 9).alias("rotation"), F.slice("fit", 11, 3).alias("shift"), v(13).alias("sigma2"), v(14).alias("rms"), v(15).alias("nrms"), v(16).cast("long").alias("iterations"), (v(17) > 0).alias("converged"))
    return rows.filter("kind = 0").select("source", "target", F.col("id").alias(pid), *XYZ), fits
