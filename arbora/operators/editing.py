"""Edits of coordinates and links that look at whole neurons, and feature tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import distance, per_neuron, with_parent, written
from . import morphometry as M
from .forest import Forest
from .geometry import bridges
from .topology import path_rank


def _chains(f: Forest):
    """Positions of each unbranched stretch, distal end first, closed by its proximal end."""
    seg, depth = f.segments(), f.depth
    own = np.flatnonzero(seg >= 0)
    own = own[np.lexsort((-depth[own], seg[own]))]
    for chain in np.split(own, np.flatnonzero(np.diff(seg[own])) + 1):
        if len(chain):
            yield np.append(chain, f.parent[chain[-1]])


def smooth_skeleton(nodes: DataFrame, window: int = 5) -> DataFrame:
    """Centred moving mean of the coordinates along each stretch; the window shrinks towards its ends, which stay."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Forest(pdf)
        out = f.xyz.copy()
        for chain in _chains(f):
            n = len(chain)
            i = np.arange(n)
            half = np.minimum(window // 2, np.minimum(i, n - 1 - i))
            total = np.vstack([np.zeros(3), f.xyz[chain].cumsum(axis=0)])
            inner = slice(1, n - 1)
            out[chain[inner]] = ((total[i + half + 1] - total[i - half]) / (2 * half + 1)[:, None])[inner]
        return f.frame(x=out[:, 0], y=out[:, 1], z=out[:, 2])

    new = per_neuron(nodes, fn, "neuron long, node_id long, x double, y double, z double")
    return nodes.drop("x", "y", "z").join(new, ["neuron", "node_id"]).select(*nodes.columns)


def despike(nodes: DataFrame, sigma: float = 5.0, max_spike_length: int = 1) -> DataFrame:
    """For A-B-C along a stretch with |AB| / |AC| above ``sigma``, B (up to ``max_spike_length`` nodes) moves onto the line
    from A to C. Longer spikes first; later stretches see earlier moves."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Forest(pdf)
        xyz = f.xyz.copy()
        dist = lambda a, b: np.sqrt(((xyz[a] - xyz[b]) ** 2).sum(axis=1))
        for k in range(max_spike_length, 0, -1):
            for chain in _chains(f):
                if len(chain) < k + 2:
                    continue
                a, b, c = chain[: -(k + 1)], chain[1:-k], chain[k + 1 :]
                for i in np.flatnonzero(dist(a, b) > sigma * dist(a, c)).tolist():
                    for j in range(1, k + 1):
                        xyz[chain[i + j]] = xyz[a[i]] + (xyz[c[i]] - xyz[a[i]]) * j / (k + 1)
        return f.frame(x=xyz[:, 0], y=xyz[:, 1], z=xyz[:, 2])

    new = per_neuron(nodes, fn, "neuron long, node_id long, x double, y double, z double")
    return nodes.drop("x", "y", "z").join(new, ["neuron", "node_id"]).select(*nodes.columns)


def _longest(f: Forest):
    """Positions of each path of most nodes, a neuron's longest path first, distal end first; all paths but those to a
    root end with the node that they join."""
    lengths, f.step = f.step, (f.parent >= 0).astype(float)
    rank, depth = path_rank(f), f.depth
    f.step = lengths
    own = np.lexsort((-depth, rank, f.neuron))
    new = (np.diff(rank[own]) != 0) | (np.diff(f.neuron[own]) != 0)
    for chain in np.split(own, np.flatnonzero(new) + 1):
        if len(chain):
            end = f.parent[chain[-1]]
            yield np.append(chain, end) if end >= 0 else chain


def _filled(r: np.ndarray, along: np.ndarray, limit: int | None) -> np.ndarray:
    """``r`` with its gaps (nan) filled linearly in ``along``, beyond the ends by the nearest value; at most ``limit``
    of a gap from either side."""
    has = np.flatnonzero(~np.isnan(r))
    if not len(has) or len(has) == len(r):
        return r
    gap = np.flatnonzero(np.isnan(r))
    if limit is not None:
        after = np.searchsorted(has, gap)
        left = np.where(after > 0, gap - has[np.maximum(after - 1, 0)], len(r))
        right = np.where(after < len(has), has[np.minimum(after, len(has) - 1)] - gap, len(r))
        gap = gap[np.minimum(left, right) <= limit]
    out = r.copy()
    out[gap] = np.interp(along[gap], along[has], r[has])
    return out


def guess_radius(nodes: DataFrame, connectors: DataFrame, limit: int | None = None, smooth: int = 5) -> DataFrame:
    """Radii of nodes with connectors are the distance to the farthest one in the plane (whole squared distances); other
    known radii stay; the rest is linear along each path, at most ``limit`` nodes in a row.

    Each path then takes the maximum over the last ``smooth`` nodes (0: none); later, shorter paths see and overwrite the
    node that they join. What stays unknown is -1.
    """
    n = nodes.select("neuron", "node_id", *(F.col(c).alias(f"p{c}") for c in "xy"))
    flat = sum((F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in "xy")
    r = connectors.join(n, ["neuron", "node_id"]).groupBy("neuron", "node_id").agg(F.max(F.sqrt(flat.cast("long").cast("double"))).alias("__r"))

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Forest(pdf)
        known = pdf["radius"].to_numpy(float)
        out = np.where(known > 0, known, np.nan)
        by_connector = pdf["__r"].to_numpy(float)
        out = np.where(np.isnan(by_connector), out, by_connector)
        for chain in _longest(f):
            r = _filled(out[chain], f.step[chain].cumsum(), limit)
            best = r.copy()
            for back in range(1, min(smooth, len(r))):
                best[back:] = np.fmax(best[back:], r[:-back])
            out[chain] = best
        return f.frame(radius=np.where(np.isnan(out), -1.0, out))

    new = per_neuron(nodes.join(r, ["neuron", "node_id"], "left"), fn, "neuron long, node_id long, radius double")
    return nodes.drop("radius").join(new, ["neuron", "node_id"]).select(*nodes.columns)


def heal(nodes: DataFrame, max_dist: float | None = None, min_size: int = 1, leaves_only: bool = False) -> DataFrame:
    """Links a neuron's components by the shortest gaps (a minimum spanning tree); the largest keeps its root.

    Shortest gaps are found by a k-d tree in Borůvka's rounds: about n log n for a neuron of n nodes.
    """

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Forest(pdf)
        parent = np.where(f.parent >= 0, f.parent, -1)
        for code in np.unique(f.neuron):
            own = np.flatnonzero(f.neuron == code)
            root = f.root[own]
            ids, comp, size = np.unique(root, return_inverse=True, return_counts=True)
            if len(ids) < 2:
                continue
            usable = size[comp] >= min_size
            if leaves_only:
                usable &= (f.children[own] == 0) | (f.parent[own] < 0)
            links = own[bridges(f.xyz[own], comp, usable, max_dist)].tolist()
            around: dict[int, list[int]] = {}
            for a, b in [*((c, parent[c]) for c in own.tolist() if parent[c] >= 0), *links]:
                around.setdefault(int(a), []).append(int(b))
                around.setdefault(int(b), []).append(int(a))
            seen: set[int] = set()
            for r in ids[np.lexsort((f.id[ids], -size))].tolist():
                if r in seen:
                    continue
                parent[r], todo = -1, [r]
                seen.add(r)
                while todo:
                    x = todo.pop()
                    for y in around.get(x, ()):
                        if y not in seen:
                            seen.add(y)
                            parent[y] = x
                            todo.append(y)
        return f.frame(parent_id=np.where(parent >= 0, f.id[parent], -1))

    links = per_neuron(nodes, fn, "neuron long, node_id long, parent_id long")
    return nodes.drop("parent_id").join(links, ["neuron", "node_id"]).select(*nodes.columns)


def stitch(nodes: DataFrame, new_id: int, **options) -> DataFrame:
    """Several neurons as one, their gaps healed."""
    from .collections import combine

    return heal(combine(nodes, new_id), **options)


#: Tasks that the other neurons are dealt to, each with a copy of the base; pairs of nodes compared at a time.
SLICES, PAIRS = 64, 1 << 20


def _closest(q: np.ndarray, t: np.ndarray, max_dist: float) -> np.ndarray:
    """Position in ``t`` of the nearest point closer than ``max_dist`` for each of ``q``, or -1; ties: the first. Only points within ``max_dist`` along x are compared."""
    out = np.full(len(q), -1)
    by, order = np.argsort(t[:, 0], kind="stable"), np.argsort(q[:, 0], kind="stable")
    x = t[by, 0]
    for i in range(0, len(q), 256):
        own = order[i : i + 256]
        some = np.sort(by[np.searchsorted(x, q[own[0], 0] - max_dist) : np.searchsorted(x, q[own[-1], 0] + max_dist, "right")])
        step = max(1, PAIRS // max(1, len(some)))
        for j in range(0, len(own) if len(some) else 0, step):
            part = own[j : j + step]
            d = np.sqrt(sum((q[part, c, None] - t[None, some, c]) ** 2 for c in range(3)))
            best = d.argmin(axis=1)
            near = d[np.arange(len(part)), best] < max_dist
            out[part[near]] = some[best[near]]
    return out


def average(nodes: DataFrame, base: int, max_dist: float) -> DataFrame:
    """The base neuron with each node at the mean of itself and the others' nearest nodes; where any other neuron has none
    within ``max_dist``, the node stays.

    The base goes to ``SLICES`` tasks, which let their share of the other neurons pass by and give one sum a node. Ties: smaller id.
    """
    key = F.pmod(F.xxhash64("neuron"), F.lit(SLICES)).cast("int")
    slices = F.when(F.col("neuron") == base, F.sequence(F.lit(0), F.lit(SLICES - 1))).otherwise(F.array(key))
    rows = nodes.filter("neuron IS NOT NULL").select(F.explode(slices).alias("slice"), (F.col("neuron") != base).alias("other"), "neuron", "node_id", *(F.col(c).cast("double").alias(c) for c in "xyz"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, ids, own, total, count, seen = None, None, None, None, None, 0

        def given() -> Iterator[pd.DataFrame]:
            if ids is not None:
                yield pd.DataFrame({"node_id": pd.array([*ids, None], "Int64"), "n": [*count, seen], **{c: [*total[:, k], 0.0] for k, c in enumerate("xyz")}})

        for g in runs(batches):
            if g["slice"].iloc[0] != part:
                yield from given()
                part, ids = g["slice"].iloc[0], None
            at = g[["x", "y", "z"]].to_numpy(float)
            known = np.isfinite(at).all(axis=1)
            if not g["other"].iloc[0]:
                ids, own = g["node_id"].to_numpy()[known], at[known]
                total, count, seen = np.zeros((len(ids), 3)), np.zeros(len(ids), np.int64), 0
            elif ids is not None:
                seen += 1
                at = at[known]
                hit = _closest(own, at, max_dist)
                has = hit >= 0
                total[has] += at[hit[has]]
                count += has
        yield from given()

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole neurons of a slice."""
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            new = (b["slice"].to_numpy()[1:] != b["slice"].to_numpy()[:-1]) | (b["neuron"].to_numpy()[1:] != b["neuron"].to_numpy()[:-1])
            cut = [0, *(np.flatnonzero(new) + 1).tolist(), len(b)]
            for s, e in zip(cut, cut[1:]):
                g = b.iloc[s:e]
                if held and (held[-1]["slice"].iloc[-1] != g["slice"].iloc[0] or held[-1]["neuron"].iloc[-1] != g["neuron"].iloc[0]):
                    yield pd.concat(held) if len(held) > 1 else held[0]
                    held = []
                held.append(g)
        if held:
            yield pd.concat(held) if len(held) > 1 else held[0]

    sums = rows.repartition("slice").sortWithinPartitions("slice", "other", "neuron", "node_id").mapInPandas(run, "node_id long, n long, x double, y double, z double")
    sums = written(sums.groupBy("node_id").agg(F.sum("n").alias("__n"), *(F.sum(c).alias(f"__{c}") for c in "xyz")))
    all_ = sums.filter("node_id IS NULL").select(F.col("__n").alias("__all"))  # one row
    t = nodes.filter(F.col("neuron") == base).join(sums, "node_id", "left").join(F.broadcast(all_), F.lit(True), "left")
    return t.withColumns({c: F.when(F.col("__n") == F.col("__all"), (F.col(c) + F.col(f"__{c}")) / (F.col("__all") + 1)).otherwise(F.col(c)) for c in "xyz"}).select(*nodes.columns)


def split_axon_dendrite(nodes: DataFrame, connectors: DataFrame, flow_thresh: float = 0.9, split: float = 0.5) -> DataFrame:
    """Compartment per node: ``linker`` where the flow is near its maximum; the pieces between are ``axon`` where their
    share of presynapses weighs at least ``split``, else ``dendrite``; pieces without synapses take their neighbour's."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Forest(pdf)
        dp, dq, tp, tq = M._flow(f)
        flow = M._children_max(f, dp * (tq - dq) + dq * (tp - dp))
        top = pd.Series(flow).groupby(f.neuron).transform("max").to_numpy()
        linker = (flow >= flow_thresh * top) & (top > 0)
        piece = np.arange(f.n)
        for level in f.levels[1:]:
            go = level[~linker[level] & ~linker[f.parent[level]]]
            piece[go] = piece[f.parent[go]]
        pre, post = (pdf[c].to_numpy(float) for c in ("pre", "post"))
        p, q = np.bincount(piece, pre, f.n)[piece], np.bincount(piece, post, f.n)[piece]
        all_p, all_q = (pd.Series(x).groupby(f.neuron).transform("sum").to_numpy() for x in (pre, post))
        a, b = p / np.maximum(all_p, 1), q / np.maximum(all_q, 1)
        kind = np.where(linker, "linker", np.where(a + b == 0, "", np.where(a >= split * (a + b), "axon", "dendrite")))
        for level in f.levels[1:]:
            w = level[kind[level] == ""]
            kind[w] = np.where(kind[f.parent[w]] == "linker", "", kind[f.parent[w]])
        for level in f.levels[:0:-1]:
            w = level[(kind[f.parent[level]] == "") & (kind[level] != "") & (kind[level] != "linker")]
            kind[f.parent[w]] = kind[w]
        return f.frame(compartment=np.where(kind == "", "dendrite", kind))

    return per_neuron(M._synapses(nodes, connectors), fn, "neuron long, node_id long, compartment string")


def drop_nodes(nodes: DataFrame, fraction: float = 0.1, seed: int = 0) -> DataFrame:
    """Without a share of the nodes, chosen by a hash; roots and branch points stay, children move up."""
    from .topology import classify_nodes, remove_nodes

    t = classify_nodes(nodes)
    n = nodes.groupBy("neuron").agg(F.round(F.count("*") * fraction).alias("n"))
    r = t.filter("type IN ('slab', 'end')").withColumn("r", F.row_number().over(Window.partitionBy("neuron").orderBy(F.xxhash64("neuron", "node_id", F.lit(seed)))))
    return remove_nodes(nodes, r.join(n, "neuron").filter("r <= n").select("neuron", "node_id"))


def features(nodes: DataFrame) -> DataFrame:
    """One row of shape features per neuron."""
    base = M.summary(nodes).select("neuron", F.col("n_nodes").alias("num_nodes"), F.col("cable_length").alias("total_length"), "n_branches", F.col("n_leafs").alias("num_tips"), *((F.col(f"{c}_max") - F.col(f"{c}_min")).alias(f"extent_{c}") for c in "xyz"))
    path = M.dist_to_root(nodes).groupBy("neuron").agg(F.max("dist").alias("max_path_length"))
    root = nodes.filter("parent_id < 0").groupBy("neuron").agg(F.min(F.struct("node_id", "x", "y", "z")).alias("r")).select("neuron", *(F.col(f"r.{c}").alias(f"p{c}") for c in "xyz"))
    euclid = nodes.join(root, "neuron").groupBy("neuron").agg(F.max(distance()).alias("max_euclidean_distance"))
    seg = M.segment_analysis(nodes).groupBy("neuron").agg(F.avg(F.when(~F.isnan("tortuosity"), 1 / F.col("tortuosity"))).alias("mean_contraction"))
    taper = with_parent(nodes, "radius").filter("pradius > 0").groupBy("neuron").agg(F.avg(F.col("radius") / F.col("pradius")).alias("parent_daughter_ratio"))
    out = base
    for t in (path, euclid, seg, taper):
        out = out.join(t, "neuron", "left")
    return out
