"""Measures of single neurons. Column arithmetic is DataFrame code; tree recursions run over whole neurons in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import distance, per_neuron, with_parent, written
from .forest import Forest


# --- lengths -------------------------------------------------------------------------------------------------------
def parent_dist(nodes: DataFrame, root_dist: float | None = None) -> DataFrame:
    """Distance of each node to its parent; roots get ``root_dist`` (default null)."""
    d = with_parent(nodes, "x", "y", "z").withColumn("parent_dist", F.coalesce(distance(), F.lit(root_dist)))
    return d.select("neuron", "node_id", "parent_dist")


def cable_length(nodes: DataFrame) -> DataFrame:
    """Sum of parent distances per neuron. Mask by filtering nodes first: nodes without their parent count as roots."""
    return parent_dist(nodes, 0.0).groupBy("neuron").agg(F.sum("parent_dist").alias("cable_length"))


def surface_volume(nodes: DataFrame) -> DataFrame:
    """Cable length, lateral surface and volume of the tapered cylinders, and cable per node."""
    e = with_parent(nodes, "x", "y", "z", "radius").withColumn("h", F.coalesce(distance(), F.lit(0.0)))
    r1, r2, h = F.col("radius"), F.coalesce("pradius", "radius"), F.col("h")
    return e.groupBy("neuron").agg(
        F.sum("h").alias("cable_length"),
        F.sum(np.pi * (r1 + r2) * F.sqrt((r1 - r2) * (r1 - r2) + h * h) * (h > 0).cast("int")).alias("surface_area"),
        F.sum(np.pi / 3 * (r1 * r1 + r1 * r2 + r2 * r2) * h).alias("volume"),
        (F.sum("h") / F.count("*")).alias("sampling_resolution"),
    )


def summary(nodes: DataFrame) -> DataFrame:
    """Numbers of nodes, branch points, leaves and roots, cable length and bounding box per neuron."""
    kids = nodes.filter("parent_id >= 0").groupBy("neuron", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("c"))
    t = with_parent(nodes, "x", "y", "z").join(kids, ["neuron", "node_id"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    root = F.col("parent_id") < 0
    return t.groupBy("neuron").agg(
        F.count("*").alias("n_nodes"),
        F.count_if(~root & (F.col("c") > 1)).alias("n_branches"),
        F.count_if(~root & (F.col("c") == 0)).alias("n_leafs"),
        F.count_if(root).alias("n_trees"),
        F.sum(F.coalesce(distance(), F.lit(0.0))).alias("cable_length"),
        *(f(c).alias(f"{c}_{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))),
    )


# --- orders and segments -------------------------------------------------------------------------------------------
def strahler_index(nodes: DataFrame, method: str = "standard", min_twig_size: int | None = None) -> DataFrame:
    """Strahler order per node; ``greedy`` adds the children up. Twigs of fewer nodes than ``min_twig_size`` are ignored
    and take the order of the branch point they hang from."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Forest(pdf)
        si = f.strahler(method == "greedy")
        if min_twig_size:
            seg = f.segments()
            size = np.bincount(seg[seg >= 0], minlength=f.n)
            twig = (seg >= 0) & (f.children[seg] == 0) & (size[seg] < min_twig_size)
            keep = Forest(pdf[~twig].reset_index(drop=True))
            si = np.zeros(f.n, np.int64)
            si[~twig] = keep.strahler(method == "greedy")
            for level in f.levels[1:]:
                w = level[twig[level]]
                si[w] = si[f.parent[w]]
        return f.frame(strahler_index=si)

    return per_neuron(nodes, fn, "neuron long, node_id long, strahler_index long")


def segments(nodes: DataFrame) -> DataFrame:
    """(neuron, node_id, segment, pos): unbranched stretches, named by their distal end, positions from there; the
    branch point or root that closes a stretch is its last row."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Forest(pdf)
        seg, depth = f.segments(), f.depth
        at = np.flatnonzero(seg >= 0)
        top = at[(f.children[f.parent[at]] != 1) | (f.parent[f.parent[at]] < 0)]
        node, owner = np.concatenate([at, f.parent[top]]), np.concatenate([seg[at], seg[top]])
        out = pd.DataFrame({"neuron": f.nodes["neuron"].to_numpy()[node], "node_id": f.id[node], "segment": f.id[owner], "pos": depth[owner] - depth[node]})
        return out

    return per_neuron(nodes, fn, "neuron long, node_id long, segment long, pos long")


def segment_analysis(nodes: DataFrame) -> DataFrame:
    """Per unbranched stretch: length, tortuosity, distance of its proximal end to the root, Strahler order, radii, volume."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Forest(pdf)
        seg, d, si = f.segments(), f.dist_root, f.strahler()
        at = np.flatnonzero(seg >= 0)
        if not len(at):
            return pd.DataFrame(columns=["neuron"])
        p = f.parent[at]
        r = f.nodes["radius"].to_numpy(float)
        top_of = np.full(f.n, -1)
        ends = (f.children[p] != 1) | (f.parent[p] < 0)
        top_of[seg[at[ends]]] = p[ends]
        vol = np.bincount(seg[at], np.pi / 3 * (r[at] ** 2 + r[at] * r[p] + r[p] ** 2) * f.step[at], f.n)
        s = np.unique(seg[at])
        node = np.concatenate([at, top_of[s]])
        own = np.concatenate([seg[at], s])
        g = pd.Series(r[node]).groupby(own).agg(["mean", "min", "max"])
        top = top_of[s]
        straight = np.sqrt(((f.xyz[s] - f.xyz[top]) ** 2).sum(axis=1))
        length = d[s] - d[top]
        with np.errstate(divide="ignore", invalid="ignore"):
            tort = np.where(straight > 0, length / straight, np.nan)
        return pd.DataFrame({"neuron": f.nodes["neuron"].to_numpy()[s], "segment": f.id[s], "length": length, "tortuosity": tort, "root_dist": d[top], "strahler_index": si[s], "radius_mean": g["mean"].to_numpy(), "radius_min": g["min"].to_numpy(), "radius_max": g["max"].to_numpy(), "volume": vol[s]})

    return per_neuron(nodes, fn, "neuron long, segment long, length double, tortuosity double, root_dist double, strahler_index long, radius_mean double, radius_min double, radius_max double, volume double")


def tortuosity(nodes: DataFrame, seg_length: float | None = None) -> DataFrame:
    """Mean over segments of path length over straight distance; with ``seg_length``, over stretches of that length."""
    if seg_length is None:
        return segment_analysis(nodes).groupBy("neuron").agg(F.avg(F.when(~F.isnan("tortuosity"), F.col("tortuosity"))).alias("tortuosity"))

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Forest(pdf)
        seg, depth = f.segments(), f.depth
        out = []
        at = np.flatnonzero(seg >= 0)
        for own, group in pd.Series(at).groupby(seg[at]):
            chain = group.to_numpy()[np.argsort(-depth[group.to_numpy()])]
            chain = np.append(chain, f.parent[chain[-1]])
            along = np.concatenate([[0], f.step[chain[:-1]].cumsum()])
            cuts = np.arange(0, along[-1] + 1e-9, seg_length)
            if len(cuts) < 2:
                continue
            place = np.column_stack([np.interp(cuts, along, f.xyz[chain, i]) for i in range(3)])
            r = np.sqrt((np.diff(place, axis=0) ** 2).sum(axis=1))
            out.append((f.nodes["neuron"].iloc[own], (seg_length / r[r > 0]).sum(), int((r > 0).sum())))
        return pd.DataFrame(out, columns=["neuron", "s", "n"])

    parts = per_neuron(nodes, fn, "neuron long, s double, n long").groupBy("neuron").agg((F.sum("s") / F.sum("n")).alias("tortuosity"))
    return nodes.select("neuron").distinct().join(parts, "neuron", "left")


# --- radial profiles -----------------------------------------------------------------------------------------------
def sholl_analysis(nodes: DataFrame, radii: list[float], center: str | tuple = "centermass", geodesic: bool = False) -> DataFrame:
    """Per radius: crossings (exactly one end of an edge within), cable and branch points strictly inside the shell."""
    steps = [0.0, *(r for r in radii if r > 0)]
    if geodesic:
        d = dist_to_root(nodes, weighted=True).withColumnRenamed("dist", "d")
        t = nodes.join(d, ["neuron", "node_id"])
    elif center == "root":
        c = nodes.filter("parent_id < 0").groupBy("neuron").agg(F.min(F.struct("node_id", "x", "y", "z")).alias("s")).select("neuron", *(F.col(f"s.{a}").alias(f"c{a}") for a in "xyz"))
        t = nodes.join(c, "neuron").withColumn("d", distance("", "c"))
    elif center == "centermass":
        c = nodes.groupBy("neuron").agg(*(F.avg(a).alias(f"c{a}") for a in "xyz"))
        t = nodes.join(c, "neuron").withColumn("d", distance("", "c"))
    else:
        t = nodes.withColumns({f"c{a}": F.lit(float(v)) for a, v in zip("xyz", center)}).withColumn("d", distance("", "c"))
    kids = nodes.filter("parent_id >= 0").groupBy("neuron", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("kids"))
    t = t.select("neuron", "node_id", "parent_id", "x", "y", "z", "d").join(kids, ["neuron", "node_id"], "left")
    e = with_parent(t, "x", "y", "z", "d").withColumn("len", distance())
    shells = F.array(*(F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for a, b in zip(steps, steps[1:])))
    e = e.withColumn("s", F.explode(shells)).select("*", "s.lo", "s.hi")
    within = lambda c: (F.col(c) > F.col("lo")) & (F.col(c) < F.col("hi"))
    return e.groupBy("neuron", F.col("hi").alias("radius")).agg(
        F.sum(F.coalesce(((F.col("d") <= F.col("hi")) != (F.col("pd") <= F.col("hi"))).cast("long"), F.lit(0))).alias("intersections"),
        F.sum(F.when(within("d") & F.col("len").isNotNull(), F.col("len")).otherwise(0.0)).alias("cable_length"),
        F.sum((within("d") & (F.col("kids") > 1) & (F.col("parent_id") >= 0)).cast("long")).alias("branch_points"),
    ).withColumn("branch_points", F.coalesce("branch_points", F.lit(0)))


# --- distances -----------------------------------------------------------------------------------------------------
def dist_to_root(nodes: DataFrame, weighted: bool = True) -> DataFrame:
    """Path length (or number of edges) from each node to its root."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Forest(pdf)
        return f.frame(dist=f.dist_root if weighted else f.depth.astype(float))

    return per_neuron(nodes, fn, "neuron long, node_id long, dist double")


# --- angles --------------------------------------------------------------------------------------------------------
def _angle(a: str, b: str):
    dot = sum(F.col(f"{a}{c}") * F.col(f"{b}{c}") for c in "xyz")
    norm = lambda v: F.sqrt(sum(F.col(f"{v}{c}") * F.col(f"{v}{c}") for c in "xyz"))
    n = norm(a) * norm(b)
    return F.when(n > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / n))))


def _edge_vectors(nodes: DataFrame, name: str) -> DataFrame:
    """Child minus parent for every node with a parent."""
    e = with_parent(nodes, "x", "y", "z", "parent_id").filter("px IS NOT NULL")
    return e.select("neuron", "node_id", "parent_id", F.col("pparent_id").alias("grand"), *((F.col(c) - F.col(f"p{c}")).alias(f"{name}{c}") for c in "xyz"))


def branch_angles(nodes: DataFrame, degrees: bool = True) -> DataFrame:
    """Angle between each two children's edges at branch points that are no roots."""
    return _pair_angles(_edge_vectors(nodes, "a").filter("grand >= 0"), degrees)


def soma_exit_angles(nodes: DataFrame, degrees: bool = True) -> DataFrame:
    """Angle between each two stems of a root."""
    return _pair_angles(_edge_vectors(nodes, "a").filter("grand < 0"), degrees)


def _pair_angles(v: DataFrame, degrees: bool) -> DataFrame:
    w = v.select("neuron", "parent_id", F.col("node_id").alias("other"), *(F.col(f"a{c}").alias(f"b{c}") for c in "xyz"))
    pair = v.join(w, ["neuron", "parent_id"]).filter("node_id < other")
    angle = _angle("a", "b")
    return pair.select("neuron", F.col("parent_id").alias("node_id"), F.col("node_id").alias("child_a"), F.col("other").alias("child_b"), (F.degrees(angle) if degrees else angle).alias("angle"))


def path_angles(nodes: DataFrame, degrees: bool = True) -> DataFrame:
    """Angle between the edge into a slab node and the edge out of it."""
    kids = nodes.filter("parent_id >= 0").groupBy("neuron", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("c")).filter("c = 1")
    v = _edge_vectors(nodes, "a")
    out = v.select("neuron", F.col("parent_id").alias("node_id"), *(F.col(f"a{c}").alias(f"b{c}") for c in "xyz"))
    t = v.join(kids, ["neuron", "node_id"]).join(out, ["neuron", "node_id"])
    angle = _angle("a", "b")
    return t.select("neuron", "node_id", (F.degrees(angle) if degrees else angle).alias("angle"))


def root_angles(nodes: DataFrame, degrees: bool = True) -> DataFrame:
    """Angle between each edge (parent to child) and the direction from the root to the parent."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Forest(pdf)
        at = np.flatnonzero(f.parent >= 0)
        p = f.parent[at]
        a, b = f.xyz[at] - f.xyz[p], f.xyz[p] - f.xyz[f.root[at]]
        n = np.sqrt((a**2).sum(axis=1)) * np.sqrt((b**2).sum(axis=1))
        ok = n > 0
        ang = np.arccos(np.clip((a[ok] * b[ok]).sum(axis=1) / n[ok], -1, 1))
        return f.frame(x=0.0).iloc[at[ok]][["neuron", "node_id"]].assign(angle=np.degrees(ang) if degrees else ang)

    return per_neuron(nodes, fn, "neuron long, node_id long, angle double")


# --- synapse flow --------------------------------------------------------------------------------------------------
def _synapses(nodes: DataFrame, connectors: DataFrame) -> DataFrame:
    """Nodes with their numbers of pre- and postsynapses."""
    n = connectors.groupBy("neuron", "node_id").agg(F.count_if(F.col("type") == "pre").alias("pre"), F.count_if(F.col("type") == "post").alias("post"))
    return nodes.join(n, ["neuron", "node_id"], "left").fillna(0, ["pre", "post"])


def _flow(f: Forest) -> tuple[np.ndarray, ...]:
    pre, post = (f.nodes[c].to_numpy(np.int64) for c in ("pre", "post"))
    dp, dq, root = f.up(pre), f.up(post), f.root
    return dp, dq, dp[root], dq[root]


def synapse_flow_centrality(nodes: DataFrame, connectors: DataFrame, mode: str = "sum") -> DataFrame:
    """Paths from post- to presynapses through each node, per component; branch points take their children's maximum.

    ``centrifugal`` counts paths to distal presynapses, ``centripetal`` paths from distal postsynapses.
    """

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Forest(pdf)
        dp, dq, tp, tq = _flow(f)
        away, toward = dp * (tq - dq), dq * (tp - dp)
        value = {"sum": away + toward, "centrifugal": away, "centripetal": toward}[mode]
        return f.frame(flow=_children_max(f, value))

    return per_neuron(_synapses(nodes, connectors), fn, "neuron long, node_id long, flow long")


def _children_max(f: Forest, value: np.ndarray) -> np.ndarray:
    """Branch points that are no roots take the maximum of their children."""
    best = np.zeros(f.n, value.dtype)
    has = np.flatnonzero(f.parent >= 0)
    np.maximum.at(best, f.parent[has], value[has])
    return np.where((f.children > 1) & (f.parent >= 0), best, value)


def flow_centrality(nodes: DataFrame) -> DataFrame:
    """(leaves not distal) * (leaves distal) of each unbranched stretch's distal end; branch points: children's maximum."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Forest(pdf)
        d = f.up(((f.children == 0) & (f.parent >= 0)).astype(np.int64))
        value = d * (d[f.root] - d)
        return f.frame(flow=_children_max(f, value))

    return per_neuron(nodes, fn, "neuron long, node_id long, flow long")


def bending_flow(nodes: DataFrame, connectors: DataFrame) -> DataFrame:
    """At branch points: sum over ordered pairs of children of distal post of one times distal pre of the other."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Forest(pdf)
        dp, dq, _, _ = _flow(f)
        has = np.flatnonzero(f.parent >= 0)
        p = f.parent[has]
        sum_p, sum_q, same = (np.bincount(p, w, f.n) for w in (dp[has], dq[has], dp[has] * dq[has]))
        value = np.where(f.children > 1, sum_p * sum_q - same, 0).astype(np.int64)
        return f.frame(flow=value)[f.children > 1]

    return per_neuron(_synapses(nodes, connectors), fn, "neuron long, node_id long, flow long")


def _entropy(p: np.ndarray) -> np.ndarray:
    q = np.where((p > 0) & (p < 1), p, 0.5)
    return np.where((p > 0) & (p < 1), -(q * np.log(q) + (1 - q) * np.log(1 - q)), 0.0)


def segregation_index(parts: DataFrame, by: str = "part", key: str = "neuron") -> DataFrame:
    """1 - weighted entropy of the parts' pre/post mix over the whole's; 0 where the whole is pure."""
    g = parts.groupBy(key, by).agg(F.sum("pre").alias("pre"), F.sum("post").alias("post"))
    n, p = F.col("pre") + F.col("post"), F.col("post") / (F.col("pre") + F.col("post"))
    h = lambda q: F.when((q > 0) & (q < 1), -(q * F.log(q) + (1 - q) * F.log(1 - q))).otherwise(0.0)
    g = g.filter(n > 0).withColumns({"n": n, "hn": h(p) * n})
    t = g.groupBy(key).agg(F.sum("hn").alias("hn"), F.sum("n").alias("n"), F.sum("post").alias("q"))
    whole = h(F.col("q") / F.col("n"))
    return t.select(key, F.when(whole > 0, 1 - F.col("hn") / F.col("n") / whole).otherwise(0.0).alias("segregation_index"))


def arbor_segregation_index(nodes: DataFrame, connectors: DataFrame) -> DataFrame:
    """Segregation index of the parts distal and proximal of each node, within its component."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Forest(pdf)
        dp, dq, tp, tq = _flow(f)

        def h(p, q):
            n = p + q
            return _entropy(np.where(n > 0, q / np.maximum(n, 1), 0)) * n

        whole, n = h(tp, tq), tp + tq
        split = h(dp, dq) + h(tp - dp, tq - dq)
        return f.frame(segregation_index=np.where(whole > 0, 1 - split / np.where(whole > 0, whole, 1), 0.0))

    return per_neuron(_synapses(nodes, connectors), fn, "neuron long, node_id long, segregation_index double")


def betweenness_centrality(nodes: DataFrame, directed: bool = True) -> DataFrame:
    """Shortest paths through each node: in a tree, products of the counts on its sides."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Forest(pdf)
        size = f.up(np.ones(f.n, np.int64))
        if directed:
            return f.frame(betweenness=(size - 1) * f.depth)
        total = size[f.root]
        has = np.flatnonzero(f.parent >= 0)
        squares = np.bincount(f.parent[has], size[has] ** 2, f.n).astype(np.int64) + (total - size) ** 2
        return f.frame(betweenness=((total - 1) ** 2 - squares) // 2)

    return per_neuron(nodes, fn, "neuron long, node_id long, betweenness long")


# --- persistence ---------------------------------------------------------------------------------------------------
def persistence_points(nodes: DataFrame) -> DataFrame:
    """Birth (root distance of the leaf) and death (of the point where it meets a longer path) of each path."""

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Forest(pdf)
        leaf, d = f.paths(), f.dist_root
        top = np.flatnonzero((f.parent < 0) | (leaf[f.parent] != leaf))
        death = np.where(f.parent[top] < 0, d[top], d[f.parent[top]])
        own = leaf[top]
        return pd.DataFrame({"neuron": f.nodes["neuron"].to_numpy()[own], "leaf": f.id[own], "birth": d[own], "death": death})

    return per_neuron(nodes, fn, "neuron long, leaf long, birth double, death double")


def persistence_vectors(points: DataFrame, samples: int = 100, bw: float = 0.2) -> DataFrame:
    """Gaussian density of births, weighted by lifetimes, at even places from 0 to 1.05 times the largest birth of all.

    The kernel's width is ``bw`` times the weighted standard deviation of a neuron's births. The points are written once and read three times.
    """
    points = written(points.select("neuron", "birth", "death"))
    top = points.agg((F.max("birth") * 1.05).alias("top"))
    w = points.withColumn("w", F.col("birth") - F.col("death")).filter("w > 0")
    m = w.groupBy("neuron").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("birth")).alias("s1"), F.sum(F.col("w") * F.col("birth") * F.col("birth")).alias("s2"), F.sum(F.col("w") * F.col("w")).alias("ww"))
    mean = F.col("s1") / F.col("sw")
    m = m.withColumn("h", bw * F.sqrt((F.col("s2") / F.col("sw") - mean * mean) / (1 - F.col("ww") / (F.col("sw") * F.col("sw")))))
    grid = F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("i")
    t = w.join(m.select("neuron", "sw", "h"), "neuron").filter("h > 0").join(F.broadcast(top))  # one row
    t = t.select("*", grid).withColumn("at", F.col("i") * F.col("top") / (samples - 1))
    z = (F.col("at") - F.col("birth")) / F.col("h")
    return t.groupBy("neuron", "i").agg(F.sum(F.col("w") * F.exp(-z * z / 2) / (F.col("sw") * F.col("h") * np.sqrt(2 * np.pi))).alias("density"))


#: Vectors of a block of queries; tasks that share a block at most, and tasks in all at least; pairs made at a time.
BLOCK_VECTORS, SLICES, TASKS, AT_ONCE = 65_536, 64, 256, 1 << 18


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each row of ``b`` from each of ``a``, by one product; of near ones by their differences, which keep their digits."""
    d = (b * b).sum(axis=1)[:, None] - 2 * b @ a.T + (a * a).sum(axis=1)[None]
    j, i = np.nonzero(d < 1e-3)
    if len(i):
        d[j, i] = ((b[j] - a[i]) ** 2).sum(axis=1)
    return np.sqrt(d, out=d)


def persistence_distances(vectors: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Euclidean distance of normalised vectors of each pair (a < b), or of ``queries`` (a column a) with all others.

    A task holds a block of about ``BLOCK_VECTORS`` queries and lets its share of the vectors pass by: what moves is every vector once for
    each block and every query once for each slice, no row of a pair. The rows given are all pairs, which no task holds. All vectors
    must have equally many samples.
    """
    v = vectors.groupBy("neuron").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "density"))), lambda x: x["density"]).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    v = written(v.select("neuron", F.transform("v", lambda x: x / length).alias("v")).filter("neuron IS NOT NULL"))
    q = v if queries is None else v.join(queries.select(F.col("a").alias("neuron")).distinct(), "neuron", "left_semi")
    n = max(1, -(-q.count() // BLOCK_VECTORS))
    slices = min(SLICES, max(1, -(-TASKS // n)))
    block = F.pmod(F.xxhash64("neuron"), F.lit(n)).cast("int").alias("block")
    held = q.select(block, F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), "neuron", "v")
    pass_ = v.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.pmod(F.xxhash64("neuron", F.lit(1)), F.lit(slices)).cast("int").alias("slice"), F.lit(1).alias("kind"), "neuron", "v")
    once = queries is None

    def meet(names: pa.Array, own: np.ndarray, others: pa.Array, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        left, step = names.to_numpy(zero_copy_only=False), max(1, AT_ONCE // len(own))
        for s in range(0, len(rows), step):
            some = others[s : s + step]
            right = some.to_numpy(zero_copy_only=False)
            i, j, d = np.tile(np.arange(len(own)), len(some)), np.repeat(np.arange(len(some)), len(own)), _distances(own, rows[s : s + step]).ravel()
            keep = (left[None] < right[:, None] if once else left[None] != right[:, None]).ravel()
            if not keep.all():
                i, j, d = i[keep], j[keep], d[keep]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), some.take(pa.array(j)), pa.array(d)], names=["a", "b", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, parts, own = None, [], [], None
        for b in batches:
            at = np.stack([b[c].to_numpy() for c in ("block", "slice", "kind")])
            cut = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for s, e in zip(cut, cut[1:]):
                if s == e:
                    continue
                if tuple(at[:2, s]) != key:
                    key, names, parts, own = tuple(at[:2, s]), [], [], None
                some = b["v"].slice(s, e - s)
                if np.ptp(some.value_lengths().to_numpy()):
                    raise ValueError("all vectors must have equally many samples")
                rows = some.flatten().to_numpy(zero_copy_only=False).reshape(e - s, -1)
                if not at[2, s]:
                    names.append(b["neuron"].slice(s, e - s))
                    parts.append(rows)
                    continue
                if own is None and parts:
                    own = pa.concat_arrays(names), np.concatenate(parts)
                if own is not None:
                    yield from meet(*own, b["neuron"].slice(s, e - s), rows)

    kind = dict(v.dtypes)["neuron"]
    return held.unionByName(pass_).repartition("block", "slice").sortWithinPartitions("block", "slice", "kind").mapInArrow(run, f"a {kind}, b {kind}, distance double")


# --- clouds --------------------------------------------------------------------------------------------------------
def form_factor(points: DataFrame, q: list[float], key: str = "neuron") -> DataFrame:
    """F(q) = 2 sum_{i<j} sin(q r)/(q r) / N^2 + 1/N over the distinct points of each neuron."""
    values = [float(v) for v in q]

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k, g in pdf.groupby(key, sort=False):
            xyz = np.unique(g[["x", "y", "z"]].to_numpy(float), axis=0)
            n, total = len(xyz), np.zeros(len(values))
            for i in range(0, n, 256):  # blocks of rows: memory stays bounded
                d = np.sqrt(((xyz[i : i + 256, None] - xyz[None, i:]) ** 2).sum(axis=2))
                rows, cols = np.triu_indices(d.shape[0], 1, d.shape[1])
                total += [np.sinc(v * d[rows, cols] / np.pi).sum() for v in values]
            out += [(k, v, 2 * s / n**2 + 1 / n) for v, s in zip(values, total)]
        return pd.DataFrame(out, columns=[key, "q", "form_factor"])

    return per_neuron(points, fn, f"{key} long, q double, form_factor double", key=key, order=("x", "y", "z"))
