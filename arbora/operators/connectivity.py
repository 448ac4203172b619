"""Synaptic connectivity: edges, adjacency, grouping, sparseness, similarity, traversal models, matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import durable, per_neuron
from .clustering import components
from .geometry import ranges

OTHER = "__OTHER__"


def synapse_edges(connectors: DataFrame, include_other: bool = True) -> DataFrame:
    """One row per pre/post pair of each connector id; a side that is missing is ``__OTHER__``."""
    pre = connectors.filter("type = 'pre'").select("connector_id", F.col("neuron").cast("string").alias("source"), F.col("node_id").alias("source_node"))
    post = connectors.filter("type = 'post'").select("connector_id", F.col("neuron").cast("string").alias("target"), F.col("node_id").alias("target_node"))
    e = pre.join(post, "connector_id", "full_outer" if include_other else "inner")
    return e.select("connector_id", F.coalesce("source", F.lit(OTHER)).alias("source"), F.coalesce("target", F.lit(OTHER)).alias("target"), "source_node", "target_node")


def adjacency(connectors: DataFrame, include_other: bool = True) -> DataFrame:
    """Numbers of edges (source, target, weight).

    Counted by multiplying the sides' counts of each connector, so a connector with many partners makes no row per pair
    of its synapses but one per pair of neurons.
    """
    side = lambda t, n: connectors.filter(F.col("type") == t).groupBy("connector_id", F.col("neuron").cast("string").alias(n)).agg(F.count("*").alias(f"n_{n}"))
    e = side("pre", "source").join(side("post", "target"), "connector_id", "full_outer" if include_other else "inner")
    weight = F.coalesce("n_source", F.lit(1)) * F.coalesce("n_target", F.lit(1))
    return e.groupBy(F.coalesce("source", F.lit(OTHER)).alias("source"), F.coalesce("target", F.lit(OTHER)).alias("target")).agg(F.sum(weight).alias("weight"))


def group_matrix(edges: DataFrame, row_groups: DataFrame | None = None, col_groups: DataFrame | None = None, method: str = "SUM", drop_ungrouped: bool = False) -> DataFrame:
    """Edges with sources and targets replaced by their groups (id, group); ids without one keep their own name."""
    e = edges.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), "weight")
    for side, groups in (("source", row_groups), ("target", col_groups)):
        if groups is not None:
            g = groups.select(F.col("id").cast("string").alias(side), F.col("group").cast("string").alias("__g"))
            e = e.join(g, side, "inner" if drop_ungrouped else "left").withColumn(side, F.coalesce("__g", side)).drop("__g")
    agg = {"SUM": F.sum, "AVERAGE": F.avg, "MIN": F.min, "MAX": F.max}[method]
    return e.groupBy("source", "target").agg(agg("weight").alias("weight"))


def connectivity_sparseness(edges: DataFrame, which: str = "LTS", by: str = "target", dense: bool = True) -> DataFrame:
    """Lifetime sparseness (LTS), kurtosis (LTK) or activity ratio of each column of weights.

    ``dense``: an edge that is not there weighs 0, so every column has as many values as there are ids on the other side
    (they are counted first); otherwise it is missing and left out.
    """
    w, other = F.col("weight").cast("double"), "source" if by == "target" else "target"
    n = F.lit(edges.select(other).distinct().count()).cast("double") if dense else F.count("weight").cast("double")
    m = edges.groupBy(by).agg(n.alias("n"), *(F.sum(F.pow(w, i)).alias(f"s{i}") for i in range(1, 5)))
    m1, m2, m3, m4 = (F.col(f"s{i}") / F.col("n") for i in range(1, 5))
    if which == "LTS":
        return m.filter("n > 1").select(by, ((1 - m1 * m1 / m2) / (1 - 1 / F.col("n"))).alias("sparseness"))
    if which == "activity_ratio":
        return m.select(by, (1 - m1 * m1 / m2).alias("sparseness"))
    spread = m2 - m1 * m1
    return m.filter(spread > 1e-12 * m2).select(by, ((m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * F.pow(m1, 4)) / (spread * spread) - 3).alias("sparseness"))


def _pairs(sources: DataFrame, queries: DataFrame | None) -> DataFrame:
    """All pairs (a, b): each of ``queries`` (a column a) with every other source, or each two sources once (a < b).

    The result of a similarity is dense, so its size is the number of queries times the number of sources.
    """
    b = sources.select(F.col("source").alias("b"))
    if queries is None:
        return b.join(sources.select(F.col("source").alias("a")), F.col("a") < F.col("b")).select("a", "b")
    return b.join(queries.select("a").distinct(), F.col("a") != F.col("b")).select("a", "b")


def connectivity_similarity(adjacency: DataFrame, metric: str = "vertex_normalized", c1: float = 0.5, c2: float = 1.0, queries: DataFrame | None = None, threshold: float = 0.0) -> DataFrame:
    """Similarity of pairs (a, b) of sources by their weights to the same targets, pairs that share none included.

    Pairs meet on targets they share; what only one of them has comes from per-source sums. ``queries`` as for ``_pairs``; weights under ``threshold`` count as 0. Sources without any weight are in no pair.
    """
    e = adjacency.groupBy("source", "target").agg(F.sum("weight").cast("double").alias("w")).filter((F.col("w") > 0) & (F.col("w") >= threshold))
    if metric == "rank_index":
        return rank_index(e.withColumnRenamed("w", "weight"), queries)
    return _meeting(e, metric, c1, c2, queries)


#: Weights and queries of a block; tasks that share a block at most, and tasks in all at least; sources that a block meets at a time.
BLOCK_WEIGHTS, BLOCK_QUERIES, SLICES, TASKS, AT_ONCE = 2_000_000, 4096, 64, 256, 64


def _meeting(e: DataFrame, metric: str, c1: float, c2: float, queries: DataFrame | None) -> DataFrame:
    """The similarities of ``connectivity_similarity``, made where a block of queries meets a source: no row of a pair is moved.

    A task holds one block of queries, about ``BLOCK_WEIGHTS`` weights and ``BLOCK_QUERIES`` ids, and lets its share of the sources pass by. What moves is every
    source once for each block and every query once for each slice. The rows given are all pairs, which no task holds.
    """
    e = e.filter("source IS NOT NULL")
    q = e if queries is None else e.join(queries.select(F.col("a").alias("source")).distinct(), "source", "left_semi")
    size = q.agg(F.count("*"), F.countDistinct("source")).first()
    n = max(1, -(-size[0] // BLOCK_WEIGHTS), -(-size[1] // BLOCK_QUERIES))
    slices = min(SLICES, max(1, -(-TASKS // n)))
    whole = lambda t: t.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("target", "w"))).alias("p")).select("source", F.col("p.target").alias("target"), F.col("p.w").alias("w"))
    block = F.pmod(F.xxhash64("source"), F.lit(n)).cast("int").alias("block")
    held = whole(q).select(block, F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), "source", "target", "w")
    pass_ = whole(e).select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), F.pmod(F.xxhash64("source", F.lit(1)), F.lit(slices)).cast("int").alias("slice"), F.lit(1).alias("kind"), "source", "target", "w")
    ids, once = dict(e.dtypes)["source"], queries is None
    top = lambda w: w - c1 * w * np.exp(-c2 * w)  # noqa: E731  the highest value that a weight can give

    def sides(rows: list) -> tuple:
        """Sources, and of all their weights: the source's number, target, weight; then sums by source. A null target is shared with none."""
        own, w = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows]), np.concatenate([r[2] for r in rows])
        add = lambda v: np.bincount(own, v, len(rows))
        sums = {"s": add(w), "n": add(None).astype(float), "q": add(w * w), "top": add(top(w))}
        known = np.concatenate([r[1].is_valid().to_numpy(zero_copy_only=False) for r in rows])
        return np.array([r[0] for r in rows]), own[known], np.concatenate([r[1].drop_null().to_numpy(zero_copy_only=False) for r in rows]), w[known], sums

    def meet(a: tuple, b: tuple) -> pa.RecordBatch:
        (na, oa, ta, wa, all_a), (nb, ob, tb, wb, all_b) = a, b
        lo, hi = np.searchsorted(ta, tb, "left"), np.searchsorted(ta, tb, "right")
        at, of = ranges(lo, hi - lo), np.repeat(np.arange(len(tb)), hi - lo)
        cell, x, y = ob[of] * len(na) + oa[at], wa[at], wb[of]
        add = lambda v: np.bincount(cell, v, len(na) * len(nb)).reshape(len(nb), len(na))
        A, B = {k: v[None] for k, v in all_a.items()}, {k: v[:, None] for k, v in all_b.items()}
        if metric == "matching_index":
            m = add(None)
            value = m / (A["n"] + B["n"] - m)
        elif metric == "matching_index_synapses":
            value = (add(x) + add(y)) / (A["s"] + B["s"])
        elif metric == "matching_index_weighted_synapses":
            value = (add(x) / A["s"]) * (add(y) / B["s"])
        elif metric == "cosine":
            value = add(x * y) / np.sqrt(A["q"] * B["q"])
        elif metric in ("vertex", "vertex_normalized"):
            less, more = np.minimum(x, y), np.maximum(x, y)
            # targets of one of them alone: the smaller weight is 0, so the value is -c1 times the weight
            alone = A["s"] + B["s"] - add(x) - add(y)
            value = add(less - c1 * more * np.exp(-c2 * less)) - c1 * alone
            if metric == "vertex_normalized":
                lowest = -c1 * (alone + add(more))
                highest = A["top"] + B["top"] + add(top(more) - top(x) - top(y))
                value = np.divide(value - lowest, highest - lowest, out=np.zeros_like(value), where=highest > lowest)
        else:
            raise KeyError(metric)
        j, i = np.nonzero(na[None] < nb[:, None] if once else na[None] != nb[:, None])
        return pa.RecordBatch.from_arrays([pa.array(na, kind).take(pa.array(i)), pa.array(nb, kind).take(pa.array(j)), pa.array(value[j, i])], names=["a", "b", "similarity"])

    kind = pa.string() if ids == "string" else {"int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(ids, pa.int64())

    def run(batches):
        key, rows, block_, some = None, [], None, []
        for b in (big.slice(i, 64) for big in batches for i in range(0, big.num_rows, 64)):
            for n_row, r in enumerate(b.select(["block", "slice", "kind", "source"]).to_pylist()):
                if (r["block"], r["slice"]) != key:
                    if some and block_ is not None:
                        yield meet(block_, sides(some))
                    key, rows, block_, some = (r["block"], r["slice"]), [], None, []
                own = r["source"], b["target"][n_row].values, b["w"][n_row].values.to_numpy(zero_copy_only=False)
                if not r["kind"]:
                    rows.append(own)
                    continue
                if block_ is None and rows:
                    names, o, t, w, sums = sides(rows)
                    by = np.argsort(t, kind="stable")
                    block_ = names, o[by], t[by], w[by], sums
                some.append(own)
                if len(some) >= AT_ONCE:
                    if block_ is not None:
                        yield meet(block_, sides(some))
                    some = []
        if some and block_ is not None:
            yield meet(block_, sides(some))

    return held.unionByName(pass_).repartition("block", "slice").sortWithinPartitions("block", "slice", "kind", "source").mapInArrow(run, f"a {ids}, b {ids}, similarity double")


def rank_index(adjacency: DataFrame, queries: DataFrame | None = None, normalize: bool = True) -> DataFrame:
    """1 - the distance of two sources' ranks of all targets over the largest that there can be.

    Ranks are of whole vectors, zeros included, ties share their mean rank. Not normalised: 1 / distance (1 at 0).
    """
    e = adjacency.groupBy("source", "target").agg(F.sum("weight").cast("double").alias("w")).filter("w > 0")
    n = e.select("target").distinct().count()
    by = Window.partitionBy("source")
    e = e.withColumn("zeros", n - F.count("*").over(by))
    below, level = F.rank().over(by.orderBy("w")) - 1, F.count("*").over(Window.partitionBy("source", "w"))
    r = e.select("source", "target", (F.col("zeros") + below + (level + 1) / 2).alias("r"))
    zero = e.groupBy("source").agg(((F.first("zeros") + 1) / 2).alias("z"))
    pairs = _pairs(zero, queries)
    ra, rb = (pairs.join(r.select(F.col("source").alias(k), "target", F.col("r").alias(f"r{k}")), k) for k in "ab")
    both = ra.unionByName(rb, allowMissingColumns=True).groupBy("a", "b", "target").agg(F.max("ra").alias("ra"), F.max("rb").alias("rb"))
    for k in "ab":
        both = both.join(zero.select(F.col("source").alias(k), F.col("z").alias(f"z{k}")), k)
    d = both.groupBy("a", "b").agg((F.sum(F.abs(F.coalesce("ra", "za") - F.coalesce("rb", "zb"))) + (n - F.count("*")) * F.abs(F.first("za") - F.first("zb"))).alias("d"))
    sim = 1 - F.col("d") / F.lit(max(1, n * n // 2)) if normalize else F.when(F.col("d") > 0, 1 / F.col("d")).otherwise(1.0)
    return d.select("a", "b", sim.alias("similarity"))


# --- spatial -------------------------------------------------------------------------------------------------------
def nearest(query: DataFrame, target: DataFrame, by: list[str], qid: str, tid: str, max_dist: float) -> DataFrame:
    """For each query point the nearest target point closer than ``max_dist`` with equal ``by`` columns.

    A grid of that width: targets go to their cell, queries to the 27 around, so only near points meet. Ties: smaller id.
    """
    cell = lambda c: F.floor(F.col(c) / max_dist).cast("long")
    t = target.select(*by, F.col(tid).alias("tid"), *(F.col(c).alias(f"t{c}") for c in "xyz"), *(cell(c).alias(f"c{c}") for c in "xyz"))
    near = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    q = query.select(*by, F.col(qid).alias("qid"), "x", "y", "z")
    for c in "xyz":
        q = q.withColumn("o", F.explode(near)).withColumn(f"c{c}", cell(c) + F.col("o")).drop("o")
    d = F.sqrt(sum((F.col(c) - F.col(f"t{c}")) * (F.col(c) - F.col(f"t{c}")) for c in "xyz"))
    return q.join(t, [*by, "cx", "cy", "cz"]).withColumn("dist", d).filter(F.col("dist") < max_dist).groupBy(*by, "qid").agg(F.min(F.struct("dist", "tid")).alias("m")).select(*by, "qid", F.col("m.tid").alias("tid"), F.col("m.dist").alias("dist"))


def cable_overlap(points: DataFrame, pairs: DataFrame, max_dist: float) -> DataFrame:
    """Cable of a's edges that are nearest to a midpoint of b within ``max_dist``, with repeats, per pair (a, b).

    ``points``: edge midpoints with their length (neuron, pid, x, y, z, length). A pair's points meet in one task, sorted
    along x, so that only points within ``max_dist`` along it are compared; ties: smaller pid.
    """
    pairs = pairs.select("a", "b").distinct().withColumn("pair", F.concat_ws(":", "a", "b"))
    side = lambda c, kind: pairs.join(points.select(F.col("neuron").alias(c), "pid", "x", "y", "z", "length"), c).select("pair", "a", "b", F.lit(kind).alias("kind"), "pid", "x", "y", "z", "length")

    def one(g: pd.DataFrame) -> float | None:
        xyz, kind, pid = g[["x", "y", "z"]].to_numpy(float), g["kind"].to_numpy(), g["pid"].to_numpy()
        order = np.argsort(xyz[:, 0], kind="stable")
        order = order[~np.isnan(xyz[order, 0])]
        q, t = (order[kind[order] == k] for k in (1, 0))
        hit = []
        for i in range(0, len(q), 256):
            own = xyz[q[i : i + 256]]
            some = t[np.searchsorted(xyz[t, 0], own[:, 0].min() - max_dist) : np.searchsorted(xyz[t, 0], own[:, 0].max() + max_dist, "right")]
            step = max(1, (1 << 20) // max(1, len(some)))
            for j in range(0, len(own), step):
                d = np.sqrt(sum((own[j : j + step, c, None] - xyz[None, some, c]) ** 2 for c in range(3)))
                d = np.where(d < max_dist, d, np.inf)
                best = d.min(axis=1, initial=np.inf)
                near = np.flatnonzero(best < np.inf)
                if len(near):
                    hit.append(some[np.where(d[near] == best[near, None], pid[some], np.iinfo(np.int64).max).argmin(axis=1)])
        return float(g["length"].to_numpy()[np.concatenate(hit)].sum()) if hit else None

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(g["a"].iloc[0], g["b"].iloc[0], one(g)) for _, g in pdf.groupby("pair", sort=False)]
        return pd.DataFrame([r for r in rows if r[2] is not None], columns=["a", "b", "overlap"])

    return per_neuron(side("a", 0).unionByName(side("b", 1)), fn, "a long, b long, overlap double", key="pair", order=("kind", "pid"), union=True)


def synapse_similarity(connectors: DataFrame, pairs: DataFrame, sigma: float, omega: float) -> DataFrame:
    """Mean over a's synapses of exp(-|nA-nB|/(nA+nB)) * exp(-d^2/2 sigma^2) to b's nearest synapse of the same type.

    nA, nB: synapses of the type within ``omega`` of the synapse and of its partner. A type that b lacks scores 0.
    """
    c = connectors.withColumn("sid", F.xxhash64("neuron", "connector_id", "node_id", "type")) if "sid" not in connectors.columns else connectors
    a = c.select(F.col("neuron"), "type", "sid", "x", "y", "z")
    b = c.select(F.col("neuron"), "type", F.col("sid").alias("tid"), *(F.col(k).alias(f"t{k}") for k in "xyz"))
    d = F.sqrt(sum((F.col(k) - F.col(f"t{k}")) * (F.col(k) - F.col(f"t{k}")) for k in "xyz"))
    n = a.join(b, ["neuron", "type"]).filter(d <= omega).groupBy("sid").agg(F.count("*").alias("n"))
    q = pairs.join(a.withColumnRenamed("neuron", "a"), "a")
    near = q.join(b.withColumnRenamed("neuron", "b"), ["b", "type"]).groupBy("a", "b", "sid").agg(F.min(F.struct(d.alias("d"), "tid")).alias("m"))
    s = near.select("a", "b", "sid", F.col("m.d").alias("d"), F.col("m.tid").alias("tid")).join(n, "sid").join(n.select(F.col("sid").alias("tid"), F.col("n").alias("nb")), "tid")
    s = s.withColumn("s", F.exp(-F.abs(F.col("n") - F.col("nb")) / (F.col("n") + F.col("nb"))) * F.exp(-F.col("d") * F.col("d") / (2 * sigma * sigma)))
    total = q.groupBy("a", "b").agg(F.count("*").alias("all"))
    return total.join(s.groupBy("a", "b").agg(F.sum("s").alias("s")), ["a", "b"], "left").select("a", "b", (F.coalesce("s", F.lit(0.0)) / F.col("all")).alias("similarity"))


# --- matching ------------------------------------------------------------------------------------------------------
def top_n(scores: DataFrame, n: int, distances: bool = False) -> DataFrame:
    """The n best targets of each query (ties: smaller target), with their rank."""
    w = Window.partitionBy("query").orderBy(F.col("score") if distances else F.desc("score"), "target")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def matches_above(scores: DataFrame, threshold: float, distances: bool = False) -> DataFrame:
    """Targets at least (distances: at most) at the threshold."""
    return scores.filter(F.col("score") <= threshold if distances else F.col("score") >= threshold)


def matches_within(scores: DataFrame, percentage: float, distances: bool = False) -> DataFrame:
    """Per query the targets within a share of the best score, as text: ids, and scores to three places, best first."""
    w = Window.partitionBy("query")
    if distances:
        best = F.min("score").over(w)
        keep = F.col("score") <= best + F.abs(best * percentage)
    else:
        best = F.max("score").over(w)
        keep = F.col("score") >= best - F.abs(best * percentage)
    t = scores.withColumn("__keep", keep).filter("__keep")
    order = F.col("score") if distances else -F.col("score")
    items = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("target").alias("t"), F.col("score").alias("s"))))
    t = t.groupBy("query").agg(items.alias("m"))
    return t.select("query", F.array_join(F.transform("m", lambda x: x["t"].cast("string")), ",").alias("matches"), F.array_join(F.transform("m", lambda x: F.format_string("%.3f", x["s"])), ",").alias("scores"))


def mutual_best(scores: DataFrame) -> DataFrame:
    """Pairs that are each other's best: a one-to-one matching without a solver."""
    a = scores.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "target"))).filter("r = 1")
    b = scores.withColumn("r", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score"), "query"))).filter("r = 1")
    return a.drop("r").join(b.select("query", "target"), ["query", "target"])


def assignment(score: np.ndarray) -> np.ndarray:
    """Column of each row in the one-to-one assignment of the highest total score (rows <= columns), by the Hungarian
    method with potentials."""
    cost = -np.asarray(score, float)
    n, m = cost.shape
    if n > m:
        back = assignment(score.T)
        out = np.full(n, -1)
        out[back] = np.arange(m)
        return out
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = ~used[1:]
            now = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (now < least[1:])
            least[1:][better], way[1:][better] = now[better], j0
            j1 = int(np.where(free, least[1:], np.inf).argmin()) + 1
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = np.full(n, -1)
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def bipartite_match(scores: DataFrame, threshold: float | None = None, group: str | None = None) -> DataFrame:
    """One-to-one matches of the highest total score, within each ``group`` of pairs or over all.

    Pairs under the threshold never match. Pairs that share no query and no target, even by way of others, do not bear on
    each other: each connected part of the pairs is a problem of its own, and a task holds one part's score matrix at a time.
    """
    keys = [group] if group else []
    if threshold is not None:
        scores = scores.filter(F.col("score") >= threshold)
    side = lambda c: F.to_json(F.struct(*(F.col(k).alias("g") for k in keys), F.col(c).alias(c[0])))
    pairs = scores.select("query", "target", "score", side("query").alias("a"), side("target").alias("b"))
    pairs = pairs.join(components(pairs).withColumnRenamed("node", "a"), "a").select("label", "query", "target", "score")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, t = np.unique(pdf["query"]), np.unique(pdf["target"])
        m = np.full((len(q), len(t)), -1e10)
        m[np.searchsorted(q, pdf["query"]), np.searchsorted(t, pdf["target"])] = pdf["score"]
        col = assignment(m)
        rows = np.flatnonzero(col >= 0)
        rows = rows[m[rows, col[rows]] > -1e9]
        return pd.DataFrame({"query": q[rows], "target": t[col[rows]], "score": m[rows, col[rows]]})

    return pairs.groupBy("label").applyInPandas(run, "query long, target long, score double")


# --- models --------------------------------------------------------------------------------------------------------
def activation(weight: Column, min_w: float = 0.0, max_w: float = 0.3) -> Column:
    """Probability that grows from 0 to 1 between two weights."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (weight - min_w) / (max_w - min_w)))


def traverse(edges: DataFrame, seeds: DataFrame, max_steps: int = 15, iterations: int = 1, min_w: float = 0.0, max_w: float = 0.3, seed: int | None = None) -> DataFrame:
    """Step at which each node is first reached, per iteration: seeds at 1; at every step each edge from a reached node to
    one that is not fires with the probability of its weight.

    The dice are a hash of iteration, edge, step and ``seed``, so a step that is computed again gives the same. With
    ``seed`` None only edges of probability 1 fire. Each step's result is checkpointed.
    """
    e = edges.select("source", "target", activation(F.col("weight").cast("double"), min_w, max_w).alias("p")).filter("p > 0" if seed is not None else "p >= 1")
    run = edges.sparkSession.range(iterations).select(F.col("id").alias("iteration"))
    reached = durable(seeds.select("node").distinct().join(run, F.lit(True)).select("iteration", "node", F.lit(1).alias("step")))
    n = reached.count()
    for step in range(2, max_steps + 1):
        open_ = reached.join(e, F.col("node") == F.col("source")).select("iteration", "source", "target", "p").join(reached.select("iteration", F.col("node").alias("target")), ["iteration", "target"], "left_anti")
        dice = F.pmod(F.xxhash64("iteration", "source", "target", F.lit(step), F.lit(seed or 0)), F.lit(1 << 53)) / float(1 << 53)
        new = (open_.filter(dice < F.col("p")) if seed is not None else open_).select("iteration", F.col("target").alias("node")).distinct().withColumn("step", F.lit(step))
        reached = durable(reached.unionByName(new))
        before, n = n, reached.count()
        if n == before and seed is None:
            break
    return reached


def traversal_summary(reached: DataFrame) -> DataFrame:
    """First, last, mean and median step of each node over the iterations."""
    return reached.groupBy("node").agg(F.min("step").alias("layer_min"), F.max("step").alias("layer_max"), F.avg("step").alias("layer_mean"), F.median("step").alias("layer_median"))


def bayesian_traverse(edges: DataFrame, seeds: DataFrame, max_steps: int = 5, min_w: float = 0.0, max_w: float = 0.3) -> DataFrame:
    """Probability ``cmf`` that each node has been reached by each step (node, step, cmf).

    An edge whose source is first reached at step k fires at each later step, so by step t it has fired with probability
    1 - (1 - p)^(t - k); that is summed over the source's first steps, and a target is missed if all its edges miss it.
    """
    e = edges.select("source", "target", activation(F.col("weight").cast("double"), min_w, max_w).alias("p")).filter("p > 0")
    seeds = seeds.select("node").distinct()
    nodes = e.select(F.col("source").alias("node")).union(e.select(F.col("target").alias("node"))).union(seeds).distinct()
    state = durable(nodes.join(seeds.withColumn("one", F.lit(1.0)), "node", "left").select("node", F.array(F.coalesce("one", F.lit(0.0))).alias("cmf")))
    for t in range(1, max_steps):  # state has steps 1 to t
        first = F.transform(F.sequence(F.lit(1), F.lit(t)), lambda k: (F.element_at("cmf", k) - F.when(k > 1, F.element_at("cmf", F.greatest(k - 1, F.lit(1)))).otherwise(0.0)) * (1 - F.pow(1 - F.col("p"), F.lit(t + 1) - k)))
        fired = state.join(e, F.col("node") == F.col("source")).select(F.col("target").alias("node"), F.aggregate(first, F.lit(0.0), lambda x, y: x + y).alias("d"))
        got = fired.groupBy("node").agg((1 - F.product(1 - F.least(F.col("d"), F.lit(1.0)))).alias("got"))
        state = durable(state.join(got, "node", "left").select("node", F.concat("cmf", F.array(F.greatest(F.element_at("cmf", -1), F.coalesce("got", F.lit(0.0))))).alias("cmf")))
    return state.select("node", F.posexplode("cmf").alias("step", "cmf")).withColumn("step", F.col("step") + 1)


def bayesian_summary(reached: DataFrame) -> DataFrame:
    """First and last step with a chance, mean and median step of each node that may be reached, of (node, step, cmf)."""
    by = Window.partitionBy("node").orderBy("step")
    p = reached.withColumn("p", F.col("cmf") - F.coalesce(F.lag("cmf").over(by), F.lit(0.0)))
    total = F.max("cmf")
    return p.groupBy("node").agg(F.min(F.when(F.col("cmf") > 0, F.col("step"))).alias("layer_min"), F.max(F.when(F.col("p") > 0, F.col("step"))).alias("layer_max"),
        (F.sum(F.col("p") * F.col("step")) / total).alias("layer_mean"), F.min(F.when(F.col("cmf") >= 0.5, F.col("step"))).alias("layer_median")).filter("layer_min IS NOT NULL")
