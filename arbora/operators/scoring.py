"""Point-cloud similarity: nearest-neighbour joins, two-way lookup scores, candidate searches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import fresh


def digitize(col: Column, edges: list[float], right: bool = True) -> Column:
    """Bin number of a value: bins (lo, hi] (``right``) or [lo, hi); the outermost edges count as infinite."""
    inner = edges[1:-1]
    return sum(((col > float(e)) if right else (col >= float(e))).cast("int") for e in inner) if inner else F.lit(0)


def linear_edges(low: float, high: float, bins: int) -> list[float]:
    return [low + (high - low) * i / bins for i in range(bins + 1)]


def geometric_edges(low: float, high: float, bins: int) -> list[float]:
    """Edges in geometric progression, with 0 below the lowest."""
    return [0.0, *(low * (high / low) ** (i / (bins - 1)) for i in range(bins))]


def quantile_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    """Edges of bins of about equal counts; one pass of a bounded quantile sketch."""
    return df.approxQuantile(column, [i / bins for i in range(bins + 1)], 1e-4)


class Lookup:
    """A score for each pair of bins of distance and absolute dot product: a small literal table."""

    def __init__(self, dist_edges: list[float], dot_edges: list[float], cells: list[list[float]], right: bool = True):
        self.dist, self.dot, self.cells, self.right = dist_edges, dot_edges, cells, right

    @classmethod
    def from_csv(cls, path: str) -> Lookup:
        """Rows are distance bins, columns dot-product bins, labelled ``(lo,hi]`` or ``[lo,hi)``."""
        import csv

        with open(path) as f:
            rows = list(csv.reader(f))
        parse = lambda x: [float(v) for v in x.strip("()[] ").split(",")]
        cols, index = [parse(x) for x in rows[0][1:]], [parse(r[0]) for r in rows[1:]]
        return cls([index[0][0], *(b for _, b in index)], [cols[0][0], *(b for _, b in cols)], [[float(v) for v in r[1:]] for r in rows[1:]], rows[0][1].strip().endswith("]"))

    def array(self, dist: np.ndarray, dot: np.ndarray) -> np.ndarray:
        """The same on numpy arrays."""
        side = "left" if self.right else "right"
        i, j = (np.searchsorted(np.array(e[1:-1], float), x, side) for e, x in ((self.dist, dist), (self.dot, dot)))
        return np.array(self.cells, float)[i, j]

    def __call__(self, dist: Column, dot: Column) -> Column:
        """One array literal and an index: stays in generated code."""
        flat = F.array(*(F.lit(float(v)) for row in self.cells for v in row))
        width = len(self.cells[0])
        return F.get(flat, (digitize(dist, self.dist, self.right) * width + digitize(dot, self.dot, self.right)).cast("int"))


class Analytic:
    """Score sqrt(|dot| * exp(-d^2 / (2 sigma^2))), without a table."""

    def __init__(self, sigma: float):
        self.sigma = sigma

    @property
    def reach(self) -> float:
        """From this distance on the score is 0.0 in doubles: exp(-745.2) is."""
        return abs(self.sigma) * math.sqrt(2 * 750)

    def array(self, dist: np.ndarray, dot: np.ndarray) -> np.ndarray:
        return np.sqrt(dot * np.exp(-dist * dist / (2 * self.sigma * self.sigma)))

    def __call__(self, dist: Column, dot: Column) -> Column:
        return F.sqrt(dot * F.exp(-dist * dist / (2 * self.sigma * self.sigma)))


def analytic(sigma: float = 10.0) -> Analytic:
    return Analytic(sigma)


#: Points of a block of queries; tasks that share a block at most, and tasks in all at least; rows that a task holds before it gives them.
BLOCK_POINTS, SLICES, TASKS, HELD_ROWS = 1_000_000, 64, 256, 1_000_000


def _closest(at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The nearest column of ``to`` for each column of ``at`` (both 3 rows); ties: the first.

    |t|^2 - 2 q t is one product with a fourth coordinate; strips are so long that their product stays in the cache.
    """
    left, right = np.concatenate([at, np.ones((1, at.shape[1]))]).T, np.concatenate([-2 * to, (to * to).sum(axis=0)[None]])
    out, step = np.empty(len(left), np.int64), max(16, (1 << 17) // max(1, to.shape[1]))
    for i in range(0, len(left), step):
        (left[i : i + step] @ right).argmin(axis=1, out=out[i : i + step])
    return out


def _hits(at: np.ndarray, to: np.ndarray, alpha: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distance to the nearest point of ``to`` and absolute dot product with it, for each point of ``at``."""
    near = to[:, _closest(at[:3], to[:3])]
    dist = np.sqrt(((at[:3] - near[:3]) ** 2).sum(axis=0))
    dot = np.abs((at[3:6] * near[3:6]).sum(axis=0))
    return dist, dot * np.sqrt(at[6] * near[6]) if alpha else dot


def _hits_by_kind(at: dict, n: int, to: dict, alpha: bool) -> tuple[np.ndarray, np.ndarray]:
    """The same among points of one kind: kind -> (positions among the ``n`` points, points); what finds none of its kind is infinitely far."""
    dist, dot = np.full(n, np.inf), np.ones(n)
    for kind, (i, some) in at.items():
        if kind in to and kind is not None:
            dist[i], dot[i] = _hits(some, to[kind][1], alpha)
    return dist, dot


def _by_kind(x: np.ndarray, kinds: list) -> dict:
    own: dict = {}
    for i, kind in enumerate(kinds):
        own.setdefault(kind, []).append(i)
    return {kind: (np.array(i), x[:, i]) for kind, i in own.items()}


def _kinds_of_block(parts: list[dict], size: np.ndarray) -> dict:
    """The kinds of several objects' points that stand one after another."""
    own: dict = {}
    for part, start in zip(parts, size.cumsum() - size):
        for kind, (i, x) in part.items():
            own.setdefault(kind, []).append((i + start, x))
    return {kind: (np.concatenate([i for i, _ in some]), np.concatenate([x for _, x in some], axis=1)) for kind, some in own.items()}


def _meet(query: DataFrame, target: DataFrame, pairs: DataFrame | None, each, schema: str, reach: float | None = None, far=None, by: str | None = None) -> DataFrame:
    """Runs ``each(query ids, sizes, pids, target id, dist, dot, back)`` for a block of queries and a target at a time;
    ``back()`` gives dist and dot of each of the target's points and each query (queries x points).

    Queries form blocks of about ``BLOCK_POINTS`` points; a task holds one block and lets its share of the targets pass by,
    in strips of one matrix product. What moves is every target once for each block. A query never meets itself. With
    ``pairs`` queries without a target stay away, and a target goes only to blocks that ask for it, each with its own
    list of queries. Ties go to the smaller pid. ``reach``: queries whose box is that far or farther from the target's box are not
    compared; ``far(query ids, target id)`` gives their rows. ``by``: a column; points meet those that are equal in it only, others are infinitely far.
    """
    if pairs is not None:
        query = query.join(pairs.select(F.col("query").alias("neuron")).distinct(), "neuron", "left_semi")
    cols = ["x", "y", "z", "vx", "vy", "vz"]
    alpha = "alpha" in query.columns and "alpha" in target.columns
    cols += ["alpha"] if alpha else []
    held_ = [*cols, *([by] if by else [])]
    whole = lambda p: p.groupBy("neuron").agg(F.array_sort(F.collect_list(F.struct("pid", *held_))).alias("p")).select("neuron", F.col("p.pid").alias("pid"), *(F.col("p." + c).alias(c) for c in held_))
    n = max(1, -(-query.count() // BLOCK_POINTS))
    slices = min(SLICES, max(1, -(-TASKS // n)))  # each one has a copy of its block
    block = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(n)).cast("int").alias("block")
    q = whole(query).select(block("neuron"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), "neuron", F.lit(None).cast("array<bigint>").alias("asked"), "pid", *held_)
    t = whole(target)
    if pairs is None:
        t = t.withColumns({"asked": F.lit(None).cast("array<bigint>"), "block": F.explode(F.sequence(F.lit(0), F.lit(n - 1)))})
    else:
        t = t.join(pairs.groupBy(F.col("target").alias("neuron"), block("query")).agg(F.collect_set(F.col("query").cast("long")).alias("asked")), "neuron")
    t = t.select("block", F.pmod(F.xxhash64("neuron", F.lit(1)), F.lit(slices)).cast("int").alias("slice"), F.lit(1).alias("kind"), "neuron", "asked", "pid", *held_)

    def given(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=[c.split()[0] for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, parts, pids, kinds, whole_, box = None, [], [], [], [], None, None
        for b in (big.slice(i, 64) for big in batches for i in range(0, big.num_rows, 64)):
            out, held = [], 0
            for n_row, row in enumerate(b.select(["block", "slice", "kind", "neuron", "asked"]).to_pylist()):
                x = np.stack([b[c][n_row].values.to_numpy(zero_copy_only=False) for c in cols])
                if (row["block"], row["slice"]) != key:
                    key, ids, parts, pids, kinds, whole_, box = (row["block"], row["slice"]), [], [], [], [], None, None
                own_kinds = _by_kind(x, b[by][n_row].as_py()) if by else None
                if not row["kind"]:
                    ids.append(row["neuron"])
                    parts.append(x)
                    kinds.append(own_kinds)
                    pids.append(b["pid"][n_row].values.to_numpy())
                    continue
                asked = None if row["asked"] is None else set(row["asked"])
                own = [i for i, name in enumerate(ids) if name != row["neuron"] and (asked is None or name in asked)]
                if reach is not None and own:
                    if box is None:
                        box = np.array([p[:3].min(axis=1) for p in parts]), np.array([p[:3].max(axis=1) for p in parts])
                    gap = np.maximum(np.maximum(box[0] - x[:3].max(axis=1), x[:3].min(axis=1) - box[1]), 0)
                    apart = (gap * gap).sum(axis=1) >= reach * reach * (1 + 1e-9)
                    beyond = [ids[i] for i in own if apart[i]]
                    if beyond:
                        own = [i for i in own if not apart[i]]
                        out.append(far(np.array(beyond), row["neuron"]))
                        held += len(beyond)
                if not own:
                    continue
                if len(own) < len(ids) or whole_ is None:
                    some = np.concatenate([parts[i] for i in own], axis=1), np.array([parts[i].shape[1] for i in own]), np.concatenate([pids[i] for i in own]), np.array([ids[i] for i in own])
                    some = *some, _kinds_of_block([kinds[i] for i in own], some[1]) if by else None
                    whole_ = some if len(own) == len(ids) else whole_
                else:
                    some = whole_
                flat, size, flat_pids, names, flat_kinds = some
                if by:
                    dist, dot = _hits_by_kind(flat_kinds, flat.shape[1], own_kinds, alpha)
                    back = lambda x=x, own=own, k=own_kinds: [np.stack(c) for c in zip(*(_hits_by_kind(k, x.shape[1], kinds[i], alpha) for i in own))]
                else:
                    dist, dot = _hits(flat, x, alpha)
                    back = lambda x=x, own=own: [np.stack(c) for c in zip(*(_hits(x, parts[i], alpha) for i in own))]
                out.append(each(names, size, flat_pids, row["neuron"], dist, dot, back))
                held += len(out[-1][0])
                if held >= HELD_ROWS:
                    yield given(out)
                    out, held = [], 0
            if out:
                yield given(out)

    return q.unionByName(t).repartition("block", "slice").sortWithinPartitions("block", "slice", "kind", "neuron").mapInArrow(run, schema)


def raw_scores(query: DataFrame, target: DataFrame, score, max_dist: float | None = None, pairs: DataFrame | None = None, both: bool = False, normalized: bool = False, by: str | None = None) -> DataFrame:
    """(query, target, score): sums of the points' scores, of every query with every other target or of the given pairs.

    ``both``: also ``back``, the sum over the target's points against the query, from the same meeting. ``normalized``: over the score of
    the query (for ``back`` the target) with itself, which its number of points gives; no row of a pair is joined or moved.
    """
    one = float(score.array(np.zeros(1), np.ones(1))[0]) if normalized else 1.0

    def capped(dist, dot):
        return score.array(dist, dot) if max_dist is None else score.array(np.minimum(dist, max_dist), np.where(dist < max_dist, dot, 0.0))

    def each(ids, size, pids, target, dist, dot, back):
        raw = np.add.reduceat(capped(dist, dot), size.cumsum() - size)
        out = [raw / (size * one) if normalized else raw]
        if both:
            seen = capped(*back())
            out.append(seen.sum(axis=1) / (seen.shape[1] * one) if normalized else seen.sum(axis=1))
        return (ids, np.full(len(ids), target), *out)

    # from there on each point scores 0
    reach = getattr(score, "reach", None)
    if max_dist is not None and not capped(np.array([max_dist]), np.ones(1)).any():
        reach = max_dist if reach is None else min(reach, max_dist)
    far = lambda ids, target: (ids, np.full(len(ids), target), *(np.zeros(len(ids)) for _ in range(2 if both else 1)))
    return _meet(query, target, pairs, each, "query long, target long, score double" + (", back double" if both else ""), reach, far, **({"by": by} if by else {}))


def nearest_points(query: DataFrame, target: DataFrame, pairs: DataFrame | None, max_dist: float | None = None) -> DataFrame:
    """For each point of each pair's query the nearest point of its target: query, target, pid, dist, dot. ``pairs`` None: all but
    those of an id with itself.

    With ``max_dist`` points meet through a grid of that width only, and points without a partner within it count as
    at that distance with dot 0; without it blocks of queries meet one target at a time. Ties: smaller pid.
    """
    if max_dist is None:
        each = lambda ids, size, pids, target, dist, dot, back: (np.repeat(ids, size), np.full(len(pids), target), pids, dist, dot)
        return _meet(query, target, pairs, each, "query long, target long, pid long, dist double, dot double")
    if pairs is None:
        pairs = query.select(F.col("neuron").alias("query")).distinct().join(target.select(F.col("neuron").alias("target")).distinct(), F.col("query") != F.col("target"))
    has_alpha = "alpha" in query.columns and "alpha" in target.columns
    cols = ["vx", "vy", "vz", *(["alpha"] if has_alpha else [])]
    q = pairs.join(query.select(F.col("neuron").alias("query"), "pid", "x", "y", "z", *cols), "query")
    t = target.select(F.col("neuron").alias("target"), F.col("pid").alias("tpid"), *(F.col(c).alias(f"t{c}") for c in ("x", "y", "z", *cols)))
    d = F.sqrt(sum((F.col(c) - F.col(f"t{c}")) * (F.col(c) - F.col(f"t{c}")) for c in "xyz"))
    dot = F.abs(sum(F.col(f"v{c}") * F.col(f"tv{c}") for c in "xyz"))
    if has_alpha:
        dot = dot * F.sqrt(F.col("alpha") * F.col("talpha"))
    cell = lambda c: F.floor(F.col(c) / max_dist).cast("long")
    near = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    qq = q
    for c in "xyz":
        qq = qq.withColumn("o", F.explode(near)).withColumn(f"c{c}", cell(c) + F.col("o")).drop("o")
    met = qq.join(t.withColumns({f"c{c}": cell(f"t{c}") for c in "xyz"}), ["target", "cx", "cy", "cz"]).filter(d < max_dist)
    best = met.groupBy("query", "target", "pid").agg(F.min(F.struct(d.alias("dist"), "tpid", dot.alias("dot"))).alias("m"))
    best = best.select("query", "target", "pid", F.col("m.dist").alias("dist"), F.col("m.dot").alias("dot"))
    return q.select("query", "target", "pid").join(best, ["query", "target", "pid"], "left").select("query", "target", "pid", F.coalesce("dist", F.lit(float(max_dist))).alias("dist"), F.coalesce("dot", F.lit(0.0)).alias("dot"))


def score_pairs(query: DataFrame, target: DataFrame, pairs: DataFrame | None, score, normalized: bool = True, max_dist: float | None = None, both: bool = False, by: str | None = None) -> DataFrame:
    """Forward scores: the sum of each query point's score, over the score of the query with itself. ``pairs`` None: all.

    ``both``: also ``back``, the score of the target with the query, made in the same tasks.
    """
    self_hit = score(F.lit(0.0), F.lit(1.0))
    sized = lambda p, name, hit: p.groupBy(F.col("neuron").alias(name)).agg((F.count("*") * self_hit).alias(hit))
    size = sized(query, "query", "hit")
    hits = raw_scores(query, target, score, max_dist, pairs, both, normalized, by)
    if pairs is None:
        own = target.select(F.col("neuron").alias("query"), F.col("neuron").alias("target")).distinct().join(size, "query")
    else:
        own = pairs.filter("query = target").join(size, "query")
    kinds = [("hit", "score")]
    if both:
        kinds.append(("thit", "back"))
        own = own.join(sized(target, "target", "thit"), "target")
    return own.select("query", "target", *((F.lit(1.0) if normalized else F.col(h)).alias(n) for h, n in kinds)).unionByName(hits)


def combine(forward: DataFrame, reverse: DataFrame, scores: str = "mean") -> DataFrame:
    """Forward and reverse scores of each pair as one: forward, mean, min, max, or both side by side."""
    if scores == "forward":
        return forward
    back = reverse.select(F.col("target").alias("query"), F.col("query").alias("target"), F.col("score").alias("back"))
    return _as_one(forward.join(back, ["query", "target"]), scores)


def _as_one(t: DataFrame, scores: str) -> DataFrame:
    """Of score and back in one row."""
    if scores == "both":
        return t.select("query", "target", F.col("score").alias("forward"), F.col("back").alias("reverse"))
    f = {"mean": (F.col("score") + F.col("back")) / 2, "min": F.least("score", "back"), "max": F.greatest("score", "back")}[scores]
    return t.select("query", "target", f.alias("score"))


def nblast(query: DataFrame, target: DataFrame, score, scores: str = "forward", normalized: bool = True, max_dist: float | None = None, pairs: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """Scores (query, target, score) of all pairs, or of those given. A stated set of queries against all targets.

    ``by``: a column; a point looks for the nearest one that is equal in it, without one it is infinitely far.

    Both directions of a pair are made where it meets; given pairs are written once, as several steps read them.
    """
    if pairs is not None:
        path = fresh(query.sparkSession, "pairs")
        pairs.select("query", "target").write.parquet(path)
        pairs = query.sparkSession.read.parquet(path)
    t = score_pairs(query, target, pairs, score, normalized, max_dist, scores != "forward", by)
    return t if scores == "forward" else _as_one(t, scores)


def candidates(points: DataFrame, cell: float, n_candidates: int, queries: DataFrame | None = None) -> DataFrame:
    """Pairs (query, target) whose points share most grid cells: the ``n_candidates`` best targets of each query.

    Very full cells say little; a pair's count is weighted by the inverse of the cell's number of neurons.
    """
    cells = points.select("neuron", *(F.floor(F.col(c) / cell).alias(f"c{c}") for c in "xyz")).distinct()
    often = cells.groupBy("cx", "cy", "cz").agg(F.count("*").alias("n"))
    c = cells.join(often, ["cx", "cy", "cz"])
    a = c.select(F.col("neuron").alias("query"), "cx", "cy", "cz", "n")
    if queries is not None:
        a = a.join(queries.select(F.col("neuron").alias("query")).distinct(), "query", "left_semi")
    b = c.select(F.col("neuron").alias("target"), "cx", "cy", "cz")
    s = a.join(b, ["cx", "cy", "cz"]).filter("query <> target").groupBy("query", "target").agg(F.round(F.sum(1 / F.col("n")), 9).alias("s"))
    w = Window.partitionBy("query").orderBy(F.desc("s"), "target")
    return s.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n_candidates).select("query", "target")


def nblast_knn(points: DataFrame, score, k: int = 20, n_candidates: int = 200, cell: float = 100.0, scores: str = "mean", queries: DataFrame | None = None, **options) -> DataFrame:
    """The k best partners of each neuron (or of ``queries``) among its candidates, itself left out."""
    s = nblast(points, points, score, scores, pairs=candidates(points, cell, n_candidates, queries), **options)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "target")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nblast_smart(query: DataFrame, target: DataFrame, score, t: float = 90, criterion: str = "percentile", every: int = 10, **options) -> DataFrame:
    """A first pass with every tenth point picks the pairs that are worth a full score: those at or above the t-th
    percentile of their query, above a score, or the best t."""
    thin = lambda p: p.withColumn("__r", F.row_number().over(Window.partitionBy("neuron").orderBy("pid"))).filter((F.col("__r") - 1) % every == 0).drop("__r")
    first = nblast(thin(query), thin(target), score, **options)
    w = Window.partitionBy("query")
    if criterion == "percentile":
        keep = first.withColumn("cut", F.expr(f"percentile(score, {t / 100})").over(w)).filter("score >= cut")
    elif criterion == "score":
        keep = first.filter(F.col("score") >= t)
    else:
        keep = first.withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), "target"))).filter(F.col("r") <= t)
    return nblast(query, target, score, pairs=keep.select("query", "target"), **options)


def synblast(query: DataFrame, target: DataFrame, score, by_type: bool = False, **options) -> DataFrame:
    """The same on synapses (neuron, pid, type, x, y, z): directions do not count; by type, a type that the target lacks is
    infinitely far."""
    flat = lambda p: p.withColumns({"vx": F.lit(1.0), "vy": F.lit(0.0), "vz": F.lit(0.0)})
    return nblast(flat(query), flat(target), score, by="type" if by_type else None, **options)


def build_lookup(matching: DataFrame, random: DataFrame, dist_edges: list[float], dot_edges: list[float], epsilon: float = 1e-6) -> Lookup:
    """Log2 odds of matching over random counts per bin, from two tables of (dist, dot)."""
    width = len(dot_edges) - 1
    cell = lambda: (digitize(F.col("dist"), dist_edges) * width + digitize(F.col("dot"), dot_edges)).alias("cell")
    counts = matching.select(cell(), F.lit(1).alias("m"), F.lit(0).alias("r")).unionByName(random.select(cell(), F.lit(0).alias("m"), F.lit(1).alias("r")))
    return _odds(counts, dist_edges, dot_edges, epsilon)


def build_lookup_of_pairs(query: DataFrame, target: DataFrame, is_match, dist_edges: list[float], dot_edges: list[float], epsilon: float = 1e-6, pairs: DataFrame | None = None) -> Lookup:
    """The same from the nearest points of all pairs (or of those given), counted where they meet: no row for each point.

    ``is_match(query ids, target id)``: numpy booleans, whether a pair is matching or random.
    """
    cells, width = (len(dist_edges) - 1) * (len(dot_edges) - 1), len(dot_edges) - 1

    def each(ids, size, pids, target, dist, dot, back):
        i, j = (np.searchsorted(np.array(e[1:-1], float), x, "left") for e, x in ((dist_edges, dist), (dot_edges, dot)))
        match = np.repeat(np.asarray(is_match(ids, target), bool), size)
        n = np.bincount((i * width + j) * 2 + match, minlength=2 * cells).reshape(-1, 2)
        own = np.flatnonzero(n.any(axis=1))
        return own, n[own, 1], n[own, 0]

    return _odds(_meet(query, target, pairs, each, "cell long, m long, r long"), dist_edges, dot_edges, epsilon)


def _odds(counts: DataFrame, dist_edges: list[float], dot_edges: list[float], epsilon: float) -> Lookup:
    width = len(dot_edges) - 1
    rows = counts.groupBy("cell").agg(F.sum("m").alias("m"), F.sum("r").alias("r")).collect()  # at most one row a cell
    m, r = [0] * ((len(dist_edges) - 1) * width), [0] * ((len(dist_edges) - 1) * width)
    for x in rows:
        m[x["cell"]], r[x["cell"]] = x["m"], x["r"]
    sm, sr = max(1, sum(m)), max(1, sum(r))
    flat = [math.log2((a / sm + epsilon) / (b / sr + epsilon)) for a, b in zip(m, r)]
    return Lookup(dist_edges, dot_edges, [flat[i * width : (i + 1) * width] for i in range(len(dist_edges) - 1)])


def to_distance(scores: DataFrame) -> DataFrame:
    """The highest score of all minus each score."""
    top = scores.agg(F.max("score").alias("__top"))
    return scores.join(F.broadcast(top)).select(*[c for c in scores.columns if c != "score"], (F.col("__top") - F.col("score")).alias("score"))  # one row


def update_scores(scores: DataFrame, queries: DataFrame, targets: DataFrame, score_pairs_fn) -> DataFrame:
    """Adds the scores of pairs that are not there yet."""
    pairs = queries.select(F.col("neuron").alias("query")).distinct().join(targets.select(F.col("neuron").alias("target")).distinct(), F.lit(True))
    return scores.unionByName(score_pairs_fn(pairs.join(scores, ["query", "target"], "left_anti")))


def compress_scores(scores: DataFrame, threshold: float | None = None, digits: int | None = None) -> DataFrame:
    """Scores as floats, rounded, and not below a threshold."""
    s = F.col("score")
    if threshold is not None:
        s = F.greatest(s, F.lit(float(threshold)))
    if digits is not None:
        s = F.round(s, digits)
    return scores.withColumn("score", s.cast("float"))


from .clustering import clusters  # noqa: E402, F401
