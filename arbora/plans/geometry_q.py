"""Queries: similarity scores, coordinates, voxels, meshes, samples."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import scoring as S
from ..operators import grids as R
from ..operators import space as G
from . import fixtures as X
from .oracle import sql
from .registry import query, rounded

_D = "sqrt((q.x-t.x)*(q.x-t.x)+(q.y-t.y)*(q.y-t.y)+(q.z-t.z)*(q.z-t.z))"
_DOT = "abs(q.vx*t.vx+q.vy*t.vy+q.vz*t.vz)"
#: Neurons divisible by 20 are the queries; targets are all neurons, with all their points.
_PTS = "SELECT * FROM points"
_NN = f"""SELECT q.neuron AS query, t.neuron AS target, q.pid, min({_D}) AS dist, min_by({_DOT}, ({_D}, t.pid)) AS dot FROM p q JOIN p t ON q.neuron <> t.neuron AND (q.neuron % 20 = 0 OR t.neuron % 20 = 0) GROUP BY 1, 2, 3"""
_NNC = """SELECT query, target, pid, CASE WHEN dist < 200 THEN dist ELSE 200 END AS dist, CASE WHEN dist < 200 THEN dot ELSE 0 END AS dot FROM nn"""


def _points(s, d):
    return X.points(s, d)


def _asked(df):
    return df.filter("neuron % 20 = 0")


def _nblast_sql(body, nn="nn", score="sqrt(dot * exp(-dist * dist / (2 * 100.0 * 100.0)))"):
    return sql(body, "points", p=_PTS, nn=_NN, nnc=_NNC, hit="SELECT neuron AS query, count(*) AS n FROM p GROUP BY 1",
        f=f"SELECT n.query, n.target, sum({score}) / max(h.n) AS score FROM {nn} n JOIN hit h ON h.query = n.query GROUP BY 1, 2 UNION ALL SELECT query, query, 1.0 FROM hit")


_SC = S.analytic(100.0)


@query("nearest_points", sql("SELECT query, target, pid, round(dist, 5) AS dist, round(dot, 5) AS dot FROM nn WHERE query % 20 = 0", "points", p=_PTS, nn=_NN))
def _(s, d):
    return rounded(S.nearest_points(_asked(_points(s, d)), _points(s, d), None), 5)


@query("nblast", _nblast_sql("SELECT query, target, round(score, 6) AS score FROM f WHERE query % 20 = 0"))
def _(s, d):
    return rounded(S.nblast(_asked(_points(s, d)), _points(s, d), _SC), 6)


@query("nblast_capped", _nblast_sql("SELECT query, target, round(score, 6) AS score FROM f WHERE query % 20 = 0", "nnc"))
def _(s, d):
    return rounded(S.nblast(_asked(_points(s, d)), _points(s, d), _SC, max_dist=200.0), 6)


for _k, _f in (("mean", "(a.score + b.score) / 2"), ("min", "least(a.score, b.score)"), ("max", "greatest(a.score, b.score)")):

    @query(f"nblast_{_k}", _nblast_sql(f"SELECT a.query, a.target, round({_f}, 6) AS score FROM f a JOIN f b ON a.query = b.target AND a.target = b.query WHERE a.query % 20 = 0"))
    def _(s, d, k=_k):
        return rounded(S.nblast(_asked(_points(s, d)), _points(s, d), _SC, k), 6)


@query("nblast_both", _nblast_sql("SELECT a.query, a.target, round(a.score, 6) AS forward, round(b.score, 6) AS reverse FROM f a JOIN f b ON a.query = b.target AND a.target = b.query WHERE a.query % 20 = 0"))
def _(s, d):
    return rounded(S.nblast(_asked(_points(s, d)), _points(s, d), _SC, "both"), 6)


_LOOK = S.Lookup([0, 50, 100, 200, 400, 1e9], [0, 0.25, 0.5, 0.75, 1.0], [[float(4 - i) + 0.5 * j for j in range(4)] for i in range(5)])
_BIN = "CASE WHEN dist <= 50 THEN 0 WHEN dist <= 100 THEN 1 WHEN dist <= 200 THEN 2 WHEN dist <= 400 THEN 3 ELSE 4 END"
_BIN2 = "CASE WHEN dot <= 0.25 THEN 0 WHEN dot <= 0.5 THEN 1 WHEN dot <= 0.75 THEN 2 ELSE 3 END"


@query("nblast_lookup", _nblast_sql("SELECT query, target, round(CASE WHEN query = target THEN 1 ELSE score / 5.5 END, 6) AS score FROM f WHERE query % 20 = 0", score=f"(4 - {_BIN}) + 0.5 * {_BIN2}"))
def _(s, d):
    return rounded(S.nblast(_asked(_points(s, d)), _points(s, d), _LOOK), 6)


@query("nblast_smart", None)
def _(s, d):
    return rounded(S.nblast_smart(X.points(s, d), X.points(s, d), _SC, t=50), 6)


@query("nblast_knn", sql("""SELECT query, target, round(score, 6) AS score, rank FROM (SELECT c.query, c.target, (a.score + b.score) / 2 AS score, row_number() OVER (PARTITION BY c.query ORDER BY (a.score + b.score) / 2 DESC, c.target) AS rank
FROM cand c JOIN f a ON a.query = c.query AND a.target = c.target JOIN f b ON b.query = c.target AND b.target = c.query) WHERE rank <= 2""", "points", p=_PTS, nn=_NN, hit="SELECT neuron AS query, count(*) AS n FROM p GROUP BY 1",
    f="SELECT n.query, n.target, sum(sqrt(dot * exp(-dist * dist / (2 * 100.0 * 100.0)))) / max(h.n) AS score FROM nn n JOIN hit h ON h.query = n.query GROUP BY 1, 2",
    cell="SELECT DISTINCT neuron, floor(x / 100) AS cx, floor(y / 100) AS cy, floor(z / 100) AS cz FROM p",
    w="SELECT *, count(*) OVER (PARTITION BY cx, cy, cz) AS n FROM cell",
    cand="SELECT query, target FROM (SELECT a.neuron AS query, b.neuron AS target, row_number() OVER (PARTITION BY a.neuron ORDER BY round(sum(1.0 / a.n), 9) DESC, b.neuron) AS r FROM w a JOIN w b ON a.cx = b.cx AND a.cy = b.cy AND a.cz = b.cz AND a.neuron <> b.neuron AND a.neuron % 20 = 0 GROUP BY 1, 2) WHERE r <= 3"))
def _(s, d):
    return rounded(S.nblast_knn(_points(s, d), _SC, k=2, n_candidates=3, cell=100.0, queries=_asked(_points(s, d))), 6)


_SYN = "SELECT * FROM connectors"
_SD = "sqrt((q.x-t.x)*(q.x-t.x)+(q.y-t.y)*(q.y-t.y)+(q.z-t.z)*(q.z-t.z))"


@query("synblast", sql(f"""SELECT n.query, n.target, round(sum(sqrt(exp(-dist * dist / (2 * 100.0 * 100.0)))) / max(h.n), 6) AS score FROM (SELECT q.neuron AS query, t.neuron AS target, q.node_id, min({_SD}) AS dist FROM c q JOIN c t ON q.neuron <> t.neuron AND q.neuron % 20 = 0 GROUP BY 1, 2, 3) n
JOIN (SELECT neuron, count(*) AS n FROM c GROUP BY 1) h ON h.neuron = n.query GROUP BY 1, 2 UNION ALL SELECT DISTINCT neuron, neuron, 1.0 FROM c WHERE neuron % 20 = 0""", "connectors", c=_SYN))
def _(s, d):
    c = X.connectors(s, d).withColumnRenamed("node_id", "pid")
    return rounded(S.synblast(_asked(c), c, _SC), 6)


@query("synblast_by_type", sql(f"""SELECT n.query, n.target, round(sum(sqrt(exp(-dist * dist / (2 * 100.0 * 100.0)))) / max(h.n), 6) AS score FROM (SELECT q.neuron AS query, t.neuron AS target, q.node_id, min({_SD}) AS dist FROM c q JOIN c t ON q.neuron <> t.neuron AND q.type = t.type AND q.neuron % 20 = 0 GROUP BY 1, 2, 3) n
JOIN (SELECT neuron, count(*) AS n FROM c GROUP BY 1) h ON h.neuron = n.query GROUP BY 1, 2 UNION ALL SELECT DISTINCT neuron, neuron, 1.0 FROM c WHERE neuron % 20 = 0""", "connectors", c=_SYN))
def _(s, d):
    c = X.connectors(s, d).withColumnRenamed("node_id", "pid")
    return rounded(S.synblast(_asked(c), c, _SC, by_type=True), 6)


@query("build_lookup", sql(f"""SELECT d.d AS i, e.e AS j, round(log2((coalesce(m.n, 0) / CAST(sm.n AS DOUBLE) + 1e-6) / (coalesce(r.n, 0) / CAST(sr.n AS DOUBLE) + 1e-6)), 6) AS odds FROM (SELECT unnest(range(5)) AS d) d CROSS JOIN (SELECT unnest(range(4)) AS e) e
CROSS JOIN (SELECT count(*) AS n FROM nn WHERE query % 20 = 0 AND (query + target) % 2 = 0) sm CROSS JOIN (SELECT count(*) AS n FROM nn WHERE query % 20 = 0 AND (query + target) % 2 = 1) sr
LEFT JOIN (SELECT {_BIN} AS i, {_BIN2} AS j, count(*) AS n FROM nn WHERE query % 20 = 0 AND (query + target) % 2 = 0 GROUP BY 1, 2) m ON m.i = d.d AND m.j = e.e LEFT JOIN (SELECT {_BIN} AS i, {_BIN2} AS j, count(*) AS n FROM nn WHERE query % 20 = 0 AND (query + target) % 2 = 1 GROUP BY 1, 2) r ON r.i = d.d AND r.j = e.e""", "points", p=_PTS, nn=_NN))
def _(s, d):
    p = _points(s, d)
    t = S.build_lookup_of_pairs(_asked(p), p, lambda query, target: (query + target) % 2 == 0, _LOOK.dist, _LOOK.dot)
    return rounded(s.createDataFrame([(i, j, v) for i, row in enumerate(t.cells) for j, v in enumerate(row)], "i long, j long, odds double"), 6)


@query("clusters", None)
def _(s, d):
    return S.clusters(S.nblast(X.points(s, d), X.points(s, d), _SC, "mean"), 3)


@query("scores_to_distance", _nblast_sql("SELECT query, target, round((SELECT max(score) FROM f) - score, 6) + 0.0 AS score FROM f WHERE query % 20 = 0"))
def _(s, d):
    return rounded(S.to_distance(S.nblast(_asked(_points(s, d)), _points(s, d), _SC)), 6)


# --- transforms ----------------------------------------------------------------------------------------------------
_M = G.Affine([[0.5, 0.1, 0, 10], [0, 2, 0.25, -5], [0.1, 0, 1, 3], [0, 0, 0, 1]])
_XYZ = "round({}, 8) + 0.0 AS x, round({}, 8) + 0.0 AS y, round({}, 8) + 0.0 AS z"


def _co(df, digits=8):
    return rounded(df.select("neuron", "node_id", "x", "y", "z"), digits)


@query("xform_affine", sql("SELECT neuron, node_id, " + _XYZ.format("0.5 * x + 0.1 * y + 10", "2 * y + 0.25 * z - 5", "0.1 * x + z + 3") + " FROM nodes", "nodes"))
def _(s, d):
    return _co(_M(X.nodes(s, d)))


@query("xform_round_trip", sql("SELECT neuron, node_id, " + _XYZ.format("x", "y", "z") + " FROM nodes", "nodes"))
def _(s, d):
    r = G.Registry()
    r.register("A", "B", _M)
    r.register("B", "C", G.Affine([[2, 0, 0, 1], [0, 1, 0, 0], [0, 0, 3, 0], [0, 0, 0, 1]]))
    return _co(r.xform(r.xform(X.nodes(s, d), "A", "C"), "C", "A"))


@query("mirror", sql("SELECT neuron, node_id, " + _XYZ.format("1200 - x", "y", "z") + " FROM nodes", "nodes"))
def _(s, d):
    return _co(G.mirror(X.nodes(s, d), 1200.0))


@query("similarity_transform", sql("SELECT neuron, node_id, " + _XYZ.replace("8", "6").format("3 - 2 * y", "2 * x + 7", "2 * z") + " FROM nodes", "nodes"))
def _(s, d):
    n = X.nodes(s, d)
    t = n
    fit = G.similarity(t.select("x", "y", "z", (3 - 2 * F.col("y")).alias("tx"), (2 * F.col("x") + 7).alias("ty"), (2 * F.col("z")).alias("tz")))
    return _co(fit(t), 6)


_LM = [[0, 0, 0], [1000, 0, 0], [0, 2000, 0], [0, 0, 1000], [1000, 2000, 1000], [500, 700, 300]]
_LT = [[a * 0.5 + 10, b * 2, c + 0.1 * a] for a, b, c in _LM]


@query("thin_plate", sql("SELECT neuron, node_id, round(0.5 * x + 10, 6) + 0.0 AS x, round(2 * y, 6) + 0.0 AS y, round(z + 0.1 * x, 6) + 0.0 AS z FROM nodes", "nodes"))
def _(s, d):
    return _co(G.ThinPlate(_LM, _LT)(X.nodes(s, d)), 6)


@query("moving_least_squares", sql("SELECT neuron, node_id, round(0.5 * x + 10, 6) + 0.0 AS x, round(2 * y, 6) + 0.0 AS y, round(z + 0.1 * x, 6) + 0.0 AS z FROM nodes", "nodes"))
def _(s, d):
    return _co(G.MovingLeastSquares(_LM, _LT)(X.nodes(s, d)), 6)


@query("rescale", sql("SELECT n.neuron, n.node_id, " + _XYZ.format("c.x + (n.x - c.x) * 1.5", "c.y + (n.y - c.y) * 1.5", "c.z + (n.z - c.z) * 1.5") + " FROM nodes n JOIN (SELECT neuron, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM nodes GROUP BY 1) c ON c.neuron = n.neuron", "nodes"))
def _(s, d):
    return _co(G.rescale(X.nodes(s, d), 1.5))


def _thousandths(df, *columns):
    """Thousandths, cut off at a place where no exact half lies."""
    return df.withColumns({c: F.floor(F.col(c) * 1000 + 0.31415) for c in columns})


_K = "CAST(floor(({}) * 1000 + 0.31415) AS BIGINT)"


@query("rotate", sql(f"SELECT n.neuron, n.node_id, {_K.format('c.x - (n.y - c.y)')} AS x, {_K.format('c.y + (n.x - c.x)')} AS y, {_K.format('n.z')} AS z FROM nodes n JOIN (SELECT neuron, avg(x) AS x, avg(y) AS y FROM nodes GROUP BY 1) c ON c.neuron = n.neuron", "nodes"))
def _(s, d):
    return _thousandths(G.rotate(X.nodes(s, d), [[0, -1, 0], [1, 0, 0], [0, 0, 1]]).select("neuron", "node_id", "x", "y", "z"), "x", "y", "z")


@query("translate", sql("SELECT neuron, node_id, " + _XYZ.format("x + 1", "y - 2", "z + 3") + " FROM nodes", "nodes"))
def _(s, d):
    return _co(G.translate(X.nodes(s, d), (1, -2, 3)))


@query("normalize", sql("SELECT t.neuron, t.node_id, " + _XYZ.format("t.x / r.r", "t.y / r.r", "t.z / r.r") + " FROM t JOIN (SELECT neuron, sqrt(avg(x*x+y*y+z*z)) AS r FROM t GROUP BY 1) r ON r.neuron = t.neuron", "nodes",
    t="SELECT n.neuron, n.node_id, n.x - c.x AS x, n.y - c.y AS y, n.z - c.z AS z FROM nodes n JOIN (SELECT neuron, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM nodes GROUP BY 1) c ON c.neuron = n.neuron"))
def _(s, d):
    return _co(G.normalize(X.nodes(s, d)))


# --- voxels --------------------------------------------------------------------------------------------------------
@query("voxelize", sql("SELECT neuron, i, j, k, value FROM voxels", "voxels"))
def _(s, d):
    return G.voxelize(X.nodes(s, d), 50.0)


#: Dense grids of about a hundred cells a neuron, at every scale.
_COARSE = "SELECT neuron, CAST(floor(x / 250) AS BIGINT) AS i, CAST(floor(radius / 12) AS BIGINT) AS j, CAST(node_id % 5 AS BIGINT) AS k, count(*) AS value FROM nodes GROUP BY 1, 2, 3, 4"


def _coarse(s, d):
    return X.nodes(s, d).groupBy("neuron", F.floor(F.col("x") / 250).alias("i"), F.floor(F.col("radius") / 12).alias("j"), (F.col("node_id") % 5).alias("k")).agg(F.count("*").alias("value"))


for _name, _op in (("surface_voxels", "<"), ("inner_voxels", "=")):

    @query(_name, sql(f"""SELECT v.neuron, v.i, v.j, v.k, CAST(v.value AS BIGINT) AS value FROM v LEFT JOIN (SELECT a.neuron, a.i, a.j, a.k, count(*) AS n FROM v a JOIN v b ON a.neuron = b.neuron AND abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1 GROUP BY 1, 2, 3, 4) n
ON n.neuron = v.neuron AND n.i = v.i AND n.j = v.j AND n.k = v.k WHERE coalesce(n.n, 0) {_op} 6""", "nodes", v=_COARSE))
    def _(s, d, inverse=_name == "inner_voxels"):
        return G.surface_voxels(_coarse(s, d), inverse)


@query("smooth_voxels", sql("""SELECT v.neuron, v.i + a.d AS i, v.j + b.d AS j, v.k + c.d AS k, round(sum(v.value * a.w * b.w * c.w), 6) AS value FROM v CROSS JOIN g a CROSS JOIN g b CROSS JOIN g c GROUP BY 1, 2, 3, 4 HAVING sum(v.value * a.w * b.w * c.w) > 0""", "nodes", v=_COARSE,
    g0="SELECT d, exp(-(d * d) / 2.0) AS w FROM (SELECT unnest(range(-2, 3)) AS d)", g="SELECT d, w / (SELECT sum(w) FROM g0) AS w FROM g0"))
def _(s, d):
    return rounded(G.smooth_voxels(_coarse(s, d), 1.0, 2.0), 6)


@query("voxel_overlap", sql("""SELECT p.a, p.b, round(coalesce(m.m, 0) / CAST(x.n + y.n - coalesce(m.m, 0) AS DOUBLE), 6) AS iou, round(2 * coalesce(m.m, 0) / CAST(x.n + y.n AS DOUBLE), 6) AS dice FROM (SELECT a.neuron AS a, b.neuron AS b FROM (SELECT DISTINCT neuron FROM v) a, (SELECT DISTINCT neuron FROM v) b WHERE a.neuron <> b.neuron AND a.neuron % 20 = 0) p
LEFT JOIN (SELECT a.neuron AS a, b.neuron AS b, count(*) AS m FROM v a JOIN v b ON a.i = b.i AND a.j = b.j AND a.k = b.k AND a.neuron <> b.neuron AND a.neuron % 20 = 0 GROUP BY 1, 2) m ON m.a = p.a AND m.b = p.b JOIN (SELECT neuron, count(*) AS n FROM v GROUP BY 1) x ON x.neuron = p.a JOIN (SELECT neuron, count(*) AS n FROM v GROUP BY 1) y ON y.neuron = p.b""", "nodes", v=_COARSE))
def _(s, d):
    v = _coarse(s, d)
    ids = v.select("neuron").distinct()
    return rounded(G.overlap_coefficients(v, _asked(ids).toDF("a").join(ids.toDF("b"), F.col("a") != F.col("b"))), 6)


for _name, _sql in (("voxel_union", "{a} UNION {b}"), ("voxel_intersection", "{a} INTERSECT {b}"), ("voxel_difference", "{a} EXCEPT {b}"), ("voxel_symmetric_difference", "({a} EXCEPT {b}) UNION ALL ({b} EXCEPT {a})")):

    @query(_name, sql(_sql.format(a="SELECT neuron // 2 AS neuron, i, j, k FROM v WHERE neuron % 2 = 0", b="SELECT neuron // 2 AS neuron, i, j, k FROM v WHERE neuron % 2 = 1"), "nodes", v=_COARSE))
    def _(s, d, f=getattr(G, _name)):
        v = _coarse(s, d)
        a, b = (v.filter(f"neuron % 2 = {r}").withColumn("neuron", F.floor(F.col("neuron") / 2)) for r in (0, 1))
        return f(a, b)


_SIX = "(VALUES (0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) o(di, dj, dk)"
_DILATED = f"SELECT DISTINCT neuron, i + di AS i, j + dj AS j, k + dk AS k FROM {{}} CROSS JOIN {_SIX}"
_ERODED = f"SELECT neuron, i, j, k FROM (SELECT v.neuron, v.i, v.j, v.k, count(w.neuron) AS n FROM {{0}} v CROSS JOIN {_SIX} LEFT JOIN {{0}} w ON w.neuron = v.neuron AND w.i = v.i + di AND w.j = v.j + dj AND w.k = v.k + dk GROUP BY 1, 2, 3, 4) WHERE n = 7"
for _name, _steps in (("dilate", [_DILATED]), ("erode", [_ERODED]), ("opening", [_ERODED, _DILATED]), ("closing", [_DILATED, _ERODED])):

    @query(f"voxel_{_name}", sql("SELECT neuron, i, j, k FROM r", "nodes", v=_COARSE, **({"r1": _steps[0].format("v"), "r": _steps[1].format("r1")} if len(_steps) > 1 else {"r": _steps[0].format("v")})))
    def _(s, d, f=getattr(G, f"voxel_{_name}")):
        return f(_coarse(s, d))


_EIGHTEEN = "(SELECT a.x AS di, b.x AS dj, c.x AS dk FROM (VALUES (-1), (0), (1)) a(x), (VALUES (-1), (0), (1)) b(x), (VALUES (-1), (0), (1)) c(x) WHERE abs(a.x) + abs(b.x) + abs(c.x) <= 2) o"


@query("voxel_dilate_values", sql("""SELECT g.neuron, g.i, g.j, g.k, CAST(coalesce(v.value, m.f) AS BIGINT) AS value FROM g LEFT JOIN v ON v.neuron = g.neuron AND v.i = g.i AND v.j = g.j AND v.k = g.k
JOIN (SELECT neuron, max(value) AS f FROM v GROUP BY 1) m ON m.neuron = g.neuron""", "nodes", v=_COARSE, g=f"SELECT DISTINCT neuron, i + di AS i, j + dj AS j, k + dk AS k FROM v CROSS JOIN {_EIGHTEEN}"))
def _(s, d):
    v = _coarse(s, d)
    return G.with_values(G.voxel_dilate(v, 1, 18), v)


@query("voxel_threshold", sql("SELECT neuron, i, j, k, value FROM v WHERE value >= 3", "nodes", v=_COARSE))
def _(s, d):
    return G.voxel_threshold(_coarse(s, d), 3)


@query("voxel_flip", sql("SELECT v.neuron, m.i - v.i AS i, v.j, v.k, v.value FROM v JOIN (SELECT neuron, max(i) AS i FROM v GROUP BY 1) m ON m.neuron = v.neuron", "nodes", v=_COARSE))
def _(s, d):
    return G.voxel_flip(_coarse(s, d), "i")


@query("voxel_strip", sql("SELECT v.neuron, v.i - m.i AS i, v.j - m.j AS j, v.k - m.k AS k, v.value, m.i AS oi, m.j AS oj, m.k AS ok FROM v JOIN (SELECT neuron, min(i) AS i, min(j) AS j, min(k) AS k FROM v GROUP BY 1) m ON m.neuron = v.neuron", "nodes", v=_COARSE))
def _(s, d):
    return G.voxel_strip(_coarse(s, d))


@query("voxel_distance", sql("SELECT neuron, i, j, k, round(sqrt(min(4.0 * (i - a) * (i - a) + 9.0 * (j - b) * (j - b) + 25.0 * (k - c) * (k - c))), 6) AS distance FROM (SELECT v.neuron, v.i, v.j, v.k, e.i AS a, e.j AS b, e.k AS c FROM v JOIN e ON e.neuron = v.neuron) GROUP BY 1, 2, 3, 4", "nodes", v=_COARSE,
    e=f"SELECT neuron, i, j, k FROM ({_DILATED.format('v')}) EXCEPT SELECT neuron, i, j, k FROM v"))
def _(s, d):
    return rounded(R.distance_transform(_coarse(s, d), (2.0, 3.0, 5.0)), 6)


@query("voxel_downscale", sql("SELECT neuron, CAST(floor(i / 2.0) AS BIGINT) AS i, CAST(floor(j / 2.0) AS BIGINT) AS j, CAST(floor(k / 2.0) AS BIGINT) AS k, CAST(sum(value) AS BIGINT) AS value FROM v GROUP BY 1, 2, 3, 4", "nodes", v=_COARSE))
def _(s, d):
    return G.voxel_downscale(_coarse(s, d), 2)


@query("voxel_components", None)
def _(s, d):
    return G.voxel_components(_coarse(s, d), 26)


# --- samples -------------------------------------------------------------------------------------------------------
@query("downsample", sql("SELECT a.neuron, a.node_id, coalesce(min_by(a.a, a.hops) FILTER (a.hops > 0 AND p.keep), -1) AS parent_id FROM anc a JOIN k q ON q.neuron = a.neuron AND q.node_id = a.node_id AND q.keep JOIN k p ON p.neuron = a.neuron AND p.node_id = a.a GROUP BY 1, 2", "seg",
    k="""SELECT t.neuron, t.node_id, t.kids <> 1 OR t.parent_id < 0 OR s.pos % 3 = 0 AS keep FROM tree t LEFT JOIN (SELECT s.neuron, a.a AS node_id, a.hops AS pos FROM seg s JOIN anc a ON a.neuron = s.neuron AND a.node_id = s.segment JOIN anc e ON e.neuron = s.neuron AND e.node_id = s.segment AND e.a = s.top AND a.hops < e.hops) s ON s.neuron = t.neuron AND s.node_id = t.node_id"""))
def _(s, d):
    return G.downsample(X.nodes(s, d), 3).select("neuron", "node_id", "parent_id")


@query("sample_cable", sql("""SELECT neuron, node_id, sample, round((sample * 100.0 - (e - d)) / d, 4) + 0.0 AS t, round(x + (px - x) * (sample * 100.0 - (e - d)) / d, 4) + 0.0 AS x FROM (SELECT *, unnest(range(CAST(ceil((e - d) / 100) AS BIGINT), CAST(ceil(e / 100) AS BIGINT))) AS sample
FROM (SELECT *, sum(d) OVER (PARTITION BY neuron ORDER BY node_id ROWS UNBOUNDED PRECEDING) AS e FROM tree WHERE d > 0))""", "tree"))
def _(s, d):
    return rounded(G.sample_cable(X.nodes(s, d), 100.0).select("neuron", "node_id", "sample", "t", "x"), 4)


@query("resample_along_axis", sql("""SELECT neuron, node_id, plane, CAST(floor((x + (px - x) * (plane * 70.0 - z) / (pz - z)) * 1000 + 0.31415) AS BIGINT) AS x FROM (SELECT *, unnest(range(CAST(ceil(least(z, pz) / 70) AS BIGINT), CAST(floor(greatest(z, pz) / 70) AS BIGINT) + 1)) AS plane FROM tree WHERE parent_id >= 0 AND z <> pz)
WHERE (plane * 70.0 - z) / (pz - z) > 0 AND (plane * 70.0 - z) / (pz - z) < 1""", "tree"))
def _(s, d):
    return _thousandths(G.resample_along_axis(X.nodes(s, d), 70.0).select("neuron", "node_id", "plane", "x"), "x")


@query("estimate_spacing", sql(f"SELECT neuron, round(median(d), 5) AS spacing FROM (SELECT q.neuron, q.pid, min({_D}) AS d FROM points q JOIN points t ON t.neuron = q.neuron AND t.pid <> q.pid GROUP BY 1, 2) GROUP BY 1", "points"))
def _(s, d):
    return rounded(G.estimate_spacing(X.points(s, d)), 5)


@query("resample", sql("SELECT neuron, count(*) AS n, round(sum(l), 2) AS l FROM (SELECT neuron, greatest(1, CAST(round_even(length / 150, 0) AS BIGINT)) AS n, length AS l FROM seg) GROUP BY 1".replace("count(*) AS n", "CAST(sum(n) + 1 AS BIGINT) AS n"), "seg"))
def _(s, d):
    from ..operators import morphometry as M

    n = X.nodes(s, d)
    r = G.resample(n, 150.0)
    return rounded(r.groupBy("neuron").agg(F.count("*").alias("n")).join(M.cable_length(n), "neuron").select("neuron", "n", F.col("cable_length").alias("l")), 2)


# --- meshes: each neuron's bounding box as twelve faces ---------------------------------------------------------------
_FACES = ((0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5))


def boxes(s, d):
    b = X.nodes(s, d).groupBy("neuron").agg(*(f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))))
    v = b.select("neuron", F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("vid"), *(F.col(("hi" if i >> n & 1 else "lo") + c).alias(c) for n, c in enumerate("xyz"))) for i in range(8)))).alias("v")).select("neuron", "v.*")
    f = b.select("neuron", F.explode(F.array(*(F.struct(*(F.lit(x).cast("long").alias(f"v{n}") for n, x in enumerate(t))) for t in _FACES))).alias("f")).select("neuron", "f.*")
    return v, f


_BOX = "SELECT neuron, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM nodes GROUP BY 1"


@query("mesh_measures", sql("SELECT neuron, round(2 * ((x1-x0)*(y1-y0) + (y1-y0)*(z1-z0) + (x1-x0)*(z1-z0)), 4) AS area, round((x1-x0)*(y1-y0)*(z1-z0), 4) AS volume, CAST(12 AS BIGINT) AS n_faces FROM b", "nodes", b=_BOX))
def _(s, d):
    v, f = boxes(s, d)
    t = rounded(G.mesh_measures(v, f), 4)
    return t.withColumn("volume", F.abs("volume"))


@query("in_volume", sql("SELECT n.neuron, n.node_id, n.x > b.x0 AND n.x < b.x1 AND n.y > b.y0 AND n.y < b.y1 AND n.z > b.z0 AND n.z < b.z1 AS inside FROM nodes n CROSS JOIN (SELECT x0 + 100.003 AS x0, x1 - 100.003 AS x1, y0 + 50.503 AS y0, y1 - 50.507 AS y1, z0 + 20.501 AS z0, z1 - 20.509 AS z1 FROM b WHERE neuron = 1) b", "nodes", b=_BOX))
def _(s, d):
    v, f = boxes(s, d)
    v = v.filter("neuron = 1").withColumns({"x": F.when(F.col("vid") % 2 == 0, F.col("x") + 100.003).otherwise(F.col("x") - 100.003), "y": F.when(F.col("vid").bitwiseAND(2) == 0, F.col("y") + 50.503).otherwise(F.col("y") - 50.507), "z": F.when(F.col("vid") < 4, F.col("z") + 20.501).otherwise(F.col("z") - 20.509)})
    return G.in_volume(X.nodes(s, d), v, f.filter("neuron = 1")).select("neuron", "node_id", "inside")


@query("smooth_mesh", None)
def _(s, d):
    v, f = boxes(s, d)
    return rounded(G.smooth_mesh(v, f, 2), 6)


