"""Queries: measures of single neurons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import morphometry as M
from . import fixtures as X
from .oracle import sql
from .registry import query, rounded

R = "round({} , 4) + 0.0"


@query("parent_dist", sql("SELECT neuron, node_id, CASE WHEN parent_id >= 0 THEN round(d, 4) END AS parent_dist FROM tree", "tree"))
def _(s, d):
    return rounded(M.parent_dist(X.nodes(s, d)))


@query("cable_length", sql("SELECT neuron, round(sum(d), 4) AS cable_length FROM tree GROUP BY 1", "tree"))
def _(s, d):
    return rounded(M.cable_length(X.nodes(s, d)))


@query("surface_volume", sql("""SELECT neuron, round(sum(d), 2) AS cable_length,
  round(sum(CASE WHEN d > 0 THEN pi() * (radius + coalesce(pradius, radius)) * sqrt((radius - coalesce(pradius, radius)) * (radius - coalesce(pradius, radius)) + d * d) ELSE 0 END), 2) AS surface_area,
  round(sum(pi() / 3 * (radius * radius + radius * coalesce(pradius, radius) + coalesce(pradius, radius) * coalesce(pradius, radius)) * d), 2) AS volume,
  round(sum(d) / count(*), 2) AS sampling_resolution FROM tree GROUP BY 1""", "tree"))
def _(s, d):
    return rounded(M.surface_volume(X.nodes(s, d)), 2)


@query("summary", sql("""SELECT neuron, count(*) AS n_nodes, count(*) FILTER (parent_id >= 0 AND kids > 1) AS n_branches, count(*) FILTER (parent_id >= 0 AND kids = 0) AS n_leafs,
  count(*) FILTER (parent_id < 0) AS n_trees, round(sum(d), 4) AS cable_length, round(min(x), 4) AS x_min, round(max(x), 4) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max FROM tree GROUP BY 1""", "tree"))
def _(s, d):
    return rounded(M.summary(X.nodes(s, d)))


def _strahler_sql() -> str:
    """Orders by height, from the leaves up: a level of the tree in each step."""
    steps = ["s0 AS MATERIALIZED (SELECT h.neuron, h.node_id, h.parent_id, CAST(1 AS BIGINT) AS si, h.h FROM height h WHERE h.h = 0)"]
    for i in range(1, 24):
        steps.append(f"""s{i} AS MATERIALIZED (SELECT * FROM s{i - 1} UNION ALL SELECT h.neuron, h.node_id, h.parent_id,
  max(c.si) + CASE WHEN count(*) > 1 AND count(*) FILTER (c.si = m.m) > 1 THEN 1 ELSE 0 END, h.h
FROM height h JOIN s{i - 1} c ON c.neuron = h.neuron AND c.parent_id = h.node_id
JOIN (SELECT neuron, parent_id, max(si) AS m FROM s{i - 1} GROUP BY 1, 2) m ON m.neuron = h.neuron AND m.parent_id = h.node_id
WHERE h.h = {i} GROUP BY h.neuron, h.node_id, h.parent_id, h.h)""")
    base = sql("", "anc").rstrip()
    return base + """,
height AS MATERIALIZED (SELECT t.neuron, t.node_id, t.parent_id, max(a.hops) AS h FROM anc a JOIN tree t ON t.neuron = a.neuron AND t.node_id = a.a GROUP BY 1, 2, 3),
""" + ",\n".join(steps) + "\nSELECT neuron, node_id, si AS strahler_index FROM s23"


@query("strahler_index", _strahler_sql())
def _(s, d):
    return M.strahler_index(X.nodes(s, d))


@query("strahler_greedy", sql("SELECT a.neuron, a.a AS node_id, count(*) AS strahler_index FROM anc a JOIN tree t ON t.neuron = a.neuron AND t.node_id = a.node_id AND t.kids = 0 GROUP BY 1, 2", "anc"))
def _(s, d):
    return M.strahler_index(X.nodes(s, d), "greedy")


@query("segment_analysis", sql("""SELECT s.neuron, s.segment, round(s.length, 4) AS length, round(CASE WHEN sqrt((f.x-t.x)*(f.x-t.x)+(f.y-t.y)*(f.y-t.y)+(f.z-t.z)*(f.z-t.z)) > 0
    THEN s.length / sqrt((f.x-t.x)*(f.x-t.x)+(f.y-t.y)*(f.y-t.y)+(f.z-t.z)*(f.z-t.z)) END, 4) AS tortuosity,
  round(r.dist, 4) AS root_dist, min(n.radius) AS radius_min, max(n.radius) AS radius_max, round(avg(n.radius), 4) AS radius_mean
FROM seg s JOIN tree f ON f.neuron = s.neuron AND f.node_id = s.segment JOIN tree t ON t.neuron = s.neuron AND t.node_id = s.top
JOIN root r ON r.neuron = s.neuron AND r.node_id = s.top
JOIN anc a ON a.neuron = s.neuron AND a.node_id = s.segment AND a.dist <= s.length + 1e-9 JOIN anc b ON b.neuron = s.neuron AND b.node_id = s.segment AND b.a = s.top AND a.hops <= b.hops
JOIN tree n ON n.neuron = s.neuron AND n.node_id = a.a GROUP BY s.neuron, s.segment, s.length, f.x, f.y, f.z, t.x, t.y, t.z, r.dist""", "seg", "root"))
def _(s, d):
    t = rounded(M.segment_analysis(X.nodes(s, d))).drop("strahler_index", "volume")
    from pyspark.sql import functions as F

    return t.withColumn("tortuosity", F.when(~F.isnan("tortuosity"), F.col("tortuosity")))


@query("tortuosity", sql("""SELECT s.neuron, round(avg(s.length / sqrt((f.x-t.x)*(f.x-t.x)+(f.y-t.y)*(f.y-t.y)+(f.z-t.z)*(f.z-t.z))) FILTER ((f.x-t.x)*(f.x-t.x)+(f.y-t.y)*(f.y-t.y)+(f.z-t.z)*(f.z-t.z) > 0), 4) AS tortuosity
FROM seg s JOIN tree f ON f.neuron = s.neuron AND f.node_id = s.segment JOIN tree t ON t.neuron = s.neuron AND t.node_id = s.top GROUP BY 1""", "seg"))
def _(s, d):
    return rounded(M.tortuosity(X.nodes(s, d)))


@query("sholl_analysis", sql("""SELECT t.neuron, r.hi AS radius, sum(CAST(t.parent_id >= 0 AND (t.dc <= r.hi) <> (p.dc <= r.hi) AS BIGINT)) AS intersections,
  round(sum(CASE WHEN t.parent_id >= 0 AND t.dc > r.lo AND t.dc < r.hi THEN t.d ELSE 0 END), 4) AS cable_length,
  sum(CAST(t.parent_id >= 0 AND t.kids > 1 AND t.dc > r.lo AND t.dc < r.hi AS BIGINT)) AS branch_points
FROM dc t CROSS JOIN (VALUES (0.0, 100.0), (100.0, 200.0), (200.0, 300.0), (300.0, 400.0)) r(lo, hi) LEFT JOIN dc p ON p.neuron = t.neuron AND p.node_id = t.parent_id GROUP BY 1, 2""", "tree",
    dc="SELECT t.*, sqrt((t.x-c.x)*(t.x-c.x)+(t.y-c.y)*(t.y-c.y)+(t.z-c.z)*(t.z-c.z)) AS dc FROM tree t JOIN (SELECT neuron, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM nodes GROUP BY 1) c ON c.neuron = t.neuron").replace("(0.0, 100.0), (100.0, 200.0), (200.0, 300.0), (300.0, 400.0)", ", ".join(f"(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for a, b in ((0, 100), (100, 200), (200, 300), (300, 400)))))
def _(s, d):
    return rounded(M.sholl_analysis(X.nodes(s, d), [100, 200, 300, 400]))


@query("sholl_geodesic", sql("""SELECT t.neuron, r.hi AS radius, sum(CAST(t.parent_id >= 0 AND (q.dist <= r.hi) <> (p.dist <= r.hi) AS BIGINT)) AS intersections,
  round(sum(CASE WHEN t.parent_id >= 0 AND q.dist > r.lo AND q.dist < r.hi THEN t.d ELSE 0 END), 4) AS cable_length,
  sum(CAST(t.parent_id >= 0 AND t.kids > 1 AND q.dist > r.lo AND q.dist < r.hi AS BIGINT)) AS branch_points
FROM tree t JOIN root q ON q.neuron = t.neuron AND q.node_id = t.node_id CROSS JOIN (VALUES (CAST(0 AS DOUBLE), CAST(1000 AS DOUBLE)), (CAST(1000 AS DOUBLE), CAST(2500 AS DOUBLE))) r(lo, hi)
LEFT JOIN root p ON p.neuron = t.neuron AND p.node_id = t.parent_id GROUP BY 1, 2""", "root"))
def _(s, d):
    return rounded(M.sholl_analysis(X.nodes(s, d), [1000, 2500], geodesic=True))


@query("dist_to_root", sql("SELECT neuron, node_id, round(dist, 4) AS dist FROM root", "root"))
def _(s, d):
    return rounded(M.dist_to_root(X.nodes(s, d)))


_V = "(c.x-c.px)*(e.x-e.px)+(c.y-c.py)*(e.y-e.py)+(c.z-c.pz)*(e.z-e.pz)"
_PAIRS = f"""SELECT c.neuron, c.parent_id AS node_id, c.node_id AS child_a, e.node_id AS child_b, round(degrees(acos(greatest(-1.0, least(1.0, ({_V}) / (c.d * e.d))))), 3) AS angle
FROM tree c JOIN tree e ON e.neuron = c.neuron AND e.parent_id = c.parent_id AND c.node_id < e.node_id WHERE c.parent_id >= 0 AND """


def _angles(df):
    return rounded(df, 3).filter("angle IS NOT NULL")


@query("branch_angles", sql(_PAIRS + "c.grand >= 0 AND c.d > 0 AND e.d > 0", "tree"))
def _(s, d):
    return _angles(M.branch_angles(X.nodes(s, d)))


@query("soma_exit_angles", sql(_PAIRS + "c.grand < 0 AND c.d > 0 AND e.d > 0", "tree"))
def _(s, d):
    return _angles(M.soma_exit_angles(X.nodes(s, d)))


@query("path_angles", sql(f"""SELECT c.neuron, c.node_id, round(degrees(acos(greatest(-1.0, least(1.0, ({_V}) / (c.d * e.d))))), 3) AS angle
FROM tree c JOIN tree e ON e.neuron = c.neuron AND e.parent_id = c.node_id WHERE c.parent_id >= 0 AND c.kids = 1 AND c.d > 0 AND e.d > 0""", "tree"))
def _(s, d):
    return _angles(M.path_angles(X.nodes(s, d)))


@query("root_angles", sql("""SELECT c.neuron, c.node_id, round(degrees(acos(greatest(-1.0, least(1.0, ((c.x-c.px)*(c.px-r.x)+(c.y-c.py)*(c.py-r.y)+(c.z-c.pz)*(c.pz-r.z))
  / (c.d * sqrt((c.px-r.x)*(c.px-r.x)+(c.py-r.y)*(c.py-r.y)+(c.pz-r.z)*(c.pz-r.z))))))), 3) AS angle
FROM tree c JOIN root q ON q.neuron = c.neuron AND q.node_id = c.node_id JOIN nodes r ON r.neuron = c.neuron AND r.node_id = q.root
WHERE c.parent_id >= 0 AND c.d > 0 AND (c.px-r.x)*(c.px-r.x)+(c.py-r.y)*(c.py-r.y)+(c.pz-r.z)*(c.pz-r.z) > 0""", "root"))
def _(s, d):
    return _angles(M.root_angles(X.nodes(s, d)))


_FLOW = """SELECT t.neuron, t.node_id, CAST(CASE WHEN t.kids > 1 AND t.parent_id >= 0 THEN m.v ELSE v.v END AS BIGINT) AS flow FROM tree t
JOIN val v ON v.neuron = t.neuron AND v.node_id = t.node_id
LEFT JOIN (SELECT c.neuron, c.parent_id, max(w.v) AS v FROM tree c JOIN val w ON w.neuron = c.neuron AND w.node_id = c.node_id GROUP BY 1, 2) m ON m.neuron = t.neuron AND m.parent_id = t.node_id"""

for _mode, _expr in (("sum", "dp * (tq - dq) + dq * (tp - dp)"), ("centrifugal", "dp * (tq - dq)"), ("centripetal", "dq * (tp - dp)")):

    @query(f"synapse_flow_centrality_{_mode}", sql(_FLOW, "syn", val=f"SELECT neuron, node_id, {_expr} AS v FROM syn"))
    def _(s, d, mode=_mode):
        return M.synapse_flow_centrality(X.nodes(s, d), X.connectors(s, d), mode)


@query("flow_centrality", sql(_FLOW, "root", lv="SELECT a.neuron, a.a AS node_id, sum(CAST(t.kids = 0 AND t.parent_id >= 0 AS BIGINT)) AS n FROM anc a JOIN tree t ON t.neuron = a.neuron AND t.node_id = a.node_id GROUP BY 1, 2",
    val="SELECT r.neuron, r.node_id, l.n * (w.n - l.n) AS v FROM root r JOIN lv l ON l.neuron = r.neuron AND l.node_id = r.node_id JOIN lv w ON w.neuron = r.neuron AND w.node_id = r.root"))
def _(s, d):
    return M.flow_centrality(X.nodes(s, d))


@query("bending_flow", sql("""SELECT a.neuron, a.parent_id AS node_id, CAST(sum(s.dq * q.dp) AS BIGINT) AS flow FROM tree a JOIN tree b ON b.neuron = a.neuron AND b.parent_id = a.parent_id AND a.node_id <> b.node_id
JOIN syn s ON s.neuron = a.neuron AND s.node_id = a.node_id JOIN syn q ON q.neuron = b.neuron AND q.node_id = b.node_id WHERE a.parent_id >= 0 GROUP BY 1, 2""", "syn"))
def _(s, d):
    return M.bending_flow(X.nodes(s, d), X.connectors(s, d))


_H = "CASE WHEN {n} > 0 AND {q} > 0 AND {q} < {n} THEN -({q} / {n} * ln({q} / {n}) + (1 - {q} / {n}) * ln(1 - {q} / {n})) ELSE 0 END"


@query("arbor_segregation_index", sql("SELECT neuron, node_id, round(CASE WHEN w > 0 THEN 1 - (h1 * n1 + h2 * n2) / (w * n) ELSE 0 END, 4) AS segregation_index FROM e", "syn",
    f="SELECT neuron, node_id, CAST(dp + dq AS DOUBLE) AS n1, CAST(dq AS DOUBLE) AS q1, CAST(tp - dp + tq - dq AS DOUBLE) AS n2, CAST(tq - dq AS DOUBLE) AS q2, CAST(tp + tq AS DOUBLE) AS n, CAST(tq AS DOUBLE) AS q FROM syn",
    e=f"SELECT *, {_H.format(n='n1', q='q1')} AS h1, {_H.format(n='n2', q='q2')} AS h2, {_H.format(n='n', q='q')} AS w FROM f"))
def _(s, d):
    return rounded(M.arbor_segregation_index(X.nodes(s, d), X.connectors(s, d)))


@query("segregation_index", sql("SELECT neuron, round(CASE WHEN w > 0 THEN 1 - hn / n / w ELSE 0 END, 4) AS segregation_index FROM e", "connectors",
    g="SELECT c.neuron, n.label, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (type = 'post') AS DOUBLE) AS q FROM connectors c JOIN nodes n ON n.neuron = c.neuron AND n.node_id = c.node_id GROUP BY 1, 2",
    f=f"SELECT neuron, sum(n) AS n, sum(q) AS q, sum(n * {_H.format(n='n', q='q')}) AS hn FROM g GROUP BY 1",
    e=f"SELECT *, {_H.format(n='n', q='q')} AS w FROM f"))
def _(s, d):
    from pyspark.sql import functions as F

    c = X.connectors(s, d).join(X.nodes(s, d).select("neuron", "node_id", "label"), ["neuron", "node_id"])
    parts = c.select("neuron", "label", (F.col("type") == "pre").cast("int").alias("pre"), (F.col("type") == "post").cast("int").alias("post"))
    return rounded(M.segregation_index(parts, "label"))


@query("betweenness_directed", sql("SELECT b.neuron, b.node_id, (b.size - 1) * r.depth AS betweenness FROM below b JOIN root r ON r.neuron = b.neuron AND r.node_id = b.node_id", "below", "root"))
def _(s, d):
    return M.betweenness_centrality(X.nodes(s, d))


@query("betweenness_undirected", sql("""SELECT b.neuron, b.node_id, CAST(((n.size - 1) * (n.size - 1) - (n.size - b.size) * (n.size - b.size) - coalesce(c.s, 0)) // 2 AS BIGINT) AS betweenness
FROM below b JOIN root r ON r.neuron = b.neuron AND r.node_id = b.node_id JOIN below n ON n.neuron = r.neuron AND n.node_id = r.root
LEFT JOIN (SELECT t.neuron, t.parent_id, sum(q.size * q.size) AS s FROM tree t JOIN below q ON q.neuron = t.neuron AND q.node_id = t.node_id GROUP BY 1, 2) c ON c.neuron = b.neuron AND c.parent_id = b.node_id""", "below", "root"))
def _(s, d):
    return M.betweenness_centrality(X.nodes(s, d), directed=False)


_PERS = """SELECT p.neuron, p.leaf, max(r.dist) AS birth, min(coalesce(q.dist, r.dist)) AS death FROM path p JOIN tree t ON t.neuron = p.neuron AND t.node_id = p.at
JOIN root r ON r.neuron = p.neuron AND r.node_id = p.at LEFT JOIN root q ON q.neuron = p.neuron AND q.node_id = t.parent_id GROUP BY 1, 2"""


@query("persistence_points", sql("SELECT neuron, leaf, round(birth, 3) AS birth, round(death, 3) AS death FROM pers", "path", "root", pers=_PERS))
def _(s, d):
    return rounded(M.persistence_points(X.nodes(s, d)), 3)


_VEC = dict(pers=_PERS, w="SELECT *, birth - death AS w FROM pers WHERE birth > death",
    m="SELECT neuron, sum(w) AS sw, sum(w * birth) AS s1, sum(w * birth * birth) AS s2, sum(w * w) AS ww FROM w GROUP BY 1",
    h="SELECT neuron, sw, 0.2 * sqrt((s2 / sw - s1 / sw * s1 / sw) / (1 - ww / (sw * sw))) AS h FROM m",
    top="SELECT max(birth) * 1.05 AS t FROM pers",
    vec="""SELECT w.neuron, g.i, sum(w.w * exp(-pow((g.i * top.t / 19 - w.birth) / h.h, 2) / 2) / (h.sw * h.h * sqrt(2 * pi()))) AS density
FROM w JOIN h ON h.neuron = w.neuron AND h.h > 0 CROSS JOIN (SELECT i::INT AS i FROM range(20) r(i)) g CROSS JOIN top GROUP BY 1, 2""")


@query("persistence_vectors", sql("SELECT neuron, i, round(density, 8) AS density FROM vec", "path", "root", **_VEC))
def _(s, d):
    return rounded(M.persistence_vectors(M.persistence_points(X.nodes(s, d)), 20), 8)


@query("persistence_distances", sql("""SELECT x.neuron AS a, y.neuron AS b, round(sqrt(sum(pow(x.density / m.l - y.density / n.l, 2))), 6) AS distance FROM vec x JOIN vec y ON x.i = y.i AND x.neuron <> y.neuron JOIN l m ON m.neuron = x.neuron JOIN l n ON n.neuron = y.neuron
WHERE x.neuron % 20 = 0 GROUP BY 1, 2""", "path", "root", **_VEC, l="SELECT neuron, sqrt(sum(density * density)) AS l FROM vec GROUP BY 1"))
def _(s, d):
    v = M.persistence_vectors(M.persistence_points(X.nodes(s, d)), 20)
    t = M.persistence_distances(v, v.filter("neuron % 20 = 0").select(F.col("neuron").alias("a")))
    return t.withColumn("distance", F.floor(F.col("distance") * 1e6 + 0.5) / 1e6)  # as SQL rounds; through decimals it takes longer than all else


@query("form_factor", sql("""SELECT p.neuron, v.q, round(2 * coalesce(sum(CASE WHEN r.r = 0 THEN 1 ELSE sin(v.q * r.r) / (v.q * r.r) END), 0) / pow(max(c.n), 2) + 1.0 / max(c.n), 6) AS form_factor
FROM (SELECT DISTINCT neuron FROM few) p CROSS JOIN (VALUES (CAST(0.001 AS DOUBLE)), (CAST(0.01 AS DOUBLE))) v(q) JOIN (SELECT neuron, count(*) AS n FROM few GROUP BY 1) c ON c.neuron = p.neuron
LEFT JOIN (SELECT a.neuron, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS r FROM few a JOIN few b ON a.neuron = b.neuron AND (a.x, a.y, a.z) < (b.x, b.y, b.z)) r ON r.neuron = p.neuron GROUP BY 1, 2""", "nodes",
    few="SELECT DISTINCT neuron, x, y, z FROM nodes"))
def _(s, d):
    return rounded(M.form_factor(X.nodes(s, d), [0.001, 0.01]), 6)
