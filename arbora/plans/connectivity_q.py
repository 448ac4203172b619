"""Queries: connectivity, similarity, matching, traversal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import connectivity as N
from . import fixtures as X
from .oracle import sql
from .registry import query, rounded


def _queries(s, d):
    """The stated query set: sources divisible by 20, against all sources."""
    return X.edges(s, d).filter("source % 20 = 0").select(F.col("source").alias("a")).distinct()


_E = "SELECT source, target, CAST(weight AS DOUBLE) AS w FROM edges"
_EDGES = """SELECT coalesce(p.connector_id, q.connector_id) AS connector_id, coalesce(CAST(p.neuron AS VARCHAR), '__OTHER__') AS source, coalesce(CAST(q.neuron AS VARCHAR), '__OTHER__') AS target, p.node_id AS source_node, q.node_id AS target_node
FROM (SELECT * FROM connectors WHERE type = 'pre') p FULL JOIN (SELECT * FROM connectors WHERE type = 'post') q ON p.connector_id = q.connector_id"""


@query("synapse_edges", sql("SELECT source, target, count(*) AS n, sum(source_node) AS a, sum(target_node) AS b FROM e GROUP BY 1, 2", "connectors", e=_EDGES))
def _(s, d):
    return N.synapse_edges(X.connectors(s, d)).groupBy("source", "target").agg(F.count("*").alias("n"), F.sum("source_node").alias("a"), F.sum("target_node").alias("b"))


@query("adjacency", sql("SELECT source, target, count(*) AS weight FROM e GROUP BY 1, 2", "connectors", e=_EDGES))
def _(s, d):
    return N.adjacency(X.connectors(s, d))


@query("adjacency_inner", sql("SELECT source, target, count(*) AS weight FROM e WHERE source <> '__OTHER__' AND target <> '__OTHER__' GROUP BY 1, 2", "connectors", e=_EDGES))
def _(s, d):
    return N.adjacency(X.connectors(s, d), include_other=False)


for _m, _f in (("SUM", "sum"), ("AVERAGE", "avg"), ("MIN", "min"), ("MAX", "max")):

    @query(f"group_matrix_{_m.lower()}", sql(f"""SELECT CASE WHEN source <= 20 THEN 'g' || source % 4 ELSE CAST(source AS VARCHAR) END AS source, 'h' || target % 10 AS target, {'round(avg(weight), 4)' if _f == 'avg' else f'CAST({_f}(weight) AS BIGINT)'} AS weight
FROM edges GROUP BY 1, 2""", "edges"))
    def _(s, d, m=_m):
        e = X.edges(s, d)
        rows = e.filter("source <= 20").select(F.col("source").alias("id"), F.concat(F.lit("g"), F.col("source") % 4).alias("group")).distinct()
        cols = e.select(F.col("target").alias("id"), F.concat(F.lit("h"), F.col("target") % 10).alias("group")).distinct()
        return rounded(N.group_matrix(e, rows, cols, m))


# dense: one value for every source and target, absent weights are 0
_GRID = dict(
    e=_E,
    v="SELECT t.target, coalesce(e.w, 0) AS w FROM (SELECT DISTINCT source FROM e) s CROSS JOIN (SELECT DISTINCT target FROM e) t LEFT JOIN e ON e.source = s.source AND e.target = t.target")
_RATIO = "pow(sum(w / n), 2) / sum(w * w / n)"
_N = "(SELECT *, count(*) OVER (PARTITION BY target) AS n FROM v)"


@query("sparseness_lts", sql(f"SELECT target, round(1 / (1 - 1.0 / max(n)) * (1 - {_RATIO}), 6) + 0.0 AS sparseness FROM {_N} GROUP BY 1", "edges", **_GRID))
def _(s, d):
    return rounded(N.connectivity_sparseness(X.edges(s, d), "LTS"), 6)


@query("sparseness_activity_ratio", sql(f"SELECT target, round(1 - {_RATIO}, 6) + 0.0 AS sparseness FROM {_N} GROUP BY 1", "edges", **_GRID))
def _(s, d):
    return rounded(N.connectivity_sparseness(X.edges(s, d), "activity_ratio"), 6)


@query("sparseness_ltk", sql("SELECT v.target, round(sum(pow((w - m) / sd, 4)) / count(*) - 3, 8) + 0.0 AS sparseness FROM v JOIN (SELECT target, avg(w) AS m, stddev_pop(w) AS sd FROM v GROUP BY 1) q ON q.target = v.target WHERE sd > 0 GROUP BY 1", "edges", **_GRID))
def _(s, d):
    return rounded(N.connectivity_sparseness(X.edges(s, d), "LTK"), 8)


@query("sparseness_lts_missing", sql(f"SELECT target, round(1 / (1 - 1.0 / max(n)) * (1 - {_RATIO}) + 1e-9, 6) + 0.0 AS sparseness FROM {_N} GROUP BY 1 HAVING max(n) > 1", "edges", v=_E))
def _(s, d):  # moved off exact halves before rounding
    return rounded(N.connectivity_sparseness(X.edges(s, d), "LTS", dense=False).withColumn("sparseness", F.col("sparseness") + 1e-9), 6)


# each query with every other source, over all targets
_DENSE = dict(
    e=_E,
    x="""SELECT p.a, p.b, t.target, coalesce(a.w, 0) AS wa, coalesce(b.w, 0) AS wb FROM (SELECT x.source AS a, y.source AS b FROM (SELECT DISTINCT source FROM e WHERE source % 20 = 0) x, (SELECT DISTINCT source FROM e) y WHERE x.source <> y.source) p
CROSS JOIN (SELECT DISTINCT target FROM e) t LEFT JOIN e a ON a.source = p.a AND a.target = t.target LEFT JOIN e b ON b.source = p.b AND b.target = t.target""")
_METRICS = {
    "matching_index": "CAST(count(*) FILTER (wa > 0 AND wb > 0) AS DOUBLE) / count(*) FILTER (wa > 0 OR wb > 0)",
    "matching_index_synapses": "sum(CASE WHEN wa > 0 AND wb > 0 THEN wa + wb ELSE 0 END) / sum(wa + wb)",
    "matching_index_weighted_synapses": "sum(CASE WHEN wb > 0 THEN wa ELSE 0 END) / sum(wa) * (sum(CASE WHEN wa > 0 THEN wb ELSE 0 END) / sum(wb))",
    "cosine": "sum(wa * wb) / sqrt(sum(wa * wa) * sum(wb * wb))",
    "vertex": "sum(least(wa, wb) - 0.5 * greatest(wa, wb) * exp(-least(wa, wb)))",
    "vertex_normalized": "(sum(least(wa, wb) - 0.5 * greatest(wa, wb) * exp(-least(wa, wb))) - sum(-0.5 * greatest(wa, wb))) / (sum(greatest(wa, wb) - 0.5 * greatest(wa, wb) * exp(-greatest(wa, wb))) - sum(-0.5 * greatest(wa, wb)))",
}
for _m, _f in _METRICS.items():

    @query(f"similarity_{_m}", sql(f"SELECT a, b, round({_f}, 6) + 0.0 AS similarity FROM x GROUP BY 1, 2", "edges", **_DENSE))
    def _(s, d, m=_m):
        return rounded(N.connectivity_similarity(X.edges(s, d), m, queries=_queries(s, d)), 6)


_SCORES = "SELECT a AS query, b AS target, round(sum(wa * wb) / sqrt(sum(wa * wa) * sum(wb * wb)), 6) AS score FROM x GROUP BY 1, 2"


def _scores(s, d):
    t = N.connectivity_similarity(X.edges(s, d), "cosine", queries=_queries(s, d))
    return rounded(t.select(F.col("a").alias("query"), F.col("b").alias("target"), F.col("similarity").alias("score")), 6)


@query("top_n_matches", sql("SELECT query, target, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, target) AS rank FROM scores) WHERE rank <= 3", "edges", **_DENSE, scores=_SCORES))
def _(s, d):
    return N.top_n(_scores(s, d), 3)


@query("matches_above", sql("SELECT * FROM scores WHERE score >= 0.1", "edges", **_DENSE, scores=_SCORES))
def _(s, d):
    return N.matches_above(_scores(s, d), 0.1)


@query("matches_within", sql("""SELECT query, string_agg(CAST(target AS VARCHAR), ',' ORDER BY score DESC, target) AS matches, string_agg(format('{:.3f}', round(score, 3)), ',' ORDER BY score DESC, target) AS scores
FROM (SELECT *, max(score) OVER (PARTITION BY query) AS m FROM scores) WHERE score >= m - abs(m * 0.2) GROUP BY 1""", "edges", **_DENSE, scores="SELECT query, target, round(score, 3) AS score FROM (" + _SCORES + ")"))
def _(s, d):
    return N.matches_within(rounded(_scores(s, d), 3), 0.2)


@query("mutual_best", sql("""SELECT a.query, a.target, a.score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, target) AS r FROM scores) a JOIN (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, query) AS r FROM scores) b
ON a.query = b.query AND a.target = b.target AND a.r = 1 AND b.r = 1""", "edges", **_DENSE, scores=_SCORES))
def _(s, d):
    return N.mutual_best(_scores(s, d))


@query("bipartite_match")
def _(s, d):
    return N.bipartite_match(rounded(N.connectivity_similarity(X.edges(s, d), "cosine").select(F.col("a").alias("query"), F.col("b").alias("target"), F.col("similarity").alias("score")), 6), 0.01)


@query("rank_index", sql("""SELECT a, b, round(1 - sum(abs(ra - rb)) / (max(t) * max(t) // 2), 10) AS similarity FROM (SELECT x.a, x.b, x.target, ra.r AS ra, rb.r AS rb, count(*) OVER (PARTITION BY x.a, x.b) AS t
FROM x JOIN r ra ON ra.source = x.a AND ra.target = x.target JOIN r rb ON rb.source = x.b AND rb.target = x.target) GROUP BY 1, 2""", "edges", **_DENSE,
    g="SELECT s.source, t.target, coalesce(e.w, 0) AS w FROM (SELECT DISTINCT source FROM e) s CROSS JOIN (SELECT DISTINCT target FROM e) t LEFT JOIN e ON e.source = s.source AND e.target = t.target",
    r="SELECT source, target, rank() OVER (PARTITION BY source ORDER BY w) + (count(*) OVER (PARTITION BY source, w) - 1) / 2.0 AS r FROM g"))
def _(s, d):
    return rounded(N.connectivity_similarity(X.edges(s, d), "rank_index", queries=_queries(s, d)), 10)


_NB = "SELECT neuron AS a, neuron + 1 AS b  FROM (SELECT DISTINCT neuron FROM nodes)"


def _neighbours(s, d):
    return X.nodes(s, d).select(F.col("neuron").alias("a")).distinct().withColumn("b", F.col("a") + 1)


@query("cable_overlap", sql("""SELECT a, b, round(sum(l), 3) AS overlap FROM (SELECT p.a, p.b, q.pid, min_by(t.length, (sqrt((q.x-t.x)*(q.x-t.x)+(q.y-t.y)*(q.y-t.y)+(q.z-t.z)*(q.z-t.z)), t.pid)) AS l FROM pr p JOIN points q ON q.neuron = p.b JOIN points t ON t.neuron = p.a
AND sqrt((q.x-t.x)*(q.x-t.x)+(q.y-t.y)*(q.y-t.y)+(q.z-t.z)*(q.z-t.z)) < 150 GROUP BY 1, 2, 3) GROUP BY 1, 2""", "points", pr=_NB))
def _(s, d):
    return rounded(N.cable_overlap(X.points(s, d), _neighbours(s, d), 150.0), 3)


_SD = "sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z))"


@query("synapse_similarity", sql("""SELECT t.a, t.b, round(coalesce(s.s, 0) / t.n, 6) AS similarity FROM (SELECT p.a, p.b, count(*) AS n FROM pr p JOIN c ON c.neuron = p.a GROUP BY 1, 2) t
LEFT JOIN (SELECT m.a, m.b, sum(exp(-abs(x.n - y.n) / CAST(x.n + y.n AS DOUBLE)) * exp(-m.d * m.d / (2 * 200.0 * 200.0))) AS s FROM m JOIN n x ON x.sid = m.sid JOIN n y ON y.sid = m.tid GROUP BY 1, 2) s ON s.a = t.a AND s.b = t.b""", "connectors", pr=_NB,
    c="SELECT *, neuron * 100000 + node_id AS sid FROM connectors",
    n=f"SELECT p.sid, count(*) AS n FROM c p JOIN c q ON p.neuron = q.neuron AND p.type = q.type AND {_SD} <= 300 GROUP BY 1",
    m=f"SELECT pr.a, pr.b, p.sid, min({_SD}) AS d, min_by(q.sid, ({_SD}, q.sid)) AS tid FROM pr JOIN c p ON p.neuron = pr.a JOIN c q ON q.neuron = pr.b AND q.type = p.type GROUP BY 1, 2, 3"))
def _(s, d):
    c = X.connectors(s, d).withColumn("sid", F.col("neuron") * 100000 + F.col("node_id"))
    return rounded(N.synapse_similarity(c, _neighbours(s, d), 200.0, 300.0), 6)


# edges of a network whose nodes are both sources and targets
_NET = "SELECT source AS src, target % (SELECT max(source) FROM edges) AS target, weight FROM edges"


def _network(s, d):
    e = X.edges(s, d)
    return e.select("source", (F.col("target") % F.lit(e.agg(F.max("source")).first()[0])).alias("target"), "weight")


@query("traversal", sql("SELECT node, min(step) AS step FROM (SELECT 1 AS node, 1 AS step UNION ALL SELECT target, 2 FROM e WHERE src = 1 UNION ALL SELECT y.target, 3 FROM e x JOIN e y ON y.src = x.target WHERE x.src = 1 UNION ALL SELECT z.target, 4 FROM e x JOIN e y ON y.src = x.target JOIN e z ON z.src = y.target WHERE x.src = 1) GROUP BY 1", "edges",
    net=_NET, e="SELECT DISTINCT src, target FROM net WHERE weight >= 2"))
def _(s, d):
    t = N.traverse(_network(s, d), s.range(1, 2).withColumnRenamed("id", "node"), 4, min_w=0, max_w=2)
    return t.select("node", "step")


def _step(t):
    """SQL: cmf of every node at step t from the steps before it."""
    fired = " + ".join(f"(s.c{k} - {f's.c{k - 1}' if k > 1 else 0}) * (1 - pow(1 - e.p, {t - k}))" for k in range(1, t))
    own = ", ".join(f"s.c{k}" for k in range(1, t))
    return f"SELECT s.node, {own}, greatest(s.c{t - 1}, coalesce(g.g, 0)) AS c{t} FROM s{t - 1} s LEFT JOIN (SELECT e.target, 1 - product(1 - least(1.0, {fired})) AS g FROM s{t - 1} s JOIN e ON e.src = s.node GROUP BY 1) g ON g.target = s.node"


@query("bayesian_traversal", sql(" UNION ALL ".join(f"SELECT node, {k} AS step, round(c{k}, 6) AS cmf FROM s4" for k in range(1, 5)), "edges", net=_NET,
    e="SELECT src, target, least(1.0, sum(weight) / 8.0) AS p FROM net GROUP BY 1, 2", s1="SELECT node, CAST(node = 1 AS INT) * 1.0 AS c1 FROM (SELECT src AS node FROM e UNION SELECT target FROM e)", **{f"s{t}": _step(t) for t in (2, 3, 4)}))
def _(s, d):
    e = _network(s, d).groupBy("source", "target").agg(F.sum("weight").alias("weight"))
    return rounded(N.bayesian_traverse(e, s.range(1, 2).withColumnRenamed("id", "node"), 4, min_w=0, max_w=8), 6)
