"""Queries: trees as graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import topology as T
from . import fixtures as X
from .morphometry_q import _strahler_sql
from .oracle import sql
from .registry import query, rounded


def _few(nodes, expr):
    return nodes.filter(expr).select("neuron", "node_id")


def _links(df):
    return df.select("neuron", "node_id", "parent_id")


def _pairs(nodes):
    """Pairs (n, 2n) of node ids within each neuron."""
    a = nodes.select("neuron", F.col("node_id").alias("a"))
    b = nodes.select("neuron", F.col("node_id").alias("b"))
    return a.join(b, "neuron").filter("b = 2 * a")


@query("classify_nodes", sql("SELECT neuron, node_id, CASE WHEN parent_id < 0 THEN 'root' WHEN kids = 0 THEN 'end' WHEN kids = 1 THEN 'slab' ELSE 'branch' END AS type FROM tree", "tree"))
def _(s, d):
    return T.classify_nodes(X.nodes(s, d)).select("neuron", "node_id", "type")


@query("connected_components", sql("""SELECT r.neuron, r.node_id, c.component FROM root r JOIN (SELECT neuron, root, CAST(row_number() OVER (PARTITION BY neuron ORDER BY n DESC, low) - 1 AS BIGINT) AS component
  FROM (SELECT neuron, root, count(*) AS n, min(node_id) AS low FROM root GROUP BY 1, 2)) c ON c.neuron = r.neuron AND c.root = r.root""", "root"))
def _(s, d):
    return T.connected_components(X.nodes(s, d))


@query("components_after_filter", sql("""SELECT r.neuron, r.node_id, c.component FROM r JOIN (SELECT neuron, root, CAST(row_number() OVER (PARTITION BY neuron ORDER BY n DESC, low) - 1 AS BIGINT) AS component
  FROM (SELECT neuron, root, count(*) AS n, min(node_id) AS low FROM r GROUP BY 1, 2)) c ON c.neuron = r.neuron AND c.root = r.root""", "nodes",
    k="SELECT n.neuron, n.node_id, CASE WHEN p.node_id IS NULL THEN -1 ELSE n.parent_id END AS parent_id FROM nodes n LEFT JOIN nodes p ON p.neuron = n.neuron AND p.node_id = n.parent_id AND p.node_id % 7 <> 0 WHERE n.node_id % 7 <> 0",
    up="SELECT neuron, node_id, node_id AS a, parent_id AS up FROM k UNION ALL SELECT u.neuron, u.node_id, k.node_id, k.parent_id FROM up u JOIN k ON k.neuron = u.neuron AND k.node_id = u.up WHERE u.up >= 0",
    r="SELECT neuron, node_id, a AS root FROM up WHERE up < 0"))
def _(s, d):
    n = X.nodes(s, d)
    return T.connected_components(T.subset(n, _few(n, "node_id % 7 <> 0")))


@query("drop_fluff", sql("""SELECT k.neuron, k.node_id, k.parent_id FROM r JOIN k ON k.neuron = r.neuron AND k.node_id = r.node_id JOIN (SELECT neuron, root FROM r GROUP BY 1, 2 HAVING count(*) >= 10) c ON c.neuron = r.neuron AND c.root = r.root""", "nodes",
    k="SELECT n.neuron, n.node_id, CASE WHEN p.node_id IS NULL THEN -1 ELSE n.parent_id END AS parent_id FROM nodes n LEFT JOIN nodes p ON p.neuron = n.neuron AND p.node_id = n.parent_id AND p.node_id % 7 <> 0 WHERE n.node_id % 7 <> 0",
    up="SELECT neuron, node_id, node_id AS a, parent_id AS up FROM k UNION ALL SELECT u.neuron, u.node_id, k.node_id, k.parent_id FROM up u JOIN k ON k.neuron = u.neuron AND k.node_id = u.up WHERE u.up >= 0",
    r="SELECT neuron, node_id, a AS root FROM up WHERE up < 0"))
def _(s, d):
    n = X.nodes(s, d)
    return _links(T.drop_fluff(T.subset(n, _few(n, "node_id % 7 <> 0")), min_size=10))


@query("child_lists", sql("SELECT n.neuron, n.node_id, coalesce(array_to_string(list_sort(list(c.node_id) FILTER (c.node_id IS NOT NULL)), ','), '') AS children FROM nodes n LEFT JOIN nodes c ON c.neuron = n.neuron AND c.parent_id = n.node_id GROUP BY 1, 2", "nodes"))
def _(s, d):
    return T.child_lists(X.nodes(s, d)).withColumn("children", F.array_join(F.col("children").cast("array<string>"), ","))


@query("tangents", sql("SELECT neuron, pid, round(x, 7) AS x, round(y, 7) AS y, round(z, 7) AS z, round(vx, 4) + 0.0 AS vx, round(vy, 4) + 0.0 AS vy, round(vz, 4) + 0.0 AS vz, round(length, 4) AS length FROM points", "points"))
def _(s, d):
    return rounded(T.tangents(X.nodes(s, d)), 4, x=7, y=7, z=7)


@query("skeleton_edges", sql("SELECT neuron, node_id - 1 AS child, parent_id - 1 AS parent FROM nodes WHERE parent_id >= 0", "nodes"))
def _(s, d):
    return T.skeleton_edges(X.nodes(s, d))


@query("node_label_sorting", sql("""SELECT t.neuron, t.node_id, CAST(row_number() OVER (PARTITION BY t.neuron ORDER BY k.key) - 1 AS BIGINT) AS position FROM tree t JOIN keys k ON k.neuron = t.neuron AND k.node_id = t.node_id""", "far", "below",
    deep="SELECT a.neuron, a.a AS node_id, max(r.depth) AS deep FROM anc a JOIN root r ON r.neuron = a.neuron AND r.node_id = a.node_id GROUP BY 1, 2",
    rank="SELECT t.neuron, t.node_id, t.parent_id, row_number() OVER (PARTITION BY t.neuron, t.parent_id ORDER BY d.deep DESC, t.node_id) AS r FROM tree t JOIN deep d ON d.neuron = t.neuron AND d.node_id = t.node_id",
    keys="SELECT a.neuron, a.node_id, list(r.r ORDER BY a.hops DESC) AS key FROM anc a JOIN rank r ON r.neuron = a.neuron AND r.node_id = a.a GROUP BY 1, 2"))
def _(s, d):
    return T.node_label_sorting(X.nodes(s, d))


_LCA = """SELECT p.neuron, p.a, p.b, min(x.dist + y.dist) AS dist FROM pairs p JOIN anc x ON x.neuron = p.neuron AND x.node_id = p.a JOIN anc y ON y.neuron = p.neuron AND y.node_id = p.b AND y.a = x.a GROUP BY 1, 2, 3"""
_PAIR = "SELECT a.neuron, a.node_id AS a, b.node_id AS b FROM nodes a JOIN nodes b ON b.neuron = a.neuron AND b.node_id = 2 * a.node_id"


@query("dist_between", sql("SELECT neuron, a, b, round(dist, 4) AS dist FROM q", "anc", pairs=_PAIR, q=_LCA))
def _(s, d):
    n = X.nodes(s, d)
    return rounded(T.dist_between(n, _pairs(n)))


@query("geodesic_matrix", sql("SELECT neuron, a, b, round(dist, 4) AS dist FROM q", "anc", pairs="SELECT a.neuron, a.node_id AS a, b.node_id AS b FROM nodes a JOIN nodes b ON b.neuron = a.neuron WHERE a.node_id % 10 = 0 AND b.node_id % 15 = 0", q=_LCA))
def _(s, d):
    n = X.nodes(s, d)
    return rounded(T.geodesic_matrix(n, _few(n, "node_id % 10 = 0"), _few(n, "node_id % 15 = 0")))


@query("geodesic_matrix_directed", sql("SELECT p.neuron, p.a, p.b, round(x.dist, 4) AS dist FROM pairs p JOIN anc x ON x.neuron = p.neuron AND x.node_id = p.a AND x.a = p.b", "anc", pairs="SELECT a.neuron, a.node_id AS a, b.node_id AS b FROM nodes a JOIN nodes b ON b.neuron = a.neuron WHERE b.node_id % 15 = 0"))
def _(s, d):
    n = X.nodes(s, d)
    return rounded(T.geodesic_matrix(n, None, _few(n, "node_id % 15 = 0"), finite=True, directed=True))


@query("distal_to", sql("SELECT p.neuron, p.a, p.b, bool_or(x.a = p.b) AS distal FROM pairs p JOIN anc x ON x.neuron = p.neuron AND x.node_id = p.a GROUP BY 1, 2, 3", "anc", pairs="SELECT a.neuron, b.node_id AS a, a.node_id AS b FROM nodes a JOIN nodes b ON b.neuron = a.neuron AND b.node_id = 2 * a.node_id"))
def _(s, d):
    n = X.nodes(s, d)
    return T.distal_to(n, _pairs(n).select("neuron", F.col("b").alias("a"), F.col("a").alias("b")))


@query("connecting_nodes", sql("""SELECT b.neuron, b.node_id FROM cnt b JOIN root r ON r.neuron = b.neuron AND r.node_id = b.node_id JOIN cnt w ON w.neuron = r.neuron AND w.node_id = r.root
LEFT JOIN (SELECT t.neuron, t.parent_id, max(c.n) AS m FROM tree t JOIN cnt c ON c.neuron = t.neuron AND c.node_id = t.node_id GROUP BY 1, 2) k ON k.neuron = b.neuron AND k.parent_id = b.node_id
WHERE b.n > 0 AND (b.n < w.n OR coalesce(k.m, 0) < w.n)""", "root", cnt="SELECT neuron, a AS node_id, count(*) FILTER (node_id % 40 = 0) AS n FROM anc GROUP BY 1, 2"))
def _(s, d):
    n = X.nodes(s, d)
    return T.connecting_nodes(n, _few(n, "node_id % 40 = 0"))


@query("subset", sql("SELECT n.neuron, n.node_id, CASE WHEN n.parent_id % 3 = 0 AND n.parent_id >= 0 OR n.parent_id < 0 THEN -1 ELSE n.parent_id END AS parent_id, n.x FROM nodes n WHERE node_id % 3 <> 0", "nodes"))
def _(s, d):
    n = X.nodes(s, d)
    return T.subset(n, _few(n, "node_id % 3 <> 0")).select("neuron", "node_id", "parent_id", "x")


@query("merge_subset", sql("SELECT neuron, node_id, CASE WHEN node_id % 4 = 0 THEN radius * 2 ELSE radius END AS radius FROM nodes", "nodes"))
def _(s, d):
    n = X.nodes(s, d)
    return T.merge_subset(n, n.filter("node_id % 4 = 0").withColumn("radius", F.col("radius") * 2)).select("neuron", "node_id", "radius")


_RANK = dict(len_="SELECT p.neuron, p.leaf, p.at, r.dist FROM path p JOIN root r ON r.neuron = p.neuron AND r.node_id = p.at",
    plen="""SELECT l.neuron, l.leaf, max(l.dist) - min(coalesce(q.dist, l.dist)) AS len FROM len_ l JOIN nodes n ON n.neuron = l.neuron AND n.node_id = l.at LEFT JOIN root q ON q.neuron = l.neuron AND q.node_id = n.parent_id GROUP BY 1, 2""",
    prank="SELECT neuron, leaf, row_number() OVER (PARTITION BY neuron ORDER BY len DESC, leaf) - 1 AS r FROM plen",
    nrank="SELECT p.neuron, p.at AS node_id, k.r FROM path p JOIN prank k ON k.neuron = p.neuron AND k.leaf = p.leaf")


@query("longest_neurite", sql("SELECT n.neuron, n.node_id, CASE WHEN p.r < 3 THEN n.parent_id ELSE -1 END AS parent_id FROM nodes n JOIN nrank k ON k.neuron = n.neuron AND k.node_id = n.node_id AND k.r < 3 LEFT JOIN nrank p ON p.neuron = n.neuron AND p.node_id = n.parent_id", "path", "root", **_RANK))
def _(s, d):
    return _links(T.longest_neurite(X.nodes(s, d), 3))


@query("find_main_branchpoint", sql("SELECT n.neuron, p.node_id FROM nodes n JOIN nrank k ON k.neuron = n.neuron AND k.node_id = n.node_id AND k.r = 1 JOIN nrank p ON p.neuron = n.neuron AND p.node_id = n.parent_id AND p.r <> 1", "path", "root", **_RANK))
def _(s, d):
    return T.find_main_branchpoint(X.nodes(s, d))


@query("cell_body_fiber", sql("SELECT DISTINCT n.neuron, n.node_id, n.parent_id FROM main m JOIN anc a ON a.neuron = m.neuron AND a.node_id = m.node_id JOIN nodes n ON n.neuron = a.neuron AND n.node_id = a.a", "path", "root", **_RANK,
    main="SELECT n.neuron, p.node_id FROM nodes n JOIN nrank k ON k.neuron = n.neuron AND k.node_id = n.node_id AND k.r = 1 JOIN nrank p ON p.neuron = n.neuron AND p.node_id = n.parent_id AND p.r <> 1"))
def _(s, d):
    return _links(T.cell_body_fiber(X.nodes(s, d)))


@query("split_neurites", sql("""SELECT a.neuron, a.node_id, CAST(coalesce(min_by(c.r, a.hops), 0) AS BIGINT) AS piece FROM anc a LEFT JOIN tops c ON c.neuron = a.neuron AND c.node_id = a.a GROUP BY 1, 2""", "path", "root", **_RANK,
    tops="SELECT n.neuron, n.node_id, k.r FROM nodes n JOIN nrank k ON k.neuron = n.neuron AND k.node_id = n.node_id AND k.r IN (1, 2) JOIN nrank p ON p.neuron = n.neuron AND p.node_id = n.parent_id AND p.r <> k.r"))
def _(s, d):
    return T.split_neurites(X.nodes(s, d), 3)


@query("prune_twigs", sql("""SELECT n.neuron, n.node_id, n.parent_id FROM nodes n LEFT JOIN gone g ON g.neuron = n.neuron AND g.node_id = n.node_id WHERE g.node_id IS NULL""", "seg",
    gone="""SELECT DISTINCT a.neuron, a.a AS node_id FROM seg s JOIN tree f ON f.neuron = s.neuron AND f.node_id = s.segment AND f.kids = 0 JOIN tree t ON t.neuron = s.neuron AND t.node_id = s.top AND t.kids > 1
JOIN anc e ON e.neuron = s.neuron AND e.node_id = s.segment AND e.a = s.top JOIN anc a ON a.neuron = s.neuron AND a.node_id = s.segment AND a.hops < e.hops WHERE s.length < 500"""))
def _(s, d):
    return _links(T.prune_twigs(X.nodes(s, d), 500.0))


@query("prune_at_depth", sql("SELECT n.neuron, n.node_id, n.parent_id FROM nodes n JOIN root r ON r.neuron = n.neuron AND r.node_id = n.node_id WHERE r.dist <= 2000", "root"))
def _(s, d):
    return _links(T.prune_at_depth(X.nodes(s, d), 2000.0))


@query("reroot", sql("""SELECT n.neuron, n.node_id, CASE WHEN n.node_id = 50 THEN -1 WHEN w.a IS NOT NULL THEN w.before ELSE n.parent_id END AS parent_id FROM nodes n
LEFT JOIN (SELECT neuron, a, lag(a) OVER (PARTITION BY neuron ORDER BY hops) AS before FROM anc WHERE node_id = 50) w ON w.neuron = n.neuron AND w.a = n.node_id""", "anc"))
def _(s, d):
    n = X.nodes(s, d)
    return _links(T.reroot(n, _few(n, "node_id = 50")))


@query("cut", sql("""SELECT neuron, node_id, CASE WHEN node_id IN (20, 45) OR parent_id < 0 THEN -1 ELSE parent_id END AS parent_id, piece FROM p
UNION ALL SELECT n.neuron, n.node_id, n.parent_id, q.piece FROM nodes n JOIN p q ON q.neuron = n.neuron AND q.node_id = n.parent_id WHERE n.node_id IN (20, 45)""", "anc",
    p="SELECT a.neuron, a.node_id, n.parent_id, coalesce(min_by(a.a, a.hops) FILTER (a.a IN (20, 45)), -1) AS piece FROM anc a JOIN nodes n ON n.neuron = a.neuron AND n.node_id = a.node_id GROUP BY 1, 2, 3"))
def _(s, d):
    n = X.nodes(s, d)
    return T.cut(n, _few(n, "node_id IN (20, 45)")).select("neuron", "node_id", "parent_id", "piece")


@query("remove_nodes", sql("SELECT a.neuron, a.node_id, coalesce(min_by(a.a, a.hops) FILTER (a.hops > 0 AND a.a % 5 <> 0), -1) AS parent_id FROM anc a WHERE a.node_id % 5 <> 0 GROUP BY 1, 2", "anc"))
def _(s, d):
    n = X.nodes(s, d)
    return _links(T.remove_nodes(n, _few(n, "node_id % 5 = 0")))


@query("insert_nodes", sql("""SELECT neuron, node_id, CASE WHEN new IS NOT NULL THEN new ELSE parent_id END AS parent_id, round(x, 7) AS x FROM e
UNION ALL SELECT neuron, new, parent_id, round((x + px) / 2, 7) FROM e WHERE new IS NOT NULL""", "tree",
    e="""SELECT t.*, CASE WHEN node_id % 11 = 0 THEN max(node_id) OVER (PARTITION BY neuron) + row_number() OVER (PARTITION BY neuron, node_id % 11 = 0 ORDER BY node_id) END AS new FROM tree t"""))
def _(s, d):
    n = X.nodes(s, d)
    return rounded(T.insert_nodes(n, _few(n, "node_id % 11 = 0")).select("neuron", "node_id", "parent_id", "x"), 7)


@query("collapse_nodes", sql("""SELECT neuron, CASE WHEN node_id IN (4, 5, 7) THEN 4 ELSE node_id END AS node_id, coalesce(max(CASE WHEN parent_id >= 0 AND (CASE WHEN parent_id IN (4, 5, 7) THEN 4 ELSE parent_id END) <> (CASE WHEN node_id IN (4, 5, 7) THEN 4 ELSE node_id END)
  THEN CASE WHEN parent_id IN (4, 5, 7) THEN 4 ELSE parent_id END END), -1) AS parent_id FROM nodes GROUP BY 1, 2""".replace("GROUP BY 1, 2", "GROUP BY neuron, CASE WHEN node_id IN (4, 5, 7) THEN 4 ELSE node_id END"), "nodes"))
def _(s, d):
    n = X.nodes(s, d)
    return _links(T.collapse_nodes(n, _few(n, "node_id IN (4, 5, 7)").withColumn("target", F.lit(4).cast("long"))))


@query("health_check", sql("""SELECT neuron, CAST(0 AS BIGINT) AS duplicate_ids, CAST(sum(n - 1) AS BIGINT) AS duplicate_places, CAST(0 AS BIGINT) AS missing_parents, CAST(1 AS BIGINT) AS roots FROM (SELECT neuron, x, y, z, count(*) AS n FROM nodes GROUP BY 1, 2, 3, 4) GROUP BY 1""", "nodes"))
def _(s, d):
    return T.health_check(X.nodes(s, d))


@query("merge_duplicate_nodes", sql("SELECT neuron, count(*) AS n FROM (SELECT DISTINCT neuron, round(x, -1), y, round(z, -3) FROM nodes) GROUP BY 1", "nodes"))
def _(s, d):
    n = X.nodes(s, d).withColumns({"x": F.round("x", -1), "z": F.round("z", -3)})
    return T.merge_duplicate_nodes(n).groupBy("neuron").agg(F.count("*").alias("n"))


@query("simplify_graph", sql("SELECT neuron, segment AS source, top AS target, round(length, 4) AS length FROM seg", "seg"))
def _(s, d):
    return rounded(T.simplify_graph(X.nodes(s, d)))


@query("edges_to_forest", sql("SELECT neuron, node_id, parent_id FROM nodes", "nodes"))
def _(s, d):
    n = X.nodes(s, d)
    return T.edges_to_forest(n.filter("parent_id >= 0").select("neuron", F.col("node_id").alias("a"), F.col("parent_id").alias("b")), _few(n, "parent_id < 0"))


@query("geodesic_clusters")
def _(s, d):
    return T.geodesic_clusters(X.nodes(s, d), 1000.0)


@query("propagate_labels")
def _(s, d):
    n = X.nodes(s, d)
    return T.propagate_labels(n, n.filter("node_id % 50 = 1").select("neuron", "node_id", F.col("label")), max_iter=200)


@query("prune_by_strahler", _strahler_sql().replace("SELECT neuron, node_id, si AS strahler_index FROM s23", "SELECT neuron, node_id, parent_id FROM s23 WHERE si <> 1"))
def _(s, d):
    return _links(T.prune_by_strahler(X.nodes(s, d), [1]))
