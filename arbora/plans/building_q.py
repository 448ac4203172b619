"""Queries: directed points, somata, compartments, pruning, volumes, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import building as B
from . import fixtures as X
from .geometry_q import _BOX, boxes
from .oracle import sql
from .registry import query, rounded

_D2 = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)"


# the three eigenvalues of a symmetric matrix in closed form
@query("make_dotprops", sql("""SELECT neuron, pid, round(3 * q, 3) AS spread, round(CASE WHEN p > 0 THEN (2 * l1 + l3 - 3 * q) / (3 * q) ELSE 0 END, 3) + 0.0 AS alpha FROM (SELECT *, q + 2 * p * cos(phi) AS l1, q + 2 * p * cos(phi + 2 * pi() / 3) AS l3 FROM w)""", "nodes",
    near=f"SELECT * FROM (SELECT a.neuron, a.node_id AS pid, b.x, b.y, b.z, row_number() OVER (PARTITION BY a.neuron, a.node_id ORDER BY {_D2}, b.node_id) AS r FROM nodes a JOIN nodes b ON b.neuron = a.neuron) WHERE r <= 20",
    m="SELECT neuron, pid, covar_pop(x, x) * count(*) AS xx, covar_pop(y, y) * count(*) AS yy, covar_pop(z, z) * count(*) AS zz, covar_pop(x, y) * count(*) AS xy, covar_pop(x, z) * count(*) AS xz, covar_pop(y, z) * count(*) AS yz FROM near GROUP BY 1, 2",
    c="SELECT *, (xx + yy + zz) / 3 AS q, xy * xy + xz * xz + yz * yz AS o FROM m",
    d="SELECT *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * o) / 6) AS p FROM c",
    w="""SELECT *, acos(greatest(-1, least(1, CASE WHEN p > 0 THEN ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p) ELSE 0 END))) / 3 AS phi FROM d"""))
def _(s, d):
    return rounded(B.make_dotprops(X.nodes(s, d)).select("neuron", "pid", "spread", "alpha"), 3)


_SPOTS = "SELECT neuron, node_id AS pid, x + 3.25 AS x, y - 1.5 AS y, z + 7.125 AS z FROM nodes WHERE node_id % 4 = 0"


@query("snap", sql(f"SELECT a.neuron, a.pid, min_by(b.node_id, ({_D2}, b.node_id)) AS node_id, round(sqrt(min({_D2})), 5) AS dist FROM p a JOIN nodes b ON b.neuron = a.neuron GROUP BY 1, 2", "nodes", p=_SPOTS))
def _(s, d):
    n = X.nodes(s, d)
    spots = n.filter("node_id % 4 = 0").select("neuron", F.col("node_id").alias("pid"), (F.col("x") + 3.25).alias("x"), (F.col("y") - 1.5).alias("y"), (F.col("z") + 7.125).alias("z"))
    return rounded(B.nearest_node(spots, n), 5)


_CORNERS = "SELECT neuron, CAST(v AS BIGINT) AS pid, CASE WHEN v % 2 = 0 THEN x0 ELSE x1 END AS x, CASE WHEN v // 2 % 2 = 0 THEN y0 ELSE y1 END AS y, CASE WHEN v < 4 THEN z0 ELSE z1 END AS z FROM bx CROSS JOIN (SELECT unnest(range(8)) AS v)"


@query("match_mesh_skeleton", sql(f"SELECT a.neuron, a.pid, min_by(b.node_id, ({_D2}, b.node_id)) AS node_id, round(sqrt(min({_D2})), 5) AS dist FROM p a JOIN nodes b ON b.neuron = a.neuron GROUP BY 1, 2", "nodes", bx=_BOX, p=_CORNERS))
def _(s, d):
    v, _ = boxes(s, d)
    return rounded(B.nearest_node(v, X.nodes(s, d), "vid"), 5)


@query("find_soma", sql(f"""SELECT c.neuron, min_by(c.node_id, (-c.radius, c.node_id)) AS soma FROM (SELECT neuron, min_by(node_id, (-score, node_id)) AS best FROM (SELECT a.neuron, a.node_id, round(avg(b.radius), 9) AS score FROM k a JOIN k b ON b.neuron = a.neuron AND {_D2} <= 9 * a.radius * a.radius GROUP BY 1, 2) GROUP BY 1) m
JOIN k a ON a.neuron = m.neuron AND a.node_id = m.best JOIN k c ON c.neuron = a.neuron AND (a.x-c.x)*(a.x-c.x)+(a.y-c.y)*(a.y-c.y)+(a.z-c.z)*(a.z-c.z) <= 9 * a.radius * a.radius GROUP BY 1""", "nodes", k="SELECT * FROM nodes WHERE radius >= 40"))
def _(s, d):
    return B.find_soma(X.nodes(s, d), 40.0)


# the largest piece of nodes with the label; each is named by its topmost node, the last reached over labelled ancestors
@query("find_soma_label", sql("""SELECT n.neuron, min_by(n.node_id, (round((n.x-m.x)*(n.x-m.x)+(n.y-m.y)*(n.y-m.y)+(n.z-m.z)*(n.z-m.z), 6), n.node_id)) AS soma FROM piece n
JOIN (SELECT neuron, min_by(top, (-n, low)) AS top FROM (SELECT neuron, top, count(*) AS n, min(node_id) AS low FROM piece GROUP BY 1, 2) GROUP BY 1) big ON big.neuron = n.neuron AND big.top = n.top
JOIN (SELECT neuron, top, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM piece GROUP BY 1, 2) m ON m.neuron = n.neuron AND m.top = n.top GROUP BY 1""", "nodes",
    marked="SELECT * FROM nodes WHERE label = 'R'",
    up="SELECT neuron, node_id, node_id AS top FROM marked UNION ALL SELECT u.neuron, u.node_id, p.node_id FROM up u JOIN marked c ON c.neuron = u.neuron AND c.node_id = u.top JOIN marked p ON p.neuron = c.neuron AND p.node_id = c.parent_id",
    piece="SELECT m.*, t.top FROM marked m JOIN (SELECT neuron, node_id, max_by(top, n) AS top FROM (SELECT u.*, CASE WHEN EXISTS (SELECT 1 FROM marked c JOIN marked p ON p.neuron = c.neuron AND p.node_id = c.parent_id WHERE c.neuron = u.neuron AND c.node_id = u.top) THEN 0 ELSE 1 END AS n FROM up u) GROUP BY 1, 2) t ON t.neuron = m.neuron AND t.node_id = m.node_id"))
def _(s, d):
    return B.find_soma(X.nodes(s, d), label="R")


@query("soma_features", sql("SELECT r.neuron, r.radius AS soma_radius, round(4 * pi() * r.radius * r.radius, 4) AS soma_surface, r.kids AS num_stems FROM tree r WHERE r.parent_id < 0", "tree"))
def _(s, d):
    return rounded(B.soma_features(X.nodes(s, d)), 4)


for _label in ("A", "N", "R"):

    @query(f"compartment_features_{_label.lower()}", sql(f"""SELECT neuron, count(*) AS num_nodes, round(sum(CASE WHEN plabel = label THEN d ELSE 0 END), 3) AS total_length, CAST(count(*) FILTER (parent_id = 1) AS BIGINT) AS num_stems, round(greatest(min(e) FILTER (plabel IS DISTINCT FROM label) - max(sr), 0), 3) AS exit_distance,
round(min_by(theta, (e, node_id)) FILTER (plabel IS DISTINCT FROM label), 4) + 0.0 AS exit_theta FROM t GROUP BY 1""", "tree",
        t=f"SELECT t.*, p.label AS plabel, s.radius AS sr, sqrt((t.x-s.x)*(t.x-s.x)+(t.y-s.y)*(t.y-s.y)+(t.z-s.z)*(t.z-s.z)) AS e, atan2(t.y - s.y, t.x - s.x) AS theta FROM tree t JOIN tree s ON s.neuron = t.neuron AND s.node_id = 1 LEFT JOIN tree p ON p.neuron = t.neuron AND p.node_id = t.parent_id WHERE t.label = '{_label}'"))
    def _(s, d, label=_label):
        t = B.compartment_features(X.nodes(s, d), label)
        return t.select("neuron", "num_nodes", "num_stems", *((F.round(c, k) + 0.0).alias(c) for c, k in (("total_length", 3), ("exit_distance", 3), ("exit_theta", 4))))


@query("prune_distal_to", sql("SELECT neuron, node_id, parent_id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM anc a WHERE a.neuron = n.neuron AND a.node_id = n.node_id AND a.hops > 0 AND a.a % 20 = 0)", "anc"))
def _(s, d):
    n = X.nodes(s, d)
    return B.prune(n, n.filter("node_id % 20 = 0").select("neuron", "node_id")).select("neuron", "node_id", "parent_id")


@query("prune_proximal_to", sql("SELECT n.neuron, n.node_id, CASE WHEN n.node_id = 20 THEN -1 ELSE n.parent_id END AS parent_id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes m WHERE m.neuron = n.neuron AND m.node_id = 20) OR EXISTS (SELECT 1 FROM anc a WHERE a.neuron = n.neuron AND a.node_id = n.node_id AND a.a = 20)", "anc"))
def _(s, d):
    n = X.nodes(s, d)
    return B.prune(n, n.filter("node_id = 20").select("neuron", "node_id"), "proximal").select("neuron", "node_id", "parent_id")


# the roots of odd neurons get a descendant as their parent
@query("is_acyclic", sql("SELECT n.neuron, n.neuron % 2 = 0 OR max(n.node_id) < 5 AS acyclic, CASE WHEN n.neuron % 2 = 0 OR max(n.node_id) < 5 THEN 0 ELSE (SELECT CAST(count(*) AS BIGINT) FROM anc a WHERE a.neuron = n.neuron AND a.node_id = 5) END AS n_cyclic FROM nodes n GROUP BY 1", "anc"))
def _(s, d):
    n = X.nodes(s, d)
    return B.is_acyclic(n.withColumn("parent_id", F.when((F.col("node_id") == 1) & (F.col("neuron") % 2 == 1), 5).otherwise(F.col("parent_id"))))


@query("chunks")
def _(s, d):
    return B.chunks(X.nodes(s, d), 25)


_IN = "SELECT b.neuron AS volume, n.neuron, n.node_id, n.x FROM nodes n JOIN b ON n.x > b.x0 AND n.x < b.x1 AND n.y > b.y0 AND n.y < b.y1 AND n.z > b.z0 AND n.z < b.z1"
_SHRUNK = "SELECT neuron, x0 + 300.003 AS x0, x1 - 300.003 AS x1, y0 + 50.503 AS y0, y1 - 50.507 AS y1, z0 + 20.501 AS z0, z1 - 20.509 AS z1 FROM (" + _BOX + ") WHERE neuron % 20 = 0"


def _volumes(s, d):
    """Overlapping boxes: the volumes of every twentieth neuron."""
    v, f = boxes(s, d)
    low = lambda bit: F.col("vid").bitwiseAND(bit) == 0
    v = v.filter("neuron % 20 = 0").withColumns({c: F.when(low(bit), F.col(c) + a).otherwise(F.col(c) - b) for c, bit, a, b in (("x", 1, 300.003, 300.003), ("y", 2, 50.503, 50.507), ("z", 4, 20.501, 20.509))})
    return v, f.filter("neuron % 20 = 0")


@query("in_volumes", sql("SELECT volume, neuron, node_id FROM i", "nodes", b=_SHRUNK, i=_IN))
def _(s, d):
    return B.in_volumes(X.nodes(s, d), *_volumes(s, d)).select("volume", "neuron", "node_id")


@query("intersection_matrix", sql("SELECT volume, neuron, round(sum(x), 4) AS value FROM i GROUP BY 1, 2", "nodes", b=_SHRUNK, i=_IN))
def _(s, d):
    return rounded(B.intersection_matrix(X.nodes(s, d), *_volumes(s, d), value="x"), 4)


@query("prune_by_volume", sql("SELECT n.neuron, n.node_id, CASE WHEN EXISTS (SELECT 1 FROM i WHERE i.neuron = n.neuron AND i.node_id = n.parent_id) THEN n.parent_id ELSE -1 END AS parent_id FROM nodes n WHERE EXISTS (SELECT 1 FROM i WHERE i.neuron = n.neuron AND i.node_id = n.node_id)", "nodes", b=_SHRUNK, i=_IN))
def _(s, d):
    return B.prune_by_volume(X.nodes(s, d), *_volumes(s, d)).select("neuron", "node_id", "parent_id")


@query("sample_surface")
def _(s, d):
    return rounded(B.sample_surface(*boxes(s, d), 40), 6)


@query("align_pca")
def _(s, d):
    return rounded(B.align_pca(X.nodes(s, d).select("neuron", "node_id", "x", "y", "z")), 4)


@query("warp")
def _(s, d):
    return B.warp(X.nodes(s, d).select("neuron", "node_id", "x", "y", "z"), seed=3)


@query("rewire", sql("SELECT neuron, node_id, parent_id FROM nodes", "nodes"))
def _(s, d):
    n = X.nodes(s, d)
    lost = n.withColumn("parent_id", F.lit(-1).cast("long"))
    links = n.filter("parent_id >= 0").select("neuron", F.col("node_id").alias("a"), F.col("parent_id").alias("b"))
    return B.rewire(lost, links, n.filter("parent_id < 0").select("neuron", "node_id")).select("neuron", "node_id", "parent_id")


@query("components_of_links", sql("SELECT CAST(id AS BIGINT) AS id, CAST(min(root) AS BIGINT) AS component FROM (SELECT neuron * 10000 + node_id AS id, neuron * 10000 + root AS root FROM root) GROUP BY 1", "root"))
def _(s, d):
    n = X.nodes(s, d).filter("parent_id >= 0")
    return B.components_of_links(n.select((F.col("neuron") * 10000 + F.col("node_id")).alias("a"), (F.col("neuron") * 10000 + F.col("parent_id")).alias("b")))
