"""Queries: edits of whole neurons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import editing as E
from ..operators import topology as T
from . import fixtures as X
from .geometry_q import _thousandths
from .oracle import sql
from .registry import query, rounded


@query("smooth_skeleton", sql("""SELECT p.neuron, p.node_id, CAST(floor(coalesce(max(s.x), max(p.x)) * 1000 + 0.31415) AS BIGINT) AS x FROM nodes p LEFT JOIN (SELECT a.neuron, a.node_id, avg(b.x) AS x FROM c a JOIN c b ON b.neuron = a.neuron AND b.segment = a.segment AND abs(b.pos - a.pos) <= least(2, a.pos, a.n - a.pos) WHERE a.pos > 0 AND a.pos < a.n GROUP BY 1, 2) s
ON s.neuron = p.neuron AND s.node_id = p.node_id GROUP BY 1, 2""", "seg",
    c="SELECT s.neuron, s.segment, a.a AS node_id, a.hops AS pos, e.hops AS n, t.x FROM seg s JOIN anc e ON e.neuron = s.neuron AND e.node_id = s.segment AND e.a = s.top JOIN anc a ON a.neuron = s.neuron AND a.node_id = s.segment AND a.hops <= e.hops JOIN nodes t ON t.neuron = a.neuron AND t.node_id = a.a"))
def _(s, d):
    return _thousandths(E.smooth_skeleton(X.nodes(s, d), 5).select("neuron", "node_id", "x"), "x")


@query("features", sql("""SELECT b.neuron, b.num_nodes, b.n_branches, b.num_tips, round(b.total_length, 3) AS total_length, round(r.p, 3) AS max_path_length, round(u.e, 3) AS max_euclidean_distance FROM
(SELECT neuron, count(*) AS num_nodes, count(*) FILTER (parent_id >= 0 AND kids > 1) AS n_branches, count(*) FILTER (parent_id >= 0 AND kids = 0) AS num_tips, sum(d) AS total_length FROM tree GROUP BY 1) b
JOIN (SELECT neuron, max(dist) AS p FROM root GROUP BY 1) r ON r.neuron = b.neuron JOIN (SELECT n.neuron, max(sqrt((n.x-o.x)*(n.x-o.x)+(n.y-o.y)*(n.y-o.y)+(n.z-o.z)*(n.z-o.z))) AS e FROM nodes n JOIN nodes o ON o.neuron = n.neuron AND o.parent_id < 0 GROUP BY 1) u ON u.neuron = b.neuron""", "root"))
def _(s, d):
    return rounded(E.features(X.nodes(s, d)).select("neuron", "num_nodes", "n_branches", "num_tips", "total_length", "max_path_length", "max_euclidean_distance"), 3)


@query("heal", sql("SELECT neuron, CAST(1 AS BIGINT) AS roots, count(*) AS n FROM nodes WHERE node_id % 7 <> 0 GROUP BY 1", "nodes"))
def _(s, d):
    n = X.nodes(s, d)
    h = E.heal(T.subset(n, n.filter("node_id % 7 <> 0")))
    return h.groupBy("neuron").agg(F.count_if(F.col("parent_id") < 0).alias("roots"), F.count("*").alias("n"))


@query("drop_nodes", sql("SELECT neuron, count(*) - CAST(round(count(*) * 0.1) AS BIGINT) AS n FROM nodes GROUP BY 1", "nodes"))
def _(s, d):
    return E.drop_nodes(X.nodes(s, d)).groupBy("neuron").agg(F.count("*").alias("n"))


@query("despike")
def _(s, d):
    return rounded(E.despike(X.nodes(s, d)).select("neuron", "node_id", "x", "y", "z"))


@query("guess_radius")
def _(s, d):
    known = X.nodes(s, d).withColumn("radius", F.when(F.col("node_id") % 4 == 0, F.col("radius")).otherwise(-1.0))
    beside = X.connectors(s, d).withColumns({"x": F.col("x") + F.col("node_id") % 13, "y": F.col("y") + 2.5})
    return rounded(E.guess_radius(known, beside).select("neuron", "node_id", "radius"))


@query("average_skeletons")
def _(s, d):
    return rounded(E.average(X.nodes(s, d), 1, 300.0).select("node_id", "x", "y", "z"))


@query("split_axon_dendrite")
def _(s, d):
    return E.split_axon_dendrite(X.nodes(s, d), X.connectors(s, d))
