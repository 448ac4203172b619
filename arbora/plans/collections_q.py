"""Queries: collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collections as L
from . import fixtures as X
from .oracle import sql
from .registry import query, rounded

_META = "SELECT neuron, 'n' || neuron AS name, count(*) AS n_nodes, neuron % 7 AS grp FROM nodes GROUP BY 1"


def _meta(s, d):
    return X.nodes(s, d).groupBy("neuron").agg(F.count("*").alias("n_nodes")).select("neuron", F.concat(F.lit("n"), F.col("neuron").cast("string")).alias("name"), "n_nodes", (F.col("neuron") % 7).alias("grp"))


def _m(body):
    return sql(body, "nodes", m=_META)


@query("filter_by_name", _m("SELECT * FROM m WHERE regexp_full_match(name, 'n1[0-9]*')"))
def _(s, d):
    return L.by_name(_meta(s, d), "n1[0-9]*")


@query("filter_by_ids", _m("SELECT * FROM m WHERE neuron IN (1, 5, 9)"))
def _(s, d):
    return L.by_ids(_meta(s, d), [1, 5, 9])


@query("filter_by_position", _m("SELECT * FROM m ORDER BY neuron LIMIT 5 OFFSET 3"))
def _(s, d):
    return L.by_position(_meta(s, d), 3, 8)


@query("sort_values", _m("SELECT * FROM m ORDER BY n_nodes DESC"))
def _(s, d):
    return L.sort_values(_meta(s, d), "n_nodes")


for _k in ("first", "last", False):

    @query(f"remove_duplicates_{_k or 'none'}".lower(), _m({"first": "SELECT min(neuron) AS neuron, n_nodes FROM m GROUP BY 2", "last": "SELECT max(neuron) AS neuron, n_nodes FROM m GROUP BY 2", False: "SELECT min(neuron) AS neuron, n_nodes FROM m GROUP BY 2 HAVING count(*) = 1"}[_k]))
    def _(s, d, k=_k):
        return L.remove_duplicates(_meta(s, d), ["n_nodes"], "neuron", k).select("neuron", "n_nodes")


@query("tail", _m("SELECT * FROM m ORDER BY neuron DESC LIMIT 5"))
def _(s, d):
    return L.tail(_meta(s, d), 5)


@query("collection_mean", _m("SELECT grp, round(avg(n_nodes), 6) AS n_nodes, round(avg(neuron), 6) AS neuron FROM m GROUP BY 1"))
def _(s, d):
    return rounded(L.summarise(_meta(s, d), ["n_nodes", "neuron"], "mean", "grp"), 6)


@query("collection_sum", _m("SELECT CAST(sum(n_nodes) AS BIGINT) AS n_nodes FROM m"))
def _(s, d):
    return L.summarise(_meta(s, d), ["n_nodes"], "sum")


@query("unmix", sql("SELECT 'a' AS type, neuron, node_id FROM nodes WHERE neuron % 2 = 0 UNION ALL SELECT 'b', neuron, node_id FROM nodes WHERE neuron % 2 = 1", "nodes"))
def _(s, d):
    n = X.nodes(s, d)
    parts = L.unmix(n.withColumn("type", F.when(F.col("neuron") % 2 == 0, "a").otherwise("b")), "type", ["a", "b"])
    return parts["a"].select("type", "neuron", "node_id").union(parts["b"].select("type", "neuron", "node_id"))


@query("sample_fraction")
def _(s, d):
    return L.sample(_meta(s, d), 5, seed=1)


_A, _B = "neuron % 2 = 0", "neuron % 3 = 0"
for _name, _sql in (("collection_concat", f"SELECT * FROM m WHERE {_A} UNION ALL SELECT * FROM m WHERE {_B}"), ("collection_difference", f"SELECT * FROM m WHERE {_A} AND NOT {_B}"), ("collection_intersection", f"SELECT * FROM m WHERE {_A} AND {_B}"), ("collection_union", f"SELECT * FROM m WHERE {_A} OR {_B}")):

    @query(_name, _m(_sql))
    def _(s, d, name=_name):
        m = _meta(s, d)
        return {"collection_concat": L.concat, "collection_difference": L.difference, "collection_intersection": L.intersection, "collection_union": L.union}[name](m.filter(_A), m.filter(_B))


@query("add_metadata", _m("SELECT m.*, c_name FROM m LEFT JOIN (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0) c ON c.c_custkey = m.neuron"))
def _(s, d):
    c = X.table(s, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").cast("long").alias("neuron"), "c_name")
    return L.add_metadata(_meta(s, d), c)


@query("combine", sql("SELECT CAST(99 AS BIGINT) AS neuron, t.no AS node_id, coalesce(p.no, -1) AS parent_id FROM t LEFT JOIN t p ON p.neuron = t.neuron AND p.node_id = t.parent_id", "nodes", t="SELECT *, row_number() OVER (ORDER BY neuron, node_id) AS no FROM nodes"))
def _(s, d):
    return L.combine(X.nodes(s, d), 99).select("neuron", "node_id", "parent_id")


@query("swc_table", sql("""SELECT t.neuron, t.no AS node_id, CASE WHEN t.parent_id >= 0 AND t.kids > 1 THEN 5 WHEN t.parent_id >= 0 AND t.kids = 0 THEN 6 ELSE 0 END AS label, round(t.x, 7) AS x, coalesce(p.no, -1) AS parent_id FROM t LEFT JOIN t p ON p.neuron = t.neuron AND p.node_id = t.parent_id""", "tree",
    t="SELECT *, row_number() OVER (PARTITION BY neuron ORDER BY parent_id, node_id) AS no FROM tree"))
def _(s, d):
    return rounded(L.swc_table(X.nodes(s, d)).select("neuron", "node_id", "label", "x", "parent_id"), 7)
