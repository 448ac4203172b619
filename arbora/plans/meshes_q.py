"""Queries: surfaces of voxels, skeletons of meshes and voxels, bridges, decimation, openness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grids as R
from ..operators import meshes as M
from ..operators import space as G
from ..operators import surfaces as S
from . import fixtures as X
from .oracle import sql
from .registry import query, rounded

#: Blobs: the voxels of the fixture, four to one along each axis.
_BLOBS = "SELECT neuron, i // 4 AS i, j // 4 AS j, k // 4 AS k FROM voxels GROUP BY ALL"
_SIZE = (2.0, 3.0, 5.0)


def blobs(s, d):
    return G.voxel_downscale(X.voxels(s, d), 4).select("neuron", *"ijk")


def surface(s, d, method="cubes", **options):
    return M.voxels_to_mesh(blobs(s, d), method, _SIZE, **options)


# a filled voxel and an empty neighbour: (axis, lower voxel of the two)
_CROSS = """SELECT b.neuron, o.axis, b.i + least(o.a, 0) AS i, b.j + least(o.b, 0) AS j, b.k + least(o.c, 0) AS k
FROM b, (VALUES (0, 1, 0, 0), (0, -1, 0, 0), (1, 0, 1, 0), (1, 0, -1, 0), (2, 0, 0, 1), (2, 0, 0, -1)) o(axis, a, b, c)
WHERE NOT EXISTS (SELECT 1 FROM b n WHERE n.neuron = b.neuron AND n.i = b.i + o.a AND n.j = b.j + o.b AND n.k = b.k + o.c)"""
_HALF = "CASE WHEN axis = {} THEN 1.0 ELSE 0.5 END"


@query("voxels2mesh", sql(f"SELECT neuron, CAST((i + {_HALF.format(0)}) * 2 AS DOUBLE) AS x, CAST((j + {_HALF.format(1)}) * 3 AS DOUBLE) AS y, CAST((k + {_HALF.format(2)}) * 5 AS DOUBLE) AS z FROM c", "voxels", b=_BLOBS, c=_CROSS))
def _(s, d):
    return surface(s, d)[0].select("neuron", "x", "y", "z")


# a closed surface with V vertices and Euler number 2 chi has 2 (V - 2 chi) faces; chi counts voxels, pairs, squares and cubes;
# the surface also closes the ring of six voxels of a cube whose two empty corners are opposite
_CHI = """SELECT b.neuron, sum(1 - px - py - pz + pxy + pyz + pxz - pxyz) AS chi FROM (SELECT b.*,
CAST(x.i IS NOT NULL AS INT) AS px, CAST(y.i IS NOT NULL AS INT) AS py, CAST(z.i IS NOT NULL AS INT) AS pz,
CAST(x.i IS NOT NULL AND y.i IS NOT NULL AND xy.i IS NOT NULL AS INT) AS pxy, CAST(y.i IS NOT NULL AND z.i IS NOT NULL AND yz.i IS NOT NULL AS INT) AS pyz,
CAST(x.i IS NOT NULL AND z.i IS NOT NULL AND xz.i IS NOT NULL AS INT) AS pxz,
CAST(x.i IS NOT NULL AND y.i IS NOT NULL AND z.i IS NOT NULL AND xy.i IS NOT NULL AND yz.i IS NOT NULL AND xz.i IS NOT NULL AND xyz.i IS NOT NULL AS INT) AS pxyz
FROM b """ + " ".join(f"LEFT JOIN b {n} ON {n}.neuron = b.neuron AND {n}.i = b.i + {a} AND {n}.j = b.j + {b} AND {n}.k = b.k + {c}" for n, a, b, c in (("x", 1, 0, 0), ("y", 0, 1, 0), ("z", 0, 0, 1), ("xy", 1, 1, 0), ("yz", 0, 1, 1), ("xz", 1, 0, 1), ("xyz", 1, 1, 1))) + ") b GROUP BY 1"

_RING = """SELECT neuron, count(*) AS n FROM (SELECT neuron, i - o.a AS i, j - p.b AS j, k - q.c AS k, sum(1 << CAST(o.a + 2 * p.b + 4 * q.c AS INT)) AS mask
FROM b, (SELECT unnest(range(2)) AS a) o, (SELECT unnest(range(2)) AS b) p, (SELECT unnest(range(2)) AS c) q GROUP BY 1, 2, 3, 4) WHERE mask IN (126, 189, 219, 231) GROUP BY 1"""


@query("voxels2mesh_faces", sql("SELECT v.neuron, CAST(2 * (v.n - 2 * chi) AS BIGINT) AS n_faces, CAST(3 * (v.n - 2 * chi) AS BIGINT) AS n_edges, CAST(0 AS BIGINT) AS open_edges FROM (SELECT neuron, count(*) AS n FROM c GROUP BY 1) v JOIN chi USING (neuron)", "voxels", b=_BLOBS, c=_CROSS, solid=_CHI, ring=_RING, chi="SELECT neuron, solid.chi + coalesce(n, 0) AS chi FROM solid LEFT JOIN ring USING (neuron)"))
def _(s, d):
    f = surface(s, d)[1]
    e = M.edges(f).groupBy("neuron").agg(F.count("*").alias("n_edges"), F.count_if(F.col("n") != 2).alias("open_edges"))
    return f.groupBy("neuron").agg(F.count("*").alias("n_faces")).join(e, "neuron")


@query("voxels2mesh_blocks", sql("SELECT b.neuron, CAST(count(*) * 30 AS DOUBLE) AS volume, CAST(min(n) AS BIGINT) AS n_faces, CAST(min(a) AS DOUBLE) AS area FROM b JOIN (SELECT neuron, 2 * count(*) AS n, sum(CASE axis WHEN 0 THEN 15 WHEN 1 THEN 10 ELSE 6 END) AS a FROM c GROUP BY 1) s USING (neuron) GROUP BY 1", "voxels", b=_BLOBS, c=_CROSS))
def _(s, d):
    return rounded(G.mesh_measures(*surface(s, d, "blocks", corners=True)), 4)


# each crossing lies in four cubes; a cube's vertex is their mean
@query("voxels2mesh_nets", sql(f"""SELECT neuron, round(avg(x) * 2, 6) AS x, round(avg(y) * 3, 6) AS y, round(avg(z) * 5, 6) AS z FROM (
SELECT neuron, i + {_HALF.format(0)} AS x, j + {_HALF.format(1)} AS y, k + {_HALF.format(2)} AS z,
i - CASE WHEN axis = 0 THEN 0 ELSE u END AS ci, j - CASE axis WHEN 0 THEN u WHEN 1 THEN 0 ELSE w END AS cj, k - CASE WHEN axis = 2 THEN 0 ELSE w END AS ck
FROM c, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(u, w)) GROUP BY neuron, ci, cj, ck""", "voxels", b=_BLOBS, c=_CROSS))
def _(s, d):
    return rounded(surface(s, d, "nets")[0].select("neuron", "x", "y", "z"), 6)


@query("mesh2skeleton")
def _(s, d):
    return rounded(M.mesh_to_skeleton(*surface(s, d))[0], 6)


# every vertex has a node
@query("mesh2skeleton_map", sql(f"SELECT neuron, count(*) AS n_vertices, CAST(count(*) AS BIGINT) AS n_mapped FROM c GROUP BY 1", "voxels", b=_BLOBS, c=_CROSS))
def _(s, d):
    v, f = surface(s, d)
    nodes, of = M.mesh_to_skeleton(v, f)
    known = of.join(nodes.select("neuron", "node_id"), ["neuron", "node_id"]).groupBy("neuron").agg(F.count("*").alias("n_mapped"))
    return v.groupBy("neuron").agg(F.count("*").alias("n_vertices")).join(known, "neuron")


@query("voxels2skeleton")
def _(s, d):
    return rounded(M.voxels_to_skeleton(blobs(s, d), _SIZE)[0], 6)


@query("mesh_components")
def _(s, d):
    return M.mesh_components(*surface(s, d))


# fragments are as many as links and one, once all are joined
@query("heal_mesh")
def _(s, d):
    return rounded(M.heal_mesh(*surface(s, d)), 6)


# half the faces, still closed, and as many holes and parts as before
@query("simplify_mesh", sql("SELECT neuron, CAST(2 * chi AS BIGINT) AS euler, CAST(0 AS BIGINT) AS open_edges, true AS fewer FROM chi", "voxels", b=_BLOBS, solid=_CHI, ring=_RING, chi="SELECT neuron, solid.chi + coalesce(n, 0) AS chi FROM solid LEFT JOIN ring USING (neuron)"))
def _(s, d):
    v, f = surface(s, d)
    new, tri, _ = S.simplify_mesh(v, f, 0.6)
    e = M.edges(tri).groupBy("neuron").agg(F.count("*").alias("e"), F.count_if(F.col("n") != 2).alias("open_edges"))
    t = new.groupBy("neuron").agg(F.count("*").alias("v")).join(e, "neuron").join(tri.groupBy("neuron").agg(F.count("*").alias("f")), "neuron")
    t = t.join(f.groupBy("neuron").agg(F.count("*").alias("was")), "neuron")
    return t.select("neuron", (F.col("v") - F.col("e") + F.col("f")).alias("euler"), "open_edges", (F.col("f") <= 0.75 * F.col("was")).alias("fewer"))


@query("openness")
def _(s, d):
    return rounded(S.openness(*surface(s, d)), 6)


# a surface with every tenth vertex' faces cut out is closed again
@query("fill_holes", sql("SELECT DISTINCT neuron, CAST(0 AS BIGINT) AS unbalanced FROM voxels", "voxels"))
def _(s, d):
    v, f = surface(s, d)
    cut = f.filter("NOT (v0 % 10 = 0 OR v1 % 10 = 0 OR v2 % 10 = 0)")
    e = F.explode(F.array(*(F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"), F.when(F.col(p) < F.col(q), 1).otherwise(-1).alias("n")) for p, q in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))))).alias("e")
    ways = S.fill_holes(v, cut).select("neuron", e).groupBy("neuron", "e.a", "e.b").agg(F.sum("e.n").alias("n")).groupBy("neuron").agg(F.count_if(F.col("n") != 0).alias("unbalanced"))
    return f.select("neuron").distinct().join(ways, "neuron", "left").select("neuron", F.coalesce("unbalanced", F.lit(0).cast("long")).alias("unbalanced"))


@query("drop_internals")
def _(s, d):
    return S.drop_internals(*surface(s, d))[1]


# cells of the bounding box that are empty and linked to no cell outside of it
@query("fill_cavities", sql("""SELECT neuron, i, j, k FROM b UNION SELECT e.neuron, e.i, e.j, e.k FROM e WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.neuron = e.neuron AND r.i = e.i AND r.j = e.j AND r.k = e.k)""", "voxels", b=_BLOBS,
    box="SELECT neuron, min(i) - 1 AS i0, max(i) + 1 AS i1, min(j) - 1 AS j0, max(j) + 1 AS j1, min(k) - 1 AS k0, max(k) + 1 AS k1 FROM b GROUP BY 1",
    e="SELECT * FROM (SELECT neuron, unnest(range(i0, i1 + 1)) AS i, j0, j1, k0, k1 FROM box), LATERAL (SELECT unnest(range(j0, j1 + 1)) AS j), LATERAL (SELECT unnest(range(k0, k1 + 1)) AS k) WHERE (neuron, i, j, k) NOT IN (SELECT neuron, i, j, k FROM b)",
    reach="""SELECT neuron, i0 AS i, j0 AS j, k0 AS k FROM box UNION SELECT e.neuron, e.i, e.j, e.k FROM reach r, (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) o(a, b, c), e
WHERE e.neuron = r.neuron AND e.i = r.i + o.a AND e.j = r.j + o.b AND e.k = r.k + o.c"""))
def _(s, d):
    return R.fill_cavities(blobs(s, d))


@query("thin_voxels")
def _(s, d):
    return R.thin_voxels(blobs(s, d))


@query("thin_skeleton")
def _(s, d):
    return rounded(R.thin_skeleton(blobs(s, d), _SIZE), 6)


@query("voxel_surface_area", sql("SELECT b.neuron, CAST(min(a) AS DOUBLE) AS area, CAST(30 * count(*) AS DOUBLE) AS volume FROM b JOIN (SELECT neuron, sum(CASE axis WHEN 0 THEN 15 WHEN 1 THEN 10 ELSE 6 END) AS a FROM c GROUP BY 1) s USING (neuron) GROUP BY 1", "voxels", b=_BLOBS, c=_CROSS))
def _(s, d):
    return R.surface_area(blobs(s, d), _SIZE)


@query("voxel_normalize", sql("SELECT v.neuron, i, j, k, round(value / m, 9) AS value FROM voxels v JOIN (SELECT neuron, max(value) AS m FROM voxels GROUP BY 1) m ON m.neuron = v.neuron", "voxels"))
def _(s, d):
    v = X.voxels(s, d)
    return rounded(R.normalize(v.withColumn("value", F.col("value").cast("double"))), 9)
