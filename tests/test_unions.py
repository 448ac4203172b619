"""Parts of an object that come from several tables meet in one task, whatever adaptive execution merges."""

import contextlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from arbora.functions.tables import gathered
from arbora.operators.building import nearest_node
from arbora.operators.meshes import per_mesh
from arbora.operators.space import mesh_measures

#: Partitions of about a kilobyte, so that tables of different width are merged differently.
SMALL = {
    "spark.sql.shuffle.partitions": "64",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
}


@contextlib.contextmanager
def small_partitions(spark):
    was = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def tables(spark):
    """(wide, narrow): 500 objects each, both dealt by ``neuron``."""
    rows = spark.range(20_000).select((F.col("id") % 500).alias("neuron"), F.hash("id").cast("double").alias("x"))
    wide = rows.groupBy("neuron").agg(*(f("x").alias(f"{f.__name__}{i}") for i in range(4) for f in (F.min, F.max, F.avg)))
    return wide, rows.groupBy("neuron").agg(F.count("*").alias("n"))


def test_vertices_and_faces_of_a_mesh_meet(spark):
    wide, narrow = tables(spark)
    v = wide.select("neuron", F.explode(F.array(*(F.lit(i).cast("long") for i in range(3)))).alias("vid"), F.col("min0").alias("x"), F.col("max1").alias("y"), (F.col("avg2") + F.col("min3")).alias("z"))
    f = narrow.select("neuron", *(F.lit(i).cast("long").alias(f"v{i}") for i in range(3)))
    with small_partitions(spark):
        got = per_mesh(v, f, lambda m: pd.DataFrame({"n": [m.n], "faces": [len(m.faces)]}), "neuron long, n long, faces long").collect()
    assert len(got) == 500 and {(r.n, r.faces) for r in got} == {(3, 1)}


def test_points_meet_the_nodes_of_their_neuron(spark):
    wide, narrow = tables(spark)
    nodes = wide.select("neuron", F.lit(7).cast("long").alias("node_id"), F.col("min0").alias("x"), F.col("max1").alias("y"), (F.col("avg2") + F.col("max3")).alias("z"))
    spots = narrow.select("neuron", F.lit(1).cast("long").alias("pid"), *(F.col("n").cast("double").alias(c) for c in "xyz"))
    with small_partitions(spark):
        got = nearest_node(spots, nodes).collect()
    assert len(got) == 500 and {r.node_id for r in got} == {7}


def test_gathered_keeps_a_key_in_one_partition(spark):
    wide, narrow = tables(spark)
    both = wide.select("neuron", F.col("min0").alias("x")).union(narrow.select("neuron", F.col("n").cast("double")))
    with small_partitions(spark):
        got = gathered(both, "neuron").select("neuron", F.spark_partition_id().alias("p")).distinct().groupBy("neuron").count().toPandas()
    assert len(got) == 500 and np.all(got["count"] == 1)


def test_area_does_not_hang_on_the_order_of_faces(spark):
    # areas of thirds, which plain sums round differently from order to order
    own = np.random.default_rng(0).uniform(1e3, 1e7, 60) / 3
    faces = [(n, *(0.0,) * 3, *(float(2 * a), 0.0, 0.0), *(0.0, 1.0, 0.0)) for n in range(40) for a in np.random.default_rng(n).permutation(own)]
    t = spark.createDataFrame(faces, "neuron long, " + ", ".join(f"{k}{c} double" for k in "abc" for c in "xyz"))
    assert {r.area for r in mesh_measures(t.select("neuron"), t).collect()} == {math.fsum(own)}
