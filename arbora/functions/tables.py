"""Shared column helpers for the long tables (nodes, connectors, points, vertices, faces, voxels, edges)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of each table; others are carried along where an operator keeps whole rows.
NODES = ("neuron", "node_id", "parent_id", "x", "y", "z", "radius", "label")
CONNECTORS = ("neuron", "connector_id", "node_id", "type", "x", "y", "z")
#: Names under which other tools write the same columns.
ALIASES = {
    "node_id": ("node_id", "treenode_id", "PointNo", "rowId"),
    "parent_id": ("parent_id", "parent", "Parent", "link"),
    "connector_id": ("connector_id", "id", "con_id"),
    "type": ("type", "relation", "label", "prepost", "cn_type"),
    "radius": ("radius", "Radius", "R", "W"),
}


def standardise(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Renames known aliases of the required columns; raises when one is missing. Extra columns stay."""
    have = set(df.columns)
    for name in required:
        if name not in have:
            for other in ALIASES.get(name, (name, name.upper(), name.capitalize())):
                if other in have:
                    df = df.withColumnRenamed(other, name)
                    break
            else:
                raise ValueError(f"column {name} is missing; there are {sorted(have)}")
    return df


def pre_post(col: str = "type") -> Column:
    """Connector types as 'pre' or 'post': 0/1 and upper-case names are understood."""
    c = F.lower(F.col(col).cast("string"))
    return F.when(c.isin("0", "pre", "presynapse"), "pre").when(c.isin("1", "post", "postsynapse"), "post").otherwise(c)


def distance(a: str = "", b: str = "p") -> Column:
    """Euclidean distance of (x, y, z) with suffix a and prefix b, e.g. x and px."""
    return F.sqrt(sum((F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in "xyz"))


def with_parent(nodes: DataFrame, *columns: str) -> DataFrame:
    """Child rows with the parent's columns under a leading p; roots get nulls. One equi-join on (neuron, node)."""
    parent = nodes.select("neuron", F.col("node_id").alias("parent_id"), *(F.col(c).alias(f"p{c}") for c in columns))
    return nodes.join(parent, ["neuron", "parent_id"], "left")


def gathered(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys in one task, also of a union.

    ``repartition`` by the bare keys is left out where all parts of a union are dealt by them already; adaptive execution then merges
    the small partitions of each part on its own, and rows of one key end in different tasks. By a hash of the keys the shuffle stays.
    """
    return df.repartition(F.xxhash64(*keys))


def per_neuron(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame | Iterator[pd.DataFrame]], schema: str, key: str = "neuron", order: tuple[str, ...] = ("node_id",), least: int = 0, union: bool = False) -> DataFrame:
    """Runs ``fn`` over runs of whole neurons: one shuffle by neuron, many neurons in each call.

    ``fn`` gets rows sorted by (neuron, *order) and must treat neurons apart; memory holds one batch and the neuron
    that is still open. ``least``: batches are put together until they hold that many rows, for steps with a price by the call.
    ``fn`` may also give frames one after another, where rows out are many more than rows in. ``union``: ``df`` puts several tables together (``gathered``).
    """

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some: list[pd.DataFrame] = []
        for b in batches:
            some.append(b)
            if sum(map(len, some)) >= least:
                yield pd.concat(some, ignore_index=True) if len(some) > 1 else b
                some = []
        if some:
            yield pd.concat(some, ignore_index=True)

    def given(whole: pd.DataFrame) -> Iterator[pd.DataFrame]:
        out = fn(whole)
        for piece in (out,) if isinstance(out, pd.DataFrame) else out:
            if len(piece):
                yield piece

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in joined(batches):
            if not len(b):
                continue
            last = b[key].iloc[-1]
            cut = int((b[key] != last).to_numpy().nonzero()[0].max(initial=-1)) + 1
            if cut == 0 and (not held or held[-1][key].iloc[-1] == last):
                held.append(b)
                continue
            whole = pd.concat([*held, b.iloc[:cut]], ignore_index=True) if held else b.iloc[:cut].reset_index(drop=True)
            if len(whole):
                yield from given(whole)
            held = [b.iloc[cut:]]
        if held:
            yield from given(pd.concat(held, ignore_index=True))

    return (gathered(df, key) if union else df.repartition(key)).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def _shared(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets its own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="arbora-checkpoints-"))
    return sc.getCheckpointDir()


def fresh(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    import uuid

    return f"{_shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """A checkpoint of ``df`` in the shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: made once, however often it is read."""
    path = fresh(df.sparkSession, "written")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
