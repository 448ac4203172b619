"""Operations on collections of neurons: one metadata row each, child tables by neuron."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_name(meta: DataFrame, pattern: str, column: str = "name") -> DataFrame:
    """Neurons whose whole name matches a regular expression."""
    return meta.filter(F.col(column).rlike(f"^(?:{pattern})$"))


def by_ids(df: DataFrame, ids: list, key: str = "neuron") -> DataFrame:
    return df.filter(F.col(key).isin(list(ids)))


def by_position(meta: DataFrame, start: int, stop: int, order: str = "neuron") -> DataFrame:
    """Rows [start, stop) in an order: a top list, then its end."""
    top = meta.orderBy(order).limit(stop)
    return top.withColumn("__n", F.row_number().over(Window.orderBy(order))).filter(F.col("__n") > start).drop("__n")


def sort_values(df: DataFrame, by: str, ascending: bool = False) -> DataFrame:
    """Descending unless told otherwise."""
    return df.orderBy(F.asc(by) if ascending else F.desc(by))


def remove_duplicates(df: DataFrame, keys: list[str], order: str, keep: str | bool = "first") -> DataFrame:
    """One row per key: the first or last in an order, or none of several (``keep`` False)."""
    w = Window.partitionBy(*keys)
    if keep is False:
        return df.withColumn("__n", F.count("*").over(w)).filter("__n = 1").drop("__n")
    return df.withColumn("__n", F.row_number().over(w.orderBy(F.asc(order) if keep == "first" else F.desc(order)))).filter("__n = 1").drop("__n")


def tail(meta: DataFrame, n: int = 5, order: str = "neuron") -> DataFrame:
    """The last ``n`` rows of an order."""
    return meta.orderBy(F.desc(order)).limit(n)


def sample(meta: DataFrame, n: int, seed: int = 0, key: str = "neuron") -> DataFrame:
    """``n`` rows by the order of a seeded hash of the key: the same ones for the same seed."""
    return meta.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def summarise(meta: DataFrame, columns: list[str], how: str = "mean", by: str | None = None) -> DataFrame:
    """Mean or sum of numeric columns, over all rows or by groups."""
    f = {"mean": F.avg, "sum": F.sum}[how]
    return meta.groupBy(*([by] if by else [])).agg(*(f(c).alias(c) for c in columns))


def unmix(df: DataFrame, column: str, kinds: list) -> dict:
    """A table for each kind of object of a mixed one."""
    return {k: df.filter(F.col(column) == k) for k in kinds}


def concat(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both; columns that one lacks are null."""
    return a.unionByName(b, allowMissingColumns=True)


def difference(a: DataFrame, b: DataFrame, key: str = "neuron") -> DataFrame:
    """Rows of a (repeats kept) whose key is not in b."""
    return a.join(b.select(key), key, "left_anti")


def intersection(a: DataFrame, b: DataFrame, key: str = "neuron") -> DataFrame:
    return a.join(b.select(key), key, "left_semi")


def union(a: DataFrame, b: DataFrame, key: str = "neuron") -> DataFrame:
    """a as it is, then what b has beyond it."""
    return concat(a, difference(b, a, key))


def add_metadata(meta: DataFrame, extra: DataFrame, key: str = "neuron", missing: str = "ignore") -> DataFrame:
    """Left join; ``missing='raise'`` fails where a neuron has no row."""
    out = meta.join(extra, key, "left")
    if missing == "raise" and not meta.join(extra, key, "left_anti").isEmpty():
        raise ValueError("some neurons have no metadata")
    return out


def combine(nodes: DataFrame, new_id: int) -> DataFrame:
    """All neurons' nodes as one neuron; node ids are numbered anew, links follow."""
    size = nodes.groupBy("neuron").agg(F.count("*").alias("__n"))  # a row a neuron: the running sum over them gives where each begins
    begin = size.select("neuron", F.coalesce(F.sum("__n").over(Window.orderBy("neuron").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    own = F.row_number().over(Window.partitionBy("neuron").orderBy("node_id"))
    at = nodes.withColumn("__r", own).join(begin, "neuron").withColumn("__new", (F.col("__b") + F.col("__r")).cast("long")).drop("__b", "__r")
    p = at.select("neuron", F.col("node_id").alias("parent_id"), F.col("__new").alias("__p"))
    t = at.join(p, ["neuron", "parent_id"], "left")
    return t.select(F.lit(new_id).cast("long").alias("neuron"), F.col("__new").alias("node_id"), F.coalesce("__p", F.lit(-1)).alias("parent_id"), *[c for c in nodes.columns if c not in ("neuron", "node_id", "parent_id")])


def swc_table(nodes: DataFrame) -> DataFrame:
    """Node tables as interchange rows: parents first, ids from 1, parents renumbered; label 5 branch, 6 end, else 0."""
    from .topology import classify_nodes

    t = classify_nodes(nodes)
    num = t.withColumn("no", F.row_number().over(Window.partitionBy("neuron").orderBy("parent_id", "node_id")).cast("long"))
    p = num.select("neuron", F.col("node_id").alias("parent_id"), F.col("no").alias("parent_no"))
    label = F.when(F.col("type") == "branch", 5).when(F.col("type") == "end", 6).otherwise(0)
    return num.join(p, ["neuron", "parent_id"], "left").select("neuron", F.col("no").alias("node_id"), label.alias("label"), "x", "y", "z", "radius", F.coalesce("parent_no", F.lit(-1)).alias("parent_id"))
