"""All queries of the library by name, each with the SQL that gives the same rows (where SQL can)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers fn(spark, sf_dir) under ``name``."""

    def wrap(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return wrap


def rounded(df: DataFrame, digits: int = 4, **own: int) -> DataFrame:
    """Doubles rounded, so that sums in another order are the same value; negative zeros become zeros."""
    return df.select(*(F.round(F.col(c), own.get(c, digits)).__add__(F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


from . import alignment_q, building_q, collections_q, connectivity_q, editing_q, geometry_q, meshes_q, morphometry_q, sources_q, topology_q  # noqa: E402, F401
