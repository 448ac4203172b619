"""Every query of the library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from arbora.plans.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "orders", "customer"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    assert got
    if name in ORACLES:
        rel = con.sql(ORACLES[name])
        at = [rel.columns.index(c) for c in cols]
        assert sorted(rel.columns) == cols
        want = sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
        assert got == want
