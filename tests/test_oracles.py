"""Every bound query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tesserae.plans import bindings

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return round(float(v), 6) if hasattr(v, "__float__") else str(v)


@pytest.mark.parametrize("name", sorted(bindings.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = bindings.QUERIES[name](spark, SF)
    rel = duck.sql(bindings.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    key = lambda r: str(r)
    got = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=key)
    at = [rel.columns.index(c) for c in columns]
    expected = sorted([tuple(plain(r[k]) for k in at) for r in rel.fetchall()], key=key)
    assert got == expected
