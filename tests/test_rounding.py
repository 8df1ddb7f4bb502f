"""Queries whose SQL compares or rounds at a tie, over rows that stand on it."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tesserae.plans import bindings


def both(spark, folder, name, rows):
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    kinds = [pa.int64()] * 4 + [pa.float64()] * 4
    pq.write_table(pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names), f"{folder}/lineitem.parquet")
    c = duckdb.connect()
    c.sql(f"create view lineitem as select * from '{folder}/lineitem.parquet'")
    df = bindings.QUERIES[name](spark, str(folder))
    rel = c.sql(bindings.ORACLES[name])
    at = [rel.columns.index(x) for x in df.columns]
    return sorted(map(tuple, df.collect())), sorted(tuple(r[k] for k in at) for r in rel.fetchall())


def test_share_of_inliers_at_the_limit(spark, tmp_path):
    rows = [(k, 1, 1, m, 1.0, 1.0, 0.0 if k < m * 55 // 100 else 0.09, 0.0) for m in (20, 100, 180, 200, 340) for k in range(m)]
    got, expected = both(spark, tmp_path, "f8_accepted_poses", rows)
    assert got == expected and all(r[1] for r in got)


def test_depths_halfway_between_cents(spark, tmp_path):
    rows = [(k, 1, p, 1, 10.0, 1005.0 + 10 * p + 5000 * k, 0.05, 0.0) for p in range(1, 60) for k in range(3)]
    got, expected = both(spark, tmp_path, "a6_fused_position", rows)
    assert got == expected
