"""Expansion of all components, those that don't hold the first node too, against a search in breadth and the SQL."""

import duckdb

from tesserae.plans import bindings


def test_every_component_is_expanded(spark, tmp_path):
    links = [(1, 1), (1, 2), (2, 2), (3, 7), (4, 7), (4, 8), (9, 50), (None, 3), (5, None), (100060, 60)]
    links += [(20 + k, 200 + k + d) for k in range(8) for d in (0, 1)]  # a long way from 20
    spark.createDataFrame(links + links, "l_suppkey long, l_partkey long").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    ends = {}
    for a, b in links:
        if a is not None and b is not None and a != b + 100000:
            ends.setdefault(a, set()).add(b + 100000)
            ends.setdefault(b + 100000, set()).add(a)
    expected = {}
    for first in sorted(ends):
        if first not in expected:
            now, k = {first}, 0
            while now:
                expected |= {x: k for x in now}
                now, k = {y for x in now for y in ends[x]} - set(expected), k + 1
    got = [tuple(r) for r in bindings.QUERIES["g2_expansion"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(expected.items()) and max(expected.values()) == 15
    duck = duckdb.connect()
    duck.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(duck.sql(bindings.ORACLES["g2_expansion"]).fetchall()) == sorted(got)


def test_sql_has_no_last_round():
    duck = duckdb.connect()
    duck.sql("create table lineitem as select k + d as l_suppkey, k as l_partkey from range(1, 100) t(k), range(2) s(d)")
    assert duck.sql(f"select count(*), max(round) from ({bindings.ORACLES['g2_expansion']})").fetchall() == [(199, 198)]
