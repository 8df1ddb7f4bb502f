"""Shuffles get more partitions as the input files grow, and the same rows."""

import pytest

from tesserae.functions import sizing
from tesserae.plans import bindings


@pytest.mark.parametrize("name", ["r2_grid_mesh", "g8_boundary_edges"])
def test_grid_shuffles_follow_the_input(spark, monkeypatch, name):
    run = lambda: bindings.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    small = run()
    assert "Repartition" not in plan(small)
    monkeypatch.setattr(sizing, "SHARE", 10_000)
    large = run()
    n = sizing.partitions(large)
    assert n > 4 and plan(large).count(f", {n}") >= 2
    assert sorted(map(tuple, large.collect())) == sorted(map(tuple, small.collect()))
