"""Overlaps by blocks of a cell against all pairs."""

import random

import numpy as np

from tesserae.operators import spatial


def test_blocks_of_a_cell_meet_once(spark, tmp_path, monkeypatch):
    r = random.Random(6)
    rows = [(k, x, x + r.choice([0.0, 0.5, 3.0, 9.0]), y, y + r.choice([0.0, 0.25, 5.0])) for k in range(400) for x, y in [(r.choice([r.uniform(-6, 6), r.randint(-6, 6)]), float(r.randint(-6, 6)))]]
    rows += [(500, 2.0, -3.0, 0.0, 1.0), (501, 1.0, None, 0.0, 1.0), (None, 0.0, 1.0, 0.0, 1.0), (7, 0.0, 1.0, 0.0, 1.0)]
    rectangles = spark.createDataFrame([(k, *[None if v is None else float(v) for v in row]) for k, *row in rows], "id long, x0 double, x1 double, y0 double, y1 double")
    for name, most in (("BLOCK", 40), ("AT_ONCE", 8), ("PAIRS", 100)):
        monkeypatch.setattr(spatial, name, most)
    meets = lambda p, q: None not in p + q and p[1] <= q[2] and q[1] <= p[2] and p[3] <= q[4] and q[3] <= p[4]
    expected = sorted((p[0], q[0]) for p in rows for q in rows if p[0] is not None and q[0] is not None and p[0] < q[0] and meets(p, q))
    assert sorted(map(tuple, spatial.overlapping(rectangles, 4.0).collect())) == expected


def test_a_block_meets_what_is_near_only(monkeypatch):
    """Rows far apart in y are never compared: the comparisons grow with the pairs, not with the square of a block."""
    n, compared, count = 2000, [], np.count_nonzero
    rows = {"id": np.arange(n), "x0": np.zeros(n), "x1": np.ones(n), "y0": np.arange(n) * 1.0, "y1": np.arange(n) + 1.5, "x_here": np.ones(n, bool), "y_here": np.ones(n, bool)}
    monkeypatch.setattr(spatial.np, "count_nonzero", lambda hit, axis: compared.append(hit.size) or count(hit, axis=axis))
    assert sum(len(x[2]) for x in spatial.met(rows, rows, True)) == n - 1
    assert sum(compared) < n * (spatial.AT_ONCE + 4)
