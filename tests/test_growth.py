"""Steps that grow with the tables: what is joined or dealt stays small, and the rows stay those of the direct form."""

import pytest

from tesserae.functions import sizing
from tesserae.operators import conform, meshes, spatial
from tesserae.plans import bindings, evidence, sheets  # noqa: F401


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_revisit_pairs_join_only_the_ends_of_segments(spark, tmp_path):
    rows = [(k, "s", k % 3 if k % 11 else None, 0.0) for k in range(1, 900)] + [(7, "s", 1, 0.0), (None, "s", 1, 0.0)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    got = bindings.QUERIES["k5_revisit_pairs"](spark, str(tmp_path))
    clips, expected = {}, []
    for k, _, clip, _ in rows:
        if clip is not None and k is not None:
            clips.setdefault(clip, []).append(k)
    for clip, frames in clips.items():
        pairs = [(f - t, f, t) for f in frames for t in frames if f % 2 == t % 2 and t > f + 1 and (f % 5 == 0 or t % 5 == 0)]
        expected += [(clip, f, t) for _, f, t in sorted(pairs)[:12]]
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    assert optimized(got).count("row_number() windowspecdefinition") >= 3


@pytest.mark.parametrize("name, dealt", [("f10_triangle_gates", 10), ("a8_vertex_normals", 8), ("j20_corner_regions", 3), ("g8_inside_edges", 8)])
def test_joins_are_dealt_by_the_input(spark, monkeypatch, name, dealt):
    run = lambda: bindings.QUERIES[name](spark, "/root/testdata/sf0.001")
    small = run()
    assert "Repartition" not in optimized(small)
    monkeypatch.setattr(sizing, "SHARE", 5_000)
    large = run()
    assert optimized(large).count("RepartitionByExpression") >= dealt
    assert sorted(map(str, large.collect())) == sorted(map(str, small.collect()))


def test_overlaps_of_one_full_cell_are_dealt(spark, tmp_path):
    rows = [(k, k % 5 / 4, k % 5 / 4 + k % 3 / 8, k % 7 / 4, k % 7 / 4 + 0.25) for k in range(200)] + [(900, None, 1.0, 0.0, 1.0)]
    spark.createDataFrame(rows, "id long, x0 double, x1 double, y0 double, y1 double").coalesce(1).write.parquet(str(tmp_path / "r"))
    got = spatial.overlapping(spark.read.parquet(str(tmp_path / "r")), 4.0)
    meets = lambda p, q: p[1] <= q[2] and q[1] <= p[2] and p[3] <= q[4] and q[3] <= p[4]
    assert sorted(map(tuple, got.collect())) == [(p[0], q[0]) for p in rows[:200] for q in rows[:200] if p[0] < q[0] and meets(p, q)]
    assert got.rdd.glom().map(len).filter(lambda n: n > 0).count() > 1


def test_shared_corners_are_dealt_by_the_input(spark, monkeypatch):
    run = lambda: bindings.QUERIES["g7_shared_vertices"](spark, "/root/testdata/sf0.001")
    small = run()
    monkeypatch.setattr(sizing, "SHARE", 5_000)
    large = run()
    dealt = lambda df: optimized(df).count("RepartitionByExpression")
    assert dealt(small) == 0 and dealt(large) >= 8  # two of the mesh, three joins of two sides
    assert sorted(map(str, large.collect())) == sorted(map(str, small.collect()))


def test_rounds_of_safe_moves_are_narrow(spark, monkeypatch):
    write, wide = meshes.materialise, {}

    def watched(df, name):
        wide[name] = max(wide.get(name, 0), len(df.columns))
        return write(df, name)

    monkeypatch.setattr(meshes, "materialise", watched)
    run = lambda: sorted(map(str, bindings.QUERIES["g9_safe_moves"](spark, "/root/testdata/sf0.001").collect()))
    small = run()
    assert "stopped" in wide and max(n for name, n in wide.items() if name not in ("moves", "holds")) <= 4  # no coordinates
    monkeypatch.setattr(sizing, "SHARE", 20_000)
    assert run() == small


def test_edges_are_dealt_to_few_cells(spark, monkeypatch):
    """On whole coordinates an edge of two cells is in two, and a long one is dealt to each cell once, without a shuffle to find that out."""
    places = [(0, 0.0, 0.0), (1, 2.0, 0.0), (2, 0.0, 2.0), (3, 60.0, 37.0), (4, 1.0, 0.0)]
    points = spark.createDataFrame([(i, x, y, 0.0) for i, x, y in places], "id long, x double, y double, z double")
    found = []
    monkeypatch.setattr(conform, "dealt", lambda df, n, *keys: (keys == ("cx", "cy", "cz") and found.append(df)) or df)
    for corners, most in (((0, 1, 2), 8), ((0, 1, 3), 2 + 2 * 100)):
        mesh = spark.createDataFrame([(1, *corners)], "tid long, a long, b long, c long")
        rows = [(x.u, x.v, x.w, x.t) for x in conform.on_edges(mesh, points, 1e-6, 2.0).collect()]
        assert (0, 1, 4, 0.5) in rows and len(rows) == 1
        cut = [tuple(x) for x in found.pop().collect()]
        assert len(cut) == len(set(cut)) <= most


def test_conformed_is_dealt_by_the_input(spark, monkeypatch):
    run = lambda: sorted(map(str, bindings.QUERIES["g8_conformed"](spark, "/root/testdata/sf0.001").collect()))
    small = run()
    spread, asked = conform.dealt, []
    monkeypatch.setattr(conform, "dealt", lambda df, n, *keys: asked.append(n) or spread(df, n, *keys))
    monkeypatch.setattr(sizing, "SHARE", 5_000)
    assert run() == small and len(asked) >= 6 and min(asked) >= sizing.WORTH
