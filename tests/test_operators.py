"""Operators against plain Python on small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import stats
from tesserae.operators import gates, geometry, graph, images, matching, spatial, surface, windows
from tesserae.sources import fixtures, sampling


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 4.0], [5.0, 1.0, 3.0], [4.0, 1.0, 2.0, 9.0], [None, 2.0]])
def test_medians(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    c = F.col("v")
    got = df.agg(stats.median_or(c, 0).alias("zero"), stats.median_or(c, float("inf")).alias("inf"), stats.median_or(c, None).alias("null"), stats.upper_median(c).alias("upper"), stats.lower_median(c).alias("lower"), stats.nearest_rank(c, 0.9).alias("p90"), stats.upper_quantile(c, 3, 4).alias("p75")).first()
    v = sorted(x for x in values if x is not None)
    if not v:
        assert (got["zero"], got["inf"], got["null"], got["upper"], got["lower"]) == (0, float("inf"), None, None, None)
        return
    assert got["null"] == got["zero"] == np.median(v) and got["upper"] == v[len(v) // 2] and got["lower"] == v[(len(v) - 1) // 2]
    assert got["p90"] == v[int((len(v) - 1) * 0.9 + 0.5)] and got["p75"] == v[3 * len(v) // 4]


def test_geometric_mean_with_a_zero(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 0.25), ("b", 1.0)], "g string, v double")
    assert {r.g: round(r.m, 9) for r in df.groupBy("g").agg(stats.geometric_mean(F.col("v")).alias("m")).collect()} == {"a": 0.0, "b": 0.5}


def test_duplicate_best_fails_the_ratio(spark):
    p = spark.createDataFrame([(0, 1, 1, 1, 2.0), (0, 1, 1, 2, 2.0), (0, 1, 2, 3, 1.0)], "frame_a int, frame_b int, a int, b int, distance double")
    assert [(r.a, r.b) for r in matching.ratio_matches(p, 0.9).collect()] == [(2, 3)]


def test_failed_mutual_check_uses_up_its_target(spark):
    rows = [(0, 1, 1, 7, 1.0), (0, 1, 2, 7, 2.0), (0, 1, 3, 7, 0.5), (0, 1, 3, 8, 0.1)]
    p = spark.createDataFrame(rows, "frame_a int, frame_b int, a int, b int, distance double")
    proposals = p.where("a in (1, 2) or b = 8")
    assert [(r.a, r.b) for r in matching.reverse_checked(proposals, p).collect()] == [(3, 8)]


def test_radius_join_meets_the_same_pairs_as_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(int(f), k, float(x), float(y), [1.0]) for k, (f, x, y) in enumerate(zip(rng.integers(0, 3, 90), rng.uniform(-50, 50, 90), rng.uniform(-50, 50, 90)))]
    f = spark.createDataFrame(rows, "frame int, id int, x double, y double, d array<double>")
    got = {(r.a, r.b) for r in matching.candidate_pairs(f, radius=12.0, dx=3.0, dy=-2.0).collect()}
    assert got == {(p[1], q[1]) for p in rows for q in rows if q[0] == p[0] + 1 and (q[2] - p[2] - 3) ** 2 + (q[3] - p[3] + 2) ** 2 <= 144}


def test_tracks_follow_chains(spark):
    m = spark.createDataFrame([(k, 10, k + 1, 10) for k in range(9)] + [(2, 5, 3, 6)], "frame_a int, a int, frame_b int, b int")
    got = {(r.frame, r.id): (r.root_frame, r.root) for r in graph.tracks(m).collect()}
    assert all(got[k, 10] == (0, 10) for k in range(10)) and got[3, 6] == (2, 5)


def test_identities_depend_on_inputs_and_refuse_circles():
    ops = {"a": ("decode", "x", []), "b": ("match", "y", ["a"])}
    first = graph.identities(ops)
    assert graph.identities(ops | {"a": ("decode", "z", [])})["b"] != first["b"]
    with pytest.raises(ValueError):
        graph.identities({"a": ("k", "", ["b"]), "b": ("k", "", ["a"])})


def test_budget_resets(spark):
    rows = [("u", k, s, w) for k, (s, w) in enumerate([(0.5, False), (0.5, False), (0.5, False), (1.0, False), (0.2, True), (1.2, False), (0.1, False)])]
    got = windows.budget_marks(spark.createDataFrame(rows, "u string, k int, s double, w boolean"), ["u"], "k", "s", "w", 1.25).first()
    assert got["at"] == [2, 6] and got["marks"] == 2


def test_mask_that_begins_with_foreground(spark):
    df = spark.createDataFrame([([0, 3, 2, 4],)], "m array<long>")
    got = df.select(spatial.mask_runs(F.col("m")).alias("r"), spatial.mask_area(F.col("m")).alias("a")).first()
    assert [(x["from"], x["to"]) for x in got.r] == [(0, 3), (5, 9)] and got.a == 7


def test_gates_name_the_first(spark):
    df = spark.createDataFrame([(1,), (5,), (9,)], "v int")
    g = gates.first_gate([("small", F.col("v") < 3), ("large", F.col("v") > 7), ("never", F.col("v") < 2)])
    assert [r.g for r in df.orderBy("v").select(g.alias("g")).collect()] == ["small", None, "large"]


def test_sampling_plan(spark):
    p = sampling.plan(spark.createDataFrame([(1.0,), (16.0,), (1000.0,)], "d double"), "d")
    assert [r.frames for r in p.orderBy("d").collect()] == [4, 18, 120]
    t = [r.requested_s for r in sampling.times(p.where("d = 16")).orderBy("frame_index").collect()]
    assert len(t) == 18 and abs(t[0] - 0.8) < 1e-9 and abs(t[-1] - 15.2) < 1e-9


def test_harris_and_nms_against_loops():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 256, (40, 50)).astype(np.int32)
    h = images.harris(y)
    r, c = 10, 12
    s = np.zeros(3)
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            gx, gy = y[r + dy, c + dx + 1] - y[r + dy, c + dx - 1], y[r + dy + 1, c + dx] - y[r + dy - 1, c + dx]
            s += [gx * gx, gy * gy, gx * gy]
    assert abs(h[r - 2, c - 2] - (s[0] * s[1] - s[2] ** 2 - 0.04 * (s[0] + s[1]) ** 2)) <= 1e-5 * abs(s[0] * s[1])
    px, py = rng.integers(0, 100, 400), rng.integers(0, 100, 400)
    keep = images.spread_out(px, py, 7, 50)
    chosen = []
    for k in range(400):
        if all((px[k] - px[j]) ** 2 + (py[k] - py[j]) ** 2 >= 49 for j in chosen):
            chosen.append(k)
        if len(chosen) == 50:
            break
    assert keep.tolist() == chosen


def test_two_view_and_resection_recover_the_truth():
    rng = np.random.default_rng(5)
    pts = np.c_[rng.uniform(-2, 2, 120), rng.uniform(-2, 2, 120), rng.uniform(4, 9, 120)]
    a = 0.08
    rot = np.array([[np.cos(a), 0, np.sin(a)], [0, 1, 0], [-np.sin(a), 0, np.cos(a)]])
    t = np.array([-0.6, 0.1, 0.2])
    one, two = pts[:, :2] / pts[:, 2:], (pts @ rot.T + t)[:, :2] / (pts @ rot.T + t)[:, 2:]
    two[:20] += rng.uniform(0.1, 0.3, (20, 2))  # wrong matches
    r, d, on = geometry.two_view(one, two, 1e-3)
    assert on.sum() >= 95 and np.abs(r - rot).max() < 1e-2 and d @ t / np.linalg.norm(t) > 0.999
    r, s = geometry.resect(pts[20:], two[20:])
    assert np.abs(r - rot).max() < 1e-6 and np.abs(s - t).max() < 1e-6
    k, q, m = geometry.similarity(pts, 2.5 * pts @ rot.T + t)
    assert abs(k - 2.5) < 1e-9 and np.abs(q - rot).max() < 1e-9 and np.abs(m - t).max() < 1e-9


def test_plane_of_tilted_points():
    rng = np.random.default_rng(1)
    p = rng.uniform(-1, 1, (200, 3))
    p[:, 2] = 0.5 * p[:, 0] + 2
    c, n, e = geometry.plane(p)
    assert abs(abs(n @ np.array([0.5, 0, -1]) / np.sqrt(1.25)) - 1) < 1e-9 and e < 1e-7


def test_landmarks_of_the_generated_clip_are_true(spark):
    from tesserae.plans import scenes

    got = scenes.f9_landmarks(spark, "").collect()
    truth = fixtures.scene()[:, :3]
    # corners lie within a few pixels of their point, so the nearest point is close for most landmarks
    off = [np.min(np.linalg.norm(truth - [r.x, r.y, r.z], axis=1)) for r in got]
    assert len(got) >= 40 and np.median(off) < 0.25


def test_triangle_gate_and_edges(spark):
    t = spark.createDataFrame([(0, 1, 2, 3), (1, 3, 2, 4), (2, 2, 3, 1)], "triangle_index long, a long, b long, c long")
    assert sorted(r.triangle_index for r in surface.distinct_triangles(t).collect()) == [0, 1]
    used = {(r.u, r.v): r.used for r in surface.edges(surface.distinct_triangles(t)).collect()}
    assert used[2, 3] == 2 and sum(v == 1 for v in used.values()) == 4
    d = spark.createDataFrame([(1.0, 1.0, 1.05, 20.0, 0.01), (1.0, 1.0, 1.5, 20.0, 0.01), (1.0, 1.0, 1.0, -1.0, 0.01), (1.0, 1.0, 1.0, 20.0, 9.0)], "a double, b double, c double, area double, edge double")
    g = surface.triangle_gate([F.col(x) for x in "abc"], F.col("area"), [F.col("edge"), F.col("edge") / 2], 4.0, 300.0)
    assert [r.g for r in d.select(g.alias("g")).collect()] == [None, "discontinuity", "degenerate", "discontinuity"]


def test_expand_goes_on_until_nothing_is_added(spark):
    from tesserae.operators import graph

    links = spark.createDataFrame([(k, k + 1) for k in range(1, 7)] + [(20, 21)], "a long, b long")
    got = graph.expand(spark.createDataFrame([(1,)], "node long"), links, 1)
    assert sorted((r.node, r.round) for r in got.collect()) == [(k, k - 1) for k in range(1, 8)]
