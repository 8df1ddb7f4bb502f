"""Readers, artifacts, objects, depth and cameras."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import dense, objects
from tesserae.sources import artifacts, fixtures, sparse_text


def test_sparse_text(spark, tmp_path):
    (tmp_path / "cameras.txt").write_text("# c\n1 PINHOLE 640 480 520 520 320 240\n\n")
    (tmp_path / "images.txt").write_text("# i\n1 1 0 0 0 0.5 0 0 1 a b.png\n10 20 7 11.5 21 -1\n# note\n2 1 0 0 0 0 0 0 1 c.png\n\n3 1 0 0 0 0 0 0 1 d.png")
    (tmp_path / "points3D.txt").write_text("7 1 2 3 10 20 30 0.5 1 0 2 4\n")
    c = sparse_text.cameras(spark, str(tmp_path)).first()
    assert (c.model, c.width, c.params) == ("PINHOLE", 640, [520.0, 520.0, 320.0, 240.0])
    i = {r.id: r for r in sparse_text.images(spark, str(tmp_path)).collect()}
    assert i[1].name == "a b.png" and [(p.x, p.y, p.point3d_id) for p in i[1].points2d] == [(10.0, 20.0, 7), (11.5, 21.0, None)]
    assert i[2].points2d == [] and i[3].points2d == []
    p = sparse_text.points(spark, str(tmp_path)).first()
    assert [(t.image_id, t.point2d_index) for t in p.track] == [(1, 0), (2, 4)] and p.g == 20
    (tmp_path / "points3D.txt").write_text("7 1 2 3 10 20 30 0.5 1\n")
    with pytest.raises(Exception, match="pairs"):
        sparse_text.points(spark, str(tmp_path)).collect()


def test_artifacts_round_trip_and_tell_changes(spark, tmp_path):
    t = spark.createDataFrame([(k, k % 3, [float(k)]) for k in range(20)], "id int, frame_index int, v array<double>")
    artifacts.write({"points": t}, str(tmp_path / "a"), "surface", {"points": "frame_index"})
    back = artifacts.read(spark, str(tmp_path / "a"), "surface", verify=True)["points"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, t.collect())) and back.columns == t.columns
    assert artifacts.digest(t) == artifacts.digest(t.repartition(5)) != artifacts.digest(t.where("id > 0"))
    with pytest.raises(ValueError):
        artifacts.read(spark, str(tmp_path / "a"), "keyframes")
    t.where("id > 3").write.mode("append").partitionBy("frame_index").parquet(str(tmp_path / "a" / "points"))
    with pytest.raises(ValueError):
        artifacts.read(spark, str(tmp_path / "a"), "surface", verify=True)


def test_objects_join_by_place_and_not_by_frame(spark):
    rows = [("c", "chair", "t1", "o1", 0, 0.0, 0.0, 2.0, 2.0), ("c", "chair", "t1", "o2", 1, 0.02, 0.0, 2.0, 2.0), ("c", "chair", "u3", "o3", 2, 0.03, 0.0, 2.0, 2.0), ("c", "chair", "u4", "o4", 2, 3.0, 0.0, 2.0, 2.0), ("c", "chair", "u5", "o5", 3, None, None, None, None), ("c", "wall", "w1", "w1", 0, 0.0, 0.0, 2.0, 2.0), ("c", "wall", "w2", "w2", 1, 0.0, 0.0, 2.0, 2.0)]
    df = spark.createDataFrame(rows, "clip_id string, label string, candidate string, observation string, frame_index int, x double, y double, z double, depth double")
    got = {r.observation: r for r in objects.identify(df).collect()}
    assert got["o1"].object == got["o2"].object == got["o3"].object and got["o1"].motion == "movable_stationary"
    assert len({got[o].object for o in ("o1", "o4", "o5")}) == 3 and got["o5"].motion == "unknown"
    assert got["w1"].object != got["w2"].object and got["w1"].motion == "static_structure"
    front = spark.createDataFrame([("o", 2.0, 0.0, 0.0, 2.0), ("o", 2.1, 0.3, 0.0, 2.1), ("o", 2.2, 0.0, 0.0, 2.2), ("o", 9.0, 5.0, 5.0, 9.0), ("p", 1.0, 0.0, 0.0, 1.0)], "observation string, depth double, x double, y double, z double")
    at = objects.locations(front).collect()
    assert [(r.observation, r.points) for r in at] == [("o", 3)] and abs(at[0].x - 0.1) < 1e-9


def test_sweep_finds_the_depth_of_a_textured_plane():
    """A plane at inverse depth 0.1875 moves by 12 and -24 pixels under two known camera shifts."""
    y = np.random.default_rng(4).integers(0, 256, (120, 200)).astype(np.int32)
    still = np.eye(3)
    sources = [(np.roll(y, 12, axis=1), still, np.array([0.125, 0, 0])), (np.roll(y, -24, axis=1), still, np.array([-0.25, 0, 0]))]
    out = dense.sweep(y, sources, 512.0, 4.0, 8.0, hypotheses=9)
    inside = out[(out["gx"] > 40) & (out["gx"] < 160)]
    assert len(inside) > 200 and np.allclose(inside["depth"], 1 / 0.1875) and (inside["support"] == 2).all() and (inside["error"] < 1e-9).all()


def test_depth_points_of_a_clip(spark):
    got = dense.depth_points(fixtures.frames(spark).where("frame_index < 3"), fixtures.cameras(spark), fixtures.FOCAL, 3.0, 12.0, nearest=2)
    assert {r.frame_index for r in got.select("frame_index").distinct().collect()} == {0, 1, 2}
    assert got.where("support < 2 or depth < 3 or depth > 12.001").count() == 0


@pytest.mark.parametrize("scenario", ["lateral", "revisit"])
def test_cameras_of_a_generated_clip(scenario):
    """From exact tracks with half a pixel of noise: all frames, centers true up to a similarity."""
    import pandas as pd

    from tesserae.operators import cameras, geometry

    rng, rows, pts, centers = np.random.default_rng(2), [], fixtures.scene()[:150, :3], fixtures.centers(scenario)
    for f, c in enumerate(centers):
        rel = pts - c
        uv = rel[:, :2] / rel[:, 2:] * fixtures.FOCAL + [320, 240] + rng.normal(0, 0.3, (len(pts), 2))
        rows += [(str(k), f, u, v) for k, (u, v) in enumerate(uv) if 0 <= u < 640 and 0 <= v < 480]
    poses, marks, kept = cameras.solve(pd.DataFrame(rows, columns=["track", "frame_index", "x", "y"]), fixtures.FOCAL, 640, 480)
    assert sorted(poses) == list(range(8)) and len(marks) >= 40
    got = np.array([-poses[f][0].T @ poses[f][1] for f in range(8)])
    # centers on a line don't fix a similarity, so landmarks are aligned with the points and the cameras with them
    k, r, t = geometry.similarity(np.array(list(marks.values())), pts[[int(m) for m in marks]])
    off = np.linalg.norm(k * got @ r.T + t - centers, axis=1)
    assert np.sqrt((off**2).mean()) < 0.1


def test_pure_rotation_has_no_seed():
    import pandas as pd

    from tesserae.operators import cameras

    pts, rows = fixtures.scene()[:100, :3], []
    for f in range(5):
        q = pts @ cameras.turn(np.array([0, 1e-7 * f, 0])).T
        rows += [(str(k), f, *(q[k, :2] / q[k, 2] * 520 + [320, 240])) for k in range(100)]
    assert cameras.solve(pd.DataFrame(rows, columns=["track", "frame_index", "x", "y"]), 520.0, 640, 480) == ({}, {}, False)
