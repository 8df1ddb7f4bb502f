"""Scan files: round trips, splits, pushed filters, damage."""

import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from tesserae.sources import scans


@pytest.fixture(scope="module")
def session(spark):
    scans.register(spark)
    return spark


def test_points_round_trip_in_many_files(session, tmp_path, monkeypatch):
    rows = [(float(k), k / 7, float(-k), k % 256) for k in range(1000)]
    df = session.createDataFrame(rows, "x double, y float, z double, r int").repartition(3)
    df.write.format("ply").mode("append").save(str(tmp_path / "p"))
    assert not [n for n in os.listdir(tmp_path / "p") if n.startswith("_")]
    back = session.read.format("ply").load(str(tmp_path / "p"))
    assert back.schema == df.schema
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    monkeypatch.setattr(scans, "RECORDS", 100)
    assert len(scans.PointReader(str(tmp_path / "p"), back.schema).partitions()) >= 10
    near = session.read.format("ply").load(str(tmp_path / "p")).where("x < 10 and z > -5 and r <> 2")
    assert sorted(r.x for r in near.collect()) == [0.0, 1.0, 3.0, 4.0]
    df.limit(5).write.format("ply").mode("overwrite").save(str(tmp_path / "p"))
    assert session.read.format("ply").load(str(tmp_path / "p")).count() == 5


def test_filters_are_done_by_the_reader():
    reader = scans.PointReader("", None)
    left = list(reader.pushFilters([scans.LessThan(("x",), 3.0), scans.EqualTo(("a", "b"), 1), scans.GreaterThan(("n",), "text")]))
    assert len(left) == 2 and reader.tests == [("x", scans.LessThan, 3.0)]


def test_foreign_point_files(session, tmp_path):
    head = "ply\nformat {} 1.0\ncomment c\nelement vertex 3\nproperty float32 x\nproperty uchar red\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "a.ply").write_bytes(head.format("ascii").encode() + b"1.5 7\n2.5 8\n-1 255\n3 0 1 2\n")
    (tmp_path / "b.ply").write_bytes(head.format("binary_big_endian").encode() + b"".join(struct.pack(">fB", x, r) for x, r in ((9.0, 1), (8.0, 2), (7.0, 3))) + b"\x03" + bytes(12))
    got = sorted(map(tuple, session.read.format("ply").load(str(tmp_path)).collect()))
    assert got == [(-1.0, 255), (1.5, 7), (2.5, 8), (7.0, 3), (8.0, 2), (9.0, 1)]
    (tmp_path / "b.ply").write_bytes(head.format("binary_big_endian").encode() + bytes(9))
    with pytest.raises(Exception, match="cut short"):
        session.read.format("ply").load(str(tmp_path)).collect()
    for bad in (b"", b"plx\nend_header\n", b"ply\nformat ascii 1.0\nend_header\n", head.format("ascii").replace("float32", "list").encode()):
        (tmp_path / "a.ply").write_bytes(bad)
        with pytest.raises(Exception):
            session.read.format("ply").load(str(tmp_path / "a.ply")).collect()


def test_a_failed_write_leaves_nothing(session, tmp_path):
    df = session.createDataFrame([(1.0,), (None,)], "x double")
    with pytest.raises(Exception, match="no nulls"):
        df.write.format("ply").mode("append").save(str(tmp_path / "q"))
    assert not os.path.isdir(tmp_path / "q") or os.listdir(tmp_path / "q") == []


def test_trajectories_split_anywhere(tmp_path, monkeypatch):
    r = random.Random(1)
    rows = [[round(r.uniform(-9, 9), r.randint(0, 5)) for _ in range(16)] for _ in range(30)]
    text = "".join(f"{k} {k} 0\n" + "".join(" ".join(map(str, m[4 * i : 4 * i + 4])) + "\n" for i in range(4)) for k, m in enumerate(rows))
    (tmp_path / "a.log").write_text(text)
    for size in (1, 7, 64, 100, 333, 10**6):
        monkeypatch.setattr(scans, "BYTES", size)
        reader = scans.PathReader(str(tmp_path))
        got = [x for p in reader.partitions() for x in reader.read(p)]
        assert [(x[1], x[2]) for x in got] == list(enumerate(rows))
    (tmp_path / "a.log").write_text(text[:-20])
    with pytest.raises(ValueError):
        [x for p in reader.partitions() for x in reader.read(p)]


def test_trajectory_mapping_and_cameras(session, tmp_path):
    (tmp_path / "t.log").write_text("0 0 0\n1 0 0 4\n0 1 0 5\n0 0 1 6\n0 0 0 1\n")
    (row,) = session.read.format("trajectory").load(str(tmp_path / "t.log")).collect()
    assert (row.camera, row.x, row.y, row.z) == (0, 4.0, 5.0, 6.0) and len(row.matrix) == 16
    (tmp_path / "m.txt").write_text("2\n100\n0 5\n3 17\n9 9\n")
    assert [tuple(x) for x in scans.mapping(session, str(tmp_path / "m.txt")).collect()] == [(0, 5), (3, 17)]
    (tmp_path / "c.csv").write_text("frame_index,z,x,y\n4,3,1,2\n")
    assert [tuple(x) for x in scans.camera_table(session, str(tmp_path / "c.csv")).collect()] == [(4, 1.0, 2.0, 3.0)]
    assert session.read.format("trajectory").load(str(tmp_path / "t.log")).where(F.col("x") > 9).count() == 0
