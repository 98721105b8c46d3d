"""Files written and read back."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from navlytics.sources import dataset as D
from navlytics.sources import labels as L
from navlytics.sources import mesh as M
from navlytics.sources import telemetry as T


def test_label_file(spark, tmp_path):
    (tmp_path / "A_1.lbl").write_text("[main]\nast_x_rot = 60.5\nz_off = -70\ntime = 1407300000.5\n\n[real]\nast_x_rot = 64.11\nsun_asteroid_pos = [ -1.5e8  2.0 3]\n")
    r = {x.section: x for x in L.read_labels(spark, str(tmp_path)).collect()}
    assert r["main"].img == "A_1" and r["main"].ast_x_rot == 60.5 and r["main"].sun_asteroid_pos is None or r["main"].sun_asteroid_pos == []
    assert r["real"].ast_x_rot == 64.11 and r["real"].z_off == -70 and r["real"].sun_asteroid_pos == [-1.5e8, 2.0, 3.0]


def test_obj_file(spark, tmp_path):
    (tmp_path / "m.obj").write_text("# c\nv 0 0 0\nv 1 0 0\nv 0 1 0\nvt 0 0\nvt 1 0\nf 1/1 2/2 3/1\n")
    lines = M.read_obj_lines(spark, str(tmp_path))
    n = M.face_normals(M.faces(lines), M.vertices(lines), ["mesh"]).first().n
    assert [n.x, n.y, n.z] == [0, 0, 1]
    assert {(r.tid, r.vid) for r in M.texture_vertices(M.faces(lines), ["mesh"]).collect()} == {(0, 2), (1, 1)}
    assert M.texcoords(lines).count() == 2


def test_quads_are_refused(spark, tmp_path):
    (tmp_path / "q.obj").write_text("v 0 0 0\nf 1 2 3 4\n")
    with pytest.raises(Exception, match="triangle"):
        M.faces(M.read_obj_lines(spark, str(tmp_path))).collect()


def test_depth_array_file(spark, tmp_path):
    a = np.arange(6, dtype="<f4").reshape(2, 3)  # rows x cols
    (tmp_path / "d.jpg.geometric.bin").write_bytes(b"3&2&1&" + a.T.ravel(order="F").tobytes())
    d = spark.read.format("binaryFile").load(str(tmp_path))
    got = {(r.row, r.col): r.depth for r in D.pixels(d, ["path"], "content").collect()}
    assert got == {(i, j): (float(a[i, j]) or None) for i in range(2) for j in range(3)}
    assert d.select(F.regexp_extract(F.element_at(F.split("path", "/"), -1), T.DEPTH_FILE_PATTERN, 1)).first()[0] == "d"


def test_telemetry_and_image_folder(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_text("session,ts,lat,lon,alt,roll,pitch,yaw,gr,gp,gy\ns,1000000,60.1,24.2,5,0.1,0.2,0.3,180,-90,0\n")
    r = T.read_telemetry(spark, str(tmp_path / "t")).first()
    assert r.gimbal_roll == pytest.approx(math.pi) and r.roll == 0.1 and r.ts.second == 1
    (tmp_path / "i").mkdir()
    for n in ("f1.png", "f2.jpg", "f3.jpeg", "x.txt"):
        (tmp_path / "i" / n).write_bytes(struct.pack("<i", 1))
    assert sorted(x.frame_id for x in T.scan_image_dir(spark, str(tmp_path / "i"), 0, 3).collect()) == [1, 2]


def test_dataset_roundtrip(spark, tmp_path):
    pts = spark.range(3).select(F.col("id").alias("pt3d_id"), *[F.lit(1.0).alias(c) for c in "xyz"], (F.col("id") % 2).alias("batch_id"))
    D.write_dataset({"points3d": pts}, str(tmp_path))
    got = D.read_dataset(spark, str(tmp_path), ("points3d",))["points3d"]
    assert got.count() == 3 and got.where("batch_id = 1").count() == 1
    new = D.update_points(got, spark.createDataFrame([(1, 9.0, 9.0, 9.0)], "pt3d_id long, x double, y double, z double"))
    assert {r.pt3d_id: r.x for r in new.collect()} == {0: 1.0, 1: 9.0, 2: 1.0}


def test_mission_registry_and_state_log(spark, tmp_path):
    from navlytics.sources import missions

    missions.register(missions.Mission("toy", {"rows": lambda s, p: s.range(int(p))}))
    assert missions.get("toy").load(spark, "3")["rows"].count() == 3
    with pytest.raises(KeyError):
        missions.get("none")
    for _ in range(2):
        L.write_state_tsv(spark.range(2), str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log"), sep="\t", header=True).count() == 4
