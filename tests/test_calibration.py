"""Jacobian of all intrinsics, and cameras without views."""

import warnings

import numpy as np
from pyspark.sql import functions as F

from navlytics.plans import adjust as A
from navlytics.plans import calibration as K
from tests.test_refinement import compose, rodrigues, scene  # noqa: F401

FREE = K.PARAMETERS
START = dict(fx=480.0, fy=520.0, cx=318.0, cy=243.0, k1=-0.1, k2=0.02, p1=0.001, p2=-0.002)


def cameras(spark, ids):
    return spark.createDataFrame([(i, *START.values()) for i in ids], "cam_id long, " + ", ".join(f"{c} double" for c in FREE))


def test_jacobian_matches_differences(spark, scene):  # noqa: F811
    poses = scene["poses"].withColumn("cam_id", F.lit(1).cast("long"))
    obs = scene["obs"].withColumn("fk", F.col("frame_id") * 100 + F.col("kp_id"))
    rows = K.residual_rows(obs, poses, scene["points"], cameras(spark, [1]), FREE, A.Settings(huber_px=1e9, px_sd=2.0))
    got = {round(r.w[0][-1], 9): np.array(r.w) for r in rows.collect()}

    def res(o, w, t, k):
        x, y, z = rodrigues(w) @ scene["p1"][o.kp_id] + t
        x, y = x / z, y / z
        fx, fy, cx, cy, k1, k2, p1, p2 = k
        r2 = x * x + y * y
        rad = 1 + k1 * r2 + k2 * r2 * r2
        return np.array([o.u - fx * (x * rad + 2 * p1 * x * y + p2 * (r2 + 2 * x * x)) - cx, o.v - fy * (y * rad + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y) - cy]) / 2

    k0 = np.array(list(START.values()))
    for o in obs.collect():
        w, t = scene["r1"][o.frame_id], scene["l1"][o.frame_id]
        base = res(o, w, t, k0)
        line = got[min(got, key=lambda e: abs(e - base[0]))]
        num = np.zeros((2, 14))
        for i in range(14):
            e = np.zeros(14)
            e[i] = 1e-6
            num[:, i] = (res(o, compose(e[:3], w) if i < 3 else w, t + e[3:6], k0 + e[6:]) - base) / 1e-6
        assert np.abs(line[:, -1] - base).max() < 1e-8
        assert (np.abs(line[:, :14] - num) <= 1e-4 * np.maximum(1, np.abs(num))).all()


def test_step_lowers_the_cost_and_empty_cameras_stay(spark, scene):  # noqa: F811
    poses = scene["poses"].withColumn("cam_id", F.lit(1).cast("long"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        res = K.calibrate(scene["obs"], poses, scene["points"], cameras(spark, [1, 2]), ("fx", "fy"), A.Settings(huber_px=1e9, max_iters=1))
    cams = {r.cam_id: r for r in res.cams.collect()}
    assert cams[1].n_obs == 64 and cams[1].fx != START["fx"] and cams[1].k1 == START["k1"] and not cams[1].converged
    assert cams[2].converged and cams[2].n_obs == 0 and cams[2].fx == START["fx"] and cams[2].rms_px is None
    assert res.poses.count() == 4
    before = K.frame_sums(K.residual_rows(scene["obs"], poses, scene["points"], cameras(spark, [1]), ("fx", "fy"), A.Settings(huber_px=1e9)), 2)
    assert cams[1].cost < before.agg(F.sum(F.col("gram")[44])).first()[0] / 2


def test_frames_with_their_views_give_what_rows_give(spark, scene, monkeypatch):  # noqa: F811
    """the same cameras and poses by either way of summing, and only a round's own tables stay on disk."""
    import os

    odd = scene["obs"].withColumn("u", F.when((F.col("frame_id") == 1) & (F.col("kp_id") == 3), F.lit(None)).otherwise(F.col("u")))
    odd = odd.where("frame_id <> 2 OR kp_id > 12")  # frame 2 sees three points only
    behind = spark.createDataFrame([(99, (0.0, 0.0, -500.0)), (98, None)], "kp_id long, pt struct<x:double,y:double,z:double>")
    points = scene["points"].unionByName(behind)
    odd = odd.unionByName(spark.createDataFrame([(0, 99, 1.0, 2.0), (0, 98, 1.0, 2.0)], "frame_id long, kp_id long, u double, v double"))
    poses = scene["poses"].withColumn("cam_id", F.pmod(F.col("frame_id"), F.lit(2)) + 1)
    poses = poses.unionByName(poses.where("frame_id = 0").withColumn("frame_id", F.lit(7).cast("long")))  # sees nothing
    poses = poses.unionByName(poses.where("frame_id = 1").withColumns({"frame_id": F.lit(8).cast("long"), "cam_id": F.lit(5).cast("long")}))  # an unknown camera's
    got, write = {}, K.written
    for most in (K.GATHERED, 1):
        monkeypatch.setattr(K, "GATHERED", most)
        made = []
        monkeypatch.setattr(K, "written", lambda *a, made=made: made.append(write(*a)) or made[-1])
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            res = K.calibrate(odd, poses, points, cameras(spark, [1, 2, 3]), ("fx", "fy"), A.Settings(max_iters=2))
        cams = {r.cam_id: r for r in res.cams.collect()}
        at = {r.frame_id: [*r.rot, *r.loc] for r in res.poses.collect()}
        left = [d for d in made if "frame_id" in d.columns and os.path.exists(d.navlytics_path.removeprefix("file://"))]
        got[most] = cams, at, left
    (cams, at, left), (by_rows, at_rows, _) = got.values()
    assert len(left) == 2  # the frames of the last round, and those that take no part
    assert cams.keys() == by_rows.keys() == {1, 2, 3} and at.keys() == at_rows.keys() == {0, 1, 2, 3, 7, 8}
    for c, r in by_rows.items():
        assert (cams[c].n_obs, cams[c].converged) == (r.n_obs, r.converged)
        np.testing.assert_allclose([cams[c].fx, cams[c].fy, cams[c].cost or 0], [r.fx, r.fy, r.cost or 0], rtol=1e-6)
    for f, p in at_rows.items():
        np.testing.assert_allclose(at[f], p, rtol=1e-5, atol=1e-6)
