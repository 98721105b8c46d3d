"""Jacobians, the joint solve and the closed-form solvers on a small known scene."""

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from navlytics.functions import rotations as R
from navlytics.functions.camera import Camera
from navlytics.plans import adjust as A

CAM = Camera(640, 480, 500.0, 510.0, 320.0, 240.0)
VEC = "struct<x:double,y:double,z:double>"


def rodrigues(w):
    th = np.linalg.norm(w)
    k = w / th if th > 0 else w
    s = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    return np.eye(3) + np.sin(th) * s + (1 - np.cos(th)) * s @ s


def row(a):
    return Row(x=float(a[0]), y=float(a[1]), z=float(a[2]))


@pytest.fixture(scope="module")
def scene(spark):
    rng = np.random.default_rng(1)
    nf, n = 4, 16
    pts = rng.uniform(-20, 20, (n, 3)) + [0, 0, 90]
    rot, loc = rng.normal(0, 0.05, (nf, 3)), rng.normal(0, 8, (nf, 3))
    cam = np.array([[rodrigues(rot[f]) @ p + loc[f] for p in pts] for f in range(nf)])
    obs = [(f, k, float(cam[f, k, 0] / cam[f, k, 2] * 500 + 320), float(cam[f, k, 1] / cam[f, k, 2] * 510 + 240)) for f in range(nf) for k in range(n)]
    r1, l1, p1 = rot + rng.normal(0, 0.004, rot.shape), loc + rng.normal(0, 0.3, loc.shape), pts + rng.normal(0, 0.3, pts.shape)
    mk = spark.createDataFrame
    return {
        "pts": pts, "rot": rot, "loc": loc, "r1": r1, "l1": l1, "p1": p1, "cam": cam,
        "obs": mk(obs, "frame_id long, kp_id long, u double, v double"),
        "poses": mk([(f, row(r1[f]), row(l1[f])) for f in range(nf)], f"frame_id long, rot {VEC}, loc {VEC}"),
        "points": mk([(k, row(p1[k])) for k in range(n)], f"kp_id long, pt {VEC}"),
        "meas": mk([(f, row(-rodrigues(rot[f]).T @ loc[f])) for f in range(nf)], f"frame_id long, m {VEC}"),
    }


def compose(d, w):
    m = rodrigues(d) @ rodrigues(w)
    th = np.arccos((np.trace(m) - 1) / 2)
    return th / (2 * np.sin(th)) * np.array([m[2, 1] - m[1, 2], m[0, 2] - m[2, 0], m[1, 0] - m[0, 1]])


def test_analytic_jacobian_matches_differences(scene):
    s = A.Settings(huber_px=1e9, huber_loc=1e9, loc_sd=1.0)
    d = A.reprojection_residuals(A.camera_points(scene["obs"], scene["poses"], scene["points"].withColumn("frozen", F.lit(False))), CAM)
    lin = A.linearise(d, CAM, s).toPandas()

    def res(w, t, x):
        c = rodrigues(w) @ x + t
        return -np.array([c[0] / c[2] * 500, c[1] / c[2] * 510])

    for r in lin.itertuples():
        w, t, x = scene["r1"][r.frame_id], scene["l1"][r.frame_id], scene["p1"][r.kp_id]
        num = np.zeros((2, 9))
        for i in range(9):
            e = np.zeros(9)
            e[i] = 1e-6
            num[:, i] = (res(compose(e[:3], w) if i < 3 else w, t + e[3:6], x + e[6:]) - res(w, t, x)) / 1e-6
        got = np.hstack([np.reshape(r.jp, (2, 6)), np.reshape(r.jl, (2, 3))])
        assert np.abs(got - num).max() < 1e-5 * np.abs(num).max()
    loc = A.linearise_locations(A.location_residuals(scene["poses"], scene["meas"], 1.0), s, 1.0).toPandas()
    for r in loc.itertuples():
        w, t = scene["r1"][r.frame_id], scene["l1"][r.frame_id]
        for i in range(6):
            e = np.zeros(6)
            e[i] = 1e-6
            num = (rodrigues(compose(e[:3], w) if i < 3 else w).T @ (t + e[3:]) - rodrigues(w).T @ t) / 1e-6
            np.testing.assert_allclose(np.reshape(r.jp, (3, 6))[:, i], num, atol=1e-4)


def test_reduced_system_equals_dense_solve(spark, scene):
    """One damped step against a dense normal-equation solve in NumPy."""
    s = A.Settings(huber_px=1e9, huber_loc=1e9, loc_sd=1.0, cg_iters=12, cg_tol=1e-10)
    pts = scene["points"].withColumn("frozen", F.lit(False))
    lin = A.cut_lineage(A.linearise(A.reprojection_residuals(A.camera_points(scene["obs"], scene["poses"], pts), CAM), CAM, s))
    ll = A.linearise_locations(A.location_residuals(scene["poses"], scene["meas"], 1.0), s, 1.0)
    lam = 10.0
    blocks = A.cut_lineage(A.pose_blocks(lin, ll))
    lms = A.cut_lineage(A.landmark_blocks(lin).select("kp_id", A.inverse_sym3(A._damped(F.col("h"), A._TRI3, lam)).alias("inv"), "b", "h"))
    dp = A.solve_poses(lin, blocks, lms, lam, s, ([], []))
    dl = A.back_substitute(lin, dp, lms, [])
    nf, n = len(scene["rot"]), len(scene["pts"])
    rows, e = [], []
    for r in lin.toPandas().itertuples():
        j = np.zeros((2, 6 * nf + 3 * n))
        j[:, 6 * r.frame_id : 6 * r.frame_id + 6] = np.reshape(r.jp, (2, 6))
        j[:, 6 * nf + 3 * r.kp_id : 6 * nf + 3 * r.kp_id + 3] = np.reshape(r.jl, (2, 3))
        rows.append(j)
        e.append(r.e)
    for r in ll.toPandas().itertuples():
        j = np.zeros((3, 6 * nf + 3 * n))
        j[:, 6 * r.frame_id : 6 * r.frame_id + 6] = np.reshape(r.jp, (3, 6))
        rows.append(j)
        e.append(r.e)
    j, e = np.vstack(rows), np.concatenate(e)
    h = j.T @ j
    want = np.linalg.solve(h + lam * np.diag(np.diag(h)), -j.T @ e)
    got = np.concatenate([np.concatenate(dp.orderBy("frame_id").toPandas().p.to_numpy()), np.concatenate(dl.orderBy("kp_id").toPandas().dl.to_numpy())])
    np.testing.assert_allclose(got, want, atol=1e-4 * np.abs(want).max())


def test_joint_solve_lowers_the_cost(scene):
    s = A.Settings(huber_px=1e9, huber_loc=1e9, loc_sd=1.0, max_iters=1, cg_iters=3)
    res = A.bundle_adjust(scene["obs"], scene["poses"], scene["points"], CAM, s, scene["meas"])
    assert res.stats[-1]["success"] and res.cost < 0.2 * res.stats[0]["cost"]


def test_joint_solve_says_whether_it_converged(spark, scene, monkeypatch):
    noisy = scene["obs"].withColumns({"u": F.col("u") + F.sin(7 * F.col("kp_id") + F.col("frame_id")), "v": F.col("v") + F.cos(5 * F.col("kp_id") + F.col("frame_id"))})
    few = A.Settings(huber_px=1e9, huber_loc=1e9, max_iters=1, cg_iters=1, max_tries=1)
    with pytest.warns(RuntimeWarning, match="not converged"):
        res = A.bundle_adjust(noisy, scene["poses"], scene["points"], CAM, few, scene["meas"])
    assert not res.converged and res.stats[-1]["cg_iters"] == 1 and not res.stats[-1]["cg_converged"]
    full = A.Settings(huber_px=1e9, huber_loc=1e9, ftol=0.02, cg_tol=0.02)
    res = A.bundle_adjust(noisy, scene["poses"], scene["points"], CAM, full, scene["meas"])
    assert res.converged and len(res.stats) > 2 and res.stats[-1]["cg_residual"] <= 0.02

    from navlytics.workload import refinement

    asked = []
    monkeypatch.setattr(A, "bundle_adjust", lambda *a, **k: asked.append(a[4:5] or k.get("s")) or A.Result(a[1], a[2], 0.0))
    refinement.map_refinement(refinement_tables(spark))
    assert asked == [None]  # the library's settings


def test_resection_keeps_one_pass_of_trials_on_disk(spark, scene, monkeypatch):
    """trials go by passes with the same outcome, and rows of groups with too few of them are not written."""
    import os

    n = scene["cam"][:, :, :2] / scene["cam"][:, :, 2:]
    rows = [(f, k, row(scene["pts"][k]), float(n[f, k, 0] + (0.2 + 0.01 * k if k % 4 == f else 0)), float(n[f, k, 1])) for f in range(4) for k in range(16 if f < 3 else 5)]
    d = spark.createDataFrame(rows, f"f long, k long, pt {VEC}, x double, y double")
    got, write = [], A.written
    for poses in (1 << 18, 1):
        monkeypatch.setattr(A, "PASS_POSES", poses)
        made = {}
        monkeypatch.setattr(A, "written", lambda d, name, made=made: made.setdefault(name, []).append(write(d, name)) or made[name][-1])
        got.append({r.f: (r.inliers, [round(x, 6) for x in r.m]) for r in A.resection_ransac(d, "f", "k", 1e-3, trials=16).collect()})
        there = {name: [d for d in ds if os.path.exists(d.navlytics_path.removeprefix("file://"))] for name, ds in made.items()}
        assert len(there["matches"]) == len(there["trials"]) == 1 and len(made["trials"]) >= (2 if poses == 1 else 1)
        assert there["matches"][0].select("f").distinct().count() == 3
    assert got[0] == got[1] and {f: v[0] for f, v in got[0].items()} == {0: 12, 1: 12, 2: 12}


def refinement_tables(spark):
    from navlytics.workload.base import Tables

    return Tables(spark, "/root/testdata/sf0.001")


def test_pose_refinement_goes_on_until_frames_rest(spark, scene):
    pts = spark.createDataFrame([(k, row(p)) for k, p in enumerate(scene["pts"])], f"kp_id long, pt {VEC}")
    out = A.refine_poses(scene["obs"], scene["poses"], pts, CAM, A.Settings(huber_px=1e9)).orderBy("frame_id").collect()
    np.testing.assert_allclose([list(r.loc) for r in out], scene["loc"], atol=1e-4)
    with pytest.warns(RuntimeWarning, match="still move"):
        A.refine_poses(scene["obs"], scene["poses"], pts, CAM, A.Settings(huber_px=1e9, max_iters=1))


def test_closed_forms(spark, scene):
    cam = scene["cam"]
    rows = [(k, [float(x) for x in np.hstack([rodrigues(scene["rot"][f]), scene["loc"][f][:, None]]).ravel()], float(cam[f, k, 0] / cam[f, k, 2]), float(cam[f, k, 1] / cam[f, k, 2]))
            for f in range(len(cam)) for k in range(len(scene["pts"]))]
    p = A.triangulate(spark.createDataFrame(rows, "kp_id long, m array<double>, x double, y double"), "kp_id").orderBy("kp_id").collect()
    np.testing.assert_allclose([list(r.pt) for r in p], scene["pts"], atol=1e-5)

    n = cam[:, :, :2] / cam[:, :, 2:]
    pairs = spark.createDataFrame([(0, *map(float, n[0, k]), *map(float, n[1, k])) for k in range(n.shape[1])], "g long, x0 double, y0 double, x1 double, y1 double")
    e = pairs.join(A.essential_matrix(pairs, ["g"]), "g").select(A.epipolar_error(F.col("e"), *[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("d"))
    assert e.agg(F.max("d")).first()[0] < 1e-6

    bad = [(0, k, row(scene["pts"][k]), float(n[0, k, 0] + (0.3 if k % 8 == 0 else 0)), float(n[0, k, 1])) for k in range(n.shape[1])]
    r = A.resection_ransac(spark.createDataFrame(bad, f"f long, k long, pt {VEC}, x double, y double"), "f", "k", 1e-3, trials=24).first()
    assert r.inliers == n.shape[1] - 2
    np.testing.assert_allclose(np.reshape(r.m, (3, 4))[:, 3], scene["loc"][0], atol=1e-4)

    # a third of the views wrong, some groups with few rows: rounds go on only where no clean sample is likely yet
    off = np.random.default_rng(5).uniform(0.1, 0.6, len(scene["pts"]))
    far = [(f, k, row(scene["pts"][k]), float(n[f % 4, k, 0] + (off[k] if k % 3 == f % 3 else 0)), float(n[f % 4, k, 1])) for f in range(12) for k in range(n.shape[1] if f < 11 else 6)]
    far = spark.createDataFrame(far, f"f long, k long, pt {VEC}, x double, y double")
    got = {r.f: r for r in A.resection_ransac(far.where("f < 11 or k % 3 <> 2"), "f", "k", 1e-3, trials=1).collect()}
    assert set(got) == set(range(11))
    for f in range(11):
        assert got[f].inliers == n.shape[1] - sum(k % 3 == f % 3 for k in range(n.shape[1]))
        np.testing.assert_allclose(np.reshape(got[f].m, (3, 4))[:, 3], scene["loc"][f % 4], atol=1e-4)
    with pytest.warns(RuntimeWarning, match="trials"):
        A.resection_ransac(far, "f", "k", 1e-3, trials=1, max_trials=1)

    q = spark.range(5).select(R.from_ypr((F.col("id") - 2) * 0.1, F.lit(0.0), F.lit(0.0)).alias("q"))
    m = A.mean_orientation(q, [], "q").first().quat
    np.testing.assert_allclose(list(m), [1, 0, 0, 0], atol=1e-12)


def test_rays_meet_the_faces_all_around(spark, monkeypatch):
    """faces in all directions, behind the origin, around it and across the axes, against all pairs; equal faces go by the least id."""
    import pandas as pd

    from navlytics.operators import nearest
    from navlytics.workload.refinement import mesh_ray_errors

    monkeypatch.setattr(nearest, "LEAF_ROWS", 16)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3)) * rng.choice([1.0, 5.0], (400, 1))
    x[0] = 0.0
    mid = rng.normal(size=(120, 1, 3)) * 3
    p = mid + rng.normal(size=(120, 3, 3)) * rng.choice([0.2, 1.0, 6.0], (120, 1, 1))
    p[60:70] = p[:10]
    rays = spark.createDataFrame(pd.DataFrame({"rid": np.arange(400), "x": x[:, 0], "y": x[:, 1], "z": x[:, 2]}))
    cols = {f"{a}{i}": p[:, i, k] for i in range(3) for k, a in enumerate("xyz")}
    got = mesh_ray_errors(rays, spark.createDataFrame(pd.DataFrame({"fid": np.arange(120), **cols})), "rid", "fid").toPandas().set_index("rid")
    want = {}
    for r in range(1, 400):
        ln = np.linalg.norm(x[r])
        m = np.stack([np.broadcast_to(-x[r] / ln, (120, 3)), p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]], 2)
        t, u, v = np.linalg.solve(m, -p[:, 0, :, None])[:, :, 0].T
        err = np.where((u >= 0) & (v >= 0) & (u + v <= 1), abs(t - ln), np.inf)
        if np.isfinite(err.min()):
            want[r] = (int(err.argmin()), err.min())
    assert set(got.index) == set(want) and len(want) > 300
    np.testing.assert_allclose([got.score[r] for r in want], [want[r][1] for r in want], rtol=1e-6, atol=1e-9)
    assert [got.hay_id[r] for r in want] == [want[r][0] for r in want]
