"""Residuals, normal equations, triangulation and pose solves on the mapped tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from navlytics.functions import computed, rotations as R
from navlytics.functions import vectors as V
from navlytics.functions.camera import Camera
from navlytics.operators.nearest import block_best, fit_cells, sampled_cells
from navlytics.plans import adjust as A
from navlytics.session import written
from navlytics.workload.base import FRAMES_SQL, PROJ_SQL, frames, landmarks, observations, placed, projected, q_rot, q_ypr, query, rnd

CAM = Camera(640, 480, 500.0, 510.0, 320.0, 240.0)


def scene(t):
    """(obs, poses, points): observations of the true scene with their pixel noise."""
    d = projected(t)
    obs = d.select("frame_id", "kp_id", (F.col("cam.x") / F.col("cam.z") * 500.0 + 320.0 + F.col("du")).alias("u"),
                   (F.col("cam.y") / F.col("cam.z") * 510.0 + 240.0 + F.col("dv")).alias("v"))
    poses = frames(t).select("frame_id", R.to_rotvec(F.col("quat")).alias("rot"), "loc")
    return obs, poses, landmarks(t).withColumn("frozen", F.lit(False))


def _shifted(poses, d=0.2):
    return poses.withColumn("loc", V.add(F.col("loc"), V.vec(d, -d, 0.0)))


@query(f"{PROJ_SQL} SELECT frame_id, kp_id, round(du - 0.2/cz*500, 4)+0.0 AS eu, round(dv + 0.2/cz*510, 4)+0.0 AS ev FROM proj")
def reprojection_residuals(t):
    obs, poses, pts = scene(t)
    d = A.reprojection_residuals(A.camera_points(obs, _shifted(poses), pts), CAM)
    return d.select("frame_id", "kp_id", rnd(F.col("eu"), 4).alias("eu"), rnd(F.col("ev"), 4).alias("ev"))


@query(f"""{PROJ_SQL}, e AS (SELECT pow(du - 0.2/cz*500, 2) + pow(dv + 0.2/cz*510, 2) AS q FROM proj)
SELECT round(0.5*sum(CASE WHEN sqrt(q) > 1 THEN sqrt(q) ELSE q END), 2) AS cost, count(*) AS n FROM e""")
def refinement_cost(t):
    obs, poses, pts = scene(t)
    d = A.reprojection_residuals(A.camera_points(obs, _shifted(poses), pts), CAM)
    w = A.huber_weight(F.hypot("eu", "ev"), 1.0)
    return d.agg(F.round(0.5 * F.sum(w * w * (F.col("eu") ** 2 + F.col("ev") ** 2)), 2).alias("cost"), F.count(F.lit(1)).alias("n"))


_C = q_rot("q", ["-(lx+0.2)", "-(ly-0.2)", "-lz"], True)
_C0 = q_rot("q", ["-lx", "-ly", "-lz"], True)


@query(f"""WITH {FRAMES_SQL} SELECT frame_id, {", ".join(f"round(({a}-{b})/3.0, 5)+0.0 AS e{k}" for a, b, k in zip(_C0, _C, "xyz"))}, round(radians(frame_id % 7)/0.5, 5)+0.0 AS oz FROM frames""")
def measurement_residuals(t):
    f = frames(t)
    poses = f.select("frame_id", R.to_rotvec(F.col("quat")).alias("rot"), "loc")
    centre = f.select("frame_id", R.rotate(R.conj(F.col("quat")), V.neg(F.col("loc"))).alias("m"))
    e = A.location_residuals(_shifted(poses), centre, 3.0)
    aa = f.select("frame_id", "quat", R.axis_quat("z", F.radians((F.col("frame_id") % 7).cast("double"))).alias("dz"))
    aa = aa.select("frame_id", R.mul(F.col("dz"), R.conj(F.col("quat"))).alias("q")).select("frame_id", R.to_rotvec(F.col("q")).alias("aa"))
    o = A.orientation_residuals(poses, aa, 0.5)
    return e.join(o, "frame_id").select("frame_id", *[rnd(F.col(f"el.{k}"), 5).alias(f"e{k}") for k in "xyz"], rnd(F.col("eo.z"), 5).alias("oz"))


@query(f"""{PROJ_SQL} SELECT frame_id, round(sum(pow(500/cz, 2)), 4) AS txx, round(sum(pow(510/cz, 2)), 4) AS tyy, round(sum(pow(500*cx/(cz*cz), 2) + pow(510*cy/(cz*cz), 2)), 4) AS tzz,
 round(sum(500/cz*du), 3)+0.0 AS bx, round(sum(510/cz*dv), 3)+0.0 AS by_ FROM proj GROUP BY 1""")
def pose_normal_blocks(t):
    """Translation part of the pose normal matrix and right-hand side at the true scene."""
    obs, poses, pts = scene(t)
    s = A.Settings(huber_px=1e9)
    lin = A.linearise(A.reprojection_residuals(A.camera_points(obs, poses, pts), CAM), CAM, s)
    b = A.pose_blocks(lin)
    return b.select("frame_id", F.round(F.col("h")[15], 4).alias("txx"), F.round(F.col("h")[18], 4).alias("tyy"), F.round(F.col("h")[20], 4).alias("tzz"),
                    rnd(F.col("b")[3], 3).alias("bx"), rnd(F.col("b")[4], 3).alias("by_"))


@query(f"""{PROJ_SQL} SELECT kp_id, round(max(px), 3)+0.0 AS x, round(max(py), 3)+0.0 AS y, round(max(pz), 3)+0.0 AS z FROM proj GROUP BY 1 HAVING count(*) >= 2""")
def landmark_triangulation(t):
    """n-view triangulation of noise-free views gives the landmark back."""
    d = projected(t)
    m = R.matrix(F.col("quat"))
    d = d.select("kp_id", m.alias("r"), "loc", (F.col("cam.x") / F.col("cam.z")).alias("x"), (F.col("cam.y") / F.col("cam.z")).alias("y"))
    r, lo = F.col("r"), F.col("loc")
    d = d.select("kp_id", F.array(r[0], r[1], r[2], lo.x, r[3], r[4], r[5], lo.y, r[6], r[7], r[8], lo.z).alias("m"), "x", "y")
    p = A.triangulate(d, "kp_id")
    return p.select("kp_id", *[rnd(F.col(f"pt.{k}"), 3).alias(k) for k in "xyz"])


@query(f"""{PROJ_SQL}, g AS (SELECT frame_id FROM proj GROUP BY 1 HAVING count(*) >= 5) SELECT frame_id, round(lx, 1)+0.0 AS x, round(ly, 1)+0.0 AS y, round(lz, 1)+0.0 AS z FROM frames SEMI JOIN g USING (frame_id)""")
def motion_only_refinement(t):
    """Exact observations pull shifted poses back to the true ones."""
    obs, poses, pts = scene(t)
    d = projected(t)
    exact = d.select("frame_id", "kp_id", (F.col("cam.x") / F.col("cam.z") * 500.0 + 320.0).alias("u"), (F.col("cam.y") / F.col("cam.z") * 510.0 + 240.0).alias("v"))
    many = exact.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 5").select("frame_id")
    out = A.refine_poses(exact.join(many, "frame_id", "left_semi"), _shifted(poses).join(many, "frame_id", "left_semi"), pts, CAM, A.Settings(huber_px=1e9, lam=1e-12))
    return out.select("frame_id", *[rnd(F.col(f"loc.{k}"), 1).alias(k) for k in "xyz"])


@query()
def map_refinement(t):
    """The joint solve to its tolerances with measured camera centres, warning if it ends before; the solver is tested on a small scene."""
    obs, poses, pts = scene(t)
    meas = frames(t).where("frame_id % 3 = 0").select("frame_id", R.rotate(R.conj(F.col("quat")), V.neg(F.col("loc"))).alias("m"))
    res = A.bundle_adjust(obs, _shifted(poses), pts, CAM, meas=meas)
    return res.poses.select("frame_id", *[rnd(F.col(f"loc.{k}"), 3).alias(k) for k in "xyz"])


@query(f"""{PROJ_SQL} SELECT CAST(f AS DOUBLE) AS focal, round(avg(pow(cx/cz*(500-f)+du, 2) + pow(cy/cz*(510-f*1.02)+dv, 2)), 4) AS cost, count(*) AS n FROM proj, (SELECT unnest([450.0, 480.0, 500.0, 520.0]) AS f) GROUP BY 1""")
def focal_cost_grid(t):
    obs, poses, pts = scene(t)
    d = A.camera_points(obs, poses, pts)
    return A.focal_costs(d, [450.0, 480.0, 500.0, 520.0], 320.0, 240.0, 1.02).withColumn("cost", F.round("cost", 4))


@query()
def mean_orientations(t):
    """Mean camera orientation of each session; equals the serial mean in the tests' small case."""
    d = A.mean_orientation(frames(t), ["session"], "quat")
    return d.select("session", *[rnd(F.col(f"quat.{k}"), 5).alias(k) for k in "wxyz"])


def _views(x: np.ndarray) -> np.ndarray:
    """Lines through the origin as points: four times the largest component's axis, and the two others over that one."""
    axis = np.abs(x).argmax(1)
    rows = np.arange(len(x))
    out = np.empty((len(x), 3))
    out[:, 0] = 4.0 * axis
    for i, other in enumerate((np.array([1, 0, 0]), np.array([2, 2, 1]))):
        out[:, 1 + i] = x[rows, other[axis]] / x[rows, axis]
    return out


def _view_boxes(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, lo, hi): boxes in the space of ``_views`` that hold every line meeting a triangle, given as n x 3 corners x 3.

    Corners move outwards a little first. A triangle on both sides of an axis' zero plane gets the whole square of that axis, unless it
    lies outside of the lines that belong there.
    """
    e1, e2 = p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]
    eps = 1e-5
    c = np.stack([p[:, 0] - eps * (e1 + e2), p[:, 1] + eps * (2 * e1 - e2), p[:, 2] + eps * (2 * e2 - e1)], 1)
    rows, los, his = [], [], []
    for axis, others in enumerate(((1, 2), (0, 2), (0, 1))):
        own, rest = c[:, :, axis], c[:, :, others]
        tiny = 1e-9 * np.abs(c).max((1, 2))[:, None]
        one_side = (own > tiny).all(1) | (own < -tiny).all(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            q = np.where(one_side[:, None, None], rest / own[:, :, None], 0.0)
        lo = np.where(one_side[:, None], q.min(1), -1.0) - 1e-6
        hi = np.where(one_side[:, None], q.max(1), 1.0) + 1e-6
        edge = np.abs(own)[:, :, None] * (1 + 1e-6) + tiny[:, :, None]
        outside = (rest > edge).all(1).any(1) | (rest < -edge).all(1).any(1)
        keep = ~outside & (lo <= 1 + 1e-6).all(1) & (hi >= -1 - 1e-6).all(1)
        at = np.full((int(keep.sum()), 1), 4.0 * axis)
        rows.append(np.flatnonzero(keep))
        los.append(np.hstack([at, lo[keep]]))
        his.append(np.hstack([at, hi[keep]]))
    return np.concatenate(rows), np.vstack(los), np.vstack(his)


_CORNERS = [f"{a}{i}" for i in range(3) for a in "xyz"]


def mesh_ray_errors(rays, faces, ray_id, face_id):
    """Signed error of the closest hit of each ray from the origin: (ray_id, face_id, score=|err|).

    Rays are gathered in cells of like direction; a face meets the cells that it may cover. Of equal faces the one with the least id stays.
    """
    def score(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        x = a[["x", "y", "z"]].to_numpy(float)
        p0, p1, p2 = (b[[f"x{i}", f"y{i}", f"z{i}"]].to_numpy(float) for i in range(3))
        ln = np.linalg.norm(x, axis=1)
        d = x / np.maximum(ln, 1e-300)[:, None]
        e1, e2 = p1 - p0, p2 - p0
        # the triple products of the intersection, turned so that each is one product with the directions
        det = d @ np.cross(e2, e1).T
        with np.errstate(divide="ignore", invalid="ignore"):
            u = d @ np.cross(e2, -p0).T / det
            qv = np.cross(-p0, e1)
            v = d @ qv.T / det
            dist = np.einsum("fj,fj->f", e2, qv)[None] / det
            ok = (ln[:, None] > 1e-6) & (np.abs(det) >= 1e-6) & (u >= -1e-6) & (u <= 1 + 1e-6) & (v >= -1e-6) & (u + v <= 1 + 1e-6)
            return np.where(ok, np.abs(dist - ln[:, None]), np.inf)

    finite = lambda cols: " AND ".join(f"abs({c}) < double('Infinity')" for c in cols)
    sized = rays.where(finite("xyz")).where("greatest(abs(x), abs(y), abs(z)) > 1e-7")

    @F.pandas_udf("array<double>")
    def view(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series(list(_views(np.column_stack([x, y, z]).astype(float))))

    seen = written(sized.withColumn("__v", view("x", "y", "z")), "rays")
    n = seen.count()
    if not n:
        return block_best(seen, faces, ray_id, face_id, score, 1, block_rows=1024)
    cells = sampled_cells(seen, "__v", n)
    placed = fit_cells(cells, seen, "__v")

    @F.pandas_udf("array<int>")
    def covered(*corners: pd.Series) -> pd.Series:
        p = np.column_stack(corners).astype(float).reshape(-1, 3, 3)
        out = []
        for at in range(0, len(p), 256):  # a large face covers many cells
            row, lo, hi = _view_boxes(p[at : at + 256])
            box, cell = cells.meeting(lo, hi)
            order = np.argsort(row[box], kind="stable")
            out += np.split(cell[order].astype("int32"), np.searchsorted(row[box][order], np.arange(1, len(p[at : at + 256]))))
        return pd.Series(out)

    kinds = faces.where(finite(_CORNERS)).groupBy(*_CORNERS).agg(F.min(face_id).alias(face_id))
    spread = kinds.withColumn("cell", F.explode(F.array_distinct(covered(*_CORNERS))))
    hits = block_best(placed.drop("__v"), spread, ray_id, face_id, score, 1, ["cell"], block_rows=1024, few=True)
    return hits.drop("cell")


_FACE = """f AS (SELECT s_suppkey AS fid, (s_suppkey % 10) * 5.0 - 25 AS x0, (s_suppkey // 10 % 10) * 5.0 - 25 AS y0, 70.0 + s_nationkey AS z0 FROM supplier)"""


@query(f"""WITH {_FACE}, r AS (SELECT p_partkey AS rid, p_size - 25.0 AS x, (p_retailprice % 50.0) - 25.0 AS y, 80.0 + (p_partkey % 40) AS z FROM part),
c AS (SELECT rid, fid, sqrt(x*x+y*y+z*z) AS l, z0*sqrt(x*x+y*y+z*z)/z AS d, x*z0/z - x0 AS hx, y*z0/z - y0 AS hy FROM r, f)
SELECT rid, round(min(abs(d - l)), 4) AS err FROM c WHERE hx >= -1e-6 AND hy >= -1e-6 AND hx/6 + hy/6 <= 1 + 1e-6 GROUP BY 1""")
def mesh_ray_error(t):
    """Rays from the origin against horizontal triangles, one per supplier."""
    k = F.col("s_suppkey")
    x0, y0 = k % 10 * 5.0 - 25, F.floor(k / 10) % 10 * 5.0 - 25
    z0 = 70.0 + F.col("s_nationkey")
    f = t.supplier.select(k.alias("fid"), x0.alias("x0"), y0.alias("y0"), z0.alias("z0"), (x0 + 6).alias("x1"), y0.alias("y1"), z0.alias("z1"), x0.alias("x2"), (y0 + 6).alias("y2"), z0.alias("z2"))
    r = landmarks(t).select(F.col("kp_id").alias("rid"), "pt.x", "pt.y", "pt.z")
    return mesh_ray_errors(r, f, "rid", "fid").select("rid", F.round("score", 4).alias("err"))


@query()
def essential_matrices(t):
    """Two-view geometry of frame pairs three apart within a session-sized neighbourhood; tested on exact views."""
    d = projected(t).select("frame_id", "kp_id", (F.col("cam.x") / F.col("cam.z")).alias("x"), (F.col("cam.y") / F.col("cam.z")).alias("y"))
    g = d.withColumn("grp", F.floor(F.col("frame_id") / 200))
    a = g.groupBy("grp", "kp_id").agg(F.min_by(F.struct("x", "y"), "frame_id").alias("a"), F.max_by(F.struct("x", "y"), "frame_id").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    p = a.select("grp", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1"))
    e = A.essential_matrix(p, ["grp"])
    j = p.join(e, "grp").withColumn("err", A.epipolar_error(F.col("e"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    return j.groupBy("grp").agg(F.count_if(F.col("err") < 0.05).alias("inliers"), F.count(F.lit(1)).alias("n"))


_PAIR = f"""v AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part)),
a AS (SELECT l_suppkey AS pair, count(*) AS n, count(*) FILTER (WHERE (3 * l_partkey + l_suppkey) % 10 >= 3) AS inliers, 4.0::DOUBLE + l_suppkey % 5 AS tx, l_suppkey % 3 - 1.0::DOUBLE AS ty,
  0.5::DOUBLE * (l_suppkey % 4) AS tz, {q_ypr("radians(l_suppkey % 11 - 5)", "radians(l_suppkey % 7 - 3)", "radians(l_suppkey % 13 - 6)", "q")} FROM v GROUP BY l_suppkey)"""


def view_pairs(t):
    """A pair of views per supplier, of the parts in its line items: (pair, kp_id, x0, y0, x1, y1), three tenths of the second views moved."""
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    deg = lambda e: F.radians(e.cast("double"))
    second = t.lineitem.select("l_suppkey").distinct().select(
        "l_suppkey", R.from_ypr(deg(s % 11 - 5), deg(s % 7 - 3), deg(s % 13 - 6)).alias("quat"), V.vec(4.0 + s % 5, s % 3 - 1.0, 0.5 * (s % 4)).alias("loc"))
    d = t.lineitem.select("l_suppkey", "l_partkey").distinct().join(landmarks(t), F.col("kp_id") == k).join(second, "l_suppkey")
    d = computed(d, c=V.add(R.rotate(F.col("quat"), F.col("pt")), F.col("loc")))
    wrong = (3 * k + s) % 10 < 3
    off = F.when(k % 2 == 0, 1.0).otherwise(-1.0) * (0.1 + 0.01 * F.pmod(F.hash("kp_id", s), F.lit(37)))
    d = computed(d, x0=F.col("pt.x") / F.col("pt.z"), y0=F.col("pt.y") / F.col("pt.z"),
                 x1=F.col("c.x") / F.col("c.z") + F.when(wrong, off / 3).otherwise(0.0), y1=F.col("c.y") / F.col("c.z") + F.when(wrong, off).otherwise(0.0))
    return d.select(s.alias("pair"), "kp_id", "x0", "y0", "x1", "y1")


@query(f"""WITH {_PAIR} SELECT pair, n, inliers, inliers AS front, true AS ok, round(qw, 4)+0.0 AS w, round(qx, 4)+0.0 AS x, round(qy, 4)+0.0 AS y, round(qz, 4)+0.0 AS z,
 round(tx / sqrt(tx*tx+ty*ty+tz*tz), 3)+0.0 AS dx, round(ty / sqrt(tx*tx+ty*ty+tz*tz), 3)+0.0 AS dy, round(tz / sqrt(tx*tx+ty*ty+tz*tz), 3)+0.0 AS dz FROM a""")
def relative_poses(t):
    """Rotation and direction between the two views of every supplier's pair, with three tenths of the correspondences wrong; the true poses come back."""
    from navlytics.plans import twoview

    d = twoview.relative_poses(view_pairs(t), "pair", "kp_id", 1e-6)
    return d.select("pair", "n", "inliers", "front", "ok", *[rnd(F.col(f"quat.{k}"), 4).alias(k) for k in "wxyz"], *[rnd(F.col(f"dir.{k}"), 3).alias(f"d{k}") for k in "xyz"])


@query("""WITH v AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part))
SELECT l_partkey AS kp_id, count(*) AS total_count, count(*) FILTER (WHERE (3 * l_partkey + l_suppkey) % 10 >= 3) AS inlier_count, max(l_suppkey) FILTER (WHERE (3 * l_partkey + l_suppkey) % 10 >= 3) AS inlier_in
FROM v GROUP BY 1""")
def keypoint_counters(t):
    """How often every landmark was seen in a solved pair of views, how often it agreed, and where last."""
    from navlytics.plans import twoview

    pairs = view_pairs(t)
    return twoview.keypoint_counters(pairs, twoview.relative_poses(pairs, "pair", "kp_id", 1e-6), "pair", "kp_id", 1e-6)


@query()
def resection(t):
    """Camera pose of every frame group from landmarks with corrupted views; tested on a small scene."""
    d = placed(t, observations(t).select("frame_id", "kp_id"))
    d = d.select("frame_id", "kp_id", "pt", (F.col("cam.x") / F.col("cam.z")).alias("x"), (F.col("cam.y") / F.col("cam.z")).alias("y"))
    r = A.resection_ransac(d, "frame_id", "kp_id", 8.0 / 500)
    return r.select("frame_id", "inliers")


@query(f"""WITH {FRAMES_SQL} SELECT frame_id, round(qw, 4)+0.0 AS w, round(qx, 4)+0.0 AS x, round(qy, 4)+0.0 AS y, round(qz, 4)+0.0 AS z FROM frames""")
def rotation_alignment(t):
    """Rotation recovered from three mapped vectors per frame."""
    f = frames(t).withColumn("src", F.explode(F.array(V.vec(1.0, 0.2, 0.0), V.vec(0.0, 1.0, -0.3), V.vec(0.5, 0.0, 1.0))))
    f = f.select("frame_id", "src", R.rotate(F.col("quat"), F.col("src")).alias("dst"))
    d = A.align_rotation(f, ["frame_id"], "src", "dst")
    return d.select("frame_id", *[rnd(F.col(f"quat.{k}"), 4).alias(k) for k in "wxyz"])


@query("""WITH o AS (SELECT l_partkey, l_suppkey % 130 AS b FROM lineitem),
w AS (SELECT l_partkey, b // 60 AS word, bit_or(1::BIGINT << (b % 60)) AS bits, count(DISTINCT b) AS n, bool_or(b % 7 = 0) AS f FROM o GROUP BY 1, 2)
SELECT l_partkey, word, bits, (sum(n) OVER p)::BIGINT AS batches, bool_or(f) OVER p AS frozen FROM w WINDOW p AS (PARTITION BY l_partkey)""")
def batch_membership(t):
    from navlytics.plans.mapping import batch_membership as membership

    obs = t.lineitem.select("l_partkey", (F.col("l_suppkey") % 130).alias("batch"))
    return membership(obs, "l_partkey", "batch", obs.select("batch").where("batch % 7 = 0"))


@query(f"""{PROJ_SQL} SELECT frame_id, kp_id, round(degrees(acos(least(greatest((cx*(cx+lx)+cy*(cy+ly)+cz*(cz+lz))/(sqrt(cx*cx+cy*cy+cz*cz)*sqrt(pow(cx+lx,2)+pow(cy+ly,2)+pow(cz+lz,2))),-1),1))),3) AS deg
 FROM proj WHERE degrees(acos(least(greatest((cx*(cx+lx)+cy*(cy+ly)+cz*(cz+lz))/(sqrt(cx*cx+cy*cy+cz*cz)*sqrt(pow(cx+lx,2)+pow(cy+ly,2)+pow(cz+lz,2))),-1),1))) > 3""")
def viewpoint_angles(t):
    from navlytics.plans.mapping import viewpoint_angle

    d = projected(t).withColumn("deg", F.degrees(viewpoint_angle(F.col("cam"), F.col("loc")))).where("deg > 3")
    return d.select("frame_id", "kp_id", F.round("deg", 3).alias("deg"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_extendedprice / 1000 AS v, l_discount * 100 AS z, 1 + l_tax * 100 AS p,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey) >= 2),
t AS (SELECT a.l_orderkey AS k, a.q, a.v, b.p, b.z FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.n = 1 AND b.n = 2)
SELECT k * 10 + 2 AS frame_id, round(p * q / (p + q), 6) + 0.0 AS known, round(p * (z + (q * v - p * z) / (p + q)) + 1e-8, 4) + 0.0 AS pull FROM t""")
def marginal_prior(t):
    """What a measured first frame and the step to the second tell about the second once the first is dropped, for every order's first two lines."""
    from pyspark.sql import Window as W

    from navlytics.plans import prior as M

    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")  # an order has a few lines
    d = t.lineitem.withColumn("n", F.row_number().over(w)).withColumn("lines", F.count(F.lit(1)).over(W.partitionBy("l_orderkey"))).where("lines >= 2 AND n <= 2")
    frame = F.col("l_orderkey") * 10
    along = lambda c: F.array(*[F.lit(0.0)] * 3, c, F.lit(0.0), F.lit(0.0))
    sd, weight = F.sqrt("l_quantity"), F.sqrt(1 + F.col("l_tax") * 100)
    seen = d.where("n = 1").select((frame * 10).alias("row_id"), (frame + 1).alias("frame_id"), along(-sd).alias("j"), F.array(sd * F.col("l_extendedprice") / 1000).alias("e"))
    step = d.where("n = 2").withColumn("side", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        (frame * 10 + 1).alias("row_id"), (frame + F.col("side")).alias("frame_id"),
        along(F.when(F.col("side") == 1, weight).otherwise(-weight)).alias("j"), F.array(weight * F.col("l_discount") * 100).alias("e"))
    blocks, rhs = M.factors(seen.unionByName(step), 1)
    blocks, rhs = M.eliminate(blocks, rhs, seen.select("frame_id"))
    j = blocks.where("fa = fb").select(F.col("fa").alias("frame_id"), F.col("h")[21].alias("known")).join(rhs, "frame_id")
    return j.select("frame_id", rnd(F.col("known"), 6).alias("known"), rnd(F.col("b")[3] + 1e-8, 4).alias("pull"))


@query("""WITH v AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part)),
f AS (SELECT l_orderkey, count(*) AS n FROM v WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1 HAVING count(*) >= 4)
SELECT o_custkey % 7 AS cam_id, 500.0 + 5 * (o_custkey % 7) AS fx, 510.0 - 4 * (o_custkey % 7) AS fy, round(-0.12 + 0.01 * (o_custkey % 7), 3) AS k1,
  round(0.03 - 0.002 * (o_custkey % 7), 3) AS k2, CAST(sum(n) AS BIGINT) AS n_obs, true AS converged FROM orders JOIN f ON o_orderkey = l_orderkey GROUP BY 1, 2, 3, 4, 5""")
def camera_calibration(t):
    """Focal lengths and radial distortion of seven cameras with their frames' poses, from exact views in frames that see four landmarks or more.

    The solve starts from one wrong camera and shifted poses; the true cameras come back.
    """
    from pyspark.sql import Window as W

    from navlytics.functions.vectors import vec
    from navlytics.plans import calibration as K

    own = (F.col("session") % 7).alias("cam_id")
    d = placed(t, observations(t).select("frame_id", "kp_id")).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("frame_id"))).where("n >= 4")
    d = d.withColumn("cam_id", F.col("session") % 7)
    d = d.withColumns({"x": F.col("cam.x") / F.col("cam.z"), "y": F.col("cam.y") / F.col("cam.z")}).withColumn("r2", F.col("x") ** 2 + F.col("y") ** 2)
    rad = 1 + F.col("r2") * ((-0.12 + 0.01 * F.col("cam_id")) + F.col("r2") * (0.03 - 0.002 * F.col("cam_id")))
    obs = written(d.select("frame_id", "kp_id", (F.col("x") * rad * (500 + 5 * F.col("cam_id")) + 320).alias("u"), (F.col("y") * rad * (510 - 4 * F.col("cam_id")) + 240).alias("v")))
    poses = computed(frames(t).join(obs.select("frame_id").distinct(), "frame_id"), true=R.to_rotvec(F.col("quat")))
    poses = computed(poses, rot=R.compose_rotvecs(vec(0.002, -0.001, 0.001), F.col("true")))
    poses = poses.select("frame_id", own, "rot", V.add(F.col("loc"), vec(0.2, -0.2, 0.3)).alias("loc"))
    start = {"fx": 505.0, "fy": 505.0, "cx": 320.0, "cy": 240.0, "k1": 0.0, "k2": 0.0, "p1": 0.0, "p2": 0.0}
    cams = poses.select("cam_id").distinct().select("cam_id", *[F.lit(v).alias(c) for c, v in start.items()])
    res = K.calibrate(obs, poses, landmarks(t), cams, s=A.Settings(huber_px=1e9, ftol=1e-9))
    return res.cams.select("cam_id", F.round("fx", 1).alias("fx"), F.round("fy", 1).alias("fy"), F.round("k1", 3).alias("k1"), F.round("k2", 3).alias("k2"), "n_obs", "converged")
