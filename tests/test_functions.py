"""Properties of the column functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from navlytics.functions import camera as C
from navlytics.functions import physics as Y
from navlytics.functions import poses as P
from navlytics.functions import rotations as R
from navlytics.functions import vectors as V


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_rotation_of_known_vector(spark):
    r = one(spark, v=R.rotate(R.quat(0.5, 0.5, 0.5, 0.5), V.vec(1.0, 2.0, 3.0))).v
    np.testing.assert_allclose([r.x, r.y, r.z], [3, 1, 2])


@pytest.mark.parametrize("order,rev", [("xyz", False), ("zxz", False), ("zyx", True)])
def test_euler_order(spark, order, rev):
    ang = (0.3, -0.7, 1.1)
    want = R.one()
    for a, x in zip(ang, order):
        want = R.mul(R.axis_quat(x, a), want) if rev else R.mul(want, R.axis_quat(x, a))
    r = one(spark, a=R.from_euler(ang, order, rev), b=want)
    np.testing.assert_allclose(list(r.a), list(r.b), atol=1e-12)


def test_pose_difference_and_matrix(spark):
    p = P.pose(V.vec(1.0, -2.0, 0.5), R.from_ypr(0.4, -0.2, 1.0))
    q = P.pose(V.vec(-3.0, 0.2, 2.0), R.from_ypr(-1.4, 0.3, 0.1))
    r = one(spark, a=P.to_array(P.add(q, P.sub(p, q))), b=P.to_array(p), c=P.to_array(P.from_matrix(P.to_matrix(p))),
            g=P.to_array(P.to_local(P.to_global(p, q), q)))
    for k in "acg":
        np.testing.assert_allclose(r[k], r.b, atol=1e-12)


def test_interpolation_ends(spark):
    p = P.pose(V.vec(1.0, 0.0, 0.0), R.from_ypr(0.4, 0.0, 0.0))
    q = P.pose(V.vec(3.0, 0.0, 0.0), R.from_ypr(1.0, 0.0, 0.0))
    r = one(spark, m=R.to_ypr(P.interpolate(p, q, 0.5).quat), e=P.to_array(P.interpolate(p, q, 1.0)), b=P.to_array(q))
    assert r.m.yaw == pytest.approx(0.7)
    np.testing.assert_allclose(r.e, r.b, atol=1e-12)


def test_distortion_inverse(spark):
    cam = C.Camera.from_fov(640, 480, 50.0, 40.0, (-0.1, 0.02, 0.001, -0.001, 0.003))
    r = one(spark, d=C.let(cam.distort(100.0, 400.0), lambda p: cam.undistort(p.x, p.y, 15)))
    np.testing.assert_allclose(list(r.d), [100, 400], atol=1e-6)
    assert cam.x_fov == pytest.approx(50.0) and np.allclose(np.array(cam.matrix()).reshape(3, 3) @ np.array(cam.inverse_matrix()).reshape(3, 3), np.eye(3))


def test_ray_triangle_hit_and_miss(spark):
    tri = [V.vec(-1.0, -1.0, 5.0), V.vec(3.0, -1.0, 5.0), V.vec(-1.0, 3.0, 5.0)]
    r = one(spark, hit=V.ray_triangle(V.vec(0.0, 0.0, 0.0), V.vec(0.0, 0.0, 4.0), *tri), miss=V.ray_triangle(V.vec(0.0, 0.0, 0.0), V.vec(9.0, 0.0, 4.0), *tri))
    assert r.hit == pytest.approx(1.0) and r.miss is None


def test_kepler_and_orbit(spark):
    r = one(spark, e=Y.eccentric_anomaly(0.6, 2.0, 1e-9), p=Y.orbit_position(2.0, 0.3, 0.0, 0.0, 0.0, 0.0))
    assert r.e - 0.6 * math.sin(r.e) == pytest.approx(2.0, abs=1e-8)
    np.testing.assert_allclose(list(r.p), [1.4, 0, 0], atol=1e-6)


def test_spectral_flux_close_to_fine_sum(spark):
    qe = [0.2, 0.5, 0.3]
    r = one(spark, a=Y.sensed_electron_flux(5800.0, qe, 4e-7, 9e-7, 100), b=Y.sensed_electron_flux(5800.0, qe, 4e-7, 9e-7, 1000))
    assert r.a == pytest.approx(r.b, rel=0.02)


def test_rough_reflectance_tends_to_smooth(spark):
    kw = dict(w=0.1, b=-0.2, b_sh0=1.0, hs=0.05)
    r = one(spark, s=Y.hapke_radiance(0.8, 0.7, 0.6, **kw), t=Y.hapke_radiance(0.8, 0.7, 0.6, theta=1e-3, **kw), dark=Y.hapke_radiance(-0.1, 0.7, 0.6, **kw))
    assert r.t == pytest.approx(r.s, rel=1e-2) and r.dark == 0


def test_full_frame_crop_changes_nothing(spark):
    r = one(spark, c=Y.crop_transform(0.0, 0.0, 640.0, 480.0, 640, 480, 30.0, 24.0)).c
    assert r.scale == 1.0 and r.quat.w == pytest.approx(1.0)


def test_clipping_and_wrapping(spark):
    r = one(spark, a=V.wrap_rads(F.lit(-math.pi)), b=V.wrap_degs(F.lit(540.0)), c=C.padded_distortion(F.array(F.lit(0.5))))
    assert r.a == pytest.approx(-math.pi) and r.b == -180 and r.c == [0.5] + [0.0] * 7


def test_roughness_follows_the_published_equations(spark):
    """Both orders of the two rays, and equal ones."""
    import math

    from navlytics.functions.physics import _rough_effective

    theta = math.radians(20)

    def plain(i, e, psi):
        t = math.tan(theta)
        x = 1 / math.sqrt(1 + math.pi * t * t)
        e1, e2 = (lambda a: math.exp(-2 / math.pi / (t * math.tan(a)))), (lambda a: math.exp(-1 / math.pi / (t * math.tan(a)) ** 2))
        eta = lambda a: x * (math.cos(a) + math.sin(a) * t * e2(a) / (2 - e1(a)))
        h, f = math.sin(psi / 2) ** 2, math.exp(-2 * math.tan(psi / 2))
        if i <= e:
            d = 2 - e1(e) - psi / math.pi * e1(i)
            m0, m = x * (math.cos(i) + math.sin(i) * t * (math.cos(psi) * e2(e) + h * e2(i)) / d), x * (math.cos(e) + math.sin(e) * t * (e2(e) - h * e2(i)) / d)
            last = math.cos(i) / eta(i)
        else:
            d = 2 - e1(i) - psi / math.pi * e1(e)
            m0, m = x * (math.cos(i) + math.sin(i) * t * (e2(i) - h * e2(e)) / d), x * (math.cos(e) + math.sin(e) * t * (math.cos(psi) * e2(i) + h * e2(e)) / d)
            last = math.cos(e) / eta(e)
        return m0, m, m / eta(e) * math.cos(i) / eta(i) * x / (1 - f + f * x * last)

    rows = [(i, e, psi) for i in (0.2, 0.7, 1.2) for e in (0.2, 0.7, 1.2) for psi in (0.1, 1.5, 3.0)]
    df = spark.createDataFrame(rows, "i double, e double, psi double")
    got = df.select("i", "e", "psi", _rough_effective(F.cos("i"), F.cos("e"), F.col("psi"), theta).alias("r")).select("i", "e", "psi", "r.*").collect()
    for r in got:
        assert all(abs(a - b) < 1e-9 for a, b in zip((r.mu0, r.mu, r.s), plain(r.i, r.e, r.psi)))


def test_steps_by_batch_and_by_projection_equal_the_bound_ones(spark):
    """nested bindings took 160 microseconds a row."""
    cam = C.Camera(640, 480, 500.0, 510.0, 320.0, 240.0, (-0.12, 0.03, 0.001, -0.0015))
    rows = [(float(37 * i % 640), float(53 * i % 480), 0.01 * i) for i in range(200)] + [(None, 3.0, 0.1), (4.0, None, 0.1), (float("nan"), 7.0, 0.1), (9.0, 9.0, 3.0)]
    d = spark.createDataFrame(rows, "u double, v double, t double")
    both = cam.undistorted(d.withColumn("a", cam.undistort("u", "v", 12)), F.col("u"), F.col("v"), "b", 12)
    same = lambda a, b: F.col(f"{a}.x").eqNullSafe(F.col(f"{b}.x")) & F.col(f"{a}.y").eqNullSafe(F.col(f"{b}.y"))
    assert both.count() == 204 and both.where("u is not null and v is not null").where(~same("a", "b")).count() == 0
    assert both.where("u is null or v is null").where("a.x is not null or a.y is not null or b.x is not null or b.y is not null").count() == 0
    turn = R.axis_quat("y", F.col("t"))
    both = cam.rotated_pixel(d.withColumn("a", cam.rotate_pixel(turn, "u", "v")), turn, "u", "v", "b")
    assert both.where(~same("a", "b")).count() == 0
    # no function of higher order is left in the plans
    plan = cam.rotated_pixel(d, turn, "u", "v", "b")._jdf.queryExecution().executedPlan().toString()
    assert "transform(" not in plan
