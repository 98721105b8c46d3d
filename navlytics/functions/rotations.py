"""Unit quaternions as STRUCT<w, x, y, z: DOUBLE>, rotation vectors as STRUCT<x, y, z>."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from navlytics.functions import clip, let, num, record
from navlytics.functions import vectors as V


def quat(w, x, y, z) -> Column:
    return record(w=w, x=x, y=y, z=z)


def one() -> Column:
    return quat(1.0, 0.0, 0.0, 0.0)


def conj(q: Column) -> Column:
    return quat(q.w, -q.x, -q.y, -q.z)


def mul(a: Column, b: Column) -> Column:
    return quat(
        a.w * b.w - a.x * b.x - a.y * b.y - a.z * b.z,
        a.w * b.x + a.x * b.w + a.y * b.z - a.z * b.y,
        a.w * b.y - a.x * b.z + a.y * b.w + a.z * b.x,
        a.w * b.z + a.x * b.y - a.y * b.x + a.z * b.w,
    )


def unit(q: Column) -> Column:
    n = F.sqrt(q.w * q.w + q.x * q.x + q.y * q.y + q.z * q.z)
    return quat(q.w / n, q.x / n, q.y / n, q.z / n)


def rotate(q: Column, v: Column) -> Column:
    """q v q* for unit q."""
    u = V.vec(q.x, q.y, q.z)
    t = V.scale(V.cross(u, v), 2.0)
    return V.add(V.add(v, V.scale(t, q.w)), V.cross(u, t))


def axis_quat(axis: str, angle) -> Column:
    h = num(angle) / 2.0
    s = F.sin(h)
    zero = F.lit(0.0)
    return quat(F.cos(h), *[s if a == axis else zero for a in "xyz"])


def _turn(q: Column, axis: str, angle, left: bool) -> Column:
    """q times (or preceded by) a rotation about one axis: two products per component, no zeros."""
    c, s = F.cos(num(angle) / 2.0), F.sin(num(angle) / 2.0)
    k = "xyz".index(axis)
    a, b = "xyz"[(k + 1) % 3], "xyz"[(k + 2) % 3]
    if left:
        s1 = {axis: getattr(q, axis) * c + q.w * s, a: getattr(q, a) * c - getattr(q, b) * s, b: getattr(q, b) * c + getattr(q, a) * s}
    else:
        s1 = {axis: getattr(q, axis) * c + q.w * s, a: getattr(q, a) * c + getattr(q, b) * s, b: getattr(q, b) * c - getattr(q, a) * s}
    return quat(q.w * c - getattr(q, axis) * s, s1["x"], s1["y"], s1["z"])


def from_euler(angles, order: str = "xyz", reverse: bool = False) -> Column:
    """Body-fixed axis rotations multiplied left to right (or right to left)."""
    def turn(axis: str, angle):
        return lambda q: _turn(q, axis, angle, reverse)

    out = None
    for angle, axis in zip(angles, order, strict=True):
        out = axis_quat(axis, angle) if out is None else let(out, turn(axis, angle))
    return one() if out is None else out


def from_ypr(yaw, pitch, roll) -> Column:
    """z-y'-x'' angles, in closed form."""
    c = [F.cos(num(a) / 2.0) for a in (yaw, pitch, roll)]
    s = [F.sin(num(a) / 2.0) for a in (yaw, pitch, roll)]
    return quat(
        c[0] * c[1] * c[2] + s[0] * s[1] * s[2],
        c[0] * c[1] * s[2] - s[0] * s[1] * c[2],
        c[0] * s[1] * c[2] + s[0] * c[1] * s[2],
        s[0] * c[1] * c[2] - c[0] * s[1] * s[2],
    )


def from_lat_lon_roll(lat, lon, roll) -> Column:
    return from_ypr(lon, -num(lat), roll)


def to_ypr(q: Column) -> Column:
    """STRUCT<yaw, pitch, roll>."""
    return F.struct(
        F.atan2(q.x * q.y + q.w * q.z, 0.5 - q.y * q.y - q.z * q.z).alias("yaw"),
        F.asin(clip(2.0 * (q.w * q.y - q.x * q.z), -1.0, 1.0)).alias("pitch"),
        F.atan2(q.y * q.z + q.w * q.x, 0.5 - q.x * q.x - q.y * q.y).alias("roll"),
    )


def to_lat_lon_roll(q: Column) -> Column:
    return let(to_ypr(q), lambda e: F.struct((-e.pitch).alias("lat"), e.yaw.alias("lon"), e.roll.alias("roll")))


def to_angle_axis(q: Column) -> Column:
    """STRUCT<angle, axis>; a zero rotation has a zero axis."""
    return F.struct((2.0 * F.acos(clip(q.w, -1.0, 1.0))).alias("angle"), V.normalize(V.vec(q.x, q.y, q.z)).alias("axis"))


def to_rotvec(q: Column) -> Column:
    return V.scale(V.normalize(V.vec(q.x, q.y, q.z)), 2.0 * F.acos(clip(q.w, -1.0, 1.0)))


def from_angle_axis(angle, axis: Column) -> Column:
    a = V.normalize(axis)
    h = num(angle) / 2.0
    return quat(F.cos(h), a.x * F.sin(h), a.y * F.sin(h), a.z * F.sin(h))


def from_rotvec(rv: Column) -> Column:
    n = V.norm(rv)
    k = F.when(n > 0, F.sin(n / 2.0) / n).otherwise(0.0)
    return let(F.struct(F.cos(n / 2.0).alias("w"), k.alias("k")), lambda t: quat(t.w, rv.x * t.k, rv.y * t.k, rv.z * t.k))


def angle_between(a: Column, b: Column) -> Column:
    """Rotation angle between two orientations, in [0, pi]."""
    w = a.w * b.w + a.x * b.x + a.y * b.y + a.z * b.z
    return F.abs(V.wrap_rads(2.0 * F.acos(clip(w, -1.0, 1.0))))


def rotate_point(rv: Column, p: Column) -> Column:
    """Rodrigues rotation of a point by a rotation vector; zero-angle safe."""
    th = V.norm(rv)
    parts = F.struct(V.normalize(rv).alias("k"), F.cos(th).alias("c"), F.sin(th).alias("s"))
    return let(parts, lambda t: V.add(
        V.add(V.scale(p, t.c), V.scale(V.cross(t.k, p), t.s)), V.scale(t.k, V.dot(t.k, p) * (1.0 - t.c))))


def compose_rotvecs(adj: Column, base: Column) -> Column:
    """Rotation vector of (adj after base)."""
    pair = F.struct(from_rotvec(adj).alias("a"), from_rotvec(base).alias("b"))
    return let(pair, lambda p: let(mul(p.a, p.b), to_rotvec))


def unit_base(q: Column) -> Column:
    """STRUCT of the rotated x, y and z axes."""
    return let(matrix(q), lambda m: F.struct(
        V.vec(m[0], m[3], m[6]).alias("x"), V.vec(m[1], m[4], m[7]).alias("y"), V.vec(m[2], m[5], m[8]).alias("z")))


def matrix(q: Column) -> Column:
    """Row-major ARRAY<DOUBLE>(9)."""
    w, x, y, z = q.w, q.x, q.y, q.z
    return F.array(
        1.0 - 2.0 * (y * y + z * z), 2.0 * (x * y - w * z), 2.0 * (x * z + w * y),
        2.0 * (x * y + w * z), 1.0 - 2.0 * (x * x + z * z), 2.0 * (y * z - w * x),
        2.0 * (x * z - w * y), 2.0 * (y * z + w * x), 1.0 - 2.0 * (x * x + y * y),
    )


def from_matrix(m: Column) -> Column:
    """Quaternion with w >= 0 of a row-major rotation matrix array."""
    sq = lambda e: F.sqrt(F.greatest(e, F.lit(0.0)))
    # signs come from the antisymmetric part, so the half-turn case (all zero) keeps + signs
    sign = lambda e: F.when(e < 0, -1.0).otherwise(1.0)
    return quat(
        0.5 * sq(1.0 + m[0] + m[4] + m[8]),
        0.5 * sq(1.0 + m[0] - m[4] - m[8]) * sign(m[7] - m[5]),
        0.5 * sq(1.0 - m[0] + m[4] - m[8]) * sign(m[2] - m[6]),
        0.5 * sq(1.0 - m[0] - m[4] + m[8]) * sign(m[3] - m[1]),
    )


def wedge(w: Column) -> Column:
    """Skew-symmetric matrix of a vector, row-major ARRAY<DOUBLE>(9)."""
    z = F.lit(0.0)
    return F.array(z, -w.z, w.y, w.z, z, -w.x, -w.y, w.x, z)


def vee(m: Column) -> Column:
    return V.vec(m[7], m[2], m[3])


def log_matrix(m: Column) -> Column:
    """Rotation vector of a row-major rotation matrix."""
    trace = m[0] + m[4] + m[8]
    th = F.acos(clip((trace - 1.0) / 2.0, -1.0, 1.0))
    k = F.when(F.abs(th) < 1e-10, F.lit(0.5)).otherwise(F.try_divide(th, 2.0 * F.sin(th)))
    return V.scale(V.vec(m[7] - m[5], m[2] - m[6], m[3] - m[1]), k)


def slerp_aa(a: Column, b: Column, weight) -> Column:
    """Orientation between a and b at a weight, along the shortest rotation."""
    return let(mul(b, conj(a)), lambda d: mul(
        from_angle_axis(V.wrap_rads(2.0 * F.acos(clip(d.w, -1.0, 1.0))) * num(weight), V.vec(d.x, d.y, d.z)), a))


def discretize_step(tol: float) -> float:
    return math.sqrt(2.0) * tol


def weighted_pair_mean(a: Column, wa, b: Column, wb) -> Column:
    """Weighted mean of two orientations: a turned towards b by wb / (wa + wb)."""
    return slerp_aa(a, b, num(wb) / (num(wa) + num(wb)))
