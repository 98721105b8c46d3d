"""3-vectors as STRUCT<x, y, z: DOUBLE>."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from navlytics.functions import clip, let, num, record


def vec(x, y, z) -> Column:
    return record(x=x, y=y, z=z)


def add(a: Column, b: Column) -> Column:
    return vec(a.x + b.x, a.y + b.y, a.z + b.z)


def sub(a: Column, b: Column) -> Column:
    return vec(a.x - b.x, a.y - b.y, a.z - b.z)


def scale(a: Column, k) -> Column:
    return vec(a.x * num(k), a.y * num(k), a.z * num(k))


def neg(a: Column) -> Column:
    return vec(-a.x, -a.y, -a.z)


def dot(a: Column, b: Column) -> Column:
    return a.x * b.x + a.y * b.y + a.z * b.z


def cross(a: Column, b: Column) -> Column:
    return vec(a.y * b.z - a.z * b.y, a.z * b.x - a.x * b.z, a.x * b.y - a.y * b.x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Unit vector; the zero vector stays zero."""
    n = norm(a)
    return scale(a, F.when(n > 0, 1.0 / n).otherwise(0.0))


def angle_between(a: Column, b: Column) -> Column:
    """Unsigned angle in [0, pi]; NULL when a vector is zero."""
    return F.acos(clip(F.try_divide(dot(a, b), norm(a) * norm(b)), -1.0, 1.0))


def signed_angle(a: Column, b: Column, direction: Column) -> Column:
    """Angle in (-pi, pi], positive when a x b points along ``direction``."""
    c = cross(a, b)
    return F.atan2(norm(c) * F.signum(dot(c, direction)), dot(a, b))


def parallax(centre0: Column, centre1: Column, point: Column) -> Column:
    return angle_between(sub(centre0, point), sub(centre1, point))


def triangle_normal(p0: Column, p1: Column, p2: Column) -> Column:
    return normalize(cross(sub(p1, p0), sub(p2, p0)))


def projection(a: Column, b: Column) -> Column:
    return scale(b, F.try_divide(dot(a, b), dot(b, b)))


def rejection(a: Column, b: Column) -> Column:
    return sub(a, projection(a, b))


def dist_across(a: Column, b: Column) -> Column:
    """Distance of point a from the line along b."""
    return norm(rejection(a, b))


def dist_along(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(b))


def angular_radius(loc: Column, radius) -> Column:
    return F.asin(F.try_divide(num(radius), norm(loc)))


def to_spherical(v: Column) -> Column:
    """STRUCT<lat, lon, r>."""
    r = norm(v)
    return F.struct(
        (F.lit(math.pi / 2) - F.acos(clip(F.try_divide(v.z, r), -1.0, 1.0))).alias("lat"),
        F.atan2(v.y, v.x).alias("lon"),
        r.alias("r"),
    )


def from_spherical(lat, lon, r) -> Column:
    lat, lon, r = num(lat), num(lon), num(r)
    return vec(r * F.cos(lat) * F.cos(lon), r * F.cos(lat) * F.sin(lon), r * F.sin(lat))


def wrap_rads(a) -> Column:
    """To [-pi, pi)."""
    return F.pmod(num(a) + math.pi, F.lit(2 * math.pi)) - math.pi


def wrap_degs(a) -> Column:
    """To [-180, 180)."""
    return F.pmod(num(a) + 180.0, F.lit(360.0)) - 180.0


def ray_triangle(origin: Column, target: Column, p0: Column, p1: Column, p2: Column, eps: float = 1e-6) -> Column:
    """Signed error along the ray: hit distance minus the distance of ``target``; NULL when missed."""
    edges = F.struct(sub(target, origin).alias("ray"), sub(p1, p0).alias("e1"), sub(p2, p0).alias("e2"), sub(origin, p0).alias("t"))

    def solve(g: Column) -> Column:
        parts = F.struct(
            norm(g.ray).alias("len"), normalize(g.ray).alias("d"), cross(g.t, g.e1).alias("q"))
        return let(parts, lambda h: let(cross(h.d, g.e2), lambda pv: let(dot(g.e1, pv), lambda det: let(
            F.struct(F.try_divide(dot(g.t, pv), det).alias("u"), F.try_divide(dot(h.d, h.q), det).alias("v"),
                     F.try_divide(dot(g.e2, h.q), det).alias("s")),
            lambda r: F.when(
                (h.len >= eps) & (F.abs(det) >= eps) & (r.u >= -eps) & (r.u <= 1 + eps) & (r.v >= -eps)
                & (r.u + r.v <= 1 + eps), r.s - h.len)))))

    return let(edges, solve)
