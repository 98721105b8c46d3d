"""Poses as STRUCT<loc: vec3, quat: quat, vel: vec3>.  A pose maps world points into its frame."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from navlytics.functions import let, num, record
from navlytics.functions import rotations as R
from navlytics.functions import vectors as V


def pose(loc: Column, quat: Column, vel: Column | None = None) -> Column:
    zero = V.vec(0.0, 0.0, 0.0)
    return record(loc=loc, quat=quat, vel=zero if vel is None else vel)


def identity() -> Column:
    return pose(V.vec(0.0, 0.0, 0.0), R.one())


def add(p: Column, delta: Column) -> Column:
    """Apply a delta pose after p, rotations about space-fixed axes."""
    return pose(V.add(R.rotate(delta.quat, p.loc), delta.loc), let(R.mul(delta.quat, p.quat), R.unit))


def neg(p: Column) -> Column:
    return let(R.conj(p.quat), lambda c: pose(R.rotate(c, V.neg(p.loc)), c, R.rotate(c, V.neg(p.vel))))


def sub(p: Column, q: Column) -> Column:
    """Delta with add(q, sub(p, q)) == p."""
    return let(neg(q), lambda n: add(n, p))


def to_global(p: Column, frame: Column, is_rot: bool = True) -> Column:
    q = R.mul(frame.quat, p.quat)
    return pose(
        V.add(R.rotate(frame.quat, p.loc), frame.loc),
        let(q, lambda h: R.mul(h, R.conj(frame.quat))) if is_rot else q,
        R.rotate(frame.quat, p.vel),
    )


def to_local(p: Column, frame: Column, is_rot: bool = True) -> Column:
    c = R.conj(frame.quat)
    q = R.mul(c, p.quat)
    return pose(R.rotate(c, V.sub(p.loc, frame.loc)), let(q, lambda h: R.mul(h, frame.quat)) if is_rot else q, R.rotate(c, p.vel))


def to_array(p: Column) -> Column:
    q = p.quat
    return F.array(p.loc.x, p.loc.y, p.loc.z, q.w, q.x, q.y, q.z)


def to_matrix(p: Column) -> Column:
    """Row-major 3x4 ARRAY<DOUBLE>(12)."""
    return let(R.matrix(p.quat), lambda m: F.concat(
        F.slice(m, 1, 3), F.array(p.loc.x), F.slice(m, 4, 3), F.array(p.loc.y), F.slice(m, 7, 3), F.array(p.loc.z)))


def from_matrix(m: Column) -> Column:
    rot = F.concat(F.slice(m, 1, 3), F.slice(m, 5, 3), F.slice(m, 9, 3))
    return pose(V.vec(m[3], m[7], m[11]), let(rot, R.from_matrix))


def apply(p: Column, point: Column) -> Column:
    """World point into the frame of the pose."""
    return V.add(R.rotate(p.quat, point), p.loc)


def centre(p: Column) -> Column:
    """Camera centre in the world."""
    return R.rotate(R.conj(p.quat), V.neg(p.loc))


def retract(rotvec: Column, loc: Column, d_rot: Column, d_loc: Column) -> Column:
    """Manifold step: rotation part composed, location part added.  STRUCT<rot, loc>."""
    return F.struct(R.compose_rotvecs(d_rot, rotvec).alias("rot"), V.add(loc, d_loc).alias("loc"))


def add_with_variance(p: Column, d: Column, p_var: Column, d_var: Column) -> Column:
    """Older additive algebra: locations and variances add, the rotation is composed."""
    return F.struct(
        V.add(p.loc, d.loc).alias("loc"), R.mul(d.quat, p.quat).alias("quat"), (p_var + d_var).alias("var")
    )


def sub_with_variance(p: Column, q: Column, p_var: Column, q_var: Column) -> Column:
    return F.struct(
        V.sub(p.loc, q.loc).alias("loc"), R.mul(p.quat, R.conj(q.quat)).alias("quat"), (p_var - q_var).alias("var")
    )


def interpolate(p: Column, q: Column, weight) -> Column:
    """Linear location and shortest-rotation orientation between two poses."""
    w = num(weight)
    return pose(V.add(V.scale(p.loc, 1.0 - w), V.scale(q.loc, w)), R.slerp_aa(p.quat, q.quat, w))
