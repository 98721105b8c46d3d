"""Rotation, pose, camera, geodesy and physics functions over whole tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from navlytics.functions import camera as C
from navlytics.functions import geodesy as G
from navlytics.functions import physics as Y
from navlytics.functions import poses as P
from navlytics.functions import rotations as R
from navlytics.functions import vectors as V
from navlytics.workload.base import CAM, FRAMES_SQL, PI, PROJ_SQL, Tables, frames, projected, q_mul, q_rot, q_ypr, query, rnd


def _j(xs):
    return [f"round({x},6)+0.0" for x in xs]


def _vsel(xs, names):
    return ", ".join(f'{a} AS "{n}"' for a, n in zip(_j(xs), names))


def _cols(c, prefix, parts):
    return [rnd(getattr(c, p)).alias(f"{prefix}{p}") for p in parts]


# two orientations and two vectors per order row, used by several queries
_YPR_A = ("radians((o_orderkey * 7) % 350 - 175)", "radians(o_custkey % 170 - 85)", "radians((o_orderkey * 3) % 340 - 170)")
_YPR_B = ("radians((o_custkey * 5) % 350 - 175)", "radians(o_orderkey % 170 - 85)", "radians((o_custkey * 11) % 340 - 170)")
_PAIR_SQL = f"""WITH p AS (SELECT o_orderkey AS id, {q_ypr(*_YPR_A, "a")}, {q_ypr(*_YPR_B, "g")},
  o_orderkey % 17 - 8.0::DOUBLE AS ux, o_custkey % 19 - 9.0::DOUBLE AS uy, o_orderkey % 5 + 1.0::DOUBLE AS uz,
  o_custkey % 13 - 6.0::DOUBLE AS vx, o_orderkey % 23 - 11.0::DOUBLE AS vy, o_custkey % 7 + 2.0::DOUBLE AS vz,
  {", ".join(f"{e} AS {n}" for e, n in zip(_YPR_A, ("yaw", "pitch", "roll")))} FROM orders)"""


def pairs(t: Tables):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    deg = lambda e: F.radians(e.cast("double"))
    return t.orders.select(
        k.alias("id"),
        deg(k * 7 % 350 - 175).alias("yaw"), deg(c % 170 - 85).alias("pitch"), deg(k * 3 % 340 - 170).alias("roll"),
        R.from_ypr(deg(k * 7 % 350 - 175), deg(c % 170 - 85), deg(k * 3 % 340 - 170)).alias("a"),
        R.from_ypr(deg(c * 5 % 350 - 175), deg(k % 170 - 85), deg(c * 11 % 340 - 170)).alias("b"),
        V.vec(k % 17 - 8.0, c % 19 - 9.0, k % 5 + 1.0).alias("u"),
        V.vec(c % 13 - 6.0, k % 23 - 11.0, c % 7 + 2.0).alias("v"),
    )


_U, _VV = ["ux", "uy", "uz"], ["vx", "vy", "vz"]


def _cross(a, b):
    return [f"({a[1]}*{b[2]}-{a[2]}*{b[1]})", f"({a[2]}*{b[0]}-{a[0]}*{b[2]})", f"({a[0]}*{b[1]}-{a[1]}*{b[0]})"]


def _dot(a, b):
    return "(" + "+".join(f"{x}*{y}" for x, y in zip(a, b)) + ")"


def _norm(a):
    return f"sqrt({_dot(a, a)})"


_ab = q_mul("a", "g")
_rot_u = q_rot("a", _U)


@query(f"{_PAIR_SQL} SELECT id, {_vsel(_ab, ('mw', 'mx', 'my', 'mz'))}, {_vsel(_rot_u, ('rx', 'ry', 'rz'))}, "
       f"{_vsel(q_rot('a', _U, True), ('ix', 'iy', 'iz'))}, {_vsel(q_rot('a', ['1', '0', '0']), ('ex', 'ey', 'ez'))} FROM p")
def quaternion_algebra(t):
    d = pairs(t)
    a, b, u = F.col("a"), F.col("b"), F.col("u")
    d = d.select("id", R.mul(a, b).alias("m"), R.rotate(a, u).alias("r"), R.rotate(R.conj(a), u).alias("i"), R.unit_base(a).x.alias("e"))
    return d.select("id", *_cols(d.m, "m", "wxyz"), *_cols(d.r, "r", "xyz"), *_cols(d.i, "i", "xyz"), *_cols(d.e, "e", "xyz"))


@query(f"{_PAIR_SQL} SELECT id, round(yaw,6)+0.0 AS yaw, round(pitch,6)+0.0 AS pitch, round(roll,6)+0.0 AS roll, "
       f"round(-pitch,6)+0.0 AS lat, round(yaw,6)+0.0 AS lon FROM p")
def ypr_quaternion_roundtrip(t):
    d = pairs(t).select("id", R.to_ypr(F.col("a")).alias("e"), R.to_lat_lon_roll(F.col("a")).alias("l"))
    return d.select("id", *_cols(d.e, "", ("yaw", "pitch", "roll")), *_cols(d.l, "", ("lat", "lon")))


_ang = f"2*acos(least(greatest({_dot(['aw', 'ax', 'ay', 'az'], ['gw', 'gx', 'gy', 'gz'])},-1),1))"


@query(f"{_PAIR_SQL} SELECT id, round(CASE WHEN {_ang} >= {PI} THEN 2*{PI}-{_ang} ELSE {_ang} END,6)+0.0 AS angle, "
       f"round(2*acos(least(greatest(aw,-1),1)),6)+0.0 AS theta, {_vsel(['ax/sqrt(ax*ax+ay*ay+az*az)', 'ay/sqrt(ax*ax+ay*ay+az*az)', 'az/sqrt(ax*ax+ay*ay+az*az)'], ('kx', 'ky', 'kz'))}, "
       f"{_vsel(['aw', 'ax', 'ay', 'az'], ('bw', 'bx', 'by', 'bz'))} FROM p")
def angle_axis(t):
    d = pairs(t).select("id", R.angle_between(F.col("a"), F.col("b")).alias("angle"), R.to_angle_axis(F.col("a")).alias("k"),
                        R.from_rotvec(R.to_rotvec(F.col("a"))).alias("q"))
    return d.select("id", rnd(d.angle).alias("angle"), rnd(d.k.angle).alias("theta"), *_cols(d.k.axis, "k", "xyz"), *_cols(d.q, "b", "wxyz"))


@query("""SELECT o_orderkey AS id, round(radians(((o_orderkey + 180) % 360) - 180),6)+0.0 AS rads,
 CAST(((o_orderkey + 180) % 360) - 180 AS DOUBLE) AS degs,
 CAST((((-o_orderkey + 180) % 360 + 360) % 360) - 180 AS DOUBLE) AS neg_degs FROM orders WHERE (o_orderkey + 180) % 360 <> 0""")
def wrap_angles(t):
    k = F.col("o_orderkey").cast("double")
    d = t.orders.where((F.col("o_orderkey") + 180) % 360 != 0)
    return d.select(F.col("o_orderkey").alias("id"), rnd(V.wrap_rads(F.radians(k))).alias("rads"),
                    V.wrap_degs(k).alias("degs"), V.wrap_degs(-k).alias("neg_degs"))


_uxv = _cross(_U, _VV)
_proj = [f"({_dot(_U, _VV)}/{_dot(_VV, _VV)}*{x})" for x in _VV]
_rej = [f"({a}-{b})" for a, b in zip(_U, _proj)]


@query(f"""{_PAIR_SQL} SELECT id, {_vsel(_uxv, ('cx', 'cy', 'cz'))}, {_vsel(_proj, ('px', 'py', 'pz'))}, {_vsel(_rej, ('jx', 'jy', 'jz'))},
 round(acos(least(greatest({_dot(_U, _VV)}/({_norm(_U)}*{_norm(_VV)}),-1),1)),6)+0.0 AS angle,
 round(CASE WHEN {_uxv[2]} > 0 THEN 1 WHEN {_uxv[2]} < 0 THEN -1 ELSE 0 END * acos(least(greatest({_dot(_U, _VV)}/({_norm(_U)}*{_norm(_VV)}),-1),1)),5)+0.0 AS signed,
 round({_norm(_rej)},6)+0.0 AS across, round({_dot(_U, _VV)}/{_norm(_VV)},6)+0.0 AS along,
 round(asin(0.5/{_norm(_U)}),6)+0.0 AS ang_radius FROM p WHERE {_uxv[2]} <> 0""")
def vector_algebra(t):
    u, v = F.col("u"), F.col("v")
    d = pairs(t).withColumn("c", V.cross(u, v)).where("c.z <> 0")
    d = d.select("id", "c", V.projection(u, v).alias("p"), V.rejection(u, v).alias("j"), V.angle_between(u, v).alias("angle"),
                 V.signed_angle(u, v, V.vec(0.0, 0.0, 1.0)).alias("signed"), V.dist_across(u, v).alias("across"),
                 V.dist_along(u, v).alias("along"), V.angular_radius(u, 0.5).alias("ang_radius"))
    return d.select("id", *_cols(d.c, "c", "xyz"), *_cols(d.p, "p", "xyz"), *_cols(d.j, "j", "xyz"), rnd(d.angle).alias("angle"),
                    rnd(d.signed, 5).alias("signed"), *[rnd(d[n]).alias(n) for n in ("across", "along", "ang_radius")])


@query(f"""{_PAIR_SQL} SELECT id, round(asin(uz/{_norm(_U)}),6)+0.0 AS lat, round(atan2(uy,ux),6)+0.0 AS lon, round({_norm(_U)},6)+0.0 AS r,
 {_vsel(_U, ('x', 'y', 'z'))} FROM p""")
def spherical_coordinates(t):
    d = pairs(t).select("id", V.to_spherical(F.col("u")).alias("s"))
    d = d.select("id", "s", V.from_spherical(d.s.lat, d.s.lon, d.s.r).alias("b"))
    return d.select("id", *_cols(d.s, "", ("lat", "lon", "r")), *_cols(d.b, "", "xyz"))


# pose algebra: a = (u, qa), delta = (v, qb)
_sum_loc = [f"({r}+{v})" for r, v in zip(q_rot("g", _U), _VV)]
_ba = q_mul("g", "a")
_neg_loc = q_rot("a", ["-ux", "-uy", "-uz"], True)
_loc_local = q_rot("g", ["ux-vx", "uy-vy", "uz-vz"], True)


@query(f"""{_PAIR_SQL} SELECT id, {_vsel(_sum_loc, ('sx', 'sy', 'sz'))}, {_vsel(_ba, ('sw', 'qx', 'qy', 'qz'))},
 {_vsel(_neg_loc, ('nx', 'ny', 'nz'))}, {_vsel(_VV, ('dx', 'dy', 'dz'))}, {_vsel(_sum_loc, ('gx', 'gy', 'gz'))},
 {_vsel(_loc_local, ('lx', 'ly', 'lz'))} FROM p""")
def pose_algebra(t):
    d = pairs(t).select("id", P.pose(F.col("u"), F.col("a")).alias("p"), P.pose(F.col("v"), F.col("b")).alias("f"))
    d = d.withColumn("s", P.add(d.p, d.f))
    d = d.select("id", "s", P.neg(d.p).loc.alias("n"), P.sub(d.s, d.p).loc.alias("d"), P.to_global(d.p, d.f).loc.alias("g"),
                 P.to_local(d.p, d.f).loc.alias("l"))
    return d.select("id", *_cols(d.s.loc, "s", "xyz"), rnd(d.s.quat.w).alias("sw"), *_cols(d.s.quat, "q", "xyz"),
                    *_cols(d.n, "n", "xyz"), *_cols(d.d, "d", "xyz"), *_cols(d.g, "g", "xyz"), *_cols(d.l, "l", "xyz"))


@query(f"{_PAIR_SQL} SELECT id, " + ", ".join(
    f"round({e},6)+0.0 AS m{i}{j}" for j, col in enumerate([q_rot("a", v) for v in (["1", "0", "0"], ["0", "1", "0"], ["0", "0", "1"])] + [_U])
    for i, e in enumerate(col)) + ", round(abs(aw),6)+0.0 AS w FROM p")
def pose_matrix(t):
    d = pairs(t).select("id", P.to_matrix(P.pose(F.col("u"), F.col("a"))).alias("m"))
    d = d.withColumn("back", P.from_matrix(d.m))
    return d.select("id", *[rnd(d.m[4 * i + j]).alias(f"m{i}{j}") for i in range(3) for j in range(4)], rnd(d.back.quat.w).alias("w"))


@query(f"{_PAIR_SQL} SELECT id, {_vsel(_rot_u, ('x', 'y', 'z'))}, " + ", ".join(
    f"round({e},5)+0.0 AS {n}" for e, n in zip(q_mul("g", "a"), ("cw", "cx", "cy", "cz"))) +
    f", {_vsel(['0.0', '-2*acos(aw)*az/sqrt(ax*ax+ay*ay+az*az)'], ('w00', 'w01'))} FROM p")
def rotation_vectors(t):
    d = pairs(t).select("id", "u", R.to_rotvec(F.col("a")).alias("ra"), R.to_rotvec(F.col("b")).alias("rb"), F.col("a"), F.col("b"))
    d = d.select("id", R.rotate_point(d.ra, d.u).alias("p"), R.compose_rotvecs(d.rb, d.ra).alias("c"), R.wedge(d.ra).alias("w"), "a", "b")
    q = R.from_rotvec(d.c)
    d = d.select("id", "p", q.alias("q"), "w")
    return d.select("id", *_cols(d.p, "", "xyz"), *[rnd(getattr(d.q, k), 5).alias(f"c{k}") for k in "wxyz"],
                    rnd(d.w[0]).alias("w00"), rnd(d.w[1]).alias("w01"))


@query(f"{_PAIR_SQL}, r AS (SELECT id, CASE WHEN aw < 0 THEN -1 ELSE 1 END AS s, * EXCLUDE (id) FROM p) "
       f"SELECT id, " + ", ".join(f"round(2*acos(least(abs(aw),1))*s*a{k}/sqrt(ax*ax+ay*ay+az*az),4)+0.0 AS l{k}" for k in "xyz") +
       " FROM r WHERE abs(aw) > 0.02")
def rotation_log(t):
    d = pairs(t).where("abs(a.w) > 0.02").select("id", R.log_matrix(R.matrix(F.col("a"))).alias("l"))
    return d.select("id", *[rnd(getattr(d.l, k), 4).alias(f"l{k}") for k in "xyz"])


# telemetry: coordinates near the equator, from events
_A, _F = G.WGS84_A, G.WGS84_F
_OR = (60.08879, 24.35987, 0.629)


def _ecef(lat, lon, alt):
    n = f"({_A}/sqrt(1-{G.WGS84_E2}*sin(radians({lat}))*sin(radians({lat}))))"
    return [f"(({n}+{alt})*cos(radians({lat}))*cos(radians({lon})))", f"(({n}+{alt})*cos(radians({lat}))*sin(radians({lon})))",
            f"(({n}*(1-{G.WGS84_E2})+{alt})*sin(radians({lat})))"]


_d = [f"({a}-{b})" for a, b in zip(_ecef("lat", "lon", "alt"), _ecef(*map(str, _OR)))]
_sl, _cl, _so, _co = (f"{f}(radians({a}))" for a in _OR[:2] for f in ("sin", "cos"))
_E = f"(-{_so}*{_d[0]}+{_co}*{_d[1]})"
_N = f"(-{_sl}*{_co}*{_d[0]}-{_sl}*{_so}*{_d[1]}+{_cl}*{_d[2]})"
_UP = f"({_cl}*{_co}*{_d[0]}+{_cl}*{_so}*{_d[1]}+{_sl}*{_d[2]})"
GEO_SQL = f"""geo AS (SELECT event_id, user_id, ts, 60.08 + (event_id % 211) * 0.0001::DOUBLE AS lat, 24.35 + (user_id % 97) * 0.0002::DOUBLE AS lon,
 20.0 + value * 0.1 AS alt, radians(event_id % 359 - 179) AS yaw, radians(user_id % 41 - 20) AS pitch, radians(event_id % 31 - 15) AS roll FROM events)"""


def geo(t: Tables):
    e, u = F.col("event_id"), F.col("user_id")
    deg = lambda x: F.radians(x.cast("double"))
    return t.events.select(
        "event_id", "user_id", "ts", (60.08 + (e % 211) * 0.0001).alias("lat"), (24.35 + (u % 97) * 0.0002).alias("lon"),
        (20.0 + F.col("value") * 0.1).alias("alt"), deg(e % 359 - 179).alias("yaw"), deg(u % 41 - 20).alias("pitch"), deg(e % 31 - 15).alias("roll"))


@query(f"WITH {GEO_SQL} SELECT event_id, round({_E},4)+0.0 AS east, round({_N},4)+0.0 AS north, round({_UP},4)+0.0 AS up FROM geo")
def geodetic_enu(t):
    d = geo(t).select("event_id", G.to_enu("lat", "lon", "alt", _OR).alias("e"))
    return d.select("event_id", rnd(d.e.x, 4).alias("east"), rnd(d.e.y, 4).alias("north"), rnd(d.e.z, 4).alias("up"))


# fixed camera mount: 90 degrees about y
@query(f"""WITH {GEO_SQL}, m AS (SELECT event_id, {_N} AS nx, {_E} AS ny, -{_UP} AS nz, cos(yaw/2)*cos(pitch/2)*cos(roll/2)+sin(yaw/2)*sin(pitch/2)*sin(roll/2) AS nw FROM geo)
SELECT event_id, round(nx,4)+0.0 AS bx, round(ny,4)+0.0 AS "by", round(nz,4)+0.0 AS bz, round(nw,6)+0.0 AS bw,
 round(-nz,4)+0.0 AS cx, round(ny,4)+0.0 AS cy, round(nx,4)+0.0 AS cz FROM m""")
def telemetry_poses(t):
    d = geo(t)
    body = G.telemetry_pose("lat", "lon", "alt", "yaw", "pitch", "roll", _OR)
    d = d.select("event_id", body.alias("b"), P.pose(V.vec(0.0, 0.0, 0.0), R.axis_quat("y", math.pi / 2)).alias("mount"))
    d = d.withColumn("c", P.to_local(d.b, d.mount))
    return d.select("event_id", *[rnd(getattr(d.b.loc, k), 4).alias(f"b{k}") for k in "xyz"], rnd(d.b.quat.w).alias("bw"),
                    *[rnd(getattr(d.c.loc, k), 4).alias(f"c{k}") for k in "xyz"])


# ---- camera -----------------------------------------------------------------------------------
_k1, _k2, _p1, _p2 = CAM.dist
_xn, _yn = "(cx/cz)", "(cy/cz)"
_r2 = f"({_xn}*{_xn}+{_yn}*{_yn})"
_rad = f"(1+({_k1})*{_r2}+({_k2})*{_r2}*{_r2})"
_xd = f"({_xn}*{_rad}+2*({_p1})*{_xn}*{_yn}+({_p2})*({_r2}+2*{_xn}*{_xn}))"
_yd = f"({_yn}*{_rad}+({_p1})*({_r2}+2*{_yn}*{_yn})+2*({_p2})*{_xn}*{_yn})"


@query(f"{PROJ_SQL} SELECT frame_id, kp_id, round(cx,5)+0.0 AS x, round(cy,5)+0.0 AS y, round(cz,5)+0.0 AS z FROM proj")
def to_camera_frame(t):
    d = projected(t)
    return d.select("frame_id", "kp_id", *[rnd(getattr(d.cam, k), 5).alias(k) for k in "xyz"])


@query(f"{PROJ_SQL} SELECT frame_id, kp_id, round({_xd}*500+320,5)+0.0 AS u, round({_yd}*510+240,5)+0.0 AS v, "
       f"round({_xn}*500+320,5)+0.0 AS pu, round({_yn}*510+240,5)+0.0 AS pv FROM proj")
def camera_projection(t):
    d = projected(t)
    d = d.select("frame_id", "kp_id", CAM.project(d.cam).alias("a"), CAM.project(d.cam, False).alias("b"))
    return d.select("frame_id", "kp_id", rnd(d.a.x, 5).alias("u"), rnd(d.a.y, 5).alias("v"), rnd(d.b.x, 5).alias("pu"), rnd(d.b.y, 5).alias("pv"))


@query(f"{PROJ_SQL} SELECT frame_id, kp_id, round({_xn}*500+320,2)+0.0 AS u, round({_yn}*510+240,2)+0.0 AS v FROM proj")
def undistort_roundtrip(t):
    """distort then undistort returns the ideal pixel."""
    d = projected(t)
    d = d.select("frame_id", "kp_id", CAM.project(d.cam).alias("p"))
    d = CAM.undistorted(d, F.col("p.x"), F.col("p.y"), "q", 12)
    return d.select("frame_id", "kp_id", rnd(d.q.x, 2).alias("u"), rnd(d.q.y, 2).alias("v"))


_u, _v = "(l_partkey % 640)", "(l_suppkey % 480)"
_rx, _ry = f"(({_u}+0.5-320)/500.0)", f"(({_v}+0.5-240)/510.0)"
_rn = f"sqrt({_rx}*{_rx}+{_ry}*{_ry}+1)"
_YQ = (math.cos(math.radians(2.5)), math.sin(math.radians(2.5)))
_yc, _ys = math.cos(math.radians(5)), math.sin(math.radians(5))


@query(f"""SELECT l_partkey, l_suppkey, round(max({_rx}/{_rn}),6)+0.0 AS rx, round(max({_ry}/{_rn}),6)+0.0 AS ry, round(max(1/{_rn}),6)+0.0 AS rz,
 round(max(-{_rx}*-50.0),6)+0.0 AS ox, round(max({_ry}*-50.0),6)+0.0 AS oy,
 round(max(({_yc}*{_rx}+{_ys})/({_yc}-{_ys}*{_rx})*500+320-0.5),4)+0.0 AS tu, round(max({_ry}/({_yc}-{_ys}*{_rx})*510+240-0.5),4)+0.0 AS tv
 FROM lineitem GROUP BY l_partkey, l_suppkey""")
def pixel_rays(t):
    d = t.lineitem.select("l_partkey", "l_suppkey").distinct()
    u, v = (F.col("l_partkey") % 640).cast("double"), (F.col("l_suppkey") % 480).cast("double")
    q = R.quat(_YQ[0], 0.0, _YQ[1], 0.0)
    d = d.select("l_partkey", "l_suppkey", CAM.unit_ray(u, v).alias("r"), CAM.pixel_to_xy(u, v, -50.0).alias("o"), CAM.rotate_pixel(q, u, v).alias("t"))
    return d.select("l_partkey", "l_suppkey", *_cols(d.r, "r", "xyz"), *_cols(d.o, "o", "xy"), rnd(d.t.x, 4).alias("tu"), rnd(d.t.y, 4).alias("tv"))


@query(f"""SELECT vec_id, i - 1 AS px, round((((i-1)%8)*80+0.5-320)/500.0*abs(e),6)+0.0 AS x, round(((((i-1)//8)*60)+0.5-240)/510.0*abs(e),6)+0.0 AS y,
 round(abs(e),6)+0.0 AS z FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings)""")
def depth_to_points(t):
    d = t.embeddings.select("vec_id", F.posexplode("embedding").alias("px", "e")).withColumn("depth", F.abs(F.col("e").cast("double")))
    d = d.select("vec_id", F.col("px").cast("bigint").alias("px"), C.depth_to_point(CAM, (F.col("px") % 8 * 80).cast("double"),
                 (F.floor(F.col("px") / 8) * 60).cast("double"), F.col("depth")).alias("p"))
    return d.select("vec_id", "px", *_cols(d.p, "", "xyz"))


@query(f"""SELECT event_id, round(4*(sqrt(1+value*value/(4+1e-15))-1+1e-15),6)+0.0 AS loss,
 round(CASE WHEN value > 10 THEN sqrt(10/value) ELSE 1 END,6)+0.0 AS weight,
 round(2*0.5*100/(100+0.5-(2*(event_id%1000)/1000.0-1)*(100-0.5)),6)+0.0 AS depth FROM events""")
def robust_loss(t):
    return t.events.select("event_id", rnd(C.pseudo_huber("value", 2.0)).alias("loss"), rnd(C.huber_weight("value", 10.0)).alias("weight"),
                           rnd(C.linear_depth(F.col("event_id") % 1000 / 1000.0, 0.5, 100.0)).alias("depth"))


# ---- physics ----------------------------------------------------------------------------------
@query(f"""SELECT o_orderkey AS id, round(1/pow(1+(pow(o_orderkey%640-320.0,2)+pow(o_custkey%480-240.0,2))/(500.0*500.0),2),6)+0.0 AS cos4,
 round({PI}*pow((1+o_orderkey%9)*1e-3/2,2)*1e6,6)+0.0 AS area,
 floor(least(greatest(o_totalprice/1e5,0.01),3.0)*1000)*0.001 AS exposure,
 round(least(2e5/o_totalprice,5.0),6)+0.0 AS def_exposure, round(radians(30.0)/640*radians(24.0)/480*1e6,6)+0.0 AS px_sr FROM orders""")
def radiometry(t):
    d = t.orders.select(
        F.col("o_orderkey").alias("id"),
        rnd(Y.cos4((F.col("o_orderkey") % 640).cast("double"), (F.col("o_custkey") % 480).cast("double"), 320.0, 240.0, 500.0)).alias("cos4"),
        rnd(Y.aperture_area((1 + F.col("o_orderkey") % 9).cast("double")) * 1e6).alias("area"),
        Y.exposure_gain(F.col("o_totalprice") / 1e5, 0.01, 3.0).exposure.alias("exposure"),
        rnd(Y.default_exposure("o_totalprice")).alias("def_exposure"), rnd(Y.mean_pixel_sr(30.0, 24.0, 640, 480) * 1e6).alias("px_sr"))
    return d


_QE = [0.1, 0.4, 0.55, 0.3, 0.05]
_LO, _HI = 400.0, 900.0
_lam = "(400.0 + (o_orderkey % 4999) * 0.1)"
_qe = "+".join(f"(CASE WHEN {_lam}={x} THEN 1 ELSE sin(({_lam}-{x})/125.0*{PI})/(({_lam}-{x})/125.0*{PI}) END)*{y}" for x, y in zip((400.0, 525.0, 650.0, 775.0, 900.0), _QE))


@query(f"SELECT o_orderkey AS id, round(greatest({_qe},0),6)+0.0 AS qe FROM orders")
def quantum_efficiency(t):
    lam = 400.0 + F.col("o_orderkey") % 4999 * 0.1
    return t.orders.select(F.col("o_orderkey").alias("id"), rnd(Y.quantum_efficiency(lam, _QE, _LO, _HI)).alias("qe"))


@query("""SELECT p_partkey AS id, 0.0 AS residual, round((p_partkey * 977 % 4711) / 4711.0 * 2 * pi(), 4) + 0.0 AS phase FROM part""")
def kepler_equation(t):
    """The solved anomaly satisfies the equation: residual rounds to zero for every row."""
    k = F.col("p_partkey")
    d = t.part.select(k.alias("id"), (k % 90 / 100.0).alias("e"), F.radians(F.col("p_size") * 7.0).alias("m"))
    d = d.withColumn("ea", Y.eccentric_anomaly(d.e, d.m, 1e-9))
    return d.select("id", rnd(d.ea - d.e * F.sin(d.ea) - d.m, 4).alias("residual"),
                    rnd(Y.spin_phase((d.id * 977 % 4711).cast("double"), 4711.0), 4).alias("phase"))


@query(f"""WITH k AS (SELECT p_partkey AS id, radians((p_partkey*17)%360) AS ra, radians(p_size*3.0-75) AS de FROM part)
SELECT id, round(degrees(asin(-sin({Y.OBLIQUITY_J2000})*cos(de)*sin(ra)+cos({Y.OBLIQUITY_J2000})*sin(de))),5)+0.0 AS lat,
 round(degrees(atan2(cos({Y.OBLIQUITY_J2000})*cos(de)*sin(ra)+sin({Y.OBLIQUITY_J2000})*sin(de), cos(de)*cos(ra))),5)+0.0 AS lon FROM k""")
def ecliptic_coordinates(t):
    d = t.part.select(F.col("p_partkey").alias("id"), Y.equatorial_to_ecliptic((F.col("p_partkey") * 17 % 360).cast("double"), F.col("p_size") * 3.0 - 75).alias("e"))
    return d.select("id", rnd(d.e.lat, 5).alias("lat"), rnd(d.e.lon, 5).alias("lon"))


_ax, _ay, _az = (q_rot("a", v) for v in (["1", "0", "0"], ["0", "1", "0"], ["0", "0", "1"]))


@query(f"""{_PAIR_SQL}, b AS (SELECT id, vx, vy, vz, {", ".join(f"{e} AS x{i}" for i, e in enumerate(_ax))}, {", ".join(f"{e} AS z{i}" for i, e in enumerate(_az))} FROM p),
n AS (SELECT *, x1*vz-x2*vy AS n0, x2*vx-x0*vz AS n1, x0*vy-x1*vx AS n2 FROM b)
SELECT id, round(acos(least(greatest(-(vx*x0+vy*x1+vz*x2)/sqrt(vx*vx+vy*vy+vz*vz),-1),1)),5)+0.0 AS elong,
 round(abs(acos(least(greatest((n0*z0+n1*z1+n2*z2)/sqrt(n0*n0+n1*n1+n2*n2),-1),1))),4)+0.0 AS direc FROM n""")
def sun_elongation(t):
    d = pairs(t).select("id", Y.solar_elongation(F.col("v"), F.col("a")).alias("s"))
    return d.select("id", rnd(d.s.elong, 5).alias("elong"), rnd(F.abs(d.s.direc), 4).alias("direc"))


_g = "radians(1.0+p_partkey%90)"
_ci, _ce = "(0.1+(p_partkey%9)*0.1)", "(0.15+(p_size%8)*0.1)"
_H = "(1+2*{m})/(1+2*{m}*sqrt(1-0.034))"


@query(f"""SELECT p_partkey AS id, round(1e3*0.034/4/{PI}*{_ci}/({_ci}+{_ce})*((1+2.25/(1+tan({_g}/2)/0.061))*((1-0.0064)/pow(1+2*-0.08*cos({_g})+0.0064,1.5))
 +{_H.format(m=_ci)}*{_H.format(m=_ce)}-1),5)+0.0 AS radiance,
 round(100*least(greatest((least(3.0,p_size/10.0-2.5+1)-greatest(-3.0,p_size/10.0-2.5-1))/2.0,0),1),4)+0.0 AS visible FROM part""")
def reflectance(t):
    k = F.col("p_partkey")
    rad = Y.hapke_radiance(0.1 + k % 9 * 0.1, 0.15 + F.col("p_size") % 8 * 0.1, F.radians(1.0 + k % 90), w=0.034, b=-0.08, b_sh0=2.25, hs=0.061)
    return t.part.select(k.alias("id"), rnd(rad * 1e3, 5).alias("radiance"),
                         rnd(Y.visibility_percent(F.col("p_size") / 10.0 - 2.5, F.lit(0.0), 3.0, 3.0, 1.0), 4).alias("visible"))


@query(f"""{PROJ_SQL}, lag AS (SELECT frame_id, kp_id, {q_rot("q", ["-lx", "-ly", "-lz"], True)[0]} AS ax, {q_rot("q", ["-lx", "-ly", "-lz"], True)[1]} AS ay,
 {q_rot("q", ["-lx", "-ly", "-lz"], True)[2]} AS az, px, py, pz FROM proj)
SELECT kp_id, frame_id, round(acos(least(greatest(((ax-px)*(0-px)+(ay-py)*(0-py)+(az-pz)*(0-pz))/(sqrt((ax-px)*(ax-px)+(ay-py)*(ay-py)+(az-pz)*(az-pz))*sqrt(px*px+py*py+pz*pz)),-1),1)),5)+0.0 AS parallax FROM lag""")
def landmark_parallax(t):
    """Parallax of each observation against the map origin."""
    d = projected(t)
    d = d.select("kp_id", "frame_id", "pt", P.centre(P.pose(d.loc, d.quat)).alias("centre"))
    return d.select("kp_id", "frame_id", rnd(V.parallax(d.centre, V.vec(0.0, 0.0, 0.0), d.pt), 5).alias("parallax"))


_wb = "(n2/(n2+1.25*n3))"


@query(f"""{_PAIR_SQL}, s AS (SELECT p.*, 10.0 + id % 30 AS n2, 5.0 + id % 50 AS n3 FROM p), g AS (SELECT *, CASE WHEN {_ang} >= {PI} THEN 2*{PI}-{_ang} ELSE {_ang} END AS ab FROM s)
SELECT id, round(ux + (vx-ux)*n2/(n2+12.5*n3), 6)+0.0 AS x, round(ab*{_wb}, 5)+0.0 AS turned FROM g WHERE ab < 3.14""")
def mixed_pose_blend(t):
    """Blend of a 3-D and a 2-D pose solution, weighted by their point counts."""
    d = pairs(t).withColumns({"n2": 10.0 + F.col("id") % 30, "n3": 5.0 + F.col("id") % 50})
    a, b, n2, n3 = (F.col(c) for c in ("a", "b", "n2", "n3"))
    d = d.withColumn("ab", R.angle_between(a, b)).where("ab < 3.14")
    d = d.select("id", "a", R.weighted_pair_mean(a, 1.25 * n3, b, n2).alias("q"), (F.col("u.x") + (F.col("v.x") - F.col("u.x")) * n2 / (n2 + 12.5 * n3)).alias("x"))
    return d.select("id", rnd(F.col("x")).alias("x"), rnd(R.angle_between(F.col("a"), F.col("q")), 5).alias("turned"))


_lu = q_rot("a", [f"{x}/{_norm(_VV)}" for x in _VV], True)


@query(f"""{_PAIR_SQL} SELECT id, {_vsel(_lu, ('x', 'y', 'z'))}, round(sqrt(pow(ux-vx,2)+pow(uy-vy,2))/abs(vz),6)+0.0 AS lateral, round(abs(uz-vz)/abs(vz),6)+0.0 AS distance FROM p""")
def system_state_errors(t):
    """Light direction in the spacecraft frame and relative position errors."""
    d = pairs(t).select("id", Y.light_direction(F.col("v"), F.col("a")).alias("l"), Y.position_errors(F.col("u"), F.col("v")).alias("e"))
    return d.select("id", *_cols(d.l, "", "xyz"), rnd(d.e.lateral).alias("lateral"), rnd(d.e.distance).alias("distance"))
