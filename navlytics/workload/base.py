"""Query registry, table access and the role mapping of the given tables.

frames = orders, landmarks = part, observations = lineitem, telemetry = events (session = user),
descriptors and 8x8 image tiles = embeddings (batch = label).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from navlytics.functions import camera as C, computed
from navlytics.functions import rotations as R
from navlytics.functions import vectors as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CAM = C.Camera(640, 480, 500.0, 510.0, 320.0, 240.0, (-0.12, 0.03, 0.001, -0.0015))


class Tables:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of Tables under its own name."""

    def wrap(fn):
        QUERIES[fn.__name__] = lambda spark, path: fn(Tables(spark, path))
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return wrap


def rnd(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def frames(t: Tables) -> DataFrame:
    """(frame_id, session, loc, quat): small view rotations, cameras spread over the ground."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(k.alias("frame_id"), c.alias("session"), *[v.alias(n) for n, v in frame_pose(k, c).items()])


def frame_pose(k: Column, c: Column) -> dict[str, Column]:
    """Pose of the frame of order k and customer c."""
    deg = lambda e: F.radians(e.cast("double"))
    return {"loc": V.vec((k % 41 - 20).cast("double"), (c % 37 - 18).cast("double"), (k % 7).cast("double")),
            "quat": R.from_ypr(deg(k % 21 - 10), deg(c % 15 - 7), deg(k % 13 - 6))}


def landmarks(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.select(
        k.alias("kp_id"),
        V.vec(F.col("p_size") - 25.0, F.pmod(F.col("p_retailprice"), F.lit(50.0)) - 25.0, 80.0 + (k % 40)).alias("pt"),
    )


def observations(t: Tables) -> DataFrame:
    """One row per (frame, landmark) with the pixel noise of that observation."""
    return t.lineitem.groupBy(F.col("l_orderkey").alias("frame_id"), F.col("l_partkey").alias("kp_id")).agg(
        ((F.max("l_discount") - 0.05) * 20.0).alias("du"), ((F.max("l_tax") - 0.04) * 20.0).alias("dv"))


def projected(t: Tables) -> DataFrame:
    """Observations joined with their frame and landmark, and the camera-frame point."""
    j = observations(t).join(frames(t), "frame_id").join(landmarks(t), "kp_id")
    return j.withColumn("cam", V.add(R.rotate(F.col("quat"), F.col("pt")), F.col("loc")))


def placed(t: Tables, seen: DataFrame) -> DataFrame:
    """``projected`` of some (frame_id, kp_id, ...) for large tables: rows meet their landmark first and carry their order's keys instead of its pose."""
    j = seen.join(landmarks(t), "kp_id").join(t.orders.select(F.col("o_orderkey").alias("frame_id"), F.col("o_custkey").alias("session")), "frame_id")
    j = computed(j, **frame_pose(F.col("frame_id"), F.col("session")))
    return computed(j, cam=V.add(R.rotate(F.col("quat"), F.col("pt")), F.col("loc")))


# ---- the same views as SQL text -------------------------------------------------------------

def q_mul(a: str, b: str) -> list[str]:
    """Quaternion product of columns named {a}w.. and {b}w.. as four SQL expressions."""
    p = {"aw": f"{a}w", "ax": f"{a}x", "ay": f"{a}y", "az": f"{a}z", "bw": f"{b}w", "bx": f"{b}x", "by": f"{b}y", "bz": f"{b}z"}
    return [s.format(**p) for s in (
        "({aw}*{bw}-{ax}*{bx}-{ay}*{by}-{az}*{bz})", "({aw}*{bx}+{ax}*{bw}+{ay}*{bz}-{az}*{by})",
        "({aw}*{by}-{ax}*{bz}+{ay}*{bw}+{az}*{bx})", "({aw}*{bz}+{ax}*{by}-{ay}*{bx}+{az}*{bw})")]


def q_rot(q: str, v: list[str], inverse: bool = False) -> list[str]:
    """Rotation-matrix form of q v q*, independent of the Spark formula."""
    s = "-" if inverse else ""
    w, x, y, z = f"({s}{q}w)", f"{q}x", f"{q}y", f"{q}z"
    a, b, c = (f"({e})" for e in v)
    return [
        f"((1-2*({y}*{y}+{z}*{z}))*{a}+2*({x}*{y}-{w}*{z})*{b}+2*({x}*{z}+{w}*{y})*{c})",
        f"(2*({x}*{y}+{w}*{z})*{a}+(1-2*({x}*{x}+{z}*{z}))*{b}+2*({y}*{z}-{w}*{x})*{c})",
        f"(2*({x}*{z}-{w}*{y})*{a}+2*({y}*{z}+{w}*{x})*{b}+(1-2*({x}*{x}+{y}*{y}))*{c})",
    ]


def q_ypr(yaw: str, pitch: str, roll: str, name: str) -> str:
    """Select list of the quaternion of z-y'-x'' angles, from the half-angle formulas."""
    cy, sy, cp, sp, cr, sr = (f"{f}(({a})/2.0)" for a in (yaw, pitch, roll) for f in ("cos", "sin"))
    return (
        f"{cr}*{cp}*{cy}+{sr}*{sp}*{sy} AS {name}w, {sr}*{cp}*{cy}-{cr}*{sp}*{sy} AS {name}x, "
        f"{cr}*{sp}*{cy}+{sr}*{cp}*{sy} AS {name}y, {cr}*{cp}*{sy}-{sr}*{sp}*{cy} AS {name}z"
    )


FRAMES_SQL = f"""frames AS (SELECT o_orderkey AS frame_id, o_custkey AS session,
  CAST(o_orderkey % 41 - 20 AS DOUBLE) AS lx, CAST(o_custkey % 37 - 18 AS DOUBLE) AS ly, CAST(o_orderkey % 7 AS DOUBLE) AS lz,
  {q_ypr("radians(o_orderkey % 21 - 10)", "radians(o_custkey % 15 - 7)", "radians(o_orderkey % 13 - 6)", "q")} FROM orders)"""
LANDMARKS_SQL = """landmarks AS (SELECT p_partkey AS kp_id, p_size - 25.0::DOUBLE AS px,
  (p_retailprice % 50.0::DOUBLE) - 25.0 AS py, 80.0::DOUBLE + (p_partkey % 40) AS pz FROM part)"""
OBS_SQL = """obs AS (SELECT l_orderkey AS frame_id, l_partkey AS kp_id, (max(l_discount) - 0.05) * 20.0 AS du,
  (max(l_tax) - 0.04) * 20.0 AS dv FROM lineitem GROUP BY 1, 2)"""
_cam = q_rot("q", ["px", "py", "pz"])
PROJ_SQL = f"""WITH {FRAMES_SQL}, {LANDMARKS_SQL}, {OBS_SQL},
proj AS (SELECT *, {_cam[0]}+lx AS cx, {_cam[1]}+ly AS cy, {_cam[2]}+lz AS cz
  FROM obs JOIN frames USING (frame_id) JOIN landmarks USING (kp_id))"""
PI = repr(math.pi)
