"""Grids, keypoint rotation, formatting and match masks over whole tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from navlytics.functions import grids as D
from navlytics.functions import noise as Z
from navlytics.functions import rotations as R
from navlytics.functions import vectors as V
from navlytics.plans import mapping as M
from navlytics.workload.base import query, rnd
from navlytics.workload.mapping import KP_SQL, keypoints

_TOL = math.radians(20)
_GRID = ", ".join(f"({i},{a!r}::DOUBLE,{b!r}::DOUBLE)" for i, (a, b) in enumerate(D.direction_grid(_TOL)))
_W = lambda e: f"((({e}) + pi()) - floor((({e}) + pi()) / (2*pi())) * 2*pi() - pi())"


@query(f"""WITH g(i, la, lo) AS (VALUES {_GRID}), p AS (SELECT p_partkey AS id, radians(p_size*3.1-78) AS lat, radians((p_partkey*17.3) % 360 - 180) AS lon FROM part),
d AS (SELECT id, i, la, lo, sqrt(pow({_W('la-lat')},2)+pow({_W('lo-lon')},2)) AS d FROM p, g) SELECT id, i AS idx, round(la,5)+0.0 AS lat, round(lo,5)+0.0 AS lon FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d,9), i) AS r FROM d) WHERE r = 1""")
def direction_grid_snap(t):
    k = F.col("p_partkey")
    d = t.part.select(k.alias("id"), D.nearest_grid_point(F.radians(F.col("p_size") * 3.1 - 78), F.radians(k * 17.3 % 360 - 180), _TOL).alias("g"))
    return d.select("id", "g.idx", rnd(F.col("g.lat"), 5).alias("lat"), rnd(F.col("g.lon"), 5).alias("lon"))


@query(f"""WITH {KP_SQL}, r AS (SELECT img, id, cos(radians(img % 90))*(u-320)+sin(radians(img % 90))*(v-240)+320 AS x, cos(radians(img % 90))*(v-240)-sin(radians(img % 90))*(u-320)+240 AS y FROM kp)
SELECT img, id, round(x,5)+0.0 AS x, round(y,5)+0.0 AS y FROM r WHERE x BETWEEN 16 AND 624 AND y BETWEEN 16 AND 464""")
def rotate_keypoints(t):
    d = keypoints(t).withColumn("p", D.rotate_keypoint("u", "v", 640.0, 480.0, F.radians((F.col("img") % 90).cast("double")))).select("img", "id", "p.x", "p.y")
    return d.where(M.inside_border("x", "y", 640, 480, 16)).select("img", "id", rnd(F.col("x"), 5).alias("x"), rnd(F.col("y"), 5).alias("y"))


@query("""SELECT event_id, CASE WHEN value = 0 THEN 0.0 ELSE round(round(value*pow(10, 1-floor(log10(value))))/pow(10, 1-floor(log10(value))), 6) END AS v2,
 round(value*value*0.01 + event_id % 7, 6) AS z, round((event_id % 7) - 0.02*(pow(value,2)+pow(value/2,2)), 5)+0.0 AS resid FROM events""")
def number_formats(t):
    v = F.col("value")
    e = F.col("event_id") % 7
    p = D.paraboloid_residual(V.vec(v, v / 2, e.cast("double")), V.vec(0.0, 0.0, 0.0), R.one(), 0.02)
    return t.events.select("event_id", F.round(D.significant(v, 2), 6).alias("v2"), F.round(v * v * 0.01 + e, 6).alias("z"), rnd(p, 5).alias("resid"))


@query("""SELECT l_suppkey, l_linenumber * 2 + i AS i, l_suppkey % 5 * 3 + j AS j, round(sum(l_discount * (i + 1) * (j + 2)), 4) AS v FROM lineitem, range(2) a(i), range(3) b(j) GROUP BY 1, 2, 3""")
def sparse_block_sum(t):
    """Scatter-add of dense blocks into a coordinate matrix."""
    d = t.lineitem.select("l_suppkey", "l_discount", F.explode(D.block_indices(F.col("l_linenumber").cast("bigint"), F.col("l_suppkey") % 5, 2, 3)).alias("e"))
    v = F.col("l_discount") * (F.pmod("e.i", F.lit(2)) + 1) * (F.pmod("e.j", F.lit(3)) + 2)
    return d.groupBy("l_suppkey", F.col("e.i").alias("i"), F.col("e.j").alias("j")).agg(F.round(F.sum(v), 4).alias("v"))


@query("""SELECT p_partkey AS id, round(p_size/sqrt(p_size*p_size+pow(p_partkey%9,2)),6)+0.0 AS c, round(-(p_partkey%9)/sqrt(p_size*p_size+pow(p_partkey%9,2)),6)+0.0 AS s FROM part WHERE p_size > 0""")
def givens_rotations(t):
    d = t.part.where("p_size > 0").select(F.col("p_partkey").alias("id"), D.givens(F.col("p_size").cast("double"), (F.col("p_partkey") % 9).cast("double")).alias("g"))
    return d.select("id", rnd(F.col("g.c")).alias("c"), rnd(F.col("g.s")).alias("s"))


@query("SELECT count(*) AS n, true AS mean_ok, true AS corr_ok, true AS rot_ok FROM lineitem")
def seeded_noise(t):
    """Moments of the generated noise stay near their targets."""
    a, b = Z.correlated_normals([1.0, -2.0], [[1.0, 0.5], [0.5, 2.0]], 11)
    d = t.lineitem.select(a.alias("a"), b.alias("b"), Z.random_rotation(0.3, 5).alias("q"), Z.random_distance(70.0, 280.0, 3, False).alias("dist"))
    return d.agg(F.count(F.lit(1)).alias("n"), ((F.abs(F.avg("a") - 1.0) < 0.2) & (F.abs(F.avg("b") + 2.0) < 0.2)).alias("mean_ok"),
                 (F.abs(F.covar_pop("a", "b") - 0.5) < 0.2).alias("corr_ok"),
                 (F.max(F.abs(2.0 * F.acos(F.col("q.w")) - 0.3)) < 1e-9).alias("rot_ok"))


@query(f"""WITH {KP_SQL} SELECT a.img, a.id, count(*) AS n FROM kp a JOIN kp b ON b.img = a.img + 1 AND abs(a.u-b.u) < 20 AND abs(a.v-b.v) < 20 AND sqrt(pow(a.u-b.u,2)+pow(a.v-b.v,2)) < 20 GROUP BY 1, 2""")
def match_mask_counts(t):
    """Reference keypoints within reach of each scene keypoint of the next image, by grid cells.

    Scene keypoints go to their tile of 4 x 4 cells, spots of the next image to the up to four tiles that their neighbour cells lie in.
    """
    k = keypoints(t).select("img", "id", "u", "v")
    cell = lambda c: F.floor(F.col(c) / 20.0)
    tile = lambda c: F.shiftright(c, 2)
    a = k.withColumns({"tx": tile(cell("u")), "ty": tile(cell("v"))})
    # copies of a spot count once with their multiplicity
    b = k.groupBy((F.col("img") - 1).alias("img"), F.col("u").alias("bu"), F.col("v").alias("bv")).agg(F.count(F.lit(1)).alias("m"))
    for c, to in (("bu", "tx"), ("bv", "ty")):
        b = b.withColumn(to, F.explode(F.sequence(tile(cell(c) - 1), tile(cell(c) + 1))))
    du, dv = F.col("u") - F.col("bu"), F.col("v") - F.col("bv")
    j = a.join(b, ["img", "tx", "ty"]).where((F.abs(du) < 20) & (F.abs(dv) < 20) & (F.hypot(du, dv) < 20))
    return j.groupBy("img", "id").agg(F.sum("m").alias("n"))
