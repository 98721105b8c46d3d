"""Map maintenance, keyframe logic and id-keyed joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from navlytics.functions import camera as C
from navlytics.functions import vectors as V
from navlytics.operators.ordered import dense_ids
from navlytics.operators.spatial import keep_spaced, suppress_greedy
from navlytics.plans import mapping as M
from navlytics.workload.base import CAM, FRAMES_SQL, LANDMARKS_SQL, OBS_SQL, PROJ_SQL, frames, landmarks, observations, projected, query, rnd

DIAG = 800.0


def keypoints(t):
    """Detections: image = supplier, pixel from part number and price, response = quantity."""
    return t.lineitem.groupBy(F.col("l_suppkey").alias("img"), F.col("l_partkey").alias("id")).agg(
        F.max("l_quantity").alias("response"), F.min("l_orderkey").alias("okey")).select(
        "img", "id", (F.col("id") * 37 % 640).cast("double").alias("u"), (F.col("okey") * 11 % 480).cast("double").alias("v"), "response", "okey")


KP_SQL = """kp AS (SELECT l_suppkey AS img, l_partkey AS id, CAST(l_partkey * 37 % 640 AS DOUBLE) AS u, CAST(min(l_orderkey) * 11 % 480 AS DOUBLE) AS v,
 max(l_quantity) AS response, min(l_orderkey) AS okey FROM lineitem GROUP BY 1, 2)"""


@query(f"WITH {KP_SQL} SELECT img, id FROM kp WHERE u >= 16 AND v >= 16 AND u <= 624 AND v <= 464")
def border_filter(t):
    return keypoints(t).where(M.inside_border("u", "v", 640, 480, 16)).select("img", "id")


@query(f"WITH {KP_SQL} SELECT a.img, a.id FROM kp a WHERE NOT EXISTS (SELECT 1 FROM kp b WHERE a.img = b.img AND b.id < a.id AND sqrt(pow(a.u-b.u,2)+pow(a.v-b.v,2)) <= 30)")
def track_spacing_filter(t):
    return keep_spaced(keypoints(t), ["img"], "u", "v", "id", 30.0).select("img", "id")


@query()
def greedy_suppression(t):
    """Best response first, everything nearer than the limit dropped; tested against the serial form."""
    k = keypoints(t).withColumn("prio", (51 - F.col("response")) * 1_000_000_000_000 + F.col("id"))
    return suppress_greedy(k, ["img"], "u", "v", "prio", 30.0).select("img", "id")


@query(f"""WITH {KP_SQL}, c AS (SELECT img, id, response, cc, rr FROM kp, range(4) a(cc), range(3) b(rr)
 WHERE u + 32 >= cc*160 AND floor((u - 32)/160) <= cc AND floor((v - 32)/160) <= rr AND floor((v+32)/160) >= rr AND floor((u+32)/160) >= cc)
SELECT img, id, CAST(rr AS INTEGER) AS cell_row, CAST(cc AS INTEGER) AS cell_col FROM (SELECT *, row_number() OVER (PARTITION BY img, cc, rr ORDER BY response DESC, id) AS rn FROM c) WHERE rn <= 5""")
def grid_topk(t):
    return M.grid_top_k(keypoints(t), ["img"], "u", "v", "response", "id", 640, 480, 3, 4, 60, 32.0).select("img", "id", "cell_row", "cell_col")


@query(f"""WITH {KP_SQL}, a AS (SELECT img, id, response FROM (SELECT *, row_number() OVER (PARTITION BY img, floor(u/40), floor(v/40) ORDER BY response DESC, id) AS r FROM kp) WHERE r = 1
 UNION SELECT img, id, response FROM (SELECT *, row_number() OVER (PARTITION BY img, floor((u+20)/40), floor((v+20)/40) ORDER BY response DESC, id) AS r FROM kp) WHERE r = 1)
SELECT img, id FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY response DESC, id) AS r FROM a) WHERE r <= 100""")
def two_grid_detections(t):
    return M.two_grid_best(keypoints(t), ["img"], "u", "v", "response", "id", 40.0, 100).select("img", "id")


@query(f"""{PROJ_SQL}, m AS (SELECT frame_id, CASE WHEN count(*) > 1 THEN median(sqrt(du*du+dv*dv)) END AS md FROM proj GROUP BY 1)
SELECT frame_id, round(md,6) AS err_med, round(greatest(0.4, coalesce(2*md,0)),6) AS norm_err, round(greatest(2.4, coalesce(3*md,0)),6) AS max_err FROM m""")
def adaptive_error_limits(t):
    d = M.error_limits(projected(t).withColumn("e", F.hypot("du", "dv")), "frame_id", "e", DIAG)
    return d.select("frame_id", *[F.round(c, 6).alias(c) for c in ("err_med", "norm_err", "max_err")])


@query(f"""{PROJ_SQL}, h AS (SELECT kp_id, bool_or(cz < 0) AS behind FROM proj GROUP BY 1), q AS (SELECT proj.*, behind FROM proj JOIN h USING (kp_id)),
s AS (SELECT frame_id, (stddev_pop(du)+stddev_pop(dv))/2 AS sd FROM q WHERE NOT behind GROUP BY 1),
b AS (SELECT kp_id, bit_or(CASE WHEN behind THEN 1 ELSE CASE WHEN sqrt(du*du+dv*dv) > greatest(0.4, 2*sd) + 1e-9 THEN 1 ELSE 0 END | CASE WHEN sqrt(du*du+dv*dv) > greatest(2.4, 3*sd) THEN 2 ELSE 0 END END) AS flags
 FROM q LEFT JOIN s USING (frame_id) GROUP BY 1)
SELECT kp_id, CAST(flags AS INTEGER) AS flags, CASE WHEN flags = 0 THEN 'good' WHEN flags = 1 THEN 'wait' ELSE 'remove' END AS verdict FROM b""")
def landmark_sanity(t):
    return M.classify_landmarks(projected(t), "kp_id", "frame_id", "cam.z", "du", "dv", DIAG)


_STATE = """st AS (SELECT l_orderkey AS frame_id, count(*) AS n, avg(CASE WHEN l_discount > 0.06 THEN 1.0::DOUBLE ELSE 0 END) AS view_ratio, avg(CASE WHEN l_tax > 0.05 THEN 1.0::DOUBLE ELSE 0 END) AS tri, CAST(sum(l_quantity) AS BIGINT) AS active FROM lineitem GROUP BY 1)"""


@query(f"""WITH {_STATE} SELECT frame_id, CASE WHEN n / 8.0 < 0.7 AND n < 3 THEN 'few_keypoints' WHEN frame_id % 13 > 5 THEN 'rotation' WHEN view_ratio > 0.3 THEN 'viewpoint'
 WHEN tri > 0 AND (tri > 0.3 OR active < 24) THEN 'triangulation' END AS reason FROM st""")
def keyframe_decision(t):
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("frame_id")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("l_discount") > 0.06).cast("double")).alias("view"),
        F.avg((F.col("l_tax") > 0.05).cast("double")).alias("tri"), F.sum("l_quantity").alias("active"))
    return s.select("frame_id", M.keyframe_reason(F.col("n"), (F.col("frame_id") % 13).cast("double"), F.col("view"), F.col("tri"), F.col("active"), 4, 12).alias("reason"))


_ROT = "radians(frame_id % 5 - 2)"


@query(f"""{PROJ_SQL}, p AS (SELECT frame_id, kp_id, cx/cz*500+320 AS u, cy/cz*510+240 AS v FROM proj), n AS (
 SELECT *, lag(u) OVER w AS u0, lag(v) OVER w AS v0, lag(frame_id) OVER w AS ref FROM p WINDOW w AS (PARTITION BY kp_id ORDER BY frame_id)),
r AS (SELECT *, (u0+0.5-320)/500 AS rx, (v0+0.5-240)/510 AS ry, cos({_ROT}) AS c, sin({_ROT}) AS s FROM n WHERE ref IS NOT NULL)
SELECT kp_id, frame_id, round(sqrt(pow((c*rx+s)/(c-s*rx)*500+319.5-u,2)+pow(ry/(c-s*rx)*510+239.5-v,2))/800,5) AS displ FROM r
 WHERE sqrt(pow((c*rx+s)/(c-s*rx)*500+319.5-u,2)+pow(ry/(c-s*rx)*510+239.5-v,2))/800 > 0.008""")
def viewpoint_changed(t):
    """Rotation-compensated displacement of every keypoint against its previous view."""
    from navlytics.functions import rotations as R
    from navlytics.operators.ordered import Ordered

    d = projected(t).select("frame_id", "kp_id", CAM.project(F.col("cam"), False).alias("p")).select("frame_id", "kp_id", "p.x", "p.y")
    o = Ordered(d, ["kp_id"], "frame_id", "frame_id").prefix(lag={"u0": F.col("x"), "v0": F.col("y")}).where("u0 is not null")
    o = o.withColumn("rel", R.axis_quat("y", F.radians((F.col("frame_id") % 5 - 2).cast("double"))))
    o = M.compensated_displacement(o, CAM, "rel", "u0", "v0", "x", "y", "px")
    # one generator drops and rounds: a filter would be pushed below the projections, with all their expressions written out in it
    displ = F.col("px") / DIAG
    return o.select("kp_id", "frame_id", F.explode(F.when(displ > 0.008, F.array(F.round(displ, 5)))).alias("displ"))


@query(f"""{PROJ_SQL}, p AS (SELECT frame_id, kp_id, sqrt(pow(cx/cz*500,2)+pow(cy/cz*510,2))/800 AS d FROM proj)
SELECT kp_id, frame_id AS ref_frame, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY kp_id ORDER BY d DESC, frame_id) AS r FROM p) WHERE r = 1 AND d > 0.016""")
def triangulation_candidates(t):
    d = projected(t).select("frame_id", "kp_id", CAM.project(F.col("cam"), False).alias("p"))
    d = d.select("frame_id", "kp_id", (F.hypot(F.col("p.x") - 320, F.col("p.y") - 240) / DIAG).alias("d"))
    return M.best_reference(d, "kp_id", "frame_id", "d", 0.016).withColumn("d", F.round("d", 6))


@query("""WITH s AS (SELECT p_partkey AS kp_id, p_size AS total_count, p_partkey % (p_size + 1) AS inlier_count, p_partkey % 3 <> 0 AS active FROM part),
n AS (SELECT l_partkey AS kp_id, count(*) AS n FROM lineitem WHERE l_orderkey % 4 <> 1 GROUP BY 1),
d AS (SELECT s.*, coalesce(n, 0) AS n_obs, total_count >= 2 AND inlier_count / total_count < 0.15 AS poor FROM s LEFT JOIN n USING (kp_id))
SELECT kp_id, n_obs, CASE WHEN poor THEN 'ratio' ELSE 'observations' END AS reason FROM d WHERE poor OR (active AND n_obs < 2) OR (NOT active AND n_obs < 3)""")
def prune_landmarks(t):
    d = M.prune_candidates(_counted(t), *_window_obs(t))
    return d


def _counted(t):
    k = F.col("p_partkey")
    return t.part.select(k.alias("kp_id"), F.col("p_size").alias("total_count"), (k % (F.col("p_size") + 1)).alias("inlier_count"), (k % 3 != 0).alias("active"))


def _window_obs(t):
    obs = t.lineitem.select(F.col("l_partkey").alias("kp_id"), F.col("l_orderkey").alias("frame_id"))
    removed = t.orders.where("o_orderkey % 4 = 1").select(F.col("o_orderkey").alias("frame_id"))
    return obs, "kp_id", removed, "frame_id"


@query("""WITH n AS (SELECT l_partkey AS kp_id, count(*) AS n FROM lineitem GROUP BY 1)
SELECT p_partkey AS kp_id, p_partkey % 3 <> 0 AND NOT p_partkey % 4 = 0 AS active FROM part LEFT JOIN n ON kp_id = p_partkey WHERE NOT p_partkey % 4 = 0 OR coalesce(n, 0) >= 3""")
def deactivate_landmarks(t):
    obs = _window_obs(t)[0]
    doomed = t.part.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("kp_id"))
    return M.deactivate(_counted(t), obs, doomed, "kp_id", 3).select("kp_id", "active")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r <= 3")
def keyframe_fifo_window(t):
    return M.fifo_window(t.orders.select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 3)


@query("SELECT o_orderkey, o_orderkey % 4 = 0 AS maintenance FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphan_frames(t):
    d = t.orders.join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
    return d.select("o_orderkey", (F.pmod("o_orderkey", F.lit(4)) == 0).alias("maintenance"))


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS removed FROM orders")
def keyframe_union(t):
    """Removed and current keyframes as one list."""
    o = t.orders.select("o_orderkey")
    gone = o.where("o_orderkey % 3 = 0")
    return gone.withColumn("removed", F.lit(True)).unionByName(o.join(gone, "o_orderkey", "left_anti").withColumn("removed", F.lit(False)))


@query("""SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_orderkey % 2 = 0 AND l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 2 = 1) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 20)""")
def inlier_intersection(t):
    a = t.lineitem.where("l_orderkey % 2 = 0").select(F.col("l_partkey").alias("id"))
    b = t.lineitem.where("l_orderkey % 2 = 1").select(F.col("l_partkey").alias("id"))
    good = t.part.where("p_size > 20").select(F.col("p_partkey").alias("id"))
    return a.join(b, "id", "left_semi").join(good, "id", "left_semi").distinct()


@query(f"WITH {OBS_SQL}, {LANDMARKS_SQL} SELECT frame_id, kp_id, round(px, 4) AS x, kp_id % 2 = 0 AS in_3d FROM obs JOIN landmarks USING (kp_id) WHERE kp_id % 3 <> 0")
def active_landmark_join(t):
    d = observations(t).join(landmarks(t).where("kp_id % 3 <> 0"), "kp_id")
    return d.select("frame_id", "kp_id", F.round(F.col("pt.x"), 4).alias("x"), (F.col("kp_id") % 2 == 0).alias("in_3d"))


@query("SELECT l_orderkey AS f0, l_orderkey + 1 AS f1, count(*) AS common FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey + 1 AND a.l_suppkey = b.l_suppkey) GROUP BY 1, 2")
def two_view_pairs(t):
    a = t.lineitem.select(F.col("l_orderkey").alias("f0"), "l_suppkey").distinct()
    b = t.lineitem.select((F.col("l_orderkey") - 1).alias("f0"), "l_suppkey").distinct()
    return a.join(b, ["f0", "l_suppkey"]).groupBy("f0", (F.col("f0") + 1).alias("f1")).agg(F.count(F.lit(1)).alias("common"))


@query("""WITH k AS (SELECT DISTINCT o_orderkey AS frame_id FROM orders WHERE o_orderstatus = 'F'), o AS (SELECT DISTINCT l_orderkey AS frame_id, l_partkey AS kp_id FROM lineitem JOIN k ON l_orderkey = frame_id),
f AS (SELECT frame_id, row_number() OVER (ORDER BY frame_id) - 1 AS cam_idx FROM (SELECT DISTINCT frame_id FROM o)), p AS (SELECT kp_id, row_number() OVER (ORDER BY kp_id) - 1 AS pt_idx FROM (SELECT DISTINCT kp_id FROM o))
SELECT cam_idx, pt_idx, frame_id, kp_id FROM o JOIN f USING (frame_id) JOIN p USING (kp_id)""")
def ba_args_dense(t):
    """Keyframes, observations and landmarks joined, with consecutive camera and point numbers."""
    k = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("frame_id"))
    o = t.lineitem.select(F.col("l_orderkey").alias("frame_id"), F.col("l_partkey").alias("kp_id")).distinct().join(k, "frame_id", "left_semi")
    f = dense_ids(o.select("frame_id").distinct(), "frame_id", "cam_idx")
    p = dense_ids(o.select("kp_id").distinct(), "kp_id", "pt_idx")
    return o.join(f, "frame_id").join(p, "kp_id").select("cam_idx", "pt_idx", "frame_id", "kp_id")


@query(f"WITH {OBS_SQL} SELECT frame_id, kp_id FROM obs WHERE sqrt(du*du+dv*dv) <= 0.7")
def filter_by_repr_err(t):
    return observations(t).where(F.hypot("du", "dv") <= 0.7).select("frame_id", "kp_id")


@query("""SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_quantity > 0 AND l_discount < 0.08 AND l_tax < 0.08 GROUP BY 1, 2 HAVING count(*) >= 15""")
def pair_quality_having(t):
    d = t.lineitem.where("l_quantity > 0 and l_discount < 0.08 and l_tax < 0.08")
    return d.groupBy("l_suppkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n >= 15")


@query("""SELECT l_suppkey, least(count(DISTINCT (floor(l_partkey/50.0), floor(l_orderkey/500.0))), count(DISTINCT (floor(l_orderkey/50.0), floor(l_partkey/500.0)))) AS cells FROM lineitem GROUP BY 1""")
def inlier_cell_count(t):
    d = t.lineitem.select("l_suppkey", (F.col("l_partkey") / 10).alias("pa"), (F.col("l_orderkey") / 100).alias("oa"), (F.col("l_orderkey") / 10).alias("ob"), (F.col("l_partkey") / 100).alias("pb"))
    return M.inlier_cells(d, ["l_suppkey"], ("pa", "oa"), ("ob", "pb"), 5.0)


@query("""WITH s AS (SELECT label, count(*) AS n, max(vec_id) + 1 AS m FROM embeddings GROUP BY 1), o AS (SELECT label, coalesce(sum(n) OVER w, 0) AS on_, coalesce(sum(m) OVER w, 0) AS om FROM s WINDOW w AS (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT vec_id, label, CAST(vec_id % 7 + on_ AS BIGINT) AS pose_idx, CAST(vec_id + om AS BIGINT) AS pt_idx FROM embeddings JOIN o USING (label)""")
def join_batches(t):
    e = t.embeddings.select("vec_id", "label", (F.col("vec_id") % 7).alias("pose_idx"), F.col("vec_id").alias("pt_idx"))
    sizes = e.groupBy("label").agg(F.count(F.lit(1)).alias("pose_idx"), (F.max("vec_id") + 1).alias("pt_idx"))
    return M.join_batches(e, "label", ["pose_idx", "pt_idx"], sizes)


@query("""SELECT p_partkey AS track_id, CASE WHEN p_size > 25 THEN min_by(l_quantity, l_orderkey * 10000000 + l_suppkey * 1000 + l_quantity) ELSE round(avg(l_quantity), 6) END AS x FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey, p_size""")
def track_mean(t):
    """Mean triangulated coordinate per track; frozen tracks keep their first one."""
    d = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") > 25).alias("frozen")), "l_partkey")
    o = F.col("l_orderkey") * 10000000 + F.col("l_suppkey") * 1000 + F.col("l_quantity")
    g = d.groupBy(F.col("l_partkey").alias("track_id")).agg(F.max("frozen").alias("frozen"), F.min_by("l_quantity", o).alias("first"), F.avg("l_quantity").alias("mean"))
    return g.select("track_id", F.when(F.col("frozen"), F.col("first")).otherwise(F.round("mean", 6)).alias("x"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_size + 0.5 ELSE p_retailprice END AS x, p_partkey % 2 = 0 OR p_size < 10 AS known FROM part")
def trajectory_update(t):
    """New values where a solution exists, old ones elsewhere; lookup over two maps."""
    new = t.part.where("p_partkey % 4 = 0").select("p_partkey", (F.col("p_size") + 0.5).alias("new_x"))
    m2 = t.part.where("p_partkey % 2 = 0").select("p_partkey", F.lit(True).alias("a"))
    m3 = t.part.where("p_size < 10").select("p_partkey", F.lit(True).alias("b"))
    d = t.part.join(new, "p_partkey", "left").join(m2, "p_partkey", "left").join(m3, "p_partkey", "left")
    return d.select("p_partkey", F.coalesce("new_x", "p_retailprice").alias("x"), F.coalesce("a", "b", F.lit(False)).alias("known"))
