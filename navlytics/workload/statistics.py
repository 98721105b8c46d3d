"""Track statistics, robust aggregates and calibration error reports."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from navlytics.operators import quantiles as Q
from navlytics.plans import tracking as T
from navlytics.workload.base import OBS_SQL, PROJ_SQL, micros, observations, projected, query, rnd

# tracks: landmark = order, frame = part, so that lengths spread over the report's bins
_FIN = f"""WITH {OBS_SQL.replace("l_orderkey AS frame_id, l_partkey AS kp_id", "l_partkey AS frame_id, l_orderkey AS kp_id")}, fin AS (SELECT * FROM obs WHERE kp_id NOT IN (SELECT kp_id FROM obs WHERE frame_id = (SELECT max(frame_id) FROM obs))),
len AS (SELECT kp_id, count(*) AS track_len FROM fin GROUP BY 1)"""


def _finished(t):
    obs = observations(t).select(F.col("kp_id").alias("frame_id"), F.col("frame_id").alias("kp_id"), "du", "dv")
    return T.finished_observations(obs, "kp_id", "frame_id")


def _lengths(t):
    return T.track_lengths(_finished(t), "kp_id")


@query(f"{_FIN} SELECT least(track_len, 5) AS len_bin, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM len GROUP BY 1")
def track_length_histogram(t):
    h = T.length_histogram(_lengths(t))
    return h.withColumn("pct", F.round("pct", 6))


@query(f"{_FIN} SELECT round(quantile_cont(track_len, 0.159), 6) AS len_p15_9, round(quantile_cont(track_len, 0.5), 6) AS len_p50, round(quantile_cont(track_len, 0.841), 6) AS len_p84_1 FROM len")
def track_percentiles(t):
    q = Q.exact_quantiles(_lengths(t), [], "track_len", T.LENGTH_QUANTILES)
    return q.select(*[F.round(c, 6).alias(c) for c in q.columns])


@query(f"{_FIN} SELECT round(quantile_cont(e, 0.5), 6) AS err_p50, round(quantile_cont(e, 0.841), 6) AS err_p84_1, round(quantile_cont(e, 0.977), 6) AS err_p97_7 FROM (SELECT sqrt(du*du+dv*dv) AS e FROM fin)")
def error_percentiles(t):
    d = _finished(t).select(F.hypot("du", "dv").alias("e"))
    q = Q.exact_quantiles(d, [], "e", T.ERROR_QUANTILES)
    return q.select(*[F.round(c, 6).alias(c) for c in q.columns])


@query("SELECT round(avg(CASE WHEN p_size > 12 THEN 1.0 ELSE 0.0 END), 6) AS succ_rate, count(*) FILTER (p_size > 12) AS n_3d, count(*) AS n_all FROM part")
def triangulation_success_rate(t):
    return T.success_rate(t.part, F.col("p_size") > 12).withColumn("succ_rate", F.round("succ_rate", 6))


@query("""WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.02) AS lo, quantile_cont(l_extendedprice, 0.98) AS hi FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(avg(l_extendedprice), 4) AS robust_mean, count(*) AS robust_n FROM lineitem JOIN q USING (l_returnflag)
WHERE l_extendedprice > lo AND l_extendedprice < hi GROUP BY 1""")
def robust_mean_by_group(t):
    return Q.robust_mean(t.lineitem, ["l_returnflag"], "l_extendedprice", 2.0).withColumn("robust_mean", F.round("robust_mean", 4))


@query("""WITH q AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events),
m AS (SELECT avg(value) AS m, count(*) AS n FROM events, q WHERE value > lo AND value < hi), s AS (SELECT pow(value - m, 2) AS sq FROM events, m),
q2 AS (SELECT quantile_cont(sq, 0.01) AS lo, quantile_cont(sq, 0.99) AS hi FROM s)
SELECT round(sqrt(avg(sq) * max(n) / (max(n) - 1)), 5) AS robust_std FROM s, q2, m WHERE sq > lo AND sq < hi""")
def robust_std_total(t):
    return Q.robust_std(t.events, [], "value", 1.0).withColumn("robust_std", F.round("robust_std", 5))


@query("""SELECT event_type, round(quantile_cont(value, 0.95), 6) AS q95, round(quantile_cont(value, 0.2), 6) AS q20 FROM events GROUP BY 1""")
def error_quantiles_by_type(t):
    q = Q.exact_quantiles(t.events, ["event_type"], "value", {"q95": 0.95, "q20": 0.2})
    return q.select("event_type", F.round("q95", 6).alias("q95"), F.round("q20", 6).alias("q20"))


@query(f"""{PROJ_SQL} SELECT frame_id, round(median(sqrt(du*du+dv*dv)), 6) AS repr_px, CASE WHEN frame_id % 3 = 0 THEN round(max(sqrt(lx*lx+ly*ly+lz*lz)), 6) END AS loc_m
 FROM proj GROUP BY frame_id""")
def frame_error_medians(t):
    """Median reprojection norm of each frame; location residuals only at measured frames."""
    d = projected(t).withColumn("e", F.hypot("du", "dv"))
    med = Q.exact_quantiles(d, ["frame_id"], "e", {"repr_px": 0.5})
    loc = d.where("frame_id % 3 = 0").groupBy("frame_id").agg(F.max(F.sqrt(F.col("loc.x") ** 2 + F.col("loc.y") ** 2 + F.col("loc.z") ** 2)).alias("loc_m"))
    return med.join(loc, "frame_id", "left").select("frame_id", F.round("repr_px", 6).alias("repr_px"), F.round("loc_m", 6).alias("loc_m"))


@query("""SELECT count(*) AS frames, round(avg(CASE WHEN value < 100 THEN value END), 6) AS mean_err, round(100.0 * avg(CASE WHEN value < 100 THEN 1 ELSE 0 END), 6) AS ok_pct,
 max_by(value, ts) AS last_err, round(degrees(avg(value / 1000)), 6) AS ori_deg FROM events""")
def run_summary(t):
    """Means ignore failed (NaN) frames, as the reports do."""
    e = t.events.withColumn("err", F.when(F.col("value") < 100, F.col("value")).otherwise(F.lit(float("nan"))))
    ok = ~F.isnan("err")
    return e.agg(F.count(F.lit(1)).alias("frames"), F.round(F.avg(F.when(ok, F.col("err"))), 6).alias("mean_err"),
                 F.round(100.0 * F.avg(ok.cast("int")), 6).alias("ok_pct"), F.max_by("value", "ts").alias("last_err"),
                 F.round(F.degrees(F.avg(F.col("value") / 1000)), 6).alias("ori_deg"))


@query("""SELECT user_id, count(step) AS steps, round(avg(step), 6) AS mean_step, round(stddev_pop(step), 5) AS sd_step FROM (
 SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS step FROM events) GROUP BY 1""")
def step_length_stats(t):
    d = t.events.withColumn("us", micros("ts"))
    s = T.step_lengths(d, ["user_id"], "us", "event_id", ["value"])
    return s.groupBy("user_id").agg(F.count("step").alias("steps"), F.round(F.avg("step"), 6).alias("mean_step"), F.round(F.stddev_pop("step"), 5).alias("sd_step"))


@query("""WITH h AS (SELECT quantile_cont(-s_acctbal, 0.2) AS q20, quantile_cont(-s_acctbal, 0.5) AS q50 FROM supplier WHERE s_nationkey <> 3)
SELECT round(q20, 6) AS ground_q20, round(q50, 6) AS ground_q50 FROM h""")
def ground_altitude(t):
    d = t.supplier.where("s_nationkey <> 3").select((-F.col("s_acctbal")).alias("h"))
    q = Q.exact_quantiles(d, [], "h", {"ground_q20": 0.2, "ground_q50": 0.5})
    return q.select(*[F.round(c, 6).alias(c) for c in q.columns])


@query(f"""{PROJ_SQL} SELECT frame_id, round(0.5*stddev_pop(sqrt(du*du+dv*dv))/avg(sqrt(du*du+dv*dv)) + 0.5*stddev_pop(atan2(dv+0.001,du))/pi(), 5) AS quality
 FROM proj GROUP BY frame_id HAVING count(*) > 2 AND avg(sqrt(du*du+dv*dv)) > 0""")
def displacement_quality(t):
    d = projected(t)
    n = F.hypot("du", "dv")
    q = 0.5 * F.stddev_pop(n) / F.avg(n) + 0.5 * F.stddev_pop(F.atan2(F.col("dv") + 0.001, F.col("du"))) / F.lit(math.pi)
    return d.groupBy("frame_id").agg(F.count(F.lit(1)).alias("c"), F.avg(n).alias("m"), F.try_divide(F.lit(1.0), F.avg(n)).alias("i"), F.stddev_pop(n).alias("s"),
                                     F.stddev_pop(F.atan2(F.col("dv") + 0.001, F.col("du"))).alias("a")).where("c > 2 and m > 0").select(
        "frame_id", F.round(0.5 * F.col("s") / F.col("m") + 0.5 * F.col("a") / F.lit(math.pi), 5).alias("quality"))


@query("""SELECT l_suppkey AS img, round(max(abs(l_discount - 0.05)), 6) AS max_err, count(*) AS n FROM lineitem GROUP BY 1 HAVING max(abs(l_discount - 0.05)) < 0.06""")
def image_max_error(t):
    d = t.lineitem.groupBy(F.col("l_suppkey").alias("img")).agg(F.max(F.abs(F.col("l_discount") - 0.05)).alias("m"), F.count(F.lit(1)).alias("n"))
    return d.where("m < 0.06").select("img", F.round("m", 6).alias("max_err"), "n")


@query(f"""{PROJ_SQL}, r AS (SELECT sqrt(cx*cx+cy*cy) AS rad, (du*cx+dv*cy)/sqrt(cx*cx+cy*cy) AS radial FROM proj WHERE cx*cx+cy*cy > 0),
l AS (SELECT min(rad) AS lo, max(rad) AS hi FROM r)
SELECT CAST(least(floor((rad-lo)/(hi-lo)*20),19) AS BIGINT) AS bin, count(*) AS n, round(avg(radial),6)+0.0 AS mean FROM r, l GROUP BY 1""")
def radial_error_bins(t):
    d = projected(t).select(F.hypot("cam.x", "cam.y").alias("rad"), F.col("cam.x").alias("x"), F.col("cam.y").alias("y"), "du", "dv").where("rad > 0")
    d = d.select("rad", ((F.col("du") * F.col("x") + F.col("dv") * F.col("y")) / F.col("rad")).alias("radial"))
    return T.binned_mean(d, "rad", "radial", 20).withColumn("mean", rnd(F.col("mean")))


@query("""WITH r AS (SELECT event_type, abs(value - 40) AS d FROM events), q AS (SELECT event_type, quantile_cont(d, 0.8) AS q FROM r GROUP BY 1)
SELECT event_type, round(avg(d), 6) AS dispersion FROM r JOIN q USING (event_type) WHERE d < q GROUP BY 1""")
def residual_dispersion(t):
    d = t.events.select("event_type", F.abs(F.col("value") - 40).alias("d"))
    return T.mean_below_quantile(d, ["event_type"], "d", 0.8).withColumn("dispersion", F.round("dispersion", 6))


@query("""SELECT round(median(p_size), 6) AS cx, round(median(p_retailprice), 6) AS cy, round(covar_pop(p_size, p_retailprice), 4) AS cxy,
 round(var_pop(p_size), 4) AS cxx, round(var_pop(p_retailprice), 4) AS cyy FROM part""")
def plane_centroid(t):
    med = [Q.exact_quantiles(t.part, [], c, {n: 0.5}).select(F.round(n, 6).alias(n)) for c, n in (("p_size", "cx"), ("p_retailprice", "cy"))]
    cov = t.part.agg(F.round(F.covar_pop("p_size", "p_retailprice"), 4).alias("cxy"), F.round(F.var_pop("p_size"), 4).alias("cxx"), F.round(F.var_pop("p_retailprice"), 4).alias("cyy"))
    for m in med:
        cov = Q.with_group_values(cov, m, [])
    return cov


@query("""WITH p AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS e FROM embeddings)
SELECT a.vec_id, round(corr(a.e, b.e), 6)+0.0 AS xcorr FROM p a JOIN p b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY 1""")
def image_cross_correlation(t):
    """Normalised cross-correlation of each tile with the next one."""
    p = t.embeddings.select("vec_id", F.posexplode("embedding").alias("i", "e")).withColumn("e", F.col("e").cast("double"))
    n = p.select((F.col("vec_id") - 1).alias("vec_id"), "i", F.col("e").alias("f"))
    return p.join(n, ["vec_id", "i"]).groupBy("vec_id").agg(rnd(F.coalesce(F.corr("e", "f"), F.lit(0.0))).alias("xcorr"))


@query("""WITH t(i, xt) AS (VALUES (0, 100.0), (1, 2000.0), (2, 5555.5), (3, 9000.0))
SELECT CAST(i AS BIGINT) AS i, CAST(xt AS DOUBLE) AS xt, round(sum(pow(0.9, abs(xt - event_id)/100) * value) / sum(pow(0.9, abs(xt - event_id)/100)), 6) AS smooth FROM events, t GROUP BY ALL""")
def weighted_smooth1d(t):
    d = t.events.select(F.col("event_id").cast("double").alias("x"), "value")
    return T.kernel_smooth(d, "x", "value", [100.0, 2000.0, 5555.5, 9000.0], lambda d: F.pow(F.lit(0.9), d / 100)).withColumn("smooth", F.round("smooth", 6))


@query(f"""{PROJ_SQL}, w AS (SELECT du, dv, CASE WHEN sqrt(du*du+dv*dv) > 0.5 THEN sqrt(0.5/sqrt(du*du+dv*dv)) ELSE 1 END AS w FROM proj)
SELECT round(sum(w*w*(du*du+dv*dv)), 4) AS cost, count(*) AS n, round(avg(w*w*(du*du+dv*dv)), 6) AS mean_cost FROM w""")
def huber_cost(t):
    from navlytics.functions.camera import huber_weight

    d = projected(t)
    c = huber_weight(F.hypot("du", "dv"), 0.5) ** 2 * (F.col("du") ** 2 + F.col("dv") ** 2)
    d = d.select(c.alias("c"))
    return d.agg(F.round(F.sum("c"), 4).alias("cost"), F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 6).alias("mean_cost"))


@query("""SELECT round(max(sqrt(pow(ax-bx*k,2)+pow(ay-by_*k,2))), 6) AS max_shift FROM (SELECT *, (ax*bx+ay*by_)/(bx*bx+by_*by_) AS k FROM (
 SELECT p_size+0.5 AS ax, p_retailprice/100 AS ay, p_size+1.0 AS bx, p_retailprice/100+0.25 AS by_ FROM part))""")
def max_shift_error(t):
    from navlytics.functions import vectors as V

    a = V.vec(F.col("p_size") + 0.5, F.col("p_retailprice") / 100, F.lit(0.0))
    b = V.vec(F.col("p_size") + 1.0, F.col("p_retailprice") / 100 + 0.25, F.lit(0.0))
    return t.part.select(V.dist_across(a, b).alias("d")).agg(F.round(F.max("d"), 6).alias("max_shift"))
