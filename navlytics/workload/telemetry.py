"""Telemetry, frame clocks, as-of lookups and ordered windows over the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from navlytics.functions import poses as P
from navlytics.functions import rotations as R
from navlytics.functions import vectors as V
from navlytics.operators.ordered import Ordered, asof_backward, dense_ids
from navlytics.sources import telemetry as S
from navlytics.workload.base import frames, micros, query, rnd

_SEC = "epoch_us(ts) / 1e6"


def _video(t):
    e = F.col("event_id")
    sec = (e * 40 + F.col("user_id")) / 1000.0
    pts = F.when(e % 17 == 0, 0.0).otherwise(sec - F.when(e % 13 == 0, 0.5).otherwise(0.0))
    return t.events.select("user_id", "event_id", pts.alias("pts"))


_VIDEO = """v AS (SELECT user_id, event_id, CASE WHEN event_id % 17 = 0 THEN 0.0::DOUBLE ELSE (event_id*40+user_id)/1000.0::DOUBLE - CASE WHEN event_id % 13 = 0 THEN 0.5::DOUBLE ELSE 0 END END AS pts FROM events)"""


@query(f"""WITH {_VIDEO}, a AS (SELECT *, row_number() OVER w AS rn, last_value(CASE WHEN pts <> 0 THEN pts END IGNORE NULLS) OVER w AS base FROM v WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, last_value(CASE WHEN pts <> 0 THEN rn END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS rn0 FROM a),
c AS (SELECT *, coalesce(base + (rn - rn0) / 25.0::DOUBLE, pts) AS raw FROM b),
d AS (SELECT *, greatest(0, coalesce(lag(raw) OVER (PARTITION BY user_id ORDER BY event_id) - raw, 0)) AS back FROM c)
SELECT user_id, event_id, round(raw + sum(back) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 5) AS time FROM d""")
def clock_repair(t):
    return S.repair_clock(_video(t), ["user_id"], "event_id", "pts", 25.0).select("user_id", "event_id", F.round("time", 5).alias("time"))


@query("""WITH r AS (SELECT user_id, event_id AS s, event_id + 150 AS e FROM events WHERE event_type = 'error')
SELECT user_id, event_id FROM events f WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = f.user_id AND r.s <= f.event_id AND f.event_id < r.e)""")
def invalid_range_filter(t):
    f = t.events.select("user_id", "event_id")
    r = t.events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("s"), (F.col("event_id") + 150).alias("e"))
    return S.drop_ranges(f, r, ["user_id"], "event_id", "s", "e")


@query("""SELECT f.user_id, f.event_id, round(f.value + coalesce((SELECT sum(g.value) FROM events g WHERE g.user_id = f.user_id AND g.event_type = 'signup' AND g.event_id <= f.event_id), 0), 4) AS time FROM events f""")
def gap_offsets(t):
    f = t.events.select("user_id", "event_id", F.col("value").alias("time"))
    g = t.events.where("event_type = 'signup'").select("user_id", "event_id", F.col("value").alias("off"))
    return S.add_gap_offsets(f, g, ["user_id"], "event_id", "time", "off").withColumn("time", F.round("time", 4))


_AS_F = "f AS (SELECT user_id, event_id, epoch_us(ts)/1e6 AS t FROM events WHERE event_type <> 'view'), m AS (SELECT user_id, event_id AS mid, epoch_us(ts)/1e6 AS mt FROM events WHERE event_type = 'view')"


@query(f"""WITH {_AS_F}, a AS (SELECT f.*, m.mid, m.mt FROM f ASOF LEFT JOIN m ON f.user_id = m.user_id AND f.t + 600 >= m.mt),
b AS (SELECT *, mid IS NOT NULL AND mid IS DISTINCT FROM lag(mid) OVER (PARTITION BY user_id ORDER BY t, event_id) AS fresh FROM a)
SELECT user_id, event_id, CAST(CASE WHEN fresh THEN mid END AS DOUBLE) AS measure_id, CASE WHEN fresh THEN round(mt - t, 4) END AS time_off FROM b""")
def asof_measurement(t):
    e = t.events.withColumn("t", micros("ts") / 1e6)
    f = e.where("event_type <> 'view'").select("user_id", "event_id", "t")
    m = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("mid"), F.col("t").alias("mt"))
    d = S.attach_measures(f, m, ["user_id"], "t", "mt", "event_id", "mid", 600.0)
    return d.select("user_id", "event_id", F.col("measure_id").cast("double").alias("measure_id"), F.round("time_off", 4).alias("time_off"))


@query(f"""WITH {_AS_F}, a AS (SELECT f.*, m.mid AS lesser FROM f ASOF LEFT JOIN m ON f.user_id = m.user_id AND f.t > m.mt)
SELECT a.user_id, a.event_id, CAST(a.lesser AS DOUBLE) AS lesser, CAST(m.mid AS DOUBLE) AS greater FROM a ASOF LEFT JOIN m ON a.user_id = m.user_id AND a.t < m.mt""")
def nearest_lesser_greater(t):
    """Predecessor and successor in time; the successor is the predecessor on the reversed axis."""
    e = t.events.withColumn("t", micros("ts"))
    f = e.where("event_type <> 'view'").select("user_id", "event_id", "t", (-F.col("t")).alias("nt"))
    m = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("lesser"), (F.col("t") + 1).alias("mt"))
    a = asof_backward(f, m, ["user_id"], "t", "mt", "event_id", ["lesser"])
    g = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("greater"), (-F.col("t") + 1).alias("mt"))
    return asof_backward(a, g, ["user_id"], "nt", "mt", "event_id", ["greater"]).select(
        "user_id", "event_id", F.col("lesser").cast("double").alias("lesser"), F.col("greater").cast("double").alias("greater"))


@query("""WITH s AS (SELECT event_id, user_id, ts, avg(value) OVER w AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT user_id, event_id, round(v, 5) AS v FROM s""")
def centred_mean_window(t):
    e = t.events.select("user_id", "event_id", micros("ts").alias("us"), F.col("value").alias("v"))
    return S.centred_mean(e, ["user_id"], "us", "event_id", ["v"]).select("user_id", "event_id", F.round("v", 5).alias("v"))


@query("""WITH s AS (SELECT event_id, user_id, value AS v, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT user_id, event_id, CAST(k AS INTEGER) AS sub, round(v * (1 - k / 10.0::DOUBLE) + n * (k / 10.0::DOUBLE), 5) AS v, k = 0 AS has_measure FROM s, range(10) r(k) WHERE n IS NOT NULL""")
def synthetic_frames(t):
    e = t.events.select("user_id", "event_id", micros("ts").alias("us"), F.col("value").alias("v"))
    d = S.synthesise_frames(e, ["user_id"], "us", "event_id", ["v"], 10)
    return d.select("user_id", "event_id", "sub", F.round("v", 5).alias("v"), "has_measure")


@query("""WITH d AS (SELECT user_id, event_id, epoch_us(ts)/1e6 AS t, lag(epoch_us(ts)/1e6) OVER w AS pt, value, lag(value) OVER w AS pv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, round((value - pv) / (t - pt) * 1000, 4)+0.0 AS vel FROM d""")
def velocity_lag(t):
    e = t.events.select("user_id", "event_id", micros("ts").alias("us"), "value")
    o = Ordered(e, ["user_id"], "us", "event_id").prefix(lag={"pt": F.col("us"), "pv": F.col("value")})
    v = (F.col("value") - F.col("pv")) / (F.col("us") / 1e6 - F.col("pt") / 1e6) * 1000
    return o.select("user_id", "event_id", rnd(v, 4).alias("vel"))


@query("""SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS time_adj,
 round(sum(value) OVER w, 3) AS clock, max(value) OVER w AS high, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def carried_state(t):
    """Last measured adjustment, running clock, running maximum and frame number of each session."""
    e = t.events.select("user_id", "event_id", micros("ts").alias("us"), "value", "event_type")
    o = Ordered(e, ["user_id"], "us", "event_id").prefix(
        last={"time_adj": F.when(F.col("event_type") == "purchase", F.col("value"))}, total={"clock": F.col("value")}, high={"high": F.col("value")}, rank="n")
    return o.select("user_id", "event_id", "time_adj", F.round("clock", 3).alias("clock"), "high", "n")


@query("""WITH g AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 36e9 THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM g)
SELECT user_id, CAST(session_no AS BIGINT) AS session_no, count(*) AS n, min(event_id) AS first_id FROM s GROUP BY 1, 2""")
def session_reset(t):
    """Tracking restarts after a gap (ten hours here; six seconds for video)."""
    e = t.events.select("user_id", "event_id", micros("ts").alias("us"))
    g = Ordered(e, ["user_id"], "us", "event_id").prefix(lag={"p": F.col("us")}, keep_slice=True)
    g = g.withColumn("cut", F.coalesce((F.col("us") - F.col("p") > 36_000_000_000).cast("bigint"), F.lit(0).cast("bigint")))
    s = Ordered(g, ["user_id"], "us", "event_id").prefix(total={"session_no": F.col("cut")})
    return s.groupBy("user_id", "session_no").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS dense_id FROM orders")
def dense_renumbering(t):
    return dense_ids(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", tie="o_orderkey")


@query("""SELECT doc_id, CAST(regexp_extract('cam0/img' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.png' WHEN doc_id % 3 = 1 THEN '.jpeg' ELSE '.jpg' END, '(\\d+)\\.(png|jpg|jpeg)$', 1) AS BIGINT) AS frame_id,
 'dji-' || doc_id AS vid FROM documents WHERE doc_id % 5 <> 0 AND doc_id > 10 AND doc_id < 9000 AND (doc_id - 1) % 2 = 0""")
def image_name_scan(t):
    path = F.concat(F.lit("cam0/img"), F.col("doc_id"), F.when(F.col("doc_id") % 5 == 0, ".txt").when(F.col("doc_id") % 3 == 0, ".png").when(F.col("doc_id") % 3 == 1, ".jpeg").otherwise(".jpg"))
    d = t.documents.select("doc_id", S.frame_number(path).alias("frame_id"), S.video_id(F.concat(F.lit("/data/dji-"), F.col("doc_id"), F.lit(".mp4"))).alias("vid"))
    return S.sample_frames(d.where("frame_id > 10 and frame_id < 9000"), "frame_id", 1, 2)


@query("""SELECT event_id, 'frame-' || event_id || ' (' || strftime(ts, '%H:%M:%S.%f') || ')' AS name, round(epoch_us(ts)/1e6, 3) AS unix FROM events""")
def frame_names(t):
    return t.events.select("event_id", S.frame_label(F.col("event_id"), F.col("ts").cast("timestamp")).alias("name"), F.round(micros("ts") / 1e6, 3).alias("unix"))


@query("""WITH u AS (SELECT page_id, split_part(url, '://', 2) AS p FROM pages) SELECT page_id, split_part(list_extract(string_split(p, '/'), -1), '-', 1) AS batch,
 try_cast(split_part(p, '/', 3) AS DOUBLE) IS NOT NULL AS is_num FROM u""")
def batch_ids(t):
    """Batch id = last path segment up to its first dash; and a float-parsable test."""
    p = F.element_at(F.split("url", "://"), 2)
    seg = F.split(p, "/")
    return t.pages.select("page_id", F.split(F.element_at(seg, -1), "-")[0].alias("batch"),
                          F.coalesce(F.expr("try_cast(try_element_at(split(try_element_at(split(url, '://'), 2), '/'), 3) as double)").isNotNull(), F.lit(False)).alias("is_num"))


@query("""WITH f AS (SELECT o_orderkey AS id, CAST(o_orderkey % 41 - 20 AS DOUBLE) AS x, CAST(o_custkey % 37 - 18 AS DOUBLE) AS y FROM orders),
p AS (SELECT id, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM f WINDOW w AS (ORDER BY id)) SELECT id, round(x*0.7+nx*0.3, 6)+0.0 AS x, round(y*0.7+ny*0.3, 6)+0.0 AS y FROM p WHERE nx IS NOT NULL""")
def pose_interpolation(t):
    f = frames(t)
    o = Ordered(f, [], "frame_id", "frame_id").prefix(lead={"nl": F.col("loc"), "nq": F.col("quat")}).where("nl is not null")
    d = o.select("frame_id", P.interpolate(P.pose(F.col("loc"), F.col("quat")), P.pose(F.col("nl"), F.col("nq")), 0.3).loc.alias("l"))
    return d.select(F.col("frame_id").alias("id"), rnd(F.col("l.x")).alias("x"), rnd(F.col("l.y")).alias("y"))


@query("""WITH k AS (SELECT user_id, event_id, epoch_us(ts)/1e9 AS t, value AS v FROM events WHERE event_type <> 'view'),
n AS (SELECT *, lag(t) OVER w AS t0, lag(v) OVER w AS v0, lead(t) OVER w AS t2, lead(v) OVER w AS v2 FROM k WINDOW w AS (PARTITION BY user_id ORDER BY t)),
m AS (SELECT *, coalesce(((v-v0)/(t-t0)*(t2-t)+(v2-v)/(t2-t)*(t-t0))/(t2-t0), (v-v0)/(t-t0), (v2-v)/(t2-t), 0) AS m FROM n),
s AS (SELECT user_id, t, v, m, lead(t) OVER w AS tn, lead(v) OVER w AS vn, lead(m) OVER w AS mn, row_number() OVER w AS rn FROM m WINDOW w AS (PARTITION BY user_id ORDER BY t)),
q AS (SELECT user_id, event_id, epoch_us(ts)/1e9 AS x FROM events WHERE event_type = 'view'),
j AS (SELECT q.*, coalesce(a.t, f.t) AS t, coalesce(a.v, f.v) AS v, coalesce(a.m, f.m) AS m, coalesce(a.tn, f.tn) AS tn, coalesce(a.vn, f.vn) AS vn, coalesce(a.mn, f.mn) AS mn
 FROM q ASOF LEFT JOIN (SELECT * FROM s WHERE tn IS NOT NULL) a ON q.user_id = a.user_id AND q.x >= a.t LEFT JOIN s f ON f.user_id = q.user_id AND f.rn = 1)
SELECT user_id, event_id, round(coalesce((2*pow(u,3)-3*u*u+1)*v + (pow(u,3)-2*u*u+u)*h*m + (-2*pow(u,3)+3*u*u)*vn + (pow(u,3)-u*u)*h*mn, v), 2)+0.0 AS interp FROM (SELECT *, (x-t)/(tn-t) AS u, tn-t AS h FROM j)""")
def interp_location(t):
    e = t.events.select("user_id", "event_id", (micros("ts") / 1e9).alias("x"), "value", "event_type")
    k = e.where("event_type <> 'view'").select("user_id", F.col("x").alias("kt"), F.col("value").alias("kv"))
    q = e.where("event_type = 'view'").select("user_id", "event_id", "x")
    return S.cubic_at(q, k, ["user_id"], "x", "kt", "kv", "event_id").select("user_id", "event_id", rnd(F.col("interp"), 2).alias("interp"))


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN value END AS v,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, v AS m FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.event_id, e.n, CASE WHEN r.m IS NULL THEN e.v WHEN e.v IS NULL THEN r.m ELSE 0.8 * r.m + 0.2 * e.v END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id, round(m + 1e-9, 4) AS smooth FROM r""")
def drift_filter_batch(t):
    """The drift filter over whole sessions; errors carry no value."""
    e = t.events.select("user_id", "event_id", micros("ts").alias("us"), F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    d = S.exponential_mean(e, ["user_id"], "us", "event_id", "value", "smooth")
    return d.select("user_id", "event_id", F.round(F.col("smooth") + 1e-9, 4).alias("smooth"))
