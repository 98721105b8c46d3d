"""Streaming operators over the event table, drained with an available-now trigger."""

from __future__ import annotations

from pyspark.sql import functions as F

from navlytics.functions import rotations as R
from navlytics.streaming import frames as S
from navlytics.workload.base import micros, query, rnd


def _events(t):
    return S.read_stream(t.spark, t.path, "events.parquet")


@query("""WITH r AS (SELECT user_id AS session, event_id AS frame_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT a.session, a.frame_id, round(sum(CASE WHEN b.n = 1 THEN pow(0.8, a.n - 1) ELSE 0.2 * pow(0.8, a.n - b.n) END * b.value), 4) AS smooth FROM r a JOIN r b ON a.session = b.session AND b.n <= a.n GROUP BY 1, 2""")
def drift_filter(t):
    e = _events(t).select(F.col("user_id").alias("session"), F.col("event_id").alias("frame_id"), (micros("ts") / 1e6).alias("t"), "value")
    return S.run_to_table(S.drift_filter_stream(e)).withColumn("smooth", F.round("smooth", 4))


@query()
def keyframe_stream(t):
    """Compared in the tests with a serial walk over each session."""
    e = _events(t).withColumn("q", R.from_ypr(F.radians((F.col("event_id") % 40).cast("double")), F.lit(0.0), F.lit(0.0)))
    f = e.select(F.col("user_id").alias("session"), F.col("event_id").alias("frame_id"), (micros("ts") / 1e6).alias("t"), F.greatest(F.lit(0), 315 - F.col("value").cast("int") * 2).alias("n_kp"),
                 "q.w", "q.x", "q.y", "q.z", (F.col("event_type") != "error").alias("has_measure"))
    return S.run_to_table(S.keyframe_stream(f, gap_sec=36000.0, rot_deg=10.0, need_measure=True))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 36e9 THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, epoch_us(min(ts))/1e6 AS start, count(*) AS frames FROM s GROUP BY user_id, n""")
def session_window_tracks(t):
    e = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    d = S.session_tracks(e, "ts", "user_id", "10 hours")
    return d.select("user_id", (F.unix_micros("start") / 1e6).alias("start"), "frames")


@query("""SELECT epoch_us(time_bucket(INTERVAL '1 day', ts))//1000000 AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_window_counts(t):
    """Complete-mode windows over de-duplicated rows."""
    e = t.events.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    d = S.windowed_counts(S.observation_stream(e.unionByName(e.where("event_id % 3 = 0")), "ts", ["event_id"]), "ts", "event_type", "1 day")
    return d.select(F.unix_seconds("start").alias("start"), "event_type", "n")


@query("""WITH c AS (SELECT user_id, event_id AS kf, value AS d FROM events WHERE event_type = 'signup') SELECT e.user_id, e.event_id, round(e.value + coalesce(c.d, 0), 4) AS value FROM events e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.event_id >= c.kf""")
def late_correction(t):
    f = t.events.select("user_id", "event_id", "value")
    c = t.events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("kf"), "value")
    return S.late_correction(f, c, ["user_id"], "event_id", "kf", ["value"]).withColumn("value", F.round("value", 4))
