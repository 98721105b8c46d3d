"""Streams against a serial walk over the same rows."""

import numpy as np
from pyspark.sql import functions as F

from navlytics.streaming import frames as S


def test_keyframe_stream_over_two_batches(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = []
    for s in (1, 2):
        t = 0.0
        for i in range(40):
            t += 20.0 if i == 25 else 1.0
            yaw = 0.03 * i
            rows.append((s, i, t, int(rng.integers(200, 316)), float(np.cos(yaw / 2)), 0.0, 0.0, float(np.sin(yaw / 2)), bool(i % 5)))
    d = spark.createDataFrame(rows, "session long, frame_id long, t double, n_kp int, w double, x double, y double, z double, has_measure boolean")
    for part, cond in enumerate(("frame_id < 18", "frame_id >= 18")):
        d.where(cond).coalesce(1).write.parquet(str(tmp_path / f"in{part}"))
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    got = {(r.session, r.frame_id): r for r in S.run_to_table(S.keyframe_stream(stream, rot_deg=5.0, fifo=3)).collect()}
    for s in (1, 2):
        last, kf, track, window = None, None, 0, []
        for (_, i, t, n, w, *_xy, z, _m) in (r for r in rows if r[0] == s):
            if last is not None and t - last > 6:
                track, kf, window = track + 1, None, []
            last = t
            yaw = 2 * np.arctan2(z, w)
            why = "first" if kf is None else "few_keypoints" if n / 315 < 0.7 else "rotation" if np.degrees(abs(yaw - kf)) > 5 else None
            if why:
                kf, window = yaw, (window + [i])[-3:]
            r = got[s, i]
            assert (r.reason, r.track_no, list(r.window)) == (why, track, window)


def test_thinning_keeps_the_newest_and_spreads_the_rest():
    assert S.thin_window(list(range(10)), 4, 4) == [6, 7, 8, 9]
    kept = S.thin_window(list(range(30)), 8, 3)
    assert len(kept) == 8 and kept[-3:] == [27, 28, 29] and kept[0] == 0
    assert np.diff(kept)[0] > np.diff(kept)[-1]


def test_native_windows_on_a_stream(spark, tmp_path):
    d = spark.range(20).select(F.lit(1).alias("s"), F.timestamp_seconds(F.col("id") + F.when(F.col("id") >= 10, 30).otherwise(0)).alias("ts"), "id")
    d.unionByName(d).coalesce(1).write.parquet(str(tmp_path / "in"))
    src = lambda: spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = S.session_tracks(S.observation_stream(src(), "ts", ["id"], "1 hour"), "ts", "s", "6 seconds", "1 hour")
    batch = S.session_tracks(spark.read.parquet(str(tmp_path / "in")).dropDuplicates(["id"]), "ts", "s", "6 seconds")
    assert sorted(r.frames for r in batch.collect()) == [10, 10]
    assert q.isStreaming and "start" in q.columns


def test_window_drops_idle_keyframes_first():
    ids = list(range(0, 40, 2))
    assert S.thin_window(ids, 8, 3, dict.fromkeys(ids[:4], 5)) == [0, 2, 4, 6, 34, 36, 38]
    kept = S.thin_window(ids, 8, 3, dict.fromkeys(ids, 1))
    assert kept == S.thin_window(ids, 8, 3) and kept[-2:] == [36, 38] and len(kept) == 8
