"""Stateful frame processing: keyframes, session resets, filters and late corrections.

State is one small record per session.  Keypoint-level input is reduced to one row per frame by
native aggregation before it reaches a stateful operator, and inside a micro-batch only those frame
rows of a session are ordered.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from navlytics.operators.ordered import Ordered, asof_backward
from navlytics.session import shared_folder

KEYFRAME_OUT = "session BIGINT, frame_id BIGINT, t DOUBLE, track_no INT, is_keyframe BOOLEAN, reason STRING, kf_count INT, window ARRAY<BIGINT>"
KEYFRAME_STATE = "last_t DOUBLE, track_no INT, kf_t DOUBLE, w DOUBLE, x DOUBLE, y DOUBLE, z DOUBLE, kf_count INT, window ARRAY<BIGINT>"


def thin_window(ids: list[int], limit: int, fifo: int, active: dict[int, int] | None = None) -> list[int]:
    """Keyframe numbers to keep, at most ``limit``: the newest ``fifo`` and, before them, ever wider gaps.

    ``active`` counts the active landmarks of keyframes; older keyframes that have none go first. Then, one at a time, goes the later end of the gap that
    falls furthest below its wanted width, which decays from ten numbers at the oldest gap to one at the newest; of equal ones the oldest.
    """
    if limit <= fifo:
        return list(ids)[-limit:]
    old, new = (ids[:-fifo], ids[-fifo:]) if fifo else (ids, [])
    kept = [i for i in old if active is None or active.get(i, 0) > 0] + list(new)
    while len(kept) > limit:
        gaps = list(zip(kept, kept[1:]))[: len(kept) - fifo]
        missing = {end: 10.0 ** (1 - k / (len(kept) - fifo)) - (end - start) for k, (start, end) in enumerate(gaps)}
        kept.remove(max(missing, key=missing.get))
    return kept


def keyframe_stream(frames: DataFrame, max_keypoints: int = 315, min_kp_ratio: float = 0.7, rot_deg: float = 5.0, gap_sec: float = 6.0,
                    fifo: int = 8, need_measure: bool = False, limit: int | None = None) -> DataFrame:
    """Decide keyframes over (session, frame_id, t, n_kp, w, x, y, z, has_measure) rows.

    A session without frames for ``gap_sec`` starts a new track; its first frame is a keyframe (with a
    measure if one is required).  Later ones need few keypoints or a rotation beyond the limit.  The
    window is first-in-first-out, or thinned to ``limit`` keyframes when that is larger than ``fifo``.
    """

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(chunks)).sort_values(["t", "frame_id"], kind="stable")
        last_t, track, kf_t, *q, count, window = state.get if state.exists else (None, 0, None, 1.0, 0.0, 0.0, 0.0, 0, [])
        window = list(window)
        rows = []
        for r in pdf.itertuples(index=False):
            if last_t is not None and r.t - last_t > gap_sec:
                track, kf_t, window = track + 1, None, []
            last_t = r.t
            allowed = r.has_measure or not need_measure
            reason = None
            if allowed and kf_t is None:
                reason = "first"
            elif allowed and r.n_kp / max_keypoints < min_kp_ratio:
                reason = "few_keypoints"
            elif allowed:
                dot = min(1.0, max(-1.0, float(np.dot(q, (r.w, r.x, r.y, r.z)))))
                ang = abs((2 * math.acos(dot) + math.pi) % (2 * math.pi) - math.pi)
                reason = "rotation" if math.degrees(ang) > rot_deg else None
            if reason:
                kf_t, q, count = r.t, [r.w, r.x, r.y, r.z], count + 1
                window = thin_window(window + [r.frame_id], limit or fifo, fifo)
            rows.append((key[0], r.frame_id, r.t, track, reason is not None, reason, count, list(window)))
        state.update((last_t, track, kf_t, *map(float, q), count, window))
        yield pd.DataFrame(rows, columns=["session", "frame_id", "t", "track_no", "is_keyframe", "reason", "kf_count", "window"])

    return frames.groupBy("session").applyInPandasWithState(run, KEYFRAME_OUT, KEYFRAME_STATE, "append", GroupStateTimeout.NoTimeout)


def drift_filter_stream(df: DataFrame, keep: float = 0.8) -> DataFrame:
    """Exponential mean of ``value`` per session over (session, frame_id, t, value) rows."""

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(chunks)).sort_values(["t", "frame_id"], kind="stable")
        cur = state.get[0] if state.exists else None
        out = []
        for v in pdf["value"]:
            cur = v if cur is None else keep * cur + (1.0 - keep) * v
            out.append(cur)
        state.update((float(cur),))
        yield pd.DataFrame({"session": key[0], "frame_id": pdf["frame_id"].to_numpy(), "smooth": out})

    return df.groupBy("session").applyInPandasWithState(
        run, "session BIGINT, frame_id BIGINT, smooth DOUBLE", "cur DOUBLE", "append", GroupStateTimeout.NoTimeout)


def session_tracks(df: DataFrame, ts: str, session: str, gap: str = "6 seconds", watermark: str = "1 minute") -> DataFrame:
    """Uninterrupted tracks: native session windows on a stream; on a table, gaps found slice by slice,
    because a batch session window would sort a whole session in one task."""
    if not df.isStreaming:
        us = df.select(session, F.unix_micros(ts).alias("__us"), F.xxhash64(*df.columns).alias("__tie"))
        width = F.expr(f"unix_micros(timestamp_seconds(0) + interval {gap})")
        o = Ordered(us, [session], "__us", "__tie").prefix(lag={"__p": F.col("__us")}, keep_slice=True)
        o = o.withColumn("__cut", F.coalesce((F.col("__us") - F.col("__p") >= width).cast("bigint"), F.lit(0).cast("bigint")))
        o = Ordered(o, [session], "__us", "__tie").prefix(total={"__no": F.col("__cut")})
        g = o.groupBy(session, "__no").agg(F.min("__us").alias("a"), F.max("__us").alias("b"), F.count(F.lit(1)).alias("frames"))
        return g.select(session, F.timestamp_micros("a").alias("start"), F.timestamp_micros(F.col("b") + width).alias("end"), "frames")
    d = df.withWatermark(ts, watermark)
    return d.groupBy(session, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("frames")).select(
        session, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "frames")


def observation_stream(df: DataFrame, ts: str, keys: list[str], watermark: str = "1 minute") -> DataFrame:
    """Tracked keypoint rows without redelivered copies."""
    return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def windowed_counts(df: DataFrame, ts: str, key: str, width: str, watermark: str = "1 minute") -> DataFrame:
    d = df.withWatermark(ts, watermark) if df.isStreaming else df
    return d.groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def late_correction(frames: DataFrame, corrections: DataFrame, keys: list[str], frame: str, kf: str, coords: list[str]) -> DataFrame:
    """Shift frames newer than a solved keyframe by the latest delta known for it.

    ``corrections`` has keys, the keyframe number and one delta per coordinate.
    """
    c = corrections.select(*keys, F.col(kf).cast("double").alias("__k"), *[F.col(x).alias(f"__d_{x}") for x in coords])
    f = frames.withColumn("__f", F.col(frame).cast("double"))
    hit = asof_backward(f, c, keys, "__f", "__k", frame, [f"__d_{x}" for x in coords])
    return hit.withColumns({x: F.col(x) + F.coalesce(F.col(f"__d_{x}"), F.lit(0.0)) for x in coords}).drop("__f", *[f"__d_{x}" for x in coords])


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared folder."""
    return f"{shared_folder(spark)}/navlytics-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drain an available-now stream into Parquet and read it back."""
    spark = stream.sparkSession
    root = work_folder(spark)
    q = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/ckpt").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def read_stream(spark: SparkSession, folder: str, file_glob: str, bytes_per_trigger: int = 256 * 1024 * 1024) -> DataFrame:
    """Parquet files of a folder as a stream with the schema of what is there.

    The byte limit bounds a micro-batch, and with it the frame rows of one session in one task.
    """
    schema = spark.read.option("pathGlobFilter", file_glob).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", file_glob).option("maxBytesPerTrigger", bytes_per_trigger).parquet(folder)
