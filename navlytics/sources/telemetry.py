"""Telemetry and video frame tables: clock repair, range filters, gap offsets, measurement lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from navlytics.functions import poses as P
from navlytics.operators.ordered import affine_scan, Ordered, asof_backward

TELEMETRY_SCHEMA = (
    "session STRING, ts_us BIGINT, lat DOUBLE, lon DOUBLE, alt DOUBLE, roll DOUBLE, pitch DOUBLE, yaw DOUBLE, "
    "gimbal_roll DOUBLE, gimbal_pitch DOUBLE, gimbal_yaw DOUBLE"
)
VIDEO_ID_PATTERN = r"(^|\\|/)([\w-]+)\.mp4$"
FRAME_FILE_PATTERN = r"(\d+)\.(png|jpg|jpeg)$"
DEPTH_FILE_PATTERN = r"(.*?)(\.jpg|\.png|\.jpeg)?\.geometric\.bin"


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """CSV rows; gimbal angles come in degrees and leave in radians, times as timestamps."""
    d = spark.read.csv(path, schema=TELEMETRY_SCHEMA, header=True)
    rad = {c: F.radians(c) for c in ("gimbal_roll", "gimbal_pitch", "gimbal_yaw")}
    return d.withColumns({"ts": F.timestamp_micros("ts_us"), **rad}).drop("ts_us")


def frame_number(path: Column) -> Column:
    """Number in an image file name, NULL for other files."""
    return F.regexp_extract(path, FRAME_FILE_PATTERN, 1).try_cast("bigint")


def video_id(path: Column) -> Column:
    return F.regexp_extract(path, VIDEO_ID_PATTERN, 2)


def frame_label(frame_id: Column, ts: Column) -> Column:
    """frame-12 (08:15:30.250000)"""
    return F.format_string("frame-%d (%s)", frame_id, F.date_format(ts, "HH:mm:ss.SSSSSS"))


def scan_image_dir(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Image files of a folder with their number, both range ends exclusive."""
    d = spark.read.format("binaryFile").load(path).withColumn("frame_id", frame_number(F.col("path")))
    d = d.where("frame_id is not null")
    if first is not None:
        d = d.where(F.col("frame_id") > first)
    return d if last is None else d.where(F.col("frame_id") < last)


def sample_frames(df: DataFrame, frame: str, offset: int = 0, skip: int = 1) -> DataFrame:
    return df.where(F.pmod(F.col(frame) - offset, F.lit(skip)) == 0).where(F.col(frame) >= offset)


def repair_clock(df: DataFrame, keys: Sequence[str], frame: str, pts: str, fps: float) -> DataFrame:
    """Column ``time``: zero stamps continue at the frame rate, backward jumps are taken out."""
    good = F.when(F.col(pts) != 0, F.col(pts))
    a = Ordered(df, keys, frame, frame).prefix(last={"__base": good}, rank="__rn", keep_slice=True)
    anchored = F.when(F.col(pts) != 0, F.col("__rn"))
    b = Ordered(a, keys, frame, frame).prefix(last={"__at": anchored}, keep_slice=True)
    b = b.withColumn("__raw", F.coalesce(F.col("__base") + (F.col("__rn") - F.col("__at")) / F.lit(fps), F.col(pts)))
    c = Ordered(b, keys, frame, frame).prefix(lag={"__prev": F.col("__raw")}, keep_slice=True)
    back = F.greatest(F.lit(0.0), F.coalesce(F.col("__prev") - F.col("__raw"), F.lit(0.0)))
    d = Ordered(c.withColumn("__back", back), keys, frame, frame).prefix(total={"__off": F.col("__back")})
    return d.withColumn("time", F.col("__raw") + F.col("__off")).drop("__base", "__rn", "__at", "__raw", "__prev", "__back", "__off")


def drop_ranges(df: DataFrame, ranges: DataFrame, keys: Sequence[str], frame: str, start: str, end: str) -> DataFrame:
    """Rows outside every [start, end) range of their key.

    Ranges and rows are stacked in frame order; a row is inside when the greatest end seen so far
    lies beyond it.  Overlapping ranges need no merging and no pair is formed.
    """
    rows = df.select(*keys, F.col(frame).cast("double").alias("__o"), F.lit(1.0).alias("__t"),
                     F.lit(None).cast("double").alias("__end"), F.struct(*df.columns).alias("__row"))
    bars = ranges.select(*keys, F.col(start).cast("double").alias("__o"), F.lit(0.0).alias("__t"),
                         F.col(end).cast("double").alias("__end"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"))
    seen = Ordered(rows.unionByName(bars), keys, "__o", "__t").prefix(high={"__open": F.col("__end")})
    return seen.where("__row is not null and (__open is null or __open <= __o)").select("__row.*")


def add_gap_offsets(df: DataFrame, gaps: DataFrame, keys: Sequence[str], frame: str, time: str, offset: str) -> DataFrame:
    """Add the sum of all offsets given at or before each frame to its time."""
    rows = df.select(*keys, F.col(frame).cast("double").alias("__o"), F.lit(1.0).alias("__t"),
                     F.lit(0.0).alias("__add"), F.struct(*df.columns).alias("__row"))
    jumps = gaps.select(*keys, F.col(frame).cast("double").alias("__o"), F.lit(0.0).alias("__t"),
                        F.col(offset).cast("double").alias("__add"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"))
    run = Ordered(rows.unionByName(jumps), keys, "__o", "__t").prefix(total={"__off": F.col("__add")})
    kept = run.where("__row is not null").select("__row.*", "__off")
    return kept.withColumn(time, F.col(time) + F.col("__off")).drop("__off")


def attach_measures(frames: DataFrame, measures: DataFrame, keys: Sequence[str], frame_time: str, meas_time: str,
                    frame_id: str, measure_id: str, half_frame: float) -> DataFrame:
    """Frames with the latest measure up to half a frame ahead; a measure serves its first frame only.

    Adds ``measure_id`` and ``time_off`` = measure time - frame time, both NULL without a measure.
    """
    f = frames.withColumn("__lim", F.col(frame_time) + half_frame)
    m = measures.select(*keys, F.col(meas_time).alias("__mt"), F.col(measure_id).alias("__mid"))
    hit = asof_backward(f, m, keys, "__lim", "__mt", frame_id, ["__mid", "__mt"], keep_slice=True)
    seq = Ordered(hit, keys, "__lim", frame_id).prefix(lag={"__prev": F.col("__mid")})
    fresh = F.col("__mid").isNotNull() & ~F.col("__mid").eqNullSafe(F.col("__prev"))
    return seq.select(*frames.columns, F.when(fresh, F.col("__mid")).alias("measure_id"),
                      F.when(fresh, F.col("__mt") - F.col(frame_time)).alias("time_off"))


def centred_mean(df: DataFrame, keys: Sequence[str], order: str, tie: str, cols: Sequence[str]) -> DataFrame:
    """Three-row centred means; missing neighbours at the ends are left out."""
    o = Ordered(df, keys, order, tie).prefix(
        lag={f"__a_{c}": F.col(c) for c in cols}, lead={f"__b_{c}": F.col(c) for c in cols})
    out = {}
    for c in cols:
        trio = [F.col(f"__a_{c}"), F.col(c), F.col(f"__b_{c}")]
        n = sum((v.isNotNull().cast("int") for v in trio), F.lit(0))
        out[c] = sum((F.coalesce(v, F.lit(0.0)) for v in trio), F.lit(0.0)) / n
    return o.withColumns(out).drop(*[f"__{x}_{c}" for c in cols for x in "ab"])


def exponential_mean(df: DataFrame, keys: Sequence[str], order: str, tie: str, value: str, out: str, keep: float = 0.8) -> DataFrame:
    """Drift filter in batch form: keep * mean so far + (1 - keep) * value, starting at a key's first value that is not NULL.

    NULL values leave the mean as it is; before the first value it is NULL.
    """
    o = Ordered(df, keys, order, tie).prefix(total={"__seen": F.col(value).isNotNull().cast("bigint")}, keep_slice=True)
    first = (F.col("__seen") == 1) & F.col(value).isNotNull()
    d = affine_scan(o, keys, order, tie, F.when(first, 0.0).otherwise(keep), F.when(first, F.col(value)).otherwise((1.0 - keep) * F.col(value)), out)
    return d.withColumn(out, F.when(F.col("__seen") > 0, F.col(out))).drop("__seen")


def synthesise_frames(df: DataFrame, keys: Sequence[str], order: str, tie: str, cols: Sequence[str], n: int = 10) -> DataFrame:
    """``n`` frames per pair of consecutive rows with linearly interpolated values; only the first
    frame of a pair carries the measure."""
    o = Ordered(df, keys, order, tie).prefix(lead={f"__n_{c}": F.col(c) for c in [order, *cols]})
    e = o.where(F.col(f"__n_{order}").isNotNull()).withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    w = F.col("sub") / F.lit(float(n))
    mix = {c: F.col(c) * (1.0 - w) + F.col(f"__n_{c}") * w for c in cols}
    return e.withColumns({**mix, "has_measure": F.col("sub") == 0}).drop(*[f"__n_{c}" for c in [order, *cols]])


def interpolate_poses(a: Column, b: Column, weight: Column) -> Column:
    return P.interpolate(a, b, weight)


def cubic_at(df: DataFrame, knots: DataFrame, keys: Sequence[str], time: str, knot_time: str, value: str, tie: str) -> DataFrame:
    """Column ``interp``: cubic Hermite value of the knot series at each row's time.

    Slopes are the three-point differences of the neighbouring knots, so a row needs four knots
    around it and the series is never gathered.  Outside the knots the end segment extends.
    """
    v = Ordered(knots, keys, knot_time, knot_time)
    k = v.prefix(lag={"__t0": F.col(knot_time), "__v0": F.col(value)}, lead={"__t2": F.col(knot_time), "__v2": F.col(value)}, keep_slice=True)
    t1, v1 = F.col(knot_time), F.col(value)
    left = F.try_divide(v1 - F.col("__v0"), t1 - F.col("__t0"))
    right = F.try_divide(F.col("__v2") - v1, F.col("__t2") - t1)
    h0, h1 = t1 - F.col("__t0"), F.col("__t2") - t1
    k = k.withColumn("__m", F.coalesce((left * h1 + right * h0) / (h0 + h1), left, right, F.lit(0.0)))
    k = Ordered(k, keys, knot_time, knot_time).prefix(
        lead={"__tn": F.col(knot_time), "__vn": F.col(value), "__mn": F.col("__m")})
    # the last knot opens no segment; rows before the first knot use the first segment
    by = list(keys) or ["__one"]  # without keys, the one first segment of all
    first = k.withColumn("__one", F.lit(1)).groupBy(*by).agg(F.min_by(F.struct(knot_time, value, "__m", "__tn", "__vn", "__mn"), knot_time).alias("__f"))
    seg = k.where("__tn is not null")
    hit = asof_backward(df, seg, keys, time, knot_time, tie, [knot_time, value, "__m", "__tn", "__vn", "__mn"])
    hit = hit.join(first, list(keys), "left") if keys else hit.withColumn("__one", F.lit(1)).join(first, "__one", "left").drop("__one")
    for c in (knot_time, value, "__m", "__tn", "__vn", "__mn"):
        hit = hit.withColumn(c, F.coalesce(F.col(c), F.col(f"__f.{c}")))
    hit = hit.drop("__f")
    h = F.col("__tn") - F.col(knot_time)
    s = (F.col(time) - F.col(knot_time)) / h
    val = ((2 * s**3 - 3 * s**2 + 1) * F.col(value) + (s**3 - 2 * s**2 + s) * h * F.col("__m")
           + (-2 * s**3 + 3 * s**2) * F.col("__vn") + (s**3 - s**2) * h * F.col("__mn"))
    return hit.withColumn("interp", F.coalesce(val, F.col(value))).drop(knot_time, value, "__m", "__tn", "__vn", "__mn")
