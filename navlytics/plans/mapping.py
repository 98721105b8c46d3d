"""Keyframe decisions and map maintenance over frame, landmark and observation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from navlytics.functions.camera import Camera
from navlytics.operators.quantiles import exact_quantiles

# default thresholds, overridable at every call
MAX_KEYPOINTS = 315
MIN_KP_DIST = 15.0
NEW_KF_MIN_KP_RATIO = 0.70
NEW_KF_ROT_DEG = 5.0
MIN_DISPL_FOV = 0.008
REPR_ERR_FOV = 0.0005
MAX_REPR_ERR_FOV = 0.003
REMOVAL_USAGE, REMOVAL_RATIO, RETAIN_OBS = 2, 0.15, 3
MAX_KEYFRAMES = 8


def inside_border(u: str, v: str, width: float, height: float, border: float) -> Column:
    return F.col(u).between(border, width - border) & F.col(v).between(border, height - border)


def error_limits(obs: DataFrame, frame: str, err: str, diagonal: float) -> DataFrame:
    """(frame, err_med, norm_err, max_err): field-of-view limits raised by 2x and 3x the median
    error of frames with more than one error."""
    med = exact_quantiles(obs, [frame], err, {"__m": 0.5})
    n = obs.groupBy(frame).agg(F.count(err).alias("__n"))
    d = med.join(n, frame).withColumn("err_med", F.when(F.col("__n") > 1, F.col("__m")))
    return d.select(
        frame, "err_med",
        F.greatest(F.lit(REPR_ERR_FOV * diagonal), 2.0 * F.col("err_med")).alias("norm_err"),
        F.greatest(F.lit(MAX_REPR_ERR_FOV * diagonal), 3.0 * F.col("err_med")).alias("max_err"),
    )


def classify_landmarks(obs: DataFrame, kp: str, frame: str, depth: str, ex: str, ey: str, diagonal: float,
                       parallax: str | None = None, fov_diag_rad: float = 1.0, max_dist_coef: float = 2.0, votes: Column | None = None) -> DataFrame:
    """(kp, flags, verdict) with verdict good / wait / remove.

    Flag 1: behind a camera, error over the normal limit, or too little parallax; flag 2: error over
    the hard limit.  Landmarks behind a camera get no error flag and take no part in a frame's spread,
    to which the limits adapt.  With ``votes`` only observations where it is true set error flags.
    """
    behind = obs.groupBy(kp).agg(F.coalesce(F.bool_or(F.col(depth) < 0), F.lit(False)).alias("__behind"))
    d = obs.join(behind, kp)
    sd = d.where(~F.col("__behind")).groupBy(frame).agg(((F.stddev_pop(ex) + F.stddev_pop(ey)) / 2).alias("__sd"))
    e = F.hypot(ex, ey)
    norm = F.greatest(F.lit(REPR_ERR_FOV * diagonal), 2 * F.col("__sd"))
    high = F.greatest(F.lit(MAX_REPR_ERR_FOV * diagonal), 3 * F.col("__sd"))
    errors = F.when(e > norm, 1).otherwise(0).bitwiseOR(F.when(e > high, 2).otherwise(0))
    if votes is not None:
        errors = F.when(votes, errors).otherwise(0)
    aggs = [F.bit_or(F.when(F.col("__behind"), 1).otherwise(errors)).alias("__b")]
    if parallax is not None:
        aggs.append(F.max(parallax).alias("__p"))
    g = d.join(sd, frame, "left").groupBy(kp).agg(*aggs)
    flags = F.col("__b")
    if parallax is not None:
        low = F.col("__p") / fov_diag_rad * max_dist_coef < MAX_REPR_ERR_FOV
        flags = flags.bitwiseOR(F.when((F.col("__b") == 0) & low, 1).otherwise(0))
    g = g.select(kp, flags.alias("flags"))
    return g.withColumn("verdict", F.when(F.col("flags") == 0, "good").when(F.col("flags") == 1, "wait").otherwise("remove"))


def keyframe_reason(kp_count: Column, rot_deg: Column, viewpoint_ratio: Column, triangulable_ratio: Column, active: Column,
                    max_keypoints: int = MAX_KEYPOINTS, min_inliers: int = 12, view_limit: float = 0.3, tri_limit: float = 0.3,
                    has_measure: Column | None = None) -> Column:
    """First matching reason for a new keyframe, NULL for none."""
    weak = active < 2 * min_inliers
    c = (
        F.when(kp_count / max_keypoints < NEW_KF_MIN_KP_RATIO, "few_keypoints")
        .when(rot_deg > NEW_KF_ROT_DEG, "rotation")
        .when(viewpoint_ratio > view_limit, "viewpoint")
        .when((triangulable_ratio > 0) & ((triangulable_ratio > tri_limit) | weak), "triangulation")
    )
    return c if has_measure is None else F.when(has_measure, c)


def compensated_displacement(pairs: DataFrame, cam: Camera, rel_q: str, u0: str, v0: str, u1: str, v1: str, out: str) -> DataFrame:
    """Pixel distance between a point and its reference view after rotating the reference by rel_q."""
    d = cam.rotated_pixel(pairs, F.col(rel_q), u0, v0, "__r")
    return d.withColumn(out, F.hypot(F.col("__r.x") - F.col(u1), F.col("__r.y") - F.col(v1))).drop("__r")


def best_reference(displ: DataFrame, kp: str, frame: str, value: str, limit: float) -> DataFrame:
    """Reference frame with the largest displacement of each keypoint, where it is large enough."""
    g = displ.groupBy(kp).agg(F.max_by(frame, F.struct(F.col(value), -F.col(frame))).alias("ref_frame"), F.max(value).alias(value))
    return g.where(F.col(value) > limit)


def prune_candidates(landmarks: DataFrame, obs: DataFrame, kp: str, removed_frames: DataFrame, frame: str) -> DataFrame:
    """Landmarks to drop: poor inlier ratio after enough uses, or too few surviving observations."""
    n = obs.join(removed_frames.select(frame).distinct(), frame, "left_anti").groupBy(kp).agg(F.count(F.lit(1)).alias("__n"))
    d = landmarks.join(n, kp, "left").withColumn("n_obs", F.coalesce("__n", F.lit(0)))
    poor = (F.col("total_count") >= REMOVAL_USAGE) & (F.try_divide(F.col("inlier_count"), F.col("total_count")) < REMOVAL_RATIO)
    few = F.when(F.col("active"), F.col("n_obs") < 2).otherwise(F.col("n_obs") < RETAIN_OBS)
    return d.where(poor | few).select(kp, "n_obs", F.when(poor, "ratio").otherwise("observations").alias("reason"))


def deactivate(landmarks: DataFrame, obs: DataFrame, doomed: DataFrame, kp: str, kf_lim: int) -> DataFrame:
    """Landmark table after deletion: rows with enough observations stay as inactive."""
    n = obs.groupBy(kp).agg(F.count(F.lit(1)).alias("__n"))
    d = landmarks.join(doomed.select(kp).distinct().withColumn("__del", F.lit(True)), kp, "left").join(n, kp, "left")
    gone = F.coalesce("__del", F.lit(False))
    keep = F.coalesce("__n", F.lit(0)) >= kf_lim
    return d.where(~gone | keep).withColumn("active", F.col("active") & ~gone).drop("__del", "__n")


def fifo_window(frames: DataFrame, keys: Sequence[str], frame: str, keep: int) -> DataFrame:
    """The last ``keep`` keyframes of each session (map-side limited top-k)."""
    w = W.partitionBy(*keys).orderBy(F.col(frame).desc())
    return frames.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= keep).drop("__r")


def grid_top_k(df: DataFrame, image: Sequence[str], u: str, v: str, response: str, ident: str, width: int, height: int,
               rows: int, cols: int, k: int, margin: float = 0.0) -> DataFrame:
    """Best k/(rows*cols) detections of each grid cell; cells overlap by ``margin``, and a point in an
    overlap counts (and may appear) once per cell."""
    cw, ch = width / cols, height / rows

    def span(x: Column, size: float, n: int) -> Column:
        lo = F.greatest(F.floor((x - margin) / size), F.lit(0))
        hi = F.least(F.floor((x + margin) / size), F.lit(n - 1))
        return F.sequence(lo.cast("int"), hi.cast("int"))

    d = df.withColumn("cell_row", F.explode(span(F.col(v), ch, rows))).withColumn("cell_col", F.explode(span(F.col(u), cw, cols)))
    w = W.partitionBy(*image, "cell_row", "cell_col").orderBy(F.col(response).desc(), ident)
    return d.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= max(1, k // (rows * cols))).drop("__r")


def two_grid_best(df: DataFrame, image: Sequence[str], u: str, v: str, response: str, ident: str, cell: float, n: int) -> DataFrame:
    """Union of the best per cell of a grid and of one shifted by half a cell, then the n best overall per image."""
    best = None
    for shift in (0.0, cell / 2):
        keys = [F.floor((F.col(c) + shift) / cell).alias(f"__{c}") for c in (u, v)]
        top = df.groupBy(*image, *keys).agg(F.min_by(F.struct(*df.columns), F.struct(-F.col(response), F.col(ident))).alias("__b")).select("__b.*")
        best = top if best is None else best.unionByName(top)
    w = W.partitionBy(*image).orderBy(F.col(response).desc(), ident)
    return best.distinct().withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def inlier_cells(df: DataFrame, by: Sequence[str], a: tuple[str, str], b: tuple[str, str], div: float) -> DataFrame:
    """Distinct grid cells covered on each side, the smaller of the two."""
    cells = lambda p: F.struct(F.floor(F.col(p[0]) / div), F.floor(F.col(p[1]) / div))
    sides = [df.select(*by, cells(p).alias("c")).distinct().groupBy(*by).agg(F.count("c").alias(n)) for p, n in ((a, "na"), (b, "nb"))]
    return sides[0].join(sides[1], list(by)).select(*by, F.least("na", "nb").alias("cells"))


def join_batches(obs: DataFrame, batch: str, ids: Sequence[str], sizes: DataFrame) -> DataFrame:
    """Union of batches with shifted ids.  ``sizes`` has one row per batch with a count per id space;
    offsets are running sums over the batch list."""
    w = W.orderBy(batch).rowsBetween(W.unboundedPreceding, -1)
    off = sizes.select(batch, *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"__o_{c}") for c in ids])
    return obs.join(off, batch).withColumns({c: F.col(c) + F.col(f"__o_{c}") for c in ids}).drop(*[f"__o_{c}" for c in ids])


def batch_membership(obs: DataFrame, point: str, batch: str, frozen: DataFrame | None = None) -> DataFrame:
    """(point, word, bits, batches, frozen): which batches see a point, as words of 60 bits each.

    Bit k of a word stands for batch 60 * word + k (batch numbers from 0).  ``batches`` counts all batches of the point; it is
    frozen when any of them is in the ``batch`` column of ``frozen``.
    """
    b = F.col(batch).cast("bigint")
    d = obs.select(point, b.alias(batch))
    if frozen is None:
        d = d.withColumn("__f", F.lit(False))
    else:
        d = d.join(frozen.select(b.alias(batch)).distinct().withColumn("__f", F.lit(True)), batch, "left")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col(batch) % 60).cast("int"))
    g = d.groupBy(point, F.floor(F.col(batch) / 60).alias("word")).agg(F.bit_or(one).alias("bits"), F.max(F.coalesce("__f", F.lit(False))).alias("__f"))
    w = W.partitionBy(point)
    return g.select(point, "word", "bits", F.sum(F.bit_count("bits")).over(w).cast("bigint").alias("batches"), F.max("__f").over(w).alias("frozen"))


def viewpoint_angle(point: Column, shift: Column) -> Column:
    """Angle under which a point appears moved when the camera translates by ``shift``."""
    from navlytics.functions import vectors as V

    return V.angle_between(point, V.add(point, shift))
