"""Reconstruction datasets: sensors, records, trajectories, keypoints, points and observations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from navlytics.functions.camera import padded_distortion
from navlytics.operators.ordered import Ordered, dense_ids

TABLES = ("sensors", "records_camera", "trajectories", "keypoints", "descriptors", "points3d", "observations")
MIN_OBS, MIN_RATIO = 3, 0.2


def write_dataset(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """One Parquet folder per table; a batch_id column becomes a partition column."""
    for name, df in tables.items():
        w = df.write.mode(mode)
        (w.partitionBy("batch_id") if "batch_id" in df.columns else w).parquet(f"{path}/{name}")


def read_dataset(spark: SparkSession, path: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def good_landmark(min_obs: int = MIN_OBS, min_ratio: float = MIN_RATIO) -> Column:
    return ~F.col("bad_qlt") & (F.col("inlier_count") > min_obs) & (F.try_divide(F.col("inlier_count"), F.col("total_count")) > min_ratio)


def export_points(landmarks: DataFrame, min_obs: int = MIN_OBS, min_ratio: float = MIN_RATIO) -> DataFrame:
    """(pt3d_id, kp_id, x, y, z, r, g, b): good landmarks numbered in id order, grey."""
    d = dense_ids(landmarks.where(good_landmark(min_obs, min_ratio)), "kp_id", "pt3d_id")
    return d.select("pt3d_id", "kp_id", "x", "y", "z", *[F.lit(128).alias(c) for c in "rgb"])


def export_observations(obs: DataFrame, points: DataFrame, frames: DataFrame, scale: float = 1.0) -> DataFrame:
    """(frame_id, img_file, pt3d_id, feat_id, u, v) for frames with a pose; features numbered per frame."""
    d = obs.join(points.select("kp_id", "pt3d_id"), "kp_id").join(frames.where("has_pose").select("frame_id", "img_sc"), "frame_id")
    d = Ordered(d, ["frame_id"], "kp_id", "kp_id").prefix(rank="__r")
    return d.select("frame_id", F.format_string("cam/frame%06d.png", F.col("frame_id")).alias("img_file"), "pt3d_id",
                    (F.col("__r") - 1).alias("feat_id"), (F.col("u") / F.col("img_sc") * scale).alias("u"), (F.col("v") / F.col("img_sc") * scale).alias("v"))


def camera_row(sensor: DataFrame, scale: float = 1.0) -> DataFrame:
    """Scaled intrinsics with eight distortion slots."""
    out = {c: F.col(c) * scale for c in ("fx", "fy", "cx", "cy")} | {c: (F.col(c) * scale).cast("int") for c in ("width", "height")}
    return sensor.withColumns({**out, "dist": padded_distortion(F.col("dist"))})


def update_points(points: DataFrame, new: DataFrame) -> DataFrame:
    n = new.select("pt3d_id", *[F.col(c).alias(f"__{c}") for c in "xyz"])
    return points.join(n, "pt3d_id", "left").withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in "xyz"}).drop("__x", "__y", "__z")


def load_problem(observations: DataFrame, records: DataFrame, keypoints: DataFrame, trajectories: DataFrame) -> DataFrame:
    """Observation rows with pixel and pose, and consecutive pose numbers in frame order."""
    d = observations.join(records, "img_file").join(keypoints, ["img_file", "feat_id"]).join(trajectories, "frame_id")
    ids = dense_ids(d.select("frame_id").distinct(), "frame_id", "pose_idx")
    return d.join(ids, "frame_id")


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
                            T.StructField("channels", T.IntegerType()), T.StructField("data", T.ArrayType(T.FloatType()))]))
def decode_array(content: pd.Series) -> pd.DataFrame:
    """Depth array files: a ``width&height&channels&`` header, then column-major float32."""
    out = []
    for blob in content:
        raw = bytes(blob)
        head, pos = [], 0
        while len(head) < 3:
            end = raw.index(b"&", pos)
            head.append(int(raw[pos:end]))
            pos = end + 1
        w, h, c = head
        a = np.frombuffer(raw, "<f4", w * h * c, pos).reshape((w, h, c), order="F")
        out.append((w, h, c, np.transpose(a, (1, 0, 2)).ravel()))
    return pd.DataFrame(out, columns=["width", "height", "channels", "data"])


@F.pandas_udf(T.BinaryType())
def encode_array(width: pd.Series, height: pd.Series, data: pd.Series) -> pd.Series:
    """Inverse of decode_array for one channel, row-major values in."""
    return pd.Series([
        f"{w}&{h}&1&".encode() + np.asarray(d, dtype="<f4").reshape(h, w).T.ravel(order="F").tobytes()
        for w, h, d in zip(width, height, data)])


def pixels(df: DataFrame, keys: list[str], content: str) -> DataFrame:
    """(keys, row, col, depth): one row per pixel, zero and NaN depths as NULL."""
    d = df.select(*keys, decode_array(content).alias("a")).select(*keys, F.col("a.width").alias("w"), F.posexplode("a.data").alias("i", "d"))
    val = F.col("d").cast("double")
    return d.select(*keys, F.floor(F.col("i") / F.col("w")).cast("int").alias("row"), (F.col("i") % F.col("w")).alias("col"),
                    F.when(~F.isnan(val) & (val != 0), val).alias("depth"))
