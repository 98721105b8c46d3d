"""Pixel tables (image keys, row, col, value): neighbourhoods, resampling and lookups.

Box sums use the fact that a box is a product of two ranges: a pixel is sent to the k rows above and
below, summed, then to the k columns, so a k x k window costs 2k rows per pixel instead of k*k, all
by grouped sums that combine map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from navlytics.operators.nearest import block_best
from navlytics.operators.quantiles import with_group_values


def _spread(df: DataFrame, keys: list[str], axis: str, half: int, size: int, sums: list[str], mirror: bool) -> DataFrame:
    """Sum columns over an axis window; outside positions mirror about the edge pixel."""
    at = F.col(axis)
    if not mirror:
        hits = F.sequence(F.greatest(at - half, F.lit(0)), F.least(at + half, F.lit(size - 1)))
    else:
        # targets whose window, after mirroring, covers this pixel (once per covering position)
        def reach(pos: Column) -> Column:
            lo, hi = F.greatest(pos - half, F.lit(0)), F.least(pos + half, F.lit(size - 1))
            return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

        hits = F.concat(reach(at), F.when(at > 0, reach(-at)).otherwise(F.array().cast("array<int>")),
                        F.when(at < size - 1, reach(2 * (size - 1) - at)).otherwise(F.array().cast("array<int>")))
    d = df.withColumn(axis, F.explode(hits))
    return d.groupBy(*keys, "row", "col").agg(*[F.sum(c).alias(c) for c in sums])


def box_sums(df: DataFrame, image: Sequence[str], value: str, k: int, rows: int, cols: int, mirror: bool = False) -> DataFrame:
    """(image, row, col, s, n): sum and count of the non-null values in the k x k box."""
    keys = list(image)
    d = df.select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"),
                  F.coalesce(F.col(value), F.lit(0.0)).alias("s"), F.col(value).isNotNull().cast("bigint").alias("n"))
    d = _spread(d, keys, "row", k // 2, rows, ["s", "n"], mirror)
    return _spread(d, keys, "col", k // 2, cols, ["s", "n"], mirror)


def nan_blur(df: DataFrame, image: Sequence[str], value: str, k: int, rows: int, cols: int, min_share: float, only_nulls: bool = True,
             mirror: bool = False) -> DataFrame:
    """Box mean of present values where their share exceeds ``min_share``; optionally only fills gaps."""
    b = box_sums(df, image, value, k, rows, cols, mirror)
    mean = F.when(F.col("n") > min_share * k * k, F.col("s") / F.col("n"))
    d = df.join(b, [*image, "row", "col"])
    return d.withColumn(value, F.coalesce(F.col(value), mean) if only_nulls else mean).drop("s", "n")


def outliers(df: DataFrame, image: Sequence[str], value: str, rows: int, cols: int, k_bg: int = 15, k_nan: int = 7, lim: float = 1.0,
             lim_nan: float = 0.2, max_nan: float = 0.7, both: bool = True) -> DataFrame:
    """Adds ``outlier``: far from the local mean and/or in a sparse spot, or in a very sparse one."""
    bg = box_sums(df, image, value, k_bg, rows, cols).select(*image, "row", "col", (F.col("s") / F.nullif("n", F.lit(0))).alias("__m"))
    gap = box_sums(df, image, value, k_nan, rows, cols).select(*image, "row", "col", (1.0 - F.col("n") / float(k_nan * k_nan)).alias("__g"))
    d = df.join(bg, [*image, "row", "col"]).join(gap, [*image, "row", "col"])
    far = F.abs(F.col(value) - F.col("__m")) > lim
    sparse = F.col("__g") > lim_nan
    bad = ((far & sparse) if both else (far | sparse)) | (F.col("__g") > max_nan)
    return d.withColumn("outlier", F.col(value).isNull() | F.coalesce(bad, F.lit(False))).drop("__m", "__g")


def clear_borders(value: str, margin: int, rows: int, cols: int) -> Column:
    inside = F.col("row").between(margin, rows - 1 - margin) & F.col("col").between(margin, cols - 1 - margin)
    return F.when(inside, F.col(value))


def convolve(df: DataFrame, image: Sequence[str], value: str, kernel: list[list[float]]) -> DataFrame:
    """Sum of kernel weight x neighbour value (zero outside), one shuffle."""
    h = len(kernel) // 2
    taps = F.array(*[F.struct(F.lit(i - h).alias("dr"), F.lit(j - h).alias("dc"), F.lit(float(w)).alias("w"))
                     for i, r in enumerate(kernel) for j, w in enumerate(r) if w != 0])
    d = df.select(*image, "row", "col", value, F.explode(taps).alias("t"))
    d = d.groupBy(*image, (F.col("row") - F.col("t.dr")).alias("row"), (F.col("col") - F.col("t.dc")).alias("col")).agg(
        F.sum(F.col(value) * F.col("t.w")).alias("conv"))
    return df.select(*image, "row", "col").join(d, [*image, "row", "col"])


def gaussian_kernel(size: int, sigma: float) -> list[list[float]]:
    import math

    ax = [i - (size - 1) / 2 for i in range(size)]
    k = [[math.exp(-(x * x + y * y) / (2 * sigma * sigma)) for x in ax] for y in ax]
    total = sum(map(sum, k))
    return [[v / total for v in r] for r in k]


def bilinear(points: DataFrame, pixels: DataFrame, image: Sequence[str], x: str, y: str, value: str, background: float | None = None) -> DataFrame:
    """Adds ``interp``: bilinear mean of the present (foreground) neighbours, NULL when there is none."""
    taps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    fx, fy = F.col(x) - F.floor(x), F.col(y) - F.floor(y)
    p = points.withColumn("__id", F.xxhash64(*image, x, y)).withColumn("__t", F.explode(taps))
    w = F.when(F.col("__t.i") == 1, fy).otherwise(1 - fy) * F.when(F.col("__t.j") == 1, fx).otherwise(1 - fx)
    p = p.select(*image, x, y, w.alias("__w"), (F.floor(y) + F.col("__t.i")).cast("int").alias("row"), (F.floor(x) + F.col("__t.j")).cast("int").alias("col"))
    good = pixels.where(F.col(value).isNotNull())
    if background is not None:
        good = good.where(F.col(value) < background * 0.999)
    j = p.distinct().join(good.select(*image, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), value), [*image, "row", "col"])
    g = j.groupBy(*image, x, y).agg((F.sum(F.col("__w") * F.col(value)) / F.nullif(F.sum("__w"), F.lit(0.0))).alias("interp"))
    return points.join(g, [*image, x, y], "left")


def downsample(df: DataFrame, image: Sequence[str], value: str, factor: int) -> DataFrame:
    return df.groupBy(*image, F.floor(F.col("row") / factor).alias("row"), F.floor(F.col("col") / factor).alias("col")).agg(F.avg(value).alias(value))


def object_bounds(df: DataFrame, image: Sequence[str], value: str, threshold: float, margin: int, rows: int, cols: int, min_px: int = 1) -> DataFrame:
    """Bounding box of bright pixels that keep a full 3x3 bright neighbourhood, widened by a margin."""
    bright = df.withColumn("__b", F.when(F.col(value) > threshold, 1.0).otherwise(0.0))
    core = box_sums(bright, image, "__b", 3, rows, cols).where("s = n")
    g = core.groupBy(*image).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") >= min_px).select(
        *image, F.greatest(F.col("r0") - margin, F.lit(0)).alias("r0"), F.least(F.col("r1") + margin, F.lit(rows - 1)).alias("r1"),
        F.greatest(F.col("c0") - margin, F.lit(0)).alias("c0"), F.least(F.col("c1") + margin, F.lit(cols - 1)).alias("c1"))


def ground_resolution(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mean absolute neighbour difference along rows (y) and columns (x) of a regular grid."""
    nxt = df.select((F.col("row") - 1).alias("row"), "col", F.col(y).alias("__y"))
    right = df.select("row", (F.col("col") - 1).alias("col"), F.col(x).alias("__x"))
    a = df.join(nxt, ["row", "col"]).agg(F.avg(F.abs(F.col("__y") - F.col(y))).alias("res_y"))
    b = df.join(right, ["row", "col"]).agg(F.avg(F.abs(F.col("__x") - F.col(x))).alias("res_x"))
    return with_group_values(a, b, [])


def bilinear_or_nearest(points: DataFrame, pixels: DataFrame, image: Sequence[str], x: str, y: str, value: str, ident: str, max_dist: float,
                        background: float | None = None) -> DataFrame:
    """Bilinear value; where all four neighbours are missing, the nearest present pixel of the image
    within ``max_dist``.  ``ident`` is a unique id of the points; ties go to the first pixel in row order."""
    good = pixels.where(F.col(value).isNotNull())
    if background is not None:
        good = good.where(F.col(value) < background * 0.999)
    b = bilinear(points, pixels, image, x, y, value, background)
    lost = b.where("interp is null").select(*image, ident, F.col(x).alias("__x"), F.col(y).alias("__y"))
    order = F.shiftleft(F.col("row").cast("bigint"), 32) + F.col("col")  # row order for columns below 2^32
    hay = good.select(*image, order.alias("__px"), F.col("row").cast("double").alias("__r"), F.col("col").cast("double").alias("__c"), value)

    def score(p: pd.DataFrame, q: pd.DataFrame) -> np.ndarray:
        d = np.hypot(p["__x"].to_numpy()[:, None] - q["__c"].to_numpy()[None], p["__y"].to_numpy()[:, None] - q["__r"].to_numpy()[None])
        return np.where(d <= max_dist, d, np.inf)

    near = block_best(lost, hay.drop(value), ident, "__px", score, 1, list(image)).select(*image, ident, F.col("hay_id").alias("__px"))
    near = near.join(hay.select(*image, "__px", F.col(value).alias("__near")), [*image, "__px"]).select(ident, "__near")
    return b.join(near, ident, "left").withColumn("interp", F.coalesce("interp", "__near")).drop("__near")


# ---- per-pixel value functions ----------------------------------------------------------------

def adjust_gamma(v: Column, gamma: float, max_val: float = 255.0, gamma_break: float = 0.0, linear: float = 0.0, inverse: bool = False) -> Column:
    """Gamma curve, optionally with a linear toe below ``gamma_break``."""
    n = v / max_val
    g = gamma if inverse else 1.0 / gamma
    out = F.pow(n, F.lit(g))
    if gamma_break > 0:
        toe = n * linear if not inverse else n / linear
        out = F.when(n < gamma_break, toe).otherwise(out)
    return F.round(out * max_val)


def change_depth(v: Column, src_bits: int, dst_bits: int) -> Column:
    return v * ((2**dst_bits - 1) / (2**src_bits - 1))


def remove_background(v: Column, bg: Column, gain: float = 1.0, offset: float = 0.0, max_val: float = 255.0) -> Column:
    return F.greatest(F.least(v - bg * gain + offset, F.lit(max_val)), F.lit(0.0))


def colour_correct(b: Column, g: Column, r: Column, mx: list[list[float]], max_val: float = 255.0) -> list[Column]:
    return [F.greatest(F.least(b * m[0] + g * m[1] + r * m[2], F.lit(max_val)), F.lit(0.0)) for m in mx]


def stretch(v: Column, lo: Column, hi: Column, gamma: float, max_val: float = 255.0) -> Column:
    n = F.greatest(F.least((v - lo) / (hi - lo), F.lit(1.0)), F.lit(0.0))
    return F.pow(n, F.lit(1.0 / gamma)) * max_val


def box_extremes(df: DataFrame, image: Sequence[str], value: str, k: int, rows: int, cols: int) -> DataFrame:
    """(image, row, col, lo, hi): extremes of the k x k box, rows first and columns second."""
    half = k // 2
    d = df.select(*image, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).alias("lo"), F.col(value).alias("hi"))
    for axis, size in (("row", rows), ("col", cols)):
        at = F.col(axis)
        d = d.withColumn(axis, F.explode(F.sequence(F.greatest(at - half, F.lit(0)), F.least(at + half, F.lit(size - 1)))))
        d = d.groupBy(*image, "row", "col").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return d


def bright_enough(points: DataFrame, df: DataFrame, image: Sequence[str], value: str, k: int, rows: int, cols: int, lo: float, hi: float) -> DataFrame:
    """Points (image, row, col) whose surrounding box reaches ``hi`` at its brightest and stays over ``lo``."""
    b = box_extremes(df, image, value, k, rows, cols).where((F.col("lo") >= lo) & (F.col("hi") >= hi))
    return points.join(b.select(*image, "row", "col"), [*image, "row", "col"], "left_semi")
