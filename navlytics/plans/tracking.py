"""Track statistics, run summaries and calibration reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from navlytics.operators.ordered import Ordered
from navlytics.operators.quantiles import exact_quantiles, trimmed, with_group_values

# quantiles of the report: one standard deviation around the median, and its upper tail
LENGTH_QUANTILES = {"len_p15_9": 0.159, "len_p50": 0.5, "len_p84_1": 0.841}
ERROR_QUANTILES = {"err_p50": 0.5, "err_p84_1": 0.841, "err_p97_7": 0.977}


def finished_observations(obs: DataFrame, kp: str, frame: str) -> DataFrame:
    """Observations of landmarks that are not in the last keyframe (those tracks still grow)."""
    last = obs.agg(F.max(frame).alias("f")).first()["f"]
    return obs.join(obs.where(F.col(frame) == last).select(kp).distinct(), kp, "left_anti")


def track_lengths(obs: DataFrame, kp: str) -> DataFrame:
    return obs.groupBy(kp).agg(F.count(F.lit(1)).alias("track_len"))


def length_histogram(lengths: DataFrame, cap: int = 5) -> DataFrame:
    """Counts and percent share of track lengths 1..cap, longer ones pooled at cap."""
    h = lengths.groupBy(F.least(F.col("track_len"), F.lit(cap)).alias("len_bin")).agg(F.count(F.lit(1)).alias("n"))
    return with_group_values(h, h.agg(F.sum("n").alias("total")), []).select(
        "len_bin", "n", (100.0 * F.col("n") / F.col("total")).alias("pct"))


def success_rate(landmarks: DataFrame, has_3d: Column) -> DataFrame:
    return landmarks.agg(F.avg(has_3d.cast("double")).alias("succ_rate"), F.count_if(has_3d).alias("n_3d"), F.count(F.lit(1)).alias("n_all"))


def step_lengths(df: DataFrame, keys: Sequence[str], order: str, tie: str, coords: Sequence[str]) -> DataFrame:
    """Distance to the previous row of the same key."""
    o = Ordered(df, keys, order, tie).prefix(lag={f"__p_{c}": F.col(c) for c in coords})
    sq = sum(((F.col(c) - F.col(f"__p_{c}")) ** 2 for c in coords), F.lit(0.0))
    return o.withColumn("step", F.sqrt(sq)).drop(*[f"__p_{c}" for c in coords])


def mean_below_quantile(df: DataFrame, by: Sequence[str], value: str, q: float) -> DataFrame:
    lim = exact_quantiles(df, by, value, {"__q": q})
    return with_group_values(df, lim, by).where(F.col(value) < F.col("__q")).groupBy(*by).agg(F.avg(value).alias("dispersion"))


def binned_mean(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Mean of y in equal-width bins of x between its extremes; the top edge belongs to the last bin."""
    lim = df.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    d = with_group_values(df, lim, [])
    b = F.least(F.floor((F.col(x) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins), F.lit(bins - 1))
    return d.groupBy(b.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"))


def kernel_smooth(df: DataFrame, x: str, y: str, targets: Sequence[float], weight) -> DataFrame:
    """Kernel-weighted mean of y at given positions; ``weight`` maps a distance column to a weight.

    The target list is a literal of the call, so every row adds to that many map-side sums and
    nothing else moves.
    """
    pts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(v)).alias("xt")) for i, v in enumerate(targets)])
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y, F.explode(pts).alias("t"))
    w = weight(F.abs(F.col("t.xt") - F.col(x)))
    return d.groupBy(F.col("t.i").cast("bigint").alias("i"), F.col("t.xt").alias("xt")).agg((F.sum(w * F.col(y)) / F.sum(w)).alias("smooth"))


def trimmed_summary(df: DataFrame, by: Sequence[str], value: str, pct: float) -> DataFrame:
    return trimmed(df, by, value, pct).groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def direction_quality(dx: Column, dy: Column) -> Mapping[str, Column]:
    """Aggregate: spread of displacement lengths and directions, 0 is uniform."""
    d, a = F.hypot(dx, dy), F.atan2(dy, dx)
    return {"quality": 0.5 * F.stddev_pop(d) / F.avg(d) + 0.5 * F.stddev_pop(a) / F.lit(3.141592653589793)}
