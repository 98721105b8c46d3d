"""Random columns: correlated normals, orientations, states and sensor noise (seeded)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

from navlytics.functions import clip, num
from navlytics.functions import rotations as R
from navlytics.functions import vectors as V


def correlated_normals(mean: list[float], cov: list[list[float]], seed: int) -> list[Column]:
    """One column per component of a multivariate normal, through the Cholesky factor."""
    low = np.linalg.cholesky(np.array(cov))
    z = [F.randn(seed + i) for i in range(len(mean))]
    return [F.lit(float(m)) + sum((float(low[i, j]) * z[j] for j in range(i + 1)), F.lit(0.0)) for i, m in enumerate(mean)]


def random_rotation(angle, seed: int) -> Column:
    """Rotation by a given angle about a uniformly random axis."""
    return R.from_angle_axis(angle, V.vec(F.randn(seed), F.randn(seed + 1), F.randn(seed + 2)))


def sensor_noise(value, mean: float, sd: float, seed: int, max_val: float = 255.0) -> Column:
    return clip(num(value) + mean + sd * F.randn(seed), 0.0, max_val)


def random_distance(lo: float, hi: float, seed: int, uniform_distance: bool = True) -> Column:
    """Distance uniform in itself or in its inverse."""
    u = F.rand(seed)
    return lo + (hi - lo) * u if uniform_distance else 1.0 / (1.0 / hi + (1.0 / lo - 1.0 / hi) * u)


def random_direction(seed: int) -> Column:
    """STRUCT<lat, lon> uniform on the sphere."""
    return F.struct(F.asin(2.0 * F.rand(seed) - 1.0).alias("lat"), ((2.0 * F.rand(seed + 1) - 1.0) * math.pi).alias("lon"))
