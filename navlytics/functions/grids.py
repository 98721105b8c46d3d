"""Near-uniform direction grids, keypoint rotation, number formatting and small residuals."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from navlytics.functions import let, num
from navlytics.functions import rotations as R
from navlytics.functions import vectors as V


def lat_steps(tol: float, lat_range: tuple[float, float] = (-math.pi / 2, math.pi / 2)) -> list[float]:
    n = math.ceil((lat_range[1] - lat_range[0]) / (math.sqrt(2) * tol))
    return [lat_range[0] + (lat_range[1] - lat_range[0]) * i / n for i in range(1, n)]


def direction_grid(tol: float, lat_range: tuple[float, float] = (-math.pi / 2, math.pi / 2)) -> list[tuple[float, float]]:
    """(lat, lon) points whose spacing along each ring follows its circumference."""
    out = []
    for lat in lat_steps(tol, lat_range):
        m = math.ceil(2 * math.pi * math.cos(lat) / (math.sqrt(2) * tol))
        out += [(lat, -math.pi + 2 * math.pi * j / m) for j in range(m)]
    return out


def nearest_grid_point(a, b, tol: float) -> Column:
    """STRUCT<dist, idx, lat, lon>: grid point nearest in wrapped coordinates, first one on ties.

    The grid depends on the tolerance only, so it is a literal of the plan.
    """
    pts = direction_grid(tol)
    grid = F.arrays_zip(F.lit([p[0] for p in pts]).alias("la"), F.lit([p[1] for p in pts]).alias("lo"))

    def dist(p: Column, i: Column) -> Column:
        d = F.hypot(V.wrap_rads(p["la"] - num(a)), V.wrap_rads(p["lo"] - num(b)))
        # rounded, so that mirror-image points tie and the first wins
        return F.struct(F.round(d, 9).alias("dist"), i.alias("idx"), p["la"].alias("lat"), p["lo"].alias("lon"))

    return F.array_min(F.transform(grid, dist))


def snap_vector(v: Column, tol: float) -> Column:
    return let(V.to_spherical(v), lambda s: let(nearest_grid_point(s.lat, s.lon, tol), lambda p: V.from_spherical(p.lat, p.lon, s.r)))


def snap_orientation(q: Column, tol: float) -> Column:
    """Latitude and roll snapped to the grid, longitude set to zero."""
    return let(R.to_lat_lon_roll(q), lambda e: let(nearest_grid_point(e.lat, e.roll, tol), lambda p: R.from_lat_lon_roll(p.lat, 0.0, p.lon)))


def north_to_up(q: Column) -> Column:
    """Image rotation that turns the pole upwards."""
    return let(R.rotate(R.conj(q), V.vec(0.0, 0.0, 1.0)), lambda n: -F.atan2(n.y, n.z))


def rotate_keypoint(u, v, width: float, height: float, angle) -> Column:
    """Pixel rotated about the image centre."""
    x, y = num(u) - width / 2, num(v) - height / 2
    c, s = F.cos(num(angle)), F.sin(num(angle))
    return F.struct((c * x + s * y + width / 2).alias("x"), (c * y - s * x + height / 2).alias("y"))


def significant(x, digits: int) -> Column:
    """Value rounded to a number of significant digits."""
    x = num(x)
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def paraboloid_residual(p: Column, apex: Column, tilt: Column, curvature) -> Column:
    """Height of a point over a paraboloid standing on a tilted plane."""
    return let(R.rotate(R.conj(tilt), V.sub(p, apex)), lambda r: r.z - num(curvature) * (r.x * r.x + r.y * r.y))


def block_indices(row: Column, col: Column, rows: int, cols: int) -> Column:
    """Array of (i, j) entries of a dense block at block position (row, col)."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.transform(
        F.sequence(F.lit(0), F.lit(cols - 1)), lambda j: F.struct((row * rows + i).alias("i"), (col * cols + j).alias("j")))))


def givens(a, b) -> Column:
    """STRUCT<c, s> of the rotation that zeroes b against a."""
    a, b = num(a), num(b)
    r = F.hypot(a, b)
    return F.struct(F.when(r > 0, a / r).otherwise(1.0).alias("c"), F.when(r > 0, -b / r).otherwise(0.0).alias("s"))
