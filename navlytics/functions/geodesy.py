"""Geodetic coordinates on the WGS84 ellipsoid and telemetry poses."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from navlytics.functions import num
from navlytics.functions import poses as P
from navlytics.functions import rotations as R
from navlytics.functions import vectors as V

# fixed values: WGS84 semi-major axis [m] and flattening
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
WGS84_E2 = WGS84_F * (2 - WGS84_F)


def to_ecef(lat, lon, alt) -> Column:
    """Degrees and metres to earth-centred x, y, z."""
    la, lo, h = F.radians(num(lat)), F.radians(num(lon)), num(alt)
    n = WGS84_A / F.sqrt(1.0 - WGS84_E2 * F.sin(la) * F.sin(la))
    return V.vec((n + h) * F.cos(la) * F.cos(lo), (n + h) * F.cos(la) * F.sin(lo), (n * (1 - WGS84_E2) + h) * F.sin(la))


def _ecef_number(lat: float, lon: float, alt: float) -> tuple[float, float, float]:
    la, lo = math.radians(lat), math.radians(lon)
    n = WGS84_A / math.sqrt(1 - WGS84_E2 * math.sin(la) ** 2)
    return (n + alt) * math.cos(la) * math.cos(lo), (n + alt) * math.cos(la) * math.sin(lo), (n * (1 - WGS84_E2) + alt) * math.sin(la)


def to_enu(lat, lon, alt, origin: tuple[float, float, float]) -> Column:
    """Local east, north, up metres around a fixed origin (lat, lon, alt)."""
    la, lo = math.radians(origin[0]), math.radians(origin[1])
    d = V.sub(to_ecef(lat, lon, alt), V.vec(*_ecef_number(*origin)))
    sl, cl, so, co = math.sin(la), math.cos(la), math.sin(lo), math.cos(lo)
    return V.vec(
        d.x * -so + d.y * co,
        d.x * (-sl * co) + d.y * (-sl * so) + d.z * cl,
        d.x * (cl * co) + d.y * (cl * so) + d.z * sl,
    )


def telemetry_pose(lat, lon, alt, yaw, pitch, roll, origin, body_to_cam: Column | None = None) -> Column:
    """Body (x north, y east, z down) or camera pose of a telemetry row; angles in radians."""
    enu = to_enu(lat, lon, alt, origin)
    body = P.pose(V.vec(enu.y, enu.x, -enu.z), R.from_ypr(yaw, pitch, roll))
    return body if body_to_cam is None else P.to_local(body, body_to_cam)
