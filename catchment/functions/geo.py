"""Distance, projection and cell arithmetic as columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

EARTH_RADIUS_M = 6371008.8
M_PER_DEG = EARTH_RADIUS_M * math.pi / 180.0

# WGS84 ellipsoid
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
WGS84_B = WGS84_A * (1 - WGS84_F)


def mm(x: Column) -> Column:
    """Round metres to whole millimetres without leaving primitive doubles."""
    return F.floor(x * 1000.0 + 0.5) / F.lit(1000.0)


def _sq(x: Column) -> Column:
    return x * x


def _at_most_one(x: Column) -> Column:
    # not least(): that would turn a null into one
    return F.when(x > 1.0, F.lit(1.0)).otherwise(x)


def half_chord(lon1: Column, lat1: Column, lon2: Column, lat2: Column, cos1: Column | None = None, cos2: Column | None = None) -> Column:
    """sin(d / 2R): grows with great-circle distance and needs no asin; cosines of the latitudes may be given."""
    dphi = F.sin((F.radians(lat2) - F.radians(lat1)) / 2.0)
    dlam = F.sin((F.radians(lon2) - F.radians(lon1)) / 2.0)
    cos1, cos2 = F.cos(F.radians(lat1)) if cos1 is None else cos1, F.cos(F.radians(lat2)) if cos2 is None else cos2
    return F.sqrt(_sq(dphi) + cos1 * cos2 * _sq(dlam))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, cos1: Column | None = None, cos2: Column | None = None) -> Column:
    h = half_chord(lon1, lat1, lon2, lat2, cos1, cos2)
    return F.asin(_at_most_one(h)) * (2.0 * EARTH_RADIUS_M)


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(_sq(x2 - x1) + _sq(y2 - y1))


def manhattan(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.abs(x2 - x1) + F.abs(y2 - y1)


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    x = F.radians(lon) * WGS84_A
    y = F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2.0)) * WGS84_A
    return x, y


def equal_area(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Cylindrical equal-area on the sphere; areas are exact for R."""
    return F.radians(lon) * EARTH_RADIUS_M, F.sin(F.radians(lat)) * EARTH_RADIUS_M


def azimuthal(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Azimuthal equidistant around (lon0, lat0) on the sphere."""
    p, p0, dl = F.radians(lat), F.radians(lat0), F.radians(lon) - F.radians(lon0)
    c = F.asin(_at_most_one(half_chord(lon0, lat0, lon, lat))) * 2.0
    k = F.when(F.abs(c) < 1e-12, F.lit(1.0)).otherwise(c / F.sin(c))
    x = k * F.cos(p) * F.sin(dl) * EARTH_RADIUS_M
    y = k * (F.cos(p0) * F.sin(p) - F.sin(p0) * F.cos(p) * F.cos(dl)) * EARTH_RADIUS_M
    return x, y


def destination(lon: Column, lat: Column, bearing_deg: Column, dist_m) -> tuple[Column, Column]:
    """Point reached from (lon, lat) along a bearing."""
    d = F.lit(dist_m) / EARTH_RADIUS_M
    p1, b = F.radians(lat), F.radians(bearing_deg)
    p2 = F.asin(F.sin(p1) * F.cos(d) + F.cos(p1) * F.sin(d) * F.cos(b))
    l2 = F.radians(lon) + F.atan2(
        F.sin(b) * F.sin(d) * F.cos(p1), F.cos(d) - F.sin(p1) * F.sin(p2)
    )
    return F.degrees(l2), F.degrees(p2)


class Haversine:
    """Great-circle metric, searched as straight chords between points on the sphere.

    A chord grows with the great-circle distance, and boxes around points in
    space have no trouble with poles or the date line.
    """

    name = "haversine"

    @staticmethod
    def embed(x: Column, y: Column) -> list[Column]:
        c = F.cos(F.radians(y)) * EARTH_RADIUS_M
        return [c * F.cos(F.radians(x)), c * F.sin(F.radians(x)), F.sin(F.radians(y)) * EARTH_RADIUS_M]

    @staticmethod
    def reach(m: float) -> float:
        return 2 * EARTH_RADIUS_M * math.sin(min(math.pi / 2, m / (2 * EARTH_RADIUS_M)))

    @staticmethod
    def between(p: list[Column], q: list[Column]) -> Column:
        half = F.sqrt(sum((_sq(a - b) for a, b in zip(p, q)), F.lit(0.0))) / (2.0 * EARTH_RADIUS_M)
        return mm(F.asin(_at_most_one(half)) * (2.0 * EARTH_RADIUS_M))

    @staticmethod
    def order(p: list[Column], q: list[Column]) -> Column:
        """Grows with the distance between embedded points; of the same kind in every metric, cheap to compare."""
        return sum((_sq(a - b) for a, b in zip(p, q)), F.lit(0.0))

    @staticmethod
    def dist(x1, y1, x2, y2) -> Column:
        return mm(haversine_m(x1, y1, x2, y2))


class Planar:
    """Straight-line metric on projected metres."""

    name = "euclidean"

    @staticmethod
    def embed(x: Column, y: Column) -> list[Column]:
        return [x, y]

    @staticmethod
    def reach(m: float) -> float:
        return m

    @staticmethod
    def between(p: list[Column], q: list[Column]) -> Column:
        return mm(F.sqrt(sum((_sq(a - b) for a, b in zip(p, q)), F.lit(0.0))))

    @staticmethod
    def order(p: list[Column], q: list[Column]) -> Column:
        return sum((_sq(a - b) for a, b in zip(p, q)), F.lit(0.0))

    @classmethod
    def dist(cls, x1, y1, x2, y2) -> Column:
        return cls.between([x1, y1], [x2, y2])


class Manhattan(Planar):
    """City-block metric on projected metres; searched on axes turned by 45 degrees.

    |dx| + |dy| is the larger of |du| and |dv| for u = x + y, v = x - y, so the
    straight distance in (u, v) is between one and sqrt(2) times the metric.
    """

    name = "manhattan"
    stretch = math.sqrt(2.0)

    @staticmethod
    def embed(x: Column, y: Column) -> list[Column]:
        return [x + y, x - y]

    @staticmethod
    def reach(m: float) -> float:
        return m * math.sqrt(2.0)

    @staticmethod
    def between(p: list[Column], q: list[Column]) -> Column:
        return mm(F.greatest(F.abs(p[0] - q[0]), F.abs(p[1] - q[1])))

    @staticmethod
    def order(p: list[Column], q: list[Column]) -> Column:
        return F.greatest(F.abs(p[0] - q[0]), F.abs(p[1] - q[1]))


Haversine.stretch = Planar.stretch = 1.0
METRICS = {m.name: m for m in (Haversine, Planar, Manhattan)}


# --- ellipsoid -------------------------------------------------------------


def vincenty_inverse(lon1, lat1, lon2, lat2, max_iter: int = 60):
    """WGS84 inverse distance on NumPy arrays; NaN where it does not converge."""
    u1 = np.arctan((1 - WGS84_F) * np.tan(np.radians(lat1)))
    u2 = np.arctan((1 - WGS84_F) * np.tan(np.radians(lat2)))
    big_l = np.radians(lon2 - lon1)
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = big_l.copy()
    done = np.zeros(lam.shape, dtype=bool)
    sin_s = cos_s = sigma = cos2a = cos2m = np.zeros_like(lam)
    for _ in range(max_iter):
        sl, cl = np.sin(lam), np.cos(lam)
        sin_s = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
        cos_s = s1 * s2 + c1 * c2 * cl
        sigma = np.arctan2(sin_s, cos_s)
        with np.errstate(divide="ignore", invalid="ignore"):
            sin_a = np.where(sin_s == 0, 0.0, c1 * c2 * sl / sin_s)
            cos2a = 1 - sin_a**2
            cos2m = np.where(cos2a == 0, 0.0, cos_s - 2 * s1 * s2 / cos2a)
        c = WGS84_F / 16 * cos2a * (4 + WGS84_F * (4 - 3 * cos2a))
        new = big_l + (1 - c) * WGS84_F * sin_a * (
            sigma + c * sin_s * (cos2m + c * cos_s * (-1 + 2 * cos2m**2))
        )
        done = np.abs(new - lam) < 1e-12
        lam = new
        if done.all():
            break
    us = cos2a * (WGS84_A**2 - WGS84_B**2) / WGS84_B**2
    a = 1 + us / 16384 * (4096 + us * (-768 + us * (320 - 175 * us)))
    b = us / 1024 * (256 + us * (-128 + us * (74 - 47 * us)))
    ds = b * sin_s * (
        cos2m
        + b / 4 * (
            cos_s * (-1 + 2 * cos2m**2)
            - b / 6 * cos2m * (-3 + 4 * sin_s**2) * (-3 + 4 * cos2m**2)
        )
    )
    return np.where(done, WGS84_B * a * (sigma - ds), np.nan)


def _inverse(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    args = [s.to_numpy(dtype=float) for s in (lon1, lat1, lon2, lat2)]
    return pd.Series(vincenty_inverse(*args))


_vincenty = F.pandas_udf(_inverse, DoubleType())
# for a column of its own: filters on what follows from it do not compute it a second time
ellipsoid_once = F.pandas_udf(_inverse, DoubleType()).asNondeterministic()


def geodesic_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, v: Column | None = None) -> Column:
    """Ellipsoid distance in Arrow batches (or as given); great circle where it does not converge."""
    v = _vincenty(lon1, lat1, lon2, lat2) if v is None else v
    return F.coalesce(F.when(F.isnan(v), None).otherwise(v), haversine_m(lon1, lat1, lon2, lat2))
