"""Geodesy and the camera: numpy cores, Arrow-backed column functions, and plain column expressions."""

from __future__ import annotations

import math
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewake import config as C

_B = C.WGS84_A * (1 - C.WGS84_F)


@dataclass(frozen=True)
class Camera:
    lon: float
    lat: float
    bearing: float
    tilt: float
    height: float
    fov_h: float
    fov_v: float
    fx: float
    fy: float
    u0: float
    v0: float

    def __iter__(self):
        return iter(astuple(self))


#: The sample camera used by the test queries.
SAMPLE_CAMERA = Camera(121.5, 29.87, 90.0, 5.0, 20.0, 55.0, 35.0, 1500.0, 1500.0, 960.0, 540.0)


def _delta_sigma(big_b, sin_s, cos_s, cos_2m):
    inner = cos_s * (2 * cos_2m**2 - 1) - big_b / 6 * cos_2m * (4 * sin_s**2 - 3) * (4 * cos_2m**2 - 3)
    return big_b * sin_s * (cos_2m + big_b / 4 * inner)


def _a_b(cos2_alpha):
    u2 = cos2_alpha * (C.WGS84_A**2 - _B**2) / _B**2
    return 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2))), u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))


def distance_m(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Metres between points on the ellipsoid; rows stop on their own, 0 where points coincide."""
    lat1, lon1, lat2, lon2 = (np.radians(np.asarray(x, float)) for x in np.broadcast_arrays(lat1, lon1, lat2, lon2))
    u1, u2 = np.arctan((1 - C.WGS84_F) * np.tan(lat1)), np.arctan((1 - C.WGS84_F) * np.tan(lat2))
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    gap = lon2 - lon1
    lam, out, live = gap.copy(), np.zeros_like(gap), np.isfinite(gap + lat1 + lat2)
    out[~live] = np.nan
    sigma, sin_s, cos_s, cos2a, cos2m = (np.zeros_like(gap) for _ in range(5))
    same = np.zeros(gap.shape, bool)
    for _ in range(C.VINCENTY_ROUNDS):
        if not live.any():
            break
        sl, cl = np.sin(lam), np.cos(lam)
        ss = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
        same |= live & (ss < C.VINCENTY_EPS)
        live &= ~same
        cs = su1 * su2 + cu1 * cu2 * cl
        sa = np.divide(cu1 * cu2 * sl, ss, out=np.zeros_like(ss), where=ss != 0)
        c2a = 1 - sa**2
        c2m = np.where(c2a < C.VINCENTY_EPS, 0.0, cs - 2 * su1 * su2 / np.where(c2a < C.VINCENTY_EPS, 1.0, c2a))
        s = np.arctan2(ss, cs)
        c = C.WGS84_F / 16 * c2a * (4 + C.WGS84_F * (4 - 3 * c2a))
        new = gap + (1 - c) * C.WGS84_F * sa * (s + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
        for store, value in ((sigma, s), (sin_s, ss), (cos_s, cs), (cos2a, c2a), (cos2m, c2m)):
            store[live] = value[live]
        moved = np.abs(new - lam)
        lam = np.where(live, new, lam)
        live &= moved >= C.VINCENTY_EPS
    big_a, big_b = _a_b(cos2a)
    length = _B * big_a * (sigma - _delta_sigma(big_b, sin_s, cos_s, cos2m))
    return np.where(same, 0.0, np.where(np.isnan(out), np.nan, length))


def destination(lat, lon, bearing, metres) -> tuple[np.ndarray, np.ndarray]:
    """(lat, lon) reached on the ellipsoid; longitudes wrap to [-180, 180)."""
    lat, lon, bearing, metres = (np.asarray(x, float) for x in np.broadcast_arrays(lat, lon, bearing, metres))
    phi, alpha = np.radians(lat), np.radians(bearing)
    tan_u = (1 - C.WGS84_F) * np.tan(phi)
    cu = 1 / np.sqrt(1 + tan_u**2)
    su = tan_u * cu
    sigma1 = np.arctan2(tan_u, np.cos(alpha))
    sa = cu * np.sin(alpha)
    c2a = 1 - sa**2
    big_a, big_b = _a_b(c2a)
    base = metres / (_B * big_a)
    sigma = base.copy()
    for _ in range(C.VINCENTY_ROUNDS):
        c2m = np.cos(2 * sigma1 + sigma)
        new = base + _delta_sigma(big_b, np.sin(sigma), np.cos(sigma), c2m)
        moved = np.abs(new - sigma)
        sigma = new
        if not (moved >= C.VINCENTY_EPS).any():
            break
    ss, cs, c2m = np.sin(sigma), np.cos(sigma), np.cos(2 * sigma1 + sigma)
    lat2 = np.arctan2(su * cs + cu * ss * np.cos(alpha), (1 - C.WGS84_F) * np.hypot(sa, su * ss - cu * cs * np.cos(alpha)))
    lam = np.arctan2(ss * np.sin(alpha), cu * cs - su * ss * np.cos(alpha))
    c = C.WGS84_F / 16 * c2a * (4 + C.WGS84_F * (4 - 3 * c2a))
    turn = lam - (1 - c) * C.WGS84_F * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
    return np.degrees(lat2), (lon + np.degrees(turn) + 540) % 360 - 180


def bearing_deg(lat1, lon1, lat2, lon2) -> np.ndarray:
    lat1, lon1, lat2, lon2 = (np.radians(x) for x in (lat1, lon1, lat2, lon2))
    y = np.sin(lon2 - lon1) * np.cos(lat2)
    x = np.cos(lat1) * np.sin(lat2) - np.sin(lat1) * np.cos(lat2) * np.cos(lon2 - lon1)
    return (np.degrees(np.arctan2(y, x)) + 360) % 360


def classify(camera: Camera, distance, bearing) -> np.ndarray:
    """0 outside the vertical field of view, 1 to be projected, 2 gone sideways."""
    below = 90 + camera.tilt - camera.fov_v / 2 >= np.degrees(np.arctan(np.asarray(distance) / camera.height))
    off = np.abs(camera.bearing - bearing)
    off = np.where(off < 180, off, 360 - off)
    return np.where(below, 0, np.where(off <= camera.fov_h / 2 + C.FOV_MARGIN_DEG, 1, 2))


def project(camera: Camera, distance, bearing) -> tuple[np.ndarray, np.ndarray]:
    """Pixel (x, y), truncated toward zero, of a point on the water at a distance and bearing."""
    off = np.asarray(bearing - camera.bearing, float)
    off = np.where(off > 180, off - 360, np.where(off < -180, off + 360, off))
    tilt = np.radians(-camera.tilt)
    forward, right = distance * np.cos(np.radians(off)), distance * np.sin(np.radians(off))
    rest = camera.height - forward * np.tan(tilt)
    z = forward / np.cos(tilt) + rest * np.sin(tilt)
    y = rest * np.cos(tilt)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.trunc(camera.fx * right / z + camera.u0), np.trunc(camera.fy * y / z + camera.v0)


# --- single points, for state machines that step one vessel at a time -----------------------------


def _shift(big_b: float, ss: float, cs: float, c2m: float) -> float:
    return big_b * ss * (c2m + big_b / 4 * (cs * (2 * c2m**2 - 1) - big_b / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))


def destination_point(lat: float, lon: float, bearing: float, metres: float) -> tuple[float, float]:
    """destination() of one point."""
    alpha, tan_u = math.radians(bearing), (1 - C.WGS84_F) * math.tan(math.radians(lat))
    cu = 1 / math.sqrt(1 + tan_u**2)
    su, ca = tan_u * cu, math.cos(alpha)
    sigma1, sa = math.atan2(tan_u, ca), cu * math.sin(alpha)
    c2a = 1 - sa**2
    big_a, big_b = _a_b(c2a)
    sigma = base = metres / (_B * big_a)
    for _ in range(C.VINCENTY_ROUNDS):
        new = base + _shift(big_b, math.sin(sigma), math.cos(sigma), math.cos(2 * sigma1 + sigma))
        moved, sigma = abs(new - sigma), new
        if moved < C.VINCENTY_EPS:
            break
    ss, cs, c2m = math.sin(sigma), math.cos(sigma), math.cos(2 * sigma1 + sigma)
    lat2 = math.atan2(su * cs + cu * ss * ca, (1 - C.WGS84_F) * math.hypot(sa, su * ss - cu * cs * ca))
    lam = math.atan2(ss * math.sin(alpha), cu * cs - su * ss * ca)
    c = C.WGS84_F / 16 * c2a * (4 + C.WGS84_F * (4 - 3 * c2a))
    turn = lam - (1 - c) * C.WGS84_F * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
    return math.degrees(lat2), (lon + math.degrees(turn) + 540) % 360 - 180


# --- column functions ---------------------------------------------------------------------------


@F.pandas_udf(T.DoubleType())
def distance_col(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    return pd.Series(distance_m(lat1, lon1, lat2, lon2))


@F.pandas_udf(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]))
def destination_col(lat: pd.Series, lon: pd.Series, bearing: pd.Series, metres: pd.Series) -> pd.DataFrame:
    lat2, lon2 = destination(lat, lon, bearing, metres)
    return pd.DataFrame({"lat": lat2, "lon": lon2})


def nautical(metres: Column) -> Column:
    """Metres to nautical miles with the factor that the gate's variant uses."""
    return metres * 0.00054


def bearing_col(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    turn = F.radians(lon2) - F.radians(lon1)
    y = F.sin(turn) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(turn)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def angle_gap(a: Column, b: Column) -> Column:
    """Difference of two directions on the circle, 0 to 180."""
    gap = F.abs(a - b)
    return F.when(gap < 180.0, gap).otherwise(360.0 - gap)


def classify_col(camera: Camera, distance: Column, bearing: Column) -> Column:
    limit = 90 + camera.tilt - camera.fov_v / 2
    below = F.lit(limit) >= F.degrees(F.atan(distance / F.lit(camera.height)))
    inside = angle_gap(F.lit(camera.bearing), bearing) <= camera.fov_h / 2 + C.FOV_MARGIN_DEG
    return F.when(below, "OutsideVerticalFov").when(inside, "Transform").otherwise("RemoveVisualTrack")


def project_col(camera: Camera, distance: Column, bearing: Column) -> tuple[Column, Column]:
    """Pixel coordinates before truncation."""
    off = bearing - F.lit(camera.bearing)
    off = F.when(off > 180.0, off - 360.0).when(off < -180.0, off + 360.0).otherwise(off)
    tilt = float(np.radians(-camera.tilt))
    forward, right = distance * F.cos(F.radians(off)), distance * F.sin(F.radians(off))
    rest = F.lit(camera.height) - forward * float(np.tan(tilt))
    z = forward / float(np.cos(tilt)) + rest * float(np.sin(tilt))
    y = rest * float(np.cos(tilt))
    return F.lit(camera.fx) * right / z + camera.u0, F.lit(camera.fy) * y / z + camera.v0
