"""Distances, projection and polygon rings as Column arithmetic; geodesic distances over Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapulse.constants import METRES_PER_DEGREE

# WGS 84 and GRS 80 ellipsoids, UTM zone 22 south.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
GRS80_A = 6378137.0
GRS80_F = 1 / 298.257222101
UTM_SCALE = 0.9996
UTM_FALSE_EASTING = 500_000.0
UTM_FALSE_NORTHING = 10_000_000.0
UTM_CENTRAL_MERIDIAN = -51.0

# A degree of latitude is never shorter than this on WGS 84, so boxes built with it are never too small.
_MIN_METRES_PER_DEGREE = 110_500.0

INVERSE_ITERATIONS = 5
# Change of the longitude term in the last iteration, in radians: under a millimetre.
_SETTLED = 1e-10


def planar_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance in metres, longitude shrunk by the cosine of the mid latitude."""
    north = (lat2 - lat1) * F.lit(METRES_PER_DEGREE)
    east = (lon2 - lon1) * F.lit(METRES_PER_DEGREE) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.hypot(north, east)


def geodesic(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Distances on the WGS 84 ellipsoid in metres (Vincenty's inverse formula), NaN where it does not settle."""
    f, a = WGS84_F, WGS84_A
    b = a * (1 - f)
    with np.errstate(all="ignore"):
        reduced1, reduced2 = (np.arctan((1 - f) * np.tan(np.radians(lat))) for lat in (lat1, lat2))
        su1, cu1, su2, cu2 = np.sin(reduced1), np.cos(reduced1), np.sin(reduced2), np.cos(reduced2)
        turn = lam = np.radians(lon2 - lon1)
        for _ in range(INVERSE_ITERATIONS):
            sin, cos = np.sin(lam), np.cos(lam)
            cross, side = cu1 * su2 - su1 * cu2 * cos, cu2 * sin
            ss, cs = np.sqrt(side * side + cross * cross), su1 * su2 + cu1 * cu2 * cos
            sa = np.where(ss == 0, 0.0, cu1 * cu2 * sin / ss)
            sig, c2a = np.arctan2(ss, cs), 1 - sa * sa
            c2m = np.where(c2a == 0, 0.0, cs - 2 * su1 * su2 / c2a)
            cc = f / 16 * c2a * (4 + f * (4 - 3 * c2a))
            was, lam = lam, turn + (1 - cc) * f * sa * (sig + cc * ss * (c2m + cc * cs * (2 * c2m * c2m - 1)))
        u = c2a * ((a * a - b * b) / (b * b))
        aa = 1 + u / 16384 * (4096 + u * (u * (320 - 175 * u) - 768))
        bb = u / 1024 * (256 + u * (u * (74 - 47 * u) - 128))
        shift = bb * ss * (c2m + bb / 4 * (cs * (2 * c2m * c2m - 1) - bb / 6 * c2m * (4 * ss * ss - 3) * (4 * c2m * c2m - 3)))
        return np.where(np.abs(lam - was) <= _SETTLED, b * aa * (sig - shift), np.nan)


def with_geodesic_distance(
    df: DataFrame, lat1: str, lon1: str, lat2: str, lon2: str, out: str = "distancia_m"
) -> DataFrame:
    """Adds the distance on the WGS 84 ellipsoid in metres (Vincenty's inverse formula).

    A fixed number of iterations, each shrinking the error by about 1/300; nearly
    opposite points, for which that is not enough, get null. The formula goes over
    Arrow batches: as one expression its code is too long for the JVM to compile.
    """

    @F.pandas_udf("double")
    def distance(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
        return pd.Series(geodesic(*(x.to_numpy(np.float64) for x in (lat1, lon1, lat2, lon2))))

    return df.withColumn(out, distance(*[F.col(c).cast("double") for c in (lat1, lon1, lat2, lon2)]))


def place_in_space(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Metres from the centre of the WGS 84 ellipsoid along its axes. No way along the surface is shorter than the straight one."""
    e2 = WGS84_F * (2 - WGS84_F)
    phi, lam = F.radians(lat), F.radians(lon)
    n = F.lit(WGS84_A) / F.sqrt(1 - F.lit(e2) * F.sin(phi) * F.sin(phi))
    return n * F.cos(phi) * F.cos(lam), n * F.cos(phi) * F.sin(lam), n * F.lit(1 - e2) * F.sin(phi)


def within_geodesic_distance(
    df: DataFrame,
    lat1: str,
    lon1: str,
    lat2: str,
    lon2: str,
    limit_m: float,
    out: str = "distancia_m",
) -> DataFrame:
    """Rows at most `limit_m` apart, with the distance.

    The row id keeps the filter above the formula: pushed through it, the distance
    would be computed twice.
    """
    return (
        with_geodesic_distance(df, lat1, lon1, lat2, lon2, out)
        .withColumn("_row", F.monotonically_increasing_id())
        .filter((F.col(out) <= limit_m) & (F.col("_row") >= 0))
        .drop("_row")
    )


def in_box(lat: Column, lon: Column, centre_lat: float, centre_lon: float, radius_m: float) -> Column:
    """Plain comparisons that keep every point within the radius, for pushdown to the files."""
    half_lat = radius_m / _MIN_METRES_PER_DEGREE
    keep = lat.between(centre_lat - half_lat, centre_lat + half_lat)
    edge = abs(centre_lat) + half_lat
    if edge >= 89.0:
        return keep
    half_lon = radius_m / (_MIN_METRES_PER_DEGREE * math.cos(math.radians(edge)))
    west, east = centre_lon - half_lon, centre_lon + half_lon
    if west < -180.0:
        return keep & ((lon >= west + 360.0) | (lon <= east))
    if east > 180.0:
        return keep & ((lon >= west) | (lon <= east - 360.0))
    return keep & lon.between(west, east)


def _krueger() -> tuple[float, list[float], list[float]]:
    n = GRS80_F / (2 - GRS80_F)
    radius = GRS80_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    delta = [
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    ]
    return radius, beta, delta


def to_lon_lat(easting: Column, northing: Column) -> tuple[Column, Column]:
    """UTM zone 22 south to degrees (inverse Gauss-Krueger series to fourth order)."""
    radius, beta, delta = _krueger()
    xi0 = (northing - F.lit(UTM_FALSE_NORTHING)) / F.lit(UTM_SCALE * radius)
    eta0 = (easting - F.lit(UTM_FALSE_EASTING)) / F.lit(UTM_SCALE * radius)
    xi, eta = xi0, eta0
    for j, coefficient in enumerate(beta, start=1):
        xi = xi - F.lit(coefficient) * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - F.lit(coefficient) * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, coefficient in enumerate(delta, start=1):
        lat = lat + F.lit(coefficient) * F.sin(2 * j * chi)
    lon = F.lit(UTM_CENTRAL_MERIDIAN) + F.degrees(F.atan(F.sinh(eta) / F.cos(xi)))
    return lon, F.degrees(lat)


def reproject_ring(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.array(*to_lon_lat(p[0], p[1])))


def is_clockwise(ring: Column) -> Column:
    """Orientation by the sum over the edges; clockwise rings are outer rings."""
    edges = F.greatest(F.array_size(ring) - 1, F.lit(0))
    terms = F.zip_with(
        F.slice(ring, 1, edges),
        F.slice(ring, 2, edges),
        lambda p, q: (q[0] - p[0]) * (q[1] + p[1]),
    )
    return F.aggregate(terms, F.lit(0.0), lambda total, term: total + term) >= 0


def group_rings(rings: Column) -> Column:
    """Rings to parts: each outer ring starts a part, the rings up to the next one are its holes.

    Rings of fewer than four points are dropped first; the first ring left is
    always an outer one. One pass over the array of a row, no shuffle.
    """
    kept = F.filter(rings, lambda ring: F.array_size(ring) >= 4)
    starts = F.filter(
        F.transform(
            kept, lambda ring, i: F.when((i == 0) | is_clockwise(ring), (i + 1).cast("int"))
        ),
        lambda i: i.isNotNull(),
    )
    return F.transform(
        starts,
        lambda start, k: F.slice(
            kept, start, F.coalesce(F.get(starts, k + 1), F.array_size(kept) + 1) - start
        ),
    )


def to_multipolygon(rings: Column) -> Column:
    """Projected rings to a multipolygon in degrees; null or no rings give null.

    Rings that are all too short give an empty array, which validation rejects.
    """
    parts = F.transform(group_rings(rings), lambda part: F.transform(part, reproject_ring))
    return F.when(F.array_size(rings) > 0, parts)


def place_order(lat: str, lon: str) -> Column:
    """A number that neighbouring places share most of: the bits of latitude and longitude by turns, 16 of each (Z-order). Null places come first."""

    def spread(share: Column) -> Column:
        inside = F.least(F.greatest(F.floor(share * 65536), F.lit(0)), F.lit(65535)).cast("long")
        bits = F.when(share.isNotNull(), inside)
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return bits

    return F.shiftleft(spread((F.col(lat) + 90) / 180), 1).bitwiseOR(spread((F.col(lon) + 180) / 360))
