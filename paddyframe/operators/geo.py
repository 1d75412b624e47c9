"""Polygon centroids (survey 2.J, J7) on a vertex table, with UTM projection as column math.

Vertices: ``(polygon_id, ring, seq, x, y)``; rings are closed implicitly (the
last vertex connects to the first).  The shoelace sums are one window
(``lead`` over the ring) and one aggregation; holes wound the other way
subtract themselves.  For geographic input the centroid is taken in projected
UTM metres (Transverse Mercator, Krueger series to third order) and mapped
back to latitude / longitude, all as JVM-side column expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: WGS84 ellipsoid and UTM parameters ------------------------
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_K0 = 0.9996
UTM_FALSE_EASTING = 500000.0
# ---------------------------------------------------------------------------

_N = WGS84_F / (2 - WGS84_F)
_A = WGS84_A / (1 + _N) * (1 + _N ** 2 / 4 + _N ** 4 / 64)
_ALPHA = (_N / 2 - 2 * _N ** 2 / 3 + 5 * _N ** 3 / 16, 13 * _N ** 2 / 48 - 3 * _N ** 3 / 5, 61 * _N ** 3 / 240)
_BETA = (_N / 2 - 2 * _N ** 2 / 3 + 37 * _N ** 3 / 96, _N ** 2 / 48 + _N ** 3 / 15, 17 * _N ** 3 / 480)
_DELTA = (2 * _N - 2 * _N ** 2 / 3 - 2 * _N ** 3, 7 * _N ** 2 / 3 - 8 * _N ** 3 / 5, 56 * _N ** 3 / 15)
_C = 2 * math.sqrt(_N) / (1 + _N)


def central_meridian(zone: int) -> float:
    return -183.0 + 6.0 * zone


def utm_forward(lat: Column, lon: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """(lat, lon) degrees -> (easting, northing) metres."""
    phi = F.radians(lat)
    dl = F.radians(lon - F.lit(central_meridian(zone)))
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(_C) * F.atanh(F.lit(_C) * F.sin(phi)))
    xi = F.atan(t / F.cos(dl))
    eta = F.atanh(F.sin(dl) / F.sqrt(F.lit(1.0) + t * t))
    e, n = eta, xi
    for j, a in enumerate(_ALPHA, start=1):
        e = e + F.lit(a) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
        n = n + F.lit(a) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
    easting = F.lit(UTM_FALSE_EASTING) + F.lit(UTM_K0 * _A) * e
    northing = F.lit(UTM_K0 * _A) * n + F.lit(10000000.0 if south else 0.0)
    return easting, northing


def utm_inverse(easting: Column, northing: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """(easting, northing) metres -> (lat, lon) degrees."""
    xi = (northing - F.lit(10000000.0 if south else 0.0)) / F.lit(UTM_K0 * _A)
    eta = (easting - F.lit(UTM_FALSE_EASTING)) / F.lit(UTM_K0 * _A)
    xp, ep = xi, eta
    for j, b in enumerate(_BETA, start=1):
        xp = xp - F.lit(b) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
        ep = ep - F.lit(b) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
    chi = F.asin(F.sin(xp) / F.cosh(ep))
    phi = chi
    for j, dlt in enumerate(_DELTA, start=1):
        phi = phi + F.lit(dlt) * F.sin(F.lit(2.0 * j) * chi)
    lam = F.atan(F.sinh(ep) / F.cos(xp))
    return F.degrees(phi), F.degrees(lam) + F.lit(central_meridian(zone))


def polygon_centroid(vertices: DataFrame, key: str = "polygon_id") -> DataFrame:
    """Planar area and centroid per polygon (shoelace)."""
    w = Window.partitionBy(key, "ring").orderBy("seq")
    first_x = F.first("x").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first_y = F.first("y").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    v = vertices.withColumn("nx", F.coalesce(F.lead("x").over(w), first_x)) \
        .withColumn("ny", F.coalesce(F.lead("y").over(w), first_y))
    v = v.withColumn("cr", F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))
    agg = v.groupBy(key).agg(F.sum("cr").alias("_s"), F.sum((F.col("x") + F.col("nx")) * F.col("cr")).alias("_sx"),
                             F.sum((F.col("y") + F.col("ny")) * F.col("cr")).alias("_sy"))
    return agg.select(key, (F.lit(0.5) * F.col("_s")).alias("area"),
                      F.try_divide(F.col("_sx"), F.lit(3.0) * F.col("_s")).alias("cx"),
                      F.try_divide(F.col("_sy"), F.lit(3.0) * F.col("_s")).alias("cy"))


def geographic_centroid(vertices: DataFrame, zone: int = 51, key: str = "polygon_id",
                        lat_col: str = "lat", lon_col: str = "lon") -> DataFrame:
    """Centroid of lat/lon polygons computed in UTM metres, returned as (lat, lon)."""
    e, n = utm_forward(F.col(lat_col), F.col(lon_col), zone)
    proj = vertices.select(key, "ring", "seq", e.alias("x"), n.alias("y"))
    c = polygon_centroid(proj, key)
    lat, lon = utm_inverse(F.col("cx"), F.col("cy"), zone)
    return c.select(key, "area", lat.alias("latitude"), lon.alias("longitude"))
