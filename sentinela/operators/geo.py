"""Geographic aggregates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela import constants as K
from sentinela.plans.hints import bounded_broadcast


def geo_extent(df: DataFrame, lat: str = K.LAT, lon: str = K.LON, digits: int = 6) -> DataFrame:
    """Min, max and mean of the coordinates (map centre and range)."""
    r = lambda c: F.floor(c * F.lit(10.0 ** digits) + F.lit(0.5)) / F.lit(10.0 ** digits)
    return df.agg(F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"), r(F.avg(lat)).alias("lat_media"),
                  F.min(lon).alias("lon_min"), F.max(lon).alias("lon_max"), r(F.avg(lon)).alias("lon_media"))


def hex_cells(lat: str = K.LAT, lon: str = K.LON, radius_m: float = K.HEX_RADIUS_M):
    """Axial (q, r) of the pointy-top hexagon of circumradius ``radius_m`` that
    holds each point, on a local metre projection, with cube rounding."""
    x = F.col(lon) * F.lit(K.M_PER_DEG_LON)
    y = F.col(lat) * F.lit(K.M_PER_DEG_LAT)
    q = (x / F.lit(math.sqrt(3.0)) - y / F.lit(3.0)) / F.lit(radius_m)
    r = (F.lit(2.0) / F.lit(3.0)) * y / F.lit(radius_m)
    s = -q - r
    rq, rr, rs = F.round(q, 0), F.round(r, 0), F.round(s, 0)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    fr = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return fq.cast("long"), fr.cast("long")


def hex_density(df: DataFrame, lat: str = K.LAT, lon: str = K.LON, radius_m: float = K.HEX_RADIUS_M) -> DataFrame:
    """Points per hexagonal cell (NULL positions dropped)."""
    q, r = hex_cells(lat, lon, radius_m)
    d = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    return d.groupBy(q.alias("hex_q"), r.alias("hex_r")).agg(F.count(F.lit(1)).alias("n"))


def heat_points(df: DataFrame, lat: str = K.LAT, lon: str = K.LON, cell_deg: float = 1e-4) -> DataFrame:
    """One weighted point per square cell of ``cell_deg`` degrees.

    Cells come from ``floor`` (not ``round``) so no tie rule is involved; the
    map receives one row per occupied cell, not one per incident.
    """
    inv = 1.0 / cell_deg
    d = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    g = d.groupBy(F.floor(F.col(lat) * F.lit(inv)).alias("cel_lat"),
                  F.floor(F.col(lon) * F.lit(inv)).alias("cel_lon")).agg(F.count(F.lit(1)).alias("n"))
    return g


def zone_dimension_join(df: DataFrame, boxes: DataFrame, zone: str = K.ZONE) -> DataFrame:
    """Attach the zone's centre and half-width (inner join, broadcast dimension)."""
    b = bounded_broadcast(boxes.withColumnRenamed("zone", zone))
    return df.join(b, zone, "inner")
