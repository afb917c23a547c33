"""Compact position reports: encoding and decoding as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 131072.0  # 2 to the 17
ZONES = 15
MAX_PAIR_AGE = 10.0


def zones_at(lat: Column) -> Column:
    """Number of longitude zones at a latitude, 59 at the equator and 1 from 87 degrees."""
    a = 1 - math.cos(math.pi / (2 * ZONES))
    c = F.cos(F.radians(F.abs(lat)))
    n = F.floor(2 * math.pi / F.acos(1 - F.lit(a) / (c * c))).cast("int")
    return F.when(F.abs(lat) >= 87.0, 1).otherwise(F.greatest(n, F.lit(1)))


def _mod(x: Column, y) -> Column:
    return x - y * F.floor(x / y)


def _rounded(lat: Column, odd: int) -> tuple[Column, Column]:
    """The field of a latitude in an even (0) or odd (1) report, and the latitude that it stands for."""
    dlat = 360.0 / (4 * ZONES - odd)
    y = F.floor(SCALE * _mod(lat, dlat) / dlat + 0.5)
    return y, dlat * (y / SCALE + F.floor(lat / dlat))


def straddles(lat: Column) -> Column:
    """Whether the even and the odd report of a latitude fall into different zones, so that the pair gives no place."""
    return zones_at(_rounded(lat, 0)[1]) != zones_at(_rounded(lat, 1)[1])


def encode(lat: Column, lon: Column, odd: int) -> tuple[Column, Column]:
    """The two 17-bit fields of a position in an even (0) or odd (1) report."""
    y, rlat = _rounded(lat, odd)
    # as a lambda the number of zones is computed once a row
    dlon = F.array(360.0 / F.greatest(zones_at(rlat) - odd, F.lit(1)))
    x = F.get(F.transform(dlon, lambda d: F.floor(SCALE * _mod(lon, d) / d + 0.5)), F.lit(0))
    return F.pmod(y, F.lit(131072)).cast("long"), F.pmod(x, F.lit(131072)).cast("long")


def decode_global(lat_even: Column, lon_even: Column, lat_odd: Column, lon_odd: Column, t_even: Column, t_odd: Column) -> Column:
    """Struct (lat, lon) from an even and an odd report; null if they are more than 10 s apart or in different zones."""
    ye, xe, yo, xo = (c / SCALE for c in (lat_even, lon_even, lat_odd, lon_odd))
    j = F.floor(59 * ye - 60 * yo + 0.5)
    south = lambda v: F.when(v >= 270, v - 360).otherwise(v)
    even, odd = south(360.0 / 60 * (_mod(j, 60) + ye)), south(360.0 / 59 * (_mod(j, 59) + yo))
    zones = zones_at(even)
    newer_even = t_even >= t_odd
    count = F.when(newer_even, zones).otherwise(F.greatest(zones - 1, F.lit(1)))
    m = F.floor(xe * (zones - 1) - xo * zones + 0.5)
    lon = 360.0 / count * (_mod(m, count) + F.when(newer_even, xe).otherwise(xo))
    lon = F.when(lon >= 180, lon - 360).otherwise(lon)
    fits = (F.abs(t_even - t_odd) <= MAX_PAIR_AGE) & (zones == zones_at(odd))
    return F.when(fits, F.struct(F.round(F.when(newer_even, even).otherwise(odd), 6).alias("lat"), F.round(lon, 6).alias("lon")))


def decode_local(cpr_lat: Column, cpr_lon: Column, odd: Column, ref_lat: Column, ref_lon: Column) -> Column:
    """Struct (lat, lon) of one report near a known place."""
    i = F.when(odd, 1).otherwise(0)
    dlat = 360.0 / (60 - i)
    y, x = cpr_lat / SCALE, cpr_lon / SCALE
    lat = dlat * (F.floor(ref_lat / dlat) + F.floor(_mod(ref_lat, dlat) / dlat - y + 0.5) + y)
    dlon = 360.0 / F.greatest(zones_at(lat) - i, F.lit(1))
    lon = dlon * (F.floor(ref_lon / dlon) + F.floor(_mod(ref_lon, dlon) / dlon - x + 0.5) + x)
    lon = F.when(lon >= 180, lon - 360).otherwise(lon)
    return F.struct(F.round(F.when(lat > 90, lat - 360).otherwise(lat), 6).alias("lat"), F.round(lon, 6).alias("lon"))
