"""Distances and bearings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Earth's radius in nautical miles and in kilometres.
RADIUS_NM, RADIUS_KM = 3440.065, 6371.0


def _chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    return F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS_NM) -> Column:
    """Great-circle distance; radius in the unit wanted."""
    a = _chord(lat1, lon1, lat2, lon2)
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial course from the first point to the second, 0 to 360."""
    dlon = F.radians(lon2 - lon1)
    a, b = F.radians(lat1), F.radians(lat2)
    y = F.sin(dlon) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str, radius: float = RADIUS_NM) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(2 * {radius} * atan2(sqrt{a}, sqrt(1 - {a})))"


def haversine_expr(lat1: str, lon1: str, lat2: str, lon2: str, radius: float = RADIUS_NM) -> str:
    """``haversine`` as a Spark SQL expression, for use inside others."""
    a = f"(sin(radians({lat2} - {lat1}) / 2) * sin(radians({lat2} - {lat1}) / 2) + cos(radians({lat1})) * cos(radians({lat2})) * sin(radians({lon2} - {lon1}) / 2) * sin(radians({lon2} - {lon1}) / 2))"
    return f"(2 * {radius}D * atan2(sqrt({a}), sqrt(1 - {a})))"
