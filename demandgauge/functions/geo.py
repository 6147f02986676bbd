"""Column expressions on coordinates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_RADIUS_M = 6371008.8
METRES_PER_DEGREE = 111195.0  # a little below the true length, so that cells are never too small


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(half_lat) * F.sin(half_lat) + (
        F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon))
    return F.asin(F.least(F.sqrt(h), F.lit(1.0))) * (2 * EARTH_RADIUS_M)
