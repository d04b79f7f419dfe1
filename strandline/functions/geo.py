"""Geographic column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def usable_position(lat: Column, lon: Column, null_island: bool = True) -> Column:
    """Both coordinates are numbers on the globe; ``null_island``: and not a bare (0, 0)."""
    ok = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180)
    if null_island:
        ok = ok & ~((F.abs(lat) < 0.01) & (F.abs(lon) < 0.01))
    return F.coalesce(ok, F.lit(False))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; NULL where a coordinate is."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(h < 1, h).when(h >= 1, 1.0)))


def haversine_atan2_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))


def equirectangular_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return EARTH_KM * F.sqrt(x * x + F.pow(F.radians(lat2 - lat1), 2))


def planar_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in the plane of (lat, lon) in radians, times the earth's radius."""
    return EARTH_KM * F.sqrt(F.pow(F.radians(lat2 - lat1), 2) + F.pow(F.radians(lon2 - lon1), 2))


def near_origin(lat: Column, lon: Column, degrees: float = 1.0) -> Column:
    """Whether a position lies so close to (0, 0) that it stands for none."""
    return F.coalesce((F.abs(lat) < degrees) & (F.abs(lon) < degrees), F.lit(False))
