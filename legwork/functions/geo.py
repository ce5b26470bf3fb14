"""Distances on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))


def walking_minutes(metres: Column, detour: float = 1.4, metres_per_minute: float = 83.3) -> Column:
    return metres * detour / metres_per_minute


def band(lat: Column, metres: float) -> Column:
    """Number of the band of latitude, ``metres`` high."""
    return F.floor(lat / (metres / 111_000.0))


def cells_of(number: Column, metres: float) -> tuple[Column, Column]:
    """(cells around a band of latitude, degrees of longitude that ``metres`` span at most in it): wide cells near the poles, one at them."""
    step = metres / 111_000.0
    pole = F.least(F.greatest(F.abs(number * step), F.abs((number + 1) * step)), F.lit(90.0))
    reach = F.least(F.lit(step * 1.001) / F.greatest(F.cos(F.radians(pole)), F.lit(1e-9)), F.lit(180.0))
    return F.greatest(F.floor(F.lit(180.0) / reach), F.lit(1)), reach


def cell(lon: Column, lat: Column, metres: float) -> tuple[Column, Column]:
    """(cell along the band, band) of a point."""
    y = band(lat, metres)
    around, _ = cells_of(y, metres)
    return F.pmod(F.floor((lon + 180) / 360 * around), around), y


def near_cells(lon: Column, number: Column, metres: float) -> Column:
    """Cells of a band of latitude that may hold points within ``metres``, over the date line too."""
    around, reach = cells_of(number, metres)
    at = lambda degrees: F.floor((degrees + 180) / 360 * around)
    return F.array_distinct(F.transform(F.sequence(at(lon - reach), at(lon + reach)), lambda x: F.pmod(x, around)))
