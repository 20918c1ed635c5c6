"""Distances, bounds and bearings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METRES = 6_371_000.0
METRES_PER_DEGREE = 110_000.0


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * EARTH_METRES) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def boxes_overlap(a: str, b: str) -> Column:
    """Whether the boxes of two aliased tables touch; borders count."""
    c = lambda t, n: F.col(f"{t}.{n}")
    return (c(a, "min_lat") <= c(b, "max_lat")) & (c(b, "min_lat") <= c(a, "max_lat")) & (c(a, "min_lng") <= c(b, "max_lng")) & (c(b, "min_lng") <= c(a, "max_lng"))


def within_degrees(lat1: Column, lng1: Column, lat2: Column, lng2: Column, metres: float) -> Column:
    """A cheap test that holds for all points within `metres`."""
    band = metres / METRES_PER_DEGREE
    return (F.abs(lat1 - lat2) <= band) & (F.abs(lng1 - lng2) <= band / F.greatest(F.lit(0.01), F.cos(F.radians(lat1))))


def diagonal(min_lat: Column, min_lng: Column, max_lat: Column, max_lng: Column) -> Column:
    """The span of a box in metres."""
    return haversine(min_lat, min_lng, max_lat, max_lng)


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Degrees from north, 0 to 360."""
    east = F.radians(lng2 - lng1)
    y = F.sin(east) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(east)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def turn(a: Column, b: Column) -> Column:
    """The angle between two bearings, 0 to 180."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, F.lit(360.0) - d)
