"""Squared distances as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def planar_sq(x: Column, y: Column, cx: Column, cy: Column) -> Column:
    """Squared Euclidean distance in map units, in the direct form, which keeps small differences of large numbers."""
    return (x - cx) * (x - cx) + (y - cy) * (y - cy)


def haversine_sq(lon: Column, lat: Column, clon: Column, clat: Column) -> Column:
    """Squared great-circle distance in square kilometres."""
    a = F.pow(F.sin(F.radians(clat - lat) / 2), F.lit(2.0)) + F.cos(F.radians(lat)) * F.cos(F.radians(clat)) * F.pow(F.sin(F.radians(clon - lon) / 2), F.lit(2.0))
    d = F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))
    return d * d


def distance_sq(longlat: bool):
    return haversine_sq if longlat else planar_sq


def haversine_sq_of(lon: float, lat: float, clon: float, clat: float) -> float:
    """haversine_sq of numbers."""
    a = math.sin(math.radians(clat - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(clat)) * math.sin(math.radians(clon - lon) / 2) ** 2
    return (2 * EARTH_KM * math.asin(min(1.0, math.sqrt(a)))) ** 2
