"""Distances and calendar components."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formats import as_column

# Fixed value: mean earth radius in metres.
EARTH_RADIUS_M = 6371008.8


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    phi1, phi2 = F.radians(as_column(lat1)), F.radians(as_column(lat2))
    half_dphi = F.radians(as_column(lat2) - as_column(lat1)) / 2
    half_dlam = F.radians(as_column(lon2) - as_column(lon1)) / 2
    a = F.pow(F.sin(half_dphi), 2) + F.cos(phi1) * F.cos(phi2) * F.pow(F.sin(half_dlam), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def planar_distance(x, y, center: tuple[float, float]) -> Column:
    dx, dy = as_column(x) - center[0], as_column(y) - center[1]
    return F.sqrt(dx * dx + dy * dy)


def in_zone(x, y, center: tuple[float, float], radius: float) -> Column:
    return (planar_distance(x, y, center) < radius).cast("int")


def trend_component(period, slope: float) -> Column:
    return as_column(period) * F.lit(float(slope))


def seasonal_component(period, cycle: int = 12, amplitude: float = 0.2) -> Column:
    return F.lit(float(amplitude)) * F.sin(F.lit(2 * math.pi) * as_column(period) / F.lit(float(cycle)))
