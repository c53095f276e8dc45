"""Great-circle distance and map zoom."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from drivetrace.config import EARTH_RADIUS_M


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in metres; null if any coordinate is null."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2.0)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2.0)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2.0 * EARTH_RADIUS_M) * F.asin(F.sqrt(chord))


def map_zoom(lat_span: Column, lon_span: Column, center_lat: Column) -> Column:
    """Zoom level that shows the box with some margin, between 3 and 16."""
    tiny = F.lit(1e-6)
    span = F.greatest(lat_span, lon_span * F.cos(F.radians(center_lat)), tiny)
    return F.greatest(F.lit(3.0), F.least(F.lit(16.0), F.log2(F.lit(360.0) / span) - 0.5))
