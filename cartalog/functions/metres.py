"""Whole metres between points in plain Python, for searches inside one task."""

import math

from cartalog.functions.geo import EARTH_RADIUS


def whole_metres(lat1: float, lon1: float, lat2: float, lon2: float) -> int:
    a, b = math.sin(math.radians(lat2 - lat1) / 2), math.sin(math.radians(lon2 - lon1) / 2)
    inner = a * a + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * b * b
    return int(2 * EARTH_RADIUS * math.asin(math.sqrt(min(1.0, inner))))
