"""Distances, boxes, projections and tiles as native expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the sphere for distances, and the equatorial radius of the web map's sphere, in metres.
EARTH_RADIUS = 6372797.560856
MERCATOR_RADIUS = 6378137.0
TILE_PIXELS = 256


def known_position(lat: Column, lon: Column) -> Column:
    """Whether both are given and in range; never null."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon), F.lit(False))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points on the sphere."""
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    inner = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(F.least(F.lit(1.0), inner)))


def manhattan(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees of latitude plus degrees of longitude."""
    return F.abs(lat1 - lat2) + F.abs(lon1 - lon2)


def in_box(lat: Column, lon: Column, hi_lat: Column, hi_lon: Column, lo_lat: Column, lo_lon: Column) -> Column:
    """Whether a point is in the box from its upper left to its lower right corner, which may cross the 180th meridian."""
    across = (lon >= hi_lon) | (lon <= lo_lon)
    return lat.between(lo_lat, hi_lat) & F.when(hi_lon > lo_lon, across).otherwise(lon.between(hi_lon, lo_lon))


def mercator_x(lon: Column) -> Column:
    return F.lit(MERCATOR_RADIUS) * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    return F.lit(MERCATOR_RADIUS) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def pixel_x(lon: Column, zoom: Column | int) -> Column:
    """The column of pixels, not rounded, at a zoom of the web map."""
    size = F.lit(TILE_PIXELS) * F.pow(F.lit(2.0), F.lit(zoom) if isinstance(zoom, int) else zoom)
    return size / 2 + lon * (size / 360)


def pixel_y(lat: Column, zoom: Column | int) -> Column:
    """The row of pixels, not rounded; the sine is kept within 0.9999."""
    size = F.lit(TILE_PIXELS) * F.pow(F.lit(2.0), F.lit(zoom) if isinstance(zoom, int) else zoom)
    sine = F.greatest(F.lit(-0.9999), F.least(F.lit(0.9999), F.sin(F.radians(lat))))
    return size / 2 - F.log((1 + sine) / (1 - sine)) * (size / (4 * math.pi))


def lon_of_pixel(x: Column, zoom: Column | int) -> Column:
    size = F.lit(TILE_PIXELS) * F.pow(F.lit(2.0), F.lit(zoom) if isinstance(zoom, int) else zoom)
    return (x - size / 2) / (size / 360)


def lat_of_pixel(y: Column, zoom: Column | int) -> Column:
    size = F.lit(TILE_PIXELS) * F.pow(F.lit(2.0), F.lit(zoom) if isinstance(zoom, int) else zoom)
    return F.degrees(2 * F.atan(F.exp((size / 2 - y) / (size / (2 * math.pi)))) - F.lit(math.pi / 2))


def tile_x(lon: Column, zoom: Column | int) -> Column:
    return F.floor(pixel_x(lon, zoom) / TILE_PIXELS).cast("int")


def tile_y(lat: Column, zoom: Column | int) -> Column:
    return F.floor(pixel_y(lat, zoom) / TILE_PIXELS).cast("int")


def tile_box(x: Column, y: Column, zoom: Column | int) -> tuple[Column, Column, Column, Column]:
    """West, south, east, north of a tile in mercator metres."""
    whole = 2 * math.pi * MERCATOR_RADIUS
    side = F.lit(whole) / F.pow(F.lit(2.0), F.lit(zoom) if isinstance(zoom, int) else zoom)
    west, north = x * side - whole / 2, F.lit(whole / 2) - y * side
    return west, north - side, west + side, north


def line_length(points: Column) -> Column:
    """Metres along an array of structs (lat, lon); 0 for fewer than two points."""
    ends = F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0)))
    starts = F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0)))
    steps = F.zip_with(starts, ends, lambda a, b: haversine(a["lat"], a["lon"], b["lat"], b["lon"]))
    return F.when(F.size(points) > 1, F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def ring_area(points: Column) -> Column:
    """Square degrees within a ring of structs (lat, lon), by the shoelace formula; the ring need not repeat its first point."""
    n = F.size(points)
    turned = F.concat(F.slice(points, 2, F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1))
    parts = F.zip_with(points, turned, lambda a, b: a["lon"] * b["lat"] - b["lon"] * a["lat"])
    return F.when(n > 2, F.abs(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)) / 2).otherwise(0.0)


def centre_of_mass(points: Column) -> Column:
    """The plain mean of an array of structs (lat, lon), as such a struct; null for an empty array."""
    n = F.size(points)
    total = F.aggregate(points, F.struct(F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon")), lambda s, p: F.struct((s["lat"] + p["lat"]).alias("lat"), (s["lon"] + p["lon"]).alias("lon")))
    return F.when(n > 0, F.struct((total["lat"] / n).alias("lat"), (total["lon"] / n).alias("lon")))
