"""Features of map tiles, and the geometry that goes into them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartalog.functions import tags
from cartalog.functions.geo import MERCATOR_RADIUS, mercator_x, mercator_y

#: Points of a piece of a long line, and from how many points on a line is long.
PIECE, LONG_LINE = 20, 40


def classify(features: DataFrame, layers: Mapping[str, Mapping[str, tuple[str, ...]]]) -> DataFrame:
    """Features (.., tags as a map) with the first layer that wants them; others are left out."""
    return features.withColumn("layer", tags.pick_layer(F.col("tags"), layers)).where("layer is not null")


def with_box(features: DataFrame, line: str = "line") -> DataFrame:
    """xmin, ymin, xmax, ymax in mercator metres of an array of structs (lat, lon)."""
    xs, ys = F.transform(line, lambda p: mercator_x(p["lon"])), F.transform(line, lambda p: mercator_y(p["lat"]))
    return features.withColumns({"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)})


def tile_features(features: DataFrame, x: int, y: int, zoom: int, margin: float = 0.0) -> DataFrame:
    """Features whose box meets a tile; comparisons only, which reach the scan."""
    whole = 2 * math.pi * MERCATOR_RADIUS
    side = whole / 2**zoom
    west, north = x * side - whole / 2 - margin, whole / 2 - y * side + margin
    east, south = west + side + 2 * margin, north - side - 2 * margin
    return features.where((F.col("xmax") >= west) & (F.col("xmin") <= east) & (F.col("ymax") >= south) & (F.col("ymin") <= north))


def all_tiles(features: DataFrame, zoom: int) -> DataFrame:
    """Features with every tile (x, y) of a zoom that their box meets."""
    whole = 2 * math.pi * MERCATOR_RADIUS
    side, last = whole / 2**zoom, 2**zoom - 1

    def at(value: Column, sign: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(last), F.floor((value * sign + whole / 2) / side))).cast("int")

    spread = features.withColumn("x", F.explode(F.sequence(at(F.col("xmin"), 1), at(F.col("xmax"), 1))))
    return spread.withColumn("y", F.explode(F.sequence(at(F.col("ymax"), -1), at(F.col("ymin"), -1))))


def split_line(line: Column) -> Column:
    """Pieces of a long line; pieces share no point, shorter lines are one piece."""
    n = F.size(line)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(PIECE))
    return F.when(n > LONG_LINE, F.transform(starts, lambda s: F.slice(line, s, PIECE))).otherwise(F.array(line))


Ring = list[tuple[float, float]]


def _inside(point: tuple[float, float], ring: Ring) -> bool:
    x, y, odd = point[0], point[1], False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def _area(ring: Ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def merge_rings(lines: list[Ring]) -> list[Ring]:
    """Rings made of lines that meet at their ends; what does not close is left out."""
    open_lines, rings = [list(line) for line in lines if len(line) > 1], []
    while open_lines:
        ring = open_lines.pop(0)
        while ring[0] != ring[-1]:
            for k, other in enumerate(open_lines):
                if other[0] == ring[-1]:
                    ring += open_lines.pop(k)[1:]
                elif other[-1] == ring[-1]:
                    ring += open_lines.pop(k)[-2::-1]
                else:
                    continue
                break
            else:
                break
        if ring[0] == ring[-1] and len(ring) > 3:
            rings.append(ring[:-1])
    return rings


def assemble(lines: list[Ring]) -> list[list[Ring]]:
    """Polygons, each an outer ring and its holes, by even-odd nesting; outer rings turn left, holes right."""
    rings = sorted(merge_rings(lines), key=lambda r: -abs(_area(r)))
    depth, polygons, owner = [], [], {}
    for k, ring in enumerate(rings):
        around = [j for j in range(k) if _inside(ring[0], rings[j])]
        depth.append(len(around))
        turned = ring if (_area(ring) > 0) == (len(around) % 2 == 0) else ring[::-1]
        if len(around) % 2 == 0:
            owner[k] = len(polygons)
            polygons.append([turned])
        else:
            outer = max(j for j in around if depth[j] == len(around) - 1)
            polygons[owner[outer]].append(turned)
    return polygons


def simplify(line: Ring, most: float) -> Ring:
    """Douglas-Peucker: points farther than so much from the line between those kept."""
    if len(line) < 3:
        return line
    (ax, ay), (bx, by) = line[0], line[-1]
    length = math.hypot(bx - ax, by - ay)
    far = [abs((bx - ax) * (ay - y) - (ax - x) * (by - ay)) / length if length else math.hypot(x - ax, y - ay) for x, y in line[1:-1]]
    k = max(range(len(far)), key=far.__getitem__) + 1
    if far[k - 1] <= most:
        return [line[0], line[-1]]
    return simplify(line[: k + 1], most)[:-1] + simplify(line[k:], most)


def clip_ring(ring: Ring, west: float, south: float, east: float, north: float) -> Ring:
    """The part of a ring within a box, by Sutherland and Hodgman."""
    for axis, bound, sign in ((0, west, 1), (0, east, -1), (1, south, 1), (1, north, -1)):
        out: Ring = []
        for a, b in zip(ring[-1:] + ring[:-1], ring, strict=True):
            ina, inb = (a[axis] - bound) * sign >= 0, (b[axis] - bound) * sign >= 0
            if ina != inb:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
            if inb:
                out.append(b)
        ring = out
        if not ring:
            return []
    return ring


def build_polygons(parts: DataFrame) -> DataFrame:
    """(relid, polygons): multipolygons of lines (relid, line), line an array of structs (lat, lon)."""

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        lines = [[(p["lon"], p["lat"]) for p in line] for line in group["line"]]
        rings = [[[{"lat": y, "lon": x} for x, y in ring] for ring in polygon] for polygon in assemble(lines)]
        return pd.DataFrame({"relid": [key[0]], "polygons": [rings]})

    return parts.groupBy("relid").applyInPandas(build, "relid bigint, polygons array<array<array<struct<lat:double,lon:double>>>>")


def clip_polygons(rings: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """(id, ring) within a box (west, south, east, north), every part kept; rings as arrays of structs (lat, lon)."""

    def clip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cut = [clip_ring([(p["lon"], p["lat"]) for p in ring], *box) for ring in batch["ring"]]
            out = batch.assign(ring=[[{"lat": y, "lon": x} for x, y in r] for r in cut])
            yield out[[len(r) > 2 for r in cut]]

    return rings.select("id", "ring").mapInPandas(clip, "id bigint, ring array<struct<lat:double,lon:double>>")
