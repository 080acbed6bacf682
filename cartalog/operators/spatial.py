"""Boxes, nearest points and reverse geocoding over a grid of cells."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartalog.functions import tags
from cartalog.functions.geo import EARTH_RADIUS, haversine, in_box, known_position, manhattan
from cartalog.session import broadcast_if_small, cut

#: Half the side of the first box around a point, in degrees, and how often it may double; metres up to which an area counts as a point's own.
FIRST_HALF, DOUBLINGS = 0.00005, 100
AREA_METRES = {"country": 50_000, "state": 10_000, "city": 1_000, "suburb": 500, "district": 500, "postcode": 200, "zip": 200, "street": 50, "housenumber": 20}


#: Sides of cells in degrees, each a whole part of a circle, that a search for the closest goes through; the last one holds everything.
CELLS = (0.01, 0.08, 0.5, 4.0, 30.0, 360.0)


def _safe(side: float) -> Column:
    """Metres around a target within the cells of that side looked at; cells are narrow far north and south, and none hold a pole's surroundings."""
    return F.cos(F.radians(F.least(F.lit(90.0), F.abs("tlat") + 2 * side))) * (math.radians(side) * EARTH_RADIUS)


def _surely_closest(side: float) -> Column:
    return F.col("best.metres") <= _safe(side)


def _closest(points: DataFrame, targets: DataFrame, rank: Column, sure: Callable[[float], Column], cell: float = CELLS[0], within: Column | None = None, keys: tuple[str, ...] = ("target",)) -> DataFrame:
    """(*keys, tlat, tlon, best): the least rank among the points of each target's cell and those around it, in wider cells until it is sure.

    points: (lat, lon, what rank needs). Each round only takes the targets still open, and joins cells, so few rows meet where points are many,
    and few targets are left where they are few. sure tells of the side of a cell whether no point beyond the cells can rank less. keys beyond
    target are columns that points have too and that have to be equal. A target's search also ends where the cells hold all within so many metres.
    """
    located, open_, done = points.where(known_position(F.col("lat"), F.col("lon"))), targets.select(*keys, "tlat", "tlon").where("tlat is not null and tlon is not null"), None
    for side in [c for c in CELLS if c >= cell]:
        around, per_row = F.array(*[F.lit(k) for k in (-1, 0, 1)]), round(360 / side)
        row = lambda lat: F.floor(F.col(lat) / side) if per_row > 1 else F.lit(0).cast("bigint")  # noqa: B023, E731
        column = lambda lon: F.floor((F.col(lon) + 180) / side)  # noqa: B023, E731
        cells = located.withColumn("_y", row("lat")).withColumn("_x", F.pmod(column("lon"), F.lit(per_row)))
        spread = open_.withColumn("_y", F.explode(F.transform(around, lambda k: row("tlat") + k) if per_row > 1 else F.array(row("tlat"))))  # noqa: B023
        spread = spread.withColumn("_x", F.explode(F.array_distinct(F.transform(around, lambda k: F.pmod(column("tlon") + k, F.lit(per_row))))))  # noqa: B023
        best = cells.join(broadcast_if_small(spread), ["_y", "_x", *keys[1:]]).groupBy(*keys, "tlat", "tlon").agg(F.min(rank).alias("best"))
        enough = F.lit(False) if within is None else within <= _safe(side)  # noqa: B023
        found = cut(best.where(sure(side) | enough if per_row > 1 else F.lit(True)))
        done = found if done is None else done.unionByName(found)
        open_ = cut(open_.where(~enough).join(found.select(*keys, "tlat", "tlon"), [*keys, "tlat", "tlon"], "left_anti"))
        if not open_.limit(1).count():
            break
    return done


def in_bounding_box(points: DataFrame, hi_lat: float, hi_lon: float, lo_lat: float, lo_lon: float) -> DataFrame:
    """Points in a box given by its upper left and lower right corners; one that crosses the 180th meridian has the left one farther east.

    Plain comparisons, which reach the scan of a table clustered by cells.
    """
    lat, lon = F.col("lat"), F.col("lon")
    sides = lon.between(hi_lon, lo_lon) if hi_lon <= lo_lon else (lon >= hi_lon) | (lon <= lo_lon)
    return points.where(lat.between(lo_lat, hi_lat) & sides)


def boxes_join(points: DataFrame, boxes: DataFrame, cell: float = 0.1) -> DataFrame:
    """Points in each of many boxes (box columns hi_lat, hi_lon, lo_lat, lo_lon): cells equi-joined, then the exact test.

    Boxes are spread over the cells they touch, so they should not be many thousand cells wide; choose the cell to suit.
    """
    per_row = round(360 / cell)
    cells = points.withColumn("_y", F.floor(F.col("lat") / cell)).withColumn("_x", F.floor((F.col("lon") + 180) / cell))
    east = F.when(F.col("hi_lon") > F.col("lo_lon"), F.col("lo_lon") + 360).otherwise(F.col("lo_lon"))
    spread = boxes.withColumn("_y", F.explode(F.sequence(F.floor(F.col("lo_lat") / cell), F.floor(F.col("hi_lat") / cell))))
    columns = F.array_distinct(F.transform(F.sequence(F.floor((F.col("hi_lon") + 180) / cell), F.floor((east + 180) / cell)), lambda c: F.when(c > per_row, c - per_row).otherwise(c)))
    # The meridian itself is the last cell's far side and the first cell's near side.
    columns = F.array_distinct(F.concat(columns, F.transform(F.filter(columns, lambda c: (c == per_row) | (c == 0)), lambda c: per_row - c)))
    spread = spread.withColumn("_x", F.explode(columns))
    met = cells.join(spread, ["_y", "_x"]).where(in_box(F.col("lat"), F.col("lon"), F.col("hi_lat"), F.col("hi_lon"), F.col("lo_lat"), F.col("lo_lon")))
    return met.drop("_y", "_x").distinct()


def nearest_expanding(points: DataFrame, targets: DataFrame, key: str = "verid") -> DataFrame:
    """(target, key, lat, lon): as boxes double around each target, the closest of the first that is not empty, by degrees of latitude and longitude.

    targets: (target, tlat, tlon), any number of them; those whose place is unknown have no row, nor has any where there are no points.
    """
    far = F.greatest(F.abs(F.col("lat") - F.col("tlat")), F.abs(F.col("lon") - F.col("tlon")))
    step = F.when(far <= FIRST_HALF, 0).otherwise(F.ceil(F.log2(far / FIRST_HALF)))
    rank = F.struct(step.alias("step"), manhattan(F.col("lat"), F.col("lon"), F.col("tlat"), F.col("tlon")).alias("far"), F.col(key).alias("key"), F.col("lat").alias("lat"), F.col("lon").alias("lon"))
    best = _closest(points, targets, rank, lambda side: F.lit(FIRST_HALF) * F.pow(F.lit(2.0), F.col("best.step")) <= side).where(F.col("best.step") < DOUBLINGS)
    return best.select("target", F.col("best.key").alias(key), "best.lat", "best.lon")


def nearest(points: DataFrame, targets: DataFrame, key: str = "verid", cell: float = CELLS[0]) -> DataFrame:
    """(target, key, metres): the closest point on the sphere, the smallest key of several; targets as for nearest_expanding()."""
    rank = F.struct(haversine(F.col("lat"), F.col("lon"), F.col("tlat"), F.col("tlon")).alias("metres"), F.col(key).alias("key"))
    return _closest(points, targets, rank, _surely_closest, cell).select("target", F.col("best.key").alias(key), "best.metres")


nearest_join = nearest


def reverse_geocode(tags_table: DataFrame, places: DataFrame, targets: DataFrame, metres: Mapping[str, float] = AREA_METRES) -> DataFrame:
    """(target, area, value): of each kind of area, the value at the closest object that has it, if it is close enough.

    tags_table: (objectid, key, value); places: (objectid, lat, lon); targets: (target, tlat, tlon), a request.
    """
    area = tags.area_prefix(F.col("key"))
    far = haversine(F.col("lat"), F.col("lon"), F.col("tlat"), F.col("tlon"))
    most = F.create_map(*[F.lit(x) for pair in metres.items() for x in (pair[0], float(pair[1]))])
    have = tags_table.where(tags.is_address_decodable(F.col("key"))).select("objectid", area.alias("area"), "value").where(F.col("area").isin(*metres)).join(places, "objectid")
    have = cut(have.where(known_position(F.col("lat"), F.col("lon"))).select("objectid", "area", "value", "lat", "lon"))
    kinds = have.select("area").distinct().collect()  # as many as metres has at most
    asked = targets.select("target", "tlat", "tlon", F.explode(F.array(*[F.lit(r["area"]) for r in kinds]).cast("array<string>")).alias("area"))
    rank = F.struct(far.alias("metres"), F.col("objectid").alias("objectid"), F.col("value").alias("value"))
    # Of each kind the closest object is searched for, in cells until none beyond them can be closer or close enough: the widest circle may hold all objects.
    best = _closest(have, asked, rank, _surely_closest, within=most[F.col("area")], keys=("target", "area")).where(F.col("best.metres") <= most[F.col("area")])
    best = best.groupBy("target", "area").agg(F.min("best").alias("best"))
    return best.select("target", "area", F.col("best.value").alias("value"))


def area_boxes(points: DataFrame) -> DataFrame:
    """(areatype, name, level, hi_lat .. lo_lon): the true extent of each named area; points: (areatype, name, lat, lon)."""
    extent = points.groupBy("areatype", "name").agg(F.max("lat").alias("hl_lat"), F.min("lon").alias("hl_lon"), F.min("lat").alias("lr_lat"), F.max("lon").alias("lr_lon"))
    return extent.withColumn("level", tags.area_level(F.col("areatype")))


def area_parents(areas: DataFrame) -> DataFrame:
    """(id, parid): of each area, the closest centre among the areas of the first kind above it that exists; null for the top.

    areas: (id, areatype, hl_lat .. lr_lon); each level looks for its parents over cells of a degree, ring by ring.
    """
    middle = areas.select("id", "areatype", ((F.col("hl_lat") + F.col("lr_lat")) / 2).alias("lat"), ((F.col("hl_lon") + F.col("lr_lon")) / 2).alias("lon"))
    present = [r["areatype"] for r in areas.select("areatype").distinct().collect()]  # kinds of area: a dozen
    wanted = F.lit(None).cast("string")
    for kinds in tags.AREA_LEVELS:
        for kind in kinds:
            level = next(k for k, names in enumerate(tags.AREA_LEVELS) if kind in names)
            above = next((a for upper in reversed(tags.AREA_LEVELS[:level]) for a in reversed(upper) if a in present), None)
            wanted = F.when(F.col("areatype") == kind, F.lit(above).cast("string")).otherwise(wanted)
    children = cut(middle.withColumn("wanted", wanted))
    found = None
    for row in children.select("wanted").where("wanted is not null").distinct().collect():  # one per level at most
        own = children.where(F.col("wanted") == row["wanted"]).select(F.col("id").alias("target"), F.col("lat").alias("tlat"), F.col("lon").alias("tlon"))
        near = nearest_join(children.where(F.col("areatype") == row["wanted"]), own, "id", cell=1.0).select("target", "id")
        found = near if found is None else found.unionByName(near)
    if found is None:
        return middle.select("id", F.lit(None).cast(areas.schema["id"].dataType).alias("parid"))
    return middle.select("id").join(found.select(F.col("target").alias("id"), F.col("id").alias("parid")), "id", "left")


def largest_areas(areas: DataFrame, kinds: tuple[str, ...] = ("country", "city")) -> DataFrame:
    size = F.abs(F.col("hl_lat") - F.col("lr_lat")) * F.abs(F.col("hl_lon") - F.col("lr_lon"))
    return areas.where(F.col("areatype").isin(*kinds)).select("id", "name", size.alias("area")).orderBy(F.desc("area"), "id")


def order_like(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows in the order of a request (pos, key), repeats kept."""
    return ids.join(rows, key).orderBy("pos")


def closest_in_array(points: Column, lat: Column, lon: Column) -> Column:
    """The element of an array of structs (lat, lon) closest by degrees, the first of several."""
    ranked = F.transform(points, lambda p, k: F.struct(manhattan(p["lat"], p["lon"], lat, lon).alias("far"), k.alias("k"), p.alias("p")))
    return F.array_min(F.transform(ranked, lambda r: F.struct(r["far"].alias("far"), r["k"].alias("k"), r["p"].alias("p"))))["p"]


def fill_gaps(rows: DataFrame, group: str, order: str, columns: tuple[str, ...] = ("lat", "lon")) -> DataFrame:
    """Missing places of a line taken from the one before, at the start from the one after."""
    forward = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy(group).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    for c in columns:
        rows = rows.withColumn(c, F.coalesce(F.last(c, ignorenulls=True).over(forward), F.first(c, ignorenulls=True).over(backward)))
    return rows
