"""Points near other points, and regions containing points, on the whole sphere.

Near points: bands of latitude are cut into cells whose width in degrees grows towards the poles. Each point has one home cell, and is
sent, as the other point of a pair, to every cell that its circle may touch, across the 180th meridian and the poles: an equi-join on
cells, then the exact distance.

Regions: polygons are triangulated by ear clipping. A bounded number of triangles becomes one bounding-volume hierarchy in arrays that is sent to
the executors; more are shared out with the points by cells of a size that fits each triangle, in one shuffle, and every task builds the hierarchy
of its own triangles. Points are run through it batch by batch: hierarchy levels, then exact tests of the candidate triangles, then one row per
point and region.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartalog.functions.geo import EARTH_RADIUS, haversine, known_position
from cartalog.session import broadcast_if_small, cut, small

#: Sides of a cell as multiples of the distance: wider cells send fewer copies and compare more pairs.
CELL_SIDES = 4
#: Triangles, at most, of a hierarchy sent to the executors, 10 MB, and of a cell's share; ten times as many points make a share.
BLOCK_TRIANGLES = 100_000
#: Sides of the widest cells, in degrees, and how often they are halved at most.
WIDEST_CELL, MOST_LEVELS = 720.0, 24
LEAF_TRIANGLES = 8


def _cells_of_band(band: Column, height: float) -> Column:
    """How many cells go round a band: the farthest edge from the equator decides."""
    edge = F.least(F.lit(90.0), F.greatest(F.abs(band * height - 90), F.abs((band + 1) * height - 90)))
    return F.greatest(F.lit(1), F.floor(F.lit(360.0) * F.cos(F.radians(edge)) / height)).cast("int")


def near_pairs(df: DataFrame, key: str, lat: str, lon: str, metres: float) -> DataFrame:
    """(key, other): pairs of points at most so many metres apart on the sphere, the smaller key first, each pair once.

    A position that is null or out of range gives no pair; so does a null key. Repeated rows count once; a key with several positions is
    near by any of them. An empty table gives an empty one. Other columns, whatever their names, play no part.
    """
    angle = metres / EARTH_RADIUS
    height = 180 / max(1, math.floor(180 / (math.degrees(angle) * CELL_SIDES)))
    reach = math.degrees(angle) * (1 + 1e-9)
    points = df.select(F.col(key).alias("k"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    points = points.where(F.col("k").isNotNull() & known_position(F.col("lat"), F.col("lon"))).distinct()
    x = F.pmod(F.col("lon") + 180, F.lit(360.0))

    def band(value: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(round(180 / height) - 1), F.floor((value + 90) / height))).cast("int")

    def cell(value: Column, n: Column) -> Column:
        return F.floor(value * n / 360).cast("int")

    home = points.withColumn("band", band(F.col("lat"))).withColumn("n", _cells_of_band(F.col("band"), height))
    home = home.select("k", "lat", "lon", "band", F.least(F.col("n") - 1, cell(x, F.col("n"))).alias("cell"))
    # The widest difference of longitude at this distance; near a pole, all round.
    sine = F.lit(math.sin(angle)) / F.cos(F.radians("lat"))
    width = F.when(sine < 1, F.degrees(F.asin(sine)) * (1 + 1e-9)).otherwise(180.0)
    sent = points.withColumn("x", x).withColumn("w", F.coalesce(width, F.lit(180.0)))
    sent = sent.withColumn("band", F.explode(F.sequence(band(F.col("lat") - reach), band(F.col("lat") + reach)))).withColumn("n", _cells_of_band(F.col("band"), height))
    around = F.sequence(cell(F.col("x") - F.col("w"), F.col("n")), cell(F.col("x") + F.col("w"), F.col("n")))
    cells = F.when(F.col("w") >= 180, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array_distinct(F.transform(around, lambda c: F.pmod(c, F.col("n")).cast("int"))))
    sent = sent.withColumn("cell", F.explode(cells)).select(F.col("k").alias("k2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "band", "cell")
    pairs = home.join(sent, ["band", "cell"]).where((F.col("k") < F.col("k2")) & (F.abs(F.col("lat") - F.col("lat2")) <= reach))
    pairs = pairs.where(haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= metres)
    # Keys with one position meet once only; several positions of a key may meet more often.
    return pairs.select(F.col("k").alias("key"), F.col("k2").alias("other")).distinct()


def box_ring(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The ring of a box given by opposite corners in any order; null if a corner is unknown.

    A box less than 180 degrees wide is meant: if the corners are farther apart, it crosses the 180th meridian, and the ring goes on beyond it.
    """
    west, east = F.least(lon1, lon2), F.greatest(lon1, lon2)
    across = east - west > 180
    west, east = F.when(across, F.greatest(lon1, lon2)).otherwise(west), F.when(across, F.least(lon1, lon2) + 360).otherwise(east)
    south, north = F.least(lat1, lat2), F.greatest(lat1, lat2)
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((west, south), (east, south), (east, north), (west, north))])
    return F.when(known_position(lat1, lon1) & known_position(lat2, lon2), ring)


def ear_clip(ring: list[tuple[float, float]]) -> list[tuple[tuple[float, float], ...]]:
    """Triangles that fill a simple polygon. A ring without area gives the triangles of its line, so that points on it are found.

    Only reflex corners can lie in an ear; they are kept in order of x, so that an ear is held against those between its own ends, all at once.
    A corner is looked at again when a neighbour of it goes. A ring that crosses itself is no simple polygon: it still ends, some ear being taken.
    """
    points = [p for k, p in enumerate(ring) if p != ring[k - 1]] or ring[:1]
    if len(points) < 3:
        return [(points[0], points[-1], points[-1])] if points else []
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True))
    if area < 0:
        points.reverse()
    n = len(points)
    before, after = [*range(-1, n - 1)], [*range(1, n), 0]
    before[0] = n - 1

    def turn(k: int) -> float:
        a, b, c = points[before[k]], points[k], points[after[k]]
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    reflex = sorted((k for k in range(n) if turn(k) <= 0), key=lambda k: points[k][0])
    rank = {k: r for r, k in enumerate(reflex)}
    x, y = (np.array([points[k][c] for k in reflex]) for c in (0, 1))
    alive = np.ones(len(reflex), dtype=bool)

    def is_ear(k: int) -> bool:
        if turn(k) <= 0:
            return False
        a, b, c = points[before[k]], points[k], points[after[k]]
        low, high = np.searchsorted(x, min(a[0], b[0], c[0])), np.searchsorted(x, max(a[0], b[0], c[0]), side="right")
        px, py, inside = x[low:high], y[low:high], alive[low:high].copy()
        for p in (a, b, c):
            inside &= (px != p[0]) | (py != p[1])
        for p, q in ((a, b), (b, c), (c, a)):
            inside &= (q[0] - p[0]) * (py - p[1]) - (q[1] - p[1]) * (px - p[0]) >= 0
        return not inside.any()

    out, left, k, tried = [], n, 0, 0
    while left > 3:
        if tried > left:  # no ear is left: a straight corner goes, or in rings that cross themselves any
            for _ in range(left):
                if turn(k) == 0:
                    break
                k = after[k]
        elif not is_ear(k):
            k, tried = after[k], tried + 1
            continue
        a, c = before[k], after[k]
        out.append((points[a], points[k], points[c]))
        after[a], before[c] = c, a
        left, tried = left - 1, 0
        for gone in (k, a, c):
            if gone in rank and (gone == k or turn(gone) > 0):
                alive[rank[gone]] = False
        # One corner on, so that no corner becomes the middle of a fan of slivers.
        k = after[c]
    return [*out, (points[before[k]], points[k], points[after[k]])]


def triangles(regions: DataFrame, region: str, ring: str) -> DataFrame:
    """(region, ax .. cy): the triangles of each region's ring of structs (x, y)."""

    def clip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *[v for p in t for v in p]) for i, points in zip(batch["region"], batch["ring"], strict=True) for t in ear_clip([(p["x"], p["y"]) for p in points])]
            yield pd.DataFrame(rows, columns=["region", "ax", "ay", "bx", "by", "cx", "cy"])

    kind = regions.schema[region].dataType.simpleString()
    found = regions.select(F.col(region).alias("region"), F.col(ring).alias("ring")).where("region is not null and ring is not null and size(ring) > 0").distinct()
    return found.mapInPandas(clip, f"region {kind}, ax double, ay double, bx double, by double, cx double, cy double")


class Hierarchy:
    """A bounding-volume hierarchy over triangles, level by level in arrays, for whole batches of points."""

    def __init__(self, regions: np.ndarray, corners: np.ndarray) -> None:
        """corners: an array of triangles x (ax, ay, bx, by, cx, cy)."""
        middle = (corners[:, 0::2].mean(axis=1), corners[:, 1::2].mean(axis=1))
        # Equal shares along x, then along y within each, keep the leaves compact.
        slices = max(1, math.ceil(math.sqrt(len(corners) / LEAF_TRIANGLES)))
        column = np.argsort(np.argsort(middle[0], kind="stable"), kind="stable") * slices // max(1, len(corners))
        order = np.lexsort((middle[1], column))
        self.regions, self.corners = regions[order], corners[order]
        x, y = self.corners[:, 0::2], self.corners[:, 1::2]
        self.boxes = np.stack([x.min(axis=1), y.min(axis=1), x.max(axis=1), y.max(axis=1)], axis=1)
        self.levels = []
        boxes = self.boxes
        while len(boxes) > 1 or not self.levels:
            starts = np.arange(0, len(boxes), LEAF_TRIANGLES)
            lows, highs = np.minimum.reduceat(boxes[:, :2], starts), np.maximum.reduceat(boxes[:, 2:], starts)
            self.levels.append((np.concatenate([lows, highs], axis=1), len(boxes)))
            boxes = self.levels[-1][0]
        self.box = boxes[0]

    def find(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of points and regions of all hits, borders included; shared borders of a region's triangles give one hit."""

        def within(points: np.ndarray, boxes: np.ndarray) -> np.ndarray:
            return (x[points] >= boxes[:, 0]) & (y[points] >= boxes[:, 1]) & (x[points] <= boxes[:, 2]) & (y[points] <= boxes[:, 3])

        points, nodes = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        for boxes, below in reversed(self.levels):
            ok = within(points, boxes[nodes])
            points, nodes = points[ok], nodes[ok]
            first = nodes * LEAF_TRIANGLES
            count = np.minimum(first + LEAF_TRIANGLES, below) - first
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            points, nodes = np.repeat(points, count), np.repeat(first, count) + at
        ok = within(points, self.boxes[nodes])
        points, nodes = points[ok], nodes[ok]
        t, px, py = self.corners[nodes], x[points], y[points]
        sides = []
        for a, b in ((0, 2), (2, 4), (4, 0)):
            # The same sum for an edge, whichever triangle it belongs to: no point slips between two triangles.
            swap = (t[:, a] > t[:, b]) | ((t[:, a] == t[:, b]) & (t[:, a + 1] > t[:, b + 1]))
            ax, ay = np.where(swap, t[:, b], t[:, a]), np.where(swap, t[:, b + 1], t[:, a + 1])
            bx, by = np.where(swap, t[:, a], t[:, b]), np.where(swap, t[:, a + 1], t[:, b + 1])
            side = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
            sides.append(np.where(swap, -side, side))
        ok = ((sides[0] >= 0) & (sides[1] >= 0) & (sides[2] >= 0)) | ((sides[0] <= 0) & (sides[1] <= 0) & (sides[2] <= 0))
        hits = pd.DataFrame({"p": points[ok], "r": self.regions[nodes[ok]]}).drop_duplicates()
        return hits["p"].to_numpy(), hits["r"].to_numpy()


def _covered(level: Column, low: Column, high: Column, size: float) -> Column:
    """The cells of a level, by number, that a stretch touches; two or three for its own level."""
    width = F.lit(size) / F.pow(F.lit(2.0), level)
    return F.sequence(F.floor(low / width), F.floor(high / width))


def _dealt(points: DataFrame, parts: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Points (key, lat, lon) and triangles (region, ax .. cy) under common cells: (cell, share) and their columns.

    A triangle goes to the level of cells whose sides are at least as long as its own, so to few cells; a point to its cell of each level that there
    is. Cells with more points or triangles than a block are dealt into shares: each point and triangle of the cell meet in exactly one.
    """
    west, east = F.least("ax", "bx", "cx"), F.greatest("ax", "bx", "cx")
    south, north = F.least("ay", "by", "cy"), F.greatest("ay", "by", "cy")
    side = F.greatest(east - west, north - south, F.lit(WIDEST_CELL / 2**MOST_LEVELS))
    level = F.greatest(F.lit(0), F.floor(F.log2(F.lit(WIDEST_CELL) / side))).cast("int")
    placed = parts.select("*", level.alias("level"), west.alias("w"), east.alias("e"), south.alias("s"), north.alias("n"))
    placed = placed.withColumn("cx_", F.explode(_covered(F.col("level"), F.col("w"), F.col("e"), WIDEST_CELL))).withColumn("cy_", F.explode(_covered(F.col("level"), F.col("s"), F.col("n"), WIDEST_CELL)))
    placed = cut(placed.select(F.struct("level", F.col("cx_").alias("x"), F.col("cy_").alias("y")).alias("cell"), "region", "ax", "ay", "bx", "by", "cx", "cy"))
    levels = [r["level"] for r in placed.select("cell.level").distinct().collect()]  # MOST_LEVELS + 1 at most
    # Rings may go on beyond the 180th meridian; points are looked up there as well.
    turned = points.select("key", "lat", F.explode(F.array("lon", F.col("lon") + 360)).alias("lon"))
    at = lambda v: F.floor(F.col(v) * F.pow(F.lit(2.0), F.col("level")) / F.lit(WIDEST_CELL))
    sent = turned.withColumn("level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).select("key", "lat", "lon", F.struct("level", at("lon").alias("x"), at("lat").alias("y")).alias("cell"))
    crowds = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("triangles"))
    crowds = crowds.join(sent.groupBy("cell").agg(F.count(F.lit(1)).alias("points")), "cell")
    crowds = cut(crowds.select("cell", F.ceil(F.col("triangles") / block).cast("int").alias("t"), F.ceil(F.col("points") / (10 * block)).cast("int").alias("p")))
    crowds = broadcast_if_small(crowds)
    mine = lambda n, *of: F.pmod(F.xxhash64(*of), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sent = sent.join(crowds, "cell").select("cell", mine("p", "key").alias("p"), all_of("t").alias("t"), "key", "lat", "lon")
    placed = placed.join(crowds, "cell").select("cell", all_of("p").alias("p"), mine("t", "region", "ax", "ay", "bx", "by").alias("t"), "region", "ax", "ay", "bx", "by", "cx", "cy")
    return sent, placed


def points_in_regions(points: DataFrame, key: str, lat: str, lon: str, regions: DataFrame, region: str, ring: str, block: int = BLOCK_TRIANGLES) -> DataFrame:
    """(key, region): each point with every region whose ring contains it or passes through it, each pair once.

    Rings are arrays of structs (x, y) of a simple polygon, x from -180 to 540: where a ring goes beyond the 180th meridian, points on
    the other side are looked up 360 degrees on. Null keys, unknown positions and null or empty rings give nothing, repeated rows count once, a
    region with several rings counts as their union; empty tables give an empty one. Other columns, whatever their names, play no part.
    At most so many triangles (block) are sent to the executors; more meet the points in cells, and each task builds the hierarchy of its own.
    """
    key_kind, region_kind = points.schema[key].dataType.simpleString(), regions.schema[region].dataType.simpleString()
    wanted = points.select(F.col(key).alias("key"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    wanted = wanted.where(F.col("key").isNotNull() & known_position(F.col("lat"), F.col("lon")))
    parts = cut(triangles(regions, region, ring))
    schema, corners, spark = f"key {key_kind}, region {region_kind}", ("ax", "ay", "bx", "by", "cx", "cy"), points.sparkSession

    def found(tree: Hierarchy, keys: pa.Array, y: np.ndarray, x: np.ndarray, shifts: tuple[float, ...]) -> pa.RecordBatch:
        hits = [tree.find(x + shift, y) for shift in shifts]
        places = np.concatenate([p for p, _ in hits])
        return pa.RecordBatch.from_arrays([keys.take(pa.array(places)), pa.array(np.concatenate([r for _, r in hits]))], names=["key", "region"])

    if small(parts, block):
        rows = parts.select("region", *corners).toArrow()
        if not rows.num_rows:
            return spark.createDataFrame([], schema)
        tree = Hierarchy(rows.column("region").to_numpy(), np.stack([rows.column(c).to_numpy() for c in corners], axis=1))
        sent = spark.sparkContext.broadcast(tree)

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield found(sent.value, batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy(), (0.0, 360.0) if sent.value.box[2] > 180 else (0.0,))

        west, south, east, north = (float(v) for v in tree.box)
        near = F.col("lat").between(south, north) & (F.col("lon").between(west, east) | F.lit(east > 180) & (F.col("lon") + 360).between(west, east))
        return wanted.where(near).mapInArrow(look_up, schema).distinct()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's triangles come first and become its hierarchy; then its points."""
        held: list[pa.RecordBatch] = []
        tree = None
        for batch in batches:
            is_point = batch.column(0).to_numpy(zero_copy_only=False)
            first = int(np.searchsorted(is_point, True))
            if first:
                held.append(batch.slice(0, first))
            rest = batch.slice(first)
            if rest.num_rows and held:
                if tree is None:
                    rows = pa.Table.from_batches(held)
                    tree = Hierarchy(rows.column("region").to_numpy(), np.stack([rows.column(c).to_numpy() for c in corners], axis=1))
                yield found(tree, rest.column(1), rest.column("ay").to_numpy(), rest.column("ax").to_numpy(), (0.0,))

    sent, placed = _dealt(wanted, parts.select("region", *corners), block)
    none = lambda kind: F.lit(None).cast(kind)
    both = sent.select("cell", "p", "t", F.lit(True).alias("point"), "key", none(region_kind).alias("region"), F.col("lon").alias("ax"), F.col("lat").alias("ay"), *[none("double").alias(c) for c in corners[2:]])
    both = both.unionByName(placed.select("cell", "p", "t", F.lit(False).alias("point"), none(key_kind).alias("key"), "region", *corners))
    both = both.repartition("cell", "p", "t").sortWithinPartitions("point").select("point", "key", "region", *corners)
    return both.mapInArrow(meet, schema).distinct()
