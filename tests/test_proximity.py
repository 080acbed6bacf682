import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartalog.functions.geo import EARTH_RADIUS
from cartalog.operators.proximity import Hierarchy, box_ring, ear_clip, near_pairs, points_in_regions


def metres(a, b):
    (la, lo), (lb, mo) = a, b
    h = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(mo - lo) / 2) ** 2
    return 2 * EARTH_RADIUS * math.asin(math.sqrt(min(1, h)))


@pytest.mark.parametrize("limit", [30.0, 2_000.0, 900_000.0])
def test_near_pairs_everywhere(spark, limit):
    rng = random.Random(5)
    spots = [(0, 0), (51, 7), (84, 180), (89.9999, 10), (90, 0), (-90, 77), (-89.9999, -170), (-50, -180), (12, 179.9999)]
    step = math.degrees(limit / EARTH_RADIUS)
    points = []
    for lat, lon in spots:
        for _ in range(14):
            la = max(-90, min(90, lat + rng.uniform(-step, step)))
            lo = lon + rng.uniform(-1, 1) * min(180, step / max(1e-6, math.cos(math.radians(la))))
            points.append((la, (lo + 180) % 360 - 180))
    rows = [(k, float(la), float(lo)) for k, (la, lo) in enumerate(points)]
    df = spark.createDataFrame([*rows, rows[0], (900, None, 1.0), (901, 361.0, 361.0), (902, float("nan"), 1.0), (None, 0.0, 0.0)], "verid int, lat double, lon double")
    want = {(i, j) for i in range(len(points)) for j in range(i + 1, len(points)) if metres(points[i], points[j]) <= limit}
    assert {tuple(r) for r in near_pairs(df, "verid", "lat", "lon", limit).collect()} == want
    assert want


def test_ear_clip_fills_polygons():
    star = [(math.cos(k * math.pi / 8) * (3 if k % 2 else 1), math.sin(k * math.pi / 8) * (3 if k % 2 else 1)) for k in range(16)]
    for ring in (star, star[::-1], [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], [(0, 0), (1, 0), (2, 0), (2, 2), (0, 2)]):
        area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2
        parts = ear_clip(list(ring))
        assert len(parts) == len(ring) - 2
        total = sum(abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) / 2 for a, b, c in parts)
        assert total == pytest.approx(area)


def test_hierarchy_against_plain_boxes():
    rng = np.random.default_rng(3)
    low = rng.uniform(-5, 5, (300, 2))
    high = low + rng.uniform(0, 2, (300, 2))
    corners, ids = [], []
    for k, ((x0, y0), (x1, y1)) in enumerate(zip(low, high, strict=True)):
        for t in ear_clip([(x0, y0), (x1, y0), (x1, y1), (x0, y1)]):
            corners.append([v for p in t for v in p])
            ids.append(k)
    x, y = np.concatenate([rng.uniform(-6, 7, 2000), low[:, 0], (low[:, 0] + high[:, 0]) / 2]), np.concatenate([rng.uniform(-6, 7, 2000), low[:, 1], (low[:, 1] + high[:, 1]) / 2])
    p, r = Hierarchy(np.array(ids), np.array(corners)).find(x, y)
    want = {(i, k) for k in range(300) for i in np.flatnonzero((x >= low[k, 0]) & (x <= high[k, 0]) & (y >= low[k, 1]) & (y <= high[k, 1]))}
    assert set(zip(p.tolist(), r.tolist(), strict=True)) == want and len(p) == len(want)


def test_regions_cross_the_meridian(spark):
    areas = spark.createDataFrame([(1, 1.0, 179.0, -1.0, -179.0), (2, 5.0, 10.0, 6.0, 9.0), (3, None, 1.0, 2.0, 3.0), (4, 361.0, 361.0, 0.0, 0.0), (2, 5.0, 10.0, 6.0, 9.0), (5, 8.0, 8.0, 8.0, 9.0)], "id int, a double, b double, c double, d double")
    areas = areas.withColumn("ring", box_ring(*map(F.col, "abcd"))).withColumn("lat", F.lit(0.0))
    points = spark.createDataFrame([(1, 0.0, 180.0), (2, 0.0, -180.0), (3, 0.0, 178.9), (4, 5.5, 9.5), (5, 5.0, 9.0), (6, 5.5, 10.1), (7, None, 0.0), (4, 5.5, 9.5), (8, 0.5, -179.5), (9, 8.0, 8.5), (10, 8.0, 9.5)], "verid int, lat double, lon double")
    want = {(1, 1), (2, 1), (8, 1), (4, 2), (5, 2), (9, 5)}
    for block in (1, 1000):
        assert {tuple(r) for r in points_in_regions(points, "verid", "lat", "lon", areas, "id", "ring", block=block).collect()} == want
    assert points_in_regions(points, "verid", "lat", "lon", areas.limit(0), "id", "ring").count() == 0
    assert points_in_regions(points.limit(0), "verid", "lat", "lon", areas, "id", "ring").count() == 0
    assert near_pairs(points.limit(0), "verid", "lat", "lon", 10.0).count() == 0


def star(rng, x, y, corners, size):
    """A concave ring around a place."""
    return [(x + size * r * math.cos(2 * math.pi * k / corners), y + size * r * math.sin(2 * math.pi * k / corners)) for k in range(corners) for r in [rng.uniform(0.2, 1)]]


def odd_crossings(ring, px, py):
    return sum((a[1] > py) != (b[1] > py) and px < (b[0] - a[0]) * (py - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) % 2 == 1


def test_concave_rings_of_all_sizes(spark):
    rng = random.Random(17)
    rings = {k: star(rng, rng.uniform(-30, 30), rng.uniform(-30, 30), rng.randint(5, 60), rng.choice([0.01, 0.5, 4, 30])) for k in range(40)}
    points = {k: (rng.uniform(-40, 40), rng.uniform(-40, 40)) for k in range(600)} | {600 + k: (ring[0][1] * 0.5 + ring[2][1] * 0.5, ring[0][0] * 0.5 + ring[2][0] * 0.5) for k, ring in rings.items()}
    want = {(p, k) for p, (lat, lon) in points.items() for k, ring in rings.items() if odd_crossings(ring, lon, lat)}
    areas = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in ring]) for k, ring in rings.items()], "id int, ring array<struct<x:double,y:double>>")
    df = spark.createDataFrame([(k, lat, lon) for k, (lat, lon) in points.items()], "verid int, lat double, lon double")
    for block in (7, 100_000):
        assert {tuple(r) for r in points_in_regions(df, "verid", "lat", "lon", areas, "id", "ring", block=block).collect()} == want
    assert len(want) > 100


def test_many_corners_are_clipped_fast():
    rng = random.Random(23)
    for ring in (star(rng, 0, 0, 6_000, 5), [(k, 1 + k % 2) for k in range(4_000)] + [(3_999, 0), (0, 0)]):
        began = time.perf_counter()
        parts = ear_clip(ring)
        assert time.perf_counter() - began < 20
        area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2
        assert len(parts) == len(ring) - 2
        assert sum(abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) / 2 for a, b, c in parts) == pytest.approx(area)
    # A ring that crosses itself still ends.
    assert len(ear_clip([(0, 0), (2, 2), (2, 0), (0, 2)])) == 2
