from cartalog.operators.tiles import assemble, build_polygons, clip_ring, simplify


def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]


def test_polygons_with_holes_and_islands():
    outer, hole, island, other = square(0, 0, 10), square(2, 2, 6), square(4, 4, 2), square(20, 0, 3)
    parts = [outer[:3], outer[2:][::-1], hole, island, other[:2], other[1:4], other[3:], [(50, 50), (51, 51)]]
    polygons = assemble([list(p) for p in parts])
    assert sorted(len(p) for p in polygons) == [1, 1, 2]
    assert sorted(abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1], strict=True))) / 2 for p in polygons for r in p) == [4, 9, 36, 100]


def test_simplify_and_clip():
    assert simplify([(0, 0), (1, 0.01), (2, 0), (3, 5), (4, 0)], 0.1) == [(0, 0), (2, 0), (3, 5), (4, 0)]
    assert sorted(clip_ring([(0, 0), (4, 0), (4, 4), (0, 4)], 1, 1, 9, 2)) == [(1, 1), (1, 2), (4, 1), (4, 2)]
    assert clip_ring([(0, 0), (1, 0), (1, 1)], 5, 5, 6, 6) == []


def test_build_polygons(spark):
    lines = [(1, [{"lat": float(y), "lon": float(x)} for x, y in square(0, 0, 4)[:3]]), (1, [{"lat": float(y), "lon": float(x)} for x, y in square(0, 0, 4)[2:]])]
    row = build_polygons(spark.createDataFrame(lines, "relid bigint, line array<struct<lat:double,lon:double>>")).first()
    assert row["relid"] == 1 and len(row["polygons"]) == 1 and len(row["polygons"][0][0]) == 4
