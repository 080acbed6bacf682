"""What is shuffled follows the tables, not the pairs of their rows."""

import random
import time

from cartalog.operators import graph, spatial
from tests.test_proximity import metres


def shuffled(spark, run):
    """MB written for shuffles while run() is made and counted; what it gives."""
    status = spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        time.sleep(0.3)
        return status.executorList(True).apply(0).totalShuffleWrite() / 1e6

    before = written()
    rows = run()
    return written() - before, rows


def test_reverse_geocode_of_a_crowd(spark):
    rng = random.Random(12)
    kinds = {"addr:country": 50_000, "addr:city": 1_000, "addr:street": 50}
    objects = [(k, list(kinds)[k % 3], f"v{k % 7}", 45 + rng.random(), 6 + rng.random()) for k in range(3_000)]
    objects += [(5_000, "addr:city", "pole", 89.9999, 10.0), (5_001, "addr:street", "east", 0.0, 180.0), (5_002, "addr:city", "far", 45.5, 40.0), (5_003, "addr:city", "none", None, 1.0), (5_004, "name", "no", 45.5, 6.5)]
    targets = [(k, 45 + rng.random(), 6 + rng.random()) for k in range(1_000)] + [(2_000, 89.9999, -170.0), (2_001, 0.0, -179.9999), (2_002, None, 1.0), (2_003, 45.501, 6.5), (2_004, 46.4, 6.5)]
    table = spark.createDataFrame(objects, "objectid int, key string, value string, lat double, lon double")
    asked = spark.createDataFrame(targets, "target int, tlat double, tlon double")
    mb, rows = shuffled(spark, lambda: spatial.reverse_geocode(table.select("objectid", "key", "value"), table.select("objectid", "lat", "lon"), asked).collect())
    some = [t for t in targets if t[0] % 20 == 0 or t[0] >= 2_000]
    want = {}
    for target, la, lo in some:
        for k, key, value, lat, lon in objects:
            if la is not None and lat is not None and key in kinds and (d := metres((lat, lon), (la, lo))) <= kinds[key]:
                want[target, key[5:]] = min(want.get((target, key[5:]), (d, k, value)), (d, k, value))
    got = {(r["target"], r["area"]): r["value"] for r in rows if r["target"] % 20 == 0 or r["target"] >= 2_000}
    assert got == {k: v[2] for k, v in want.items()}
    assert {(2_000, "city"), (2_001, "street")} <= set(want) and mb < 5


def test_turns_at_crowded_points(spark):
    rng = random.Random(9)
    ways = {v: list(range(60 * v, 60 * v + 60)) for v in range(60)}
    halves = [(v, 10_000 + w, w, w % 50) for v, own in ways.items() for w in own] + [(0, 7, None, 3)]
    kinds = {"no_left_turn": 40, "only_straight_on": 8, "stop": 5}
    rules = [(rng.choice(own), rng.choice(own), v, kind) for v, own in ways.items() for kind, n in kinds.items() for _ in range(n)]
    rules += [*rules[:9], (3, None, 0, "only_straight_on"), (4, None, 0, "no_left_turn"), (None, 5, 0, "no_left_turn"), (5, 6, None, "no_left_turn")]
    half = spark.createDataFrame(halves, "verid bigint, node bigint, wayid bigint, cost int").selectExpr("*", "0 AS type")
    turns = spark.createDataFrame(rules, "edgefrom bigint, edgeto bigint, vervia bigint, type string")
    mb, rows = shuffled(spark, lambda: graph.turn_shortcuts(half, half, turns).select("startid", "endid", "via", "cost", "origid").collect())
    no, only = {x[:3] for x in rules if x[3][:2] == "no"}, {x[:3] for x in rules if x[3][:4] == "only"}
    limited, at = {(a, v) for a, _, v in only}, {}
    for h in halves:
        at.setdefault(h[0], []).append(h)
    want = [
        (a[1], b[1], v, a[3] + b[3], a[2] if a[2] is not None and a[2] == b[2] else -1)
        for v, own in at.items() for a in own for b in own
        if a[1] != b[1] and (None in (a[2], b[2]) or (a[2], b[2], v) not in no) and ((a[2], v) not in limited or (b[2] is not None and (a[2], b[2], v) in only))
    ]
    assert sorted(map(tuple, rows)) == sorted(want) and mb < 1


def test_new_points_are_numbered_without_shuffles(spark):
    """However far apart the ways' numbers lie; edges and points agree on the numbers, also between runs."""
    rng = random.Random(4)
    vertex = spark.createDataFrame([(v, 50 + v / 9_000, 8.0) for v in range(1_000)], "verid bigint, lat double, lon double")
    ends = [rng.sample(range(1_000), 2) for _ in range(3_000)]
    ends += [(b, a) if k % 4 else (a, b) for k, (a, b) in enumerate(ends[:1_000])]
    turns = spark.createDataFrame([(1, 2, v, "no_left_turn") for v in range(0, 1_000, 2)], "edgefrom bigint, edgeto bigint, vervia bigint, type string")
    for far in (1, (1 << 62) // 2_000):
        rows = [((k - 2_000) * far, 1 + k % 3, a, b, 20, 1 + k % 2, b, a, 20, 20, 2, 0, k % 3 > 0) for k, (a, b) in enumerate(ends)]
        segs = spark.createDataFrame(rows, "wayid bigint, segment bigint, startid bigint, endid bigint, cost int, hops int, second bigint, before bigint, first int, last int, timecost int, type int, oneway boolean")
        mb, (edges, points, arrivals) = shuffled(spark, lambda: graph.restricted_graph(segs, turns, vertex))  # noqa: B023
        new = [r["verid"] for r in points.collect()]
        split = sum((a % 2 == 0) + (b % 2 == 0) - (a % 2 == b % 2 == 0 and h == 1) for _, _, a, b, _, h, *_ in rows)
        assert len(set(new)) == len(new) == split + 500 and min(new) == 1_000 and arrivals.count() == 500
        found = [tuple(r) for r in edges.select("startid", "endid", "type").collect()]
        assert {x for r in found for x in r[:2]} <= set(range(1_000)) | set(new) and max(r[2] for r in found) < 32
        # Two edges have the same ends nowhere, though turns over either end of two lone hops lead between the same middles.
        assert len({r[:2] for r in found}) == len(found) > 4_000
        again = graph.restricted_graph(segs.repartition(3), turns, vertex)[1]
        assert {tuple(r) for r in points.collect()} == {tuple(r) for r in again.collect()}
        assert far > 1 or mb < 0.4
