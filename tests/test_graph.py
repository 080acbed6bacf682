import heapq
import random

import pytest
from pyspark.sql import functions as F

from cartalog.operators import graph


def dijkstra(edges, src):
    out, best = {}, {src: 0}
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
    heap = [(0, src)]
    while heap:
        d, v = heapq.heappop(heap)
        if d > best[v]:
            continue
        for u, w in out.get(v, ()):
            if d + w < best.get(u, 1 << 60):
                best[u] = d + w
                heapq.heappush(heap, (d + w, u))
    return best


@pytest.fixture(scope="module")
def network(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(40), rng.randrange(40), rng.randint(1, 50)) for _ in range(130)]
    edges += [(a, b, w + 5) for a, b, w in edges[:20]]
    edges = [e for e in edges if e[0] != e[1]]
    return edges, spark.createDataFrame([(a, b, w, k) for k, (a, b, w) in enumerate(edges)], "startid bigint, endid bigint, cost int, origid bigint")


def test_distances(spark, network):
    edges, df = network
    got = {r["verid"]: r["dist"] for r in graph.distances(df, spark.createDataFrame([(1, 3)], "source int, verid bigint")).collect()}
    assert got == dijkstra(edges, 3)
    near = {r["verid"]: r["dist"] for r in graph.distances(df, spark.createDataFrame([(1, 3)], "source int, verid bigint"), most=40).collect()}
    assert near == {v: d for v, d in got.items() if d <= 40}


def test_routes_three_ways(spark, network):
    edges, df = network
    rng = random.Random(7)
    pairs = [(k, rng.randrange(40), rng.randrange(40)) for k in range(12)] + [(99, 1, 77), (100, 4, 4)]
    requests = spark.createDataFrame(pairs, "pair int, src bigint, dst bigint")
    want = {p: dijkstra(edges, s).get(d) for p, s, d in pairs}
    cost = {}
    for a, b, w in edges:
        cost[a, b] = min(w, cost.get((a, b), w))
    rows = graph.routes(df, requests).collect()
    assert {r["pair"]: r["dist"] for r in rows} == want
    for r in rows:
        assert r["dist"] is None and r["path"] == [] or sum(cost[s] for s in zip(r["path"], r["path"][1:], strict=False)) == r["dist"]
    reached = graph.distances(df, requests.where("pair < 4").select(F.col("pair").alias("source"), F.col("src").alias("verid")))
    for r in graph.unrolled(reached, requests.where("pair < 4")).collect():
        assert r["dist"] == want[r["pair"]] and sum(cost[s] for s in zip(r["path"], r["path"][1:], strict=False)) == (r["dist"] or 0)
    met = {r["pair"]: r["dist"] for r in graph.meeting_distances(df, requests.where("pair < 3")).collect()}
    assert met == {p: d for p, d in want.items() if p < 3 and d is not None}


def test_contraction_keeps_distances(spark, network):
    edges, df = network
    gone = [v for v in (2, 5, 9, 30) if not any({a, b} <= {2, 5, 9, 30} for a, b, _ in edges)] or [2]
    small = [(r["startid"], r["endid"], r["cost"]) for r in graph.contract(df, spark.createDataFrame([(v,) for v in gone], "verid bigint")).collect()]
    a, b = dijkstra(edges, 3), dijkstra(small, 3)
    assert {v: d for v, d in a.items() if v not in gone} == b


def turn_aware(segs, no, only, src, dst):
    """Least cost over states of point and way come by, so that every turn can be looked at."""
    moves, limited = {}, {x[2] for x in no} | {x[1] for x in only}
    # Stretches are split in the middle at points with restrictions; whoever turns round there comes back by the same way.
    parts = [(way, *ends, w // 2, oneway) for way, a, b, w, oneway in segs if {a, b} & limited for ends in ((a, (way, "mid")), ((way, "mid"), b))]
    for way, a, b, w, oneway in parts + [s for s in segs if not {s[1], s[2]} & limited]:
        moves.setdefault(a, []).append((b, w, way))
        if not oneway:
            moves.setdefault(b, []).append((a, w, way))
    heap, done, k = [(0, 0, src, None, None)], set(), 0
    while heap:
        d, _, v, came, last = heapq.heappop(heap)
        if v == dst:
            return d
        if (v, came, last) in done:
            continue
        done.add((v, came, last))
        for u, w, way in moves.get(v, ()):
            turned = came is not None and ((came, way, v) in no or ((came, v) in only and way not in only[came, v]))
            # Over a restricted point nobody turns back into the same stretch of road.
            if turned or (came is not None and v in limited and (way, u) == (came, last)):
                continue
            k += 1
            heapq.heappush(heap, (d + w, k, u, way, v))
    return None


def test_paths_obey_turn_restrictions(spark):
    rng = random.Random(31)
    places = {v: (50 + rng.random() / 20, 8 + rng.random() / 20) for v in range(40)}
    ways = {}
    for w in range(60):
        ways[w] = rng.sample(range(40), 2)
    segs = [(w, a, b, 2 * rng.randint(20, 400), rng.random() < 0.3) for w, (a, b) in ways.items()]
    seen, kept = set(), []
    for s in segs:
        if frozenset(s[1:3]) not in seen:
            kept.append(s)
            seen.add(frozenset(s[1:3]))
    segs = kept
    turns = []
    for _ in range(60):
        v = rng.choice([3, 7, 11, 19, 23, 30])
        near = [s[0] for s in segs if v in s[1:3]]
        if len(near) > 1:
            a, b = rng.sample(near, 2)
            turns.append((a, b, v, rng.choice(["no_left_turn", "no_left_turn", "only_straight_on"])))
    no = {(a, b, v) for a, b, v, k in turns if k.startswith("no")}
    only = {}
    for a, b, v, k in turns:
        if k.startswith("only"):
            only.setdefault((a, v), set()).add(b)
    df = spark.createDataFrame([(w, 1, a, b, c, 1, b, a, c, c, c // 10, 0, o) for w, a, b, c, o in segs], "wayid bigint, segment bigint, startid bigint, endid bigint, cost int, hops int, second bigint, before bigint, first int, last int, timecost int, type int, oneway boolean")
    restrictions = spark.createDataFrame(turns, "edgefrom bigint, edgeto bigint, vervia bigint, type string")
    vertex = spark.createDataFrame([(v, *p) for v, p in places.items()], "verid bigint, lat double, lon double")
    edges, points, arrivals = graph.restricted_graph(df, restrictions, vertex)
    arrive = {r["verid"]: r["arrival"] for r in arrivals.collect()}
    new = [r["verid"] for r in points.collect()]
    assert set(arrive) == {v for _, _, v, _ in turns} and min(new) == 40 and len(set(new)) == len(new)
    pairs = [(k, rng.randrange(40), rng.randrange(40)) for k in range(60)]
    pairs = [(k, a, b) for k, a, b in pairs if a != b]
    got = {r["pair"]: r["dist"] for r in graph.routes(edges, spark.createDataFrame([(k, a, arrive.get(b, b)) for k, a, b in pairs], "pair int, src bigint, dst bigint")).collect()}
    want = {k: turn_aware(segs, no, only, a, b) for k, a, b in pairs}
    assert got == want
    assert any(want[k] != turn_aware(segs, set(), {}, a, b) for k, a, b in pairs)
    # Without restrictions nothing changes.
    plain, none, _ = graph.restricted_graph(df, restrictions.limit(0), vertex)
    assert none.count() == 0 and plain.count() == sum(1 if s[4] else 2 for s in segs)


def test_repeated_pairs_of_ends_get_a_point_between(spark):
    way = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 1), (2, 1, 4), (2, 2, 3), (3, 0, 5), (3, 1, 6), (3, 2, 7), (3, 3, 5), (4, 0, 8), (4, 1, 9)], "wayid int, pos int, verid int")
    vertex = spark.createDataFrame([(v, 50 + v / 100, 8 + v / 70) for v in range(1, 10)], "verid int, lat double, lon double")
    ends = graph.endpoints(way)
    repaired = graph.repaired_ends(way, vertex, ends)
    assert {r[0] for r in repaired.collect()} == {r[0] for r in ends.collect()} | {2, 4, 6, 7}
    assert graph.repeated_pairs(graph.segments(way, vertex, repaired)).count() == 0
