"""Ways to a routable graph, shortest paths by rounds of joins, and paths back to ways."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartalog.functions import tags
from cartalog.functions.geo import haversine
from cartalog.functions.metres import whole_metres
from cartalog.session import broadcast_if_small, cut

#: Bits of an edge's type.
GEOMETRY_STORED, ONE_WAY, PREPROCESSED, TURN_RESTRICTED, FINAL = 1, 2, 4, 8, 16
#: A bit that no edge keeps: another edge may have the same ends.
TWIN = 1 << 30
#: Edges that a search request may collect into one task at most.
TASK_EDGES = 500_000


def endpoints(way: DataFrame) -> DataFrame:
    """(verid): ends of ways, and points that ways pass more than once between them; way: (wayid, pos, verid)."""
    ends = way.groupBy("wayid").agg(F.min_by("verid", "pos").alias("a"), F.max_by("verid", "pos").alias("b")).select(F.explode(F.array("a", "b")).alias("verid"))
    crossed = way.groupBy("verid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("verid")
    return ends.unionByName(crossed).distinct()


def repeated_pairs(segments: DataFrame) -> DataFrame:
    """Segments whose pair of ends, in either direction, comes more than once: (a, b, n)."""
    pair = segments.select(F.least("startid", "endid").alias("a"), F.greatest("startid", "endid").alias("b"))
    return pair.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def known_stretches(way: DataFrame, vertex: DataFrame) -> DataFrame:
    """(wayid, pos, verid, lat, lon): points of ways whose place is known, where two in a row are."""
    placed = way.join(vertex, "verid")
    w = Window.partitionBy("wayid").orderBy("pos")
    near = placed.withColumn("_before", F.lag("pos").over(w)).withColumn("_after", F.lead("pos").over(w))
    return near.where((F.col("_before") == F.col("pos") - 1) | (F.col("_after") == F.col("pos") + 1)).drop("_before", "_after")


def segments(way: DataFrame, vertex: DataFrame, ends: DataFrame, hops: bool = False) -> DataFrame:
    """(wayid, segment, startid, endid, cost, hops): ways cut at endpoints, cost the sum of whole metres per hop.

    way: (wayid, pos, verid). Running sums within a way number the segments; a point between two is the end of one and the start of the next.
    With hops, loops are kept, and columns tell the first and last hop: second and before, the points next to the ends, first and last, the
    metres, and endpos, where on the way the segment ends.
    """
    placed = way.join(vertex, "verid").join(ends.select("verid", F.lit(1).alias("is_end")), "verid", "left")
    w = Window.partitionBy("wayid").orderBy("pos")
    hop = placed.select(
        "wayid", "pos", "verid", "lat", "lon", F.coalesce("is_end", F.lit(0)).alias("is_end"),
        F.lead("verid").over(w).alias("next"), F.lead("lat").over(w).alias("nlat"), F.lead("lon").over(w).alias("nlon"), F.lead("pos").over(w).alias("npos"),
    ).withColumn("segment", F.sum("is_end").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hop = hop.where((F.col("npos") == F.col("pos") + 1) & (F.col("verid") != F.col("next")))
    metres = F.floor(haversine(F.col("lat"), F.col("lon"), F.col("nlat"), F.col("nlon")))
    cut_up = hop.groupBy("wayid", "segment").agg(F.min_by("verid", "pos").alias("startid"), F.max_by("next", "pos").alias("endid"), F.sum(metres).cast("int").alias("cost"), F.count(F.lit(1)).cast("int").alias("hops"),
        *([F.min_by("next", "pos").alias("second"), F.max_by("verid", "pos").alias("before"), F.min_by(metres, F.col("pos")).cast("int").alias("first"), F.max_by(metres, F.col("pos")).cast("int").alias("last"), F.max("npos").alias("endpos")] if hops else []),
    )
    return cut_up if hops else cut_up.where("startid <> endid")


def repaired_ends(way: DataFrame, vertex: DataFrame, ends: DataFrame) -> DataFrame:
    """(verid): endpoints, and points that keep two segments from having the same ends: the one before the end of every segment whose pair of ends
    comes more than once, or whose end the way has passed before, if the segment has a point between its ends; of a loop the one after its start too."""
    cut_up = cut(segments(way, vertex, ends, hops=True))
    pair = [F.least("startid", "endid").alias("a"), F.greatest("startid", "endid").alias("b")]
    passed = way.groupBy("wayid", F.col("verid").alias("endid")).agg(F.min("pos").alias("seen"))
    longer = cut_up.where("hops >= 2").select("*", *pair).join(repeated_pairs(cut_up), ["a", "b"], "left").join(passed, ["wayid", "endid"])
    extra = longer.where(F.col("n").isNotNull() | (F.col("seen") < F.col("endpos")))
    extra = extra.select(F.explode(F.when((F.col("startid") == F.col("endid")) & (F.col("hops") >= 3), F.array("second", "before")).otherwise(F.array("before"))).alias("verid"))
    return ends.unionByName(extra).distinct()


def travel_time(cost: Column, metres_per_second: Column) -> Column:
    """Whole seconds, by the speed taken once more from kilometres an hour; null without a speed."""
    return F.when(metres_per_second > 0, F.floor(cost / (metres_per_second * tags.KMH))).cast("int")


def both_directions(edges: DataFrame) -> DataFrame:
    """Edges, and those that are not one-way turned round as well; edges: (startid, endid, .., oneway)."""
    turned = edges.where(~F.col("oneway")).withColumn("_s", F.col("startid")).withColumn("startid", F.col("endid")).withColumn("endid", F.col("_s")).drop("_s")
    return edges.unionByName(turned)


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """One edge per start and end: the cheapest, then the smallest origin; loops are dropped."""
    others = [c for c in edges.columns if c not in ("startid", "endid")]
    rank = ["cost"] + (["origid"] if "origid" in others else []) + [c for c in others if c not in ("cost", "origid")]
    best = edges.where("startid <> endid").groupBy("startid", "endid").agg(F.min(F.struct(*rank)).alias("e"))
    return best.select("startid", "endid", *[F.col(f"e.{c}").alias(c) for c in others])


def degrees(edges: DataFrame) -> DataFrame:
    """(verid, degree): edges at each vertex, both directions."""
    return edges.select(F.explode(F.array("startid", "endid")).alias("verid")).groupBy("verid").agg(F.count(F.lit(1)).alias("degree"))


def turn_restrictions(members: DataFrame, vertex: DataFrame) -> DataFrame:
    """(edgefrom, edgeto, vervia, type) of relations (relid, type, role, ref), where both ways and a known via are there."""
    rows = members.groupBy("relid", "type").agg(F.max(F.when(F.col("role") == "from", F.col("ref"))).alias("edgefrom"), F.max(F.when(F.col("role") == "to", F.col("ref"))).alias("edgeto"), F.max(F.when(F.col("role") == "via", F.col("ref"))).alias("vervia"))
    whole = rows.where("edgefrom is not null and edgeto is not null and vervia is not null")
    return whole.join(vertex.select(F.col("verid").alias("vervia")), "vervia", "left_semi").select("edgefrom", "edgeto", "vervia", "type")


def turn_shortcuts(half_in: DataFrame, half_out: DataFrame, restrictions: DataFrame) -> DataFrame:
    """Edges over restricted points: each way in with each way out that no restriction forbids and every "only" allows.

    half_in, half_out: (verid, node, wayid, cost, type), node being the other end of the half edge; timecost is added up too where both have it.
    """
    kind = F.col("type")
    sums = ["cost"] + ["timecost"] * ("timecost" in half_in.columns and "timecost" in half_out.columns)
    # Of every way into a point the ways out that are forbidden, and those that alone are allowed: all joins are by points, and pairs are never shuffled.
    no, only = tags.is_no_turn(kind), tags.is_only_turn(kind)
    turns = restrictions.where(no | only).select(F.col("vervia").alias("verid"), F.col("edgefrom").alias("fw"), "edgeto", only.alias("only"))
    rules = turns.groupBy("verid", "fw").agg(F.collect_set(F.when(~F.col("only"), F.col("edgeto"))).alias("never"), F.collect_set(F.when(F.col("only"), F.col("edgeto"))).alias("allowed"), F.max("only").alias("limited"))
    a = half_in.select("verid", F.col("node").alias("startid"), F.col("wayid").alias("fw"), F.col("type").alias("t1"), *[F.col(c).alias(f"{c}_in") for c in sums])
    b = half_out.select("verid", F.col("node").alias("endid"), F.col("wayid").alias("tw"), F.col("type").alias("t2"), *[F.col(c).alias(f"{c}_out") for c in sums])
    # The way is compared as a range: with it as a key, rules and ways in would be shuffled by both.
    ruled = a.alias("a").join(rules.alias("r"), (F.col("a.verid") == F.col("r.verid")) & (F.col("a.fw") <= F.col("r.fw")) & (F.col("a.fw") >= F.col("r.fw")), "left").select("a.*", "never", "allowed", "limited")
    pairs = ruled.join(b, "verid").where("startid <> endid")
    has = lambda ways: F.coalesce(F.array_contains(ways, F.col("tw")), F.lit(False))
    pairs = pairs.where(~has("never") & (~F.coalesce("limited", F.lit(False)) | has("allowed")))
    bits = F.col("t1").bitwiseOR(F.col("t2")).bitwiseOR(TURN_RESTRICTED | FINAL).bitwiseAND(~GEOMETRY_STORED)
    return pairs.select("startid", "endid", F.col("verid").alias("via"), *[(F.col(f"{c}_in") + F.col(f"{c}_out")).alias(c) for c in sums], bits.alias("type"), F.when(F.col("fw") == F.col("tw"), F.col("fw")).otherwise(F.lit(-1)).alias("origid"))


def restricted_graph(segs: DataFrame, restrictions: DataFrame, vertex: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges (startid, endid, cost, timecost, type, origid, via) that obey turn restrictions, new points (verid, lat, lon), and arrivals (verid, arrival).

    segs: segments() with hops, and oneway, type, timecost, in the direction of travel. A segment is split in the middle of its hop at a restricted
    end, in the middle of its only hop if both ends are; the halves at the end become shortcuts over it, one for every turn allowed. A path may still
    begin at a restricted point, and end there at its arrival: routes() requests take arrival for dst where there is one. Restrictions that
    name the same turn twice count once; null ends and unknown points take no part.
    """
    at = restrictions.select(F.col("vervia").alias("verid")).where("verid is not null").distinct()
    mark = lambda end, name: at.select(F.col("verid").alias(end), F.lit(True).alias(name))
    marked = segs.where("startid <> endid").join(mark("startid", "_s"), "startid", "left").join(mark("endid", "_e"), "endid", "left")
    s, e = F.coalesce("_s", F.lit(False)), F.coalesce("_e", F.lit(False))
    marked = cut(marked.select("wayid", "segment", "startid", "endid", "second", "before", "cost", "timecost", "first", "last", "type", "oneway", s.alias("_s"), e.alias("_e"), (s & e & (F.col("hops") == 1)).alias("_one")))
    one = F.col("_one")
    # Numbers of new points follow from what they are made of, so that nothing is sorted or joined for them: arrivals first, then two for each segment.
    known = cut(at.join(vertex.select("verid"), "verid", "left_semi"))
    lowest, highest = known.agg(F.min("verid"), F.max("verid")).first()
    first_free = (vertex.agg(F.max("verid")).first()[0] or 0) + 1
    after = first_free + (highest - lowest + 1 if lowest is not None else 0)
    free, split = marked.where("not _s and not _e"), marked.where("_s or _e").withColumn("_w", F.col("wayid").cast("bigint"))
    way0, way1, number0, number1 = [x or 0 for x in split.agg(F.min("_w"), F.max("_w"), F.min("segment"), F.max("segment")).first()]
    if after + 2 * (number1 - number0 + 1) * (way1 - way0 + 1) >= 1 << 63:  # far apart as hashes are: the ways' ranks instead
        ranks = cut(split.select("wayid").distinct().withColumn("_w", F.row_number().over(Window.orderBy("wayid"))))
        way0, split = 1, split.drop("_w").join(ranks, "wayid")
    pair = F.lit(after).cast("bigint") + ((F.col("_w") - way0) * (number1 - number0 + 1) + F.col("segment") - number0) * 2
    split = split.select("*", F.when(F.col("_s"), pair).alias("n0"), F.when(one, pair).when(F.col("_e"), pair + 1).alias("m1"))
    arrivals = known.select("verid", (F.lit(first_free).cast("bigint") + F.col("verid") - (lowest or 0)).alias("arrival"))
    # Two edges over restricted points have the same ends only if both lead from and to the middle of a lone hop, between the same two points.
    hop = [F.least("startid", "endid").alias("_a"), F.greatest("startid", "endid").alias("_b")]
    twins = cut(split.where(one).groupBy(*hop).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_a", "_b", F.lit(TWIN).alias("_twin")))
    split = split.select("*", *hop).join(broadcast_if_small(twins), ["_a", "_b"], "left").withColumn("_twin", F.when(one, F.coalesce("_twin", F.lit(0))).otherwise(0))
    place = lambda end: vertex.select(F.col("verid").alias(end), F.col("lat").alias(f"{end}_lat"), F.col("lon").alias(f"{end}_lon"))
    made = lambda number, a, b: F.struct(F.col(number).alias("verid"), F.col(a).alias("a"), F.col(b).alias("b"))
    new = split.select(F.explode(F.filter(F.array(F.when(F.col("_s"), made("n0", "startid", "second")), F.when(F.col("_e") & ~one, made("m1", "before", "endid"))), lambda x: x.isNotNull())).alias("p")).select("p.*")
    new = new.unionByName(arrivals.select(F.col("arrival").alias("verid"), F.col("verid").alias("a"), F.col("verid").alias("b")))
    points = new.join(place("a"), "a").join(place("b"), "b").select("verid", ((F.col("a_lat") + F.col("b_lat")) / 2).alias("lat"), ((F.col("a_lon") + F.col("b_lon")) / 2).alias("lon"))
    c0 = F.when(F.col("_s"), F.floor(F.col("first") / 2)).otherwise(0)
    c1 = F.when(one, F.col("cost") - c0).when(F.col("_e"), F.floor(F.col("last") / 2)).otherwise(0)
    seconds = lambda metres: F.when(F.col("cost") > 0, F.floor(F.col("timecost").cast("bigint") * metres / F.col("cost"))).otherwise(0)
    split = split.select("*", c0.cast("int").alias("c0"), c1.cast("int").alias("c1"))
    split = split.select("*", seconds(F.col("c0")).cast("int").alias("t0"), F.when(one, F.col("timecost") - seconds(F.col("c0"))).otherwise(seconds(F.col("c1"))).cast("int").alias("t1"))
    start_half = split.where("_s").select(F.col("startid").alias("verid"), F.col("n0").alias("node"), "wayid", F.col("c0").alias("cost"), F.col("t0").alias("timecost"), (F.col("type").bitwiseOR(F.col("_twin"))).alias("type"), "oneway")
    end_half = split.where("_e").select(F.col("endid").alias("verid"), F.col("m1").alias("node"), "wayid", F.col("c1").alias("cost"), F.col("t1").alias("timecost"), (F.col("type").bitwiseOR(F.col("_twin"))).alias("type"), "oneway")
    half_out = start_half.unionByName(end_half.where("not oneway")).drop("oneway")
    half_in = end_half.unionByName(start_half.where("not oneway")).drop("oneway")
    inner = split.where(~one).select(
        F.when(F.col("_s"), F.col("n0")).otherwise(F.col("startid")).alias("startid"), F.when(F.col("_e"), F.col("m1")).otherwise(F.col("endid")).alias("endid"),
        (F.col("cost") - F.col("c0") - F.col("c1")).alias("cost"), (F.col("timecost") - F.col("t0") - F.col("t1")).alias("timecost"), F.col("type").bitwiseOR(F.lit(TURN_RESTRICTED)).alias("type"), F.col("wayid").alias("origid"), "oneway",
    )
    plain = free.select("startid", "endid", "cost", "timecost", "type", F.col("wayid").alias("origid"), "oneway")
    columns = ("startid", "endid", "cost", "timecost", "type", "origid", F.lit(None).cast("bigint").alias("via"))
    restricted = F.col("type").bitwiseAND(~TWIN).bitwiseOR(F.lit(TURN_RESTRICTED)).alias("type")
    leaving = half_out.select(F.col("verid").alias("startid"), F.col("node").alias("endid"), "cost", "timecost", restricted, F.col("wayid").alias("origid"))
    ending = half_in.join(arrivals, "verid").select(F.col("node").alias("startid"), F.col("arrival").alias("endid"), "cost", "timecost", restricted, F.col("wayid").alias("origid"))
    over = turn_shortcuts(half_in, half_out, restrictions).select(*columns[:-1], F.col("via").cast("bigint").alias("via"))
    bare = lambda edges: edges.withColumn("type", F.col("type").bitwiseAND(~TWIN))
    twin = F.col("type").bitwiseAND(TWIN) != 0
    # All others are the only ones with their ends, since these are new points of one segment's end each.
    single = bare(over.where(~twin)).unionByName(both_directions(inner).select(*columns)).unionByName(leaving.select(*columns)).unionByName(ending.select(*columns))
    edges = dedupe_edges(both_directions(plain).select(*columns).unionByName(bare(over.where(twin))))
    return edges.unionByName(single.select(*edges.columns)), points, arrivals


def distances(edges: DataFrame, sources: DataFrame, metric: str = "cost", hops: int | None = None, most: float | None = None) -> DataFrame:
    """(source, verid, dist, prev): least sums of the metric from each source, within so many hops and so far.

    Rounds relax only what got better in the last one, the least per vertex taken before the shuffle; ties of prev go to the smallest.
    The rounds are as many as the longest least path has edges. edges: (startid, endid, metric); sources: (source, verid).
    """
    edges = cut(edges.groupBy("startid", "endid").agg(F.min(metric).alias("w")).repartition("startid"))
    best = cut(sources.select("source", "verid", F.lit(0).cast("bigint").alias("dist"), F.lit(None).cast("bigint").alias("prev")))
    front, round_ = best, 0
    while hops is None or round_ < hops:
        round_ += 1
        step = front.select("source", F.col("verid").alias("startid"), "dist").join(edges, "startid")
        reached = step.select("source", F.col("endid").alias("verid"), (F.col("dist") + F.col("w")).alias("dist"), F.col("startid").alias("prev"))
        if most is not None:
            reached = reached.where(F.col("dist") <= most)
        reached = reached.groupBy("source", "verid").agg(F.min(F.struct("dist", "prev")).alias("new"))
        merged = cut(best.withColumn("old", F.struct("dist", "prev")).select("source", "verid", "old").join(reached, ["source", "verid"], "full"))
        better = F.col("old").isNull() | (F.col("new.dist") < F.col("old.dist"))
        front = merged.where(F.coalesce(better & F.col("new").isNotNull(), F.lit(False))).select("source", "verid", "new.dist", "new.prev")
        best = merged.select("source", "verid", F.when(F.coalesce(better & F.col("new").isNotNull(), F.lit(False)), F.col("new")).otherwise(F.col("old")).alias("b")).select("source", "verid", "b.dist", "b.prev")
        if not front.limit(1).count():
            break
    return best


def hop_distances(edges: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """(source, verid, dist): the fewest hops, up to so many."""
    return distances(edges.select("startid", "endid", F.lit(1).cast("bigint").alias("one")), sources, "one", hops).select("source", "verid", "dist")


def meeting_distances(edges: DataFrame, requests: DataFrame, metric: str = "cost") -> DataFrame:
    """(pair, dist, meet): least distances of (pair, src, dst), searched from both ends and joined where they meet."""
    ahead = distances(edges, requests.select(F.col("pair").alias("source"), F.col("src").alias("verid")), metric)
    turned = edges.select(F.col("endid").alias("startid"), F.col("startid").alias("endid"), metric)
    back = distances(turned, requests.select(F.col("pair").alias("source"), F.col("dst").alias("verid")), metric)
    both = ahead.select("source", "verid", F.col("dist").alias("df")).join(back.select("source", "verid", F.col("dist").alias("db")), ["source", "verid"])
    best = both.groupBy("source").agg(F.min(F.struct((F.col("df") + F.col("db")).alias("dist"), F.col("verid").alias("meet"))).alias("b"))
    return best.select(F.col("source").alias("pair"), "b.dist", "b.meet")


def _route(edges: dict[int, list[tuple[int, int]]], src: int, dst: int, lower: dict[int, float] | None = None) -> tuple[int | None, list[int]]:
    """Dijkstra with a heap; with lower bounds to the target, A*."""
    bound = lower.get if lower else lambda v, d=0.0: 0.0
    best, prev, heap, done = {src: 0}, {}, [(bound(src, 0.0), 0, src)], set()
    while heap:
        _, d, v = heapq.heappop(heap)
        if v in done:
            continue
        done.add(v)
        if v == dst:
            path = [v]
            while path[-1] != src:
                path.append(prev[path[-1]])
            return d, path[::-1]
        for u, w in edges.get(v, ()):
            if u not in best or d + w < best[u] or (d + w == best[u] and u in prev and v < prev[u]):
                best[u], prev[u] = d + w, v
                heapq.heappush(heap, (d + w + bound(u, 0.0), d + w, u))
    return None, []


def routes(edges: DataFrame, requests: DataFrame, metric: str = "cost", vertex: DataFrame | None = None) -> DataFrame:
    """(pair, dist, path): shortest paths of (pair, src, dst); dist null and path empty where there is none.

    A graph of at most TASK_EDGES edges is broadcast and requests are shared out over tasks; larger ones go by rounds of joins. With
    vertex, (verid, lat, lon), searches on the small graph are guided by the straight distance in whole metres.
    """
    least = cut(edges.groupBy("startid", "endid").agg(F.min(metric).cast("bigint").alias("w")))
    if least.limit(TASK_EDGES + 1).count() > TASK_EDGES:
        reached = distances(least, requests.select(F.col("pair").alias("source"), F.col("src").alias("verid")), "w")
        return unrolled(reached, requests)
    adjacency: dict[int, list[tuple[int, int]]] = {}
    for row in least.toLocalIterator():
        adjacency.setdefault(row["startid"], []).append((row["endid"], row["w"]))
    places = {r["verid"]: (r["lat"], r["lon"]) for r in vertex.select("verid", "lat", "lon").toLocalIterator()} if vertex is not None else None
    # No edge is cheaper per straight metre than this, so no path is.
    share = 0.0
    if places:
        rates = [w / m for a, out in adjacency.items() for b, w in out if a in places and b in places and (m := whole_metres(*places[a], *places[b]) + 1)]
        share = min(rates, default=0.0) if len(rates) == sum(map(len, adjacency.values())) else 0.0
    sent = edges.sparkSession.sparkContext.broadcast((adjacency, places, share))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, at, rate = sent.value
        for batch in batches:
            rows = []
            for pair, src, dst in batch[["pair", "src", "dst"]].itertuples(index=False):
                lower = {v: whole_metres(*p, *at[dst]) * rate for v, p in at.items()} if rate and dst in at else None
                d, path = _route(graph, src, dst, lower)
                rows.append((pair, d, path))
            yield pd.DataFrame(rows, columns=["pair", "dist", "path"]).astype({"dist": "Int64"})

    return requests.select("pair", "src", "dst").mapInPandas(solve, f"pair {requests.schema['pair'].dataType.simpleString()}, dist bigint, path array<bigint>")


def unrolled(reached: DataFrame, requests: DataFrame) -> DataFrame:
    """(pair, dist, path) from distances() rows: pointers are followed for all requests at once, one join a step."""
    back = cut(reached.select(F.col("source").alias("pair"), "verid", "dist", "prev"))
    ends = requests.join(back.select("pair", F.col("verid").alias("dst"), "dist", "prev"), ["pair", "dst"], "left")
    state = cut(ends.select("pair", "dist", F.when(F.col("dist").isNotNull(), F.array("dst")).otherwise(F.array().cast("array<bigint>")).alias("path"), "prev"))
    while state.where("prev is not null").limit(1).count():
        step = back.select("pair", F.col("verid").alias("at"), F.col("prev").alias("before"))
        state = cut(state.join(step, (state["pair"] == step["pair"]) & (F.col("prev") == F.col("at")), "left").select(state["pair"], "dist", F.when(F.col("prev").isNotNull(), F.concat(F.array("prev"), F.col("path"))).otherwise(F.col("path")).alias("path"), F.col("before").alias("prev")))
    return state.select("pair", "dist", "path")


def path_edges(paths: DataFrame) -> DataFrame:
    """(pair, pos, startid, endid): the steps of paths."""
    pairs = F.arrays_zip(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))).alias("a"), F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))).alias("b"))
    return paths.select("pair", F.posexplode(pairs).alias("pos", "step")).select("pair", "pos", F.col("step.a").alias("startid"), F.col("step.b").alias("endid"))


def expanded(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Paths with the point that each shortcut leads over (via, null where it leads over none) put between its ends."""
    over = edges.select("startid", "endid", "via").where("via is not null")
    steps = path_edges(paths).join(over, ["startid", "endid"], "left").groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("pos", "startid", "via"))).alias("steps"))
    parts = F.flatten(F.transform("steps", lambda s: F.filter(F.array(s["startid"], s["via"]), lambda v: v.isNotNull())))
    whole = F.when(F.col("steps").isNull(), F.col("path")).otherwise(F.concat(parts, F.slice("path", -1, 1)))
    return paths.join(steps, "pair", "left").select("pair", "dist", whole.alias("path"))


def path_ways(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(pair, pos, way): the way that each step was made from, in its own direction or else the other; -1 where none is known."""
    steps = path_edges(paths)
    own = edges.groupBy("startid", "endid").agg(F.min("origid").alias("own"))
    other = own.select(F.col("startid").alias("endid"), F.col("endid").alias("startid"), F.col("own").alias("other"))
    return steps.join(own, ["startid", "endid"], "left").join(other, ["startid", "endid"], "left").select("pair", "pos", F.coalesce("own", "other", F.lit(-1)).alias("way"))


def path_points(paths: DataFrame, vertex: DataFrame) -> DataFrame:
    """(pair, line): the places of a path's points, in order, as an array of structs."""
    at = paths.select("pair", F.posexplode("path").alias("pos", "verid")).join(vertex, "verid")
    return at.groupBy("pair").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("line"))


def waypoint_pairs(waypoints: DataFrame) -> DataFrame:
    """(pair, src, dst) of consecutive waypoints (request, pos, verid); pair is a struct of request and position."""
    w = Window.partitionBy("request").orderBy("pos")
    return waypoints.withColumn("dst", F.lead("verid").over(w)).where("dst is not null").select(F.struct("request", "pos").alias("pair"), F.col("verid").alias("src"), "dst")


def import_metrics(edges: DataFrame, metrics: DataFrame) -> DataFrame:
    """Edges with measured metres and seconds, (startid, endid, meters, seconds), where there are any."""
    return edges.join(metrics, ["startid", "endid"], "left").withColumn("cost", F.coalesce("meters", "cost")).withColumn("timecost", F.coalesce("seconds", "timecost")).drop("meters", "seconds")


def contract(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """One round of contraction: vertices (verid), no two of them neighbours, are taken out, shortcuts keep all distances between the rest.

    Shortcuts carry via, the vertex taken out. A shortcut is kept only where it is shorter than any edge there is.
    """
    gone = vertices.select("verid").distinct()
    into = edges.join(gone.withColumnRenamed("verid", "endid"), "endid").select(F.col("endid").alias("via"), F.col("startid").alias("a"), F.col("cost").alias("c1"))
    out = edges.join(gone.withColumnRenamed("verid", "startid"), "startid").select(F.col("startid").alias("via"), F.col("endid").alias("b"), F.col("cost").alias("c2"))
    short = into.join(out, "via").where("a <> b").select(F.col("a").alias("startid"), F.col("b").alias("endid"), (F.col("c1") + F.col("c2")).alias("cost"), "via")
    kept = edges.join(gone.withColumnRenamed("verid", "startid"), "startid", "left_anti").join(gone.withColumnRenamed("verid", "endid"), "endid", "left_anti")
    kept = kept.select("startid", "endid", "cost", F.lit(None).cast("bigint").alias("via"))
    best = kept.unionByName(short).groupBy("startid", "endid").agg(F.min(F.struct("cost", F.coalesce("via", F.lit(-1)).alias("via"))).alias("e"))
    return best.select("startid", "endid", "e.cost", F.nullif("e.via", F.lit(-1)).alias("via"))
