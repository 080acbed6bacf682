"""Queries over places, graphs, timetables and tiles, each with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartalog.api import MapFile, Service, map_info_rows
from cartalog.functions import codec, geo, tags, times
from cartalog.functions.curve import peano
from cartalog.operators import graph, gtfs, spatial, tiles
from cartalog.plans import relational
from cartalog.plans.views import metres
from cartalog.streaming.windows import sessions, windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None, plan: relational.Plan) -> None:
    relational.register(name, sql, plan, QUERIES, SQL)


c = F.col
#: What is searched for: a spot beside every point whose id can be divided by 50.
_TARGET_SQL = "t AS (SELECT verid AS target, lat + 0.0007e0 AS tlat, lon - 0.0004e0 AS tlon FROM vx WHERE verid % 50 = 0)"


def _targets(t: Callable[[str], DataFrame]) -> DataFrame:
    return t("vx").where("verid % 50 = 0").selectExpr("verid AS target", "lat + 0.0007e0 AS tlat", "lon - 0.0004e0 AS tlon")


# boxes and neighbours
register("q_bbox", "SELECT verid, lat, lon FROM pt WHERE lat BETWEEN -30e0 AND 45e0 AND lon BETWEEN -169.5e0 AND -167e0", lambda t: spatial.in_bounding_box(t("pt"), 45.0, -169.5, -30.0, -167.0))
register("q_bbox_antimeridian", "SELECT verid, lat, lon FROM pt WHERE lat BETWEEN -60e0 AND 60e0 AND (lon >= 179e0 OR lon <= -169e0)", lambda t: spatial.in_bounding_box(t("pt"), 60.0, 179.0, -60.0, -169.0))
register(
    "q_boxes_join",
    "SELECT v.verid, b.id FROM vx v JOIN (SELECT n_nationkey AS id, 45e0 + n_nationkey / 30e0 + 0.11e0 AS hi_lat, 6e0 + n_nationkey / 40e0 AS hi_lon, 45e0 + n_nationkey / 30e0 AS lo_lat, 6.2e0 + n_nationkey / 40e0 AS lo_lon FROM nation) b ON v.lat BETWEEN b.lo_lat AND b.hi_lat AND v.lon BETWEEN b.hi_lon AND b.lo_lon",
    lambda t: spatial.boxes_join(t("vx"), t("nation").selectExpr("n_nationkey AS id", "45e0 + n_nationkey / 30e0 + 0.11e0 AS hi_lat", "6e0 + n_nationkey / 40e0 AS hi_lon", "45e0 + n_nationkey / 30e0 AS lo_lat", "6.2e0 + n_nationkey / 40e0 AS lo_lon")).select("verid", "id"),
)
register(
    "q_nearest_expanding",
    f"WITH {_TARGET_SQL}, d AS (SELECT target, verid, lat, lon, abs(lat - tlat) + abs(lon - tlon) AS far, CASE WHEN greatest(abs(lat - tlat), abs(lon - tlon)) <= 0.00005e0 THEN 0 ELSE ceil(log2(greatest(abs(lat - tlat), abs(lon - tlon)) / 0.00005e0)) END AS step FROM vx, t) SELECT target, verid, lat, lon FROM d QUALIFY row_number() OVER (PARTITION BY target ORDER BY step, far, verid) = 1",
    lambda t: spatial.nearest_expanding(t("vx"), _targets(t)),
)
register("q_nearest", f"WITH {_TARGET_SQL}, d AS (SELECT target, verid, round({metres('u.', 'p.')}, 3) AS metres FROM vx p, (SELECT target, tlat AS lat, tlon AS lon FROM t) u) SELECT target, verid, metres FROM d QUALIFY row_number() OVER (PARTITION BY target ORDER BY metres, verid) = 1", lambda t: spatial.nearest(t("vx"), _targets(t)).withColumn("metres", F.round("metres", 3)))
register(
    "q_nearest_join",
    f"WITH u AS (SELECT verid AS target, lat + 0.0007e0 AS lat, lon - 0.0004e0 AS lon FROM vx WHERE verid % 50 = 0), d AS (SELECT target, verid, {metres('u.', 'p.')} AS metres FROM vx p, u) SELECT target, verid FROM d QUALIFY row_number() OVER (PARTITION BY target ORDER BY metres, verid) = 1",
    lambda t: spatial.nearest_join(t("vx"), t("vx").where("verid % 50 = 0").selectExpr("verid AS target", "lat + 0.0007e0 AS tlat", "lon - 0.0004e0 AS tlon")).select("target", "verid"),
)
register(
    "q_reverse_geocode",
    f"WITH {_TARGET_SQL}, a AS (SELECT p_partkey AS objectid, CASE WHEN p_partkey % 3 = 0 THEN 'country' WHEN p_partkey % 3 = 1 THEN 'city' ELSE 'street' END AS area, p_brand AS value FROM part), d AS (SELECT t.target, a.area, a.value, a.objectid, {metres('u.', 'v.')} AS far FROM a JOIN vx v ON v.verid = a.objectid, (SELECT target, tlat AS lat, tlon AS lon FROM t) u, t WHERE t.target = u.target) SELECT target, area, value FROM d WHERE far <= CASE area WHEN 'country' THEN 50000 WHEN 'city' THEN 1000 ELSE 50 END QUALIFY row_number() OVER (PARTITION BY target, area ORDER BY far, objectid) = 1",
    lambda t: spatial.reverse_geocode(
        t("part").selectExpr("p_partkey AS objectid", "CASE WHEN p_partkey % 3 = 0 THEN 'addr:country' WHEN p_partkey % 3 = 1 THEN 'addr:city' ELSE 'addr:street' END AS key", "p_brand AS value"), t("vx").withColumnRenamed("verid", "objectid"), _targets(t)
    ),
)
_LEVEL = relational.SQL["q_area_levels"].split("CASE areatype")[1].split(" END AS level")[0]
register(
    "q_area_bbox",
    f"SELECT r_name AS name, 'country' AS areatype, max(lat) AS hl_lat, min(lon) AS hl_lon, min(lat) AS lr_lat, max(lon) AS lr_lon, 0 AS level FROM customer JOIN vx ON verid = c_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name",
    lambda t: spatial.area_boxes(t("customer").join(t("vx"), F.expr("verid = c_custkey")).join(t("nation"), F.expr("n_nationkey = c_nationkey")).join(t("region"), F.expr("r_regionkey = n_regionkey")).select(F.lit("country").alias("areatype"), F.col("r_name").alias("name"), "lat", "lon")),
)
register(
    "q_area_parents",
    f"WITH m AS (SELECT id, areatype, (hl_lat + lr_lat) / 2 AS lat, (hl_lon + lr_lon) / 2 AS lon, CASE areatype {_LEVEL} END AS level FROM area), k AS (SELECT * FROM (VALUES ('country', 0, 0), ('province', 1, 0), ('region', 1, 1), ('county', 1, 2), ('state', 1, 3), ('island', 2, 0), ('archipelago', 2, 1), ('village', 2, 2), ('town', 2, 3), ('city', 2, 4), ('neighbourhood', 3, 0), ('locality', 3, 1), ('hamlet', 3, 2), ('district', 3, 3), ('suburb', 3, 4)) v(areatype, level, weight)), p AS (SELECT DISTINCT k.* FROM k JOIN m USING (areatype)), w AS (SELECT l.level, (SELECT p.areatype FROM p WHERE p.level < l.level ORDER BY p.level DESC, p.weight DESC LIMIT 1) AS wanted FROM (SELECT DISTINCT level FROM m) l), d AS (SELECT a.id, b.id AS parid, row_number() OVER (PARTITION BY a.id ORDER BY {metres('a.', 'b.')}, b.id) AS k FROM m a JOIN w ON w.level = a.level JOIN m b ON b.areatype = w.wanted) SELECT m.id, d.parid FROM m LEFT JOIN d ON d.id = m.id AND d.k = 1",
    lambda t: spatial.area_parents(t("area")),
)
register("q_largest_areas", "SELECT id, name, abs(hl_lat - lr_lat) * abs(hl_lon - lr_lon) AS area FROM area WHERE areatype IN ('country', 'city')", lambda t: spatial.largest_areas(t("area")))
register("q_closest_in_array", "SELECT wayid, arg_min(v.verid, struct_pack(d := abs(lat - 45.5e0) + abs(lon - 6.5e0), p := pos)) AS verid FROM way JOIN vx v ON v.verid = way.verid GROUP BY wayid", lambda t: t("way").join(t("vx"), "verid").groupBy("wayid").agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon", "verid"))).alias("p")).select("wayid", spatial.closest_in_array(F.col("p"), F.lit(45.5), F.lit(6.5))["verid"].alias("verid")))
register(
    "q_fill_gaps",
    "WITH g AS (SELECT w.wayid, w.pos, CASE WHEN w.verid % 4 <> 1 THEN v.lat END AS lat, CASE WHEN w.verid % 4 <> 1 THEN v.lon END AS lon FROM way w JOIN vx v ON v.verid = w.verid) SELECT wayid, pos, coalesce(last_value(lat IGNORE NULLS) OVER b, first_value(lat IGNORE NULLS) OVER f) AS lat, coalesce(last_value(lon IGNORE NULLS) OVER b, first_value(lon IGNORE NULLS) OVER f) AS lon FROM g WINDOW b AS (PARTITION BY wayid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY wayid ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
    lambda t: spatial.fill_gaps(t("way").join(t("vx"), "verid").select("wayid", "pos", F.when(c("verid") % 4 != 1, c("lat")).alias("lat"), F.when(c("verid") % 4 != 1, c("lon")).alias("lon")), "wayid", "pos"),
)

# geometry
_HOPS = "SELECT wayid, pos, lat, lon, nlat, nlon FROM hop WHERE endid IS NOT NULL"
register("q_haversine", f"SELECT wayid, pos, CAST(floor({metres('', 'n')}) AS BIGINT) AS metres FROM hop WHERE endid IS NOT NULL", lambda t: t("hop").where("endid is not null").select("wayid", "pos", F.floor(geo.haversine(c("lat"), c("lon"), c("nlat"), c("nlon"))).alias("metres")))
register("q_manhattan", "SELECT wayid, pos, round(abs(lat - nlat) + abs(lon - nlon), 6) AS degrees FROM hop WHERE endid IS NOT NULL", lambda t: t("hop").where("endid is not null").select("wayid", "pos", F.round(geo.manhattan(c("lat"), c("lon"), c("nlat"), c("nlon")), 6).alias("degrees")))
register("q_mercator", "SELECT verid, round(6378137e0 * radians(lon), 3) AS x, round(6378137e0 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS y FROM vx", lambda t: t("vx").select("verid", F.round(geo.mercator_x(c("lon")), 3).alias("x"), F.round(geo.mercator_y(c("lat")), 3).alias("y")))
_PX = "(256 * 4096e0) / 2 + lon * ((256 * 4096e0) / 360)"
_PY = "(256 * 4096e0) / 2 - ln((1 + greatest(-0.9999e0, least(0.9999e0, sin(radians(lat))))) / (1 - greatest(-0.9999e0, least(0.9999e0, sin(radians(lat)))))) * ((256 * 4096e0) / (4 * pi()))"
register("q_tile_pixel", f"SELECT verid, round({_PX}, 3) AS px, round({_PY}, 3) AS py, CAST(floor(({_PX}) / 256) AS INT) AS tx, CAST(floor(({_PY}) / 256) AS INT) AS ty FROM pt", lambda t: t("pt").select("verid", F.round(geo.pixel_x(c("lon"), 12), 3).alias("px"), F.round(geo.pixel_y(c("lat"), 12), 3).alias("py"), geo.tile_x(c("lon"), 12).alias("tx"), geo.tile_y(c("lat"), 12).alias("ty")))
register("q_pixel_round_trip", "SELECT verid, round(lat, 6) AS lat, round(lon, 6) AS lon FROM vx", lambda t: t("vx").select("verid", F.round(geo.lat_of_pixel(geo.pixel_y(c("lat"), 15), 15), 6).alias("lat"), F.round(geo.lon_of_pixel(geo.pixel_x(c("lon"), 15), 15), 6).alias("lon")))
_SIDE = "(2 * pi() * 6378137e0 / 4096e0)"
register("q_tile_bbox", f"SELECT p_size AS tx, p_partkey AS ty, round(p_size * {_SIDE} - pi() * 6378137e0, 3) AS west, round(pi() * 6378137e0 - (p_partkey + 1) * {_SIDE}, 3) AS south, round((p_size + 1) * {_SIDE} - pi() * 6378137e0, 3) AS east, round(pi() * 6378137e0 - p_partkey * {_SIDE}, 3) AS north FROM part", lambda t: t("part").select(c("p_size").alias("tx"), c("p_partkey").alias("ty"), *[F.round(v, 3).alias(n) for v, n in zip(geo.tile_box(c("p_size"), c("p_partkey"), 12), ("west", "south", "east", "north"), strict=True)]))
_STEP = "struct_pack(x := CASE WHEN x < w / 3 THEN y WHEN x < w / 3 * 2 THEN w / sqrt(3e0) - y ELSE y END, y := CASE WHEN x < w / 3 THEN x WHEN x < w / 3 * 2 THEN x - w / 3 ELSE x - w / 3 * 2 END, d := CASE WHEN x < w / 3 THEN 0 WHEN x < w / 3 * 2 THEN 1 ELSE 2 END)"
register(
    "q_peano",
    f"WITH RECURSIVE s AS (SELECT verid, CASE WHEN lat < 0 THEN lat + 360 ELSE lat END AS x, CASE WHEN lon < 0 THEN lon + 360 ELSE lon END AS y, 360e0 * sqrt(3e0) AS w, CAST(0 AS BIGINT) AS n, 0 AS k FROM vx UNION ALL SELECT verid, z.x, z.y, w / sqrt(3e0), n * 3 + z.d, k + 1 FROM (SELECT *, {_STEP} AS z FROM s WHERE k < 30) q) SELECT verid, n AS curve FROM s WHERE k = 30",
    lambda t: t("vx").select("verid", peano(c("lat"), c("lon")).alias("curve")),
)


def _lines(t: Callable[[str], DataFrame]) -> DataFrame:
    at = t("way").join(t("vx"), "verid").groupBy("wayid").agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))).alias("p"))
    return at.select("wayid", F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("line"))


register("q_line_length", f"SELECT w.wayid, round(coalesce(s.metres, 0), 2) AS metres FROM (SELECT DISTINCT wayid FROM way) w LEFT JOIN (SELECT wayid, sum({metres('', 'n')}) AS metres FROM hop WHERE endid IS NOT NULL GROUP BY wayid) s ON s.wayid = w.wayid", lambda t: _lines(t).select("wayid", F.round(geo.line_length(c("line")), 2).alias("metres")))
register("q_polygon_area", "WITH p AS (SELECT w.wayid, w.pos, v.lat, v.lon, count(*) OVER (PARTITION BY w.wayid) AS n FROM way w JOIN vx v ON v.verid = w.verid), q AS (SELECT a.wayid, a.n, abs(sum(a.lon * b.lat - b.lon * a.lat)) / 2 AS area FROM p a JOIN p b ON b.wayid = a.wayid AND b.pos = (a.pos + 1) % a.n GROUP BY a.wayid, a.n) SELECT wayid, CASE WHEN n > 2 THEN round(area, 6) ELSE 0 END AS area FROM q", lambda t: _lines(t).select("wayid", F.round(geo.ring_area(c("line")), 6).alias("area")))
register("q_center_of_mass", "SELECT wayid, round(avg(lat), 7) AS lat, round(avg(lon), 7) AS lon FROM way JOIN vx ON vx.verid = way.verid GROUP BY wayid", lambda t: _lines(t).select("wayid", geo.centre_of_mass(c("line")).alias("m")).select("wayid", F.round("m.lat", 7).alias("lat"), F.round("m.lon", 7).alias("lon")))
register("q_line_bbox", "SELECT wayid, max(lat) AS hi_lat, min(lon) AS hi_lon, min(lat) AS lo_lat, max(lon) AS lo_lon FROM way JOIN vx ON vx.verid = way.verid GROUP BY wayid", lambda t: _lines(t).select("wayid", *[f(F.transform("line", lambda p: p["lat"])).alias(n) for f, n in ((F.array_max, "hi_lat"), (F.array_min, "lo_lat"))], *[f(F.transform("line", lambda p: p["lon"])).alias(n) for f, n in ((F.array_min, "hi_lon"), (F.array_max, "lo_lon"))]))
register("q_wkt_line", "SELECT wayid, 'LINESTRING (' || string_agg(printf('%.6f %.6f', lon, lat), ', ' ORDER BY pos) || ')' AS wkt FROM way JOIN vx ON vx.verid = way.verid GROUP BY wayid", lambda t: _lines(t).select("wayid", codec.wkt_line(c("line")).alias("wkt")))
register("q_polyline_roundtrip", "SELECT wayid, count(*) AS n, TRUE AS close FROM way GROUP BY wayid", lambda t: _lines(t).withColumn("back", codec.from_polyline(codec.to_polyline(c("line")))).select("wayid", F.size("back").cast("bigint").alias("n"), F.forall(F.zip_with("line", "back", lambda a, b: geo.manhattan(a["lat"], a["lon"], b["lat"], b["lon"]) < 2.1e-5), lambda ok: ok).alias("close")))
register("q_polyline", None, lambda t: _lines(t).select("wayid", codec.to_polyline(c("line")).alias("code")))
register("q_wkb_roundtrip", "SELECT wayid, count(*) AS n, TRUE AS same FROM way GROUP BY wayid", lambda t: _lines(t).withColumn("back", codec.from_wkb(codec.to_wkb(c("line"), 2))).select("wayid", F.size("back").cast("bigint").alias("n"), (c("back") == c("line")).alias("same")))
register("q_stored_geometry", "SELECT wayid, CASE WHEN count(*) = 1 THEN 2 ELSE 4 END + CASE WHEN wayid % 2 = 0 THEN 1 ELSE 0 END AS flags, count(*) AS n FROM way GROUP BY wayid", lambda t: _lines(t).select("wayid", F.when(c("wayid") % 2 == 0, codec.to_stored(c("line"), True)).otherwise(codec.to_stored(c("line"), False)).alias("b")).select("wayid", F.conv(F.hex(F.substring("b", 1, 1)), 16, 10).cast("int").alias("flags"), F.size(codec.from_stored(c("b"))).cast("bigint").alias("n")))
register("q_split_line", "WITH n AS (SELECT l_suppkey AS id, count(*) AS n FROM lineitem GROUP BY 1) SELECT id, CASE WHEN n > 40 THEN CAST(ceil(n / 20e0) AS INT) ELSE 1 END AS pieces FROM n", lambda t: t("lineitem").groupBy(c("l_suppkey").alias("id")).agg(F.collect_list("l_orderkey").alias("line")).select("id", F.size(tiles.split_line(c("line"))).alias("pieces")))
register(
    "q_tile_features",
    f"WITH b AS (SELECT wayid, min(6378137e0 * radians(lon)) AS xmin, max(6378137e0 * radians(lon)) AS xmax, min(6378137e0 * ln(tan(pi() / 4 + radians(lat) / 2))) AS ymin, max(6378137e0 * ln(tan(pi() / 4 + radians(lat) / 2))) AS ymax FROM way JOIN vx ON vx.verid = way.verid GROUP BY wayid), e AS (SELECT 2 * pi() * 6378137e0 AS whole) SELECT wayid FROM b, e WHERE xmax >= 530 * whole / 1024 - whole / 2 AND xmin <= 531 * whole / 1024 - whole / 2 AND ymax >= whole / 2 - 366 * whole / 1024 AND ymin <= whole / 2 - 365 * whole / 1024",
    lambda t: tiles.tile_features(tiles.with_box(_lines(t)), 530, 365, 10).select("wayid"),
)
register("q_tiles_per_feature", None, lambda t: tiles.all_tiles(tiles.with_box(_lines(t)), 9).select("wayid", "x", "y"))

# graphs
register("q_endpoints", "SELECT verid FROM way w WHERE pos = 0 UNION SELECT verid FROM (SELECT verid, row_number() OVER (PARTITION BY wayid ORDER BY pos DESC) AS k FROM way) WHERE k = 1 UNION SELECT verid FROM way GROUP BY verid HAVING count(*) > 1", lambda t: graph.endpoints(t("way")))
_ENDS = "SELECT DISTINCT verid FROM way WHERE pos = 0 OR verid % 3 = 0 UNION SELECT verid FROM (SELECT verid, row_number() OVER (PARTITION BY wayid ORDER BY pos DESC) AS k FROM way) WHERE k = 1"
_SEGMENTS = f"e AS ({_ENDS}), h AS (SELECT h.*, sum(CASE WHEN e.verid IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY wayid ORDER BY pos ROWS UNBOUNDED PRECEDING) AS segment FROM hop h LEFT JOIN e ON e.verid = h.startid), g AS (SELECT wayid, segment, arg_min(startid, pos) AS startid, arg_max(endid, pos) AS endid, CAST(sum(floor({metres('', 'n')})) AS INT) AS cost, CAST(count(*) AS INT) AS hops FROM h WHERE endid IS NOT NULL AND startid <> endid GROUP BY wayid, segment)"


def _segments(t: Callable[[str], DataFrame]) -> DataFrame:
    return graph.segments(t("way"), t("vx"), _ends(t))


register("q_edge_segments", f"WITH {_SEGMENTS} SELECT wayid, CAST(segment AS BIGINT) AS segment, startid, endid, cost, hops FROM g WHERE startid <> endid", _segments)
_ALL_SEGMENTS = _SEGMENTS.split(", g AS (")[0] + ", g AS (SELECT wayid, segment, arg_min(startid, pos) AS startid, arg_max(endid, pos) AS endid, arg_max(startid, pos) AS before, arg_min(endid, pos) AS second, max(pos) + 1 AS endpos, count(*) AS hops FROM h WHERE endid IS NOT NULL AND startid <> endid GROUP BY wayid, segment)"


def _ends(t: Callable[[str], DataFrame]) -> DataFrame:
    return t("way").where("pos = 0 or verid % 3 = 0").select("verid").union(t("way").groupBy("wayid").agg(F.max_by("verid", "pos").alias("verid")).select("verid")).distinct()


def _restricted(t: Callable[[str], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    segs = graph.segments(t("way"), t("vx"), _ends(t), hops=True).join(t("highway").select("wayid", tags.one_way(c("oneway"), c("highway")).alias("oneway")), "wayid")
    return graph.restricted_graph(segs.withColumn("timecost", c("cost")).withColumn("type", F.lit(0)), t("restriction"), t("vx"))


register(
    "q_repaired_ends",
    f"WITH {_ALL_SEGMENTS}, p AS (SELECT least(startid, endid) AS a, greatest(startid, endid) AS b FROM g GROUP BY 1, 2 HAVING count(*) > 1), s AS (SELECT wayid, verid, min(pos) AS seen FROM way GROUP BY 1, 2), x AS (SELECT g.* FROM g LEFT JOIN p ON p.a = least(startid, endid) AND p.b = greatest(startid, endid) JOIN s ON s.wayid = g.wayid AND s.verid = g.endid WHERE hops >= 2 AND (p.a IS NOT NULL OR s.seen < g.endpos)) SELECT verid FROM e UNION SELECT before FROM x UNION SELECT second FROM x WHERE startid = endid AND hops >= 3",
    lambda t: graph.repaired_ends(t("way"), t("vx"), _ends(t)),
)
register("q_restricted_graph", None, lambda t: _restricted(t)[0])
register("q_restricted_points", None, lambda t: _restricted(t)[1])
register("q_edge_times", f"WITH {_SEGMENTS} SELECT g.wayid, g.startid, g.endid, CAST(floor(cost / (13 * 0.277778e0)) AS INT) AS seconds FROM g WHERE startid <> endid", lambda t: _segments(t).select("wayid", "startid", "endid", graph.travel_time(c("cost"), F.lit(13)).alias("seconds")))
register(
    "q_edges_two_way",
    f"WITH {_SEGMENTS}, o AS (SELECT wayid, CASE WHEN oneway IN ('true','1','yes','-1','reverse') THEN TRUE WHEN oneway IN ('false','0','no') THEN FALSE ELSE coalesce(highway IN ('motorway','motorway_link','trunk'), FALSE) END AS oneway FROM highway) SELECT startid, endid, g.wayid, cost FROM g JOIN o USING (wayid) WHERE startid <> endid UNION ALL SELECT endid, startid, g.wayid, cost FROM g JOIN o USING (wayid) WHERE NOT oneway AND startid <> endid",
    lambda t: graph.both_directions(_segments(t).join(t("highway").select("wayid", tags.one_way(c("oneway"), c("highway")).alias("oneway")), "wayid")).select("startid", "endid", "wayid", "cost"),
)
register("q_edge_dedupe", "SELECT startid, endid, min(cost) AS cost, min(origid) AS origid FROM edge GROUP BY startid, endid", lambda t: graph.dedupe_edges(t("edge")))
register("q_repeated_pairs", "SELECT least(startid, endid) AS a, greatest(startid, endid) AS b, count(*) AS n FROM hop WHERE endid IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1", lambda t: graph.repeated_pairs(t("hop").where("endid is not null")))
register("q_known_stretches", "WITH p AS (SELECT w.wayid, w.pos, w.verid, v.lat, v.lon, LAG(w.pos) OVER (PARTITION BY w.wayid ORDER BY w.pos) AS b, LEAD(w.pos) OVER (PARTITION BY w.wayid ORDER BY w.pos) AS a FROM way w JOIN vx v ON v.verid = w.verid WHERE v.verid % 4 <> 1) SELECT wayid, pos, verid, lat, lon FROM p WHERE b = pos - 1 OR a = pos + 1", lambda t: graph.known_stretches(t("way"), t("vx").where("verid % 4 <> 1")).select("wayid", "pos", "verid", "lat", "lon"))
register("q_degree", "SELECT verid, count(*) AS degree FROM (SELECT startid AS verid FROM edge UNION ALL SELECT endid FROM edge) GROUP BY verid", lambda t: graph.degrees(t("edge")))
register(
    "q_turn_restrictions",
    "WITH m AS (SELECT o_orderkey AS relid, 'no_u_turn' AS type, o_orderkey AS f, o_custkey AS t, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey % 100 END AS v FROM orders) SELECT f AS edgefrom, t AS edgeto, v AS vervia, type FROM m WHERE v IN (SELECT verid FROM vx)",
    lambda t: graph.turn_restrictions(
        t("orders").selectExpr("o_orderkey AS relid", "'no_u_turn' AS type", "inline(array(named_struct('role', 'from', 'ref', o_orderkey), named_struct('role', 'to', 'ref', o_custkey), named_struct('role', 'via', 'ref', if(o_orderkey % 3 = 0, null, o_custkey % 100))))"), t("vx")
    ),
)
register(
    "q_turn_shortcuts",
    "WITH a AS (SELECT * FROM half WHERE side = 'in'), b AS (SELECT * FROM half WHERE side = 'out'), onl AS (SELECT edgefrom, vervia FROM restriction WHERE type = 'only_straight_on' GROUP BY 1, 2) SELECT a.node AS startid, b.node AS endid, a.verid AS via, a.cost + b.cost AS cost, 24 AS type, CASE WHEN a.wayid = b.wayid THEN a.wayid ELSE -1 END AS origid FROM a JOIN b ON a.verid = b.verid AND a.node <> b.node WHERE NOT EXISTS (SELECT 1 FROM restriction r WHERE r.type = 'no_u_turn' AND r.edgefrom = a.wayid AND r.edgeto = b.wayid AND r.vervia = a.verid) AND (NOT EXISTS (SELECT 1 FROM onl o WHERE o.edgefrom = a.wayid AND o.vervia = a.verid) OR EXISTS (SELECT 1 FROM restriction r WHERE r.type = 'only_straight_on' AND r.edgefrom = a.wayid AND r.edgeto = b.wayid AND r.vervia = a.verid))",
    lambda t: graph.turn_shortcuts(t("half").where("side = 'in'").withColumn("type", F.lit(1)), t("half").where("side = 'out'").withColumn("type", F.lit(0)), t("restriction")),
)
register(
    "q_khop_distance",
    "WITH RECURSIVE w AS (SELECT 1 AS source, CAST(1 AS BIGINT) AS verid, 0 AS dist UNION SELECT w.source, e.endid, w.dist + 1 FROM w JOIN edge e ON e.startid = w.verid WHERE w.dist < 2) SELECT source, verid, CAST(min(dist) AS BIGINT) AS dist FROM w GROUP BY source, verid",
    lambda t: graph.hop_distances(t("edge"), t("vx").sparkSession.createDataFrame([(1, 1)], "source int, verid bigint"), 2),
)
_PAIRS = [(1, 1, 150), (2, 20, 3), (3, 77, 77), (4, 5, 199), (5, 1, 999_999_999)]


def _pairs(t: Callable[[str], DataFrame]) -> DataFrame:
    return t("vx").sparkSession.createDataFrame(_PAIRS, "pair int, src bigint, dst bigint")


register("q_shortest_path", None, lambda t: graph.routes(t("edge"), _pairs(t)))
register("q_shortest_path_guided", None, lambda t: graph.routes(t("edge"), _pairs(t), vertex=t("vx")).select("pair", "dist"))
register("q_distances_within", None, lambda t: graph.distances(t("edge"), t("vx").sparkSession.createDataFrame([(1, 1), (2, 50)], "source int, verid bigint"), most=30_000).select("source", "verid", "dist"))
register("q_bidirectional", None, lambda t: graph.meeting_distances(t("edge"), _pairs(t).where("pair in (1, 3)")).select("pair", "dist"))
register("q_path_edges", None, lambda t: graph.path_edges(graph.routes(t("edge"), _pairs(t))))
register("q_path_way_ids", None, lambda t: graph.path_ways(graph.routes(t("edge"), _pairs(t)), t("edge")))
register("q_path_geometry", None, lambda t: graph.path_points(graph.routes(t("edge"), _pairs(t)), t("vx")).select("pair", codec.wkt_line(c("line")).alias("wkt")))
register("q_waypoints", "SELECT wayid AS request, pos, verid AS src, nxt AS dst FROM (SELECT *, LEAD(verid) OVER (PARTITION BY wayid ORDER BY pos) AS nxt FROM way) WHERE nxt IS NOT NULL", lambda t: graph.waypoint_pairs(t("way").withColumnRenamed("wayid", "request")).select("pair.request", "pair.pos", "src", "dst"))
register("q_import_metrics", "SELECT e.startid, e.endid, coalesce(m.meters, e.cost) AS cost, coalesce(m.seconds, 0) AS timecost FROM edge e LEFT JOIN (SELECT DISTINCT startid, endid, 7 AS meters, 3 AS seconds FROM edge WHERE startid % 5 = 0) m USING (startid, endid)", lambda t: graph.import_metrics(t("edge").withColumn("timecost", F.lit(0)), t("edge").where("startid % 5 = 0").select("startid", "endid", F.lit(7).alias("meters"), F.lit(3).alias("seconds")).distinct()).select("startid", "endid", "cost", "timecost"))
_GONE = "SELECT p_partkey AS verid FROM part WHERE p_partkey % 97 = 5 AND p_partkey NOT IN (SELECT endid FROM edge WHERE startid % 97 = 5)"
register(
    "q_contract",
    f"WITH g AS ({_GONE}), s AS (SELECT a.startid, b.endid, a.cost + b.cost AS cost FROM edge a JOIN g ON g.verid = a.endid JOIN edge b ON b.startid = a.endid WHERE a.startid <> b.endid UNION ALL SELECT startid, endid, cost FROM edge WHERE startid NOT IN (SELECT verid FROM g) AND endid NOT IN (SELECT verid FROM g)) SELECT startid, endid, min(cost) AS cost FROM s GROUP BY startid, endid",
    lambda t: graph.contract(t("edge"), t("vx").where("verid % 97 = 5").join(t("edge").where("startid % 97 = 5").select(c("endid").alias("verid")), "verid", "left_anti")).select("startid", "endid", "cost"),
)
register("q_max_cost", "SELECT max(cost) AS cost, count(*) AS edges, count(DISTINCT startid) AS vertices FROM edge", lambda t: t("edge").agg(F.max("cost").alias("cost"), F.count(F.lit(1)).alias("edges"), F.count_distinct("startid").alias("vertices")))

# timetables
_CALLS = "SELECT trip_id, CAST(stop_sequence AS INT) AS pos, stop_id AS stop, LEAD(stop_id) OVER (PARTITION BY trip_id ORDER BY stop_sequence) AS next_stop, LEAD(arrival) OVER (PARTITION BY trip_id ORDER BY stop_sequence) - departure AS seconds, departure FROM stop_times"
register("q_gtfs_edges", f"SELECT trip_id, pos, stop, next_stop, seconds FROM ({_CALLS}) WHERE next_stop IS NOT NULL", lambda t: gtfs.stop_edges(t("stop_times")))
register("q_gtfs_trips_per_edge", f"SELECT stop, next_stop, list(trip_id ORDER BY trip_id) AS trips FROM ({_CALLS}) WHERE next_stop IS NOT NULL GROUP BY stop, next_stop", lambda t: gtfs.trips_per_edge(gtfs.stop_edges(t("stop_times"))))
register("q_gtfs_last_call", "SELECT trip_id, stop_id, stop_sequence, arrival, departure FROM stop_times QUALIFY row_number() OVER (PARTITION BY trip_id, stop_id ORDER BY stop_sequence DESC) = 1", lambda t: gtfs.last_stop_times(t("stop_times")))
register("q_service_active", "SELECT service_id, monday = 1 AND DATE '2024-03-11' BETWEEN start_date AND end_date AS active FROM calendar", lambda t: t("calendar").select("service_id", gtfs.is_active(F.lit("2024-03-11").cast("date")).alias("active")))
register(
    "q_next_service",
    "WITH d AS (SELECT *, greatest(DATE '2024-02-07', start_date) AS first FROM calendar), k AS (SELECT service_id, CAST(first + CAST(k AS INT) AS DATE) AS day, list_extract([monday, tuesday, wednesday, thursday, friday, saturday, sunday], isodow(first + CAST(k AS INT))) AS runs, end_date FROM d, range(7) r(k)), m AS (SELECT service_id, min(day) FILTER (WHERE runs = 1 AND day <= end_date) AS next_date FROM k GROUP BY service_id) SELECT d.service_id, CASE WHEN DATE '2024-02-07' > end_date THEN NULL WHEN monday + tuesday + wednesday + thursday + friday + saturday + sunday = 0 THEN start_date ELSE next_date END AS next_date FROM d JOIN m USING (service_id)",
    lambda t: gtfs.next_service(t("calendar"), F.lit("2024-02-07").cast("date")),
)
register(
    "q_next_departure",
    f"WITH c AS ({_CALLS}), r AS (SELECT DISTINCT trip_id * 1000 + pos AS request, stop, next_stop, CAST((trip_id * 37) % 86400 AS INT) AS at_s FROM c WHERE next_stop IS NOT NULL) SELECT r.request, c.trip_id, ((c.departure - r.at_s) % 86400 + 86400) % 86400 AS wait FROM r JOIN c ON c.stop = r.stop AND c.next_stop = r.next_stop QUALIFY row_number() OVER (PARTITION BY r.request ORDER BY ((c.departure - r.at_s) % 86400 + 86400) % 86400, c.trip_id) = 1",
    lambda t: gtfs.next_departure(t("stop_times"), gtfs.stop_edges(t("stop_times")).selectExpr("trip_id * 1000 + pos AS request", "stop", "next_stop", "CAST((trip_id * 37) % 86400 AS INT) AS at")),
)
register("q_gtfs_eav", "SELECT route_id AS objectid, tag, value FROM (SELECT route_id, unnest(['route_short_name', 'route_long_name', 'agency_id', 'route_type']) AS tag, unnest([route_short_name, route_long_name, CAST(agency_id AS VARCHAR), route_type]) AS value FROM rt) WHERE value IS NOT NULL AND value <> ''", lambda t: gtfs.to_tags(t("rt"), "route_id", ["route_short_name", "route_long_name", "agency_id", "route_type"]))
register("q_gtfs_name_words", r"WITH p AS (SELECT route_id, list_filter(list_transform(string_split_regex(route_long_name, '\s+'), lambda x: regexp_replace(x, '[[:punct:]]', '', 'g')), lambda x: x <> '') AS parts FROM rt) SELECT route_id AS objectid, 'name' || CAST(k - 1 AS VARCHAR) AS tag, parts[k] AS value FROM p, range(1, 40) r(k) WHERE len(parts) > 1 AND k <= len(parts)", lambda t: gtfs.name_words(t("rt"), "route_id", "route_long_name"))
register("q_gtfs_groups", "SELECT trip_id AS groupid, stop_time_id AS objectid, stop_sequence AS objectorder FROM stop_times", lambda t: gtfs.group_rows(t("stop_times")))
_BUS = "SELECT rel_id, ref, coalesce(nullif(operator, ''), network) AS agency FROM osm_relation WHERE route = 'bus' AND ref IS NOT NULL AND ref <> '' AND coalesce(nullif(operator, ''), nullif(network, '')) IS NOT NULL AND rel_id % 7 <> 0"


def _bus(t: Callable[[str], DataFrame]) -> dict[str, DataFrame]:
    rel = t("osm_relation").selectExpr("rel_id AS relid", "'route' AS type", "route", "ref", "name", "operator", "network").distinct()
    return gtfs.bus_relations(rel, rel.select("relid").distinct().selectExpr("relid", "explode(sequence(0, 2)) AS pos", "if(relid % 7 = 0, 'way', 'node') AS type", "relid * 10 AS ref"))


register("q_bus_agencies", f"WITH b AS ({_BUS}), f AS (SELECT min(rel_id) AS rel_id FROM b GROUP BY ref) SELECT agency_name, CAST(dense_rank() OVER (ORDER BY agency_name COLLATE \"C\") AS INT) AS agency_id FROM (SELECT DISTINCT b.agency AS agency_name FROM b JOIN f USING (rel_id))", lambda t: _bus(t)["agency"])
register("q_bus_trips", f"WITH b AS ({_BUS}) SELECT min(rel_id) AS trip_id, min(rel_id) AS route_id FROM b GROUP BY ref", lambda t: _bus(t)["trips"].distinct())
register("q_timetable_graph", f"SELECT stop AS startid, next_stop AS endid, min(seconds) AS cost FROM ({_CALLS}) WHERE next_stop IS NOT NULL AND seconds >= 0 GROUP BY stop, next_stop", lambda t: gtfs.timetable_edges(gtfs.stop_edges(t("stop_times"))))

# times
register("q_time_arith", "SELECT event_id, CAST((s + d) % 86400 AS INT) AS sec, CAST((s + d) // 86400 AS INT) AS carry, printf('%02d:%02d:%02d', CAST((s + d) % 86400 // 3600 AS INT), CAST((s + d) % 3600 // 60 AS INT), CAST((s + d) % 60 AS INT)) AS text FROM (SELECT event_id, extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + CAST(floor(extract(second FROM ts)) AS INT) AS s, (event_id * 7919) % 200000 AS d FROM events)", lambda t: (lambda sec, more: t("events").select("event_id", times.add_seconds(sec, more)[0].alias("sec"), times.add_seconds(sec, more)[1].alias("carry"), times.time_text(times.add_seconds(sec, more)[0]).alias("text")))(times.seconds_of_day(F.date_format("ts", "HH:mm:ss")), c("event_id") * 7919 % 200000))
register("q_weekday", "SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INT) AS weekday FROM orders", lambda t: t("orders").select("o_orderkey", times.weekday(c("o_orderdate")).alias("weekday")))
register("q_date_valid", "SELECT p_partkey, y, m, d, try_cast(printf('%04d-%02d-%02d', y, m, d) AS DATE) IS NOT NULL AS valid FROM (SELECT p_partkey, CAST(1999 + p_partkey % 6 AS INT) AS y, CAST(p_partkey % 14 AS INT) AS m, CAST(p_partkey % 33 AS INT) AS d FROM part)", lambda t: t("part").selectExpr("p_partkey", "CAST(1999 + p_partkey % 6 AS INT) AS y", "CAST(p_partkey % 14 AS INT) AS m", "CAST(p_partkey % 33 AS INT) AS d").withColumn("valid", times.valid_date(c("y"), c("m"), c("d"))))
register("q_moment", "SELECT o_orderkey, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) + INTERVAL 86399 SECOND AS last, CAST(date_trunc('second', o_orderdate) AS TIMESTAMP) AS iso FROM orders", lambda t: t("orders").select("o_orderkey", times.parse_moment(F.date_format("o_orderdate", "yyyyMMdd"), True).cast("timestamp_ntz").alias("last"), times.parse_moment(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz").alias("iso")))
register("q_time_compare", "SELECT stop_time_id, arrival < departure AS before, departure - arrival AS seconds FROM stop_times", lambda t: (lambda a, b: t("stop_times").select("stop_time_id", (a < b).alias("before"), (b - a).alias("seconds")))(*[times.seconds_of_day(times.time_text(c(x))) for x in ("arrival", "departure")]))

# events, as a stream would have them
register("q_event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2", lambda t: windowed_counts(t("events")).select(c("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total")))
register(
    "q_event_sessions",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts < LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events), s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, k",
    lambda t: sessions(t("events")).select("user_id", c("start").cast("timestamp_ntz").alias("start"), c("end").cast("timestamp_ntz").alias("end"), "n"),
)

# polygons and service answers
_PROPER = "hl_lat <> lr_lat AND hl_lon <> lr_lon"


def _corners(t: Callable[[str], DataFrame]) -> DataFrame:
    at = lambda lat, lon: F.struct(c(lat).alias("lat"), c(lon).alias("lon"))
    return t("area").where(_PROPER).select("id", F.array(at("hl_lat", "hl_lon"), at("hl_lat", "lr_lon"), at("lr_lat", "lr_lon"), at("lr_lat", "hl_lon")).alias("ring"))


register(
    "q_build_polygons",
    f"SELECT id AS relid, 1 AS polygons, 1 AS rings, 4 AS points FROM area WHERE {_PROPER}",
    lambda t: tiles.build_polygons(_corners(t).select(c("id").alias("relid"), F.explode(F.array(F.slice("ring", 1, 3), F.concat(F.slice("ring", 3, 2), F.slice("ring", 1, 1)))).alias("line"))).select("relid", F.size("polygons").alias("polygons"), F.size(c("polygons")[0]).alias("rings"), F.size(c("polygons")[0][0]).alias("points")),
)
register(
    "q_clip_polygons",
    f"SELECT id, greatest(least(hl_lat, lr_lat), -30e0) AS south, least(greatest(hl_lat, lr_lat), 30e0) AS north FROM area WHERE {_PROPER} AND least(hl_lat, lr_lat) < 30 AND greatest(hl_lat, lr_lat) > -30",
    lambda t: tiles.clip_polygons(_corners(t), (-180.0, -30.0, 180.0, 30.0)).select("id", F.array_min(F.transform("ring", lambda p: p["lat"])).alias("south"), F.array_max(F.transform("ring", lambda p: p["lat"])).alias("north")),
)


def _service(t: Callable[[str], DataFrame]) -> Service:
    places = t("vx").withColumnRenamed("verid", "objectid")
    return Service(t("vx").sparkSession, {"m": MapFile(t("osm"), places, edge=t("edge"), vertex=t("vx"))})


register("q_service_route", None, lambda t: _service(t).graph_route("m", "45.1,6.2|45.9,6.8|45.5,6.5"))
register("q_service_nearest", None, lambda t: _service(t).search_nearest("m", "45.1,6.2|45.9,6.8"))
register("q_map_info", "SELECT 0 AS objectid, 'features' AS tag, 'search,routing' AS value UNION ALL SELECT 0, 'comment', ''", lambda t: map_info_rows(t("vx")).where("tag <> 'bbox'"))
