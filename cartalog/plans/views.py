"""Tables of a map file and a timetable as views over the given tables; one SQL text for Spark and for the engine it is checked against."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from cartalog.functions.geo import EARTH_RADIUS
from cartalog.session import table

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "osm_tags", "vertex", "osm_relation", "routes", "addrdecoder_areas", "agency", "eval_items", "route_kinds",
)

HAVERSINE = f"2 * {EARTH_RADIUS}e0 * asin(sqrt(least(1e0, pow(sin(radians({{b}}lat - {{a}}lat) / 2), 2) + cos(radians({{a}}lat)) * cos(radians({{b}}lat)) * pow(sin(radians({{b}}lon - {{a}}lon) / 2), 2))))"


def metres(a: str, b: str) -> str:
    return HAVERSINE.format(a=a, b=b)


VIEWS = {
    # points of a road graph with dense ids, and ways through them
    "vx": "SELECT p_partkey AS verid, 45e0 + ((p_partkey * 7919) % 100003) / 1e5 AS lat, 6e0 + ((p_partkey * 104729) % 100019) / 1e5 AS lon FROM part",
    "way": "SELECT l_orderkey AS wayid, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) - 1 AS INT) AS pos, l_partkey AS verid FROM lineitem",
    "hop": "SELECT w.wayid, w.pos, w.verid AS startid, v.lat, v.lon, LEAD(w.verid) OVER (PARTITION BY w.wayid ORDER BY w.pos) AS endid, LEAD(v.lat) OVER (PARTITION BY w.wayid ORDER BY w.pos) AS nlat, LEAD(v.lon) OVER (PARTITION BY w.wayid ORDER BY w.pos) AS nlon FROM way w JOIN vx v ON v.verid = w.verid",
    "edge": f"SELECT startid, endid, CAST(floor({HAVERSINE.format(a='', b='n')}) AS INT) AS cost, min(wayid) AS origid FROM hop WHERE endid IS NOT NULL AND startid <> endid GROUP BY startid, endid, lat, lon, nlat, nlon",
    "highway": "SELECT DISTINCT l_orderkey AS wayid, CASE CAST(l_orderkey % 16 AS INT) WHEN 0 THEN 'motorway' WHEN 1 THEN 'motorway_link' WHEN 2 THEN 'trunk' WHEN 3 THEN 'primary' WHEN 4 THEN 'secondary' WHEN 5 THEN 'tertiary' WHEN 6 THEN 'residential' WHEN 7 THEN 'unclassified' WHEN 8 THEN 'living_street' WHEN 9 THEN 'road' WHEN 10 THEN 'footway' WHEN 11 THEN 'construction' WHEN 12 THEN 'cycleway' WHEN 13 THEN 'trunk_link' WHEN 14 THEN 'service' END AS highway, CASE CAST(l_orderkey % 7 AS INT) WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN '-1' WHEN 3 THEN 'reverse' END AS oneway, CASE CAST(l_orderkey % 5 AS INT) WHEN 0 THEN 'no' WHEN 1 THEN 'permissive' WHEN 2 THEN 'private' END AS access, CASE CAST(l_orderkey % 11 AS INT) WHEN 0 THEN 'roundabout' END AS junction FROM lineitem",
    "restriction": "SELECT DISTINCT a.wayid AS edgefrom, b.wayid AS edgeto, a.verid AS vervia, CASE WHEN (a.wayid + b.wayid) % 5 = 0 THEN 'no_u_turn' ELSE 'only_straight_on' END AS type FROM way a JOIN way b ON a.verid = b.verid AND a.wayid <> b.wayid WHERE ((a.wayid + b.wayid) % 5 = 0 OR (a.wayid + b.wayid) % 11 = 0)",
    "half": "SELECT startid AS verid, endid AS node, wayid, CAST(pos + 1 AS INT) AS cost, 'out' AS side FROM hop WHERE endid IS NOT NULL UNION ALL SELECT endid, startid, wayid, CAST(pos + 1 AS INT), 'in' FROM hop WHERE endid IS NOT NULL",
    # known points and tags of the map file
    "pt": "SELECT DISTINCT verid, lat, lon FROM vertex WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180",
    "osm": "SELECT DISTINCT objectid, lower(trim(key)) AS key, value FROM osm_tags WHERE value IS NOT NULL AND key IS NOT NULL AND objectid IS NOT NULL",
    "area": "SELECT DISTINCT id, areatype, name, hl_lat, hl_lon, lr_lat, lr_lon FROM addrdecoder_areas WHERE hl_lat BETWEEN -90 AND 90 AND lr_lat BETWEEN -90 AND 90 AND hl_lon BETWEEN -180 AND 180 AND lr_lon BETWEEN -180 AND 180",
    "osm_id": "SELECT DISTINCT objectid AS internal_id, concat(CASE WHEN objectid % 3 = 0 THEN 'w' ELSE 'n' END, CAST(objectid AS STRING)) AS osm_id FROM osm",
    "rel": "SELECT l_orderkey AS groupid, l_partkey AS objectid, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) AS INT) AS objectorder FROM lineitem",
    "rt": "SELECT DISTINCT route_id, route_short_name, route_long_name, agency_id, route_type FROM routes",
    "tagged": "SELECT p_partkey AS objectid, k AS key, CASE k WHEN 'highway' THEN CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'bus_stop' WHEN 1 THEN 'residential' WHEN 2 THEN 'motorway' WHEN 3 THEN 'trunk' ELSE 'steps' END WHEN 'amenity' THEN CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'bus_station' WHEN 1 THEN 'nightclub' WHEN 2 THEN 'parking' ELSE 'bench' END WHEN 'railway' THEN CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'tram' WHEN 1 THEN 'halt' ELSE 'yes' END WHEN 'name' THEN p_name WHEN 'addr:postcode' THEN concat(CAST(10000 + p_size AS STRING), CASE WHEN p_size % 9 = 0 THEN 'ABC' ELSE '' END) WHEN 'postal_code' THEN CAST(p_size AS STRING) WHEN 'phone' THEN CASE WHEN p_size % 2 = 0 THEN '+49 (0)30-12' ELSE 'call me' END WHEN 'ref' THEN 'r|1' ELSE lower(p_brand) END AS value FROM part CROSS JOIN (SELECT 'highway' AS k UNION ALL SELECT 'amenity' UNION ALL SELECT 'railway' UNION ALL SELECT 'name' UNION ALL SELECT 'addr:postcode' UNION ALL SELECT 'postal_code' UNION ALL SELECT 'phone' UNION ALL SELECT 'ref' UNION ALL SELECT 'brand') ks WHERE (p_partkey + length(k)) % 3 <> 0",
    # a timetable
    "calendar": "SELECT n_nationkey AS service_id, CASE WHEN n_nationkey % 3 <> 0 THEN 1 ELSE 0 END AS monday, CASE WHEN (n_nationkey + 1) % 3 <> 0 THEN 1 ELSE 0 END AS tuesday, CASE WHEN (n_nationkey + 2) % 3 <> 0 THEN 1 ELSE 0 END AS wednesday, CASE WHEN n_nationkey % 4 = 0 THEN 1 ELSE 0 END AS thursday, CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 0 END AS friday, CASE WHEN n_nationkey % 7 = 0 THEN 1 ELSE 0 END AS saturday, 0 AS sunday, CASE WHEN n_nationkey % 6 = 0 THEN DATE '2024-06-01' ELSE DATE '2024-01-01' END AS start_date, CASE WHEN n_nationkey % 8 = 0 THEN DATE '2024-02-10' ELSE DATE '2024-12-31' END AS end_date FROM nation",
    "stop_times": "SELECT wayid AS trip_id, wayid * 100 + pos AS stop_time_id, verid AS stop_id, pos AS stop_sequence, CAST(pos * 300 + (wayid % 86) * 600 AS INT) AS arrival, CAST(pos * 300 + (wayid % 86) * 600 + 30 AS INT) AS departure FROM way",
    "words": "SELECT doc_id, text FROM documents WHERE text IS NOT NULL",
    "lowered": "SELECT doc_id, lower(text) AS text FROM words",
}


def _uses(sql: str) -> list[str]:
    names = [*VIEWS, *BASE]
    return [n for n in names if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or given table as a DataFrame."""
    if name in BASE:
        return table(spark, sf_dir, name)
    sql = VIEWS[name]
    used = _uses(sql)
    for u in used:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{u}\b", rf"\1 {{{u}}}", sql)
    return spark.sql(sql, **{u: view(spark, sf_dir, u) for u in used})


def with_views(sql: str) -> str:
    """SQL with the views that it uses as common table expressions before it."""
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in _uses(text):
            if name in VIEWS and name not in ordered:
                need(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    need(sql)
    if not ordered:
        return sql
    heads = ", ".join(f"{n} AS ({VIEWS[n]})" for n in ordered)
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {heads}, {sql[15:]}"
    return f"WITH {heads}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {heads} {sql}"
