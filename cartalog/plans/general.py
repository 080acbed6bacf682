"""The queries of the general clean-up problems, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartalog.functions.geo import EARTH_RADIUS
from cartalog.operators.hierarchy import descendants, hierarchy
from cartalog.operators.packed import split_packed
from cartalog.operators.proximity import box_ring, near_pairs, points_in_regions
from cartalog.operators.wide import Attribute, to_long, to_wide
from cartalog.session import table

NEAR_METRES = 30.0
ATTRIBUTES = (
    Attribute("name", "text"),
    Attribute("amenity", "text"),
    Attribute("wheelchair", "boolean"),
    Attribute("fee", "boolean"),
    Attribute("capacity", "whole"),
    Attribute("building:levels", "whole"),
    Attribute("height", "length"),
    Attribute("ele", "length"),
    Attribute("start_date", "date"),
)
EDIT_ORDER = ("edit_no", "edited_at", "loaded_at")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of relations whose ref holds two or more."""
    return split_packed(table(spark, sf_dir, "osm_relation"), "rel_id", "ref", least=2).select("rel_id", "pos", "item")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(table(spark, sf_dir, "addrdecoder_areas"), "id", "parid")


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every area with every area above it, and the steps between."""
    return descendants(hierarchy(table(spark, sf_dir, "addrdecoder_areas"), "id", "parid"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, areas = table(spark, sf_dir, "vertex"), table(spark, sf_dir, "addrdecoder_areas")
    near = near_pairs(vertices, "verid", "lat", "lon", NEAR_METRES)
    boxes = areas.where("areatype = 'suburb'").withColumn("ring", box_ring(F.col("hl_lat"), F.col("hl_lon"), F.col("lr_lat"), F.col("lr_lon")))
    inside = points_in_regions(vertices, "verid", "lat", "lon", boxes, "id", "ring")
    return near.select(F.col("key").alias("verid"), F.lit("vertex").alias("other_kind"), F.col("other").alias("other_id")).unionByName(
        inside.select(F.col("key").alias("verid"), F.lit("area").alias("other_kind"), F.col("region").alias("other_id"))
    )


def p7_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per object, one typed column per attribute."""
    return to_wide(table(spark, sf_dir, "osm_tags"), "objectid", "key", "value", EDIT_ORDER, ATTRIBUTES)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_long(p7_wide(spark, sf_dir), "objectid", ATTRIBUTES)


QUERIES = {q.__name__: q for q in (p1_found, p5_found, p5_descendants, p6_found, p7_found, p7_wide)}

_WALK = """
WITH RECURSIVE n AS (SELECT id, min(parid) AS up FROM addrdecoder_areas WHERE id IS NOT NULL GROUP BY id),
e AS (SELECT n.id, CASE WHEN n.up <> n.id AND p.id IS NOT NULL THEN n.up END AS par FROM n LEFT JOIN n p ON p.id = n.up),
w AS (SELECT id, id AS node, [id] AS path, FALSE AS looped FROM e
      UNION ALL
      SELECT w.id, e.par, list_append(w.path, e.par), list_contains(w.path, e.par) FROM w JOIN e ON e.id = w.node WHERE e.par IS NOT NULL AND NOT w.looped),
z AS (SELECT id, arg_max(node, len(path)) AS last, max(len(path)) AS len, arg_max(path, len(path)) AS path, bool_or(looped) AS looped FROM w GROUP BY id)"""

SQL = {
    "p5_found": _WALK + """,
b AS (SELECT node AS id, count(*) - 1 AS below FROM w JOIN z ON z.id = w.id WHERE NOT z.looped GROUP BY node)
SELECT z.id, CASE WHEN NOT looped THEN 'tree' WHEN last = z.id THEN 'on_cycle' ELSE 'below_cycle' END AS node_kind,
  CASE WHEN looped THEN -1 ELSE last END AS root_id, CAST(CASE WHEN looped THEN -1 ELSE len - 1 END AS INT) AS n_above,
  CAST(CASE WHEN looped THEN -1 ELSE b.below END AS INT) AS n_below,
  CASE WHEN looped THEN '' ELSE array_to_string(list_reverse(z.path), '/') END AS id_path
FROM z LEFT JOIN b ON b.id = z.id""",
    "p5_descendants": _WALK + """
SELECT w.node AS above, w.id AS below, CAST(len(w.path) - 1 AS INT) AS steps FROM w JOIN z ON z.id = w.id WHERE NOT z.looped AND w.node <> w.id""",
    "p6_found": f"""
WITH v AS (SELECT DISTINCT verid, lat, lon FROM vertex WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND verid IS NOT NULL),
g AS (SELECT *, CAST(floor(lat * 1000) AS BIGINT) AS band FROM v),
h AS (SELECT *, unnest([band - 1, band, band + 1]) AS near FROM g),
s AS (SELECT DISTINCT id, least(hl_lat, lr_lat) AS s, greatest(hl_lat, lr_lat) AS n, least(hl_lon, lr_lon) AS w, greatest(hl_lon, lr_lon) AS e
      FROM addrdecoder_areas WHERE areatype = 'suburb' AND hl_lat BETWEEN -90 AND 90 AND lr_lat BETWEEN -90 AND 90 AND hl_lon BETWEEN -180 AND 180 AND lr_lon BETWEEN -180 AND 180)
SELECT a.verid, 'vertex' AS other_kind, b.verid AS other_id FROM g a JOIN h b ON b.near = a.band AND a.verid < b.verid
WHERE 2 * {EARTH_RADIUS}e0 * asin(sqrt(least(1e0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 30e0
UNION
SELECT v.verid, 'area', s.id FROM v JOIN s ON v.lat BETWEEN s.s AND s.n AND CASE WHEN s.e - s.w > 180 THEN v.lon >= s.e OR v.lon <= s.w ELSE v.lon BETWEEN s.w AND s.e END""",
}

_TAGS = r"""
WITH t AS (SELECT objectid, regexp_replace(lower(key), '^\s+|\s+$', '', 'g') AS attr, edit_no, edited_at, loaded_at, value FROM osm_tags WHERE objectid IS NOT NULL AND key IS NOT NULL),
d AS (SELECT * FROM t WHERE attr IN ('name', 'amenity', 'wheelchair', 'fee', 'capacity', 'building:levels', 'height', 'ele', 'start_date')
      QUALIFY row_number() OVER (PARTITION BY objectid, attr ORDER BY edit_no DESC NULLS LAST, edited_at DESC NULLS LAST, loaded_at DESC NULLS LAST, value DESC NULLS LAST) = 1),
c AS (SELECT objectid, attr, regexp_replace(value, '^\s+|\s+$', '', 'g') AS v FROM d WHERE value IS NOT NULL),
m AS (SELECT objectid, attr, v, regexp_replace(lower(replace(v, '−', '-')), '^([+-]?\d*),', '\1.') AS x FROM c)
"""
_DATES = r"""
COALESCE(
  TRY_CAST(CASE WHEN regexp_full_match(v, '\d{4}[-/.]\d{1,2}[-/.]\d{1,2}([T ]\d{1,2}:\d{2}(:\d{2})?)?') THEN regexp_replace(v, '^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2}).*$', '\1-\2-\3') END AS DATE),
  TRY_CAST(CASE WHEN regexp_full_match(v, '\d{8}') THEN regexp_replace(v, '^(\d{4})(\d{2})(\d{2})$', '\1-\2-\3') END AS DATE),
  TRY_CAST(CASE WHEN regexp_full_match(v, '\d{1,2}\.\d{1,2}\.\d{4}') THEN regexp_replace(v, '^(\d{1,2})\.(\d{1,2})\.(\d{4})$', '\3-\2-\1') END AS DATE),
  CAST(try_strptime(CASE WHEN regexp_full_match(v, '\d{1,2} [A-Za-z]{3} \d{4}') THEN v END, '%d %b %Y') AS DATE))"""
SQL["p7_found"] = (
    _TAGS
    + rf"""
SELECT objectid, attr, val FROM (
  SELECT objectid, attr, CASE
    WHEN attr IN ('name', 'amenity') THEN nullif(v, '')
    WHEN attr IN ('wheelchair', 'fee') THEN CASE WHEN lower(v) IN ('yes', 'y', 'true', '1', 'ja') THEN 'true' WHEN lower(v) IN ('no', 'n', 'false', '0', 'nein') THEN 'false' END
    WHEN attr IN ('capacity', 'building:levels') THEN CASE WHEN regexp_full_match(x, '[+-]?(\d+|\d{{1,3}}([ ,]\d{{3}})+)(\.0*)?') OR regexp_full_match(v, '\d{{1,3}},\d{{3}}')
      THEN CAST(TRY_CAST(regexp_replace(regexp_replace(v, '\.0*$', ''), '[ ,+]', '', 'g') AS BIGINT) AS VARCHAR) END
    WHEN attr IN ('height', 'ele') THEN CASE WHEN regexp_full_match(x, '[+-]?\d+(\.\d+)?\s*(m|cm)?')
      THEN printf('%.2f', TRY_CAST(regexp_extract(x, '^[+-]?\d+(\.\d+)?') AS DOUBLE) / CASE WHEN x LIKE '%cm' THEN 100e0 ELSE 1e0 END + 0e0) END
    ELSE strftime({_DATES}, '%Y-%m-%d') END AS val FROM m) WHERE val IS NOT NULL"""
)
