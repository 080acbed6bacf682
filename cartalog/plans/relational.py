"""Queries of the relational builder, tags and words, each with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartalog.functions import strings, tags
from cartalog.operators import search
from cartalog.operators.conditions import FieldConditions, key_begins, key_is
from cartalog.operators.query import Query, bounds, dense_ids, next_id
from cartalog.plans.views import view, with_views

Plan = Callable[[Callable[[str], DataFrame]], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None, plan: Plan, queries: dict | None = None, statements: dict | None = None) -> None:
    """A query over views by name, and its SQL."""
    queries, statements = QUERIES if queries is None else queries, SQL if statements is None else statements

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(lambda v: view(spark, sf_dir, v))

    run.__name__ = name
    queries[name] = run
    if sql is not None:
        statements[name] = with_views(sql)


#: Part of a configuration of fixed tags, as the configuration file has it: * for any value, a minus for values ruled out.
FIXED = {"amenity": ("*", "-bench"), "highway": ("bus_stop",), "railway": ("tram", "halt")}
_FIXED_SQL = "((key = 'amenity' AND regexp_matches(value, '^[a-z;_]*$') AND value <> 'bench') OR (key = 'highway' AND value = 'bus_stop') OR (key = 'railway' AND value IN ('tram', 'halt')))"
_USER_SQL = "(key LIKE 'name%' OR key IN ('email','fax','phone','website','wikipedia','opening_hours','operator','ref','postal_code','alt_name') OR key LIKE 'addr:%')"
_WRITE_SQL = "(NOT (key = 'ref' OR (key = 'amenity' AND value = 'public_building')))"

register("q_project_distinct", "SELECT DISTINCT p_brand, p_size FROM part", lambda t: Query().from_(t("part")).select("DISTINCT p_brand", "p_size").build())
register(
    "q_where_ops",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_discount < 0.05e0 AND l_returnflag <> 'R'",
    lambda t: Query().from_(t("lineitem")).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").where("l_quantity", ">=", 10).where("l_discount", "<", 0.05).where("l_returnflag", "<>", "R").build(),
)
register("q_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 15", lambda t: Query().from_(t("part")).select("p_partkey", "p_size").between("p_size", 5, 15).build())
register("q_prefix", "SELECT objectid, value FROM osm WHERE key = 'name' AND starts_with(value, 'Ge')", lambda t: Query().from_(t("osm")).select("objectid", "value").where("key", "=", "name").has_prefix("value", "Ge").build())
register("q_in_list", "SELECT verid, lat FROM pt WHERE verid IN (1, 5, 7, 11, 4000)", lambda t: Query().from_(t("pt")).select("verid", "lat").in_("verid", [1, 5, 7, 11, 4000]).build())
register("q_in_empty", "SELECT verid, lat FROM pt WHERE 1 = 0", lambda t: Query().from_(t("pt")).select("verid", "lat").in_("verid", []).build())
register(
    "q_in_subquery",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    lambda t: Query().from_(t("orders")).select("o_orderkey", "o_custkey").in_("o_custkey", Query().from_(t("customer")).select("c_custkey").where("c_mktsegment", "=", "BUILDING")).build(),
)
register(
    "q_in_any",
    "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09e0)",
    lambda t: Query().from_(t("part")).select("p_partkey").in_any("p_partkey", [Query().from_(t("lineitem")).select("l_partkey").where("l_quantity", ">", 49), Query().from_(t("lineitem")).select("l_partkey").where("l_discount", ">", 0.09)]).build(),
)
register(
    "q_from_subquery",
    "SELECT a.c_nationkey, a.c_custkey FROM (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 5000) a WHERE a.c_nationkey < 5",
    lambda t: Query().from_(Query().from_(t("customer")).select("c_custkey", "c_nationkey").where("c_acctbal", ">", 5000), "a").select("a.c_nationkey", "a.c_custkey").where("a.c_nationkey", "<", 5).build(),
)
register("q_from_tables", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", lambda t: Query().from_([t("nation"), t("region")]).select("n_name", "r_name").where("n_regionkey = r_regionkey").build())
register("q_join_equi", "SELECT objectid, key, osm_id FROM osm JOIN (SELECT internal_id AS objectid, osm_id FROM osm_id) i USING (objectid)", lambda t: Query().from_(t("osm")).join(t("osm_id").withColumnRenamed("internal_id", "objectid"), ["objectid"]).select("objectid", "key", "osm_id").build())
register(
    "q_join_chain",
    "SELECT s.l_partkey AS partkey, count(*) AS n FROM lineitem s JOIN part p ON p.p_partkey = s.l_partkey JOIN (SELECT DISTINCT s_suppkey FROM supplier) u ON u.s_suppkey = s.l_suppkey GROUP BY s.l_partkey",
    lambda t: Query().from_(t("lineitem").withColumnsRenamed({"l_partkey": "partkey", "l_suppkey": "suppkey"})).join(t("part").select(F.col("p_partkey").alias("partkey")), ["partkey"]).join_all([t("supplier").select(F.col("s_suppkey").alias("suppkey")).distinct()], ["suppkey"]).select("partkey", "count(*) AS n").group_by("partkey").build(),
)
register(
    "q_lookup_positional",
    "SELECT w.wayid, w.pos, w.verid AS id, p.lat, p.lon, p.lat IS NOT NULL AS found FROM way w LEFT JOIN (SELECT * FROM vx WHERE verid % 10 <> 3) p ON p.verid = w.verid",
    lambda t: search.positional_points(t("way").groupBy("wayid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "verid"))), lambda x: x["verid"]).alias("ids")), t("vx").where("verid % 10 <> 3")),
)
register("q_id_translate", "SELECT o.objectid AS internal_id, i.osm_id FROM (SELECT DISTINCT objectid FROM osm UNION SELECT 999999999) o LEFT JOIN osm_id i ON i.internal_id = o.objectid", lambda t: search.translate_ids(t("osm").select("objectid").distinct().union(t("osm").sparkSession.createDataFrame([(999999999,)], "objectid bigint")).withColumnRenamed("objectid", "internal_id"), t("osm_id"), "internal_id", "osm_id"))
register("q_id_kind", "SELECT osm_id, CASE WHEN osm_id LIKE 'n%' THEN 'node' WHEN osm_id LIKE 'w%' THEN 'way' END AS kind FROM osm_id", lambda t: t("osm_id").select("osm_id", search.id_kind(F.col("osm_id")).alias("kind")))
register("q_group_members", "SELECT groupid, list(objectid ORDER BY objectorder, objectid) AS objects FROM rel GROUP BY groupid", lambda t: search.group_members(t("rel")))
register("q_groups_of", "SELECT objectid, list_sort(list(DISTINCT groupid)) AS groups FROM rel GROUP BY objectid", lambda t: search.groups_of(t("rel")))
register(
    "q_group_having",
    "SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_orderpriority HAVING count(*) > 10",
    lambda t: Query().from_(t("orders")).select("o_orderpriority", "count(*) AS n", "max(o_totalprice) AS top").group_by("o_orderpriority").having("n > 10").build(),
)
register("q_order_multi", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey ASC, c_acctbal DESC, c_custkey DESC LIMIT 50", lambda t: Query().from_(t("customer")).select("c_custkey", "c_nationkey", "c_acctbal").order_desc("c_acctbal", "c_custkey").order_asc("c_nationkey").limit(50).build())
register("q_limit_offset", "SELECT DISTINCT objectid FROM osm ORDER BY objectid LIMIT 10 OFFSET 20", lambda t: Query().from_(t("osm")).select("DISTINCT objectid").order_asc("objectid").limit(10).offset(20).build())
register("q_union", "SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 0", lambda t: Query().from_(t("customer")).select("c_nationkey AS nationkey").where("c_acctbal", "<", 0).unite(Query().from_(t("supplier")).select("s_nationkey AS nationkey").where("s_acctbal", ">", 0)).build())
register("q_intersect", "SELECT l_partkey AS partkey FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT p_partkey FROM part WHERE p_size < 20", lambda t: Query().from_(t("lineitem")).select("l_partkey AS partkey").where("l_quantity", ">", 45).intersect(Query().from_(t("part")).select("p_partkey AS partkey").where("p_size", "<", 20)).build())
register("q_bounds", "SELECT max(lat) AS hi_lat, min(lon) AS hi_lon, min(lat) AS lo_lat, max(lon) AS lo_lon FROM pt", lambda t: bounds(t("pt")))
register("q_count", "SELECT count(*) AS n FROM osm", lambda t: t("osm").agg(F.count(F.lit(1)).alias("n")))
register("q_next_id", "SELECT max(objectid) + 1 AS next_id FROM osm", lambda t: next_id(t("osm"), "objectid"))
register("q_dense_ids", "SELECT key, row_number() OVER (ORDER BY key) - 1 AS dense_id FROM (SELECT DISTINCT key FROM osm)", lambda t: dense_ids(t("osm"), "key"))
register("q_reconcile", "SELECT 'osm' AS name, count(*) AS n, count(DISTINCT objectid) AS ids FROM osm UNION ALL SELECT 'pt', count(*), count(DISTINCT verid) FROM pt", lambda t: t("osm").agg(F.lit("osm").alias("name"), F.count(F.lit(1)).alias("n"), F.count_distinct("objectid").alias("ids")).union(t("pt").agg(F.lit("pt"), F.count(F.lit(1)), F.count_distinct("verid"))))

# tags
_SEARCH = "WITH ids AS (SELECT objectid FROM osm WHERE {a} INTERSECT SELECT objectid FROM osm WHERE {b} ORDER BY objectid LIMIT {n} OFFSET {m}) SELECT o.objectid, list_sort(list(DISTINCT concat(o.key, '=', o.value))) AS tags FROM osm o JOIN ids i ON i.objectid = o.objectid GROUP BY o.objectid"


def _flat(df: DataFrame) -> DataFrame:
    return df.select("objectid", F.array_sort(F.array_distinct(F.transform("tags", lambda x: F.concat(x["key"], F.lit("="), x["value"])))).alias("tags"))


register("q_tag_search", _SEARCH.format(a="key = 'amenity' AND value = 'cafe'", b="key = 'wheelchair' AND value = 'yes'", n=10, m=0), lambda t: _flat(search.simple_search(t("osm"), [key_is("amenity", "cafe"), key_is("wheelchair", "yes")])))
register("q_tag_search_multi", _SEARCH.format(a="key = 'name' AND starts_with(value, 'G')", b="key = 'capacity' AND value >= '2'", n=25, m=5), lambda t: _flat(search.simple_search(t("osm"), [key_begins("name", "G"), FieldConditions((("key", "=", "capacity"), ("value", ">=", "2")))], 5, 25)))
register("q_tags_by_ids", "SELECT objectid, list_sort(list(DISTINCT concat(key, '=', value))) AS tags FROM osm WHERE objectid IN (1000, 1001, 1002, 1003, 777) GROUP BY objectid", lambda t: _flat(search.collect_tags(t("osm").where(F.col("objectid").isin(1000, 1001, 1002, 1003, 777)))))
register("q_tag_json", None, lambda t: search.tags_json(t("osm")))
register("q_tag_suggest", "SELECT DISTINCT key AS en FROM osm WHERE starts_with(key, 'w')", lambda t: search.suggest(t("osm").select(F.col("key").alias("en")), "w"))
register("q_vocabulary", "SELECT DISTINCT key, count(*) AS n FROM osm GROUP BY key", lambda t: t("osm").groupBy("key").agg(F.count(F.lit(1)).alias("n")))
register("q_eav_upsert", "SELECT objectid, key, value FROM osm UNION SELECT p_partkey, 'name', p_name FROM part", lambda t: search.eav_upsert(t("osm"), t("part").select(F.col("p_partkey").alias("objectid"), F.lit("name").alias("key"), F.col("p_name").alias("value"))))
_BASE36 = "WITH RECURSIVE k AS (SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS number FROM (SELECT DISTINCT key AS tag FROM osm)), d AS (SELECT tag, number // 36 AS rest, substr('abcdefghijklmnopqrstuvwxyz0123456789', CAST(number % 36 + 1 AS INT), 1) AS code FROM k UNION ALL SELECT tag, rest // 36, code || substr('abcdefghijklmnopqrstuvwxyz0123456789', CAST(rest % 36 + 1 AS INT), 1) FROM d WHERE rest > 0) "
register("q_tag_dictionary", _BASE36 + "SELECT tag, 'q' || code || 'q' AS hash FROM d WHERE rest = 0", lambda t: search.tag_dictionary(t("osm").withColumnRenamed("key", "tag")))
register("q_tag_round_trip", "SELECT objectid, key, value FROM osm", lambda t: (lambda d: search.decode_keys(search.encode_keys(t("osm"), d), d))(search.tag_dictionary(t("osm").withColumnRenamed("key", "tag"))))
register(
    "q_fixed_tags",
    "SELECT objectid, key, value FROM tagged WHERE key IN ('amenity', 'railway')",
    lambda t: (lambda fixed: (lambda d: search.fixed_tags(fixed.join(d, "tag").select("objectid", F.col("hash").alias("tag")), d))(search.tag_dictionary(fixed)))(t("tagged").where("key in ('amenity', 'railway')").select("objectid", F.concat("key", F.lit("="), "value").alias("tag"))),
)
register(
    "q_canonical_tag",
    "SELECT objectid, CASE WHEN key = 'highway' AND value = 'bus_stop' THEN 'public_transport' WHEN key = 'amenity' AND value = 'bus_station' THEN 'public_transport' WHEN key = 'railway' AND value = 'tram' THEN 'public_transport' WHEN key = 'postal_code' THEN 'addr:postcode' ELSE key END AS ckey, CASE WHEN key = 'highway' AND value = 'bus_stop' THEN 'bus_stop' WHEN key = 'amenity' AND value = 'bus_station' THEN 'bus_stop' WHEN key = 'railway' AND value = 'tram' THEN 'tram' WHEN key = 'railway' AND value = 'halt' THEN 'stop' WHEN key = 'amenity' AND value = 'nightclub' THEN 'club' ELSE value END AS cvalue FROM tagged",
    lambda t: t("tagged").select("objectid", tags.canonical(F.col("key"), F.col("value")).alias("c")).select("objectid", F.col("c.key").alias("ckey"), F.col("c.value").alias("cvalue")),
)
register(
    "q_accept_tag",
    f"SELECT objectid, key, value FROM tagged WHERE ({_FIXED_SQL} AND {_WRITE_SQL}) OR {_USER_SQL}",
    lambda t: t("tagged").where(tags.accept_tag(F.col("key"), F.col("value"), FIXED)),
)
register(
    "q_valid_user_pair",
    "SELECT objectid, key, value FROM tagged WHERE CASE WHEN key = 'addr:postcode' THEN regexp_matches(value, '^[A-Za-z0-9 -]*$') AND length(regexp_replace(value, '[^A-Za-z]', '', 'g')) <= 2 WHEN key IN ('phone', 'fax') THEN regexp_matches(value, '^[0-9()+ -]*$') ELSE TRUE END",
    lambda t: t("tagged").where(tags.valid_user_pair(F.col("key"), F.col("value"))),
)
register(
    "q_tag_predicates",
    f"SELECT key, value, count(*) AS n, bool_or(key IN ('leisure','railway','tourism','public_transport','shop')) AS full_text, bool_or(key NOT IN ('email','fax','phone','website','wikipedia','opening_hours','addr:housenumber')) AS full_pair, bool_or(value NOT LIKE '%|%') AS valid, bool_or({_WRITE_SQL}) AS writes, bool_or((key = 'amenity' AND value = 'parking') OR key IN ('highway', 'ref')) AS alone, bool_or(key IN ('amenity','highway')) AS aggregate, bool_or(regexp_matches(value, '^[a-z;_]*$')) AS fixed_value, bool_or(value NOT IN ('yes','no','limited','true','false','maybe','1','0','german')) AS no_meta FROM tagged WHERE key IN ('highway','amenity','railway','postal_code','ref','phone') GROUP BY key, value",
    lambda t: t("tagged")
    .where("key in ('highway','amenity','railway','postal_code','ref','phone')")
    .groupBy("key", "value")
    .agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(tags.is_full_text(F.col("key"))).alias("full_text"), F.bool_or(tags.is_full_text_pair(F.col("key"))).alias("full_pair"), F.bool_or(tags.valid_value(F.col("value"))).alias("valid"),
        F.bool_or(tags.writable(F.col("key"), F.col("value"))).alias("writes"), F.bool_or(tags.alone_deprecated(F.col("key"), F.col("value"))).alias("alone"), F.bool_or(tags.is_aggregate(F.col("key"))).alias("aggregate"),
        F.bool_or(tags.valid_fixed_value(F.col("value"))).alias("fixed_value"), F.bool_or(tags.is_meta_free(F.col("value"))).alias("no_meta"),
    ),
)
register(
    "q_tag_rank",
    f"SELECT objectid, CAST(sum(1 + CASE WHEN {_WRITE_SQL} THEN CASE WHEN ({_FIXED_SQL} AND {_WRITE_SQL}) OR {_USER_SQL} THEN 1 ELSE 0 END + CASE WHEN {_USER_SQL} THEN 2 ELSE 0 END + CASE WHEN key LIKE 'addr:%' THEN 2 ELSE 0 END + CASE WHEN key LIKE 'name%' THEN 30 ELSE 0 END ELSE 0 END) AS INT) AS rank FROM tagged GROUP BY objectid",
    lambda t: t("tagged").groupBy("objectid").agg(F.collect_list(F.struct("key", "value")).alias("tags")).select("objectid", tags.rank_object(F.col("tags"), FIXED).alias("rank")),
)
register(
    "q_accept_object",
    f"SELECT DISTINCT objectid FROM tagged WHERE ({_WRITE_SQL} AND {_FIXED_SQL} AND NOT ((key = 'amenity' AND value = 'parking') OR key IN ('highway', 'ref'))) OR key IN ('phone', 'name', 'ref', 'postal_code')",
    lambda t: t("tagged").groupBy("objectid").agg(F.collect_list(F.struct("key", "value")).alias("tags")).where(tags.accept_object(F.col("tags"), FIXED)).select("objectid"),
)
register(
    "q_area_levels",
    "SELECT areatype, CASE areatype WHEN 'country' THEN 0 WHEN 'province' THEN 1 WHEN 'region' THEN 1 WHEN 'county' THEN 1 WHEN 'state' THEN 1 WHEN 'island' THEN 2 WHEN 'archipelago' THEN 2 WHEN 'village' THEN 2 WHEN 'town' THEN 2 WHEN 'city' THEN 2 WHEN 'street' THEN 4 WHEN 'postcode' THEN 4 ELSE 3 END AS level, count(*) AS n FROM area GROUP BY areatype",
    lambda t: t("area").groupBy("areatype").agg(F.count(F.lit(1)).alias("n")).withColumn("level", tags.area_level(F.col("areatype"))),
)
register("q_filter_tags", "SELECT objectid, coalesce(list_sort(list(DISTINCT key) FILTER (WHERE key NOT LIKE 'addr:%' AND key <> 'note')), []) AS keys FROM osm GROUP BY objectid", lambda t: t("osm").groupBy("objectid").agg(F.collect_set("key").alias("k")).select("objectid", F.array_sort(F.filter("k", lambda x: ~tags.is_address(x) & (x != "note"))).alias("keys")))
register("q_style_group", "SELECT value, CASE value WHEN 'motorway' THEN 'motorway' WHEN 'trunk' THEN 'motorway' WHEN 'residential' THEN 'minorroad' WHEN 'steps' THEN 'noauto' WHEN 'tram' THEN 'railway' ELSE 'other' END AS style, count(*) AS n FROM tagged WHERE key IN ('highway', 'railway') GROUP BY value", lambda t: t("tagged").where("key in ('highway', 'railway')").groupBy("value").agg(F.count(F.lit(1)).alias("n")).withColumn("style", tags.style_group(F.col("value"))))
LAYERS = {"ln_motorway": {"highway": ("motorway", "trunk")}, "pt_transit": {"railway": ("*",), "name": ("*",)}, "pt_amenity": {"amenity": ("*",)}}
register(
    "q_layer_pick",
    "WITH m AS (SELECT objectid, max(CASE WHEN key = 'highway' THEN value END) AS h, max(CASE WHEN key = 'railway' THEN value END) AS r, max(CASE WHEN key = 'name' THEN value END) AS n, max(CASE WHEN key = 'amenity' THEN value END) AS a FROM tagged GROUP BY objectid) SELECT objectid, CASE WHEN h IN ('motorway', 'trunk') THEN 'ln_motorway' WHEN r IS NOT NULL AND n IS NOT NULL THEN 'pt_transit' WHEN a IS NOT NULL THEN 'pt_amenity' END AS layer FROM m",
    lambda t: t("tagged").groupBy("objectid").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("tags")).select("objectid", tags.pick_layer(F.col("tags"), LAYERS).alias("layer")),
)
_ROAD = "highway IN ('motorway','motorway_link','trunk','trunk_link','primary','primary_link','secondary','secondary_link','tertiary','tertiary_link','residential','unclassified','living_street','road') AND (access IS NULL OR access IN ('yes','designated','permissive','unknown','destination','customer','official'))"
register("q_edge_filter", f"SELECT wayid FROM highway WHERE {_ROAD}", lambda t: t("highway").where(tags.is_road({"highway": F.col("highway"), "access": F.col("access")})).select("wayid"))
register(
    "q_speed_oneway",
    "SELECT wayid, CAST(floor(CASE highway WHEN 'motorway' THEN 140 WHEN 'motorway_link' THEN 80 WHEN 'trunk' THEN 100 WHEN 'trunk_link' THEN 80 WHEN 'primary' THEN 120 WHEN 'secondary' THEN 90 WHEN 'tertiary' THEN 80 WHEN 'residential' THEN 60 WHEN 'unclassified' THEN 20 WHEN 'living_street' THEN 20 WHEN 'road' THEN 80 END * 0.277778e0) AS INT) AS mps, CASE WHEN oneway IN ('true','1','yes','-1','reverse') THEN TRUE WHEN oneway IN ('false','0','no') THEN FALSE ELSE coalesce(highway IN ('motorway','motorway_link','trunk'), FALSE) OR coalesce(junction = 'roundabout', FALSE) END AS one_way, coalesce(oneway IN ('-1','reverse'), FALSE) AS reversed FROM highway",
    lambda t: t("highway").select("wayid", tags.speed(F.col("highway")).alias("mps"), tags.one_way(F.col("oneway"), F.col("highway"), F.col("junction")).alias("one_way"), tags.is_reversed(F.col("oneway")).alias("reversed")),
)
register("q_footways", "SELECT wayid, 10 AS mps FROM highway WHERE highway IN ('trunk','living_street','footway','primary','secondary','tertiary','unclassified','residential','road','service')", lambda t: t("highway").where(tags.is_footway(F.col("highway"))).select("wayid", F.lit(tags.WALKING_SPEED).alias("mps")))

# words
_TOKENS = "WITH d AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(text, '[^a-z0-9#&+]+'), lambda x: x <> '')) AS tokens FROM lowered) "


def _documents(t: Callable[[str], DataFrame]) -> DataFrame:
    # Plain ASCII words, which both engines cut alike; search_words() is tested for the others.
    return t("lowered").select(F.col("doc_id").alias("docid"), F.array_distinct(F.filter(F.split("text", "[^a-z0-9#&+]+"), lambda w: w != "")).alias("tokens"), ((F.col("doc_id") * 7919) % 1000003 + 1000000).alias("curve"))


register("q_fulltext_exact", _TOKENS + "SELECT doc_id AS docid FROM d WHERE list_contains(tokens, 'bridge') AND list_contains(tokens, 'line')", lambda t: search.fulltext_ids(_documents(t), ["bridge", "line"]))
register("q_fulltext_prefix", _TOKENS + "SELECT doc_id AS docid FROM d WHERE list_contains(tokens, 'line') AND len(list_filter(tokens, lambda x: starts_with(x, 'carr'))) > 0", lambda t: search.fulltext_ids(_documents(t), ["line"], ["carr"]))
register(
    "q_fulltext_location",
    _TOKENS
    + "h AS (SELECT doc_id AS docid, CASE WHEN starts_with(c, '12345') THEN 2 WHEN starts_with(c, '1234') THEN 3 WHEN starts_with(c, '123') THEN 4 WHEN starts_with(c, '1') THEN 6 ELSE 8 END AS level FROM (SELECT doc_id, CAST((doc_id * 7919) % 1000003 + 1000000 AS VARCHAR) AS c FROM d WHERE list_contains(tokens, 'line'))), c AS (SELECT level, sum(count(*)) OVER (ORDER BY level) AS n FROM h GROUP BY level), e AS (SELECT coalesce(min(level), 99) AS enough FROM c WHERE n - 3 >= 20) SELECT docid FROM h, e WHERE level <= enough ORDER BY docid LIMIT 20 OFFSET 3".replace(") h AS", "), h AS"),
    lambda t: search.fulltext_near(_documents(t), 1234567, ["line"], offset=3, limit=20),
)
SQL["q_fulltext_location"] = SQL["q_fulltext_location"].replace("FROM lowered) h AS", "FROM lowered), h AS")
register("q_fulltext_index", None, lambda t: search.indexed_ids(search.token_index(_documents(t)), ["line"], ["carr"]))
SQL["q_fulltext_index"] = SQL["q_fulltext_prefix"]
register("q_fulltext_documents", None, lambda t: search.search_documents(t("tagged"), t("vx").withColumnRenamed("verid", "objectid"), FIXED))
register("q_stored_tags", None, lambda t: (lambda free, fixed: free.select("objectid", F.concat("key", F.lit("~"), "value").alias("tag")).unionByName(fixed))(*search.store_tags(t("tagged"), FIXED)))

# scalars
register("q_tokenize", "SELECT p_partkey, string_split(p_name, ' ') AS parts FROM part", lambda t: t("part").select("p_partkey", strings.tokenize(F.col("p_name"), " ").alias("parts")))
register("q_base36", "WITH RECURSIVE k AS (SELECT p_partkey AS number FROM part), d AS (SELECT number, number // 36 AS rest, substr('abcdefghijklmnopqrstuvwxyz0123456789', CAST(number % 36 + 1 AS INT), 1) AS code FROM k UNION ALL SELECT number, rest // 36, code || substr('abcdefghijklmnopqrstuvwxyz0123456789', CAST(rest % 36 + 1 AS INT), 1) FROM d WHERE rest > 0) SELECT number, code FROM d WHERE rest = 0", lambda t: t("part").select(F.col("p_partkey").alias("number"), strings.base36(F.col("p_partkey")).alias("code")))
register("q_hex", "SELECT doc_id, lower(hex(text)) AS code FROM words", lambda t: t("words").select("doc_id", strings.hex_text(F.col("text")).alias("code")))
register("q_base64", "SELECT doc_id, to_base64(encode(text)) AS code FROM words", lambda t: t("words").select("doc_id", F.replace(F.replace(strings.base64_text(F.col("text")), F.lit("\r\n"), F.lit("")), F.lit("\n"), F.lit("")).alias("code")))
register("q_base64_round_trip", "SELECT doc_id, text FROM words", lambda t: t("words").select("doc_id", strings.base64_decoded(strings.base64_text(F.col("text"))).alias("text")))
register("q_filter_words", r"SELECT p_partkey, list_filter(list_transform(string_split(p_type, ' '), lambda x: regexp_replace(x, '[[:punct:]]', '', 'g')), lambda x: x <> '') AS parts FROM part", lambda t: t("part").select("p_partkey", strings.filter_words(F.split("p_type", " ")).alias("parts")))
register("q_escape", r"""SELECT objectid, key, translate(regexp_replace(value, '^[ \n\r\t]+|[ \n\r\t]+$', '', 'g'), chr(34) || '/' || chr(92) || chr(8) || chr(12) || chr(10) || chr(13) || chr(9) || chr(39), '') AS value FROM osm""", lambda t: t("osm").select("objectid", "key", strings.escape(F.col("value")).alias("value")))
register("q_lexical_int", r"SELECT objectid, value, coalesce(try_cast(nullif(regexp_extract(value, '^\s*([+-]?[0-9]+)', 1), '') AS INT), 0) AS number FROM osm WHERE key = 'capacity'", lambda t: t("osm").where("key = 'capacity'").select("objectid", "value", strings.lexical_int(F.col("value")).alias("number")))
