"""The service's endpoints as functions: arguments in, one row of JSON out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartalog import __version__
from cartalog.functions.curve import peano
from cartalog.operators import graph, search, spatial, tiles

#: Waypoints of a route at most, and graphs held at a time.
MOST_WAYPOINTS, MOST_GRAPHS = 150, 10


class RequestError(ValueError):
    """Arguments that no answer can be given for."""


@dataclass
class MapFile:
    """The tables of one map: osm (objectid, key, value), places (objectid, lat, lon), docs (docid, tokens, curve), edge, vertex, osm_id, info, arrivals (verid, arrival)."""

    osm: DataFrame
    places: DataFrame
    docs: DataFrame | None = None
    edge: DataFrame | None = None
    vertex: DataFrame | None = None
    osm_id: DataFrame | None = None
    info: DataFrame | None = None
    arrivals: DataFrame | None = None


def parse_points(text: str) -> list[tuple[float, float]]:
    """lat,lon pairs between bars, in range."""
    points = []
    for part in text.replace("+", " ").strip("[]").split("|"):
        try:
            lat, lon = (float(v) for v in part.split(","))
        except ValueError as e:
            raise RequestError(f"no point: {part}") from e
        if not (-90 <= lat <= 90 and -180 <= lon <= 180):
            raise RequestError(f"out of range: {part}")
        points.append((lat, lon))
    return points


def answer(df: DataFrame) -> DataFrame:
    """(json): ok, version and the rows as response; responses are pages of bounded size."""
    rows = df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias("response"))
    return rows.select(F.to_json(F.struct(F.lit(True).alias("ok"), F.lit(__version__).alias("version"), "response")).alias("json"))


def refused(spark: SparkSession, error: str) -> DataFrame:
    return spark.range(1).select(F.to_json(F.struct(F.lit(False).alias("ok"), F.lit(__version__).alias("version"), F.lit(error).alias("error"))).alias("json"))


@dataclass
class Service:
    spark: SparkSession
    maps: dict[str, MapFile] = field(default_factory=dict)
    graphs: dict[str, DataFrame] = field(default_factory=dict)

    def _map(self, name: str) -> MapFile:
        if name not in self.maps:
            raise RequestError(f"no map {name}")
        return self.maps[name]

    def call(self, endpoint: str, **arguments) -> DataFrame:
        """The answer of an endpoint, or the error that it gives."""
        try:
            return getattr(self, endpoint)(**arguments)
        except RequestError as e:
            return refused(self.spark, str(e))

    def search_query(self, mapname: str, q: str = "", tags: Sequence[str] = (), tagsvals: Sequence[tuple[str, str]] = (), near: str = "", offset: int = 0, limit: int = search.PAGE) -> DataFrame:
        m = self._map(mapname)
        exact, begins = [*tags, *[f"{k}={v}" for k, v in tagsvals]], q.lower().split()
        if near:
            lat, lon = parse_points(near)[0]
            curve = self.spark.range(1).select(peano(F.lit(lat), F.lit(lon)).alias("c")).first()["c"]
            ids = search.fulltext_near(m.docs, curve, exact, begins, offset, limit)
        else:
            ids = search.page(search.fulltext_ids(m.docs, exact, begins), offset, limit, "docid")
        return answer(search.collect_tags(m.osm.join(F.broadcast(ids.withColumnRenamed("docid", "objectid")), "objectid", "left_semi")))

    def search_ids(self, mapname: str, ids: Sequence[int]) -> DataFrame:
        m = self._map(mapname)
        wanted = self.spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "pos int, objectid bigint")
        found = search.collect_tags(m.osm.join(F.broadcast(wanted), "objectid", "left_semi"))
        return answer(wanted.join(found, "objectid").select("pos", "objectid", "tags"))

    def search_nearest(self, mapname: str, points: str, decode: bool = False) -> DataFrame:
        m = self._map(mapname)
        targets = self.spark.createDataFrame([(k, *p) for k, p in enumerate(parse_points(points))], "target int, tlat double, tlon double")
        near = spatial.nearest_expanding(m.places, targets, "objectid")
        rows = near.join(search.collect_tags(m.osm.join(F.broadcast(near.select("objectid")), "objectid", "left_semi")), "objectid", "left").select("target", "objectid", "lat", "lon", "tags")
        if decode:
            address = spatial.reverse_geocode(m.osm, m.places, targets).groupBy("target").agg(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("addr:"), "area").alias("key"), "value"))).alias("address"))
            rows = rows.join(address, "target", "left").select("target", "objectid", "lat", "lon", F.concat(F.filter(F.coalesce("tags", F.array().cast("array<struct<key:string,value:string>>")), lambda t: ~t["key"].startswith("addr:")), F.coalesce("address", F.array().cast("array<struct<key:string,value:string>>"))).alias("tags"))
        return answer(rows)

    def graph_load(self, mapname: str) -> DataFrame:
        if len(self.graphs) >= MOST_GRAPHS and mapname not in self.graphs:
            raise RequestError("too many graphs")
        self.graphs[mapname] = self._map(mapname).edge.cache()
        return self.graph_list()

    def graph_unload(self, mapname: str) -> DataFrame:
        if mapname not in self.graphs:
            raise RequestError(f"{mapname} is not loaded")
        self.graphs.pop(mapname).unpersist()
        return self.graph_list()

    def graph_list(self) -> DataFrame:
        return answer(self.spark.createDataFrame([(g,) for g in sorted(self.graphs)], "mapname string"))

    def graph_nearest(self, mapname: str, lat: float, lon: float) -> DataFrame:
        parse_points(f"{lat},{lon}")
        return answer(spatial.nearest_expanding(self._map(mapname).vertex, self.spark.createDataFrame([(0, float(lat), float(lon))], "target int, tlat double, tlon double")))

    def graph_route(self, mapname: str, waypoints: str, metric: str = "distance") -> DataFrame:
        """Legs between consecutive waypoints: snapped ends, length, points and ways; the metric is distance or time."""
        m, points = self._map(mapname), parse_points(waypoints)
        if not 2 <= len(points) <= MOST_WAYPOINTS:
            raise RequestError("two waypoints at least, and not too many")
        if metric not in ("distance", "time"):
            raise RequestError(f"no metric {metric}")
        edges = self.graphs.get(mapname, m.edge)
        targets = self.spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "target int, tlat double, tlon double")
        snapped = spatial.nearest_expanding(m.vertex, targets).select(F.lit(0).alias("request"), F.col("target").alias("pos"), "verid")
        pairs = graph.waypoint_pairs(snapped).select(F.col("pair.pos").alias("pair"), "src", "dst")
        if m.arrivals is not None:  # a path ends at a restricted point by a point of its own
            ends = pairs.join(m.arrivals.withColumnRenamed("verid", "dst"), "dst", "left")
            pairs = ends.select("pair", "src", F.coalesce("arrival", "dst").alias("dst"))
        paths = graph.routes(edges, pairs, "cost" if metric == "distance" else "timecost")
        ways = graph.path_ways(paths, edges).groupBy("pair").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "way"))), lambda w: w["way"]).alias("ways"))
        if "via" in edges.columns:
            paths = graph.expanded(paths, edges)
        legs = paths.join(graph.path_points(paths, m.vertex), "pair", "left").join(ways, "pair", "left")
        return answer(legs.select(F.col("pair").alias("leg"), F.col("dist").alias("length"), "path", "line", "ways"))

    def match_tags(self, mapname: str, tag: str) -> DataFrame:
        return answer(search.suggest(self._map(mapname).osm.select(F.col("key").alias("en")), tag))

    def map_info(self, mapname: str) -> DataFrame:
        info = self._map(mapname).info
        return answer(info if info is not None else map_info_rows(self.maps[mapname].places))

    def list_maps(self) -> DataFrame:
        return answer(self.spark.createDataFrame([(m,) for m in sorted(self.maps)], "mapname string"))

    def get_tile(self, features: DataFrame, x: int, y: int, z: int) -> DataFrame:
        return answer(tiles.tile_features(features, x, y, z))

    def write_data(self, mapname: str, rows: Sequence[tuple[int, str, str]]) -> DataFrame:
        m = self._map(mapname)
        m.osm = search.eav_upsert(m.osm, self.spark.createDataFrame(list(rows), "objectid bigint, key string, value string"))
        return self.search_ids(mapname, [r[0] for r in rows])


def map_info_rows(places: DataFrame, features: Sequence[str] = ("search", "routing"), comment: str = "") -> DataFrame:
    """(objectid, tag, value) of object 0: the bounding box, the features, a comment."""
    box = places.agg(F.concat_ws(",", F.max("lat"), F.min("lon"), F.min("lat"), F.max("lon")).alias("bbox"))
    rows = [F.struct(F.lit(tag).alias("tag"), value.alias("value")) for tag, value in (("bbox", F.col("bbox")), ("features", F.lit(",".join(features))), ("comment", F.lit(comment)))]
    return box.select(F.lit(0).alias("objectid"), F.inline(F.array(*rows)))


def ingest(osm: DataFrame, config: dict, pedestrian: bool = False) -> dict[str, DataFrame]:
    """The tables of a map file from the rows of an extract: vertex, edge, turn restrictions, tags, documents, places, ids and groups.

    Edges obey the restrictions (graph.restricted_graph()): arrivals tells by which point a path ends at a restricted one.
    """
    from cartalog.functions import tags as t
    from cartalog.sources import osm as source

    nodes, refs, pairs = source.node_points(osm), source.way_refs(osm), source.object_tags(osm)
    way_tags = pairs.where("kind = 'way'").groupBy("objectid").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in ("highway", "oneway", "junction", "construction", "motorcycle", *t.ACCESS_KEYS)])
    roads = way_tags.where(t.is_footway(F.col("highway")) if pedestrian else t.is_road({k: F.col(k) for k in ("highway", "construction", "motorcycle", *t.ACCESS_KEYS)})).withColumnRenamed("objectid", "wayid")
    way = refs.join(roads.select("wayid"), "wayid", "left_semi").join(nodes.select("verid"), "verid", "left_semi")
    ends = graph.repaired_ends(way, nodes, graph.endpoints(way))
    one = F.lit(False) if pedestrian else t.one_way(F.col("oneway"), F.col("highway"), F.col("junction"))
    speed = F.lit(t.WALKING_SPEED) if pedestrian else t.speed(F.col("highway"))
    cut = graph.segments(way, nodes, ends, hops=True).join(roads.select("wayid", one.alias("oneway"), (F.lit(False) if pedestrian else t.is_reversed(F.col("oneway"))).alias("reversed"), speed.alias("speed")), "wayid")
    back = lambda a, b: F.when(F.col("reversed"), F.col(b)).otherwise(F.col(a)).alias(a)
    both = [back(a, b) for x, y in (("startid", "endid"), ("second", "before"), ("first", "last")) for a, b in ((x, y), (y, x))]
    turned = cut.select("wayid", "segment", *both, "cost", "hops", graph.travel_time(F.col("cost"), F.col("speed")).alias("timecost"), F.when(F.col("oneway"), graph.ONE_WAY).otherwise(0).alias("type"), "oneway")
    members = source.relation_members(osm)
    kinds = pairs.where("kind = 'relation'").groupBy(F.col("objectid").alias("relid")).agg(F.max(F.when(F.col("key") == "type", F.col("value"))).alias("of"), F.max(F.when(F.col("key") == "restriction", F.col("value"))).alias("turn"))
    turns = members.drop("type").join(kinds.where("of = 'restriction'").select("relid", F.col("turn").alias("type")), "relid")
    restrictions = graph.turn_restrictions(turns, nodes.join(ends, "verid", "left_semi"))
    edge, split, arrivals = graph.restricted_graph(turned, restrictions, nodes.select("verid", "lat", "lon"))
    objects = pairs.where("kind in ('node', 'way')").select(F.when(F.col("kind") == "way", F.col("objectid") * 2 + 1).otherwise(F.col("objectid") * 2).alias("objectid"), "kind", F.col("objectid").alias("osm"), "key", "value")
    free, fixed = search.store_tags(objects.select("objectid", "key", "value"), config)
    places = nodes.select((F.col("verid") * 2).alias("objectid"), "lat", "lon").unionByName(source.way_places(osm).select((F.col("wayid") * 2 + 1).alias("objectid"), "lat", "lon"))
    return {
        "vertex": nodes.join(ends, "verid", "left_semi").select("verid", "lat", "lon").unionByName(split), "edge": edge, "arrivals": arrivals, "turn_restrictions": restrictions, "osm": free, "osm_tag_fixed": fixed,
        "osm_fulltext": search.search_documents(objects.select("objectid", "key", "value"), places, config), "objectkdtree": places,
        "osm_id": objects.select(F.col("objectid").alias("internal_id"), F.concat(F.substr("kind", F.lit(1), F.lit(1)), F.col("osm").cast("string")).alias("osm_id")).distinct(),
        "osm_rel": members.select(F.col("relid").alias("groupid"), F.when(F.col("type") == "way", F.col("ref") * 2 + 1).otherwise(F.col("ref") * 2).alias("objectid"), F.col("pos").alias("objectorder")),
    }
