import struct
import zlib

import pytest

from cartalog.api import MapFile, Service, ingest, map_info_rows
from cartalog.operators import graph
from cartalog.plans.relational import FIXED
from cartalog.sources import files
from cartalog.sources.osm import OsmSource

NODES = [(k, 49.0 + k / 1000, 7.0 + (k % 3) / 1000, {"amenity": "cafe", "name": f"Café {k}"} if k % 4 == 0 else {}) for k in range(1, 13)]
WAYS = [(100, [1, 2, 3, 4, 5], {"highway": "primary", "name": "Main Road"}), (101, [3, 6, 7], {"highway": "residential", "oneway": "yes"}), (102, [8, 9, 10, 8], {"building": "retail"}), (103, [1, 11], {"highway": "footway"})]
RELATIONS = [(200, [("way", 100, "from"), ("node", 3, "via"), ("way", 101, "to")], {"type": "restriction", "restriction": "no_left_turn"})]


def xml():
    tags = lambda t: "".join(f'<tag k="{k}" v="{v}"/>' for k, v in t.items())
    out = [f'<node id="{i}" lat="{a}" lon="{o}">{tags(t)}</node>' for i, a, o, t in NODES]
    out += [f'<way id="{i}">{"".join(f"<nd ref=\"{r}\"/>" for r in refs)}{tags(t)}</way>' for i, refs, t in WAYS]
    out += [f'<relation id="{i}">{"".join(f"<member type=\"{k}\" ref=\"{r}\" role=\"{o}\"/>" for k, r, o in m)}{tags(t)}</relation>' for i, m, t in RELATIONS]
    return f'<?xml version="1.0" encoding="UTF-8"?><osm>{"".join(out)}</osm>'


def number(v):
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    return bytes([*out, v])


def part(field, data):
    return number(field << 3 | 2) + number(len(data)) + data if isinstance(data, bytes) else number(field << 3) + number(data)


def zig(v):
    return v << 1 if v >= 0 else (-v << 1) - 1


def deltas(values):
    return b"".join(number(zig(b - a)) for a, b in zip([0, *values], values, strict=False))


def pbf():
    strings = [""]
    at = lambda s: strings.index(s) if s in strings else strings.append(s) or len(strings) - 1
    units = lambda v: round(v * 1e7)
    keys = b"".join(b"".join(number(at(k)) + number(at(v)) for k, v in t.items()) + b"\0" for *_, t in NODES)
    dense = part(1, deltas([n[0] for n in NODES])) + part(8, deltas([units(n[1]) for n in NODES])) + part(9, deltas([units(n[2]) for n in NODES])) + part(10, keys)
    tags = lambda t: part(2, b"".join(number(at(k)) for k in t)) + part(3, b"".join(number(at(v)) for v in t.values()))
    ways = b"".join(part(3, part(1, i) + tags(t) + part(8, deltas(refs))) for i, refs, t in WAYS)
    kinds = {"node": 0, "way": 1, "relation": 2}
    relations = b"".join(part(4, part(1, i) + tags(t) + part(8, b"".join(number(at(r)) for _, _, r in m)) + part(9, deltas([r for _, r, _ in m])) + part(10, bytes(kinds[k] for k, _, _ in m))) for i, m, t in RELATIONS)
    out = b""
    for kind, block in (("OSMHeader", b""), *[("OSMData", part(2, g)) for g in (part(2, dense), ways, relations)]):
        block = part(1, b"".join(part(1, s.encode()) for s in strings)) + block
        blob = part(2, len(block)) + part(3, zlib.compress(block))
        header = part(1, kind.encode()) + part(3, len(blob))
        out += struct.pack(">I", len(header)) + header + blob
    return out


@pytest.fixture(scope="module")
def extracts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("osm")
    (folder / "a.osm").write_text(xml())
    (folder / "a.osm.pbf").write_bytes(pbf())
    spark.dataSource.register(OsmSource)
    return {k: spark.read.format("osm").load(str(folder / k)) for k in ("a.osm", "a.osm.pbf")}


def plain(df):
    return sorted((r["kind"], r["id"], round(r["lat"], 6) if r["lat"] else None, round(r["lon"], 6) if r["lon"] else None, sorted(tuple(t) for t in r["tags"]), r["refs"], [tuple(m) for m in r["members"]] if r["members"] else None) for r in df.collect())


def test_both_formats_give_the_extract(extracts):
    want = [("node", i, round(a, 6), round(o, 6), sorted(t.items()), None, None) for i, a, o, t in NODES] + [("way", i, None, None, sorted(t.items()), refs, None) for i, refs, t in WAYS] + [("relation", i, None, None, sorted(t.items()), None, m) for i, m, t in RELATIONS]
    assert plain(extracts["a.osm"]) == sorted(want) == plain(extracts["a.osm.pbf"])


@pytest.fixture(scope="module")
def tables(extracts):
    return ingest(extracts["a.osm"], {**FIXED, "building": ("retail",)})


def test_ingest(spark, tables):
    # 3 may be left in every direction and arrived at from all; over it leads only 100, as the turn into 101 is forbidden.
    pairs = [(0, 1, 5), (1, 5, 1), (2, 1, 7), (3, 5, 7), (4, 3, 7), (5, 3, 1), (6, 1, {r["verid"]: r["arrival"] for r in tables["arrivals"].collect()}[3])]
    paths = {r["pair"]: r["path"] for r in graph.expanded(graph.routes(tables["edge"], spark.createDataFrame(pairs, "pair int, src bigint, dst bigint")), tables["edge"]).collect()}
    assert all(3 in paths[k] and paths[k][0] == a and paths[k][-1] == b for k, a, b in pairs[:2] + pairs[4:6]) and paths[2] == paths[3] == [] and paths[6][0] == 1
    assert [tuple(r) for r in tables["turn_restrictions"].collect()] == [(100, 101, 3, "no_left_turn")]
    docs = {r["docid"]: r["tokens"] for r in tables["osm_fulltext"].collect()}
    assert {"cafe", "8"} <= set(docs[16]) and "amenity=cafe" in docs[16]
    assert {r["verid"] for r in tables["vertex"].collect()} >= {1, 3, 5, 7}
    places = {r["objectid"]: round(r["lat"], 6) for r in tables["objectkdtree"].where("objectid % 2 = 1").collect()}
    assert places[205] == round((49.008 + 49.009 + 49.010 + 49.008) / 4, 6) and places[203] == 49.006


def test_service(spark, tables):
    osm = tables["osm"].unionByName(tables["osm_tag_fixed"].selectExpr("objectid", "split(tag, '=')[0] AS key", "split(tag, '=')[1] AS value"))
    service = Service(spark, {"m": MapFile(osm, tables["objectkdtree"], tables["osm_fulltext"], tables["edge"], tables["vertex"], arrivals=tables["arrivals"])})
    text = lambda endpoint, **a: service.call(endpoint, **a).first()["json"]
    assert '"objectid":16' in text("search_query", mapname="m", q="caf", tagsvals=[("amenity", "cafe")])
    assert '"objectid":16' in text("search_query", mapname="m", q="caf", near="49.008,7.002", limit=1)
    assert text("search_query", mapname="none").startswith('{"ok":false')
    assert '"objectid":24' in text("search_nearest", mapname="m", points="49.0121,7.0", decode=True)
    assert '"length"' in text("graph_route", mapname="m", waypoints="49.003,7.0|49.007,7.001") and '"path":[1,' in text("graph_route", mapname="m", waypoints="49.001,7.001|49.005,7.001", metric="time")
    assert '"path":[]' in text("graph_route", mapname="m", waypoints="49.001,7.001|49.007,7.001")
    assert "out of range" in text("graph_route", mapname="m", waypoints="99,7|49,7") and "two waypoints" in text("graph_route", mapname="m", waypoints="49,7")
    assert '"verid":3' in text("graph_nearest", mapname="m", lat=49.003, lon=7.0)
    assert '"mapname":"m"' in text("graph_load", mapname="m") and '"ok":false' in text("graph_unload", mapname="x") and '"response":[]' in text("graph_unload", mapname="m")
    assert '"name"' in text("match_tags", mapname="m", tag="na") and "bbox" in text("map_info", mapname="m") and '"m"' in text("list_maps")
    assert '"fresh"' in text("write_data", mapname="m", rows=[(16, "note", "fresh")])
    assert map_info_rows(tables["objectkdtree"]).count() == 3


def test_feed_and_files(spark, tmp_path):
    (tmp_path / "routes.txt").write_text('route_id,route_short_name,extra,route_type\n1,"A, B",x,3\n2,C,y\n3,D,z,0\n')
    rows = files.read_feed(spark, str(tmp_path), "routes").orderBy("route_id").collect()
    assert [(r["route_id"], r["route_short_name"], r["route_type"], r["agency_id"]) for r in rows] == [("1", "A, B", "3", None), ("3", "D", "0", None)]
    df = spark.createDataFrame([(1, 'a<b>&"c"', None)], "id int, name string, z string")
    assert df.select(files.xml_row(df.columns).alias("x")).first()["x"] == "<row><id>1</id><name>a&lt;b&gt;&amp;&quot;c&quot;</name></row>"
    assert files.json_rows(df).first()["json"] == '{"id":1,"name":"a<b>&\\"c\\""}'
    assert files.write_table(df, str(tmp_path), "t", ("id",)) == 1
    files.write_pipes(df, str(tmp_path), "p")
    files.write_feed(df, str(tmp_path), "f")
    assert files.find_file(str(tmp_path), "routes.txt") == str(tmp_path / "routes.txt") and files.find_file(str(tmp_path), "none") is None
    config = files.read_config('<c><property name="a"><property name="s" type="string">x</property><property name="b" type="boolean">true</property><property name="l" type="array"><value>1</value></property><property name="m" type="map"><pair key="k" value="v"/></property><property name="f" type="associativeArray"><entry key="k"><value>*</value></entry></property><property name="o" type="objects"><object><property name="n" type="string">y</property></object></property></property></c>')
    assert config == {"a": {"s": "x", "b": True, "l": ["1"], "m": {"k": "v"}, "f": {"k": ["*"]}, "o": [{"n": "y"}]}}


def test_streams(spark, sf, tmp_path):
    from cartalog.streaming.windows import latest_edits, sessions, windowed_counts

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = windowed_counts(stream, late="1000 days").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    rows = lambda df: sorted((r["start"], r["event_type"], r["n"], round(r["total"], 4)) for r in df.collect())
    assert rows(spark.table("counts")) == rows(windowed_counts(events))
    assert sessions(events).agg({"n": "sum"}).first()[0] == events.count()
    tags = spark.read.parquet(f"{sf}/osm_tags.parquet")
    assert latest_edits(tags).count() == tags.select("objectid", "key").distinct().count()
