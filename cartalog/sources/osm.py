"""Map extracts, as XML or PBF, read by a data source of its own: one row per node, way or relation.

spark.dataSource.register(OsmSource); spark.read.format("osm").load(path). A PBF file is split at its blobs, which are found by their headers
without being read, so blobs are decoded in parallel; an XML file is one split. Both are plain Python over protobuf's wire format and zlib.
"""

from __future__ import annotations

import glob
import os
import struct
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "kind string, id bigint, lat double, lon double, tags array<struct<key:string,value:string>>, refs array<bigint>, members array<struct<type:string,ref:bigint,role:string>>"
#: Blobs that one task decodes, about 8 MB each when decoded.
BLOBS_A_TASK = 8
KINDS = ("node", "way", "relation")
Row = tuple


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: whole numbers, or bytes for anything with a length."""
    at, end = 0, len(data)
    while at < end:
        key, at = varint(data, at)
        match key & 7:
            case 0:
                value, at = varint(data, at)
            case 1:
                value, at = data[at : at + 8], at + 8
            case 2:
                size, at = varint(data, at)
                value, at = data[at : at + size], at + size
            case 5:
                value, at = data[at : at + 4], at + 4
            case kind:
                raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        v, at = varint(data, at)
        out.append(v)
    return out


def zigzag(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def summed(data: bytes) -> list[int]:
    out, now = [], 0
    for v in packed(data):
        now += zigzag(v)
        out.append(now)
    return out


def blobs(path: str) -> Iterator[tuple[int, int, str]]:
    """(offset, size, type) of the blobs of a PBF file, from their headers."""
    with open(path, "rb") as f:
        while head := f.read(4):
            header = dict(fields(f.read(struct.unpack(">I", head)[0])))
            size = header[3]
            yield f.tell(), size, header[1].decode()
            f.seek(size, 1)


def blob_rows(blob: bytes) -> Iterator[Row]:
    parts = dict(fields(blob))
    data = parts[1] if 1 in parts else zlib.decompress(parts[3])
    strings: list[str] = []
    groups, units, lat0, lon0 = [], 100, 0, 0
    for number, value in fields(data):
        match number:
            case 1:
                strings = [s.decode("utf-8", "replace") for _, s in fields(value)]
            case 2:
                groups.append(value)
            case 17:
                units = value
            case 19:
                lat0 = value
            case 20:
                lon0 = value
    place = lambda v, zero: (zero + units * v) / 1e9
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    lat0, lon0 = signed(lat0), signed(lon0)
    for group in groups:
        for number, value in fields(group):
            if number == 2:
                dense = dict(fields(value))
                keys = iter(packed(dense.get(10, b"")))
                for i, lat, lon in zip(summed(dense[1]), summed(dense[8]), summed(dense[9]), strict=True):
                    tags = []
                    while k := next(keys, 0):
                        tags.append((strings[k], strings[next(keys)]))
                    yield "node", i, place(lat, lat0), place(lon, lon0), tags, None, None
                continue
            if number not in (1, 3, 4):
                continue
            m: dict = dict(fields(value))
            tags = [(strings[k], strings[v]) for k, v in zip(packed(m.get(2, b"")), packed(m.get(3, b"")), strict=True)]
            if number == 1:
                yield "node", zigzag(m[1]), place(zigzag(m[8]), lat0), place(zigzag(m[9]), lon0), tags, None, None
            elif number == 3:
                yield "way", m[1], None, None, tags, summed(m.get(8, b"")), None
            else:
                members = [(KINDS[t], ref, strings[role]) for role, ref, t in zip(packed(m.get(8, b"")), summed(m.get(9, b"")), packed(m.get(10, b"")), strict=True)]
                yield "relation", m[1], None, None, tags, None, members


def xml_rows(path: str) -> Iterator[Row]:
    for _, e in ET.iterparse(path):
        if e.tag not in KINDS:
            continue
        tags = [(t.get("k"), t.get("v")) for t in e.iter("tag")]
        if e.tag == "node":
            yield "node", int(e.get("id")), float(e.get("lat")), float(e.get("lon")), tags, None, None
        elif e.tag == "way":
            yield "way", int(e.get("id")), None, None, tags, [int(n.get("ref")) for n in e.iter("nd")], None
        else:
            yield "relation", int(e.get("id")), None, None, tags, None, [(m.get("type"), int(m.get("ref")), m.get("role") or "") for m in e.iter("member")]
        e.clear()


class Part(InputPartition):
    def __init__(self, path: str, spans: list[tuple[int, int]] | None) -> None:
        self.path, self.spans = path, spans


class OsmReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.paths = sorted(glob.glob(f"{path}/*") if os.path.isdir(path) else glob.glob(path))

    def partitions(self) -> list[Part]:
        out: list[Part] = []
        for path in self.paths:
            if not path.endswith(".pbf"):
                out.append(Part(path, None))
                continue
            spans = [(at, size) for at, size, kind in blobs(path) if kind == "OSMData"]
            out += [Part(path, spans[k : k + BLOBS_A_TASK]) for k in range(0, len(spans), BLOBS_A_TASK)]
        return out

    def read(self, partition: Part) -> Iterator[Row]:
        if partition.spans is None:
            yield from xml_rows(partition.path)
            return
        with open(partition.path, "rb") as f:
            for at, size in partition.spans:
                f.seek(at)
                yield from blob_rows(f.read(size))


class OsmSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> OsmReader:
        return OsmReader(self.options["path"])


def node_points(osm: DataFrame) -> DataFrame:
    return osm.where("kind = 'node'").select(F.col("id").alias("verid"), "lat", "lon")


def way_refs(osm: DataFrame) -> DataFrame:
    return osm.where("kind = 'way'").select(F.col("id").alias("wayid"), F.posexplode("refs").alias("pos", "verid"))


def object_tags(osm: DataFrame) -> DataFrame:
    return osm.select("kind", F.col("id").alias("objectid"), F.inline("tags"))


def relation_members(osm: DataFrame) -> DataFrame:
    rows = osm.where("kind = 'relation'").select(F.col("id").alias("relid"), F.posexplode("members").alias("pos", "m"))
    return rows.select("relid", "pos", "m.type", "m.ref", "m.role")


def way_places(osm: DataFrame) -> DataFrame:
    """(wayid, lat, lon): closed ways by the mean of their points, open ones by their middle point; ways with a missing point are left out."""
    refs = way_refs(osm)
    placed = refs.join(node_points(osm), "verid").groupBy("wayid").agg(F.array_sort(F.collect_list(F.struct("pos", "verid", "lat", "lon"))).alias("p"), F.avg("lat").alias("alat"), F.avg("lon").alias("alon"))
    whole = placed.join(refs.groupBy("wayid").agg(F.count(F.lit(1)).alias("n")), "wayid").where(F.size("p") == F.col("n"))
    closed = (F.col("p")[0]["verid"] == F.element_at("p", -1)["verid"]) & (F.col("n") > 1)
    middle = F.element_at("p", (F.floor(F.col("n") / 2) + 1).cast("int"))
    middle = F.when(F.col("n") == 1, F.col("p")[0]).otherwise(middle)
    return whole.select("wayid", F.when(closed, F.col("alat")).otherwise(middle["lat"]).alias("lat"), F.when(closed, F.col("alon")).otherwise(middle["lon"]).alias("lon"))
