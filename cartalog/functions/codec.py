"""Bytes and texts of geometries: polylines, WKT, WKB and stored geometries, coded batch by batch."""

from __future__ import annotations

import struct
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StringType, StructField, StructType

#: Units a degree in polylines, the mark after each ring, and the flags in a stored geometry's first byte.
POLYLINE_UNITS, RING_MARK = 100_000, "\t"
COMPRESSED, POINT, LINE, POLYGON, MULTIPOLYGON = 1, 2, 4, 6, 8

POINTS = ArrayType(StructType([StructField("lat", DoubleType()), StructField("lon", DoubleType())]))
Pair = tuple[float, float]


def _pairs(points: Iterable | None) -> list[Pair]:
    return [] if points is None else [(p["lat"], p["lon"]) for p in points]


def encode_line(points: list[Pair]) -> str:
    """Differences in units cut off towards zero, in groups of five bits, the lowest first."""
    out, before = [], (0, 0)
    for point in points:
        now = tuple(int(v * POLYLINE_UNITS) for v in point)
        for a, b in zip(now, before, strict=True):
            bits = (a - b) << 1
            bits = ~bits if a < b else bits
            while bits >= 32:
                out.append(chr((bits & 31 | 32) + 63))
                bits >>= 5
            out.append(chr(bits + 63))
        before = now
    return "".join(out)


def decode_line(text: str) -> list[Pair]:
    values, bits, shift = [], 0, 0
    for ch in text:
        part = ord(ch) - 63
        bits |= (part & 31) << shift
        shift += 5
        if part < 32:
            values.append(~(bits >> 1) if bits & 1 else bits >> 1)
            bits = shift = 0
    lat = lon = 0
    points = []
    for k in range(0, len(values) - 1, 2):
        lat, lon = lat + values[k], lon + values[k + 1]
        points.append((lat / POLYLINE_UNITS, lon / POLYLINE_UNITS))
    return points


def encode_rings(rings: list[list[Pair]]) -> str:
    return "".join(encode_line(ring) + RING_MARK for ring in rings)


def decode_rings(text: str) -> list[list[Pair]]:
    return [decode_line(part) for part in text.split(RING_MARK)[:-1]]


def wkb(points: list[Pair], kind: int) -> bytes:
    """Little-endian WKB with x as longitude: 1 a point, 2 a line, 3 a polygon of one ring."""
    flat = [v for lat, lon in points for v in (lon, lat)]
    if kind == 1:
        return struct.pack("<BI2d", 1, 1, *flat[:2])
    head = struct.pack("<BI", 1, kind) + (struct.pack("<I", 1) if kind == 3 else b"")
    return head + struct.pack("<I", len(points)) + struct.pack(f"<{len(flat)}d", *flat)


def read_wkb(data: bytes) -> list[Pair]:
    order = "<" if data[0] == 1 else ">"
    (kind,) = struct.unpack_from(order + "I", data, 1)
    at, count = 5, 1
    if kind == 3:
        at += 4
    if kind != 1:
        (count,) = struct.unpack_from(order + "I", data, at)
        at += 4
    flat = struct.unpack_from(f"{order}{2 * count}d", data, at)
    return [(flat[k + 1], flat[k]) for k in range(0, len(flat), 2)]


def stored(points: list[Pair], compress: bool) -> bytes:
    """A flag byte, then a polyline or pairs of doubles."""
    kind = POINT if len(points) == 1 else LINE
    body = encode_line(points).encode("latin-1") if compress else struct.pack(f"<{2 * len(points)}d", *[v for p in points for v in p])
    return bytes([kind | COMPRESSED * compress]) + body


def read_stored(data: bytes) -> list[Pair]:
    if data[0] & COMPRESSED:
        return decode_line(data[1:].decode("latin-1"))
    flat = struct.unpack_from(f"<{(len(data) - 1) // 8}d", data, 1)
    return list(zip(flat[0::2], flat[1::2], strict=True))


def _rows(points: list[Pair]) -> list[dict[str, float]]:
    return [{"lat": lat, "lon": lon} for lat, lon in points]


def to_polyline(points: Column) -> Column:
    def code(batch: pd.Series) -> pd.Series:
        return batch.map(lambda p: None if p is None else encode_line(_pairs(p)))

    return F.pandas_udf(code, StringType())(points)


def from_polyline(text: Column) -> Column:
    def code(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: None if t is None else _rows(decode_line(t)))

    return F.pandas_udf(code, POINTS)(text)


def to_wkb(points: Column, kind: int) -> Column:
    def code(batch: pd.Series) -> pd.Series:
        return batch.map(lambda p: None if p is None or not len(p) else wkb(_pairs(p), kind))

    return F.pandas_udf(code, BinaryType())(points)


def from_wkb(data: Column) -> Column:
    def code(batch: pd.Series) -> pd.Series:
        return batch.map(lambda b: None if b is None else _rows(read_wkb(bytes(b))))

    return F.pandas_udf(code, POINTS)(data)


def to_stored(points: Column, compress: bool = True) -> Column:
    def code(batch: pd.Series) -> pd.Series:
        return batch.map(lambda p: None if p is None or not len(p) else stored(_pairs(p), compress))

    return F.pandas_udf(code, BinaryType())(points)


def from_stored(data: Column) -> Column:
    def code(batch: pd.Series) -> pd.Series:
        return batch.map(lambda b: None if b is None else _rows(read_stored(bytes(b))))

    return F.pandas_udf(code, POINTS)(data)


def wkt_line(points: Column) -> Column:
    """LINESTRING with x as longitude and six decimals; native."""
    texts = F.transform(points, lambda p: F.format_string("%.6f %.6f", p["lon"], p["lat"]))
    return F.concat(F.lit("LINESTRING ("), F.array_join(texts, ", "), F.lit(")"))


def wkt_polygon(rings: Column) -> Column:
    texts = F.transform(rings, lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.format_string("%.6f %.6f", p["lon"], p["lat"])), ", "), F.lit(")")))
    return F.concat(F.lit("POLYGON ("), F.array_join(texts, ", "), F.lit(")"))


def from_wkt_line(text: Column) -> Column:
    parts = F.regexp_extract_all(text, F.lit("(-?[0-9.]+ -?[0-9.]+)"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.split(p, " ")[1].cast("double").alias("lat"), F.split(p, " ")[0].cast("double").alias("lon")))
